"""Chat formatting with the template as a black box.

The template is any function from messages to a string.  Turn spans are not asked of it: successive prefixes of the
conversation are rendered and consecutive outputs compared.  Where an output starts with the one before it, the rest
is the new turn's span; where it does not, the template rewrites history, and the turn is flagged.  Inside a span the
text's place is found by rendering the turn once more with a one-character probe instead of its text.

Every template is rendered on the whole prefix of every turn, so work grows with the square of a conversation's turns.
Only a template that states ``turn_local`` (each turn's piece depends on that turn alone, and the head on whether the
messages open the conversation) is rendered in windows of ``window`` turns, which give the same pieces with bounded work
and memory per turn.

Defined results: null texts and roles count as empty; a null conversation id is a conversation of its own; turns are
ordered by (turn, role, text), nulls first, so ties and repeated rows have one order; very long texts stay whole; an empty
table has no conversations; columns beside conv_id, turn, role and text are ignored, whatever their names.

A conversation's turns are rendered in their order, so one conversation is one task's work, however long; its rows stream by.
"""

from __future__ import annotations

import hashlib
import inspect
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.words import by_rows

Message = tuple[str, str]
#: messages (and, if it takes a second argument, whether they open the conversation) -> rendered string
Template = Callable[[list[Message]], str] | Callable[[list[Message], bool], str]

_CONTROL = re.compile(r"<(?=\||/?s>)|\[(?=/?INST\])")
_TURN = re.compile(r"<\|turn:((?:\\.|[^|\\])*)\|>\n(.*?)<\|end\|>\n", re.S)
PROBE = "\ue000"


def escape(text: str) -> str:
    """Control strings lose their form by a backslash; backslashes are doubled, so ``unescape`` restores every text."""
    return _CONTROL.sub(r"\g<0>\\", text.replace("\\", "\\\\"))


def escape_role(role: str) -> str:
    """Besides, every bar that isn't behind a backslash of an escape gets one, since a bar ends the role."""
    return re.sub(r"(\\.)|\|", lambda m: m[1] or r"\|", escape(role), flags=re.S)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def turn_marks(messages: list[Message], opening: bool = True) -> str:
    """The default template: one marked block a turn, texts and roles escaped."""
    head = "<|begin|>\n" if opening else ""
    return head + "".join(f"<|turn:{escape_role(r)}|>\n{escape(t)}<|end|>\n" for r, t in messages)


turn_marks.turn_local = True


def parse(formatted: str) -> list[Message]:
    """Messages of a string that ``turn_marks`` made."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def _takes_opening(template: Template) -> bool:
    try:
        inspect.signature(template).bind([], True)
    except (TypeError, ValueError):
        return False
    return True


def spans(messages: list[Message], template: Template, opening: bool = True) -> list[tuple[str, int, int, bool]]:
    """Per turn: what it adds to the output, where its text lies in that, and whether earlier output changed.

    After a rewrite the addition is what follows the common beginning of both outputs.
    """
    out, before = [], ""
    more = (opening,) if _takes_opening(template) else ()
    for i in range(len(messages)):
        now = template(messages[: i + 1], *more)
        rewrites = not now.startswith(before)
        start = len(before)
        if rewrites:
            start = next((k for k, (a, b) in enumerate(zip(now, before, strict=False)) if a != b), min(len(now), len(before)))
        probed = template([*messages[:i], (messages[i][0], PROBE)], *more)
        at = probed.rfind(PROBE)
        out.append((now[start:], at - start, len(now) - (len(probed) - at - 1) - start, rewrites))
        before = now
    return out


def format_turns(df: DataFrame, template: Template = turn_marks, learn: tuple[str, ...] = ("assistant",), window: int = 16) -> DataFrame:
    """One row a turn, in order within each partition: conv_id, turn_no, piece, loss_from, loss_to, rewrites.

    The pieces of a conversation in order are its formatted string; [loss_from, loss_to) of a piece is under the loss.
    """
    kind = df.select("conv_id").schema[0].dataType.simpleString()
    in_windows = getattr(template, "turn_local", False)
    ordered = df.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        key, held, done = object(), [], 0

        def flush() -> Iterator[tuple]:
            for i, (piece, lo, hi, rewrites) in enumerate(spans(held, template, done == 0)):
                learned = held[i][0] in learn
                yield key, done + i, piece, lo if learned else None, hi if learned else None, rewrites

        for conv, _, role, text in rows:
            if conv != key or type(conv) is not type(key):
                yield from flush()
                key, held, done = conv, [], 0
            elif in_windows and len(held) == window:
                yield from flush()
                done += len(held)
                held = []
            held.append((role or "", text or ""))
        yield from flush()

    return by_rows(ordered, run, f"conv_id {kind}, turn_no long, piece string, loss_from int, loss_to int, rewrites boolean")


def digests(formatted: DataFrame, read: Callable[[str], list[Message]] = parse) -> DataFrame:
    """One row per conversation, read back from the pieces alone, as they come in order."""
    kind = formatted.select("conv_id").schema[0].dataType.simpleString()

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        key, state = object(), None

        def row() -> tuple:
            n, turns, loss_chars, loss, size, rewrites = state
            return key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), size, rewrites

        for conv, piece, lo, hi, rewrites in rows:
            if conv != key or type(conv) is not type(key):
                if state:
                    yield row()
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, text in read(piece):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if lo is not None:
                text = unescape(piece[lo:hi])
                state[2] += len(text)
                state[3].update(text.encode("utf-8", "surrogatepass"))
            state[4] += len(piece)
            state[5] += rewrites
        if state:
            yield row()

    return by_rows(
        formatted.select("conv_id", "piece", "loss_from", "loss_to", "rewrites"),
        run,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_rewrites long",
    )


def own_conversation(df: DataFrame) -> DataFrame:
    """``df`` with the conversation -7, whose texts hold control strings."""
    text = "</s>[INST] ok [/INST]"
    more = df.sparkSession.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(more)
