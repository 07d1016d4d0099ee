"""Chat formatting: ties, repeats, empty tables, clashing columns and any text, against the messages themselves."""

import hashlib
import random

from sextant.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, piece int"


def test_ties_repeats_and_clashing_columns(spark):
    rows = [(1, 0, "user", "b", 1), (1, 0, "user", "a", 2), (1, 0, "user", "a", 3), (1, 0, None, "z", 4), (1, None, "assistant", "first", 5), (2, 3, "assistant", None, 6)]
    x = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(x)).collect()}
    order = [("assistant", "first"), ("", "z"), ("user", "a"), ("user", "a"), ("user", "b")]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == digest("".join(f"{r}\n{t}\n" for r, t in order)) and got[1].n_turns == 5
    assert got[1].loss_sha256 == digest("first") and got[2].loss_chars == 0 and got[2].loss_sha256 == digest("")
    assert chat.digests(chat.format_turns(x.limit(0))).count() == 0


def test_any_text_comes_back():
    rng = random.Random(1)
    bits = ["<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "\\", "\n", "<|end|>", "a", " ", "é", "|", "<", "[", "turn:", chat.PROBE]
    for _ in range(2000):
        messages = [("".join(rng.choices(bits, k=rng.randint(0, 4))).replace("\n", ""), "".join(rng.choices(bits, k=rng.randint(0, 12)))) for _ in range(rng.randint(1, 5))]
        assert chat.parse(chat.turn_marks(messages)) == messages
        if any(chat.PROBE in t for _, t in messages):
            continue
        for (piece, lo, hi, rewrites), (_, text) in zip(chat.spans(messages, chat.turn_marks), messages, strict=True):
            assert not rewrites and chat.unescape(piece[lo:hi]) == text


def test_a_rewrite_of_every_turn_is_flagged_every_time(spark):
    numbered = lambda m: f"{len(m)}:" + "".join(t for _, t in m)
    x = spark.createDataFrame([(1, i, "user", f"t{i}", 0) for i in range(20)], SCHEMA)
    assert sum(r.rewrites for r in chat.format_turns(x, numbered).collect()) == 19
