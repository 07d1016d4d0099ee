"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger row keeps the measurements and one failure bit per rule; a
policy is a version and a mask over those bits, so changing a policy, or asking what one rule alone removes, reads the
ledger and never the texts again.

Defined results: a null or empty text has no words, all measurements are 0 and the ``min_words`` bit is set; repeated
rows give repeated ledger rows; very long texts are measured whole; other input columns are ignored, whatever their names;
an empty table gives an empty ledger.  The id column may be null and is passed through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.words import SPACES, beside, by_rows

SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_bangs")


@dataclass(frozen=True)
class Rule:
    """``fails`` is a boolean column over the measurements, as SQL text that Spark and DuckDB read alike."""

    name: str
    fails: str


#: The position in this list is the rule's bit; add new rules at the end.
RULES = (
    Rule("min_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "n_lines >= 4 AND 10 * n_dup_lines > 5 * n_lines"),
    Rule("capitals", "10 * n_capitals > 4 * word_chars"),
    Rule("exclamations", "10 * n_bangs > 3 * n_words"),
    Rule("long_words", "word_chars > 25 * n_words"),
)
BASE = ("min_words", "repeated_windows")


def mask_of(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    return sum(1 << i for i, r in enumerate(rules) if r.name in names)


#: version -> names of the rules that reject.
POLICIES = {1: BASE, 2: tuple(r.name for r in RULES)}
CURRENT = 2


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        counts = Counter(windows)
        if len(counts) < len(windows):
            inside = bytearray(n)
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    inside[i : i + 3] = b"\1\1\1"
            repeated = sum(inside)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    chars = len(text or "") - (len(raw) - len(raw.translate(None, SPACES)))
    less = lambda drop: len(raw) - len(raw.translate(None, drop))
    return n, chars, less(SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines), less(CAPITALS), less(b"!")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """id, MEASURES and ``failures`` (one bit per rule), one row per input row; the text is read once."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, text in rows:
            yield key, *measure(text)

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    measured = by_rows(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    return measured.withColumn("failures", _bits(rules))


def _bits(rules: tuple[Rule, ...]) -> Column:
    bits: Column = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def keep(docs: DataFrame, names: tuple[str, ...], text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that a policy keeps, all columns; ids play no part, so null and repeated ones are judged row by row."""
    rows = beside(docs, text_col, lambda texts: [measure(t) for t in texts], ", ".join(f"{m} long" for m in MEASURES))
    return apply_policy(rows.withColumn("failures", _bits(rules)), names, rules).where("kept").select("_row.*")


def apply_policy(rows: DataFrame, names: tuple[str, ...], rules: tuple[Rule, ...] = RULES, to: str = "kept") -> DataFrame:
    return rows.withColumn(to, F.col("failures").bitwiseAND(F.lit(mask_of(names, rules)).cast("long")) == 0)


def ablations(rows: DataFrame, policies: dict[int, tuple[str, ...]] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per policy version and rule: rows that fail it, rows that fail nothing else, rows rejected with and without it.

    Documents are folded to one row per distinct bit pattern first, so what is exploded by policy and rule is bounded
    by the number of patterns and not by the number of documents.
    """
    spark = rows.sparkSession
    none = spark.createDataFrame([(0, 0)], "failures long, n long")  # so that an empty ledger has its zeros
    patterns = rows.groupBy("failures").agg(F.count(F.lit(1)).alias("n")).select("failures", "n").unionByName(none)
    table = [(v, r.name, mask_of(names, rules), 1 << i) for v, names in policies.items() for i, r in enumerate(rules) if r.name in names]
    masks = F.broadcast(spark.createDataFrame(table, "version int, rule string, mask long, bit long"))  # a row a policy and rule
    hit = F.col("failures").bitwiseAND(F.col("mask"))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return (
        patterns.crossJoin(masks)  # bit patterns times policies' rules, both bounded by the rules
        .groupBy("version", "rule")
        .agg(
            count(F.col("failures").bitwiseAND(F.col("bit")) != 0).alias("n_failing"),
            count(hit == F.col("bit")).alias("n_only_this"),
            count(hit != 0).alias("n_rejected"),
            count(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) != 0).alias("n_rejected_without"),
        )
    )
