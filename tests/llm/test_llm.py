"""Small tables with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from sextant.llm import bpe, chat, coder, decontaminate, html, jaccard, lm, quality, rules, urls  # noqa: E402
from sextant.llm.queries import tokenizer_file  # noqa: E402

SCHEMA = "doc_id long, text string, score double, host string, set string"


def text(seed: int, n: int = 80) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefg", k=rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = text(1)
    near = base.split()
    near[40] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, text(2)), (5, None), (6, ""), (7, "word"), (7, "word"), (8, "x" * 50_000), (None, text(3))]
    return spark.createDataFrame([(*r, 0.5, "h", "s") for r in rows], SCHEMA)


def test_rules(docs):
    got = rules.ledger(docs).collect()
    assert len(got) == 10 and all(r.n_words == 0 and r.failures & 1 for r in got if r.doc_id in (5, 6))
    assert rules.ledger(docs.limit(0)).count() == 0
    assert rules.measure("a b c a b c x")[4] == 6
    ab = {(r.version, r.rule): r for r in rules.ablations(rules.ledger(docs)).collect()}
    assert ab[(1, "min_words")].n_rejected >= 5


def test_quality_without_positives_and_with(spark, docs):
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    rng = np.random.default_rng(0)
    p, n = rng.normal(1, 0.3, (300, 14)), rng.normal(-1, 0.3, (300, 14))
    net = quality.fit_pu(p[:150], np.concatenate([p[150:], n]), 0.33, steps=200)
    assert (net.score(p) > 0.3).mean() > 0.95 and (net.score(n) < 0.3).mean() > 0.95


def test_bpe_is_the_library(docs):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    blob = bpe.lexicon(docs, path, size=50)
    want = sorted((r.doc_id or 0, " ".join(map(str, e.ids)), library.decode(e.ids, skip_special_tokens=False)) for r in docs.collect() for e in [library.encode(r.text or "", add_special_tokens=False)])
    assert sorted((r.doc_id or 0, r.ids, r.decoded) for r in bpe.encode(docs, path, blob).collect()) == want
    encoder = bpe.Encoder(path, blob)
    for t in ("ΑΣΣ it'LL <|endoftext|>é 12", "日本 🎉x"):
        assert next(encoder.encode([t]))[1] == " ".join(map(str, library.encode(t, add_special_tokens=False).ids))


def test_html():
    page = "<html><head><title>t</title></head><body><nav><a href=x>Menu</a></nav><article><h1>Big &amp; small</h1><p>One  sentence here.<p>Two.</article><footer>foot</footer>"
    assert html.main_text(page) == "Big & small\nOne sentence here.\nTwo."
    assert html.main_text(None) == "" and html.main_text("<p") is not None


def test_chat(spark):
    x = spark.createDataFrame([(1, 0, "user", "</s>[INST] \\ <|end|>"), (1, 1, "assistant", None), (1, 2, "assistant", "z" * 9), (None, 0, None, "q")] + [(2, i, "assistant", f"t{i}") for i in range(40)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(x)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 9 and got[2].n_turns == 40 and got[None].n_turns == 1
    whole = "".join(r.piece for r in chat.format_turns(x.where("conv_id = 2")).collect())
    assert chat.parse(whole) == [("assistant", f"t{i}") for i in range(40)]
    rewriting = lambda m, first: f"{len(m)}:" + "".join(t for _, t in m)
    assert [s[3] for s in chat.spans([("u", "a"), ("u", "b")], rewriting)] == [False, True]


def test_token_files(docs):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    got = coder.round_trip(docs, path).collect()
    library = Tokenizer.from_file(path)
    assert sum(r.n_tokens for r in got) == sum(len(library.encode(r.text or "").ids) + 1 for r in docs.collect())
    assert sorted(r.start for r in got) == sorted(np.cumsum([0] + [r.n_tokens for r in sorted(got, key=lambda r: r.start)])[:-1].tolist())


def test_jaccard(docs):
    got = {r.doc_id: r for r in jaccard.join(docs).collect()}
    assert (got[1].class_id, got[2].class_id) == (1, 1) and got[1].n_copies == 2
    a, b = (set(jaccard.shingles(t, 5, jaccard._Hashes()).tolist()) for t in (text(1), docs.where("doc_id = 3").first().text))
    assert (got[3].class_id == 1) == (len(a & b) / len(a | b) >= 0.8)
    assert got[4].class_id == 4 and got[5].n_links == 0 and got[6].class_id == 6 and got[7].n_copies == 2
    assert jaccard.join(docs.limit(0)).count() == 0


def test_decontaminate(spark, docs):
    item = text(9, 20)
    wrong = item[:30] + "#" + item[31:]
    held = docs.select("doc_id", "text").where("doc_id = 4").selectExpr("doc_id", f"concat(text, ' {wrong} ', text) AS text").unionByName(docs.select("doc_id", "text"))
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.distance) for r in decontaminate.find(held, bench).collect()] == [(4, 1, 1)]
    assert decontaminate.clean(held, bench.limit(0)).count() == held.count()
    twice = held.unionByName(spark.createDataFrame([(None, f"{text(5)} {item}"), (1, f"{text(6)} {item}")], held.schema))
    clean = decontaminate.clean(twice, bench, block_chars=1)
    assert clean.columns == held.columns
    assert sorted(map(repr, clean.collect())) == sorted(map(repr, held.where(~F.col("text").contains(wrong) | F.col("text").isNull()).collect()))


def test_stages_keep_whole_rows_without_ids(spark, docs):
    """Null and repeated ids and clashing columns: each row is judged alone, by the ledger's own verdict."""
    wide = docs.withColumn("n_words", F.lit("clash")).unionByName(docs.limit(0).withColumn("n_words", F.lit("")))
    kept = rules.keep(wide, rules.POLICIES[rules.CURRENT])
    want = [r for r in wide.collect() if rules.measure(r.text)[0] >= 50]
    assert kept.columns == wide.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, want))
    assert sorted(map(repr, quality.keep(wide, None, 0.3).collect())) == sorted(map(repr, wide.collect()))
    assert quality.keep(wide, None, 0.6).count() == 0 == rules.keep(wide.limit(0), rules.BASE).count()
    assert {r.doc_id for r in jaccard.keep_one(docs).collect()} == {None, 1, 4, 5, 6, 7, 8}


def test_jaccard_pairs_inside_a_hot_passage_equal_brute_force(spark):
    """Pairs of near copies at just over the threshold, in texts that share a passage: buckets split to the last depth."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    passage, rows = [word() for _ in range(120)], []
    for i in range(400):
        own = [word() for _ in range(124)]
        other = own.copy()
        for k in (15, 39, 63, 87, 111):
            other[k] = word()
        rows += [(2 * i, " ".join(passage + own)), (2 * i + 1, " ".join(passage + other))]
    sets = [set(jaccard.shingles(t, 5, jaccard._Hashes()).tolist()) for _, t in rows]
    want = {2 * i + e: int(len(sets[2 * i] & sets[2 * i + 1]) >= 0.8 * len(sets[2 * i] | sets[2 * i + 1])) for i in range(400) for e in (0, 1)}
    assert sum(want.values()) == 800
    runs = jaccard.runs_for(0.8, 0.9999)
    assert (1 - 0.8 ** (jaccard.DEPTH + 1)) ** runs <= 1e-4
    got = {r.doc_id: r.n_links for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), limit=4).collect()}
    assert got == want


def test_jaccard_null_ids_and_repeated_rows_by_row_counts(spark):
    near = text(31).split()
    near[40] = "changed"
    rows = [(None, text(31)), (8, " ".join(near)), (None, text(32)), (9, text(32)), (9, text(32)), (7, "word"), (7, "word"), (None, text(33)), (None, text(33)), (None, text(34)), (5, None), (6, " ")]
    x = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(jaccard.shingles(rows[i][1], 5, jaccard._Hashes()).tolist()) for i in (0, 1)]
    assert len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])
    got = sorted(((r.doc_id or 0, r.class_id or 0, r.n_links, r.n_copies) for r in jaccard.join(x).collect()))
    assert got == sorted([(0, 8, 1, 1), (8, 8, 1, 1), (0, 9, 2, 3), (9, 9, 2, 3), (9, 9, 2, 3), (7, 7, 1, 2), (7, 7, 1, 2), (0, 0, 1, 2), (0, 0, 1, 2), (0, 0, 0, 1), (5, 5, 0, 1), (6, 6, 0, 1)])
    kept = sorted((r.doc_id or 0, r.text or "") for r in jaccard.keep_one(x).collect())
    assert kept == sorted([(8, rows[1][1]), (9, text(32)), (7, "word"), (0, text(33)), (0, text(34)), (5, ""), (6, " ")])


def test_chat_black_box_templates_see_whole_prefixes(spark):
    messages = [("user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(40)]
    x = spark.createDataFrame([(1, i, *m) for i, m in enumerate(messages)], "conv_id long, turn long, role string, text string")
    late = lambda m: "".join(f"{r}:{'cut' if i == 3 and len(m) > 16 else t};" for i, (r, t) in enumerate(m))
    numbered = lambda m: "".join(f"{i} {r}:{t};" for i, (r, t) in enumerate(m))
    for template, rewrites in ((late, [16]), (numbered, []), (chat.turn_marks, [])):
        got = chat.format_turns(x, template).orderBy("turn_no").collect()
        whole = chat.spans(messages, template)
        assert [(r.piece, r.rewrites) for r in got] == [(s[0], s[3]) for s in whole]
        assert [r.turn_no for r in got if r.rewrites] == rewrites
        assert all(r.piece[r.loss_from : r.loss_to] == messages[r.turn_no][1] for r in got if r.loss_from is not None and not r.rewrites)
