"""Every stage of the pipeline against a brute-force version of it, on the smallest tables; rules' ledger and ablations."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sextant.llm import decontaminate, jaccard, quality, queries, rules
from sextant.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rules_hold(text):
    n, chars, symbols, dup, repeat, lines, capitals, bangs = rules.measure(text)
    return n >= 50 and 100 * repeat <= 50 * n and 10 * symbols <= 3 * n and not (lines >= 4 and 10 * dup > 5 * lines) and 10 * capitals <= 4 * chars and 10 * bangs <= 3 * n and chars <= 25 * n


def one_of_each(rows):
    sets = [set(jaccard.shingles(r.text, 5, jaccard._Hashes()).tolist()) for r in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    least = {}
    for i, r in enumerate(rows):
        key = top(i) if sets[i] else ("bare", i)
        if key not in least or r.doc_id < least[key].doc_id:
            least[key] = r
    return list(least.values())


def test_stages_and_run(spark, docs):
    from tokenizers import Tokenizer

    key = lambda rows: Counter(tuple(r) for r in rows)
    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    now = docs.collect()
    network = queries.quality_network(docs, labels)
    items = [decontaminate.normal(r.text) for r in benchmark.collect()]
    library = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()

    def clean(text):
        text = decontaminate.normal(text)
        return not any(decontaminate.myers(i, text, decontaminate.budget(len(i), 0.1, 12)) for i in items if i)

    brute = {
        "quality rules": lambda rows: [r for r in rows if rules_hold(r.text)],
        "quality classifier": lambda rows: [r for r in rows if network.score(np.array([quality.features(r.text, network.ratios)]))[0] >= corpus_pipeline.KEEP_AT],
        "near duplicates": one_of_each,
        "decontamination": lambda rows: [r for r in rows if clean(r.text)],
    }
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = brute[name](now)
        left = stage(spark, left, SF)
        assert left.columns == docs.columns
        left = spark.createDataFrame(left.collect(), docs.schema)
        assert key(left.collect()) == key(want), name
        assert 0 < len(want) <= len(now)
        now = want
    digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    want = Counter()
    for r in now:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_ledger_is_stored_once_and_read_by_policies_and_ablations(spark, docs, tmp_path):
    rules.ledger(docs).write.parquet(str(tmp_path / "ledger"))
    held = spark.read.parquet(str(tmp_path / "ledger"))
    rows = held.collect()
    for version, names in rules.POLICIES.items():
        kept = rules.apply_policy(held, names).where("kept").count()
        assert kept == sum(not any(r.failures >> i & 1 for i, x in enumerate(rules.RULES) if x.name in names) for r in rows)
        for got in rules.ablations(held).where(F.col("version") == version).collect():
            bit = [x.name for x in rules.RULES].index(got.rule)
            others = [i for i, x in enumerate(rules.RULES) if x.name in names and i != bit]
            failing = [r for r in rows if r.failures >> bit & 1]
            assert got.n_failing == len(failing)
            assert got.n_only_this == sum(not any(r.failures >> i & 1 for i in others) for r in failing)
            assert got.n_rejected == len(rows) - kept
            assert got.n_rejected_without == sum(any(r.failures >> i & 1 for i in others) for r in rows)
    assert {r.n_rejected for r in rules.ablations(held.limit(0)).collect()} == {0}
