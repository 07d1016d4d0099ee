"""Token files: per document against the tokenizers library, blocks against an exact round trip, bad checksums."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.llm import coder
from sextant.llm.queries import tokenizer_file


def round_trip(ids):
    ids = np.asarray(ids, "<u4")
    (code,) = coder.encode_blocks([ids])
    (back,) = coder.decode_blocks([code], [len(ids)])
    assert (back == ids).all()
    return len(code)


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 513, 1000, 5000, 70_001])
def test_blocks_of_any_length_come_back(n):
    rng = np.random.default_rng(n)
    round_trip(rng.zipf(1.3, n) % 65_536)


def test_blocks_of_one_length_are_coded_together_and_stay_apart():
    rng = np.random.default_rng(1)
    blocks = [(rng.zipf(1.2, n) % 50_000).astype("<u4") for n in (3000, 3000, 70, 3000)]
    alone = [coder.encode_blocks([b])[0] for b in blocks]
    assert coder.encode_blocks(blocks) == alone
    for b, got in zip(blocks, coder.decode_blocks(alone[::-1], [3000, 70, 3000, 3000])[::-1], strict=True):
        assert (b == got).all()


def test_predictions_pay():
    rng = np.random.default_rng(2)
    assert round_trip(np.zeros(100_000)) < 8_000
    assert round_trip(np.tile(rng.integers(0, 50_000, 500), 200)) < 60_000  # orders 1 and 2 name what follows
    skewed = rng.zipf(1.5, 100_000) % 65_536
    assert round_trip(skewed) < 0.85 * len(zlib.compress(skewed.astype("<u2").tobytes(), 9)) + 20_000
    assert round_trip(rng.integers(0, 65_536, 100_000)) < 220_000


def test_every_document_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    texts = ["two  spaces", "a\nb\n\nc", " lead", "trail ", "a \n b", "tab\tx y", "\n", None, "", "<|endoftext|> x", "é ü z", "same", "same", "long " * 60_000, "x\n y"]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(None, "none", 7), (11, "same", 7), (11, "other", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    got = coder.round_trip(docs, tokenizer_file("byte_bpe_50k.json")).collect()

    def want(text):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        return len(ids), zlib.crc32(ids.tobytes())

    key = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=key) == sorted(((k, *want(t)) for k, t, _ in rows), key=key)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *(r.n_tokens for r in ordered)])[:-1].tolist()
    assert [r.doc_id for r in ordered] == sorted((r.doc_id for r in got), key=lambda x: -1 if x is None else x)
    assert coder.round_trip(docs.limit(0), tokenizer_file("byte_bpe_50k.json")).count() == 0


def test_a_block_with_another_checksum_raises(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text here")], "doc_id long, text string")
    coder.write(docs, tokenizer_file("byte_bpe_50k.json"), str(tmp_path / "good"))
    spark.read.parquet(str(tmp_path / "good")).withColumn("crc", F.col("crc") + 1).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="checksum differs"):
        coder.read(spark, str(tmp_path / "bad")).collect()


def test_parts_met_often_outlast_a_full_memory():
    """What many batches hold goes to the library once, however many other parts come by."""
    tokens, sent = coder.Tokens(tokenizer_file("byte_bpe_50k.json"), remembered=60), []

    class Library:
        def __init__(self, own):
            self.own = own

        def __getattr__(self, name):
            return getattr(self.own, name)

        def encode_batch_fast(self, texts, **how):
            sent.extend(texts)
            return self.own.encode_batch_fast(texts, **how)

    plain, tokens.library = tokens.library, Library(tokens.library)
    for i in range(40):
        texts = [f"so often met here w{i}a w{i}b\nline w{i}c often" for _ in range(3)] + ["", f"  two{i}", f"w{i}a"]
        got = [ids.tolist() for ids in tokens(texts)]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert " ".join(sent).split().count("often") == " ".join(sent).split().count("line") == 1
    assert len(tokens.memory.place) <= 60


def test_a_word_goes_to_the_library_once_whatever_signs_end_it():
    tokens, sent = coder.Tokens(tokenizer_file("byte_bpe_50k.json")), []

    class Library:
        def __init__(self, own):
            self.own = own

        def __getattr__(self, name):
            return getattr(self.own, name)

        def encode_batch_fast(self, texts, **how):
            sent.extend(texts)
            return self.own.encode_batch_fast(texts, **how)

    plain, tokens.library = tokens.library, Library(tokens.library)
    texts = ["so zweifelnd, zweifelnd. zweifelnd!!", "x zweifelnd### zweifelnd\nline zweifelnd;", "y zweifelnd, zweifelnd?!"]
    assert [ids.tolist() for ids in tokens(texts[:2]) + tokens(texts[2:])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert sum(" ".join(sent).count(w) for w in (" zweifelnd", "\nzweifelnd")) == 1


def test_words_and_signs_in_any_mix_equal_the_library():
    rng = np.random.default_rng(4)
    pieces = ["word", "Straße", "éa", "don't", "it's,", "'s", "'", ",", ".", "!!", "###", "<|endoftext|>", "<|", "_", "12", "x2", "東京", "é", "×", "÷", "ɏ", "ɐ", " ", " ", "\r", "\t", "\x1c", " ", " ", " ", "\n", "\n\n", "  "]
    texts = ["".join(rng.choice(pieces, rng.integers(1, 30))) for _ in range(3000)]
    tokens = coder.Tokens(tokenizer_file("byte_bpe_50k.json"), remembered=500)
    for at in range(0, len(texts), 300):
        got = [ids.tolist() for ids in tokens(texts[at : at + 300])]
        assert got == [tokens.library.encode(t, add_special_tokens=False).ids for t in texts[at : at + 300]]
