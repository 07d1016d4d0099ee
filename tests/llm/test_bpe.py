"""The BPE operator against the tokenizers library: sharded automata, random Unicode, edge rows."""

import random

import pytest
import regex

from sextant.llm import bpe
from sextant.llm.queries import tokenizer_file

ALPHABET = [*"aAb́éΣσİI'’  \x85\x1c1२x\n\t", "<|endoftext|>", "'ll ", "\U0001f389"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    got = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    got.no_truncation()
    got.no_padding()
    return got


def wanted(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)


def test_shards_of_any_size_give_the_library_ids(spark, library):
    path, rng = tokenizer_file("word_bpe_49k.json"), random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", "x" * 200_000, "same same same"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "again", 1), (3, texts[3], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    for size, shard in ((200_000, 7), (40, 10), (0, 10)):
        shards = bpe.lexicon(docs, path, size=size, shard=shard)
        assert (len(shards) > 1) == (size > 0)
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids, r.decoded) for r in bpe.encode(docs, path, shards).collect())
        assert got == sorted((-1 if k is None else k, *wanted(library, t)) for k, t, _ in rows)
    none = docs.limit(0)
    assert bpe.encode(none, path, bpe.lexicon(none, path)).count() == 0


def test_words_are_cut_once_a_chunk(library, monkeypatch):
    """Chunks between white space, whatever stands in them, give the library's ids, and a chunk met again isn't cut again."""
    path, cut = tokenizer_file("word_bpe_49k.json"), []
    encoder = bpe.Encoder(path, [], remembered=500)

    class Counted:
        @staticmethod
        def findall(text, own=bpe._PIECES):
            cut.append(text)
            return own.findall(text)

    monkeypatch.setattr(bpe, "_PIECES", Counted)
    rng = random.Random(3)
    texts = ["don't they'll x2y\u00b2 na\u0308ive \u1e9e\u0130x don't"] * 3 + ["".join(rng.choice(ALPHABET) for _ in range(40)) for _ in range(400)] + ["a\x1fb c\x1d d", "a < b <c> <|endoftext|>don't", "\u2000\u3000\x85x\u180ey\u200bz"]
    assert list(encoder.encode(texts[:3])) == [wanted(library, t) for t in texts[:3]]
    assert len(cut) == len(set(cut)) == 4  # alphabetic chunks aren't cut at all
    assert list(encoder.encode(texts)) == [wanted(library, t) for t in texts]


def test_split_and_pieces_know_the_same_white_space():
    differ = {c for c in map(chr, range(0x110000)) if c.isspace() != bool(regex.match(r"\p{White_Space}", c))}
    assert differ == set("\x1c\x1d\x1e\x1f") and all(regex.match(r"\p{L}", c) for c in map(chr, range(0x110000)) if c.isalpha())


def test_least_count_takes_no_more_than_the_size(spark):
    counts = spark.createDataFrame([("a", 9000), ("b", 8200), ("c", 5), ("d", 5), ("e", 1)], "word string, n long")
    for size, want in ((5, 1), (4, 2), (3, 6), (2, 6), (1, 16384), (0, 16384)):
        least = bpe.least_count(counts, size)
        assert least == want and counts.where(counts.n >= least).count() <= size


def test_an_automaton_shares_suffixes_and_numbers_words():
    words = sorted(["walking", "talking", "talked", "walked", "tall", "ing"], key=str.encode)
    one = bpe.Lexicon(bpe.Lexicon.compile((w, [i, i + 1]) for i, w in enumerate(words)))
    assert one.find([w.encode() for w in words]).tolist() == list(range(6))
    assert one.find([b"walk", b"", b"talkings", b"zzz"]).tolist() == [-1] * 4
    assert [one.ids(i) for i in range(6)] == [[i, i + 1] for i in range(6)]
    assert len(one.finals) < sum(map(len, words)) // 2


def test_words_of_one_length_are_merged_together(library, monkeypatch):
    """No word of up to 40 bytes is merged by itself, and all have the ids of one merge after another."""
    path, rng, alone = tokenizer_file("word_bpe_49k.json"), random.Random(5), []
    encoder, merge = bpe.Encoder(path, [], remembered=300), bpe.WordBpe.merge
    words = ["".join(rng.choice("thenationsé'12ß́") for _ in range(rng.randint(1, 14))).lower() for _ in range(3000)] + ["aaaaaaa", "é", "x" * 40, "x" * 41, "the"]
    ids, sizes = encoder.bpe.merge_all(words)
    want = [encoder.bpe.merge(w) for w in words]
    assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for own in want for i in own]
    assert [a.tolist() for a in encoder.bpe.merge_all([])] == [[], []]

    def counted(self, word):
        alone.append(word)
        return merge(self, word)

    monkeypatch.setattr(bpe.WordBpe, "merge", counted)
    for at in range(0, len(words), 250):  # the memory is full again and again
        texts = [" ".join(words[at : at + 250]), "<|endoftext|>".join(words[at : at + 9]), "<|ENDOFTEXT|> 49406 the"]
        assert list(encoder.encode(texts)) == [wanted(library, t) for t in texts]
    assert set(alone) <= {"x" * 41}
