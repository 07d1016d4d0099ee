"""Cross-tokenizer alignment against the libraries on whole texts, and counts by brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sextant.llm import align
from sextant.llm.queries import tokenizer_file

FILES = (tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def whole(libraries, text):
    """ids of both, and (A, B) slices between common ends, by comparing all prefixes of the whole text; None if bytes differ."""
    a, b = libraries
    if not text:
        return None
    letters = align.letters_of_bytes()
    ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != f" {text}".encode() or b"".join(bytes_b) != f" {text}".encode():
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    out, i, j = [], 0, 0
    for k, end in enumerate(ends_a):
        if end in ends_b:
            m = ends_b.index(end)
            out.append((ids_a[i : k + 1], ids_b[j : m + 1]))
            i, j = k + 1, m + 1
    return out


def brute(libraries, rows):
    groups = [whole(libraries, t) for _, t in rows]
    links = [Counter((x, y) for a, b in g or [] for x in a for y in b) for g in groups]
    count = Counter(p for own in links for p in own)
    highest = {}
    for (a, _), n in count.items():
        highest[a] = max(highest.get(a, 0), n)
    out = []
    for (key, _), g, own in zip(rows, groups, links, strict=True):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g or [])
        out.append((
            key, sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), sum(own.values()),
            sum(t for p, t in own.items() if count[p] == highest[p[0]]), sum(t * count[p] for p, t in own.items()), hashlib.sha256(text.encode()).hexdigest() if g else "",
        ))
    return out


def texts():
    rng = random.Random(3)
    words = ["the", "of", "unbelievable", "naïve", "Straße", "東京都", "🙂🙂", "x2=3;", "don't", "​", "ab\ncd", "é", "<|endoftext|>", "</s>", "<unk>", "▁", "a▁b", " ", "--", "1234567"]
    out = [None, "", " ", "  ", "a", " lead", "trail ", "two  spaces", "a \n b", "tab\tx", "\n", "x  y", "x\u001c y", "　a  　 b", "same text", "same text", "東" * 500, "a" * 3000, "ab" * 1000, "the of " * 2000]
    return out + [rng.choice([" ", " ", "  ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(120)]


def test_rows_equal_brute_force(spark, libraries):
    rows = [*enumerate(texts()), (None, "no id"), (3, "same text")]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, pairs int").repartition(3)
    want = sorted(map(repr, brute(libraries, rows)))
    for common in (1_000_000, 50, 0):  # all counts broadcast, some, none
        assert sorted(map(repr, map(tuple, align.alignment(docs, *FILES, common=common).collect()))) == want
    assert align.alignment(docs.limit(0), *FILES).count() == 0


def test_groups_of_ids(spark, libraries):
    rows = [(1, "unbelievable 東京 x"), (2, None)]
    got = {r.doc_id: r for r in align.groups(spark.createDataFrame(rows, "doc_id long, text string"), *FILES).collect()}
    want = whole(libraries, rows[0][1])
    assert got[1].a_ids == [i for a, _ in want for i in a] and [(g.a, g.b) for g in got[1].groups] == [(len(a), len(b)) for a, b in want]
    assert got[2].a_ids == [] and got[2].groups == []


def test_every_code_point_in_units(libraries):
    """Units give the tokens of whole texts, whatever characters meet."""
    rng = random.Random(5)
    points = [chr(c) for c in [*range(0x3000), *range(0x3000, 0x110000, 41)] if not 0xD800 <= c < 0xE000]
    aligner = align.Aligner.of(*FILES)
    own = ["".join(rng.choice([" ", "", rng.choice(points), rng.choice("ab \n")]) + c for c in rng.sample(points, 40)) for _ in range(1500)]
    for text, units in zip(own, aligner(own), strict=True):
        g = whole(libraries, text)
        assert (b";".join(u[4] for u in units).decode() if units else None) == (";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g) if g else None)


def test_wide_groups_and_packing(monkeypatch):
    aligner = align.Aligner.of(*FILES)
    text = "東京都 unbelievable 🙂🙂 Straße"
    a, b = aligner.a.encode(f" {text}", add_special_tokens=False).ids, aligner.b.encode(text)
    want = aligner.align(f" {text}".encode(), a, b)
    monkeypatch.setattr(align, "WIDE", 0)  # every group but of one link each side is folded
    got = aligner.align(f" {text}".encode(), a, b)
    links = Counter(np.frombuffer(got[5], "<u4").tolist())
    for pairs, times in got[6]:
        links.update(dict(zip(pairs.tolist(), times.tolist(), strict=True)))
    assert got[6] and got[:5] == want[:5] and links == Counter(np.frombuffer(want[5], "<u4").tolist())
    p, t = np.array([5, 9, 2**32 - 1], np.uint32), np.array([1, 254, 70_000])
    got = align.unpack(*align.pack(p, t))
    assert got[0].tolist() == p.tolist() and got[1].tolist() == t.tolist()
    assert align.unpack(*align.pack(p[:0], t[:0]))[0].tolist() == []


class Counted:
    """A tokenizer that notes what it is sent."""

    def __init__(self, own, name, sent):
        self.own, self.name, self.sent = own, name, sent

    def __getattr__(self, name):
        if name != self.name:
            return getattr(self.own, name)

        def call(texts, **how):
            self.sent += [texts] if isinstance(texts, str) else texts
            return getattr(self.own, name)(texts, **how)

        return call


def flat(units):
    links = Counter(x for u in units for x in np.frombuffer(u[5], "<u4").tolist())
    for pairs, times in (w for u in units for w in u[6]):
        links.update(dict(zip(pairs.tolist(), times.tolist(), strict=True)))
    return b";".join(u[4] for u in units).decode(), links, tuple(sum(u[i] for u in units) for i in range(4))


def told(groups):
    text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
    links = Counter(x * align.IDS + y for a, b in groups for x in a for y in b)
    return text, links, (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values()))


def test_words_are_aligned_once_and_those_met_again_stay(libraries, monkeypatch):
    monkeypatch.setattr(align, "REMEMBERED", 60)
    aligner, sent_a, sent_b = align.Aligner(*FILES), [], []
    aligner.a, aligner.b = Counted(aligner.a, "encode_batch_fast", sent_a), Counted(aligner.b, "encode", sent_b)
    for i in range(40):
        texts = [f"zweifelnd, zweifelnd. x{i} zweifelnd!! y{i}", f"z{i} zweifelnd### w{i} zweifelnd; often", f"v{i} often"]
        for text, units in zip(texts, aligner(texts), strict=True):
            assert flat(units) == told(whole(libraries, text))
    for sent in (sent_a, sent_b):
        assert " ".join(sent).count("zweifelnd") == " ".join(sent).count("often") == 1
    assert len(aligner.units) <= 60


def test_words_and_signs_in_any_mix_equal_whole_texts(libraries):
    rng = random.Random(6)
    pieces = ["word", "Straße", "éa", "don't", "it's,", "'", ",", ".", "!!", "###", "<|endoftext|>", "<|", "</s>", "a<s>", "_", "12", "x2", "東京", "e\u0301", "×", "ɏ", "ɐ", "ﬁ", "½", "\r", "\t", "\u2028", " ", " ", " ", " ", "\n", "  ", "y" * 70]
    own = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(2500)]
    aligner = align.Aligner(*FILES)
    for at in range(0, len(own), 500):
        for text, units in zip(own[at : at + 500], aligner(own[at : at + 500]), strict=True):
            groups = whole(libraries, text)
            assert (flat(units) if units else None) == (told(groups) if groups else None), text
