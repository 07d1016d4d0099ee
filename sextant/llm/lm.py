"""Log-bilinear language model with noise-contrastive estimation, and the smoothed unigram base.

Tokens are lower-case (A-Z) words and one end per text.  Counts of all words over all training texts are made on the cluster.
The model's symbols are the end, all words that make up ``share`` of the training tokens or more (so at most 1 / share of
them, as many as the data have), and ``classes`` classes that hold every other word by its last two bytes.

The three symbols before a token (ends before a text's first) give a context vector, the sum of their vectors, each weighted
per dimension by its position: v(h) = sum_k c_k * r_(h_k).  Output is factored by groups of symbols of like frequency, each
level a log-bilinear score, s(g | h) = v . q_g + b_g and s(w | h) = v . q_w + b_w inside the group, so that a token is
normalised over some two times the root of all symbols: log P(w | h) = log softmax_g + log softmax_w, by batched matrix products.
A word of a class also has its smoothed share of the class.

Training is noise-contrastive: at either level the token's own score is told from those of symbols drawn from the unigram.
First every text counts: which symbol stood one, two or three before which is counted over all training texts, and all
parameters are trained on these counts, each position alone as the context.  Then whole contexts are trained on all training
texts: every task goes over all its texts from these parameters, and what the tasks reach is averaged, weighted by tokens.  Texts
become arrays of symbols once, which both passes read.

Counts of words beyond the ``head`` most frequent (a bound on what is broadcast) never reach a task whole: those words
leave the texts' tasks as rows and meet their counts in a join.

Defined results: null and empty texts have the end as their only token; words never seen in training have count 0; without
training texts N = V = 0 and every symbol is as likely as another of its group; very long texts are scored whole, in slices;
repeated rows are scored and counted each; ids may repeat or be null; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.core.shared import materialise
from sextant.llm.words import by_rows

#: Stands for the end; no word holds a newline.
END = b"\n"
LONGEST = 48


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def class_of(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-2:]) % classes


def count_words(docs: DataFrame, classes: int, text_col: str = "text") -> DataFrame:
    """word, class, n over all texts (the end as a newline); tasks add up first, in tables of bounded size."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: Counter = Counter()
        for (text,) in rows:
            held.update(tokens(text))
            if len(held) > 400_000:
                yield from out(held)
                held.clear()
        yield from out(held)

    def out(held: Counter) -> Iterator[tuple]:
        return ((w.decode("utf-8", "surrogatepass"), class_of(w, classes), n) for w, n in list(held.items()))

    return by_rows(docs.select(text_col), run, "word string, class int, n long").groupBy("word").agg(F.first("class").alias("class"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The bounded part of the counts that every task needs."""

    head: dict[bytes, int]  # word -> count
    symbols: dict[bytes, int]  # model word -> symbol
    classes: int
    n: int  # training tokens
    v: int  # distinct training tokens
    class_size: np.ndarray  # per class: tokens + distinct words + 1
    often: np.ndarray  # per symbol: training tokens

    @property
    def size(self) -> int:
        return len(self.symbols) + self.classes

    @property
    def kind(self) -> str:
        """Of a stored symbol."""
        return "<u2" if self.size <= 1 << 16 else "<u4"

    def symbol(self, word: bytes) -> int:
        return self.symbols.get(word, -1) if word in self.symbols else len(self.symbols) + class_of(word, self.classes)


def vocabulary(counts: DataFrame, head: int, share: float, classes: int) -> Vocabulary:
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = counts.where((F.length("word") <= LONGEST) & (F.col("word") != "\n")).orderBy(F.desc("n"), "word").limit(head).select("word", "n").toArrow()
    words = {w.encode("utf-8", "surrogatepass"): n for w, n in zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True)}
    chosen = [w for w, n in words.items() if n >= share * total.n]  # at most 1 / share
    ends = counts.where(F.col("word") == "\n").select("n").first()
    own = [ends.n if ends else 0, *(words[w] for w in chosen)]
    per = {r["class"]: (r.n, r.v) for r in counts.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    inside: dict[int, list[int]] = {}
    for w, n in zip([END, *chosen], own, strict=True):
        if n:
            part = inside.setdefault(class_of(w, classes), [0, 0])
            part[0] += n
            part[1] += 1
    size, rest = np.ones(classes), np.zeros(classes)
    for c, (n, v) in per.items():
        rest[c] = n - inside.get(c, (0, 0))[0]
        size[c] += rest[c] + v - inside.get(c, (0, 0))[1]
    if ends:
        words[END] = ends.n
    symbols = {w: i for i, w in enumerate([END, *chosen])}
    return Vocabulary(words, symbols, classes, int(total.n), int(total.v), size, np.concatenate([own, rest]))


class _Places(dict):
    """Head word -> its place in the head, other words -> -1."""

    def __init__(self, head: dict[bytes, int]):
        super().__init__((w, i) for i, w in enumerate(head))

    def __missing__(self, word: bytes) -> int:
        return -1


class _Symbols(dict):
    """word -> symbol, remembered for class words up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(vocabulary.symbols)
        self.own, self.fixed = vocabulary, len(vocabulary.symbols)

    def __missing__(self, word: bytes) -> int:
        got = self.fixed + class_of(word, self.own.classes)
        if len(self) < 300_000:
            self[word] = got
        return got


CONTEXT, DIMS = 3, 16
#: Tokens of a training step.
BATCH = 12288


class LogBilinear:
    """Parameters of the model; ``flat`` holds them all in one array, the others are views of it."""

    def __init__(self, often: np.ndarray, seed: int = 3):
        m = len(often)
        self.width = width = max(1, math.isqrt(max(0, m - 1)) + 1)  # symbols a group
        self.groups = groups = -(-m // width)
        order = np.argsort(-often, kind="stable")
        self.place = np.empty(m, np.int64)  # a symbol's row among the leaves: group * width + place in the group
        self.place[order] = np.arange(m)
        leaves = np.zeros(groups * width)
        leaves[self.place] = often + 0.5
        self.missing = leaves.reshape(groups, width) == 0
        leaf = leaves.reshape(groups, width) / leaves.reshape(groups, width).sum(1, keepdims=True)
        self.p_group, self.p_leaf = leaves.reshape(groups, width).sum(1) / leaves.sum(), leaf
        self.shapes = {"r": (m, DIMS), "c": (CONTEXT, DIMS), "qg": (groups, DIMS), "bg": (groups,), "q": (groups * width, DIMS), "b": (groups * width,)}
        self.flat = np.zeros(sum(math.prod(x) for x in self.shapes.values()), np.float32)
        self.r, self.c, self.qg, self.bg, self.q, self.b = self.views(self.flat).values()
        rng = np.random.default_rng(seed)
        self.r[:], self.q[:], self.qg[:] = (rng.normal(0, 0.3, x.shape) for x in (self.r, self.q, self.qg))
        self.c[:] = (1.0 / np.arange(1, CONTEXT + 1))[:, None]
        self.bg[:] = np.log(self.p_group)
        self.b[:] = np.log(np.maximum(leaf, 1e-12)).ravel()
        self.q.reshape(groups, width, DIMS)[self.missing] = 0

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The named parameters as parts of one array."""
        ends = itertools.accumulate(math.prod(x) for x in self.shapes.values())
        return {name: flat[end - math.prod(shape) : end].reshape(shape) for (name, shape), end in zip(self.shapes.items(), ends, strict=True)}

    def context(self, h: np.ndarray) -> np.ndarray:
        return sum(self.r.take(h[:, k], 0) * self.c[k] for k in range(CONTEXT))

    def log_probs(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Normalised log probability of each symbol w after the symbols h (a row each, the last one first)."""
        place = self.place[w]
        order = _order(place, len(self.b))
        place, v = place[order], self.context(h[order])
        group = place // self.width
        s = self.qg @ v.T + self.bg[:, None]
        got = s[group, np.arange(len(w))] - _log_sum(s)
        cuts = np.searchsorted(group, np.arange(self.groups + 1))
        for g in np.flatnonzero(np.diff(cuts)):
            rows, leaf = slice(cuts[g], cuts[g + 1]), slice(g * self.width, (g + 1) * self.width)
            s = self.q[leaf] @ v[rows].T + np.where(self.missing[g], np.float32(-1e9), self.b[leaf])[:, None]
            got[rows] += s[place[rows] - g * self.width, np.arange(s.shape[1])] - _log_sum(s)
        out = np.empty_like(got)
        out[order] = got
        return out

    def table(self, h: np.ndarray) -> np.ndarray:
        """Log probability of every symbol after each row of h."""
        return np.stack([self.log_probs(h, np.full(len(h), w)) for w in range(len(self.place))], 1)

    def gradients(self, h: np.ndarray, w: np.ndarray, noise_group: np.ndarray, noise_leaf: np.ndarray, losses: list[float] | None = None) -> np.ndarray:
        """Gradient of a batch's contrastive loss (mean a token), against the noise groups and, in every group, the noise leaves
        given; ``losses`` takes the loss of each part, if it is wanted."""
        n, grad = len(w), np.zeros_like(self.flat)
        part = self.views(grad)
        place = self.place[w]
        order = _order(place, len(self.b))
        place, h = place[order], h[order]
        v, group = self.context(h), place // self.width
        back = np.zeros_like(v)
        every = [(0, n)]
        _contrast(v, group, every, noise_group[None], self.qg, self.bg, self.p_group, part["qg"], part["bg"], back, losses)
        cuts = np.searchsorted(group, np.arange(self.groups + 1))
        noise = noise_leaf + np.arange(self.groups)[:, None] * self.width
        _contrast(v, place, list(itertools.pairwise(cuts.tolist())), noise, self.q, self.b, self.p_leaf.ravel(), part["q"], part["b"], back, losses)
        for k in range(CONTEXT):
            part["c"][k] += np.einsum("ij,ij->j", back, self.r.take(h[:, k], 0))
            at = _order(h[:, k], len(self.r))
            _add_sorted(part["r"], h[at, k], back.take(at, 0) * self.c[k])
        return grad / np.float32(n)

    def draw(self, rng: np.random.Generator, groups: int = 10, leaves: int = 6) -> tuple[np.ndarray, np.ndarray]:
        """Noise of a batch: groups, and leaves of every group."""
        cumulated = np.cumsum(self.p_leaf, 1)
        leaf = (cumulated[:, None, :] < rng.random((self.groups, leaves))[:, :, None] * cumulated[:, None, -1:]).sum(2)
        return rng.choice(self.groups, groups, p=self.p_group), np.minimum(leaf, self.width - 1)


def _log_sum(s: np.ndarray) -> np.ndarray:
    """Of every column; ``s`` is used up."""
    top = s.max(0)
    s -= top
    return top + np.log(np.exp(s, out=s).sum(0))


def _order(at: np.ndarray, size: int) -> np.ndarray:
    return np.argsort(at.astype(np.int16) if size < 1 << 15 else at, kind="stable")


def _add_sorted(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """to[at] += rows, where ``at`` ascends and repeats."""
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    to[at[starts]] += np.add.reduceat(rows, starts, 0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _contrast(v: np.ndarray, w: np.ndarray, parts: list[tuple[int, int]], noise: np.ndarray, q: np.ndarray, b: np.ndarray, p: np.ndarray, dq: np.ndarray, db: np.ndarray, back: np.ndarray, losses: list[float] | None) -> None:
    """Adds one level's gradients: data (w ascends) against draws from p, -log sigma(s_w - log(k p_w)) - sum log sigma(-(...)).
    The rows from parts[i][0] to parts[i][1] have the draws noise[i]."""
    bias = b - np.log(noise.shape[1] * np.maximum(p, 1e-12)).astype(np.float32)
    own, drawn, free = q.take(w, 0), q[noise], bias[noise]
    s = np.einsum("ij,ij->i", v, own) + bias[w]
    z = np.empty((len(w), noise.shape[1]), np.float32)
    for i, (lo, hi) in enumerate(parts):
        if hi > lo:
            np.matmul(v[lo:hi], drawn[i].T, out=z[lo:hi])
            z[lo:hi] += free[i]
    if losses is not None:
        losses.append(float(np.logaddexp(0, -s).sum() + np.logaddexp(0, z).sum()))
    miss, hit = _sigmoid(-s), _sigmoid(z)
    back -= miss[:, None] * own
    pull, weight = np.zeros_like(drawn), np.zeros_like(free)
    for i, (lo, hi) in enumerate(parts):
        if hi > lo:
            back[lo:hi] += hit[lo:hi] @ drawn[i]
            pull[i], weight[i] = hit[lo:hi].T @ v[lo:hi], hit[lo:hi].sum(0)
    _add_sorted(dq, w, -miss[:, None] * v)
    np.add.at(dq, noise, pull)
    db -= np.bincount(w, miss, len(b)).astype(np.float32)
    np.add.at(db, noise, weight)


def contexts(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The CONTEXT symbols before each token, the nearest first; the end (0) before a text's first token."""
    h = np.zeros((len(ids), CONTEXT), np.int64)
    for k in range(CONTEXT):
        h[k + 1 :, k] = ids[: len(ids) - k - 1]
    for k in range(CONTEXT):
        for j in range(k, CONTEXT):  # token k of a text has no symbol further back than k
            at = starts + k
            h[at[at < len(ids)], j] = 0
    return h


def symbols_of(docs: DataFrame, known: Vocabulary, text_col: str = "text") -> DataFrame:
    """ids: the symbols of each text, ``known.kind`` numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        own = shared.value
        symbol = _Symbols(own).__getitem__
        for (text,) in rows:
            words = tokens(text)
            yield (np.fromiter(map(symbol, words), own.kind, len(words)).tobytes(),)

    return by_rows(docs.select(text_col), run, "ids binary", out=256)


def batches(rows: Iterator[tuple], kind: str, size: int = BATCH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(contexts, symbols) of about ``size`` tokens, of whole texts or slices of long ones."""
    held: list[np.ndarray] = []
    n = 0
    for (raw,) in rows:
        held.append(np.frombuffer(raw, kind))
        n += len(held[-1])
        if n >= size:
            yield from _sliced(held, size)
            held, n = [], 0
    if n:
        yield from _sliced(held, size)


def _sliced(held: list[np.ndarray], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids = np.concatenate(held).astype(np.int64)
    lengths = np.array([len(x) for x in held])
    h = contexts(ids, np.cumsum(lengths) - lengths)
    parts = max(1, len(ids) // size)  # even slices of ``size`` to twice as many tokens
    for lo, hi in itertools.pairwise(len(ids) * i // parts for i in range(parts + 1)):
        yield h[lo:hi], ids[lo:hi]


def learn(rows: Iterator[tuple], own: Vocabulary, start: np.ndarray, rate: float = 0.02, steps: int = 200, seed: tuple[int, ...] = (5,)) -> tuple[int, np.ndarray]:
    """Tokens in the texts (their symbols) and the parameters after contrastive steps (Adagrad) with whole contexts over all of
    them; texts of fewer than ``steps`` batches are gone over again until some ``steps`` are done, 20 times at most."""
    model, rng = bilinear(own, start), np.random.default_rng(seed)
    squares = np.full_like(model.flat, 1e-8)

    def step(h: np.ndarray, w: np.ndarray) -> None:
        g = model.gradients(h, w, *model.draw(rng))
        squares[:] += g * g
        model.flat -= rate * g / np.sqrt(squares)

    few: list[tuple[np.ndarray, np.ndarray]] | None = []  # all batches, as long as they may be gone over again
    done = n = 0
    for h, w in batches(rows, own.kind):
        step(h, w)
        done, n = done + 1, n + len(w)
        if few is not None:
            few.append((h.astype(own.kind), w.astype(own.kind)))
            if done >= steps:
                few = None
    for _ in range(min(20, -(-steps // done)) - 1 if few else 0):
        for h, w in few:
            step(h.astype(np.int64), w.astype(np.int64))
    return n, model.flat


def transitions(coded: DataFrame, known: Vocabulary) -> DataFrame:
    """cell ((position * size + symbol that far before) * size + symbol), n over all texts (ids); each task adds its own in one
    array of CONTEXT * symbols**2."""
    m, kind = known.size, known.kind

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        total = np.zeros(CONTEXT * m * m, np.int32)
        for h, w in batches(rows, kind, 1 << 18):
            for k in range(CONTEXT):
                total[k * m * m : (k + 1) * m * m] += np.bincount(h[:, k] * m + w, minlength=m * m)
        at = np.flatnonzero(total)
        return zip(at.tolist(), total[at].tolist(), strict=True)

    return by_rows(coded.select("ids"), run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def fit_counts(model: LogBilinear, counts: np.ndarray, noise: int = 10, steps: int = 80, rate: float = 0.05) -> None:
    """Contrastive training on transition counts (position, symbol before, symbol), one position at a time as context and in
    expectation over the noise: at either level, data cells against ``noise`` draws a token."""
    n = counts.sum()
    if not n:
        return
    leaves = np.zeros((len(counts), counts.shape[1], len(model.b)), np.float32)
    leaves[:, :, model.place] = counts / n
    groups = leaves.reshape(*leaves.shape[:2], model.groups, model.width).sum(3)
    p_leaf = np.maximum(model.p_leaf, 1e-12).astype(np.float32).ravel()
    levels = (
        (leaves, noise * np.repeat(groups, model.width, 2) * model.p_leaf.astype(np.float32).ravel(), np.log(noise * p_leaf), "q", "b"),
        (groups, noise * groups.sum(2, keepdims=True) * model.p_group.astype(np.float32), np.log(noise * model.p_group).astype(np.float32), "qg", "bg"),
    )
    first, second, views = np.zeros_like(model.flat), np.zeros_like(model.flat), model.views
    for t in range(1, steps + 1):
        grad = np.zeros_like(model.flat)
        part = views(grad)
        for k in range(CONTEXT):
            v = model.r * model.c[k]
            for data, draw, shift, name, bias in levels:
                q = getattr(model, name)
                p = _sigmoid(v @ q.T + (getattr(model, bias) - shift))
                g = p * (draw[k] + data[k])
                g -= data[k]
                back = g @ q
                part[name] += g.T @ v
                part[bias] += g.sum(0)
                part["r"] += back * model.c[k]
                part["c"][k] += (back * model.r).sum(0)
        first += 0.1 * (grad - first)
        second += 0.01 * (grad * grad - second)
        model.flat -= rate * (1 - 0.9 * t / steps) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-10)


#: Parameters that travel in one row.
PIECE = 1024


def parameters(docs: DataFrame, known: Vocabulary, text_col: str) -> tuple[int, np.ndarray]:
    """First from the transition counts of all texts, then with whole contexts on all of them: tokens gone over, parameters."""
    m, model = known.size, LogBilinear(known.often)
    coded = materialise(symbols_of(docs, known, text_col), "symbols")
    cells = transitions(coded, known).toArrow()  # at most CONTEXT * symbols**2 rows
    table = np.zeros(CONTEXT * m * m, np.float32)
    table[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    fit_counts(model, table.reshape(CONTEXT, m, m))
    model.c *= np.array([[0.5], [0.4], [0.3]], np.float32)  # the positions speak together from here on
    start = docs.sparkSession.sparkContext.broadcast((known, model.flat.tobytes()))

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        from pyspark import TaskContext

        own, flat = start.value
        task = TaskContext.get().partitionId()
        n, flat = learn(rows, own, np.frombuffer(flat, np.float32), seed=(5, task))
        if n:
            yield from ((at // PIECE, task, n, flat[at : at + PIECE].tobytes()) for at in range(0, len(flat), PIECE))

    def add(rows: Iterator[tuple]) -> Iterator[tuple]:
        for piece, own in itertools.groupby(rows, lambda r: r[0]):
            tokens_, total = 0, 0.0
            for _, _, n, raw in own:
                tokens_ += n
                total = total + n * np.frombuffer(raw, np.float32).astype(np.float64)
            yield piece, tokens_, (total / tokens_).astype(np.float32).tobytes()

    reached = by_rows(coded, run, "piece int, task int, n long, flat binary").repartition("piece").sortWithinPartitions("piece", "task")
    got = sorted(by_rows(reached, add, "piece int, n long, flat binary").collect(), key=lambda r: r.piece)
    return (got[0].n, np.frombuffer(b"".join(bytes(r.flat) for r in got), np.float32)) if got else (0, model.flat)


@dataclass
class Model:
    vocabulary: Vocabulary
    counts: DataFrame  # word, class, n
    flat: np.ndarray  # parameters of LogBilinear
    learnt: int = 0  # tokens whose whole contexts were trained

    def bilinear(self) -> LogBilinear:
        return bilinear(self.vocabulary, self.flat)


def bilinear(known: Vocabulary, flat: np.ndarray) -> LogBilinear:
    model = LogBilinear(known.often)
    model.flat[:] = flat
    return model


def train(docs: DataFrame, text_col: str = "text", head: int = 100_000, share: float = 1.5e-4, classes: int = 256) -> Model:
    counts = materialise(count_words(docs, classes, text_col), "words")
    known = vocabulary(counts, head, share, classes)
    learnt, flat = parameters(docs, known, text_col)
    return Model(known, counts, flat, learnt)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    shared = spark.sparkContext.broadcast((model.vocabulary, model.flat))

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        from pyspark import TaskContext

        own, flat = shared.value
        net, place, symbol = bilinear(own, flat), _Places(own.head), _Symbols(own)
        fixed, row = len(own.symbols), TaskContext.get().partitionId() << 36
        symbol_of = np.array([*map(own.symbol, own.head), 0])  # the last entry stands for the words that are not in the head
        log_of = np.log10(np.array([*own.head.values(), 0.0]) + 1)
        per_token, share = math.log10(own.n + own.v + 1), np.log10(own.class_size)

        def out(held: list[tuple]) -> Iterator[tuple]:
            nonlocal row
            at = [np.fromiter(map(place.__getitem__, words), np.int64, len(words)) for _, words in held]
            lengths = np.array([len(x) for x in at])
            every, firsts = np.concatenate(at), np.cumsum(lengths) - lengths
            unknown = np.flatnonzero(every < 0)
            ids, logs = symbol_of[every], log_of[every]
            text_of = np.searchsorted(firsts, unknown, "right") - 1
            missed = np.bincount(text_of, minlength=len(held))
            rest = [held[t][1][i] for i, t in zip((unknown - firsts[text_of]).tolist(), text_of.tolist(), strict=True)]
            ids[unknown] = np.fromiter(map(symbol.__getitem__, rest), np.int64, len(rest))
            tails = [Counter(rest[hi - k : hi]) for k, hi in zip(missed.tolist(), np.cumsum(missed).tolist(), strict=True)]
            h = contexts(ids, firsts)
            value = np.concatenate([net.log_probs(h[lo : lo + BATCH], ids[lo : lo + BATCH]) for lo in range(0, len(ids), BATCH)]) / math.log(10)
            rare = ids >= fixed
            value += np.where(rare, logs - share[np.maximum(ids - fixed, 0)], 0.0)
            for (key, words), tail, k, base, total in zip(held, tails, missed.tolist(), np.add.reduceat(logs, firsts).tolist(), np.add.reduceat(value, firsts).tolist(), strict=True):
                n = len(words)
                yield row, key, None, n, n - k, base - n * per_token, total
                for w, c in tail.items():
                    yield row, None, w.decode("utf-8", "surrogatepass"), c, None, None, None
                row += 1

        held: list[tuple] = []
        n = 0
        for key, text in rows:
            held.append((key, tokens(text)))
            n += len(held[-1][1])
            if n >= BATCH:
                yield from out(held)
                held, n = [], 0
        if held:
            yield from out(held)

    parts = materialise(by_rows(docs.select(id_col, text_col), run, f"row long, id {kind}, word string, n long, known long, base double, value double"), "scored")
    rare = (
        parts.where("word IS NOT NULL").select("row", "word", F.col("n").alias("k"))
        .join(model.counts.select("word", F.log10(F.col("n") + 1).alias("x")), "word")
        .groupBy("row").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("x")).alias("x"))
    )
    zero: Column = F.lit(0)
    return parts.where("word IS NULL").join(rare, "row", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("k", zero)).cast("long").alias("n_known"),
        F.lit(model.vocabulary.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("x", zero)).alias("base_score"),
        (F.col("value") + F.coalesce("x", zero)).alias("score"),
    )
