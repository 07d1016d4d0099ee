"""Quality classifier learned from positive and unlabelled text (non-negative PU risk).

Trusted positives P and unlabelled rows U give the unbiased risk  pi*R_P(+) + R_U(-) - pi*R_P(-).  Its last two terms
estimate the risk on negatives, which can't be below zero; when a step finds them below zero, the step ascends on them
instead (Kiryo et al. 2017).  The class prior pi is estimated from P and U alone, as the smallest ratio of unlabelled to
positive mass over bins of the direction between their means.

What the network sees of a text is its shape (lengths, repeats, symbols, capitals) and its content: the mean, over its words, of
the log ratio of the word's share in P to that in U, words being hashed to BUCKETS.  Ratios are counted in two halves of the
sample, and a row of either half is scored by the other half's while the network is trained, so that no row's own words speak
for it; later texts get the mean of both.

Bounds: ratios and network are fitted on at most ``max_positive`` + ``max_unlabelled`` rows, chosen by the smallest hash of the
id; their texts stay on the executors, and what reaches the driver is a row of FEATURES floats each and four tables of BUCKETS
counts.  Every row of the table is scored on the executors from its whole text.

Defined results: null or empty texts get the score of an empty text; very long texts are read whole; repeated rows get equal
scores, and an id that repeats with different texts is in the sample with the one of least hash; without any positive or any
unlabelled row all scores are 0.5; an empty table gives no rows; labels with a null id or null label are ignored; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.core.shared import materialise
from sextant.llm.rules import measure
from sextant.llm.words import beside, by_rows

FEATURES = 15
BUCKETS = 4096


class _Buckets(dict):
    """Word -> bucket of its lower-case form, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = got = zlib.crc32(word.lower()) % BUCKETS
        return got


_buckets = _Buckets()


def buckets(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(_buckets.__getitem__, words), np.int64, len(words))


def log_ratios(positive: np.ndarray, unlabelled: np.ndarray) -> np.ndarray:
    """Per bucket the log of the ratio of its shares, drawn to 0 where it was rarely seen."""
    if not positive.sum() or not unlabelled.sum():
        return np.zeros(BUCKETS)
    p, u = positive / positive.sum(), unlabelled / unlabelled.sum()
    prior = 20 * (positive + unlabelled + 1) / (positive + unlabelled + 1).sum()
    flat = 2.0 / max(1.0, min(positive.sum(), unlabelled.sum()))
    return np.log((p + flat) / (u + flat)) * (positive + unlabelled) / (positive + unlabelled + prior + 20)


def features(text: str | None, ratios: np.ndarray) -> list[float]:
    """Shape and content of a text; nothing but the text goes in."""
    n, chars, symbols, dup_lines, repeated, lines, capitals, bangs = measure(text)
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    w, c, ln = max(n, 1), max(chars, 1), max(lines, 1)
    lone = sum(1 for x in words if len(x) == 1)
    distinct = len(set(words))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    return [
        math.log1p(n) / 4,
        min(symbols / w, 3),
        raw.count(b"|") / w,
        min(bangs / w, 3),
        4 * capitals / c,
        4 * digits / c,
        distinct / w,
        repeated / w,
        dup_lines / ln,
        min(chars / w, 30) / 5,
        math.log1p(w / ln) / 3,
        2 * lone / w,
        math.log1p(n) * distinct / w / 4,
        1.0 if n < 5 else 0.0,
        3 * float(ratios[buckets(text)].mean()) if n else 0.0,
    ]


class Network:
    """One hidden layer; f(x) is the log-odds of the positive class."""

    def __init__(self, size: int, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, 1 / math.sqrt(size), (size, hidden)), np.zeros(hidden), rng.normal(0, 1 / math.sqrt(hidden), (hidden, 1)), np.zeros(1)]
        self.mean, self.scale = np.zeros(size), np.ones(size)
        self.ratios = np.zeros(BUCKETS)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(z @ self.w[0] + self.w[1])
        return z, h, (h @ self.w[2] + self.w[3])[:, 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x)[2], -30, 30)))

    def gradient(self, z: np.ndarray, h: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        back = np.outer(g, self.w[2][:, 0]) * (1 - h * h)
        return [z.T @ back, back.sum(0), h.T @ g[:, None], np.array([g.sum()])]


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, steps: int = 600, rate: float = 0.02, seed: int = 7) -> Network:
    """Minimise the non-negative PU risk with the logistic loss; batches of 512, Adam steps."""
    net = Network(positive.shape[1], hidden, seed)
    both = np.concatenate([positive, unlabelled])
    net.mean, net.scale = both.mean(0), both.std(0) + 1e-3
    rng = np.random.default_rng(seed)
    m, v = [np.zeros_like(w) for w in net.w], [np.zeros_like(w) for w in net.w]
    sig = lambda s: 1 / (1 + np.exp(-np.clip(s, -30, 30)))
    for t in range(1, steps + 1):
        p = positive[rng.integers(0, len(positive), min(512, len(positive)))]
        u = unlabelled[rng.integers(0, len(unlabelled), min(512, len(unlabelled)))]
        zp, hp, fp = net.forward(p)
        zu, hu, fu = net.forward(u)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        gp_pos, gp_neg, gu = -prior * sig(-fp) / len(p), -prior * sig(fp) / len(p), sig(fu) / len(u)
        if negative >= 0:
            grads = [a + b for a, b in zip(net.gradient(zp, hp, gp_pos + gp_neg), net.gradient(zu, hu, gu), strict=True)]
        else:
            grads = [-a - b for a, b in zip(net.gradient(zp, hp, gp_neg), net.gradient(zu, hu, gu), strict=True)]
        step = rate * (1 - 0.9 * t / steps)
        for i, g in enumerate(grads):
            g = g + 1e-4 * net.w[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            net.w[i] = net.w[i] - step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return net


def prior_without_negatives(positive: np.ndarray, unlabelled: np.ndarray, bins: int = 10) -> float:
    """Smallest unlabelled-to-positive mass ratio over quantile bins of the direction between the two means, each ratio raised by
    its standard error, since the smallest of noisy ratios lies too low; fewer bins for few positives."""
    both = np.concatenate([positive, unlabelled])
    axis = (positive.mean(0) - unlabelled.mean(0)) / (both.std(0) + 1e-6)
    a, b = positive @ axis, unlabelled @ axis
    bins = max(2, min(bins, len(a) // 40))
    cuts = np.quantile(a, np.linspace(0, 1, bins + 1)[1:-1])
    na, nb = (np.bincount(np.searchsorted(cuts, x), minlength=bins) for x in (a, b))
    seen = (na > 0.02 * len(a)) & (nb > 0)
    if not seen.any():
        return 0.5
    ratio = (nb[seen] / len(b)) / (na[seen] / len(a))
    return float(np.clip((ratio * (1 + np.sqrt(1 / na[seen] + 1 / nb[seen]))).min(), 0.05, 0.95))


def _sample(ids: DataFrame, bound: int, id_col: str) -> DataFrame:
    return ids.orderBy(F.xxhash64(id_col), id_col).limit(bound)


def train(docs: DataFrame, positives: DataFrame, unlabelled: DataFrame, prior: float | None = None, id_col: str = "doc_id", text_col: str = "text", max_positive: int = 4000, max_unlabelled: int = 8000) -> Network | None:
    """``positives`` and ``unlabelled`` hold ids; the bounded samples' texts are turned to features on the executors."""
    chosen = _sample(positives.select(id_col), max_positive, id_col).withColumn("_side", F.lit(1))
    chosen = chosen.unionByName(_sample(unlabelled.select(id_col), max_unlabelled, id_col).withColumn("_side", F.lit(0)))
    half = F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(2)).cast("int")
    texts = docs.select(F.col(id_col), F.col(text_col).alias("_text")).join(F.broadcast(chosen), id_col)  # chosen: the bounded ids
    one = F.min_by("_text", F.xxhash64("_text")).alias("_text")  # of an id that repeats; so the sample stays bounded
    texts = materialise(texts.groupBy(id_col, "_side").agg(one).select("_side", half.alias("_half"), "_text").repartition(8), "sample")

    def count(rows: Iterator[tuple]) -> Iterator[tuple]:
        total = np.zeros((2, 2, BUCKETS), np.int64)
        for side, part, text in rows:
            total[side, part] += np.bincount(buckets(text), minlength=BUCKETS)
        return ((i, n) for i, n in enumerate(total.ravel().tolist()) if n)

    counts = np.zeros(4 * BUCKETS)
    for r in by_rows(texts, count, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # at most 4 * BUCKETS rows
        counts[r.i] = r.n
    unlabelled_counts, positive_counts = counts.reshape(2, 2, BUCKETS)
    ratios = np.stack([log_ratios(positive_counts[k], unlabelled_counts[k]) for k in (0, 1)])

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for side, part, text in rows:
            yield side, features(text, ratios[1 - part])

    got = sorted(by_rows(texts, run, "side int, x array<double>").collect())
    p = np.array([r.x for r in got if r.side == 1]).reshape(-1, FEATURES)
    u = np.array([r.x for r in got if r.side == 0]).reshape(-1, FEATURES)
    if not len(p) or not len(u):
        return None
    net = fit_pu(p, u, prior if prior is not None else prior_without_negatives(p, u))
    net.ratios = ratios.mean(0)
    return net


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        keys, xs = [], []
        for key, text in rows:
            keys.append(key)
            xs.append(features(text, np.zeros(BUCKETS) if net is None else net.ratios))
            if len(keys) == 256:
                yield from emit(keys, xs)
                keys, xs = [], []
        if keys:
            yield from emit(keys, xs)

    def emit(keys: list, xs: list) -> Iterator[tuple]:
        got = np.full(len(keys), 0.5) if net is None else net.score(np.array(xs))
        return zip(keys, got.tolist(), strict=True)

    return by_rows(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, score double")


def keep(docs: DataFrame, net: Network | None, at: float, text_col: str = "text") -> DataFrame:
    """The rows scored ``at`` or more, all columns; ids play no part."""

    def scores(texts: list[str | None]) -> list[tuple]:
        return [(0.5,)] * len(texts) if net is None else [(float(x),) for x in net.score(np.array([features(t, net.ratios) for t in texts]))]

    return beside(docs, text_col, scores, "score double").where(F.col("score") >= at).select("_row.*")
