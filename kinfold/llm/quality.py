"""Quality classifier: histogram gradient-boosted trees over document statistics, as flat arrays."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import stash_texts
from kinfold.llm.langid import held_out

#: Labelled documents to learn from, at most: those of smallest hash of doc_id.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
TREES, DEPTH, BINS, RATE, LEAST_LEAF, L2 = 80, 4, 64, 0.15, 10, 1.0

_WORD = re.compile(r"\S+")
FEATURES = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "distinct_words", "repeated_next", "longest_run", "top_word", "top_pair", "distinct_pairs",
    "upper", "letters", "digits", "stops", "marks", "symbols", "pipes", "spaces", "high_bytes", "entropy", "capital_words", "wordless", "marked_ends", "log_lines",
    "line_words", "distinct_lines", "lines_ended", "stops_per_word", "short_words",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[[ord(c) for c in chars]] = 1
    return out


_UPPER, _LOWER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz")
_HIGH = (np.arange(256) >= 128).astype(float)
_CLASSES = np.stack([_UPPER, _UPPER + _LOWER + _HIGH, _class("0123456789"), _class("."), _class(",;:!?\"'()-"), _class("#$%&*+/<=>@[\\]^_`{}~"), _class("|"), _class(" \t\n\r\v\f"), _HIGH], axis=1)


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text; all zero if it has no word."""
    words = _WORD.findall(text) if text else []
    if not words:
        return [0.0] * len(FEATURES)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    n, size = len(words), raw.sum()
    length = np.fromiter(map(len, words), dtype=np.float64, count=n)
    share = raw[raw > 0] / size
    same = np.fromiter((a == b for a, b in zip(words, words[1:])), dtype=bool, count=n - 1)  # noqa: B905
    change = np.flatnonzero(np.concatenate(([True], ~same, [True])))
    count = Counter(words)
    pairs = Counter(zip(words, words[1:]))  # noqa: B905
    classes = (raw @ _CLASSES) / size
    lines = [x for x in text.split("\n") if x.strip()]
    first = [w[0] for w in words]
    last = [w[-1] for w in words]
    return [
        np.log1p(size), np.log1p(n), length.mean(), length.std(), len(count) / n, same.mean() if n > 1 else 0.0, np.log(np.diff(change).max()),
        max(count.values()) / n, max(pairs.values()) / (n - 1) if n > 1 else 0.0, len(pairs) / max(n - 1, 1), *classes.tolist(), -(share * np.log2(share)).sum(),
        sum(map(str.isupper, first)) / n, sum(not any(map(str.isalpha, w)) for w in words) / n, sum(not (c.isalnum() or c in ".,;:!?)\"'") for c in last) / n,
        np.log1p(len(lines)), n / len(lines), len(set(lines)) / len(lines), sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines), sum(c in ".!?" for c in last) / n, (length <= 3).mean(),
    ]


class BoostedTrees:
    """Logistic boosting on binned features. Node k of a tree has children left[k] and right[k]; a leaf points to itself."""

    def __init__(self) -> None:
        self.base = 0.0
        self.roots = np.zeros(0, np.int64)
        self.feature = self.left = self.right = np.zeros(0, np.int64)
        self.split = self.value = np.zeros(0)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Learn from rows ``x`` and labels 0 or 1; without rows or with one class the score is constant."""
        p = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(p / (1 - p)))
        if not len(y) or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        margin = np.full(len(y), self.base)
        feature, left, right, split, value, roots = [], [], [], [], [], []

        def node() -> int:
            for part in (feature, left, right):
                part.append(0)
            split.append(np.inf)
            value.append(0.0)
            k = len(feature) - 1
            left[k] = right[k] = k
            return k

        for _ in range(TREES):
            prob = 1 / (1 + np.exp(-margin))
            grad, hess = prob - y, prob * (1 - prob)
            roots.append(node())
            todo = [(roots[-1], np.arange(len(y)), 0)]
            while todo:
                k, rows, depth = todo.pop()
                g, h = grad[rows].sum(), hess[rows].sum()
                best = (1e-6, 0, 0)
                if depth < DEPTH and len(rows) >= 2 * LEAST_LEAF:
                    for j, e in enumerate(edges):
                        if not len(e):
                            continue
                        b = binned[rows, j]
                        gs, hs, ns = (np.cumsum(np.bincount(b, weights=w, minlength=len(e) + 1))[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
                        gain = gs**2 / (hs + L2) + (g - gs) ** 2 / (h - hs + L2) - g**2 / (h + L2)
                        gain[(ns < LEAST_LEAF) | (len(rows) - ns < LEAST_LEAF)] = 0
                        at = int(gain.argmax())
                        if gain[at] > best[0]:
                            best = (gain[at], j, at)
                if best[0] <= 1e-6:
                    value[k] = -RATE * g / (h + L2)
                    margin[rows] += value[k]
                    continue
                _, feature[k], at = best
                split[k] = float(edges[feature[k]][at])
                go = binned[rows, feature[k]] <= at
                left[k], right[k] = node(), node()
                todo += [(left[k], rows[go], depth + 1), (right[k], rows[~go], depth + 1)]
        self.roots, self.feature, self.left, self.right = (np.array(v, dtype=np.int64) for v in (roots, feature, left, right))
        self.split, self.value = np.array(split), np.array(value)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1: all rows walk down all trees together, one level a step."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(DEPTH if len(self.roots) else 0):
            at = np.where(x[row, self.feature[at]] <= self.split[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def _statistics(texts: pa.Array) -> pa.Array:
    return pa.array([statistics(t.as_py()) for t in texts], pa.list_(pa.float64()))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> BoostedTrees:
    """Trees from at most ``sample_rows`` labelled documents that are not held out, those of smallest hash of doc_id.

    A document with several labels counts by their mean, 1 from 0.5 on; null labels and ids don't count. Of several
    texts under one id the first in order counts. Only the sample's statistics reach the driver.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    got = stash_texts(rows.select("doc_id", "y", F.arrow_udf(_statistics, "array<double>")("text").alias("stats")), "quality-sample").toPandas().sort_values("doc_id")
    x = np.array(got["stats"].tolist(), dtype=np.float64).reshape(len(got), len(FEATURES))
    return BoostedTrees().fit(x, got["y"].to_numpy(dtype=np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs``; null and empty texts are scored by their zero statistics."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def of(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for at in range(0, len(texts), 512):
            part = np.array([statistics(t.as_py()) for t in texts[at : at + 512]])
            out.append(model.value.score(part))
        return pa.array(np.concatenate(out))

    scored = stash_texts(docs.select("doc_id", held_out().alias("held_out"), F.arrow_udf(of, "double")("text").alias("score")), "quality-scores")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
