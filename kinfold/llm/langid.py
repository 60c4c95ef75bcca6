"""Language identification by prediction by partial matching over bytes (method C escapes, frozen statistics)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import stash_texts, whole_row

#: Bytes of context at most; four bytes, context and symbol, fit one code.
ORDER = 3
#: Labelled documents that the statistics are taken from, per language, at most.
SAMPLE_DOCS = 1500
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: str = "doc_id"):
    """True where crc32(doc_id as text) mod 4 is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _padded(text: str) -> bytes:
    """A text's bytes after ``ORDER`` line ends, the context of its first byte; letters are folded to lower case."""
    return b"\n" * ORDER + text.lower().encode("utf-8", "surrogatepass")


def _codes(data: np.ndarray) -> np.ndarray:
    """For each byte from position ORDER on, its context and itself as one big-endian 32-bit code."""
    x = data.astype(np.uint32)
    return (x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:]


class ContextTrees:
    """One context tree per language, of depth ``ORDER``, over the same symbols: counts of (context, symbol).

    Frozen PPM, method C: in a context seen n times with d distinct symbols, a symbol seen c times has
    probability c/(n+d) and escape has d/(n+d); escape goes to the next shorter context and below the empty
    context every byte is equally likely. A context never seen costs nothing and passes on. Symbols are not
    excluded on escape, so a code length depends on (context, symbol) alone and is tabulated.
    """

    def __init__(self, languages: list[str], code: np.ndarray, language: np.ndarray, count: np.ndarray) -> None:
        self.languages = languages
        self.nodes: list[list[tuple]] = []
        for k in range(len(languages)):
            own = language == k
            c, n, levels = code[own].astype(np.int64), count[own].astype(np.int64), []
            for order in range(ORDER + 1):
                full, inverse = np.unique(c & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
                total = np.bincount(inverse, weights=n, minlength=len(full))
                context, where, distinct = np.unique(full >> 8, return_inverse=True, return_counts=True)
                levels.append((full, total, context, np.bincount(where, weights=total, minlength=len(context)), distinct))
            self.nodes.append(levels)
        self._index()

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Exact code lengths in bits, one row per code and one column per language, from the trees themselves."""
        c, out = codes.astype(np.int64), np.zeros((len(codes), len(self.languages)))
        for k, levels in enumerate(self.nodes):
            cost, todo = np.zeros(len(c)), np.arange(len(c))
            for order in range(ORDER, -1, -1):
                full, total, context, seen, distinct = levels[order]
                if not len(full) or not len(todo):
                    continue
                key = c[todo] & ((1 << 8 * (order + 1)) - 1)
                at = np.minimum(np.searchsorted(context, key >> 8), len(context) - 1)
                known = context[at] == key >> 8
                mass = np.log2(seen[at] + distinct[at])
                own = np.minimum(np.searchsorted(full, key), len(full) - 1)
                hit = full[own] == key
                cost[todo[hit]] += mass[hit] - np.log2(total[own[hit]])
                escaped = known & ~hit
                cost[todo[escaped]] += mass[escaped] - np.log2(distinct[at[escaped]])
                todo = todo[~hit]
            cost[todo] += 8
            out[:, k] = cost
        return out

    def _index(self) -> None:
        """A table from the two byte pairs of a code to the row of its code lengths, for all codes seen in training."""
        seen = np.unique(np.concatenate([levels[ORDER][0] for levels in self.nodes] or [np.zeros(0, np.int64)]))
        pairs = np.unique(np.concatenate((seen >> 16, seen & 0xFFFF)))
        self.pair = np.zeros(1 << 16, dtype=np.uint16)
        self.pair[pairs] = np.arange(1, len(pairs) + 1)
        self.width = len(pairs) + 1
        self.table = np.zeros(self.width * self.width, dtype=np.int32)
        self.table[self.pair[seen >> 16].astype(np.int64) * self.width + self.pair[seen & 0xFFFF]] = np.arange(1, len(seen) + 1)
        self.rows = np.vstack((np.zeros((1, len(self.languages))), self.bits(seen))).astype(np.float32)

    def lengths(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code length in bits of each text under each language, and the texts' bytes."""
        sums, sizes = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), dtype=np.int64)
        at = 0
        while at < len(texts):
            chunk, size, first = [], 0, at
            while at < len(texts) and size < 1 << 18:
                chunk.append(_padded(texts[at]))
                size += len(chunk[-1])
                at += 1
            data = np.frombuffer(b"".join(chunk), dtype=np.uint8)
            own = np.array([len(x) for x in chunk])
            start = np.concatenate(([0], np.cumsum(own)[:-1]))
            for lo in range(0, len(data) - ORDER, 1 << 18):
                codes = _codes(data[lo : lo + (1 << 18) + ORDER])
                row = self.table[self.pair[codes >> 16].astype(np.int32) * self.width + self.pair[codes & 0xFFFF]]
                cost = self.rows[row]
                new = np.flatnonzero(row == 0)
                if len(new):
                    distinct, inverse = np.unique(codes[new], return_inverse=True)
                    cost[new] = self.bits(distinct).astype(np.float32)[inverse]
                ends = start + own
                which = np.flatnonzero((ends - ORDER > lo) & (start < lo + len(codes)))
                left, right = np.maximum(start[which] - lo, 0), np.minimum(ends[which] - ORDER - lo, len(codes))
                cuts = np.column_stack((left, right)).ravel()
                padded = np.vstack((cost, np.zeros((1, cost.shape[1]), np.float32)))
                part = np.add.reduceat(padded, cuts, axis=0, dtype=np.float64)[::2]
                sums[first + which] += np.where((right > left)[:, None], part, 0)
            sizes[first : first + len(chunk)] = own - ORDER
        return sums, sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """A language and a score for each text; ``und`` and 0 for null texts and texts without a letter.

        The score is the chosen language's share of the probabilities that the code lengths stand for, over an
        effective length of at most 64 bytes, so that long texts do not all score 1. Ties go to the first language
        in order.
        """
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        sums, sizes = self.lengths([t or "" for t in texts])
        best = sums.argmin(axis=1) if len(texts) else np.zeros(0, int)
        scale = np.minimum(sizes, 64) / np.maximum(sizes, 1)
        share = 1 / np.exp2(-(sums - sums.min(axis=1, keepdims=True)) * scale[:, None]).sum(axis=1) if len(texts) else []
        has = [bool(t) and _LETTER.search(t) is not None for t in texts]
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], [float(s) if h else 0.0 for s, h in zip(share, has, strict=True)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, text = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for name in sorted(set(lang)):
            parts = [_codes(np.frombuffer(_padded(t), dtype=np.uint8)) for t, own in zip(text, lang, strict=True) if own == name and t]
            if parts:
                code, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.record_batch([pa.array([name] * len(code)), pa.array(code.astype(np.int64)), pa.array(n)], names=["lang", "code", "n"])


def train(docs: DataFrame, text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> ContextTrees:
    """Context trees from a bounded sample of ``docs``: per language, the ``sample_docs`` non-empty texts of smallest hash.

    The languages are all non-null values of ``lang`` that have a text with at least one character; a sampled text
    counts whole. Copies of a text count once in a language, in its size
    as in the sample: each distinct text has one hash, and a threshold on it, set by the number of the language's
    distinct hashes, thins the rows before they are folded and ranked, so no task ranks more than a small multiple
    of the bound; a language of no more distinct texts than that gives all of them. The driver gets the counts of
    distinct codes of that sample.
    """
    rows = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text", F.lit(9)))
    size = rows.select("lang", "mark").distinct().groupBy("lang").count()
    share = F.lit(2.0 * sample_docs + 200) / F.col("count")
    thin = rows.join(F.broadcast(size), "lang").where((F.pmod("mark", F.lit(1 << 30)) / float(1 << 30)) < share).select("lang", "text", "mark").distinct()
    ranked = thin.selectExpr("lang", "text", "row_number() over (partition by lang order by mark, text) as place").where(F.col("place") <= sample_docs)
    counts = ranked.select("lang", "text").mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    names, code, n = counts.column("lang").to_pylist(), counts.column("code").to_numpy(), counts.column("n").to_numpy()
    languages = sorted(set(names))
    place = {x: k for k, x in enumerate(languages)}
    return ContextTrees(languages, code, np.array([place[x] for x in names], dtype=np.int64), n)


def language_of(trees: ContextTrees, docs: DataFrame, text: str = "text") -> Column:
    """The struct ``(lang_pred, score)`` of a whole text; the trees are broadcast, bounded by the sample. Write it once with :func:`stash_texts`."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def of(texts: pa.Array) -> pa.Array:
        name, score = [], []
        for at in range(0, len(texts), 256):
            a, b = shared.value.predict(texts[at : at + 256].to_pylist())
            name += a
            score += b
        return pa.StructArray.from_arrays([pa.array(name, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    return F.arrow_udf(of, "struct<lang_pred: string, score: double>")(F.col(text))


def predict_language(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` per document, learned from the rows that are not held out."""
    trees = train(docs.where(~held_out()))
    found = stash_texts(docs.select("doc_id", held_out().alias("held_out"), language_of(trees, docs).alias("found")), "languages")
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def reject_unknown(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose language is recognised: not ``und``, and a score of ``least`` or more."""
    trees = train(docs.where(~held_out()))
    found = stash_texts(docs.select(whole_row(docs).alias("row"), language_of(trees, docs).alias("found")), "languages")
    return found.where((F.col("found.lang_pred") != UNKNOWN) & (F.col("found.score") >= least)).select("row.*")
