"""Substring dedup by sliding sentence spans: runs of consecutive sentences that repeat anywhere are removed but for their first place.

A passage pasted into the middle of a sentence shares its first and last sentence with strangers and may hold fewer whole
sentences than a run; of these, spans over the end of a sentence are compared by their words.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import row_keys, stash, stash_texts, whole_row

#: Sentences in a run.
RUN = 3
#: Words of a span that begins and ends anywhere in a sentence, and in how many consecutive ones one at least is hashed:
#: ``SPAN + REACH - 1`` words that repeat and go over the end of a sentence share a run or a hashed span.
SPAN, REACH = 30, 21
#: Share of all runs from which on a run is dealt in parts.
HOT = 0.001
#: Letters of scripts written without spaces between words.
_LETTERS = "฀-໿က-႟ក-៿々-〇぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾝ\U00020000-\U0003ffff"
#: A sentence ends after . ! ? and the like with closing marks before white space, at a line end, after the full-width
#: stops, which no space follows, and at a space within a script that has none between words.
_END = re.compile(
    r"(?<=[.!?।॥۔؟።…])[\"'»”’)\]]*\s+|\s*\n\s*"
    rf"|(?<=[。！？｡])(?![。！？｡])[\"'»”’)\]」』）】》]*\s*|(?<=[{_LETTERS}])\s+"
)
#: Whether a character is white space; none beyond the ideographic space is.
_BLANK = np.array([chr(c).isspace() for c in range(0x3002)])
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def sentences(text: str) -> tuple[list[int], list[int]]:
    """Starts and ends of the sentences of ``text``; white space around them belongs to none."""
    starts, ends, at = [], [], 0
    for m in _END.finditer(text):
        if text[at : m.start()].strip():
            starts.append(at)
            ends.append(m.start())
        at = m.end()
    if text[at:].strip():
        starts.append(at)
        ends.append(len(text))
    return starts, ends


def run_hashes(text: str | None, found: tuple[list[int], list[int]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(h1, h2, start, until)`` of every run of ``RUN`` sentences, in order; fewer sentences have no run.

    Sentences are compared by their lower-cased words; a run's hash has 128 bits. ``until`` is where the sentence
    after the run starts, or the text's end. ``found`` is what :func:`sentences` gives, if known.
    """
    starts, ends = found or (sentences(text) if text else ([], []))
    n = len(starts) - RUN + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    digest = xxhash.xxh3_128_digest
    own = np.frombuffer(b"".join(digest(" ".join(text[s:e].lower().split()).encode("utf-8", "surrogatepass")) for s, e in zip(starts, ends, strict=True)), dtype=np.uint64).reshape(-1, 2)
    out = []
    with np.errstate(over="ignore"):
        for lane, odd in enumerate(_ODD):
            mixed = np.full(n, RUN, dtype=np.uint64)
            for j in range(RUN):
                mixed = (mixed ^ own[j : j + n, lane]) * odd
                mixed ^= mixed >> np.uint64(29)
            out.append(mixed.view(np.int64))
    after = np.array([*starts, len(text)], dtype=np.int32)
    return out[0], out[1], after[:n], after[RUN : RUN + n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _ODD[0]
    x ^= x >> np.uint64(29)
    return x * _ODD[1]


def span_hashes(text: str | None, found: tuple[list[int], list[int]] | None = None) -> tuple[np.ndarray, ...]:
    """``(h1, h2, start, until, pos, n)`` of chosen spans of ``SPAN`` words that go over the end of a sentence.

    Spans within one sentence are none, and those that hold ``RUN`` whole sentences have a run. Of the others among every
    ``REACH`` consecutive ones that with the least hash of its first three words is chosen (winnowing), so the choice
    follows from the words alone, wherever they stand. ``pos`` is the first sentence that a span touches and ``n`` how
    many it does; ``until`` is where the word after it starts, or the text's end.
    """
    none = (*[np.zeros(0, np.int64)] * 2, *[np.zeros(0, np.int32)] * 4)
    if not text or len(text) < 2 * (SPAN + REACH) - 3:
        return none
    said, places = text.lower(), None
    if len(said) != len(text):  # some letters have longer small forms
        lowered = [(m.start(), m.group().lower()) for m in re.finditer(r"\S+", text)]
        said, places = " ".join(w for _, w in lowered), np.array([a for a, _ in lowered], dtype=np.int64)
    code = np.frombuffer(said.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    blank = np.concatenate(([True], _BLANK[np.minimum(code, len(_BLANK) - 1)], [True]))
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    first, last = edge[::2], edge[1::2]
    if len(first) < SPAN + REACH - 1:
        return none
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(code.astype(np.uint64) + np.uint64(1)))))
        word = _mixed(total[last] - total[first])
        n = len(word) - SPAN + 1
        order = _mixed(word[:n] + (word[1 : n + 1] ^ _ODD[0]) * _ODD[0] + (word[2 : n + 2] ^ _ODD[1]) * _ODD[1])
    place = first if places is None else places
    begins, every = np.searchsorted(place, np.array((found or sentences(text))[0], dtype=np.int64)), np.arange(n)
    low, high = np.searchsorted(begins, every, "right"), np.searchsorted(begins, every + SPAN, "left")
    fit = (high > low) & (high - low <= RUN)
    order[~fit] = np.uint64(0xFFFFFFFFFFFFFFFF)
    at = np.unique(np.lib.stride_tricks.sliding_window_view(order, REACH).argmin(axis=1) + every[: n - REACH + 1])
    at = at[fit[at]]
    low, high = low[at], high[at]
    words = said.split()
    digests = b"".join(xxhash.xxh3_128_digest(" ".join(words[i : i + SPAN]).encode("utf-8", "surrogatepass")) for i in at.tolist())
    own = np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)
    after = np.append(place, len(text)).astype(np.int32)
    pos = np.maximum(low - 1, 0)
    return own[:, 0], own[:, 1], after[at], after[at + SPAN], pos.astype(np.int32), (high - pos).astype(np.int32)


def _hashes(text: str | None) -> list[np.ndarray]:
    bounds = sentences(text) if text else ([], [])
    runs = run_hashes(text, bounds)
    n = len(runs[0])
    return [np.concatenate(x) for x in zip((*runs, np.arange(n, dtype=np.int32), np.full(n, RUN, np.int32)), span_hashes(text, bounds), strict=True)]


def _runs(texts: pa.Array) -> pa.Array:
    found = [_hashes(t.as_py()) for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(f[0]) for f in found]))).astype(np.int32)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    parts = [pa.array(np.concatenate([f[j] for f in found]) if found else [], kind) for j, kind in enumerate(kinds)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, ["h1", "h2", "start", "until", "pos", "n"]))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """``(none, id, th, runs)``: per document with any, its runs and spans ``(start, until, pos, n)`` that are not the first of their kind, in order.

    ``id`` is the doc_id as text, ``th`` the text's hash; rows equal in doc_id and text are one document. First is
    the smallest doc_id (null last), then the smallest hash, then the earliest place; a passage repeated inside
    one document counts. Occurrences are counted by half of a hash in partial aggregates, so a run that a third of
    all documents share is one row per task there; only runs that occur twice meet again with their places. A run
    with more than a share of ``HOT`` of all rows, of which there can be but ``1 / HOT``, is dealt in parts of that size.
    """
    runs = F.arrow_udf(_runs, "array<struct<h1: bigint, h2: bigint, start: int, until: int, pos: int, n: int>>")
    found = docs.select("doc_id", *row_keys(), F.explode(runs("text")).alias("r")).select("doc_id", "none", "id", "th", "r.*")
    rows = stash_texts(found, "spans-runs")
    often = stash(rows.groupBy("h1").agg(F.count("*").alias("times")).where("times > 1"), "spans-often")
    most = max(1, int(rows.count() * HOT))
    parts = often.select("h1", F.ceil(F.col("times") / most).cast("int").alias("parts"))
    hot = F.broadcast(parts.where("parts > 1"))
    dealt = rows.join(hot, "h1", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id", "start"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    twice = stash(dealt.join(parts.select("h1", each), ["h1", "part"], "left_semi"), "spans-repeated")
    place = F.struct("none", "doc_id", "th", "start")
    firsts = twice.groupBy("h1", "h2").agg(F.min(place).alias("first"), (F.max("part") + 1).alias("parts")).select("h1", "h2", "first", each)
    later = twice.join(firsts, ["h1", "h2", "part"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("none", "id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "until", "pos", "n"))).alias("runs"))


def _cut(text: Column, runs: Column) -> Column:
    """``text`` without the characters of ``runs``, which are ordered by their start, and without white space at its end."""
    gap = lambda a, b: F.struct(a.alias("start"), b.alias("until"))
    state = lambda done, a, b: F.struct(done.alias("done"), a.alias("start"), b.alias("until"))
    # What is kept: from the end of what went so far to the start of the next run that does not touch it.
    met = lambda s, r: F.when(r["start"] <= s["until"], state(s["done"], s["start"], F.greatest(s["until"], r["until"]))).otherwise(state(F.concat(s["done"], F.array(gap(s["until"], r["start"]))), r["start"], r["until"]))
    first = state(F.array().cast("array<struct<start: int, until: int>>"), F.lit(0), F.lit(0))
    kept = F.aggregate(runs, first, met, lambda s: F.concat(s["done"], F.array(gap(s["until"], F.length(text)))))
    return F.regexp_replace(F.concat_ws("", F.transform(kept, lambda g: F.substring(text, g["start"] + 1, g["until"] - g["start"]))), r"(?U)\s+\z", "")


def _with_cuts(docs: DataFrame) -> DataFrame:
    """``(row, kept, removed)``: the caller's row, its text without repeats and how many sentences went, in whole or in part; 0 where nothing did."""
    gone = repeated_runs(docs)
    marked = docs.select(whole_row(docs).alias("row"), *row_keys())
    joined = marked.join(gone, ["none", "id", "th"], "left")
    covered = F.size(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["pos"], r["pos"] + r["n"] - 1)))))
    text = F.col("row")["text"]
    changed = F.col("runs").isNotNull()
    return joined.select("row", F.when(changed, _cut(text, F.col("runs"))).otherwise(text).alias("kept"), F.when(changed, covered).otherwise(0).alias("removed"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with ``kept_text``, ``sentences_removed`` and ``changed``; one row per row, texts without repeats as they were.

    Null texts stay null, empty ones empty. A document wholly made of later repeats gets an empty text. Columns of
    the caller with one of the three names are replaced.
    """
    own = [c for c in docs.columns if c.lower() not in ("kept_text", "sentences_removed", "changed")]
    found = _with_cuts(docs)
    return found.select(*[F.col("row")[c].alias(c) for c in own], F.col("kept").alias("kept_text"), F.col("removed").alias("sentences_removed"), (F.col("removed") > 0).alias("changed"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with repeats cut out of ``text`` and ``n_chars`` (where present) set anew; documents that lose everything go."""
    found, kinds = _with_cuts(docs), dict(docs.dtypes)
    put = {"text": F.col("kept")}
    if "n_chars" in kinds:
        put["n_chars"] = F.when(F.col("removed") > 0, F.length("kept").cast(kinds["n_chars"])).otherwise(F.col("row")["n_chars"])
    return found.where((F.col("removed") == 0) | (F.length("kept") > 0)).select(*[put.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
