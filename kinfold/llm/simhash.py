"""SimHash near-duplicates by covering locality-sensitive hashing: no pair within the radius is missed."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import components, row_keys, stash, stash_texts, whole_row

RADIUS = 3
SHINGLE = 3
#: Buckets up to this many distinct fingerprints are compared pair by pair inside one task; larger ones are split again.
SMALL_BUCKET = 4096
#: Within a batch, runs up to this length are compared by shifting the whole batch.
SHIFT = 16


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 if it has no word or is null."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) <= width:
        spans = [(0, len(line))]
    else:
        spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    found = np.fromiter((digest(line[s:e], 42) for s, e in spans), dtype=np.uint64)
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(found), 65536):
        part = found[at : at + 65536]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (total * 2 > len(found)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t.as_py()) for t in texts], dtype=np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, none, id, th, fp)`` per row of ``docs``, written once: what names the row (see :func:`row_keys`) and its fingerprint as a signed long."""
    return stash_texts(docs.select("doc_id", *row_keys(text), F.arrow_udf(_fingerprints, "long")(F.col(text)).alias("fp")), "simhash-rows")


def masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """The covering masks over the given bit positions.

    Position i gets a nonzero vector m(i) of radius + 1 bits, dealt in turn; the mask of each nonzero v holds
    the positions with <m(i), v> odd. The vectors of at most ``radius`` positions span no more than ``radius``
    dimensions, so some v is orthogonal to all of them: under its mask the two fingerprints agree.
    """
    n = 1 << (radius + 1)
    code = {b: 1 + k % (n - 1) for k, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (code[b] & v).bit_count() & 1) for v in range(1, n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


TABLES = masks(list(range(64)))
INNER = [masks([b for b in range(64) if not t >> b & 1]) for t in TABLES]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the classes of a[i] and b[i]: the smallest index of each class, by hooking and pointer jumping."""
    while len(a):
        x, y = label[a], label[b]
        far = x != y
        if not far.any():
            break
        a, b, x, y = a[far], b[far], x[far], y[far]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def close_in_bucket(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the graph "at most ``radius`` differing bits" over distinct fingerprints of one bucket.

    Pairs are compared in blocks; where the bucket's fingerprints differ in few positions and are many, every
    neighbour within the radius is looked up instead. Nothing is left out.
    """
    n = len(fps)
    label = np.arange(n)
    free = [b for b in range(64) if (int(np.bitwise_or.reduce(fps ^ fps[0])) >> b) & 1]
    if n > 1024 and len(free) <= 18:
        code = np.zeros(n, dtype=np.int64)
        for k, b in enumerate(free):
            code |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
        place = np.full(1 << len(free), -1, dtype=np.int64)
        place[code] = np.arange(n)
        for r in range(1, radius + 1):
            for flip in combinations(range(len(free)), r):
                other = place[code ^ sum(1 << f for f in flip)]
                at = np.flatnonzero(other > np.arange(n))
                label = _merge(label, at, other[at])
    else:
        for s in range(0, n, 256):
            near = np.bitwise_count(fps[s : s + 256, None] ^ fps[None, s:]) <= radius
            a, b = np.nonzero(near)
            far = b > a
            label = _merge(label, a[far] + s, b[far] + s)
    at = np.flatnonzero(label != np.arange(n))
    return fps[at], fps[label[at]]


def _links(batches: Iterator[pa.RecordBatch], limit: int | None, radius: int) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (t, key, fp): links inside each bucket, and the rows of buckets above ``limit`` for another split."""
    schema = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64())])

    def out(kind: int, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(a):
            yield pa.record_batch([pa.array(np.full(len(a), kind, dtype=np.int8)), pa.array(a.view(np.int64)), pa.array(np.asarray(b).view(np.int64))], schema=schema)

    def whole(t: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole buckets only."""
        edge = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (key[1:] != key[:-1]))))
        length = np.diff(np.append(edge, len(fp)))
        run = np.repeat(np.arange(len(edge)), length)
        label = np.arange(len(fp))
        short = np.repeat(length <= SHIFT, length)
        for d in range(1, min(SHIFT, len(fp))):
            at = np.flatnonzero(short[:-d] & (run[:-d] == run[d:]) & (np.bitwise_count(fp[:-d] ^ fp[d:]) <= radius))
            label = _merge(label, at, at + d)
        at = np.flatnonzero(label != np.arange(len(fp)))
        yield from out(0, fp[at], fp[label[at]])
        for k in np.flatnonzero(length > SHIFT):
            part = fp[edge[k] : edge[k] + length[k]]
            if limit is None or length[k] <= limit:
                yield from out(0, *close_in_bucket(part, radius))
            else:
                yield from out(1, part, np.full(length[k], t[edge[k]], dtype=np.int64))

    held: list[tuple] = []
    passing = None
    for batch in batches:
        t, key, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        fp = fp.view(np.uint64)
        if not len(fp):
            continue
        if passing is not None:
            same = (t == passing[0]) & (key == passing[1])
            n = len(fp) if same.all() else int(np.argmin(same))
            yield from out(1, fp[:n], np.full(n, passing[0], dtype=np.int64))
            if n == len(fp):
                continue
            t, key, fp, passing = t[n:], key[n:], fp[n:], None
        if held:
            t, key, fp = (np.concatenate((h, x)) for h, x in zip(held, (t, key, fp), strict=True))
        same = (t == t[-1]) & (key == key[-1])
        cut = 0 if same.all() else len(t) - int(np.argmin(same[::-1]))
        if cut:
            yield from whole(t[:cut], key[:cut], fp[:cut])
        held = [t[cut:], key[cut:], fp[cut:]]
        if limit is not None and len(held[0]) > limit:
            yield from out(1, held[2], np.full(len(held[2]), held[0][0], dtype=np.int64))
            passing, held = (held[0][0], held[1][0]), []
    if held:
        yield from whole(*held)


def link_fingerprints(fps: DataFrame, radius: int = RADIUS, small_bucket: int = SMALL_BUCKET, files: int | None = None) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fps(fp long)`` whose components are those of the whole graph within the radius.

    A bucket of more than ``small_bucket`` fingerprints is split by the covering masks over the positions its
    own mask leaves free: pairs within the radius meet again there, and a part's fingerprints then differ in no
    more than 18 positions, so it is bounded. Each task returns a spanning forest, not pairs. ``files``: into how
    many files the links go; by default one a task.
    """
    if radius != RADIUS:
        raise ValueError("the tables are laid out for a radius of 3")
    keys = [F.struct(F.lit(k).cast("int").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(TABLES)]
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("x")).select("x.t", "x.key", "fp")
    dealt = rows.repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    links = dealt.mapInArrow(lambda b: _links(b, small_bucket, radius), "kind byte, a long, b long")
    found = stash(links if files is None else links.repartition(files), "simhash-links")
    large = found.where("kind = 1").select(F.col("b").alias("t"), F.col("a").alias("fp"))
    outer = F.element_at(F.array(*[F.lit(_signed(m)) for m in TABLES]), F.col("t").cast("int") + 1)
    split = [F.struct(F.lit(k).cast("int").alias("t2"), F.element_at(F.array(*[F.lit(_signed(inner[k])) for inner in INNER]), F.col("t").cast("int") + 1).alias("m2")) for k in range(len(TABLES))]
    rows = large.select("t", "fp", F.explode(F.array(*split)).alias("x")).select(
        (F.col("t") * 16 + F.col("x.t2")).cast("int").alias("t"), F.col("fp").bitwiseAND(outer.bitwiseOR(F.col("x.m2"))).alias("key"), "fp"
    )
    dealt = rows.repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    inner = dealt.mapInArrow(lambda b: _links(b, None, radius), "kind byte, a long, b long")
    return found.where("kind = 0").select("a", "b").unionByName(inner.select("a", "b"))


def simhash_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, classes)``: :func:`fingerprints` of the documents, and ``classes(fp, component_id, keeper)`` for each distinct fingerprint.

    Copies are folded to their distinct fingerprint before any table is built, so a group of copies costs one
    row. Null texts count as texts without words (fingerprint 0). ``component_id`` is the smallest non-null
    doc_id of the class, null if it has none; ``keeper`` marks the one fingerprint whose row is kept.
    """
    rows = fingerprints(docs)
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    count = rows.count()
    roots = components(link_fingerprints(nodes.select("fp"), files=1 + count // 200_000), count)
    of = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = of.groupBy("root").agg(F.min("least").alias("component_id"), F.min(F.struct(F.col("least").isNull(), F.col("least"), F.col("fp"))).getField("fp").alias("best"))
    return rows, of.join(best, "root").select("fp", "component_id", (F.col("fp") == F.col("best")).alias("keeper"))


def simhash_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row ``(doc_id, fingerprint, component_id)`` per row of ``docs``, repeated and null ids included."""
    rows, classes = simhash_classes(docs)
    return rows.join(classes.select("fp", "component_id"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document of each SimHash class: that of the smallest doc_id (of its texts the one of smallest hash, of equal rows one).

    Documents without words would all fall into one class by their zero fingerprint; that class keeps one as well.
    Texts are fingerprinted once; whole rows meet only the names of the documents to keep, and are told apart only
    if the table holds rows equal in id and text.
    """
    rows, classes = simhash_classes(docs)
    keepers = classes.where("keeper").select("fp", "component_id")
    chosen = rows.join(keepers, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("fp").agg(F.min(F.struct("none", "id", "th")).alias("k")).select("k.*")
    kept = docs.select(whole_row(docs).alias("row"), *row_keys()).join(chosen, ["none", "id", "th"], "left_semi")
    if not rows.groupBy("none", "id", "th").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["none", "id", "th"])
    return kept.select("row.*")
