"""Embedding near-duplicates: a navigable small-world graph per shard, audited beams, exact cosines, union of links."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.ann import grouped, matrix, usable
from kinfold.llm.common import components, stash
from kinfold.llm.simhash import _merge

COSINE = 0.98
#: Distinct vectors in a shard, about.
SHARD = 8192
#: Distinct vectors that one task asks a shard about, about; they pass by in chunks of ``CHUNK``.
ASK = 1 << 17
CHUNK = 8192
#: Out of ``LINK_POOL`` nearest nodes: links of a node on its layer, half of them spread; links to the layer above; links taken from nodes that chose it.
LINK_POOL, LINKS, UPWARD, TAKEN = 32, 20, 4, 16
#: One node in so many of a layer is on the next one.
THIN = 16
FIRST_BEAM = 16
#: Queries with links to other vectors that a chunk's audit answers by brute force; with fewer of them, all queries are.
AUDIT = 128
#: Cosines this near the threshold are computed again by one formula for both directions.
DOUBT = 1e-9
#: How far cosines in single precision may be off, with a wide margin.
ROUGH = 1e-4
_QUERIES = 1024


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; each is scaled by its largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def reaches(a: np.ndarray, b: np.ndarray, least: float, rough: np.ndarray) -> np.ndarray:
    """Whether the cosine of rows a[i] and b[i] of unit vectors is ``least`` or more; ``rough`` is it up to rounding."""
    out = rough >= least
    near = np.flatnonzero(np.abs(rough - least) <= DOUBT)
    out[near] = (a[near] * b[near]).sum(axis=1) >= least
    return out


class SmallWorld:
    """A hierarchical navigable small-world graph over unit vectors.

    Every layer holds all nodes of the next and more. A node is linked to near nodes of its layer, half of them such
    that no chosen one is nearer to them, to the nearest of the layer above, and back from nodes that chose it. The
    nearest are found for many nodes at once by matrix products, which within a shard of bounded size is cheaper
    than walking there one insertion after another.
    """

    def __init__(self, vectors: np.ndarray, seed: int = 5) -> None:
        self.x = vectors
        n = len(vectors)
        level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(THIN)).astype(np.int64)
        self.top = int(level.max())
        self.entry = int(level.argmax())
        single = vectors.astype(np.float32)
        members = [np.flatnonzero(level >= k) for k in range(self.top + 1)]
        self.links = [self._layer(single, members[k], members[k + 1] if k < self.top else None, n) for k in range(self.top + 1)]
        self.into = self._reversed(self.links[0], n)

    def _layer(self, single: np.ndarray, own: np.ndarray, above: np.ndarray | None, n: int) -> np.ndarray:
        links = np.full((n, LINKS + UPWARD + TAKEN), -1, dtype=np.int32)
        x, pool = single[own], min(LINK_POOL, len(own) - 1)
        for s in range(0, len(own), _QUERIES):
            q = x[s : s + _QUERIES]
            rows = own[s : s + len(q)]
            if pool:
                sims = q @ x.T
                sims[np.arange(len(q)), s + np.arange(len(q))] = -np.inf
                near = np.argpartition(-sims, pool - 1, axis=1)[:, :pool]
                near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, axis=1), axis=1), axis=1)
                chosen = self._spread(x, near, np.take_along_axis(sims, near, axis=1))
                links[rows, : chosen.shape[1]] = own[chosen]
            if above is not None:
                sims = q @ single[above].T
                up = above[np.argsort(-sims, axis=1)[:, :UPWARD]]
                links[rows, LINKS : LINKS + up.shape[1]] = np.where(up == rows[:, None], -1, up)
        a, j = np.nonzero(links[:, : LINKS + UPWARD] >= 0)
        b = links[a, j].astype(np.int64)
        sims = np.concatenate([np.einsum("ij,ij->i", single[a[s : s + 65536]], single[b[s : s + 65536]]) for s in range(0, len(a), 65536)] or [np.zeros(0)])
        order = np.lexsort((-sims, b))
        a, b = a[order], b[order]
        rank = np.arange(len(b)) - np.searchsorted(b, b, side="left")
        kept = rank < TAKEN
        links[b[kept], LINKS + UPWARD + rank[kept]] = a[kept]
        return links

    @staticmethod
    def _spread(x: np.ndarray, near: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """``LINKS`` of each row's nearest: first, up to half, those that no chosen one is nearer to; then the nearest of the rest."""
        m, pool = near.shape
        between = np.empty((m, pool, pool), dtype=np.float32)
        for s in range(0, m, 128):
            part = x[near[s : s + 128]]
            between[s : s + 128] = part @ part.transpose(0, 2, 1)
        chosen, covered = np.zeros((m, pool), dtype=bool), np.full((m, pool), -np.inf, dtype=np.float32)
        for j in range(pool):
            take = (covered[:, j] <= sims[:, j]) & (chosen.sum(axis=1) < LINKS // 2)
            chosen[:, j] = take
            covered[take] = np.maximum(covered[take], between[take, j])
        order = np.argsort(~chosen, axis=1, kind="stable")[:, :LINKS]
        return np.take_along_axis(near, order, axis=1)

    @staticmethod
    def _reversed(links: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes that chose each node of the lowest layer, so that a walk goes both ways: offsets and sources."""
        a, j = np.nonzero(links >= 0)
        b = links[a, j]
        order = np.argsort(b, kind="stable")
        return np.concatenate(([0], np.cumsum(np.bincount(b, minlength=n)))), a[order]

    def _beam(self, q: np.ndarray, start: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``width`` nodes met by a beam search of one layer from ``start``: ids (-1: none) and cosines, best first."""
        m, n = len(q), len(self.x)
        links = self.links[layer]
        seen = np.zeros((m, n + 1), dtype=bool)
        ids, sims, open_ = np.full((m, width), -1, dtype=np.int64), np.full((m, width), -np.inf), np.zeros((m, width), dtype=bool)
        ids[:, 0], sims[:, 0], open_[:, 0] = start, np.einsum("ij,ij->i", q, self.x[start]), True
        seen[np.arange(m), start] = True
        live = np.arange(m)
        while len(live):
            place = np.where(open_[live], sims[live], -np.inf).argmax(axis=1)
            go = open_[live, place]
            live, place = live[go], place[go]
            if not len(live):
                break
            open_[live, place] = False
            new = links[ids[live, place]].astype(np.int64)
            new[new < 0] = n
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = n
            fresh = ~seen[live[:, None], new] & (new < n)
            seen[live[:, None], new] = True
            s = np.full(new.shape, -np.inf)
            r, c = np.nonzero(fresh)
            s[r, c] = np.einsum("ij,ij->i", q[live[r]], self.x[new[r, c]])
            all_ids, all_sims, all_open = np.concatenate((ids[live], new), axis=1), np.concatenate((sims[live], s), axis=1), np.concatenate((open_[live], fresh), axis=1)
            by = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            sims[live] = np.take_along_axis(all_sims, by, axis=1)
            ids[live] = np.where(np.isfinite(sims[live]), np.take_along_axis(all_ids, by, axis=1), -1)
            open_[live] = np.take_along_axis(all_open, by, axis=1) & np.isfinite(sims[live])
        by = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, by, axis=1), np.take_along_axis(sims, by, axis=1)

    def _entries(self, q: np.ndarray) -> np.ndarray:
        """The node of the lowest layer that each query starts from: down the layers, by a narrow beam."""
        start = np.full(len(q), self.entry, dtype=np.int64)
        for k in range(self.top, 0, -1):
            ids, _ = self._beam(q, start, k, 4)
            start = np.where(ids[:, 0] >= 0, ids[:, 0], start)
        return start

    def within(self, q: np.ndarray, beam: int, least: float, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(query, node)`` found at ``least`` or more: a beam search, then a walk along links among such nodes.

        A query whose own node the graph holds (``own``, else -1) starts there, any other at the top.
        """
        out_q, out_n, n = [], [], len(self.x)
        offsets, sources = self.into
        for s in range(0, len(q), _QUERIES):
            part, start = q[s : s + _QUERIES], own[s : s + _QUERIES].copy()
            far = np.flatnonzero(start < 0)
            if len(far):
                start[far] = self._entries(part[far])
            ids, sims = self._beam(part, start, 0, beam)
            r, c = np.nonzero(sims >= least - DOUBT)
            r, node = r, ids[r, c]
            hit = reaches(part[r], self.x[node], least, sims[r, c])
            edge = r[hit] * n + node[hit]
            known = np.unique(edge)
            while len(edge):
                r, node = edge // n, edge % n
                direct = self.links[0][node].astype(np.int64)
                count = offsets[node + 1] - offsets[node]
                back = sources[np.repeat(offsets[node] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())]
                a, b = np.nonzero(direct >= 0)
                new = np.unique(np.concatenate((r[a] * n + direct[a, b], np.repeat(r, count) * n + back)))
                new = new[~np.isin(new, known, assume_unique=True)]
                fits = np.zeros(len(new), dtype=bool)
                for t in range(0, len(new), 65536):
                    u, v = part[new[t : t + 65536] // n], self.x[new[t : t + 65536] % n]
                    fits[t : t + 65536] = reaches(u, v, least, np.einsum("ij,ij->i", u, v))
                edge = new[fits]
                known = np.union1d(known, edge)
            out_q.append(s + known // n)
            out_n.append(known % n)
        return np.concatenate(out_q), np.concatenate(out_n)


def audited_links(world: SmallWorld, q: np.ndarray, least: float, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(query, node)`` for the links of all queries, with the beam doubled until all true links of an audit's queries are found.

    ``own`` is each query's own node, -1 if the shard does not hold it; a query is not linked with itself. Queries
    are answered by brute force in random order until ``AUDIT`` of them have a link: those are the audit, for a query
    without one tests nothing. If the queries run out first, all of them have their exact answer. A beam as wide as
    the shard is an exact scan, so the loop ends. Queries answered by brute force keep that answer.
    """
    own = np.full(len(q), -1) if own is None else own
    order = np.random.default_rng(len(q)).permutation(len(q))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    linked: list[tuple[np.ndarray, np.ndarray]] = []

    def other(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = b != own[a]
        return a[keep], b[keep]

    narrow = world.x.astype(np.float32).T.copy()

    def scan(ks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Single precision only rules out what is far below; the rest is computed in double.
        a, b = np.nonzero(q[ks].astype(np.float32) @ narrow >= least - ROUGH)
        out = [(ks[a[s : s + 65536]], b[s : s + 65536]) for s in range(0, len(a), 65536)]
        out = [(x[hit], y[hit]) for x, y in out if (hit := reaches(q[x], world.x[y], least, np.einsum("ij,ij->i", q[x], world.x[y]))).any()]
        return other(*(np.concatenate(z) for z in zip(*out, strict=True))) if out else (ks[:0], ks[:0])

    at, beam, n, audit = 0, FIRST_BEAM, len(world.x), 0
    while at < len(q) and audit < AUDIT:
        found.append(scan(order[at : at + 256]))
        audit += len(np.unique(found[-1][0]))
        linked.append(found[-1])
        at += 256
    if at < len(q):
        asks = np.unique(np.concatenate([a for a, _ in linked]))
        true = np.sort(np.concatenate([a * n + b for a, b in linked]))
    while at < len(q) and beam < n:
        a, b = world.within(q[asks], beam, least, own[asks])
        if np.isin(true, asks[a] * n + b).all():
            rest = order[at:]
            a, b = world.within(q[rest], beam, least, own[rest])
            found.append(other(rest[a], b))
            at = len(q)
        beam *= 2
    for s in range(at, len(q), 256):
        found.append(scan(order[s : s + 256]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


_LINK = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64())])


def _answers(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(len(a), kind, np.int8)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], schema=_LINK)


class _Shard:
    """A shard's graph while a label's nodes pass by: counts rows linked, and keeps the classes that the links make of its nodes."""

    def __init__(self, blob: bytes, least: float) -> None:
        self.world, self.names, self.copies = pickle.loads(blob)
        self.place = np.argsort(self.names)
        self.label, self.least, self.held = np.arange(len(self.names)), least, []

    def add(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        self.held.append((matrix(part.column("v")), part.column("node").to_numpy(), part.column("copies").to_numpy(), np.array(part.column("inside").to_pylist(), dtype=bool)))
        if sum(len(h[1]) for h in self.held) >= CHUNK:
            yield from self.ask()

    def ask(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        v, node, copies, inside = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held = []
        at = self.place[np.minimum(np.searchsorted(self.names, node, sorter=self.place), len(self.names) - 1)]
        q, hit = audited_links(self.world, unit(v), self.least, np.where(self.names[at] == node, at, -1))
        if not len(q):
            return
        yield _answers(0, node, np.bincount(q, weights=self.copies[hit], minlength=len(node)))
        # A pair of two shards is asked for once; it counts for both nodes.
        out = ~inside[q]
        if out.any():
            yield _answers(0, self.names, np.bincount(hit[out], weights=copies[q[out]], minlength=len(self.names)))
        order = np.argsort(q, kind="stable")
        q, hit = q[order], hit[order]
        first = np.searchsorted(q, q, side="left")
        self.label = _merge(self.label, hit[first], hit)
        heads = np.unique(first)
        yield _answers(1, node[q[heads]], self.names[hit[heads]])

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self.ask()
        far = np.flatnonzero(self.label != np.arange(len(self.names)))
        yield _answers(1, self.names[far], self.names[self.label[far]])


def _asked(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (label, shard, ask), each graph before the nodes that it is asked about: its answers, a chunk at a time."""
    shard = None
    for new, part in grouped(batches, ["label", "shard", "ask"]):
        if new and shard is not None:
            yield from shard.end()
            shard = None
        at = 0
        if part.column("world")[0].is_valid:
            shard, at = _Shard(part.column("world")[0].as_py(), least), 1
        if shard is not None and part.num_rows > at:
            yield from shard.add(part.slice(at))
    if shard is not None:
        yield from shard.end()


def link(df: DataFrame, least: float = COSINE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``df(vec_id, embedding, label)``.

    Only rows of one non-null label are compared; unusable vectors (see :func:`ann.usable`) and rows without a
    label or id link with nothing. Rows equal in label and vector are one node with a count and a number of its own,
    so a vector that a third of all rows hold costs one node, and rows that repeat an id under other labels or
    vectors stay rows of their own. Each label's nodes are cut into shards, whose graphs are rows of a written table.
    Every shard is asked about its own nodes and half of the other shards', so that each pair of shards meets once.
    A task holds one graph while up to ``ASK`` nodes stream by; it returns how many rows each node links to, and a
    spanning forest of the links.
    """
    ids = df.select("vec_id", "embedding", "label")
    fine = usable(ids.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull()))
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    # Equal vectors are known by 128 bits of hash, so that the vectors themselves are moved once.
    rows = stash(fine.select("vec_id", "label", v.alias("v")).withColumns({"h": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")}), "vector-rows")
    nodes = rows.groupBy("label", "h", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v")).withColumn("node", F.monotonically_increasing_id())
    nodes = stash(nodes, "vector-nodes")
    size = stash(nodes.groupBy("label").agg(F.count("*").alias("n")).selectExpr("label", f"cast(ceil(n / {SHARD}) as int) as shards", f"cast(ceil(n / {ASK}) as int) as asks"), "vector-shards")
    total = size.agg(F.sum("shards"), F.sum(F.col("shards") * F.col("asks"))).first()
    least_tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = [max(least_tasks, min(20_000, 4 * (t or 1))) for t in total]
    sized = nodes.join(size, "label").withColumn("shard", F.pmod("h", F.col("shards")).cast("int")).withColumn("ask", F.pmod(F.xxhash64("h"), F.col("asks")).cast("int"))

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node")
        world = SmallWorld(unit(np.stack(part["v"].to_numpy()).astype(np.float64)))
        blob = pickle.dumps((world, part["node"].to_numpy(), part["copies"].to_numpy()))
        return pd.DataFrame({"label": [key[0]], "shard": [key[1]], "asks": [int(part["asks"].iloc[0])], "world": [blob]})

    label_type = df.schema["label"].dataType.simpleString()
    worlds = sized.select("label", "shard", "asks", "node", "copies", "v").repartition(tasks[0], "label", "shard").groupBy("label", "shard").applyInPandas(build, f"label {label_type}, shard int, asks int, world binary")
    worlds = stash(worlds, "vector-worlds").select("label", "shard", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("ask"), F.lit(False).alias("inside"), F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("copies"), F.lit(None).cast("array<double>").alias("v"), "world")
    # Shard s is asked about by itself and by the half of the shards that follows it round; of two opposite ones, by the lower.
    half = F.expr("(shards - 1) div 2 + if(shards % 2 = 0 and shard < shards div 2, 1, 0)").cast("int")
    sent = sized.withColumn("turn", F.explode(F.sequence(F.lit(0), half)))
    sent = sent.select("label", ((F.col("shard") + F.col("turn")) % F.col("shards")).cast("int").alias("shard"), "ask", (F.col("turn") == 0).alias("inside"), "node", "copies", "v", F.lit(None).cast("binary").alias("world"))
    dealt = worlds.unionByName(sent).repartition(tasks[1], "label", "shard", "ask").sortWithinPartitions("label", "shard", "ask", F.col("world").isNull())
    answers = stash(dealt.mapInArrow(lambda b: _asked(b, least), "kind byte, a long, b long"), "vector-links")
    outside = answers.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    roots = components(answers.where("kind = 1").select("a", "b"))
    classes = nodes.select("label", "h", "h2", "node", "least", "copies").join(outside, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = stash(classes.select("label", "h", "h2", "root", "least", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-classes")
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = rows.select("vec_id", "label", "h", "h2").join(classes.join(smallest, "root").select("label", "h", "h2", "n_links", "component_id"), ["label", "h", "h2"]).select("vec_id", "n_links", "component_id")
    # Rows that took no part: told apart by what ruled them out, so that repeated ids stay rows of their own.
    d = rows.select(F.size("v").alias("d")).limit(1).first()
    e = F.col("embedding")
    part = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) == (d["d"] if d else -1))
    sound = ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    alone = ids.where(~F.coalesce(part & sound, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
