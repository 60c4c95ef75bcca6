"""Approximate nearest neighbours over learned partitions: a balanced cut of a neighbour graph, and a classifier that routes."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import stash

#: Vectors of the sample that a graph, its partitions and its classifier are learned from, at most.
SAMPLE_ROWS = 6_000
#: One in so many of the sample is left out of the training and audits the routing.
AUDIT_EVERY = 6
#: Neighbours in the sample's graph.
GRAPH_K = 10
#: Distinct vectors in a partition, about, and partitions of a level, at most: beyond their product there are two levels.
LEAF_ROWS = 4096
FAN = 64
#: Share of the true neighbours that routing must find for the audit's queries; it fixes the number of probes.
RECALL = 0.93
#: Rows of a block of candidates that a task holds while the queries pass by.
BLOCK = 8192


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is not null, not zero, holds finite components only, and has the commonest length."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = df.where(v.isNotNull() & (F.size(v) > 0)).where(~bad).where(F.exists(v, lambda x: x != 0))
    lengths = fine.groupBy(F.size(v).alias("_d")).count().orderBy(F.desc("count"), "_d").first()
    return fine.where(F.size(v) == (lengths["_d"] if lengths else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as one array of doubles, a row per list."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def balanced_cut(near: np.ndarray, vectors: np.ndarray, parts: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Parts of equal size (to 5 %) that keep most edges of the graph ``near`` (rows of neighbour ids) inside.

    Starts from recursive halving along the leading direction; then vertices move, best gain first, to the part
    that holds most of their neighbours, while it has room and theirs stays filled.
    """
    n = len(near)
    part = np.zeros(n, dtype=np.int64)
    todo = [(np.arange(n), 0, parts)]
    rng = np.random.default_rng(seed)
    while todo:
        rows, first, k = todo.pop()
        if k == 1:
            part[rows] = first
            continue
        x = vectors[rows] - vectors[rows].mean(axis=0)
        d = rng.standard_normal(x.shape[1])
        for _ in range(8):
            d = x.T @ (x @ d)
            d /= np.linalg.norm(d) or 1.0
        order = rows[np.argsort(x @ d, kind="stable")]
        cut = len(rows) * (k // 2) // k
        todo += [(order[:cut], first, k // 2), (order[cut:], first + k // 2, k - k // 2)]
    most, least = int(np.ceil(n / parts * 1.05)), int(np.floor(n / parts * 0.95))
    source, target = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (source, part[target]), 1)
        np.add.at(votes, (target, part[source]), 1)
        gain = votes - votes[np.arange(n), part][:, None]
        want, size, moved = gain.argmax(axis=1), np.bincount(part, minlength=parts), 0
        for v in np.argsort(-gain.max(axis=1), kind="stable"):
            if gain[v, want[v]] <= 0:
                break
            if size[want[v]] < most and size[part[v]] > least:
                size[part[v]] -= 1
                size[want[v]] += 1
                part[v] = want[v]
                moved += 1
        if not moved:
            break
    return part


class Router:
    """A softmax classifier over one hidden layer; its most probable classes are the partitions to search."""

    def __init__(self, x: np.ndarray, soft: np.ndarray, hidden: int = 64, epochs: int = 60, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.scale = 1.0 / max(1e-12, float(np.sqrt((x**2).sum(axis=1).mean())))
        x = x * self.scale
        self.w = [rng.standard_normal((x.shape[1], hidden)) * np.sqrt(2 / x.shape[1]), np.zeros(hidden), rng.standard_normal((hidden, soft.shape[1])) * np.sqrt(1 / hidden), np.zeros(soft.shape[1])]
        mean, var, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for s in range(0, len(x), 256):
                rows = order[s : s + 256]
                h, p = self._forward(x[rows])
                back = (p - soft[rows]) / len(rows)
                inner = (back @ self.w[2].T) * (h > 0)
                step += 1
                for k, g in enumerate((x[rows].T @ inner, inner.sum(axis=0), h.T @ back, back.sum(axis=0))):
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    var[k] = 0.999 * var[k] + 0.001 * g * g
                    self.w[k] -= 0.003 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(x @ self.w[0] + self.w[1], 0)
        z = h @ self.w[2] + self.w[3]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return h, e / e.sum(axis=1, keepdims=True)

    def shares(self, vectors: np.ndarray) -> np.ndarray:
        """Each row's probabilities of the partitions."""
        return self._forward(vectors * self.scale)[1]


def neighbours(x: np.ndarray, k: int, queries: np.ndarray | None = None) -> np.ndarray:
    """The ``k`` rows of ``x`` of largest inner product with each query; without queries with each row, itself left out."""
    q, out = x if queries is None else queries, []
    for s in range(0, len(q), 1024):
        inner = q[s : s + 1024] @ x.T
        if queries is None:
            inner[np.arange(len(inner)), s + np.arange(len(inner))] = -np.inf
        out.append(np.argpartition(-inner, k, axis=1)[:, :k])
    return np.concatenate(out) if out else np.zeros((0, k), np.int64)


def learn(sample: np.ndarray, parts: int, k: int = 20) -> Router | None:
    """A router over ``parts`` balanced parts of the sample's neighbour graph; none if the sample is too small to cut."""
    if parts < 2 or len(sample) < max(8 * parts, k + 2):
        return None
    near = neighbours(sample, k)
    part = balanced_cut(near[:, :GRAPH_K], sample, parts)
    soft = np.full((len(sample), parts), 0.01)
    np.add.at(soft, (np.repeat(np.arange(len(sample)), k), part[near].ravel()), 1)
    soft[np.arange(len(sample)), part] += 1
    return Router(sample, soft / soft.sum(axis=1, keepdims=True))


class Partitions:
    """One or two levels of routers; a leaf is a first part, or a second part of it. ``probes`` leaves are searched for a query."""

    def __init__(self, first: Router | None, second: dict[int, Router] | None = None, parts: int = 1, inner: int = 1) -> None:
        self.first, self.second = first, second or {}
        self.parts, self.inner = (parts if first else 1), inner
        self.leaves = self.parts * self.inner
        self.probes = 1

    def shares(self, vectors: np.ndarray) -> np.ndarray:
        """Each row's probabilities of the leaves."""
        top = self.first.shares(vectors) if self.first else np.ones((len(vectors), 1))
        out = np.zeros((len(vectors), self.parts, self.inner))
        out[:, :, 0] = top
        for p, router in self.second.items():
            out[:, p] = top[:, p, None] * router.shares(vectors)
        return out.reshape(len(vectors), self.leaves)

    def home(self, vectors: np.ndarray) -> np.ndarray:
        return self.shares(vectors).argmax(axis=1)

    def order(self, vectors: np.ndarray) -> np.ndarray:
        """Leaves of each row, most probable first."""
        return np.argsort(-self.shares(vectors), axis=1, kind="stable")

    def audit(self, sample: np.ndarray, asked: np.ndarray, k: int, recall: float) -> float:
        """Set ``probes`` to the least that finds ``recall`` of the sample's ``k`` nearest of rows that no part was learned from; what it finds."""
        if self.leaves == 1 or not len(asked) or len(sample) <= k:
            self.probes = self.leaves
            return 1.0
        place = np.argsort(self.order(asked), axis=1)
        needed = np.take_along_axis(place, self.home(sample)[neighbours(sample, k, asked)], axis=1)
        self.probes = next(m for m in range(1, self.leaves + 1) if (needed < m).mean() >= recall or m == self.leaves)
        return float((needed < self.probes).mean())


def _near(most: int, count: Column | int) -> Column:
    """Whether a row's hash is among about the smallest ``2 * most`` of ``count`` rows."""
    return F.pmod("mark", F.lit(1 << 30)) < (F.lit(2.0 * most + 200) / count) * (1 << 30)


def _thinned(rows: DataFrame, by: str, most: int) -> DataFrame:
    """At most ``most`` rows ``(by, v)`` of each value of ``by``, those of smallest hash; a threshold thins them before any task ranks them."""
    size = rows.groupBy(by).count()
    near = rows.withColumn("mark", F.xxhash64("h", F.lit(5))).join(F.broadcast(size), by).where(_near(most, F.col("count")))
    return near.selectExpr(by, "v", f"row_number() over (partition by {by} order by pmod(mark, {1 << 30}), h, node) as place").where(F.col("place") <= most)


def partitions(nodes: DataFrame, total: int, k: int, leaf_rows: int = LEAF_ROWS) -> Partitions:
    """Partitions learned from bounded samples of ``nodes(node, h, v)``: as many as hold about ``leaf_rows`` vectors each, ``FAN`` by ``FAN`` at most.

    The first level learns from one sample on the driver, each part's second level from a sample of that part, on
    an executor; ``FAN`` routers of a few dozen kB come back.
    """
    parts = min(FAN, max(1, -(-total // leaf_rows)))
    inner = min(FAN, -(-total // (parts * leaf_rows))) if parts == FAN else 1
    marked = nodes.withColumn("mark", F.xxhash64("h", F.lit(5))).where(_near(SAMPLE_ROWS, max(1, total)))
    got = matrix(marked.orderBy(F.pmod("mark", F.lit(1 << 30)), "h", "node").limit(SAMPLE_ROWS).select("v").toArrow().column("v"))
    asks = np.arange(len(got)) % AUDIT_EVERY == AUDIT_EVERY - 1
    found = Partitions(learn(got[~asks], parts, k), parts=parts, inner=inner if parts > 1 else 1)
    if found.inner > 1 and found.first:
        model = nodes.sparkSession.sparkContext.broadcast(found.first)
        part_of = F.arrow_udf(lambda v: pa.array(model.value.shares(matrix(v)).argmax(axis=1) if len(v) else [], pa.int32()), "int")

        def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            router = learn(np.stack(rows["v"].to_numpy()).astype(np.float64), inner, k)
            return pd.DataFrame({"p": [key[0]], "model": [pickle.dumps(router)]})

        split = stash(nodes.select("node", "h", "v", part_of("v").alias("p")), "ann-parts")
        for r in _thinned(split, "p", SAMPLE_ROWS).select("p", "v").groupBy("p").applyInPandas(fit, "p int, model binary").collect():
            router = pickle.loads(r["model"])
            if router is not None:
                found.second[r["p"]] = router
    found.audit(got[~asks], got[asks], k, RECALL)
    return found


def _top(queries: np.ndarray, vectors: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, row, score)``: the ``k`` best rows of one block for each query, ties to the smaller ``least``."""
    out = []
    for s in range(0, len(queries), 256):
        inner = queries[s : s + 256] @ vectors.T
        # The product of blocks may differ in the last bits from that of two vectors; near-ties are scored again.
        floor = np.partition(inner, len(vectors) - k, axis=1)[:, len(vectors) - k] if len(vectors) > k else np.full(len(inner), -np.inf)
        row, col = np.nonzero(inner >= (floor - 1e-9 * np.abs(floor).clip(1e-300, 1e300))[:, None])
        score = np.concatenate([(queries[s + row[t : t + 65536]] * vectors[col[t : t + 65536]]).sum(axis=1) for t in range(0, len(row), 65536)] or [np.zeros(0)])
        order = np.lexsort((least[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
        out.append((s + row[keep], col[keep], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """The slices of sorted batches that lie in one group, each with whether its group begins there."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        cuts = [0, *(j for j in range(1, len(own)) if own[j] != own[j - 1]), len(own)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield own[a] != last, batch.slice(a, b - a)
            last = own[a]


def _compare(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by block, candidates before queries: holds a block's candidates and answers its queries as they pass."""
    schema = pa.schema([("query", pa.int64()), ("node", pa.int64()), ("least", pa.int64()), ("score", pa.float64())])
    held: list[tuple] = []
    for new, part in grouped(batches, ["leaf", "block", "asks"]):
        v, node = matrix(part.column("v")), part.column("node").to_numpy()
        if not part.column("asks")[0].as_py():
            held = ([] if new else held) + [(v, node, part.column("least").to_numpy())]
            block = (part.column("leaf")[0].as_py(), part.column("block")[0].as_py())
        elif held and block == (part.column("leaf")[0].as_py(), part.column("block")[0].as_py()):
            if len(held) > 1:
                held = [tuple(np.concatenate(x) for x in zip(*held, strict=True))]
            q, row, score = _top(v, held[0][0], held[0][2], k)
            yield pa.record_batch([pa.array(node[q]), pa.array(held[0][1][row]), pa.array(held[0][2][row]), pa.array(score)], schema=schema)


def _searched(nodes: DataFrame, asked: DataFrame, sizes: DataFrame, k: int, probes: int, model) -> DataFrame:
    """``(query, node, least, score)``: per query node, the best ``k`` of each block of its ``probes`` most probable leaves."""
    order = F.arrow_udf(lambda v: pa.array(list(model.value.order(matrix(v))[:, :probes].astype(np.int32)) if len(v) else [], pa.list_(pa.int32())), "array<int>")
    spark = nodes.sparkSession
    blocks = sizes.selectExpr("leaf", f"cast(ceil(n / {BLOCK}) as int) as blocks")
    held = nodes.join(F.broadcast(blocks), "leaf").select("leaf", F.pmod("h", F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("asks"), "node", "v", "least")
    sent = asked.select("node", "v", "least", F.explode(order("v")).alias("leaf")).join(F.broadcast(blocks), "leaf")
    sent = sent.select("leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("asks"), "node", "v", "least")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(20_000, blocks.agg(F.sum("blocks")).first()[0] or 1))
    dealt = held.unionByName(sent).repartition(tasks, "leaf", "block").sortWithinPartitions("leaf", "block", "asks")
    return dealt.mapInArrow(lambda b: _compare(b, k), "query long, node long, least long, score double")


def search(df: DataFrame, queries: DataFrame, k: int = 20, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows of ``df`` found for each row of ``queries``, by inner product.

    Both are ``(vec_id, embedding)``. Equal vectors are one node with its ``k + 1`` smallest ids, which are all that
    any answer can show, so a vector that a third of all rows hold is indexed and asked once. Every node lies in its
    most probable leaf; a query goes to as many of its most probable leaves as the audit asks for. A leaf is cut by
    hash into blocks of about ``BLOCK`` nodes, each held by one task while the queries stream by. A query that finds
    fewer than ``k`` is asked again in all leaves. Unusable vectors take no part; rows with a null vec_id neither.
    Rows of one vec_id never find each other; a repeated query is answered once, by its vector of smallest hash.
    """
    rows = usable(df.where(F.col("vec_id").isNotNull())).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)).alias("v"))
    # Equal vectors are known by 128 bits of hash, so that the vectors themselves are moved once.
    rows = stash(rows.withColumns({"h": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")}), "ann-rows")
    named_rows = rows.select("vec_id", "h", "h2").distinct()
    few = named_rows.selectExpr("vec_id", "h", "h2", "row_number() over (partition by h, h2 order by vec_id) as place").where(F.col("place") <= k + 1)
    few = few.groupBy("h", "h2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = rows.groupBy("h", "h2").agg(F.first("v").alias("v")).join(few, ["h", "h2"])
    nodes = stash(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("least", F.col("ids")[0]), "ann-nodes")
    found = partitions(nodes.select("node", "h", "v"), nodes.count(), k, leaf_rows)
    model = df.sparkSession.sparkContext.broadcast(found)
    home = F.arrow_udf(lambda v: pa.array(model.value.home(matrix(v)) if len(v) else [], pa.int32()), "int")
    index = stash(nodes.select("node", "h", "v", "least", home("v").alias("leaf")), "ann-index")
    sizes = stash(index.groupBy("leaf").agg(F.count("*").alias("n")), "ann-sizes")
    wanted = queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    own = named_rows.join(wanted, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("h", "h2")).alias("x")).select(F.col("vec_id").alias("query_id"), "x.h", "x.h2")
    who = stash(own.join(nodes.select("h", "h2", "node"), ["h", "h2"]).select("query_id", "node"), "ann-queries")
    asked = nodes.join(who.select("node").distinct(), "node", "left_semi").select("node", "v", "least")
    ids = nodes.select("node", "ids")

    def named(pairs: DataFrame) -> DataFrame:
        """The best ``k + 1`` ids of each query node: they lie in its best ``k + 1`` nodes, so only those meet their ids."""
        near = pairs.selectExpr("*", "row_number() over (partition by query order by score desc, least) as place").where(F.col("place") <= k + 1).select("query", "node", "score")
        shown = near.join(ids, "node").select("query", "score", F.explode("ids").alias("vec_id"))
        return stash(shown.selectExpr("*", "row_number() over (partition by query order by score desc, vec_id) as place").where(F.col("place") <= k + 1).drop("place"), "ann-found")

    best = named(_searched(index, asked, sizes, k + 1, found.probes, model))
    if found.probes < found.leaves:
        short = asked.join(best.groupBy("query").count().where(F.col("count") > k).select(F.col("query").alias("node")), "node", "left_anti")
        short = stash(short, "ann-short")
        if not short.isEmpty():
            best = best.join(short.select(F.col("node").alias("query")), "query", "left_anti").unionByName(named(_searched(index, short, sizes, k + 1, found.leaves, model)))
    answers = who.join(best, who["node"] == best["query"]).where("vec_id <> query_id")
    ranked = answers.selectExpr("query_id", "cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank", "vec_id", "score")
    return ranked.where(F.col("rank") <= k)


def every_twentieth(df: DataFrame) -> DataFrame:
    """The stated query set: rows whose vec_id is divisible by 20, against all rows."""
    return search(df, df.where(F.col("vec_id") % 20 == 0))
