from collections import Counter

import numpy as np
import pytest

from kinfold.llm import ann, embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, v string, h string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if e is None else [None if x is None else float(x) for x in e], g, "x", "y") for i, e, g in rows], SCHEMA)


def clustered(n, seed, groups=40, width=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, width))
    return (centres[rng.integers(0, groups, n)] + rng.standard_normal((n, width)) * rng.choice([0.02, 0.6], (n, 1))).astype(np.float32)


ODD = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] * 16, 1), (9004, [None] + [1.0] * 15, 1), (9005, [float("inf")] * 16, 1), (9006, [1.0, 2.0], 1), (None, [1.0] * 16, 1)]


def nearest(ids, x, q, k):
    s = (x.astype(float) * x[q].astype(float)).sum(axis=1)
    keep = ids != ids[q]
    order = np.lexsort((ids[keep], -s[keep]))[:k]
    return ids[keep][order].tolist()


def test_small_search_is_exact(spark):
    x = clustered(70, 1)
    rows = [(k, x[k], k % 3) for k in range(70)] + [(100 + k, x[0], 1) for k in range(30)] + ODD
    got = {}
    for r in ann.every_twentieth(table(spark, rows)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids = np.array([*range(70), *range(100, 130)])
    all_x = np.concatenate((x, np.repeat(x[:1], 30, axis=0)))
    assert set(got) == {k for k in ids.tolist() if k % 20 == 0}
    for q, found in got.items():
        found.sort()
        assert [v for _, v, _ in found] == nearest(ids, all_x, int(np.flatnonzero(ids == q)[0]), 20)
        assert [r for r, _, _ in found] == list(range(1, 21))


@pytest.mark.parametrize(("fan", "leaf_rows"), [(64, 250), (6, 60)])
def test_recall_over_learned_partitions(spark, monkeypatch, fan, leaf_rows):
    x = clustered(2000, 2)
    got = {}
    monkeypatch.setattr(ann, "FAN", fan)
    for r in ann.search(table(spark, [(k, x[k], 0) for k in range(2000)]), table(spark, [(k, x[k], 0) for k in range(0, 2000, 20)]), leaf_rows=leaf_rows).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[q] & set(nearest(np.arange(2000), x, q, 20))) for q in got)
    assert len(got) == 100 and all(len(v) == 20 for v in got.values()) and hits >= 0.9 * 2000


def test_probes_are_few_where_vectors_have_structure(spark):
    x = clustered(4000, 9).astype(float)
    found = ann.Partitions(ann.learn(x[:3000], 16), parts=16)
    assert found.audit(x[:3000], x[3000:], 20, ann.RECALL) >= ann.RECALL and found.probes < 8


def test_queries_that_find_too_few_are_asked_everywhere(spark, monkeypatch):
    """A leaf that holds fewer rows than an answer has."""
    monkeypatch.setattr(ann, "RECALL", 0.0)
    x = np.concatenate((clustered(600, 11), np.full((12, 16), 40.0) * np.arange(1, 13)[:, None])).astype(np.float32)
    got = Counter(r.query_id for r in ann.search(table(spark, [(k, x[k], 0) for k in range(612)]), table(spark, [(k, x[k], 0) for k in range(600, 612)]), leaf_rows=40).collect())
    assert got == {k: 20 for k in range(600, 612)}


def test_a_vector_that_very_many_rows_hold(spark):
    x = clustered(200, 12)
    rows = [(k, x[k], 0) for k in range(200)] + [(1000 + k, x[5], 0) for k in range(800)]
    ids, all_x = np.array([r[0] for r in rows]), np.stack([r[1] for r in rows])
    got = {}
    for r in ann.every_twentieth(table(spark, rows)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert len(got) == 10 + 40
    for q, found in got.items():
        assert [v for _, v in sorted(found)] == nearest(ids, all_x, int(np.flatnonzero(ids == q)[0]), 20)


def test_no_rows_to_search(spark):
    assert ann.every_twentieth(table(spark, ODD)).count() == 0 and ann.every_twentieth(table(spark, [])).count() == 0


def test_cut_is_balanced():
    x = clustered(1000, 3).astype(float)
    near = np.argsort(-(x @ x.T), axis=1)[:, 1:11]
    part = ann.balanced_cut(near, x, 8)
    size = np.bincount(part, minlength=8)
    assert size.max() <= 1000 / 8 * 1.06 and size.min() >= 1000 / 8 * 0.9
    assert (part[near] == part[:, None]).mean() > 0.5


def brute_links(rows):
    fine = [k for k, (i, e, g) in enumerate(rows) if i is not None and g is not None and e is not None and len(e) == 16 and all(v is not None and np.isfinite(v) for v in e) and any(v != 0 for v in e)]
    u = {k: np.asarray(rows[k][1], dtype=float) / np.linalg.norm(np.asarray(rows[k][1], dtype=float)) for k in fine}
    links = {k: [j for j in fine if j != k and rows[j][2] == rows[k][2] and u[j] @ u[k] >= 0.98] for k in range(len(rows)) if k in u}
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((i, len(links.get(k, [])), least, i == least))
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard", "ask", "chunk"), [(8192, 8192, 8192), (60, 100, 40), (30, 1000, 1000)])
def test_links_match_brute_force(spark, monkeypatch, shard, ask, chunk):
    monkeypatch.setattr(embedding_dedup, "SHARD", shard)
    monkeypatch.setattr(embedding_dedup, "ASK", ask)
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    x = clustered(400, 4, groups=12)
    rows = [(k, x[k], k % 2) for k in range(400)] + [(500 + k, x[3], 1) for k in range(20)] + [(600, x[3] * 2, 1), (601, x[3], None), (602, x[3], 0), (7, x[7], 1)] + ODD
    # One id under two labels, under one label with near vectors, and with far ones.
    rows += [(1, x[3], 0), (1, x[3], 1), (650, x[3] * 1.001, 1), (650, x[3] + np.float32(1e-4), 1), (651, x[3], 1), (651, -x[3], 1)]
    got = sorted(map(tuple, embedding_dedup.link(table(spark, rows)).collect()), key=str)
    assert got == brute_links(rows)


def test_tiny_and_huge_components(spark):
    rows = [(1, [1e-200, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1e300, 1e299], 1), (4, [0.0, 1e-300], 1), (5, [0.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, embedding_dedup.link(df).collect())) == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 4, True), (5, 1, 4, False)]


def test_no_vectors(spark):
    assert embedding_dedup.link(table(spark, [])).count() == 0
    assert sorted(map(tuple, embedding_dedup.link(table(spark, ODD[:2])).collect())) == [(9001, 0, 9001, True), (9002, 0, 9002, True)]


def test_beam_search_finds_neighbours():
    x = np.random.default_rng(5).standard_normal((1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    world = embedding_dedup.SmallWorld(x)
    assert world.top >= 1
    ids, _ = world._beam(x[:200], world._entries(x[:200]), 0, 64)
    assert (ids[:, 0] == np.arange(200)).mean() > 0.97


def test_audit_asks_queries_that_have_links(monkeypatch):
    x = np.random.default_rng(8).normal(size=(2000, 16))
    # Every 15th query was asked before; none of these is one.
    x[2::150] = x[1::150] + 1e-3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    world = embedding_dedup.SmallWorld(x)
    true = {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.98), strict=True) if a != b}
    monkeypatch.setattr(embedding_dedup, "AUDIT", 4)
    assert {*zip(*(v.tolist() for v in embedding_dedup.audited_links(world, x, 0.98, np.arange(len(x)))), strict=True)} == true

    def own_only(self, q, beam, least, own):
        """A search that finds a query itself and nothing else."""
        return np.nonzero(q @ self.x.T > 1 - 1e-9)

    monkeypatch.setattr(embedding_dedup.SmallWorld, "within", own_only)
    for audit in (4, 128):
        monkeypatch.setattr(embedding_dedup, "AUDIT", audit)
        found = embedding_dedup.audited_links(world, x, 0.98, np.arange(len(x)))
        assert {*zip(*(v.tolist() for v in found), strict=True)} == true, audit
