import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinfold.llm import mixing as S

SCHEMA = "doc_id long, text string, source string, size string, taken int, block int, row int, mark int, of_id int, of_mark int, sum int, n int, k int, copy int, source_no int, _size int, _mark int, _id int, _own int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", *range(15)) for i, t, s in rows], SCHEMA)


def shares(sizes):
    """Targets by sharing the excess again until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: S.WEIGHTS[k % 3] for k, s in enumerate(names)}
    total, stopped, out = sum(sizes.values()), set(), {}
    while True:
        left = total - sum(3 * sizes[s] for s in stopped)
        w = sum(weight[s] for s in names if s not in stopped)
        out = {s: 3.0 * sizes[s] if s in stopped else left * weight[s] / w for s in names}
        above = {s for s in names if s not in stopped and out[s] > 3 * sizes[s]}
        if not above:
            return out
        stopped |= above


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 500, "c": 20, "d": 3}, {"a": 5}, {None: 40, "é": 10, "z": 100}, {"a": 1, "b": 1, "c": 1000}])
def test_targets(spark, sizes):
    got = S.targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long"))
    want = shares(sizes)
    for r in got.collect():
        assert r.target == pytest.approx(want[r.source])


def test_schedule_is_the_golden_ratio_sequence(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 37)
    plan = spark.createDataFrame([(1, 0.0, 0.5), (2, 0.5, 0.55), (3, 0.55, 1.0)], "source_no int, low double, high double")
    got = sorted(map(tuple, S.schedule(plan, 1000).collect()))
    count, want = Counter(), []
    for i in range(1, 1001):
        u = (i * S.GOLDEN) % 1
        s = 1 if u < 0.5 else 2 if u < 0.55 else 3
        want.append((s, count[s]))
        count[s] += 1
    assert got == sorted(want)
    assert abs(count[2] - 50) <= 3


def rows_of(n):
    return [(k, " ".join(["w"] * (k % 23)), f"s{k % 4}") for k in range(n)]


def test_mix_follows_targets_and_limits(spark):
    rows = [*rows_of(600), (1000, None, "s1"), (1001, "a  b\tc", None), (None, "x y", "s2"), (7, "w w", "s3"), (7, "w w", "s3"), (1002, "", None), (1003, "one " * 5000, "s0")]
    got = S.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = shares(sizes)
    by_size = {n: s for s, n in sizes.items()}
    assert len(by_size) == len(sizes)
    taken = Counter()
    for r in got:
        s = by_size[r.source_size]
        assert r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s, v in want.items():
        assert abs(taken[s] - v) <= max(5, 0.02 * v)
    again = S.mix(docs(spark, rows[::-1])).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_pieces_do_not_matter(spark, monkeypatch):
    df = docs(spark, rows_of(300))
    want = sorted(map(tuple, S.mix(df).collect()))
    monkeypatch.setattr(S, "PIECE", 11)
    assert sorted(map(tuple, S.mix(df).collect())) == want


def test_blocks_by_brute_force(spark):
    """Documents laid out by hand, blocks cut by hand, the schedule run by hand."""
    rows = rows_of(200)
    df = docs(spark, rows)
    marks = {r.doc_id: r.mark for r in df.select("doc_id", S.mark_of().alias("mark")).collect()}
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    goal = shares(sizes)
    names = sorted(sizes)
    block = max(1, min(S.BLOCK, sum(sizes.values()) // S.LEAST_SLOTS))
    blocks = {s: max(1, math.ceil(sizes[s] / block)) for s in names}
    want = {s: goal[s] * blocks[s] / sizes[s] for s in names}
    edges, at = [], 0.0
    for s in names:
        edges.append((at / sum(want.values()), (at + want[s]) / sum(want.values()), s))
        at += want[s]
    times, rank = Counter(), Counter()
    for i in range(1, round(sum(want.values())) + 1):
        u = (i * S.GOLDEN) % 1
        s = next((s for a, b, s in edges if a <= u < b), None)
        if s is not None and rank[s] < 3 * blocks[s]:
            times[s, rank[s] % blocks[s]] += 1
            rank[s] += 1
    taken, place = {}, Counter()
    for i, t, s in sorted(rows, key=lambda r: (marks[r[0]], len(r[1].split()), r[0])):
        taken[i] = 0
        for w in range(place[s], place[s] + len(t.split())):
            taken[i] += times[s, next(j for j in range(blocks[s]) if j * sizes[s] // blocks[s] <= w < (j + 1) * sizes[s] // blocks[s])] if blocks[s] < 60 else times[s, w]
        place[s] += len(t.split())
    assert {r.doc_id: r.taken for r in S.mix(df).collect()} == taken


def test_stage(spark):
    rows = [*rows_of(300), (900, None, "s1")]
    out = S.mixed_documents(docs(spark, rows))
    assert out.columns == docs(spark, []).columns and {tuple(r)[3:] for r in out.collect()} == {("x", *range(15))}
    words = {r.source: r.w for r in out.groupBy("source").agg(F.sum(F.size(F.filter(F.split("text", " "), lambda x: x != ""))).alias("w")).collect()}
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    for s, v in shares(sizes).items():
        assert abs(words[s] - v) < 0.1 * v
    assert out.where("doc_id = 900").count() == 1
    assert S.mix(docs(spark, [])).count() == 0 and S.mixed_documents(docs(spark, [])).count() == 0
    assert [r.taken for r in S.mix(docs(spark, [(1, "", "a"), (2, None, None)])).collect()] == [0, 0]
