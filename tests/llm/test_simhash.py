import numpy as np
import pytest
import xxhash

from kinfold.llm import simhash as S

SCHEMA = "doc_id long, text string, fp string, root int, lang string, row int, none int, id int, th int, _fp int, keeper int, component_id int"


def by_definition(text):
    words = [w for w in text.encode().lower().replace(b"\t", b" ").replace(b"\n", b" ").split(b" ") if w]
    spans = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, near):
    label = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            low = min(label[j] for j in np.flatnonzero(near[i]))
            changed |= low < label[i]
            label[i] = min(low, label[i])
    least = {}
    for i, r in enumerate(label):
        if ids[i] is not None:
            least[r] = min(least.get(r, ids[i]), ids[i])
    return [least.get(r) for r in label]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "en", *range(7)) for i, t in rows], SCHEMA)


BASE = " ".join(f"word{k % 37} item{k % 53}" for k in range(400))
ROWS = [(5, BASE), (3, BASE), (9, BASE.replace("item7 ", "thing7 ", 1)), (1, "tiny"), (2, "TINY"), (4, ""), (7, None), (None, "other words here now"), (8, "other words here now"), (11, BASE), (11, BASE), (6, "naïve café words"), (12, " \t\n ")]


def test_every_pair_within_the_radius_shares_a_table():
    rng = np.random.default_rng(0)
    for _ in range(300):
        x = int(rng.integers(0, 1 << 63))
        for r in (1, 2, 3):
            y = x
            for b in rng.choice(64, r, replace=False):
                y ^= 1 << int(b)
            assert any(x & m == y & m for m in S.TABLES)
    for t, inner in zip(S.TABLES, S.INNER, strict=True):
        assert all(m & t == 0 for m in inner)
        assert all(64 - (t | m).bit_count() <= 18 for m in inner)


def test_matches_brute_force(spark):
    got = sorted(map(tuple, S.simhash_near_duplicates(docs(spark, ROWS)).collect()), key=str)
    ids = [i for i, _ in ROWS]
    fps = [by_definition(t or "") for _, t in ROWS]
    near = np.array([[(a ^ b).bit_count() <= 3 for b in fps] for a in fps])
    want = sorted([(i, f"{f:016x}", c) for i, f, c in zip(ids, fps, components(ids, near), strict=True)], key=str)
    assert got == want


def test_keeps_one_of_each_class(spark):
    kept = S.keep_one_of_each(docs(spark, ROWS))
    assert kept.columns == docs(spark, []).columns and {tuple(r)[2:] for r in kept.collect()} == {("x", 1, "en", *range(7))}
    got = [r.doc_id for r in kept.collect()]
    classes = {r.component_id for r in S.simhash_near_duplicates(docs(spark, ROWS)).collect()}
    assert sorted(got) == sorted(classes) and len(set(got)) == len(got)


def test_empty_table(spark):
    assert S.simhash_near_duplicates(docs(spark, [])).count() == 0
    assert S.keep_one_of_each(docs(spark, [])).count() == 0


@pytest.mark.parametrize("small", [2, 40, 4096])
def test_large_buckets_are_split_exactly(spark, small):
    rng = np.random.default_rng(1)
    centre = [int(x) for x in rng.integers(0, 1 << 62, 6)]
    fps = set()
    for c in centre:
        for _ in range(120):
            x = c
            for b in rng.choice(64, int(rng.integers(1, 7)), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    values = np.array(sorted(fps), dtype=np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None]) <= 3
    want = components(list(range(len(values))), near)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    edges = S.link_fingerprints(df, small_bucket=small).collect()
    place = {int(v): k for k, v in enumerate(values.view(np.int64))}
    linked = np.eye(len(values), dtype=bool)
    for e in edges:
        linked[place[e.a], place[e.b]] = linked[place[e.b], place[e.a]] = True
    assert components(list(range(len(values))), linked) == want


def test_dense_bucket_by_lookup():
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 1 << 14, 3000).astype(np.uint64) | np.uint64(1 << 40))
    a, b = S.close_in_bucket(fps)
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3
    assert len(a) == len(fps) - len(set(components(list(range(len(fps))), near)))
    assert len(a) == len(b)
