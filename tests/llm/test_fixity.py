import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from kinfold.llm import fixity as S

SCHEMA = "archive string, offset long, payload string, digest string, node int"


def table(spark, rows):
    return spark.createDataFrame([(a, o, p, "x", 1) for a, o, p in rows], SCHEMA)


def brute(a, b):
    """Every record that one side holds more often than the other; single ones of a place are paired."""
    fold = lambda rows: Counter((x or "", o, len((p or "").encode()), hashlib.sha256((p or "").encode()).hexdigest()) for x, o, p in rows)
    left, right = fold(a) - fold(b), fold(b) - fold(a)
    out = []
    for place in {r[:2] for r in left | right}:
        sides = [[(*r[2:], n) for r, n in s.items() if r[:2] == place] for s in (left, right)]
        if place[1] is not None and len(sides[0]) == len(sides[1]) == 1 and sides[0][0][2] == sides[1][0][2]:
            out.append((*place, "corrupt", *sides[0][0][:2], *sides[1][0]))
            continue
        out += [(*place, "missing", *r[:2], None, None, r[2]) for r in sides[0]] + [(*place, "extra", None, None, *r) for r in sides[1]]
    return sorted(out, key=str)


def audited(spark, a, b):
    return sorted(map(tuple, S.audit(table(spark, a), table(spark, b)).collect()), key=str)


def test_locates_exactly_what_differs(spark):
    rng = random.Random(6)
    rows = [(f"f{k % 3}", 7000 * k, f"payload {k} " * rng.randint(1, 40)) for k in range(400)]
    other = rows[:]
    for k in (3, 90, 301):
        other[k] = (*other[k][:2], other[k][2].replace("payload", "paYload", 1))
    del other[200]
    other += [("f9", 5, "new"), ("f0", 123456789012, "far")]
    got = audited(spark, rows, other)
    assert got == brute(rows, other) and len(got) == 6


def test_equal_empty_and_odd_inputs(spark):
    rows = [(None, None, None), ("a", 1, ""), ("a", 1, ""), ("a", 2, "é" * 50_000), ("a", 2, "z")]
    assert S.audit(table(spark, rows), table(spark, rows[::-1])).count() == 0
    assert S.audit(table(spark, []), table(spark, [])).count() == 0
    assert audited(spark, rows, []) == brute(rows, [])
    fewer = rows[:1] + rows[2:]
    assert audited(spark, rows, fewer) == brute(rows, fewer) == [("a", 1, "missing", 0, hashlib.sha256(b"").hexdigest(), None, None, 1)]


def test_every_differing_record_of_a_place_is_reported(spark):
    rows = [("a", None, f"lost {k}") for k in range(5)] + [("a", 7, "x"), ("a", 7, "y"), ("a", 9, "p"), ("a", 9, "q"), ("a", 11, "u"), ("a", 11, "u"), (None, None, "same")]
    other = [("a", None, "new"), ("a", 7, "x"), ("a", 9, "p!"), ("a", 9, "q!"), ("a", 11, "v"), ("a", 11, "v"), (None, None, "same")]
    got = audited(spark, rows, other)
    assert got == brute(rows, other)
    assert sorted((r[1] or -1, r[2], r[-1]) for r in got) == sorted([(-1, "missing", 1)] * 5 + [(-1, "extra", 1), (7, "missing", 1), (9, "missing", 1), (9, "missing", 1), (9, "extra", 1), (9, "extra", 1), (11, "corrupt", 2)])


def test_many_records_at_one_place(spark):
    rows = [("a", 0, f"r{k}") for k in range(3000)] + [("b", None, f"r{k}") for k in range(3000)]
    other = rows[:1499] + rows[1500:4000] + rows[4001:]
    assert audited(spark, rows, other) == brute(rows, other)


def test_roots_depend_on_every_record(spark):
    rows = [("a", k * 100_000, f"r{k}") for k in range(64)]
    root = lambda r: S.tree(S.leaves(table(spark, r)))[-1].first().digest
    first = root(rows)
    assert root(rows[::-1]) == first
    for k in (0, 31, 63):
        assert root([*rows[:k], ("a", k * 100_000, "other"), *rows[k + 1 :]]) != first


def test_archives_are_contiguous(spark):
    given = [(2, "u", "<p>é</p>"), (1, None, None), (None, "v", "x"), (None, "v", "x"), (1, "w", "y"), (1, "w", "y"), (1, "w", "y")]
    pages = spark.createDataFrame([(*r, "z", 1) for r in given], "page_id long, url string, html string, archive string, n int")
    rows = S.page_records(pages, lambda r: F.concat(F.lit("X"), F.substring(r, 2, 100000))).collect()
    want = []
    for i, url, text in given:
        body = (text or "").encode()
        want.append(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{'' if i is None else i}>\r\nWARC-Target-URI: {url or ''}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n")
    assert sorted(bytes(r.digest) for r in rows) == sorted(hashlib.sha256(w).digest() for w in want)
    assert sorted(bytes(r.damaged_digest) for r in rows) == sorted(hashlib.sha256(b"X" + w[1:]).digest() for w in want)
    assert len({r.archive for r in rows}) == 2
    for archive in {r.archive for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.archive == archive), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
