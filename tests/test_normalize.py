import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinfold.functions import similarity as sim
from kinfold.functions.normalize import is_valid, normalize
from kinfold.functions.text import is_blank, native, shown, slug, title_case

CASES = [
    ("email", "  Foo.Bar@X.Co ", "foo.bar@x.co", True), ("email", "not mail", "not mail", False), ("email", None, "", True), ("email", " NaN ", "", True),
    ("phone", "+91 98765-43210", "9876543210", True), ("phone", "09876543210", "9876543210", True), ("phone", "15552345678.0", "5552345678", True), ("phone", "+1 (555) 234-5678", "5552345678", True),
    ("phone", "0091 9876543210", "9876543210", True), ("phone", "123", "123", False), ("name", "  o'brien   m.g. 12th ", "O'Brien M.G. 12Th", True), ("sku", " ab_1  2.0", "AB-1-2", True), ("sku", "x", "X", False),
    ("barcode", "01-2 3.0", "0123", True), ("username", " Big  User ", "big_user", True), ("uid", " ab.0 ", "AB.0", True), ("aadhaar", "4521 6789 1234", "452167891234", True), ("aadhaar", "12", "12", False),
    ("price", "12.0", "12", True), ("price", "1.2.0", "1.2.0", True), ("notes", "  a  b ", "a  b", True), ("city", "new  delhi", "New Delhi", True), ("name", "éa", "Éa", True),
]


def test_normalisers(spark):
    for field in {c[0] for c in CASES}:
        own = [c for c in CASES if c[0] == field]
        df = spark.createDataFrame([(k, c[1]) for k, c in enumerate(own)], "k int, raw string")
        got = df.select("k", normalize(F.col("raw"), field).alias("n"), is_valid(F.col("raw"), field).alias("v")).orderBy("k").collect()
        assert [(r.n, r.v) for r in got] == [(c[2], c[3]) for c in own]


def test_normalisers_are_idempotent(spark):
    for field, raw, *_ in CASES:
        if field == "phone":
            continue
        once = spark.createDataFrame([(raw,)], "raw string").select(normalize(F.col("raw"), field).alias("a"))
        row = once.select("a", normalize(F.col("a"), field).alias("b")).first()
        assert row.a == row.b


def test_blank_literals(spark):
    rows = [(x,) for x in (None, "", "  ", "NULL", "n/a", "-", "<NA>", "NaT", "0", "False")]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(is_blank(F.col("x"))).collect()]
    assert got == [True] * 8 + [False] * 2


def test_text_of_native_values(spark):
    df = spark.createDataFrame([(9876543210.0, True, 0.5)], "a double, b boolean, c double")
    row = df.select(shown(F.col("a"), "double"), shown(F.col("b"), "boolean"), shown(F.col("c"), "double"), title_case(F.lit("x-ray")), slug(F.lit(" Source  ID! "))).first()
    assert tuple(row) == ("9876543210.0", "True", "0.5", "X-Ray", "source_id")


@pytest.mark.parametrize(("a", "b", "want"), [("martha", "marhta", 0.9611), ("dwayne", "duane", 0.84), ("same", "SAME ", 1.0), ("", "x", 0.0), ("a", "b", 0.0), ("abc", None, 0.0)])
def test_jaro_winkler(a, b, want):
    assert round(sim._jaro_winkler_batch(pd.Series([a], dtype=object), pd.Series([b], dtype=object))[0], 4) == want


def test_similarities(spark):
    df = spark.createDataFrame([("kitten", "sitting", "a b", "b c", "nan", "1990-01-01")], "a string, b string, c string, d string, e string, f string")
    row = df.select(
        F.round(sim.levenshtein_similarity(F.col("a"), F.col("b")), 4), F.round(sim.token_jaccard(F.col("c"), F.col("d")), 4), sim.exact(F.col("e"), F.col("e")), sim.year_match(F.col("f"), F.lit("1990")), sim.soundex_equal(F.lit("Robert"), F.lit("Rupert")), sim.levenshtein_similarity(F.lit(None).cast("string"), F.col("a")),
    ).first()
    assert tuple(row) == (0.5714, 0.3333, 0.0, 1.0, 1.0, 0.0)


def test_native_values(spark):
    df = spark.createDataFrame([("5", "int"), ("0.0", "float"), ("False", "bool"), ("05", "text"), (None, "int")], "t string, k string").select(native(F.col("t"), F.col("k")).alias("v"))
    got = df.select(F.schema_of_variant("v").alias("s"), F.to_json("v").alias("j")).collect()
    assert [r.s for r in got[:4]] == ["BIGINT", "DOUBLE", "BOOLEAN", "STRING"] and [r.j for r in got] == ["5", "0.0", "false", '"05"', None]
