from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from kinfold.operators import master, survivorship
from kinfold.operators.survivorship import survivors

SCHEMA = "entity_id string, attribute string, seq long, ord int, raw_value string, norm_value string, kind string, source_id string, record_uuid string, source_column string"


def entries(spark, *rows):
    """Rows of (attribute, value[, source[, kind]]) of one entity."""
    full = [("e", r[0], k, 0, r[1], r[1], r[3] if len(r) > 3 else "text", r[2] if len(r) > 2 else "s", f"R{k}", r[0]) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def resolved(spark, *rows, priority="top"):
    return {r.attribute: (r.resolved_value, r.resolution_rule) for r in survivors(entries(spark, *rows), priority).collect()}


def test_rules_in_order(spark):
    got = resolved(
        spark, ("one", "x"), ("same", "y"), ("same", "y"), ("most", "a"), ("most", "b"), ("most", "b"), ("trust", "b", "low"), ("trust", "z", "top"), ("name", "Al"), ("name", "Alexander"), ("role", "b"), ("role", "a"),
        ("last_seen", "2024-01-01"), ("last_seen", "2024-03-01"), ("last_seen", "2023-12-31"), ("visits", "3", "s", "int"), ("visits", "12", "s", "int"),
    )
    assert got == {
        "one": ("x", "SINGLE_NON_NULL"), "same": ("y", "UNANIMOUS_CONSENSUS"), "most": ("b", "MAJORITY_VOTE"), "trust": ("z", "SOURCE_AUTHORITY_PRIORITY"), "name": ("Alexander", "COMPLETENESS_LENGTH_TIE_BREAK"),
        "role": ("a", "DETERMINISTIC_LEXICOGRAPHICAL"), "last_seen": ("2024-03-01", "MOST_RECENT_TIMESTAMP"), "visits": ("12", "MOST_RECENT_TIMESTAMP"),
    }


def test_conflicts_are_logged_in_order(spark):
    got = survivors(entries(spark, ("role", "b", "s1"), ("role", "a", "s2"))).first()
    assert got.conflict_details == "Conflicting values: s1:b, s2:a" and got.record_uuid == "R1"


def test_equivalent_attributes_merge(spark):
    values = spark.createDataFrame(
        [("1", "name", "Ann"), ("1", "display_name", "ann "), ("1", "income", "50000"), ("1", "annual_income", "50000.0"), ("1", "role", "x"), ("2", "name", "Bob"), ("2", "display_name", "BOB"), ("2", "income", "7"), ("2", "annual_income", "7"), ("2", "role", "y")],
        "entity_id string, attribute string, value string",
    )
    renames = master.equivalence_map(values)
    assert renames == {"display_name": "name", "income": "annual_income"}
    assert {r.attribute for r in master.consolidate(values, renames).collect()} == {"name", "annual_income", "role"}


def test_equivalence_keys(spark):
    rows = ["1.50", "1.5", "2024-01-05", "2024-01-05T00:00:00", " A  b ", "n/a", None]
    df = spark.createDataFrame([(x,) for x in rows], "v string")
    k = [r[0] for r in df.select(master.equivalence_key(F.col("v"))).collect()]
    assert k[0] == k[1] and k[2] == k[3] and k[4] == "text:a b" and k[5] == k[6] == ""


@pytest.mark.parametrize(
    ("text", "want"),
    [("2024/01/05", "2024-01-05 00:00:00"), ("05-Jan-2024", "2024-01-05 00:00:00"), ("Sept. 3, 2023", "2023-09-03 00:00:00"), ("03/04/2023", "2023-03-04 00:00:00"), ("25/12/2023 9:05", "2023-12-25 09:05:00"), ("20230704", "2023-07-04 00:00:00"),
     ("7 July 2023 10:11:12", "2023-07-07 10:11:12"), ("2023-7-4", "2023-07-04 00:00:00"), ("2024", "2024-01-01 00:00:00"), ("13/13/2023", None), ("Foo 3, 2023", None), ("12345678", None), ("2023-02-30", None), ("hello", None), ("10 Main 2020", None)],
)
def test_dates_as_they_are_written(spark, text, want):
    got = spark.createDataFrame([(text,)], "x string").select(survivorship.time_key(F.col("x"), F.lit("text")).alias("t")).first().t
    assert (None if got is None else str(datetime.fromtimestamp(int(got) // 10**9, timezone.utc))[:19]) == want
