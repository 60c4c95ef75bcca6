"""A small demonstration: two files about people, some of them in both."""

from __future__ import annotations

import csv
import os

from pyspark.sql import DataFrame, SparkSession

from kinfold.sources.files import read_csv

#: (given name, family name, e-mail, phone digits, town, in the first file, in the second).
PEOPLE = (
    ("Mira", "Castell", "mira.castell@example.org", "9811100001", "Porto", True, True),
    ("Jon", "Okafor", "jon.okafor@example.org", "9811100002", "Turin", True, True),
    ("Leda", "Novak", "leda.novak@example.org", "9811100003", "Graz", True, False),
    ("Omar", "Lind", "omar.lind@example.org", "9811100004", "Lund", False, True),
)


def write_demo(folder: str) -> list[str]:
    """Write ``people_a.csv`` and ``people_b.csv``, which spell the same people differently; their paths."""
    a = [{"first_name": g, "last_name": f, "email": e, "phone_number": f"+91 {p[:5]}-{p[5:]}", "city": t} for g, f, e, p, t, here, _ in PEOPLE if here]
    b = [{"full_name": f"{g} {f}".upper(), "email_id": f" {e.upper()} ", "mobile_number": f"0{p}", "city_name": t} for g, f, e, p, t, _, here in PEOPLE if here]
    os.makedirs(folder, exist_ok=True)
    paths = []
    for name, rows in (("people_a", a), ("people_b", b)):
        paths.append(os.path.join(folder, f"{name}.csv"))
        with open(paths[-1], "w", newline="", encoding="utf-8") as f:
            out = csv.DictWriter(f, rows[0])
            out.writeheader()
            out.writerows(rows)
    return paths


def demo_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The demonstration's files as tables, by file name."""
    return {os.path.basename(p): read_csv(spark, p) for p in write_demo(folder)}
