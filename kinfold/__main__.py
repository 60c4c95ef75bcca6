"""Resolve files from the command line: ``python -m kinfold a.csv b.csv dump.sql --export out --store repository``."""

from __future__ import annotations

import argparse
import os
import time

from pyspark.sql import SparkSession

from kinfold.operators.records import Source
from kinfold.operators.resolve import resolve
from kinfold.plans.mapping import HeaderMapper, slug
from kinfold.sources.files import read_csv, table_name, write_export
from kinfold.sources.repository import Repository
from kinfold.sources.sql_dump import read_sql_dump


def main(args: list[str] | None = None) -> dict:
    """Map, resolve and report the given files; the statistics as a dict."""
    parser = argparse.ArgumentParser(prog="kinfold", description=__doc__)
    parser.add_argument("files", nargs="+", help="CSV files with headers, or SQL dumps ending in .sql")
    parser.add_argument("--export", help="folder for the wide master as CSV")
    parser.add_argument("--store", help="folder for all tables as Parquet")
    parser.add_argument("--edges", action="store_true", help="store the log of all matching pairs as well")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("kinfold").getOrCreate()
    tables = {}
    for path in given.files:
        name = os.path.basename(path)
        if path.endswith(".sql"):
            tables |= {table_name(name, t): df for t, df in read_sql_dump(spark, path).items()}
        else:
            tables[name] = read_csv(spark, path)
    mapper, began = HeaderMapper(), time.time()
    sources = [Source(f"src_{slug(name)}", df, {c: p.suggested_canonical for c, p in mapper.propose(df.columns).items()}, name) for name, df in tables.items()]
    found = resolve(sources)
    stats = found.statistics.first().asDict() | {"total_sources": len(sources)}
    if given.export:
        write_export(found.wide(), given.export)
    if given.store:
        Repository(spark, given.store).save(found, edges=given.edges)
    stats["elapsed_seconds"] = round(time.time() - began, 2)
    for name, value in stats.items():
        print(f"{name}: {value}")
    return stats


if __name__ == "__main__":
    main()
