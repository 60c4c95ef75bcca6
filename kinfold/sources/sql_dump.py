"""SQL dumps: scripts run in an embedded SQLite on the driver, each table then a DataFrame."""

from __future__ import annotations

import os
import sqlite3
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from kinfold.plans.staging import shared_dir

#: Scripts above this many bytes are loaded into a file instead of memory.
IN_MEMORY = 10 * 1024 * 1024
#: Rows handed to Spark at a time.
CHUNK = 50_000


def statements(path: str) -> Iterator[str]:
    """The statements of a script, one at a time; a large script is never held whole."""
    held = ""
    with open(path, encoding="utf-8") as f:
        for line in f:
            held += line
            if ";" in line and sqlite3.complete_statement(held):
                yield held
                held = ""
    if held.strip():
        yield held


def read_sql_dump(spark: SparkSession, path: str, in_memory: int = IN_MEMORY) -> dict[str, DataFrame]:
    """All tables of a dump file by name. Raises FileNotFoundError if there is none.

    A dump is a script, which one engine must run in order; the driver does, statement by statement, and writes each
    table in chunks of ``CHUNK`` rows to the shared folder. A column has the type that all its values have, whatever
    it was declared as: long, double (also where longs and doubles mix) or text; without values, what was declared.
    """
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    on_disk = os.path.getsize(path) > in_memory
    handle, name = tempfile.mkstemp(suffix=".sqlite") if on_disk else (None, ":memory:")
    if handle is not None:
        os.close(handle)
    db = sqlite3.connect(name)
    try:
        for statement in statements(path):
            db.executescript(statement)
        tables = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        return {t: _table(spark, db, t) for t in tables}
    finally:
        db.close()
        if on_disk:
            os.remove(name)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _type(db: sqlite3.Connection, table: str, column: str, declared: str) -> str:
    found = {r[0] for r in db.execute(f"SELECT DISTINCT typeof({_quoted(column)}) FROM {_quoted(table)}")} - {"null"}
    if not found:
        return "bigint" if "INT" in declared else "double" if any(x in declared for x in ("REAL", "FLOA", "DOUB")) else "string"
    return "bigint" if found == {"integer"} else "double" if found <= {"integer", "real"} else "string"


def _text(value: object) -> str:
    return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)


def _table(spark: SparkSession, db: sqlite3.Connection, table: str) -> DataFrame:
    types = {r[1]: _type(db, table, r[1], r[2].upper()) for r in db.execute(f"PRAGMA table_info({_quoted(table)})")}
    schema = ", ".join(f"`{c.replace('`', '``')}` {t}" for c, t in types.items())
    make = {"bigint": int, "double": float, "string": _text}
    rows, where, wrote = db.execute(f"SELECT * FROM {_quoted(table)}"), f"{shared_dir(spark)}/dump-{uuid.uuid4().hex}", False
    while chunk := rows.fetchmany(CHUNK):
        typed = [tuple(None if v is None else make[t](v) for v, t in zip(r, types.values(), strict=True)) for r in chunk]
        df = spark.createDataFrame(typed, schema)
        if not wrote and len(chunk) < CHUNK:
            return df
        df.coalesce(1).write.mode("append").parquet(where)
        wrote = True
    return spark.read.schema(schema).parquet(where) if wrote else spark.createDataFrame([], schema)
