"""Sources to canonical records: raw values kept, mapped columns normalised."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.normalize import is_valid, normalize
from kinfold.functions.text import is_blank, shown, strip, title_case
from kinfold.operators.numbering import numbered, tagged
from kinfold.plans.mapping import UNMAPPED
from kinfold.plans.vocabulary import RECORD_ID_HEADERS


@dataclass(frozen=True)
class Source:
    """A dataset to resolve. ``order`` names columns that fix the order of its rows; parts of one source share a ``source_id``."""

    source_id: str
    df: DataFrame
    mapping: dict[str, str]
    source_name: str = ""
    part_number: int = 1
    total_parts: int = 1
    order: tuple[str, ...] = field(default=())

    @property
    def part_id(self) -> str:
        return f"part_{self.source_id}_{self.part_number:02d}"

    @property
    def targets(self) -> dict[str, str]:
        """Mapped columns that the source has, by raw name."""
        return {c: t for c, t in self.mapping.items() if t and t != UNMAPPED and c in self.df.columns}


def _raw(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    value = shown(F.col(f"`{name}`"), kind)
    return F.when(is_blank(value), F.lit(None).cast("string")).otherwise(value)


def _kind(spark_type: str) -> str:
    if spark_type in ("double", "float") or spark_type.startswith("decimal"):
        return "float"
    return {"boolean": "bool", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int"}.get(spark_type, "text")


def canonicalize(source: Source) -> DataFrame:
    """``(source_id, part_id, source_record_id, raw, kinds, norm, columns, order_key)`` per row of a source.

    ``raw`` maps every column to its text, null if blank; ``kinds`` gives the native kind of each. ``norm`` maps
    targets to normal forms: of several columns of one target the last counts, even if blank. A missing name is
    made from first and last name. ``columns`` maps each target to the first column that stands for it.
    ``source_record_id`` is the first filled id header, null if there is none.
    """
    df = source.df
    raw = {c: _raw(df, c) for c in df.columns}
    targets = source.targets
    norm = {t: normalize(raw[c], t) for c, t in targets.items()}

    def part(name: str) -> Column:
        own = F.nullif(norm[name], F.lit("")) if name in norm else F.lit(None).cast("string")
        return F.coalesce(own, raw[name]) if name in raw else own

    made = F.regexp_replace(title_case(strip(F.concat_ws(" ", part("first_name"), part("last_name")))), r"(?U)\s+", " ")
    norm["name"] = F.coalesce(F.nullif(norm["name"], F.lit("")), made) if "name" in norm else made
    first: dict[str, str] = {}
    for c, t in targets.items():
        first.setdefault(t, c)
    ids = [raw[c] for c in RECORD_ID_HEADERS if c in raw]
    pairs = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), v)]) if d else F.create_map().cast("map<string,string>")
    # One shape for all sources, so that they can be one table: per column its value as a number, as a double and as text, in that order.
    whole, real = "decimal(38,9)", ("float", "double")

    def ordered(c: str) -> Column:
        kind, value = dict(df.dtypes)[c], F.col(f"`{c}`")
        number = value.cast(whole) if _kind(kind) in ("int", "float") and kind not in real else F.lit(None).cast(whole)
        return F.struct(number.alias("whole"), (value.cast("double") if kind in real else F.lit(None).cast("double")).alias("real"), (F.lit(None).cast("string") if _kind(kind) in ("int", "float") else value.cast("string")).alias("text"))

    key = F.array(*[ordered(c) for c in source.order]) if source.order else F.array().cast(f"array<struct<whole: {whole}, real: double, text: string>>")
    return df.select(
        F.lit(source.source_id).alias("source_id"),
        F.lit(source.part_id).alias("part_id"),
        F.coalesce(*ids, F.lit(None).cast("string")).alias("source_record_id"),
        pairs(raw).alias("raw"),
        F.create_map(*[F.lit(x) for c, k in df.dtypes for x in (c, _kind(k))]).alias("kinds"),
        F.map_filter(pairs(norm), lambda k, v: v.isNotNull()).alias("norm"),
        pairs({t: F.lit(c) for t, c in first.items()}).alias("columns"),
        key.alias("order_key"),
    )


def validity(source: Source) -> DataFrame:
    """One boolean per target: whether the row's value is well formed."""
    return source.df.select(*[is_valid(_raw(source.df, c), t).alias(t) for c, t in source.targets.items()])


def canonical_records(sources: list[Source], start: int = 0) -> DataFrame:
    """All sources as one numbered table: ``seq`` and ``record_uuid`` follow the order of sources, then of rows."""
    parts = [canonicalize(s).withColumn("source_no", F.lit(k)) for k, s in enumerate(sources)]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    out = numbered(rows, ["source_no", "order_key", F.xxhash64(F.map_entries("raw").cast("string"))])
    first = out.groupBy("source_no").agg((F.min("seq") - 1).alias("_first"))
    named = out.join(first, "source_no").withColumn("source_record_id", F.coalesce("source_record_id", F.concat(F.lit("ROW_"), (F.col("seq") - F.col("_first")).cast("string"))))
    return named.withColumn("seq", F.col("seq") + start).withColumn("record_uuid", tagged("REC", 8, F.col("seq"))).drop("source_no", "order_key", "_first")
