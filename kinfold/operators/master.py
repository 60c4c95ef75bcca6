"""The wide master: one row per entity, one column per attribute, attributes that say the same merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.text import is_blank, slug, strip
from kinfold.operators.survivorship import _ISO
from kinfold.plans.vocabulary import COLUMN_ORDER, FIELDS, INTERNAL


def equivalence_key(value: Column) -> Column:
    """What two values have in common if they say the same: a number, a date, or a text; '' for none."""
    text = F.lower(F.regexp_replace(strip(value), r"(?U)\s+", " "))
    number = text.try_cast("double")
    fine = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    at = F.try_to_timestamp(F.when(text.rlike(_ISO.replace("T ", "t ")), F.upper(text)))
    date = F.concat(F.lit("date:"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))
    return F.when(is_blank(value), "").when(fine, F.concat(F.lit("number:"), F.format_string("%.11e", number))).otherwise(F.coalesce(date, F.concat(F.lit("text:"), text)))


def equivalent_pairs(values: DataFrame) -> DataFrame:
    """``(left, right)`` attribute names that agree wherever both are filled, and are filled alike or agree twice.

    ``values`` is ``(entity_id, attribute, value)``. The join pairs the attributes of one entity; entities have few.
    """
    keyed = values.select("entity_id", "attribute", equivalence_key(F.col("value")).alias("k")).where("k <> ''")
    counts = keyed.groupBy("attribute").agg(F.count("*").alias("filled"))
    a, b = keyed.alias("a"), keyed.alias("b")
    both = a.join(b, (F.col("a.entity_id") == F.col("b.entity_id")) & (F.col("a.attribute") < F.col("b.attribute")))
    same = both.groupBy(F.col("a.attribute").alias("left"), F.col("b.attribute").alias("right")).agg(F.count("*").alias("overlap"), F.bool_and(F.col("a.k") == F.col("b.k")).alias("agree"))
    sized = same.join(counts.select(F.col("attribute").alias("left"), F.col("filled").alias("n_left")), "left").join(counts.select(F.col("attribute").alias("right"), F.col("filled").alias("n_right")), "right")
    alike = (F.col("n_left") == F.col("overlap")) & (F.col("n_right") == F.col("overlap"))
    return sized.where(F.col("agree") & (alike | (F.col("overlap") >= 2))).select("left", "right")


def equivalence_map(values: DataFrame) -> dict[str, str]:
    """The surviving name of each attribute that merges into another: canonical first, then most filled, then by name."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for left, right in equivalent_pairs(values).orderBy("left", "right").collect():
        a, b = root(left), root(right)
        if a != b:
            parent[b] = a
    groups: dict[str, list[str]] = {}
    for x in list(parent):
        groups.setdefault(root(x), []).append(x)
    if not groups:
        return {}
    filled = dict(values.where(F.col("attribute").isin(*parent)).groupBy("attribute").agg(F.count_if(equivalence_key(F.col("value")) != "")).collect())
    out = {}
    for group in groups.values():
        keep = min(group, key=lambda c: (c not in FIELDS, -filled.get(c, 0), c))
        out |= {c: keep for c in group if c != keep}
    return out


def consolidate(values: DataFrame, renames: dict[str, str]) -> DataFrame:
    """``values`` with merged attributes under their surviving names; per entity the first name with a value gives it."""
    if not renames:
        return values
    to = F.create_map(*[F.lit(x) for kv in renames.items() for x in kv])
    named = values.where(~is_blank(F.col("value"))).select("entity_id", F.coalesce(to[F.col("attribute")], F.col("attribute")).alias("kept"), "attribute", "value")
    return named.groupBy("entity_id", F.col("kept").alias("attribute")).agg(F.min_by("value", "attribute").alias("value"))


def source_names(members: DataFrame, sources: DataFrame) -> DataFrame:
    """``(entity_id, sources)``: the distinct names of an entity's sources in order, ``1 Source`` if none is known."""
    named = members.join(sources, "source_id", "left").groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set("source_name")), ", ").alias("sources"))
    return named.withColumn("sources", F.when(F.col("sources") == "", "1 Source").otherwise(F.col("sources")))


def ordered_attributes(names: list[str]) -> list[str]:
    """Known attributes in their fixed order, then the others by name; name parts go where a name is."""
    rest = set(names) - ({"first_name", "last_name"} if "name" in names else set())
    return [c for c in COLUMN_ORDER if c in rest] + sorted(rest - set(COLUMN_ORDER))


def wide_master(members: DataFrame, resolved: DataFrame, sources: DataFrame, where: Column | str | None = None) -> DataFrame:
    """``(entity_id, cluster_size, sources, attributes…)``, blank where an entity lacks one, wholly blank columns left out.

    Rows come by falling size, then entity. The attribute names, which become columns, are the only data that
    reach the driver.
    """
    values = resolved.select("entity_id", "attribute", F.col("resolved_value").alias("value")).where(~slug(F.col("attribute")).isin(*INTERNAL))
    merged = consolidate(values, equivalence_map(values)).where(strip(F.col("value")) != "")
    names = ordered_attributes([r[0] for r in merged.select("attribute").distinct().collect()])
    sizes = members.groupBy("entity_id").agg(F.count("*").alias("cluster_size")).join(source_names(members, sources), "entity_id")
    cells = merged.groupBy("entity_id").pivot("attribute", names).agg(F.first("value")) if names else None
    wide = sizes.join(cells, "entity_id", "left").fillna("", names) if cells is not None else sizes
    wide = wide if where is None else wide.where(where)
    return wide.select("entity_id", "cluster_size", "sources", *[F.col(f"`{c}`") for c in names]).orderBy(F.desc("cluster_size"), "entity_id")
