"""Golden records: one resolved value per entity and attribute, with the rule that chose it and where it came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.normalize import normalize
from kinfold.functions.text import is_blank, slug, strip
from kinfold.operators.numbering import numbered, tagged
from kinfold.plans.vocabulary import FIELDS, INTERNAL

DEFAULT_PRIORITY_SOURCE = "src_hr_db"
# Names of attributes that keep their most recent value, and fields in which longer text is better.
TEMPORAL_NAME = r"(?i)(last_active|last_seen|last_login|updated_at|created_at|timestamp|_date$|^date_|_at$|activity_date)"
LONGER_IS_BETTER = ("name", "address", "company", "notes", "business_name", "category")
IDENTIFIERS_SHOWN_NORMAL = ("email", "aadhaar", "sku", "barcode")
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
#: Other ways in which dates are written, and how each is read; where day and month could be either, the month is first.
#: A time after a date is read as well. Month names are English, in any case.
_CLOCK = r"(?:[ T](\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?))?$"
_DATES = (
    (r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})", "yMd"), (r"^(\d{4})-(\d{1,2})-(\d{1,2})", "yMd"), (r"^(\d{4})(\d{2})(\d{2})", "yMd"), (r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})", "Mdy"),
    (r"^(\d{1,2})[ -]([A-Za-z]{3,9})\.?,?[ -](\d{4})", "dNy"), (r"^([A-Za-z]{3,9})\.? (\d{1,2}),? (\d{4})", "Ndy"), (r"^(\d{4})[ -]([A-Za-z]{3,9})\.?[ -](\d{1,2})", "yNd"),
)
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _written(raw: Column) -> Column:
    """The ISO text of a date in one of the ways above, else null."""
    found = F.lit(None).cast("string")
    for pattern, order in _DATES[::-1]:
        whole = pattern + _CLOCK
        part = {kind: F.regexp_extract(raw, whole, k + 1) for k, kind in enumerate(order)}
        if "N" in part:
            name = F.lower(part["N"])
            part["M"] = F.coalesce(*[F.when(name.isin(m, m[:3], "sept" if m[:3] == "sep" else m), F.lit(str(k + 1))) for k, m in enumerate(_MONTHS)])
        month, day = part["M"], part["d"]
        if order == "Mdy":  # a first number above twelve is a day
            swapped = part["M"].try_cast("int") > 12
            month, day = F.when(swapped, part["d"]).otherwise(part["M"]), F.when(swapped, part["M"]).otherwise(part["d"])
        clock = F.regexp_extract(raw, whole, 4)
        clock = F.when(clock == "", "00:00").when(F.length(F.substring_index(clock, ":", 1)) == 1, F.concat(F.lit("0"), clock)).otherwise(clock)
        text = F.concat(part["y"], F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"), F.lit("T"), clock)
        found = F.when(raw.rlike(whole), text).otherwise(found)
    return found


def time_key(raw: Column, kind: Column) -> Column:
    """Nanoseconds since 1970 of a value that reads as a time, else null.

    ISO dates and times, four-digit years and the commoner other ways of writing dates are read from text; numbers
    count as nanoseconds, floats cut to whole ones; booleans are no times.
    """
    text = F.when(raw.rlike(r"^\d{4}$"), F.concat(raw, F.lit("-01-01"))).when(raw.rlike(_ISO), raw).otherwise(_written(strip(raw)))
    # Nanoseconds in decimal, as years beyond 2262 would not fit a long.
    at = (F.unix_micros(F.try_to_timestamp(text)).cast("decimal(30,0)") * 1000).cast("decimal(30,0)")
    return F.when(kind.isin("int", "float"), F.floor(raw.try_cast("double")).cast("decimal(30,0)")).when(kind == "text", at)


def attribute_entries(records: DataFrame, members: DataFrame) -> DataFrame:
    """``(entity_id, attribute, seq, ord, raw_value, norm_value, kind, source_id, record_uuid, source_column)``.

    Mapped targets first (``ord`` 0), then the raw columns that no target took (1); an attribute of both kinds
    pools them. Blank values, bookkeeping columns' values included where blank, make no entry.
    """
    r = records.join(members.select("seq", "entity_id"), "seq")
    mapped = r.select("entity_id", "seq", "source_id", "record_uuid", "raw", "kinds", "columns", F.explode("norm").alias("attribute", "norm_value")).select(
        "entity_id", "attribute", "seq", F.lit(0).alias("ord"), F.coalesce(F.col("raw")[F.coalesce(F.col("columns")[F.col("attribute")], F.col("attribute"))], F.col("norm_value")).alias("raw_value"),
        F.trim("norm_value").alias("norm_value"), F.coalesce(F.col("kinds")[F.coalesce(F.col("columns")[F.col("attribute")], F.col("attribute"))], F.lit("text")).alias("kind"),
        "source_id", "record_uuid", F.coalesce(F.col("columns")[F.col("attribute")], F.col("attribute")).alias("source_column"),
    )
    left = F.map_filter("raw", lambda k, v: v.isNotNull() & ~F.array_contains("taken", k))
    rest = r.withColumn("taken", F.map_values("columns"))
    passed = rest.select("entity_id", "seq", "source_id", "record_uuid", "kinds", F.explode(left).alias("attribute", "raw_value")).select(
        "entity_id", "attribute", "seq", F.lit(1).alias("ord"), "raw_value", F.trim("raw_value").alias("norm_value"), F.coalesce(F.col("kinds")[F.col("attribute")], F.lit("text")).alias("kind"),
        "source_id", "record_uuid", F.col("attribute").alias("source_column"),
    )
    return mapped.unionByName(passed).where(~is_blank(F.col("norm_value")))


def survivors(entries: DataFrame, priority_source: str = DEFAULT_PRIORITY_SOURCE) -> DataFrame:
    """``(entity_id, attribute, resolved_value, kind, source_id, record_uuid, source_column, raw_value, resolution_rule, conflict_details)``.

    ``kind`` is that of the value's source, so that :func:`text.native` gives the value back in its own type.

    Rules in order: the most recent value of a temporal attribute; the single value; the one value all agree on;
    the most frequent; among equally frequent ones that of the priority source; the longest, then first by
    text, where longer is better; the first by text. An attribute is temporal by its name, or, unless it is a
    canonical field, if at least two and half of its values read as times.

    Entries are first folded to one row per distinct value, so an entity with very many copies of a value
    ranks few rows; only contested attributes gather their entries for the log.
    """
    place = F.struct("seq", "ord", "raw_value", "kind", "source_id", "record_uuid", "source_column")
    timed = entries.withColumn("t", time_key(F.col("raw_value"), F.col("kind")))
    values = timed.groupBy("entity_id", "attribute", "norm_value").agg(
        F.count("*").alias("n"), F.min(place).alias("first"), F.min(F.when(F.col("source_id") == priority_source, place)).alias("trusted"),
        F.count("t").alias("dated"), F.max("t").alias("t"),
        F.min(F.when(F.col("t").isNotNull(), F.struct((-F.col("t")).alias("k"), place.alias("at")))).getField("at").alias("latest"),
    )
    own = Window.partitionBy("entity_id", "attribute")
    seen = values.withColumns({"total": F.sum("n").over(own), "distinct": F.count("*").over(own), "most": F.max("n").over(own), "dates": F.sum("dated").over(own)})
    seen = seen.withColumn("top", F.col("n") == F.col("most")).withColumn("tops", F.sum(F.col("top").cast("int")).over(own)).withColumn("trusts", F.max(F.col("top") & F.col("trusted").isNotNull()).over(own))
    by_name = F.col("attribute").rlike(TEMPORAL_NAME)
    guessed = ~F.col("attribute").isin(*FIELDS) & (F.col("dates") >= 2) & (F.col("dates") >= F.floor((F.col("total") + 1) / 2))
    longer = F.col("attribute").isin(*LONGER_IS_BETTER)
    rule = (
        F.when((by_name | guessed) & (F.col("dates") > 0), "MOST_RECENT_TIMESTAMP")
        .when(F.col("total") == 1, "SINGLE_NON_NULL")
        .when(F.col("distinct") == 1, "UNANIMOUS_CONSENSUS")
        .when(F.col("tops") == 1, "MAJORITY_VOTE")
        .when(F.col("trusts"), "SOURCE_AUTHORITY_PRIORITY")
        .when(longer, "COMPLETENESS_LENGTH_TIE_BREAK")
        .otherwise("DETERMINISTIC_LEXICOGRAPHICAL")
    )
    ruled = seen.withColumn("rule", rule)
    recent, trusted = F.col("rule") == "MOST_RECENT_TIMESTAMP", F.col("rule") == "SOURCE_AUTHORITY_PRIORITY"
    rank = Window.partitionBy("entity_id", "attribute").orderBy(
        F.when(recent, F.col("t")).desc_nulls_last(), F.when(recent, F.col("norm_value")).desc_nulls_last(), F.when(recent, 0).otherwise(F.when(F.col("top"), 0).otherwise(1)),
        F.when(trusted, F.col("trusted")).asc_nulls_last(), F.when(F.col("rule") == "COMPLETENESS_LENGTH_TIE_BREAK", -F.length("norm_value")).asc_nulls_last(), "norm_value",
    )
    won = ruled.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1")
    won = won.withColumn("at", F.when(recent, F.col("latest")).when(trusted, F.col("trusted")).otherwise(F.col("first")))
    raw = F.col("at.raw_value")
    resolved = F.when(recent, raw).when(F.col("attribute") == "phone", normalize(F.col("norm_value"), "phone")).when(F.col("attribute").isin(*IDENTIFIERS_SHOWN_NORMAL), F.col("norm_value")).otherwise(raw)
    chosen = won.select("entity_id", "attribute", resolved.alias("resolved_value"), "at.kind", "at.source_id", "at.record_uuid", "at.source_column", raw.alias("raw_value"), F.col("rule").alias("resolution_rule"), "distinct")
    logged = conflict_log(entries, chosen.where((F.col("distinct") > 1) & (F.col("resolution_rule") != "MOST_RECENT_TIMESTAMP")).select("entity_id", "attribute"))
    return chosen.drop("distinct").where(~is_blank(F.col("resolved_value"))).join(logged, ["entity_id", "attribute"], "left")


def conflict_log(entries: DataFrame, contested: DataFrame) -> DataFrame:
    """``(entity_id, attribute, conflict_details)``: all values of contested attributes with their sources, in the order of records."""
    own = entries.join(contested, ["entity_id", "attribute"], "left_semi")
    listed = F.array_sort(F.collect_list(F.struct("seq", "ord", "source_id", "norm_value")))
    text = F.array_join(F.transform(listed, lambda x: F.concat(x["source_id"], F.lit(":"), x["norm_value"])), ", ")
    return own.groupBy("entity_id", "attribute").agg(F.concat(F.lit("Conflicting values: "), text).alias("conflict_details"))


def field_provenance(resolved: DataFrame) -> DataFrame:
    """Survivors numbered in the order of entities and attributes."""
    return numbered(resolved, ["entity_id", "attribute"], "n").select(
        tagged("PROV", 7, F.col("n")).alias("provenance_id"), "entity_id", F.col("attribute").alias("canonical_field"), "resolved_value", "source_id", "record_uuid", "source_column", "raw_value",
        F.col("resolved_value").alias("normalized_value"), "resolution_rule", "conflict_details",
    )


# For each golden column the attributes that fill it, in order.
GOLDEN = {
    "golden_name": ("name", "full_name", "business_name", "username"), "golden_email": ("email", "email_id"), "golden_phone": ("phone", "phone_number"),
    "golden_username": ("username", "handle"), "golden_member_id": ("member_id", "uid", "aadhaar", "employee_id"), "golden_address": ("address", "city"), "golden_company": ("company", "organization"),
}


def master_entities(members: DataFrame, entries: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row per entity: its size, golden columns, all attributes as a map, and the share of its attributes that resolved."""
    sizes = members.groupBy("entity_id").agg(F.count("*").alias("cluster_size"))
    attributes = resolved.groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attribute", "resolved_value")))).alias("attributes"))
    total = entries.groupBy("entity_id").agg(F.count_distinct("attribute").alias("_total"))
    joined = sizes.join(attributes, "entity_id", "left").join(total, "entity_id", "left").withColumn("attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>")))
    filled = lambda name: F.when(~F.col("attributes")[name].isin("", "0", "0.0", "False"), F.col("attributes")[name])
    golden = [F.coalesce(*[filled(n) for n in names], F.lit("")).alias(c) for c, names in GOLDEN.items()]
    quality = F.when(F.coalesce("_total", F.lit(0)) == 0, 1.0).otherwise(F.round(F.size("attributes") / F.col("_total"), 2))
    return joined.select("entity_id", "cluster_size", *golden, "attributes", quality.alias("entity_quality_score"))


def drop_internal(entries: DataFrame) -> DataFrame:
    """Entries whose attribute is not a bookkeeping name."""
    return entries.where(~slug(F.col("attribute")).isin(*INTERNAL))
