"""Entity search and the replay of how an entity's records were linked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.text import MATCH_NULL_LITERALS, digits, strip


def _target(field: str) -> Column:
    own = F.nullif(F.col("norm")[field], F.lit(""))
    return strip(F.coalesce(own, F.col("raw")[field], F.lit("")))


def _has_no_value(value: str | None) -> bool:
    return value is None or value.strip().lower() in MATCH_NULL_LITERALS


def seeds(records: DataFrame, field: str, value: str) -> DataFrame:
    """Records whose ``field`` is ``value``: by lower case for e-mail and username, by digits for phone and national id, else also as a part."""
    if _has_no_value(value):
        return records.limit(0)
    target, want = _target(field), value.strip()
    if field in ("email", "username"):
        return records.where(F.lower(target) == want.lower())
    if field in ("phone", "aadhaar"):
        return records.where(((digits(target) != "") & (digits(target) == digits(F.lit(want)))) | (target == want))
    return records.where(F.lower(target).contains(want.lower()))


def entity_of(records: DataFrame, labels: DataFrame, field: str, value: str) -> int | None:
    """The root of the entity that the first matching record belongs to; None if nothing matches."""
    first = seeds(records, field, value).orderBy("seq").limit(1).select("seq")
    found = labels.join(F.broadcast(first), "seq").select("root").first()
    return None if found is None else found["root"]


def trace(records: DataFrame, labels: DataFrame, edges: DataFrame, field: str, value: str) -> DataFrame:
    """The match trail of the entity that the first matching record belongs to.

    ``(step_number, action, source_dataset, record_uuid, identifier_type, identifier_value, match_confidence,
    root, cluster_size)``: the seed, then one step per edge of the entity in the order in which they were logged.
    A step's record is the side whose source was not yet discovered, b if a's was. No match, no rows.
    """
    first = seeds(records, field, value).orderBy("seq").limit(1).select(F.col("seq").alias("_seed"), F.col("source_id").alias("_seed_source"), F.col("record_uuid").alias("_seed_uuid"))
    entity = first.join(labels, F.col("_seed") == F.col("seq")).select("_seed", "_seed_source", "_seed_uuid", F.col("root").alias("_root"))
    members = labels.join(F.broadcast(entity), F.col("root") == F.col("_root")).select("seq", "_root", "_seed_source")
    size = members.agg(F.count("*").alias("cluster_size"))
    own = edges.join(members.select(F.col("seq").alias("seq_a"), "_root", "_seed_source"), "seq_a")
    # A source is discovered by the seed or by any earlier edge; the first edge that names it is its discovery.
    sides = own.select("step_order", F.explode(F.array("source_id_a", "source_id_b")).alias("source")).groupBy("source").agg(F.min("step_order").alias("found"))
    steps = own.join(sides.withColumnRenamed("source", "source_id_a"), "source_id_a")
    known = (F.col("source_id_a") == F.col("_seed_source")) | (F.col("found") < F.col("step_order"))
    trail = steps.select(
        "step_order", F.concat(F.lit("Link via "), F.upper("identifier_type"), F.lit(": "), F.col("identifier_value")).alias("action"),
        F.when(known, F.col("source_id_b")).otherwise(F.col("source_id_a")).alias("source_dataset"), F.when(known, F.col("record_uuid_b")).otherwise(F.col("record_uuid_a")).alias("record_uuid"),
        "identifier_type", "identifier_value", "match_confidence", F.col("_root").alias("root"),
    )
    seed = entity.select(
        F.lit(0).cast("long").alias("step_order"), F.lit(f"Seed {field} = {value}").alias("action"), F.col("_seed_source").alias("source_dataset"), F.col("_seed_uuid").alias("record_uuid"),
        F.lit(None).cast("string").alias("identifier_type"), F.lit(None).cast("string").alias("identifier_value"), F.lit(None).cast("double").alias("match_confidence"), F.col("_root").alias("root"),
    )
    # One entity's trail is ordered as a whole.
    number = F.row_number().over(Window.partitionBy("root").orderBy("step_order"))
    return seed.unionByName(trail).withColumn("step_number", number).crossJoin(size).select("step_number", "action", "source_dataset", "record_uuid", "identifier_type", "identifier_value", "match_confidence", "root", "cluster_size")


def search(provenance: DataFrame, members: DataFrame, records: DataFrame, labels: DataFrame, field: str, value: str) -> DataFrame:
    """``(entity_id, how)`` of the entity found, at most one row.

    In the order of their say: the entity of the first matching record (``replay``), a resolved value equal but
    for case (``exact``), one that contains the text (``substring``), the entity's own id (``id``). Of several
    the smallest entity id counts. In a substring ``%`` and ``_`` are wildcards.
    """
    if _has_no_value(value):
        return provenance.select("entity_id", F.lit("").alias("how")).limit(0)
    want, own = value.strip(), provenance.where(F.col("canonical_field") == field)
    text = F.lower("resolved_value")
    first = seeds(records, field, want).orderBy("seq").limit(1).select("seq")
    ways = [
        (1, "replay", first.join(members.select("seq", "entity_id"), "seq").select("entity_id")),
        (2, "exact", own.where(text == want.lower()).select("entity_id")),
        (3, "substring", own.where(text.like(f"%{want.lower()}%")).select("entity_id")),
    ]
    if field == "entity_id" or want.isdigit():
        ways.append((4, "id", members.where(F.col("entity_id") == want).select("entity_id")))
    found = None
    for order, how, rows in ways:
        part = rows.agg(F.min("entity_id").alias("entity_id")).where("entity_id is not null").select("entity_id", F.lit(how).alias("how"), F.lit(order).alias("_order"))
        found = part if found is None else found.unionByName(part)
    return found.orderBy("_order").limit(1).select("entity_id", "how")


def evidence(keys: DataFrame, members: DataFrame, entity_id: str | None = None) -> DataFrame:
    """``(entity_id, identifier_type, identifier_value, match_confidence, links)``: what holds an entity together, each value once.

    All records of a value lie in one entity, so its links follow from their number and no pair is made.
    """
    own = members.select("seq", "entity_id")
    own = own if entity_id is None else own.where(F.col("entity_id") == entity_id)
    held = keys.join(own, "seq").groupBy("entity_id", "identifier_type", "identifier_value").agg(F.max("confidence").alias("match_confidence"), F.count("*").alias("n")).where("n > 1")
    return held.withColumn("links", F.expr("n * (n - 1) div 2")).drop("n")


def entity_records(records: DataFrame, members: DataFrame, entity_id: str) -> DataFrame:
    """The source rows of one entity."""
    return records.join(members.where(F.col("entity_id") == entity_id).select("seq"), "seq", "left_semi").orderBy("seq")


def search_fields(records: DataFrame, provenance: DataFrame) -> DataFrame:
    """``(field, place)``: every field that some record or entity fills, the usual ones first."""
    # Fields offered first.
    usual = ("email", "phone", "aadhaar", "username", "uid", "member_id", "sku", "barcode", "name")
    filled = lambda m: F.explode(F.map_keys(F.map_filter(m, lambda k, v: v.isNotNull() & (v != "")))).alias("field")
    names = records.select(filled("norm")).unionByName(records.select(filled("raw"))).unionByName(provenance.select(F.col("canonical_field").alias("field"))).distinct()
    place = F.coalesce(*[F.when(F.col("field") == f, k) for k, f in enumerate(usual)], F.lit(len(usual)))
    return names.select("field", place.alias("place"))
