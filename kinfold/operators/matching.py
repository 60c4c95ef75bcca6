"""Match keys, the edge log, and clusters of records that share an identifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.normalize import is_valid
from kinfold.functions.text import MATCH_NULL_LITERALS, is_blank
from kinfold.operators.components import clusters
from kinfold.operators.numbering import numbered, tagged
from kinfold.plans.staging import staged
from kinfold.plans.vocabulary import COMPOSITE, RULES, Rule


def _composite() -> Column:
    """Name and address together, where the address is long and has a digit."""
    name, address = F.col("norm")["name"], F.col("norm")["address"]
    strong = ~is_blank(name, MATCH_NULL_LITERALS) & ~is_blank(address, MATCH_NULL_LITERALS) & (F.length(address) >= 20) & address.rlike(r"(?U)\d")
    return F.when(strong, F.concat(F.lower(name), F.lit("|"), F.lower(address)))


def match_keys(records: DataFrame, rules: tuple[Rule, ...] = RULES, require_valid: bool = False) -> DataFrame:
    """``(seq, record_uuid, source_id, rule_rank, identifier_type, identifier_value, confidence)`` per filled identifier.

    Blank values never make a key, so they never link. Malformed ones do, unless ``require_valid``.
    """
    found = []
    for r in rules:
        value = _composite() if r.identifier_type == COMPOSITE else F.col("norm")[r.identifier_type]
        usable = ~is_blank(value, MATCH_NULL_LITERALS)
        if require_valid and r.identifier_type != COMPOSITE:
            usable &= is_valid(value, r.identifier_type)
        text = value if r.identifier_type == COMPOSITE else F.trim(value)
        found.append(F.when(usable, F.struct(F.lit(r.rank).alias("rule_rank"), F.lit(r.identifier_type).alias("identifier_type"), text.alias("identifier_value"), F.lit(r.confidence).alias("confidence"))))
    keys = F.filter(F.array(*found), lambda k: k.isNotNull())
    return records.select("seq", "record_uuid", "source_id", F.explode(keys).alias("k")).select("seq", "record_uuid", "source_id", "k.*")


def identifier_index(keys: DataFrame) -> DataFrame:
    """The keys of single fields, numbered in the order of records and rules."""
    single = keys.where(F.col("identifier_type") != COMPOSITE)
    return numbered(single, ["seq", "rule_rank"], "n").select(tagged("IDX", 8, F.col("n")).alias("index_id"), "identifier_type", "identifier_value", "record_uuid", "source_id")


def match_edges(keys: DataFrame, start: int = 0) -> DataFrame:
    """The edge log: each pair of records that share a value of a type, a the later and b the earlier record.

    It grows with the square of a value's records, as a log of all pairs must; clusters do not depend on it.
    ``step_order`` follows the later record, then the rule, then the earlier record.
    """
    a, b = keys.alias("a"), keys.select("seq", "record_uuid", "source_id", "identifier_type", "identifier_value").alias("b")
    same = (F.col("a.identifier_type") == F.col("b.identifier_type")) & (F.col("a.identifier_value") == F.col("b.identifier_value"))
    pairs = a.join(b, same & (F.col("a.seq") > F.col("b.seq"))).select(
        F.col("a.seq").alias("seq_a"), F.col("b.seq").alias("seq_b"), F.col("a.record_uuid").alias("record_uuid_a"), F.col("b.record_uuid").alias("record_uuid_b"),
        F.col("a.source_id").alias("source_id_a"), F.col("b.source_id").alias("source_id_b"), F.col("a.rule_rank").alias("rule_rank"),
        F.col("a.identifier_type").alias("identifier_type"), F.col("a.identifier_value").alias("identifier_value"), F.col("a.confidence").alias("match_confidence"),
    )
    out = numbered(pairs, ["seq_a", "rule_rank", "seq_b"], "step_order").withColumn("step_order", F.col("step_order") + start)
    return out.withColumn("edge_id", tagged("EDGE", 6, F.col("step_order")))


def edge_count(keys: DataFrame) -> DataFrame:
    """``(total_edges)``: how many rows the edge log has, from the sizes of the values alone."""
    sizes = keys.groupBy("identifier_type", "identifier_value").agg(F.count("*").cast("decimal(38,0)").alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long"), F.lit(0)).alias("total_edges"))


def entity_keys(keys: DataFrame, labels: DataFrame, root: Column | int) -> DataFrame:
    """The keys of one entity's records; its part of the edge log is :func:`match_edges` of them, but for the numbers."""
    return keys.join(F.broadcast(labels.where(F.col("root") == root).select("seq")), "seq", "left_semi")


def star_links(keys: DataFrame) -> DataFrame:
    """``(a, b)``: each record to the first record of each of its values; as many rows as keys, whatever their sizes."""
    first = keys.groupBy("identifier_type", "identifier_value").agg(F.min("seq").alias("b"), F.max("seq").alias("_last")).where("b <> _last")
    return keys.join(first, ["identifier_type", "identifier_value"]).select(F.col("seq").alias("a"), "b")


def cluster_records(records: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """``(seq, root)`` per record, the root being the first record that can be reached."""
    keys = match_keys(records) if keys is None else keys
    return clusters(records.select(F.col("seq").alias("node")), star_links(keys)).withColumnRenamed("node", "seq")


def grown_clusters(labels: DataFrame, keys: DataFrame, more: DataFrame, more_keys: DataFrame) -> DataFrame:
    """``labels(seq, root)`` after the records ``more`` with ``more_keys`` have joined those with ``labels`` and ``keys``.

    The new records are linked to each other and to the roots of the old ones that hold their values; only these links
    are clustered, and old records whose root joined another change it. So the iteration is over the new records and
    the roots they touch, not over all records.
    """
    held = keys.groupBy("identifier_type", "identifier_value").agg(F.min("seq").alias("seq"))
    touched = more_keys.select("identifier_type", "identifier_value").distinct().join(held, ["identifier_type", "identifier_value"])
    old = touched.join(labels, "seq").select("identifier_type", "identifier_value", "root")
    across = more_keys.join(old, ["identifier_type", "identifier_value"]).select(F.col("seq").alias("a"), F.col("root").alias("b"))
    nodes = more.select(F.col("seq").alias("node")).unionByName(across.select(F.col("b").alias("node")).distinct())
    found = staged(clusters(nodes, star_links(more_keys).unionByName(across)), "grown")
    moved = found.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("now"))
    kept = labels.join(moved, "root", "left").select("seq", F.coalesce("now", "root").alias("root"))
    return kept.unionByName(more.select("seq").join(found.withColumnRenamed("node", "seq"), "seq").select("seq", "root"))


def clusters_from_edges(records: DataFrame, edges: DataFrame) -> DataFrame:
    """The same from a stored edge log."""
    return clusters(records.select(F.col("seq").alias("node")), edges.select(F.col("seq_a").alias("a"), F.col("seq_b").alias("b"))).withColumnRenamed("node", "seq")


def entity_members(records: DataFrame, labels: DataFrame) -> DataFrame:
    """``(entity_id, seq, record_uuid, source_id, cluster_size)``; entities are numbered in the order of their roots."""
    sizes = labels.groupBy("root").agg(F.count("*").alias("cluster_size"))
    named = numbered(sizes, ["root"], "n").select("root", "cluster_size", tagged("ENT", 5, F.col("n")).alias("entity_id"))
    return labels.join(named, "root").join(records.select("seq", "record_uuid", "source_id"), "seq").select("entity_id", "seq", "record_uuid", "source_id", "cluster_size")
