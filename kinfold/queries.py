"""Registered queries of the entity-resolution engine, each with SQL that gives the same rows where SQL can.

The inputs are derived from the tables by the same expressions on both sides: three sources of people (a CRM,
first orders, event users) that share e-mails, phones, member codes or name and address, with literals for no
value in some of the keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import similarity as sim
from kinfold.functions.normalize import is_valid, normalize
from kinfold.functions.text import MATCH_NULL_LITERALS, is_blank, native
from kinfold.operators import features, jobs, linkage_models, master, matching, search, statistics, survivorship
from kinfold.operators.records import Source, canonical_records
from kinfold.operators.resolve import Resolution, extend, resolve
from kinfold.plans.mapping import HeaderMapper, compatibility, previews, validate
from kinfold.plans.staging import shared_dir, staged
from kinfold.plans.vocabulary import HEADER_SYNONYMS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- the three sources ---------------------------------------------------------------------------------------

CRM_MAP = {"cust_id": "member_id", "full_name": "name", "email_address": "email", "phone_no": "phone", "city": "city", "street_address": "address", "national_id": "aadhaar"}
ORDERS_MAP = {"user_email": "email", "contact_no": "phone", "member_code": "member_id", "full_name": "name", "street_address": "address", "notes": "notes"}
EVENTS_MAP = {"username": "username", "phone": "phone"}

PEOPLE_SQL = """
crm AS (
  SELECT c_custkey AS k, 'CUST-' || c_custkey AS cust_id, c_name AS full_name,
    CASE WHEN c_custkey % 10 = 0 THEN 'N/A' ELSE 'c' || c_custkey || '@mail' || c_nationkey || '.example.com' END AS email_address,
    CASE WHEN c_custkey % 10 = 5 THEN '-' ELSE '+91 ' || (9000000000 + c_custkey) END AS phone_no,
    n_name AS city, c_custkey || ' Long Orchard Avenue, ' || n_name AS street_address, CAST(100000000000 + c_custkey AS VARCHAR) AS national_id, c_mktsegment AS segment
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), firsts AS (
  SELECT o_custkey, o_orderdate, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1
), ord AS (
  SELECT c_custkey AS k, CASE WHEN c_custkey % 7 <> 0 THEN '  ' || upper('c' || c_custkey || '@mail' || c_nationkey || '.example.com') || ' ' END AS user_email,
    CASE WHEN c_custkey % 7 <> 0 THEN '0' || (9000000000 + c_custkey) END AS contact_no, CASE WHEN c_custkey % 7 <> 0 THEN 'cust-' || c_custkey END AS member_code,
    CASE WHEN c_custkey % 11 = 0 THEN c_name || ' jr' ELSE c_name END AS full_name, c_custkey || ' long orchard avenue,  ' || lower(n_name) AS street_address, strftime(o_orderdate, '%Y-%m-%d') AS join_date, o_orderpriority AS notes
  FROM firsts JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), evt AS (
  SELECT user_id AS k, 'User ' || user_id AS username, (9000000000 + user_id) || '.0' AS phone, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last_active_date, count(*) AS n_events FROM events GROUP BY user_id
), src AS (
  SELECT 0 AS s, k, 'src_crm' AS source_id, cust_id AS member_id, full_name AS name, email_address AS email, phone_no AS phone, city, street_address AS address, national_id AS aadhaar, NULL::VARCHAR AS username, NULL::VARCHAR AS notes FROM crm
  UNION ALL SELECT 1, k, 'src_orders', member_code, full_name, user_email, contact_no, NULL, street_address, NULL, NULL, notes FROM ord
  UNION ALL SELECT 2, k, 'src_events', NULL, NULL, NULL, phone, NULL, NULL, NULL, username, NULL FROM evt
), dig AS (
  SELECT *, CASE WHEN phone IS NULL OR phone = '-' THEN '' ELSE regexp_replace(regexp_replace(phone, '\\.0$', ''), '[^0-9]', '', 'g') END AS d FROM src
), rec AS (
  SELECT row_number() OVER (ORDER BY s, k) AS seq, source_id, s, k, upper(trim(coalesce(member_id, ''))) AS member_id, TITLE(coalesce(name, '')) AS name, TITLE(coalesce(city, '')) AS city,
    TITLE(regexp_replace(coalesce(address, ''), '\\s+', ' ', 'g')) AS address, CASE WHEN email IS NULL OR email = 'N/A' THEN '' ELSE lower(trim(email)) END AS email,
    CASE WHEN length(d) = 12 AND d LIKE '91%' THEN substr(d, 3) WHEN length(d) = 11 AND (d LIKE '0%' OR d LIKE '1%') THEN substr(d, 2) ELSE d END AS phone,
    coalesce(aadhaar, '') AS aadhaar, regexp_replace(lower(trim(coalesce(username, ''))), '\\s+', '_', 'g') AS username, coalesce(notes, '') AS notes
  FROM dig
), keys AS (
  SELECT seq, source_id, 1 AS rule_rank, 'email' AS identifier_type, email AS identifier_value, 1.0::DOUBLE AS confidence FROM rec WHERE email <> ''
  UNION ALL SELECT seq, source_id, 2, 'phone', phone, 0.98 FROM rec WHERE phone <> ''
  UNION ALL SELECT seq, source_id, 3, 'aadhaar', aadhaar, 1.0 FROM rec WHERE aadhaar <> ''
  UNION ALL SELECT seq, source_id, 6, 'username', username, 0.95 FROM rec WHERE username <> ''
  UNION ALL SELECT seq, source_id, 8, 'member_id', member_id, 0.95 FROM rec WHERE member_id <> ''
  UNION ALL SELECT seq, source_id, 9, 'name_address_fuzzy', lower(name) || '|' || lower(address), 0.88 FROM rec WHERE name <> '' AND length(address) >= 20 AND regexp_matches(address, '[0-9]')
), lnk AS (
  SELECT DISTINCT a.seq AS x, b.seq AS y FROM keys a JOIN keys b ON a.identifier_type = b.identifier_type AND a.identifier_value = b.identifier_value
), reach AS (
  SELECT seq AS x, seq AS y FROM rec UNION SELECT r.x, l.y FROM reach r JOIN lnk l ON r.y = l.x
), lab AS (
  SELECT x AS seq, min(y) AS root FROM reach GROUP BY x
), ent AS (
  SELECT lab.seq, lab.root, 'ENT_' || lpad(CAST(dense_rank() OVER (ORDER BY lab.root) AS VARCHAR), CAST(greatest(5, length(CAST(dense_rank() OVER (ORDER BY lab.root) AS VARCHAR))) AS INTEGER), '0') AS entity_id, count(*) OVER (PARTITION BY lab.root) AS cluster_size FROM lab
), edge AS (
  SELECT row_number() OVER (ORDER BY a.seq, a.rule_rank, b.seq) AS step_order, a.seq AS seq_a, b.seq AS seq_b, a.source_id AS source_id_a, b.source_id AS source_id_b, a.identifier_type, a.identifier_value, a.confidence AS match_confidence
  FROM keys a JOIN keys b ON a.identifier_type = b.identifier_type AND a.identifier_value = b.identifier_value AND a.seq > b.seq
)"""


def _title_sql(sql: str) -> str:
    """``TITLE(x)`` in SQL: pieces of letters and of others, the first character of each in upper case."""
    out, at = "", 0
    while (start := sql.find("TITLE(", at)) >= 0:
        depth, end = 1, start + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[start + 6 : end - 1]
        out += sql[at:start] + f"array_to_string(list_transform(regexp_extract_all(lower({inner}), '[a-z]+|[^a-z]+'), lambda p: upper(p[1]) || p[2:]), '')"
        at = end
    return out + sql[at:]


PEOPLE_SQL = _title_sql(PEOPLE_SQL)


def people(select: str, more: str = "") -> str:
    """SQL over the derived tables: crm, ord, evt, rec, keys, lab, ent, edge."""
    return f"WITH RECURSIVE {PEOPLE_SQL}{more} {select}"


def _str(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def people_sources(spark: SparkSession, sf_dir: str) -> list[Source]:
    customer, nation, orders, events = (_read(spark, sf_dir, t) for t in ("customer", "nation", "orders", "events"))
    k = F.col("c_custkey")
    named = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"])
    mail = F.concat(F.lit("c"), _str(k), F.lit("@mail"), _str("c_nationkey"), F.lit(".example.com"))
    crm = named.select(
        k.alias("k"), F.concat(F.lit("CUST-"), _str(k)).alias("cust_id"), F.col("c_name").alias("full_name"), F.when(k % 10 == 0, "N/A").otherwise(mail).alias("email_address"),
        F.when(k % 10 == 5, "-").otherwise(F.concat(F.lit("+91 "), _str(k + 9000000000))).alias("phone_no"), F.col("n_name").alias("city"), F.concat(_str(k), F.lit(" Long Orchard Avenue, "), "n_name").alias("street_address"),
        _str(k + 100000000000).alias("national_id"), F.col("c_mktsegment").alias("segment"),
    )
    firsts = orders.groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey", "o_orderpriority")).alias("o"))
    filled = k % 7 != 0
    ord_ = firsts.join(named, F.col("o_custkey") == k).select(
        k.alias("k"), F.when(filled, F.concat(F.lit("  "), F.upper(mail), F.lit(" "))).alias("user_email"), F.when(filled, F.concat(F.lit("0"), _str(k + 9000000000))).alias("contact_no"),
        F.when(filled, F.concat(F.lit("cust-"), _str(k))).alias("member_code"), F.when(k % 11 == 0, F.concat("c_name", F.lit(" jr"))).otherwise(F.col("c_name")).alias("full_name"), F.concat(_str(k), F.lit(" long orchard avenue,  "), F.lower("n_name")).alias("street_address"),
        F.date_format("o.o_orderdate", "yyyy-MM-dd").alias("join_date"), F.col("o.o_orderpriority").alias("notes"),
    )
    evt = events.groupBy("user_id").agg(F.max("ts").alias("ts"), F.count("*").alias("n_events")).select(
        F.col("user_id").alias("k"), F.concat(F.lit("User "), _str("user_id")).alias("username"), F.concat(_str(F.col("user_id") + 9000000000), F.lit(".0")).alias("phone"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("last_active_date"), "n_events",
    )
    return [Source("src_crm", crm, CRM_MAP, "CRM", order=("k",)), Source("src_orders", ord_, ORDERS_MAP, "Orders", order=("k",)), Source("src_events", evt, EVENTS_MAP, "Events", order=("k",))]


def resolution(spark: SparkSession, sf_dir: str) -> Resolution:
    return resolve(people_sources(spark, sf_dir), priority_source="src_crm")


# --- normalisers ---------------------------------------------------------------------------------------------

_RAW_SQL = {
    "email": ("customer", "c_custkey", "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' C' || c_custkey || '@Mail.Example.COM ' WHEN 2 THEN 'bad mail ' || c_custkey WHEN 3 THEN 'NaN' ELSE 'x.y-' || c_custkey || '@a-b.co' END"),
    "phone": ("customer", "c_custkey", "CASE c_custkey % 6 WHEN 0 THEN '+91 ' || (9000000000 + c_custkey) WHEN 1 THEN '00' || (4400000000 + c_custkey) WHEN 2 THEN '0' || (9000000000 + c_custkey) WHEN 3 THEN '1' || (5550000000 + c_custkey) || '.0' WHEN 4 THEN '-' ELSE '(' || c_custkey || ') 12' END"),
    "aadhaar": ("customer", "c_custkey", "CASE c_custkey % 4 WHEN 0 THEN '4521 ' || (10000000 + c_custkey) WHEN 1 THEN 'n/a' WHEN 2 THEN '12-' || c_custkey ELSE 'UID' || (100000000000 + c_custkey) END"),
    "sku": ("part", "p_partkey", "CASE p_partkey % 4 WHEN 0 THEN ' sku_' || p_partkey || ' a  b' WHEN 1 THEN p_partkey || '.0' WHEN 2 THEN NULL ELSE p_brand || '_' || p_partkey END"),
    "barcode": ("part", "p_partkey", "CASE p_partkey % 4 WHEN 0 THEN '0-12 ' || p_partkey || '.0' WHEN 1 THEN 'ab#' || p_partkey WHEN 2 THEN 'none' ELSE CAST(p_partkey AS VARCHAR) END"),
    "username": ("customer", "c_custkey", "CASE c_custkey % 3 WHEN 0 THEN '  Big  User ' || c_custkey WHEN 1 THEN c_name ELSE 'undefined' END"),
    "member_id": ("customer", "c_custkey", "CASE c_custkey % 3 WHEN 0 THEN ' cust-' || c_custkey || '.0' WHEN 1 THEN lower(c_name) ELSE '' END"),
    "numeric": ("part", "p_partkey", "CASE p_partkey % 4 WHEN 0 THEN p_partkey || '.0' WHEN 1 THEN p_size || '.50' WHEN 2 THEN ' 1.2.0 ' ELSE 'null' END"),
    "name": ("part", "p_partkey", "CASE p_partkey % 4 WHEN 0 THEN '  o''brien   ' || p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN '12th m.g. ' || p_type ELSE '-' END"),
    "address": ("customer", "c_custkey", "c_custkey || '  long orchard av., flat ' || c_custkey || 'b'"),
    "company": ("supplier", "s_suppkey", "CASE s_suppkey % 3 WHEN 0 THEN lower(s_name) || ' &  sons' WHEN 1 THEN ' ' || s_name ELSE NULL END"),
    "notes": ("supplier", "s_suppkey", "'  ' || s_name || ' a  b '"),
}
_BLANK_SQL = "raw IS NULL OR lower(trim(raw)) IN ('', 'nan', 'none', 'null', 'undefined', 'n/a', 'na', '-', '<na>', 'nat')"
_DIGITS_SQL = "regexp_replace(regexp_replace(regexp_replace(trim(raw), '\\.0$', ''), '[^0-9]', '', 'g'), '^00', '')"
_RULE_SQL = {
    "email": "lower(trim(raw))",
    "phone": f"CASE WHEN length({_DIGITS_SQL}) = 12 AND {_DIGITS_SQL} LIKE '91%' THEN substr({_DIGITS_SQL}, 3) WHEN length({_DIGITS_SQL}) = 11 AND substr({_DIGITS_SQL}, 1, 1) IN ('0', '1') THEN substr({_DIGITS_SQL}, 2) ELSE {_DIGITS_SQL} END",
    "aadhaar": "regexp_replace(trim(raw), '[^0-9]', '', 'g')",
    "sku": "regexp_replace(regexp_replace(upper(trim(raw)), '\\.0$', ''), '[\\s_]+', '-', 'g')",
    "barcode": "upper(regexp_replace(regexp_replace(trim(raw), '\\.0$', ''), '[^A-Za-z0-9]', '', 'g'))",
    "username": "regexp_replace(lower(trim(raw)), '\\s+', '_', 'g')",
    "member_id": "upper(trim(raw))",
    "numeric": "regexp_replace(trim(raw), '^([^.]*)\\.0$', '\\1')",
    "notes": "trim(raw)",
} | {f: "TITLE(regexp_replace(trim(raw), '\\s+', ' ', 'g'))" for f in ("name", "address", "company")}
_VALID_SQL = {"email": "regexp_matches(norm, '^[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\\.[A-Za-z0-9_]+$')", "phone": "length(norm) BETWEEN 7 AND 15", "aadhaar": "length(norm) >= 6", "sku": "length(norm) >= 2", "barcode": "length(norm) >= 4"}


def _norm_query(field: str) -> None:
    table, key, raw = _RAW_SQL[field]
    sql = f"SELECT id, raw, norm, raw_blank OR ({_VALID_SQL.get(field, 'true')}) AS valid FROM (SELECT *, CASE WHEN raw_blank THEN '' ELSE {_RULE_SQL[field]} END AS norm FROM (SELECT id, raw, {_BLANK_SQL} AS raw_blank FROM (SELECT {key} AS id, {raw} AS raw FROM {table})))"
    sql = _title_sql(sql)
    spark_raw = raw.replace("VARCHAR", "STRING").replace("''b", "\\'b").replace("o\\'b", "o\\'b")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _read(spark, sf_dir, table).select(F.col(key).alias("id"), F.expr(spark_raw).alias("raw"))
        return df.select("id", "raw", normalize(F.col("raw"), field).alias("norm"), is_valid(F.col("raw"), field).alias("valid"))

    query(f"norm_{field}", sql)(run)


for _field in _RAW_SQL:
    _norm_query(_field)


@query("null_isolation", "SELECT id, raw, coalesce(lower(trim(raw)) IN ('', 'nan', 'none', 'null', 'undefined', 'n/a', 'na', '-', '<na>', 'nat'), true) AS blank, coalesce(lower(trim(raw)) IN ('', 'nan', 'none', 'null', 'undefined', 'n/a', 'na', '-'), true) AS match_blank FROM (SELECT event_id AS id, CASE event_id % 12 WHEN 0 THEN '' WHEN 1 THEN ' NaN ' WHEN 2 THEN 'None' WHEN 3 THEN 'NULL' WHEN 4 THEN 'undefined' WHEN 5 THEN 'N/A' WHEN 6 THEN 'na' WHEN 7 THEN '-' WHEN 8 THEN '<NA>' WHEN 9 THEN 'NaT' WHEN 10 THEN NULL ELSE event_type END AS raw FROM events)")
def null_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    literals = ["", " NaN ", "None", "NULL", "undefined", "N/A", "na", "-", "<NA>", "NaT", None]
    raw = F.col("event_type")
    for k, x in enumerate(literals):
        raw = F.when(F.col("event_id") % 12 == k, F.lit(x).cast("string")).otherwise(raw)
    df = _read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), raw.alias("raw"))
    return df.select("id", "raw", is_blank(F.col("raw")).alias("blank"), is_blank(F.col("raw"), MATCH_NULL_LITERALS).alias("match_blank"))


@query("name_synthesis", "SELECT id, 'Seg ' || upper(substr(seg, 1, 1)) || lower(substr(seg, 2)) || CASE WHEN id % 2 = 0 THEN ' Mc' ELSE '' END AS name, 'CU-' || id AS source_record_id FROM (SELECT c_custkey AS id, c_mktsegment AS seg FROM customer)")
def name_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    df = c.select(k.alias("k"), F.when(k % 3 == 0, F.concat(F.lit("CU-"), _str(k))).alias("id"), F.concat(F.lit("CU-"), _str(k)).alias("cust_id"), F.concat(F.lit("seg "), F.lower("c_mktsegment")).alias("first_name"), F.when(k % 2 == 0, "MC").alias("last_name"))
    records = canonical_records([Source("src", df, {"first_name": "first_name", "last_name": "last_name"}, order=("k",))])
    return records.select(F.col("raw")["k"].cast("long").alias("id"), F.col("norm")["name"].alias("name"), "source_record_id")


# --- matching and clusters ------------------------------------------------------------------------------------


@query("canonical_records", people("SELECT seq, source_id, email, phone, aadhaar, username, member_id, name, city, address, notes FROM rec"))
def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = canonical_records(people_sources(spark, sf_dir))
    return r.select("seq", "source_id", *[F.coalesce(F.col("norm")[f], F.lit("")).alias(f) for f in ("email", "phone", "aadhaar", "username", "member_id", "name", "city", "address", "notes")])


@query("match_keys", people("SELECT seq, source_id, rule_rank, identifier_type, identifier_value, confidence FROM keys"))
def match_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution(spark, sf_dir).keys.select("seq", "source_id", "rule_rank", "identifier_type", "identifier_value", "confidence")


@query("identifier_index", people("SELECT 'IDX_' || lpad(CAST(row_number() OVER (ORDER BY seq, rule_rank) AS VARCHAR), 8, '0') AS index_id, identifier_type, identifier_value, 'REC_' || lpad(CAST(seq AS VARCHAR), 8, '0') AS record_uuid, source_id FROM keys WHERE rule_rank < 9"))
def identifier_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution(spark, sf_dir).identifier_index


EDGE_COLUMNS = ["step_order", "seq_a", "seq_b", "source_id_a", "source_id_b", "identifier_type", "identifier_value", "match_confidence"]


@query("enrichment_edges", people(f"SELECT {', '.join(EDGE_COLUMNS)} FROM edge"))
def enrichment_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution(spark, sf_dir).edges.select(*EDGE_COLUMNS)


@query("composite_edges", people("SELECT seq_a, seq_b, identifier_value FROM edge WHERE identifier_type = 'name_address_fuzzy'"))
def composite_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution(spark, sf_dir).edges.where("identifier_type = 'name_address_fuzzy'").select("seq_a", "seq_b", "identifier_value")


@query("clusters", people("SELECT seq, root FROM lab"))
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution(spark, sf_dir).labels.select("seq", "root")


@query("clusters_from_edges", people("SELECT seq, root FROM lab"))
def clusters_from_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolution(spark, sf_dir)
    return matching.clusters_from_edges(r.records, r.edges).select("seq", "root")


@query("entity_members", people("SELECT entity_id, ent.seq, source_id, cluster_size FROM ent JOIN rec ON ent.seq = rec.seq"))
def entity_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution(spark, sf_dir).members.select("entity_id", "seq", "source_id", "cluster_size")


@query("cluster_size_hist", people("SELECT cluster_size, count(DISTINCT entity_id) AS entities FROM ent GROUP BY cluster_size"))
def cluster_size_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution(spark, sf_dir).members.groupBy("cluster_size").agg(F.count_distinct("entity_id").alias("entities"))


@query("unmatched_flag", people("SELECT seq, cluster_size = 1 AS is_unmatched FROM ent"))
def unmatched_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolution(spark, sf_dir)
    return statistics.unmatched_flags(r.records, r.members).select("seq", "is_unmatched")


@query("shared_identifiers", people("SELECT a.source_id AS source_a, b.source_id AS source_b, a.identifier_type, count(*) AS shared_values FROM (SELECT DISTINCT source_id, identifier_type, identifier_value FROM keys WHERE rule_rank < 9) a JOIN (SELECT DISTINCT source_id, identifier_type, identifier_value FROM keys WHERE rule_rank < 9) b ON a.identifier_type = b.identifier_type AND a.identifier_value = b.identifier_value AND a.source_id < b.source_id GROUP BY ALL"))
def shared_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.shared_identifiers(resolution(spark, sf_dir).identifier_index)


@query("system_stats", people("SELECT (SELECT count(*) FROM rec) AS total_records, count(*) AS total_entities, count(*) FILTER (n > 1) AS linked_entities, count(*) FILTER (n = 1) AS single_entities, round(avg(n), 2) AS average_cluster_size, (SELECT count(*) FROM edge) AS total_edges FROM (SELECT root, count(*) AS n FROM lab GROUP BY root)"))
def system_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolution(spark, sf_dir)
    return statistics.system_statistics(r.members, matching.edge_count(r.keys))


@query("dedup_kpis", people("SELECT greatest(0, r - e) AS duplicates_resolved, round((r - e) / r * 100, 1) AS reduction_pct, r - s AS matched_rows FROM (SELECT (SELECT count(*) FROM rec) AS r, count(*) AS e, count(*) FILTER (n = 1) AS s FROM (SELECT root, count(*) AS n FROM lab GROUP BY root))"))
def dedup_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.dedup_kpis(statistics.system_statistics(resolution(spark, sf_dir).members))


@query("manifest", people("SELECT source_id, count(*) AS n_rows, max(CASE s WHEN 0 THEN 7 WHEN 1 THEN 6 ELSE 2 END) AS mapped_columns FROM rec GROUP BY source_id"))
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.manifest(canonical_records(people_sources(spark, sf_dir)))


# --- survivorship ---------------------------------------------------------------------------------------------

CANON = "'" + "', '".join(("email phone aadhaar username uid member_id name first_name last_name business_name company address city rating category review_count latitude longitude role notes sku barcode price stock bio followers following platform").split()) + "'"
#: Over entries(entity_id, attribute, seq, raw_value, norm_value, t, source_id) the winner of each attribute.
SURVIVE_SQL = f""", v AS (
  SELECT entity_id, attribute, norm_value, count(*) AS n, min(seq) AS first, min(CASE WHEN source_id = 'PRIORITY' THEN seq END) AS trusted, count(t) AS dated, max(t) AS t FROM entries GROUP BY ALL
), w AS (
  SELECT *, sum(n) OVER p AS total, count(*) OVER p AS dist, max(n) OVER p AS most, sum(dated) OVER p AS dates FROM v WINDOW p AS (PARTITION BY entity_id, attribute)
), u AS (
  SELECT *, sum(CASE WHEN n = most THEN 1 ELSE 0 END) OVER p AS tops, max(CASE WHEN n = most AND trusted IS NOT NULL THEN 1 ELSE 0 END) OVER p AS trusts FROM w WINDOW p AS (PARTITION BY entity_id, attribute)
), ruled AS (
  SELECT *, CASE WHEN dates > 0 AND (regexp_matches(attribute, '(last_active|last_seen|last_login|updated_at|created_at|timestamp|_date$|^date_|_at$|activity_date)') OR (attribute NOT IN ({CANON}) AND dates >= 2 AND dates >= (total + 1) // 2)) THEN 'MOST_RECENT_TIMESTAMP'
    WHEN total = 1 THEN 'SINGLE_NON_NULL' WHEN dist = 1 THEN 'UNANIMOUS_CONSENSUS' WHEN tops = 1 THEN 'MAJORITY_VOTE' WHEN trusts = 1 THEN 'SOURCE_AUTHORITY_PRIORITY'
    WHEN attribute IN ('name', 'address', 'company', 'notes', 'business_name', 'category') THEN 'COMPLETENESS_LENGTH_TIE_BREAK' ELSE 'DETERMINISTIC_LEXICOGRAPHICAL' END AS rule
  FROM u
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY entity_id, attribute ORDER BY CASE WHEN rule = 'MOST_RECENT_TIMESTAMP' THEN t END DESC NULLS LAST, CASE WHEN rule = 'MOST_RECENT_TIMESTAMP' THEN norm_value END DESC NULLS LAST,
    CASE WHEN n = most THEN 0 ELSE 1 END, CASE WHEN rule = 'SOURCE_AUTHORITY_PRIORITY' THEN trusted END NULLS LAST, CASE WHEN rule = 'COMPLETENESS_LENGTH_TIE_BREAK' THEN -length(norm_value) END NULLS LAST, norm_value) AS place FROM ruled
), won AS (
  SELECT p.entity_id, p.attribute, p.rule AS resolution_rule, p.dist, e.seq, e.source_id, e.raw_value, e.norm_value
  FROM placed p JOIN entries e ON e.entity_id = p.entity_id AND e.attribute = p.attribute AND e.norm_value = p.norm_value
    AND e.seq = CASE WHEN p.rule = 'SOURCE_AUTHORITY_PRIORITY' THEN p.trusted WHEN p.rule = 'MOST_RECENT_TIMESTAMP' THEN (SELECT min(x.seq) FROM entries x WHERE x.entity_id = p.entity_id AND x.attribute = p.attribute AND x.norm_value = p.norm_value AND x.t = p.t) ELSE p.first END
  WHERE p.place = 1
)"""
ORDER_ENTRIES_SQL = """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq FROM orders), entries AS (
  SELECT CAST(o_custkey AS VARCHAR) AS entity_id, 'status' AS attribute, seq, o_orderstatus AS raw_value, o_orderstatus AS norm_value, NULL::BIGINT AS t, 'src_' || (o_orderkey % 3) AS source_id FROM o
  UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'notes', seq, o_orderpriority, o_orderpriority, NULL, 'src_x' FROM o
  UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'role', seq, o_orderpriority, o_orderpriority, NULL, 'src_x' FROM o
  UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'order_date', seq, strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%Y-%m-%d'), epoch_ns(CAST(strftime(o_orderdate, '%Y-%m-%d') AS TIMESTAMP)), 'src_x' FROM o
  UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'units', seq, CAST(o_orderkey % 50 AS VARCHAR), CAST(o_orderkey % 50 AS VARCHAR), o_orderkey % 50, 'src_x' FROM o
)"""


def order_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of customers as their orders tell them."""
    from pyspark.sql import Window

    o = _read(spark, sf_dir, "orders").withColumn("seq", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long"))
    day, units = F.date_format("o_orderdate", "yyyy-MM-dd"), _str(F.col("o_orderkey") % 50)
    x = F.lit("src_x")
    parts = [("status", F.col("o_orderstatus"), "text", F.concat(F.lit("src_"), _str(F.col("o_orderkey") % 3))), ("notes", F.col("o_orderpriority"), "text", x), ("role", F.col("o_orderpriority"), "text", x), ("order_date", day, "text", x), ("units", units, "int", x)]
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), v.alias("raw_value"), v.alias("norm_value"), F.lit(k).alias("kind"), s.alias("source_id")) for a, v, k, s in parts])).alias("e")
    return o.select(_str("o_custkey").alias("entity_id"), "seq", F.lit(0).alias("ord"), _str("o_orderkey").alias("record_uuid"), rows).select("entity_id", "seq", "ord", "record_uuid", "e.*", F.col("e.attribute").alias("source_column"))


@query("survivor_rules", ORDER_ENTRIES_SQL + SURVIVE_SQL.replace("PRIORITY'", "src_1'", 1) + " SELECT entity_id, attribute, raw_value AS resolved_value, resolution_rule, source_id FROM won")
def survivor_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivorship.survivors(order_entries(spark, sf_dir), "src_1").select("entity_id", "attribute", "resolved_value", "resolution_rule", "source_id")


@query("native_values", ORDER_ENTRIES_SQL + SURVIVE_SQL.replace("PRIORITY'", "src_1'", 1) + " SELECT entity_id, max(TRY_CAST(raw_value AS BIGINT)) FILTER (attribute = 'units') AS units, max(raw_value) FILTER (attribute = 'notes') AS notes FROM won GROUP BY entity_id")
def native_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved values back in the types of their sources."""
    found = survivorship.survivors(order_entries(spark, sf_dir), "src_1").select("entity_id", "attribute", native(F.col("resolved_value"), F.col("kind")).alias("v"))
    units = F.when(F.schema_of_variant("v") == "BIGINT", F.variant_get("v", "$", "bigint"))
    of = lambda a, c: F.max(F.when(F.col("attribute") == a, c)).alias(a)
    return found.groupBy("entity_id").agg(of("units", units), of("notes", F.variant_get("v", "$", "string")))


@query("survivor_rule_counts", ORDER_ENTRIES_SQL + SURVIVE_SQL.replace("PRIORITY'", "src_1'", 1) + " SELECT attribute, resolution_rule, count(*) AS n FROM won GROUP BY ALL")
def survivor_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivorship.survivors(order_entries(spark, sf_dir), "src_1").groupBy("attribute", "resolution_rule").agg(F.count("*").alias("n"))


PEOPLE_ENTRIES_SQL = """, flat AS (
  SELECT rec.*, entity_id, crm.cust_id, coalesce(crm.full_name, ord.full_name) AS r_name, CASE WHEN s = 0 THEN crm.email_address ELSE trim(ord.user_email) END AS r_email, CASE WHEN s = 0 THEN crm.phone_no WHEN s = 1 THEN ord.contact_no ELSE evt.phone END AS r_phone,
    crm.city AS r_city, CASE WHEN s = 0 THEN crm.street_address ELSE ord.street_address END AS r_address, coalesce(crm.cust_id, ord.member_code) AS r_member, evt.username AS r_username, ord.notes AS r_notes, crm.segment, ord.join_date, evt.last_active_date, evt.n_events
  FROM rec JOIN ent ON rec.seq = ent.seq LEFT JOIN crm ON s = 0 AND rec.k = crm.k LEFT JOIN ord ON s = 1 AND rec.k = ord.k LEFT JOIN evt ON s = 2 AND rec.k = evt.k
), all_entries AS (
  SELECT entity_id, 'email' AS attribute, seq, r_email AS raw_value, email AS norm_value, NULL::BIGINT AS t, source_id FROM flat
  UNION ALL SELECT entity_id, 'phone', seq, r_phone, phone, NULL, source_id FROM flat UNION ALL SELECT entity_id, 'aadhaar', seq, aadhaar, aadhaar, NULL, source_id FROM flat
  UNION ALL SELECT entity_id, 'name', seq, r_name, name, NULL, source_id FROM flat UNION ALL SELECT entity_id, 'city', seq, r_city, city, NULL, source_id FROM flat
  UNION ALL SELECT entity_id, 'address', seq, r_address, address, NULL, source_id FROM flat UNION ALL SELECT entity_id, 'member_id', seq, r_member, member_id, NULL, source_id FROM flat
  UNION ALL SELECT entity_id, 'username', seq, r_username, username, NULL, source_id FROM flat UNION ALL SELECT entity_id, 'notes', seq, r_notes, notes, NULL, source_id FROM flat
  UNION ALL SELECT entity_id, 'segment', seq, segment, segment, NULL, source_id FROM flat UNION ALL SELECT entity_id, 'join_date', seq, join_date, join_date, epoch_ns(CAST(join_date AS TIMESTAMP)), source_id FROM flat
  UNION ALL SELECT entity_id, 'last_active_date', seq, last_active_date, last_active_date, epoch_ns(CAST(last_active_date AS TIMESTAMP)), source_id FROM flat
  UNION ALL SELECT entity_id, 'n_events', seq, CAST(n_events AS VARCHAR), CAST(n_events AS VARCHAR), n_events, source_id FROM flat
  UNION ALL SELECT entity_id, 'k', seq, CAST(k AS VARCHAR), CAST(k AS VARCHAR), k, source_id FROM flat
), entries AS (SELECT * FROM all_entries WHERE norm_value IS NOT NULL AND norm_value <> '')""" + SURVIVE_SQL.replace("PRIORITY'", "src_crm'", 1) + """, shown AS (
  SELECT *, CASE WHEN resolution_rule = 'MOST_RECENT_TIMESTAMP' THEN raw_value WHEN attribute IN ('phone', 'email', 'aadhaar') THEN norm_value ELSE raw_value END AS resolved_value FROM won
)"""


@query("field_provenance", people("SELECT 'PROV_' || lpad(CAST(row_number() OVER (ORDER BY entity_id, attribute) AS VARCHAR), 7, '0') AS provenance_id, entity_id, attribute AS canonical_field, resolved_value, source_id, 'REC_' || lpad(CAST(seq AS VARCHAR), 8, '0') AS record_uuid, resolution_rule FROM shown", PEOPLE_ENTRIES_SQL))
def field_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution(spark, sf_dir).provenance.select("provenance_id", "entity_id", "canonical_field", "resolved_value", "source_id", "record_uuid", "resolution_rule")


@query("conflict_log", people("SELECT e.entity_id, e.attribute, 'Conflicting values: ' || string_agg(e.source_id || ':' || e.norm_value, ', ' ORDER BY e.seq) AS conflict_details FROM entries e JOIN won w ON e.entity_id = w.entity_id AND e.attribute = w.attribute WHERE w.dist > 1 AND w.resolution_rule <> 'MOST_RECENT_TIMESTAMP' GROUP BY ALL", PEOPLE_ENTRIES_SQL))
def conflict_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution(spark, sf_dir).survivors.where("conflict_details IS NOT NULL").select("entity_id", "attribute", "conflict_details")


@query("golden_columns", people("SELECT entity_id, coalesce(max(resolved_value) FILTER (attribute = 'name'), max(resolved_value) FILTER (attribute = 'username'), '') AS golden_name, coalesce(max(resolved_value) FILTER (attribute = 'email'), '') AS golden_email, coalesce(max(resolved_value) FILTER (attribute = 'phone'), '') AS golden_phone, coalesce(max(resolved_value) FILTER (attribute = 'username'), '') AS golden_username, coalesce(max(resolved_value) FILTER (attribute = 'member_id'), max(resolved_value) FILTER (attribute = 'aadhaar'), '') AS golden_member_id, coalesce(max(resolved_value) FILTER (attribute = 'address'), max(resolved_value) FILTER (attribute = 'city'), '') AS golden_address, '' AS golden_company FROM shown GROUP BY entity_id", PEOPLE_ENTRIES_SQL))
def golden_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution(spark, sf_dir).master.select("entity_id", *survivorship.GOLDEN)


@query("quality_score", ORDER_ENTRIES_SQL + """, x AS (SELECT entity_id, attribute, true AS resolves FROM entries UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'phone', o_custkey % 3 <> 0 FROM orders)
SELECT entity_id, count(DISTINCT attribute) FILTER (resolves) AS attributes, round(count(DISTINCT attribute) FILTER (resolves) / count(DISTINCT attribute), 2) AS entity_quality_score FROM x GROUP BY entity_id""")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' attributes, and a phone that for every third of them has no digit and so resolves to nothing."""
    entries = order_entries(spark, sf_dir)
    phone = F.when(F.col("entity_id").cast("long") % 3 == 0, "ask").otherwise("555-0100")
    entries = entries.unionByName(entries.where("attribute = 'status'").withColumns({"attribute": F.lit("phone"), "raw_value": phone, "norm_value": phone, "source_column": F.lit("phone")}))
    members = entries.select("entity_id", "seq").distinct()
    return survivorship.master_entities(members, entries, survivorship.survivors(entries)).select("entity_id", F.size("attributes").cast("long").alias("attributes"), "entity_quality_score")


@query("dates_as_written", "SELECT o_orderkey, epoch_us(CAST(date_trunc('day', o_orderdate) AS TIMESTAMP)) + CASE WHEN o_orderkey % 9 = 8 THEN 47100000000 ELSE 0 END AS micros FROM orders WHERE o_orderkey % 9 <> 7")
def dates_as_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in eight ways of writing them, read back; a ninth is no date."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 9
    ways = ("yyyy/MM/dd", "dd-MMM-yyyy", "MMM d, yyyy", "MM/dd/yyyy", "yyyyMMdd", "d MMMM yyyy", "yyyy.M.d", "'on' yyyy", "yyyy-MM-dd'T13:05'")
    text = F.coalesce(*[F.when(k == j, F.date_format(d, way)) for j, way in enumerate(ways)])
    read = _read(spark, sf_dir, "orders").select("o_orderkey", survivorship.time_key(text, F.lit("text")).alias("t"))
    return read.where("t IS NOT NULL").select("o_orderkey", (F.col("t") / 1000).cast("long").alias("micros"))


@query("source_list", people("SELECT entity_id, string_agg(DISTINCT CASE s WHEN 0 THEN 'CRM' WHEN 1 THEN 'Orders' ELSE 'Events' END, ', ' ORDER BY CASE s WHEN 0 THEN 'CRM' WHEN 1 THEN 'Orders' ELSE 'Events' END) AS sources FROM ent JOIN rec ON ent.seq = rec.seq GROUP BY entity_id"))
def source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolution(spark, sf_dir)
    return master.source_names(r.members, r.sources)


WIDE = ("name", "username", "email", "phone", "aadhaar", "member_id", "city", "address", "notes", "join_date", "last_active_date", "n_events", "segment")


@query("wide_master", people(f"SELECT e.entity_id, any_value(e.cluster_size) AS cluster_size, {', '.join(f'''coalesce(max(resolved_value) FILTER (attribute = '{a}'), '') AS {a}''' for a in WIDE)} FROM (SELECT DISTINCT entity_id, cluster_size FROM ent) e JOIN shown s ON e.entity_id = s.entity_id GROUP BY e.entity_id", PEOPLE_ENTRIES_SQL))
def wide_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolution(spark, sf_dir)
    return r.wide().select("entity_id", "cluster_size", *WIDE)


@query("wide_columns", people("SELECT CAST(row_number() OVER (ORDER BY coalesce(nullif(list_position(['name', 'sku', 'barcode', 'price', 'stock', 'uid', 'username', 'email', 'phone', 'aadhaar', 'member_id', 'city', 'address'], attribute), 0), CASE attribute WHEN 'notes' THEN 50 ELSE 99 END), attribute) - 1 AS INT) AS place, attribute FROM (SELECT DISTINCT attribute FROM shown WHERE trim(resolved_value) <> '')", PEOPLE_ENTRIES_SQL))
def wide_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attribute that some entity fills is a column, in the order shown."""
    return spark.createDataFrame(list(enumerate(resolution(spark, sf_dir).wide().columns[3:])), "place int, attribute string")


_EXPORTED = ", ".join(f"max(resolved_value) FILTER (attribute = '{c}') AS {c}" for c in WIDE)


@query("export_round_trip", people(f"SELECT e.entity_id, {_EXPORTED} FROM (SELECT DISTINCT entity_id FROM ent) e JOIN shown s ON e.entity_id = s.entity_id GROUP BY e.entity_id", PEOPLE_ENTRIES_SQL))
def export_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide master as it is exported, read back as text; blanks come back as nulls."""
    import uuid

    from kinfold.sources.files import read_csv, write_export

    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    write_export(resolution(spark, sf_dir).wide(), path)
    return read_csv(spark, path).select("entity_id", *WIDE)


def _attribute_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    price, k = F.col("p_retailprice"), F.col("p_partkey")
    cells = {"brand": F.col("p_brand"), "maker": F.upper("p_brand"), "size": _str("p_size"), "size_float": F.concat(_str("p_size"), F.lit(".0")), "label": F.when(k % 2 == 0, F.col("p_name")), "title": F.when(k % 3 == 0, F.col("p_name")), "odd": F.when(k % 5 == 0, F.concat(_str("p_size"), F.lit("x"))), "cost": F.round(price, 2).cast("string")}
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), v.alias("value")) for a, v in cells.items()])).alias("c")
    return p.select(_str(k).alias("entity_id"), rows).select("entity_id", "c.*").where("value IS NOT NULL")


@query("equivalent_attributes", """WITH c AS (
  SELECT p_partkey AS e, 'brand' AS a, 'text:' || lower(p_brand) AS v FROM part UNION ALL SELECT p_partkey, 'maker', 'text:' || lower(p_brand) FROM part UNION ALL SELECT p_partkey, 'size', 'number:' || p_size FROM part UNION ALL SELECT p_partkey, 'size_float', 'number:' || p_size FROM part
  UNION ALL SELECT p_partkey, 'label', 'text:' || lower(p_name) FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'title', 'text:' || lower(p_name) FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'odd', 'text:' || p_size || 'x' FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT p_partkey, 'cost', 'number:' || p_retailprice FROM part
), n AS (SELECT a, count(*) AS n FROM c GROUP BY a)
SELECT x.a AS "left", y.a AS "right" FROM c x JOIN c y ON x.e = y.e AND x.a < y.a JOIN n nx ON nx.a = x.a JOIN n ny ON ny.a = y.a GROUP BY x.a, y.a, nx.n, ny.n HAVING bool_and(x.v = y.v) AND (count(*) >= 2 OR (count(*) = nx.n AND count(*) = ny.n))""")
def equivalent_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return master.equivalent_pairs(_attribute_values(spark, sf_dir))


# --- search ---------------------------------------------------------------------------------------------------


@query("search_exact", people("SELECT entity_id, 'replay' AS how FROM ent WHERE seq = (SELECT min(seq) FROM rec WHERE lower(email) = 'c33@mail' || (SELECT c_nationkey FROM customer WHERE c_custkey = 33) || '.example.com')"))
def search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolution(spark, sf_dir)
    nation = _read(spark, sf_dir, "customer").where("c_custkey = 33").select("c_nationkey").first()[0]
    return search.search(r.provenance, r.members, r.records, r.labels, "email", f" C33@MAIL{nation}.example.com ")


@query("search_substring", people("SELECT min(entity_id) AS entity_id, 'substring' AS how FROM shown WHERE attribute = 'join_date' AND resolved_value LIKE '%-03-%'", PEOPLE_ENTRIES_SQL))
def search_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolution(spark, sf_dir)
    hidden = r.records.withColumn("raw", F.map_filter("raw", lambda k, v: k != "join_date"))
    return search.search(r.provenance, r.members, hidden, r.labels, "join_date", "-03-")


@query("search_digits", people("SELECT seq, source_id FROM rec WHERE phone = '9000000042'"))
def search_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolution(spark, sf_dir)
    return search.seeds(r.records, "phone", "90000-00042").select("seq", "source_id")


@query("replay_steps", people("""SELECT row_number() OVER (ORDER BY step_order) AS step_number, source_dataset, 'REC_' || lpad(CAST(seq AS VARCHAR), 8, '0') AS record_uuid, identifier_type, identifier_value, match_confidence, root, cluster_size FROM (
  SELECT 0 AS step_order, source_id AS source_dataset, rec.seq, NULL AS identifier_type, NULL AS identifier_value, NULL AS match_confidence, root, cluster_size FROM rec JOIN ent ON rec.seq = ent.seq WHERE rec.seq = (SELECT min(seq) FROM rec WHERE phone = '9000000042')
  UNION ALL SELECT e.step_order, CASE WHEN known THEN source_id_b ELSE source_id_a END, CASE WHEN known THEN seq_b ELSE seq_a END, identifier_type, identifier_value, match_confidence, root, cluster_size FROM (
    SELECT edge.*, root, cluster_size, source_id_a = (SELECT source_id FROM rec WHERE seq = (SELECT min(seq) FROM rec WHERE phone = '9000000042')) OR EXISTS (SELECT 1 FROM edge f JOIN ent g ON f.seq_a = g.seq WHERE g.root = ent.root AND f.step_order < edge.step_order AND edge.source_id_a IN (f.source_id_a, f.source_id_b)) AS known
    FROM edge JOIN ent ON edge.seq_a = ent.seq WHERE root = (SELECT root FROM ent WHERE seq = (SELECT min(seq) FROM rec WHERE phone = '9000000042'))) e)"""))
def replay_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolution(spark, sf_dir)
    return r.trace("phone", "9000000042").drop("action")


@query("entity_evidence", people("SELECT entity_id, identifier_type, identifier_value, max(match_confidence) AS match_confidence, count(*) AS links FROM edge JOIN ent ON seq_a = seq GROUP BY ALL"))
def entity_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolution(spark, sf_dir)
    return search.evidence(r.keys, r.members)


@query("search_fields", people("SELECT field, CAST(coalesce(nullif(list_position(['email', 'phone', 'aadhaar', 'username', 'uid', 'member_id', 'sku', 'barcode', 'name'], field), 0), 10) - 1 AS INT) AS place FROM (SELECT unnest(['email', 'phone', 'aadhaar', 'username', 'member_id', 'name', 'city', 'address', 'notes', 'k', 'cust_id', 'full_name', 'email_address', 'phone_no', 'street_address', 'national_id', 'segment', 'user_email', 'contact_no', 'member_code', 'join_date', 'last_active_date', 'n_events']) AS field)"))
def search_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolution(spark, sf_dir)
    return search.search_fields(r.records, r.provenance)


# --- similarity, pairs, models --------------------------------------------------------------------------------

_PAIRS_SQL = "SELECT a.p_partkey AS id, a.p_name || ' ' || a.p_type AS x, b.p_name || ' ' || b.p_type AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    a = p.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("x"))
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat_ws(" ", "p_name", "p_type").alias("y"))
    return a.join(b, "p_partkey").withColumnRenamed("p_partkey", "id")


def _similarity(name: str, f: Callable[[Column, Column], Column], sql: str | None) -> None:
    query(f"sim_{name}", sql and f"SELECT id, {sql} AS similarity FROM ({_PAIRS_SQL})")(lambda spark, sf_dir: _pairs(spark, sf_dir).select("id", f(F.col("x"), F.col("y")).alias("similarity")))


_similarity("levenshtein", sim.levenshtein_similarity, "1 - levenshtein(lower(x), lower(y)) / greatest(length(x), length(y))")
_similarity("token_jaccard", sim.token_jaccard, "len(list_intersect(list_distinct(regexp_extract_all(lower(x), '\\w+')), list_distinct(regexp_extract_all(lower(y), '\\w+')))) / len(list_distinct(regexp_extract_all(lower(x), '\\w+') || regexp_extract_all(lower(y), '\\w+')))")
_similarity("exact", sim.exact, "CASE WHEN lower(x) = lower(y) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")
_similarity("year_match", sim.year_match, "CASE WHEN substr(x, 1, 4) = substr(y, 1, 4) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")


def _soundex_sql(x: str) -> str:
    """The Soundex code of a text in SQL: letters to digits, H and W dropped, runs collapsed, vowels dropped."""
    coded = f"translate(regexp_replace(upper({x}), '[^A-Z]', '_', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ_', '012301270224550126230172020')"
    folded = f"{coded}[1] || replace({coded}[2:], '7', '')"
    for digit in "0123456":
        folded = f"regexp_replace({folded}, '{digit}+', '{digit}', 'g')"
    return f"CASE WHEN regexp_matches(upper({x}), '^[A-Z]') THEN upper({x})[1] || rpad(left(replace(({folded})[2:], '0', ''), 3), 3, '0') ELSE {x} END"


def _jaro_winkler_sql(pairs: str) -> str:
    """Tables over ``pairs(id, x, y)`` (stripped lower case), the last of which is ``jw(id, similarity)``: one step per character of x, which takes its first free match."""
    return f"""jw_pairs AS ({pairs}), jw_todo AS (SELECT id, x, y, length(x) AS n, length(y) AS m, greatest(length(x), length(y)) // 2 - 1 AS reach FROM jw_pairs WHERE x <> '' AND y <> '' AND x <> y),
jw_steps AS (
  SELECT id, x, y, n, m, reach, 0::BIGINT AS i, repeat('0', m::INT) AS used, '' AS mine FROM jw_todo
  UNION ALL SELECT id, x, y, n, m, reach, i + 1, CASE WHEN j IS NULL THEN used ELSE used[:j - 1] || '1' || used[j + 1:] END, CASE WHEN j IS NULL THEN mine ELSE mine || x[i + 1] END FROM (
    SELECT *, list_filter(range(greatest(1, i + 1 - reach), least(m, i + 1 + reach) + 1), lambda k: used[k] = '0' AND y[k] = x[i + 1])[1] AS j FROM jw_steps WHERE i < n)
), jw_ends AS (SELECT *, array_to_string(list_transform(list_filter(range(1, m + 1), lambda k: used[k] = '1'), lambda k: y[k]), '') AS theirs, len(mine) AS c FROM jw_steps WHERE i = n),
jw_jaro AS (SELECT id, x, y, CASE WHEN c = 0 THEN 0.0::DOUBLE ELSE (c / n + c / m + (c - len(list_filter(range(1, c + 1), lambda k: mine[k] <> theirs[k])) / 2) / c) / 3 END AS jaro,
  len(list_filter([1, 2, 3, 4], lambda k: k <= n AND k <= m AND x[:k] = y[:k])) AS prefix FROM jw_ends),
jw AS (SELECT id, jaro + prefix * 0.1::DOUBLE * (1 - jaro) AS similarity FROM jw_jaro UNION ALL SELECT id, CASE WHEN x <> '' AND x = y THEN 1.0 ELSE 0.0 END FROM jw_pairs WHERE x = '' OR y = '' OR x = y)"""


_similarity("soundex", sim.soundex_equal, f"CASE WHEN lower({_soundex_sql('x')}) = lower({_soundex_sql('y')}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")
_similarity("jaro_winkler", sim.jaro_winkler, None)
SQL["sim_jaro_winkler"] = f"WITH RECURSIVE {_jaro_winkler_sql(f'SELECT id, lower(x) AS x, lower(y) AS y FROM ({_PAIRS_SQL})')} SELECT id, similarity FROM jw"


def linkage_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as people records, and a second set with slips in some fields."""
    c = _read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    name = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("anna", "boris", "carla", "david", "erin", "farid", "greta")]), (k % 7 + 1).cast("int")), F.lit(""))
    base = dict(
        rec_id=F.concat(F.lit("a"), _str(k)), given_name=name, surname=F.concat(F.lit("smith"), _str(k % 97)), address_1=F.concat(_str(k % 50), F.lit(" high street")), street_number=_str(k % 50),
        suburb=F.lower("c_mktsegment"), postcode=F.lpad(_str(k % 1000), 4, "2"), state=_str("c_nationkey"), date_of_birth=F.concat(_str(F.lit(1950) + k % 50), F.lpad(_str(k % 12 + 1), 2, "0"), F.lit("15")), soc_sec_id=_str(k + 1000000),
    )
    other = base | dict(
        rec_id=F.concat(F.lit("b"), _str(k)), surname=F.when(k % 4 == 0, F.concat(F.lit("smyth"), _str(k % 97))).otherwise(base["surname"]), soc_sec_id=F.when(k % 3 == 0, "").otherwise(base["soc_sec_id"]),
        date_of_birth=F.when(k % 5 == 0, F.concat(_str(F.lit(1950) + k % 50), F.lit("0101"))).otherwise(base["date_of_birth"]),
    )
    return tuple(features.with_soundex(c.select(*[v.alias(n) for n, v in d.items()])) for d in (base, other))


_BLOCK_PASSES = (("soc_sec_id",), ("surname", "given_name", "postcode"), ("date_of_birth", "postcode", "suburb"))
_PEOPLE_RECORDS_SQL = """a AS (SELECT c_custkey AS k, ['anna', 'boris', 'carla', 'david', 'erin', 'farid', 'greta'][c_custkey % 7 + 1] AS gn, 'smith' || (c_custkey % 97) AS sn, lower(c_mktsegment) AS sub, lpad(CAST(c_custkey % 1000 AS VARCHAR), 4, '2') AS pc, (1950 + c_custkey % 50) || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') || '15' AS dob, CAST(c_custkey + 1000000 AS VARCHAR) AS ssn FROM customer),
b AS (SELECT k, gn, CASE WHEN k % 4 = 0 THEN 'smyth' || (k % 97) ELSE sn END AS sn, sub, pc, CASE WHEN k % 5 = 0 THEN (1950 + k % 50) || '0101' ELSE dob END AS dob, CASE WHEN k % 3 = 0 THEN '' ELSE ssn END AS ssn FROM a),
pairs AS (SELECT ak, bk, count(*) AS n FROM (SELECT a.k AS ak, b.k AS bk, 1 AS p FROM a JOIN b ON a.ssn = b.ssn AND b.ssn <> '' UNION ALL SELECT a.k, b.k, 2 FROM a JOIN b ON a.sn = b.sn AND a.gn = b.gn AND a.pc = b.pc UNION ALL SELECT a.k, b.k, 3 FROM a JOIN b ON a.dob = b.dob AND a.pc = b.pc AND a.sub = b.sub) GROUP BY ALL)"""


@query("blocking_pairs", f"WITH {_PEOPLE_RECORDS_SQL} SELECT 'a' || ak AS rec_id_a, 'b' || bk AS rec_id_b, CAST(n AS INT) AS num_passes_triggered FROM pairs")
def blocking_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.candidate_pairs(*linkage_records(spark, sf_dir), _BLOCK_PASSES)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = linkage_records(spark, sf_dir)
    pairs = features.candidate_pairs(a, b, _BLOCK_PASSES)
    return features.pair_features(pairs.withColumn("match_label", (F.substring("rec_id_a", 2, 20) == F.substring("rec_id_b", 2, 20)).cast("int")), a, b)


def _features_sql() -> str:
    """Tables after those of the people's records, the last of which is ``f``: the 24 features of each pair, its passes and label."""
    fields = {"given_name": "gn", "surname": "sn", "suburb": "sub"}
    sides = "gn || ' ' || sn AS full_name, (k % 50) || ' high street' AS adr, CAST(k % 50 AS VARCHAR) AS num"
    exact = lambda c: f"CASE WHEN a.{c} = b.{c} AND a.{c} <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    lev = lambda c: f"CASE WHEN a.{c} = '' OR b.{c} = '' THEN 0.0::DOUBLE ELSE round(1 - levenshtein(a.{c}, b.{c}) / greatest(length(a.{c}), length(b.{c})), 4) END"
    jw = lambda name: f"(SELECT round(similarity, 4) FROM jw WHERE jw.id = a.k || '/' || b.k || '/{name}')"
    compared = {"given_name": "gn", "surname": "sn", "suburb": "sub", "full_name": "full_name", "address_1": "adr"}
    todo = " UNION ALL ".join(f"SELECT ak || '/' || bk || '/{name}' AS id, a.{c} AS x, b.{c} AS y FROM pairs JOIN a2 a ON a.k = ak JOIN b2 b ON b.k = bk" for name, c in compared.items())
    words = [f"list_distinct(regexp_extract_all({x}.adr, '\\w+'))" for x in "ab"]
    made = {f"{n}_{kind}": sql for n, c in fields.items() for kind, sql in (("jw", jw(n)), ("lev", lev(c)), ("exact", exact(c)))} | {
        "given_name_soundex": f"CASE WHEN {_soundex_sql('a.gn')} = {_soundex_sql('b.gn')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", "surname_soundex": f"CASE WHEN {_soundex_sql('a.sn')} = {_soundex_sql('b.sn')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
        "full_name_jw": jw("full_name"), "address_1_jw": jw("address_1"), "address_1_lev": lev("adr"), "address_1_jaccard": f"round(len(list_intersect({words[0]}, {words[1]})) / len(list_distinct({words[0]} || {words[1]})), 4)",
        "street_number_exact": exact("num"), "postcode_exact": exact("pc"), "postcode_lev": lev("pc"), "state_exact": exact("st"), "dob_exact": exact("dob"), "dob_lev": lev("dob"), "dob_year_match": "CASE WHEN left(a.dob, 4) = left(b.dob, 4) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
        "ssn_exact": exact("ssn"), "ssn_lev": lev("ssn"),
    }
    more = ", ".join(f"{x}2 AS (SELECT {x}.*, {sides}, CAST(c_nationkey AS VARCHAR) AS st FROM {x} JOIN customer ON c_custkey = k)" for x in "ab")
    shown = ", ".join(f"{sql} AS {name}" for name, sql in made.items())
    return f"{_PEOPLE_RECORDS_SQL}, {more}, {_jaro_winkler_sql(todo)}, f AS (SELECT 'a' || ak AS rec_id_a, 'b' || bk AS rec_id_b, {shown}, CAST(n AS INT) AS num_passes_triggered, CASE WHEN ak = bk THEN 1 ELSE 0 END AS match_label FROM pairs JOIN a2 a ON a.k = ak JOIN b2 b ON b.k = bk)"


@query("pair_features", f"WITH RECURSIVE {_features_sql()} SELECT * FROM f")
def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir)


@query("class_balance", f"WITH {_PEOPLE_RECORDS_SQL} SELECT count(*) AS total_pairs, count(*) FILTER (ak = bk) AS matches, count(*) FILTER (ak <> bk) AS non_matches, round(count(*) FILTER (ak = bk) / count(*) * 100, 2) AS match_pct FROM pairs")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = linkage_records(spark, sf_dir)
    pairs = features.candidate_pairs(a, b, _BLOCK_PASSES)
    return features.class_balance(pairs.withColumn("match_label", (F.substring("rec_id_a", 2, 20) == F.substring("rec_id_b", 2, 20)).cast("int"))).drop("imbalance")


_STATS_SQL = """, l AS (SELECT match_label, unnest(map_entries(MAP {%s}), recursive := true) FROM f)
SELECT key AS feature, round(coalesce(avg(value) FILTER (match_label = 1), 0), 4) AS mean_match, round(coalesce(avg(value) FILTER (match_label = 0), 0), 4) AS mean_non_match, round(coalesce(avg(value) FILTER (match_label = 1), 0) - coalesce(avg(value) FILTER (match_label = 0), 0), 4) AS delta_mean,
  round(coalesce(stddev_samp(value) FILTER (match_label = 1), 0), 4) AS std_match, round(coalesce(stddev_samp(value) FILTER (match_label = 0), 0), 4) AS std_non_match FROM l GROUP BY key"""


@query("feature_stats", f"WITH RECURSIVE {_features_sql()}" + _STATS_SQL % ", ".join(f"'{c}': {c}::DOUBLE" for c in features.FEATURES))
def feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_statistics(_features(spark, sf_dir))


@query("classification_metrics", """WITH s AS (SELECT doc_id, quality AS y, (doc_id * 37 % 101) / 100.0::DOUBLE AS q FROM labels), p AS (SELECT *, CASE WHEN q >= 0.6 THEN 1 ELSE 0 END AS z FROM s),
c AS (SELECT count(*) FILTER (y = 1 AND z = 1) AS tp, count(*) FILTER (y = 0 AND z = 1) AS fp, count(*) FILTER (y = 0 AND z = 0) AS tn, count(*) FILTER (y = 1 AND z = 0) AS fn FROM p),
r AS (SELECT y, rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2 AS rk FROM p), u AS (SELECT (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM r)
SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 4) AS accuracy, round(tp / (tp + fp), 4) AS "precision", round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1, round(auc, 4) AS roc_auc FROM c, u""")
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = (F.col("doc_id") * 37 % 101) / 100.0
    scored = _read(spark, sf_dir, "labels").select(F.col("quality").alias("match_label"), q.alias("match_probability"), (q >= 0.6).cast("int").alias("predicted_match"))
    return linkage_models.classification_metrics(scored)


@query("evaluation_table", """SELECT 'no_ssn' AS regime, 'Random Forest' AS model, printf('%.2f%%', 100 * round(count(*) FILTER (y = 1 AND z = 1) / count(*) FILTER (z = 1), 4)) AS "precision", printf('%.2f%%', 100 * round(count(*) FILTER (y = 1 AND z = 1) / count(*) FILTER (y = 1), 4)) AS recall, count(*) FILTER (y = 1 AND z = 1) AS tp, count(*) FILTER (y = 0 AND z = 1) AS fp
FROM (SELECT quality AS y, CASE WHEN (doc_id * 37 % 101) / 100.0::DOUBLE >= 0.6 THEN 1 ELSE 0 END AS z FROM labels)""")
def evaluation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage_models.evaluation_table({("no_ssn", "rf"): classification_metrics(spark, sf_dir)}).select("regime", "model", "precision", "recall", "tp", "fp")


@query("prediction_summary", "SELECT count(*) AS total_pairs, count(*) FILTER (q >= 0.6) AS predicted_matches, count(*) FILTER (q < 0.6) AS predicted_non_matches, round(avg(q), 4) AS mean_probability FROM (SELECT (doc_id * 37 % 101) / 100.0::DOUBLE AS q FROM labels)")
def prediction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = (F.col("doc_id") * 37 % 101) / 100.0
    return linkage_models.prediction_summary(_read(spark, sf_dir, "labels").select(q.alias("match_probability"), (q >= 0.6).cast("int").alias("predicted_match")))


@query("error_analysis", "SELECT doc_id, CASE WHEN quality = 0 THEN 'FP' ELSE 'FN' END AS error FROM labels WHERE (quality = 0) = (doc_id % 3 = 0) AND quality IN (0, 1)")
def error_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("match_label"), (F.col("doc_id") % 3 == 0).cast("int").alias("predicted_match"))
    return linkage_models.errors(scored).select("doc_id", "error")


@query("prediction_scores")
def prediction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(_features(spark, sf_dir), "features")
    return linkage_models.score(linkage_models.train(rows, "no_ssn"), rows)


# --- others ---------------------------------------------------------------------------------------------------


@query("exact_duplicate_docs", "SELECT min(doc_id) AS first_doc_id, count(*) AS copies FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def exact_duplicate_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("copies")).where("copies > 1").drop("h")


@query("header_mapping", "SELECT * FROM (VALUES ('email_id', 'email', 1.0::DOUBLE), ('contact_no', 'phone', 1.0), ('full_name', 'name', 1.0), ('residence_address', 'address', 1.0), ('emp_code', 'member_id', 1.0), ('last_login', 'unmapped', 0.0), ('warehouse_bay', 'unmapped', 0.0), ('listing_sku', 'sku', 1.0), ('aisle_title', 'unmapped', 0.5)) t(raw_column, suggested_canonical, confidence)")
def header_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = HeaderMapper().propose(["email_id", "contact_no", "full_name", "residence_address", "emp_code", "last_login", "warehouse_bay", "listing_sku", "aisle_title"])
    return spark.createDataFrame([(p.raw_column, p.suggested_canonical, p.confidence) for p in found.values()], "raw_column string, suggested_canonical string, confidence double")


_NAMED = ", ".join(f"({k}, '{target}', '{name}')" for k, (target, names) in enumerate(HEADER_SYNONYMS.items()) for name in names)


@query("header_synonyms", f"SELECT name AS raw_column, coalesce(max(target) FILTER (target = name), arg_min(target, place)) AS suggested_canonical, 1.0::DOUBLE AS confidence FROM (VALUES {_NAMED}) t(place, target, name) GROUP BY name")
def header_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listed name by itself: a target's own name is that target, any other goes to the first target that lists it."""
    mapper = HeaderMapper()
    found = [mapper.propose_one(n) for n in sorted({n for names in HEADER_SYNONYMS.values() for n in names})]
    return spark.createDataFrame([(p.raw_column, p.suggested_canonical, p.confidence) for p in found], "raw_column string, suggested_canonical string, confidence double")


@query("header_collisions", "SELECT * FROM (VALUES ('e_mail', 'unmapped', true), ('email', 'email', true), ('cell', 'phone', true), ('phone_number', 'unmapped', true), ('lat', 'latitude', false), ('aisle', 'unmapped', false)) t(raw_column, target, is_ambiguous)")
def header_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several columns for a target one keeps it, and all of them are flagged."""
    found = HeaderMapper().propose(["e_mail", "email", "cell", "phone_number", "lat", "aisle"])
    return spark.createDataFrame([(p.raw_column, p.suggested_canonical, p.is_ambiguous) for p in found.values()], "raw_column string, target string, is_ambiguous boolean")


@query("mapping_checks", "SELECT * FROM (VALUES ('good', 0, true, 'email'), ('bad', 3, false, '')) t(mapping, n_errors, compatible, shared)")
def mapping_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of two mappings, and what each shares with a third."""
    given = {"good": {"a": "email", "b": "city"}, "bad": {"a": "city", "b": "city", "c": "unmapped"}}
    rows = []
    for name, mapping in given.items():
        alike, shared = compatibility({"x": mapping, "y": {"m": "email", "p": "phone"}})
        rows.append((name, len(validate(mapping, ("a", "b"))), alike, ",".join(shared)))
    return spark.createDataFrame(rows, "mapping string, n_errors int, compatible boolean, shared string")


@query("column_previews", """WITH v AS (SELECT * FROM (SELECT 'late' AS "column", c_name AS value, c_custkey AS k FROM customer WHERE c_custkey % 400 = 399 UNION ALL SELECT 'segment', c_mktsegment, c_custkey FROM customer) QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY k) <= 3)
SELECT c.name AS "column", coalesce((SELECT string_agg(value, ',' ORDER BY k) FROM v WHERE "column" = c.name), '') AS "values" FROM (SELECT unnest(['late', 'segment', 'none']) AS name) c""")
def column_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three filled values of each column, however late in the table."""
    k = F.col("c_custkey")
    df = _read(spark, sf_dir, "customer").coalesce(1).sortWithinPartitions(k).select(F.when(k % 400 == 399, F.col("c_name")).otherwise("n/a").alias("late"), F.col("c_mktsegment").alias("segment"), F.lit(" ").alias("none"))
    return spark.createDataFrame([(c, ",".join(v)) for c, v in previews(df).items()], "column string, values string")


@query("job_recovery", "SELECT CAST(o_orderkey AS VARCHAR) AS job_id, CASE WHEN o_orderkey % 3 = 0 THEN 'PAUSED_RECOVERABLE' ELSE 'FAILED_INTERRUPTED' END AS status FROM orders WHERE o_orderstatus IN ('O', 'P')")
def job_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", jobs.RUNNING).when(F.col("o_orderstatus") == "P", jobs.QUEUED).otherwise(jobs.COMPLETED)
    log = o.select(
        _str("o_orderkey").alias("job_id"), F.lit("src").alias("source_id"), F.lit("resolve").alias("job_type"), status.alias("status"), F.lit(0).cast("long").alias("total_records"),
        F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0).cast("long").alias("last_checkpoint_chunk"), F.lit(None).cast("string").alias("error_message"), F.col("o_orderdate").alias("at"), F.lit(1).cast("long").alias("version"),
    )
    return jobs.recovered(log).select("job_id", "status")


@query("parameter_filter", "SELECT c_custkey, c_name FROM customer WHERE lower(c_mktsegment) = lower('Building') AND lower(c_name) LIKE lower('%0001%') ORDER BY c_custkey")
def parameter_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    return spark.sql("SELECT c_custkey, c_name FROM {c} WHERE lower(c_mktsegment) = lower(:seg) AND lower(c_name) LIKE lower(:part) ORDER BY c_custkey", args={"seg": "Building", "part": "%0001%"}, c=c)


@query("windowed_activity", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS sum_value FROM events GROUP BY ALL")
def windowed_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.streaming.ingest import windowed_activity as aggregate

    return aggregate(_read(spark, sf_dir, "events")).withColumn("sum_value", F.round("sum_value", 4))


@query("incremental_clusters", people("SELECT seq, root FROM lab"))
def incremental_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, *later = people_sources(spark, sf_dir)
    return extend(resolve([first]), later).labels.select("seq", "root")


@query("search_by_id", people("SELECT DISTINCT entity_id, 'id' AS how FROM ent WHERE entity_id = 'ENT_00007'"))
def search_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolution(spark, sf_dir)
    return search.search(r.provenance, r.members, r.records, r.labels, "entity_id", "ENT_00007")


@query("entity_rows", people("SELECT ent.seq, source_id FROM ent JOIN rec ON ent.seq = rec.seq WHERE entity_id = 'ENT_00007'"))
def entity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolution(spark, sf_dir)
    return search.entity_records(r.records, r.members, "ENT_00007").select("seq", "source_id")


@query("valid_only_keys", people("SELECT seq, identifier_type, identifier_value FROM keys WHERE identifier_type NOT IN ('email', 'phone') OR (identifier_type = 'phone' AND length(identifier_value) BETWEEN 7 AND 15) OR regexp_matches(identifier_value, '^[a-z0-9_.-]+@[a-z0-9_.-]+\\.[a-z0-9_]+$')"))
def valid_only_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolve(people_sources(spark, sf_dir), require_valid=True)
    return r.keys.select("seq", "identifier_type", "identifier_value")


@query("keyed_upsert", "SELECT 'c' || c_custkey AS source_id, CASE WHEN c_custkey % 5 = 0 THEN 'UPDATED' ELSE c_mktsegment END AS source_name FROM customer UNION ALL SELECT 's' || s_suppkey, max(n) FROM (SELECT s_suppkey, s_name AS n FROM supplier UNION ALL SELECT s_suppkey, 'Z' || s_name FROM supplier WHERE s_suppkey % 2 = 0) GROUP BY ALL")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository's table after an upsert: rows of a key replaced, others kept, new ones added, of repeated new keys the last."""
    import uuid

    from kinfold.sources.repository import Repository

    repo = Repository(spark, f"{shared_dir(spark)}/repository-{uuid.uuid4().hex}")
    old = _read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), _str("c_custkey")).alias("source_id"), F.col("c_mktsegment").alias("source_name"), "c_custkey")
    named = _read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), _str("s_suppkey")).alias("source_id"), F.col("s_name").alias("source_name"), "s_suppkey")
    again = named.where("s_suppkey % 2 = 0").withColumn("source_name", F.concat(F.lit("Z"), "source_name"))
    changed = old.where("c_custkey % 5 = 0").withColumn("source_name", F.lit("UPDATED"))
    repo.append("data_sources", old)
    repo.upsert("data_sources", changed.drop("c_custkey").unionByName(named.unionByName(again).drop("s_suppkey")), "source_id")
    return repo.read("data_sources").select("source_id", "source_name")


@query("csv_round_trip", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type FROM part")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV into the shared folder and read back as text."""
    import uuid

    from kinfold.sources.files import read_csv

    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type").write.option("header", True).csv(path)
    return read_csv(spark, path)


@query("token_sets", "SELECT p_partkey, list_sort(list_intersect(a, b)) AS shared, len(list_distinct(a || b)) AS n_all, len(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))) AS n_only FROM (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '\\w+')) AS a, list_distinct(regexp_extract_all(lower(p_type), '\\w+')) AS b FROM part)")
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (sim.tokens(F.col(c)) for c in ("p_name", "p_type"))
    return _read(spark, sf_dir, "part").select("p_partkey", F.array_sort(F.array_intersect(a, b)).alias("shared"), F.size(F.array_union(a, b)).alias("n_all"), F.size(F.array_except(a, b)).alias("n_only"))


@query("session_activity", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(ts) AS session_start, count(*) AS n_events FROM g GROUP BY user_id, s")
def session_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.streaming.ingest import sessions

    return sessions(_read(spark, sf_dir, "events")).select("user_id", "session_start", "n_events")


@query("feature_stats_builtin", f"""WITH {_PEOPLE_RECORDS_SQL}, f AS (
  SELECT CASE WHEN ak = bk THEN 1 ELSE 0 END AS y, round(1 - levenshtein(a.sn, b.sn) / greatest(length(a.sn), length(b.sn)), 4) AS surname_lev, CASE WHEN a.ssn = b.ssn AND a.ssn <> '' THEN 1.0 ELSE 0.0 END AS ssn_exact, CASE WHEN a.dob = b.dob THEN 1.0 ELSE 0.0 END AS dob_exact, n::DOUBLE AS num_passes_triggered
  FROM pairs JOIN a ON a.k = ak JOIN b ON b.k = bk
), l AS (SELECT y, 'surname_lev' AS feature, surname_lev::DOUBLE AS v FROM f UNION ALL SELECT y, 'ssn_exact', ssn_exact FROM f UNION ALL SELECT y, 'dob_exact', dob_exact FROM f UNION ALL SELECT y, 'num_passes_triggered', num_passes_triggered FROM f)
SELECT feature, round(avg(v) FILTER (y = 1), 4) AS mean_match, round(coalesce(avg(v) FILTER (y = 0), 0), 4) AS mean_non_match, round(coalesce(stddev_samp(v) FILTER (y = 1), 0), 4) AS std_match FROM l GROUP BY feature""")
def feature_stats_builtin(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _features(spark, sf_dir).select("rec_id_a", "rec_id_b", "match_label", "surname_lev", "ssn_exact", "dob_exact", "num_passes_triggered")
    return features.feature_statistics(made).select("feature", "mean_match", "mean_non_match", "std_match")
