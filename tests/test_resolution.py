import random

import pytest

from kinfold.operators import search
from kinfold.operators.records import Source
from kinfold.operators.resolve import extend, resolve
from kinfold.plans.mapping import HeaderMapper
from kinfold.sources.repository import Repository

A = [("Amit", "Kumar", "amit@x.com", "+91 98765-43210", "4521 6789 1234", "Delhi", "12 MG Road"), ("Riya", "Shah", "riya@x.com", "+91 91234 56789", "1111 2222 3333", "Pune", "5 Hill St"), ("Solo", "One", "solo@x.com", "+91 90000 00001", "", "Goa", "")]
B = [("Amit Kumar", "AMIT@x.com ", "9876543210", "452167891234", "New Delhi", "12 MG Road"), ("Riya Shah", "riya@x.com", "09123456789", "111122223333", "Pune", "5 hill st"), ("Other", "other@x.com", "8888888888", "", "Goa", "x")]


def mapped(df):
    return {c: p.suggested_canonical for c, p in HeaderMapper().propose(df.columns).items()}


def sources(spark, a=A, b=B):
    da = spark.createDataFrame(a, "first_name string, last_name string, email string, phone_number string, aadhaar string, city string, address string")
    db = spark.createDataFrame(b, "full_name string, email_id string, mobile_number string, aadhar_number string, city_name string, residential_address string")
    return [Source("src_a", da, mapped(da), "A", order=("email",)), Source("src_b", db, mapped(db), "B", order=("email_id",))]


@pytest.fixture(scope="module")
def demo(spark):
    return resolve(sources(spark))


def test_demo_counts(demo):
    stats = demo.statistics.first()
    assert (stats.total_records, stats.total_entities, stats.linked_entities, stats.single_entities, stats.total_edges, stats.average_cluster_size) == (6, 4, 2, 2, 6, 1.5)


def test_members_are_records(demo):
    assert demo.members.select("record_uuid").distinct().count() == demo.records.count() == 6
    assert demo.edges.join(demo.labels.withColumnsRenamed({"seq": "seq_a", "root": "ra"}), "seq_a").join(demo.labels.withColumnsRenamed({"seq": "seq_b", "root": "rb"}), "seq_b").where("ra <> rb").count() == 0


def test_golden_values(demo):
    rows = {r.golden_email: r for r in demo.master.collect()}
    assert rows["amit@x.com"].golden_phone == "9876543210" and rows["amit@x.com"].golden_name == "Amit Kumar"
    rules = {(r.entity_id, r.canonical_field): r.resolution_rule for r in demo.provenance.collect()}
    assert rules["ENT_00001", "email"] == "UNANIMOUS_CONSENSUS" and rules["ENT_00003", "email"] == "SINGLE_NON_NULL"


def test_wide_master(demo):
    wide = demo.wide()
    assert wide.columns[:3] == ["entity_id", "cluster_size", "sources"] and "first_name" not in wide.columns
    assert wide.first().sources == "A, B" and wide.first().cluster_size == 2


def test_replay_and_search(demo):
    whole = search.trace(demo.records, demo.labels, demo.edges, "email", "AMIT@x.com").orderBy("step_number").collect()
    steps = demo.trace("email", "AMIT@x.com").orderBy("step_number").collect()
    assert steps == whole
    assert [s.identifier_type for s in steps] == [None, "email", "phone", "aadhaar"] and steps[0].cluster_size == 2 and steps[1].source_dataset == "src_b"
    assert search.search(demo.provenance, demo.members, demo.records, demo.labels, "phone", "98765 43210").first().entity_id == "ENT_00001"
    assert search.search(demo.provenance, demo.members, demo.records, demo.labels, "email", " - ").count() == 0
    assert demo.trace("email", "nobody@x.com").count() == 0


def partition_of(r):
    groups = {}
    for x in r.labels.join(r.records.selectExpr("seq", "norm['email'] as e"), "seq").collect():
        groups.setdefault(x.root, set()).add(x.e)
    return sorted(map(sorted, groups.values()))


def test_partition_does_not_depend_on_order(spark, demo):
    rows = A[:]
    random.Random(3).shuffle(rows)
    assert partition_of(resolve(sources(spark, rows)[::-1])) == partition_of(demo)


def test_later_sources_match_stored_records(spark, demo):
    a, b = sources(spark)
    assert partition_of(extend(resolve([a]), [b])) == partition_of(demo)


def test_clusters_grow_as_they_would_be_found(spark):
    """Random records that share values, resolved at once and in steps."""
    rng = random.Random(5)
    rows = [(f"u{rng.randrange(60)}" if rng.random() < 0.5 else None, f"m{rng.randrange(60)}@x.y" if rng.random() < 0.6 else None, k) for k in range(80)]
    source = lambda n, part: Source(f"s{n}", spark.createDataFrame(part, "uid string, mail string, k int"), {"uid": "uid", "mail": "email"}, order=("k",))
    parts = [rows[:30], rows[30:31], rows[31:]]
    now = None
    for n, part in enumerate(parts):
        now = resolve([source(n, part)]) if now is None else extend(now, [source(n, part)])
    at_once = resolve([source(n, part) for n, part in enumerate(parts)])
    assert sorted(map(tuple, now.labels.select("seq", "root").collect())) == sorted(map(tuple, at_once.labels.select("seq", "root").collect()))
    assert sorted(map(tuple, now.members.collect())) == sorted(map(tuple, at_once.members.collect()))


def test_blanks_never_link(spark):
    df = spark.createDataFrame([(None, "", "a"), ("  ", "n/a", "b"), ("x@y.z", "-", "c")], "email string, phone string, name string")
    r = resolve([Source("s", df, {"email": "email", "phone": "phone", "name": "name"}, order=("name",))])
    assert r.edges.count() == 0 and r.members.select("entity_id").distinct().count() == 3 and r.keys.count() == 1


def test_falsy_values_survive(spark):
    df = spark.createDataFrame([("a@b.c", 0.0, False, 0)], "email string, balance double, premium boolean, stock_left int")
    r = resolve([Source("s", df, {"email": "email"})])
    got = {x.attribute: x.resolved_value for x in r.survivors.collect()}
    assert got == {"email": "a@b.c", "balance": "0.0", "premium": "False", "stock_left": "0"}


def test_composite_key_links_strong_addresses_only(spark):
    df = spark.createDataFrame([("Ann Lee", "12 Very Long Street Name"), ("ann lee", "12 very long  street name"), ("Bo", "1 St"), ("Bo", "1 St")], "name string, address string")
    r = resolve([Source("s", df, {"name": "name", "address": "address"}, order=("name", "address"))])
    assert r.edges.count() == 1 and r.edges.first().identifier_type == "name_address_fuzzy" and r.identifier_index.count() == 0


def test_no_identifiers_means_singletons(spark):
    df = spark.createDataFrame([("Cafe", 4.5, "food"), ("Cafe", 4.5, "food")], "business_name string, rating double, category string")
    r = resolve([Source("s", df, mapped(df))])
    assert r.statistics.first().single_entities == 2 and r.edges.count() == 0


def test_two_columns_for_one_target_are_refused(spark):
    df = spark.createDataFrame([("a", "b")], "x string, y string")
    with pytest.raises(ValueError):
        resolve([Source("s", df, {"x": "email", "y": "email"})])


def test_repository_round_trip(spark, demo, tmp_path):
    repo = Repository(spark, f"file://{tmp_path}/repo")
    repo.save(demo)
    assert repo.read("master_entities").count() == 4 and repo.read("enrichment_edges").count() == 6 and repo.read("dataset_parts").count() == 2
    assert partition_of(repo.load()) == partition_of(demo)
    repo.upsert("data_sources", spark.createDataFrame([("src_a", "renamed")], "source_id string, source_name string"), "source_id")
    assert {r.source_name for r in repo.read("data_sources").collect()} == {"renamed", "B"}
    repo.views("t_")
    assert repo.sql("SELECT count(*) FROM t_entity_members WHERE source_id = :s", {"s": "src_a"}).first()[0] == 3
    repo.reset()
    assert repo.read("master_entities").count() == 0


def test_rows_follow_typed_order(spark):
    rows = [(-5, 1.5, "b"), (10, -2.0, "a"), (9, 0.0, "c"), (-50, 3.0, "d"), (9007199254740993, 1.0, "e"), (9007199254740992, 1.0, "f"), (None, 1.0, "g")]
    df = spark.createDataFrame(rows, "n long, x double, tag string")
    for order, want in ((("n",), "gdbcafe"), (("x",), None), (("tag",), "abcdefg")):
        r = resolve([Source("s", df, {}, order=(*order, "tag"))])
        got = "".join(x.t for x in r.records.orderBy("seq").selectExpr("raw['tag'] as t").collect())
        assert got == want if want else got[0] == "a" and got[-1] == "d"
