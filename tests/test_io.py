import time

import pytest
from pyspark.sql import functions as F

from kinfold.__main__ import main
from kinfold.operators import jobs
from kinfold.operators.components import clusters, connected_components
from kinfold.operators.numbering import numbered, tagged
from kinfold.operators.records import Source
from kinfold.sources import files, sql_dump
from kinfold.sources.demo import demo_tables, write_demo
from kinfold.sources.repository import Repository
from kinfold.sources.sql_dump import read_sql_dump
from kinfold.streaming import ingest


def test_sql_dump(spark, tmp_path, monkeypatch):
    path = tmp_path / "d.sql"
    path.write_text("CREATE TABLE m (id INTEGER PRIMARY KEY, mail VARCHAR, score REAL); INSERT INTO m VALUES (1, 'a@b.c', 1.5), (2, NULL, NULL); CREATE TABLE empty (x TEXT);")
    for limit in (10**7, 1):
        got = read_sql_dump(spark, str(path), limit)
        assert sorted(map(tuple, got["m"].collect())) == [(1, "a@b.c", 1.5), (2, None, None)] and got["empty"].count() == 0
    path.write_text("""CREATE TABLE t (a INTEGER, b INTEGER, c TEXT, d BLOB, "e f" REAL);
INSERT INTO t VALUES (1, 3.7, 'x; y', x'4142', 2);
INSERT INTO t VALUES (9007199254740993, 2, 5, NULL, 1.5), (NULL, NULL, NULL, NULL, NULL); CREATE TABLE u (n INTEGER); INSERT INTO u VALUES ('three'), (4);
""")
    for limit, chunk in ((10**7, 50_000), (1, 1)):
        monkeypatch.setattr(sql_dump, "CHUNK", chunk)
        got = read_sql_dump(spark, str(path), limit)
        assert sorted(map(tuple, got["t"].collect()), key=str) == sorted([(1, 3.7, "x; y", "AB", 2.0), (9007199254740993, 2.0, "5", None, 1.5), (None,) * 5], key=str)
        assert {r.n for r in got["u"].collect()} == {"three", "4"}
    with pytest.raises(FileNotFoundError):
        read_sql_dump(spark, str(tmp_path / "none.sql"))
    assert files.table_name("d.sql", "m") == "d.sql (m)"


def test_csv(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"p{k}.csv").write_text(f'phone,note\n0{k}234567890,"a\nb"\n,x\n')
    paths = [f"file://{tmp_path}/p{k}.csv" for k in (1, 2)]
    assert {r.phone for r in files.read_csv_filled(spark, paths).collect()} == {"01234567890", "02234567890", ""}
    assert files.read_parts(spark, paths).select("_file").distinct().count() == 2
    wide = spark.createDataFrame([("E1", 2, "A", "x")], "entity_id string, cluster_size long, sources string, name string")
    files.write_export(wide, f"file://{tmp_path}/out")
    assert files.read_csv(spark, f"file://{tmp_path}/out").columns == ["entity_id", "name"]


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 60)] + [(100, 99), (99, 98), (200, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[k] == 1 for k in range(1, 61)) and got[100] == got[98] == 98 and got[200] == 200 and len(got) == 64
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    lone = clusters(spark.createDataFrame([(7,)], "node long"), spark.createDataFrame([], "a long, b long")).first()
    assert tuple(lone) == (7, 7)


def test_numbers_follow_the_order(spark):
    df = numbered(spark.range(1000).repartition(7).selectExpr("id", "-id as k"), ["k"])
    assert all(r.seq == 1000 - r.id for r in df.collect())
    assert tuple(spark.range(1).select(tagged("X", 3, F.lit(12345)), tagged("X", 3, F.lit(7))).first()) == ("X_12345", "X_007")


def test_jobs(spark, tmp_path):
    log = jobs.JobLog(spark, f"file://{tmp_path}/jobs")
    log.create("j1", "s", "resolve")
    assert log.start("j2", lambda: time.sleep(1)) and not log.start("j2", lambda: None)

    def fail():
        raise RuntimeError("broken")

    log.start("j3", fail)
    for j in ("j2", "j3"):
        log.wait(j, 60)
    log.recover()
    # A second application goes on where the first one stopped.
    again = jobs.JobLog(spark, f"file://{tmp_path}/jobs")
    again.create("j2", "s", "resolve")
    assert {r.job_id: r.status for r in jobs.latest(again.read()).collect()}["j2"] == jobs.QUEUED
    again.start("j2", lambda: None)
    again.wait("j2", 60)
    assert jobs.JobLog(spark, f"file://{tmp_path}/none").recover().count() == 0
    got = {r.job_id: (r.status, r.error_message) for r in jobs.latest(log.read()).collect()}
    assert got["j1"][0] == jobs.INTERRUPTED and got["j2"][0] == jobs.COMPLETED and got["j3"] == (jobs.FAILED, "broken")


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/even*.parquet")
    q = ingest.windowed_activity(stream).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").selectExpr("sum(n_events)").first()[0] == events.count()
    published = {}
    users = stream.select("user_id", "event_type")
    q = ingest.resolve_stream(users, lambda df, n: Source(f"s{n}", df.distinct(), {"user_id": "uid"}, order=("user_id", "event_type")), lambda r, n: published.update({n: r.statistics.first()}), f"file://{tmp_path}/cp", Repository(spark, f"file://{tmp_path}/state"))
    q.processAllAvailable()
    q.stop()
    assert published[max(published)].total_entities == events.select("user_id").distinct().count()


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    """Three batches by three queries on one checkpoint, the last of them delivered twice."""
    into, store = tmp_path / "in", Repository(spark, f"file://{tmp_path}/state")
    into.mkdir()
    seen = []

    def once():
        stream = spark.readStream.schema("uid string, mail string").json(f"file://{into}")
        q = ingest.resolve_stream(stream, lambda df, n: Source(f"s{n}", df, {"uid": "uid", "mail": "email"}, order=("uid",)), lambda r, n: seen.append((n, r.records.count(), r.statistics.first().total_entities)), f"file://{tmp_path}/cp", store)
        q.processAllAvailable()
        q.stop()

    for k, rows in enumerate((["A1 a@x.y", "B1 b@x.y"], ["C1 a@x.y"], ["D1 b@x.y", "E1 e@x.y"])):
        (into / f"{k}.json").write_text("\n".join(f'{{"uid": "{r.split()[0]}", "mail": "{r.split()[1]}"}}' for r in rows))
        once()
    assert seen == [(0, 2, 2), (1, 3, 2), (2, 5, 3)]
    (tmp_path / "cp" / "commits" / "2").unlink()
    for crc in (tmp_path / "cp" / "commits").glob(".2.crc"):
        crc.unlink()
    once()
    assert seen[-1] == (2, 5, 3)


def test_a_table_is_replaced_whole_or_not_at_all(spark, tmp_path):
    repo = Repository(spark, f"file://{tmp_path}/repo")
    rows = lambda *ids: spark.createDataFrame([(i, f"name {i}") for i in ids], "source_id string, source_name string")
    names = lambda: {r.source_id for r in repo.read("data_sources").collect()}
    repo.append("data_sources", rows("a"))
    repo.append("data_sources", rows("b"))
    held = repo.read("data_sources")
    repo.overwrite("data_sources", repo.read("data_sources").where("source_id <> 'a'"))
    assert names() == {"b"} and held.count() == 2
    # A writer that stopped before its success mark.
    rows("z").write.parquet(f"file://{tmp_path}/repo/data_sources/v3")
    (tmp_path / "repo" / "data_sources" / "v3" / "_SUCCESS").unlink()
    assert names() == {"b"}
    repo.overwrite("data_sources", rows("c"))
    assert names() == {"c"}
    repo.upsert("data_sources", spark.createDataFrame([("c", "x"), ("c", "y"), ("d", "z")], "source_id string, source_name string"), "source_id")
    assert {(r.source_id, r.source_name) for r in repo.read("data_sources").collect()} == {("c", "y"), ("d", "z")}


def test_demo(spark, tmp_path):
    got = main(write_demo(str(tmp_path)))
    assert (got["total_records"], got["total_entities"], got["linked_entities"]) == (6, 4, 2)
    assert {n: df.count() for n, df in demo_tables(spark, str(tmp_path)).items()} == {"people_a.csv": 3, "people_b.csv": 3}


def test_command_line(spark, tmp_path):
    (tmp_path / "a.csv").write_text("full_name,email_id\nAnn,a@b.c\nBob,\n")
    (tmp_path / "b.sql").write_text("CREATE TABLE t (contact_id INTEGER, email_address TEXT, city TEXT); INSERT INTO t VALUES (1, 'A@B.C ', 'Rome');")
    stats = main([str(tmp_path / "a.csv"), str(tmp_path / "b.sql"), "--export", f"file://{tmp_path}/out", "--store", f"file://{tmp_path}/repo"])
    assert (stats["total_records"], stats["total_entities"], stats["linked_entities"], stats["total_sources"]) == (3, 2, 1, 2)
    assert files.read_csv(spark, f"file://{tmp_path}/out").count() == 2
