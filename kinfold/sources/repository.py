"""A repository of tables as Parquet folders: append, overwrite, keyed upsert, views, reset.

A table is a folder of numbered versions. A version counts from the moment at which its last file, the writer's
success mark, is there; so a writer that stops half-way leaves the table as it was, and readers never see a part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.resolve import Resolution

# The tables and their columns.
SCHEMAS = {
    "data_sources": "source_id string, source_name string, file_format string, is_multipart boolean, total_parts int, total_raw_records long, created_at timestamp",
    "dataset_parts": "part_id string, source_id string, part_number int, file_path string, record_count long, status string",
    "canonical_records": "seq long, record_uuid string, source_id string, part_id string, source_record_id string, raw map<string,string>, kinds map<string,string>, norm map<string,string>, columns map<string,string>",
    "identifier_index": "index_id string, identifier_type string, identifier_value string, record_uuid string, source_id string",
    "enrichment_edges": "edge_id string, record_uuid_a string, record_uuid_b string, source_id_a string, source_id_b string, identifier_type string, identifier_value string, match_confidence double, step_order long, seq_a long, seq_b long",
    "master_entities": "entity_id string, cluster_size long, golden_name string, golden_email string, golden_phone string, golden_username string, golden_member_id string, golden_address string, golden_company string, attributes map<string,string>, entity_quality_score double",
    "entity_members": "entity_id string, seq long, record_uuid string, source_id string, cluster_size long",
    "field_provenance": "provenance_id string, entity_id string, canonical_field string, resolved_value string, source_id string, record_uuid string, source_column string, raw_value string, normalized_value string, resolution_rule string, conflict_details string",
    "cluster_labels": "seq long, root long",
    "job_runs": "job_id string, source_id string, job_type string, status string, total_records long, last_checkpoint_chunk long, error_message string, at timestamp, version long",
}


class Repository:
    """Tables under one folder of a store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _fs(self, name: str):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self._at(name))
        return path, path.getFileSystem(conf)

    def _versions(self, name: str) -> list[int]:
        """The complete versions of a table, oldest first."""
        path, fs = self._fs(name)
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path)]
        child = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName()[1:]) for p in found if p.getName()[1:].isdigit() and fs.exists(child(p, "_SUCCESS")))

    def version(self, name: str) -> int:
        """The number of the version that :meth:`read` reads, 0 if nothing was written."""
        return max(self._versions(name), default=0)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table, its newest version by default; empty with its schema if nothing was written."""
        at = self.version(name) if version is None else version
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self._at(name)}/v{at}") if at in self._versions(name) else self.spark.createDataFrame([], SCHEMAS[name])

    def _shaped(self, name: str, df: DataFrame) -> DataFrame:
        wanted = self.spark.createDataFrame([], SCHEMAS[name]).schema
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows to the newest version, or make the first."""
        self._shaped(name, df).write.mode("append").parquet(f"{self._at(name)}/v{self.version(name) or 1}")

    def overwrite(self, name: str, df: DataFrame, version: int | None = None) -> None:
        """Replace a table, which the new one may read: the next version is written beside the old one, which stays readable until the one after it.

        With a ``version`` of the caller's own, writing it again replaces it alone.
        """
        kept = [v for v in self._versions(name) if version is None or v < version]
        at = (max(kept, default=0) + 1) if version is None else version
        self._shaped(name, df).write.mode("overwrite").parquet(f"{self._at(name)}/v{at}")
        for old in kept[:-1]:
            path, fs = self._fs(f"{name}/v{old}")
            fs.delete(path, True)

    def upsert(self, name: str, df: DataFrame, key: str) -> None:
        """Rows of ``df`` in place of those of the same key; of several rows of a key in ``df`` the last in order of its other columns counts."""
        new = self._shaped(name, df)
        others = [c for c, kind in new.dtypes if c != key and not kind.startswith("map")]
        maps = [c for c, kind in new.dtypes if kind.startswith("map")]
        order = F.struct(*others, *[F.array_sort(F.map_entries(c)).alias(c) for c in maps])
        new = new.groupBy(key).agg(F.max_by(F.struct(*[c for c in new.columns if c != key]), order).alias("row")).select(key, "row.*").select(*new.columns)
        self.overwrite(name, self.read(name).join(new.select(key), key, "left_anti").unionByName(new))

    def views(self, prefix: str = "") -> None:
        """All tables as temporary views, for SQL."""
        for name in SCHEMAS:
            self.read(name).createOrReplaceTempView(prefix + name)

    def sql(self, text: str, args: dict | list | None = None) -> DataFrame:
        """A statement over the views with bound parameters; errors are raised."""
        return self.spark.sql(text, args=args)

    def reset(self) -> None:
        """Delete all tables."""
        for name in SCHEMAS:
            path, fs = self._fs(name)
            fs.delete(path, True)

    def save(self, r: Resolution, edges: bool = True) -> None:
        """Write all tables of a resolution in place of what is there.

        The edge log holds all pairs of a value, so it grows with the square of a value's records; nothing but a
        reader of the log itself needs it, and it can be left out.
        """
        counts = r.records.groupBy("source_id").agg(F.count("*").alias("total_raw_records"), F.count_distinct("part_id").cast("int").alias("total_parts"))
        self.overwrite("data_sources", r.sources.join(counts, "source_id").withColumns({"is_multipart": F.col("total_parts") > 1, "created_at": F.current_timestamp(), "file_format": F.lit("table")}))
        parts = r.records.groupBy("part_id", "source_id").agg(F.count("*").alias("record_count"))
        self.overwrite("dataset_parts", parts.withColumns({"status": F.lit("INGESTED"), "part_number": F.regexp_extract("part_id", r"_(\d+)$", 1).cast("int")}))
        for name, df in (("canonical_records", r.records), ("identifier_index", r.identifier_index), *([("enrichment_edges", r.edges)] if edges else []), ("entity_members", r.members), ("field_provenance", r.provenance), ("master_entities", r.master)):
            self.overwrite(name, df)

    def load(self) -> Resolution:
        """The stored records and sources as a resolution; its clusters are those of the stored records' keys."""
        return Resolution(self.read("canonical_records"), self.read("data_sources").select("source_id", "source_name"))

    def keep(self, r: Resolution, version: int) -> None:
        """Records, sources and clusters as they are after step ``version``; repeating a step replaces what it left."""
        for name, df in (("data_sources", r.sources), ("cluster_labels", r.labels), ("canonical_records", r.records)):
            self.overwrite(name, df, version)

    def kept(self, before: int) -> Resolution | None:
        """The newest of the kept states older than step ``before``; None if there is none."""
        found = [v for v in self._versions("canonical_records") if v < before]
        if not found:
            return None
        records, sources, labels = (self.read(name, found[-1]) for name in ("canonical_records", "data_sources", "cluster_labels"))
        return Resolution(records, sources.select("source_id", "source_name"), known_labels=labels)
