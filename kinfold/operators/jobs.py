"""A log of job states: rows are only ever appended, a job's last row is its state."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUEUED, RUNNING, PAUSED, COMPLETED, FAILED, INTERRUPTED = "QUEUED", "RUNNING", "PAUSED_RECOVERABLE", "COMPLETED", "FAILED", "FAILED_INTERRUPTED"
SCHEMA = "job_id string, source_id string, job_type string, status string, total_records long, last_checkpoint_chunk long, error_message string, at timestamp, version long"


def latest(log: DataFrame) -> DataFrame:
    """The last row of each job."""
    last = log.groupBy("job_id").agg(F.max_by(F.struct(*log.columns), "version").alias("r"))
    return last.select("r.*")


def recovered(log: DataFrame) -> DataFrame:
    """The rows to append after a restart: jobs under way become recoverable if they have a checkpoint, else interrupted."""
    kept = F.col("last_checkpoint_chunk") > 0
    message = F.when(kept, "restarted in flight; its checkpoint is kept").otherwise("restarted before its first checkpoint")
    return latest(log).where(F.col("status").isin(RUNNING, QUEUED)).withColumns({"status": F.when(kept, PAUSED).otherwise(INTERRUPTED), "error_message": message, "version": F.col("version") + 1, "at": F.current_timestamp()})


class JobLog:
    """Jobs of one application, logged as Parquet under ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._threads: dict[str, threading.Thread] = {}
        self._lock = threading.RLock()
        # Rows of this log follow those that an earlier application left.
        self._version = self.read().agg(F.max("version")).first()[0] or 0

    def read(self) -> DataFrame:
        """All rows; none if nothing was logged yet."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return self.spark.read.schema(SCHEMA).parquet(self.path) if path.getFileSystem(conf).exists(path) else self.spark.createDataFrame([], SCHEMA)

    def _append(self, **row) -> None:
        with self._lock:
            self._version += 1
            fields = [f.split()[0] for f in SCHEMA.split(", ")]
            values = {"version": self._version, "total_records": 0, "last_checkpoint_chunk": 0} | row
            df = self.spark.createDataFrame([tuple(values.get(f) for f in fields)], SCHEMA).withColumn("at", F.current_timestamp())
            df.coalesce(1).write.mode("append").parquet(self.path)

    def create(self, job_id: str, source_id: str, job_type: str, total_records: int = 0) -> None:
        self._append(job_id=job_id, source_id=source_id, job_type=job_type, status=QUEUED, total_records=total_records)

    def start(self, job_id: str, work: Callable[[], None], source_id: str = "", job_type: str = "resolve") -> bool:
        """Run ``work`` in a thread, under the job's group; False if the job is running already."""
        with self._lock:
            if self.is_running(job_id):
                return False

            def run() -> None:
                self.spark.sparkContext.setJobGroup(job_id, f"{job_type} {source_id}")
                try:
                    work()
                    self._append(job_id=job_id, source_id=source_id, job_type=job_type, status=COMPLETED)
                except Exception as e:  # the log is where a job's error belongs
                    self._append(job_id=job_id, source_id=source_id, job_type=job_type, status=FAILED, error_message=str(e)[:2000])

            self._append(job_id=job_id, source_id=source_id, job_type=job_type, status=RUNNING)
            self._threads[job_id] = threading.Thread(target=run, daemon=True, name=f"job-{job_id}")
            self._threads[job_id].start()
            return True

    def is_running(self, job_id: str) -> bool:
        with self._lock:
            self._threads = {k: t for k, t in self._threads.items() if t.is_alive()}
            return job_id in self._threads

    def wait(self, job_id: str, timeout: float | None = None) -> None:
        if (thread := self._threads.get(job_id)) is not None:
            thread.join(timeout)

    def recover(self) -> DataFrame:
        """Close what was under way when the application stopped; the states after it."""
        with self._lock:
            rows = recovered(self.read()).withColumn("version", F.lit(self._version + 1).cast("long"))
            rows.write.mode("append").parquet(self.path)
            self._version += 1
        return latest(self.read())
