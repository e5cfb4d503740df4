"""Streams that act: rows are graded as they appear, with reports on the way, a deadline and a last report; and a log of events with subscribers.

Everything a micro-batch writes lies in a folder with its number and is written anew if that batch is replayed after a failure, so grades, counts and reports
are there exactly once however often a run was stopped.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgrid.operators.rules import subscribed


def due_reports(counts: DataFrame, batch: str, n: str, every: int) -> DataFrame:
    """``batch, total, number`` of the batches of a run (one row each) in which the count of rows so far reaches another multiple of ``every``. The table form of ``Grading``'s reports."""
    x = counts.withColumn("total", F.sum(n).over(Window.orderBy(batch)))
    return x.where(F.floor(F.col("total") / every) > F.floor((F.col("total") - F.col(n)) / every)).select(batch, "total", F.floor(F.col("total") / every).alias("number"))


class Grading:
    """Grades the rows of a stream once each and reports progress, in tables under ``path``: ``grades``, ``counts`` and ``reports`` (a folder each batch) and ``last``.

    ``grade`` turns rows into rows with ``key`` and ``status``. A key that comes again, in one batch or later, is graded once; keys that ``expected`` lacks are not graded.
    """

    def __init__(self, spark: SparkSession, path: str, grade: Callable[[DataFrame], DataFrame], expected: DataFrame, key: str, every: int = 4, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.grade, self.expected, self.key, self.every, self.clock = spark, path.rstrip("/"), grade, expected.select(key).distinct(), key, every, clock
        jvm = spark.sparkContext._jvm
        self.at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self.fs = self.at("grades").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def done(self, name: str, before: int | None = None) -> DataFrame | None:
        """What finished batches (those before a number) have written to a table."""
        found = [s.getPath().getName() for s in self.fs.listStatus(self.at(name))] if self.fs.exists(self.at(name)) else []
        own = [f"{self.path}/{name}/{n}" for n in found if self.fs.exists(self.at(f"{name}/{n}/_SUCCESS")) and (before is None or int(n[6:]) < before)]
        return self.spark.read.parquet(*own) if own else None

    def batch(self, rows: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        rows = rows.join(self.expected, self.key, "left_semi")
        before = self.done("grades", batch_id)
        if before is not None:
            rows = rows.join(before.select(self.key), self.key, "left_anti")
        out = f"batch={batch_id}"
        self.grade(rows.dropDuplicates([self.key])).write.mode("overwrite").parquet(f"{self.path}/grades/{out}")
        n = self.spark.read.parquet(f"{self.path}/grades/{out}").count()
        earlier = self.done("counts", batch_id)
        total = (earlier.agg(F.sum("n")).first()[0] or 0 if earlier is not None else 0) + n
        self.spark.sql(f"SELECT {batch_id}L AS batch, {n}L AS n").write.mode("overwrite").parquet(f"{self.path}/counts/{out}")
        number = total // self.every
        if number > (total - n) // self.every:
            self.report("progress", total, number, batch_id).write.mode("overwrite").parquet(f"{self.path}/reports/{out}")

    def report(self, reason: str, total: int, number: int, batch_id: int | None) -> DataFrame:
        """One row for each status among all grades so far."""
        grades = self.done("grades", None if batch_id is None else batch_id + 1)
        by = grades.groupBy("status").agg(F.count(F.lit(1)).alias("n")) if grades is not None else self.spark.createDataFrame([], "status string, n bigint")
        return by.select(F.lit(reason).alias("reason"), F.lit(number).cast("bigint").alias("number"), F.lit(total).cast("bigint").alias("total"), "status", "n")

    def total(self) -> int:
        counts = self.done("counts")
        return 0 if counts is None else counts.agg(F.sum("n")).first()[0]

    def started(self) -> float:
        """When the first run began: a restart keeps its deadline."""
        at = f"{self.path}/started"
        if not self.fs.exists(self.at("started/_SUCCESS")):
            self.spark.createDataFrame([(float(self.clock()),)], "at double").write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at).first()[0]

    def watch(self, stream: Callable[[], DataFrame], checkpoint: str, seconds: float = 86_400, poll: float = 5, sleep: Callable[[float], None] = time.sleep) -> int:
        """Grade what is there, again and again, until all expected keys are graded; the last report is written then, or at the deadline, ``seconds`` after
        the first run began, which is an error: what is graded stays, and a later call goes on. Returns the number of graded rows."""
        started, wanted = self.started(), self.expected.count()
        while True:
            stream().writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
            total = self.total()
            over = self.clock() - started > seconds
            if total >= wanted or over:
                self.report("complete" if total >= wanted else "deadline", total, total // self.every, None).write.mode("overwrite").parquet(f"{self.path}/last")
                if total < wanted:
                    raise TimeoutError(f"{total} of {wanted} rows are graded; what there is can be taken up again")
                return total
            sleep(poll)


class EventLog:
    """Events (``kind, source, targets`` and more), appended under ``path`` in a folder for each kind, so that subscribers to some kinds read only those."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def publish(self, events: DataFrame) -> None:
        events.write.mode("append").partitionBy("kind").parquet(self.path)

    def table(self, listener: str, kinds: list[str] | None = None, source: str | None = None) -> DataFrame:
        """What a listener is sent: its own and broadcast events, of some kinds and one source if asked. See ``rules.subscribed``."""
        return subscribed(self.spark.read.schema(self.schema).parquet(self.path), listener, kinds, source)

    def stream(self, listener: str, kinds: list[str] | None = None, source: str | None = None) -> DataFrame:
        """The same as a stream; each subscriber's place is in its own checkpoint."""
        return subscribed(self.spark.readStream.schema(self.schema).parquet(self.path), listener, kinds, source)
