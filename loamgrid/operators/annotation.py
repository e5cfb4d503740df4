"""Annotations of records by an outside model, asked in batches and kept by content: what is known is never asked again, what a reply lacks is asked once more, alone.

The model is a function of the caller's; it runs on executors, one call a batch. The library calls no model itself.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Records of a bucket, within which batches are made.
BUCKET = 1_024
ANSWERS = "record_key string, batch_sha256 string, annotation string"


class Annotations:
    """A store of answers under ``path``: ``answers`` (by record key), and ``batches``: what was asked and which of its ids came back.

    ``call(text)`` gets the prompt followed by a JSON list of records and returns a list of objects, each with the ``id`` of its record.
    """

    def __init__(self, spark: SparkSession, path: str, model: str, prompt: str, schema: str, call: Callable[[str], list[dict]], size: int = 8):
        self.spark, self.path, self.call, self.size, self.prompt, self.model, self.schema = spark, path.rstrip("/"), call, size, prompt, model, schema

    def keyed(self, rows: DataFrame) -> DataFrame:
        """``rows`` (``id string, payload string``: a JSON object) with ``record_key``: the digest of model, prompt, schema and record."""
        head = hashlib.sha256(json.dumps([self.model, self.prompt, self.schema]).encode()).hexdigest()
        return rows.withColumn("record_key", F.sha2(F.concat_ws("\x1f", F.lit(head), F.col("id"), F.col("payload")), 256))

    def known(self) -> DataFrame:
        """One answer for each record key that any finished run has got."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/answers")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], ANSWERS)
        x = self.spark.read.schema(ANSWERS).parquet(f"{self.path}/answers")
        return x.groupBy("record_key").agg(F.min(F.struct("batch_sha256", "annotation")).alias("a")).select("record_key", "a.*")

    def ask(self, rows: DataFrame, n: int) -> None:
        """Ask for ``n`` rows in batches and keep the answers: of each batch those ids that came back exactly once."""
        call, prompt, head = self.call, self.prompt, json.dumps([self.model, self.schema])

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for records in part["records"]:
                    text = prompt + json.dumps([{"id": r["id"], **json.loads(r["payload"])} for r in records], ensure_ascii=False)
                    sha = hashlib.sha256((head + text).encode()).hexdigest()
                    replies = call(text)
                    count = Counter(r.get("id") for r in replies)
                    keys = {r["id"]: r["record_key"] for r in records}
                    good = [(keys[r["id"]], json.dumps(r, ensure_ascii=False, sort_keys=True)) for r in replies if r.get("id") in keys and count[r["id"]] == 1]
                    rows = [(k, sha, a, True) for k, a in good] + [(k, sha, None, False) for k in keys.values() if k not in dict(good)]
                    yield pd.DataFrame(rows, columns=["record_key", "batch_sha256", "annotation", "answered"])

        buckets = -(-n // BUCKET)
        x = rows.withColumn("b", F.pmod(F.xxhash64("record_key"), F.lit(buckets)))
        x = x.withColumn("g", F.floor((F.row_number().over(Window.partitionBy("b").orderBy("record_key")) - 1) / self.size))
        batches = x.groupBy("b", "g").agg(F.array_sort(F.collect_list(F.struct("id", "payload", "record_key"))).alias("records"))
        # What was asked is written first and read again: a later step can't make the calls a second time.
        run_id = f"{self.path}/batches/{hashlib.sha256(f'{self.spark.sparkContext.applicationId}{self.runs()}'.encode()).hexdigest()[:16]}"
        batches.select("records").mapInPandas(run, "record_key string, batch_sha256 string, annotation string, answered boolean").write.parquet(run_id)
        self.spark.read.parquet(run_id).where("answered").select("record_key", "batch_sha256", "annotation").write.mode("append").parquet(f"{self.path}/answers")

    def runs(self) -> int:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/batches")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return len(fs.listStatus(at)) if fs.exists(at) else 0

    def annotate(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``annotation`` (JSON) and ``batch_sha256``. Unknown records are asked for, those that a reply lacks, repeats or names wrongly once more; if any is still
        missing, an error: what came back stays known. Equal records are asked for once; ids and payloads must not be null."""
        own = self.keyed(rows)
        for _ in range(2):
            todo = own.dropDuplicates(["record_key"]).join(self.known().select("record_key"), "record_key", "left_anti")
            n = todo.count()
            if n:
                self.ask(todo, n)
        missing = own.join(self.known().select("record_key"), "record_key", "left_anti").select("id").limit(5).collect()
        if missing:
            raise ValueError(f"no answer for records such as {[r.id for r in missing]}")
        return own.join(self.known(), "record_key").drop("record_key")
