"""Named queries over the test tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.functions.text import plain_words
from loamgrid.operators.packing import next_fit
from loamgrid.plans import bound, indexed, more, nested, stateful  # noqa: F401  (the others register their queries in bound)
from loamgrid.plans.dialect import expand, run_sql
from loamgrid.plans.sqlbook import BOOK
from loamgrid.streaming.windows import windowed_counts


def _run(template: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, template)


def greedy_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id", F.size(plain_words(F.col("text"))).cast("bigint").alias("n_words"))
    return next_fit(docs, "source", "doc_id", "n_words")


def _windows(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), kind)


#: SQL of the event windows. Session windows are islands of events less than the gap apart.
WINDOW_SQL = {
    "tumbling": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS stop, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "sliding": """SELECT w AS start, w + INTERVAL 1 HOUR AS stop, event_type, count(*) AS n, round(sum(value), 4) AS total
FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w, event_type, value FROM events WHERE ts IS NOT NULL) x GROUP BY ALL""",
    "session": """WITH b AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM b)
SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, user_id, count(*) AS n, round(sum(value), 4) AS total FROM i GROUP BY user_id, k""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: partial(_run, text) for name, text in BOOK.items()}
    out |= {"greedy_bins": greedy_bins} | bound.QUERIES
    return out | {f"{kind}_windows": partial(_windows, kind) for kind in ("tumbling", "sliding", "session")}


def oracle_sql() -> dict[str, str]:
    return {name: expand(text, 1) for name, text in BOOK.items()} | bound.ORACLE | {f"{kind}_windows": text for kind, text in WINDOW_SQL.items()}
