"""One place that builds the session, so that every entry point gets the same settings."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "loamgrid", master: str | None = None, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; cluster settings such as the master stay the caller's when set outside."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("LOAMGRID_DRIVER_MEMORY", "8g"),
        "spark.driver.host": "127.0.0.1",
        # States with timers need this store.
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
