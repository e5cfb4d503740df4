"""Folders for tables that a job writes on its way: in ``spark.checkpoint.dir``, which driver and executors share, or a temporary one in local sessions where that is unset."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def fresh(spark: SparkSession, name: str) -> str:
    """A path that nothing has been written to."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        app = spark.sparkContext.applicationId
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="loamgrid-")
            atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
        at = _LOCAL[app]
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df``, written and read again: its lineage ends there, so a lost executor costs no earlier work."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def compact(df: DataFrame, name: str = "table") -> DataFrame:
    """``written``, packed closer: for tables as large as the input."""
    path = fresh(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
