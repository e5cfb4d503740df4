"""Shared helpers: tables, lineage cuts in the cluster's shared folder, ordered range buckets, Arrow row mapping."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points of text handed to one call of a mapped function; bounds a worker's memory for any batch size.
CHUNK_CHARS = 4_000_000
_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data layout, read by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset: a temporary one of a local session (tests), or an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="loamgrid-")
            atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
        at = _LOCAL[app]
    return at.rstrip("/")


#: Bytes of a row group of ``cut``: a task that writes or reads one holds all of it, outside the memory that Spark counts.
ROW_GROUP = 16 << 20


def cut(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loamgrid-{uuid.uuid4().hex}"
    df.write.option("compression", compression).option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loamgrid_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once nothing lazy reads them any more."""
    for df in frames:
        path = getattr(df, "_loamgrid_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished steps now: it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim(spark: SparkSession) -> None:
    """``release``, and let executors hand heap that a finished stage has grown back to the system, where Python workers need it."""
    release(spark)
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') AS x").write.format("noop").mode("overwrite").save()


def range_splits(df: DataFrame, key: Column, n: int) -> list[int]:
    """At most ``n - 1`` values of an integer ``key`` that cut it into runs of about equal size. Only these reach the driver."""
    if n < 2:
        return []
    q = F.percentile_approx(key, [i / n for i in range(1, n)], max(10_000, 20 * n))
    got = df.select(q.alias("q")).first()["q"]
    return sorted(set(got or []))


def bucket_of(key: Column, splits: list[int]) -> Column:
    """How many of ``splits`` are at most ``key``: buckets rise with the key. Two short searches instead of one long one."""
    if not splits:
        return F.lit(0)
    step = max(1, int(len(splits) ** 0.5))
    coarse = F.array(*[F.lit(s).cast("long") for s in splits[::step]])
    fine = F.array(*[F.lit(s).cast("long") for s in splits])
    block = F.greatest(F.size(F.filter(coarse, lambda s: s <= key)) - 1, F.lit(0))
    inside = F.filter(F.slice(fine, block * step + 1, F.lit(step)), lambda s: s <= key)
    return (block * step + F.size(inside)).cast("int")


#: What a worker process keeps from one task to the next: the state of one operator at most.
_STATE: dict = {}
#: Rows of an Arrow batch at most, so that batches of long texts stay small on both sides.
BATCH_ROWS = 1_000


def worker_state(key, make: Callable[[], object] | None = None):
    """The state ``key`` of this worker process, made once; that of any other operator is dropped. Without ``make``: drop all."""
    if make is None:
        _STATE.clear()
        return None
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = make()
    return _STATE[key]


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches of this session to BATCH_ROWS rows, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def map_texts(df: DataFrame, keys: list[Column], text: Column, make: Callable[[], Callable[[list, list], list]], schema: str, keeps: bool = False) -> DataFrame:
    """Apply a function to (keys..., text) rows in Arrow batches; null texts arrive as ''.

    ``make()`` runs once per task and returns ``fn(rows_of_keys, texts) -> rows`` (tuples in the schema's order). Only the named
    columns are read, so other columns of ``df`` can have any name. ``keeps``: ``make`` uses ``worker_state``.
    """
    small_batches(df.sparkSession)
    picked = df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.coalesce(text.cast("string"), F.lit("")).alias("t"))
    out = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            worker_state(None)
        fn = make()
        for batch in batches:
            lengths = pa.compute.binary_length(batch.column(batch.num_columns - 1)).to_pylist()
            start = 0
            while start < batch.num_rows:
                end, size = start, 0
                while end < batch.num_rows and (end == start or size + lengths[end] <= CHUNK_CHARS):
                    size += lengths[end]
                    end += 1
                part = batch.slice(start, end - start)
                cols = [c.to_pylist() for c in part.columns]
                rows = fn(list(zip(*cols[:-1], strict=True)) if len(cols) > 1 else [()] * part.num_rows, cols[-1])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
                start = end

    return picked.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
