"""Arrow batches of texts whose size in a Python worker doesn't follow the input."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Rows of an Arrow batch that Spark sends, and bytes of text that are worked on at once (a longer text is alone).
ROWS, CHUNK_CHARS = 1_000, 1_000_000


def hold(spark: SparkSession) -> None:
    """Hold Arrow batches of this session to ROWS rows, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS:
        spark.conf.set(name, str(ROWS))


def slices(parts: Iterator[pa.RecordBatch], text: int, most: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """The same rows in runs of at most ``most`` bytes of the string column number ``text``."""
    for part in parts:
        sizes = pc.fill_null(pc.binary_length(part.column(text)), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(sizes):
            if i > start and size + n > most:
                yield part.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < part.num_rows:
            yield part.slice(start)
