"""Sources, streaming and packing on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from loamgrid.functions.text import compatible_alnum
from loamgrid.operators.packing import next_fit
from loamgrid.sources import files
from loamgrid.streaming import windows


@pytest.mark.parametrize("kind", ["tumbling", "sliding", "session"])
def test_stream_equals_batch(spark, tmp_path, kind):
    src = str(tmp_path / "in")
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    late = spark.sql("SELECT 999999L AS event_id, TIMESTAMP_NTZ '2030-01-01 00:00:00' AS ts, 1L AS user_id, 'click' AS event_type, 0D AS value, '{}' AS props")
    rows.unionByName(late.select(*[F.col(c).cast(t).alias(c) for c, t in rows.dtypes])).coalesce(1).write.parquet(src)
    stream = windows.windowed_counts(windows.read_events(spark, src), kind)
    windows.run_available(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    got = set(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    want = set(map(tuple, windows.windowed_counts(rows.withColumn("ts", F.col("ts").cast("timestamp")), kind).collect()))
    assert got == want


def test_files(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": 1, "t": "x"}\n\n{"id": 2, "t": "y"}\n{"id": 3, "t"')
    assert {r.id for r in files.read_jsonl(spark, str(p), "id int, t string").where("id IS NOT NULL").collect()} >= {1, 2}
    assert [r.line for r in files.corrupt_lines(spark, str(p)).collect()] == ['{"id": 3, "t"']
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(p), "id int, t string", strict=True).collect()
    found = files.manifest(spark, str(tmp_path))
    new, changed = files.new_files(found, found.withColumn("sha256", F.lit("other")))
    assert (new.count(), changed.count()) == (0, 1)


def test_functions(spark):
    r = spark.createDataFrame([("ﬁ Straße-1", "<p>a<script>x</script>b &amp;lt; c</p>"), (None, None)], "t string, h string").select(compatible_alnum("t").alias("n"), files.html_to_text(F.col("h")).alias("h")).collect()
    assert [tuple(x) for x in r] == [("fistrasse1", "a b &lt; c"), (None, None)]


def test_next_fit(spark):
    rows = spark.createDataFrame([("g", i, n) for i, n in enumerate([1000, 1000, 100, 3000, 5])], "g string, i int, n int")
    assert [r.bin for r in next_fit(rows, "g", "i", "n").orderBy("i").collect()] == [0, 0, 1, 2, 3]


def test_next_fit_runs_agree(spark):
    rnd = random.Random(5)
    sizes = [rnd.choice([0, 1, 7, 60, 300, 1000, 2048, 2500]) for _ in range(400)]
    rows = spark.createDataFrame([("hot" if i % 4 else None, i if i else None, n if i % 50 else None, "x") for i, n in enumerate(sizes)], "g string, i int, n int, c string")
    whole, split = ({(r.i, r.g): r.bin for r in next_fit(rows, "g", "i", "n", run_rows=k).collect()} for k in (1_000, 17))
    assert whole == split and len(whole) == len(sizes)
    assert next_fit(rows.limit(0), "g", "i", "n").count() == 0
