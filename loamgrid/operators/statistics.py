"""Paired statistics. Bootstrap draws are counts of a keyed hash, so they need no numbering of the items and no pass in one task; the exact one numbers them in ranges."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.sources.workspace import written

#: Draws that a task makes, and a block of values meets on average.
CELLS = 1 << 21
#: Replicates whose hashes of one item go to Python in one row.
SLICE = 256


def _uniform(*key: Column) -> Column:
    return (F.pmod(F.xxhash64(*key), F.lit(1 << 32)) + 0.5) / float(1 << 32)


def poisson_draw(*key: Column) -> Column:
    """How often an item is drawn in a replicate: a Poisson count of mean 1 by a hash of the key, by inversion up to 12."""
    u, total, p = _uniform(*key), 0.0, 0.36787944117144233
    out = F.lit(0)
    for k in range(12):
        total += p
        out = out + (u > total).cast("int")
        p /= k + 1
    return out


def bootstrap(df: DataFrame, item: list[str], num: str, den: str | None = None, strata: list[str] | None = None, replicates: int = 1000, seed: int = 42, bounds: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """One row: ``estimate, low, high`` of the mean of ``num`` (or of sum(num) / sum(den)) by a percentile bootstrap.

    ``item`` identifies what is drawn as a whole (a cluster's rows have one item). ``strata``: drawn within each, the means weighted by the strata's true sizes. Replicates are
    partial sums of rows times draws, so nothing is shuffled but one row per task, replicate and stratum. Rows with a null are left out.
    """
    d = F.col(den) if den else F.lit(1.0)
    strata = strata or []
    # A cluster's rows share their draw, since the draw is a function of the item.
    rows = df.select(*strata, F.xxhash64(*item).alias("__i"), F.col(num).cast("double").alias("a"), d.cast("double").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    x = rows.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", poisson_draw(F.col("__i"), F.col("r"), F.lit(seed)))
    sums = x.groupBy("r", *strata).agg(F.sum(F.col("w") * F.col("a")).alias("a"), F.sum(F.col("w") * F.col("b")).alias("b"), F.sum("b").alias("size"))
    per = sums.where("b > 0").groupBy("r").agg((F.sum(F.col("a") / F.col("b") * F.col("size")) / F.sum("size")).alias("m"))
    real = rows.agg((F.sum("a") / F.sum("b")).alias("estimate"))
    return real.crossJoin(per.agg(F.percentile("m", bounds[0]).alias("low"), F.percentile("m", bounds[1]).alias("high")))


def numbered(df: DataFrame, item: str) -> tuple[DataFrame, int]:
    """``df`` with ``i``, the place of a row by ``item`` (unique; null last) from 0, and the number of rows. Items are numbered in ranges, one task each, and ranges start where those before end."""
    kept = written(df.repartitionByRange(F.col(item).asc_nulls_last()).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = sorted(map(tuple, kept.groupBy("__range").count().collect()))  # a row a range
    starts = [(k, end - size) for (k, size), end in zip(sizes, accumulate(size for _, size in sizes), strict=True)]
    places = F.row_number().over(Window.partitionBy("__range").orderBy(F.col(item).asc_nulls_last())) - 1
    out = kept.withColumn("i", places).join(F.broadcast(df.sparkSession.createDataFrame(starts, "__range int, __start bigint")), "__range")
    return out.withColumn("i", F.col("i") + F.col("__start")).drop("__range", "__start"), sum(size for _, size in sizes)


def _sorted_draws(n: int, wide: int, replicates: int):
    """Draws of a task as one row a block: its cells in order, their first bytes, then their second and so on, so that what is alike lies together. A row ``r, h`` brings four bytes of a hash for each replicate from r."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [np.zeros(0, "u8")]
        for batch in batches:
            r, h = batch.column(0), batch.column(1).cast(pa.binary())
            if not len(h):
                continue
            ends = np.frombuffer(h.buffers()[1], "i4", len(h) + 1, 4 * h.offset).astype("i8")
            drawn = np.diff(ends) // 4
            hashes = np.frombuffer(h.buffers()[2], ">u4", drawn.sum(), ends[0]).astype("u8")
            replicate = np.arange(len(hashes)) + np.repeat(r.to_numpy() - (ends[:-1] - ends[0]) // 4, drawn)
            block, place = np.divmod(hashes % np.uint64(n), np.uint64(wide))
            every.append(block * np.uint64(wide * replicates) + replicate.astype("u8") * np.uint64(wide) + place)
        cells = np.concatenate(every)
        cells.sort()
        blocks = cells // np.uint64(wide * replicates)
        at = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(cells)] if len(cells) else []
        for a, b in pairwise(at):
            part = (cells[a:b] - blocks[a] * np.uint64(wide * replicates)).astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array([int(blocks[a])], pa.int64()), pa.array([part.view("u1").reshape(-1, 4).T.tobytes()], pa.binary())], ["block", "cells"])

    return run


def _drawn_sums(wide: int, replicates: int):
    """Sum and number of the values of one block that each replicate drew; null values are left out."""

    def run(draws: pa.Table, values: pa.Table) -> pa.Table:
        v, known = np.zeros(wide), np.zeros(wide, bool)
        place, given = values["i"].to_numpy() % wide, values["v"].combine_chunks()
        v[place], known[place] = given.fill_null(0.0).to_numpy(zero_copy_only=False), given.is_valid().to_numpy(zero_copy_only=False)
        total, drawn = np.zeros(replicates), np.zeros(replicates, "i8")
        for x in draws["cells"]:
            cells = np.frombuffer(x.as_buffer(), "u1").reshape(4, -1).T.copy().view("<u4").ravel()
            r, place = np.divmod(cells, np.uint32(wide))
            if not known.all():
                r, place = r[known[place]], place[known[place]]
            total += np.bincount(r, v[place], replicates)
            drawn += np.bincount(r, minlength=replicates)
        return pa.table({"r": pa.array(range(replicates), pa.int32()), "total": total, "drawn": drawn})

    return run


def exact_bootstrap(df: DataFrame, item: str, value: str, replicates: int = 1000, seed: int | None = 42) -> DataFrame:
    """``low, high`` of the mean, each replicate drawing as many items as there are: draw i of replicate r is the item in place ``sha256("seed:r:i") mod n`` (without a seed: ``"r:i"``).

    ``item`` is unique. Draws need no rows but their number, so tasks make ``CELLS`` each. They are sorted by blocks of ``CELLS / replicates`` items, meet a block's values, and leave as one
    sum a block and replicate: tasks grow in number, not in size.
    """
    rows, n = numbered(df.select(F.col(item).alias("item"), F.col(value).cast("double").alias("v")), "item")
    wide = max(1, CELLS // replicates)
    blocks = max(1, -(-n // wide))
    tasks = -(-blocks // 4)
    ids = df.sparkSession.range(0, n, 1, blocks).select(F.concat(F.lit(":"), F.col("id").cast("string")).alias("tail"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(SLICE))).alias("r"))
    head = [] if seed is None else [F.lit(f"{seed}:")]
    hashes = F.transform(F.sequence("r", F.least(F.col("r") + SLICE, F.lit(replicates)) - 1), lambda r: F.substr(F.sha2(F.concat(*head, r.cast("string"), F.col("tail")), 256), F.lit(1), F.lit(8)))
    draws = ids.select("r", F.unhex(F.array_join(hashes, "")).alias("h")).mapInArrow(_sorted_draws(n, wide, replicates), "block bigint, cells binary")
    values = rows.select(F.expr(f"i div {wide}").alias("block"), "i", "v")
    met = draws.repartition(tasks, "block").groupBy("block").cogroup(values.repartition(tasks, "block").groupBy("block"))
    sums = met.applyInArrow(_drawn_sums(wide, replicates), "r int, total double, drawn bigint")
    means = sums.groupBy("r").agg((F.sum("total") / F.nullif(F.sum("drawn"), F.lit(0))).alias("m"))
    return means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def paired(df: DataFrame, item: list[str], arm: str, base: str, new: str, value: str) -> DataFrame:
    """Items that both arms have: ``item, a, b, delta``."""
    pick = lambda x: F.max(F.when(F.col(arm) == x, F.col(value)))
    return df.where(F.col(arm).isin(base, new)).groupBy(*item).agg(pick(base).alias("a"), pick(new).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").withColumn("delta", F.col("b") - F.col("a"))


def without(df: DataFrame, excluded: DataFrame, key: list[str]) -> DataFrame:
    """A sensitivity subset: rows but for the excluded keys."""
    return df.join(excluded.select(*key).distinct(), key, "left_anti")


def interaction(df: DataFrame, item: list[str], arm: str, value: str, arms: tuple[str, str, str, str]) -> DataFrame:
    """(d - b) - (c - a) per item that has all four arms ``(a, b, c, d)``."""
    got = [F.max(F.when(F.col(arm) == x, F.col(value))).alias(n) for x, n in zip(arms, "abcd", strict=True)]
    return df.groupBy(*item).agg(*got).withColumn("interaction", (F.col("d") - F.col("b")) - (F.col("c") - F.col("a"))).where("interaction IS NOT NULL")


def compared(published: DataFrame, computed: DataFrame, key: list[str], value: str, relative: float = 1e-9, absolute: float = 1e-8) -> DataFrame:
    """Keys whose published value differs from the computed one by more than the tolerance, or that one side lacks."""
    a, b = published.select(*key, F.col(value).alias("published")), computed.select(*key, F.col(value).alias("computed"))
    far = F.abs(F.col("published") - F.col("computed")) > F.greatest(F.lit(absolute), relative * F.greatest(F.abs("published"), F.abs("computed")))
    return a.join(b, key, "full").where(F.coalesce(far, F.lit(True)) & ~(F.col("published").isNull() & F.col("computed").isNull()))


def same_context(a: Column, b: Column, verdict_a: Column, verdict_b: Column) -> Column:
    """The second arm's verdict, but the first one's where both saw the same context."""
    return F.when(a.eqNullSafe(b), verdict_a).otherwise(verdict_b)


def selection_gate(exact: Column, binary: Column, bias: Column, low: Column) -> Column:
    """Whether a judge may replace another: agreement, small bias, and an improvement whose interval is above 0."""
    return F.coalesce((exact >= 0.8) & (binary >= 0.9) & (F.abs(bias) <= 0.05) & (low > 0), F.lit(False))


def improvement(delta: Column, p: Column, low: Column, practical: float = 5.0) -> Column:
    """struct<significant, practical> of a difference in percentage points."""
    return F.struct(F.coalesce((delta > 0) & (p < 0.05) & (low > 0), F.lit(False)).alias("significant"), F.coalesce(delta >= practical, F.lit(False)).alias("practical"))
