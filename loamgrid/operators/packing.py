"""Sequential packing that no window function expresses: greedy, whole excerpts, within a group of any size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the whole table per run of ``order``; a group's rows of a run are packed by one task.
RUN_ROWS = 200_000


def _pack(sizes: list[int], room: int, used: int) -> tuple[list[int], int]:
    """Bins, counted from the one open at the start, and what is used of the last one."""
    bins, now = [], 0
    for n in sizes:
        if used and used + n > room:
            now, used = now + 1, 0
        used += n
        bins.append(now)
    return bins, used


def _transition(sizes: list[int], room: int) -> tuple[np.ndarray, np.ndarray]:
    """For every fill of the open bin at the start (``room + 1``: over-full), the fill at the end and the bins opened.

    Starts that have reached the same fill stay together, so that few are left to follow after the first bins.
    """
    which = np.arange(room + 2)
    fill, opened, base = which.copy(), np.zeros(room + 2, np.int64), np.zeros(room + 2, np.int64)
    for x, n in enumerate(sizes):
        new = (fill > 0) & (fill + n > room)
        opened += new
        fill = np.minimum(np.where(new, 0, fill) + n, room + 1)
        if len(fill) > 1 and (x % 16 == 0 or x == len(sizes) - 1):
            first, back = np.unique(fill, return_index=True, return_inverse=True)[1:]
            base += (opened - opened[first][back])[which]
            which, fill, opened = back[which], fill[first], opened[first]
    return fill[which], opened[which] + base


def next_fit(df: DataFrame, group: str, order: str, size: str, room: int = 2048, run_rows: int = RUN_ROWS) -> DataFrame:
    """``df`` with ``bin``: excerpts in the integer ``order`` fill a bin until the next one would not fit; a longer one has a bin of its own.

    Runs of ``order`` are cut at quantiles of the whole table, so a group that holds most rows is dealt to many tasks: each run of a group
    first tells what it makes of every possible fill of the bin left open before it, these are chained per group, and the runs are packed
    from the fills they really start with. Ties of ``order`` are packed by size; null sizes count 0; rows with a null order come first, null
    groups are one group; repeated rows stay; an empty table gives an empty table. ``df`` must not have columns bin, __run, __fill, __bin.
    """
    n = -(-df.count() // run_rows)
    cuts = sorted(set(df.select(F.percentile_approx(F.col(order), [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("q")).first()["q"] or [])) if n > 1 else []
    run = F.size(F.filter(F.array(*[F.lit(c).cast("bigint") for c in cuts]), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    rows = df.withColumn("__run", F.coalesce(F.when(F.col(order).isNull(), 0).otherwise(run), F.lit(0)).cast("int"))
    kind = dict(df.dtypes)[group]

    def in_order(part: pd.DataFrame) -> pd.DataFrame:
        return part.sort_values([order, size], kind="stable", na_position="first")

    def lengths(part: pd.DataFrame) -> list[int]:
        return part[size].fillna(0).astype("int64").tolist()

    def summary(part: pd.DataFrame) -> pd.DataFrame:
        fill, opened = _transition(lengths(in_order(part)), room)
        return pd.DataFrame({group: [part[group].iloc[0]], "__run": [part["__run"].iloc[0]], "fill": [fill.tolist()], "opened": [opened.tolist()]})

    def chain(part: pd.DataFrame) -> pd.DataFrame:
        part, fill, at, starts = part.sort_values("__run"), 0, 0, []
        for f, o in zip(part["fill"], part["opened"], strict=True):
            starts.append((fill, at))
            fill, at = int(f[fill]), at + int(o[fill])
        return pd.DataFrame({"__g": part[group], "__r": part["__run"], "__fill": [s[0] for s in starts], "__bin": [s[1] for s in starts]})

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = in_order(part)
        bins, _ = _pack(lengths(part), room, int(part["__fill"].iloc[0]))
        return part.assign(bin=np.array(bins, np.int64) + int(part["__bin"].iloc[0])).drop(columns=["__run", "__fill", "__bin"])

    starts = rows.select(group, order, size, "__run").groupBy(group, "__run").applyInPandas(summary, f"`{group}` {kind}, __run int, fill array<bigint>, opened array<bigint>")
    starts = starts.groupBy(group).applyInPandas(chain, f"__g {kind}, __r int, __fill bigint, __bin bigint")
    known = rows.join(starts, rows[group].eqNullSafe(starts["__g"]) & (rows["__run"] == starts["__r"])).drop("__g", "__r")
    return known.groupBy(group, "__run").applyInPandas(pack, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", bin bigint")
