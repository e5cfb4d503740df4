"""Keyed states that live for a time after their last write: sessions (an hour) and task states (a day), as a stream with timers and as a table.

A write creates a state or prolongs it; a write that comes when the time is over begins a new one. The stream keeps what is open in a state store and emits a
state when the watermark passes its end, or when the next write shows that it had ended; the table form gives the same states from all writes at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

#: Seconds that a state lives after its last write, by kind.
TTL = {"session": 3_600, "state": 86_400}
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def lifetimes(writes: DataFrame, key: str, at: str, ttl: dict[str, int] | None = None, horizon: str | None = None) -> DataFrame:
    """``key, kind, start, last, writes, live``: the states that ``writes`` (a table) make of each key. ``live``: the state's time isn't over at ``horizon`` (SQL; the last write of
    the table if None). Writes without key or time are left out.

    Two writes less than the time to live apart are of one state, so writes are first counted by stretches of that length: at most one row a key and stretch is ordered.
    """
    ttl = TTL if ttl is None else ttl
    micros = f"unix_micros(CAST(`{at}` AS timestamp))"
    x = writes.where(f"`{key}` IS NOT NULL AND `{at}` IS NOT NULL").select(F.col(key), F.expr(f"{micros} AS __at"), F.explode(F.expr("array(" + ", ".join(f"named_struct('kind', '{k}', 'ttl', {n} * 1000000L)" for k, n in ttl.items()) + ")")).alias("__k"))
    x = x.groupBy(key, F.col("__k.kind").alias("kind"), F.col("__k.ttl").alias("__ttl"), F.expr("__at DIV __k.ttl").alias("__s")).agg(F.min("__at").alias("__a"), F.max("__at").alias("__b"), F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(key, "kind").orderBy("__s")
    x = x.withColumn("__run", F.count_if(F.coalesce(F.col("__a") - F.lag("__b").over(w) >= F.col("__ttl"), F.lit(True))).over(w))
    runs = x.groupBy(key, "kind", "__ttl", "__run").agg(F.min("__a").alias("__a"), F.max("__b").alias("__b"), F.sum("__n").alias("writes"))
    end = writes.agg(F.expr(f"max({micros})").alias("__end")) if horizon is None else writes.sparkSession.sql(f"SELECT unix_micros(CAST({horizon} AS timestamp)) AS __end")
    runs = runs.crossJoin(F.broadcast(end))  # one row
    return runs.selectExpr(f"`{key}`", "kind", "timestamp_micros(__a) AS start", "timestamp_micros(__b) AS last", "writes", "__b + __ttl > __end AS live")


class Expiring(StatefulProcessor):
    """One map entry for each kind of state that is open; a timer of event time for each end that a write has set."""

    def __init__(self, key: str, at: str, ttl: dict[str, int]):
        self.key, self.at, self.ttl = key, at, {k: n * 1_000_000 for k, n in ttl.items()}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "kind string", "start bigint, last bigint, writes bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = np.sort(np.concatenate([r[self.at].to_numpy("datetime64[us]").astype(np.int64) for r in rows]))
        gaps = np.diff(at)
        for kind, ttl in self.ttl.items():
            edges = [0, *(np.flatnonzero(gaps >= ttl) + 1).tolist(), len(at)]
            state = tuple(self.open.getValue((kind,))) if self.open.containsKey((kind,)) else None
            for lo, hi in zip(edges, edges[1:], strict=False):
                first, last, n = int(at[lo]), int(at[hi - 1]), hi - lo
                if state and first - state[1] < ttl:
                    state = min(first, state[0]), max(last, state[1]), state[2] + n
                    continue
                if state:
                    yield self.ended(key, kind, state)
                state = first, last, n
            self.open.updateValue((kind,), state)
            self.handle.registerTimer(-(-(state[1] + ttl) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        for kind, ttl in self.ttl.items():
            if self.open.containsKey((kind,)):
                state = tuple(self.open.getValue((kind,)))
                if state[1] + ttl <= now:  # no write has prolonged it since
                    self.open.removeKey((kind,))
                    yield self.ended(key, kind, state)

    def ended(self, key, kind: str, state: tuple) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "kind": [kind], "start": [pd.Timestamp(state[0], unit="us", tz="UTC")], "last": [pd.Timestamp(state[1], unit="us", tz="UTC")], "writes": [state[2]]})

    def close(self) -> None:
        pass


def expired(writes: DataFrame, key: str, at: str, ttl: dict[str, int] | None = None, late: str = "0 seconds") -> DataFrame:
    """``key, kind, start, last, writes`` of the states of a stream of writes as they end. Writes behind the watermark (``late`` after the newest) are left out,
    as are those without key or time. The session must use the RocksDB state store."""
    conf = writes.sparkSession.conf
    if conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKS:
        raise RuntimeError(f"timers need spark.sql.streaming.stateStore.providerClass={ROCKS}")
    x = writes.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, F.col(at).cast("timestamp").alias(at)).withWatermark(at, late)
    kind = dict(writes.dtypes)[key]
    schema = f"`{key}` {kind}, kind string, start timestamp, last timestamp, writes bigint"
    return x.groupBy(key).transformWithStateInPandas(Expiring(key, at, TTL if ttl is None else ttl), schema, "Append", "EventTime")


def open_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``key, kind, start, last, writes`` of what a stream of ``expired`` holds open, read from its checkpoint."""
    x = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint)
    return x.select(F.col("key.*"), F.col("user_map_key.kind").alias("kind"), F.timestamp_micros("user_map_value.start").alias("start"), F.timestamp_micros("user_map_value.last").alias("last"), F.col("user_map_value.writes").alias("writes"))
