"""Streams with state: sessions that expire, profiles, reports; each against its batch form, and over restarts."""

import datetime

import pytest
from pyspark.sql import functions as F

from loamgrid.streaming import profiles, progress, sessions
from loamgrid.streaming.windows import read_events, run_available

EVENTS = "/root/testdata/sf0.001/events.parquet"


def brute_lifetimes(rows, ttl):
    """(key, kind, start, last, writes) of sorted writes, one by one."""
    out = []
    for kind, n in ttl.items():
        state = {}
        for k, t in sorted(rows, key=lambda r: r[1]):
            if k in state and t - state[k][1] < n:
                state[k] = [state[k][0], t, state[k][2] + 1]
            else:
                if k in state:
                    out.append((k, kind, *state[k], False))
                state[k] = [t, t, 1]
        end = max((t for _, t in rows), default=0)
        out += [(k, kind, *s, s[1] + n > end) for k, s in state.items()]
    return sorted(out)


def seconds(df):
    return df.withColumns({c: F.col(c).cast("double") for c in ("start", "last")})


def test_lifetimes_equal_writes_one_by_one(spark):
    rows = [(k, 1_700_000_000 + t) for k, ts in {1: [0, 10, 3599, 7198, 10_798, 14_400, 200_000], 2: [5, 5, 86_404, 86_405 + 86_400], 3: [200_001]}.items() for t in ts]
    df = spark.createDataFrame([*rows, (None, 1), (4, None)], "user bigint, t bigint").select("user", F.timestamp_seconds("t").alias("ts"), F.lit(1).alias("kind"), F.lit(2).alias("writes"))
    got = seconds(sessions.lifetimes(df, "user", "ts")).collect()
    assert sorted((r.user, r.kind, r.start, r.last, r.writes, r.live) for r in got) == brute_lifetimes(rows, sessions.TTL)
    assert not sessions.lifetimes(df, "user", "ts", horizon="TIMESTAMP '2030-01-01'").where("live").count()
    assert sessions.lifetimes(df.limit(0), "user", "ts").count() == 0


def test_sessions_expire_and_a_restart_agrees_with_the_table(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    events = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp")).where("user_id < 6").select("user_id", "ts")
    days = sorted(r[0] for r in events.select(F.to_date("ts")).distinct().collect())
    cuts = [days[len(days) // 3], days[2 * len(days) // 3]]
    parts = [events.where(F.to_date("ts") < cuts[0]), events.where(F.to_date("ts").between(*cuts)), events.where(F.to_date("ts") > cuts[1])]
    for part in parts:  # each is read by a stream of its own that goes on from the checkpoint
        part.coalesce(1).write.mode("append").parquet(src)
        run_available(sessions.expired(read_events(spark, src), "user_id", "ts"), out, check)
    cols = ["user_id", "kind", "start", "last", "writes"]
    want = sessions.lifetimes(events, "user_id", "ts")
    ended = sorted(map(tuple, spark.read.parquet(out).select(cols).collect()))
    assert ended == sorted(map(tuple, want.where("NOT live").select(cols).collect())) and ended
    assert sorted(map(tuple, sessions.open_states(spark, check).select(cols).collect())) == sorted(map(tuple, want.where("live").select(cols).collect()))
    # A write an hour after everyone's last: all sessions are gone, states of the last day are not; a day later these are gone as well.
    for later, left in (("61 minutes", True), ("25 hours", False)):
        end = events.agg(F.max("ts")).first()[0]
        spark.sql(f"SELECT 99L AS user_id, TIMESTAMP '{end}' + INTERVAL {later} AS ts").write.mode("append").parquet(src)
        run_available(sessions.expired(read_events(spark, src), "user_id", "ts"), out, check)
        kinds = {r.kind: r.n for r in sessions.open_states(spark, check).where("user_id <> 99").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert kinds.get("session", 0) == 0 and (kinds.get("state", 0) > 0) == left


def test_timers_need_their_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(RuntimeError, match="RocksDB"):
            sessions.expired(spark.readStream.format("rate").load(), "value", "timestamp")
    finally:
        spark.conf.set(name, before)


# --- profiles --------------------------------------------------------------------------------------------------------------------
PROPOSAL = f"user_id string, session_id string, message string, updates {profiles.UPDATES}, at timestamp"


def fact(category, value, evidence, status="active", field=None):
    return category, field, value, status, evidence


def proposals(spark, rows):
    """(user, session, message, updates, second)"""
    return spark.createDataFrame([(*r[:4], datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=r[4])) for r in rows], PROPOSAL)


TOLD = "I am 52, female; type 2 diabetes was found, I take Metformin now. Penicillin gives me a rash."


def test_stated_facts_are_kept_and_rewritten(spark, tmp_path):
    store = profiles.ProfileStore(spark, str(tmp_path / "p"))
    first = [fact("demographics", "52", "I am 52", field="age"), fact("demographics", "female", "female", field="sex"), fact("conditions", " type 2 diabetes ", "type 2 diabetes was found"), fact("medications", "Metformin", "I take Metformin now"), fact("allergies", "penicillin", "Penicillin gives me a rash")]
    store.merge(proposals(spark, [("u1", "s1", TOLD, first, 0), ("u2", "s1", TOLD, first[2:3], 0)]), 0)
    store.merge(proposals(spark, [("u1", "s2", "they made me stop it", [fact("medications", "met  FORMIN", "made me stop", "stopped")], 60)]), 1)
    got = {(r.category, r.name): (r.place, r.value, r.status, r.source_text) for r in store.of("u1").collect()}
    assert got == {
        ("demographics", "age"): (1, "52", "active", "I am 52"), ("demographics", "sex"): (2, "female", "active", "female"), ("conditions", "type2diabetes"): (1, "type 2 diabetes", "active", "type 2 diabetes was found"),
        ("medications", "metformin"): (1, "met  FORMIN", "stopped", "made me stop"), ("allergies", "penicillin"): (1, "penicillin", "active", "Penicillin gives me a rash"),
    }
    assert store.of("u3").count() == 0 and store.of("u2").count() == 1
    before = sorted(map(tuple, store.read().collect()))
    store.merge(proposals(spark, [("u1", "s2", "they made me stop it", [fact("medications", "met  FORMIN", "made me stop", "stopped")], 60)]), 1)  # a replay
    assert sorted(map(tuple, store.read().collect())) == before
    store.compact()
    assert sorted(map(tuple, store.read().collect())) == before and store.names("facts") == []
    store.merge(proposals(spark, [("u1", "s9", TOLD, first, 0)]), 1)  # a replay of what is folded
    store.compact()
    assert sorted(map(tuple, store.read().collect())) == before
    plan = store.of("u1")._jdf.queryExecution().toString()
    assert "EqualTo(user_key" in plan  # the key reaches the scan


@pytest.mark.parametrize("bad", [
    {"category": "unknown"}, {"category": None}, {"status": "maybe"}, {"value": ""}, {"value": "x" * 161}, {"evidence": ""}, {"evidence": "never said"}, {"field": "age"},
    {"category": "demographics", "field": "age", "value": "121", "evidence": "I am 52"}, {"category": "demographics", "field": "age", "value": "5.2", "evidence": "I am 52"}, {"category": "demographics", "field": "sex", "value": "other", "evidence": "female"},
    {"category": "demographics", "field": None}, {"category": "demographics", "field": "age", "value": "52", "status": "denied", "evidence": "I am 52"},
])
def test_one_bad_fact_refuses_its_batch_and_no_other(spark, bad):
    good = {"category": "medications", "field": None, "value": "Metformin", "status": "active", "evidence": "Metformin"}
    rows = [("u", "s", TOLD, [tuple(good.values()), tuple((good | bad).values())], 0), ("v", "s", TOLD, [tuple(good.values())], 0)]
    assert {r.user_id: r.fault is None for r in profiles.judged(proposals(spark, rows)).collect()} == {"u": False, "v": True}
    assert profiles.facts(proposals(spark, rows)).count() == 1


def test_batches_without_scope_or_facts_are_refused(spark):
    one = [fact("lifestyle", "shifts", "shifts")]
    rows = [(None, "s", "shifts", one, 0), ("u", " ", "shifts", one, 0), ("u", "s", "", one, 0), ("u", "s", "shifts", [], 0), ("u", "s", "shifts", None, 0), ("u", "s", "shifts", one * 21, 0), ("u", "s", "shifts", [None], 0), ("u", "s", "shifts", one * 20, 0)]
    assert [r.fault for r in profiles.judged(proposals(spark, rows)).collect()] == ["user", "session", "message", "updates", "updates", "updates", "category", None]


def test_only_the_last_facts_of_a_category_are_shown(spark, tmp_path):
    store = profiles.ProfileStore(spark, str(tmp_path / "p"))
    rows = [("u", "s", f"fact {i:02}", [fact("lifestyle", f"fact {i:02}", f"fact {i:02}")], i) for i in range(25)] + [("u", "s", "fact 07", [fact("lifestyle", "fact 07", "fact 07", "denied")], 99)]
    store.merge(proposals(spark, rows), 0)
    got = store.of("u").orderBy("place").collect()
    assert [r.value for r in got] == [f"fact {i:02}" for i in range(5, 25)] and [r.value for r in got if r.status == "denied"] == ["fact 07"]


def test_profile_stream_survives_restarts(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "p")
    rows = [(f"u{i % 3}", "s", f"word{i % 4} said", [fact("conditions", f"word{i % 4}", f"word{i % 4}", "active" if i % 5 else "denied")], i) for i in range(30)]
    for lo in (0, 10, 20):
        proposals(spark, rows[lo : lo + 10]).coalesce(1).write.mode("append").parquet(src)
        profiles.keep_profiles(spark.readStream.schema(PROPOSAL).parquet(src), out, str(tmp_path / "check"))
        if lo == 10:
            profiles.ProfileStore(spark, out).compact()
    want = profiles.folded(profiles.facts(proposals(spark, rows)))
    assert sorted(map(tuple, profiles.ProfileStore(spark, out).read().select(want.columns).collect())) == sorted(map(tuple, want.collect()))


# --- reports and events ----------------------------------------------------------------------------------------------------------
RUN = "run string, score int"


def grading(spark, tmp_path, names, **more):
    seen = []

    def grade(rows):
        seen.append(rows)
        return rows.select("run", F.when(F.col("score") > 0, "good").otherwise("bad").alias("status"))

    return progress.Grading(spark, str(tmp_path / "out"), grade, spark.createDataFrame([(n,) for n in names], "run string"), "run", **more)


def arrive(spark, tmp_path, rows):
    spark.createDataFrame(rows, RUN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_reports_come_before_slow_rows_and_once_after_restarts(spark, tmp_path):
    source = lambda: spark.readStream.schema(RUN).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    g = grading(spark, tmp_path, "abcdefgh", every=3)
    arrive(spark, tmp_path, [("a", 1), ("b", 0), ("x", 1)])  # x is not expected
    late = [[("c", 1), ("a", 0)], [("d", 1), ("d", 1), ("e", 0), ("f", 1)], [("g", 1), ("h", 1)]]
    reported = []

    def next_rows(_):
        done = g.done("reports")
        reported.append(0 if done is None else done.select("number").distinct().count())
        arrive(spark, tmp_path, late.pop(0))

    assert g.watch(source, str(tmp_path / "check"), sleep=next_rows) == 8
    assert reported == [0, 1, 2]  # each as soon as it was due
    rows = {(r.reason, r.number, r.total, r.status, r.n) for r in g.done("reports").collect()}
    assert rows == {("progress", 1, 3, "good", 2), ("progress", 1, 3, "bad", 1), ("progress", 2, 6, "good", 4), ("progress", 2, 6, "bad", 2)}
    assert {(r.reason, r.total, r.status, r.n) for r in spark.read.parquet(f"{g.path}/last").collect()} == {("complete", 8, "good", 6), ("complete", 8, "bad", 2)}
    # The last batch again, as after a failure before its commit: nothing counts twice.
    before = sorted(map(tuple, g.done("grades").collect()))
    g.batch(spark.createDataFrame([("g", 1), ("h", 1)], RUN), 3)
    assert sorted(map(tuple, g.done("grades").collect())) == before and g.total() == 8
    assert g.watch(source, str(tmp_path / "check")) == 8
    counts = g.done("counts")
    assert {(r.batch, r.total, r.number) for r in progress.due_reports(counts, "batch", "n", 3).collect()} == {(1, 3, 1), (2, 6, 2)}


def test_deadline_ends_the_watch_and_holds_over_restarts(spark, tmp_path):
    now = [1000.0]
    source = lambda: spark.readStream.schema(RUN).parquet(str(tmp_path / "in"))
    arrive(spark, tmp_path, [("a", 1)])
    for wait in (31, 1):  # the second run is over its time at once: the first one's start counts
        with pytest.raises(TimeoutError, match="1 of 2"):
            grading(spark, tmp_path, "ab", clock=lambda: now[0]).watch(source, str(tmp_path / "check"), seconds=60, sleep=lambda _: now.__setitem__(0, now[0] + wait))
    assert [r.reason for r in spark.read.parquet(str(tmp_path / "out" / "last")).collect()] == ["deadline"]
    arrive(spark, tmp_path, [("b", 0)])
    assert grading(spark, tmp_path, "ab", clock=lambda: now[0]).watch(source, str(tmp_path / "check"), seconds=60) == 2


def test_event_log_reaches_its_subscribers_once(spark, tmp_path):
    schema = "event_id bigint, kind string, source string, targets array<string>"
    log = progress.EventLog(spark, str(tmp_path / "log"), schema)
    got = []
    run = lambda: log.stream("b", ["task"], "a").writeStream.foreachBatch(lambda df, _: got.extend(r.event_id for r in df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    log.publish(spark.createDataFrame([(1, "task", "a", ["b"]), (2, "task", "a", None), (3, "task", "a", ["c", "d"]), (4, "note", "a", ["b"]), (5, "task", "c", ["x", "b"])], schema))
    run()
    assert sorted(got) == [1, 2]
    log.publish(spark.createDataFrame([(6, "task", "a", ["b"])], schema))
    run()
    assert sorted(got) == [1, 2, 6]
    assert sorted(r.event_id for r in log.table("b").collect()) == [1, 2, 4, 5, 6]
    assert "kind" in log.table("b", ["task"])._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:80]
