"""Checks of nested records that come as JSON: every fault is a row (record, rule, path, value), and what of a trace may be seen up to a turn.

Records are VARIANT columns, so rules read paths without a schema and a record of any shape is judged, not refused by the reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the data set's rules.
MODES = ["exact_set", "rubric", "trace", "exact_metrics"]
PRIVATE_FIELDS = ["answer", "gold", "checks", "initial_state", "record"]
EVENT_FIELDS = ["turn", "user_id", "session_id", "text"]
STATUSES = ["ok", "error"]
ADAPTED = "public_dataset_adaptation"
#: Kinds of trace events that a judge may see, fields that he may not, and roles whose events are not the system's.
SEEN_EVENTS = ["tool_observation", "retrieval", "memory_read", "memory_write", "memory_search", "memory_add", "memory_snapshot", "memory_settle", "memory_error", "profile_snapshot", "permission_denied", "event_memory_read", "event_memory_write", "retrieval_error", "mem0_operation", "memory_write_suppressed", "memory_fixture", "live_fixture_records_not_injected"]
HIDDEN_FIELDS = ["payload", "messages", "patient_facts", "checkpoints", "seed_history", "scripted_followups", "private"]
SEEDS = ["seed", "seed_fixture"]

FAULT = "array<struct<rule:string,path:string,value:string>>"


def records(lines: DataFrame, key: str, column: str = "line") -> DataFrame:
    """``id, r`` from JSON texts: the record as VARIANT and its key. Texts that are no JSON are an error."""
    return lines.select(F.parse_json(column).alias("r")).select(F.expr(f"try_variant_get(r, '$.{key}', 'string') AS id"), "r")


def listed(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def fault(when: str, rule: str, path: str, value: str) -> str:
    """SQL: one fault in a list, or an empty list; a condition that is null is a fault, too."""
    return f"IF(coalesce({when}, true), array(named_struct('rule', '{rule}', 'path', {path}, 'value', CAST({value} AS string))), CAST(array() AS {FAULT}))"


def every(items: str, *faults: str) -> str:
    """SQL: the faults of all items of a list; ``x`` is the item, ``i`` its place."""
    return f"flatten(transform({items}, (x, i) -> concat({', '.join(faults)})))"


def items(at: str, source: str = "r") -> str:
    return f"coalesce(try_variant_get({source}, '{at}', 'array<variant>'), CAST(array() AS array<variant>))"


def get(at: str, kind: str = "string", source: str = "r") -> str:
    return f"try_variant_get({source}, '{at}', '{kind}')"


def keys(source: str) -> str:
    return f"coalesce(map_keys(try_cast({source} AS map<string, variant>)), array(''))"


CASE_RULES = [
    fault(f"{get('$.dataset_version')} IS DISTINCT FROM version", "version", "'dataset_version'", get("$.dataset_version")),
    fault(f"{get('$.split')} IS DISTINCT FROM 'dev'", "split", "'split'", get("$.split")),
    fault(f"(size({items('$.source_ids')}) > 0) <> ({get('$.origin')} <=> '{ADAPTED}')", "origin", "'origin'", get("$.origin")),
    every(f"array_intersect({keys('r')}, array({listed(PRIVATE_FIELDS)}))", fault("true", "private field", "x", "NULL")),
    fault(f"(size({items('$.events')}) > 0) <> ({get('$.suite')} IS DISTINCT FROM 'component')", "events", "'events'", get("$.suite")),
    every(
        items("$.events"),
        fault(f"{get('$.turn', 'int', 'x')} <> i + 1", "turn order", "concat('events[', i, '].turn')", get("$.turn", "string", "x")),
        fault(f"array_sort({keys('x')}) <> array_sort(array({listed(EVENT_FIELDS)}))", "event fields", "concat('events[', i, ']')", f"array_join(array_sort({keys('x')}), ',')"),
        *[fault(f"schema_of_variant(variant_get(x, '$.{f}')) <> 'STRING' OR {get(f'$.{f}', 'string', 'x')} = ''", "event value", f"concat('events[', i, '].{f}')", get(f"$.{f}", "string", "x")) for f in EVENT_FIELDS[1:]],
    ),
]
CHECK_RULES = [
    fault(f"size({items('$.checks')}) = 0", "no checks", "'checks'", "NULL"),
    every(
        items("$.checks"),
        fault(f"{get('$.mode', 'string', 'x')} NOT IN ({listed(MODES)})", "mode", "concat('checks[', i, '].mode')", get("$.mode", "string", "x")),
        fault(f"{get('$.weight', 'double', 'x')} <= 0", "weight", "concat('checks[', i, '].weight')", get("$.weight", "string", "x")),
        fault("schema_of_variant(variant_get(x, '$.critical')) <> 'BOOLEAN'", "critical", "concat('checks[', i, '].critical')", get("$.critical", "string", "x")),
        fault(f"NOT ({get('$.turn', 'int', 'x')} BETWEEN IF(n_events = 0, 0, 1) AND n_events)", "check turn", "concat('checks[', i, '].turn')", get("$.turn", "string", "x")),
    ),
    fault(f"size(array_distinct(transform({items('$.checks')}, x -> {get('$.check_id', 'string', 'x')}))) <> size({items('$.checks')})", "check ids", "'checks'", "NULL"),
]
FIXTURE_RULES = [
    every(
        items("$.tool_responses"),
        fault(f"NOT ({get('$.turn', 'int', 'x')} BETWEEN 1 AND n_events)", "tool turn", "concat('tool_responses[', i, '].turn')", get("$.turn", "string", "x")),
        fault(f"{get('$.match', 'string', 'x')} <> 'any_arguments'", "matching", "concat('tool_responses[', i, '].match')", get("$.match", "string", "x")),
        fault(f"size({items('$.responses', 'x')}) = 0", "no responses", "concat('tool_responses[', i, '].responses')", "NULL"),
        f"flatten(transform({items('$.responses', 'x')}, (y, j) -> {fault(get('$.status', 'string', 'y') + f' NOT IN ({listed(STATUSES)})', 'status', chr(39) + 'tool_responses.responses.status' + chr(39), get('$.status', 'string', 'y'))}))",
    ),
]


def violations(cases: DataFrame, rubrics: DataFrame, fixtures: DataFrame, documents: DataFrame, sources: DataFrame, version: str) -> DataFrame:
    """``id, rule, path, value``: all faults of a data set of ``records``: those of the records themselves, ids that repeat or that one table lacks, references to unknown sources and
    documents, dialogues that two cases share. An empty result: the data set is valid.

    Each table is read once for its own rules; references are exploded and joined, so no list of keys is carried along.
    """
    n = F.expr(f"size({items('$.events')})").alias("n_events")
    found = cases.withColumn("version", F.lit(version)).select("id", F.expr(f"concat({', '.join(CASE_RULES)})").alias("f"))
    sized = cases.select("id", n).dropDuplicates(["id"])
    for table, rules in ((rubrics, CHECK_RULES), (fixtures, FIXTURE_RULES)):
        found = found.unionAll(table.join(sized, "id", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0))).select("id", F.expr(f"concat({', '.join(rules)})").alias("f")))
    out = found.select("id", F.explode("f").alias("f")).select("id", "f.rule", "f.path", "f.value")
    one = lambda df, rule, path, value: df.select("id", F.lit(rule).alias("rule"), F.lit(path).alias("path"), value.cast("string").alias("value"))
    for name, table in (("cases", cases), ("rubrics", rubrics), ("fixtures", fixtures), ("documents", documents), ("sources", sources)):
        out = out.unionAll(one(table.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL"), "repeated id", name, F.col("n")))
    for name, table in (("rubrics", rubrics), ("fixtures", fixtures)):
        for rule, a, b in ((f"no {name}", cases, table), ("no case", table, cases)):
            out = out.unionAll(one(a.select("id").join(b.select("id"), "id", "left_anti").distinct(), rule, name, F.lit(None)))
    used = cases.select("id", F.explode(F.expr(items("$.source_ids"))).alias("v")).select("id", F.col("v").cast("string").alias("k"))
    out = out.unionAll(one(used.join(sources.select(F.col("id").alias("k")), "k", "left_anti"), "unknown source", "source_ids", F.col("k")))
    answers = f"flatten(transform({items('$.tool_responses')}, x -> flatten(transform({items('$.responses', 'x')}, y -> {items('$.document_keys', 'y')}))))"
    actions = f"flatten(transform({items('$.component_actions')}, x -> {items('$.document_keys', 'x')}))"
    asked = fixtures.select("id", F.explode(F.expr(f"concat({answers}, {actions})")).alias("v")).select("id", F.col("v").cast("string").alias("k"))
    out = out.unionAll(one(asked.join(documents.select(F.col("id").alias("k")), "k", "left_anti"), "unknown document", "document_keys", F.col("k")))
    said = cases.select("id", F.expr(f"transform({items('$.events')}, x -> {get('$.text', 'string', 'x')})").alias("t")).where("size(t) > 0").groupBy(F.sha2(F.to_json("t"), 256).alias("h")).agg(F.min("id").alias("first"), F.collect_set("id").alias("ids")).where("size(ids) > 1")
    twice = said.select("first", F.explode("ids").alias("id")).where("id <> first")
    return out.unionAll(one(twice, "same dialogue", "events", F.col("first")))


def up_to_turn(events: DataFrame, horizon: int, trace: str = "trace", order: str = "i", column: str = "r", hidden_roles: list[str] | None = None) -> DataFrame:
    """``trace, order, event, phase, turn, seen``: what a judge of a trace (VARIANT events in order) may see up to a turn: events of some kinds, without private fields, as JSON with sorted keys.

    Phase and turn are an event's own, or those of the last turn start before it; seed events have no turn and are always seen. Events without a whole-number turn are not.
    """
    event = F.expr(f"coalesce(try_variant_get({column}, '$.event', 'string'), '')")
    own = lambda f, kind: F.expr(f"try_variant_get({column}, '$.{f}', '{kind}')")
    starts = F.when(event == "seed_turn_start", F.struct(F.lit("seed").alias("p"), F.lit(None).cast("bigint").alias("t"))).when(event == "turn_start", F.struct(F.coalesce(own("phase", "string"), F.lit("target")).alias("p"), own("turn", "bigint").alias("t")))
    w = Window.partitionBy(trace).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = events.withColumn("event", event).withColumn("at", F.last(starts, ignorenulls=True).over(w))
    whole = F.expr(f"schema_of_variant(variant_get({column}, '$.turn')) IN ('BIGINT', 'DECIMAL(1,0)')")
    x = x.withColumn("phase", F.coalesce(own("phase", "string"), "at.p")).withColumn("turn", F.when(F.expr(f"variant_get({column}, '$.turn') IS NOT NULL"), F.when(whole, own("turn", "bigint"))).otherwise(F.col("at.t")))
    x = x.where(F.col("event").isin(*SEEN_EVENTS) & F.coalesce(F.col("phase") != "patient_selector", F.lit(True)) & (F.coalesce(F.col("phase").isin(*SEEDS), F.lit(False)) | F.coalesce(F.col("turn") <= horizon, F.lit(False))))
    if hidden_roles:
        x = x.where(~F.coalesce(own("role", "string").isin(*hidden_roles), F.lit(False)))
    kept = F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(F.col(column).cast("map<string,variant>").cast("map<string,string>"), lambda k, v: ~k.isin(*HIDDEN_FIELDS))), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1)))
    return x.select(trace, order, "event", "phase", "turn", F.to_json(kept).alias("seen"))



#: Limits of a case that may be run (fixed values); its fields that the run may see are named in ``execution_view``.
MOST_REPLIES, MOST_FOLLOWUPS, MOST_SEED_TURNS = 3, 12, 24


def execution_view(cases: DataFrame, most_replies: int = MOST_REPLIES, most_followups: int = MOST_FOLLOWUPS, most_seed_turns: int = MOST_SEED_TURNS) -> DataFrame:
    """``id, refused, seen``: what a run may see of a case (VARIANT ``r``), as JSON, or why it must not run (null ``seen``): its reply limit, follow-ups, seed turns or id are out of bounds.
    Fields that are not named here never pass, whatever a record holds."""
    replies = "try_variant_get(r, '$.interaction.max_patient_replies', 'int')"
    users = f"size(filter(flatten(transform({items('$.private.seed_history')}, h -> {items('$.messages', 'h')})), m -> {get('$.role', 'string', 'm')} = 'user'))"
    whole = "schema_of_variant(variant_get(r, '$.interaction.max_patient_replies')) = 'BIGINT'"
    refused = f"""CASE WHEN NOT coalesce({whole} AND {replies} BETWEEN 0 AND {most_replies}, false) THEN 'replies' WHEN size({items('$.interaction.scripted_followups')}) > {most_followups} THEN 'followups'
WHEN {users} > {most_seed_turns} THEN 'seed turns' WHEN NOT coalesce({get('$.case_id')} RLIKE '^[A-Za-z0-9_-]+$', false) THEN 'id' END"""
    part = lambda path: f"variant_get(r, '{path}')"
    seen = f"""to_json(named_struct({', '.join(f"'{k}', {part('$.' + k)}" for k in ('case_id', 'family_id', 'domain', 'difficulty'))}, 'interaction', named_struct({', '.join(f"'{k}', {part('$.interaction.' + k)}" for k in ('opening', 'max_patient_replies', 'scripted_followups'))}),
'patient_facts', {part('$.private.patient_facts')}, 'seed_history', {part('$.private.seed_history')}, 'environment', {part('$.private.environment')}))"""
    return cases.withColumn("refused", F.expr(refused)).select("id", "refused", F.expr(f"IF(refused IS NULL, {seen}, NULL)").alias("seen"))
