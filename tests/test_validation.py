"""Nested records: each damage is named; traces end at their horizon and lose private fields; annotation batches are asked once and mended once."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from loamgrid.functions import tokens
from loamgrid.operators import annotation, sampling, validation

CASES = [
    {"case_id": "A", "dataset_version": "v1", "split": "dev", "origin": "public_dataset_adaptation", "source_ids": ["s1"], "suite": "agent", "title": "t", "events": [{"turn": 1, "user_id": "u", "session_id": "s", "text": "hello"}, {"turn": 2, "user_id": "u", "session_id": "s", "text": "more"}]},
    {"case_id": "B", "dataset_version": "v1", "split": "dev", "origin": "written", "source_ids": [], "suite": "component", "title": "t", "events": []},
]
RUBRICS = [{"case_id": "A", "checks": [{"check_id": "c1", "mode": "rubric", "weight": 1, "critical": True, "turn": 1}, {"check_id": "c2", "mode": "trace", "weight": 0.5, "critical": False, "turn": 2}]}, {"case_id": "B", "checks": [{"check_id": "c1", "mode": "exact_set", "weight": 2, "critical": False, "turn": 0}]}]
FIXTURES = [{"case_id": "A", "tool_responses": [{"turn": 1, "match": "any_arguments", "responses": [{"status": "ok", "document_keys": ["d1"]}]}]}, {"case_id": "B", "tool_responses": [], "component_actions": [{"op": "call", "document_keys": ["d2"]}]}]
DOCUMENTS, SOURCES = [{"key": "d1"}, {"key": "d2"}], [{"source_id": "s1"}]


def faults(spark, cases, rubrics, fixtures, documents=DOCUMENTS, sources=SOURCES):
    def table(rows, key):
        return validation.records(spark.createDataFrame([(json.dumps(r),) for r in rows], "line string"), key)

    out = validation.violations(table(cases, "case_id"), table(rubrics, "case_id"), table(fixtures, "case_id"), table(documents, "key"), table(sources, "source_id"), "v1")
    return {(r.id, r.rule, r.path, r.value) for r in out.collect()}


DAMAGES = {
    "repeated id": (lambda c, r, f: c[1].update(case_id="A"), {("A", "repeated id", "cases", "2"), ("B", "no case", "rubrics", None), ("B", "no case", "fixtures", None)}),
    "future check": (lambda c, r, f: r[0]["checks"][0].update(turn=999), {("A", "check turn", "checks[0].turn", "999")}),
    "unknown document": (lambda c, r, f: f[1]["component_actions"][0].update(document_keys=["NONE"]), {("B", "unknown document", "document_keys", "NONE")}),
    "private field": (lambda c, r, f: c[0].update(gold="B"), {("A", "private field", "gold", None)}),
    "version and split": (lambda c, r, f: (c[0].update(dataset_version="v2"), c[1].pop("split")), {("A", "version", "dataset_version", "v2"), ("B", "split", "split", None)}),
    "source": (lambda c, r, f: (c[0].update(source_ids=["s9"]), c[1].update(origin="public_dataset_adaptation")), {("A", "unknown source", "source_ids", "s9"), ("B", "origin", "origin", "public_dataset_adaptation")}),
    "events": (lambda c, r, f: (c[0]["events"][1].update(turn=3, note="x"), c[0]["events"][0].update(text="")), {("A", "turn order", "events[1].turn", "3"), ("A", "event fields", "events[1]", "note,session_id,text,turn,user_id"), ("A", "event value", "events[0].text", "")}),
    "event types": (lambda c, r, f: c[0]["events"][0].update(user_id=7), {("A", "event value", "events[0].user_id", "7")}),
    "checks": (lambda c, r, f: (r[0]["checks"][1].update(mode="guess", weight=0, critical="yes", check_id="c1"), r[1].update(checks=[])), {("A", "mode", "checks[1].mode", "guess"), ("A", "weight", "checks[1].weight", "0"), ("A", "critical", "checks[1].critical", "yes"), ("A", "check ids", "checks", None), ("B", "no checks", "checks", None)}),
    "fixtures": (lambda c, r, f: (f[0]["tool_responses"][0].update(turn=3, match="exact"), f[0]["tool_responses"][0]["responses"][0].update(status="maybe"), f.pop()), {("A", "tool turn", "tool_responses[0].turn", "3"), ("A", "matching", "tool_responses[0].match", "exact"), ("A", "status", "tool_responses.responses.status", "maybe"), ("B", "no fixtures", "fixtures", None)}),
    "same dialogue": (lambda c, r, f: c[1].update(suite="agent", events=copy.deepcopy(c[0]["events"])), {("B", "same dialogue", "events", "A"), ("B", "check turn", "checks[0].turn", "0")}),
}


@pytest.mark.parametrize("damage", ["none", *DAMAGES])
def test_each_damage_is_named_and_nothing_else(spark, damage):
    own = [copy.deepcopy(x) for x in (CASES, RUBRICS, FIXTURES)]
    if damage == "none":
        assert faults(spark, *own) == set()
        return
    change, want = DAMAGES[damage]
    change(*own)
    assert faults(spark, *own) == want


def test_trace_up_to_a_turn(spark):
    trace = [
        {"event": "seed_turn_start"}, {"event": "memory_write", "content": "seeded", "private": 1}, {"event": "turn_start", "turn": 1}, {"event": "retrieval", "query": "q", "patient_facts": ["x"]}, {"event": "chat", "text": "not shown"},
        {"event": "retrieval", "query": "chosen", "phase": "patient_selector"}, {"event": "tool_observation", "role": "judge"}, {"event": "turn_start", "turn": 2}, {"event": "memory_read", "n": 3}, {"event": "memory_read", "turn": 1, "late": True}, {"event": "memory_read", "turn": "1"},
    ]
    rows = spark.createDataFrame([("t", i, json.dumps(e)) for i, e in enumerate(trace)], "trace string, i int, line string").selectExpr("trace", "i", "parse_json(line) AS r")
    got = {r.i: (r.phase, r.turn, json.loads(r.seen)) for r in validation.up_to_turn(rows, 1, hidden_roles=["judge"]).collect()}
    assert got == {1: ("seed", None, {"content": "seeded", "event": "memory_write"}), 3: ("target", 1, {"event": "retrieval", "query": "q"}), 9: ("target", 1, {"event": "memory_read", "late": "true", "turn": "1"})}
    assert {r.i for r in validation.up_to_turn(rows, 2, hidden_roles=["judge"]).collect()} == {1, 3, 8, 9}


# --- annotations -----------------------------------------------------------------------------------------------------------------
def test_known_records_are_not_asked_and_missing_ones_alone_again(spark, tmp_path):
    log = str(tmp_path / "calls")

    def model(text):
        ids = [r["id"] for r in json.loads(text.split("\n\n", 1)[1])]
        with open(log, "a") as f:
            f.write(json.dumps(sorted(ids)) + "\n")
        first = len(ids) > 2  # whole batches come back without b, with c twice and with a stranger
        return [{"id": i, "status": "keep", "text": f"about {i}"} for i in ids if not (first and i == "b")] + ([{"id": "c"}, {"id": "zz"}] if first and "c" in ids else [])

    calls = lambda: [json.loads(x) for x in open(log)]
    rows = spark.createDataFrame([(k, json.dumps({"question": f"q {k}"})) for k in "abcd"], "id string, payload string")
    store = annotation.Annotations(spark, str(tmp_path / "a"), "m1", "Review.\n\n", "{}", model, size=4)
    got = {r.id: json.loads(r.annotation)["text"] for r in store.annotate(rows).collect()}
    assert got == {k: f"about {k}" for k in "abcd"}
    assert calls()[0] == ["a", "b", "c", "d"] and sorted(x for c in calls()[1:] for x in c) == ["b", "c"]
    n = len(calls())
    assert store.annotate(rows.unionAll(rows)).count() == 8 and len(calls()) == n  # nothing is sent again
    more = rows.unionAll(spark.createDataFrame([("e", "{}")], rows.schema))
    assert store.annotate(more).count() == 5 and calls()[n:] == [["e"]]
    other = annotation.Annotations(spark, str(tmp_path / "a"), "m2", "Review.\n\n", "{}", lambda text: [], size=4)
    with pytest.raises(ValueError, match="no answer"):  # another model knows nothing, and this one never answers
        other.annotate(rows)
    assert store.annotate(rows).count() == 4


# --- tokens ----------------------------------------------------------------------------------------------------------------------
def test_token_places_rebuild_the_text(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["First sentence. Second longer sentence here!\n\nA third, naïve one 語 \U0001f600.", "word " * 700 + "end. " + "more " * 30, "", None, "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("k", tokens.tokens(F.col("t"), path))
    rows = df.select("id", "t", "k", F.expr(tokens.token_texts("t", "k")).alias("p"), tokens.decoded(F.transform("k", lambda x: x["id"]), path).alias("d"), tokens.sentence_sizes("t", "k").alias("s")).collect()
    own = tokens.tokenizer(path)
    for r in rows:
        assert (r.k is None) == (r.t is None)
        if r.t:
            e = own.encode(r.t, add_special_tokens=False)
            assert [(x.id, x.start, x.stop) for x in r.k] == [(i, *o) for i, o in zip(e.ids, e.offsets, strict=True)]
            assert "".join(r.p) == r.t == r.d and sum(r.s) == len(r.k)
    assert len(rows[0].s) == 3 and rows[3].s is None
    spans = sampling.spans_of(df.select("id", tokens.sentence_sizes("t", "k").alias("sizes")), "id", "sizes", 64).orderBy("id", "start").collect()
    for r in rows:
        mine = [(x.start, x.stop) for x in spans if x.id == r.id]
        assert [i for a, b in mine for i in range(a, b)] == list(range(len(r.k or []))) and all(b - a <= 64 for a, b in mine)
    got = [(x.id, x.start, x.stop) for x in tokens.token_windows(df, "id", "k").orderBy("id", "start").collect()]
    n = {r.id: len(r.k or []) for r in rows}
    assert got == [(i, a, min(a + 384, n[i])) for i in sorted(n) for a in range(0, n[i], 288) if a == 0 or a + 96 < n[i]]


def test_a_run_sees_named_fields_within_limits(spark):
    good = {"case_id": "A-1", "family_id": "f", "domain": "d", "difficulty": 2, "rubric": "x", "interaction": {"opening": "hi", "max_patient_replies": 1, "scripted_followups": ["a"], "note": "n"}, "private": {"patient_facts": {"age": 5}, "seed_history": [{"messages": [{"role": "user"}, {"role": "assistant"}]}], "environment": "e", "gold": "g"}}
    rows = {"good": good, "replies": copy.deepcopy(good), "text": copy.deepcopy(good), "followups": copy.deepcopy(good), "seed turns": copy.deepcopy(good), "id": copy.deepcopy(good)}
    rows["replies"]["interaction"]["max_patient_replies"] = 4
    rows["text"]["interaction"]["max_patient_replies"] = "1"
    rows["followups"]["interaction"]["scripted_followups"] = ["a"] * 13
    rows["seed turns"]["private"]["seed_history"] *= 25
    rows["id"]["case_id"] = "../x"
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in rows.items()], "id string, line string").selectExpr("id", "parse_json(line) AS r")
    got = {r.id: (r.refused, r.seen and json.loads(r.seen)) for r in validation.execution_view(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {"good": None, "replies": "replies", "text": "replies", "followups": "followups", "seed turns": "seed turns", "id": "id"}
    want = {k: good[k] for k in ("case_id", "family_id", "domain", "difficulty")} | {"interaction": {k: good["interaction"][k] for k in ("opening", "max_patient_replies", "scripted_followups")}} | {k: good["private"][k] for k in ("patient_facts", "seed_history", "environment")}
    assert got["good"][1] == want and all(v[1] is None for k, v in got.items() if k != "good")
