"""Roll-ups of judged answers, ledgers and traces. Nulls are unknown, never zero; keys that are null are one group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(condition: Column) -> Column:
    """The share of rows, in percent, where a condition holds; rows where it is unknown don't count."""
    return F.avg(condition.cast("double")) * 100


def score_100(score: Column) -> Column:
    """The mean of scores from 0 to 2 on a scale to 100; null without any."""
    return F.avg(score) * 50


def joint_score(*scores: Column) -> Column:
    """As ``score_100`` of each row's least score; a row with an unknown score is unknown."""
    known = scores[0].isNotNull()
    for s in scores[1:]:
        known = known & s.isNotNull()
    return F.avg(F.when(known, F.least(*scores))) * 50


def whole_total(value: Column) -> Column:
    """The sum if every value is known and there is one, else null."""
    return F.when((F.count_if(value.isNull()) == 0) & (F.count(F.lit(1)) > 0), F.sum(value))


def distribution(df: DataFrame, keys: list[str], value: str, known: Column | None = None) -> DataFrame:
    """Observed and unknown counts, least, most, mean and interpolated quantiles of the known values of each group."""
    v = F.when(known if known is not None else F.col(value).isNotNull(), F.col(value))
    q = [F.percentile(v, p).alias(n) for p, n in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"))]
    return df.groupBy(*keys).agg(F.count(v).alias("observed"), (F.count(F.lit(1)) - F.count(v)).alias("unknown"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"), *q)


def most_common(df: DataFrame, keys: list[str], value: str, n: int = 5) -> DataFrame:
    """The ``n`` most frequent values of each group; ties by value."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), value))).where(F.col("place") <= n)


def judged_checks(checks: DataFrame, verdicts: DataFrame, judges: int = 2) -> DataFrame:
    """``checks`` (``case_id, check_id, critical, executed``) with ``verdict``, ``disagreement`` and ``any_failed`` from ``verdicts`` (``case_id, check_id, judge, verdict``).

    Judges must agree, else the verdict is uncertain, as it is where one of ``judges`` is missing (``judge_error``); what was not executed has no verdict of theirs.
    """
    # One kind, or two judges, show in the least and the greatest: distinct counts would copy each verdict for each of them.
    n = F.count("judge") if judges < 2 else F.when(F.min("judge") != F.max("judge"), 2).otherwise(F.least(F.count("judge"), F.lit(1))) if judges == 2 else F.size(F.collect_set("judge"))
    kinds = F.when(F.min("verdict") != F.max("verdict"), 2).otherwise(F.least(F.count("verdict"), F.lit(1)))
    got = verdicts.groupBy("case_id", "check_id").agg(n.alias("__n"), kinds.alias("__kinds"), F.min("verdict").alias("__v"), F.count_if(F.col("verdict") == "fail").alias("__f"))
    x = checks.join(got, ["case_id", "check_id"], "left")
    whole = F.coalesce(F.col("__n") >= judges, F.lit(False))
    v = F.when(~F.col("executed"), "not_executed").when(whole & (F.col("__kinds") == 1), F.col("__v")).otherwise("uncertain")
    return x.withColumn("verdict", v).withColumn("disagreement", whole & (F.col("__kinds") > 1)).withColumn("any_failed", F.coalesce(F.col("__f") > 0, F.lit(False))).withColumn("judge_error", F.col("executed") & ~whole).drop("__n", "__kinds", "__v", "__f")


def case_rollup(checks: DataFrame) -> DataFrame:
    """Per case of ``judged_checks``: its status (a judge's failure is no failure of the case), whether all applicable checks passed (there must be one), critical failures, disagreements."""
    applies = F.col("verdict") != "not_applicable"
    n = F.count_if(applies)
    return checks.groupBy("case_id").agg(
        F.when(F.bool_or("judge_error"), "judge_error").otherwise("graded").alias("status"),
        n.alias("applicable"),
        ((n > 0) & (n == F.count_if(F.col("verdict") == "pass"))).alias("all_passed"),
        F.bool_or(F.col("critical") & F.col("any_failed")).alias("critical_failed_any"),
        F.bool_or(F.col("critical") & (F.col("verdict") == "fail")).alias("critical_failed_both"),
        F.count_if("disagreement").alias("disagreements"),
    )


def attempts(df: DataFrame, run: str, order: list[str], status: str) -> DataFrame:
    """Per run: attempts, status of the first and the last, whether a retry was needed and succeeded."""
    o = F.struct(*order)
    x = df.groupBy(run).agg(F.count(F.lit(1)).alias("attempts"), F.min_by(status, o).alias("first_status"), F.max_by(status, o).alias("last_status"))
    return x.withColumn("recovered", (F.col("first_status") != "ok") & (F.col("last_status") == "ok"))


def numbered_attempts(df: DataFrame, run: str, order: list[str]) -> DataFrame:
    return df.withColumn("attempt", F.row_number().over(Window.partitionBy(run).orderBy(*order)))


def ledger_conflicts(df: DataFrame, request: str, amount: str, kind: str) -> DataFrame:
    """One row per request: its amount and kind, both unknown where entries contradict each other."""
    x = df.groupBy(request).agg(F.count_distinct(amount).alias("a"), F.count_distinct(kind).alias("k"), F.min(amount).alias("amount"), F.min(kind).alias("kind"), F.count(F.lit(1)).alias("entries"))
    clash = (F.col("a") > 1) | (F.col("k") > 1)
    return x.select(request, "entries", clash.alias("conflict"), F.when(~clash, F.col("amount")).alias("amount"), F.when(clash, "unknown").otherwise(F.coalesce("kind", F.lit("unknown"))).alias("kind"))


def cost_summary(df: DataFrame, keys: list[str], kinds: list[str]) -> DataFrame:
    """Of ``ledger_conflicts``: known amounts by kind, their subtotal, and the total, which is null where any request is unknown."""
    parts = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("amount"))), F.lit(0.0)) for k in kinds]
    subtotal = parts[0]
    for p in parts[1:]:
        subtotal = subtotal + p
    unknown = F.count_if(~F.col("kind").isin(*kinds) | F.col("amount").isNull())
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), unknown.alias("unknown_requests"), *[p.alias(k) for p, k in zip(parts, kinds, strict=True)], subtotal.alias("subtotal"), F.when(unknown == 0, subtotal).alias("total"))


def once_by_response(df: DataFrame, response: str, order: list[str]) -> DataFrame:
    """The first row of each response: its cost counts once, however often it is used."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(response).orderBy(*order))).where("__n = 1").drop("__n")


def agreement(df: DataFrame, question: str, a: str, b: str, top: int = 2) -> DataFrame:
    """Exact and binary agreement, mean absolute error and bias of two scores: means per question, then over questions."""
    x, y = F.col(a), F.col(b)
    top_a, top_b = (x == top).cast("double"), (y == top).cast("double")
    per = df.groupBy(question).agg(F.avg((x == y).cast("double")).alias("exact"), F.avg((top_a == top_b).cast("double")).alias("binary"), F.avg(F.abs(x - y).cast("double")).alias("mae"), F.avg(top_b - top_a).alias("bias"))
    return per.agg(F.count(F.lit(1)).alias("questions"), *[F.avg(c).alias(c) for c in ("exact", "binary", "mae", "bias")])


def balanced_composite(df: DataFrame, label: str, predicted: str, stability: str, conflict: str) -> DataFrame:
    """Agreement on positives and on negatives, their mean, and with stability and conflicts the composite."""
    pos, neg = F.avg(F.when(F.col(label), F.col(predicted).cast("double"))), F.avg(F.when(~F.col(label), (~F.col(predicted)).cast("double")))
    x = df.agg(pos.alias("positive"), neg.alias("negative"), F.avg(stability).alias("stability"), F.avg(conflict).alias("conflict"))
    x = x.withColumn("balanced", (F.col("positive") + F.col("negative")) / 2)
    return x.withColumn("composite", (F.col("balanced") + F.col("stability")) / 2 - 0.25 * F.col("conflict"))


def score_conflicts(df: DataFrame, question: str, answer_key: Column, score: str) -> DataFrame:
    """Equal answers to a question that were scored differently."""
    x = df.groupBy(question, answer_key.alias("answer_key")).agg(F.count(F.lit(1)).alias("n"), F.min(score).alias("low"), F.max(score).alias("high"))
    return x.where("low <> high")


def family_states(df: DataFrame, keys: list[str], family: str, correct: str, variants: int = 2) -> DataFrame:
    """Per family: ``state`` (``both_correct``, ``both_wrong``, ``mixed``) where all variants are there, else ``incomplete``."""
    n, good = F.count(correct), F.count_if(correct)
    state = F.when(n < variants, "incomplete").when(good == n, "both_correct").when(good == 0, "both_wrong").otherwise("mixed")
    return df.groupBy(*keys, family).agg(state.alias("state"))


def state_transitions(before: DataFrame, after: DataFrame, family: str) -> DataFrame:
    """Families by their state in two arms, with what share of the first state kept it is left to the reader: counts."""
    x = before.select(family, F.col("state").alias("before")).join(after.select(family, F.col("state").alias("after")), family)
    return x.groupBy("before", "after").agg(F.count(F.lit(1)).alias("families"))


def rescue_rate(df: DataFrame, keys: list[str], closed: str, helped: str) -> DataFrame:
    """Of the items wrong without evidence, the share that is right with it; null without any."""
    wrong, saved = F.count_if(~F.col(closed)), F.count_if(~F.col(closed) & F.col(helped))
    return df.groupBy(*keys).agg(wrong.alias("closed_wrong"), saved.alias("rescued"), F.when(wrong > 0, saved / wrong).alias("rate"))


def fact_category(pairs: Column) -> Column:
    """What an item's facts show, each an array of the scores (0 to 2) of its wordings."""
    right, wrong = (lambda p: F.forall(p, lambda s: s == 2)), (lambda p: F.forall(p, lambda s: s == 0))
    return (
        F.when(pairs.isNull() | (F.size(pairs) <= 0), "no_valid_probes").when(F.forall(pairs, right), "all_probed_facts_correct").when(F.forall(pairs, wrong), "all_probed_facts_wrong")
        .when(F.exists(pairs, wrong), "some_facts_consistently_wrong").otherwise("partial_or_wording_sensitive")
    )


def round_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of ``valid, answer_score, reasoning_score, format_score, ended, tokens``: rates over all samples, those that can't be judged included."""
    valid = F.col("valid")
    rate = lambda c: F.sum(c.cast("double")) / F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), rate(valid & (F.col("answer_score") == 2)).alias("answer_accuracy"), rate(valid & (F.col("reasoning_score") == 2)).alias("reasoning_accuracy"),
        rate(valid & (F.least("answer_score", "reasoning_score") == 2)).alias("joint_accuracy"), F.count_if(~valid).alias("unjudgeable"), rate(F.col("format_score")).alias("format_rate"),
        rate(~F.col("ended")).alias("truncation_rate"), rate(F.col("tokens")).alias("mean_tokens"),
    )


def sample_rollup(df: DataFrame, item: str, correct: str, reward: str) -> DataFrame:
    """k samples an item: any, majority (of the judged), all wrong, unjudgeable (none judged), and whether rewards differ."""
    n, good = F.count(correct), F.count_if(correct)
    return df.groupBy(item).agg((good > 0).alias("any_correct"), (2 * good > n).alias("majority"), ((n > 0) & (good == 0)).alias("all_wrong"), (n == 0).alias("unjudgeable"), (F.min(reward) < F.max(reward)).alias("rewards_differ"))


def loss_bucket(final: Column, reasoning: Column) -> Column:
    return F.when(final == 0, "final_wrong").when(final == 1, "final_partial").when(reasoning < 2, "reasoning_fault").otherwise("fully_correct")


def assessable_rate(df: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Rows where a flag is set, rows where it is known, and the rate among these."""
    n, known = F.count_if(F.col(flag)), F.count(flag)
    return df.groupBy(*keys).agg(n.alias("n"), known.alias("assessable"), F.when(known > 0, n / known).alias("rate"))


def stop_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of ``stop_reason, tokens``: truncation, mean and most tokens, and counts by reason as a sorted text."""
    per = df.groupBy(*keys, F.coalesce("stop_reason", F.lit("unknown")).alias("r")).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), F.max("tokens").alias("m"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "n"))), lambda x: F.concat_ws("=", x["r"], x["n"].cast("string"))), ",")
    return per.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("r") == "length", F.col("n")).otherwise(0)) / F.sum("n")).alias("truncated"), (F.sum("t") / F.sum("n")).alias("mean_tokens"), F.max("m").alias("most_tokens"), listed.alias("reasons"))


def plan_coverage(plan: DataFrame, done: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Planned runs, those done, and the share; what was done without a plan is not counted."""
    x = plan.join(done.select(*keys).distinct().withColumn("__done", F.lit(True)), keys, "left")
    n = F.count_if(F.col("__done"))
    return x.groupBy(*by).agg(F.count(F.lit(1)).alias("planned"), n.alias("completed"), (n / F.count(F.lit(1))).alias("share"))


def speed_up(df: DataFrame, arm: str, base: str, new: str, seconds: str) -> DataFrame:
    """Mean seconds of two arms, their ratio and the reduction in percent."""
    a, b = F.avg(F.when(F.col(arm) == base, F.col(seconds))), F.avg(F.when(F.col(arm) == new, F.col(seconds)))
    return df.agg(a.alias("base_mean"), b.alias("new_mean")).withColumn("speed_up", F.col("base_mean") / F.col("new_mean")).withColumn("reduction_pct", 100 * (1 - F.col("new_mean") / F.col("base_mean")))


def trace_metrics(events: DataFrame, trace: str, advertised: list[str]) -> DataFrame:
    """Per trace of ``event, tool, tokens, cost, chars``: requests, tool calls, calls of tools that were not advertised, tokens, whole cost, body characters."""
    req, call = F.col("event") == "request", F.col("event") == "tool"
    return events.groupBy(trace).agg(
        F.count_if(req).alias("requests"), F.count_if(call).alias("tool_calls"), F.count_if(call & ~F.col("tool").isin(*advertised)).alias("unadvertised"),
        F.sum(F.when(req, F.col("tokens"))).alias("tokens"), F.when(F.count_if(req & F.col("cost").isNull()) == 0, F.sum(F.when(req, F.col("cost")))).alias("cost"), F.sum(F.when(call, F.col("chars"))).alias("body_chars"),
    )


def changed_outcomes(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(~F.col(a).eqNullSafe(F.col(b)))


def supported_facts(df: DataFrame, keys: list[str], facts: str, hard_negative: str, returned: str) -> DataFrame:
    """Rows whose facts (there must be one) are all supported, and hard negatives for which nothing came back, among their kind."""
    neg = F.col(hard_negative)
    good = ~neg & (F.size(facts) > 0) & F.forall(facts, lambda f: f)
    return df.groupBy(*keys).agg(F.count_if(~neg).alias("positives"), F.count_if(good).alias("supported"), F.count_if(neg).alias("negatives"), F.count_if(neg & (F.col(returned) == 0)).alias("negatives_empty"))


def disagreement_by_stratum(df: DataFrame, stratum: str, selection: str, differs: str) -> DataFrame:
    """Audited rows and disagreements by stratum, and by stratum and selection ('all' for the former)."""
    x = df.groupingSets([(F.col(stratum),), (F.col(stratum), F.col(selection))], stratum, selection)
    return x.agg(F.count(F.lit(1)).alias("n"), F.count_if(differs).alias("disagreements"), F.grouping_id().alias("__g")).withColumn(selection, F.when(F.col("__g") > 0, "all").otherwise(F.col(selection))).drop("__g")


def repetition_summary(runs: DataFrame, queries: DataFrame, anchors: list[str]) -> DataFrame:
    """``repetition, scenarios, completed, positive, negative, negative_empty`` and ``<anchor>_hits`` of each repetition, none left out: ``runs`` (``repetition, scenario, status``), ``queries`` (``repetition, scenario, query,
    required, expect_empty, n_returned`` and an ``array<boolean>`` for each of ``anchors``).

    Only queries of completed scenarios count. A query is positive if it requires terms; it hits if all of its anchors are found. A negative one expects nothing.
    """
    done = runs.where("status = 'completed'").select("repetition", "scenario")
    x = queries.join(done, ["repetition", "scenario"], "left_semi")
    hits = [F.count_if(F.col("required") & F.forall(a, lambda v: F.coalesce(v, F.lit(False)))).alias(f"{a}_hits") for a in anchors]
    q = x.groupBy("repetition").agg(F.count_if("required").alias("positive"), *hits, F.count_if("expect_empty").alias("negative"), F.count_if(F.col("expect_empty") & (F.col("n_returned") == 0)).alias("negative_empty"))
    own = runs.groupBy("repetition").agg(F.count(F.lit(1)).alias("scenarios"), F.count_if(F.col("status") == "completed").alias("completed"))
    counts = [c for c in q.columns if c != "repetition"]
    return own.join(q, "repetition", "left").select("repetition", "scenarios", "completed", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def observations(runs: DataFrame, queries: DataFrame, columns: list[str]) -> DataFrame:
    """``scenario, query, runs``: every completed run of a query side by side, in the order of repetitions; ``runs`` holds ``repetition`` and ``columns``. A query has as many as there are repetitions."""
    done = runs.where("status = 'completed'").select("repetition", "scenario")
    return queries.join(done, ["repetition", "scenario"], "left_semi").groupBy("scenario", "query").agg(F.array_sort(F.collect_list(F.struct("repetition", *columns))).alias("runs"))
