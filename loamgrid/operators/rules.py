"""Rules over rows: ordered reasons, flags, tables of rules, status ladders and cuts. A null condition is false."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions import text as T

Rules = list[tuple[str, Column]]


def first_reason(rules: Rules, default: str | None = None) -> Column:
    """The name of the first condition that holds."""
    return F.coalesce(*[F.when(c, F.lit(n)) for n, c in rules], F.lit(default))


def reasons(rules: Rules) -> Column:
    """The names of all conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))


def corpus_rejection(title: Column, text: Column) -> Column:
    """Why a page is no prose for a corpus; null for those that are."""
    return first_reason([
        ("short_or_heading", F.size(T.fields(text)) < 25),
        ("ocr_joined_words", text.rlike("[A-Za-z]{35,}")),
        ("question_answer_format", text.rlike(r"(?i)Answer\s*=|Answers to Case|Review Questions|The answer is|Medical (?:image|knowledge) question:")),
        ("editorial_or_index_page", title.rlike(r"(?i)Sandbox:|Image Insertion|^List of|Template:")),
    ])


#: How a question refers to its options, to a case, to a picture (fixed values).
CHOICE = r"(?i)\b(?:which|what)\s+(?:(?:one|of|the)\s+)*following\b|\b(?:above|following)\s+(?:options|choices|statements)\b|\b(?:option|choice)\s+[A-D]\b|\b(?:both|all|none)\s+of\s+the\s+above\b|\b(?:listed|labeled)\s+as\s+[a-d]\b"
CASE = r"(?i)(year[- ]old|\bpatient\b|\bpresents?\b|\bcomplains?\b|\bhistory of\b|\bon examination\b|\bwoman\b|\bman\b|\bchild\b|\binfant\b|\bpregnant\b)"
PICTURE = (
    r"(?i)\b(?:is|are|was|were|been|as|also)\s+(?:shown|depicted|illustrated)\b|\bshown\s+(?:below|in|here)\b|\b(?:figure|fig\.)\s*(?:below|[A-D]\b|\d)|"
    r"\b(?:see|the|following)\s+(?:illustration|photograph|diagram)\b|\b(?:histopath\w*|radiological finding|x\s*-?\s*ray|MRI|CT|karyogram|smear)[^.?!]{0,70}\bgiven below\b|"
    r"\bgiven below is the histopathology\b|\bthis\b[^.?!]{0,70}\bscan\b|\bdepicted on the plate\b|<img\b|!\[[^\]]*\]\("
)
PICTURE_OPTION = r"(?i)image_question|\b(?:figure|image)\s*[A-D1-4]\b"
VISUAL = r"(?i)\b(image|figure|diagram|photograph|shown|illustrated)\b"
OCR = r"(?i)\b(?:aery|aeries|cailage|impoant|transpo|transpos|conveed|hyperspineism|IG1-1|IGI-1GH)\b"


def missing_image(question: Column, options: Column) -> Column:
    return first_reason([("missing_option_image", F.exists(options, lambda x: x.rlike(PICTURE_OPTION))), ("missing_referenced_image", question.rlike(PICTURE))])


def question_rejections(df: DataFrame, known_ids: DataFrame, case: str = CASE) -> DataFrame:
    """Why a question is no knowledge question, for ``id, split, seq, question, exp, options, cop, choice_type``: ``df`` plus ``reason`` (null: kept).

    ``known_ids`` (``id``) are taken already. Of equal questions of a split the first by ``seq`` that nothing else rejects is kept.
    """
    q, e = T.stripped(F.coalesce("question", F.lit(""))), T.stripped(F.coalesce("exp", F.lit("")))
    opts = F.transform("options", lambda x: T.stripped(F.coalesce(x, F.lit(""))))
    label = F.substr(F.lit("ABCD"), F.col("cop") + 1, F.lit(1))
    # A key of null can't match, and an id named twice must not double a row.
    x = df.join(known_ids.select(F.col("id").alias("__known")).where("__known IS NOT NULL").distinct(), F.col("id") == F.col("__known"), "left")
    x = x.withColumn("__r", first_reason([
        ("existing_case_source", F.col("__known").isNotNull()),
        ("outside_single_choice_pilot", ~F.col("choice_type").eqNullSafe("single")),
        ("invalid_question_options_or_label", (q == "") | F.exists(opts, lambda o: o == "") | F.coalesce(~F.col("cop").between(0, 3), F.lit(True))),
        ("case_pattern_not_knowledge_pilot", q.rlike(case)),
        ("missing_image", missing_image(q, opts).isNotNull()),
        ("duplicate_options", F.size(F.array_distinct(F.transform(opts, T.spaced))) != 4),
        ("missing_explanation", e == ""),
        ("insufficient_explanation_before_reference", F.size(T.fields(T.before_references(e))) < 15),
        ("explicit_answer_marker_conflict", T.names_other_option(e, label)),
    ])).withColumn("__key", T.spaced(q))
    first = F.row_number().over(Window.partitionBy("split", "__key", F.col("__r").isNull()).orderBy("seq"))
    return x.withColumn("reason", F.coalesce("__r", F.when(first > 1, "exact_question_duplicate"))).drop("__known", "__r", "__key")


def review_flags(question: Column, options: Column, explanation: Column) -> Column:
    every = F.array_join(options, " ")
    return reasons([
        ("suspected_ocr_tokens", F.concat_ws(" ", question, every, explanation).rlike(OCR)),
        ("explanation_mentions_image", explanation.rlike(r"(?i)\b(?:figure|fig\.|image|diagram|shown below)\b")),
        ("markup_or_encoding", F.concat(question, explanation).rlike("<[^>]+>|�")),
        ("options_required_for_answer", every.rlike(r"(?i)\b(?:all|none|both)\s+(?:of\s+)?(?:the\s+)?(?:above|these)|\b(?:a and b|a & b)\b")),
    ])


def is_case(question: Column, explanation: Column, options: Column, cop: Column, choice_type: Column) -> Column:
    """Whether a question is a usable case vignette."""
    good = [choice_type.eqNullSafe("single"), F.size(T.fields(question)) >= 20, question.rlike(CASE), F.size(T.fields(explanation)) >= 15, F.forall(options, lambda o: o != ""), cop.between(0, 3), missing_image(question, options).isNull()]
    out = good[0]
    for g in good[1:]:
        out = out & F.coalesce(g, F.lit(False))
    return out


def holdout_rejection(seen: Column, choice_type: Column, cop: Column, options: Column, question: Column, explanation: Column, near: Column) -> Column:
    norm = T.spaced(question)
    return first_reason([
        ("prior_local_source_id", seen),
        ("not_single_labeled", ~choice_type.eqNullSafe("single") | F.coalesce(~cop.between(0, 3), F.lit(True))),
        ("missing_option", F.exists(options, lambda o: o.isNull() | (T.stripped(o) == ""))),
        ("duplicate_options", F.size(F.array_distinct(F.transform(options, T.spaced))) != 4),
        ("question_length", (F.length(norm) < 20) | (F.length(question) > 3000)),
        ("possible_missing_visual", question.rlike(VISUAL)),
        ("insufficient_source_explanation", explanation.isNull() | (F.size(T.fields(explanation)) < 8)),
        ("near_question", near),
    ])


def output_violations(outputs: DataFrame, agents: DataFrame, text: str = "output", words: dict[str, list[str]] | None = None) -> DataFrame:
    """``outputs`` (``agent``, text) with ``violations`` and ``fixes``, by the rules of ``agents``: ``agent, disclaimer, max_length, high_risk, cite, no_diagnosis, no_dose``.

    ``words`` names what counts as ``disclaimer``, ``risk``, ``visit``, ``source``, ``diagnosis`` and, as patterns, ``dose``. Agents without rules break none.
    """
    words = words or {}
    t = F.col(text)

    def any_of(kind: str) -> Column:
        found = F.lit(False)
        for w in words.get(kind, ()):
            found = found | F.contains(F.lower(t), F.lit(w.lower()))
        return found

    dose = F.lit(False)
    for p in words.get("dose", ()):
        dose = dose | t.rlike(p)
    x = outputs.join(F.broadcast(agents), "agent", "left")
    no_disclaimer, no_warning = F.col("disclaimer") & ~any_of("disclaimer"), F.col("high_risk") & any_of("risk") & ~any_of("visit")
    broken = reasons([("no_disclaimer", no_disclaimer), ("too_long", F.length(t) > F.col("max_length")), ("no_visit_advised", no_warning), ("no_source", F.col("cite") & ~any_of("source")), ("diagnosis", F.col("no_diagnosis") & any_of("diagnosis")), ("dose", F.col("no_dose") & dose)])
    fixes = reasons([("add_disclaimer", no_disclaimer), ("add_emergency_warning", no_warning)])
    return x.select(*[outputs[c] for c in outputs.columns if c != "agent"], "agent", broken.alias("violations"), fixes.alias("fixes"))


def fixed_output(text: Column, fixes: Column, disclaimer: str, warning: str, most: int | None = None) -> Column:
    """The warning in front, the text cut to ``most``, the disclaimer behind, as the fixes say."""
    body = F.when(F.length(text) > most, F.concat(F.substr(text, F.lit(1), F.lit(most)), F.lit("..."))).otherwise(text) if most else text
    body = F.when(F.array_contains(fixes, "add_emergency_warning"), F.concat(F.lit(warning + "\n\n"), body)).otherwise(body)
    return F.when(F.array_contains(fixes, "add_disclaimer"), F.concat(body, F.lit("\n\n" + disclaimer))).otherwise(body)


def allowed_calls(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """``calls`` (``agent, tool``) with ``allowed``: an agent without a list, or with an empty one, may call all. ``tools``: ``agent, allowed_tools``."""
    x = calls.join(F.broadcast(tools), "agent", "left")
    free = F.coalesce(F.size("allowed_tools") <= 0, F.lit(True)) | F.col("allowed_tools").isNull()
    return x.withColumn("allowed", free | F.coalesce(F.array_contains("allowed_tools", F.col("tool")), F.lit(False))).drop("allowed_tools")


def task_rule(tasks: DataFrame, rules: list[dict]) -> DataFrame:
    """``tasks`` (``question, n_subtasks``) with ``rule`` and ``issue`` (``too_many``, ``too_few``): the first rule one of whose words is in the question decides.

    A rule: ``name``, ``pattern`` (words parted by bars), ``min`` (1 if missing), ``max`` (none if missing).
    """
    hit = [F.exists(F.array(*map(F.lit, r["pattern"].split("|"))), lambda w: F.contains(F.col("question"), w)) for r in rules]
    n, name, issue = F.col("n_subtasks"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, h in reversed(list(zip(rules, hit, strict=True))):
        here = F.when(n > r["max"], "too_many") if r.get("max") else F.when(F.lit(False), "")
        name, issue = F.when(h, r["name"]).otherwise(name), F.when(h, F.coalesce(here, F.when(n < r.get("min", 1), "too_few"))).otherwise(issue)
    return tasks.withColumn("rule", name).withColumn("issue", issue)


def required_agents(question: Column, rules: list[tuple[list[str], list[str]]]) -> Column:
    """Agents, in order of name, that rules (symptom words, agents) demand."""
    parts = [F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(question, w)), F.array(*map(F.lit, agents))).otherwise(F.array().cast("array<string>")) for words, agents in rules]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def resolve_sources(items: DataFrame, review: DataFrame, audit: DataFrame, override: DataFrame) -> DataFrame:
    """``id, accepted, reasons``: an item is accepted where review and audit both pass, or where the override says so. All are keyed by ``id``; the others have ``ok``."""
    x = items.select("id")
    for name, df in (("review", review), ("audit", audit), ("override", override)):
        x = x.join(df.select("id", F.col("ok").alias(name)), "id", "left")
    why = reasons([("review_missing", F.col("review").isNull()), ("review_failed", ~F.col("review")), ("audit_missing", F.col("audit").isNull()), ("audit_failed", ~F.col("audit"))])
    return x.select("id", F.coalesce("override", F.size(why) == 0).alias("accepted"), F.when(F.col("override").isNotNull(), F.array(F.lit("override"))).otherwise(why).alias("reasons"))


def verdict(answerable: Column, refused: Column, supported: Column, complete: Column) -> Column:
    """A judged answer's verdict: refusals are right only where nothing can be answered, and an answer needs support before it can be complete."""
    return F.when(~answerable, F.when(refused, "pass").otherwise("hard_fail")).when(refused, "fail").when(~supported, "hard_fail").when(complete, "pass").otherwise("partial")


def reuse_status(reviewed: Column, train: Column, raw: Column) -> Column:
    """Ladder of evidence: a review, a strong candidate of the training text, one of the raw text. Candidates: array<struct<score, hits, share>>."""

    def strong(c: Column) -> Column:
        return F.exists(c, lambda x: (x["score"] >= 0.18) & (x["hits"] > 0) & (x["share"] >= 0.5))

    return first_reason([("reviewed", reviewed), ("strong_train", strong(train)), ("strong_raw", strong(raw))], "needs_review")


def clipped_text(text: Column, most: int) -> Column:
    return F.struct(F.substr(text, F.lit(1), F.lit(most)).alias("text"), (F.length(text) > most).alias("truncated"))


def budgeted_blocks(blocks: DataFrame, record: str, order: str, text: str, most: int = 8000) -> DataFrame:
    """``blocks`` cut so that a record's texts, in order, take ``most`` code points in all; blocks beyond are dropped. ``cut`` marks shortened ones."""
    before = F.coalesce(F.sum(F.length(text)).over(Window.partitionBy(record).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = blocks.withColumn("__room", F.greatest(F.lit(0), most - before).cast("int")).where("__room > 0")
    return x.withColumn("cut", F.length(text) > F.col("__room")).withColumn(text, F.expr(f"substring(`{text}`, 1, __room)")).drop("__room")


def tool_outcome(result: Column) -> Column:
    """What a tool's JSON result says of itself."""
    get = lambda k: F.get_json_object(result, f"$.{k}")
    some = lambda k: F.coalesce(~get(k).isin("", "false", "0", "null", "[]", "{}"), F.lit(False))
    status = F.coalesce(get("status"), F.lit(""))
    return (
        F.when(result.isNull() | ~F.coalesce(result.rlike(r"^\s*\{"), F.lit(False)), "unknown")
        .when((get("success") == "false") | status.isin("error", "failed") | some("error") | some("error_type"), "failure")
        .when((get("success") == "true") | status.isin("success", "completed", "ok"), "explicit_success")
        .otherwise("returned_without_explicit_status")
    )


def request_group(roles: Column, calibrated: Column, targets: list[str]) -> Column:
    """The cost group of a request by its role; requests of several roles are unknown."""
    role = F.element_at(roles, 1)
    known = F.when(role == "embedding", "embedding").when(calibrated | (role == "probe"), "calibration").when(role.isin(*targets), "target")
    known = known.when(role.isin("patient_selector", "patient_simulator"), "selector").when((role == "rubric_judge") | role.startswith("rubric_judge_"), "judge")
    return F.when(F.size(roles) == 1, known.otherwise("unknown")).otherwise("unknown")


def known_number(value: Column) -> Column:
    """Whether a number is finite and not negative."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")) & (value >= 0), F.lit(False))


def chat_messages(system: str, user: Column, assistant: Column) -> Column:
    pairs = (("system", F.lit(system)), ("user", user), ("assistant", assistant))
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in pairs])


def subscribed(events: DataFrame, listener: str, kinds: list[str] | None = None, source: str | None = None) -> DataFrame:
    """Events (``kind, source, targets``) that a listener gets: broadcast ones (no targets) and those that name it, of the kinds and source asked for."""
    x = events.where(F.col("targets").isNull() | F.array_contains("targets", listener))
    x = x.where(F.col("kind").isin(*kinds)) if kinds else x
    return x.where(F.col("source") == source) if source else x


def of_type(df: DataFrame, metadata: Column, field: str, value: str | None) -> DataFrame:
    """Rows whose JSON metadata has this value in a field; all rows where no value is asked for. Metadata that is no JSON has none."""
    return df if value is None else df.where(F.get_json_object(metadata, f"$.{field}") == value)
