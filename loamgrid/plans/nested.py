"""Nested records, traces and tokens of the test tables: data sets and traces are made of conversations, faults included."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from loamgrid.functions import tokens
from loamgrid.operators import sampling as D
from loamgrid.operators import validation
from loamgrid.plans.bound import query


@query("record_violations", """
WITH e AS (SELECT conv_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations), c AS (SELECT conv_id, count(*) AS n, list(text ORDER BY i) AS said FROM e GROUP BY conv_id),
s AS (SELECT conv_id, min(CAST(conv_id AS VARCHAR)) OVER (PARTITION BY said) AS first FROM c), f AS (
SELECT conv_id, 'version' AS rule, 'dataset_version' AS path, 'v2' AS value FROM c WHERE conv_id % 7 = 3
UNION ALL SELECT conv_id, 'turn order', 'events[' || i || '].turn', CAST(i + 2 AS VARCHAR) FROM e WHERE conv_id % 9 = 4
UNION ALL SELECT conv_id, 'event value', 'events[' || i || '].text', '' FROM e WHERE text = ''
UNION ALL SELECT conv_id, 'mode', 'checks[0].mode', 'guess' FROM c WHERE conv_id % 5 = 2
UNION ALL SELECT conv_id, 'check turn', 'checks[0].turn', CAST(conv_id % 6 AS VARCHAR) FROM c WHERE NOT conv_id % 6 BETWEEN 1 AND n
UNION ALL SELECT conv_id, 'unknown document', 'document_keys', 'd' || conv_id % 60 FROM c WHERE conv_id % 60 NOT IN (SELECT item_id FROM benchmark)
UNION ALL SELECT conv_id, 'same dialogue', 'events', first FROM s WHERE first <> CAST(conv_id AS VARCHAR))
SELECT CAST(conv_id AS VARCHAR) AS id, rule, path, value FROM f""")
def _(t):
    event = F.struct((F.col("i") + F.when(F.col("conv_id") % 9 == 4, 2).otherwise(1)).alias("turn"), F.lit("u").alias("user_id"), F.lit("s").alias("session_id"), F.col("y.text").alias("text"))
    own = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("l"))
    events = own.select("conv_id", F.posexplode("l").alias("i", "y")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", event.alias("e")))).alias("l")).select("conv_id", F.transform("l", lambda x: x["e"]).alias("events"))
    line = lambda df, **fields: validation.records(df.select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("case_id"), *[c.alias(k) for k, c in fields.items()])).alias("line")), "case_id")
    none = F.array().cast("array<string>")
    cases = line(events, dataset_version=F.when(F.col("conv_id") % 7 == 3, "v2").otherwise("v1"), split=F.lit("dev"), origin=F.lit("written"), source_ids=none, suite=F.lit("agent"), events=F.col("events"))
    check = F.struct(F.lit("c").alias("check_id"), F.when(F.col("conv_id") % 5 == 2, "guess").otherwise("rubric").alias("mode"), F.lit(1).alias("weight"), F.lit(True).alias("critical"), (F.col("conv_id") % 6).alias("turn"))
    rubrics = line(events, checks=F.array(check))
    fixtures = line(events, tool_responses=none, component_actions=F.array(F.struct(F.array(F.concat(F.lit("d"), (F.col("conv_id") % 60).cast("string"))).alias("document_keys"))))
    keys = t("benchmark").select(F.concat(F.lit("d"), F.col("item_id").cast("string")).alias("id"))
    return validation.violations(cases, rubrics, fixtures, keys.distinct(), keys.limit(0), "v1")


@query("trace_horizon", """
WITH x AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS began FROM conversations)
SELECT conv_id AS trace, turn AS i, 'memory_read' AS event, 'target' AS phase, began AS turn, '{"event":"memory_read","n":"' || length(coalesce(text, '')) || '"}' AS seen FROM x WHERE role <> 'user' AND began <= 3""")
def _(t):
    start = F.to_json(F.struct(F.lit("turn_start").alias("event"), F.col("turn")))
    read = F.to_json(F.struct(F.lit("memory_read").alias("event"), F.length(F.coalesce("text", F.lit(""))).alias("n"), F.lit("x").alias("private")))
    rows = t("conversations").select(F.col("conv_id").alias("trace"), F.col("turn").alias("i"), F.parse_json(F.when(F.col("role") == "user", start).otherwise(read)).alias("r"))
    return validation.up_to_turn(rows, 3)


def _vocabulary() -> str:
    """A public tokenizer's file; LOAMGRID_TOKENIZERS names another folder."""
    folder = os.environ.get("LOAMGRID_TOKENIZERS")
    if folder:
        return os.path.join(folder, "word_bpe_49k.json")
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("token_spans")
def _(t):
    """Spans of at most 256 tokens that end with sentences where they can: see ``sampling.spans_of``; the tokens of a span are its literal text."""
    x = t("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return D.spans_of(tokens.sentence_token_sizes(x, "doc_id", "t", _vocabulary()), "doc_id", "sizes", 256)
