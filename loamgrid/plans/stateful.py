"""Table forms of the streams with state, each with SQL from its definition; the streams themselves are tested against these."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.plans.bound import query
from loamgrid.streaming import profiles, progress, sessions


@query("session_lifetimes", """
WITH k AS (SELECT unnest([{'kind': 'session', 'ttl': INTERVAL 1 HOUR}, {'kind': 'state', 'ttl': INTERVAL 24 HOUR}]) AS k), e AS (SELECT user_id, ts, k.kind AS kind, k.ttl AS ttl FROM events, k WHERE ts IS NOT NULL AND user_id IS NOT NULL),
b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id, kind ORDER BY ts) < ttl THEN 0 ELSE 1 END AS fresh FROM e), i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, kind ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT user_id, kind, min(ts) AS start, max(ts) AS last, count(*) AS writes, max(ts) + max(ttl) > (SELECT max(ts) FROM events) AS live FROM i GROUP BY user_id, kind, run""")
def _(t):
    out = sessions.lifetimes(t("events"), "user_id", "ts")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "last")})


#: Each user message proposes its first and last word, with its first and last twelve characters as evidence; every seventh character count gives evidence that nobody said.
TOLD = r"""WITH m AS (SELECT conv_id, turn, text, trim(regexp_extract(text, '^[^ \n]+')) AS w1, trim(regexp_extract(text, '[^ \n]+$')) AS w2, substr(text, 1, 12) AS e1,
  CASE WHEN length(text) % 7 = 0 THEN '(unsaid)' ELSE substr(text, length(text) - 11) END AS e2 FROM conversations WHERE role = 'user' AND trim(coalesce(text, '')) <> ''),
p AS (SELECT conv_id, turn, unnest([{'seq': 0, 'c': 'conditions', 'v': w1, 'e': e1}, {'seq': 1, 'c': 'medications', 'v': w2, 'e': e2}]) AS f, text FROM m),
ok AS (SELECT conv_id, turn FROM p GROUP BY conv_id, turn HAVING bool_and(trim(f.v) <> '' AND length(f.v) <= 160 AND trim(f.e) <> '' AND strpos(text, f.e) > 0)),
f AS (SELECT sha256(CAST(conv_id AS VARCHAR)) AS user_key, f.c AS category, lower(regexp_replace(f.v, '\s+', '', 'g')) AS name, f.v AS value, f.e AS source_text, turn, f.seq AS seq FROM p JOIN ok USING (conv_id, turn)),
g AS (SELECT user_key, category, name, max_by(value, [turn, seq]) AS value, max_by(source_text, [turn, seq]) AS source_text, min([turn, seq]) AS born FROM f GROUP BY ALL)"""


@query("profile_contexts", TOLD + """
SELECT user_key, category, name, row_number() OVER (PARTITION BY user_key, category ORDER BY born, name) AS place, value, 'active' AS status, 'user_reported' AS source, source_text
FROM (SELECT *, row_number() OVER (PARTITION BY user_key, category ORDER BY born DESC, name DESC) AS r FROM g) x WHERE r <= 20""")
def _(t):
    said = t("conversations").where("role = 'user' AND trim(coalesce(text, '')) <> ''")
    fact = "named_struct('category', '{}', 'field', CAST(NULL AS string), 'value', trim(regexp_extract(text, '{}', 0)), 'status', 'active', 'evidence', {})"
    first, last = fact.format("conditions", "^[^ \\\\n]+", "substring(text, 1, 12)"), fact.format("medications", "[^ \\\\n]+$", "IF(length(text) % 7 = 0, '(unsaid)', substring(text, length(text) - 11))")
    proposed = said.selectExpr("CAST(conv_id AS string) AS user_id", "'s' AS session_id", "text AS message", f"array({first}, {last}) AS updates", "timestamp_seconds(turn) AS at")
    return profiles.contexts(profiles.folded(profiles.facts(proposed)))


@query("progress_reports", """
WITH b AS (SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS batch, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1), s AS (SELECT *, CAST(sum(n) OVER (ORDER BY batch) AS BIGINT) AS total FROM b)
SELECT batch, total, total // 24 AS number FROM s WHERE total // 24 > (total - n) // 24""")
def _(t):
    counts = t("events").where("ts IS NOT NULL").groupBy(F.expr("CAST(unix_micros(CAST(date_trunc('hour', ts) AS timestamp)) DIV 1000000 AS bigint) AS batch")).agg(F.count(F.lit(1)).alias("n"))
    return progress.due_reports(counts, "batch", "n", 24)
