"""Searches that write an index, a graph or rounds on their way, bound to the test tables; SQL, where it can say the same, from the definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.functions import text as T
from loamgrid.operators import containment, nearest, search_index
from loamgrid.operators import retrieval as R
from loamgrid.operators import sampling as D
from loamgrid.plans.bound import _BAG, _FEATURES, BM, STOP, query
from loamgrid.sources import workspace


@query("stemmed_search")
def _(t):
    """The 16 best documents of each benchmark item by its rarest 14 words (any), and by its rarest two (both): see ``search_index``."""
    docs, items = t("documents").where("doc_id IS NOT NULL"), t("benchmark")
    path = workspace.fresh(docs.sparkSession, "index")
    search_index.build(docs.select("doc_id", F.regexp_extract("text", r"^\S*\s*\S*", 0).alias("title"), F.col("text").alias("body")), path, "doc_id", ["title", "body"])
    words = items.select("item_id", F.explode(F.array_distinct(T.plain_words(F.col("text")))).alias("w")).where("length(w) > 2 AND w NOT RLIKE '^[0-9]+$'")
    df = words.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    ordered = words.join(df, "w").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("df", (-F.length("w")).alias("l"), "w"))).alias("o")).select("item_id", F.transform("o", lambda x: x["w"]).alias("o"))
    asked = ordered.select((F.col("item_id") * 2).alias("query_id"), F.slice("o", 1, 14).alias("phrases"), F.lit(False).alias("every"))
    asked = asked.unionAll(ordered.where("size(o) > 1").select((F.col("item_id") * 2 + 1).alias("query_id"), F.slice("o", 1, 2).alias("phrases"), F.lit(True).alias("every")))
    return search_index.search(docs.sparkSession, path, asked, 16).withColumn("score", F.round("score", 6))


FORM = "regexp_replace(replace(lower({}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
CONTAINED = f"""WITH r AS (SELECT doc_id, {FORM.format('text')} AS f FROM documents), n AS (SELECT item_id, {FORM.format('text')} AS f FROM benchmark),
m AS (SELECT doc_id, item_id, strpos(r.f, n.f) - 1 AS first FROM r JOIN n ON n.f <> '' AND contains(r.f, n.f))"""


@query("needle_containment", f"{CONTAINED} SELECT * FROM m")
def _(t):
    return containment.contained(t("documents"), t("benchmark"), "doc_id", "text", "item_id", "text").select("doc_id", "item_id", "first")


@query("containment_coverage", f"""
{CONTAINED}, k AS (SELECT doc_id, count(*) AS m FROM m GROUP BY doc_id), h AS (SELECT source, sha256(doc_id || ':' || coalesce(text, '')) AS h, m FROM documents LEFT JOIN k USING (doc_id)),
b AS (SELECT source, substr(h, 1, 3) AS b, count(*) AS n, sum(m) AS m, count(m) AS k, sha256(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY ALL)
SELECT source, CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(d, '' ORDER BY b)) AS sha256, CAST(coalesce(sum(m), 0) AS BIGINT) AS n_matches, CAST(sum(k) AS BIGINT) AS n_matched_rows FROM b GROUP BY source""")
def _(t):
    docs = t("documents")
    found = containment.contained(docs, t("benchmark"), "doc_id", "text", "item_id", "text")
    return containment.coverage(docs, found, "source", "doc_id", "text")


@query("closest_negative", r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n, lower(regexp_extract(text, '^\S+\s+(\S+)', 1)) AS answer, lower(text) AS t FROM documents),
p AS (SELECT a.doc_id, b.doc_id AS negative, abs(a.n - b.n) AS gap FROM d a JOIN d b ON a.source <> b.source AND NOT contains(b.t, a.answer)),
w AS (SELECT doc_id, min(row(gap, negative)) AS b FROM p GROUP BY doc_id)
SELECT d.doc_id, b[2] AS negative, CAST(b[1] AS BIGINT) AS gap FROM d LEFT JOIN w USING (doc_id)""")
def _(t):
    docs = t("documents").select("doc_id", "source", "text", F.size(T.plain_words(F.col("text"))).alias("n"), F.regexp_extract("text", r"^\S+\s+(\S+)", 1).alias("answer"))
    return nearest.closest_negative(docs, "doc_id", "n", "source", "answer", "text")


def _questions(t):
    b = t("benchmark")
    return b.unionByName(b.select((F.col("item_id") + 100_000).alias("item_id"), F.concat("text", F.lit(" so")).alias("text"))).unionByName(b.where("length(text) % 3 = 0").select((F.col("item_id") + 200_000).alias("item_id"), F.concat("text", F.lit(" so it goes")).alias("text")))


@query("near_dup_sequence")
def _(t):
    """The questions that stay when they are taken in order and each goes that is near one taken before, or equal to any before."""
    return D.kept_questions(_questions(t), "item_id", "text").select("item_id")


@query("mined_passages")
def _(t):
    """For each benchmark item the five best documents of a pool from three stemmed searches: see ``retrieval.mined``."""
    docs, items = t("documents").where("doc_id IS NOT NULL"), t("benchmark")
    path = workspace.fresh(docs.sparkSession, "index")
    search_index.build(docs, path, "doc_id", ["text"])
    parts = items.select("item_id", F.col("text").alias("question"), F.substring_index("text", " ", 12).alias("reason"), F.substring_index("text", " ", -6).alias("target"))
    return R.mined(docs, parts, path, {"question": 0.35, "reason": 0.45, "target": 0.2}).withColumn("score", F.round("score", 6))


@query("passage_windows", f"""
WITH {BM}, pool AS (SELECT item_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM bm) x WHERE r <= 2),
m AS (SELECT -1 AS item_id, doc_id, text FROM documents), tb AS (SELECT doc_id, unnest({_BAG}) AS term FROM (SELECT doc_id, {_FEATURES} AS w FROM m) x), tt AS (SELECT doc_id, term, count(*) AS tf FROM tb GROUP BY ALL),
voc AS (SELECT term, ln((1e0 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tt GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 180000),
pc AS (SELECT doc_id, regexp_extract_all(text, '\\s*\\S+') AS p FROM documents WHERE doc_id IN (SELECT doc_id FROM pool)),
sx AS (SELECT doc_id, p, unnest(range(0, len(p), 40)) AS a FROM pc), wn AS (SELECT doc_id, a, least(a + 60, len(p)) AS b, ltrim(array_to_string(p[a + 1:a + 60], ''), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM sx WHERE a = 0 OR a + 20 < len(p)),
texts AS (SELECT 'w' AS kind, doc_id AS x, a AS y, text FROM wn UNION ALL SELECT 'q', item_id, 0, text FROM benchmark UNION ALL SELECT 't', item_id, 0, regexp_extract(text, '\\S+\\s+\\S+\\s+\\S+$') FROM benchmark),
b2 AS (SELECT kind, x, y, unnest({_BAG}) AS term FROM (SELECT kind, x, y, {_FEATURES} AS w FROM texts) z), t2 AS (SELECT kind, x, y, term, (1 + ln(count(*))) * any_value(idf) AS w FROM b2 JOIN voc USING (term) GROUP BY ALL),
n2 AS (SELECT kind, x, y, sqrt(sum(w * w)) AS nw FROM t2 GROUP BY ALL), u2 AS (SELECT kind, x, y, term, w / nw AS u FROM t2 JOIN n2 USING (kind, x, y)),
qq AS (SELECT x AS item_id, term, sum(u * CASE kind WHEN 'q' THEN 0.8e0 ELSE 0.2e0 END) AS q FROM u2 WHERE kind <> 'w' GROUP BY ALL),
sc AS (SELECT pool.item_id, doc_id, y AS a, sum(u * q) AS s FROM pool JOIN u2 ON u2.kind = 'w' AND u2.x = doc_id JOIN qq ON qq.item_id = pool.item_id AND qq.term = u2.term GROUP BY ALL),
al AS (SELECT pool.item_id, wn.doc_id, wn.a, wn.b, wn.text, round(coalesce(s, 0), 6) AS score FROM pool JOIN wn USING (doc_id) LEFT JOIN sc ON sc.item_id = pool.item_id AND sc.doc_id = wn.doc_id AND sc.a = wn.a)
SELECT item_id, doc_id AS id, CAST(a AS BIGINT) AS start, CAST(b AS BIGINT) AS stop, md5(text) AS passage, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY score DESC, a) AS r FROM al) x WHERE r = 1""")
def _(t):
    """The best window of 60 words in each item's two best documents, by the item (0.8) and its last three words (0.2)."""
    found = R.ranked(R.bm25(t("documents"), t("benchmark"), k=2), "item_id", 2).select("item_id", "id")
    items = t("benchmark").withColumn("tail", F.regexp_extract("text", r"\S+\s+\S+\s+\S+$", 0))
    return R.best_windows(found, t("documents"), items, {"text": 0.8, "tail": 0.2}, width=60, step=40, stop=list(STOP)).withColumn("passage", F.md5("passage"))
