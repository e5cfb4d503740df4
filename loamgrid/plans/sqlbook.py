"""Queries that both engines run from one text, by name. Every ORDER BY of a window ends in a unique key; floats are rounded."""

from __future__ import annotations

BOOK: dict[str, str] = {}
#: Replicates of the bootstraps whose draws SQL repeats; ``operators.statistics.bootstrap`` takes any number.
REPLICATES = 200

# --- corpus curation -------------------------------------------------------------------------------------------------------------
BOOK["decontaminate_13gram"] = """
WITH bad AS (SELECT DISTINCT @explode(@grams(w, 13)) AS g FROM (SELECT @words(text) AS w FROM benchmark)),
docs AS (SELECT doc_id, lang, @words(text) AS w FROM documents),
hit AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, @explode(@grams(w, 13)) AS g FROM docs) x WHERE g IN (SELECT g FROM bad))
SELECT lang, count(*) AS n_docs, count_if(hit.doc_id IS NOT NULL) AS n_contaminated, count_if(hit.doc_id IS NULL) AS n_kept
FROM docs LEFT JOIN hit ON docs.doc_id = hit.doc_id GROUP BY lang"""
BOOK["exact_dedup_normalized"] = """
SELECT doc_id, key AS normalized_sha256 FROM (SELECT doc_id, key, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS rn
FROM (SELECT doc_id, @sha(@join(@words(text))) AS key FROM documents) k) r WHERE rn = 1"""
BOOK["dedup_protected"] = """
WITH keyed AS (SELECT doc_id, @sha(@join(@words(text))) AS key FROM documents),
safe AS (SELECT DISTINCT key FROM keyed WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0))
SELECT min(doc_id) AS doc_id, key FROM keyed WHERE NOT EXISTS (SELECT 1 FROM safe WHERE safe.key = keyed.key) GROUP BY key"""
BOOK["min_length_profile"] = """
SELECT lang, count(*) AS n, count_if(words >= 60) AS n60, count_if(words >= 80) AS n80, count_if(chars BETWEEN 600 AND 6500) AS mid, round(avg(words), 6) AS mean_words,
@dbl(median(words)) AS median_words, min(words) AS min_words, max(words) AS max_words FROM (SELECT lang, @size(@words(text)) AS words, length(text) AS chars FROM documents) x GROUP BY lang"""
BOOK["repeated_lines"] = """
SELECT doc_id, max(n) AS most, count(*) AS lines FROM (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, @explode(@lines(text)) AS line FROM documents) l
WHERE length(line) >= 50 GROUP BY doc_id, line) c WHERE n >= 6 GROUP BY doc_id"""
BOOK["quality_filter_join"] = """
SELECT d.lang, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic, count(*) AS n, count_if(coalesce(l.quality, 0) = 1 AND coalesce(l.toxic, 1) = 0) AS accepted
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2, 3"""
BOOK["hash_split_mod25"] = """
SELECT split, count(*) AS n, sum(n_chars) AS chars FROM (SELECT n_chars, CASE WHEN @hash32(CAST(doc_id AS VARCHAR(20))) % 25 = 0 THEN 'validation' ELSE 'train' END AS split FROM documents) x GROUP BY split"""
BOOK["stratified_largest_remainder"] = """
WITH n AS (SELECT lang, count(*) AS c FROM documents GROUP BY lang), t AS (SELECT sum(c) AS total FROM n),
q AS (SELECT lang, c, @fl(100 * c / total) AS base, 100 * c / total - floor(100 * c / total) AS frac FROM n CROSS JOIN t),
r AS (SELECT lang, base, row_number() OVER (ORDER BY frac DESC, lang) AS rn, 100 - sum(base) OVER () AS extra FROM q),
quota AS (SELECT lang, base + CASE WHEN rn <= extra THEN 1 ELSE 0 END AS quota FROM r),
ranked AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY @sha(concat('42:', doc_id)), doc_id) AS rn FROM documents)
SELECT doc_id, ranked.lang, rn FROM ranked JOIN quota ON ranked.lang = quota.lang WHERE rn <= quota"""
BOOK["quota_select"] = """
SELECT doc_id, quality, toxic, rn FROM (SELECT d.doc_id, quality, toxic, row_number() OVER (PARTITION BY quality ORDER BY toxic, @sha(concat('7:', d.doc_id)), d.doc_id) AS rn
FROM documents d JOIN labels l ON d.doc_id = l.doc_id) x WHERE rn <= 20"""
BOOK["split_80_10_10"] = """
SELECT lang, split, count(*) AS n FROM (SELECT lang, CASE WHEN rn <= @even(c * 0.1) THEN 'test' WHEN rn <= 2 * @even(c * 0.1) THEN 'validation' ELSE 'train' END AS split
FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY @sha(concat('s:', doc_id)), doc_id) AS rn, @dbl(count(*) OVER (PARTITION BY lang)) AS c FROM documents) r) s GROUP BY lang, split"""
BOOK["group_disjoint_split"] = """
WITH g AS (SELECT source, row_number() OVER (ORDER BY @sha(source), source) AS rn FROM (SELECT DISTINCT source FROM documents) s),
split AS (SELECT source, CASE WHEN rn <= 1 THEN 'test' WHEN rn <= 2 THEN 'validation' ELSE 'train' END AS split FROM g)
SELECT split, count(*) AS n, count(DISTINCT d.source) AS groups FROM documents d JOIN split ON d.source = split.source GROUP BY split"""
BOOK["split_leakage"] = """
SELECT key, count(DISTINCT split) AS splits, count(*) AS n FROM (SELECT @sha(@join(@words(text))) AS key, CASE WHEN doc_id % 5 = 0 THEN 'dev' ELSE 'train' END AS split FROM documents) x
GROUP BY key HAVING count(DISTINCT split) > 1"""
BOOK["bigram_block_pairs"] = """
WITH w AS (SELECT item_id, @words(text) AS w FROM benchmark), g AS (SELECT DISTINCT item_id, @explode(@grams(w, 2)) AS g FROM w)
SELECT a.item_id AS a, b.item_id AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.item_id < b.item_id GROUP BY a.item_id, b.item_id HAVING count(*) >= 2"""
BOOK["substring_contamination"] = """
WITH items AS (SELECT item_id, w, @join(w) AS needle FROM (SELECT item_id, @words(text) AS w FROM benchmark) a),
heads AS (SELECT item_id, needle, concat(w[@at(1)], ' ', w[@at(2)], ' ', w[@at(3)]) AS head FROM items WHERE length(needle) >= 40 AND @size(w) >= 5),
docs AS (SELECT doc_id, @words(text) AS w FROM documents), g AS (SELECT DISTINCT doc_id, @explode(@grams(w, 3)) AS head FROM docs),
hit AS (SELECT g.doc_id, heads.item_id, heads.needle FROM g JOIN heads ON g.head = heads.head)
SELECT hit.item_id, hit.doc_id FROM hit JOIN docs ON hit.doc_id = docs.doc_id WHERE @pos(@join(docs.w), hit.needle) > 0"""
BOOK["char_chunks"] = """
SELECT doc_id, start, length(substr(text, @b(start) + 1, 1024)) AS chars, md5(substr(text, @b(start) + 1, 1024)) AS chunk_md5
FROM (SELECT doc_id, text, @explode(@range(0, length(text), 924)) AS start FROM documents) x"""
BOOK["word_windows"] = """
SELECT doc_id, start, least(start + 180, n) AS stop FROM (SELECT doc_id, n, @explode(@range(0, n, 120)) AS start FROM (SELECT doc_id, @size(@words(text)) AS n FROM documents) w) x
WHERE start = 0 OR start + 60 < n"""
BOOK["fixed_word_windows"] = """
SELECT doc_id, count(*) AS windows, max(start) AS last_start FROM (SELECT doc_id, n, @explode(@range(0, n, 100)) AS start FROM (SELECT doc_id, @size(@words(text)) AS n FROM documents) w) x GROUP BY doc_id"""
BOOK["subdivide_spans"] = """
SELECT doc_id, start, least(start + 500, n) AS stop FROM (SELECT doc_id, n, @explode(@range(0, n, 500)) AS start FROM (SELECT doc_id, @b(length(text)) AS n FROM documents) a) x"""
BOOK["url_domain_filter"] = """
SELECT page_id, @find(url, '^https?://([^/?#]+)', 1) AS host, replace(@tail(@find(url, '^[^?#]+', 0), '/'), '_', ' ') AS title FROM pages WHERE @rlike(url, 'example[.](com|org)')"""
BOOK["keyed_hash_selection"] = """
SELECT doc_id, lang, source FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY @sha(concat('salt', doc_id)), doc_id) AS rn FROM documents) x WHERE rn <= 2"""
BOOK["secret_scan"] = """
SELECT rule, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, @explode(rules) AS rule FROM (SELECT doc_id, array(CASE WHEN @rlike(text, 'AKIA[0-9A-Z]{16}') THEN 'aws' END,
CASE WHEN @rlike(text, 'sk-[A-Za-z0-9]{20,}') THEN 'sk' END, CASE WHEN @rlike(text, 'gh[pousr]_[A-Za-z0-9]{20,}') THEN 'gh' END, CASE WHEN @rlike(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z]+') THEN 'mail' END) AS rules FROM documents) a) x
WHERE rule IS NOT NULL GROUP BY rule""".replace("array(CASE", "@arr(CASE")
BOOK["uuid_harvest"] = """
SELECT count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT @explode(regexp_extract_all(concat(lower(text), CASE WHEN doc_id % 7 = 0 THEN concat(' 0123abcd-0000-4000-8000-', @pad(doc_id), ' 0123abcd-0000-4000-8000-', @pad(doc_id + 1)) ELSE '' END),
'([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})')) AS id FROM documents) x"""

# --- retrieval -------------------------------------------------------------------------------------------------------------------
_COS = """sim AS (SELECT q.vec_id AS q, q.label AS ql, d.vec_id AS d, d.label AS dl, round(@dot(q.embedding, d.embedding), 6) AS score FROM (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 100 = 0) q JOIN embeddings d ON q.vec_id <> d.vec_id),
rank AS (SELECT q, ql, d, dl, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rk FROM sim), top AS (SELECT * FROM rank WHERE rk <= 10)"""
BOOK["retrieval_metrics"] = f"""
WITH {_COS}, per AS (SELECT q, min(CASE WHEN ql = dl THEN rk END) AS first_hit FROM top GROUP BY q)
SELECT count(*) AS queries, round(avg(CASE WHEN first_hit <= 1 THEN 1.0D ELSE 0.0D END), 6) AS hit1, round(avg(CASE WHEN first_hit <= 3 THEN 1.0D ELSE 0.0D END), 6) AS hit3,
round(avg(CASE WHEN first_hit <= 10 THEN 1.0D ELSE 0.0D END), 6) AS hit10, round(avg(coalesce(1.0D / first_hit, 0.0D)), 6) AS mrr10 FROM per""".replace("0D", "0e0")
BOOK["threshold_sweep"] = f"""
WITH {_COS}, grid AS (SELECT 0.1 * t AS threshold FROM (SELECT @explode(@range(0, 10, 1)) AS t) g),
m AS (SELECT round(threshold, 1) AS threshold, count_if(score >= threshold AND ql = dl) AS kept_good, count_if(score < threshold AND ql <> dl) AS cut_bad FROM top CROSS JOIN grid GROUP BY 1)
SELECT @dbl(threshold) AS threshold, kept_good, cut_bad, row_number() OVER (ORDER BY kept_good + cut_bad DESC, threshold) AS place FROM m"""
BOOK["vector_validation"] = """
SELECT label, count(*) AS n, count_if(@size(embedding) <> 64) AS bad_dim, count_if(abs(sqrt(@dot(embedding, embedding)) - 1) > 0.000001) AS not_unit FROM embeddings GROUP BY label"""

# --- conversations and memory ----------------------------------------------------------------------------------------------------
BOOK["message_dedup"] = "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY md5(concat(role, ':', text)) ORDER BY conv_id, turn) AS rn FROM conversations) x WHERE rn = 1"
BOOK["message_entropy"] = """
SELECT conv_id, n, round(1 - distinct_n / @dbl(n), 6) AS dup_rate, round(mean_len, 6) AS mean_len, CASE WHEN n > 50 OR mean_len > 1000 THEN 'high' WHEN n > 20 OR 1 - distinct_n / @dbl(n) > 0.2 THEN 'medium' ELSE 'low' END AS level
FROM (SELECT conv_id, count(*) AS n, count(DISTINCT concat(role, ':', text)) AS distinct_n, avg(length(text)) AS mean_len FROM conversations GROUP BY conv_id) x"""
BOOK["role_transitions"] = "SELECT coalesce(before, 'start') AS before, role, count(*) AS n FROM (SELECT role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) x GROUP BY 1, 2"
BOOK["profile_upsert"] = """
SELECT user_id, event_type, max_by(event_id, @row(ts, event_id)) AS latest, count(*) AS n FROM events GROUP BY user_id, event_type"""
BOOK["last_n_messages"] = "SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) x WHERE rn <= 3"

# --- traces, ledgers, reports ----------------------------------------------------------------------------------------------------
_K = "led AS (SELECT user_id, event_id, ts, event_type, value, @b(@json(props, k)) AS k FROM events)"
BOOK["ledger_latest_wins"] = f"WITH {_K} SELECT user_id, count(*) AS requests, round(sum(value), 4) AS total FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_id DESC) AS rn FROM led) x WHERE rn = 1 GROUP BY user_id"
BOOK["ledger_terminal_wins"] = f"WITH {_K} SELECT event_type, count(*) AS n FROM (SELECT event_type, row_number() OVER (PARTITION BY user_id, k ORDER BY CASE WHEN event_type = 'click' THEN 0 ELSE 1 END DESC, ts DESC, event_id DESC) AS rn FROM led) x WHERE rn = 1 GROUP BY event_type"
BOOK["ledger_conflicts"] = f"WITH {_K} SELECT user_id, count_if(kinds > 1) AS conflicted, count_if(kinds = 1) AS settled FROM (SELECT user_id, k, count(DISTINCT event_type) AS kinds FROM led GROUP BY user_id, k) x GROUP BY user_id"
BOOK["unknown_total"] = """
SELECT event_type, CASE WHEN count_if(v IS NULL) = 0 AND count(*) > 0 THEN round(sum(v), 4) END AS total, round(sum(v), 4) AS known_subtotal, count_if(v IS NULL) AS unknown
FROM (SELECT event_type, CASE WHEN event_type = 'error' AND event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events) x GROUP BY event_type"""
BOOK["latency_quantiles"] = """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, round(@pct(value, 0.5), 6) AS p50, round(@pct(value, 0.95), 6) AS p95, round(@pct(value, 0.99), 6) AS p99, max(CASE WHEN rn = least(n, @fl(n * 0.95) + 1) THEN value END) AS i95, max(CASE WHEN rn = @fl((n - 1) * 0.95) + 1 THEN value END) AS j95 FROM r GROUP BY event_type"""
BOOK["cube_report"] = """
SELECT coalesce(r_name, 'all') AS region, coalesce(o_orderstatus, 'all') AS status, count(*) AS n, count_if(o_totalprice > 150000) AS high, round(avg(o_totalprice), 4) AS mean_price
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, o_orderstatus)"""
BOOK["grouping_sets_strata"] = """
SELECT CASE WHEN l_returnflag IS NOT NULL THEN 'returnflag' WHEN l_linestatus IS NOT NULL THEN 'linestatus' ELSE 'all' END AS stratum, coalesce(l_returnflag, l_linestatus, 'all') AS val, count(*) AS n, round(sum(l_quantity), 2) AS qty
FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus))"""
BOOK["sweep_concurrency"] = """
WITH p AS (SELECT event_type, @secs(ts) AS t, 1 AS d FROM events UNION ALL SELECT event_type, @secs(ts) + 600 AS t, -1 AS d FROM events)
SELECT event_type, max(running) AS peak FROM (SELECT event_type, @b(sum(d) OVER (PARTITION BY event_type ORDER BY t, d ROWS UNBOUNDED PRECEDING)) AS running FROM p) x GROUP BY event_type"""
BOOK["repeat_queries"] = f"WITH {_K} SELECT event_type, @b(sum(n - 1)) AS repeats, count(*) AS keys FROM (SELECT event_type, k, user_id, count(*) AS n FROM led GROUP BY event_type, k, user_id) x GROUP BY event_type"
BOOK["gaps_islands"] = """
WITH e AS (SELECT user_id, event_id, @secs(ts) AS t FROM events), b AS (SELECT user_id, event_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 3600 THEN 0 ELSE 1 END AS fresh FROM e),
i AS (SELECT user_id, t, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT user_id, @b(island) AS island, count(*) AS n, round(max(t) - min(t), 3) AS seconds FROM i GROUP BY user_id, island"""
BOOK["retention_cleanup"] = "SELECT event_type, count(*) AS kept FROM events WHERE ts IS NULL OR ts > TIMESTAMP '2024-01-15 00:00:00' GROUP BY event_type"
BOOK["full_outer_runs"] = """
WITH o AS (SELECT o_custkey, max_by(o_orderkey, @secs(o_orderdate) * 1000000.0 + o_orderkey) AS latest, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
c AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
SELECT coalesce(c_custkey, o_custkey) AS custkey, latest, coalesce(n, 0) AS n, c_custkey IS NOT NULL AS expected FROM c FULL OUTER JOIN o ON c_custkey = o_custkey"""
BOOK["overlay_precedence"] = """
SELECT doc_id, layer, val FROM (SELECT doc_id, layer, val, row_number() OVER (PARTITION BY doc_id ORDER BY layer DESC) AS rn FROM (SELECT doc_id, 0 AS layer, n_chars AS val FROM documents UNION ALL SELECT doc_id, 1 AS layer, @b(quality) AS val FROM labels) u) x WHERE rn = 1"""
BOOK["execution_matrix"] = """
SELECT p_partkey AS case_id, r_name AS model, rep FROM (SELECT p_partkey, r_name, @explode(@range(1, CASE WHEN p_partkey % 50 = 0 THEN 4 ELSE 2 END, 1)) AS rep FROM part CROSS JOIN region) x"""
BOOK["telemetry_rollup"] = """
SELECT event_type, @b(day) AS day, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, count_if(value IS NULL) AS unknown
FROM (SELECT event_type, user_id, value, floor(@secs(ts) / 86400) AS day FROM events) x GROUP BY event_type, day"""
BOOK["carry_forward"] = """
SELECT coalesce(@b(phase), -1) AS phase, count(*) AS n FROM (SELECT max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS phase FROM events) x GROUP BY 1"""

# --- judges and statistics -------------------------------------------------------------------------------------------------------
_ARMS = "arms AS (SELECT l_partkey AS item, max(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS a, max(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS b FROM lineitem GROUP BY l_partkey), paired AS (SELECT item, a, b FROM arms WHERE a IS NOT NULL AND b IS NOT NULL)"
BOOK["paired_wins_losses"] = f"WITH {_ARMS} SELECT count(*) AS n, count_if(b > a) AS wins, count_if(b < a) AS losses, count_if(a = b) AS ties, round(avg(b - a), 6) AS delta FROM paired"
BOOK["paired_bootstrap"] = f"""
WITH {_ARMS}, o AS (SELECT row_number() OVER (ORDER BY item) - 1 AS i, b - a AS d FROM paired), n AS (SELECT count(*) AS n FROM o), reps AS (SELECT @explode(@range(0, {REPLICATES}, 1)) AS r),
draw AS (SELECT r, o.i, @hash32(concat(r, ':', o.i)) % n AS pick FROM reps CROSS JOIN o CROSS JOIN n),
m AS (SELECT r, avg(o.d) AS m FROM draw JOIN o ON draw.pick = o.i GROUP BY r)
SELECT round(@pct(m, 0.025), 6) AS low, round(@pct(m, 0.975), 6) AS high FROM m"""
BOOK["cluster_bootstrap"] = f"""
WITH f AS (SELECT c_nationkey AS fam, @dbl(count_if(o_orderstatus = 'F')) AS a, @dbl(count(*)) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey),
o AS (SELECT row_number() OVER (ORDER BY fam) - 1 AS i, a, n FROM f), k AS (SELECT count(*) AS k FROM o), reps AS (SELECT @explode(@range(0, {REPLICATES}, 1)) AS r),
draw AS (SELECT r, @hash32(concat(r, '/', o.i)) % k AS pick FROM reps CROSS JOIN o CROSS JOIN k), m AS (SELECT r, sum(a) / sum(n) AS m FROM draw JOIN o ON draw.pick = o.i GROUP BY r)
SELECT round(@pct(m, 0.025), 6) AS low, round(@pct(m, 0.5), 6) AS mid, round(@pct(m, 0.975), 6) AS high FROM m"""
# The two-sided binomial tail needs its last 6 sqrt(n) terms only: what lies below is under 1e-31 (Hoeffding).
BOOK["mcnemar_holm"] = """
WITH t AS (SELECT arm, @dbl(count_if(x = 1 AND y = 0)) AS b, @dbl(count_if(x = 0 AND y = 1)) AS c FROM (SELECT l_linestatus AS arm, CASE WHEN l_quantity > 48 THEN 1 ELSE 0 END AS x, CASE WHEN l_tax > 0.075 THEN 1 ELSE 0 END AS y FROM lineitem) q GROUP BY arm),
s AS (SELECT arm, b, c, b + c AS n, @explode(@range(greatest(0, @fl(least(b, c) - 6 * sqrt(b + c)) - 1), @b(least(b, c)) + 1, 1)) AS i FROM t),
p AS (SELECT arm, @b(max(b)) AS b, @b(max(c)) AS c, least(1.0, 2 * sum(exp(@lnfact(n) - @lnfact(@dbl(i)) - @lnfact(n - i) - n * ln(2.0)))) AS p FROM s GROUP BY arm)
SELECT arm, b, c, round(@dbl(p), 6) AS p, round(@dbl(max(least(1.0, k * p)) OVER (ORDER BY p, arm ROWS UNBOUNDED PRECEDING)), 6) AS holm FROM (SELECT arm, b, c, p, count(*) OVER () - row_number() OVER (ORDER BY p, arm) + 1 AS k FROM p) h"""
BOOK["cohen_kappa"] = """
SELECT n, round(agree / n, 6) AS observed, CASE WHEN e = 1 THEN NULL ELSE round((agree / n - e) / (1 - e), 6) END AS kappa FROM (SELECT n, agree, (a1 * b1 + (n - a1) * (n - b1)) / (n * n) AS e FROM
(SELECT @dbl(count(*)) AS n, @dbl(count_if(quality = 1 - toxic)) AS agree, @dbl(sum(quality)) AS a1, @dbl(sum(1 - toxic)) AS b1 FROM labels) x) y"""
BOOK["confusion_matrix"] = "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic"
BOOK["factorial_contrast"] = """
SELECT round(sum(wf * m), 6) AS form, round(sum(wr * m), 6) AS relation, round(sum(wi * m), 6) AS interaction FROM (SELECT CASE WHEN l_linestatus = 'O' THEN 0.5 ELSE -0.5 END AS wf, CASE WHEN l_returnflag = 'A' THEN 0.5 ELSE -0.5 END AS wr,
CASE WHEN (l_linestatus = 'O') = (l_returnflag = 'A') THEN 1.0 ELSE -1.0 END AS wi, avg(l_quantity) AS m FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_linestatus, l_returnflag) x"""
BOOK["group_advantage"] = """
SELECT l_orderkey, l_linenumber, round((r - avg(r) OVER (PARTITION BY l_orderkey)) / (stddev_pop(r) OVER (PARTITION BY l_orderkey) + 0.000001), 5) + 0.0 AS advantage
FROM (SELECT l_orderkey, l_linenumber, 0.9 * l_quantity / 50 + 0.1 * l_discount AS r FROM lineitem) x"""
BOOK["ema_stats"] = """
WITH o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL)
SELECT user_id, round(sum(value * CASE WHEN i = 1 THEN power(0.9, n - 1) ELSE 0.1 * power(0.9, n - i) END), 5) AS ema, max(n) AS n FROM o GROUP BY user_id"""
BOOK["k_sample_rollup"] = """
SELECT any_ok, majority, count(*) AS orders FROM (SELECT l_orderkey, bool_or(l_quantity > 45) AS any_ok, count_if(l_quantity > 25) * 2 > count(*) AS majority FROM lineitem GROUP BY l_orderkey) x GROUP BY any_ok, majority"""
BOOK["two_judge_consensus"] = """
SELECT verdict, count(*) AS n FROM (SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'not_executed' WHEN quality = 1 AND toxic = 0 THEN 'pass' WHEN quality = 0 AND toxic = 1 THEN 'fail' ELSE 'uncertain' END AS verdict FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) x GROUP BY verdict"""
BOOK["repeat_stability"] = "SELECT stable, count(*) AS n FROM (SELECT l_partkey, count(DISTINCT l_returnflag) = 1 AND count(*) >= 2 AS stable FROM lineitem GROUP BY l_partkey) x GROUP BY stable"
BOOK["referential_violations"] = """
SELECT 'label without document' AS rule, count(*) AS n FROM labels LEFT JOIN documents ON labels.doc_id = documents.doc_id WHERE documents.doc_id IS NULL UNION ALL SELECT 'repeated document id' AS rule, count(*) - count(DISTINCT doc_id) AS n FROM documents
UNION ALL SELECT 'turn gap' AS rule, count(*) AS n FROM (SELECT turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS gap FROM conversations) g WHERE gap <> 1"""
BOOK["set_operations"] = """
SELECT 'both' AS kind, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) a UNION ALL SELECT 'unlabelled' AS kind, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) b
UNION ALL SELECT 'union' AS kind, count(*) AS n FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels) c"""
