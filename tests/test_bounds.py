"""What a worker or a task holds doesn't follow the size of the input."""

import pyarrow as pa
from pyspark.sql import functions as F

from loamgrid.functions import batches, tokens
from loamgrid.functions.stem import stem_rows
from loamgrid.operators import search_index


def test_slices_keep_all_rows_in_runs_of_few_bytes():
    part = pa.RecordBatch.from_pydict({"i": list(range(7)), "t": ["aa", None, "b" * 9, "", "cc", "dd", "e"]})
    got = list(batches.slices(iter([part]), 1, 4))
    assert [r for g in got for r in g.to_pylist()] == part.to_pylist()
    assert [g.num_rows for g in got] == [2, 1, 3, 1]


def test_stems_of_many_long_texts_leave_in_small_batches(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(300))) for i in range(3000)]
    df = spark.createDataFrame([*rows, (-1, None), (-2, "")], "doc int, t string").coalesce(1)
    sizes = stem_rows(df, "t").mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"n": [p.num_rows]}) for p in it), "n bigint").collect()
    assert sum(r.n for r in sizes) == 900_000 and int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_index_shares_grow_in_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "SHARE", 10)
    search_index.build(spark.createDataFrame([(i, "one word") for i in range(200)], "doc_id int, t string"), str(tmp_path), "doc_id", ["t"], 2)
    per_file = spark.read.parquet(f"{tmp_path}/postings").groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert per_file < 100


def test_token_sizes_need_no_column_of_tokens(spark):
    from loamgrid.plans.nested import _vocabulary

    df = spark.createDataFrame([(1, "One two. Three!\n\nFour"), (2, None), (3, "")], "doc_id int, t string")
    want = {r.doc_id: r.s for r in df.select("doc_id", tokens.sentence_sizes("t", tokens.tokens(F.col("t"), _vocabulary())).alias("s")).collect()}
    assert {r.doc_id: r.sizes for r in tokens.sentence_token_sizes(df, "doc_id", "t", _vocabulary()).collect()} == want


def test_bm25_scores_documents_where_they_lie(spark, monkeypatch):
    import math
    import random

    from loamgrid.operators import retrieval

    rnd = random.Random(3)
    docs = [(i, " ".join(rnd.choice("abcdefgh") * 2 for _ in range(rnd.randrange(30)))) for i in range(300)] + [(900, None), (901, "aa bb"), (902, "AA, bb")]
    asked = [(1, "aa bb aa"), (2, "hh"), (3, None), (4, "zz"), (5, "cc dd ee ff gg")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(asked, "item_id long, text string")
    words = {i: (t or "").lower().replace(",", "").split() for i, t in docs}
    mean, want = sum(map(len, words.values())) / len(words), {}
    for i, t in asked:
        for term in sorted(set((t or "").split())):
            df = sum(term in w for w in words.values())
            for j, w in words.items():
                if tf := w.count(term):
                    want[i, j] = want.get((i, j), 0) + math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    for block in (retrieval.QUERY_BLOCK, 2):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        every = retrieval.bm25(d, q)
        assert "hashpartitioning" not in every._jdf.queryExecution().executedPlan().toString()
        got = {(r.item_id, r.id): r.score for r in every.collect()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-6 for x in want)
        best = [tuple(r) for r in retrieval.ranked(retrieval.bm25(d, q, k=7), "item_id", 7).collect()]
        assert sorted(best) == sorted(tuple(r) for r in retrieval.ranked(every, "item_id", 7).collect())


def test_dense_search_makes_no_table_of_pairs(spark, monkeypatch):
    import math
    import random

    from loamgrid.operators import retrieval, vectors

    rnd = random.Random(5)
    rows = [(i, [rnd.choice([-1.0, 0.5, 0.25, 2.0]) for _ in range(3)]) for i in range(400)]  # very many equal ones
    rows += [(500, None), (501, [1.0, None, 1.0]), (502, [1.0, 2.0]), (503, [0.0, 0.0, 0.0]), (504, [math.inf, 1.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = d.where("vec_id % 50 = 0 AND vec_id < 400").withColumnRenamed("vec_id", "q")
    of = {i: v for i, v in rows if v and len(v) == 3 and None not in v}

    def want(k, plain, others):
        out = {}
        for i in range(0, 400, 50):
            scores = []
            for j, v in of.items():
                a, b = of[i], v
                if not plain:
                    a, b = ([x / n for x in y] if (n := math.sqrt(sum(x * x for x in y))) else y for y in (a, b))
                s = sum(x * y for x, y in zip(a, b, strict=True))
                if not (others and i == j):
                    scores.append((not math.isnan(s), 0 if math.isnan(s) else -(round(s, 6) if plain else s), j))
            out[i] = [j for *_, j in sorted(scores)[:k]]
        return out

    for block, cells in ((retrieval.QUERY_BLOCK, vectors.CELLS), (3, 64)):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        monkeypatch.setattr(vectors, "CELLS", cells)
        for plain, others in ((False, False), (True, True)):
            got = retrieval.dense(d, q, k=6, blocks=3, plain=plain, others=others)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan
            found = {}
            for r in got.orderBy("q", "rank").collect():
                found.setdefault(r.q, []).append(r.id)
            assert found == want(6, plain, others)


def test_verdicts_are_not_copied_for_distinct_counts(spark):
    from loamgrid.operators import scoring

    checks = spark.createDataFrame([(1, c, False, True) for c in "abcdefg"], "case_id int, check_id string, critical boolean, executed boolean")
    told = [("a", "x", "pass"), ("a", "y", "pass"), ("b", "x", "pass"), ("b", "y", "fail"), ("c", "x", "pass"), ("c", "x", "pass"), ("d", "x", "fail"), ("e", None, "pass"), ("f", "x", None), ("f", "y", "pass")]
    verdicts = spark.createDataFrame([(1, *v) for v in told], "case_id int, check_id string, judge string, verdict string")
    got = scoring.judged_checks(checks, verdicts)
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
    want = {"a": ("pass", False, False), "b": ("uncertain", True, False), "f": ("pass", False, False)} | {c: ("uncertain", False, True) for c in "cdeg"}
    assert {r.check_id: (r.verdict, r.disagreement, r.judge_error) for r in got.collect()} == want
    for judges, lost in ((1, {"e", "g"}), (3, set("abcdefg"))):
        assert {r.check_id for r in scoring.judged_checks(checks, verdicts, judges).where("judge_error").collect()} == lost


def test_texts_are_dealt_out_only_where_they_are_asked_for(spark, monkeypatch):
    from loamgrid.operators import nearest
    from loamgrid.plans import bound, catalogue

    seen = {}
    real = nearest.written

    def spy(df, name="table"):
        seen.setdefault(name, []).append(df)
        return real(df, name)

    monkeypatch.setattr(nearest, "written", spy)
    monkeypatch.setattr(bound, "written", spy)
    rows = [(i, i % 9, f"s{i % 3}", "yes", "no such word") for i in range(60)]
    got = nearest.closest_negative(spark.createDataFrame(rows, "id int, n int, s string, a string, t string"), "id", "n", "s", "a", "t")
    assert got.where("negative IS NULL").count() == 0 and "exact" not in seen and "text" not in seen["sizes"][0].columns
    catalogue.queries()["substring_contamination"](spark, "/root/testdata/sf0.001").collect()
    assert "LeftSemi" in seen["met"][0]._jdf.queryExecution().executedPlan().toString()


def test_relevance_takes_more_tasks_for_more_documents(spark, monkeypatch):
    from loamgrid.operators import retrieval

    monkeypatch.setattr(retrieval, "TASK_DOCS", 10)
    d, q = spark.createDataFrame([(i, "one two three") for i in range(370)], "doc_id long, text string"), spark.createDataFrame([(i, "one two") for i in range(9)], "item_id long, text string")
    assert "37)" in retrieval.relevance(d, q, max_df=1.0)._jdf.queryExecution().executedPlan().toString()


def test_draws_of_the_paired_bootstrap_are_made_in_many_tasks(spark, monkeypatch):
    from loamgrid.operators import statistics
    from loamgrid.plans import catalogue

    monkeypatch.setattr(statistics, "CELLS", 2000, raising=False)
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("paired", "draws")
    try:
        assert catalogue.queries()["paired_bootstrap"](spark, "/root/testdata/sf0.001").count() == 1
    finally:
        for key in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(key, None)
    stages = {s for job in seen.getJobIdsForGroup("paired") for s in seen.getJobInfo(job).stageIds}
    items = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_partkey").distinct().count()
    assert max(info.numTasks for s in stages if (info := seen.getStageInfo(s))) >= items * 200 * 0.9 / 2000


def test_paired_bootstrap_numbers_a_null_item_last_as_its_sql(spark, tmp_path):
    import duckdb

    from loamgrid.plans import catalogue

    rows = [(None if p == 40 else p, flag, q) for p in range(41) for flag, q in (("A", float(p % 7)), ("R", float(p * p % 50)), ("N", 9.0))]
    spark.createDataFrame(rows, "l_partkey bigint, l_returnflag string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = c.execute(catalogue.oracle_sql()["paired_bootstrap"]).fetchall()
    assert [tuple(r) for r in catalogue.queries()["paired_bootstrap"](spark, str(tmp_path)).collect()] == want


def test_postings_of_a_document_stay_in_its_task(spark, tmp_path):
    rows = spark.createDataFrame([(i, " ".join(f"w{i % 7}x{k}" for k in range(40))) for i in range(60)], "doc_id long, t string").repartition(5)
    search_index.build(rows, str(tmp_path), "doc_id", ["t"], 4)
    posted = spark.read.parquet(f"{tmp_path}/postings").withColumn("task", F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1))
    tasks = posted.groupBy("doc").agg(F.count_distinct("task").alias("n"), F.count_distinct("term").alias("terms")).collect()
    assert {(r.n, r.terms) for r in tasks} == {(1, 40)} and len(tasks) == 60


def test_only_members_of_a_pool_are_split_into_terms(spark):
    from loamgrid.operators import retrieval

    docs = spark.createDataFrame([(i, f"one two three w{i}") for i in range(50)], "doc_id long, text string")
    pool, items = spark.createDataFrame([(1, 7), (1, 8), (2, 7)], "item_id long, id long"), spark.createDataFrame([(1, "one w7"), (2, "w7")], "item_id long, text string")
    got = retrieval.rerank(pool, docs, items, {"text": 1.0})
    assert "LeftSemi" in got._jdf.queryExecution().executedPlan().toString()
    assert [(r.item_id, r.id) for r in got.orderBy("item_id", "rank").collect()] == [(1, 7), (1, 8), (2, 7)]
