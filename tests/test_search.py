"""The stemmed index against SQLite's full-text search on the same texts."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from loamgrid.functions.stem import porter
from loamgrid.operators import search_index

ENGLISH = "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll yes by syzygy generalizations oscillators eyes dying flies being ying x12ing apologies archaeology".split()


def engine(rows):
    c = sqlite3.connect(":memory:")
    try:
        c.execute("CREATE VIRTUAL TABLE p USING fts5(id UNINDEXED, title, body, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("SQLite without full-text search")
    c.executemany("INSERT INTO p VALUES (?, ?, ?)", rows)
    return c


def test_stems_equal_the_engine():
    c = engine([(i, w, "") for i, w in enumerate(ENGLISH)])
    c.execute("CREATE VIRTUAL TABLE v USING fts5vocab('p', 'instance')")
    theirs = {row - 1: term for term, row in c.execute("SELECT term, doc FROM v")}
    assert {w: porter(w) for w in ENGLISH} == {w: theirs[i] for i, w in enumerate(ENGLISH)}


def compare(spark, path, c, queries, weights):
    """(id, phrases, every) must have the engine's scores, and its rows but where scores are equal."""
    got = {}
    asked = spark.createDataFrame(queries, "query_id int, phrases array<string>, every boolean")
    for r in search_index.search(spark, path, asked, 16, weights).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc, r.score))
    for i, phrases, every in queries:
        text = (" AND " if every else " OR ").join('"' + p + '"' for p in phrases)
        rows = c.execute(f"SELECT id, -bm25(p, 0, {weights.get('title', 1)}, {weights.get('body', 1)}) AS s FROM p WHERE p MATCH ? ORDER BY s DESC, id", (text,)).fetchall()
        mine = got.get(i, [])
        assert len(mine) == min(16, len(rows)), text
        assert [s for _, s in mine] == pytest.approx([s for _, s in rows[:16]], rel=1e-9), text
        theirs = dict(rows)
        assert all(theirs[d] == pytest.approx(s, rel=1e-9) for d, s in mine), text
    return got


def test_search_equals_the_engine(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.regexp_extract("text", r"^\S*\s*\S*", 0).alias("title"), F.col("text").alias("body"))
    planted = [(9001, "Generalised treatments", "the treated patients were treating hopeful relational conditions"), (9002, None, "Étude naïve treatment; treatment-resistant conditions"), (9003, "", None), (9004, "treat", "condition condition treat")]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    search_index.build(docs, str(tmp_path), "doc_id", ["title", "body"], buckets=8)
    c = engine([tuple(r) for r in docs.collect()])
    words = [r.text.lower().split() for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").collect()]
    clean = [["".join(ch for ch in w if ch.isalnum()) for w in ws] for ws in words]
    queries = [(i, sorted({w for w in ws if w})[:14], False) for i, ws in enumerate(clean)] + [(100 + i, [w for w in ws if w][:2], True) for i, ws in enumerate(clean)]
    queries += [(200, ["treatment", "conditions"], True), (201, ["treat conditions", "naive"], False), (202, ["relational conditions"], False), (203, ["etude", "treatment resistant"], True), (204, ["nowhere at all"], True), (205, [" ".join(w for w in clean[0] if w)], False)]
    got = compare(spark, str(tmp_path), c, queries, {})
    assert len(got) > len(clean) and got[203] and 204 not in got
    compare(spark, str(tmp_path), c, queries[-6:], {"title": 3.5})
    one = search_index.search(spark, str(tmp_path), spark.createDataFrame([(1, ["treatment"], False), (2, ["-", ""], True)], "query_id int, phrases array<string>, every boolean"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(term" in plan or "EqualTo(term" in plan  # only the stem's bucket and rows are read
    assert {r.query_id for r in one.collect()} == {1}


def test_index_needs_documents_with_ids(spark, tmp_path):
    with pytest.raises(ValueError, match="needs documents"):
        search_index.build(spark.createDataFrame([], "doc_id int, t string"), str(tmp_path / "a"), "doc_id", ["t"])
    with pytest.raises(Exception, match="no id"):
        search_index.build(spark.createDataFrame([(None, "x")], "doc_id int, t string"), str(tmp_path / "b"), "doc_id", ["t"])
