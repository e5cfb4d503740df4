"""Containment of needles, nearest sizes, kept sets, mined passages: against nested loops and rows taken one by one."""

import random
import re
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from loamgrid.operators import containment, nearest, retrieval, sampling, search_index

ROWS = [(1, "Ein Straßen-Café, ﬁne!"), (2, "STRASSENCAFÉ fine fine"), (3, "nothing"), (4, None), (5, ""), (6, "aaaa"), (6, "aaaa b"), (7, "x" * 50_000 + "needle" + "y" * 9)]
NEEDLES = [(1, "strassencafé"), (2, "ＦＩＮＥ"), (3, "aa"), (4, "aaa"), (5, "needle"), (6, "!?"), (7, None), (8, "fine"), (9, "café fine"), (10, "straßencafé")]


def form(x):
    return "".join(c for c in unicodedata.normalize("NFKC", x).casefold() if c.isalnum())


def test_contained_equals_nested_loops(spark):
    rows = spark.createDataFrame([(*r, "q") for r in ROWS], "id int, t string, form string")
    needles = spark.createDataFrame(NEEDLES, "n int, s string")
    want = set()
    for i, t in ROWS:
        for n, s in NEEDLES:
            x, y = form(t or ""), form(s or "")
            if y and y in x:
                at = [k for k in range(len(x)) if x.startswith(y, k)]
                want.add((i, n, at[0], len(at), t))
    for most in (containment.BLOCK_CHARS, 30):  # one automaton, and several
        got = containment.contained(rows, needles, "id", "t", "n", "s", most).collect()
        assert sorted((r[0], r[1], r[2], r[3]) for r in got) == sorted(w[:4] for w in want)
    assert containment.contained(rows.limit(0), needles, "id", "t", "n", "s").count() == 0
    assert containment.contained(rows, needles.where("n = 6"), "id", "t", "n", "s").count() == 0


def test_coverage_counts_rows_and_matches(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 3, "y"), (None, 4, "z")], "src string, id int, t string")
    found = spark.createDataFrame([(1,), (1,), (3,)], "id int")
    got = {r.src: tuple(r)[1:] for r in containment.coverage(rows, found, "src", "id", "t").collect()}
    assert {k: (v[0], v[2], v[3]) for k, v in got.items()} == {"a": (2, 2, 1), "b": (1, 1, 1), None: (1, 0, 0)}
    again = {r.src: r.sha256 for r in containment.coverage(rows.repartition(3), found, "src", "id", "t").collect()}
    assert again == {k: v[1] for k, v in got.items()} and len(set(again.values())) == 3


@pytest.mark.parametrize("seed", [1])
def test_closest_negative_equals_all_pairs(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(160):
        size = rnd.choice([7, 7, 7, rnd.randrange(40), rnd.randrange(3000)])
        subject = rnd.choice(["s1", "s1", "s1", "s2", "s3", None if rnd.random() < 0.1 else "s4"])
        rows.append((i, None if rnd.random() < 0.03 else size, subject, rnd.choice(["yes", "NO", "common", "", None, "rare"]), rnd.choice(["common words", "common no", "yes common", "Yes and no", None])))
    got = nearest.closest_negative(spark.createDataFrame(rows, "id int, n int, s string, a string, t string"), "id", "n", "s", "a", "t")
    want = {}
    for i, n, s, a, _ in rows:
        fits = [(abs(n - m), j) for j, m, u, _, t in rows if n is not None and m is not None and s is not None and u is not None and u != s and t is not None and (a is None or a.lower() not in t.lower())]
        gap, j = min(fits, default=(None, None))
        want[i] = (j, gap)
    assert {r.id: (r.negative, r.gap) for r in got.collect()} == want


def _negatives(rows):
    want = {}
    for i, n, s, a, _ in rows:
        fits = [(abs(n - m), j) for j, m, u, _, t in rows if u != s and (a is None or a.lower() not in t.lower())]
        gap, j = min(fits, default=(None, None))
        want[i] = (j, gap)
    return want


def test_closest_negative_between_sizes_far_apart(spark):
    rows = [(i, 10**11 * (i // 3) + i % 3, f"s{i % 4 // 2}", "yes" if i % 5 else None, ["yes", "no"][i // 3 % 2]) for i in range(24)]
    got = nearest.closest_negative(spark.createDataFrame(rows, "id int, n long, s string, a string, t string"), "id", "n", "s", "a", "t")
    assert {r.id: (r.negative, r.gap) for r in got.collect()} == _negatives(rows)


@pytest.mark.parametrize("lists", [1, 50])
def test_closest_negative_lists_the_texts_without_common_answers(spark, monkeypatch, lists):
    for name, value in (("DENSE", 4), ("TOP", 1), ("OPEN", 2), ("LISTS", lists), ("SENT", 300)):
        monkeypatch.setattr(nearest, name, value)
    rnd = random.Random(4)
    rows = []
    for i in range(400):
        text = " ".join(w for w in ("alpha", "beta", "gamma", "delta") if rnd.random() < 0.97)
        rows.append((i, rnd.choice([3, 3, 4, rnd.randrange(60), rnd.randrange(900)]), rnd.choice(["s1", "s1", "s1", "s2", "s3"]), rnd.choice(["alpha", "BETA", "gamma", "delta", "lph", "a", "none", None]), text + " a" * (i % 100 > 0)))
    got = nearest.closest_negative(spark.createDataFrame(rows, "id int, n int, s string, a string, t string"), "id", "n", "s", "a", "t")
    assert {r.id: (r.negative, r.gap) for r in got.collect()} == _negatives(rows)
    alone = nearest.closest_negative(spark.createDataFrame([(*r[:2], "s1", *r[3:]) for r in rows], "id int, n int, s string, a string, t string"), "id", "n", "s", "a", "t")
    assert alone.count() == 400 and alone.where("negative IS NOT NULL").count() == 0


def test_kept_questions_equal_insertion_one_by_one(spark):
    rnd = random.Random(9)
    rows, text = [], [f"word{rnd.randrange(90)}" for _ in range(14)]
    for i in range(500):  # chains: each is a small change of one before
        text = list(text) if rnd.random() < 0.8 else [f"word{rnd.randrange(90)}" for _ in range(14)]
        text[rnd.randrange(14)] = f"word{rnd.randrange(90)}"
        rows.append((i, " ".join(text)))
    rows += [(500, rows[3][1].upper() + "!"), (501, None), (502, "?"), (503, "")]
    spaced = lambda t: " ".join(re.findall("[a-z0-9]+", (t or "").lower()))
    kept, seen = [], set()
    for i, t in rows:
        q = spaced(t)
        if q and q in seen:
            continue
        seen.add(q)
        grams = set(zip(q.split(), q.split()[1:], strict=False))
        near = lambda k, q=q, grams=grams: len(grams & k[2]) >= 2 and min(len(q), len(k[1])) >= 0.8 * max(len(q), len(k[1])) and SequenceMatcher(None, k[1], q, autojunk=False).ratio() >= 0.9
        if not q or not any(near(k) for k in kept if k[1]):
            kept.append((i, q, grams))
    got = sampling.kept_questions(spark.createDataFrame(rows, "id int, t string"), "id", "t")
    assert sorted(r.id for r in got.collect()) == sorted(k[0] for k in kept)


def test_kept_set_of_a_chain_and_of_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 21), (20, 22), (21, 22)], "a int, b int")
    assert sorted(r.id for r in nearest.kept_set(chain).collect()) == [1, 3, 5, 7, 9, 21, 22]
    assert nearest.kept_set(chain.limit(0)).count() == 0


def test_mined_passages_come_from_the_three_searches(spark, tmp_path):
    docs = [(1, "the spleen was injured and observation sufficed " * 8), (2, "The Spleen was INJURED and observation sufficed " * 8), (3, "unrelated words about weather " * 10), (4, "observation " + "filler " * 80), (5, "spleen injury"), (6, None)]
    d = spark.createDataFrame(docs, "doc_id int, text string").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    search_index.build(d, str(tmp_path), "doc_id", ["text"], 4)
    q = spark.createDataFrame([(1, "a 50 year old with splenic injury", "the spleen was injured", "observation"), (2, "zzz", None, "yyy")], "item_id bigint, question string, reason string, target string")
    got = retrieval.mined(d, q, str(tmp_path), {"question": 0.35, "reason": 0.45, "target": 0.2}).orderBy("rank").collect()
    assert [r.item_id for r in got] == [1, 1, 1] and [r.id for r in got][0] == 1 and {r.id for r in got} == {1, 4, 5}  # one body of two, none without a term
