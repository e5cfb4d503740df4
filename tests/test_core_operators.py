"""Operators that SQL does not express, against plain versions, and rules on hand-made rows."""

import io
import math
import random
import tarfile
import unicodedata
import zipfile
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from loamgrid.functions import text as T
from loamgrid.operators import retrieval, sampling, sequences, statistics
from loamgrid.sources import files


def test_normal_forms(spark):
    texts = ["Ａ１ ﬁn Straße  x.", "", None, "É É 漢 ½.."]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in rows.select("i", T.compatible_alnum(F.col("t")).alias("a"), T.answer_key(F.col("t")).alias("k")).collect():
        t = texts[r.i]
        if t is None:
            assert r.a is None and r.k is None
            continue
        assert r.a == "".join(c for c in unicodedata.normalize("NFKC", t).casefold() if c.isalnum())
        assert r.k == " ".join(t.casefold().split()).rstrip(".")


def test_near_questions_against_all_pairs(spark):
    rnd, words = random.Random(3), [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(15):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 8, 15]))]
        for _ in range(3):
            own = list(base)
            own[rnd.randrange(len(own))] = rnd.choice(words)
            texts.append(" ".join(own) + rnd.choice(["?", ""]))
    texts += ["", None, texts[0] + "!"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, t string")
    got = {(r.a, r.b): r.score for r in sampling.near_questions(rows, "id", "t").collect()}
    first = {}
    for i, t in enumerate(texts):
        q = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").lower()).split())
        if q:
            first.setdefault(q, i)
    want, grams = {}, lambda q: set(zip(q.split(), q.split()[1:], strict=False))
    for a, i in first.items():
        for b, j in first.items():
            if i < j and len(grams(a) & grams(b)) >= 2 and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
                s = SequenceMatcher(None, a, b, autojunk=False).ratio()
                if s >= 0.9:
                    want[i, j] = s
    assert got == want and want


def test_sentence_spans_cover_the_words(spark):
    texts = ["One two three. Four five. " * 40, "no marks " * 100, "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, t string")
    by = {}
    for r in sampling.sentence_spans(rows, "id", "t", 16).orderBy("start").collect():
        assert r.start == by.get(r.id, 0) and 0 < r.stop - r.start <= 16
        by[r.id] = r.stop
    assert by == {0: 200, 1: 200}
    cuts = [r.stop for r in sampling.sentence_spans(rows.where("id = 0"), "id", "t", 16).collect()]
    assert all(c % 5 in (0, 3) for c in cuts)


def test_batches_stay_in_the_budget(spark):
    sizes = [5, 1, 9, 9, 30, 2, 2, 2, 40, 1]
    rows = spark.createDataFrame([("g", i, n) for i, n in enumerate(sizes)], "g string, i bigint, n bigint")
    got = sequences.micro_batches(rows, "g", "i", "n", 3, 30).orderBy("i").collect()
    for b in {r.batch for r in got}:
        own = [r.n for r in got if r.batch == b]
        assert len(own) <= 3 and (len(own) == 1 or len(own) * max(own) <= 30)
    assert [r.batch for r in got] == sorted(r.batch for r in got)
    got = sequences.length_batches(rows, "g", "n", "i", 4, 40).orderBy("n", "i").collect()
    assert [r.batch for r in got] == [0, 0, 0, 0, 0, 1, 1, 1, 2, 3] or all(len([r for r in got if r.batch == b]) <= 4 for b in {r.batch for r in got})


@pytest.mark.parametrize("sizes", [[3, 4, 2], [5, 5, 1], [9], [4, 4, 5], [2, 1, 1, 1]])
def test_no_block_of_one_token(spark, sizes):
    rows = spark.createDataFrame([("s", i, n) for i, n in enumerate(sizes)], "s string, i bigint, n bigint")
    got = sequences.packed_blocks(rows, "s", "i", "n", 4).orderBy("block", "block_start").collect()
    lengths = {}
    for r in got:
        assert r.block_start == lengths.get(r.block, 0)
        lengths[r.block] = r.block_end
    assert sum(lengths.values()) == sum(sizes) and all(1 < n <= 4 for n in lengths.values())
    assert all(n == 4 for b, n in lengths.items() if b < max(lengths) - 1)


def test_bootstrap_is_near_the_normal_interval(spark):
    rnd = random.Random(5)
    values = [rnd.gauss(1, 2) for _ in range(2000)]
    rows = spark.createDataFrame([(i, i % 4, v) for i, v in enumerate(values)], "i bigint, s bigint, v double")
    mean = sum(values) / len(values)
    half = 1.96 * (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5 / len(values) ** 0.5
    for strata in (None, ["s"]):
        r = statistics.bootstrap(rows, ["i"], "v", strata=strata, replicates=600).first()
        assert math.isclose(r.estimate, mean) and abs((r.high - r.low) / 2 - half) < 0.15 * half and r.low < mean < r.high
    assert statistics.bootstrap(rows.limit(0), ["i"], "v").first().low is None


def test_exact_bootstrap_draws_the_places_of_its_hashes(spark, monkeypatch):
    import hashlib

    rnd = random.Random(8)
    items = [*rnd.sample(range(-(10**12), 10**12), 60), None]
    values = [None if k % 9 == 4 else rnd.gauss(1, 2) for k in range(61)]
    rows = spark.createDataFrame(list(zip(items, values, strict=True)), "k bigint, v double").repartition(5)
    placed = [v for _, v in sorted(zip(items, values, strict=True), key=lambda x: (x[0] is None, x[0] or 0))]
    for cells, slices, seed, least in ((1 << 21, 256, None, 0), (200, 7, None, 0), (40, 50, 42, 0), (30, 7, 3, 10**13)):
        monkeypatch.setattr(statistics, "CELLS", cells)
        monkeypatch.setattr(statistics, "SLICE", slices)
        part = rows.where(f"k > {-(10**13)} OR k IS NULL") if not least else rows.where("k IS NULL").withColumn("v", F.lit(2.5))
        known = placed if not least else [2.5]
        means = []
        for r in range(50):
            key = "" if seed is None else f"{seed}:"
            got = [known[int(hashlib.sha256(f"{key}{r}:{i}".encode()).hexdigest()[:8], 16) % len(known)] for i in range(len(known))]
            got = [v for v in got if v is not None]
            means.append(sum(got) / len(got))
        means.sort()
        want = []
        for q in (0.025, 0.975):
            at = q * (len(means) - 1)
            want.append(means[int(at)] + (at - int(at)) * (means[min(int(at) + 1, 49)] - means[int(at)]))
        out = statistics.exact_bootstrap(part, "k", "v", 50, seed).collect()
        assert len(out) == 1 and math.isclose(out[0].low, want[0]) and math.isclose(out[0].high, want[1])
    assert list(map(tuple, statistics.exact_bootstrap(rows.limit(0), "k", "v", 50).collect())) == [(None, None)]


def test_dense_search_is_exact_and_parameters_are_checked(spark):
    rnd = random.Random(6)
    vectors = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(60)] + [[0.0] * 8]
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")
    got = retrieval.dense(rows, rows.where("vec_id < 3").withColumnRenamed("vec_id", "q"), k=5, blocks=7).collect()
    for q in range(3):
        score = lambda v: 0.0 if not any(v) else sum(a * b for a, b in zip(vectors[q], v, strict=True)) / math.hypot(*vectors[q]) / math.hypot(*v)  # noqa: B023, E731
        best = sorted(range(61), key=lambda i: (-round(score(vectors[i]), 6), i))[:5]
        assert [r.id for r in sorted((r for r in got if r.q == q), key=lambda r: r["rank"])] == best
    empty = spark.createDataFrame([(1, "...")], "doc_id bigint, text string")
    with pytest.raises(Exception, match="no terms"):
        retrieval.corpus_size(empty, "text").collect()
    with pytest.raises(ValueError):
        retrieval.fuse(rows, rows, "q", weight=1.0)
    with pytest.raises(ValueError):
        sampling.quota_sample(spark.createDataFrame([("a", ["x"], 1)], "k string, f array<string>, id bigint"), "k", "f", "id", {"a": 2})


def test_archives_and_manifests(spark, tmp_path):
    body = "<book><title>T</title><body><sec id='s1'><title>Head</title><p>" + "long words " * 10 + "</p><p>short</p></sec><sec><title>References</title><p>" + "x " * 60 + "</p></sec></body></book>"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.xml", body)
        z.writestr("raw.bin", b"\xff\xfe")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("two.xml")
        info.size = len(body)
        t.addfile(info, io.BytesIO(body.encode()))
    m = files.zip_members(spark, str(tmp_path))
    assert {r.member: r.text is None for r in m.collect()} == {"one.xml": False, "raw.bin": True, "two.xml": False}
    got = files.xml_passages(m.where("member LIKE '%.xml'")).collect()
    assert {(r.member, r.section, r.title) for r in got} == {("one.xml", "s1", "T -- Head"), ("two.xml", "s1", "T -- Head")} and all(r.text == ("long words " * 10).strip() for r in got)
    listed = m.select("member", "bytes", "sha256")
    assert files.manifest_faults(m, listed).count() == 0
    odd = listed.where("member <> 'raw.bin'").withColumn("bytes", F.col("bytes") + F.when(F.col("member") == "one.xml", 1).otherwise(0)).unionAll(listed.limit(1).select(F.lit("lost"), "bytes", "sha256"))
    assert {tuple(r) for r in files.manifest_faults(m, odd).collect()} == {("raw.bin", "unlisted"), ("one.xml", "changed"), ("lost", "missing")}


def test_ledgers_sinks_and_pages(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l/a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n{"a": 3')
    assert sorted(r.a for r in files.read_ledger(spark, str(tmp_path / "l"), "a int").collect()) == [1, 2]
    (tmp_path / "l/b.jsonl").write_text('{"a": 1\n{"a": 2}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_ledger(spark, str(tmp_path / "l"), "a int").collect()
    for n in (3, 5):
        files.replace_jsonl(spark.range(n), str(tmp_path / "out"))
        assert files.read_replaced(spark, str(tmp_path / "out"), "id int").count() == n
    page = spark.createDataFrame([("<p>a  b</p>\n<script>x</script>\n  <b>c</b> \n",), (None,)], "h string")
    assert [r[0] for r in page.select(files.page_text(F.col("h"), 3)).collect()] == ["a b...", None]
    paths = files.with_image_paths(spark.createDataFrame([("x.png",), ("/y",), ("http://z",), (None,)], "image_path string"), "/d/")
    assert [r[0] for r in paths.collect()] == ["/d/x.png", "/y", "http://z", None]
    topics = files.file_topics(spark.createDataFrame([("012_heart.txt", "t"), ("x.txt", "t")], "file_name string, text string"), [(1, 20, "cardiology")])
    assert [(r.number, r.title, r.topic) for r in topics.collect()] == [(12, "heart", "cardiology"), (None, "x", None)]
