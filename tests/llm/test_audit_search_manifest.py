"""Filter audit, exact search and Merkle manifest against SQL on the tables and brute force on planted edges."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.llm import filters, merkle, queries, topk

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_top_k", "op13_merkle"])
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    cur = c.execute(queries.ORACLE[name])
    cols = [x[0] for x in cur.description]
    got = queries.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(repr, map(tuple, got.select(cols).collect()))) == sorted(map(repr, cur.fetchall()))


# --- filters ---------------------------------------------------------------------------------------------------------------------
def brute_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return len(w), len(set(w)), len(re.findall("[A-Z]", t)), len(re.findall(r"[#$%&*|]", t)), len(t), hashlib.sha256(t.encode()).digest()


def hard_texts(seed=1):
    rnd = random.Random(seed)
    units = ["a", "Ab", "ä", "語", "#", "x" * 63, "x" * 64, "x" * 65, "y" * 200, "\x1c", " ", "\U0001f600", "word", "words"]
    gaps = [" ", "  ", "\t", "\n", "\x0b\x0c", "\r\n"]
    made = ["".join(rnd.choice(units) + rnd.choice([*gaps, ""]) for _ in range(rnd.choice([1, 3, 40, 300]))) for _ in range(150)]
    return [*made, "", " ", "\n\n", "ends ", " starts", "Q" * 70_000, "deep " * 50_000 + "sea", "abcdefgh abcdefghi abcdefg abcdefgh"]


def test_scan_equals_brute_force(spark, monkeypatch):
    texts = hard_texts()
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(-1, None, "z")], "id bigint, t string, k0 string")
    for size in (filters.CHUNK_BYTES, 500):
        monkeypatch.setattr(filters, "CHUNK_BYTES", size)
        got = {r.k0: tuple(bytes(v) if isinstance(v, bytearray) else v for v in tuple(r)[1:]) for r in filters.scan(df, [F.col("id")], F.col("t")).collect()}
        assert got == {i: brute_counts(t) for i, t in enumerate(texts)} | {-1: brute_counts("")}


def test_equal_hashes_of_different_words_are_told_apart(monkeypatch):
    texts = [b"aa bb cc aa", b"x y x", b"longer-than-eight longer-than-nine! q"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    monkeypatch.setattr(filters, "ODD", np.uint64(0))  # all hashes are 0
    assert filters.measure(data, offsets)[1].tolist() == [3, 2, 3]


def brute_audit(docs, labels):
    good, bad = ({x[0] for x in labels if x[0] is not None and x[c] == 1} for c in (1, 2))
    texts = [(i, t or "", s or "") for i, t, s in docs]
    least = {}
    for i, t, _ in texts:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    rows = []
    for i, t, s in texts:
        n, d, c, m, k, _ = brute_counts(t)
        rows.append((s, {"A": n < 200, "B": 100 * d < 50 * n, "C": 100 * c > 2 * k, "D": m > 0, "E": i is not None and least[t] < i}, i in good, i in bad))
    out = {}
    for s in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == s]
        removed = {}
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for k, x in enumerate(order, 1):
                gone = [r for r in left if r[1][x]]
                left = [r for r in left if not r[1][x]]
                removed[order, x] = len(gone)
                alone = sum(r[1][x] and sum(r[1].values()) == 1 for r in mine)
                out[s, order, k] = [len(left), len(gone), sum(r[1][x] for r in mine) - len(gone), alone, sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, x in enumerate(order, 1):
                out[s, order, k].append(sum(v for (_, y), v in removed.items() if y == x))
    return out


def test_audit_with_nulls_repeats_and_clashing_names(spark):
    rnd = random.Random(3)
    pool = [" ".join(rnd.choice(["Aa", "bb", "c", "d%", f"w{i}"]) for i in range(n)) for n in (1, 150, 220, 300) for _ in range(4)] + ["", None]
    docs = [(rnd.choice([None, *range(40)]), rnd.choice(pool), rnd.choice(["s", "hot", "hot", "hot", None, ""])) for _ in range(150)]
    labels = [(rnd.choice([None, *range(40)]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(40)]
    df = spark.createDataFrame([(*d, 7, "m", 1) for d in docs], "doc_id bigint, text string, source string, mask int, digest string, n bigint")
    ld = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {tuple(r)[:3]: list(tuple(r)[3:]) for r in filters.audit(df, ld).collect()}
    assert got == brute_audit(docs, labels)
    assert filters.audit(df.limit(0), ld).count() == 0
    assert filters.audit(df, ld.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


# --- search ----------------------------------------------------------------------------------------------------------------------
def brute_top(rows, k, scale=64):
    """(query id, rank, id, score), by row."""
    live = [(r, i, [int(np.floor(scale * np.float64(np.float32(c)))) for c in v]) for r, (i, v) in enumerate(rows) if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for r, i, q in live:
        if i is not None and i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j is None, j or 0, j) for s, j, x in live if s != r and len(x) == len(q))
            out += [(i, n, j, -s) for n, (s, _, _, j) in enumerate(scored[:k], 1)]
    return sorted(map(repr, out))


def top_rows(spark, rows, k):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, rid int, id string")
    return sorted(repr(tuple(r)) for r in topk.nearest(df, F.col("vec_id") % 20 == 0, k).collect())


def test_search_equals_brute_force(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(6, 8))
    rows = [(int(i), (centres[i % 6] + 0.1 * rnd.normal(size=8)).tolist()) for i in range(500)]
    rows += [(500 + i, rows[7][1]) for i in range(150)]  # one vector with many copies: ties
    rows += [(None, rows[7][1]), (None, rows[8][1]), (0, rows[3][1]), (0, rows[3][1]), (-20, [0.0] * 8)]
    rows += [(1000, None), (1020, [1.0, None] + [0.0] * 6), (1040, [float("nan")] * 8), (1060, [float("inf")] * 8), (1080, [1.0, 2.0]), (1081, [3.0, -1.5]), (1100, []), (1101, []), (1120, [5.0])]
    want = brute_top(rows, 5)
    assert top_rows(spark, rows, 5) == want
    # Small blocks of queries, seeds and parts; each ends in the same rows.
    for name, value in (("QUERY_BYTES", 3000), ("SEEDS", 7), ("STEP", 3), ("PIVOTS", 2)):
        monkeypatch.setattr(topk, name, value)
    assert top_rows(spark, rows, 5) == want


def test_search_spares_candidates_and_holds_whole_numbers(spark):
    rnd = np.random.default_rng(6)
    centres = 50 * rnd.normal(size=(8, 6))
    v = np.floor(centres[np.arange(4000) % 8] + rnd.normal(size=(4000, 6)))
    pivots = topk.farthest_first(v[:500], 16)
    d = topk.distances(v, pivots)
    queries = {"rid": np.arange(40), "v": v[:40], "d": d[:40].astype(np.float32)}
    state = topk.Search(queries, np.full(40, -float(2**53)), float((pivots**2).sum(axis=1).max()), 5)
    seen = []
    state.bounds = lambda own, norm, p, f=state.bounds: seen.append(f(own, norm, p)) or seen[-1]
    for lo in range(0, 4000, 500):
        state.add(np.arange(lo, lo + 500), np.arange(lo, lo + 500), v[lo : lo + 500], d[lo : lo + 500])
    exact = v[:40] @ v.T
    assert all((b >= exact[:, i * 500 : (i + 1) * 500]).all() for i, b in enumerate(seen))  # bounds hold
    assert (np.concatenate(seen, axis=1) < state.limit[:40, None]).mean() > 0.5  # and spare most pairs
    big = [(20, [1e6, -1e6, 1e6]), (1, [1e6, 1e6, 1e6]), (2, [2e6, 1.0, -3e6])]  # products beyond 2 ** 53: whole numbers
    assert top_rows(spark, big, 5) == brute_top(big, 5)
    with pytest.raises(ValueError):
        top_rows(spark, [(20, [1e12]), (1, [1e12])], 5)


def test_search_without_rows_or_queries(spark):
    assert top_rows(spark, [], 3) == [] and top_rows(spark, [(1, [1.0])], 3) == [] and top_rows(spark, [(20, [1.0])], 3) == []


# --- manifest --------------------------------------------------------------------------------------------------------------------
def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_manifest(rows):
    def leaf(r, more=0):
        vals = [r[0], r[1], r[2], None if r[3] is None else r[3] + more, r[4]]
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in vals))

    def tree(nodes):
        paths, at, now = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(now) > 1:
            for i, p in enumerate(paths):
                j = at[i] ^ 1
                p.append(("<" if at[i] % 2 else ">") + now[j] if j < len(now) else "=")
                at[i] //= 2
            now = [h("".join(now[i : i + 2])) for i in range(0, len(now), 2)]
        return now[0], paths

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    subs = {g: tree([leaf(r) for r in rs]) for g, rs in groups.items()}
    root, above = tree([subs[g][0] for g in langs])
    out = []
    for g, up in zip(langs, above, strict=True):
        for r, p in zip(groups[g], subs[g][1], strict=True):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(r, int(tampered))
            for s in p + up:
                node = h(s[1:] + node if s[0] == "<" else node + s[1:])
            out.append((r[0], leaf(r), subs[g][0], root, h("".join(s[1:] for s in p + up)), node, node == root))
    return sorted(map(repr, out))


@pytest.mark.parametrize("height", [1, 2, 7])
def test_manifest_equals_brute_force(spark, monkeypatch, tmp_path, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rnd = random.Random(height)
    rows = [(i, rnd.choice(["s", None]), lang, rnd.choice([None, i]), rnd.choice([None, "", "text ä"])) for lang, n in (("en", 37), (None, 16), ("ä", 1), ("", 2), ("zz", 5)) for i in range(n)]
    rows += [(None, "s", "en", 1, "x"), (5, "s", "en", 5, "twin"), (5, "s", "en", 5, "twin"), (5, "s", "zz", 9, "other")]
    rnd.shuffle(rows)
    folder = str(tmp_path)
    spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, tree int, hash string").write.parquet(f"{folder}/documents.parquet")
    assert sorted(repr(tuple(r)) for r in queries.op13_merkle(spark, folder).collect()) == brute_manifest(rows)


def test_manifest_of_one_row_and_of_none(spark, tmp_path):
    for n in (1, 0):
        rows = [(i, "s", "en", 3, "abc") for i in range(n)]
        spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").write.parquet(f"{tmp_path}/{n}/documents.parquet")
        got = queries.op13_merkle(spark, f"{tmp_path}/{n}")
        assert sorted(repr(tuple(r)) for r in got.collect()) == (brute_manifest(rows) if n else [])
        assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_numbers_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"))
    for n in (1, 5, 40):
        got = merkle.numbered(df, ["g", "k"], n).orderBy("number").collect()
        assert [r.number for r in got] == list(range(1000)) and [(r.g, r.k) for r in got] == sorted((r.g, r.k) for r in got)
