"""N-gram Jaccard join: the sparse product of the document by n-gram incidence matrix, in blocks, with pairs below size bounds left out.

Rows of the matrix are distinct shingle sets (exact copies are one row), columns are shingle hashes. Two sets of Jaccard similarity of at
least 0.8 share a column among the first fifth of their columns in any common order, so the product runs over those only, rare columns
first. Overlap counts of a pair are summed over the blocks of few rows, pairs whose counts are below the bound that their sizes demand are
dropped, and the rest are verified on whole sets. Blocks of many rows, the near-copy groups, are not multiplied: their rows are written
as differences to what most rows of the group have, and the product goes on among those (``deltas``).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.llm.common import _arrow_schema, cut, discard, small_batches, trim, worker_state
from loamgrid.llm.graph import components

WORDS = 5
#: Every so many documents are read to estimate which columns are common; that only orders columns, no result depends on it.
SAMPLE, COMMON, COMMON_MOST = 16, 2, 1_000_000
#: A block is multiplied directly where that makes at most so many pairs a row; any larger one is split by differences.
DIRECT = 48
#: Documents of the sample from which a column is dealt by (column, row) instead of by column.
HOT = 64
#: Copies of a group's row in a join on the group, whose rows are dealt to as many parts.
SALT = 16
#: Rows of a table of one small row per group up to which it is broadcast.
BROADCAST_GROUPS = 200_000
#: Ids of documents that stay (8 bytes each), and of active ones, up to which they are broadcast to filter the texts.
BROADCAST_IDS, BROADCAST_ACTIVE = 2_000_000, 500_000
#: First columns that one task compares: tasks grow in number, not in size.
DEALT = 1_000_000
CACHE = 100_000
PRIMES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _halves(name: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", name)


def _node():
    return F.struct("n", "h", "g").alias("node")


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * PRIMES[1]
        x = (x ^ (x >> np.uint64(29))) * PRIMES[2]
        return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles; word hashes are kept."""

    def __init__(self):
        import xxhash

        self.digest, self.digest_128 = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > CACHE:
            known.clear()
        hashes = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = self.digest(w)
            hashes.append(h)
        h = np.array(hashes, np.uint64)
        n = len(h)
        size = min(n, WORDS)
        with np.errstate(over="ignore"):
            acc = np.full(n - size + 1, size, np.uint64)
            for i in range(size):
                acc = acc * PRIMES[0] + h[i : n - size + 1 + i]
        return np.unique(_mix(acc))

    def name(self, shingles: np.ndarray) -> bytes:
        """A set's 128-bit name; with its size, a set's identity."""
        return self.digest_128(shingles.tobytes())


def _rows(df: DataFrame, make, ddl: str) -> DataFrame:
    """``make()`` gives ``fn(id, text) -> rows``; batches of rows go out as soon as they hold enough values."""
    out = _arrow_schema(df.sparkSession, ddl)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(None)
        fn = make()
        rows, held = [], 0

        def pack():
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i in range(batch.num_rows):
                for row, weight in fn(ids[i], batch.column(1)[i].as_py() or ""):
                    rows.append(row)
                    held += weight
                if held > 250_000:
                    yield pack()
                    rows, held = [], 0
        if rows:
            yield pack()

    return df.mapInArrow(run, ddl)


def common_columns(texts: DataFrame) -> list[tuple[int, int]]:
    """Hashes that a sample of documents repeats, with their counts: the most frequent, down to the least count that leaves at most COMMON_MOST."""

    def make():
        shingles = Shingler()
        seen: set[bytes] = set()

        def fn(_, text):
            s = shingles(text)
            if not len(s) or (name := shingles.name(s)) in seen:
                return []
            seen.add(name)
            return [((int(x),), 1) for x in s.view(np.int64).tolist()]

        return fn

    sample = texts.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(SAMPLE)) == 0)
    counts = cut(_rows(sample, make, "s bigint").groupBy("s").count().where(F.col("count") >= COMMON))
    # No task sorts them: of each count, how many columns have it is enough to tell where to stop.
    least, total = None, 0
    for r in sorted(counts.groupBy("count").agg(F.count(F.lit(1)).alias("m")).collect(), reverse=True):
        total += r["m"]
        if total > COMMON_MOST:
            break
        least = r["count"]
    out = [] if least is None else [(r["s"], r["count"]) for r in counts.where(F.col("count") >= least).collect()]
    discard(counts)
    return out


class Order:
    """The common order of columns: by count in the sample, then by hash."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts

    def __call__(self, columns: np.ndarray) -> tuple[np.ndarray, int]:
        """``columns`` in order, and how many of them are not hot."""
        if not len(self.keys):
            return columns, len(columns)
        at = np.minimum(np.searchsorted(self.keys, columns), len(self.keys) - 1)
        often = np.where(self.keys[at] == columns, self.counts[at], 0)
        return columns[np.argsort(often, kind="stable")], int((often < HOT).sum())


def shared_order(texts: DataFrame):
    """``Order``'s arrays, broadcast: at most COMMON_MOST columns of 16 bytes."""
    common = sorted(common_columns(texts))
    return texts.sparkSession.sparkContext.broadcast((np.array([c[0] for c in common], np.int64), np.array([c[1] for c in common], np.int64)))


def shingle_sets(texts: DataFrame, shared) -> DataFrame:
    """``id, n, h, g, cold, first``: size and name of each text's set, and its first columns, n - ceil(0.8 n) + 1 of them, of which ``cold`` are not hot."""

    def make():
        shingles, order = Shingler(), Order(*shared.value)
        seen: set[bytes] = set()

        def fn(i, text):
            s = shingles(text)
            n = len(s)
            if not n:
                return [((i, 0, 0, 0, 0, []), 1)]
            name = shingles.name(s)
            if name in seen:  # a copy within this task: its columns are out already
                return [((i, n, *_halves(name), 0, []), 1)]
            if len(seen) < 500_000:
                seen.add(name)
            x, cold = order(s.view(np.int64))
            keep = n - (4 * n + 4) // 5 + 1
            return [((i, n, *_halves(name), min(cold, keep), x[:keep].tolist()), keep + 4)]

        return fn

    return _rows(texts, make, "id bigint, n int, h bigint, g bigint, cold int, first array<bigint>")


def whole_sets(texts: DataFrame, shared) -> DataFrame:
    """``node, s``: names and all columns of the texts' sets, in order; one row per node."""

    def make():
        shingles, order = Shingler(), Order(*shared.value)

        def fn(_, text):
            s = shingles(text)
            return [((len(s), *_halves(shingles.name(s)), order(s.view(np.int64))[0].tolist()), len(s))] if len(s) else []

        return fn

    return _rows(texts, make, "n int, h bigint, g bigint, s array<bigint>").select(_node(), "s").dropDuplicates(["node"])


def sets_of(nodes: DataFrame, texts: DataFrame, names: DataFrame, shared) -> DataFrame:
    """``whole_sets`` of the rows in ``nodes`` (``node``), as a written table, read from one text per node (``names``: ``node, least``).

    Where a text has another set because its id is repeated, its set is there too and joins with nothing.
    """
    ids = cut(nodes.join(names, "node").select(F.col("least").alias("id")).distinct())
    wanted = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_ACTIVE else ids, texts["id"].eqNullSafe(ids["id"]), "left_semi")
    out = cut(whole_sets(wanted, shared), "lz4_raw")
    discard(ids)
    return out


def _size(a: str, b: str) -> str:
    return f"5 * least({a}, {b}) >= 4 * greatest({a}, {b})"


def verified(pairs: DataFrame, texts: DataFrame, names: DataFrame, shared) -> DataFrame:
    """Those of the pairs ``a, b`` of nodes whose whole sets have 100 * intersection >= 80 * union, as a written table."""
    pairs = cut(pairs)
    nodes = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()
    sets = sets_of(nodes, texts, names, shared)
    x = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    same = F.size(F.array_intersect("sa", "sb"))
    out = cut(x.where(180 * same >= 80 * (F.col("a.n") + F.col("b.n"))).select("a", "b"))
    discard(pairs, sets)
    trim(texts.sparkSession)
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``n_shingles``, ``component_id``: the least id among all documents reachable by links.

    Words are runs of non-white-space after A-Z are lower-cased; texts of fewer than five words are one shingle; null texts and texts
    without words have none, link with nothing and are their own component. Rows that share an id are separate documents. A null
    id is never the least where another id is reachable. An empty table gives an empty table; other columns are not read.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[id_col]
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    shared = shared_order(texts)
    base = cut(shingle_sets(texts, shared))
    postings = base.select(F.posexplode("first").alias("at", "c"), "cold", _node())
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(base.agg(F.sum("cold").alias("n")).first()["n"] or 0) // DEALT))
    dealt = postings.where("at < cold").select("c", "at", "node").repartition(tasks, "c")
    # Columns that are not hot have few rows each: one pass over them, where they lie, tells those of one row only.
    of_column = Window.partitionBy("c")
    several = dealt.withColumn("one", F.min("node").over(of_column) == F.max("node").over(of_column)).where("NOT one").drop("one")
    live = cut(several.dropDuplicates(["c", "node"]).unionAll(postings.where("at >= cold").select("c", "at", "node").dropDuplicates(["c", "node"])))
    light = cut(base.select("id", "n", "h", "g"))
    discard(base)
    trim(spark)
    class_of = cut(light.where("n > 0").groupBy("n", "h", "g").agg(F.min("id").alias("least")).select(_node(), "least"))
    labels = link(live, texts, class_of, shared)
    discard(live)
    if labels is not None:
        of = class_of.join(labels, "node", "left").select("node", "least", "root")
        best = cut(of.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("best")))
        class_of = _per_group(of, best, ["root"], "left").select("node", F.coalesce("best", "least").alias("least"))
    out = light.select("id", _node()).join(class_of, "node", "left")
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("node.n").cast("long").alias("n_shingles"), F.coalesce("least", "id").cast(kind).alias("component_id"))


def _hopeful(k, a: str, b: str):
    """Whether ``k`` shared first columns can be those of a link: beyond them two sets share at most what the longer rest of them holds."""
    rest = F.greatest(F.floor(F.col(f"{a}.n") * 4 / 5), F.floor(F.col(f"{b}.n") * 4 / 5))
    return 9 * (k + rest + 1) >= 4 * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def link(live: DataFrame, texts: DataFrame, names: DataFrame, shared) -> DataFrame | None:
    """``node, root`` of the similarity graph over the columns in ``live`` (``c, at, node``): its components; None without links."""
    blocks = cut(live.groupBy("c").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("c", (F.col("m") > 2 * DIRECT).alias("many")))
    rows = live.join(blocks, "c")
    edges = deltas(groups_of(rows.where("many").select("c", "node"), texts, names, shared))
    labels = None if edges is None else cut(components(edges))
    few = rows.where("NOT many").select("c", "at", "node")
    root = F.col("node") if labels is None else F.coalesce("root", "node")
    own = cut((few if labels is None else few.join(labels, "node", "left")).select("c", "at", "node", root.alias("root")))
    x = own.select("c", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("at").alias("pa"))
    y = own.select("c", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("at").alias("pb"))
    # At the first column that a pair shares, what stands before it in either row is not shared: the rest must do.
    room = F.expr("9 * least(a.n - pa, b.n - pb) >= 4 * (a.n + b.n)")
    product = x.join(y, (x["c"] == y["c"]) & (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & F.expr(_size("a.n", "b.n")) & room).select("a", "b").distinct()
    first = own.groupBy("node").agg(F.collect_list("c").alias("cs"))
    both = product.join(first.select(F.col("node").alias("a"), F.col("cs").alias("ca")), "a").join(first.select(F.col("node").alias("b"), F.col("cs").alias("cb")), "b")
    # Columns of large blocks are not in ``first``: a pair that shares such a column is found by its differences.
    found = verified(both.where(_hopeful(F.size(F.array_intersect("ca", "cb")), "a", "b")).select("a", "b"), texts, names, shared)
    discard(own, blocks)
    if found.isEmpty():
        return labels
    if labels is None:
        return cut(components(found))
    for end in ("a", "b"):
        of = labels.select(F.col("node").alias(end), F.col("root").alias("r"))
        found = found.join(of, end, "left").withColumn(end, F.coalesce("r", end)).drop("r")
    top = cut(components(found))
    up = labels.join(top.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return cut(up.unionAll(top.join(labels, "node", "left_anti").select("node", "root")))


def groups_of(rows: DataFrame, texts: DataFrame, names: DataFrame, shared) -> DataFrame | None:
    """The rows of large blocks (``c, node``) by connected blocks, for ``deltas``; every pair of a block is in one group. None without rows."""
    rows = cut(rows)
    if rows.isEmpty():
        return None
    least = cut(rows.groupBy("node").agg(F.min("c").alias("lo")))
    tied = components(rows.join(least, "node").where("c <> lo").select(F.col("c").alias("a"), F.col("lo").alias("b")).distinct())
    tied = cut(tied.select(F.col("node").alias("lo"), "root"))
    sets = sets_of(least, texts, names, shared)
    group = F.struct(F.coalesce("root", "lo").alias("a"), F.lit(0).cast("long").alias("b")).alias("group")
    at = least.join(F.broadcast(tied) if tied.count() <= BROADCAST_GROUPS else tied, "lo", "left")
    out = cut(at.join(sets, "node").select(group, "node", F.col("node").alias("root"), F.lit(0).alias("lost"), "s"))
    discard(rows, least, tied, sets)
    return out


def _per_group(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join ``rows`` with the written table ``groups`` of one row per key: broadcast while that is small, else dealt to SALT parts of each group."""
    if groups.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), keys, how)
    part = F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int")
    return rows.withColumn("salt", part).join(groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), [*keys, "salt"], how).drop("salt")


def deltas(rows: DataFrame | None) -> DataFrame | None:
    """Links ``a, b`` that connect all linked rows of each group, for ``group, node, root, lost, s``; None without rows.

    ``s`` are a row's columns, ``lost`` counts columns that it is known not to share here. In a group, every row is replaced by its
    differences to the columns that most rows have: that leaves the distance of any two rows as it is. With ``cost = 9 * (differences +
    lost) - n``, two rows are linked where their distance is at most (n + n') / 9, so

    - where their costs add up to 0 or less, whatever the differences are: such links all lead to the row of least cost, and tying
      that row to each is enough;
    - else only if they share at least (cost + cost') / 18 differences. Differences of one row only are not shared and count as lost.
      Rows meet by a shared difference among their first ones, the rare ones first, as in the whole product. Few rows are compared
      at once; many are a group of their own, without that difference, with those before it lost (a pair meets at its first one).

    The sum of the differences falls from each level to the next, so the levels end. A row's ``root`` is only a hint to skip pairs.
    """
    edges = None
    while rows is not None:
        spark = rows.sparkSession
        size = cut(rows.groupBy("group").agg(F.count(F.lit(1)).alias("m")))
        times = rows.select("group", F.explode("s").alias("e")).groupBy("group", "e").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
        few = size.count() <= BROADCAST_GROUPS
        times = cut(times.join(F.broadcast(size) if few else size, "group").select("group", "e", (2 * F.col("k") > F.col("m")).alias("most"), F.expr("IF(2 * k > m, m - k, k)").alias("k")))
        most = cut(times.where("most").groupBy("group").agg(F.collect_list("e").alias("mode")))  # at most twice the mean size of a row
        part = F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int")
        x = rows.withColumn("salt", part).join(most.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["group", "salt"], "left")
        x = x.withColumn("mode", F.coalesce("mode", F.array().cast("array<bigint>"))).withColumn("d", F.concat(F.array_except("s", "mode"), F.array_except("mode", "s")))
        x = cut(x.select("group", "node", "root", "lost", "d", (9 * (F.size("d") + F.col("lost")) - F.col("node.n")).alias("cost")), "lz4_raw")
        centre = cut(x.groupBy("group").agg(F.min(F.struct("cost", "node", "root")).alias("centre")))
        tied = F.col("cost") + F.col("centre.cost") <= 0
        y = _per_group(x, centre, ["group"]).withColumn("tied", tied).withColumn("band", F.floor(F.log(F.col("node.n")) / F.log(F.lit(1.25))).cast("int"))
        y = y.withColumn("root", F.when(F.col("tied"), F.col("centre.root")).otherwise(F.col("root")))
        star = y.where("tied AND node <> centre.node").select(F.col("node").alias("a"), F.col("centre.node").alias("b"))
        # The least cost of any partner: of rows within a quarter of the size, so in the same band or one beside it.
        lows = y.groupBy("group", "band").agg(F.min("cost").alias("low"), F.min(F.when(~F.col("tied"), F.col("cost"))).alias("free"))
        lows = cut(lows.withColumn("band", F.explode(F.expr("array(band - 1, band, band + 1)"))).groupBy("group", "band").agg(F.min("low").alias("low"), F.min("free").alias("free")))
        y = _per_group(y, lows, ["group", "band"]).withColumn("need", F.greatest(F.lit(1), F.ceil((F.col("cost") + F.when(F.col("tied"), F.col("free")).otherwise(F.col("low"))) / 18)).cast("int"))
        y = y.where("need <= size(d)").select("group", "node", "root", "lost", "cost", "need", F.size("d").alias("n_d"), F.explode("d").alias("e"))
        y = y.join(times.where("k > 1").select("group", "e", "k"), ["group", "e"])
        y = y.groupBy("group", "node").agg(*[F.first(c).alias(c) for c in ("root", "lost", "cost", "need", "n_d")], F.array_sort(F.collect_list(F.struct("k", "e"))).alias("s"))
        y = y.where("need <= size(s)").select("group", "node", "root", (F.col("lost") + F.col("n_d") - F.size("s")).alias("lost"), "cost", "need", F.expr("transform(s, x -> x.e)").alias("s"))
        y = cut(y, "lz4_raw")
        z = y.select("group", "node", "root", "lost", "cost", "need", "s", F.posexplode(F.expr("slice(s, 1, size(s) - need + 1)")).alias("at", "e"))
        by_root = z.groupBy("group", "e", "root").agg(F.count(F.lit(1)).cast("double").alias("b"))
        blocks = by_root.groupBy("group", "e").agg(F.sum("b").alias("m"), ((F.sum("b") * F.sum("b") - F.sum(F.col("b") * F.col("b"))) / 2).alias("pairs")).where("pairs > 0")
        blocks = cut(blocks.select("group", "e", (F.col("pairs") > DIRECT * F.col("m")).alias("many")))
        z = cut(z.join(blocks, ["group", "e"]).select("group", "e", "many", "node", "root", (F.col("lost") + F.col("at")).alias("lost"), "cost", F.expr("slice(s, at + 1, size(s))").alias("s")), "lz4_raw")
        own = z.where("NOT many")
        a, b = (own.select("group", "e", F.col("node").alias(i), F.col("root").alias("r" + i), F.col("cost").alias("c" + i), F.col("s").alias("s" + i)) for i in "ab")
        same = F.expr("a < b AND ra <> rb AND 18 * least(size(sa), size(sb)) >= ca + cb AND 18 * size(array_intersect(sa, sb)) >= ca + cb")
        found = cut(star.unionAll(a.join(b, ["group", "e"]).where(same).select("a", "b")).distinct())
        edges = found if edges is None else edges.unionAll(found)
        deeper = F.struct(F.xxhash64("group", "e").alias("a"), F.xxhash64("e", "group", F.lit(7)).alias("b"))
        new = cut(z.where("many").select(deeper.alias("group"), "node", "root", "lost", F.expr("slice(s, 2, size(s))").alias("s")), "lz4_raw")
        discard(rows, size, times, most, x, centre, lows, y, blocks, z)
        trim(spark)
        rows = None if new.isEmpty() else new
    return edges


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, all columns: the row of the least id where ids are unique and not null, else any one row."""
    n, ids = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    rows = docs.withColumn("__row", F.col("doc_id").cast("long")) if n == ids else cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    keep = cut(near_duplicates(rows, "__row").where("__row = component_id").select(F.col("__row").alias("__keep")))
    small = F.broadcast(keep) if keep.count() <= BROADCAST_IDS else keep
    return rows.join(small, rows["__row"] == small["__keep"], "left_semi").drop("__row")
