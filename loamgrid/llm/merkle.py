"""Merkle manifest of a table: bottom-up build, top-down proofs.

Rows are leaves. Those of one group (a language) are numbered in order and hashed upwards, two neighbours to a parent, until one node is left; these nodes,
in the order of their groups, likewise give one root. Up to HEIGHT levels are made at once, in blocks of ``2 ** HEIGHT`` neighbours, so a table of n rows
takes log2(n) / HEIGHT rounds, each of which is written to the shared folder. Proofs go the other way: the blocks of a round are joined with their
parents, whose proofs are done, and each child puts the siblings that it has inside its block before what it inherits.
Everything is DataFrame functions; no step holds more than a block of any group in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.common import cut, discard

#: Levels of a round: a block has at most 2 ** HEIGHT nodes.
HEIGHT = 7
#: Steps of a proof begin with the side that the sibling stands on; a node without one is hashed alone.
LEFT, RIGHT, ALONE = "<", ">", "="


def leaf_of(columns: list[Column]) -> Column:
    """Digest of a row: each value as its length in bytes, a colon and its text, and - for null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def numbered(df: DataFrame, order: list[str], n: int | None = None) -> DataFrame:
    """``df``, written, with ``number``: its place from 0 on in ascending ``order`` (nulls first). Rows are dealt to tasks by ranges of the order; equal rows
    are split, too. Only the counts of tasks come together."""
    spark = df.sparkSession
    n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = df.withColumn("__tie", F.monotonically_increasing_id())
    dealt = cut(tie.repartitionByRange(n, *order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie").withColumn("__m", F.monotonically_increasing_id()))
    counts = {r.p: r.n for r in dealt.groupBy(F.shiftright("__m", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each task
    starts, at = [0] * (max(counts, default=0) + 1), 0
    for p in range(len(starts)):
        starts[p], at = at, at + counts.get(p, 0)
    start = F.element_at(F.from_json(F.lit(str(starts)), "array<bigint>"), F.shiftright("__m", 33).cast("int") + 1)
    out = dealt.withColumn("number", start + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m")
    out._loamgrid_path = dealt._loamgrid_path
    return out


#: Levels of a block from its nodes upwards: of ``h`` more levels, each has the digests of two neighbours each of the one below.
LEVELS = """aggregate(slice(sequence(0, h), 2, h), array(nodes), (acc, i) -> concat(acc, array(transform(sequence(0, (size(element_at(acc, -1)) - 1) DIV 2),
j -> sha2(concat(get(element_at(acc, -1), 2 * j), coalesce(get(element_at(acc, -1), 2 * j + 1), '')), 256)))))"""
#: The steps of the node in place ``i`` of its block, upwards.
STEPS = f"""transform(slice(sequence(0, h), 1, h), l -> CASE WHEN shiftright(i, l) % 2 = 1 THEN concat('{LEFT}', get(get(levels, l), shiftright(i, l) - 1))
WHEN get(get(levels, l), shiftright(i, l) + 1) IS NULL THEN '{ALONE}' ELSE concat('{RIGHT}', get(get(levels, l), shiftright(i, l) + 1)) END)"""


def fold(leaf: str, proof: str) -> str:
    """SQL of the digest that a leaf and its proof lead to."""
    return f"aggregate({proof}, {leaf}, (node, s) -> sha2(IF(startswith(s, '{LEFT}'), concat(substring(s, 2), node), concat(node, substring(s, 2))), 256))"


def siblings(proof: str) -> str:
    """SQL of the digests in a proof, joined."""
    return f"array_join(transform({proof}, s -> substring(s, 2)), '')"


def blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """``tree, n, h, pos, rows``: neighbouring nodes (``tree, pos, n, hash`` and ``payload``; n: nodes of the tree on this level) in blocks, written. ``pos`` is the
    block's place, and that of its parent; ``h`` the number of levels that are made of it."""
    x = nodes.withColumn("h", F.least(F.lit(HEIGHT), F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)))
    x = x.withColumn("row", F.struct("pos", "hash", *payload)).withColumn("pos", F.shiftright("pos", HEIGHT))
    return cut(x.groupBy("tree", "n", "h", "pos").agg(F.sort_array(F.collect_list("row")).alias("rows")))


def levels(blocked: DataFrame) -> DataFrame:
    return blocked.withColumn("nodes", F.expr("transform(rows, r -> r.hash)")).withColumn("levels", F.expr(LEVELS))


def parents(blocked: DataFrame) -> DataFrame:
    """The nodes above the blocks: ``tree, pos, n, hash``."""
    return levels(blocked).selectExpr("tree", "pos", "n", "h", "get(element_at(levels, -1), 0) AS hash").withColumn("n", F.expr("CAST(ceil(n / shiftleft(1L, h)) AS bigint)")).drop("h")


def climb(nodes: DataFrame, most: int, payload: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The written rounds from ``nodes`` up to one node a tree, the largest of ``most`` nodes, and these last nodes."""
    rounds = []
    while True:
        rounds.append(blocks(nodes, [] if rounds else payload))
        nodes = parents(rounds[-1])
        if most <= 1 << HEIGHT:
            return rounds, nodes
        most = -(-most >> HEIGHT)


def descend(rounds: list[DataFrame], proofs: DataFrame, payload: list[str], carried: tuple[str, ...] = ()) -> DataFrame:
    """``tree, pos, hash, proof`` and ``payload`` of the lowest nodes, from ``tree, pos, proof`` of the highest, whose columns ``carried`` all below them get. All but the last round are written."""
    for k, blocked in reversed(list(enumerate(rounds))):
        x = levels(blocked.join(proofs.select("tree", "pos", F.col("proof").alias("above"), *carried), ["tree", "pos"]))
        x = x.select("tree", "h", "levels", "above", *carried, F.posexplode("rows").alias("i", "row"))
        proofs = x.select("tree", "row.pos", "row.hash", *carried, *([f"row.{c}" for c in payload] if k == 0 else []), F.concat(F.expr(STEPS), "above").alias("proof"))
        if k:
            proofs = cut(proofs)
    return proofs


def manifest(docs: DataFrame, columns: list[str], group: str, key: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """``key, leaf, subroot, root, proof`` and the columns ``extra`` of every row: a proof is its steps from the leaf to the root, each ``<`` (sibling on the left), ``>`` (on
    the right) or ``=`` (none) and the sibling's digest.

    Leaves are digests of ``columns``, in ascending ``key`` within their ``group``; null keys come first, rows of one key stand in the order of their leaves and all
    stay, equal rows next to each other. Null is a group like any other and the first. A group of one row has its leaf as subroot; where there is one group, its
    subroot is the root. An empty table gives an empty table. Other columns are not read. The rounds stay in the shared folder: the result reads them.
    """
    extra = extra or {}
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.col(group).cast("string").alias("grp"), leaf_of([F.col(c) for c in columns]).alias("hash"), *[c.alias(k) for k, c in extra.items()])
    rows = cut(rows)  # texts are hashed once, not for the ranges as well
    leaves = numbered(rows, ["grp", "key", "hash"])
    groups = numbered(leaves.groupBy("grp").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n")), ["grp"]).withColumnRenamed("number", "tree")
    n_groups, most = groups.agg(F.count(F.lit(1)), F.max("n")).first()
    if not n_groups:
        return rows.select(F.col("key").alias(key), F.col("hash").alias("leaf"), F.col("hash").alias("subroot"), F.col("hash").alias("root"), F.array("hash").alias("proof"), *extra)
    payload = ["key", *extra]
    placed = leaves.join(groups.withColumnRenamed("grp", "g"), F.col("grp").eqNullSafe(F.col("g"))).selectExpr("tree", "number - first AS pos", "n", "hash", *[f"`{c}`" for c in payload])
    rounds, tops = climb(placed, most, payload)
    subroots = cut(tops.selectExpr("0L AS tree", "tree AS pos", f"{n_groups}L AS n", "hash"))
    above, last = climb(subroots, n_groups, [])
    root = last.first()["hash"]
    ends = cut(descend(above, last.select("tree", "pos", F.array().cast("array<string>").alias("proof")), []).selectExpr("pos AS tree", "0L AS pos", "proof", "hash AS subroot"))
    discard(rows, leaves, subroots, *above)
    out = descend(rounds, ends, payload, ("subroot",))
    return out.select(F.col("key").cast(kind).alias(key), F.col("hash").alias("leaf"), "subroot", F.lit(root).alias("root"), "proof", *extra)
