"""Deduplication, splits and samples. Randomness is the order of a keyed hash, so it does not depend on partitions; ties end in the id."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loamgrid.functions.text import fields, spaced
from loamgrid.operators.nearest import kept_set


def hash_order(key: Column, seed: int | str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in a random order (a range-partitioned sort by hash)."""
    return df.orderBy(hash_order(F.col(key), seed), key)


def dedup(df: DataFrame, key: Column, order: list[str], id_col: str) -> DataFrame:
    """``df`` with ``duplicate_of``: the id of the first row with the same key, null for that row itself. Null keys are equal to nothing."""
    own = F.coalesce(key, F.concat(F.lit("\0"), F.col(id_col).cast("string")))
    w = Window.partitionBy("__key").orderBy(*order)
    x = df.withColumn("__key", own).withColumn("__first", F.first(id_col).over(w)).withColumn("__n", F.row_number().over(w))
    return x.withColumn("duplicate_of", F.when(F.col("__n") > 1, F.col("__first"))).drop("__key", "__first", "__n")


def same_set(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``only_a, only_b, same``: how many keys only one of two tables has, and whether there are none. Keys are counted where they lie before they meet."""
    both = a.select(F.col(key).alias("k"), F.lit(1).alias("s")).unionAll(b.select(F.col(key), F.lit(2))).groupBy("k").agg(F.bit_or("s").alias("s"))
    x = both.agg(F.count_if(F.col("s") == 1).alias("only_a"), F.count_if(F.col("s") == 2).alias("only_b"))
    return x.withColumn("same", F.col("only_a") + F.col("only_b") == 0)


def split_priority(df: DataFrame, key: Column, split: str, id_col: str, order: tuple[str, ...] = ("test", "validation", "train")) -> DataFrame:
    """As ``dedup``, where the row of the split that stands first in ``order`` stays."""
    rank = functools.reduce(lambda a, x: a.when(F.col(split) == x[1], x[0]), enumerate(order[1:], 1), F.when(F.col(split) == order[0], 0)).otherwise(len(order))
    return dedup(df.withColumn("__rank", rank), key, ["__rank", id_col], id_col).drop("__rank")


def bucketed_split(groups: DataFrame, key: str, parts: list[tuple[str, float]], seed: int = 42, rest: str = "train") -> DataFrame:
    """``groups`` with ``split``: whole groups by their hash's place in [0, 1), so no order over all of them is needed; sizes are those shares on average."""
    u = F.conv(F.substr(hash_order(F.col(key), seed), F.lit(1), F.lit(12)), 16, 10).cast("double") / float(16**12)
    at, out = 0.0, None
    for name, share in parts:
        at += share
        out = F.when(u < at, name) if out is None else out.when(u < at, name)
    return groups.withColumn("split", out.otherwise(rest))


def round_robin(df: DataFrame, group: str, order: list[Column], id_col: str, size: str, budget: int) -> DataFrame:
    """``df`` with ``rn``: rows taken in rounds, one of each group by its order a round (groups by name within it), while what was taken before stays under ``budget`` in ``size``.

    Each group's own running size bounds what it can give before any row is ranked against other groups: a row whose group has already used up the budget can't be taken. So only a budget's worth
    of rows of each group meets the running sum, which goes by rounds: their sums are ordered in one place, rows only within the round where the budget ends.
    """
    own = Window.partitionBy(group).orderBy(*order)
    x = df.withColumn("rn", F.row_number().over(own)).withColumn("__own", F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)).where(F.col("__own") < budget)
    rounds = x.groupBy("rn").agg(F.sum(size).alias("__s"))
    before = rounds.withColumn("__start", F.coalesce(F.sum("__s").over(Window.orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("__start") < budget).select("rn", "__start")
    inside = F.coalesce(F.sum(size).over(Window.partitionBy("rn").orderBy(group, id_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x.join(before, "rn").withColumn("__upto", F.col("__start") + inside).where(F.col("__upto") < budget).select(*df.columns, "rn")


def counted_split(df: DataFrame, keys: list[str], id_col: str, counts: list[tuple[str, int]], seed: int = 42, rest: str = "train") -> DataFrame:
    """Within each group, the first so many by hash are of the first split, the next of the second, and so on."""
    x = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(hash_order(F.col(id_col), seed), id_col)))
    at, out = 0, None
    for name, n in counts:
        at += n
        out = F.when(F.col("__n") <= at, name) if out is None else out.when(F.col("__n") <= at, name)
    return x.withColumn("split", out.otherwise(rest)).drop("__n")


def every_nth(df: DataFrame, kind: str, order: list[str], n: int = 5, name: str = "dev", rest: str = "test") -> DataFrame:
    """Every ``n``-th row within its kind is of one split, from the first on."""
    i = F.row_number().over(Window.partitionBy(kind).orderBy(*order)) - 1
    return df.withColumn("split", F.when(i % n == 0, name).otherwise(rest))


def audit_sample(df: DataFrame, method: str, failed: str, id_col: str, passes: int = 8, seed: int = 42) -> DataFrame:
    """All failures, and at most ``passes`` other rows a method."""
    w = Window.partitionBy(method, F.coalesce(F.col(failed), F.lit(False))).orderBy(hash_order(F.col(id_col), seed), id_col)
    return df.withColumn("__n", F.row_number().over(w)).where(F.coalesce(F.col(failed), F.lit(False)) | (F.col("__n") <= passes)).drop("__n")


def quota_sample(df: DataFrame, kind: str, flags: str, id_col: str, quotas: dict[str, int], seed: int = 42) -> DataFrame:
    """So many of each kind, those with fewer flags first; a kind that is short of its quota is an error."""
    w = Window.partitionBy(kind).orderBy(F.size(flags), hash_order(F.col(id_col), seed), id_col)
    quota = F.element_at(F.create_map(*[F.lit(v) for kv in quotas.items() for v in kv]), F.col(kind))
    out = df.where(F.col(kind).isin(*quotas)).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= quota).drop("__n")
    short = {k: n for k, n in quotas.items()}
    for r in out.groupBy(kind).agg(F.count(F.lit(1)).alias("n")).collect():  # one row per quota
        short[r[kind]] -= r["n"]
    short = {k: n for k, n in short.items() if n}
    if short:
        raise ValueError(f"short of their quotas: {short}")
    return out


def replay_mix(main: DataFrame, general: DataFrame, id_col: str, tokens: str, share: float = 0.01, seed: int = 42, buckets: int = 256) -> DataFrame:
    """``main``, and of ``general`` in hash order as many rows as make up ``share`` of the whole, the row that crosses it included.

    The running sum goes bucket by bucket of the hash: only the sums of buckets are in one place, and one bucket's rows where it ends.
    """
    target = main.agg((F.coalesce(F.sum(tokens), F.lit(0)) * share / (1 - share)).alias("__target"))
    h = hash_order(F.col(id_col), seed)
    x = general.withColumn("__h", h).withColumn("__b", F.pmod(F.conv(F.substr("__h", F.lit(1), F.lit(2)), 16, 10).cast("int"), F.lit(buckets)))
    sums = x.groupBy("__b").agg(F.sum(tokens).alias("__s"))
    before = sums.withColumn("__start", F.coalesce(F.sum("__s").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__b", "__start")
    near = x.join(F.broadcast(before), "__b").crossJoin(F.broadcast(target)).where("__start < __target")
    inside = F.coalesce(F.sum(tokens).over(Window.partitionBy("__b").orderBy("__h", id_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    took = near.withColumn("__upto", F.col("__start") + inside).where("__upto < __target").select(*general.columns)
    return main.withColumn("bucket", F.lit("main")).unionByName(took.withColumn("bucket", F.lit("replay")))


def exposure_schedule(df: DataFrame, id_col: str, epochs: int, seed: int = 42) -> DataFrame:
    """Every row once an epoch, in an order of its own each: ``df`` with ``epoch`` and the sort key ``place_hash``."""
    x = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    return x.withColumn("place_hash", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col(id_col).cast("string")), 256))


def stratum_spans(df: DataFrame, id_col: str, n_tokens: str, most: int, window: int, seed: int = 42) -> DataFrame:
    """``id, stratum, start, stop``: spans of a long document, one in each of ceil(most / window) equal strata, at a place that a hash draws.

    Each span leaves room for one end mark in its share of ``most``. A document that fits with its end mark is one span.
    """
    count = -(-most // window)
    n = F.col(n_tokens)
    x = df.select(id_col, n.cast("bigint").alias("__n"), F.explode(F.when(n + 1 <= most, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.lit(count - 1)))).alias("stratum"))
    i = F.col("stratum")
    width = F.lit(most // count) + (i < most % count).cast("int") - 1
    left, right = F.floor(F.col("__n") * i / count), F.floor(F.col("__n") * (i + 1) / count)
    h = F.conv(F.substr(hash_order(F.concat_ws(":", F.col(id_col).cast("string"), i.cast("string")), seed), F.lit(1), F.lit(8)), 16, 10).cast("bigint")
    start = left + F.pmod(h, right - width - left + 1)
    whole = i < 0
    return x.select(id_col, "stratum", F.when(whole, F.lit(0)).otherwise(start).cast("bigint").alias("start"), F.when(whole, F.col("__n")).otherwise(start + width).cast("bigint").alias("stop"))


def sentence_spans(df: DataFrame, id_col: str, text_col: str, width: int = 2047) -> DataFrame:
    """``id, start, stop`` in words: runs of at most ``width`` words that make up the text, each as long as it can be that ends with a sentence or paragraph in its second half, else of full width.

    One fold over the sentences of a text: it holds where the open run starts, the last sentence end inside it and the cuts so far. A sentence that ends beyond the run's room
    closes it, at that last end or at full width, and what is still too long of the sentence is cut at full widths at once.
    """
    parts = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"(?<=[.!?])\s+|\n\n+"), lambda s: s != "")
    return spans_of(df.select(id_col, F.transform(parts, lambda s: F.size(fields(s))).alias("sizes")), id_col, "sizes", width)


def spans_of(df: DataFrame, id_col: str, sizes_col: str, width: int) -> DataFrame:
    """As ``sentence_spans`` in any unit, from the sizes of a text's sentences (``array<int>``)."""
    kind = dict(df.dtypes)[id_col]
    close = f"IF(a.mark > a.start AND a.mark >= a.start + {width // 2}, a.mark, a.start + {width})"
    more = f"(a.at + n - {close} - 1) DIV {width}"
    cuts = f"concat(a.cuts, transform(sequence(0L, {more}), i -> {close} + i * {width}))"
    fold = f"""aggregate(sizes, named_struct('at', 0L, 'start', 0L, 'mark', 0L, 'cuts', array(0L)), (a, n) ->
        IF(a.at + n <= a.start + {width}, named_struct('at', a.at + n, 'start', a.start, 'mark', a.at + n, 'cuts', a.cuts),
           named_struct('at', a.at + n, 'start', {close} + {more} * {width}, 'mark', a.at + n, 'cuts', {cuts})), a -> concat(a.cuts, array(a.at)))"""
    x = df.select(F.col(id_col), F.coalesce(F.col(sizes_col), F.array().cast("array<int>")).alias("sizes")).withColumn("cuts", F.expr(fold))
    x = x.select(F.col(id_col), F.expr("explode(transform(sequence(0, size(cuts) - 2), i -> named_struct('start', cuts[i], 'stop', cuts[i + 1])))").alias("s"))
    return x.select(F.col(id_col).cast(kind), "s.start", "s.stop").where("start < stop")


def ratio(a: str, b: str) -> float:
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b, autojunk=False).ratio()


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in matching blocks of two texts."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)])


def near_questions(df: DataFrame, id_col: str, text_col: str, shared: int = 2, lengths: float = 0.8, least: float = 0.9) -> DataFrame:
    """``a, b, score``: pairs of different questions whose normal forms share ``shared`` word pairs, are of like length and at least ``least`` alike.

    Equal normal forms are one question, represented by its least id; null and empty texts are in no pair. Candidates meet at every word pair: a pair of
    words that very many questions share makes a block of as many pairs of questions, as the definition asks.
    """
    q = df.where(F.col(text_col).isNotNull()).groupBy(spaced(F.col(text_col)).alias("q")).agg(F.min(id_col).alias("id")).where("q <> ''")
    q = q.withColumn("w", F.split("q", " "))
    pairs = F.expr("IF(size(w) < 2, CAST(array() AS array<string>), array_distinct(transform(sequence(0, size(w) - 2), i -> concat(w[i], ' ', w[i + 1]))))")
    g = q.select("id", F.length("q").alias("n"), F.explode(pairs).alias("g"))
    a, b = g.select(F.col("id").alias("a"), F.col("n").alias("na"), "g"), g.select(F.col("id").alias("b"), F.col("n").alias("nb"), "g")
    like = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= lengths * F.greatest("na", "nb"))
    cand = a.join(b, "g").where(like).groupBy("a", "b").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= shared)
    text = q.select("id", "q")
    x = cand.join(text.select(F.col("id").alias("a"), F.col("q").alias("qa")), "a").join(text.select(F.col("id").alias("b"), F.col("q").alias("qb")), "b")
    return x.withColumn("score", similarity("qa", "qb")).where(F.col("score") >= least).select("a", "b", "score")


def kept_questions(df: DataFrame, id_col: str, text_col: str, **limits) -> DataFrame:
    """The rows of ``df`` that stay when questions are taken in the order of their ids and each goes that equals one before in its normal form, or is near one taken before
    (``near_questions`` with ``limits``). Rows without words stay."""
    named = df.withColumn("__q", spaced(F.coalesce(F.col(text_col), F.lit(""))))
    firsts = named.where("__q <> ''").groupBy("__q").agg(F.min(id_col).alias(id_col))
    gone = kept_set(near_questions(df, id_col, text_col, **limits)).select(F.col("id").alias(id_col))
    stay = firsts.join(gone, id_col, "left_anti").select(id_col).unionAll(named.where("__q = ''").select(id_col))
    return df.join(stay.distinct(), id_col, "left_semi")


def split_sources(df: DataFrame, source: str, split: str) -> DataFrame:
    """``source, splits, names``: sources whose rows are in more than one split (there should be none)."""
    x = df.groupBy(source).agg(F.collect_set(split).alias("__s")).where("size(__s) > 1")
    return x.select(source, F.size("__s").alias("splits"), F.array_join(F.array_sort("__s"), ",").alias("names"))
