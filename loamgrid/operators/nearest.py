"""Nearest values under side conditions, and the kept set of a graph of near pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.operators.statistics import numbered
from loamgrid.sources.workspace import compact, written

#: Rows that are kept of each size, and as many of other subjects than the first one's; of sizes with up to DENSE rows all are compared instead.
TOP, DENSE = 3, 16
#: Rows of what a ring asks for up to which they go to the texts, which then stay where they lie.
SENT = 500_000
#: Answers that most texts hold: how many are listed with all texts that lack them at once, and from how many open rows on.
LISTS, OPEN = 256, 64


def closest_negative(df: DataFrame, id_col: str, size: str, subject: str, answer: str, text: str) -> DataFrame:
    """``id_col, negative, gap``: for every row another of a different subject whose text doesn't hold the row's answer (in lower case), of the nearest size; ties go to the smaller id.

    Rows of one size, subject and answer ask once. Of large sizes only the first rows are looked at, enough for any subject; what finds none among its own size's is compared with all rows of
    the sizes around, in rings that grow by places among the sizes that occur. Answers that keep many rows open are those that most texts hold: for them, the few texts without are
    listed by size. Rows with a null subject or size have no negative and are none; a null answer is held by no text, an empty one by all; no negative: null. Sizes are whole numbers.
    """
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.col(size).cast("bigint").alias("size"), F.col(subject).alias("subject"), F.lower(answer).alias("answer"), F.lower(text).alias("text"))
    rows = compact(rows, "texts")
    x = rows.where("subject IS NOT NULL AND size IS NOT NULL")
    usable = x.where("text IS NOT NULL").selectExpr("size AS at", "id AS cand", "subject AS cs", "text")
    bare = usable.drop("text")
    places, n = numbered(x.select("size").distinct(), "size")
    places = written(places, "sizes")
    ends = bare.agg(F.min("cs").alias("lo"), F.max("cs").alias("hi")).first()
    asked = x.where("answer IS NULL OR answer <> ''").where((F.col("subject") != F.lit(ends["lo"])) | (F.col("subject") != F.lit(ends["hi"])))
    keys = written(asked.select("size", "subject", "answer").distinct().withColumn("k", F.monotonically_increasing_id()), "keys")
    first = _of_listed(keys, usable, bare)
    done, todo, wide = [first], keys.join(first.select("k"), "k", "left_anti"), 1
    while todo.limit(1).count():
        found, todo = _ring(todo, usable, places, n, wide)
        done.append(found)
        often = written(todo.where("answer IS NOT NULL").groupBy("answer").count().where(F.col("count") >= OPEN).orderBy(F.desc("count"), "answer").limit(LISTS).select("answer"), "often")
        if often.limit(1).count():
            done.append(_of_missing(todo.join(F.broadcast(often), "answer"), usable, often))
            todo = todo.join(F.broadcast(often), "answer", "left_anti")
        wide *= 8
    best = df.sparkSession.createDataFrame([], f"k bigint, negative {kind}, gap bigint")
    for d in done:
        best = best.unionAll(d)
    best = keys.join(best, "k").select(F.col("size").alias("ks"), F.col("subject").alias("ku"), F.col("answer").alias("ka"), "negative", "gap")
    same = (F.col("size") == F.col("ks")) & (F.col("subject") == F.col("ku")) & F.col("answer").eqNullSafe(F.col("ka"))
    return rows.drop("text").join(best, same, "left").select(F.col("id").alias(id_col), "negative", "gap")


#: What makes a row with a text the negative of a key.
FITS = "cs <> subject AND NOT coalesce(contains(text, answer), false)"


def _of_listed(keys: DataFrame, usable: DataFrame, bare: DataFrame) -> DataFrame:
    """``k, negative, gap`` of the keys that find theirs among the first rows of their own size, where that has more than DENSE."""
    large = bare.groupBy("at").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("cand", "cs")).alias("f")).where(F.col("m") > DENSE).select("at", F.col("f.cs").alias("fs"))
    # Of each size two lists: rows of the subject of its first row, and all others. TOP rows of each are kept, and one more that tells where the rest begins.
    listed = bare.join(large, "at").withColumn("other", F.col("cs") != F.col("fs"))
    listed = listed.withColumn("r", F.row_number().over(Window.partitionBy("at", "other").orderBy("cand"))).where(F.col("r") <= TOP + 1)
    listed = written(listed.select("at", "cand", "other", (F.col("r") > TOP).alias("rest")), "listed")
    # Texts meet what was chosen where they lie: the list has a few rows for each large size, however many documents there are.
    index = usable.join(F.broadcast(listed), ["at", "cand"])
    met = index.join(keys.withColumnRenamed("size", "at").hint("shuffle_hash"), "at")
    step = met.groupBy("k").agg(F.min(F.expr(f"IF(NOT rest AND {FITS}, cand, NULL)")).alias("negative"), F.min(F.expr("IF(rest AND (other OR cs <> subject), cand, NULL)")).alias("h"))
    # All rows that are not listed stand behind the first of a rest.
    return written(step.where("negative IS NOT NULL AND (h IS NULL OR negative < h)").select("k", "negative", F.lit(0).cast("bigint").alias("gap")), "first")


def _ring(todo: DataFrame, usable: DataFrame, places: DataFrame, n: int, wide: int) -> tuple[DataFrame, DataFrame]:
    """``k, negative, gap`` of the keys whose negative is among all rows of the ``wide`` sizes that occur on either side and of their own, and the keys left."""
    around = todo.select("size").distinct().join(places, "size")
    around = around.withColumn("j", F.explode(F.sequence(F.greatest(F.lit(0), F.col("i") - wide - 1), F.least(F.lit(n - 1), F.col("i") + wide + 1))))
    around = around.join(places.select(F.col("size").alias("at"), F.col("i").alias("j")), "j")
    around = written(around.select("size", "at", F.abs(F.col("at") - F.col("size")).alias("gap"), (F.abs(F.col("j") - F.col("i")) > wide).alias("beyond")), "around")
    # A size that is not looked at is at least this far; none: all were.
    edge = around.where("beyond").groupBy("size").agg(F.min("gap").alias("edge"))
    sent = written(todo.join(around.where("NOT beyond"), "size").select("k", "subject", "answer", "at", "gap"), "sent")
    sent = F.broadcast(sent) if sent.count() <= SENT else sent.hint("shuffle_hash")
    met = usable.join(sent, "at").where(FITS).groupBy("k", "gap").agg(F.min("cand").alias("cand"))
    best = met.groupBy("k").agg(F.min(F.struct("gap", "cand")).alias("b"))
    step = written(todo.join(best, "k", "left").join(edge, "size", "left").select("k", "size", "subject", "answer", "b", "edge"), "ring")
    sure = "(edge IS NULL OR coalesce(b.gap < edge, false))"
    return step.where(f"b IS NOT NULL AND {sure}").selectExpr("k", "b.cand AS negative", "b.gap AS gap"), step.where(f"NOT {sure}").select("k", "size", "subject", "answer")


def _of_missing(todo: DataFrame, usable: DataFrame, often: DataFrame) -> DataFrame:
    """``k, negative, gap`` of keys whose answers are in ``often``, from all texts that lack each of these; keys without a negative are left out."""
    lacking = usable.join(F.broadcast(often), F.expr("NOT contains(text, answer)")).groupBy("answer", "at", "cs").agg(F.min("cand").alias("cand"))
    # Two rows of a size are enough, as they are of two subjects.
    points = lacking.groupBy("answer", "at").agg(F.slice(F.array_sort(F.collect_list(F.struct("cand", "cs"))), 1, 2).alias("t"))
    points = written(points.withColumn("only", F.expr("IF(size(t) = 1, t[0].cs, NULL)")), "missing")
    sides = None
    for order in (F.col("at").asc(), F.col("at").desc()):
        by = Window.partitionBy("answer").orderBy(order)
        so_far = (Window.unboundedPreceding, Window.currentRow)
        # ``prior``: the last size before that has another subject than this one's only one.
        p = points.withColumn("last", F.lag(F.struct("at", "t", "only")).over(by))
        p = p.withColumn("prior", F.last(F.when(~F.col("only").eqNullSafe(F.col("last.only")), F.col("last")), ignorenulls=True).over(by.rowsBetween(*so_far)))
        p = p.select("answer", "at", F.lit(None).cast("bigint").alias("k"), F.lit(None).cast(todo.schema["subject"].dataType).alias("subject"), F.struct(F.struct("at", "t", "only").alias("own"), "prior").alias("p"))
        z = p.unionByName(todo.select("answer", F.col("size").alias("at"), "k", "subject"), allowMissingColumns=True)
        z = z.withColumn("c", F.last("p", ignorenulls=True).over(Window.partitionBy("answer").orderBy(order, F.col("k").asc_nulls_first()).rowsBetween(*so_far))).where("k IS NOT NULL AND c IS NOT NULL")
        z = z.withColumn("r", F.expr("IF(c.own.only <=> subject, c.prior, c.own)")).where("r IS NOT NULL")
        z = z.select("k", F.abs(F.col("at") - F.col("r.at")).alias("gap"), F.expr("IF(r.t[0].cs <> subject, r.t[0].cand, get(r.t, 1).cand)").alias("cand"))
        sides = z if sides is None else sides.unionAll(z)
    return written(sides.groupBy("k").agg(F.min(F.struct("gap", "cand")).alias("b")).selectExpr("k", "b.cand AS negative", "b.gap AS gap"), "lists")


def kept_set(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id`` of what goes when rows are taken in order and each goes that is near one taken before: ``pairs`` have the earlier row in ``a``, the later in ``b``.

    In each round, rows without an earlier neighbour left are taken, and their later neighbours go with all their pairs. The rounds are at most as many as the longest chain of
    pairs; each is written. Rows in no pair are taken anyway and don't appear.
    """
    left = written(pairs.where(F.col(a) < F.col(b)).select(F.col(a).alias("a"), F.col(b).alias("b")).distinct(), "pairs")
    gone = []
    while left.limit(1).count():
        taken = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        out = written(left.join(taken, "a").select(F.col("b").alias("id")).distinct(), "gone")
        gone.append(out)
        rest = left.join(taken, "a", "left_anti").join(out.select(F.col("id").alias("b")), "b", "left_anti").join(out.select(F.col("id").alias("a")), "a", "left_anti")
        left = written(rest.select("a", "b"), "pairs")
    out = pairs.select(F.col(b).alias("id")).limit(0) if not gone else gone[0]
    for g in gone[1:]:
        out = out.unionAll(g)
    return out
