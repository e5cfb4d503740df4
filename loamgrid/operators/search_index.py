"""Full-text search in fields: a written index of stems with places, ranked by BM25 with weights for fields.

``build`` writes postings (stem, document, field, places) in buckets by stem, sorted in runs, and the documents' lengths; ``search`` reads only the buckets and row groups of the
stems that are asked for. Queries are phrases of which any or every one must occur; a phrase of several words occurs where its stems stand in order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgrid.functions.stem import stem_rows, stemmed

# Fixed values of the ranking: saturation, length, and what a phrase counts that most documents hold.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
BUCKETS = 16
#: Postings of a file at most: the files of a bucket grow in number, not in size.
SHARE = 2_000_000
#: What lets a task write to all its buckets' files at once instead of sorting its rows by bucket.
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
#: Stems asked for up to which a search names them to the scan.
NAMED = 5_000


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build(docs: DataFrame, path: str, id_col: str, fields: list[str], buckets: int = BUCKETS) -> None:
    """Write the index of ``docs`` under ``path``. Null fields have no words; a null id is an error; ids are unique. An empty corpus is an error, and leaves no index."""
    marks = F.assert_true(F.col(id_col).isNotNull(), "a document has no id")
    x = docs.where(F.coalesce(marks.cast("boolean"), F.lit(True)))
    x = x.select(F.col(id_col).alias("doc"), F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.col(f).alias("text")) for i, f in enumerate(fields)])).alias("f"))
    x = stem_rows(x.select("doc", F.col("f.field").cast("tinyint").alias("field"), "f.text"), "text")
    rows = x.select("term", "doc", "field", "places").withColumn("bucket", bucket_of(F.col("term"), buckets))
    # Every task writes the postings of its own documents, sorted as they come, in its files of all buckets: none is shuffled, and none sorted again.
    spark = docs.sparkSession
    before = spark.conf.get(OPEN_FILES, "0")
    spark.conf.set(OPEN_FILES, str(max(buckets, int(before))))
    try:
        rows.write.mode("overwrite").option("maxRecordsPerFile", SHARE).option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    finally:
        spark.conf.set(OPEN_FILES, before)
    written = read_postings(spark, path, dict(docs.dtypes)[id_col])
    sizes = docs.select(F.col(id_col).alias("doc")).join(written.groupBy("doc").agg(F.sum(F.size("places")).alias("n")), "doc", "left").select("doc", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    sizes.write.mode("overwrite").parquet(f"{path}/docs")
    stats = spark.read.parquet(f"{path}/docs").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_words"))
    if not stats.first()["n_docs"]:
        raise ValueError("an index needs documents")
    stats.withColumns({"buckets": F.lit(buckets), "fields": F.array(*[F.lit(f) for f in fields])}).write.mode("overwrite").parquet(f"{path}/stats")


def read_postings(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(f"term string, doc {kind}, field tinyint, places array<int>, bucket int").parquet(f"{path}/postings")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 16, weights: dict[str, float] | None = None, query_id: str = "query_id") -> DataFrame:
    """``query_id, doc, score, rank``: the best ``k`` documents of each query (``query_id, phrases array<string>, every boolean``) by BM25, ties by document.

    ``every``: all phrases must occur, else any. Phrases without words are left out, as are queries that have no other. ``weights`` of fields: 1 if not given.
    """
    stats = spark.read.parquet(f"{path}/stats").first()
    weights = weights or {}
    by_field = F.element_at(F.array(*[F.lit(float(weights.get(f, 1.0))) for f in stats["fields"]]), F.col("field") + 1)
    asked = queries.select(query_id, F.coalesce("every", F.lit(False)).alias("every"), F.posexplode(F.array_distinct("phrases")).alias("phrase", "text")).select("*", stemmed("text").alias("stems")).where("size(stems) > 0")
    asked = asked.withColumn("wanted", F.count(F.lit(1)).over(Window.partitionBy(query_id)))
    # Equal phrases of several queries are looked up once.
    phrases = asked.select("stems").distinct().select("stems", F.posexplode("stems").alias("at", "term"))
    named = [r.term for r in phrases.select("term").distinct().limit(NAMED + 1).collect()]
    lengths = spark.read.parquet(f"{path}/docs")
    postings = read_postings(spark, path, dict(lengths.dtypes)["doc"])
    if len(named) <= NAMED:
        buckets = {r.b for r in spark.createDataFrame([(t,) for t in named], "t string").select(bucket_of(F.col("t"), stats["buckets"]).alias("b")).collect()}
        postings = postings.where(F.col("bucket").isin(*buckets) & F.col("term").isin(*named))
    few = len(named) <= NAMED
    phrases = F.broadcast(phrases) if few else phrases
    # Only phrases of several words need their places; of a single one, each task counts where the postings lie.
    single = postings.join(phrases.where("size(stems) = 1"), "term").select("stems", "doc", (F.size("places") * by_field).alias("f"))
    met = postings.join(phrases.where("size(stems) > 1"), "term").select("stems", "doc", "field", F.expr("transform(places, p -> p - at)").alias("starts"))
    starts = met.groupBy("stems", "doc", "field").agg(F.collect_list("starts").alias("all")).where("size(all) = size(stems)")  # at most a row for each word of the phrase
    starts = starts.withColumn("n", F.expr("size(aggregate(slice(all, 2, size(all)), all[0], (a, x) -> array_intersect(a, x)))")).where("n > 0")
    # All that is found of a document is dealt out once, by document; pairs of a query and a document are made and summed there.
    hits = single.unionAll(starts.select("stems", "doc", F.col("n") * by_field)).repartition("doc").groupBy("doc", "stems").agg(F.sum("f").alias("f"))
    df = hits.groupBy("stems").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((stats["n_docs"] - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    asked = asked.join(df.select("stems", idf.alias("idf")), "stems")
    found = hits.join(lengths, "doc").join(F.broadcast(asked) if few else asked, "stems")
    mean = stats["n_words"] / stats["n_docs"] or math.inf
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n") / mean))
    scored = found.groupBy("doc", query_id).agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("had"), F.any_value("wanted").alias("wanted"), F.any_value("every").alias("every")).where("NOT every OR had = wanted")
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), "doc")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(query_id, "doc", "score", "rank")
