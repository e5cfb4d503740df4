"""Profiles of facts that users state about themselves: proposals are checked as whole batches, accepted facts are folded into a keyed table.

The table is a folder of facts: ``facts/batch=<id>`` holds what one batch brought and is written anew when that batch is replayed, so nothing counts twice; ``base-<n>``
holds facts folded up to a batch. Reading folds what is there: for each user and fact the latest statement, in the place of the first. Users are named by the
sha256 of their id only, by which the table is dealt and looked up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Categories, states, fields, and the limits of a fact's text, its evidence and a batch.
CATEGORIES = ["demographics", "conditions", "medications", "allergies", "lifestyle", "limitations"]
STATES = ["active", "stopped", "denied"]
FIELDS = ["age", "sex"]
SEXES = ["male", "female"]
VALUE_CHARS, EVIDENCE_CHARS, BATCH_FACTS, OLDEST, SHOWN = 160, 1000, 20, 120, 20
UPDATES = "array<struct<category:string,field:string,value:string,status:string,evidence:string>>"
FACTS = "user_key string, category string, name string, value string, status string, source_text string, session_id string, at timestamp, seq int"


def listed(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def fault_of(fact: str, message: str) -> str:
    """SQL: the first fault of one proposed fact, or null. ``field`` belongs to demographics alone."""
    f = fact
    return f"""CASE WHEN {f} IS NULL OR {f}.category IS NULL OR {f}.category NOT IN ({listed(CATEGORIES)}) THEN 'category'
WHEN {f}.value IS NULL OR trim({f}.value) = '' OR length({f}.value) > {VALUE_CHARS} THEN 'value'
WHEN {f}.status IS NULL OR {f}.status NOT IN ({listed(STATES)}) THEN 'status'
WHEN {f}.evidence IS NULL OR trim({f}.evidence) = '' OR length({f}.evidence) > {EVIDENCE_CHARS} OR NOT contains({message}, {f}.evidence) THEN 'evidence'
WHEN {f}.category = 'demographics' AND ({f}.status <> 'active' OR {f}.field IS NULL OR {f}.field NOT IN ({listed(FIELDS)})) THEN 'field'
WHEN {f}.category = 'demographics' AND {f}.field = 'age' AND NOT coalesce({f}.value RLIKE '^[0-9]+$' AND try_cast({f}.value AS int) BETWEEN 1 AND {OLDEST}, false) THEN 'age'
WHEN {f}.category = 'demographics' AND {f}.field = 'sex' AND {f}.value NOT IN ({listed(SEXES)}) THEN 'sex'
WHEN {f}.category <> 'demographics' AND {f}.field IS NOT NULL THEN 'field' END"""


def judged(proposals: DataFrame) -> DataFrame:
    """``proposals`` (``user_id, session_id, message, updates, at``) with ``fault``: null if every fact of the batch can be taken, else what the whole batch is refused for."""
    blank = "trim(coalesce({0}, '')) = ''"
    return proposals.withColumn("fault", F.expr(f"""CASE WHEN {blank.format('user_id')} THEN 'user' WHEN {blank.format('session_id')} THEN 'session' WHEN {blank.format('message')} THEN 'message'
WHEN updates IS NULL OR size(updates) NOT BETWEEN 1 AND {BATCH_FACTS} THEN 'updates' ELSE get(filter(transform(updates, u -> {fault_of('u', 'message')}), x -> x IS NOT NULL), 0) END"""))


def facts(proposals: DataFrame) -> DataFrame:
    """The facts (FACTS) of the batches that are taken. ``name`` tells facts of a category apart: the field, or the value without white space in lower case."""
    x = judged(proposals).where("fault IS NULL").selectExpr("sha2(user_id, 256) AS user_key", "session_id", "at", "posexplode(updates) AS (seq, u)")
    name = "IF(u.category = 'demographics', u.field, lower(regexp_replace(u.value, '\\\\s+', '')))"
    return x.selectExpr("user_key", "u.category", f"{name} AS name", "trim(u.value) AS value", "u.status", "u.evidence AS source_text", "session_id", "at", "seq")


def folded(facts: DataFrame) -> DataFrame:
    """One row for each user, category and name: the latest statement (ties: the later in its batch, then the later session by name), with ``first_at`` and ``first_seq`` of the earliest and the number of statements."""
    counted = facts if "n" in facts.columns else facts.withColumns({"first_at": F.col("at"), "first_seq": F.col("seq"), "n": F.lit(1).cast("bigint")})
    last = F.max(F.struct("at", "seq", "session_id", "value", "status", "source_text")).alias("l")
    x = counted.groupBy("user_key", "category", "name").agg(last, F.min(F.struct("first_at", "first_seq")).alias("f"), F.sum("n").alias("n"))
    return x.select("user_key", "category", "name", *[f"l.{c}" for c in ("value", "status", "source_text", "session_id", "at", "seq")], "f.*", "n")


def contexts(profiles: DataFrame) -> DataFrame:
    """What of ``folded`` a reader is shown: the SHOWN facts of each category that were first stated last, in that order: ``user_key, category, name, place, value, status, source, source_text``."""
    last = Window.partitionBy("user_key", "category").orderBy(F.desc("first_at"), F.desc("first_seq"), F.desc("name"))
    place = Window.partitionBy("user_key", "category").orderBy("first_at", "first_seq", "name")
    x = profiles.withColumn("r", F.row_number().over(last)).where((F.col("r") <= SHOWN) | (F.col("category") == "demographics"))
    return x.select("user_key", "category", "name", F.row_number().over(place).alias("place"), "value", "status", F.lit("user_reported").alias("source"), "source_text")


class ProfileStore:
    """A table of profiles under ``path``, which all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(folder))] if self.fs.exists(self.at(folder)) else []

    def base(self) -> int | None:
        """The batch up to which facts are folded: the newest base that was written to its end."""
        done = [int(n.removeprefix("base-")) for n in self.names("") if n.startswith("base-") and self.fs.exists(self.at(f"{n}/_SUCCESS"))]
        return max(done, default=None)

    def merge(self, proposals: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``: take the good batches among ``proposals``. A batch that comes again replaces what it wrote; one that is folded already changes nothing."""
        base = self.base()
        if base is None or batch_id > base:
            facts(proposals).write.mode("overwrite").parquet(f"{self.path}/facts/batch={batch_id}")

    def read(self) -> DataFrame:
        """The profiles (``folded``)."""
        base = self.base()
        parts = [self.spark.read.parquet(f"{self.path}/base-{base}")] if base is not None else []
        new = [f"{self.path}/facts/{n}" for n in self.names("facts") if n.startswith("batch=") and int(n[6:]) > (-1 if base is None else base) and self.fs.exists(self.at(f"facts/{n}/_SUCCESS"))]
        if new:
            one = self.spark.read.schema(FACTS).parquet(*new)
            parts.append(one.withColumns({"first_at": F.col("at"), "first_seq": F.col("seq"), "n": F.lit(1).cast("bigint")}))
        if not parts:
            return folded(self.spark.createDataFrame([], FACTS))
        return folded(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))

    def of(self, user_id: str) -> DataFrame:
        """What a reader is shown of one user; the user's key reaches the scans."""
        return contexts(self.read().where(F.col("user_key") == F.sha2(F.lit(user_id), 256)))

    def compact(self) -> None:
        """Fold all finished batches into a new base, dealt and sorted by user, so that row groups of other users are passed over. No batch may be merged meanwhile."""
        done = [int(n[6:]) for n in self.names("facts") if n.startswith("batch=") and self.fs.exists(self.at(f"facts/{n}/_SUCCESS"))]
        base = self.base()
        if not done or max(done) <= (-1 if base is None else base):
            return
        self.read().repartitionByRange("user_key", "category").sortWithinPartitions("user_key", "category").write.mode("overwrite").parquet(f"{self.path}/base-{max(done)}")
        for n in [f"facts/batch={b}" for b in done] + ([f"base-{base}"] if base is not None else []):
            self.fs.delete(self.at(n), True)


def keep_profiles(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Merge all proposals that a stream has now; with the same checkpoint a later run goes on after them."""
    store = ProfileStore(stream.sparkSession, path)
    stream.writeStream.foreachBatch(store.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
