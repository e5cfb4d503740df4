"""Which of many needles stand in which texts, both in a form of letters and digits only; and what an audit of sources by it covers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of needles in one automaton (about 100 bytes each in a worker); more needles are searched block by block.
BLOCK_CHARS = 500_000
NOT_ALNUM = re.compile(r"[\W_]+")


def alnum_form(text: str) -> str:
    """Letters and digits of the case-folded compatible form."""
    return NOT_ALNUM.sub("", unicodedata.normalize("NFKC", text).casefold())


def blocks(needles: DataFrame, most: int) -> Iterator[list[str]]:
    """The different forms of needles, in blocks of about ``most`` characters at most, by hash; a block is what reaches the driver at once."""
    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([alnum_form(t) for t in b.column(0).to_pylist()], pa.string())], names=["form"])

    x = needles.select(F.col("text").cast("string")).where("text IS NOT NULL").mapInArrow(forms, "form string").where("form <> ''").distinct()
    total = x.agg(F.sum(F.length("form"))).first()[0] or 0
    n = -(-2 * total // most) if total > most else 1
    for i in range(n):
        got = x.where(F.pmod(F.xxhash64("form"), F.lit(n)) == i).toArrow()["form"].to_pylist()
        if got:
            yield got


def contained(rows: DataFrame, needles: DataFrame, row_id: str, text: str, needle_id: str, needle_text: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``row_id, needle_id, first, n``: every needle that a row's text contains, how often (overlaps count) and where first, in code points of the text's form.

    All needles of a block are found in one pass over a text, by an automaton. Needles of one form are each given; needles without letters or digits and null texts
    match nothing; repeated rows each have their matches; no rows or no needles give no rows.
    """
    spark: SparkSession = rows.sparkSession
    kind, needle_kind = dict(rows.dtypes)[row_id], dict(needles.dtypes)[needle_id]
    named = needles.select(F.col(needle_id).alias("needle"), F.col(needle_text).cast("string").alias("text"))
    ddl = f"id {kind}, form string, first bigint, n bigint"
    out = None
    for part in blocks(named, block_chars):
        sent = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            auto = ahocorasick.Automaton()
            for i, form in enumerate(sent.value):
                auto.add_word(form, i)
            auto.make_automaton()
            for b in batches:
                row, which, first, count = [], [], [], []
                for r, t in enumerate(b.column(1).to_pylist()):
                    found: dict[int, list[int]] = {}
                    for end, i in auto.iter(alnum_form(t)):
                        at = found.setdefault(i, [end - len(sent.value[i]) + 1, 0])
                        at[1] += 1
                    for i, (a, n) in found.items():
                        row.append(r)
                        which.append(sent.value[i])
                        first.append(a)
                        count.append(n)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(which, pa.string()), pa.array(first, pa.int64()), pa.array(count, pa.int64())], names=["id", "form", "first", "n"])

        found = rows.select(F.col(row_id).alias("id"), F.col(text).cast("string").alias("t")).where("t IS NOT NULL").mapInArrow(run, ddl)
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], f"`{row_id}` {kind}, `{needle_id}` {needle_kind}, first bigint, n bigint")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([alnum_form(t) for t in b.column(1).to_pylist()], pa.string())], names=["needle", "form"])

    forms = named.where("text IS NOT NULL").mapInArrow(keyed, f"needle {needle_kind}, form string")
    return out.join(forms, "form").select(F.col("id").alias(row_id), F.col("needle").alias(needle_id), "first", "n")


def coverage(rows: DataFrame, matches: DataFrame, source: str, row_id: str, text: str) -> DataFrame:
    """``source, n_rows, sha256, n_matches, n_matched_rows`` of each source that an audit has read.

    The digest stands for the source's rows, whatever their order: each row's digest falls into one of 4,096 buckets by its first digits, each bucket's digest is made of its
    rows' in order, and the source's of its buckets' in order, so no list is longer than a bucket.
    """
    own = F.sha2(F.concat_ws(":", F.coalesce(F.col(row_id).cast("string"), F.lit("-")), F.coalesce(text, F.lit(""))), 256)
    per = matches.groupBy(F.col(row_id).alias("__id")).agg(F.count(F.lit(1)).alias("__m"))
    x = rows.select(F.col(source), F.col(row_id).alias("__r"), own.alias("h")).join(per, F.col("__r") == F.col("__id"), "left")
    b = x.groupBy(source, F.substring("h", 1, 3).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("__m", F.lit(0))).alias("m"), F.count("__m").alias("k"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"))
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda y: y["d"]), ""), 256)
    return b.groupBy(source).agg(F.sum("n").alias("n_rows"), digest.alias("sha256"), F.sum("m").alias("n_matches"), F.sum("k").alias("n_matched_rows"))
