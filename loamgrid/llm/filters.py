"""Filter interaction audit: what each of several text filters removes, in every order in which they can be applied.

Texts are scanned where they lie, in the byte buffers of Arrow batches: NumPy classes of bytes and their prefix sums count words, capitals, symbols
and code points of all texts of a batch at once, and sorted hashes of the words of each text, verified byte by byte, its distinct words.
A text leaves the scan as five numbers and a digest. Rows are then counted by part and by the set of filters that they fail (a mask), so what all
orders remove is sums over at most 32 masks a part, however many rows there are.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.llm.common import small_batches

#: The filters: a row that holds the condition is removed. They read the columns that ``scan`` counts.
CONDITIONS = {"A": "n_words < 200", "B": "100 * n_distinct < 50 * n_words", "C": "100 * n_capitals > 2 * n_chars", "D": "n_symbols > 0"}
#: The filter of repeated texts, which is told by the table.
REPEATED = "E"
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#$%&*|")] = True
#: Bytes of text scanned at once (a longer text is scanned alone), and texts at most: their numbers share 64 bits with hashes.
CHUNK_BYTES, CHUNK_TEXTS = 4_000_000, 1_000
#: Longer words are hashed and compared one by one.
LONG = 64
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Masks of the first 0 to 8 bytes of a little-endian number.
FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set between neighbouring offsets, by a prefix sum."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def eights(data: np.ndarray) -> np.ndarray:
    """At each byte, the eight bytes from there on as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def distinct_words(data: np.ndarray, start: np.ndarray, stop: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Distinct words of each of ``n`` texts. Equal hashes that stand next to each other in order are compared as bytes; a text in which two differ is counted anew, from its words."""
    size, at = stop - start, eights(data)
    h = size.astype(np.uint64) * ODD
    short = size <= LONG
    with np.errstate(over="ignore"):
        for i in range(0, LONG, 8):
            live = np.flatnonzero(short & (size > i))
            if not len(live):
                break
            x = (h[live] ^ (at[start[live] + i] & FIRST[np.minimum(size[live] - i, 8)])) * ODD
            h[live] = x ^ (x >> np.uint64(29))
        for i in np.flatnonzero(~short):
            h[i] = xxhash.xxh3_64_intdigest(data[start[i] : stop[i]].tobytes())
        key = (doc.astype(np.uint64) << np.uint64(54)) | ((h * ODD) >> np.uint64(10))
    order = np.argsort(key)
    equal = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    a, b = order[equal], order[equal + 1]
    wrong = size[a] != size[b]
    for i in range(0, LONG, 8):
        live = np.flatnonzero(~wrong & short[a] & (size[a] > i))
        if not len(live):
            break
        wrong[live] |= ((at[start[a[live]] + i] ^ at[start[b[live]] + i]) & FIRST[np.minimum(size[a[live]] - i, 8)]) != 0
    for i in np.flatnonzero(~wrong & ~short[a]):
        wrong[i] = not np.array_equal(data[start[a[i]] : stop[a[i]]], data[start[b[i]] : stop[b[i]]])
    out = np.bincount(doc, minlength=n) - np.bincount(doc[b], minlength=n)
    for d in np.unique(doc[a[wrong]]):
        out[d] = len({data[start[i] : stop[i]].tobytes() for i in np.flatnonzero(doc == d)})
    return out


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words, distinct words, capitals, symbols and code points of the texts that lie in ``data`` between neighbouring ``offsets``."""
    word = ~BLANK[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    first[offsets[full]] = word[offsets[full]]  # texts lie next to each other without blanks
    last[offsets[full + 1] - 1] = word[offsets[full + 1] - 1]
    n_words = sums(first, offsets)
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    n_distinct = distinct_words(data, start, stop, np.repeat(np.arange(len(n_words)), n_words), len(n_words))
    return n_words, n_distinct, sums((data >= 65) & (data <= 90), offsets), sums(SYMBOL[data], offsets), sums((data & 0xC0) != 0x80, offsets)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array without nulls, as they lie in its buffers."""
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def scan(df: DataFrame, keys: list[Column], text: Column) -> DataFrame:
    """``k0, k1, ..., n_words, n_distinct, n_capitals, n_symbols, n_chars, digest`` of every row: counts of its whole text and the text's sha256. Null texts are empty."""
    small_batches(df.sparkSession)
    picked = df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.coalesce(text.cast("string"), F.lit("")).alias("t"))
    names = ["n_words", "n_distinct", "n_capitals", "n_symbols", "n_chars"]
    ddl = ", ".join([f"{c} {k}" for c, k in picked.dtypes[:-1]] + [f"{c} bigint" for c in names] + ["digest binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(batch.num_columns - 1))
            lo = 0
            while lo < batch.num_rows:
                hi = int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, "right")) - 1
                hi = min(max(hi, lo + 1), lo + CHUNK_TEXTS, batch.num_rows)
                own, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                digests = [hashlib.sha256(own[a:b]).digest() for a, b in itertools.pairwise(at.tolist())]
                cols = [c.slice(lo, hi - lo) for c in batch.columns[:-1]] + [pa.array(c.astype(np.int64)) for c in measure(own, at)] + [pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], *names, "digest"])
                lo = hi

    return picked.mapInArrow(run, ddl)


def audit(docs: DataFrame, labels: DataFrame, conditions: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` for every part, order of filters and step.

    A filter of one letter each for ``conditions``, and ``REPEATED``: the text is that of a row with a smaller id somewhere in the table. Null texts are empty and
    equal each other; a null part is ''; a null id is no smaller than any other and has no smaller one, so such rows are never repeats; rows that repeat an id are
    judged each by itself, and those that share the smallest id of a text all stay. A row is good (toxic) if any label of its id says quality (toxic) 1; labels
    without an id count for nothing. No documents give no rows. Other columns are not read.
    """
    conditions = CONDITIONS if conditions is None else conditions
    letters = "".join(conditions) + REPEATED
    fails = " | ".join(f"IF({c}, {1 << i}, 0)" for i, c in enumerate(conditions.values())) or "0"
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    seen = scan(docs, [F.col(id_col), part], F.col(text_col)).selectExpr("k0 AS id", "k1 AS part", "digest", f"{fails} AS mask")
    # Rows without an id have no label; they are spread over the join's tasks.
    seen = seen.groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")).withColumn("spread", F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(0))
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("lid")).agg(F.max(F.expr("coalesce(quality = 1, false)")).alias("good"), F.max(F.expr("coalesce(toxic = 1, false)")).alias("toxic"))
    rows = seen.join(said, (F.col("id") == F.col("lid")) & (F.col("spread") == 0), "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # Of a text: at most one row for each part and label. Its smallest id is no repeat, wherever that row stands.
    texts = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("free"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("lo"))
    texts = texts.withColumn("first", F.min("lo.id").over(Window.partitionBy("digest"))).withColumn("fresh", F.expr("free + IF(lo.id = first, lo.n, 0L)"))
    texts = texts.withColumn("fresh", F.coalesce("fresh", "free"))
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("fresh").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(1 << len(conditions))).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")))
    flat = texts.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "good", "toxic", "x.mask", "x.n")
    masks = flat.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.expr("IF(good, n, 0L)")).alias("good"), F.sum(F.expr("IF(toxic, n, 0L)")).alias("toxic"))
    return orders(masks, letters)


def orders(masks: DataFrame, letters: str) -> DataFrame:
    """From ``part, mask, n, good, toxic`` (a mask's bit i: the filter of letter i fails) the counts of every order and step. A part has at most ``2 ** len(letters)`` masks."""
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))
    every = ["".join(p) for p in itertools.permutations(letters)]
    bit = f"shiftleft(1, instr('{letters}', substring(filter_order, {{}}, 1)) - 1)"
    x = parts.withColumn("filter_order", F.explode(F.split(F.lit(",".join(every)), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    x = x.selectExpr("*", f"{bit.format('step')} AS own", f"aggregate(sequence(0, step - 1), 0, (a, i) -> IF(i = 0, 0, a | {bit.format('i')})) AS before")

    def total(which: str, what: str = "x.n") -> str:
        return f"aggregate(m, 0L, (a, x) -> a + IF({which}, {what}, 0L))"

    removed = "x.mask & own <> 0 AND x.mask & before = 0"
    return x.selectExpr(
        "part",
        "filter_order",
        "step",
        f"{total('x.mask & (own | before) = 0')} AS kept",
        f"{total(removed)} AS removed",
        f"{total('x.mask & own <> 0 AND x.mask & before <> 0')} AS redundant",
        f"{total('x.mask = own')} AS unique_fails",
        f"{total(removed, 'x.good')} AS good_lost",
        f"{total(removed, 'x.toxic')} AS toxic_lost",
        # In an equal share of all orders each of the filters that a row fails comes first.
        f"{total('x.mask & own <> 0', f'x.n * {len(every)} DIV bit_count(x.mask)')} AS shapley",
    )
