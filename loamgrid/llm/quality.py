"""Quality classifier: an interpolated modified Kneser-Ney model of character n-grams, trained per language on trusted text.

Counts are summed over all trusted text: tasks emit the counts of their runs of text, which meet per n-gram. Lower orders count
distinct left neighbours; discounts come from counts of counts. Probabilities and back-off weights are built order by order with joins
sharded by n-gram. Documents are scored against bounded shards of the finished table, one pass per shard, and judged by
a quantile, by language, of the perplexity of trusted documents that the counts left out, with regard to length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.common import _arrow_schema, cut, map_texts, small_batches, worker_state

ORDER, BITS = 4, 16
OTHER = (1 << BITS) - 1
#: N-grams of a shard (16 bytes each); a larger table is scored in several passes.
SHARD_ROWS = 4_000_000
#: Symbols counted at once by a task, and the share of trusted documents whose perplexity is below the threshold.
RUN, QUANTILE = 4_000_000, 0.995
#: One trusted document in so many is held out of the counts; thresholds come from these. The least variance of log perplexity.
HELD_OUT, LEAST_SPREAD = 5, 1e-6
#: Rows of trusted ids (8 bytes each) up to which they are broadcast.
BROADCAST_IDS = 2_000_000
#: Rows of thresholds (about 40 bytes each) up to which they are broadcast.
FEW = 100_000


def symbols(text: str) -> np.ndarray:
    """Code points (those beyond 16 bits as one symbol), after ORDER - 1 starting symbols, with an end symbol."""
    s = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.concatenate([np.ones(ORDER - 1, np.uint64), np.minimum(s, OTHER).astype(np.uint64), np.full(1, 2, np.uint64)])


def grams(s: np.ndarray) -> np.ndarray:
    """All ORDER-grams as 64-bit keys, the last symbol in the lowest bits."""
    n = len(s) - ORDER + 1
    key = np.zeros(n, np.uint64)
    for i in range(ORDER):
        key = (key << np.uint64(BITS)) | s[i : i + n]
    return key


def count_grams(texts: DataFrame) -> DataFrame:
    """``lang, g, c`` over all rows of ``lang, t``."""
    ddl = "lang string, g bigint, c bigint"
    out = _arrow_schema(texts.sparkSession, ddl)
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(None)
        held: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}

        def pack(lang):
            g, c = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
            size.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(c.astype(np.int64))], schema=out)

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for i in range(batch.num_rows):
                g = grams(symbols(batch.column(1)[i].as_py() or ""))
                held.setdefault(langs[i], []).append(g)
                size[langs[i]] = size.get(langs[i], 0) + len(g)
                if sum(size.values()) >= RUN:
                    for lang in list(held):
                        yield pack(lang)
        for lang in list(held):
            yield pack(lang)

    return texts.mapInArrow(run, ddl).groupBy("lang", "g").agg(F.sum("c").alias("c"))


def estimate(counts: DataFrame) -> DataFrame:
    """``lang, k, g, lp, lb``: log probability of every seen k-gram, and log back-off weight of those that are contexts (else null).

    A row with k = 0 per language has the log probability of an unseen symbol.
    """
    tables = {ORDER: cut(counts)}
    for k in range(ORDER - 1, 0, -1):
        mask = F.lit((1 << (BITS * k)) - 1).cast("long")
        tables[k] = cut(tables[k + 1].groupBy("lang", F.col("g").bitwiseAND(mask).alias("g")).agg(F.count(F.lit(1)).alias("c")))
    parts, lower = [], None
    for k in range(1, ORDER + 1):
        t = tables[k]
        n = t.groupBy("lang").agg(*[F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)])
        y = F.when(F.col("n1") + F.col("n2") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
        disc = [F.when((F.col(f"n{i}") > 0), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")).otherwise(F.lit(0.5 * i)) for i in (1, 2, 3)]
        # Discounts stay inside (0, count): tiny tables can have counts of counts that the formula does not fit.
        n = n.select("lang", *[F.least(F.greatest(d, F.lit(0.05)), F.lit(i - 0.05)).alias(f"d{i}") for i, d in enumerate(disc, 1)])
        ctx = F.shiftrightunsigned("g", BITS) if k > 1 else F.lit(0).cast("long")
        t = t.withColumn("ctx", ctx)
        h = t.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), *[F.count_if(F.col("c") == i).alias(f"m{i}") for i in (1, 2)], F.count_if(F.col("c") > 2).alias("m3"), F.count(F.lit(1)).alias("kinds"))
        h = h.join(F.broadcast(n), "lang").withColumn("gamma", (F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")) / F.col("total"))
        x = t.join(h, ["lang", "ctx"])
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        if k == 1:
            x = x.withColumn("p", (F.col("c") - d) / F.col("total") + F.col("gamma") / (F.col("kinds") + 1))
            parts.append(h.select("lang", F.lit(0).alias("k"), F.lit(0).cast("long").alias("g"), F.log(F.col("gamma") / (F.col("kinds") + 1)).alias("lp"), F.lit(None).cast("double").alias("lb")))
        else:
            mask = F.lit((1 << (BITS * (k - 1))) - 1).cast("long")
            x = x.withColumn("low", F.col("g").bitwiseAND(mask)).join(lower.select("lang", F.col("g").alias("low"), F.col("p").alias("q")), ["lang", "low"])
            x = x.withColumn("p", (F.col("c") - d) / F.col("total") + F.col("gamma") * F.col("q"))
        own = cut(x.select("lang", "g", "p"))
        weights = h.select("lang", F.lit(k - 1).alias("k"), F.col("ctx").alias("g"), F.lit(None).cast("double").alias("lp"), F.log("gamma").alias("lb")) if k > 1 else None
        parts.append(own.select("lang", F.lit(k).alias("k"), "g", F.log("p").alias("lp"), F.lit(None).cast("double").alias("lb")))
        if weights is not None:
            parts.append(weights)
        lower = own
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.groupBy("lang", "k", "g").agg(F.max("lp").alias("lp"), F.max("lb").alias("lb"))


class Tables(NamedTuple):
    """Per language and order: sorted keys, log probabilities (nan: none) and back-off weights (0: none)."""

    by: dict[tuple[str, int], tuple[np.ndarray, np.ndarray, np.ndarray]]
    floor: dict[str, float]

    @staticmethod
    def of(rows: pa.Table) -> Tables:
        by, floor = {}, {}
        rows = rows.sort_by([("lang", "ascending"), ("k", "ascending")])
        names, kinds = rows["lang"].dictionary_encode().combine_chunks(), rows["k"].to_numpy()
        lang_at, langs = names.indices.to_numpy(zero_copy_only=False), names.dictionary.to_pylist()
        edges = np.flatnonzero(np.append(True, (np.diff(lang_at) != 0) | (np.diff(kinds) != 0))).tolist() + [rows.num_rows] if rows.num_rows else []
        for a, b in zip(edges, edges[1:], strict=False):
            lang, k, part = langs[lang_at[a]], int(kinds[a]), rows.slice(a, b - a)
            if k == 0:
                floor[lang] = float(pa.compute.max(part["lp"]).as_py())
                continue
            g = part["g"].to_numpy().astype(np.int64).view(np.uint64)
            order = np.argsort(g)
            lp, lb = (part[c].to_numpy().astype(np.float32)[order] for c in ("lp", "lb"))
            by[lang, k] = g[order], lp, np.nan_to_num(lb)
        return Tables(by, floor)

    def _at(self, lang: str, k: int, keys: np.ndarray):
        got = self.by.get((lang, k))
        if got is None or not len(got[0]):
            return np.full(len(keys), np.nan, np.float32), np.zeros(len(keys), np.float32)
        i = np.minimum(np.searchsorted(got[0], keys), len(got[0]) - 1)
        hit = got[0][i] == keys
        return np.where(hit, got[1][i], np.nan), np.where(hit, got[2][i], 0)

    def log_p(self, lang: str, keys: np.ndarray) -> np.ndarray:
        """Log probability of the last symbol of each key given the rest: the longest seen n-gram, and back-off weights on the way to it."""
        out, done, back = np.full(len(keys), self.floor[lang], np.float64), np.zeros(len(keys), bool), np.zeros(len(keys))
        for k in range(ORDER, 0, -1):
            mask = np.uint64((1 << (BITS * k)) - 1)
            lp, _ = self._at(lang, k, keys & mask)
            hit = ~done & ~np.isnan(lp)
            out[hit] = lp[hit] + back[hit]
            done |= hit
            if k > 1:
                _, lb = self._at(lang, k - 1, (keys & mask) >> np.uint64(BITS))
                back = np.where(done, back, back + lb)
        out[~done] += back[~done]
        return out


def shards_of(model: DataFrame, rows: int = SHARD_ROWS) -> list[DataFrame]:
    """The model in shards of about ``rows``. All n-grams that the score of a symbol needs share its left neighbour, the key; orders 0 and 1 are in every shard."""
    n = max(1, -(-model.count() // rows))
    if n == 1:
        return [model]
    # As the end of a context (back-off weights) that symbol is last; as part of an n-gram (probabilities) it is last but one.
    last, before = F.col("g").bitwiseAND(F.lit(OTHER).cast("long")), F.shiftrightunsigned("g", BITS).bitwiseAND(F.lit(OTHER).cast("long"))
    here = lambda s, i: F.pmod(F.xxhash64(s), F.lit(n)) == i
    return [model.select("lang", "k", "g", F.when((F.col("k") < 2) | here(before, i), F.col("lp")).alias("lp"), F.when(here(last, i), F.col("lb")).alias("lb")).where("lp IS NOT NULL OR lb IS NOT NULL") for i in range(n)]


def neighbour_shard(spark, n: int) -> np.ndarray:
    """Which of ``n`` shards each symbol as left neighbour belongs to."""
    got = spark.range(1 << BITS).select("id", F.pmod(F.xxhash64("id"), F.lit(n)).alias("s")).orderBy("id").toPandas()
    return got["s"].to_numpy(np.int64)


def perplexity(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``id, lang, h, n, lp``: symbols and log probability of every text (``h``: a hash of it). No model for the language: ``lp`` is null."""
    shards = shards_of(model, shard_rows)
    spark = docs.sparkSession
    owner = neighbour_shard(spark, len(shards)) if len(shards) > 1 else None
    kind = dict(docs.dtypes)[id_col]
    ddl = f"id {kind}, lang string, h bigint, n bigint, lp double"
    out = None
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(""))
    for i, part in enumerate(shards):
        shared = spark.sparkContext.broadcast(Tables.of(part.toArrow()))

        def make(i=i, shared=shared):
            tables = shared.value

            def run(keys, texts):
                rows = [None] * len(texts)
                by: dict[str, list[int]] = {}
                for x, (_, language, _) in enumerate(keys):
                    by.setdefault(language, []).append(x)
                for language, own in by.items():
                    parts = [grams(symbols(texts[x])) for x in own]
                    sizes = np.array([len(p) for p in parts])
                    if language in tables.floor:
                        whole = np.concatenate(parts)
                        if owner is not None:
                            mine = owner[((whole >> np.uint64(BITS)) & np.uint64(OTHER)).astype(np.int64)] == i
                        kinds, back = np.unique(whole, return_inverse=True)
                        lp = tables.log_p(language, kinds)[back]
                        if owner is not None:
                            lp = np.where(mine, lp, 0)
                        sums = np.add.reduceat(lp, np.concatenate([[0], np.cumsum(sizes)[:-1]])).tolist()
                    else:
                        sums = [None] * len(own)
                    for x, s, size in zip(own, sums, sizes.tolist(), strict=True):
                        rows[x] = (keys[x][0], language, keys[x][2], size, s)
                return rows

            return run

        got = map_texts(docs, [F.col(id_col), lang, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))], F.col(text_col), make, ddl)
        out = got if out is None else out.unionAll(got)
    if len(shards) > 1:
        # Rows of one id and text count in every shard alike: their mean is each one's share.
        whole = out.groupBy("id", "lang", "h").agg((F.sum("n") / len(shards)).alias("n"), F.sum("lp").alias("lp"), (F.count(F.lit(1)) / len(shards)).cast("bigint").alias("times"))
        out = whole.select("id", "lang", "h", (F.col("n") / F.col("times")).cast("bigint").alias("n"), (F.col("lp") / F.col("times")).alias("lp"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("x")).drop("x")
    return out


def _few(rows: DataFrame) -> DataFrame:
    """A written table, to be broadcast while it is small."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", quantile: float = QUANTILE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per document: ``id_col, lang, n_symbols, perplexity, threshold, keep``.

    Trusted text: documents labelled quality 1 (any such label of the id counts). The model counts those whose hash of the id leaves a
    remainder by HELD_OUT; the others, which it has not seen, give the thresholds. Log perplexities of a language scatter around their median
    with a variance of v + w / symbols, a line fitted to them, and ``threshold`` lies as many of these widths above the median as the quantile of the
    held-out documents does. Without trusted text in its language a document has a null perplexity,
    and without held-out text a null threshold; such documents are kept. Null languages are one language, ''; null texts are empty;
    repeated rows stay; an empty table gives an empty table; other columns are not read.
    """
    good = labels.where("quality = 1").select(F.col(id_col).alias("__good")).where("__good IS NOT NULL").distinct()
    good = F.broadcast(good) if good.count() <= BROADCAST_IDS else good
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("__id"), lang.alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    held = F.pmod(F.xxhash64("__good", F.lit(13)), F.lit(HELD_OUT)) == 0
    trusted = texts.join(good.where(~held), texts["__id"] == good["__good"], "left_semi").select("lang", "t")
    model = cut(estimate(count_grams(trusted)))
    scored = cut(perplexity(docs, model, id_col, shard_rows=shard_rows).withColumn("ppl", F.exp(-F.col("lp") / F.col("n"))))
    seen = scored.join(good.where(held), scored["id"] == good["__good"], "left_semi").where("lp IS NOT NULL").select("lang", "n", (-F.col("lp") / F.col("n")).alias("y"))
    # One row per language, as the model has.
    middle = cut(seen.groupBy("lang").agg(F.percentile_approx("y", 0.5, 10_000).alias("mu")))
    far = seen.join(_few(middle), "lang").withColumn("dev", (F.col("y") - F.col("mu")) * (F.col("y") - F.col("mu")))
    spread = cut(far.groupBy("lang").agg(F.first("mu").alias("mu"), F.greatest(F.coalesce(F.regr_intercept("dev", F.lit(1) / F.col("n")), F.avg("dev")), F.lit(LEAST_SPREAD)).alias("v"), F.greatest(F.coalesce(F.regr_slope("dev", F.lit(1) / F.col("n")), F.lit(0.0)), F.lit(0.0)).alias("w")))
    width = F.sqrt(F.col("v") + F.col("w") / F.col("n"))
    limits = cut(seen.join(_few(spread), "lang").groupBy("lang").agg(F.first("mu").alias("mu"), F.first("v").alias("v"), F.first("w").alias("w"), F.percentile_approx((F.col("y") - F.col("mu")) / width, quantile, 10_000).alias("z")))
    t = F.exp(F.col("mu") + F.col("z") * width)
    out = scored.join(_few(limits), "lang", "left")
    return out.select(F.col("id").alias(id_col), "lang", F.col("n").alias("n_symbols"), F.col("ppl").alias("perplexity"), t.alias("threshold"), F.coalesce(F.col("ppl") <= t, F.lit(True)).alias("keep"))
