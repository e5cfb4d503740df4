"""Order-dependent operators: packing by offsets, batches, turns, tool-call pairing, state machines, matching of logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offsets(df: DataFrame, group: str, order: str, size: str, parts: int = 200) -> DataFrame:
    """``df`` with ``start``, the sum of ``size`` over the group's rows before it, and ``total``, the group's.

    Rows go to runs of ``order`` cut at quantiles of the whole table: a sum within each run, and one over the runs' totals, of which a group has at most ``parts``.
    So a group of any size is spread over tasks.
    """
    cuts = sorted(set(df.select(F.percentile_approx(order, [i / parts for i in range(1, parts)], 20 * parts).alias("q")).first()["q"] or []))
    runs = df.sparkSession.createDataFrame([(c,) for c in cuts], f"`__cut` {dict(df.dtypes)[order]}") if cuts else None
    x = df
    if runs is not None:
        x = x.crossJoin(F.broadcast(runs.agg(F.array_sort(F.collect_list("__cut")).alias("__cuts"))))
        x = x.withColumn("__run", F.size(F.filter("__cuts", lambda c: c <= F.col(order)))).drop("__cuts")
    else:
        x = x.withColumn("__run", F.lit(0))
    sums = x.groupBy(group, "__run").agg(F.sum(size).alias("__s"))
    w = Window.partitionBy(group)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__s").over(w.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("__s").over(w)).drop("__s")
    x = x.withColumn("__in", F.coalesce(F.sum(size).over(Window.partitionBy(group, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    right = sums.select(F.col(group).alias("__g"), F.col("__run").alias("__r"), "__before", "total")
    x = x.join(right, x[group].eqNullSafe(F.col("__g")) & (F.col("__run") == F.col("__r")))
    return x.withColumn("start", F.col("__before") + F.col("__in")).drop("__g", "__r", "__run", "__before", "__in")


def packed_blocks(df: DataFrame, group: str, order: str, size: str, length: int = 2048) -> DataFrame:
    """Blocks of ``length`` tokens of each group's documents laid end to end, without overlap or loss: one row per block and document.

    ``size`` counts a document's tokens with its end mark. Columns: ``group, order, block, block_start, block_end, token_start, token_end`` (of the document, without the mark) and
    ``ends_document``. A last block of one token can't be trained on: where the stream leaves one, the block before it is a token shorter.
    """
    if length < 3:
        raise ValueError("a block needs three tokens at least")
    x = offsets(df.select(group, order, F.col(size).cast("bigint").alias("__n")), group, order, "__n").where("__n > 0")
    # With one token left over, blocks end at multiples of the length but for the last full one, which ends one earlier.
    tail = (F.col("total") % length == 1) & (F.col("total") > 1)
    last = F.when(tail, F.floor(F.col("total") / length) - 1)
    block = lambda p: F.when(tail & (p >= (last + 1) * length - 1), last + 1).otherwise(F.floor(p / length))
    begin = lambda b: F.when(tail & (b == last + 1), b * length - 1).otherwise(b * length)
    end = F.col("start") + F.col("__n")
    x = x.withColumn("__end", end).withColumn("block", F.explode(F.sequence(block(F.col("start")), block(end - 1))))
    stop = F.when(F.col("block") + 1 <= F.coalesce(last, F.lit(-1)) + 1, begin(F.col("block") + 1)).otherwise(F.col("total"))
    stop = F.least(F.when(tail, stop).otherwise((F.col("block") + 1) * length), F.col("total"))
    a, b = F.greatest(F.col("start"), begin(F.col("block"))), F.least(F.col("__end"), stop)
    n = F.col("__n") - 1
    return x.select(
        group, order, "block", (a - begin(F.col("block"))).alias("block_start"), (b - begin(F.col("block"))).alias("block_end"),
        F.least(a - F.col("start"), n).alias("token_start"), F.least(b - F.col("start"), n).alias("token_end"), (b == F.col("__end")).alias("ends_document"),
    )


def reconstructed(blocks: DataFrame, group: str, order: str) -> DataFrame:
    """Documents whose pieces, in order, don't meet end to end from 0: ``group, order, gap`` for each break (an audit of ``packed_blocks``)."""
    w = Window.partitionBy(group, order).orderBy("block")
    x = blocks.withColumn("before", F.coalesce(F.lag("token_end").over(w), F.lit(0)))
    return x.where(F.col("token_start") != F.col("before")).select(group, order, "block", (F.col("token_start") - F.col("before")).alias("gap"))


def overlaps(spans: DataFrame, key: str, start: str, stop: str) -> DataFrame:
    """Spans that begin before one of the same key, ordered before them, has ended."""
    w = Window.partitionBy(key).orderBy(start, stop).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("reached", F.max(stop).over(w)).where(F.col("reached") > F.col(start))


def _folded(df: DataFrame, group: str, order: list[str], size: str, close) -> DataFrame:
    """``df`` with ``batch``, a fold over each group's rows in order; ``close(count, longest, n)`` says whether a batch must end before a row of ``n``."""
    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        out, batch, count, longest = [], 0, 0, 0
        for n in part[size].fillna(0):
            if count and close(count, longest, n):
                batch, count, longest = batch + 1, 0, 0
            count, longest = count + 1, max(longest, n)
            out.append(batch)
        return part.assign(batch=pd.Series(out, index=part.index, dtype="int64"))

    return df.groupBy(group).applyInPandas(fold, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", batch bigint")


def length_batches(df: DataFrame, group: str, size: str, id_col: str, most: int = 16, budget: int = 6144) -> DataFrame:
    """Jobs by length, ties by id, in batches of at most ``most`` whose padded size stays in the budget. A group is one worker's queue."""
    return _folded(df, group, [size, id_col], size, lambda count, _, n: count == most or n * (count + 1) > budget)


def micro_batches(df: DataFrame, group: str, order: str, size: str, most: int, budget: int = 1024) -> DataFrame:
    """Consecutive rows in batches of at most ``most`` whose padded size stays in the budget; a longer row is a batch. A group is one training step."""
    return _folded(df, group, [order], size, lambda count, longest, n: count == most or (count + 1) * max(longest, n) > budget)


def recent_turns(df: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", turns: int = 5, most: int = 8000) -> DataFrame:
    """Messages of the last whole turns within ``most`` code points: at most ``turns``, and none after the first that does not fit.

    A turn begins at each user message; other roles than user and assistant are left out. A newest turn that is too long itself stays alone, each of its messages cut to an
    equal share.
    """
    x = df.where(F.col(role).isin("user", "assistant")).withColumn(text, F.coalesce(text, F.lit("")))
    x = x.withColumn("__t", F.sum(F.when(F.col(role) == "user", 1).otherwise(0)).over(Window.partitionBy(conv).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    per = x.groupBy(conv, "__t").agg(F.sum(F.length(text)).alias("__c"), F.count(F.lit(1)).alias("__m"))
    w = Window.partitionBy(conv).orderBy(F.desc("__t"))
    per = per.withColumn("__r", F.row_number().over(w)).withColumn("__sum", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = per.where((F.col("__r") <= turns) & ((F.col("__sum") <= most) | (F.col("__r") == 1)))
    share = F.when(F.col("__c") > most, F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("__m")))).otherwise(F.col("__c")).cast("int")
    return x.join(kept.select(conv, "__t", share.alias("__share")), [conv, "__t"]).withColumn(text, F.expr(f"substring(`{text}`, 1, __share)")).drop("__t", "__share")


def compressed_history(df: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", recent: int = 10, asked: int = 50, said: int = 100) -> DataFrame:
    """``conv, kind, at, first, second``: the last ``recent`` messages whole, and of those before them each question with the next answer, as snippets.

    A question is the first user message since the last answer taken; users who speak before it is answered, and further answers, are passed over. Other roles have no part.
    """
    w = Window.partitionBy(conv).orderBy(order)
    x = df.withColumn("__left", F.count(F.lit(1)).over(Window.partitionBy(conv)) - F.row_number().over(w))
    # Of each run of one role only the first message counts; then questions and answers take turns.
    old = x.where((F.col("__left") >= recent) & F.col(role).isin("user", "assistant")).withColumn("__before", F.lag(role).over(w)).where(F.col("__before").isNull() | (F.col("__before") != F.col(role)))
    p = old.withColumn("__next", F.lead(F.struct(F.substr(text, F.lit(1), F.lit(said)).alias("said"))).over(w)).where((F.col(role) == "user") & F.col("__next").isNotNull())
    p = p.select(conv, F.lit("pair").alias("kind"), F.col(order).alias("at"), F.substr(text, F.lit(1), F.lit(asked)).alias("first"), F.col("__next.said").alias("second"))
    return p.unionAll(x.where(F.col("__left") < recent).select(conv, F.lit("message"), order, role, text))


def numbered_lines(df: DataFrame, conv: str, order: str, text: str) -> DataFrame:
    """``label`` (T1L1, ...) and ``line`` of every line that is not blank; blank ones count."""
    x = df.withColumn("__t", F.row_number().over(Window.partitionBy(conv).orderBy(order))).select(conv, "__t", F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("__l", "line"))
    return x.where(F.trim("line") != "").select(conv, F.concat(F.lit("T"), F.col("__t").cast("string"), F.lit("L"), (F.col("__l") + 1).cast("string")).alias("label"), "line")


def context_growth(df: DataFrame, run: str, order: str, size: str) -> DataFrame:
    """Each request's context against the one before and the first of its run."""
    w = Window.partitionBy(run).orderBy(order)
    return df.withColumn("request", F.row_number().over(w)).withColumn("grown", F.col(size) - F.lag(size).over(w)).withColumn("since_first", F.col(size) - F.first(size).over(w))


def tool_pairing(messages: Column) -> Column:
    """Faults of a context's tool calls, in order: array<struct<type, ids>>. ``messages``: array<struct<role, call_id, calls array<string>>>.

    A tool message must answer a call that is pending, and no other message may come while one is; what is pending at the end is a fault, too.
    """
    none = F.array().cast("array<string>")
    state = F.struct(none.alias("pending"), F.array().cast("array<struct<type:string,ids:array<string>>>").alias("faults"))

    def fault(name: str, ids: Column) -> Column:
        return F.array(F.struct(F.lit(name).alias("type"), ids.alias("ids")))

    def step(s: Column, m: Column) -> Column:
        p, f = s["pending"], s["faults"]
        known = F.array_contains(p, F.coalesce(m["call_id"], F.lit("")))
        answered = F.struct(F.array_remove(p, F.coalesce(m["call_id"], F.lit(""))).alias("pending"), F.when(known, f).otherwise(F.concat(f, fault("orphan_tool_result", F.array(F.coalesce(m["call_id"], F.lit("")))))).alias("faults"))
        asked = F.when(m["role"] == "assistant", F.array_union(p, F.coalesce(m["calls"], none))).otherwise(p)
        other = F.struct(asked.alias("pending"), F.when(F.size(p) > 0, F.concat(f, fault("interrupted_tool_pair", F.array_sort(p)))).otherwise(f).alias("faults"))
        return F.when(m["role"] == "tool", answered).otherwise(other)

    return F.aggregate(messages, state, step, lambda s: F.when(F.size(s["pending"]) > 0, F.concat(s["faults"], fault("pending_tools_at_inference", F.array_sort(s["pending"])))).otherwise(s["faults"]))


#: Which status may follow which (fixed values).
NEXT = {None: ("pending",), "pending": ("in_progress", "failed"), "in_progress": ("completed", "failed"), "completed": (), "failed": ()}


def bad_transitions(df: DataFrame, task: str, order: str, status: str) -> DataFrame:
    """Rows whose status may not follow the task's one before."""
    x = df.withColumn("before", F.lag(status).over(Window.partitionBy(task).orderBy(order)))
    good = F.lit(False)
    for a, after in NEXT.items():
        here = F.col("before").isNull() if a is None else F.col("before") == a
        good = good | (here & F.col(status).isin(*after) if after else F.lit(False))
    return x.where(~F.coalesce(good, F.lit(False)))


def single_flight(calls: DataFrame, scope: str, key: str, order: str) -> DataFrame:
    """One row per call that was really made within a scope: ``scope, key, first``, the hits after it, and who asked (``agent``)."""
    return calls.groupBy(scope, key).agg(F.min(order).alias("first"), (F.count(F.lit(1)) - 1).alias("hits"), F.array_sort(F.collect_set("agent")).alias("consumers"))


def matched_logs(left: DataFrame, right: DataFrame, exact: str, relaxed: str, order: str) -> DataFrame:
    """One-to-one matches of two logs: first rows with the same exact key, the n-th with the n-th, then what is left by the relaxed key. ``left_order, right_order, kind``; one side is null where unmatched."""
    def nth(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.select(F.col(key).alias("k"), F.col(order).alias(name), F.row_number().over(Window.partitionBy(key).orderBy(order)).alias("n"))

    def pairs(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
        return nth(a, key, "left_order").join(nth(b, key, "right_order"), ["k", "n"]).select("left_order", "right_order")

    first = pairs(left, right, exact)
    a, b = (df.join(first.select(F.col(n).alias(order)), order, "left_anti") for df, n in ((left, "left_order"), (right, "right_order")))
    second = pairs(a, b, relaxed)
    rest_a, rest_b = (df.join(second.select(F.col(n).alias(order)), order, "left_anti").select(F.col(order).alias(n)) for df, n in ((a, "left_order"), (b, "right_order")))
    out = first.withColumn("kind", F.lit("exact")).unionByName(second.withColumn("kind", F.lit("same_call")))
    return out.unionByName(rest_a.withColumn("kind", F.lit("left_only")), allowMissingColumns=True).unionByName(rest_b.withColumn("kind", F.lit("right_only")), allowMissingColumns=True)


def merged_memories(a: DataFrame, b: DataFrame, owner: str, id_col: str, order: str, most: int = 20) -> DataFrame:
    """Two lists by id, in the first list's order and then the second's, each id once, at most ``most`` an owner."""
    x = a.withColumn("__l", F.lit(0)).unionByName(b.withColumn("__l", F.lit(1)))
    x = x.withColumn("__n", F.row_number().over(Window.partitionBy(owner, id_col).orderBy("__l", order))).where("__n = 1")
    return x.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy("__l", order))).where(F.col("place") <= most).drop("__n", "__l")


def resolved_references(blocks: DataFrame, run: str, block: str, body: str) -> DataFrame:
    """Rows that only refer to a block get its body from the same run; null where the run has none."""
    bodies = blocks.where(F.col(body).isNotNull()).groupBy(F.col(run).alias("__run"), F.col(block).alias("__block")).agg(F.min(body).alias("__body"))
    x = blocks.join(bodies, F.col(run).eqNullSafe(F.col("__run")) & (F.col(block) == F.col("__block")), "left")
    return x.withColumn(body, F.coalesce(body, "__body")).drop("__run", "__block", "__body")
