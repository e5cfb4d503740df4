"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, with DataFrame and SQL functions only.

A text is a set of units (sentences of its lines, wrapped at UNIT_CHARS code points from their start) given by 64-bit digests. A sketch
has three subtables of ``s`` cells; each digest enters one cell of each, which holds a count, the XOR of its digests and the XOR of their
check values. Two sketches subtract cell by cell; units that both texts have cancel. Peeling takes digests out of cells that hold just
one, until all cells are empty and the differing digests are known; where that fails, both sketches are built again, larger, until
they hold the difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.llm.common import bucket_of, range_splits

UNIT_CHARS = 64
#: Cells per subtable of the fingerprint, and of the sketches tried one after the other where peeling fails; after the last of these
#: come sketches of four times the cells each, until one peels. GROWTHS of them exceed the distinct units that a text can have.
CELLS, RETRIES = 20, (80, 320)
GROWTHS = 10
FIRST_KEY = -(1 << 63)


def units_sql(text: str) -> str:
    """Distinct unit digests of a text, as array<bigint>."""
    return f"array_distinct(transform(regexp_extract_all({text}, '[^\\\\n.!?]{{1,{UNIT_CHARS}}}[.!?]*', 0), u -> xxhash64(u)))"


def _check(key: str) -> str:
    return f"(xxhash64({key}, 7L) & 4294967295L)"


def _groups(s: int) -> int:
    """A divisor of ``s`` near its square root."""
    return max(d for d in range(1, int(s**0.5) + 1) if s % d == 0)


def _cells_sql(keys: str, s: int | str, g: int | str, count: str) -> str:
    """Cells of an array<struct<h, c, ...>>, with ``count`` of the elements ``f`` of each. ``s`` and its divisor ``g``: numbers or SQL.

    Digests of a subtable are first dealt to ``g`` runs of cells and then to the cells, two short searches in place of a long one.
    """
    m = s // g if isinstance(s, int) else f"CAST({s} div {g} AS INT)"
    cell = f"transform(array(filter(own, x -> x.p = j)), f -> named_struct('n', {count}, 'k', aggregate(f, 0L, (a, x) -> a ^ x.h), 'c', aggregate(f, 0L, (a, x) -> a ^ x.c)))[0]"
    run = f"transform(array(filter(e, x -> x.q = i)), own -> transform(sequence(i * {m}, i * {m} + {m} - 1), j -> {cell}))[0]"
    at = [f"CAST(pmod(shiftrightunsigned(y.h, {21 * t}), CAST({s} AS BIGINT)) AS INT)" for t in range(3)]
    tables = [f"transform(array(transform(u, y -> named_struct('h', y.h, 'c', y.c, 'n', y.n, 'p', {p}, 'q', CAST({p} div {m} AS INT)))), e -> flatten(transform(sequence(0, {g} - 1), i -> {run})))[0]" for p in at]
    return f"transform(array({keys}), u -> concat({', '.join(tables)}))[0]"


def sketch_sql(units: str, s: int | str, g: int | str | None = None) -> str:
    """Cells of an array of digests: array<struct<n int, k bigint, c bigint>> with 3 * s elements."""
    return _cells_sql(f"transform({units}, h -> named_struct('h', h, 'c', {_check('h')}, 'n', 1))", s, g or _groups(s), "size(f)")


def subtract_sql(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'c', x.c ^ y.c))"


def peel_sql(cells: str, s: int | str, g: int | str | None = None) -> str:
    """struct<cells, got array<struct<k, n>>, more boolean>: ``got`` has the digests taken out, n > 0 for the first text's.

    Each round takes all single digests out at once, as a sketch of their own; the rounds end where none is found. Each takes one at
    least, so that there are never more of them than cells.
    """
    sides = [f"transform(array_distinct(transform(filter(acc.cells, x -> x.n = {n} AND x.c = {_check('x.k')}), x -> x.k)), k -> named_struct('k', k, 'n', {n}))" for n in (1, -1)]
    single = f"concat({', '.join(sides)})"
    taken = _cells_sql(f"transform(one, o -> named_struct('h', o.k, 'c', {_check('o.k')}, 'n', o.n))", s, g or _groups(s), "aggregate(f, 0, (a, x) -> a + x.n)")
    step = f"transform(array({single}), one -> IF(size(one) = 0, named_struct('cells', acc.cells, 'got', acc.got, 'more', false), named_struct('cells', {subtract_sql('acc.cells', taken)}, 'got', concat(acc.got, one), 'more', true)))[0]"
    start = f"named_struct('cells', {cells}, 'got', CAST(array() AS array<struct<k:bigint,n:int>>), 'more', true)"
    return f"aggregate(sequence(1, CAST(3 * {s} AS INT)), {start}, (acc, r) -> IF(acc.more, {step}, acc))"


def grow_sql(a: str, b: str, s: int) -> str:
    """struct<s bigint, p struct>: the first sketch of 4 * s, 16 * s, ... cells per subtable that peels, and what ``peel_sql`` gives of it."""
    size, g = "CAST(big.s * 4 AS BIGINT)", f"CAST({_groups(s)} * shiftleft(1, grown) AS INT)"
    peeled = peel_sql(subtract_sql(sketch_sql(a, "w.s", "w.g"), sketch_sql(b, "w.s", "w.g")), "w.s", "w.g")
    tried = f"transform(array(named_struct('s', {size}, 'g', {g})), w -> named_struct('s', w.s, 'p', {peeled}))[0]"
    none = "CAST(NULL AS struct<cells:array<struct<n:int,k:bigint,c:bigint>>,got:array<struct<k:bigint,n:int>>,more:boolean>)"
    return f"aggregate(sequence(1, {GROWTHS}), named_struct('s', {s}L, 'p', {none}), (big, grown) -> IF(coalesce({emptied_sql('big.p')}, false), big, {tried}))"


def emptied_sql(peeled: str) -> str:
    return f"forall({peeled}.cells, x -> x.n = 0 AND x.k = 0L AND x.c = 0L)"


def estimate_sql(cells: str, s: int, gap: str) -> str:
    """How many digests differ, from the squares of the counts: for sketches that don't peel. ``gap``: the difference of the set sizes."""
    squares = f"aggregate({cells}, 0D, (a, x) -> a + CAST(x.n AS double) * x.n) / 3"
    return f"(({squares}) - CAST({gap} AS double) * ({gap}) / {s}) / {1 - 1 / s}"


def likeness_sql(n_a: str, n_b: str, differ: str) -> str:
    """1 less the share of digests that differ, among those of both; 1 for two empty sets."""
    return f"CASE WHEN {n_a} + {n_b} = 0 THEN 1D ELSE 1D - least(CAST({n_a} + {n_b} AS double), greatest(CAST(abs({n_a} - {n_b}) AS double), CAST({differ} AS double))) / ({n_a} + {n_b}) END"


def fingerprint_sql(n: str, cells: str) -> str:
    """A sketch as text: the set's size, then count, digests and checks of each cell in hexadecimal."""
    return f"concat(hex({n}), ':', array_join(transform({cells}, x -> concat_ws('.', hex(x.n), hex(x.k), hex(x.c))), '|'))"


def with_next(df: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """``b, k, t, next_t``: each row's key and text and the text of the next row by key (ties: by text); after the last comes the first.

    Rows go to buckets, runs of keys cut at keys that exist. The first row of a bucket is also sent, as a guard, to the end of the
    bucket before it, so that every bucket knows its successor without a second pass or a single global partition.
    """
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST_KEY)).alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    lowest = rows.agg(F.min("k")).first()[0]
    splits = [x for x in range_splits(rows, F.col("k"), parts) if lowest is not None and x > lowest]
    b = bucket_of(F.col("k"), splits)
    opens = F.col("k").isin(*splits) if len(splits) <= 16 else F.array_contains(F.array(*[F.lit(x).cast("long") for x in splits]), F.col("k"))
    guard = F.when(F.col("k") == F.lit(lowest), F.lit(len(splits))).when(opens if splits else F.lit(False), F.col("b") - 1)
    both = rows.withColumn("b", b).withColumn("at", F.explode(F.array_compact(F.array(F.struct(F.col("b").alias("b"), F.lit(False).alias("g")), F.when(guard.isNotNull(), F.struct(guard.alias("b"), F.lit(True).alias("g")))))))
    w = Window.partitionBy("b").orderBy("g", "k", "t")
    return both.select("at.b", "at.g", "k", "t").withColumn("next_t", F.lead("t").over(w))


def fingerprint_versions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprint every text and an edited version (its last quarter replaced by the start of the next text), and compare them.

    Returns ``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_differ, sketch_cells``:
    ``n_differ`` counts the digests that peeling recovered from a sketch of ``sketch_cells`` cells, grown until it holds them. Null texts are empty; null ids come first; equal ids are ordered by text and
    all stay; one row is its own successor; an empty table gives an empty table; other columns are not read.
    """
    spark = df.sparkSession
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(df, id_col, text_col, parts)
    q = "CAST(floor(length(t) / 4) AS INT)"
    x = rows.selectExpr("b", "g", "k", "length(t) AS n_chars", "t", f"concat(substring(t, 1, length(t) - {q}), substring(coalesce(next_t, t), 1, {q})) AS e")
    x = x.selectExpr("b", "g", "k", "n_chars", "sha2(e, 256) AS edited_sha256", f"{units_sql('t')} AS ut", f"{units_sql('e')} AS ue", "t")
    x = x.selectExpr("*", f"{sketch_sql('ut', CELLS)} AS st", f"{sketch_sql('ue', CELLS)} AS se", "size(ut) AS nt", "size(ue) AS ne")
    w = Window.partitionBy("b").orderBy("g", "k", "t")
    x = x.withColumn("sn", F.lead("st").over(w)).withColumn("nn", F.lead("nt").over(w)).where("NOT g").drop("t")
    x = x.selectExpr("*", f"{subtract_sql('st', 'se')} AS d0", f"{subtract_sql('st', 'sn')} AS dn")
    x = x.selectExpr("*", f"{peel_sql('d0', CELLS)} AS p0", f"{peel_sql('dn', CELLS)} AS pn")
    found = [(f"{emptied_sql('p0')}", "size(p0.got)", CELLS)]
    tried = emptied_sql("p0")
    for i, s in enumerate(RETRIES, 1):
        # A sketch is only worth building where it can hold the difference: at most all units of both texts.
        x = x.selectExpr("*", f"IF({tried}, NULL, {peel_sql(subtract_sql(sketch_sql('ut', s), sketch_sql('ue', s)), s)}) AS p{i}")
        ok = f"coalesce({emptied_sql(f'p{i}')}, false)"
        found.append((ok, f"size(p{i}.got)", s))
        tried = f"({tried} OR {ok})"
    x = x.selectExpr("*", f"IF({tried}, NULL, {grow_sql('ut', 'ue', RETRIES[-1])}) AS pg")
    grown = f"coalesce({emptied_sql('pg.p')}, false)"
    found.append((grown, "size(pg.p.got)", "pg.s"))
    when = " ".join(f"WHEN {ok} THEN {n}" for ok, n, _ in found)
    size = " ".join(f"WHEN {ok} THEN CAST(3 * {s} AS INT)" for ok, _, s in found)
    x = x.selectExpr("*", f"CASE {when} END AS n_differ", f"CASE {size} END AS sketch_cells")
    guess_e, guess_n = estimate_sql("d0", CELLS, "(nt - ne)"), estimate_sql("dn", CELLS, "(nt - nn)")
    kind = dict(df.dtypes)[id_col]
    key = f"CAST(IF(k = {FIRST_KEY + 1}L - 1L, NULL, k) AS {kind}) AS `{id_col}`"
    return x.selectExpr(
        key,
        "CAST(n_chars AS bigint) AS n_chars",
        "edited_sha256",
        f"{fingerprint_sql('nt', 'st')} AS fingerprint",
        f"{fingerprint_sql('ne', 'se')} AS edited_fingerprint",
        f"{likeness_sql('nt', 'ne', f'coalesce(n_differ, {guess_e})')} AS near_edited",
        f"{likeness_sql('nt', 'nn', f'IF({emptied_sql("pn")}, size(pn.got), {guess_n})')} AS near_next",
        "n_differ",
        "sketch_cells",
    )


def compare_versions(df: DataFrame, old: str, new: str, cells: int = CELLS, retries: tuple[int, ...] = RETRIES) -> DataFrame:
    """Digests that differ between two text columns: ``df`` plus ``only_old``, ``only_new`` (array<bigint>).

    Sketches of ``cells`` and ``retries`` are tried, then larger ones until one peels. Null texts are empty. The columns are added last, under names that ``df`` must not have.
    """
    a, b = f"coalesce({old}, '')", f"coalesce({new}, '')"
    out = df.selectExpr("*", f"{units_sql(a)} AS __ua", f"{units_sql(b)} AS __ub")
    out = out.withColumn("__got", F.lit(None).cast("array<struct<k:bigint,n:int>>"))
    for s in (cells, *retries):
        peeled = peel_sql(subtract_sql(sketch_sql("__ua", s), sketch_sql("__ub", s)), s)
        out = out.withColumn("__p", F.expr(f"IF(__got IS NULL, {peeled}, NULL)"))
        out = out.withColumn("__got", F.expr(f"coalesce(__got, IF({emptied_sql('__p')}, __p.got, NULL))")).drop("__p")
    out = out.withColumn("__p", F.expr(f"IF(__got IS NULL, {grow_sql('__ua', '__ub', (cells, *retries)[-1])}, NULL)"))
    out = out.withColumn("__got", F.expr(f"coalesce(__got, IF({emptied_sql('__p.p')}, __p.p.got, NULL))")).drop("__p")

    def side(sign: int) -> Column:
        return F.expr(f"transform(filter(__got, x -> x.n = {sign}), x -> x.k)")

    return out.withColumn("only_old", side(1)).withColumn("only_new", side(-1)).drop("__ua", "__ub", "__got")
