"""Chat formatting in budgeted windows, with DataFrame and SQL functions only.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts every backslash is doubled and ``<|`` becomes ``<\\|``, so no
text can hold a control string, and both steps undo exactly. Prefix sums of turn tokens cut a conversation into spans of whole turns;
each window holds the system turn, the last turns before its span within HISTORY tokens, and the span. Only the span's assistant texts are
under the loss mask, so every target counts once; what is repeated is masked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY = 1024, 128
#: What counts as a token: up to six letters, up to three digits, any other visible character; and those of the template around a turn.
TOKEN, TURN_TOKENS = r"[\p{L}\p{M}]{1,6}|\p{N}{1,3}|[^\s\p{L}\p{M}\p{N}]", 6


def escape_sql(x: str) -> str:
    return rf"replace(replace({x}, '\\', '\\\\'), '<|', '<\\|')"


def unescape_sql(x: str) -> str:
    return rf"replace(replace({x}, '<\\|', '<|'), '\\\\', '\\')"


def role_escape_sql(x: str) -> str:
    """As a text, and line ends become ``<\\n``: a lone backslash that no escaped text has there."""
    return rf"replace({escape_sql(x)}, '\n', '<\\n')"


def role_unescape_sql(x: str) -> str:
    return unescape_sql(rf"replace({x}, '<\\n', '\n')")


def format_conversations(df: DataFrame, budget: int = BUDGET, history: int = HISTORY, token: str = TOKEN) -> DataFrame:
    """Windows of ``conv_id, turn, role, text``: one row per window with ``conv_id, window_no, n_tokens, n_repeated, formatted, loss_spans``.

    Tokens of a text are the matches of the pattern ``token``; their prefix sums place the turns. ``loss_spans`` are code point ranges of ``formatted``; ``n_repeated`` counts its leading turns that earlier windows have. Rows are
    ordered by turn (nulls first; ties by role, then text) and all stay, repeated ones too. Null roles and texts are empty. A null
    conv_id is a conversation. A turn longer than half the room has a window of its own, over the budget if need be: turns
    are never cut. An empty table gives no windows; other columns are not read.
    """
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto, before = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    x = df.selectExpr("conv_id", "turn", "coalesce(CAST(role AS string), '') AS role", "coalesce(CAST(text AS string), '') AS text")
    x = x.withColumn("n", F.regexp_count("text", F.lit(token)).cast("long") + TURN_TOKENS)
    x = x.withColumn("i", F.row_number().over(by)).withColumn("p", F.coalesce(F.sum("n").over(before), F.lit(0)))
    head = F.when((F.col("i") == 1) & (F.col("role") == "system"), F.struct("role", "text", "n"))
    x = x.withColumn("sys", F.first(head).over(by))
    # Half the room: a span starts in one cell of that size and ends less than another half later, so that it fits.
    half = F.greatest(F.lit(budget) - history - F.coalesce(F.col("sys.n"), F.lit(0)), F.lit(budget // 4)) / 2
    x = x.withColumn("long", (F.col("n") > half).cast("int")).withColumn("cell", F.floor(F.col("p") / half))
    x = x.withColumn("longs", F.sum("long").over(upto))
    key = F.struct("longs", "long", "cell")
    x = x.withColumn("w", F.sum(F.when(F.lag(key).over(by) == key, 0).otherwise(1)).over(upto) - 1)
    span = Window.partitionBy("conv_id", "w")
    x = x.withColumn("rest", F.max(F.col("p") + F.col("n")).over(span) - F.col("p")).withColumn("first_of", (F.col("i") == F.min("i").over(span)))
    x = x.withColumn("last_w", F.max("w").over(Window.partitionBy("conv_id")))
    # A turn goes to its own window (2), to the next as history (1), and the system turn to each later window (0).
    own = "named_struct('w', w, 'kind', 2, 'i', i, 'role', role, 'text', text, 'n', n)"
    past = f"IF(rest <= {history} AND w < last_w AND NOT (i = 1 AND sys IS NOT NULL), named_struct('w', w + 1, 'kind', 1, 'i', i, 'role', role, 'text', text, 'n', n), NULL)"
    system = "IF(first_of AND w > 0 AND sys IS NOT NULL, named_struct('w', w, 'kind', 0, 'i', 1, 'role', sys.role, 'text', sys.text, 'n', sys.n), NULL)"
    x = x.selectExpr("conv_id", f"explode(array_compact(array({own}, {past}, {system}))) AS t").selectExpr("conv_id", "t.w AS window_no", "named_struct('kind', t.kind, 'i', t.i, 'role', t.role, 'text', t.text, 'n', t.n) AS t")
    x = x.groupBy("conv_id", "window_no").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    head_sql = f"concat('{START}', {role_escape_sql('t.role')}, '\\n')"
    body_sql = escape_sql("t.text")
    x = x.selectExpr("conv_id", "window_no", "ts", f"transform(ts, t -> named_struct('head', {head_sql}, 'body', {body_sql}, 'loss', t.kind = 2 AND t.role = 'assistant')) AS parts")
    tail = len(END) + 1
    add = "named_struct('pos', acc.pos + length(x.head) + length(x.body) + {tail}, 'spans', IF(x.loss, concat(acc.spans, array(named_struct('start', acc.pos + length(x.head), 'end', acc.pos + length(x.head) + length(x.body)))), acc.spans))".format(tail=tail)
    spans = f"aggregate(parts, named_struct('pos', 0, 'spans', CAST(array() AS array<struct<start:int,end:int>>)), (acc, x) -> {add}).spans"
    return x.selectExpr(
        "conv_id",
        "window_no",
        "aggregate(ts, 0L, (a, t) -> a + t.n) AS n_tokens",
        "size(filter(ts, t -> t.kind < 2)) AS n_repeated",
        f"array_join(transform(parts, x -> concat(x.head, x.body, '{END}\\n')), '') AS formatted",
        f"{spans} AS loss_spans",
    )


def read_back(windows: DataFrame) -> DataFrame:
    """From ``format_conversations``'s output alone, per conversation: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows``.

    Digests run over a whole conversation, so its windows meet in one row; everything before works on windows.
    """
    turns = f"slice(split(formatted, '<\\\\|im_start\\\\|>', -1), 2 + n_repeated, greatest(0, size(split(formatted, '<\\\\|im_start\\\\|>', -1)) - 1 - n_repeated))"
    cut = len(END) + 1
    role = role_unescape_sql("substring_index(t, '\\n', 1)")
    body = unescape_sql(f"substring(t, length(substring_index(t, '\\n', 1)) + 2, length(t) - length(substring_index(t, '\\n', 1)) - 1 - {cut})")
    x = windows.selectExpr(
        "conv_id",
        "window_no",
        f"{turns} AS turns",
        f"array_join(transform(loss_spans, s -> {unescape_sql('substring(formatted, s.start + 1, s.end - s.start)')}), '') AS loss",
        "length(formatted) AS chars",
    ).selectExpr("conv_id", "named_struct('w', window_no, 'n', size(turns), 'said', array_join(transform(turns, t -> concat(" + role + ", '\\n', " + body + ", '\\n')), ''), 'loss', loss, 'chars', chars) AS x")
    g = x.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return g.selectExpr(
        "conv_id",
        "aggregate(xs, 0L, (a, x) -> a + x.n) AS n_turns",
        "sha2(array_join(transform(xs, x -> x.said), ''), 256) AS turns_sha256",
        "CAST(length(array_join(transform(xs, x -> x.loss), '')) AS bigint) AS loss_chars",
        "sha2(array_join(transform(xs, x -> x.loss), ''), 256) AS loss_sha256",
        "aggregate(xs, 0L, (a, x) -> a + x.chars) AS formatted_chars",
        "CAST(size(xs) AS bigint) AS n_windows",
    )
