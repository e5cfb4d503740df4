"""One query text for two engines: ``@name(args)`` macros expand to Spark or to DuckDB syntax."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

LNFACT = "(({0} + 7.5e0) * ln({0} + 8.0e0) - ({0} + 8.0e0) + 0.9189385332046727e0 + 1.0e0 / (12.0e0 * ({0} + 8.0e0)) - 1.0e0 / (360.0e0 * power({0} + 8.0e0, 3)) + 1.0e0 / (1260.0e0 * power({0} + 8.0e0, 5)) - ln(({0} + 1.0e0) * ({0} + 2.0e0) * ({0} + 3.0e0) * ({0} + 4.0e0) * ({0} + 5.0e0) * ({0} + 6.0e0) * ({0} + 7.0e0)))"

#: name -> (Spark, DuckDB); {0}, {1}, ... are the arguments.
MACROS = {
    "words": ("regexp_extract_all(lower({0}), '([a-z0-9]+)')", "regexp_extract_all(lower({0}), '[a-z0-9]+')"),
    "grams": ("IF(size({0}) < {1}, CAST(array() AS array<string>), transform(sequence(1, size({0}) - {1} + 1), i -> array_join(slice({0}, i, {1}), ' ')))", "list_transform(range(1, len({0}) - {1} + 2), lambda i: array_to_string({0}[i:i + {1} - 1], ' '))"),
    "sha": ("sha2({0}, 256)", "sha256({0})"),
    "hash32": ("CAST(conv(substr(sha2({0}, 256), 1, 8), 16, 10) AS BIGINT)", "CAST(('0x' || substr(sha256({0}), 1, 8)) AS BIGINT)"),
    "explode": ("explode({0})", "unnest({0})"),
    "size": ("CAST(size({0}) AS BIGINT)", "CAST(len({0}) AS BIGINT)"),
    "join": ("array_join({0}, ' ')", "array_to_string({0}, ' ')"),
    "lines": ("split({0}, '\\n')", "string_split({0}, chr(10))"),
    "rlike": ("{0} RLIKE {1}", "regexp_matches({0}, {1})"),
    "sub": ("regexp_replace({0}, {1}, {2})", "regexp_replace({0}, {1}, {2}, 'g')"),
    "find": ("regexp_extract({0}, {1}, {2})", "regexp_extract({0}, {1}, {2})"),
    "b": ("CAST({0} AS BIGINT)", "CAST({0} AS BIGINT)"),
    "fl": ("CAST(floor({0}) AS BIGINT)", "CAST(floor({0}) AS BIGINT)"),
    "pct": ("percentile({0}, {1})", "quantile_cont({0}, {1})"),
    "secs": ("(unix_micros(CAST({0} AS TIMESTAMP)) / 1000000.0D)", "(epoch_us({0}) / 1000000.0)"),
    "json": ("get_json_object({0}, '$.{1}')", "json_extract_string({0}, '$.{1}')"),
    "dot": ("aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS double) * CAST(y AS double)), 0D, (a, x) -> a + x)", "list_sum(list_transform(range(1, len({0}) + 1), lambda i: CAST({0}[i] AS double) * CAST({1}[i] AS double)))"),
    "range": ("IF({1} <= {0}, CAST(array() AS array<bigint>), sequence(CAST({0} AS BIGINT), CAST({1} AS BIGINT) - 1, CAST({2} AS BIGINT)))", "range(CAST({0} AS BIGINT), CAST({1} AS BIGINT), CAST({2} AS BIGINT))"),
    "pad": ("lpad(CAST({0} AS STRING), 12, '0')", "lpad(CAST({0} AS VARCHAR), 12, '0')"),
    "arr": ("array({*})", "list_value({*})"),
    "row": ("struct({*})", "row({*})"),
    "at": ("{0}", "{0} + 1"),
    "even": ("bround({0}, 0)", "round_even({0}, 0)"),
    "pos": ("CAST(instr({0}, {1}) AS BIGINT)", "CAST(strpos({0}, {1}) AS BIGINT)"),
    "tail": ("element_at(split({0}, {1}), -1)", "list_extract(string_split({0}, {1}), -1)"),
    "dbl": ("CAST({0} AS DOUBLE)", "CAST({0} AS DOUBLE)"),
    # Logarithm of a factorial: Stirling's series seven places further on.
    "lnfact": (LNFACT, LNFACT),
    "small": ("/*+ BROADCAST({0}) */", ""),
}


def expand(text: str, engine: int) -> str:
    """Replace macros, innermost last; commas inside brackets or quotes do not part arguments."""
    while m := re.search(r"@(\w+)\(", text):
        depth, i, args, cur, quote = 1, m.end(), [], "", False
        while depth:
            c = text[i]
            if c == "'":
                quote = not quote
            if not quote:
                depth += c in "([" and 1 or c in ")]" and -1 or 0
                if not depth:
                    break
                if c == "," and depth == 1:
                    args.append(cur.strip())
                    cur, i = "", i + 1
                    continue
            cur += c
            i += 1
        args.append(cur.strip())
        form = MACROS[m.group(1)][engine]
        for n, a in enumerate(args):
            form = form.replace("{%d}" % n, a)
        form = form.replace("{*}", ", ".join(args))
        text = text[: m.start()] + form + text[i + 1 :]
    return text


def run_sql(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    """Run a template over the Parquet tables of ``sf_dir`` that it names; integers come out as bigint."""
    text, views = expand(template, 0), []
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            view = f"v_{uuid.uuid4().hex}"
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(view)
            views.append(view)
            text = re.sub(rf"(?<=FROM )\b{t}\b|(?<=JOIN )\b{t}\b", f"{view} AS {t}", text)
            text = re.sub(rf"\b{view} AS {t} (?!JOIN|LEFT|WHERE|GROUP|ORDER|ON|USING|CROSS|UNION|QUALIFY|FULL|INNER)([a-z]\w*)\b", rf"{view} AS \1", text)
    out = spark.sql(text)
    for view in views:  # the plan has resolved them
        spark.catalog.dropTempView(view)
    return out.select(*[F.col(f"`{c}`").cast("bigint").alias(c) if k in ("int", "smallint", "tinyint") else F.col(f"`{c}`").cast("double").alias(c) if k == "float" or k.startswith("decimal") else F.col(f"`{c}`") for c, k in out.dtypes])
