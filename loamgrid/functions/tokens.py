"""Tokens of text with their places, by a tokenizer file: one interface for lengths, windows and spans in any tokenizer's tokens.

A file is read once a worker process. Offsets are code points of the text, end exclusive; the pieces of a text between the starts of its tokens make up the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from loamgrid.functions import batches

#: What ends a sentence or a paragraph (fixed value).
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n\n+")
TOKENS = ArrayType(StructType().add("id", IntegerType()).add("start", IntegerType()).add("stop", IntegerType()))


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer of a file, without truncation or padding."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def tokens(text: Column, path: str) -> Column:
    """``array<struct<id, start, stop>>`` of a text's tokens; null for null. ``path`` must be there on every executor. Special tokens are not added."""

    @F.pandas_udf(TOKENS)
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            e = None if t is None else tokenizer(path).encode(t, add_special_tokens=False)
            out.append(None if e is None else [{"id": i, "start": a, "stop": b} for i, (a, b) in zip(e.ids, e.offsets, strict=True)])
        return pd.Series(out)

    return run(text.cast("string"))


def decoded(ids: Column, path: str) -> Column:
    """The text of token ids, special ones included."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else tokenizer(path).decode([int(i) for i in r], skip_special_tokens=False) for r in rows], dtype=object)

    return run(ids)


def token_texts(text: str, toks: str) -> str:
    """SQL: the text cut at the starts of its tokens: the first piece begins at 0, the last ends with the text, so that the pieces joined are the text."""
    start = f"IF(i = 0, 0, {toks}[i].start)"
    return f"transform({toks}, (x, i) -> substring({text}, {start} + 1, coalesce(get({toks}, i + 1).start, length({text})) - {start}))"


def _sizes(text: str, stops: list[int]) -> list[int]:
    ends = np.array([*(m.end() for m in SENTENCE_END.finditer(text)), len(text)])
    of = np.searchsorted(np.unique(ends), stops)
    return np.bincount(of, minlength=1).tolist() if len(of) else []


@F.pandas_udf(ArrayType(IntegerType()))
def sentence_sizes(texts: pd.Series, toks: pd.Series) -> pd.Series:
    """How many tokens end within each sentence or paragraph of a text, the blanks after it included; what ends after the last is the last one's. Null for null."""
    out = []
    for t, own in zip(texts, toks, strict=True):
        if t is None or own is None:
            out.append(None)
            continue
        out.append(_sizes(t, [x["stop"] for x in own]))
    return pd.Series(out)


def sentence_token_sizes(df: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """``id_col, sizes``: ``sentence_sizes`` of texts by the tokenizer of ``path``. Tokens stay in the worker that made them, those of few texts at a time."""
    schema = StructType([df.select(id_col).schema.fields[0], StructField("sizes", ArrayType(IntegerType()))])
    out = to_arrow_schema(schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches.slices(parts, 1):
            sizes = []
            for text in part.column(1).to_pylist():
                stops = None if text is None else [b for _, b in tokenizer(path).encode(text, add_special_tokens=False).offsets]
                sizes.append(None if text is None else _sizes(text, stops))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(out.field(0).type), pa.array(sizes, out.field(1).type)], schema=out)

    batches.hold(df.sparkSession)
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def token_windows(df: DataFrame, id_col: str, toks: str, width: int = 384, step: int = 288) -> DataFrame:
    """``id_col, start, stop`` in tokens: windows of ``width``, a new one every ``step``, the last ends with the text; texts without tokens have none."""
    n = F.size(F.coalesce(F.col(toks), F.array()))
    starts = F.expr(f"sequence(0, greatest(0, (n - {width - step} - 1) DIV {step}) * {step}, {step})")
    x = df.select(id_col, n.alias("n")).where("n > 0").select(id_col, "n", F.explode(starts).alias("start"))
    return x.select(id_col, "start", F.least(F.col("start") + width, F.col("n")).alias("stop"))
