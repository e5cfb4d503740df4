"""English stems by Porter's algorithm (1980), and terms of text for a stemmed index."""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from loamgrid.functions import batches

# The suffixes of steps 2 to 4 and what replaces them.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
STEP4_LONGEST_FIRST = sorted(STEP4, key=len, reverse=True)
#: Lengths of words that have a stem of their own.
SHORTEST, LONGEST = 3, 64
WORD = re.compile(r"[^\W_]+")


def _shape(stem: str) -> str:
    """v for vowels, c for consonants; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(stem):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _shape(stem).count("vc")


def _short_end(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _replaced(word: str, rules: dict[str, str], least: int) -> str:
    """The longest suffix decides, whether its stem is long enough or not."""
    for n in range(min(7, len(word)), 1, -1):
        if word[-n:] in rules:
            stem = word[:-n]
            return stem + rules[word[-n:]] if _measure(stem) >= least else word
    return word


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """The stem of a word in lower case."""
    if not SHORTEST <= len(word.encode()) <= LONGEST:
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        end = next((e for e in ("ed", "ing") if w.endswith(e) and "v" in _shape(w[: -len(e)])), None)
        if end:
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(w, STEP2, 1)
    w = _replaced(w, STEP3, 1)
    for end in STEP4_LONGEST_FIRST:
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short_end(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def plain_letters(text: str) -> str:
    """Lower case without diacritics."""
    low = text.lower()
    return low if low.isascii() else "".join(c for c in unicodedata.normalize("NFD", low) if c.isascii() or unicodedata.category(c) != "Mn")


def stems(text: str) -> list[str]:
    return [porter(w) for w in WORD.findall(plain_letters(text))]


@F.pandas_udf(ArrayType(StringType()))
def stemmed(texts: pd.Series) -> pd.Series:
    """Stems of the words of a text in order; null has none."""
    return pd.Series([stems(t) if t else [] for t in texts])


def stem_rows(df: DataFrame, text_col: str) -> DataFrame:
    """The other columns of ``df`` with ``term, places``: a row for each stem of a text, with its places in words from 0. A null text has none. Rows of a batch are sorted by stem.

    Rows leave in Arrow batches of the stems of few texts (``batches.CHUNK_CHARS``), so that a worker's memory doesn't follow the length of texts or of the input.
    """
    rest = [c for c in df.columns if c != text_col]
    schema = StructType([*df.select(*rest).schema.fields, StructField("term", StringType()), StructField("places", ArrayType(IntegerType()))])
    out = to_arrow_schema(schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches.slices(parts, len(rest)):
            met: dict[str, list[tuple[int, array]]] = {}
            for i, text in enumerate(part.column(len(rest))):
                found: dict[str, array] = {}
                for at, s in enumerate(stems(text.as_py() or "")):
                    found.setdefault(s, array("i")).append(at)
                for s, p in found.items():
                    met.setdefault(s, []).append((i, p))
            rows, terms, places, ends = [], [], array("i"), array("i", [0])
            for s in sorted(met):
                for i, p in met[s]:
                    rows.append(i)
                    terms.append(s)
                    places.extend(p)
                    ends.append(len(places))
            if rows:
                lists = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(places, np.int32)))
                own = [c.take(pa.array(rows, pa.int32())) for c in part.columns[:-1]]  # not the text, once for each stem
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*own, pa.array(terms, pa.string()), lists], out, strict=True)], schema=out)

    batches.hold(df.sparkSession)
    return df.select(*rest, F.col(text_col)).mapInArrow(run, schema)
