"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels.

A document is toxic if any of its sentences is: P = 1 - prod(1 - p_s), where p_s is logistic in the set of the sentence's words. The
likelihood of the document labels is maximised directly, so that the sentence scores, which nobody labelled, show where it is. A word
stands for itself and for its beginnings and ending, so that inflected or compound forms that training never saw still count.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.common import _arrow_schema, map_texts, small_batches, worker_state

#: The bounded sample that the model is fitted on: labelled rows in the order of a hash of their id. Documented parameter.
TRAIN_ROWS = 8_000
#: A word needs this many training documents; weights nearer to 0 than LEAST_WEIGHT are left out.
MIN_DOCS, LEAST_WEIGHT = 5, 0.02
EPOCHS, RATE, DECAY, BIAS = 80, 0.25, 2e-4, -5.0
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"[^\W\d_]+")
#: Word scores that a worker keeps.
CACHE = 250_000


def features(word: str) -> list[str]:
    """The word, its first 4, 5 and 6 letters, and its last 4, marked apart."""
    n = len(word)
    return [word, *(word[:k] + "-" for k in (4, 5, 6) if n >= k), *(["-" + word[-4:]] if n >= 4 else [])]


class Model(NamedTuple):
    bias: float
    weights: dict[str, float]


class Sentence(NamedTuple):
    start: int
    end: int
    p: float


def fit(texts: list[str], labels: list[int]) -> Model:
    """Full-batch Adam on the noisy-or likelihood; a sentence is a set of words, a word the sum of its features."""
    ids: dict[str, int] = {}
    words, sentences, docs_of, seen_in = [], [], [], []
    s = 0
    for d, t in enumerate(texts):
        doc_words = set()
        for m in SENTENCE.finditer(t.lower()):
            own = {ids.setdefault(w, len(ids)) for w in WORD.findall(m.group())}
            words.extend(own)
            sentences.extend([s] * len(own))
            doc_words |= own
            docs_of.append(d)
            s += 1
        seen_in.extend(doc_words)
    if not ids:
        return Model(BIAS, {})
    names: dict[str, int] = {}
    part, whole_word = [], []
    for w, i in ids.items():
        own = [names.setdefault(f, len(names)) for f in features(w)]
        part += own
        whole_word += [i] * len(own)
    part, whole_word = np.array(part, np.int64), np.array(whole_word, np.int64)
    df = np.bincount(part, np.bincount(np.array(seen_in, np.int64), minlength=len(ids))[whole_word], minlength=len(names))
    used = df >= MIN_DOCS
    keep = used[part]
    part, whole_word = part[keep], whole_word[keep]
    w_of, s_of = np.array(words, np.int64), np.array(sentences, np.int64)
    doc, y, n = np.array(docs_of, np.int64), np.array(labels, float), len(names)
    theta = np.zeros(n + 1)
    theta[-1] = BIAS
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, EPOCHS + 1):
        of_word = np.bincount(whole_word, theta[part], minlength=len(ids))
        z = np.bincount(s_of, of_word[w_of], minlength=s) + theta[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        left = np.bincount(doc, np.logaddexp(0, z), minlength=len(texts))  # -log of the chance that no sentence is toxic
        pull = np.where(y > 0, np.exp(-left) / np.maximum(-np.expm1(-left), 1e-9), -1.0)
        g_s = p * np.clip(pull, -1, 1e4)[doc]
        g_w = np.bincount(w_of, g_s[s_of], minlength=len(ids))
        grad = np.append(np.bincount(part, g_w[whole_word], minlength=n), g_s.sum()) / len(texts)
        grad[:-1] -= DECAY * theta[:-1] / 10
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        theta += RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-7)
    return Model(float(theta[-1]), {f: float(theta[i]) for f, i in names.items() if used[i] and abs(theta[i]) >= LEAST_WEIGHT})


def locate(text: str | None, model: Model, known: dict[str, float] | None = None) -> list[Sentence]:
    """Every sentence with its chance of being toxic, as code point ranges of the text. ``known``: a cache of word scores."""
    if not text:
        return []
    get, out = model.weights.get, []
    known = {} if known is None else known
    if len(known) > CACHE:
        known.clear()
    low = text.lower()
    if len(low) != len(text):  # a few characters change their length in lower case
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for m in SENTENCE.finditer(low):
        z = model.bias
        for w in set(WORD.findall(m.group())):
            v = known.get(w)
            if v is None:
                v = known[w] = sum([get(f, 0.0) for f in features(w)])
            z += v
        out.append(Sentence(m.start(), m.end(), 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))))
    return out


def noisy_or(sentences: list[Sentence]) -> float:
    return -math.expm1(sum(math.log1p(-min(s.p, 1 - 1e-12)) for s in sentences)) if sentences else 0.0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents with crc32(id as text) mod 5 other than 0, in one task of one executor.

    Of repeated labels the highest counts; rows without a label or text are left out. Without labels: a model that scores low everywhere.
    """
    ok = labels.where(f"toxic IS NOT NULL AND crc32(CAST({id_col} AS string)) % 5 <> 0").groupBy(id_col).agg(F.max("toxic").cast("int").alias("__y"))
    chosen = ok.orderBy(F.xxhash64(F.col(id_col), F.lit(11)), id_col).limit(rows)
    sample = docs.select(F.col(id_col), F.col(text_col).alias("__t")).where("__t IS NOT NULL").join(F.broadcast(chosen), id_col).select(F.col(id_col).alias("k"), "__t", "__y")
    ddl = "word string, weight double"
    out = _arrow_schema(docs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for b in batches:
            seen += zip(*(c.to_pylist() for c in b.columns), strict=True)
        seen.sort(key=lambda r: (str(r[0]), r[1]))
        model = fit([t for _, t, _ in seen], [y for _, _, y in seen])
        got = [(None, model.bias), *model.weights.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*got, strict=True), out, strict=True)], schema=out)

    got = sample.repartition(1).mapInArrow(run, ddl).collect()
    return Model(next((r.weight for r in got if r.word is None), BIAS), {r.word: r.weight for r in got if r.word is not None})


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: ``score`` (noisy-or of the sentence scores), ``predicted`` (score of at least 0.5), ``n_offending`` and ``offending``
    (``start:end:p`` of sentences with p of at least 0.5, comma-joined). Null and empty texts score 0; repeated rows stay.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.bias, model.weights))
    kind = dict(docs.dtypes)[id_col]

    def make():
        own, known = Model(*shared.value), {}

        def run(keys, texts):
            rows = []
            for (k,), t in zip(keys, texts, strict=True):
                found = locate(t, own, known)
                score = noisy_or(found)
                bad = [s for s in found if s.p >= 0.5]
                rows.append((k, score, int(score >= 0.5), len(bad), ",".join(f"{s.start}:{s.end}:{s.p:.3f}" for s in bad)))
            return rows

        return run

    return map_texts(docs, [F.col(id_col)], F.col(text_col), make, f"`{id_col}` {kind}, score double, predicted int, n_offending int, offending string")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic by a model trained on their own labels; every column and repeated row stays."""
    model, name = train(docs, labels), uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        own, known = worker_state(("toxicity", name), lambda: (Model(*shared.value), {}))
        return texts.map(lambda t: noisy_or(locate(t, own, known)))

    small_batches(docs.sparkSession)
    return docs.where(score(F.col("text")) < 0.5)
