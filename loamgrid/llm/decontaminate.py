"""Benchmark decontamination: CGK embedding of words, bit-sampling LSH over item-sized windows, exact edit verification.

The CGK random walk copies a sequence symbol by symbol, standing still or stepping on as random bits of (step, symbol) say; two
sequences of small edit distance then differ in few places, whatever the shifts. WALKS walks start at every word of the items and of
the documents. A walk's key is what it reads at a few sampled places, all of them after a step on; equal keys of an item's word and a
document's word make the item-sized window that these two starts align a candidate, and nothing else does. A candidate must hold enough of
the item's words around it, and an alignment with free ends then finds the exact edit distance in words.

Recall: ``k`` edits of an ``n``-word item leave at most ``k + 1`` runs, one of them of ceil((n - k) / (k + 1)) words: two at least for items of 5 to 9
words, three from 10 words on. Inside such a run both walks do the same, and a walk's key lies in a run of as many words as it has places with
chance 1/4 (three places) or 1/2 (two). With 16 walks a single run is missed with chance 0.01 or less, the usual several runs with far
less; the tests measure it by size and kind of edit.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.common import map_texts, small_batches, worker_state

#: Edits per word of an item up to which a passage is a copy (so items of fewer than five words must be there as they are).
EDITS = 0.2
#: Walks, and words of an item from which a key has three places instead of two. Places follow each other within GAP steps.
WALKS, LONG, GAP = 16, 10, 2
#: Code points of items in one block; a larger item table is searched block by block, each against all documents.
BLOCK_CHARS = 2_000_000
WORD = re.compile(r"[^\W_]+")
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def slots(x: np.ndarray, bits: int) -> np.ndarray:
    """Where numbers fall in a table of ``2 ** bits`` places."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) * SPREAD
        return ((x ^ (x >> np.uint64(29))) * SPREAD >> np.uint64(64 - bits)).astype(np.int64)


class Walk:
    """Random bits by step and symbol, and the places where a key is read. ``straight``: all bits are 1, and every place is read."""

    def __init__(self, number: int, symbols: int, places: int, straight: bool = False):
        draw = np.random.default_rng([number, places])
        self.places = [0, *np.cumsum(np.ones(places - 1, int) if straight else draw.integers(1, GAP + 1, places - 1)).tolist()]
        self.bits = np.ones((self.places[-1] + 1, symbols + 2), np.int64) if straight else draw.integers(0, 2, (self.places[-1] + 1, symbols + 2))
        self.bits[:, symbols + 1] = 0  # past the end the walk stands
        self.symbols, self.straight = symbols, straight

    def keys(self, seq: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts that have a key, and their keys. Symbols from ``self.symbols`` on (unknown words, ends) are in no key."""
        at, last, code = starts, starts, seq[starts]
        for j in range(1, self.places[-1] + 1):
            at = at + self.bits[j - 1][seq[at]]
            if j in self.places:
                now = seq[at]
                ok = np.flatnonzero((at != last) & (now < self.symbols))
                starts, at = starts[ok], at[ok]
                last = at
                with np.errstate(over="ignore"):
                    code = code[ok] * (self.symbols + 1) + now[ok] + 1
        return starts, code


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """The least edit distance of ``item`` to any run of ``window``, and that run's start and end (the shortest, leftmost of the best)."""
    n = len(window)
    j = np.arange(n + 1)
    d, start = np.zeros(n + 1, np.int64), j.copy()
    scale = n + 2
    for i, w in enumerate(item, 1):
        # Distance and, as a tie-break, the latest start in one number, so that minima carry both.
        up = (d + 1) * scale + (n - start)
        diag = (d[:-1] + (window != w)) * scale + (n - start[:-1])
        best = np.concatenate([[i * scale + n], np.minimum(up[1:], diag)])
        best = np.minimum.accumulate(best - j * scale) + j * scale
        d, start = best // scale, n - best % scale
    end = int(np.argmin(d))
    return int(d[end]), int(start[end]), end


class Block:
    """Items of one block, indexed by the keys of their walks. Items without words match nothing."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.ids, self.words = [], []
        for item_id, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in WORD.findall((text or "").lower())]
            if words:
                self.ids.append(item_id)
                self.words.append(np.array(words, np.int64))
        self.edits = [int(EDITS * len(w)) for w in self.words]
        self.unknown = len(self.vocabulary)
        self.end = self.unknown + 1
        self.sizes, self.most = np.array([len(w) for w in self.words], np.int64), np.array(self.edits, np.int64)
        self.counts = [np.unique(w, return_counts=True) for w in self.words]
        self.walks = []
        for lo, hi, places, n in ((1, 1, 1, 1), (2, 2, 2, 1), (3, 3, 3, 1), (4, 4, 4, 1), (5, LONG - 1, 2, WALKS), (LONG, None, 3, WALKS)):
            own = [i for i, w in enumerate(self.words) if lo <= len(w) and (hi is None or len(w) <= hi)]
            if own:
                self.walks += [self._index(Walk(r, self.unknown, places, straight=lo < 5), own) for r in range(n)]
        pairs = np.concatenate([i * self.end + w for i, (w, _) in enumerate(self.counts)]) if self.words else np.zeros(0, np.int64)
        self.bits = int(np.clip(np.ceil(np.log2(16 * len(pairs) + 1)), 12, 26))
        self.has = np.zeros(1 << self.bits, bool)
        self.has[slots(pairs, self.bits)] = True

    def _index(self, walk: Walk, own: list[int]):
        seq = np.concatenate([np.append(self.words[i], [self.end] * len(walk.bits)) for i in own])
        lengths = [len(self.words[i]) + len(walk.bits) for i in own]
        item, first = np.repeat(own, lengths), np.repeat(np.cumsum([0, *lengths[:-1]]), lengths)
        starts, code = walk.keys(seq, np.flatnonzero(seq < self.unknown))
        if walk.straight:  # whole items
            whole = starts == first[starts]
            starts, code = starts[whole], code[whole]
        order = np.argsort(code, kind="stable")
        starts, code = starts[order], code[order]
        kinds, at = np.unique(code, return_index=True)
        bits = int(np.clip(np.ceil(np.log2(32 * len(kinds) + 1)), 12, 24))
        seen = np.zeros(1 << bits, bool)
        seen[slots(kinds, bits)] = True
        return walk, bits, seen, kinds, np.append(at, len(code)), item[starts].astype(np.int32), (starts - first[starts]).astype(np.int32)

    def candidates(self, seq: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Rows (document, item, start in ``seq``) of windows that share a key with an item, each once."""
        inside, out = np.flatnonzero(seq < self.unknown), []
        for walk, bits, seen, kinds, edges, item, offset in self.walks:
            starts, code = walk.keys(seq, inside)
            hit = seen[slots(code, bits)]
            starts, code = starts[hit], code[hit]
            at = np.minimum(np.searchsorted(kinds, code), len(kinds) - 1)
            hit = kinds[at] == code
            starts, at = starts[hit], at[hit]
            n = edges[at + 1] - edges[at]
            where = np.repeat(edges[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
            p = np.repeat(starts, n)
            out.append(np.unique(np.stack([doc[p], item[where], p - offset[where]]), axis=1) if len(p) else np.zeros((3, 0), np.int64))
        return np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((3, 0), np.int64)

    def likely(self, seq: np.ndarray, low: np.ndarray, high: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Those candidates that have as many of the item's words around them as ``k`` edits leave."""
        keep = np.zeros(found.shape[1], bool)
        for size in np.unique(self.sizes[found[1]]) if found.shape[1] else ():
            own = np.flatnonzero(self.sizes[found[1]] == size)
            k = int(EDITS * size)
            for part in np.array_split(own, -(-len(own) * int(size + 2 * k) // 2_000_000)):
                d, i, s = found[:, part]
                at = s[:, None] + np.arange(-k, size + k)
                there = (at >= low[d][:, None]) & (at < high[d][:, None])
                word = seq[np.where(there, at, 0)]
                there &= word < self.unknown
                keep[part] = (there & self.has[slots(i[:, None] * self.end + word, self.bits)]).sum(axis=1) >= size - k
        return found[:, keep]

    def matches(self, docs: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """(document, item, first word, end word, distance) of the best copy of each item in each document; unknown words are -1."""
        if not self.words or not docs:
            return []
        gap = 8
        lengths = np.array([len(d) for d in docs], np.int64)
        low = np.cumsum(lengths + gap) - lengths - gap
        seq = np.full(int((lengths + gap).sum()), self.end, np.int64)
        for d, lo in zip(docs, low.tolist(), strict=True):
            seq[lo : lo + len(d)] = np.where(d < 0, self.unknown, d)
        doc = np.repeat(np.arange(len(docs)), lengths + gap)
        found = self.likely(seq, low, low + lengths, self.candidates(seq, doc))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        rows = found.T.tolist()  # by document, item, start
        at = 0
        while at < len(rows):
            d, i, s = rows[at]
            k, n, upto = self.edits[i], len(self.words[i]), s
            while at < len(rows) and rows[at][:2] == [d, i] and rows[at][2] <= upto + 2 * k + 1:
                upto = rows[at][2]
                at += 1
            lo = int(low[d])
            a, b = max(0, s - lo - 2 * k), min(len(docs[d]), upto - lo + n + 2 * k)
            near = docs[d][a:b]
            own, times = self.counts[i]
            kinds, there = np.unique(near, return_counts=True)
            pos = np.minimum(np.searchsorted(kinds, own), len(kinds) - 1)
            if np.minimum(np.where(kinds[pos] == own, there[pos], 0), times).sum() < n - k:  # words in common, repeats included
                continue
            dist, x, y = align(self.words[i], near)
            if dist <= k and ((d, i) not in best or (dist, a + x) < (best[d, i][2], best[d, i][0])):
                best[d, i] = a + x, a + y, dist
        return [(d, i, *x) for (d, i), x in sorted(best.items())]

    def symbols(self, text: str) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in WORD.findall(text.lower())], np.int64)


def blocks_of(items: DataFrame, id_col: str, text_col: str) -> list[list[tuple]]:
    """Item rows in blocks of at most about BLOCK_CHARS code points, by a hash of the id; null texts are left out."""
    rows = items.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL")
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-2 * total // BLOCK_CHARS) if total > BLOCK_CHARS else 1)
    for b in range(n):
        got = [(r.i, r.t) for r in rows.where(F.pmod(F.xxhash64("i", F.lit(5)), F.lit(n)) == b).orderBy("i", "t").collect()]
        if got:
            yield got


def find_copies(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Copies of items in documents: ``id_col, item_id, start, end, edits, item_words``, the best one of each item per input row.

    ``start`` and ``end`` are code points of the text; distances count words (runs of letters and digits, in lower case). Null and empty
    texts and items match nothing; items of under five words match as they are; of equal copies the leftmost is given; repeated rows
    each have their matches; no items or no documents give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    kind, item_kind = dict(docs.dtypes)[id_col], dict(items.dtypes)[item_id]
    ddl = f"`{id_col}` {kind}, `{item_id}` {item_kind}, start bigint, end bigint, edits int, item_words int"
    out = None
    for part in blocks_of(items, item_id, item_text):
        shared = spark.sparkContext.broadcast(part)

        def make(shared=shared):
            block = Block(shared.value)

            def run(keys, texts):
                docs_ = [block.symbols(t) for t in texts]
                rows = []
                spans: dict[int, list] = {}
                for d, i, a, b, dist in block.matches(docs_):
                    if d not in spans:
                        low = texts[d].lower()
                        low = low if len(low) == len(texts[d]) else "".join(c.lower()[0] for c in texts[d])
                        spans = {d: [m.span() for m in WORD.finditer(low)]}
                    at = spans[d]
                    start, end = (at[a][0], at[b - 1][1]) if 0 <= a < b <= len(at) else (0, len(texts[d]))
                    rows.append((keys[d][0], block.ids[i], start, end, dist, len(block.words[i])))
                return rows

            return run

        found = map_texts(docs, [F.col(id_col)], F.col(text_col), make, ddl)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], ddl)


def keep_uncontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a copy of an item; every row is judged by its own text, whatever its id. Null texts stay, as does every column.

    One filter looks at all blocks of items: each worker indexes every block once and keeps it. Rows that one block has caught are not shown to the next.
    """
    small_batches(docs.sparkSession)
    shared, name = [docs.sparkSession.sparkContext.broadcast(part) for part in blocks_of(items, "item_id", "text")], uuid.uuid4().hex
    if not shared:
        return docs

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        left = np.arange(len(texts))
        for block in worker_state(("items", name), lambda: [Block(part.value) for part in shared]):
            bad = {d for d, *_ in block.matches([block.symbols(texts.iloc[i] or "") for i in left])}
            left = np.delete(left, sorted(bad))
        return pd.Series(np.isin(np.arange(len(texts)), left))

    return docs.where(clean(F.col("text").cast("string")))
