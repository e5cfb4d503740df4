"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece exactly one token can end its BPE encoding. An automaton over the vocabulary lists the tokens that are
suffixes of each prefix; the one whose pair with the last token of the remaining prefix survives the merges is stored, and following
the stored tokens back from the end emits the same ids that applying the merges would.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.common import map_texts, worker_state

#: White space as the tokenizer's pattern sees it (Unicode White_Space).
WS = "\t-\r \x85\xa0  -     　"
#: The public pattern of byte-level BPE; L, N need the regex module.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+"
#: Runs that the pattern never crosses: what it finds in a text is what it finds in each of these in turn.
SEGMENTS = re.compile(rf" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
#: Bytes that a worker's caches of segments and of token pairs may hold, about what an entry takes besides its text, and the longest segment cached.
SEGMENT_BYTES, PAIR_BYTES, ENTRY_BYTES, PAIR_ENTRY, CACHED_CHARS = 110_000_000, 32_000_000, 200, 120, 64
#: A pair of tokens is one integer: the left one above this many bits, the right one below. More than any vocabulary needs.
PAIR_BITS = 24


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where visible, else from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(visible) else chr(next(spare)) for b in range(256)]


class Cache:
    """A dictionary of bounded bytes: when half of them are taken, what was not asked for since the last time goes."""

    def __init__(self, most: int):
        self.new, self.old, self.room, self.most = {}, {}, most // 2, most // 2

    def get(self, key, size: int):
        got = self.new.get(key)
        if got is None:
            got = self.old.get(key)
            if got is not None:
                self.put(key, got, size)
        return got

    def put(self, key, value, size: int) -> None:
        self.room -= size
        if self.room < 0:
            self.old, self.new, self.room = self.new, {}, self.most - size
        self.new[key] = value


class Codec:
    """Encoder and decoder for one byte-level BPE file of the tokenizers library (``add_special_tokens=False``).

    Inside, a token is the number of when it comes to be (its rank): single bytes first, then the merges in order.
    """

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.find = regex.compile(PATTERN).findall
        alphabet = byte_alphabet()
        self.letters = dict(enumerate(alphabet))
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        rank = {c: i for i, c in enumerate(alphabet)}
        # The two tokens that each token was merged from (none: -1), and the rank of each merge.
        self.left, self.right = [-1] * (256 + len(merges)), [-1] * (256 + len(merges))
        self.merged: dict[int, int] = {}
        for i, (a, b) in enumerate(merges, 256):
            self.merged[rank[a] << PAIR_BITS | rank[b]] = i
            if rank.setdefault(a + b, i) == i:
                self.left[i], self.right[i] = rank[a], rank[b]
        self.automaton = ahocorasick.Automaton()
        self.id_bytes, self.size = [b""] * (256 + len(merges)), [0] * (256 + len(merges))
        for token, i in rank.items():
            self.automaton.add_word(token, (len(token), i))
            self.id_bytes[i], self.size[i] = vocab[token].to_bytes(4, "little"), len(token)
        self.automaton.make_automaton()
        self.fits, self.segments = Cache(PAIR_BYTES), Cache(SEGMENT_BYTES)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        back = {c: b for b, c in enumerate(alphabet)}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` side by side: undo merges from the latest, looking for one across the seam that came earlier."""
        key = left << PAIR_BITS | right
        known = self.fits.get(key, PAIR_ENTRY)
        if known is not None:
            return known
        before, good = 1 << 60, True
        while True:
            across = self.merged.get(left << PAIR_BITS | right)
            if across is not None and across < before:
                good = False
                break
            # Of two merges the later one is undone first; at equal rank the left one was made first.
            if left < 256 and right < 256:
                break
            if left > right:
                before, left = left, self.right[left]
            else:
                before, right = right + 1, self.left[right]
        self.fits.put(key, good, PAIR_ENTRY)
        return good

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one piece of the pattern as little-endian 32-bit integers."""
        s = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        last = [0] * (len(s) + 1)
        fits, at = self.fits, 0  # ``at``: the end of the prefix whose last token is known
        for end, (size, token) in self.automaton.iter(s):
            if end >= at:
                start = end + 1 - size
                if start:
                    good = fits.new.get(last[start] << PAIR_BITS | token)
                    if good is False or good is None and not self.compatible(last[start], token):
                        continue
                at = end + 1
                last[at] = token
        ids, at = [], len(s)
        while at:
            ids.append(self.id_bytes[last[at]])
            at -= self.size[last[at]]
        ids.reverse()
        return b"".join(ids)

    def encode_segment(self, segment: str) -> bytes:
        # Plain letters are one piece of the pattern.
        if segment.isascii() and segment.removeprefix(" ").isalpha():
            return self.encode_piece(segment)
        return b"".join([self.encode_piece(piece) for piece in self.find(segment)])

    def _plain(self, text: str) -> bytes:
        known, out = self.segments, []
        for seg in SEGMENTS.findall(text):
            got = known.new.get(seg) or known.get(seg, ENTRY_BYTES + len(seg))
            if got is None:
                got = self.encode_segment(seg)
                if len(seg) <= CACHED_CHARS:
                    known.put(seg, got, ENTRY_BYTES + len(seg))
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers; strings of added tokens in it are those tokens."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(np.array([self.special[x]], dtype="<u4").tobytes() if i % 2 else self._plain(x) for i, x in enumerate(self.split_special(text)))

    def decode(self, ids: bytes) -> str:
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


def codec_of(path: str) -> Codec:
    """One codec per worker process: a worker that runs further tasks keeps what it knows."""
    return worker_state(("bpe", path), lambda: Codec(path))


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and ``decoded``.

    Nulls and empty texts give no ids and ''; repeated rows stay; an empty table gives an empty table; other columns are not read.
    A text of any length is encoded whole: memory is a few times the text.
    """
    kind = dict(df.dtypes)[id_col]

    def make():
        codec = codec_of(path)

        def run(keys, texts):
            rows = []
            for (k,), t in zip(keys, texts, strict=True):
                ids = codec.encode(t)
                rows.append((k, len(ids) // 4, ids, codec.decode(ids)))
            return rows

        return run

    return map_texts(df, [F.col(id_col)], F.col(text_col), make, f"`{id_col}` {kind}, n_tokens bigint, ids binary, decoded string", keeps=True)


def digest_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode_documents`` with digests of ids and decoded text in place of the payloads."""
    kind = dict(df.dtypes)[id_col]

    def make():
        codec = codec_of(path)

        def run(keys, texts):
            rows = []
            for (k,), t in zip(keys, texts, strict=True):
                ids = codec.encode(t)
                rows.append((k, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()))
            return rows

        return run

    return map_texts(df, [F.col(id_col)], F.col(text_col), make, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", keeps=True)
