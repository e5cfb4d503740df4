"""Token-id shards with keyed access: a minimal perfect hash maps document keys to shard offsets, fingerprints catch foreign keys.

Keyed access takes constant time, whatever the number of documents: a hash of the key names its part of the index (tables at ``path`` + INDEX), the part's minimal perfect
hash the key's slot, and the slot holds the key's fingerprint, its shard (bucket and number) and its entry there. Parts and shards are row
groups of one row, files are listed by part and by bucket: a read of a few keys opens the files that hold them and, of these, reads the
row groups that their numbers name.

File format, one blob per shard (little-endian): header ``SHARD`` (magic, version, id width in bytes, keys, distinct keys, buckets, ids);
``key int64[n]`` and ``offset uint64[n + 1]`` in document order; ``seed uint32[buckets]``; per slot ``fingerprint uint32`` and
``entry uint32``; then the raw ids (2 bytes each where the vocabulary fits, else 4). A key hashes to a bucket, the bucket's seed to a slot
of its own, and the slot holds the entry: constant time, no probing. Blobs are rows of a Parquet table, so that Spark's commit
protocol publishes whole shards only and any store that Spark writes will do.
"""

from __future__ import annotations

import contextlib
import gc
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgrid.llm.common import _arrow_schema, bucket_of, range_splits, shared_dir, small_batches, worker_state

HEADER = struct.Struct("<8sHHIIIQ")
MAGIC = b"LGIDS\0\0\1"
#: Bytes of ids after which a shard ends; a longer document has a shard of its own.
SHARD_BYTES = 1 << 20
CACHE, CACHED_CHARS = 1_000_000, 40
NO_KEY = -(1 << 63)
SHARD_DDL = "bucket int, seq int, first_key bigint, last_key bigint, n_docs bigint, n_ids bigint, keys array<bigint>, blob binary"
#: Where the index of a table of shards is, and about how many keys one part of it holds.
INDEX, PART_KEYS = "-index", 100_000
#: Tables beside the index that name the file of each bucket of shards and of each part of the index.
SHARD_FILES, PART_FILES = "-shard-files", "-part-files"
#: Parts, and shards, up to which a lookup names those it wants to the scan; more are found by joins.
FEW = 256
#: One row is a row group of its own, so that the statistics of row groups lead to it.
ROW_GROUPS = {"parquet.block.row.count.limit": "1", "compression": "zstd"}
SLOT = np.dtype([("fp", "<u4"), ("bucket", "<i4"), ("seq", "<i4"), ("entry", "<u4")])
U64 = (1 << 64) - 1


def mix(x: np.ndarray | int, seed: np.ndarray | int) -> np.ndarray:
    """A 64-bit mixer (multiply and shift rounds) of integer keys under a seed, or under each of several seeds in columns."""
    with np.errstate(over="ignore"):
        z = np.asarray(x, dtype=np.int64).view(np.uint64) + (np.asarray(seed, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds per bucket and the slot of each of the distinct ``keys``: a bijection onto ``range(len(keys))``. Large buckets choose first."""
    n = len(keys)
    buckets = max(1, n // 3)
    of = mix(keys, 0) % np.uint64(buckets)
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(buckets + 1, dtype=np.uint64)).tolist()
    seeds, slots, taken = np.zeros(buckets, "<u4"), np.zeros(n, "<u4"), np.zeros(n, bool)
    for b in sorted(range(buckets), key=lambda b: edges[b] - edges[b + 1]):
        own = order[edges[b] : edges[b + 1]]
        if not len(own):
            break
        first = 1
        while True:
            tried = np.arange(first, first + 64)
            at = mix(keys[own][None, :], tried[:, None]) % np.uint64(n)
            good = ~taken[at].any(axis=1)
            if len(own) > 1:
                ranked = np.sort(at, axis=1)
                good &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            if good.any():
                pick = int(np.argmax(good))
                break
            first += 64
        taken[at[pick]], slots[own], seeds[b] = True, at[pick], first + pick
    return seeds, slots


def pack(keys: list[int], docs: list[bytes], width: int) -> bytes:
    """A shard's blob. ``docs`` are ids as little-endian unsigned 32-bit integers; of repeated keys the first is found by key."""
    key = np.array(keys, dtype="<i8")
    sizes = np.array([len(d) // 4 for d in docs], dtype="<u8")
    offset = np.concatenate([np.zeros(1, "<u8"), np.cumsum(sizes, dtype="<u8")]).astype("<u8")
    distinct, first = np.unique(key, return_index=True)
    seeds, slots = perfect_hash(distinct)
    table = np.zeros(len(distinct), dtype=[("fp", "<u4"), ("entry", "<u4")])
    table["fp"][slots] = (mix(distinct, 1 << 20) >> np.uint64(32)).astype("<u4")
    table["entry"][slots] = first
    ids = np.frombuffer(b"".join(docs), dtype="<u4").astype("<u2" if width == 2 else "<u4")
    return HEADER.pack(MAGIC, 1, width, len(key), len(distinct), len(seeds), len(ids)) + key.tobytes() + offset.tobytes() + seeds.tobytes() + table.tobytes() + ids.tobytes()


class Shard:
    """Reads a blob in place."""

    def __init__(self, blob: bytes):
        magic, _, width, n, distinct, buckets, n_ids = HEADER.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = HEADER.size
        self.keys = np.frombuffer(blob, "<i8", n, at)
        at += 8 * n
        self.offset = np.frombuffer(blob, "<u8", n + 1, at)
        at += 8 * (n + 1)
        self.seeds = np.frombuffer(blob, "<u4", buckets, at)
        at += 4 * buckets
        self.table = np.frombuffer(blob, [("fp", "<u4"), ("entry", "<u4")], distinct, at)
        at += 8 * distinct
        self.ids = np.frombuffer(blob, "<u2" if width == 2 else "<u4", n_ids, at)

    def find(self, key: int) -> int | None:
        """The entry of ``key``, in constant time; None for keys whose fingerprint differs."""
        if not len(self.table):
            return None
        seed = int(self.seeds[int(mix(key, 0)) % len(self.seeds)])
        slot = self.table[int(mix(key, seed)) % len(self.table)]
        return int(slot["entry"]) if int(slot["fp"]) == int(mix(key, 1 << 20)) >> 32 else None

    def find_all(self, keys: np.ndarray) -> np.ndarray:
        """``find`` of many keys at once; -1 for unknown ones."""
        if not len(self.table):
            return np.full(len(keys), -1, np.int64)
        seed = self.seeds[(mix(keys, 0) % np.uint64(len(self.seeds))).astype(np.int64)]
        slot = self.table[(mix(keys, seed) % np.uint64(len(self.table))).astype(np.int64)]
        return np.where(slot["fp"] == (mix(keys, 1 << 20) >> np.uint64(32)), slot["entry"].astype(np.int64), -1)

    def entry(self, i: int) -> np.ndarray:
        return self.ids[int(self.offset[i]) : int(self.offset[i + 1])].astype("<u4")

    def get(self, key: int) -> np.ndarray | None:
        i = self.find(key)
        return None if i is None else self.entry(i)


#: How the file's tokenizer splits lower-case Latin-1 text: contractions, letters, single digits, runs of the rest.
LATIN = re.compile(r"[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|'(?:s|t|re|ve|m|ll|d)|[^\t-\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+|[0-9\xb2\xb3\xb9\xbc-\xbe]")


class Encoder:
    """The tokenizers library over a file that drops white space and ignores case; pieces that it has encoded before are looked up.

    Latin-1 texts, which no normal form changes, are split as the file says, and new pieces go to the library side by side in one text.
    Other texts, and those with anything like an added token, go to the library between blanks.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_padding()
        self.t.no_truncation()
        self.pieces: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {"": b""}
        self.width = 2 if self.t.get_vocab_size() <= 1 << 16 else 4

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of pieces, each one word to the library: encoded together and cut by its word numbers."""
        out = {}
        for i in range(0, len(new), 250):  # short texts: the library's bookkeeping grows faster than a text
            part = new[i : i + 250]
            e = self.t.encode(" ".join(part), add_special_tokens=False)
            of, ids = np.array(e.word_ids, np.int64), np.array(e.ids, dtype="<u4")
            if len(of) and of[-1] == len(part) - 1 and (np.diff(of) <= 1).all():
                cuts = np.searchsorted(of, np.arange(len(part) + 1)).tolist()
                raw = ids.tobytes()
                out.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(part, cuts, cuts[1:], strict=False))
            else:
                out.update((w, np.array(x.ids, dtype="<u4").tobytes()) for w, x in zip(part, self.t.encode_batch(part, add_special_tokens=False), strict=True))
        return out

    @staticmethod
    def _gaps(part: list[bytes | None]) -> list[int]:
        out, at = [], -1
        with contextlib.suppress(ValueError):
            while True:
                out.append(at := part.index(None, at + 1))
        return out

    @staticmethod
    def latin(text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return "<|" not in text

    def batch(self, texts: list[str], end: int | None) -> list[bytes]:
        tail = b"" if end is None else np.array([end], "<u4").tobytes()
        plain = [self.latin(t) for t in texts]
        split = [LATIN.findall(t.lower()) if ok else t.replace("\n", " ").split(" ") for t, ok in zip(texts, plain, strict=True)]
        out = [b""] * len(texts)
        for fast in (True, False):
            own = [i for i, ok in enumerate(plain) if ok == fast]
            if not own:
                continue
            known = self.pieces if fast else self.known
            if len(known) > CACHE:
                known.clear()
                known[""] = b""
            get = known.get
            parts = [list(map(get, split[i])) for i in own]
            gaps = [self._gaps(part) for part in parts]
            new = list({split[i][x] for i, gap in zip(own, gaps, strict=True) for x in gap})
            if fast:
                got = self._learn(new)
            else:
                got = {}
                for i in range(0, len(new), 20_000):
                    some = new[i : i + 20_000]
                    got.update((w, np.array(e.ids, dtype="<u4").tobytes()) for w, e in zip(some, self.t.encode_batch(some, add_special_tokens=False), strict=True))
            for i, part, gap in zip(own, parts, gaps, strict=True):
                words = split[i]
                for x in gap:
                    part[x] = got[words[x]]
                out[i] = b"".join(part) + tail
            known.update((w, ids) for w, ids in got.items() if len(w) <= CACHED_CHARS)
        return out


def encoder(path: str) -> Encoder:
    """One encoder per worker process: a worker that runs further tasks keeps the pieces it knows."""
    return worker_state(("ids", path), lambda: Encoder(path))


def write_shards(df: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode ``text_col`` and write shards to ``path``, ids in ascending ``id_col`` order.

    Null ids come first (key ``NO_KEY``), null texts are empty, repeated keys all stay (ties: by text); an empty table writes no shard.
    Buckets are runs of keys of about equal count, so no task holds more than its share; within one, shards stream out.
    """
    spark = df.sparkSession
    small_batches(spark)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_KEY))
    rows = df.select(key.alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    n = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(bucket_of(F.col("k"), range_splits(rows, F.col("k"), n)).alias("b"), "k", "t").repartition("b").sortWithinPartitions("b", "k", "t")
    out = _arrow_schema(spark, SHARD_DDL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here makes cycles, and tracing the caches takes long
        enc = encoder(tokenizer)
        bucket, seq, keys, docs, size = None, 0, [], [], 0

        def shard():
            n_ids = sum(map(len, docs)) // 4
            row = (bucket, seq, keys[0], keys[-1], len(keys), n_ids, keys, pack(keys, docs, enc.width))
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, out, strict=True)], schema=out)

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                bs, ks, ts = (c.to_pylist() for c in batch.slice(start, 256).columns)
                for b, k, ids in zip(bs, ks, enc.batch(ts, end_id), strict=True):
                    if docs and (b != bucket or size + len(ids) > shard_bytes):
                        yield shard()
                        seq, keys, docs, size = seq + 1, [], [], 0
                    if b != bucket:
                        bucket, seq = b, 0
                    keys.append(k)
                    docs.append(ids)
                    size += len(ids)
        if docs:
            yield shard()

    dealt.mapInArrow(run, SHARD_DDL).write.options(**ROW_GROUPS).parquet(path)
    list_files(spark, path, "bucket", path + SHARD_FILES)
    write_index(spark, path)


def part_of(key, n: int):
    return F.pmod(F.xxhash64(key, F.lit(31)), F.lit(n)).cast("int")


def write_index(spark: SparkSession, path: str) -> None:
    """The index of a table of shards, ``parts, part, n, seeds, slots``; a repeated key leads to its first entry. Nothing is written for an empty table."""
    shards = spark.read.parquet(path).select("bucket", "seq", "keys")
    total = shards.agg(F.sum(F.size("keys"))).first()[0] or 0
    n = max(1, -(-total // PART_KEYS))
    rows = shards.select("bucket", "seq", F.posexplode("keys").alias("entry", "k")).groupBy("k").agg(F.min(F.struct("bucket", "seq", "entry")).alias("at"))
    dealt = rows.select(part_of("k", n).alias("part"), "k", "at.bucket", "at.seq", "at.entry").repartition(n, "part").sortWithinPartitions("part", "k")
    ddl = "parts int, part int, n int, seeds binary, slots binary"
    out = _arrow_schema(spark, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def pack_part(own: np.ndarray) -> pa.RecordBatch:
            seeds, slots = perfect_hash(own[1])
            table = np.zeros(len(slots), SLOT)
            table["fp"][slots] = (mix(own[1], 1 << 20) >> np.uint64(32)).astype("<u4")
            for name, values in zip(("bucket", "seq", "entry"), own[2:], strict=True):
                table[name][slots] = values
            row = (n, int(own[0, 0]), len(slots), seeds.tobytes(), table.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, out, strict=True)], schema=out)

        for batch in batches:
            got = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            for part in np.split(got, np.flatnonzero(np.diff(got[0])) + 1, axis=1):
                if part.shape[1]:
                    if held and held[0][0, 0] != part[0, 0]:
                        yield pack_part(np.concatenate(held, axis=1))
                        held = []
                    held.append(part)
        if held:
            yield pack_part(np.concatenate(held, axis=1))

    dealt.mapInArrow(run, ddl).write.options(**ROW_GROUPS).parquet(path + INDEX)
    list_files(spark, path + INDEX, "part", path + PART_FILES, "parts")


def list_files(spark: SparkSession, path: str, number: str, to: str, *more: str) -> None:
    """Write which file holds each ``number``, in order of the numbers: as many rows as buckets, or parts, and files that hold them."""
    held = spark.read.parquet(path).select(number, *more, F.col("_metadata.file_path").alias("file")).distinct()
    held.repartitionByRange(number).sortWithinPartitions(number).write.parquet(to)


def narrowed(spark: SparkSession, path: str, listed: str, wanted: list[tuple], columns: tuple[str, ...]) -> DataFrame:
    """The rows of the table at ``path`` whose ``columns`` are one of ``wanted`` (at most FEW): their files only, by literals that reach the scan."""
    numbers = sorted({w[0] for w in wanted})
    files = [r.file for r in spark.read.parquet(listed).where(F.col(columns[0]).isin(numbers)).select("file").distinct().collect()]
    whole = spark.read.parquet(path)
    if not files:
        return whole.limit(0)
    one = [reduce(and_, [F.col(c) == F.lit(v) for c, v in zip(columns, w, strict=True)]) for w in wanted]
    return spark.read.schema(whole.schema).parquet(*files).where(reduce(or_, one))


def few(df: DataFrame, columns: tuple[str, ...]) -> list[tuple] | None:
    """The distinct values of ``columns`` where they are at most FEW, else None: no more reach the driver."""
    got = [tuple(r) for r in df.select(*columns).distinct().limit(FEW + 1).collect()]
    return got if len(got) <= FEW else None


def places(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """``k, bucket, seq, entry`` of the keys (distinct, column ``k``) that the index knows, each found in one step of its part."""
    first = spark.read.parquet(path + PART_FILES).select("parts").first()
    ddl = "k bigint, bucket int, seq int, entry int"
    if first is None:
        return spark.createDataFrame([], ddl)
    dealt = keys.withColumn("part", part_of("k", first[0]))
    named = few(dealt, ("part",))
    index = spark.read.parquet(path + INDEX) if named is None else narrowed(spark, path + INDEX, path + PART_FILES, named, ("part",))
    wanted = dealt.groupBy("part").agg(F.collect_list("k").alias("ks"))
    rows = wanted.join(index, "part").select("ks", "n", "seeds", "slots")
    out = _arrow_schema(spark, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, n, seeds, table = np.array(batch.column(0)[i].as_py(), np.int64), batch.column(1)[i].as_py(), np.frombuffer(batch.column(2)[i].as_py(), "<u4"), np.frombuffer(batch.column(3)[i].as_py(), SLOT)
                slot = table[(mix(key, seeds[(mix(key, 0) % np.uint64(len(seeds))).astype(np.int64)]) % np.uint64(n)).astype(np.int64)]
                hit = slot["fp"] == (mix(key, 1 << 20) >> np.uint64(32))
                cols = (key[hit], *(slot[c][hit] for c in ("bucket", "seq", "entry")))
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)).cast(f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return rows.mapInArrow(run, ddl)


def directory(spark: SparkSession, path: str) -> DataFrame:
    """One row per shard with ``start``: the ids of all documents before it. As many rows as shards, without their blobs."""
    small = spark.read.parquet(path).drop("blob", "keys")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Buckets are as few as partitions: only their sums are in one place.
    buckets = small.groupBy("bucket").agg(F.sum("n_ids").alias("n_ids")).select("bucket", before(Window.orderBy("bucket")).alias("first"))
    return small.join(F.broadcast(buckets), "bucket").withColumn("start", F.col("first") + before(Window.partitionBy("bucket").orderBy("seq"))).drop("first")


#: Rows of the shard directory (about 40 bytes each) up to which it is broadcast to the readers.
DIRECTORY_ROWS = 500_000


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document, through the index: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``, and ``by_key``: the index finds it (False for a repeated key's later rows)."""
    places = directory(spark, path).select("bucket", "seq", "start")
    if places.count() <= DIRECTORY_ROWS:
        places = F.broadcast(places)
    rows = spark.read.parquet(path).select("bucket", "seq", "blob").join(places, ["bucket", "seq"]).select("start", "blob")
    ddl = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, by_key boolean"
    out = _arrow_schema(spark, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                base, s = batch.column(0)[i].as_py(), Shard(batch.column(1)[i].as_py())
                got = []
                for j, (k, found) in enumerate(zip(s.keys.tolist(), s.find_all(s.keys).tolist(), strict=True)):
                    ids = s.entry(found if found == j else j)
                    got.append((None if k == NO_KEY else k, base + int(s.offset[j]), len(ids), zlib.crc32(ids.tobytes()), found == j))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*got, strict=True), out, strict=True)], schema=out)

    return rows.mapInArrow(run, ddl)


def lookup(spark: SparkSession, path: str, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """Ids of some documents by key: the index names shard and entry. Null or unknown keys give no row; repeated ones one.

    Keys of few parts and shards (FEW) read these alone, whatever the size of the tables; others are joined with all.
    """
    wanted = keys.select(F.col(key_col).cast("long").alias("k")).where("k is not null").distinct()
    hit = places(spark, path, wanted).groupBy("bucket", "seq").agg(F.collect_list(F.struct("k", "entry")).alias("ks"))  # at most the entries of a shard
    named = few(hit, ("bucket", "seq"))
    shards = spark.read.parquet(path) if named is None else narrowed(spark, path, path + SHARD_FILES, named, ("bucket", "seq"))
    rows = shards.select("bucket", "seq", "blob").join(hit, ["bucket", "seq"]).select("ks", "blob")
    ddl = f"`{key_col}` bigint, ids array<bigint>"
    out = _arrow_schema(spark, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s = Shard(batch.column(1)[i].as_py())
                got = [(r["k"], s.entry(r["entry"]).tolist()) for r in batch.column(0)[i].as_py() if int(s.keys[r["entry"]]) == r["k"]]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*got, strict=True), out, strict=True)], schema=out)

    return rows.mapInArrow(run, ddl)


def fresh_path(spark: SparkSession) -> str:
    import uuid

    return f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
