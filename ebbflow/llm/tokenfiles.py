"""Token-id files with a minimal perfect hash index for keyed access.

A shard is one byte image (little-endian throughout):

    magic "EBTK", version, width of an id in bytes (2 or 4), number of documents n, number of ids, number of buckets,
    pilots    int32  x buckets   displacement of each bucket; -1 - slot for a bucket that holds one key
    prints    uint32 x n         fingerprint of the key in each slot
    slots     uint32 x n         the document (0 to n - 1, in order) that each slot stands for
    keys      int64  x n         document keys in order
    nulls     uint8  x n         1 where the key is null
    offsets   uint64 x (n + 1)   where each document's ids begin
    payload                      the raw ids

The index is minimal and perfect: n keys fill n slots. A key is hashed to a bucket; buckets are placed from the
fullest to the emptiest, each by the first displacement that moves its keys to free slots, and single keys go straight
to the slots that are left. A lookup reads one pilot, one fingerprint and one slot, whatever the number of keys.
Equal keys are told apart by their place among their equals (0, 1, ...).

Writing: documents are dealt by key range, sorted, encoded in batches, and every task flushes a shard when its ids
reach ``shard_ids``, so memory doesn't grow with a partition. The images are written as binary rows through Spark's
Parquet writer, so any store that Spark can write holds them. Reading parses each image, looks every key up through the index and
takes its ids from the payload.

Defined results: a null text is encoded as the empty text and so holds the end id alone; documents with a null key come
first; documents with equal keys are all kept, ordered by text; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbflow import workers
from ebbflow.llm import bpe, pretokens, support

MAGIC, VERSION = b"EBTK", 1
HEADER = struct.Struct("<4sHHQQQ")
#: Mean keys in a bucket of the index.
BUCKET_KEYS = 4
SHARD_IDS = 4_000_000
END_ID = 2
SHARD_SCHEMA = "part int, seq int, first_key long, last_key long, n_docs long, n_ids long, image binary"
#: Pieces and pre-tokens that a worker remembers before it starts anew.
CACHE_ENTRIES = 2_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (three rounds of xor-shift and multiply)."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hash(keys: np.ndarray, nulls: np.ndarray, nth: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(mixed(keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ (nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + nulls.astype(np.uint64)))


def slot_of(hashes: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    """The slot of each hash."""
    pilot = pilots[(hashes >> np.uint64(32)) % np.uint64(len(pilots))].astype(np.int64)
    moved = mixed(hashes ^ mixed(pilot.astype(np.uint64))) % np.uint64(max(n, 1))
    return np.where(pilot < 0, -1 - pilot, moved.astype(np.int64))


def build_index(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pilots, slot of each key) for distinct hashes."""
    n = len(hashes)
    pilots = np.zeros(max(1, -(-n // BUCKET_KEYS)), np.int32)
    bucket = ((hashes >> np.uint64(32)) % np.uint64(len(pilots))).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[order], np.arange(len(pilots) + 1))
    sizes = np.diff(starts)
    free, slots = np.ones(n, bool), np.zeros(n, np.int64)
    for b in np.argsort(-sizes, kind="stable").tolist():
        own = order[starts[b] : starts[b + 1]]
        if len(own) < 2:
            break
        pilot, tries = 0, 64
        while True:
            seeds = mixed(np.arange(pilot, pilot + tries, dtype=np.uint64))
            at = (mixed(hashes[own][None, :] ^ seeds[:, None]) % np.uint64(n)).astype(np.int64)
            line = np.sort(at, axis=1)
            fits = free[at].all(axis=1) & (np.diff(line, axis=1) > 0).all(axis=1)
            if fits.any():
                k = int(np.argmax(fits))
                pilots[b], slots[own] = pilot + k, at[k]
                free[at[k]] = False
                break
            pilot += tries
            tries = min(tries * 2, 1 << 14)
    single = np.flatnonzero(sizes == 1)
    left = np.flatnonzero(free)
    pilots[single] = -1 - left
    slots[order[starts[single]]] = left
    return pilots, slots


def shard_image(keys: list[int | None], ids: list[bytes], width: int) -> bytes:
    """The image of documents in ascending order of key; ``ids`` hold unsigned 32-bit integers."""
    n = len(keys)
    nulls = np.fromiter((k is None for k in keys), bool, n)
    plain = np.array([k or 0 for k in keys], np.int64)
    new = np.ones(n, bool)
    new[1:] = (plain[1:] != plain[:-1]) | (nulls[1:] != nulls[:-1])
    begins = np.flatnonzero(new)
    nth = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
    hashes = key_hash(plain, nulls, nth)
    pilots, slots = build_index(hashes)
    prints, documents = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    prints[slots] = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    documents[slots] = np.arange(n, dtype=np.uint32)
    offsets = np.zeros(n + 1, np.uint64)
    offsets[1:] = np.cumsum([len(x) // 4 for x in ids])
    flat = np.frombuffer(b"".join(ids), np.uint32)
    return b"".join(
        (
            HEADER.pack(MAGIC, VERSION, width, n, len(flat), len(pilots)),
            pilots.tobytes(),
            prints.tobytes(),
            documents.tobytes(),
            plain.tobytes(),
            nulls.astype(np.uint8).tobytes(),
            offsets.tobytes(),
            (flat.astype(np.uint16) if width == 2 else flat).tobytes(),
        )
    )


class Shard:
    """Reads an image."""

    def __init__(self, image: bytes):
        magic, version, width, self.n, n_ids, n_pilots = HEADER.unpack_from(image)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token-id shard")
        at = HEADER.size

        def take(kind, count):
            nonlocal at
            got = np.frombuffer(image, kind, count, at)
            at += got.nbytes
            return got

        self.pilots, self.prints, self.documents = take(np.int32, n_pilots), take(np.uint32, self.n), take(np.uint32, self.n)
        self.keys, self.nulls, self.offsets = take(np.int64, self.n), take(np.uint8, self.n), take(np.uint64, self.n + 1)
        self.payload = take(np.uint16 if width == 2 else np.uint32, n_ids)

    def find(self, keys: np.ndarray, nulls: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The document (-1: none) of each key, by one probe of the index each."""
        if not self.n:
            return np.full(len(keys), -1)
        hashes = key_hash(keys, nulls, nth)
        slots = slot_of(hashes, self.pilots, self.n)
        known = self.prints[slots] == (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        found = self.documents[slots].astype(np.int64)
        return np.where(known & (self.keys[found] == keys) & (self.nulls[found] == nulls), found, -1)

    def get(self, key: int | None, nth: int = 0) -> np.ndarray | None:
        """The ids of one document."""
        d = int(self.find(np.array([key or 0]), np.array([key is None]), np.array([nth]))[0])
        return None if d < 0 else self.payload[int(self.offsets[d]) : int(self.offsets[d + 1])]


class LibraryEncoder:
    """The public tokenizers library over distinct pre-tokens; what a worker has seen it remembers.

    The library's own model encodes; its pattern and special tokens were already applied where the texts were cut.
    """

    def __init__(self, layout: str):
        from tokenizers import Tokenizer, pre_tokenizers

        whole = Tokenizer.from_str(layout)
        self.tokenizer = Tokenizer(whole.model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.width = 2 if whole.get_vocab_size() <= 1 << 16 else 4
        special = {t.content: i for i, t in whole.get_added_tokens_decoder().items()}
        self.encode_batch = pretokens.Encoder(self._ids, special, CACHE_ENTRIES).encode_batch

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _encoder(shared: bpe.Shared) -> LibraryEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return support.once(f"library-{shared.id}", lambda: LibraryEncoder(shared.value))


def write(docs: DataFrame, path: str, tokenizer: str, partitions: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Writes all documents' ids to shards under ``path``, in ascending order of id over (part, seq)."""
    workers.reach(docs.sparkSession)
    shared = bpe.Shared(docs.sparkSession, tokenizer)
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = _encoder(shared), TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            known = [k for k in keys if k is not None]
            row = [part, seq, known[0] if known else None, known[-1] if known else None, len(keys), held, shard_image(keys, ids, encoder.width)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, arrow.types)], schema=arrow)

        for batch in batches:
            names = batch.column(0).to_pylist()
            k = 0
            for texts in bpe.in_slices(batch.column(1).to_pylist()):
                for got in encoder.encode_batch(texts):
                    keys.append(names[k])
                    ids.append(got + end)
                    held += len(got) // 4 + 1
                    k += 1
                    if held >= shard_ids:
                        yield flush()
                        keys, ids, held, seq = [], [], 0, seq + 1
        if keys:
            yield flush()

    arrow = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("image", pa.binary())])
    keyed = docs.select(F.col(id_col).cast("bigint").alias("key"), F.col(text_col).alias("text"))
    keyed.repartitionByRange(partitions, F.asc_nulls_first("key")).sortWithinPartitions(F.asc_nulls_first("key"), "text").mapInArrow(run, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row a document from the shards: its key, start, n_tokens and ids_crc32; each is found through the index."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)

    def work(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("key", "part", "seq", "at", "n_tokens", "ids_crc32")}
        for part, seq, image in zip(rows["part"], rows["seq"], rows["image"]):
            shard = Shard(image)
            seen: dict = {}
            nth = np.zeros(shard.n, np.int64)
            for i, k in enumerate(zip(shard.keys.tolist(), shard.nulls.tolist())):
                nth[i] = seen[k] = seen.get(k, -1) + 1
            for i, d in enumerate(shard.find(shard.keys, shard.nulls, nth).tolist()):
                a, b = int(shard.offsets[d]), int(shard.offsets[d + 1])
                for name, value in (("key", None if shard.nulls[i] else int(shard.keys[i])), ("part", part), ("seq", seq), ("at", a), ("n_tokens", b - a), ("ids_crc32", zlib.crc32(shard.payload[a:b].astype("<u4").tobytes()))):
                    out[name].append(value)
        return out

    found = support.map_arrow(shards.select("part", "seq", "image"), work, "key long, part int, seq int, at long, n_tokens long, ids_crc32 long")
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, 0)
    before = shards.select("part", "seq", "n_ids").withColumn("before", F.sum("n_ids").over(order) - F.col("n_ids"))
    return found.join(before.select("part", "seq", "before"), ["part", "seq"]).select(F.col("key").alias(id_col), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """(key, ids) of some documents: only shards whose key range can hold a key are read, one probe for each key there."""
    wanted = sorted(set(keys))

    def work(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"key": [], "ids": []}
        for image in rows["image"]:
            shard = Shard(image)
            for key in wanted:
                nth = 0
                while (ids := shard.get(key, nth)) is not None:
                    out["key"].append(key)
                    out["ids"].append(ids.astype(np.int64))
                    nth += 1
        return out

    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    near = F.lit(False)
    if wanted:
        near = F.exists(F.array(*map(F.lit, wanted)), lambda k: k.between(F.col("first_key"), F.col("last_key")))
    return support.map_arrow(shards.filter(near).select("image"), work, "key long, ids array<long>")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written to shards in the shared folder and read back."""
    docs = support.table(spark, sf_dir, "documents")
    path = f"{support.shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    write(docs, path, bpe.public_tokenizer(), partitions=max(docs.rdd.getNumPartitions() * 2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return read(spark, path)
