"""Byte-level BPE encoding and decoding by speculation and verification.

Encoding a batch of distinct pieces:

1. Speculate: each pre-token's bytes are cut greedily into the longest vocabulary tokens.
2. Verify: a cut is what the merges give exactly if each adjacent pair of its tokens is compatible, that is if no merge
   across the boundary could have come before the merges that made the two tokens. All pairs of the batch are tested
   at once: in steps, the token that was made last is undone on its inner side, and the merge of the two tokens now at
   the boundary is looked up in a sorted array. A merge found that ranks before the limit refutes the pair.
3. Only pre-tokens with a refuted pair are merged exactly, pair by pair in rank order with a heap.

Texts are cut so that pieces repeat (``pretokens``), and each Python worker keeps the ids of the pieces it has seen.
The vocabulary's file is read by the driver from the given path and sent to the workers; its size doesn't depend on
the data. Special tokens of the file that occur in a text are encoded as themselves, as the public library does.

Defined results: a null text is encoded as the empty text: no ids, whose digest is that of the empty string; equal rows
stay separate rows; an empty table gives no rows; other columns are ignored, whatever their names. Texts of any length
are encoded whole, in slices that a worker's memory holds.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.llm import pretokens, support

#: Pieces and pre-tokens that a worker remembers before it starts anew.
CACHE_ENTRIES = 250_000
#: Characters of text that are worked on at once.
SLICE_CHARS = 1_000_000
NO_LIMIT = np.int64(1) << 40


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteBPE:
    """A vocabulary in the public tokenizer.json layout."""

    def __init__(self, layout: str):
        spec = json.loads(layout)
        alphabet = byte_alphabet()
        to_bytes = lambda token: bytes(alphabet[c] for c in token)
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        # "Rank" numbers tokens by when they come to be: 0 to 255 are single bytes, 256 + k the result of merge k.
        made = [bytes([b]) for b in range(256)]
        self.left, self.right = list(range(256)), list(range(256))
        rank_of = {t: r for r, t in enumerate(made)}
        pairs: dict[int, int] = {}
        for a, b in merges:
            x, y = rank_of[to_bytes(a)], rank_of[to_bytes(b)]
            whole = made[x] + made[y]
            pairs.setdefault((x << 32) | y, len(made))
            rank_of.setdefault(whole, len(made))
            self.left.append(x)
            self.right.append(y)
            made.append(whole)
        self.rank_of, self.pairs = rank_of, pairs
        self.left_of, self.right_of = np.array(self.left, np.int64), np.array(self.right, np.int64)
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        text_of = {b: c for c, b in alphabet.items()}
        self.id_of = np.array([vocab["".join(text_of[b] for b in t)] for t in made], np.uint32)
        self.longest = [0] * 256
        for t in rank_of:
            self.longest[t[0]] = max(self.longest[t[0]], len(t))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.encoder = pretokens.Encoder(self.encode_words, self.special, CACHE_ENTRIES)
        table = {int(i): t for t, i in zip(made, self.id_of)} | {i: c.encode() for c, i in self.special.items()}
        ids = range(max(table) + 1)
        self.spoken = _Table([table.get(i, b"") for i in ids])
        self.decimal = _Table([b"%d," % i for i in ids])

    def guess(self, word: bytes) -> list[int]:
        """Greedy longest match, in ranks."""
        rank_of, longest, out, i, n = self.rank_of, self.longest, [], 0, len(word)
        whole = rank_of.get(word)
        if whole is not None:
            return [whole]
        while i < n:
            j = min(n, i + longest[word[i]])
            while (r := rank_of.get(word[i:j])) is None:
                j -= 1
            out.append(r)
            i = j
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of adjacent tokens, whether the merges leave the boundary between them."""
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b, limit = a.astype(np.int64), b.astype(np.int64), np.full(len(a), NO_LIMIT)
        keys, ranks = self.pair_keys, self.pair_ranks
        while len(at):
            key = (a << 32) | b
            k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            refuted = (keys[k] == key) & (ranks[k] < limit)
            good[at[refuted]] = False
            # Undo the later of the two; a single byte can't be undone, so then the other one is.
            left = ((a > b) & (a > 255)) | (b < 256)
            done = (a < 256) & (b < 256)
            limit = np.where(left, a, b + 1)
            a, b = np.where(left, self.right_of[a], a), np.where(left, b, self.left_of[b])
            go = ~(refuted | done)
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return good

    def merge(self, word: bytes) -> list[int]:
        """Exact merging, lowest rank first and leftmost among equals."""
        token, n = list(word), len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs, heap = self.pairs, []
        for i in range(n - 1):
            if (r := pairs.get((token[i] << 32) | token[i + 1])) is not None:
                heap.append((r, i, token[i], token[i + 1]))
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i]
            if token[i] != x or j >= n or token[j] != y:
                continue
            token[i], token[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := pairs.get((r << 32) | token[k])) is not None:
                    heapq.heappush(heap, (q, i, r, token[k]))
            if (p := before[i]) >= 0 and (q := pairs.get((token[p] << 32) | r)) is not None:
                heapq.heappush(heap, (q, p, token[p], r))
        return [t for t in token if t >= 0]

    def encode_words(self, tokens: list[str]) -> list[bytes]:
        """The ids of each pre-token as little-endian unsigned 32-bit integers."""
        words = [t.encode() for t in tokens]
        guesses = [self.guess(w) for w in words]
        sizes = np.fromiter(map(len, guesses), np.int64, len(guesses))
        ranks = np.fromiter((r for g in guesses for r in g), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        if len(ranks) > 1:
            inner = np.ones(len(ranks) - 1, bool)
            inner[ends[:-1] - 1] = False
            at = np.flatnonzero(inner)
            failed = at[~self.compatible(ranks[at], ranks[at + 1])]
            for k in np.unique(np.searchsorted(ends, failed, side="right")).tolist():
                guesses[k] = self.merge(words[k])
            sizes = np.fromiter(map(len, guesses), np.int64, len(guesses))
            ranks = np.fromiter((r for g in guesses for r in g), np.int64, int(sizes.sum()))
        flat = self.id_of[ranks].tobytes()
        ends = (4 * np.cumsum(sizes)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def encode_batch(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of every text as little-endian unsigned 32-bit integers."""
        return self.encoder.encode_batch(texts)

    def decode(self, ids: np.ndarray) -> str:
        return self.spoken.join(ids).decode("utf-8", "replace")


class _Table:
    """Byte strings by number, joined for arrays of numbers."""

    def __init__(self, rows: list[bytes]):
        self.flat = np.frombuffer(b"".join(rows), np.uint8)
        self.size = np.array([len(r) for r in rows], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def join(self, ids: np.ndarray, at_once: int = 1 << 18) -> bytes:
        out = []
        for i in range(0, len(ids), at_once):
            part = ids[i : i + at_once]
            size = self.size[part]
            ends = np.cumsum(size)
            out.append(self.flat[np.repeat(self.start[part] - ends + size, size) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


def loaded(shared: Shared) -> ByteBPE:
    """This worker's copy of a broadcast vocabulary."""
    return support.once(f"bpe-{shared.id}", lambda: ByteBPE(shared.value))


class Shared:
    """A file's text that is broadcast to the workers; ``id`` tells files apart."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as file:
            text = file.read()
        self.id, self._sent = hashlib.sha256(text.encode()).hexdigest(), spark.sparkContext.broadcast(text)

    @property
    def value(self) -> str:
        return self._sent.value


def in_slices(texts: list[str | None], most: int = SLICE_CHARS) -> Iterable[list[str]]:
    """The texts in order, in runs of about ``most`` characters; null texts are empty."""
    run, held = [], 0
    for text in texts:
        run.append(text or "")
        held += len(run[-1])
        if held >= most:
            yield run
            run, held = [], 0
    if run:
        yield run


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id and ``ids`` (array of int)."""
    shared = Shared(docs.sparkSession, tokenizer)

    def work(rows: dict[str, list]) -> dict[str, list]:
        bpe = loaded(shared)
        return {"key": rows["key"], "ids": [np.frombuffer(x, np.uint32).astype(np.int32) for run in in_slices(rows["text"]) for x in bpe.encode_batch(run)]}

    return _mapped(docs, id_col, text_col, work, "ids array<int>").withColumnRenamed("key", id_col)


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id") -> DataFrame:
    """One row a document: its id and the text of ``ids``; null ids give a null text."""
    shared = Shared(encoded.sparkSession, tokenizer)

    def work(rows: dict[str, list]) -> dict[str, list]:
        bpe = loaded(shared)
        return {"key": rows["key"], "text": [None if x is None else bpe.decode(np.array(x, np.int64)) for x in rows["text"]]}

    return _mapped(encoded, id_col, "ids", work, "text string").withColumnRenamed("key", id_col)


def encode_decode_digest(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text in one pass: n_tokens and digests of the ids and of the decoded text."""
    shared = Shared(docs.sparkSession, tokenizer)

    def work(rows: dict[str, list]) -> dict[str, list]:
        bpe = loaded(shared)
        out: dict[str, list] = {"key": rows["key"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for run in in_slices(rows["text"]):
            for got in bpe.encode_batch(run):
                ids = np.frombuffer(got, np.uint32)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(bpe.decimal.join(ids)[:-1]).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        return out

    return _mapped(docs, id_col, text_col, work, "n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", id_col)


def _mapped(docs: DataFrame, id_col: str, text_col: str, work, more: str) -> DataFrame:
    picked: Column = F.col(text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    return support.map_arrow(docs.select(F.col(id_col).alias("key"), picked.alias("text")), work, f"key {kind}, {more}")


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded."""
    return encode_decode_digest(support.table(spark, sf_dir, "documents"), public_tokenizer())
