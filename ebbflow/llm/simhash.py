"""SimHash near-duplicates by anchor-point covering.

Fingerprints. A text's words (A-Z lower-cased, cut at space and U+0009 to U+000D) give shingles of ``shingle`` words
with repeats, joined by spaces; a text of fewer words is one shingle, a text without words has fingerprint zero. Each
shingle is hashed with XXH64 (seed 42); a bit of the fingerprint is 1 if it is set in over half of the hashes.

Anchors. The anchors are the words of a perfect covering code: the Hamming code of length 63 on bits 0 to 62, joined
with the free bit 63. Its covering radius is 1: every 64-bit string has an anchor at distance 1 or less. Two
fingerprints that differ in at most two bits have a string between them that differs from each in at most one bit, and
that string's anchor is within 1 + 1 = 2 of both. So each fingerprint is sent to every anchor within the covering
radius plus the threshold's half, 2 or 33 anchors of 2**58, and any two linked fingerprints meet at an anchor, with none
missed. The groups are small whatever the data: at most 2081 different fingerprints lie within 2 of an anchor.

Comparison. The fingerprints of an anchor are compared with each other by their differing bits, and the links found
are reduced to a spanning forest of the group before they leave the task. Copies were merged before (one row for each
distinct fingerprint), so neither copies nor dense groups are expanded into pairs. Components of the links are found
by iterative joins, and every document takes the component of its fingerprint.

``similar_documents`` serves a similarity instead of a number of bits: documents are linked if the sets of their
shingles have a Jaccard similarity of at least ``similarity``. First come the anchors: links of fingerprints, confirmed by
the sets. At 0.8, fingerprints differ in up to 17 bits of 64 (measured), which no covering of 64 bits decides, so an exact
way finds the rest, a prefix filter: if all sets are sorted in one common order, two sets of similarity s share one of the
first n - ceil(s * n) + 1 shingles of each, n being the set's size. The order puts the ``COMMON`` most frequent shingles
of a sample of texts last, so passages that many texts share are seldom in a prefix; any order gives the same links.
Texts that share a prefix shingle are a group; a group that the sample shows to hold more than ``GROUP`` texts is cut by a hash of the
text into parts of about that size before the shuffle, so no task holds a hot one. The first round tests, within parts, neighbours and each text with the part's first (parts of up
to ``SMALL`` texts fully). The second round takes all groups of more than ``SMALL`` texts that are not yet one component, and
tests all their pairs that sizes allow and that are in different components, in pairs of blocks of about ``BLOCK`` texts: by bitmaps, which rule out no similar pair, then by the
sets of the texts that are left; a block pair yields a forest of its links.
So no pair is missed, whatever a group's size. Sets hold 40 bits of each shingle's hash: two texts of a million words
have about one false shingle in common.

Defined results: null, empty and wordless texts share fingerprint zero and are linked like any other; rows with a null
id can't name a component and are named by the smallest other id they reach, else null; equal rows stay separate rows; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow import workers
from ebbflow.llm import support
from ebbflow.llm.components import components, extended

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEED, THRESHOLD = 42, 2
#: Shingles that are hashed at once, which bounds memory for long texts.
AT_ONCE = 1 << 16
#: Groups up to this size are compared fully in the first round; groups beyond ``GROUP`` are cut into parts there.
SMALL, GROUP = 8, 4096
#: Orders in which the first round puts the members of groups; each key has one of them.
ORDERS = 32
#: Names that a block of marks covers (a bit each), as a power of two, and the blocks that are broadcast at most.
BLOCK_BITS, BROADCAST_BLOCKS = 13, 1 << 14
#: Bytes that are kept of a shingle's hash.
KEPT = 5
#: Rows of a group that are compared with the whole group at once.
BLOCK = 512
#: Most shingles that are put last, the share of texts they are counted in (one of so many), and the least count there.
COMMON, COUNTED_IN, LEAST_COUNT = 1 << 16, 16, 2
#: Shingles of a block pair that are compared at once.
COLUMNS = 4096


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().translate(LOWER))


def shingle_hashes(words: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """The hashes of all shingles in order, ``AT_ONCE`` at a time."""
    if not words:
        return
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), AT_ONCE):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + AT_ONCE], ends[i : i + AT_ONCE])], np.uint64)


def majority(hashes: Iterator[np.ndarray]) -> int:
    """The fingerprint of hashes, as an unsigned number."""
    counts, n = np.zeros(64, np.int64), 0
    for part in hashes:
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of a text as an unsigned number."""
    return majority(shingle_hashes(words_of(text), shingle))


def packed(tokens: np.ndarray) -> bytes:
    """A sorted set of hashes as ``KEPT`` bytes each."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    whole = np.zeros((len(data) // KEPT, 8), np.uint8)
    whole[:, :KEPT] = np.frombuffer(data, np.uint8).reshape(-1, KEPT)
    return whole.view("<u8").reshape(-1)


def bitmap(tokens: np.ndarray, places: int = 0) -> bytes:
    """A bit for each token in ``places``, a power of two; if not given, at least four times as many as tokens."""
    bits = np.zeros(max(64, places or support.power_of_two(4 * len(tokens))), np.uint8)
    bits[(tokens & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def most_common(n_a: int, bits_a: bytes, n_b: int, bits_b: bytes) -> int:
    """The most tokens that two sets can share, by sizes and bitmaps: their common bits, and what may share a bit."""
    a, b = np.frombuffer(bits_a, np.uint64), np.frombuffer(bits_b, np.uint64)
    while len(a) != len(b):
        # The larger one is folded to the smaller one's places.
        a, b = (a[: len(a) // 2] | a[len(a) // 2 :], b) if len(a) > len(b) else (a, b[: len(b) // 2] | b[len(b) // 2 :])
    count = lambda x: int(np.bitwise_count(x).sum())
    return min(n_a, n_b, count(a & b) + min(n_a - count(a), n_b - count(b)))


def prefix(tokens: np.ndarray, common: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The tokens of a set that any set of that similarity shares one of; ``common`` (sorted) come last, by ``rank``."""
    n = len(tokens)
    wanted = n - math.ceil(similarity * n - 1e-9) + 1
    with np.errstate(over="ignore"):
        order = tokens * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(1)
    if len(common):
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        order = np.where(common[at] == tokens, np.uint64(1 << 63) + rank[at], order)
    return tokens if wanted >= n else tokens[np.argpartition(order, wanted - 1)[:wanted]]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed 64-bit number."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        found = np.array([fingerprint(t, shingle) for t in rows["text"]], np.uint64)
        return {"doc_id": rows["doc_id"], "fp": found.view(np.int64)}

    return support.map_arrow(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), work, "doc_id long, fp long")


def syndromes(fps: np.ndarray) -> np.ndarray:
    """The position (1 to 63, bit + 1) of the one error of each string, 0 if it is a code word."""
    found = np.zeros(len(fps), np.int64)
    for bit in range(63):
        found ^= np.where((fps >> np.uint64(bit)) & np.uint64(1), bit + 1, 0)
    return found


def _anchor_masks() -> list[np.ndarray]:
    """For each syndrome, what to change to reach all anchors within distance 2."""
    one = [np.uint64(0)] + [np.uint64(1) << np.uint64(p - 1) for p in range(1, 64)]
    free = np.uint64(1) << np.uint64(63)
    masks = [np.array([0, free], np.uint64)]
    for s in range(1, 64):
        pairs = [one[p] ^ one[p ^ s] for p in range(1, 64) if p < p ^ s]
        masks.append(np.array([one[s], one[s] ^ free, *pairs], np.uint64))
    return masks


MASKS = _anchor_masks()


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): all anchors within distance 2 of each fingerprint."""
    rows, found = [], []
    of = syndromes(fps)
    for s in np.unique(of).tolist():
        at = np.flatnonzero(of == s)
        rows.append(np.repeat(at, len(MASKS[s])))
        found.append((fps[at][:, None] ^ MASKS[s]).reshape(-1))
    return np.concatenate(rows), np.concatenate(found)


def _spanning(fps: np.ndarray, names: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links of one anchor's fingerprints, as a forest: each member and the first that it is connected with."""
    n = len(fps)
    label = np.arange(n)
    pairs = []
    for i in range(0, n, BLOCK):
        near = np.bitwise_count(fps[i : i + BLOCK, None] ^ fps[None, :]) <= threshold
        a, b = np.nonzero(near)
        pairs.append((a + i, b))
    a, b = np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        least = least[least]
        if np.array_equal(least, label):
            break
        label = least
    own = np.flatnonzero(label != np.arange(n))
    return [(int(names[x]), int(names[label[x]])) for x in own]


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(fp, name) with distinct fp to edges (u, v) between names; they connect what threshold links connect."""
    if threshold > THRESHOLD:
        raise ValueError("the anchors cover links of at most two differing bits")
    workers.reach(distinct.sparkSession)

    def replicate(rows: dict[str, list]) -> dict[str, list]:
        fps, names = np.array(rows["fp"], np.int64), np.array(rows["name"], np.int64)
        row, anchor = anchors(fps.view(np.uint64))
        return {"anchor": anchor.view(np.int64), "fp": fps[row], "name": names[row]}

    arrow = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([a, c.to_numpy(zero_copy_only=False)]) for a, c in zip(held, batch.columns)]
            if not len(held[0]):
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))
            yield _edges([x[:cut] for x in held])
            held = [x[cut:] for x in held]
        yield _edges(held)

    def _edges(held: list[np.ndarray]) -> pa.RecordBatch:
        anchor, fp, name = held
        if len(anchor) < 2:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, schema=arrow)
        begins = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        sizes = np.diff(np.append(begins, len(anchor)))
        u, v = [], []
        fp = fp.view(np.uint64)
        two = begins[sizes == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= threshold]
        u.extend(name[near + 1].tolist())
        v.extend(name[near].tolist())
        for b, n in zip(begins[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            for x, y in _spanning(fp[b : b + n], name[b : b + n], threshold):
                u.append(x)
                v.append(y)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=arrow)

    sent = support.map_arrow(distinct.select("fp", "name"), replicate, "anchor long, fp long, name long")
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return sent.repartition(parts, "anchor").sortWithinPartitions("anchor", "fp").mapInArrow(support.eased(compare), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, fp (signed) and component_id."""
    marked = support.checkpoint(fingerprints(docs, id_col, text_col, shingle))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("name"))
    named = support.checkpoint(distinct)
    linked = components(links(named.filter("name is not null"), threshold))
    placed = named.join(linked.withColumnRenamed("node", "name"), "name", "left").select(F.col("fp").alias("of"), F.coalesce("component", "name").alias("component_id"))
    placed = support.checkpoint(placed)
    return marked.join(placed, marked["fp"] == placed["of"]).select("doc_id", "fp", "component_id")


def _meet(keyed: DataFrame, similarity: float) -> DataFrame:
    """(key, part, name, n) to rows (u, v, n): the first round's pairs with n 0, and key, name and n of the members of larger groups.

    Pairs whose sizes rule out the similarity are left out.

    All pairs of small groups; of larger ones, neighbours by a hash and each member with the first of its part. One pass
    serves both, so keys, most of which one text alone has, are moved once and never stored. The hash has ``ORDERS`` forms:
    near copies share many keys, and an order for each key would pair each of them with as many others.
    """
    arrow = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int32())])

    def rows(key: np.ndarray, part: np.ndarray, name: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        begins = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(begins, len(key)))
        first, size = np.repeat(begins, sizes), np.repeat(sizes, sizes)
        place = np.arange(len(key)) - first
        left, right = [], []
        for lag in range(1, SMALL):
            at = np.flatnonzero((place >= lag) & ((size <= SMALL) | (lag == 1)))
            left.append(at - lag)
            right.append(at)
        at = np.flatnonzero((place >= 2) & (size > SMALL))
        left, right = np.concatenate([*left, first[at]]), np.concatenate([*right, at])
        fits = np.minimum(n[left], n[right]) >= similarity * np.maximum(n[left], n[right]) - 1e-6
        u, v = name[left[fits]], name[right[fits]]
        found = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1)[u != v], axis=0)
        # A part of a cut group (part > 0) may be small; the group is not.
        member = np.flatnonzero((size > SMALL) | (part > 0))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([found[:, 0], key[member]])), pa.array(np.concatenate([found[:, 1], name[member]])), pa.array(np.concatenate([np.zeros(len(found), np.int32), n[member]]))], schema=arrow
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        for batch in batches:
            held = [np.concatenate([a, c.to_numpy(zero_copy_only=False)]) for a, c in zip(held, batch.columns)]
            same = (held[0] == held[0][-1]) & (held[1] == held[1][-1]) if len(held[0]) else np.zeros(0, bool)
            if len(same) and (cut := int(np.argmax(same))):
                yield rows(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        yield rows(*held)

    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(parts, "key", "part").sortWithinPartitions("key", "part", F.xxhash64(F.pmod("key", F.lit(ORDERS)), "name"))
    return dealt.mapInArrow(support.eased(run), "u long, v long, n int")


def _linked_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets (``name``, ``shingles``: a packed set) are similar enough."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"u": [], "v": []}
        for u, v, a, b in zip(rows["u"], rows["v"], rows["a"], rows["b"]):
            a, b = unpacked(a), unpacked(b)
            both = len(np.intersect1d(a, b, assume_unique=True))
            if both >= similarity * (len(a) + len(b) - both):
                out["u"].append(u)
                out["v"].append(v)
        return out

    one = pairs.join(sets.select(F.col("name").alias("u"), F.col("shingles").alias("a")), "u")
    two = one.join(sets.select(F.col("name").alias("v"), F.col("shingles").alias("b")), "v")
    return support.map_arrow(two.select("u", "v", "a", "b"), work, "u long, v long")


def _forest(names: np.ndarray, of: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between members ``left`` and ``right`` (positions) of similar sets in different components (``of``), as a forest."""
    if not len(left) or not len(right) or (of == of[0]).all():
        return []
    sizes = np.array([len(x) for x in sets])
    tokens, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    # A token of one set is in no intersection.
    number = np.cumsum(times > 1) - 1
    shared = times[column] > 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [c, c + COLUMNS]))
        dense = np.zeros((len(sets), min(COLUMNS, int(number[-1]) + 1 - c)), np.float32)
        dense[row[part], column[part] - c] = 1
        both += dense[left] @ dense[right].T
    near = both >= similarity * (sizes[left][:, None] + sizes[right][None, :] - both.astype(np.float64))
    near &= of[left][:, None] != of[right][None, :]
    a, b = np.nonzero(near)
    label = np.arange(len(sets))
    a, b = np.concatenate([left[a], right[b]]), np.concatenate([right[b], left[a]])
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        least = least[least]
        if np.array_equal(least, label):
            break
        label = least
    # Edges of the forest: each reached member and a real neighbour nearer to the first, level by level.
    found, seen = [], label == np.arange(len(sets))
    while len(a):
        step = seen[a] & ~seen[b]
        if not step.any():
            break
        new, at = np.unique(b[step], return_index=True)
        found += zip(names[a[step][at]].tolist(), names[new].tolist())
        seen[new] = True
    return found


def _possible(of: np.ndarray, n: np.ndarray, bits: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Which members have a partner of another component (``of``) on the other side that sizes and bitmaps (of one length) allow."""
    ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    both = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, bits.shape[1], COLUMNS // 8):
        dense = np.unpackbits(bits[:, c : c + COLUMNS // 8], axis=1).astype(np.float32)
        both += dense[left] @ dense[right].T
    hidden = n - ones
    most = both.astype(np.int64) + np.minimum(hidden[left][:, None], hidden[right][None, :])
    most = np.minimum(most, np.minimum(n[left][:, None], n[right][None, :]))
    near = (most >= similarity * (n[left][:, None] + n[right][None, :] - most) - 1e-6) & (of[left][:, None] != of[right][None, :])
    found = np.zeros(len(n), bool)
    found[left[near.any(axis=1)]] = True
    found[right[near.any(axis=0)]] = True
    return found


def _by_pair(work, keys: int = 1):
    """Batches sorted by their first columns (``keys`` of them) to what ``work`` makes of the rows of each of their values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if held and row[:keys] != last:
                    yield work(held)
                    held = []
                last = row[:keys]
                held.append(row)
        if held:
            yield work(held)

    return run


def _rest(members: DataFrame, texts: DataFrame, component: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) of large groups (``members``: key, name, n) between texts that are not yet in one component, all pairs tested.

    Bitmaps test the pairs first; the sets of texts that still may have a partner are moved, those of the others are not.
    """
    workers.reach(members.sparkSession)
    spark = members.sparkSession
    labels = component.select(F.col("node").alias("named"), "component")
    members = support.checkpoint(members.join(labels, F.col("name") == F.col("named"), "left").select("key", "name", "n", F.coalesce("component", "name").alias("component")))
    torn = members.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most").select(F.col("key").alias("of"))
    members = members.join(torn, F.col("key") == F.col("of"), "left_semi")
    # Sizes of similar sets differ by one class at most; a band holds a class and the one above it.
    level = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(1.0000001 / similarity)))
    members = support.checkpoint(members.select("key", "name", "component", F.explode(F.array(level, level - 1)).alias("band")))
    open_ = members.groupBy("key", "band").agg(
        F.count(F.lit(1)).alias("there"), F.min("component").alias("least"), F.max("component").alias("most"),
        F.bit_xor(F.xxhash64(F.lit(95), "name")).alias("these"), F.bit_xor(F.xxhash64(F.lit(97), "name")).alias("those"),
    ).filter("least <> most")
    # Near copies share many shingles: groups of the same members are compared once.
    open_ = open_.groupBy("band", "there", "least", "most", "these", "those").agg(F.min("key").alias("key"))
    open_ = open_.select(F.col("key").alias("of"), F.col("band").alias("of_band"), F.ceil(F.col("there") / F.lit(BLOCK // 2)).cast("int").alias("blocks"))
    who = members.join(open_, (F.col("key") == F.col("of")) & (F.col("band") == F.col("of_band")))
    who = support.checkpoint(who.select("key", "band", "name", "component", "blocks", F.pmod(F.xxhash64(F.lit(91), "name"), F.col("blocks")).cast("int").alias("block")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    sent = who.select("key", "band", "name", "component", "block", other).select(
        "key", "band", "name", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    sent = sent.select(F.xxhash64("key", "band", "i", "j").alias("pair"), "i", "j", "block", "name", "component", "band")
    sets = _among(who.select(F.col("name").alias("u"), F.col("name").alias("v")), texts.select("name", "shingles"))

    def marks(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("name", "of_band", "n", "bits")}
        for name, band, data in zip(rows["name"], rows["level"], rows["shingles"]):
            tokens = unpacked(data)
            for of_band in (band, band - 1):
                # One length a band, which holds sizes below this one.
                places = support.power_of_two(4 * similarity ** -(of_band + 2))
                for n, value in zip(out, (name, of_band, len(tokens), bitmap(tokens, places))):
                    out[n].append(value)
        return out

    leveled = sets.withColumn("n", (F.length("shingles") / F.lit(KEPT)).cast("int"))
    marked = support.map_arrow(leveled.select("name", level.alias("level"), "shingles"), marks, "name long, of_band long, n int, bits binary")
    tested = sent.join(marked.withColumnRenamed("name", "named"), (F.col("name") == F.col("named")) & (F.col("band") == F.col("of_band")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places_of = pa.schema([(c, t) for c, t in zip(("pair", "i", "j", "block", "name", "component"), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))])

    def may_link(held: list[tuple]) -> pa.RecordBatch:
        pair, _, i, j, block, name, of, n = (np.array([x[k] for x in held], np.int64) for k in range(8))
        bits = np.frombuffer(b"".join(x[8] for x in held), np.uint8).reshape(len(held), -1)
        kept = np.flatnonzero(_possible(of, n, bits, np.flatnonzero(block == i), np.flatnonzero(block == j), similarity))
        return pa.RecordBatch.from_arrays([pa.array(x[kept], type=f.type) for x, f in zip((pair, i, j, block, name, of), places_of)], schema=places_of)

    ready = tested.select("pair", "band", "i", "j", "block", "name", "component", "n", "bits").repartition(parts, "pair").sortWithinPartitions("pair", "band")
    left = support.checkpoint(ready.mapInArrow(support.eased(_by_pair(may_link, 2)), "pair long, i int, j int, block int, name long, component long"))
    support.release(spark)
    sent = left.join(_among(left.select(F.col("name").alias("u"), F.col("name").alias("v")), sets.withColumnRenamed("name", "named"), "named"), F.col("name") == F.col("named"))
    arrow = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        _, i, j, block, names, of = (np.array([x[k] for x in held], np.int64) for k in range(6))
        found = _forest(names, of, [unpacked(x[6]) for x in held], np.flatnonzero(block == i), np.flatnonzero(block == j), similarity)
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], schema=arrow)

    sent = sent.select("pair", "i", "j", "block", "name", "component", "shingles")
    return sent.repartition(parts, "pair").sortWithinPartitions("pair").mapInArrow(support.eased(_by_pair(batch_of)), "u long, v long")


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent tokens in a share of the texts, sorted; the rank of each and about how many texts hold it."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        return {"token": np.concatenate([unpacked(x) for x in rows["shingles"]]).astype(np.int64)}

    some = texts.filter(F.pmod(F.xxhash64(F.lit(93), "k1"), F.lit(COUNTED_IN)) == 0).select("shingles")
    counted = support.map_arrow(some, work, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") >= LEAST_COUNT)
    found = counted.orderBy(F.desc("times"), "token").limit(COMMON).toArrow()
    token, times = (found[c].to_numpy() for c in ("token", "times"))
    at = np.argsort(token)
    return token[at].astype(np.uint64), (len(token) - 1 - at).astype(np.uint64), times[at] * COUNTED_IN


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row a document: doc_id and component_id, for links at a similarity of shingle sets."""
    spark = docs.sparkSession
    low = np.uint64((1 << 8 * KEPT) - 1)

    def name_of(words: list[bytes]) -> tuple[int, int]:
        same = xxhash.xxh128_intdigest(b" ".join(words))
        return (same >> 64) - (1 << 63), (same & ((1 << 64) - 1)) - (1 << 63)

    def work(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("doc_id", "k1", "k2", "fp", "shingles")}
        for key, text in zip(rows["doc_id"], rows["text"]):
            words = words_of(text)
            named = name_of(words)
            parts: list[np.ndarray] = []

            def hashes() -> Iterator[np.ndarray]:
                for x in shingle_hashes(words, shingle):  # noqa: B023
                    parts.append(np.unique(x & low))  # noqa: B023
                    yield x

            fp = int(np.uint64(majority(hashes())).view(np.int64))
            for n, value in zip(out, (key, *named, fp, packed(np.unique(np.concatenate(parts))) if parts else b"")):
                out[n].append(value)
        return out

    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    support.release(spark)
    # Each row is read once and has a number of its own; one row stands for all of its text, so that copies and sets are not moved.
    whole = support.map_arrow(given, work, "doc_id long, k1 long, k2 long, fp long, shingles binary")
    whole = support.written(whole.withColumn("name", F.monotonically_increasing_id()))
    named = support.checkpoint(whole.groupBy("k1", "k2").agg(F.min("name").alias("name"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    texts = _without(whole, named)

    # Through the anchors: one text stands for those of its fingerprint, and every link is confirmed by the sets.
    stands = support.checkpoint(texts.groupBy("fp").agg(F.min("name").alias("name")))
    same = texts.select("fp", F.col("name").alias("v")).join(stands.withColumnRenamed("name", "u"), "fp").filter("u <> v").select("u", "v")
    close = support.checkpoint(links(stands).unionByName(same))
    near = support.checkpoint(_linked_pairs(close, _among(close, texts.select("name", "shingles")), similarity))
    support.release(spark)

    # The exact way for links beyond the anchors' distance.
    common, rank, held_by = _common(texts)

    def keys(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("key", "part", "name", "n")}
        for name, data in zip(rows["name"], rows["shingles"]):
            tokens = unpacked(data)
            found = prefix(tokens, common, rank, similarity) if len(tokens) else tokens
            part = np.zeros(len(found), np.int32)
            if len(common):
                at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                hot = (common[at] == found) & (held_by[at] > GROUP)
                part[hot] = 1 + xxhash.xxh32_intdigest(name.to_bytes(8, "little")) % -(-held_by[at[hot]] // GROUP)
            for n, values in zip(out, (found.astype(np.int64), part, np.full(len(found), name), np.full(len(found), len(tokens), np.int32))):
                out[n].append(values)
        return {n: np.concatenate(values) for n, values in out.items()}

    keyed = support.map_arrow(texts.select("name", "shingles"), keys, "key long, part int, name long, n int")
    met = support.written(_meet(keyed, similarity))
    pairs = support.checkpoint(met.filter("n = 0").select("u", "v").distinct())
    del keyed
    support.release(spark)
    linked = _confirmed(pairs, texts, similarity, near)
    support.release(spark)
    rest = support.checkpoint(_rest(met.filter("n > 0").select(F.col("u").alias("key"), F.col("v").alias("name"), "n"), texts, linked, similarity))
    if rest.limit(1).count():
        linked = extended(linked, rest)
    placed = named.join(linked.withColumnRenamed("node", "named"), F.col("name") == F.col("named"), "left")
    placed = support.checkpoint(placed.select("k1", "k2", "least", F.coalesce("component", "name").alias("component")))
    ids = placed.groupBy(F.col("component").alias("of")).agg(F.min("least").alias("component_id"))
    placed = placed.join(ids, F.col("component") == F.col("of")).select(F.col("k1").alias("of1"), F.col("k2").alias("of2"), "component_id")
    found = whole.select("doc_id", "k1", "k2").join(placed, (F.col("k1") == F.col("of1")) & (F.col("k2") == F.col("of2"))).select("doc_id", "component_id")
    found = support.checkpoint(found)
    for table in (whole, met):
        support.drop(table)
    return found


def _without(whole: DataFrame, named: DataFrame) -> DataFrame:
    """The rows that stand for their text. Only marks of all others are moved, so that sets stay where they are."""
    again = whole.select("k1", "k2", F.col("name").alias("of")).join(named.filter("copies > 1").select("k1", "k2", "name"), ["k1", "k2"])
    return _marked(whole, again.filter("of <> name").select("of"), "left_anti")


def _confirmed(pairs: DataFrame, texts: DataFrame, similarity: float, known: DataFrame) -> DataFrame:
    """What the similar ones among the pairs (u, v) and the links ``known`` connect: (node, component).

    Shingle sets are large, so few of them are moved: bitmaps, a tenth of the size, rule out most pairs that are not
    similar. Then each text is confirmed with one partner, and further pairs only where that leaves them in different components.
    """

    def marks(rows: dict[str, list]) -> dict[str, list]:
        sets = [unpacked(x) for x in rows["shingles"]]
        return {"name": rows["name"], "n": [len(x) for x in sets], "bits": [bitmap(x) for x in sets]}

    def possible(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"u": [], "v": []}
        for u, v, n, bits, m, other in zip(*(rows[c] for c in ("u", "v", "n", "bits", "m", "other"))):
            both = most_common(n, bits, m, other)
            if both >= similarity * (n + m - both):
                out["u"].append(u)
                out["v"].append(v)
        return out

    marked = support.map_arrow(_among(pairs, texts.select("name", "shingles")), marks, "name long, n int, bits binary")
    both = pairs.join(marked.withColumnRenamed("name", "u"), "u").join(marked.select(F.col("name").alias("v"), F.col("n").alias("m"), F.col("bits").alias("other")), "v")
    left = support.checkpoint(support.map_arrow(both.select("u", "v", "n", "bits", "m", "other"), possible, "u long, v long"))
    sets = texts.select("name", "shingles")
    first = left.groupBy("v").agg(F.min("u").alias("u")).select("u", "v")
    linked = components(support.checkpoint(known.union(_linked_pairs(first, _among(first, sets), similarity))))
    rest = support.checkpoint(_apart(left.join(first, ["u", "v"], "left_anti"), linked))
    return extended(linked, support.checkpoint(_linked_pairs(rest, _among(rest, sets), similarity)))


def _among(pairs: DataFrame, texts: DataFrame, name: str = "name") -> DataFrame:
    """The texts (by ``name``) that some pair names. Only marks of their names are moved, so that the other texts' sets stay where they are."""
    return _marked(texts, pairs.select(F.explode(F.array("u", "v")).alias("of")), "left_semi", name)


def _marked(rows: DataFrame, names: DataFrame, how: str, name: str = "name") -> DataFrame:
    """The rows whose ``name`` is among ``names`` (``left_semi``), or the others (``left_anti``).

    Names number the rows of each partition, so a bit for each, in blocks of neighbours, says which are meant: the driver holds
    an eighth of a byte a row, however many are named. Beyond ``BROADCAST_BLOCKS`` the names are joined without a broadcast.
    """
    place = lambda x: F.col(x).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
    bits = F.substring(F.bitmap_construct_agg(place("of").cast("long")), 1, 1 << BLOCK_BITS - 3)
    blocks = support.checkpoint(names.groupBy(F.shiftright("of", BLOCK_BITS).alias("block_at")).agg(bits.alias("block_bits")))
    if blocks.count() > BROADCAST_BLOCKS:
        return rows.join(names.distinct(), F.col(name) == F.col("of"), how)
    byte = F.conv(F.hex(F.substring("block_bits", F.shiftright(place(name), 3) + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.getbit(byte, place(name).bitwiseAND(F.lit(7))) == 1
    return rows.join(F.broadcast(blocks), (F.shiftright(name, BLOCK_BITS) == F.col("block_at")) & marked, how)


def _apart(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """The pairs (u, v) that ``linked`` (node, component) leaves in different components."""
    for end in ("u", "v"):
        pairs = pairs.join(linked.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
    return pairs.filter("of_u is null or of_v is null or of_u <> of_v").select("u", "v")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: fingerprints of 3-word shingles, linked at two or fewer differing bits."""
    found = near_duplicates(support.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
