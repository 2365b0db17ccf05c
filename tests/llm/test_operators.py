"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on awkward tables."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ebbflow.llm import bpe, chat, components, gif, langid, mixing, pretokens, sharding, simhash, support, tokenfiles, topk, toxicity

AWKWARD = [
    (1, None, "en", "a", 0), (2, "", None, None, 0), (3, " \n\t ", "en", "a", 3), (4, "one two three", "en", "b", 1), (4, "one two three", "en", "b", 1), (5, "<|endoftext|> a  b", "de", "b", 2),
    (None, "one two three", None, "c", 2), (6, "wort " * 3000, "de", "a", 9), (7, "x" * 30_000, "fr", None, 9), (8, "123 456 !!! ²", "en", "a", 4), (9, "One  TWO\nthree", "en", "d", 5),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside.
CLASHING = ("size", "h", "sid", "bucket", "fp", "shard", "g", "key", "score", "v", "taken", "text__", "anchor", "name", "component", "slot")


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA).withColumns({n: F.lit(n) for n in CLASHING})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA).withColumns({n: F.lit(n) for n in CLASHING})


def invented(n, seed=0, words=40):
    rng = random.Random(seed)
    syllables = ["an", "er", "ti", "on", "es", "lo", "mi", "qu", "sch", "ou"]
    return [(i, " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(1, words))), "en", f"s{i % 5}", 0) for i in range(n)]


# --- 1 language ---


def test_language_held_out_accuracy(spark):
    rng = random.Random(1)
    stems = {"aa": ["kato", "kori", "kamu"], "bb": ["schen", "chung", "tsch"], "cc": ["eaux", "ille", "oire"]}
    rows = [(i, " ".join(rng.choice(stems[lang]) + rng.choice(stems[lang]) for _ in range(rng.randint(3, 20))), lang, "s", 0) for i, lang in enumerate(rng.choices(list(stems), k=300))]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(docs.filter("doc_id % 3 <> 0"))
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert len(got) == 300 and all(got[i]["lang_pred"] == lang for i, _, lang, _, _ in rows if i % 3 == 0)
    # An unseen word falls back to n-grams.
    assert langid.Scorer(model).text("Schentschung")[0] == "bb"


def test_language_on_awkward_rows(awkward, nothing):
    model = langid.fit(awkward)
    rows = langid.predict(awkward, model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {1, 2, 3, 8}
    assert langid.predict(nothing, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(awkward, langid.fit(nothing)).collect()} == {"und"}


# --- 2 mixing ---


def water_fill(sizes, cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        total = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / total > cap * sizes[s]]
        if not over:
            return target | {s: left * weights[s] / total for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            free.discard(s)
        left = sum(sizes.values()) - sum(target.values())
    return target


def test_mixing_targets_and_blocks(spark):
    rows = [(i, t, lang, None if i % 11 == 0 else ("big" if i % 3 else s), n) for i, t, lang, s, n in invented(400, 2)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), block_words=16).collect()
    size = {i: len(t.split()) for i, t, *_ in rows}
    source = {i: s for i, _, _, s, _ in rows}
    sizes = {}
    for i, s in source.items():
        sizes[s] = sizes.get(s, 0) + size[i]
    want = water_fill(sizes)
    taken = {}
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[source[r["doc_id"]]] and r["target"] == pytest.approx(want[source[r["doc_id"]]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] = taken.get(source[r["doc_id"]], 0) + r["taken"]
    assert len(got) == 400 and all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7), block_words=16).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mixing_points_beyond_a_long_product(spark):
    numbers = [0, 1, 3_474_000_000, 4_294_967_295, 4_294_967_296, 4_300_000_001, 15_000_000_000, 10**15 + 7]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in numbers], "n bigint").select(mixing.point(F.col("n"))).collect()]
    assert got == [n * mixing.GOLDEN % mixing.POINTS for n in numbers]


def plain_mix(rows, weights=(5, 2, 1), cap=3, block_words=16, h=None):
    """Words taken from each row, slot by slot along the schedule; ``h`` is the shuffle's key of each row."""
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(n for _, n, of in rows if of == s) for s in names}
    want = water_fill(sizes, cap)
    wanted = {s: min(int(want[s] + 0.5), sizes[s] * cap) for s in names}
    blocks = {s: max(1, -(-sizes[s] // block_words)) for s in names}
    slots = {s: (wanted[s] // sizes[s]) * blocks[s] + -(-(wanted[s] % sizes[s]) // block_words) if sizes[s] else 0 for s in names}
    total = sum(slots.values())
    ends = list(itertools.accumulate(slots[s] for s in names))
    order, left = [], dict(slots)
    for n in range(total):
        place = int(n * mixing.GOLDEN % mixing.POINTS / mixing.POINTS * total)
        s = names[sum(e <= place for e in ends)]
        order.append(s)
    taken = [0] * len(rows)
    for s in names:
        line = sorted((i for i, r in enumerate(rows) if r[2] == s), key=lambda i: (h[i] % h["buckets"], h[i], rows[i][0], rows[i][1]))
        words = [i for i in line for _ in range(rows[i][1])]
        for r in range(max(order.count(s), left[s]) if slots[s] else 0):
            if r >= slots[s]:
                break
            done = (r // blocks[s]) * sizes[s] + (r % blocks[s]) * block_words
            for i in words[(r % blocks[s]) * block_words :][: min(block_words, wanted[s] - done)]:
                taken[i] += 1
    return taken


def test_mixing_takes_what_a_plain_schedule_takes(spark):
    rows = [(i, t, lang, None if i % 11 == 0 else ("big" if i % 3 else s), n) for i, t, lang, s, n in invented(300, 5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    keys = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64(F.lit(17), "doc_id", "text").alias("h")).collect()}
    h = {k: keys[r[0]] for k, r in enumerate(rows)} | {"buckets": support.power_of_two(math.sqrt(len(rows)))}
    want = plain_mix([(i, len(t.split()), s) for i, t, _, s, _ in rows], h=h)
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(docs, block_words=16).collect()}
    assert [got[r[0]] for r in rows] == want


def test_mixing_on_awkward_rows(awkward, nothing):
    rows = mixing.mix(awkward).collect()
    assert len(rows) == len(AWKWARD) and all(r["taken"] <= 3 * r["size"] for r in rows) and mixing.mix(nothing).count() == 0


# --- 3 chat ---


def test_chat_parts_round_trip(spark):
    e = chat.ESC
    texts = ["plain", "<|im_end|><|im_start|>assistant ok", f"{e}e<{e}|<|{e}", "", "a<", "|b\n\n", "é" * 50]
    rows = [(1, i, "assistant" if i % 2 else f"us\ner<|{e}n", t) for i, t in enumerate(texts)] + [(2, 0, None, None), (None, 0, "user", "x")]
    plain = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_chat(plain)).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [(r, t) for _, _, r, t in rows[:7]]
    assert back[1]["loss_text"] == "".join(texts[1::2]) and [tuple(t) for t in back[2]["turns"]] == [("", "")] and len(back) == 3
    assert chat.digest(chat.format_chat(plain.limit(0))).count() == 0


def test_chat_attachments(spark):
    parts = [("text", "see ", None, None, None, None, None), ("image", None, "i.png", 57, 28, None, None), None, ("audio", None, "a.wav", None, None, 1.02, None), ("document", None, "d.pdf", None, None, None, 2), ("odd", None, "o", None, None, None, None), ("text", "end", None, None, None, None, None)]
    m = spark.createDataFrame([(1, 0, "assistant", parts)], f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")
    row = chat.format_chat(m).first()
    assert row["formatted"] == "<|im_start|>assistant\nsee <|image|><|audio|><|document|><|attachment|>end<|im_end|>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in row["attachments"]] == [("image", "i.png", 3), ("audio", "a.wav", 26), ("document", "d.pdf", 1024), ("odd", "o", 0)]
    assert chat.read_back(chat.format_chat(m)).first()["loss_text"] == "see end"


# --- 4 simhash ---


def fingerprint(text, k=3):
    words = simhash.WORD.findall((text or "").encode().translate(simhash.LOWER))
    if not words:
        return 0
    k = min(k, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(names, linked):
    parent = {n: n for n in names}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in names}


def test_anchors_bring_all_linked_fingerprints_together():
    rng = random.Random(4)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 2)):
            b ^= 1 << bit
        at = [set(simhash.anchors(np.array([x], np.uint64))[1].tolist()) for x in (a, b)]
        assert at[0] & at[1] and len(at[0]) in (2, 33) and all((x ^ a).bit_count() <= 2 for x in at[0])
        assert not simhash.syndromes(np.array(list(at[0]), np.uint64)).any()


def test_links_equal_brute_force(spark):
    rng, fps = random.Random(5), []
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 60)):
            fps.append(base)
            base ^= (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) if rng.random() < 0.7 else rng.getrandbits(6)
    fps = sorted(set(fps))
    rows = [(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)]
    found = components.components(simhash.links(spark.createDataFrame(rows, "fp bigint, name bigint"))).collect()
    got = {i: i for i in range(len(fps))} | {r["node"]: r["component"] for r in found}
    want = classes(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    assert got == want and len(set(got.values())) < len(fps)


def test_simhash_on_awkward_rows(awkward, nothing):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD)
    text = {i: t for i, t, *_ in AWKWARD}
    for r in rows:
        assert int(np.int64(r["fp"]).view(np.uint64)) == fingerprint(text[r["doc_id"]])
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert by[1] == by[2] == by[3] == 1 and by[9] == by[4] == by[None] == 4
    assert simhash.near_duplicates(nothing).count() == 0


def test_similar_documents_equal_brute_force(spark):
    rng, rows = random.Random(6), []
    for g in range(30):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 5)):
            rows.append((len(rows), " ".join(words), "en", "s", 0))
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(500)}"
    rows += [(len(rows) + k, "same text again", "en", "s", 0) for k in range(40)] + [(1000, "short", "en", "s", 0), (1001, None, "en", "s", 0), (1002, " ", "en", "s", 0)]
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").lower().split()
        sets[i] = {" ".join(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set()
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    want = classes(sets, [(a, b) for a in sets for b in sets if b < a and near(sets[a], sets[b])])
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def shingle_sets(rows):
    sets = {}
    for i, t, *_ in rows:
        w = t.split()
        sets[i] = {" ".join(w[a : a + 5]) for a in range(max(1, len(w) - 4))}
    return sets


def test_similar_documents_find_all_variants_of_a_hub(spark, monkeypatch):
    """Variants are near the original, not each other, and all share most shingles; groups are cut into parts."""
    monkeypatch.setattr(simhash, "GROUP", 100)
    rng = random.Random(8)
    words = [f"w{k}" for k in range(50)]
    rows = [(0, " ".join(words), "en", "s", 0)]
    for k in range(1, 1101):
        at = rng.randrange(5, 45)
        rows.append((k, " ".join([*words[:at], f"n{k}", *words[at + 1 :]]), "en", "s", 0))
    sets = shingle_sets(rows)
    assert all(len(sets[0] & x) >= 0.8 * len(sets[0] | x) for x in sets.values())
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == dict.fromkeys(sets, 0)


def test_similar_documents_find_short_texts_at_the_very_similarity(spark):
    rows = []
    for k in range(1500):
        words = [f"t{k}x{i}" for i in range(9)]
        rows += [(2 * k, " ".join(words), "en", "s", 0), (2 * k + 1, " ".join(words[:8]), "en", "s", 0)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: i - i % 2 for i, *_ in rows}


def test_similar_documents_pass_on_real_links_of_groups(spark):
    """Chains that share one passage, where neighbours are near and ends are not, against brute force."""
    rng, rows = random.Random(9), []
    for g in range(3):
        words = [f"c{k}" for k in range(30)] + [f"g{g}w{k}" for k in range(30)]
        for _ in range(12):
            rows.append((len(rows), " ".join(words), "en", "s", 0))
            words = list(words)
            words[rng.randrange(60)] = f"m{len(rows)}"
    sets = shingle_sets(rows)
    want = classes(sets, [(a, b) for a in sets for b in sets if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_similar_documents_with_one_id_for_different_texts(spark):
    a, b = ([f"{x}{k}" for k in range(60)] for x in "ab")
    rows = [(1, " ".join(a), "en", "s", 0), (1, " ".join(b), "en", "s", 0), (2, " ".join(a[:-1]), "en", "s", 0), (3, " ".join(b[:-1]), "en", "s", 0), (None, " ".join(b[1:]), "en", "s", 0)]
    got = sorted(map(tuple, simhash.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (None, 1)]


def test_similar_documents_on_awkward_rows(awkward, nothing):
    assert simhash.similar_documents(awkward).count() == len(AWKWARD) and simhash.similar_documents(nothing).count() == 0


# --- 5 GIF ---


@pytest.mark.parametrize("n", [1, 254, 255, 512, 4000, 70_000])
def test_lzw_round_trip(n):
    rng = np.random.default_rng(n)
    for pixels in (rng.integers(0, 256, n), rng.integers(0, 2, n), np.zeros(n)):
        pixels = pixels.astype(np.uint8)
        assert np.array_equal(gif.lzw_decode(gif.lzw_literals(pixels), 8, n), pixels)
        assert np.array_equal(gif.lzw_decode(gif.lzw_search(pixels), 8, n), pixels)
    assert len(gif.lzw_decode(gif.lzw_search(pixels)[: n // 9], 8, n)) <= n


def deferred(pixels):
    """An LZW stream that goes on with 12-bit codes when the table is full, without a clear code."""
    table, codes, widths, width, prefix = {bytes([b]): b for b in range(256)}, [256], [9], 9, b""
    entry = 258
    for b in pixels.tolist():
        longer = prefix + bytes([b])
        if longer in table:
            prefix = longer
            continue
        codes.append(table[prefix])
        widths.append(width)
        if entry < 4096:
            table[longer] = entry
            entry += 1
            width += entry > 1 << width and width < 12
        prefix = bytes([b])
    return gif._pack(np.array([*codes, table[prefix], 257]), np.array([*widths, width, width])), len(codes)


def test_gif_deferred_clear(spark):
    pixels = np.random.default_rng(12).integers(0, 256, 250 * 200).astype(np.uint8)
    stream, codes = deferred(pixels)
    assert codes > 4 * 8192 and np.array_equal(gif.lzw_decode(stream, 8, len(pixels)), pixels)
    assert np.array_equal(gif.lzw_decode(stream, 8, 30_001), pixels[:30_001])
    data = gif.write_gif((250, 200), [np.zeros((0, 250), np.uint8)], [1])[:13 + 768] + b"\x2c" + np.array([0, 0, 250, 200], "<u2").tobytes() + b"\0\x08" + gif._blocks(stream) + b"\x3b"
    (row,) = gif.frames(spark.createDataFrame([(1, data)], "media_id bigint, bytes binary")).collect()
    assert row["error"] is None and row["red"] == np.bincount(pixels // 32, minlength=8).tolist()


def test_gif_disposal_transparency_interlace():
    def image(left, top, rows, columns, pixels, disposal=1, clear=None, interlace=False, palette=None):
        head = b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None), 7, 0, clear or 0]) + b"\0"
        flags = (0x40 if interlace else 0) | (0x81 if palette else 0)
        box = np.array([left, top, columns, rows], "<u2").tobytes()
        return head + b"\x2c" + box + bytes([flags]) + (palette or b"") + b"\x02" + gif._blocks(gif.lzw_search(np.array(pixels, np.uint8), 2))

    start = b"GIF89a" + np.array([2, 8], "<u2").tobytes() + b"\x81\0\0" + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    data = start + image(0, 0, 8, 2, [1] * 16) + image(0, 0, 1, 2, [2, 3], disposal=2, clear=3) + image(0, 1, 1, 1, [3], disposal=3) + image(1, 0, 8, 1, [0, 1, 2, 3, 0, 1, 2, 3], interlace=True, palette=bytes(range(12)) ) + b"\x3b"
    shown = [(f.delay_cs, f.canvas.copy()) for f in gif.read_gif(data)]
    assert [d for d, _ in shown] == [7] * 4
    assert (shown[0][1] == [255, 0, 0, 255]).all()
    assert shown[1][1][0].tolist() == [[0, 255, 0, 255], [255, 0, 0, 255]]
    assert shown[2][1][0].tolist() == [[0, 0, 0, 0]] * 2 and shown[2][1][1, 0].tolist() == [0, 0, 255, 255]
    assert shown[3][1][1, 0].tolist() == [255, 0, 0, 255]
    assert [int(x) for x in shown[3][1][:, 1, 0] // 3] == [0, 0, 2, 1, 1, 2, 3, 3]


def test_gif_frames_on_awkward_rows(spark):
    good = gif.store_payload(bytes(range(64)) * 300)
    rows = [(1, good), (1, good), (2, None), (3, b"no"), (4, good[:900])]
    found = gif.frames(spark.createDataFrame(rows, "media_id bigint, bytes binary").withColumn("frame", F.lit(0))).collect()
    assert sum(r["media_id"] == 1 for r in found) == 4 and [bool(r["error"]) for r in found if r["media_id"] in (2, 3)] == [True, True]
    assert {r["start_cs"] for r in found if r["media_id"] == 1} == {0, 10} and sum(found[0]["red"]) == 64 * 256
    assert gif.frames(spark.createDataFrame([], "media_id bigint, bytes binary")).count() == 0


def test_gif_sizes_are_bounded(spark):
    good = gif.store_payload(bytes(range(64)) * 300)
    huge = good[:6] + b"\xff" * 4 + good[10:]
    second = good.rindex(b"\x2c" + np.array([0, 0, 64, 44], "<u2").tobytes())
    midway = good[: second + 5] + b"\xff" * 4 + good[second + 9 :]
    found = gif.frames(spark.createDataFrame([(1, huge), (2, midway)], "media_id bigint, bytes binary")).orderBy("media_id", F.col("error").isNotNull()).collect()
    assert [(r["media_id"], r["frame"], bool(r["error"])) for r in found] == [(1, None, True), (2, 0, False), (2, None, True)]
    assert gif.frames(spark.createDataFrame([(1, good)], "media_id bigint, bytes binary"), max_pixels=100).collect()[0]["error"]


def plain_gif(data):
    """The samples of a grey-scale GIF without interlace, code by code from a dictionary, and how many codes were entries of the table."""
    at, out, entries = 13 + 768, b"", 0
    while data[at] != 0x3B:
        assert data[at : at + 2] == b"\x21\xf9"
        at += 8
        assert data[at] == 0x2C and data[at + 9] == 0 and data[at + 10] == 8
        at += 11
        body = b""
        while data[at]:
            body += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        at += 1
        stream, place, width, last, table = int.from_bytes(body, "little"), 0, 9, None, {}
        while (code := stream >> place & ((1 << width) - 1)) != 257:
            place += width
            if code == 256:
                table, width, last = {b: bytes([b]) for b in range(256)} | {256: b"", 257: b""}, 9, None
                continue
            entries += code > 257
            got = table.get(code, None if last is None else last + last[:1])
            if last is not None and len(table) < 4096:
                table[len(table)] = last + got[:1]
            out, last = out + got, got
            width += len(table) == 1 << width and width < 12
    return out, entries


def test_gif_stored_form_is_read_by_a_plain_decoder():
    rng = np.random.default_rng(3)
    for payload in (bytes(64), b"the quick brown fox " * 64, rng.integers(0, 256, 64 * 700).astype(np.uint8).tobytes(), rng.integers(97, 101, 64 * 2000).astype(np.uint8).tobytes()):
        stored = gif.store_payload(payload)
        found, entries = plain_gif(stored)
        assert found == payload and gif.load_payload(stored)[0] == payload and entries
        assert plain_gif(gif.store_payload(payload, compress=False)) == (payload, 0)


def test_gif_payload_query(spark, tmp_path, awkward):
    awkward.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    text = {i: t for i, t, *_ in AWKWARD}
    rows = gif.op5_gif_media(spark, str(tmp_path)).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        raw = (text[r["doc_id"]] or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        stored = gif.store_payload(padded)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert [int(x) for x in r["feature"].split()] == np.bincount(np.frombuffer(padded, np.uint8) // 32, minlength=8).tolist()


# --- 6 top-k ---


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.choice([-0.5, 0.25, 0.1], 6).tolist()) for i in range(900)] + [(50, [1.0] * 6), (1000, [0.5, 0.5]), (1001, [0.5, 0.25]), (2000, None), (2100, [1.0, None]), (2200, [float("nan")] * 6), (2300, [float("inf")] * 6), (None, [1.0] * 6), (2400, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({"score": F.lit(1), "rank": F.lit(2), "v": F.lit(3)})
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect())
    ok = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in ok:
        if q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b))[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_topk_large_components(spark):
    df = spark.createDataFrame([(0, [3.0e9, -1.0]), (1, [2.0e9, 1.0]), (2, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in sorted(topk.top_k(df, F.col("vec_id") == 0, k=2).collect(), key=lambda r: r["rank"])] == [(1, min(2**63 - 1, 1024 * 1024 * 6 * 10**18 - 1024 * 1024)), (2, 1024 * 1024 * 3 * 10**9 - 1024 * 1024)]


# --- 7 shards ---


def test_shards_are_even_and_keep_groups(spark):
    rows = [(i, t, "en", "s", 0) for i, t, *_ in invented(700, 7)] + [(1000 + i, f"copy {i % 30}", "en", "s", 0) for i in range(300)] + [(2000 + i, "hot", "en", "s", 0) for i in range(503)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA), shards=10).collect()
    text = {i: t for i, t, *_ in rows}
    by, where = {}, {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        where.setdefault(text[r["doc_id"]], set()).add(r["shard"])
        raw = text[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "rows" and r["grown_shard"] is None
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sum(len(where[f"copy {i}"]) > 1 for i in range(30)) <= 3 and len(where["hot"]) <= 6
    again = sharding.shard(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5), shards=10).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


@pytest.mark.parametrize("sizes", [[2 + k % 9 for k in range(300)], [900, 900], [150] * 12])
def test_shards_keep_groups_where_every_row_has_a_copy(spark, sizes):
    rows = [(i, f"text {g}") for i, g in enumerate(g for g, n in enumerate(sizes) for _ in range(n))]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), shards=10).collect()
    text, where, count = dict(rows), {}, {}
    for r in got:
        where.setdefault(text[r["doc_id"]], set()).add(r["shard"])
        count[r["shard"]] = count.get(r["shard"], 0) + 1
    assert len(got) == len(rows) and max(count.values()) - min(count.values()) <= 1 and len(count) == 10
    quota, spare = len(rows) // 10, [len(where[f"text {g}"]) - -(-n // (len(rows) // 10)) for g, n in enumerate(sizes)]
    assert quota and sum(max(0, x) for x in spare) <= 9 and max(map(len, where.values())) <= -(-max(sizes) // quota) + 1


def test_shards_on_awkward_rows(awkward, nothing):
    rows = sharding.shard(awkward, shards=4).collect()
    assert len(rows) == len(AWKWARD) and sorted(r["shard"] for r in rows) == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3] and sharding.shard(nothing).count() == 0


# --- 8 token files, 10 BPE ---


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.public_tokenizer())


def test_token_files_round_trip(spark, awkward, nothing, library, tmp_path):
    path = str(tmp_path / "shards")
    tokenfiles.write(awkward, path, bpe.public_tokenizer(), 3, shard_ids=40)
    text = sorted(((i is not None, i or 0, t or "") for i, t, *_ in AWKWARD), key=lambda r: r[:2])
    start, want = 0, []
    for known, i, t in text:
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        want.append((i if known else -1, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [(-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenfiles.read(spark, path).collect()]
    assert sorted(got) == sorted(want)
    found = tokenfiles.lookup(spark, path, [4, 9, 77]).collect()
    assert sorted(r["key"] for r in found) == [4, 4, 9] and found[0]["ids"][-1] == 2
    tokenfiles.write(nothing, str(tmp_path / "none"), bpe.public_tokenizer(), 3)
    assert tokenfiles.read(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000, 20_000])
def test_perfect_hash_is_minimal(n):
    keys = np.arange(n) * 7 - 3
    hashes = tokenfiles.key_hash(keys, np.zeros(n, bool), np.zeros(n, np.int64))
    pilots, slots = tokenfiles.build_index(hashes)
    assert sorted(slots.tolist()) == list(range(n)) and np.array_equal(tokenfiles.slot_of(hashes, pilots, n), slots)
    shard = tokenfiles.Shard(tokenfiles.shard_image(keys.tolist(), [np.array([k % 50_000], np.uint32).tobytes() for k in keys], 2))
    assert all(shard.get(int(k)).tolist() == [k % 50_000] for k in keys[:50]) and shard.get(10**9) is None


def test_bpe_equals_the_library(library):
    rng = random.Random(8)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "é", "ß", "中", "1", "²", "!", "<|endoftext|>", "----", " ", " ", "\x1c", "\x85", "́", "😀", "ing", "Ⅰ", "\x00"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3000)] + ["a" * 3000, " " * 999, "abab" * 800, "".join(rng.choices("aeinorst", k=5000))]
    own = bpe.ByteBPE(open(bpe.public_tokenizer(), encoding="utf-8").read())
    got = [np.frombuffer(x, np.uint32) for run in bpe.in_slices(texts, 5000) for x in own.encode_batch(run)]
    for text, ids, want in zip(texts, got, library.encode_batch(texts, add_special_tokens=False)):
        assert ids.tolist() == want.ids and own.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_compatibility_decides_like_merging():
    own = bpe.ByteBPE(open(bpe.public_tokenizer(), encoding="utf-8").read())
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 2000, 3000), rng.integers(0, 2000, 3000)
    spoken = {r: t for t, r in own.rank_of.items()}
    assert own.compatible(a, b).tolist() == [own.merge(spoken[x] + spoken[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]


def test_bpe_on_awkward_rows(awkward, nothing, library):
    rows = bpe.encode_decode_digest(awkward, bpe.public_tokenizer()).collect()
    text = {i: t or "" for i, t, *_ in AWKWARD}
    for r in rows:
        ids = library.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text[r["doc_id"]].encode()).hexdigest())
    assert len(rows) == len(AWKWARD) and bpe.encode_decode_digest(nothing, bpe.public_tokenizer()).count() == 0
    back = bpe.decode(bpe.encode(awkward, bpe.public_tokenizer()), bpe.public_tokenizer()).collect()
    assert all(r["text"] == text[r["doc_id"]] for r in back)


def test_pieces_cut_only_where_tokens_end():
    rng = random.Random(10)
    for _ in range(2000):
        text = "".join(rng.choices(["a", "'s", " ", "\n", "\t", "1", "!"], k=rng.randint(0, 12)))
        found, safe = pretokens.pieces(text)
        if safe:
            joined = [t for k, p in enumerate(found) for t in pretokens.PATTERN.findall(p if not k else " " + p)]
            assert joined == pretokens.PATTERN.findall(text), text


# --- 9 toxicity ---


def test_toxicity_held_out(spark):
    rng = random.Random(11)
    rows = [(i, t + (" vile words here" if i % 4 == 0 else ""), "en", "s", 0) for i, t, *_ in invented(1200, 11)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, *_ in rows if rng.random() < 0.7] + [(5, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(toxicity.with_labels(docs.filter(~toxicity.is_held_out()), labels))
    got = {r["doc_id"]: r for r in toxicity.predict(docs, model).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["predicted"] == int(i % 4 == 0) == int(got[i]["score"] >= 0.3) for i in held) and len(model.features) < 3000


def test_toxicity_on_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 1), (6, 0)], "doc_id bigint, toxic int")
    model = toxicity.fit(toxicity.with_labels(awkward, labels))
    rows = toxicity.predict(awkward, model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in rows) and toxicity.predict(nothing, model).count() == 0
    assert {r["score"] for r in toxicity.predict(awkward, toxicity.fit(toxicity.with_labels(nothing, labels))).collect()} == {0.5}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (201, 200)], "u bigint, v bigint")
    assert {r["node"]: r["component"] for r in components.components(edges).collect()} == {i: 0 for i in range(61)} | {200: 200, 201: 200}


def test_power_of_two():
    assert [support.power_of_two(x) for x in (0, 1, 2, 3, 1024, 1025)] == [1, 1, 2, 4, 1024, 2048]


@pytest.mark.parametrize("sizes", [(10, 40, 200), (1000,)])
def test_similar_documents_lose_no_link_by_group_size(spark, sizes):
    """Pairs of near copies that share one long passage with all others of their group, which are not near; against brute force."""
    rng, rows = random.Random(sum(sizes)), []
    for g, n in enumerate(sizes):
        passage = [f"g{g}p{k}" for k in range(60)]
        for k in range(n // 2):
            own = [f"g{g}o{k}w{i}" for i in range(rng.randint(12, 16))]
            other = list(own)
            other[-1] = f"x{k}"
            rows += [(len(rows), " ".join(passage + own), "en", "s", 0), (len(rows) + 1, " ".join(passage + other), "en", "s", 0)]
    sets = shingle_sets(rows)
    ids = sorted(sets)
    numbers = {}
    matrix = np.zeros((len(ids), len({x for s in sets.values() for x in s})), np.float32)
    for i in ids:
        matrix[i, [numbers.setdefault(x, len(numbers)) for x in sets[i]]] = 1
    both, size = matrix @ matrix.T, matrix.sum(axis=1)
    near = both >= 0.8 * (size[:, None] + size[None, :] - both) - 1e-6
    want = classes(ids, [(a, b) for a, b in zip(*(x.tolist() for x in np.nonzero(near))) if b < a])
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want and len(set(want.values())) > len(rows) // 20


def test_packed_sets_round_trip():
    tokens = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 500).astype(np.uint64))
    assert np.array_equal(simhash.unpacked(simhash.packed(tokens)), tokens) and simhash.unpacked(b"").size == 0


def test_bitmaps_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(5)
    for n in (1, 7, 60, 63, 65, 1000, 5000):
        a = np.unique(rng.integers(0, 1 << 40, n).astype(np.uint64))
        for keep in (0.1, 0.5, 0.82, 1.0):
            b = np.unique(np.concatenate([a[: max(1, int(keep * n))], rng.integers(0, 1 << 40, n // 9).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            bound = simhash.most_common(len(a), simhash.bitmap(a), len(b), simhash.bitmap(b))
            assert both <= bound <= min(len(a), len(b)) and (keep != 0.5 or n < 1000 or bound < 0.8 * len(a))


def test_names_of_rows_are_broadcast_as_bits(spark, monkeypatch):
    """What the driver holds of the rows that pairs name is a bit a row, however many are named; beyond the limit nothing is broadcast."""
    rows = spark.range(0, 60_000, 1, 7).select(F.monotonically_increasing_id().alias("name"), "id")
    names = [r["name"] for r in rows.collect()]
    held = []
    broadcast = F.broadcast
    monkeypatch.setattr(simhash.F, "broadcast", lambda df: held.append(df.count()) or broadcast(df))
    for chosen in ([], names[3:9], random.Random(4).sample(names, 40_000), names):
        pairs = spark.createDataFrame([(x, x) for x in chosen], "u bigint, v bigint")
        assert sorted(r["name"] for r in simhash._among(pairs, rows).collect()) == sorted(chosen)
        assert held.pop() <= 14 and not held
    monkeypatch.setattr(simhash, "BROADCAST_BLOCKS", 1)
    assert sorted(r["name"] for r in simhash._among(pairs, rows).collect()) == sorted(names) and not held


def test_release_gives_the_memory_of_the_driver_outside_its_heap_back(spark):
    support.release(spark)
    assert support.trim(spark)


def rows_joined(spark, work):
    """How many rows the joins of ``work`` made, by Spark's own counts."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    each = lambda seq: [seq.apply(i) for i in range(seq.size())]
    bus.waitUntilEmpty()
    seen = {x.executionId() for x in each(store.executionsList())}
    work()
    bus.waitUntilEmpty()
    made = 0
    for run in (x.executionId() for x in each(store.executionsList()) if x.executionId() not in seen):
        values = store.executionMetrics(run)
        for node in each(store.planGraph(run).allNodes()):
            for metric in each(node.metrics()) if "Join" in node.name() else []:
                if metric.name() == "number of output rows" and (found := values.get(metric.accumulatorId())).isDefined():
                    made += int(found.get().replace(",", ""))
    return made


def test_components_join_each_edge_about_once(spark):
    """Dense groups are done with after a round, however many rounds a long chain beside them needs."""
    rng = random.Random(3)
    pairs = list({tuple(sorted(rng.sample(range(1000 * g, 1000 * g + 100), 2))) for g in range(4) for _ in range(1000)})
    chain = list(range(9000, 9100))
    rng.shuffle(chain)
    edges = support.checkpoint(spark.createDataFrame(pairs + list(zip(chain, chain[1:])), "u bigint, v bigint"))
    got = {}
    made = rows_joined(spark, lambda: got.update({r["node"]: r["component"] for r in components.components(edges).collect()}))
    ids = {x for p in pairs for x in p} | set(chain)
    assert got == classes(ids, [*pairs, *zip(chain, chain[1:])])
    assert len(pairs) <= made <= 3.5 * len(pairs)


def test_components_extended_by_edges(spark):
    rng = random.Random(5)
    for n in (0, 3, 40, 90):
        one, two = ([(rng.randrange(100), rng.randrange(100)) for _ in range(k)] for k in (n, 90 - n))
        known = components.components(spark.createDataFrame(one, "u bigint, v bigint"))
        got = {r["node"]: r["component"] for r in components.extended(known, spark.createDataFrame(two, "u bigint, v bigint")).collect()}
        ids = {x for a, b in one + two if a != b for x in (a, b)}
        assert got == classes(ids, [p for p in one + two if p[0] != p[1]])


def test_first_round_pairs_grow_with_a_group_and_not_with_its_square(spark):
    """Near copies share many prefix shingles, each of which makes them a group."""
    found = []
    for n in (400, 800):
        keyed = spark.range(400).selectExpr("xxhash64(id) as key").crossJoin(spark.range(n).selectExpr("id as name")).selectExpr("key", "0 as part", "name", "2000 as n")
        met = simhash._meet(keyed, 0.8)
        found.append(met.filter("n = 0").select("u", "v").distinct().count())
        assert met.filter("n > 0").count() == 400 * n
    assert found[0] >= 399 and found[1] <= 2.5 * found[0]
