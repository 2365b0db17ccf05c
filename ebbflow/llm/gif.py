"""Media columns: GIF files decoded to timed frames with colour histograms.

The decoder covers LZW code streams of every code size (growing codes, clear codes, deferred clears, codes that refer to the string being
built), global and local palettes, interlace, transparency, the disposal rules (keep, restore to background, restore
to previous) and delays. Codes are unpacked and strings expanded with array operations: an LZW string is the string of
an earlier code and the byte after it, and both lie side by side in the output, so every output byte points back to an
earlier one and pointer doubling resolves all of them at once.

The encoder writes lossless 8-bit frames as searched LZW streams that use the table. ``compress=False`` emits literal codes only
and clears the table before the codes would grow, which any decoder reads and which needs no search, but takes 9/8 of the samples.

``frames`` is the media operator: one row a frame with its delay and histogram, for a column of GIF bytes. Defined
results: null bytes and bytes that are no GIF give one row with a null frame and ``error`` set; a file that fails midway
gives its frames so far and then such a row; so does one whose header declares a canvas or an image of more than
``max_pixels`` pixels, before any memory is taken for it; a stream cut short keeps the pixels that it has and leaves the rest at index 0; equal rows stay separate rows; an empty table gives no rows;
other columns are ignored, whatever their names.

Texts as media (``op5_gif_media``): UTF-8 bytes with zeros up to a positive multiple of 64 become grey-scale samples,
64 in a row and at most ``FRAME_ROWS`` rows in a frame; a text of any length is stored whole in as many frames as it
takes. A null text is the empty text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.llm import support

WIDTH, FRAME_ROWS, DELAY = 64, 256, 10
#: Literals between clear codes: one less than what would make 8-bit streams use 10-bit codes.
LITERALS = 254
MAX_CODES = 4096
#: Pixels that a canvas or an image may have (at 4 bytes each).
MAX_PIXELS = 1 << 24
BINS = 8
#: Fixed value: first row and step of the four interlace passes.
INTERLACE = ((0, 8), (4, 8), (2, 4), (1, 2))


@dataclass
class Frame:
    """What is shown: RGBA pixels of the whole canvas, and the rectangle that this frame's image covers."""

    index: int
    delay_cs: int
    disposal: int
    box: tuple[int, int, int, int]
    canvas: np.ndarray


# --- LZW ------------------------------------------------------------------------------------------------------------


def _code_starts(count: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit offsets and widths of the first ``count`` codes after a clear, for minimum code size ``size``."""
    table = (1 << size) + 2 + np.maximum(np.arange(count) - 1, 0)
    widths = np.clip(np.ceil(np.log2(table + 1)), size + 1, 12).astype(np.int64)
    starts = np.cumsum(widths) - widths
    return starts, widths


_STARTS = {size: _code_starts(MAX_CODES * 2, size) for size in range(2, 9)}


def _expand(codes: np.ndarray, base: int, first_entry: int, most: int) -> np.ndarray:
    """Output of the codes between two clears: literals below ``base``, entries from ``first_entry`` on.

    Codes after the one that reaches ``most`` bytes are left out.
    """
    n = len(codes)
    if not n or (literal := codes < base).all():
        return codes.astype(np.uint8)
    # Entry k is the string of code k - first_entry and one byte more.
    parent = np.where(literal, -1, codes - first_entry)
    if (parent >= np.arange(n)).any():
        raise ValueError("code beyond the table")
    size, up = np.ones(n, np.int64), parent.copy()
    while (live := up >= 0).any():
        size[live] += size[up[live]]
        up[live] = up[up[live]]
    ends = np.cumsum(size)
    n = min(n, int(np.searchsorted(ends, most)) + 1)
    codes, literal, parent, size, ends = codes[:n], literal[:n], parent[:n], size[:n], ends[:n]
    starts = ends - size
    # An entry's bytes are those from its parent's start on; literals are fixed points.
    which = np.repeat(np.arange(n), size)
    at = np.arange(ends[-1])
    source = np.where(literal[which], at, starts[np.maximum(parent, 0)][which] + at - starts[which])
    while not np.array_equal(deeper := source[source], source):
        source = deeper
    return codes[which[source]].astype(np.uint8)


def lzw_decode(data: bytes, size: int, most: int) -> np.ndarray:
    """At most ``most`` indices from an LZW stream of minimum code size ``size``; a damaged rest is left out."""
    starts, widths = _STARTS[size]
    clear, stop = 1 << size, (1 << size) + 1
    raw = np.frombuffer(data + bytes(4), np.uint8).astype(np.uint32)
    window = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16)
    total, at, out, held = 8 * len(data), 0, [], 0
    guess = 512
    while held < most and at + size + 1 <= total:
        if guess > len(starts):
            # The table is full and not cleared: 12-bit codes go on.
            starts, widths = _code_starts(guess, size)
        n = min(guess, int(np.searchsorted(starts + widths, total - at, side="right")))
        bits = at + starts[:n]
        codes = (window[bits >> 3] >> (bits & 7).astype(np.uint32)).astype(np.int64) & ((1 << widths[:n]) - 1)
        ends = np.flatnonzero((codes == clear) | (codes == stop))
        if not len(ends) and n == guess:
            guess *= 4
            continue
        k = int(ends[0]) if len(ends) else n
        part = codes[:k]
        try:
            got = _expand(part, clear, stop + 1, most - held)
        except ValueError:
            bad = int(np.flatnonzero(np.where(part < clear, -1, part - stop - 1) >= np.arange(k))[0])
            out.append(_expand(part[:bad], clear, stop + 1, most - held))
            break
        out.append(got)
        held += len(got)
        if not len(ends) or codes[k] == stop:
            break
        at += int(starts[k] + widths[k])
        guess = 512 if k < 512 else MAX_CODES * 2
    return np.concatenate(out)[:most] if out else np.zeros(0, np.uint8)


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    bits = ((codes[:, None] >> np.arange(12)) & 1).astype(np.uint8)
    return np.packbits(bits[np.arange(12) < widths[:, None]], bitorder="little").tobytes()


def lzw_literals(pixels: np.ndarray) -> bytes:
    """8-bit samples as 9-bit literal codes, a clear code before every ``LITERALS`` of them."""
    n = len(pixels)
    rows = -(-n // LITERALS)
    grid = np.zeros((rows, LITERALS + 1), np.uint16)
    grid[:, 0] = 256
    flat = np.zeros(rows * LITERALS, np.uint16)
    flat[:n] = pixels
    grid[:, 1:] = flat.reshape(rows, LITERALS)
    codes = np.append(grid.reshape(-1)[: n + rows], 257)
    padded = np.zeros(-(-len(codes) // 8) * 8, np.uint32)
    padded[: len(codes)] = codes
    eights = padded.reshape(-1, 8)
    out = np.zeros((len(eights), 9), np.uint8)
    for k in range(9):
        low = eights[:, k] << np.uint32(k) if k < 8 else 0
        high = eights[:, k - 1] >> np.uint32(9 - k) if k else 0
        out[:, k] = (low | high) & 0xFF
    return out.tobytes()[: -(-9 * len(codes) // 8)]


def lzw_search(pixels: np.ndarray, size: int = 8) -> bytes:
    """An LZW stream that uses the table, which is cleared when it is full."""
    clear, stop = 1 << size, (1 << size) + 1
    codes, runs = [clear], []
    emit = codes.append
    table: dict[int, int] = {}
    known = table.get
    entry, prefix, begin = stop + 1, -1, 1
    for b in pixels.tolist():
        if prefix < 0:
            prefix = b
            continue
        key = prefix << 8 | b
        code = known(key)
        if code is not None:
            prefix = code
            continue
        emit(prefix)
        if entry < MAX_CODES:
            table[key] = entry
            entry += 1
        else:
            emit(clear)
            runs.append(len(codes) - begin)
            begin = len(codes)
            table.clear()
            entry = stop + 1
        prefix = b
    if prefix >= 0:
        emit(prefix)
    emit(stop)
    runs.append(len(codes) - begin)
    # A code's width follows from its place after the clear code.
    widths = _STARTS[size][1]
    return _pack(np.array(codes), np.concatenate([[size + 1], *(widths[:n] for n in runs)]))


# --- Files ----------------------------------------------------------------------------------------------------------


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


GREY = bytes(v for i in range(256) for v in (i, i, i))


def write_gif(size: tuple[int, int], images: list[np.ndarray], delays: list[int], compress: bool = True, palette: bytes = GREY) -> bytes:
    """A GIF of 8-bit images (rows by columns) at the top left of the canvas, each kept when the next is drawn."""
    out = [b"GIF89a", struct.pack("<HHBBB", *size, 0xF7, 0, 0), palette]
    for image, delay in zip(images, delays):
        rows, columns = image.shape
        flat = np.ascontiguousarray(image).reshape(-1)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, columns, rows, 0))
        out.append(b"\x08" + _blocks(lzw_search(flat) if compress else lzw_literals(flat)))
    out.append(b"\x3b")
    return b"".join(out)


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and (n := data[at]):
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def read_gif(data: bytes, max_pixels: int = MAX_PIXELS) -> Iterator[Frame]:
    """Composites the frames one by one."""
    if len(data) < 13 or data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > max_pixels:
        raise ValueError(f"canvas of {width} x {height} pixels")
    at, palette = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        palette, at = data[at : at + n], at + n
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear, index = 0, 0, -1, 0
    while at < len(data):
        kind = data[at]
        if kind == 0x21:
            label = data[at + 1] if at + 1 < len(data) else 0
            body, at = _sub_blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                bits, delay, shown = struct.unpack_from("<BHB", body)
                disposal, clear = (bits >> 2) & 7, shown if bits & 1 else -1
        elif kind == 0x2C and at + 11 <= len(data):
            left, top, columns, rows, flags = struct.unpack_from("<HHHHB", data, at + 1)
            if columns * rows > max_pixels:
                raise ValueError(f"image of {columns} x {rows} pixels")
            at += 10
            own = palette
            if flags & 0x80:
                n = 3 << ((flags & 7) + 1)
                own, at = data[at : at + n], at + n
            if at >= len(data) or own is None or not 2 <= data[at] <= 8:
                raise ValueError("image without palette or code size")
            size = data[at]
            body, at = _sub_blocks(data, at + 1)
            pixels = np.zeros(rows * columns, np.uint8)
            got = lzw_decode(body, size, rows * columns)
            pixels[: len(got)] = got
            image = pixels.reshape(rows, columns)
            if flags & 0x40:
                order = np.concatenate([np.arange(first, rows, step) for first, step in INTERLACE])
                image = image[np.argsort(order)]
            colours = np.zeros((256, 4), np.uint8)
            colours[: len(own) // 3, :3] = np.frombuffer(own[: len(own) // 3 * 3], np.uint8).reshape(-1, 3)
            colours[:, 3] = 255
            before = canvas.copy() if disposal == 3 else None
            part = canvas[top : top + rows, left : left + columns]
            image = image[: part.shape[0], : part.shape[1]]
            drawn = image != clear
            part[drawn] = colours[image][drawn]
            yield Frame(index, delay, disposal, (left, top, part.shape[1], part.shape[0]), canvas)
            if disposal == 2:
                part[:] = 0
            elif disposal == 3:
                canvas = before
            delay, disposal, clear, index = 0, 0, -1, index + 1
        else:
            break


def histogram(frame: Frame) -> np.ndarray:
    """Counts of opaque pixels by red, green and blue level, ``BINS`` levels each."""
    seen = frame.canvas[frame.canvas[..., 3] > 0]
    return np.stack([np.bincount(seen[:, c] // (256 // BINS), minlength=BINS) for c in range(3)])


# --- The media operator ---------------------------------------------------------------------------------------------


def frames(media: DataFrame, id_col: str = "media_id", bytes_col: str = "bytes", max_pixels: int = MAX_PIXELS) -> DataFrame:
    """One row a frame: id, frame, start_cs, delay_cs, disposal, width, height, red, green, blue (histograms), error."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("key", "frame", "start_cs", "delay_cs", "disposal", "width", "height", "red", "green", "blue", "error")}
        for key, data in zip(rows["key"], rows["data"]):
            clock = 0
            try:
                if data is None:
                    raise ValueError("no bytes")
                for f in read_gif(bytes(data), max_pixels):
                    counts = histogram(f).tolist()
                    for name, value in zip(out, (key, f.index, clock, f.delay_cs, f.disposal, f.canvas.shape[1], f.canvas.shape[0], *counts, None)):
                        out[name].append(value)
                    clock += f.delay_cs
            except (ValueError, struct.error) as why:
                for name, value in zip(out, (key, *[None] * 9, str(why))):
                    out[name].append(value)
        return out

    kind = media.schema[id_col].dataType.simpleString()
    found = support.map_arrow(
        media.select(F.col(id_col).alias("key"), F.col(bytes_col).alias("data")),
        work,
        f"key {kind}, frame int, start_cs long, delay_cs int, disposal int, width int, height int, red array<int>, green array<int>, blue array<int>, error string",
    )
    return found.withColumnRenamed("key", id_col)


def store_payload(payload: bytes, compress: bool = True) -> bytes:
    """Bytes, a multiple of ``WIDTH``, as a grey-scale GIF."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    images = [samples[i : i + FRAME_ROWS] for i in range(0, len(samples), FRAME_ROWS)]
    return write_gif((WIDTH, min(len(samples), FRAME_ROWS)), images, [DELAY] * len(images), compress)


def load_payload(stored: bytes) -> tuple[bytes, np.ndarray, int]:
    """(payload, histogram of its samples in ``BINS`` levels, frames), read from the frames' own rectangles."""
    parts, counts, n = [], np.zeros(BINS, np.int64), 0
    for f in read_gif(stored):
        left, top, columns, rows = f.box
        part = f.canvas[top : top + rows, left : left + columns, 0]
        parts.append(part.tobytes())
        counts += np.bincount(part.reshape(-1) // (256 // BINS), minlength=BINS)
        n += 1
    return b"".join(parts), counts, n


def op5_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as GIFs, read back and described."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames")}
        for key, text in zip(rows["doc_id"], rows["text"]):
            raw = (text or "").encode()
            stored = store_payload(raw + bytes(-len(raw) % 64 if raw else 64))
            payload, counts, n = load_payload(stored)
            values = (key, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), " ".join(map(str, counts.tolist())), n)
            for name, value in zip(out, values):
                out[name].append(value)
        return out

    docs = support.table(spark, sf_dir, "documents").select("doc_id", "text")
    return support.map_arrow(docs, work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int")
