"""GIF media: an encoder and a decoder, and texts stored as lossless frames.

The decoder reads the block structure, LZW code streams of every code size, global and
local palettes, interlacing, graphic control (delay, transparency, disposal) and composes
the canvas frame by frame. Codes are unpacked for a whole run between clear codes at once:
the width of a code depends only on its place in the run.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import lean, slices, staged, table
from barlab.llm.decontaminate import arrow_type

WIDTH, ROWS, DELAY = 64, 1024, 4  # of a payload's frames; the delay in hundredths of a second
HISTOGRAM_BITS = 2  # for each of red, green and blue
SLICE_BYTES, CACHE_BYTES = 1 << 20, 8 << 20
MAX_PIXELS = 1 << 26  # of one frame; a file that asks for more counts as damaged
GRAY = bytes(b for v in range(256) for b in (v, v, v))


def code_widths(n: int, min_size: int) -> np.ndarray:
    """Bits of each of n codes after a clear code. Code i of a run is read when the table
    has i - 1 entries more than at its start (the first code adds none)."""
    next_code = (1 << min_size) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.minimum(np.ceil(np.log2(next_code + 1)).astype(np.int64).clip(min_size + 1), 12)


_WIDTHS = {m: code_widths(4096, m) for m in range(2, 9)}  # the format has no smaller size than 2


def lzw_encode(pixels: bytes, min_size: int = 8) -> bytes:
    """Code stream of pixels, with a clear code at the start and when the table is full."""
    clear, runs, codes, table_ = 1 << min_size, [], [], {}
    new, full = (clear + 2) << 8, 4096 << 8  # codes are kept shifted, so that a code and a pixel make a key
    n, add, rest = new, table_.setdefault, iter(pixels)
    for c in rest:
        w = c << 8
        for c in rest:  # noqa: B020, PLW2901
            v = add(w | c, n)
            if v != n:
                w = v
                continue
            codes.append(w)
            n, w = n + 256, c << 8
            if n == full:
                break
        codes.append(w)
        if n == full:
            runs.append(codes)
            codes, n = [], new
            table_.clear()
    runs.append(codes)
    values, widths = [np.array([clear])], [np.array([min_size + 1])]
    for i, run in enumerate(runs):
        stop = clear + 1 if i == len(runs) - 1 else clear
        values.append(np.append(np.array(run, np.int64) >> 8, stop))
        full = _WIDTHS[min_size] if len(run) < 4096 else code_widths(len(run) + 1, min_size)
        widths.append(full[: len(run) + 1])
    value, width = np.concatenate(values), np.concatenate(widths)
    bits = (value[:, None] >> np.arange(12)) & 1
    return np.packbits(bits[np.arange(12) < width[:, None]].astype(np.uint8), bitorder="little").tobytes()


def _expanded(codes: np.ndarray, clear: int, most: int) -> bytes:
    """Pixels of the codes between two clear codes, until ``most`` are made. The entry that is
    added behind a code's pixels are these and the next one, so a code of that entry repeats
    a stretch of the output; places of the output are followed back to codes of one pixel."""
    if codes[0] >= clear:
        raise ValueError("a code stream begins with a code beyond its table")
    places = np.arange(len(codes))
    single = codes < clear
    of = np.where(single, places, np.minimum(codes - clear - 2, places - 1))  # the code that an entry was added behind
    size, up = (~single).astype(np.int64), of
    while (more := size[up]).any():
        size, up = size + more, up[up]
    size += 1
    stop = np.cumsum(size)
    n = min(int(np.searchsorted(stop, most)) + 1, len(codes))
    size, stop, of, single = size[:n], stop[:n], of[:n], single[:n]
    start = stop - size
    out, a = np.empty(int(stop[-1]), np.uint8), 0
    out[start[single]] = codes[:n][single]
    while a < n:
        base = int(start[a])
        b = max(a + 1, int(np.searchsorted(stop, base + SLICE_BYTES, "right")))
        source = np.repeat(start[of[a:b]] - start[a:b], size[a:b]) + np.arange(base, int(stop[b - 1]))
        while True:  # twice as far back each time; what stands before base is known
            further = source[source] if not base else np.where(source < base, source, source[np.maximum(source - base, 0)])
            if np.array_equal(further, source):
                break
            source = further
        out[base : int(stop[b - 1])] = out[source]
        a = b
    return out.tobytes()


def lzw_decode(stream: bytes, min_size: int, n_pixels: int) -> bytes:
    """Pixels of a code stream; at most ``n_pixels``, fewer when it ends early."""
    if min_size not in _WIDTHS:
        raise ValueError(f"no code size: {min_size}")
    clear, at, out, made = 1 << min_size, 0, [], 0
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.int64)
    n_bits = len(stream) * 8
    while made < n_pixels and at < n_bits:
        width = _WIDTHS[min_size] if n_bits - at < 4096 * 12 else np.concatenate([_WIDTHS[min_size], np.full((n_bits - at) // 12 - 4000, 12)])
        start = at + np.cumsum(width) - width
        start = start[start + width <= n_bits]
        width = width[: len(start)]
        if not len(start):
            break
        byte = start >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (start & 7)) & ((1 << width) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
        end = int(stops[0]) if len(stops) else len(codes)
        if end:
            out.append(_expanded(codes[:end], clear, n_pixels - made))
            made += len(out[-1])
        if end == len(codes) or codes[end] == clear + 1:
            break
        at = int(start[end] + width[end])
    return b"".join(out)[:n_pixels]


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    pixels: np.ndarray  # palette indices, height x width
    palette: np.ndarray  # n x 3
    delay: int = 0
    disposal: int = 0
    transparent: int | None = None
    canvas: np.ndarray | None = field(default=None, repr=False)  # RGBA after this frame


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def encode(frames: list[Frame], size: tuple[int, int], palette: bytes = GRAY) -> bytes:
    """A GIF of frames that share a global palette of 256 colours."""
    out = [b"GIF89a", struct.pack("<HHBBB", *size, 0xF7, 0, 0), palette]
    for f in frames:
        flags = f.disposal << 2 | (f.transparent is not None)
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, flags, f.delay, f.transparent or 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, f.left, f.top, f.width, f.height, 0, 8))
        stream = lzw_encode(f.pixels.tobytes())
        out += [bytes([len(stream[i : i + 255])]) + stream[i : i + 255] for i in range(0, len(stream), 255)] + [b"\0"]
    return b"".join([*out, b";"])


def decode(data: bytes, compose: bool = True) -> tuple[tuple[int, int], list[Frame]]:
    """Canvas size and frames; with ``compose``, each frame's canvas after it is drawn."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    wide, high, flags = struct.unpack_from("<HHB", data, 6)
    at, frames, control = 13, [], (0, 0, None)

    def colours(flags: int) -> np.ndarray:
        nonlocal at
        n = 2 << (flags & 7)
        out = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
        return out

    common = colours(flags) if flags & 0x80 else None
    while at < len(data) and data[at] != 0x3B:
        mark = data[at]
        if mark == 0x21:
            body, after = _blocks(data, at + 2)
            if data[at + 1] == 0xF9:
                control = (body[1] | body[2] << 8, body[0] >> 2 & 7, body[3] if body[0] & 1 else None)
            at = after
            continue
        if mark != 0x2C:
            raise ValueError(f"unknown block {mark:#x}")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = colours(flags) if flags & 0x80 else common
        if palette is None or w * h > MAX_PIXELS:
            raise ValueError("a frame without a palette, or too large")
        min_size = data[at]
        stream, at = _blocks(data, at + 1)
        raw = lzw_decode(stream, min_size, w * h)
        pixels = np.frombuffer(raw + bytes(w * h - len(raw)), np.uint8).reshape(h, w)
        if flags & 0x40:  # interlaced: every 8th row, then from 4, 2 and 1
            rows = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, h, step)]
            pixels = pixels[np.argsort(rows)]
        frames.append(Frame(left, top, w, h, pixels, palette, *control))
        control = (0, 0, None)
    if compose:
        _compose((wide, high), frames)
    return (wide, high), frames


def _compose(size: tuple[int, int], frames: list[Frame]) -> None:
    for f, canvas in composed(size, frames):
        f.canvas = canvas.copy()


def composed(size: tuple[int, int], frames: list[Frame]) -> Iterator[tuple[Frame, np.ndarray]]:
    """Each frame with the RGBA canvas after it is drawn; the canvas is the same array, to
    be read before the next frame is asked for."""
    canvas = np.zeros((size[1], size[0], 4), np.uint8)
    for f in frames:
        before = canvas.copy() if f.disposal == 3 else None
        part = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        pixels = f.pixels[: part.shape[0], : part.shape[1]]
        drawn = np.ones(pixels.shape, bool) if f.transparent is None else pixels != f.transparent
        part[drawn, :3] = f.palette[pixels[drawn]]
        part[drawn, 3] = 255
        yield f, canvas
        if f.disposal == 2:
            part[:] = 0
        elif f.disposal == 3:
            canvas = before


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Counts of an RGBA canvas's colours in bins of the highest bits of each component;
    transparent pixels do not count."""
    top = (canvas[canvas[..., 3] > 0][:, :3] >> (8 - HISTOGRAM_BITS)).astype(np.int64)
    return np.bincount((top[:, 0] << 2 * HISTOGRAM_BITS) | (top[:, 1] << HISTOGRAM_BITS) | top[:, 2], minlength=1 << 3 * HISTOGRAM_BITS)


def shown(size: tuple[int, int], frames: list[Frame]) -> Iterator[tuple[Frame, int, np.ndarray]]:
    """Each frame with the number of transparent pixels and the histogram of the canvas after
    it is drawn. Where every frame covers the canvas with opaque pixels, it is the canvas,
    and its palette's colours are counted without drawing it."""
    if any((f.left, f.top, f.width, f.height) != (0, 0, *size) or f.transparent is not None for f in frames):
        for f, canvas in composed(size, frames):
            yield f, int((canvas[..., 3] == 0).sum()), histogram(canvas)
        return
    for f in frames:
        n = np.bincount(f.pixels.reshape(-1), minlength=len(f.palette))
        if len(n) > len(f.palette):
            raise IndexError("a pixel beyond its palette")
        top = (f.palette >> (8 - HISTOGRAM_BITS)).astype(np.int64)
        out = np.zeros(1 << 3 * HISTOGRAM_BITS, np.int64)
        np.add.at(out, (top[:, 0] << 2 * HISTOGRAM_BITS) | (top[:, 1] << HISTOGRAM_BITS) | top[:, 2], n)
        yield f, 0, out


def store(text: bytes | None) -> bytes:
    """A text as GIF frames of gray levels: 64 samples a row, 1024 rows a frame at most. Each
    frame is cleared before the next, so that every canvas shows its own samples only."""
    payload = text or b""
    payload += bytes(-len(payload) % WIDTH or (0 if payload else WIDTH))
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    frames = [Frame(0, 0, WIDTH, len(p), p, np.zeros(0), DELAY, 2) for p in (pixels[i : i + ROWS] for i in range(0, len(pixels), ROWS))]
    return encode(frames, (WIDTH, min(len(pixels), ROWS)))


def samples(frames: list[Frame]) -> bytes:
    """The payload in stored frames: the gray level of every pixel through the palette."""
    return b"".join(f.palette[:, 0][f.pixels].tobytes() for f in frames)


FRAME = "struct<frame:int,start:int,delay:int,left:int,top:int,width:int,height:int,disposal:int,transparent:bigint,histogram:array<bigint>,pixels:binary,palette:binary>"
_INTS = ("frame", "start", "delay", "left", "top", "width", "height", "disposal")
_FRAME = pa.struct([*((n, pa.int32()) for n in _INTS), ("transparent", pa.int64()), ("histogram", pa.list_(pa.int64())), ("pixels", pa.binary()), ("palette", pa.binary())])


def _frames(data: bytes | None) -> list[dict]:
    """Rows of the frame table of one GIF; none for null or broken data."""
    rows, start = [], 0
    try:
        for i, (f, clear, colours) in enumerate(shown(*decode(data, compose=False)) if data is not None else []):
            ints = (i, start, f.delay, f.left, f.top, f.width, f.height, f.disposal)
            rows.append({**dict(zip(_INTS, ints, strict=True)), "transparent": clear, "histogram": colours.tolist(), "pixels": f.pixels.tobytes(), "palette": f.palette.tobytes()})
            start += f.delay
    except (ValueError, IndexError, struct.error):
        return []
    return rows


def with_frames(media: DataFrame, data_col: str = "gif") -> DataFrame:
    """``media`` with its GIFs decoded: the data column gives way to ``frames``, an array of
    the frame table's rows. Memory is bounded by a slice of decoded pixels and one GIF."""
    at = media.columns.index(data_col)

    def run(batches):
        seen: dict[bytes, list] = {}
        held = 0
        for batch in batches:
            rest = batch.remove_column(at)
            data, first, rows, made = batch.column(at).cast(pa.binary()), 0, [], 0

            def part(rest=rest):
                frames = pa.array(rows, pa.list_(_FRAME))  # noqa: B023
                return pa.RecordBatch.from_arrays([*rest.slice(first, len(rows)).columns, frames], names=[*rest.schema.names, "frames"])  # noqa: B023

            for value in data:
                gif = value.as_py()
                key = hashlib.sha256(gif or b"").digest()
                if key not in seen:
                    if held > CACHE_BYTES:
                        seen.clear()
                        held = 0
                    seen[key] = _frames(gif)
                    held += 1000 + sum(len(f["pixels"]) + 4000 for f in seen[key])
                rows.append(seen[key])
                made += sum(len(f["pixels"]) + len(f["palette"]) for f in rows[-1])
                if made > SLICE_BYTES:
                    yield part()
                    first, rows, made = first + len(rows), [], 0
            yield part()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.drop(data_col).schema)
    return media.mapInArrow(lean(run), f"{schema}, frames array<{FRAME}>")


def frame_table(media: DataFrame, *, id_col: str = "media_id", data_col: str = "gif") -> DataFrame:
    """(id, frame, start, delay, left, top, width, height, disposal, transparent, histogram,
    pixels, palette) for each frame of each GIF; times in hundredths of a second, histogram
    and number of transparent pixels of the whole canvas after the frame is drawn, the
    frame's own pixels as indices of its palette. Null or broken data gives none."""
    found = with_frames(media.select(F.col(id_col).alias("id"), F.col(data_col).alias("gif")))
    return found.select("id", F.explode("frames").alias("f")).select("id", "f.*")


def stored_media(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, gif): each text stored as GIF in a staged table, read back from it.
    Memory is bounded by a slice of texts."""
    kind, id_type = documents.schema[id_col].dataType.simpleString(), arrow_type(documents, id_col)
    schema = pa.schema([("doc_id", id_type), ("n_bytes", pa.int64()), ("gif", pa.binary())])

    def run(batches):
        seen: dict[bytes, bytes] = {}
        held = 0
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for a, b in slices(pa.compute.binary_length(texts).fill_null(0).to_pylist(), SLICE_BYTES):
                part, gifs = texts[a:b].to_pylist(), []
                for text in part:
                    key = hashlib.sha256(text or b"").digest()
                    if key not in seen:
                        if held > CACHE_BYTES:
                            seen.clear()
                            held = 0
                        seen[key] = store(text)
                        held += len(seen[key])
                    gifs.append(seen[key])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(t or b"") for t in part], pa.int64()), pa.array(gifs, pa.binary())], schema=schema)

    return staged(documents.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(run), f"doc_id {kind}, n_bytes bigint, gif binary"), "media")[0]


def media_of(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as GIF, the stored bytes read back, and the features of their frames:
    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, n_frames, duration, histogram). A null text is an empty one. Rows that repeat
    are all returned; equal texts give equal values."""
    media = stored_media(documents, id_col=id_col, text_col=text_col)
    found = with_frames(media.withColumn("media_bytes", F.octet_length("gif").cast("bigint")).withColumn("media_sha256", F.sha2("gif", 256)))
    gray = (F.size("frames") > 0) & F.forall("frames", lambda f: f["palette"] == F.lit(bytearray(GRAY)))  # an index is its gray level
    pixels = F.reduce("frames", F.lit(bytearray()), lambda all_, f: F.concat(all_, f["pixels"]))
    zeros = F.array_repeat(F.lit(0).cast("bigint"), 1 << 3 * HISTOGRAM_BITS)
    found = found.select(
        "*", F.when(gray, pixels).otherwise(F.raise_error(F.lit("damaged media")).cast("binary")).alias("payload"), F.size("frames").cast("bigint").alias("n_frames"),
        F.reduce("frames", F.lit(0).cast("bigint"), lambda t, f: t + f["delay"]).alias("duration"),
        F.reduce("frames", zeros, lambda t, f: F.zip_with(t, f["histogram"], lambda x, y: x + y)).alias("histogram"),
    )
    bins = F.filter(F.transform("histogram", lambda n, i: F.when(n > 0, F.concat(i.cast("string"), F.lit("="), n.cast("string")))), lambda x: x.isNotNull())
    return found.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), "media_bytes", "media_sha256",
        F.concat(F.col("n_frames").cast("string"), F.lit(":"), F.col("duration").cast("string"), F.lit(":"), F.array_join(bins, ",")).alias("feature"), "n_frames", "duration", "histogram",
    )


def op4_gif(spark, sf_dir: str) -> DataFrame:
    """The stored form and features of every document's text."""
    return media_of(table(spark, sf_dir, "documents"))
