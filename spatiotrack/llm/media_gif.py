"""Operator 7, media columns: GIF.

``to_gif`` stores bytes as palette samples of an animated GIF (LZW code streams, timed frames);
``read_gif`` decodes any GIF87a or GIF89a: LZW streams, global and local palettes, interlacing,
transparency, disposal and delays. It composes each frame on the canvas and gives its colour
histogram (four levels for each of red, green and blue) as a column.

Spark deals out the rows and both helpers see one value at a time; a frame has at most 64 KiB of
samples, so memory follows the longest single text.

Edge cases: a null text is empty; the payload is padded with zeros to a positive multiple of the
width, so even an empty text has one line of samples; equal texts give equal files; a value that is
not a GIF, or is broken or cut short, gives a null and says why in the column of errors; a null value
gives a null and no error; extra columns pass through, but the columns of results are replaced.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_array, ship

WIDTH = 64
FRAME_ROWS = 1024
DELAY_CS = 10
#: A header can claim any size; a larger canvas or frame counts as broken.
MOST_PIXELS = 1 << 26
FRAME_TYPE = "struct<number:int,left:int,top:int,width:int,height:int,delay_ms:int,disposal:int,transparent:int,histogram:array<int>>"
READ_TYPE = f"struct<payload:binary,width:int,height:int,frames:array<{FRAME_TYPE}>>"

_GRAY = bytes(x for i in range(256) for x in (i, i, i))


def _widths(first: int, n: int, start: int = 0) -> np.ndarray:
    """Bits of the codes number ``start`` and later after a clear code; ``first`` is the first free code."""
    size = first + np.maximum(np.arange(start, start + n) - 1, 0)
    return np.minimum(np.maximum(np.ceil(np.log2(size + 1)).astype(np.int64), (first - 2).bit_length()), 12)


_W8 = _widths(258, 4200)


def lzw_encode(data: bytes) -> bytes:
    """LZW of 8-bit samples, least significant bit first, a clear code whenever the table is full."""
    # Codes are kept shifted by 8 bits, so that the key of a prefix and a byte is their union.
    codes: list[int] = [256 << 8]
    breaks: list[int] = [0]
    add = codes.append
    samples = iter(data)
    prefix = next(samples) << 8
    full = False
    while True:
        table: dict[int, int] = {}
        insert, free = table.setdefault, 258 << 8
        for byte in samples:
            code = insert(prefix | byte, free)
            if code != free:
                prefix = code
            else:
                add(prefix)
                prefix = byte << 8
                free += 256
                if free == 4096 << 8:
                    full = True
                    break
        if not full:
            add(prefix)
            break
        # The table is full: clear, and start anew with the byte just read.
        full = False
        breaks.append(len(codes))
        add(256 << 8)
    add(257 << 8)
    # Between clear codes the width of a code follows from its number; a clear code counts as the last.
    edges = [b + 1 for b in breaks] + [len(codes)]
    bits = np.concatenate([_W8[: y - x] for x, y in zip(edges[:-1], edges[1:], strict=True)])
    bits = np.concatenate([[9], bits]).astype(np.int64)
    value = np.array(codes, np.int64) >> 8
    to = np.concatenate([[0], np.cumsum(bits)])
    place, shifted = to[:-1] >> 3, value << (to[:-1] & 7)
    size = int(to[-1] + 7) // 8
    out = np.zeros(size + 3)
    for k in range(3):
        out += np.bincount(place + k, weights=(shifted >> (8 * k)) & 255, minlength=size + 3)[: size + 3]
    return out[:size].astype(np.uint8).tobytes()


def _expand(code: np.ndarray, literals: int) -> np.ndarray:
    """Samples of the codes between two clear codes.

    The table entry made at code i is the output of code i and the sample after it. So a code above
    the literals copies a stretch of earlier output; copies are followed to their literals by
    doubling the step.
    """
    n = len(code)
    parent = np.where(code < literals, n, code - literals - 2)
    if ((parent >= np.arange(n)) & (parent < n) | (parent > n)).any() or (parent < 0).any():
        raise ValueError("broken LZW stream")
    length, step = np.ones(n + 1, np.int64), np.append(parent, n)
    length[n] = 0
    while (step != n).any():
        length, step = length + length[step], step[step]
    length = length[:n]
    starts = np.concatenate([[0], np.cumsum(length)])
    source = np.arange(starts[-1])
    copied = parent < n
    shift = np.where(copied, starts[:-1] - starts[np.minimum(parent, n - 1)], 0)
    source -= np.repeat(shift, length)
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    out = np.zeros(starts[-1], np.uint8)
    out[starts[:-1][~copied]] = code[~copied]
    return out[source]


def lzw_decode(data: bytes, bits: int, want: int) -> bytes:
    """Samples of an LZW code stream with ``bits`` bits a sample; stops at its end code or after ``want``."""
    clear, stop, first = 1 << bits, (1 << bits) + 1, (1 << bits) + 2
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    word = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16)
    total, at, have = len(data) * 8, 0, 0
    out: list[np.ndarray] = []
    while at < total and have < want:
        for n in (4100, total // (bits + 1) + 1):
            width = _W8[:n] if bits == 8 and n <= len(_W8) else _widths(first, n)
            place = at + np.concatenate([[0], np.cumsum(width)])
            fits = int(np.searchsorted(place, total, "right")) - 1
            start = place[:fits]
            code = word[start >> 3] >> (start & 7).astype(np.uint32) & ((1 << width[:fits]) - 1).astype(np.uint32)
            ends = np.flatnonzero((code == clear) | (code == stop))
            if len(ends) or fits < n:
                break
        used = int(ends[0]) if len(ends) else fits
        if used:
            out.append(_expand(code[:used].astype(np.int64), clear))
            have += len(out[-1])
        if not len(ends) or code[used] == stop:
            break
        at = int(place[used + 1])
    return b"".join(x.tobytes() for x in out)[:want]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(p)]) + p for p in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def to_gif(data: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """Bytes, padded with zeros to a positive multiple of ``width``, as the samples of timed frames."""
    data = data + b"\0" * (-len(data) % width or (0 if data else width))
    step = width * frame_rows
    rows = min(frame_rows, len(data) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, rows, 0xF7, 0, 0), _GRAY]
    for a in range(0, len(data), step):
        part = data[a : a + step]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay_cs, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08" + _blocks(lzw_encode(part)))
    return b"".join(out) + b"\x3b"


def _interlaced(rows: int) -> np.ndarray:
    return np.concatenate([np.arange(a, rows, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])


def frames(gif: bytes):
    """(frame's fields, its samples, the composed canvas) of each frame in turn."""
    if gif[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    wide, high, flags = struct.unpack_from("<HHB", gif, 6)
    if wide * high > MOST_PIXELS:
        raise ValueError("GIF with too large a canvas")
    at, common = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        common = np.frombuffer(gif, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    canvas = np.zeros((high, wide, 3), np.uint8)
    disposal, delay, clear_index, number = 0, 0, -1, 0

    def chain(i: int) -> tuple[bytes, int]:
        parts = []
        while gif[i]:
            parts.append(gif[i + 1 : i + 1 + gif[i]])
            i += 1 + gif[i]
        return b"".join(parts), i + 1

    while at < len(gif) and gif[at] != 0x3B:
        if gif[at] == 0x21:
            body, after = chain(at + 2)
            if gif[at + 1] == 0xF9 and len(body) >= 4:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear_index = packed >> 2 & 7, index if packed & 1 else -1
            at = after
            continue
        if gif[at] != 0x2C:
            raise ValueError("broken GIF")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", gif, at + 1)
        at += 10
        palette = common
        if flags & 0x80:
            n = 2 << (flags & 7)
            palette = np.frombuffer(gif, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        if palette is None:
            raise ValueError("GIF without a palette")
        stream, after = chain(at + 1)
        if not 1 <= gif[at] <= 8 or w * h > MOST_PIXELS:
            raise ValueError("broken GIF")
        flat = lzw_decode(stream, gif[at], w * h)
        at = after
        samples = np.frombuffer(flat + b"\0" * (w * h - len(flat)), np.uint8).reshape(h, w)
        if flags & 0x40:
            lines = np.empty_like(samples)
            lines[_interlaced(h)] = samples
            samples = lines
        shown = samples[: max(0, high - top), : max(0, wide - left)]
        area = (slice(top, top + shown.shape[0]), slice(left, left + shown.shape[1]))
        before = canvas[area].copy() if disposal == 3 else None
        colours = palette[np.minimum(shown, len(palette) - 1)]
        canvas[area] = np.where((shown == clear_index)[:, :, None], canvas[area], colours) if clear_index >= 0 else colours
        yield {"number": number, "left": left, "top": top, "width": w, "height": h, "delay_ms": 10 * delay, "disposal": disposal, "transparent": clear_index}, samples, canvas
        if disposal == 2:
            canvas[area] = 0
        elif disposal == 3:
            canvas[area] = before
        disposal, delay, clear_index, number = 0, 0, -1, number + 1


def histogram(canvas: np.ndarray) -> np.ndarray:
    level = canvas.reshape(-1, 3) >> 6
    return np.bincount(level[:, 0] << 4 | level[:, 1] << 2 | level[:, 2], minlength=64)


def read_gif(gif: bytes) -> dict:
    """What ``READ_TYPE`` says; the payload is every frame's samples as its palette shows them, one after the other.

    Raises ValueError for anything that is not a whole GIF.
    """
    out, parts = [], []
    try:
        for fields, _, canvas in frames(gif):
            area = canvas[fields["top"] : fields["top"] + fields["height"], fields["left"] : fields["left"] + fields["width"]]
            parts.append(area[:, :, 0].tobytes())
            out.append(fields | {"histogram": histogram(canvas)})
    except (IndexError, struct.error) as e:
        raise ValueError("GIF cut short") from e
    wide, high = struct.unpack_from("<HH", gif, 6)
    return {"payload": b"".join(parts), "width": wide, "height": high, "frames": out}


def _frames_array(rows: list[list[dict]]) -> pa.Array:
    flat = [f for r in rows for f in r]
    ints = {k: pa.array([f[k] for f in flat], pa.int32()) for k in ("number", "left", "top", "width", "height", "delay_ms", "disposal", "transparent")}
    hist = np.concatenate([f["histogram"] for f in flat]).astype(np.int32) if flat else np.zeros(0, np.int32)
    ints["histogram"] = pa.ListArray.from_arrays(pa.array(np.arange(0, len(hist) + 1, 64), pa.int32()), pa.array(hist))
    fields = pa.StructArray.from_arrays(list(ints.values()), list(ints))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(r) for r in rows]), pa.int32()), fields)


def _store(texts: pa.Array) -> pa.Array:
    return pa.array([to_gif((t.as_py() or "").encode()) for t in as_array(texts)], pa.binary())


def _read(media: pa.Array) -> pa.Array:
    read, errors = [], []
    for m in as_array(media):
        try:
            read.append(read_gif(m.as_py()) if m.is_valid else None)
            errors.append(None)
        except ValueError as e:
            read.append(None)
            errors.append(str(e))
    some = [r or {"payload": b"", "width": 0, "height": 0, "frames": []} for r in read]
    image = pa.StructArray.from_arrays(
        [pa.array([r["payload"] for r in some], pa.binary()), pa.array([r["width"] for r in some], pa.int32()), pa.array([r["height"] for r in some], pa.int32()), _frames_array([r["frames"] for r in some])],
        ["payload", "width", "height", "frames"],
        mask=pa.array([r is None for r in read], pa.bool_()),
    )
    return pa.StructArray.from_arrays([image, pa.array(errors, pa.string())], ["image", "error"])


def store_text(df: DataFrame, text: str = "text", to: str = "media") -> DataFrame:
    ship(df.sparkSession)
    return df.withColumn(to, F.arrow_udf(_store, "binary")(F.col(text)))


def read_media(df: DataFrame, media: str = "media", to: str = "image") -> DataFrame:
    """``df`` with a struct column ``to`` (payload, width, height and the timed frames with their histograms) and ``to``_error."""
    ship(df.sparkSession)
    both = df.withColumn("__read", F.arrow_udf(_read, f"struct<image:{READ_TYPE},error:string>")(F.col(media)))
    return both.withColumns({to: F.col("__read.image"), f"{to}_error": F.col("__read.error")}).drop("__read")


def feature(frames_column: Column) -> Column:
    """Delay and histogram of each frame, as text."""
    return F.array_join(F.transform(frames_column, lambda f: F.concat(f["delay_ms"].cast("string"), F.lit(":"), F.array_join(f["histogram"].cast("array<string>"), ","))), ";")
