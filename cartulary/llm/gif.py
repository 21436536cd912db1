"""Operator 6: media columns of animated GIF.

The decoder reads LZW code streams of any width, applies local and global palettes, interlacing, transparency and the
four disposal rules, and gives timed frames with colour histograms. The encoder writes payloads of bytes as frames of
grey pixels, a pixel a byte, so that pixels read back are the payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialise

#: Payloads are padded with spaces to a positive multiple of this, which is also the width of a frame.
UNIT = WIDTH = 192
#: Rows of pixels in a frame at most, and hundredths of a second that a frame is shown.
FRAME_ROWS, DELAY = 64, 10
HISTOGRAM_BINS = 16
#: Pixels of a screen or frame that a decoder holds at most (4 bytes each): a header may claim 65,535 by 65,535.
MOST_PIXELS = 1 << 26
_MOST_CODES = 1 << 12
_GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)


def _schedule(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Width of the j-th code after a clear code, and the bit where it starts: the table has grown by j - 1 by then."""
    j = np.arange(_MOST_CODES - (1 << size) + 2)
    widths = np.minimum(12, np.floor(np.log2((1 << size) + 2 + np.maximum(j - 1, 0))).astype(int) + 1)
    return widths, np.concatenate(([0], np.cumsum(widths)))


_SCHEDULES = {size: _schedule(size) for size in range(2, 9)}


def lzw_encode(data: bytes) -> bytes:
    """LZW code stream of 8-bit pixels. A clear code follows whenever the table is full."""
    widths, _ = _SCHEDULES[8]
    full = _MOST_CODES - 258
    codes, sizes, segment, table, free = [np.array([256])], [np.array([9])], [], {}, 258
    emit, get = segment.append, table.get
    prefix = data[0]
    for byte in data[1:]:
        if (code := get(key := prefix << 8 | byte)) is not None:
            prefix = code
            continue
        emit(prefix)
        table[key] = free
        free += 1
        prefix = byte
        if free == _MOST_CODES:
            emit(256)
            codes.append(np.array(segment))
            sizes.append(widths[: full + 1])
            segment.clear()
            table.clear()
            free = 258
    emit(prefix)
    emit(257)
    codes.append(np.array(segment))
    sizes.append(widths[: len(segment)])
    all_codes, all_sizes = np.concatenate(codes).astype(np.uint16), np.concatenate(sizes)
    bits = np.unpackbits(all_codes.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16) < all_sizes[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, size: int, most: int) -> bytes:
    """The pixels of a code stream, most of them at the most. size: bits of a pixel. Raises ValueError on codes that
    the table doesn't have yet; a stream that ends without an end code gives what it has."""
    widths, starts = _SCHEDULES[size]
    clear, end = 1 << size, (1 << size) + 1
    padded = np.frombuffer(stream + b"\0\0", np.uint8).astype(np.uint32)
    three = padded[:-2] | padded[1:-1] << np.uint32(8) | padded[2:] << np.uint32(16)  # the 24 bits from each byte on
    n_bits, at, out, done = 8 * len(stream), 0, [], 0
    base = [bytes([i]) for i in range(clear)] + [b"", b""]

    def read(places: np.ndarray, widths: np.ndarray | int) -> np.ndarray:
        return three[places >> 3] >> (places & 7).astype(np.uint32) & ((1 << widths) - 1)

    while done < most:
        n = max(0, int(np.searchsorted(starts, n_bits - at, "right")) - 1)
        n = min(n, len(widths))
        codes = read(at + starts[:n], widths[:n])
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else n
        table, last, before = base[:], b"", len(out)
        grow, add, size_now = table.append, out.append, len(base)
        for code in codes[:stop].tolist():
            if code < size_now:
                now = table[code]
                if last and size_now < _MOST_CODES:
                    grow(last + now[:1])
                    size_now += 1
            elif code == size_now and last:
                now = last + last[:1]
                if size_now < _MOST_CODES:
                    grow(now)
                    size_now += 1
            else:
                raise ValueError("a code that the table doesn't have")
            add(now)
            last = now
        if len(stops):
            at += int(starts[stop + 1])
            over = codes[stop] == end
        elif n < len(widths):
            over = True
        else:  # the table is full and stays: all further codes have 12 bits
            at += int(starts[n])
            rest = read(at + 12 * np.arange((n_bits - at) // 12), 12)
            stops = np.flatnonzero((rest == clear) | (rest == end))
            stop = int(stops[0]) if len(stops) else len(rest)
            out += [table[c] for c in rest[:stop].tolist()]
            over = not len(stops) or rest[stop] == end
            at += 12 * (stop + 1)
        done += sum(map(len, out[before:]))
        if over:
            break
    return b"".join(out)[:most]


def _blocks(data: bytes) -> bytes:
    """Sub-blocks of 255 bytes at most, and the empty one that ends them."""
    return b"".join([bytes([len(x)]) + x for x in (data[i : i + 255] for i in range(0, len(data), 255))]) + b"\0"


def encode(samples: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay: int = DELAY) -> bytes:
    """samples (a multiple of width, 8 bits each) as frames, one below the other in the payload and after the other in
    time."""
    step = width * frame_rows
    frames = [samples[i : i + step] for i in range(0, len(samples), step)]
    out = [b"GIF89a", struct.pack("<HHBBB", width, len(frames[0]) // width, 0xF7, 0, 0), _GREY.tobytes(), b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for frame in frames:
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay, 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, width, len(frame) // width, 0, 8))
        out.append(_blocks(lzw_encode(frame)))
    return b"".join([*out, b"\x3b"])


class Frame:
    """One image of a GIF: its place, its pixels as palette indices, its palette, and how it is shown."""

    __slots__ = ("left", "top", "width", "height", "pixels", "palette", "delay", "disposal", "transparent")


def parse(data: bytes, most_pixels: int = MOST_PIXELS) -> tuple[int, int, list[Frame]]:
    """Width and height of the screen, and all frames. Raises ValueError where the bytes are no GIF, where they end
    before the first frame does, and where a frame or the screen claims more than most_pixels."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("no GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    if width * height > most_pixels:
        raise ValueError("a screen of too many pixels")
    at, shared, frames = 13, None, []
    if flags & 0x80:
        shared, at = _palette(data, at, flags)
    delay = disposal = 0
    transparent = None

    def sub_blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(data) and (n := data[at]):
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        return b"".join(parts), at + 1

    while at < len(data):
        mark = data[at]
        if mark == 0x3B:
            return width, height, frames
        if mark == 0x21 and at + 1 < len(data):
            label = data[at + 1]
            body, at = sub_blocks(at + 2)
            if label == 0xF9 and len(body) >= 4:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else None
        elif mark == 0x2C and at + 10 <= len(data):
            f = Frame()
            f.left, f.top, f.width, f.height, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at, f.palette = at + 10, shared
            if flags & 0x80:
                f.palette, at = _palette(data, at, flags)
            if f.palette is None or at >= len(data) or not 2 <= data[at] <= 8:
                raise ValueError("a frame without palette or pixels")
            if f.width * f.height > most_pixels:
                raise ValueError("a frame of too many pixels")
            size = data[at]
            stream, at = sub_blocks(at + 1)
            flat = lzw_decode(stream, size, f.width * f.height)
            pixels = np.frombuffer(flat.ljust(f.width * f.height, b"\0"), np.uint8).reshape(f.height, f.width)
            if flags & 0x40:
                rows = np.concatenate([np.arange(a, f.height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                straight = np.empty_like(pixels)
                straight[rows] = pixels
                pixels = straight
            f.pixels, f.delay, f.disposal, f.transparent = pixels, delay, disposal, transparent
            frames.append(f)
            delay, disposal, transparent = 0, 0, None
        else:
            raise ValueError("an unknown block")
    if not frames:
        raise ValueError("cut off before its first frame")
    return width, height, frames


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 3 << (flags & 7) + 1
    if at + n > len(data):
        raise ValueError("a palette that is cut off")
    colours = np.zeros((256, 3), np.uint8)
    colours[: n // 3] = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3)
    return colours, at + n


def shown(data: bytes, most_pixels: int = MOST_PIXELS):
    """(frame, canvas) as they are seen: RGBA of the whole screen after palette, transparency and disposal. The canvas is
    painted on further, so whoever keeps it copies it."""
    width, height, frames = parse(data, most_pixels)
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in frames:
        before = canvas.copy() if f.disposal == 3 else None
        place = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        part = f.pixels[: place.shape[0], : place.shape[1]]
        if f.transparent is None:
            place[..., :3], place[..., 3] = f.palette.take(part, axis=0), 255
        else:
            painted = part != f.transparent
            place[painted] = np.column_stack([f.palette[part[painted]], np.full(painted.sum(), 255, np.uint8)])
        yield f, canvas
        if f.disposal == 2:
            place[...] = 0
        elif f.disposal == 3:
            canvas = before


def frames_of(media: DataFrame, key: str = "doc_id", column: str = "media", most_pixels: int = MOST_PIXELS) -> DataFrame:
    """One row a frame: key, frame, start_ms and delay_ms, width, height, disposal, and histograms of what is shown:
    red, green, blue (counts of HISTOGRAM_BINS equal bins each) and n_clear (pixels that nothing has painted). Null media have no frames;
    bytes that are no GIF, or claim pictures of more than ``most_pixels``, give one row with the error. Repeated rows stay."""
    ints = "array<long>"

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for k, data in zip(block.column(0).to_pylist(), block.column(1).to_pylist()):
            time = 0
            try:
                for i, (f, canvas) in enumerate(shown(data, most_pixels) if data is not None else ()):
                    seen = canvas[canvas[..., 3] > 0]
                    bins = [np.bincount(seen[:, c].astype(int) * HISTOGRAM_BINS >> 8, minlength=HISTOGRAM_BINS).tolist() for c in range(3)]
                    rows.append((k, i, time, f.delay * 10, f.width, f.height, f.disposal, *bins, int((canvas[..., 3] == 0).sum()), None))
                    time += f.delay * 10
            except ValueError as e:
                rows.append((k, None, None, None, None, None, None, None, None, None, None, str(e)))
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())] * 3 + [pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names) if rows else None

    names = [key, "frame", "start_ms", "delay_ms", "width", "height", "disposal", "red", "green", "blue", "n_clear", "error"]
    schema = f"{key} long, frame long, start_ms long, delay_ms long, width long, height long, disposal long, red {ints}, green {ints}, blue {ints}, n_clear long, error string"
    return map_texts(media.select(F.col(key).cast("long").alias(key), column), run, schema, column)


def store(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, n_bytes, media): the UTF-8 bytes of column (null: none), padded with spaces to a positive multiple of
    UNIT, as a GIF. Equal texts give equal media."""

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        payloads = [(x or "").encode(errors="surrogatepass") for x in block.column(1).to_pylist()]
        media = [encode(x + b" " * (-len(x) % UNIT or UNIT * (not x))) for x in payloads]
        return pa.RecordBatch.from_arrays([block.column(0), pa.array(list(map(len, payloads)), pa.int64()), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])

    return map_texts(docs.select(F.col(key).cast("long").alias(key), column), run, f"{key} long, n_bytes long, media binary", column)


def colours(f: Frame, canvas: np.ndarray) -> list[list[int]]:
    """Histograms of red, green and blue in the part of a canvas that a frame covers. Without transparency they follow from the palette."""
    part = canvas[f.top : f.top + f.height, f.left : f.left + f.width, :3]
    if f.transparent is None:
        counts = np.bincount(f.pixels[: part.shape[0], : part.shape[1]].ravel(), minlength=len(f.palette))[: len(f.palette)]
        return [np.bincount(f.palette[:, c].astype(int) * HISTOGRAM_BINS >> 8, counts, HISTOGRAM_BINS).astype(int).tolist() for c in range(3)]
    return [np.bincount(part[..., c].ravel(), minlength=256).reshape(HISTOGRAM_BINS, -1).sum(axis=1).tolist() for c in range(3)]


def features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """media(key, n_bytes, media) -> digests of the payload that is read back, and of what is stored; feature has the
    number of frames, their time in ms, and the histogram of their grey pixels. Pixels are read from the frames as they
    are shown. frames has start and delay in ms and the histograms of the colours of each."""

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for data in block.column(2).to_pylist():
            parts, timed, time = [], [], 0
            for f, canvas in shown(data):
                part = canvas[f.top : f.top + f.height, f.left : f.left + f.width, 0].tobytes()
                parts.append(part)
                seen = colours(f, canvas)
                timed.append((time, 10 * f.delay, seen[0], *seen))
                time += 10 * f.delay
            pixels = b"".join(parts)
            histogram = np.sum([grey for _, _, grey, *_ in timed], axis=0)
            feature = f"{len(timed)} frames, {time} ms, grey {' '.join(map(str, histogram))}"
            rows.append((len(pixels), hashlib.sha256(pixels).hexdigest(), zlib.crc32(pixels[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, [dict(zip(("start_ms", "delay_ms", "grey", "red", "green", "blue"), x)) for x in timed]))
        frame = pa.struct([("start_ms", pa.int64()), ("delay_ms", pa.int64()), *[(c, pa.list_(pa.int64())) for c in ("grey", "red", "green", "blue")]])
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(frame)]
        return pa.RecordBatch.from_arrays([*block.columns[:2], *(pa.array(x, t) for x, t in zip(zip(*rows), kinds))], names=names)

    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames"]
    return map_texts(media.select(key, "n_bytes", "media"), run, f"{key} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames array<struct<start_ms: long, delay_ms: long, grey: array<long>, red: array<long>, green: array<long>, blue: array<long>>>", "media")


def media_report(docs: DataFrame) -> DataFrame:
    """Stores every text as a GIF in a table of the shared folder, and computes features from that table.

    Null and empty texts are one unit of spaces, stored as any other. Texts of any length are whole: further frames take
    what one can't hold. Repeated rows and null keys stay, and equal texts have equal values. Other columns of docs are
    not read, so their names can't clash. An empty table gives an empty result."""
    return features(materialise(store(docs), "media", "lz4"))
