"""TIFF pages: directories walked, strips and tiles decoded, predictors undone.

The reader takes both byte orders, one row for each image directory, 8-bit samples stored
chunky, uncompressed or as PackBits, LZW or deflate, in strips or tiles, with horizontal
differencing or without. All else (other predictors too) is an error, never a guess. The writer makes such files; it serves the query and the tests.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Compression schemes, and the tags that are read.
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES = 322, 323, 324, 325
_TYPES = {1: "B", 3: "H", 4: "I"}
_CLEAR, _END, _FIRST = 256, 257, 258


def unpack_bits(data: bytes, most: int | None = None) -> bytes:
    """The bytes of PackBits runs; no run is read beyond ``most`` bytes."""
    out, i, n, size = [], 0, len(data), 0
    while i < n and (most is None or size < most):
        h = data[i]
        if h < 128:
            out.append(data[i + 1 : i + 2 + h])
            i += h + 2
        elif h > 128:
            out.append(data[i + 1 : i + 2] * (257 - h))
            i += 2
        else:
            i += 1
            continue
        size += len(out[-1])
    return b"".join(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more are repeats, all else literals of up to 128 bytes."""
    a = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    length = np.diff(np.append(starts, len(a)))
    out, at = [], 0

    def literal(to: int) -> None:
        for i in range(at, to, 128):
            part = data[i : min(i + 128, to)]
            out.append(bytes([len(part) - 1]) + part)

    for s, n in zip(starts[length >= 3].tolist(), length[length >= 3].tolist(), strict=True):
        literal(s)
        for i in range(0, n, 128):
            m = min(128, n - i)
            out.append(bytes([(257 - m) & 255 if m > 1 else 0, data[s]]))
        at = s + n
    literal(len(data))
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; each width grows one code early, as TIFF has it."""
    table = {bytes([i]): i for i in range(256)}
    acc, held, width, nxt = _CLEAR, 9, 9, _FIRST
    w = b""
    out = bytearray()
    for k in range(len(data)):
        wc = w + data[k : k + 1]
        if wc in table:
            w = wc
            continue
        acc, held = acc << width | table[w], held + width
        table[wc] = nxt
        nxt += 1
        if nxt == 4094:
            acc, held = acc << 12 | _CLEAR, held + 12
            table, width, nxt = {bytes([i]): i for i in range(256)}, 9, _FIRST
        elif nxt >= 1 << width:
            width += 1
        w = data[k : k + 1]
        if held >= 512:
            rest = held & 7
            out += (acc >> rest).to_bytes(held >> 3, "big")
            acc, held = acc & (1 << rest) - 1, rest
    if w:
        acc, held = acc << width | table[w], held + width
        if nxt + 1 >= 1 << width:
            width = min(12, width + 1)
    acc, held = acc << width | _END, held + width
    pad = -held % 8
    return bytes(out + (acc << pad).to_bytes((held + pad) >> 3, "big"))


def lzw_decode(data: bytes, most: int | None = None) -> bytes:
    """The bytes of LZW codes; no code is read beyond ``most`` bytes."""
    size = 0
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, prev = list(first), 9, b""
    out = []
    acc = held = 0
    for byte in data:
        acc, held = (acc << 8 | byte) & 0xFFFFFF, held + 8
        if held < width:
            continue
        held -= width
        code = acc >> held & (1 << width) - 1
        if code == _END:
            break
        if code == _CLEAR:
            table, width, prev = list(first), 9, b""
            continue
        if code < len(table):
            word = table[code]
        elif prev and code == len(table):
            word = prev + prev[:1]
        else:
            raise ValueError("a code that is not in the table")
        out.append(word)
        size += len(word)
        if most is not None and size >= most:
            break
        if prev:
            table.append(prev + word[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        prev = word
    return b"".join(out)


def inflate(data: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(data, most)


_DECODE = {NONE: lambda data, most: data[:most], LZW: lzw_decode, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: unpack_bits}
# How many bytes one stored byte can stand for at most.
_GROWTH = {NONE: 1, LZW: 4096, DEFLATE: 1040, OLD_DEFLATE: 1040, PACKBITS: 64}
_ENCODE = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 6), PACKBITS: pack_bits}


def write_tiff(pages: list[tuple[np.ndarray, int, int, tuple[int, int] | int]], order: str = "<") -> bytes:
    """A file of pages (rows x columns x samples of 8 bits, compression, predictor, rows of a strip or size of a tile)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image, compression, predictor, cut in pages:
        h, w, s = image.shape
        if isinstance(cut, int):
            parts = [image[y : y + cut] for y in range(0, h, cut)]
        else:
            th, tw = cut
            full = np.pad(image, ((0, -h % th), (0, -w % tw), (0, 0)))
            parts = [full[y : y + th, x : x + tw] for y in range(0, h, th) for x in range(0, w, tw)]
        at, size = [], []
        for p in parts:
            if predictor == 2:
                p = np.diff(p, axis=1, prepend=np.zeros_like(p[:, :1]))
            data = _ENCODE[compression](p.tobytes())
            at.append(len(out))
            size.append(len(data))
            out += data + b"\0" * (len(data) & 1)
        tags = {WIDTH: [w], HEIGHT: [h], BITS: [8] * s, COMPRESSION: [compression], PHOTOMETRIC: [2 if s == 3 else 1], SAMPLES: [s], PLANAR: [1], PREDICTOR: [predictor]}
        tags |= {STRIPS: at, ROWS: [cut], STRIP_BYTES: size} if isinstance(cut, int) else {TILE_WIDTH: [cut[1]], TILE_HEIGHT: [cut[0]], TILES: at, TILE_BYTES: size}
        entries = []
        for tag, values in sorted(tags.items()):
            kind, code = (3, "H") if tag in (BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, PREDICTOR) else (4, "I")
            raw = struct.pack(f"{order}{len(values)}{code}", *values)
            if len(raw) > 4:
                place = len(out)
                out += raw + b"\0" * (len(raw) & 1)
                raw = struct.pack(order + "I", place)
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _tags(data: bytes, order: str, at: int) -> tuple[dict[int, list[int]], int]:
    n = struct.unpack_from(order + "H", data, at)[0]
    found = {}
    for i in range(at + 2, at + 2 + 12 * n, 12):
        tag, kind, count = struct.unpack_from(order + "HHI", data, i)
        if kind in _TYPES:
            size = struct.calcsize(_TYPES[kind]) * count
            place = i + 8 if size <= 4 else struct.unpack_from(order + "I", data, i + 8)[0]
            found[tag] = list(struct.unpack_from(f"{order}{count}{_TYPES[kind]}", data, place))
    return found, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def read_tiff(data: bytes) -> Iterator[tuple[np.ndarray, dict[int, list[int]]]]:
    """Pages in the order of their directories: samples (rows x columns x samples) and tags."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("the directories go in a circle")
        seen.add(at)
        t, at = _tags(data, order, at)
        yield _page(data, t), t


def _page(data: bytes, t: dict[int, list[int]]) -> np.ndarray:
    """The samples of one directory. What the tags claim is held against the file before anything is made."""
    one = lambda tag, default=None: t[tag][0] if t.get(tag) or default is None else default
    w, h, s, scheme, predictor = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
    if t.get(BITS, [1]) != [8] * s or one(PLANAR, 1) != 1:
        raise ValueError("only 8-bit samples stored chunky are read")
    if scheme not in _DECODE or predictor not in (1, 2):
        raise ValueError(f"compression {scheme} with predictor {predictor} is not read")
    tiled = TILES in t
    th, tw = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(ROWS, h), h), w)
    places, sizes = (t[TILES], t[TILE_BYTES]) if tiled else (t[STRIPS], t[STRIP_BYTES])
    if min(w, h, s, th, tw) < 1:
        raise ValueError("an image without extent")
    across = -(-w // tw)
    if len(places) != across * -(-h // th) or len(sizes) != len(places):
        raise ValueError("strips or tiles do not cover the image")
    needs = [(th if tiled else min(th, h - k // across * th)) * tw * s for k in range(len(places))]
    if any(a + n > len(data) or n * _GROWTH[scheme] < need for a, n, need in zip(places, sizes, needs, strict=True)):
        raise ValueError("the file is too short for its image")
    parts = []
    for a, n, need in zip(places, sizes, needs, strict=True):
        raw = _DECODE[scheme](data[a : a + n], need)[:need]
        if len(raw) < need:
            raise ValueError("a strip or tile is too short")
        part = np.frombuffer(raw, np.uint8).reshape(-1, tw, s)
        parts.append(np.cumsum(part, axis=1, dtype=np.uint8) if predictor == 2 else part)
    if not tiled:
        return np.concatenate(parts)
    image = np.empty((h, w, s), np.uint8)
    for k, part in enumerate(parts):
        y, x = k // across * th, k % across * tw
        image[y : y + th, x : x + tw] = part[: h - y, : w - x]
    return image


def tiff_pages(media: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row for each page of each TIFF in the column ``media``.

    media: media (binary) and the columns to ``keep``; other columns are left aside. A null
    or empty file has no page; one that is broken, or claims more than its bytes can hold,
    has a single row, with page -1 and its error, and none of its pages. Pages of a file follow each other in order, in one task; repeated rows are read
    one by one, and an empty table gives an empty result. All of a file is held at once.

    Returns the kept columns, page, n_pages (on the last page, else null), width, height,
    samples, compression, pixels (binary), error.
    """
    keep = keep or []
    kept = media.select(*keep, "media")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    schema = (fields + ", " if fields else "") + "page int, n_pages int, width int, height int, samples int, compression int, pixels binary, error string"
    names = [*keep, "page", "n_pages", "width", "height", "samples", "compression", "pixels", "error"]
    types = [pa.int32()] * 6 + [pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = []
            source: list[int] = []
            size = 0

            def flush(b: pa.RecordBatch = b) -> pa.RecordBatch:
                own = b.take(pa.array(source, pa.int64()))
                cols = zip(*rows, strict=True)
                return pa.RecordBatch.from_arrays([*own.columns[:-1], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

            for i, m in enumerate(b.column(b.num_columns - 1)):
                data = m.as_py()
                if not data:
                    continue
                try:
                    pages = list(read_tiff(data))
                    found = [[k, len(pages) if k == len(pages) - 1 else None, im.shape[1], im.shape[0], im.shape[2], t.get(COMPRESSION, [1])[0], im.tobytes(), None] for k, (im, t) in enumerate(pages)]
                except (ValueError, LookupError, ArithmeticError, MemoryError, struct.error, zlib.error) as e:
                    found = [[-1, None, None, None, None, None, None, f"{type(e).__name__}: {e}"]]
                rows += found
                source += [i] * len(found)
                size += sum(len(r[6] or b"") for r in found)
                if size > 4 << 20:
                    yield flush()
                    rows, source, size = [], [], 0
            if rows:
                yield flush()

    return kept.mapInArrow(run, schema)


_SCHEMES = [(DEFLATE, 1), (PACKBITS, 1), (LZW, 1), (DEFLATE, 2), (NONE, 1), (DEFLATE, 1), (PACKBITS, 2), (NONE, 2)]


def text_tiff(payload: bytes, page_rows: int = 256) -> bytes:
    """The payload (a multiple of 192 bytes) as pages of 64 pixels of 3 samples a row; scheme, tiling and byte order follow its checksum."""
    crc = zlib.crc32(payload)
    rows = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3)
    pages = []
    for k, y in enumerate(range(0, len(rows), page_rows)):
        scheme, predictor = _SCHEMES[(crc + k) % len(_SCHEMES)]
        part = rows[y : y + page_rows]
        cut = (16, 32) if (crc >> 8) % 4 == 0 and len(part) % 16 == 0 else 64
        pages.append((part, scheme, predictor, cut))
    return write_tiff(pages, "<>"[crc >> 16 & 1])
