"""TIFF pages as rows.

read_pages walks the image directories of a file in either byte order, decodes strips and tiles stored plainly or by
PackBits, LZW or deflate, undoes the horizontal predictor, and gives one row a page. write_pages stores 8-bit
samples in the same forms. Tag and code numbers are those of the format.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm import kernel
from threadlake.session import ship

#: Fixed values of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 317, 322, 323, 324, 325
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
CLEAR, STOP = 256, 257

COLUMNS = 192
PAGE_ROWS = 4096
#: How a text is stored follows from its checksum alone, whatever its length.
CODECS = (LZW, PACKBITS, PACKBITS, DEFLATE, DEFLATE, DEFLATE, DEFLATE, DEFLATE)


def pack_bits(raw: bytes) -> bytes:
    """Runs of three bytes or more as repeats, what lies between them as it is, in pieces of 128 at most. Runs are found by arrays."""
    x = np.frombuffer(raw, np.uint8)
    edge = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]]) if len(x) else np.zeros(1, np.int64)
    long = np.flatnonzero(np.diff(edge) >= 3)
    out, at = [], 0
    for a, b in [*zip(edge[long].tolist(), edge[long + 1].tolist(), strict=True), (len(raw), len(raw))]:
        for i in range(at, a, 128):
            out += bytes((min(a - i, 128) - 1,)), raw[i : min(i + 128, a)]
        for i in range(a, b, 128):
            # a last single byte is stored as it is
            n = min(128, b - i)
            out.append(bytes((257 - n if n > 1 else 0, raw[i])))
        at = b
    return b"".join(out)


def unpack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += c + 2
        elif c > 128:
            out += data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
    return bytes(out)


def _width(following: np.ndarray) -> np.ndarray:
    """Bits of a code that is written when the next free code is following: it grows one code early, as the format has it."""
    return 9 + (following >= 512) + (following >= 1024) + (following >= 2048)


def pack_lzw(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first. Codes are looked up by pairs of code and byte, and laid into bits by arrays."""
    codes, table, following, w = [CLEAR], {}, 258, -1
    free = [257]  # the next free code when each code is written; the first is written with 9 bits
    for c in raw:
        k = w << 8 | c
        if w < 0:
            w = c
        elif (found := table.get(k)) is not None:
            w = found
        else:
            codes.append(w)
            free.append(following)
            table[k] = following
            following += 1
            if following == 4094:
                codes.append(CLEAR)
                free.append(following)
                table, following = {}, 258
            w = c
    if w >= 0:
        codes.append(w)
        free.append(following)
        following += 1
    codes.append(STOP)
    free.append(following)
    width = _width(np.array(free))[:, None]
    place = np.arange(12)
    bits = np.array(codes)[:, None] >> np.maximum(width - 1 - place, 0) & 1
    return np.packbits(bits[place < width].astype(np.uint8)).tobytes()


_FREE = 257 + np.arange(1, 4096 - 257)
_WIDTHS = _width(_FREE)
_ENDS = np.cumsum(_WIDTHS)


def _expand(codes: np.ndarray) -> np.ndarray:
    """The bytes of the codes between two clear codes. Entry 258 + i is code i's text and the byte behind it, so every code but the first 256 repeats earlier output."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint8)
    if codes[0] > 255 or (codes - 258 >= np.arange(n)).any():
        raise ValueError("an LZW code is used before it is made")
    back = codes >= 258
    # lengths, then places: each pointer is replaced by that of what it points to until all point to single bytes
    parent, size = np.where(back, codes - 258, n), np.ones(n + 1, np.int64)
    parent = np.append(parent, n)
    size[n] = 0
    while (parent < n).any():
        size = size + size[parent]
        parent = parent[parent]
    size = size[:n]
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(n), size)
    place = np.arange(len(owner))
    source = np.where(back[owner], start[np.where(back, codes - 258, 0)][owner] + place - start[owner], place)
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    return codes[owner[source]].astype(np.uint8)


def unpack_lzw(data: bytes) -> bytes:
    """The codes up to each clear code are read at once, as their widths follow from their number; data may end without a stop code."""
    d = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.int64)
    out, at, total = [], 0, 8 * len(data)
    first = True
    while True:
        # the code before the first clear code, and all after it, are written as if 257 + their place were free
        widths, ends = (_WIDTHS[:1], _ENDS[:1]) if first else (_WIDTHS, _ENDS)
        ends = at + ends[at + ends <= total]
        begin = ends - widths[: len(ends)]
        k = begin >> 3
        codes = (d[k] << 16 | d[k + 1] << 8 | d[k + 2]) >> (24 - (begin & 7) - widths[: len(ends)]) & (1 << widths[: len(ends)]) - 1
        stop = np.flatnonzero((codes == CLEAR) | (codes == STOP))
        if first and (not len(codes) or codes[0] != CLEAR):
            if len(codes) and codes[0] == STOP or not len(data):
                return b""
            raise ValueError("LZW data do not begin with a clear code")
        n = int(stop[0]) if len(stop) else len(codes)
        out.append(_expand(codes[:n]).tobytes())
        if not len(stop) or codes[n] == STOP:
            return b"".join(out)
        at, first = int(ends[n]), False


def compress(raw: bytes, code: int) -> bytes:
    return {PLAIN: bytes, PACKBITS: pack_bits, LZW: pack_lzw, DEFLATE: lambda x: zlib.compress(x, 1)}[code](raw)


def decompress(data: bytes, code: int) -> bytes:
    if code in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    found = {PLAIN: bytes, PACKBITS: unpack_bits, LZW: unpack_lzw}.get(code)
    if found is None:
        raise ValueError(f"unknown compression {code}")
    return found(data)


def write_pages(pages: list[np.ndarray], code: int, predictor: int, tile: int, order: str = "<") -> bytes:
    """A file of 8-bit pages (rows, columns[, samples]); tile is the side of square tiles, or 0 for strips of 64 rows."""
    return bytes(_written(pages, code, predictor, tile, order))


def _written(pages: list[np.ndarray], code: int, predictor: int, tile: int, order: str) -> bytearray:
    out = bytearray(b"II" if order == "<" else b"MM")
    out += struct.pack(order + "HI", 42, 0)
    link = 4
    for page in pages:
        x = page if page.ndim == 3 else page[:, :, None]
        h, w, s = x.shape
        step_h, step_w = (tile, tile) if tile else (64, w)
        offsets, sizes = [], []
        for top in range(0, h, step_h):
            for left in range(0, w, step_w):
                part = x[top : top + step_h, left : left + step_w]
                if tile and part.shape[:2] != (tile, tile):
                    part = np.pad(part, ((0, tile - part.shape[0]), (0, tile - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                data = compress(part.tobytes(), code)
                offsets.append(len(out))
                sizes.append(len(data))
                out += data
        tags: list[tuple[int, str, list[int]]] = [(WIDTH, "I", [w]), (HEIGHT, "I", [h]), (BITS, "H", [8] * s), (COMPRESSION, "H", [code]), (PHOTOMETRIC, "H", [1]), (SAMPLES, "H", [s]), (PREDICTOR, "H", [predictor])]
        tags += [(TILE_WIDTH, "I", [tile]), (TILE_HEIGHT, "I", [tile]), (TILE_OFFSETS, "I", offsets), (TILE_BYTES, "I", sizes)] if tile else [(STRIP_OFFSETS, "I", offsets), (STRIP_ROWS, "I", [64]), (STRIP_BYTES, "I", sizes)]
        entries = []
        for tag, kind, values in sorted(tags):
            raw = struct.pack(f"{order}{len(values)}{kind}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                raw, at = struct.pack(order + "I", len(out)), raw
                out += at
            entries.append(struct.pack(order + "HHI", tag, 3 if kind == "H" else 4, len(values)) + raw.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return out


def read_pages(data: bytes) -> Iterator[dict]:
    """page, width, height, samples, compression, predictor, tiled, pixels of every image directory, in file order. Broken files raise ValueError."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF file")
    order = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen or at + 2 > len(data):
            raise ValueError("image directories loop or leave the file")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags: dict[int, tuple] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind not in KINDS:
                continue
            form = f"{order}{count}{KINDS[kind]}"
            place = at + 10 + 12 * i
            if struct.calcsize(form) > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            if place + struct.calcsize(form) > len(data):
                raise ValueError("a tag leaves the file")
            tags[tag] = struct.unpack_from(form, data, place)
        one = lambda tag, default: tags.get(tag, (default,))[0]  # noqa: B023, E731
        w, h, s, code, predictor = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(COMPRESSION, PLAIN), one(PREDICTOR, 1)
        if any(b != 8 for b in tags.get(BITS, (1,))) or predictor not in (1, 2):
            raise ValueError("only 8-bit samples and the horizontal predictor are read")
        tiled = TILE_OFFSETS in tags
        step_h, step_w = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(STRIP_ROWS, h), h) or 1, w)
        offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags.get(STRIP_OFFSETS, ()), tags.get(STRIP_BYTES, ()))
        pixels = np.zeros((h, w, s), np.uint8)
        across = -(-w // step_w) if w else 0
        for k, (o, size) in enumerate(zip(offsets, sizes, strict=True)):
            top, left = k // across * step_h, k % across * step_w
            rows = step_h if tiled else min(step_h, h - top)
            part = np.frombuffer(decompress(bytes(data[o : o + size]), code), np.uint8)
            if len(part) < rows * step_w * s:
                raise ValueError("a strip or tile is too short")
            part = part[: rows * step_w * s].reshape(rows, step_w, s)
            if predictor == 2:
                part = np.cumsum(part, axis=1, dtype=np.uint8)
            keep = pixels[top : top + rows, left : left + step_w]
            keep[:] = part[: keep.shape[0], : keep.shape[1]]
        yield {"page": len(seen) - 1, "width": w, "height": h, "samples": s, "compression": code, "predictor": predictor, "tiled": tiled, "pixels": pixels.tobytes()}
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


PAGE = "page int, width int, height int, samples int, compression int, predictor int, tiled boolean, pixels binary, error string"
_TYPES = [pa.int32()] * 6 + [pa.bool_(), pa.binary(), pa.string()]
_FIELDS = ["page", "width", "height", "samples", "compression", "predictor", "tiled", "pixels", "error"]


#: Bytes of rows that are sent on together, one row at least.
SENT_BYTES = 4 << 20


def _stretches(sizes: Iterator[int], rows: int = 64) -> Iterator[tuple[int, int]]:
    """Ranges of so many rows or SENT_BYTES each, one row at least."""
    lo, hi, held = 0, 0, 0
    for n in sizes:
        if hi > lo and (hi - lo >= rows or held + n > SENT_BYTES):
            yield lo, hi
            lo, held = hi, 0
        hi, held = hi + 1, held + n
    if hi > lo:
        yield lo, hi


def _binary(values: list[bytes | bytearray | None]) -> pa.Array:
    """A binary column; a value alone is not copied."""
    if len(values) == 1 and values[0] is not None:
        return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, len(values[0])], np.int32).tobytes()), pa.py_buffer(values[0])])
    return pa.array(values, pa.binary())


def _pages(batches: Iterator[pa.RecordBatch], keys: list[str], media: str) -> Iterator[pa.RecordBatch]:
    """The rows of tiff_pages; a few pages of a file are in memory beside the file."""
    types = [*[pa.int64()] * len(keys), pa.binary(), *_TYPES]
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        rows.clear()
        return pa.RecordBatch.from_arrays([_binary(list(c)) if k == len(keys) else pa.array(c, t) for k, (c, t) in enumerate(zip(cols, types, strict=True))], [*keys, media, *_FIELDS])

    for batch in batches:
        for i in range(batch.num_rows):
            k = [batch.column(c)[i].as_py() for c in range(len(keys))]
            file = batch.column(len(keys))[i]
            if not file.is_valid:
                continue
            data, first, held = memoryview(file.as_buffer()).cast("B"), True, 0
            try:
                for p in read_pages(data):
                    if held + len(p["pixels"]) > SENT_BYTES and rows:
                        yield flush()
                        held = 0
                    rows.append((*k, data if first else None, *(p.get(f) for f in _FIELDS)))
                    first, held = False, held + len(p["pixels"])
            except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                rows.append((*k, data if first else None, *[None] * 8, str(e)))
            if len(rows) >= 64 or held + len(data) > SENT_BYTES:
                yield flush()
    if rows:
        yield flush()


def tiff_pages(files: DataFrame, keys: tuple[str, ...] = ("doc_id",), media: str = "media") -> DataFrame:
    """One row a page of files(keys long, media binary, ...): keys, media and the columns of PAGE, a file's pages in order next to each other.

    media is the file on the row of its first page and null on the others. Null media give no row; a file that cannot be read gives the pages before the fault and one row with error. Repeated
    files are each read; other columns are ignored; an empty table gives an empty result.
    """
    ship(files.sparkSession)
    names = list(keys)
    schema = ", ".join(f"{k} long" for k in names) + f", {media} binary, {PAGE}"
    return files.select(*[F.col(k).cast("long").alias(k) for k in names], F.col(media)).mapInArrow(lambda batches: _pages(batches, names, media), schema)


def _images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = kernel.utf8(batch.column(1))
        for lo, hi in _stretches(iter(np.diff(offs).tolist())):
            sizes, out = [], []
            for i in range(lo, hi):
                n = int(offs[i + 1] - offs[i])
                sizes.append(n)
                raw = np.full(max(1, -(-n // COLUMNS)) * COLUMNS, 32, np.uint8)
                raw[:n] = data[offs[i] : offs[i + 1]]
                crc = zlib.crc32(raw)
                code = CODECS[crc % 8]
                x = raw.reshape(-1, COLUMNS)
                tile = 64 if crc >> 8 & 3 == 0 else 0
                out.append(_written([x[i : i + PAGE_ROWS] for i in range(0, len(x), PAGE_ROWS)], code, 1 if code == PACKBITS else 1 + (crc >> 10 & 1), tile, "<" if crc >> 12 & 1 else ">"))
                del raw, x
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), _binary(out)], ["doc_id", "n_bytes", "media"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_images(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text of docs as UTF-8, padded with blanks to a positive multiple of COLUMNS, as pages of 8-bit grey samples.

    The form depends on the text's checksum alone: PackBits, LZW or deflate, with predictor or tiles or without, in either
    byte order. Null text counts as empty. Null doc_ids and repeated rows are kept; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    return _texts(docs).mapInArrow(_images, "doc_id long, n_bytes long, media binary")


class _Digest:
    """Sizes, digests and features of one document, page by page."""

    def __init__(self, doc_id: int | None, n_bytes: int, media: memoryview) -> None:
        self.ids, self.media_bytes, self.media_sha256 = (doc_id, n_bytes), len(media), hashlib.sha256(media).hexdigest()
        self.pages, self.size, self.edges, self.tail = 0, 0, 0, b""
        self.sha, self.count = hashlib.sha256(), np.zeros(256, np.int64)

    def add(self, pixels: memoryview) -> None:
        x = np.frombuffer(pixels, np.uint8)
        self.sha.update(pixels)
        self.count += np.bincount(x, minlength=256)
        self.edges += int(np.count_nonzero(x[1:] != x[:-1])) + bool(self.tail and len(x) and x[0] != self.tail[-1])
        self.pages, self.size, self.tail = self.pages + 1, self.size + len(x), (self.tail + bytes(pixels[-16:]))[-16:]

    def row(self) -> tuple:
        share = self.count[self.count > 0] / self.size
        mean = int((self.count * np.arange(256)).sum()) / self.size
        feature = f"pages={self.pages};rows={self.size // COLUMNS};mean={mean:.4f};levels={len(share)};entropy={-(share * np.log2(share)).sum():.4f};edges={self.edges}"
        return (*self.ids, self.size, self.sha.hexdigest(), zlib.crc32(self.tail), self.media_bytes, self.media_sha256, feature)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    out: list[tuple] = []
    now: _Digest | None = None

    def flush() -> pa.RecordBatch:
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    for batch in batches:
        for i in range(batch.num_rows):
            doc_id, n_bytes, page, error = (batch.column(c)[i].as_py() for c in ("doc_id", "n_bytes", "page", "error"))
            if error:
                raise ValueError(error)
            if page == 0:
                if now:
                    out.append(now.row())
                now = _Digest(doc_id, n_bytes, memoryview(batch.column("media")[i].as_buffer()).cast("B"))
            now.add(memoryview(batch.column("pixels")[i].as_buffer()).cast("B"))
        if len(out) >= 512:
            yield flush()
    if now:
        out.append(now.row())
    if out:
        yield flush()


def text_image_digests(docs: DataFrame) -> DataFrame:
    """One row a document: its text stored by text_images, read back by tiff_pages, and the sizes, digests and features of the samples.

    The three steps share a worker, and a document's pages stay next to each other, so nothing is shuffled. Null text counts as
    empty; null doc_ids and repeated rows are kept; other columns are ignored; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _texts(docs).mapInArrow(lambda batches: _digests(_pages(_images(batches), ["doc_id", "n_bytes"], "media")), schema)
