"""Media columns: grey-scale TIFF, written and read without an imaging library.

The reader walks the chain of image directories, decodes strips or tiles that are plain, PackBits, LZW
or deflate, undoes horizontal differencing, and yields one row per page. The writer makes pages of 8-bit
samples in strips or tiles of any of these forms."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_arrow, slices

#: Tags and codes of the public TIFF 6.0 format: fixed values.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, COUNTS, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)
_TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}


@dataclass
class Page:
    width: int
    height: int
    compression: int
    predictor: int
    parts: int
    samples: bytes


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128 and at + 1 < len(data):
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three equal bytes or more, of 128 at most, and what is between them as it is, 128 bytes at a time."""
    out, at = bytearray(), 0
    for run in [*((m.start(), m.end()) for m in _RUN.finditer(data)), (len(data), len(data))]:
        for start in range(at, run[0], 128):
            part = data[start : min(start + 128, run[0])]
            out.append(len(part) - 1)
            out += part
        at = run[1]
        if at > run[0]:
            out += bytes((257 - (at - run[0]), data[run[0]]))
    return bytes(out)


#: Codes between two clearings at most, and the width of the k-th code after one (widened one code early).
_CODES = 3838
_WIDTHS = np.array([9, *(9 + (n >= 511) + (n >= 1023) + (n >= 2047) for n in range(258, 258 + _CODES - 1))])
_CLEAR, _STOP = 256, 257
_BYTES = [bytes((i,)) for i in range(256)]


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first. Where a code stands follows from how many came since the table was
    cleared, so all codes up to the next clearing are read at once."""
    padded = np.frombuffer(data + bytes(4), np.uint8).astype(np.int64)
    words = padded[:-2] << 16 | padded[1:-1] << 8 | padded[2:]
    out, at, total, widths = bytearray(), 0, 8 * len(data), _WIDTHS
    table, last = [*_BYTES, b"", b""], b""
    while at + 9 <= total:
        ends = at + np.cumsum(widths)
        fits = int(np.searchsorted(ends, total, "right"))
        ends, width = ends[:fits], widths[:fits]
        first = ends - width
        codes = words[first >> 3] >> (24 - width - (first & 7)) & ((1 << width) - 1)
        marks = np.flatnonzero((codes == _CLEAR) | (codes == _STOP))
        stop = int(marks[0]) if len(marks) else fits
        for code in codes[:stop].tolist():
            if last:
                entry = table[code] if code < len(table) else last + last[:1]
                table.append(last + entry[:1])
            else:
                entry = table[code]
            out += entry
            last = entry
        if stop < fits and codes[stop] == _CLEAR:
            table, last, widths, at = [*_BYTES, b"", b""], b"", _WIDTHS, int(ends[stop])
        elif stop == fits == _CODES:  # never cleared: codes stay as wide as they are
            widths, at = np.full(_CODES, 12), int(ends[-1])
        else:
            break
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    """The writer's side of unpack_lzw. A word is known by the code of all but its last byte, and that byte."""
    codes, widths, known, size, width = [_CLEAR], [9], {}, 258, 9
    word = -1
    for byte in data:
        if word < 0:
            word = byte
            continue
        longer = word << 8 | byte
        code = known.get(longer)
        if code is not None:
            word = code
            continue
        codes.append(word)
        widths.append(width)
        known[longer] = size
        size += 1
        word = byte
        if size == 4094:
            codes.append(_CLEAR)
            widths.append(width)
            known, size, width = {}, 258, 9
        elif size >= 512:
            width = 10 + (size >= 1024) + (size >= 2048)
    if word >= 0:
        codes.append(word)
        widths.append(width)
        size += 1
        width = 9 + (size >= 512) + (size >= 1024) + (size >= 2048)
    codes.append(_STOP)
    widths.append(width)
    widths = np.array(widths)
    bits = (np.array(codes)[:, None] >> np.arange(11, -1, -1) & 1).astype(np.uint8)
    return np.packbits(bits[np.arange(11, -1, -1) < widths[:, None]]).tobytes()


_UNPACK = {NONE: bytes, PACKBITS: unpack_bits, LZW: unpack_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress}
_PACK = {NONE: bytes, PACKBITS: pack_bits, LZW: pack_lzw, DEFLATE: lambda b: zlib.compress(b, 1), OLD_DEFLATE: lambda b: zlib.compress(b, 1)}


def write(payload: bytes, width: int = 64, page_rows: int = 4096, strip_rows: int = 512, compression: int = DEFLATE, predictor: int = 2, tiled: bool = False) -> bytes:
    """payload (a multiple of width, not empty) as pages of at most page_rows rows, in strips or in tiles of
    strip_rows rows (tiles are padded with zeros to whole ones; width and strip_rows are then multiples of 16)."""
    if not payload or len(payload) % width:
        raise ValueError(f"not a positive multiple of {width} bytes")
    if tiled and (width % 16 or strip_rows % 16):
        raise ValueError("tiles are multiples of 16 wide and high")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for top in range(0, len(rows), page_rows):
        page = rows[top : top + page_rows]
        coded = np.diff(page, axis=1, prepend=np.uint8(0)) if predictor == 2 else page
        if tiled:
            coded = np.pad(coded, ((0, -len(coded) % strip_rows), (0, 0)))
        offsets, counts = [], []
        for at in range(0, len(coded), strip_rows):
            part = _PACK[compression](coded[at : at + strip_rows].tobytes())
            offsets.append(len(out))
            counts.append(len(part))
            out += part + b"\0" * (len(part) % 2)
        where = []
        for values in (offsets, counts):
            where.append(values[0] if len(values) == 1 else len(out))
            if len(values) > 1:
                out += struct.pack(f"<{len(values)}I", *values)
        struct.pack_into("<I", out, link, len(out))
        entries = [(WIDTH, 4, 1, width), (HEIGHT, 4, 1, len(page)), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, compression), (PHOTOMETRIC, 3, 1, 1), (SAMPLES, 3, 1, 1), (PREDICTOR, 3, 1, predictor)]
        if tiled:
            entries += [(TILE_WIDTH, 4, 1, width), (TILE_HEIGHT, 4, 1, strip_rows), (TILES, 4, len(offsets), where[0]), (TILE_COUNTS, 4, len(counts), where[1])]
        else:
            entries += [(STRIPS, 4, len(offsets), where[0]), (ROWS, 4, 1, strip_rows), (COUNTS, 4, len(counts), where[1])]
        out += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in sorted(entries))
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


#: Stored forms, one of which a payload gets by its checksum: compression, predictor, tiles.
FORMS = [(DEFLATE, 2, False), (PACKBITS, 1, False), (LZW, 2, True), (DEFLATE, 1, True), (LZW, 1, False), (NONE, 2, True), (PACKBITS, 2, True), (OLD_DEFLATE, 2, True)]


def stored(payload: bytes) -> bytes:
    """payload in the form that its checksum names: equal payloads have equal media."""
    compression, predictor, tiled = FORMS[zlib.crc32(payload) % len(FORMS)]
    return write(payload, strip_rows=64 if tiled else 512, compression=compression, predictor=predictor, tiled=tiled)


def read(media: bytes) -> Iterator[Page]:
    """Pages of 8-bit grey samples, strips or tiles, either byte order; a loop of directories is an error."""
    order = {b"II": "<", b"MM": ">"}.get(media[:2])
    if order is None or struct.unpack_from(order + "H", media, 2)[0] != 42:
        raise ValueError("no TIFF")
    at, seen = struct.unpack_from(order + "I", media, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", media, at)
        tags = {}
        for k in range(n):
            entry = at + 2 + 12 * k
            tag, kind, count = struct.unpack_from(order + "HHI", media, entry)
            if kind in _TYPES:
                size = struct.calcsize(_TYPES[kind]) * count
                place = entry + 8 if size <= 4 else struct.unpack_from(order + "I", media, entry + 8)[0]
                tags[tag] = struct.unpack_from(f"{order}{count}{_TYPES[kind]}", media, place)
        yield _page(media, tags)
        at = struct.unpack_from(order + "I", media, at + 2 + 12 * n)[0]


def _page(media: bytes, tags: dict) -> Page:
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    compression, predictor = tags.get(COMPRESSION, (NONE,))[0], tags.get(PREDICTOR, (1,))[0]
    if tags.get(BITS, (8,)) != (8,) or tags.get(SAMPLES, (1,))[0] != 1 or compression not in _UNPACK or predictor not in (1, 2):
        raise ValueError("only 8-bit grey samples are read")
    tiled = TILES in tags
    offsets, counts = (tags[TILES], tags[TILE_COUNTS]) if tiled else (tags[STRIPS], tags[COUNTS])
    wide, high = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(height, tags.get(ROWS, (height,))[0]))
    image = np.zeros((height, width), np.uint8)
    across = -(-width // wide)
    for k, (offset, count) in enumerate(zip(offsets, counts, strict=True)):
        top, left = k // across * high, k % across * wide
        rows = high if tiled else min(high, height - top)
        part = np.frombuffer(_UNPACK[compression](media[offset : offset + count]), np.uint8)[: rows * wide].reshape(rows, wide)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=np.uint8)
        image[top : top + rows, left : left + wide] = part[: height - top, : width - left]
    return Page(width, height, compression, predictor, len(offsets), image.tobytes())


def _described(media: bytes | None) -> Iterator[tuple[tuple, bytes | None]]:
    """The values of PAGE after n_bytes, and the samples, of each page; of the error at last, if there is one."""
    if media is None:
        yield (None, True, *[None] * 11, "no medium"), None
        return
    digest = hashlib.sha256(media).hexdigest()
    whole, size, height, total, steps, quarters, last = hashlib.sha256(), 0, 0, 0, 0, np.zeros(4, np.int64), None
    pages, k, error = read(media), 0, None
    while error is None:
        try:
            p = next(pages, None)
        except (ValueError, KeyError, IndexError, struct.error, zlib.error, OverflowError, MemoryError) as e:
            p, error = None, f"{type(e).__name__}: {e}"
        if last is not None:
            yield (*last[0][:1], p is None and error is None, *last[0][2:]), last[1]
        if p is None:
            break
        whole.update(p.samples)
        size += len(p.samples)
        height += p.height
        a = np.frombuffer(p.samples, np.uint8).reshape(p.height, p.width)
        total += int(a.sum())
        steps += int((a[:, 1:] != a[:, :-1]).sum())
        quarters += np.bincount(a.ravel() >> 6, minlength=4)
        feature = f"pages={k + 1};rows={height};sum={total};quarters={','.join(map(str, quarters))};steps={steps}"
        last = (k, False, p.width, p.height, p.compression, p.predictor, p.parts, size, whole.copy().hexdigest(), zlib.crc32(p.samples[-64:]), len(media), digest, feature, None), p.samples
        k += 1
    if error is not None:
        yield (None, True, *[None] * 8, len(media), digest, None, error), None


def texts_to_tiff(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8, zero-padded to a positive multiple of 64, as a TIFF.

    Null is empty. Whole texts, however long, over as many pages as they need; repeated rows, null ids and
    other columns don't matter; an empty table gives none."""

    def run(batches):
        for batch in batches:
            for rows in slices(batch, "text"):
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in rows["text"]]
                yield {"doc_id": rows["doc_id"], "n_bytes": [len(b) for b in raw], "media": [stored(b + b"\0" * (-len(b) % 64 or 64 * (not b))) for b in raw]}

    return map_arrow(df.select("doc_id", "text"), run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


PAGE = "doc_id {id}, n_bytes long, page int, is_last boolean, width int, height int, compression int, predictor int, parts int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def tiff_pages(df: DataFrame, samples: bool = False) -> DataFrame:
    """df (doc_id, n_bytes, media) to one row per page; with its samples if asked for.

    payload_bytes, payload_sha256 and feature are running: they hold for the samples up to this page's end,
    so the last page's row speaks for the whole medium. feature: pages, rows, sum of samples, their
    quarters' counts, and how many neighbours in a row differ. A medium that is null, broken or of another
    kind of samples has, after its readable pages, one row more with the error and null page values. Repeated
    rows, null ids and other columns don't matter; an empty table gives none."""

    def run(batches):
        names = [f.split()[0] for f in PAGE.split(", ")]
        for batch in batches:
            out: dict = {k: [] for k in [*names, "samples"]}
            for doc_id, n_bytes, media in zip(batch["doc_id"].to_pylist(), batch["n_bytes"].to_pylist(), batch["media"], strict=True):
                for row, content in _described(media.as_py()):
                    for name, v in zip(names, (doc_id, n_bytes, *row), strict=True):
                        out[name].append(v)
                    if samples:
                        out["samples"].append(content)
            yield out

    schema = PAGE.format(id=df.schema["doc_id"].dataType.simpleString()) + (", samples binary" if samples else "")
    return map_arrow(df.select("doc_id", "n_bytes", "media"), run, schema)


def op6_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tiff_pages(texts_to_tiff(documents(spark, sf_dir)))
    return pages.where("is_last").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
