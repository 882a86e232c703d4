"""Columnar archives, the formats: container directory, column locators, blob envelopes and page maps, from bytes.

`codecs` has the transforms of blob contents, `columns` reads members and row windows by byte range, `relations` makes
DataFrames of them and `writer` writes archives.  Integers are little-endian.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

# Magics, entry types, magic of column indexes, the polynomial of the blob checksum.
MAGIC, BYTE_ORDER, COLUMN_MAGIC, POLYNOMIAL = b"NCBI.sra", 0x05031988, 0x05031988, 0x04C11DB7
DIRECTORY, FILE, CHUNKED, SOFTLINK, EMPTY, HEADER_BYTES = 1, 2, 3, 4, 6, 24
MOST_ROWS, MOST_RATIO = 1_000_000_000, 1024


class FormatError(ValueError):
    pass


@dataclass(frozen=True)
class Entry:
    path: str
    kind: str
    offset: int = 0
    size: int = 0
    target: str | None = None


def tree_nodes(buffer: bytes) -> list[bytes]:
    """The payloads of a stored search tree: a count, a size, offsets as wide as the size asks for, the payloads."""
    if len(buffer) < 4:
        raise FormatError("a tree ends within its count")
    n = int.from_bytes(buffer[:4], "little")
    if not n:
        return []
    size = int.from_bytes(buffer[4:8], "little")
    kind = np.dtype("<u1" if size <= 256 else "<u2" if size <= 65536 else "<u4")
    body = 8 + n * kind.itemsize
    if body + size > len(buffer):
        raise FormatError("a tree ends within its nodes")
    edges = np.append(np.frombuffer(buffer, kind, n, 8).astype(np.int64), size)
    if (np.diff(edges) < 0).any():
        raise FormatError("a tree's nodes overlap")
    return [buffer[body + a : body + b] for a, b in zip(edges, edges[1:], strict=False)]


def entries(node: bytes, above: str = "") -> list[Entry]:
    """A directory node and all below it, depth first."""
    try:
        n = struct.unpack_from("<H", node)[0]
        name = node[2 : 2 + n].decode()
        at = 2 + n + 12  # a time and an access mode lie between
        code, at = node[at], at + 1
        path = f"{above}/{name}" if above else name
        if code in (FILE, CHUNKED):
            return [Entry(path, "file" if code == FILE else "chunked", *struct.unpack_from("<QQ", node, at))]
        if code == EMPTY:
            return [Entry(path, "empty")]
        if code == SOFTLINK:
            k = struct.unpack_from("<H", node, at)[0]
            return [Entry(path, "softlink", target=node[at + 2 : at + 2 + k].decode())]
        if code == DIRECTORY:
            return [Entry(path, "dir"), *(e for child in tree_nodes(node[at:]) for e in entries(child, path))]
    except (struct.error, IndexError, UnicodeDecodeError) as e:
        raise FormatError("a directory node is cut short") from e
    if code in (0, 5, 7):
        return []
    raise FormatError(f"unknown entry type {code}")


def read_toc(head: bytes) -> tuple[int, list[Entry]]:
    """(where data begin, entries) from an archive's first bytes, or as many of them as its header asks for."""
    if head[:8] != MAGIC:
        raise FormatError("not an archive")
    order = int.from_bytes(head[8:12], "little")
    if order not in (BYTE_ORDER, int.from_bytes(BYTE_ORDER.to_bytes(4, "big"), "little")):
        raise FormatError("unknown byte order")
    version, data = struct.unpack_from("<IQ" if order == BYTE_ORDER else ">IQ", head, 12)
    if version != 1:
        raise FormatError(f"version {version}")
    return data, [e for node in tree_nodes(head[HEADER_BYTES:data]) for e in entries(node)]


def resolve(toc: list[Entry], path: str, hops: int = 8) -> Entry:
    """The file behind a path, through softlinks."""
    by = {e.path: e for e in toc}
    while hops:
        e = by.get(path)
        if e is None:
            raise FormatError(f"no member {path}")
        if e.kind != "softlink":
            return e
        base = [] if e.target.startswith("/") else path.split("/")[:-1]
        for part in e.target.strip("/").split("/"):
            base = base[:-1] if part == ".." else base if part in (".", "") else [*base, part]
        path, hops = "/".join(base), hops - 1
    raise FormatError(f"softlinks of {path} go in a circle")


@dataclass(frozen=True)
class Blob:
    start_id: int
    id_range: int
    page: int
    size: int


LOCATOR = np.dtype([("page", "<u8"), ("gen", "<u4"), ("id_range", "<u4"), ("start_id", "<i8")])
#: Bytes of (header, double, single) that a section of a block has, by its type; ids first, then pages.
SECTIONS = {0: (0, 8, 4), 1: (4, 8, 0), 2: (8, 0, 4), 3: (0, 0, 0)}


def direct_blobs(buffer: bytes, count: int) -> list[Blob]:
    """Locators of the oldest layout, by first row."""
    rows = np.frombuffer(buffer, LOCATOR, min(count, len(buffer) // LOCATOR.itemsize))
    places = (rows["start_id"], rows["id_range"], rows["page"], rows["gen"] & 0x7FFFFFFF)
    return sorted(map(Blob, *(p.tolist() for p in places)), key=lambda b: b.start_id)


def block_blobs(data: bytes, block: np.void) -> list[Blob]:
    """The blobs of one block: ids and pages are each listed, uniform, accumulated or predicted."""
    gen = int(block["gen"])
    size, ids, pages = gen & 0x07FFFFFF, gen >> 27 & 3, gen >> 29 & 3
    ih, idd, iss = SECTIONS[ids]
    ph, pd, ps = (12, 0, 0) if pages == 3 else SECTIONS[pages]
    each = idd + iss + pd + ps
    n = size if ids == pages == 3 else (size - ih - ph) // each if each and size > ih + ph else 0
    if not n:
        return []
    at = ih + ph
    if at + each * n > len(data):
        raise FormatError("an index block is cut short")

    def take(kind: str, width: int) -> np.ndarray | None:
        nonlocal at
        if not width:
            return None
        out = np.frombuffer(data, kind, n, at)
        at += width * n
        return out

    id_wide, page_wide, id_short, page_short = take("<u8", idd), take("<u8", pd), take("<u4", iss), take("<u4", ps)

    def section(kind: int, wide, short, base: int, first: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        if kind == 0:
            return wide, short
        if kind == 1:
            return wide, np.full(n, struct.unpack_from("<I", data, base)[0])
        if kind == 2:
            begin = struct.unpack_from("<Q", data, base)[0]
            return begin + np.concatenate([[0], np.cumsum(short[:-1].astype(np.int64))]), short
        return first + step * np.arange(n), np.full(n, step)

    per = int(block["id_range"]) // n
    predicted = struct.unpack_from("<QI", data, ih) if pages == 3 else (0, 0)
    starts, ranges = section(ids, id_wide, id_short, 0, int(block["start_id"]), max(per, 1) if int(block["id_range"]) == n else per)
    places, sizes = section(pages, page_wide, page_short, ih, *predicted)
    return [Blob(*map(int, row)) for row in zip(starts, ranges, places, sizes, strict=True)]


def column_blobs(idx1: bytes, idx2: bytes = b"") -> list[Blob]:
    """All blobs of a column, by first row."""
    if len(idx1) < 8 or int.from_bytes(idx1[:4], "little") != COLUMN_MAGIC:
        raise FormatError("not a column index")
    if int.from_bytes(idx1[4:8], "little") <= 1:
        return direct_blobs(idx1[40:], int.from_bytes(idx1[24:28], "little"))
    blocks = np.frombuffer(idx1, LOCATOR, (len(idx1) - 8) // LOCATOR.itemsize, 8)
    found = [b for k in blocks for b in block_blobs(idx2[int(k["page"]) : int(k["page"]) + (int(k["gen"]) & 0x07FFFFFF)], k)]
    return sorted(found, key=lambda b: b.start_id)


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 24
        for _ in range(8):
            c = (c << 1 ^ (POLYNOMIAL if c & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(c)
    return out


CRC_TABLE = _crc_table()


def checksum(data: bytes) -> int:
    """CRC-32, highest bit first, begun at 0, not inverted."""
    c = 0
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ CRC_TABLE[c >> 24 ^ b]
    return c


@dataclass
class Cursor:
    """Numbers of seven bits a byte, the highest first, the top bit saying that more follow."""

    data: bytes
    at: int = 0

    def byte(self) -> int:
        if self.at >= len(self.data):
            raise FormatError("a number is cut short")
        self.at += 1
        return self.data[self.at - 1]

    def unsigned(self) -> int:
        value = 0
        for _ in range(10):
            b = self.byte()
            value = (value << 7 | b & 0x7F) & 0xFFFFFFFFFFFFFFFF
            if not b & 0x80:
                return value
        raise FormatError("a number is too long")

    def signed(self) -> int:
        b = self.byte()
        negative, value, left = b & 0x40, b & 0x3F, 9
        while b & 0x80:
            if not left:
                raise FormatError("a number is too long")
            b, left = self.byte(), left - 1
            value = value << 7 | b & 0x7F
        return -value if negative else value

    def many(self, n: int) -> list[int]:
        if n > len(self.data) * 8:
            raise FormatError("more numbers than bytes can hold")
        return [self.unsigned() for _ in range(n)]


@dataclass
class PageMap:
    lengths: list[int]
    leng_runs: list[int]
    kind: str = "identity"
    map: list[int] = field(default_factory=list)


def inflate(data: bytes, raw: bool = True) -> bytes:
    """Bounded against data that unfold without end."""
    most = max(1 << 20, len(data) * MOST_RATIO)
    out = zlib.decompressobj(-15 if raw else 15).decompress(data, most + 1)
    if len(out) > most:
        raise FormatError("data unfold beyond all measure")
    return out


def page_map(data: bytes, rows: int) -> PageMap:
    """Bit 0 of the variant: records serve several rows; bit 1: lengths vary.  Later versions deflate what follows the
    counts; version 2 adds each row's offset."""
    if not data or rows > MOST_ROWS:
        raise FormatError("no page map, or one of too many rows")
    version, variant = data[0] >> 2, data[0] & 3
    if version > 2:
        raise FormatError(f"page map version {version}")
    repeats, varied, offsets = variant & 1, variant & 2, version == 2
    if offsets and repeats:
        raise FormatError("offsets and repeats exclude one another")
    c = Cursor(data, 1)
    first = c.unsigned()
    records = c.unsigned() if repeats else rows
    if version and (variant or offsets):
        c = Cursor(inflate(data[c.at :]))
    if varied:
        lengths, runs = c.many(first), c.many(first)
    else:
        lengths, runs = [first], [rows]
    if repeats:
        return PageMap(lengths, runs, "repeats", c.many(records))
    return PageMap(lengths, runs, "offsets", c.many(rows)) if offsets else PageMap(lengths, runs)


@dataclass(frozen=True)
class Frame:
    flags: int
    version: int
    format: int
    size: int
    ops: bytes
    args: tuple[int, ...]


def frames(data: bytes) -> list[Frame]:
    """The transforms that a blob's header lists, outermost first."""
    if not data or data[0]:
        raise FormatError("unknown header layout")
    c, out = Cursor(data, 1), []
    while c.at < len(data):
        flags, version = c.byte(), c.byte()
        kind, size, n_ops, n_args = (c.signed() for _ in range(4))
        ops, c.at = data[c.at : c.at + n_ops], c.at + n_ops
        if len(ops) < n_ops:
            raise FormatError("a header is cut short")
        out.append(Frame(flags, version, kind, size, ops, tuple(c.signed() for _ in range(n_args))))
    return out


def envelope(raw: bytes, rows: int) -> tuple[list[Frame], PageMap | None, bytes, int]:
    """(frames, page map, data, bits to drop at the end) of a blob without its checksum."""
    if not raw:
        raise FormatError("an empty blob")
    head = raw[0]
    if not head & 0x80:
        width = (1, 2, 4, 0)[head >> 5 & 3]
        length = int.from_bytes(raw[1 : 1 + width], "little") if width else 1
        return [], PageMap([length], [rows]), raw[1 + width :], head >> 2 & 7
    if head >> 6 != 2:
        raise FormatError(f"blob version {head >> 6}")
    wide = {0: (1, 1), 1: (1, 2), 2: (1, 4), 3: (4, 4)}[head >> 4 & 3]
    sizes = int.from_bytes(raw[1 : 1 + wide[0]], "little"), int.from_bytes(raw[1 + wide[0] : 1 + sum(wide)], "little")
    a = 1 + sum(wide)
    b, c = a + sizes[0], a + sum(sizes)
    if c > len(raw):
        raise FormatError("a blob is shorter than its header tells")
    return frames(raw[a:b]) if sizes[0] else [], page_map(raw[b:c], rows) if sizes[1] else None, raw[c:], -(head & 7) & 7
