"""Archives by byte range: members, columns, the blobs of a row window, and decoded rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs

from spotweave.sources import codecs
from spotweave.sources.archive import BYTE_ORDER, HEADER_BYTES, LOCATOR, MAGIC, Blob, Entry, FormatError, PageMap, column_blobs, read_toc, resolve, tree_nodes

#: Bytes between two wanted ranges that are read along rather than asked for apart.
GAP = 1 << 20
# Columns by how their cells are stored.
TEXT, WORDS, BYTES = ("NAME", "SPOT_NAME", "SPOT_GROUP", "NAME_FMT"), ("READ_LEN", "READ_START", "X", "Y", "SPOT_LEN"), ("READ_TYPE", "READ_FILTER", "ALTREAD")
# Column names in the order in which a logical column looks for them.
FALLBACKS = {"QUALITY": ("QUALITY", "ORIGINAL_QUALITY"), "NAME": ("NAME", "SPOT_NAME")}
ALIGNED = ("SEQUENCE", "PRIMARY_ALIGNMENT", "REFERENCE")


def uri_of(path: str) -> str:
    return "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path


class Archive:
    """An archive whose directory is read by two ranges, and members by the ranges that are asked for."""

    def __init__(self, path: str):
        self.path = uri_of(path)
        store, place = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        self.file = store.open_input_file(place)
        head = self.file.read_at(HEADER_BYTES, 0)
        if head[:8] != MAGIC or len(head) < HEADER_BYTES:
            raise FormatError("not an archive")
        data = struct.unpack_from("<Q" if int.from_bytes(head[8:12], "little") == BYTE_ORDER else ">Q", head, 16)[0]
        if data > self.file.size():
            raise FormatError("an archive ends within its directory")
        self.data, self.toc = read_toc(self.file.read_at(data, 0))
        self.members = {e.path: e for e in self.toc}

    def location(self, path: str) -> tuple[int, int] | None:
        """(offset in the archive, size) of a member, through softlinks."""
        if path not in self.members:
            return None
        e = resolve(self.toc, path)
        return (self.data + e.offset, e.size) if e.kind in ("file", "chunked") else (0, 0)

    def range(self, path: str, offset: int, size: int) -> bytes:
        found = self.location(path)
        if found is None:
            raise FormatError(f"no member {path}")
        if offset + size > found[1]:
            raise FormatError(f"{path} ends before byte {offset + size}")
        return self.file.read_at(size, found[0] + offset)

    def read(self, path: str) -> bytes:
        found = self.location(path)
        return b"" if found is None else self.range(path, 0, found[1])

    def tables(self) -> list[str]:
        return sorted({p.split("/")[1] for p in self.members if p.startswith("tbl/") and "/" in p})

    def table(self, name: str | None = None) -> str:
        """The table to read: CONSENSUS before SEQUENCE before the first; "" for an archive that is one table."""
        names = self.tables()
        return name or next((n for n in ("CONSENSUS", "SEQUENCE") if n in names), names[0] if names else "")

    def base(self, name: str | None = None) -> str:
        """Where the table's columns lie."""
        chosen = self.table(name)
        base = f"tbl/{chosen}/col" if chosen else "col"
        if not any(p.startswith(f"{base}/") for p in self.members):
            raise FormatError(f"no columns of {chosen or 'a table'}")
        return base

    def columns(self, name: str | None = None) -> list[str]:
        base = self.base(name)
        return sorted({p[len(base) + 1 :].split("/")[0] for p in self.members if p.startswith(f"{base}/")})

    def is_aligned(self) -> bool:
        """Whether reads must be restored from a reference: three tables and a compressed READ."""
        return set(ALIGNED) <= set(self.tables()) and "CMP_READ" in self.columns("SEQUENCE")

    def require_plain(self, name: str | None = None) -> None:
        columns = self.columns(name)
        if "READ" not in columns:
            raise FormatError("reads are stored against a reference" if "CMP_READ" in columns else "no READ column")

    def metadata(self, name: str | None = None) -> list[tuple[str, int, bytes, dict[str, bytes]]]:
        """(path, depth, value, attributes) of the table's metadata, depth first."""
        chosen = self.table(name)
        raw = self.read(f"tbl/{chosen}/md/cur" if chosen else "md/cur")
        return metadata_nodes(raw[8:]) if len(raw) > 8 else []


def _tree_size(raw: bytes) -> int:
    n, size = struct.unpack_from("<I", raw)[0], struct.unpack_from("<I", raw, 4)[0] if len(raw) >= 8 else 0
    return 4 if not n else 8 + n * (1 if size <= 256 else 2 if size <= 65536 else 4) + size


def metadata_nodes(tree: bytes, above: str = "", depth: int = 0) -> list[tuple[str, int, bytes, dict[str, bytes]]]:
    """A stored tree of named values: attributes and children are trees themselves, the rest of a node is its value."""
    out = []
    for node in tree_nodes(tree):
        if not node:
            raise FormatError("an empty metadata node")
        end = 2 + (node[0] >> 2)
        path, attributes, below = above + node[1:end].decode("utf-8", "replace"), {}, []
        if node[0] & 1:
            size = _tree_size(node[end:])
            attributes = {k.decode("utf-8", "replace"): v for k, _, v in (a.partition(b"\0") for a in tree_nodes(node[end : end + size]))}
            end += size
        if node[0] & 2:
            size = _tree_size(node[end:])
            below = metadata_nodes(node[end : end + size], f"{path}/", depth + 1)
            end += size
        out += [(path, depth, node[end:], attributes), *below]
    return out


def overlay_blobs(raw: bytes, count: int = 0) -> list[Blob]:
    """Locators written ahead of the index, the later ones over the earlier; removed ones take theirs away."""
    by: dict[int, Blob] = {}
    rows = np.frombuffer(raw, LOCATOR, len(raw) // LOCATOR.itemsize)
    for r in rows[:count] if count else rows:
        start = int(r["start_id"])
        if int(r["gen"]) >> 31:
            by.pop(start, None)
        else:
            by[start] = Blob(start, int(r["id_range"]), int(r["page"]), int(r["gen"]) & 0x7FFFFFFF)
    return sorted(by.values(), key=lambda b: b.start_id)


def layered(base: list[Blob], over: list[Blob]) -> list[Blob]:
    """An overlay's blobs, and the base's that no overlay blob overlaps; a blob of range 0 spans all rows."""
    if not over:
        return base
    low = np.array([b.start_id for b in over])
    high = np.maximum.accumulate([b.start_id + b.id_range - 1 if b.id_range else 2**62 for b in over])

    def free(b: Blob) -> bool:
        k = int(np.searchsorted(low, b.start_id + b.id_range - 1, "right"))
        return b.id_range > 0 and not (k and high[k - 1] >= b.start_id)

    return sorted([*over, *filter(free, base)], key=lambda b: b.start_id)


@dataclass
class Column:
    """A physical column: its locators, and where its data lie."""

    archive: Archive
    path: str
    blobs: list[Blob]
    checksum: int
    page: int

    @classmethod
    def open(cls, archive: Archive, path: str) -> Column:
        idx1, idx, idx2, idx0 = (archive.read(f"{path}/{m}") for m in ("idx1", "idx", "idx2", "idx0"))
        return cls.of(archive, path, idx1, idx, idx2, idx0)

    @classmethod
    def of(cls, archive: Archive | None, path: str, idx1: bytes, idx: bytes = b"", idx2: bytes = b"", idx0: bytes = b"", size: int | None = None) -> Column:
        version = int.from_bytes(idx1[4:8], "little")
        overlays = 0
        if version <= 1:
            page, checksum = int.from_bytes(idx1[28:32], "little"), idx1[32] if len(idx1) > 32 else 0
        else:  # the header went to a member of its own
            shift = 4 if version > 2 else 0
            overlays = int.from_bytes(idx[24:28], "little") if shift else 0
            page, checksum = int.from_bytes(idx[28 + shift : 32 + shift], "little"), idx[32 + shift] if len(idx) > 32 + shift else 0
        blobs = layered(column_blobs(idx1, idx2), overlay_blobs(idx0, overlays))
        if not blobs:  # no locators: all data are one blob
            whole = size if size is not None else (archive.location(f"{path}/data") or (0, 0))[1] if archive else 0
            blobs = [Blob(1, 0, 0, whole)] if whole else []
        return cls(archive, path, blobs, checksum, page or 1)

    def first_row(self) -> int | None:
        return self.blobs[0].start_id if self.blobs else None

    def rows(self) -> int:
        return sum(b.id_range for b in self.blobs)

    def find(self, row: int) -> Blob | None:
        k = int(np.searchsorted([b.start_id for b in self.blobs], row, "right")) - 1
        b = self.blobs[k] if k >= 0 else None
        return b if b and (not b.id_range or row < b.start_id + b.id_range) else None

    def window(self, first: int, last: int) -> list[Blob]:
        return [b for b in self.blobs if b.start_id <= last and (not b.id_range or b.start_id + b.id_range > first)]

    def raw(self, blobs: list[Blob]) -> Iterator[tuple[Blob, bytes]]:
        """Blobs with their bytes; near ones are read together."""
        runs: list[tuple[int, int, list[Blob]]] = []
        for b in sorted(blobs, key=lambda b: b.page):
            a, z = b.page * self.page, b.page * self.page + b.size
            if runs and a - runs[-1][1] <= GAP:
                runs[-1] = (runs[-1][0], max(runs[-1][1], z), [*runs[-1][2], b])
            else:
                runs.append((a, z, [b]))
        for a, z, own in runs:
            data = self.archive.range(f"{self.path}/data", a, z - a)
            for b in own:
                yield b, data[b.page * self.page - a :][: b.size]

    def array(self, first: int, last: int, kind: str) -> pa.Array:
        """The decoded values of every row in the window, null where no blob has the row."""
        got = []
        for b, raw in self.raw(self.window(first, last)):
            values = decoded_array(kind, raw, self.checksum, b.id_range or last - b.start_id + 1)
            lo, hi = max(first, b.start_id), min(last, b.start_id + len(values) - 1)
            got.append((lo, hi, values.slice(lo - b.start_id, hi - lo + 1)) if lo <= hi else (lo, lo - 1, values.slice(0, 0)))
        got = sorted((g for g in got if g[0] <= g[1]), key=lambda g: g[0])
        starts, ends = [first, *(g[1] + 1 for g in got)], [*(g[0] for g in got), last + 1]
        if all(a <= z for a, z in zip(starts, ends, strict=True)):
            pieces = []
            for a, z, g in zip(starts, ends, [*got, None], strict=True):
                pieces += [pa.nulls(z - a, arrow_type(kind))] if z > a else []
                pieces += [g[2]] if g else []
            return pa.concat_arrays(pieces) if pieces else pa.nulls(0, arrow_type(kind))
        cells = self.cells(first, last, kind)  # blobs that overlap
        return pa.array([cells.get(r) for r in range(first, last + 1)], arrow_type(kind))

    def cells(self, first: int, last: int, kind: str) -> dict[int, object]:
        """Row -> decoded value of every row in the window."""
        out: dict[int, object] = {}
        for b, raw in self.raw(self.window(first, last)):
            rows = b.id_range or last - b.start_id + 1
            values = decoded_rows(kind, raw, self.checksum, rows)
            lo, hi = max(first, b.start_id), min(last, b.start_id + len(values) - 1)
            out.update(zip(range(lo, hi + 1), values[lo - b.start_id : hi - b.start_id + 1], strict=True))
        return out


LETTERS = np.frombuffer(b"ACGT", np.uint8)
#: The four bases of a byte.
FOUR = np.stack([LETTERS[np.arange(256) >> k & 3] for k in (6, 4, 2, 0)], 1)


def split_names(data: bytes, page: PageMap | None, rows: int) -> list[bytes]:
    """Names by page map, else of one width, else by NUL or line end."""
    if page is not None:
        offset, length = codecs.extents(page)
        return [data[a : a + n] for a, n in zip(offset.tolist(), length.tolist(), strict=True)]
    mark = b"\0" if b"\0" in data else b"\n"
    parts = data.removesuffix(mark).split(mark)
    if len(parts) == rows:
        return parts
    if rows and len(data) % rows == 0:
        return [data[k : k + len(data) // rows] for k in range(0, len(data), len(data) // rows)] if data else [b""] * rows
    raise FormatError("names do not match the rows")


def located(kind: str, raw: bytes, checksum: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | list[bytes]:
    """(all values of a blob, the offset of every row in them, its length); names without a page map as a list."""
    frames, page, data, adjust = codecs.opened(raw, checksum, rows)
    if kind == "READ":
        packed = codecs.unzipped(frames, data) if frames else data
        flat = FOUR[np.frombuffer(packed, np.uint8)].reshape(-1)[: max(0, len(packed) * 4 - adjust // 2)]
    elif kind in ("QUALITY", "ORIGINAL_QUALITY"):
        flat = codecs.qualities(frames, data).view(np.uint8)
    elif kind in WORDS:
        flat = codecs.numbers(frames, data).astype("<u4")
    else:
        flat = np.frombuffer(codecs.unzipped(frames, data), np.uint8)
    if kind in TEXT and page is None:
        return split_names(flat.tobytes(), None, rows)
    if page is None:  # rows of one length
        page = PageMap([len(flat) // max(1, rows)], [rows])
    offset, length = codecs.extents(page)
    if kind in TEXT:
        offset = np.minimum(offset, len(flat))
        length = np.minimum(length, len(flat) - offset)
    if len(offset) and int((offset + length).max()) > len(flat):
        raise FormatError("a page map reaches beyond the data")
    return flat, offset, length


def decoded_rows(kind: str, raw: bytes, checksum: int, rows: int) -> list:
    """The values of a blob's rows: bases and names as text, qualities and unknown columns as bytes, numbers as lists."""
    return decoded_array(kind, raw, checksum, rows).to_pylist()


def arrow_type(kind: str) -> pa.DataType:
    return pa.string() if kind == "READ" or kind in TEXT else pa.list_(pa.int64()) if kind in (*WORDS, *BYTES[:2]) else pa.binary()


def gathered(flat: np.ndarray, offset: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, edges) of rows that lie anywhere in an array, one after the other; such as lie so already are not moved."""
    edges = np.concatenate([[0], np.cumsum(length)])
    if not len(offset) or (offset == edges[:-1] + offset[0]).all():
        first = int(offset[0]) if len(offset) else 0
        return flat[first : first + int(edges[-1])], edges
    return flat[np.repeat(offset - edges[:-1], length) + np.arange(edges[-1])], edges


def arrow_rows(kind: str, flat: np.ndarray, edges: np.ndarray, absent: np.ndarray | None = None) -> pa.Array:
    """Rows of values that lie one after the other; absent ones are null."""
    if int(edges[-1]) >= 1 << 31:
        raise FormatError("too many values for one batch")
    mask = None if absent is None or not absent.any() else pa.array(absent)
    edges = edges.astype(np.int32)
    if pa.types.is_list(arrow_type(kind)):
        return pa.ListArray.from_arrays(pa.array(edges), pa.array(flat.astype(np.int64)), mask=mask)
    bits = None if mask is None else pa.py_buffer(np.packbits(~absent, bitorder="little"))
    make = pa.StringArray if pa.types.is_string(arrow_type(kind)) else pa.Array
    buffers = [pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(flat))]
    return make.from_buffers(len(edges) - 1, *buffers, bits) if make is pa.StringArray else pa.Array.from_buffers(pa.binary(), len(edges) - 1, [bits, *buffers])


def decoded_array(kind: str, raw: bytes, checksum: int, rows: int) -> pa.Array:
    """The values of a blob's rows, as `decoded_rows`."""
    got = located(kind, raw, checksum, rows)
    if isinstance(got, list):
        return pa.array([x.decode("utf-8", "replace") for x in got], pa.string())
    flat, edges = gathered(*got)
    if kind in TEXT and len(flat) and int(flat.max()) > 0x7F:
        return pa.array([flat[a:z].tobytes().decode("utf-8", "replace") for a, z in zip(edges, edges[1:], strict=False)], pa.string())
    return arrow_rows(kind, flat, edges)


def parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, edges) of text, bytes or lists; null rows are empty."""
    if pa.types.is_list(column.type):
        edges = column.offsets.to_numpy().astype(np.int64)
        return column.values.to_numpy()[edges[0] : edges[-1]], edges - edges[0]
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, "<i4", len(column) + 1, 4 * column.offset).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8)[edges[0] : edges[-1]], edges - edges[0]


def masked_rows(bases: pa.Array, ambiguous: pa.Array) -> pa.Array:
    """Bases of rows, N where the ambiguity mask (aligned at the end) tells of several."""
    (letters, edges), (mask, marks) = parts(bases), parts(ambiguous)
    places = np.flatnonzero(mask == 15)
    row = np.searchsorted(marks[1:], places, "right")
    target = edges[row + 1] - (marks[row + 1] - places)
    letters = letters.copy()
    letters[target[target >= edges[row]]] = ord("N")
    return arrow_rows("READ", letters, edges, bases.is_null().to_numpy(zero_copy_only=False) if bases.null_count else None)


def masked(bases: str, ambiguous: bytes) -> str:
    """Bases, N where the ambiguity mask (aligned at the end) tells of several."""
    if not ambiguous:
        return bases
    letters = np.frombuffer(bases.encode(), np.uint8).copy()
    mask = np.frombuffer(ambiguous, np.uint8)[-len(letters) :]
    tail = letters[len(letters) - len(mask) :]
    tail[mask == 15] = ord("N")
    return letters.tobytes().decode()


def split_lengths(total: int, reads: int, known: list[int] | None = None) -> list[int]:
    """Read lengths of a spot that tells none: the catalogue's, tiled (the last read may be cut), or equal parts of which
    the last takes the rest."""
    if known and sum(known):
        out, left, k = [], total, 0
        while left > 0:
            take = min(left, known[k % len(known)]) or (1 if not any(known) else 0)
            out.append(take)
            left, k = left - take, k + 1
        return out
    each = total // max(1, reads)
    return [each] * (reads - 1) + [total - each * (reads - 1)] if reads else []


@lru_cache(8)
def cached(path: str) -> Archive:
    """Archives that a worker has open; their directories are kept from one row window to the next."""
    return Archive(path)
