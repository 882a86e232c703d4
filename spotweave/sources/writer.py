"""Archives as a sink: rows of spots in, one archive a key out, each column by the transform that suits it."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from spotweave.sources import codecs
from spotweave.sources.archive import BYTE_ORDER, COLUMN_MAGIC, DIRECTORY, FILE, HEADER_BYTES, MAGIC
from spotweave.sources.columns import uri_of

BLOB_ROWS = 256
CRC = 1


def unsigned(v: int) -> bytes:
    groups = [v & 0x7F]
    while v := v >> 7:
        groups.append(v & 0x7F | 0x80)
    return bytes(groups[::-1])


def signed(v: int) -> bytes:
    sign, v = (0x40, -v) if v < 0 else (0, v)
    groups = []
    while v > 0x3F:
        groups.append(v & 0x7F)
        v >>= 7
    groups = [v | sign, *groups[::-1]]
    return bytes([g | 0x80 for g in groups[:-1]] + groups[-1:])


def unsigned_all(values: np.ndarray) -> bytes:
    """Numbers one after the other; such of one or two groups, which are nearly all, without a step each."""
    v = np.asarray(values, np.int64)
    most = int(v.max()) if len(v) else 0
    if most <= 0x7F:
        return v.astype(np.uint8).tobytes()
    if most >= 1 << 14:
        return b"".join(map(unsigned, v.tolist()))
    two = np.stack([v >> 7 | 0x80, v & 0x7F], 1).astype(np.uint8)
    return two[np.stack([v > 0x7F, np.ones(len(v), bool)], 1)].tobytes()


def page_map(lengths: Sequence[int]) -> bytes:
    """Lengths of rows, each with the number of rows that have it in a run."""
    n = np.asarray(lengths, np.int64)
    first = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]]))
    runs = np.diff(np.append(first, len(n)))
    return bytes([2]) + unsigned(len(first)) + unsigned_all(n[first]) + unsigned_all(runs)


def frame(version: int, size: int, ops: bytes = b"", args: tuple[int, ...] = ()) -> bytes:
    return bytes([0, version]) + b"".join(map(signed, (0, size, len(ops), len(args)))) + ops + b"".join(map(signed, args))


def blob(data: bytes, lengths: Sequence[int], frames: bytes = b"", spare_bits: int = 0) -> bytes:
    head, page = (b"\0" + frames if frames else b""), page_map(lengths)
    body = bytes([0x80 | 3 << 4 | -spare_bits & 7]) + struct.pack("<II", len(head), len(page)) + head + page + data
    return body + struct.pack("<I", codecs.crc(body))


def deflated(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    return z.compress(data) + z.flush()


def planes_of(values: np.ndarray) -> tuple[bytes, int]:
    """Byte planes that are not all zero, each deflated, and which they are."""
    raw, out, which = values.astype(np.uint64), b"", 0
    for k in range(8):
        plane = (raw >> np.uint64(8 * k)).astype(np.uint8)
        if plane.any():
            out, which = out + deflated(plane.tobytes()), which | 1 << k
    return out, which


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all values one after the other, the length of every row) of strings as bytes, lists, or numbers."""
    if column.null_count:
        raise ValueError("a cell without a value")
    n = len(column)
    if pa.types.is_primitive(column.type):
        return column.to_numpy(zero_copy_only=False), np.ones(n, np.int64)
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        values = column.flatten()
        if values.null_count:
            raise ValueError("a cell with a value missing")
        return values.to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy(zero_copy_only=False)).astype(np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, "<i8" if wide else "<i4", n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[edges[0] : edges[-1]], np.diff(edges)


def octets(values: np.ndarray) -> np.ndarray:
    if len(values) and (int(values.min()) < 0 or int(values.max()) > 255):
        raise ValueError("a number beyond a byte")
    return values.astype(np.uint8)


def zipped_blob(values: np.ndarray, lengths: np.ndarray) -> bytes:
    data = octets(values).tobytes()
    return blob(deflated(data), lengths, frame(1, len(data))) if data else blob(b"", np.zeros(len(lengths), np.int64))


BASE_CODE = np.zeros(256, np.uint8)
BASE_CODE[[ord(c) for c in "ACGT"]] = range(4)


def base_blob(letters: np.ndarray, lengths: np.ndarray) -> bytes:
    """Two bits a base; N counts as A, the mask tells."""
    code = BASE_CODE[letters]
    spare = -len(code) % 4
    four = np.append(code, np.zeros(spare, np.uint8)).reshape(-1, 4)
    return blob((four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).tobytes(), lengths, spare_bits=2 * spare)


def mask_blob(letters: np.ndarray, lengths: np.ndarray) -> bytes:
    """15 at every N, from a row's first N on; rows without one are empty."""
    ends = np.cumsum(lengths)
    places = np.flatnonzero(letters == ord("N"))
    rows, first = np.unique(np.searchsorted(ends, places, "right"), return_index=True)
    edges = np.zeros(len(letters) + 1, np.int8)
    edges[places[first]] += 1
    edges[ends[rows]] -= 1
    own = np.zeros(len(lengths), np.int64)
    own[rows] = ends[rows] - places[first]
    return zipped_blob(np.where(letters == ord("N"), 15, 0)[np.cumsum(edges[:-1]).astype(bool)], own)


def quality_blob(letters: np.ndarray, lengths: np.ndarray) -> bytes:
    data = (letters - np.uint8(33)).tobytes()
    return blob(zlib.compress(data), lengths, frame(1, len(data))) if data else blob(b"", np.zeros(len(lengths), np.int64))


def plane_blob(values: np.ndarray, lengths: np.ndarray, steps: bool = False) -> bytes:
    """Whole numbers above their minimum, or their steps, as byte planes."""
    whole = values.astype(np.int64)
    if not len(whole):
        return blob(b"", np.zeros(len(lengths), np.int64))
    if steps:
        d = np.diff(whole, prepend=whole[:1])
        data, which = planes_of(np.where(d < 0, -2 * d + 1, 2 * d))
        return blob(data, lengths, frame(1, 4 * len(whole), bytes([which]), (int(whole[0]), codecs.DELTA_BOTH)))
    data, which = planes_of(whole - whole.min())
    return blob(data, lengths, frame(1, 4 * len(whole), bytes([which]), (int(whole.min()), 0)))


def packed_blob(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """Whole numbers above their minimum, four bytes each, in the older form without a header frame."""
    whole = values.astype(np.int64)
    return blob(struct.pack("<BIq", 2, len(whole), int(whole.min())) + (whole - whole.min()).astype("<u4").tobytes(), lengths)


def tree(nodes: list[bytes]) -> bytes:
    size = sum(map(len, nodes))
    kind = "<u1" if size <= 256 else "<u2" if size <= 65536 else "<u4"
    starts = np.cumsum([0, *map(len, nodes)])[:-1].astype(kind)
    return struct.pack("<II", len(nodes), size) + starts.tobytes() + b"".join(nodes) if nodes else struct.pack("<I", 0)


def metadata_node(name: str, value: bytes = b"", children: list[bytes] | None = None, attributes: dict[str, bytes] | None = None) -> bytes:
    head = bytes([len(name) - 1 << 2 | (2 if children else 0) | (1 if attributes else 0)]) + name.encode()
    head += tree([k.encode() + b"\0" + v for k, v in attributes.items()]) if attributes else b""
    return head + (tree(children) if children else b"") + value


def container(members: dict[str, bytes]) -> bytes:
    """An archive of members by path."""
    places, at = {}, 0
    for path, data in members.items():
        places[path], at = (at, len(data)), at + len(data)

    def directory(above: str) -> bytes:
        names = dict.fromkeys(p[len(above) :].split("/")[0] for p in members if p.startswith(above))
        out = []
        for name in names:
            path = above + name
            body = bytes([FILE]) + struct.pack("<QQ", *places[path]) if path in places else bytes([DIRECTORY]) + directory(f"{path}/")
            out.append(struct.pack("<H", len(name)) + name.encode() + bytes(12) + body)
        return tree(out)

    toc = directory("")
    return MAGIC + struct.pack("<IIQ", BYTE_ORDER, 1, HEADER_BYTES + len(toc)) + toc + b"".join(members.values())


class Writer:
    """The columns of one archive, blob by blob."""

    ENCODERS = {
        "READ": ("READ", base_blob), "ALTREAD": ("READ", mask_blob), "QUALITY": ("QUALITY", quality_blob), "READ_LEN": ("READ_LEN", plane_blob), "READ_TYPE": ("READ_TYPE", zipped_blob), "READ_FILTER": ("READ_FILTER", zipped_blob),
        "X": ("X", lambda values, lengths: plane_blob(values, lengths, steps=True)), "Y": ("Y", packed_blob), "NAME": ("NAME", zipped_blob),
    }

    def __init__(self):
        self.data: dict[str, list[bytes]] = {c: [] for c in self.ENCODERS}
        self.locators: dict[str, list[tuple[int, int, int, int]]] = {c: [] for c in self.ENCODERS}
        self.size = dict.fromkeys(self.ENCODERS, 0)
        self.spots = self.bases = 0

    def add(self, rows: list[dict] | pa.RecordBatch) -> None:
        """Rows of one blob."""
        if isinstance(rows, list):
            rows = pa.RecordBatch.from_pylist(rows)
        cells = {source: flat(rows.column(source)) for source in {source: None for source, _ in self.ENCODERS.values()}}
        for column, (source, encode) in self.ENCODERS.items():
            b = encode(*cells[source])
            self.locators[column].append((self.size[column], len(b), rows.num_rows, self.spots + 1))
            self.data[column].append(b)
            self.size[column] += len(b)
        self.spots += rows.num_rows
        self.bases += len(cells["READ"][0])

    def finished(self) -> bytes:
        members = {}
        for column, blobs in self.data.items():
            head = struct.pack("<IIQQIIB7x", COLUMN_MAGIC, 1, self.size[column], 0, len(blobs), 1, CRC)
            members[f"tbl/SEQUENCE/col/{column}/idx1"] = head + b"".join(struct.pack("<QIIq", *place) for place in self.locators[column])
            members[f"tbl/SEQUENCE/col/{column}/data"] = b"".join(blobs)
        counts = [metadata_node(k, struct.pack("<Q", v)) for k, v in (("SPOT_COUNT", self.spots), ("BASE_COUNT", self.bases))]
        stats = metadata_node("STATS", children=[metadata_node("TABLE", children=counts)])
        software = metadata_node("SOFTWARE", children=[metadata_node("loader", attributes={"name": b"spotweave", "vers": b"1"})])
        members["tbl/SEQUENCE/md/cur"] = bytes(8) + tree([stats, software])
        return container(members)


NAMES = ["row_id", *dict.fromkeys(source for source, _ in Writer.ENCODERS.values())]
REPORT = "archive string, path string, spots bigint, bases bigint, md5 string"


def _store(name: str, writer: Writer, place: str) -> dict:
    target, local = f"{place}/{name}.sra", "://" not in uri_of(place)
    at, path = (fs.LocalFileSystem(), target) if local else fs.FileSystem.from_uri(uri_of(target))
    at.create_dir(path.rsplit("/", 1)[0], recursive=True)
    content = writer.finished()
    digest = hashlib.md5(content).hexdigest()
    part = f"{path}.{digest}.part"
    with at.open_output_stream(part) as out:
        out.write(content)
    at.move(part, path)
    return {"archive": name, "path": target, "spots": writer.spots, "bases": writer.bases, "md5": digest}


def stored(batches: Iterable[pa.RecordBatch], place: str, key: str = "archive") -> Iterator[pa.RecordBatch]:
    """Writes archives of batches whose rows come sorted by archive and row_id, and gives a batch of REPORT each."""
    schema = pa.schema([("archive", pa.string()), ("path", pa.string()), ("spots", pa.int64()), ("bases", pa.int64()), ("md5", pa.string())])
    writer, name, held = Writer(), None, None

    def blobs(rows: pa.RecordBatch, last: bool) -> pa.RecordBatch:
        """Adds the whole blobs, and at the end the rest; what is left."""
        at = 0
        while rows.num_rows - at >= BLOB_ROWS or last and at < rows.num_rows:
            writer.add(rows.slice(at, BLOB_ROWS))
            at += BLOB_ROWS
        return rows.slice(min(at, rows.num_rows))

    for b in batches:
        if not b.num_rows:
            continue
        code = b.column(b.schema.get_field_index(key)).dictionary_encode()
        index = code.indices.to_numpy(zero_copy_only=False)
        edges = np.concatenate([[0], np.flatnonzero(index[1:] != index[:-1]) + 1, [len(index)]])
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = code[low].as_py()
            if own != name:
                if name is not None:
                    blobs(held, True)
                    yield pa.RecordBatch.from_pylist([_store(name, writer, place)], schema)
                writer, name, held = Writer(), own, None
            rows = b.slice(low, high - low)
            held = blobs(pa.concat_batches([held, rows]) if held is not None and held.num_rows else rows, False)
    if name is not None:
        blobs(held, True)
        yield pa.RecordBatch.from_pylist([_store(name, writer, place)], schema)


def write_archives(spots: DataFrame, place: str, key: str = "archive") -> DataFrame:
    """Writes one archive `<key>.sra` a key, rows in the order of row_id (dense from 1), and gives (archive, path, spots,
    bases, md5).  Columns: row_id, READ, QUALITY (ASCII), READ_LEN, READ_TYPE, READ_FILTER (arrays), X, Y, NAME.

    A task holds one archive; a file appears under its name only when it is whole, so a repeated task writes it again.
    """
    return spots.select(key, *NAMES).repartition(key).sortWithinPartitions(key, "row_id").mapInArrow(lambda batches: stored(batches, place, key), REPORT)
