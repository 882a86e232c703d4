"""Transforms against plain computations, and columns built by hand."""

import struct
import zlib

import numpy as np
import pytest

from spotweave.sources import archive as a
from spotweave.sources import codecs, columns, relations, writer


def raw_deflate(data):
    z = zlib.compressobj(9, zlib.DEFLATED, -15)
    return z.compress(data) + z.flush()


def planes(values):
    v = np.array(values, np.uint64)
    return b"".join(raw_deflate((v >> np.uint64(8 * k)).astype(np.uint8).tobytes()) for k in range(2))


def test_checksum_and_bits():
    assert codecs.crc(b"123456789") == a.checksum(b"123456789") == 0x89A1897F and codecs.crc(b"") == 0
    assert codecs.unpacked(bytes([0b00011011, 0b10000000]), 2, 5).tolist() == [0, 1, 2, 3, 2]
    assert codecs.unpacked(bytes([0xAB, 0xC0]), 12, 1).tolist() == [0xABC]
    assert codecs.element(struct.pack("<3H", 5, 6, 700), 2, 3) == 700
    assert codecs.segment_kinds(bytes([0b101]), 3).tolist() == [True, False, True]
    with pytest.raises(a.FormatError):
        codecs.segment_kinds(b"", 1)
    with pytest.raises(a.FormatError):
        codecs.checked(1 << 40, 10)


def test_planes():
    values = [3, 700, 12, 0]
    line = codecs.irzip(planes(values), 32, 4, 10, 2, 3)
    assert line.tolist() == [v + 10 + 2 * i for i, v in enumerate(values)]
    assert codecs.irzip(planes(values), 32, 4, 1000, codecs.DELTA_UP, 3).tolist() == [1000, 1700, 1712, 1712]
    assert codecs.irzip(planes(values), 32, 4, 2000, codecs.DELTA_DOWN, 3).tolist() == [2000, 1300, 1288, 1288]
    both = [0, 2 * 5, 2 * 7 + 1, 2 * 1]
    assert codecs.irzip(planes(both), 32, 4, 100, codecs.DELTA_BOTH, 3).tolist() == [100, 105, 98, 99]
    # two series, told apart by the lowest bit; each begins at its own value
    mixed = [0, 1, 2 * 4, 2 * 6 + 1, 2 * 1]
    assert codecs.irzip(planes(mixed), 32, 5, 10, codecs.DELTA_UP, 3, (500, codecs.DELTA_DOWN)).tolist() == [10, 500, 14, 494, 15]
    # a plane that is short ends in zeros
    assert codecs.irzip(raw_deflate(bytes([9])), 8, 3, 0, 0, 1).tolist() == [9, 0, 0]
    with pytest.raises(a.FormatError):
        codecs.irzip(b"\xff\xff", 32, 4, 0, 0, 3)


def test_segments():
    assert codecs.izip(struct.pack("<BI", 1, 3) + raw_deflate(bytes([1, 2, 3])), 32).tolist() == [1, 2, 3]
    assert codecs.izip(struct.pack("<BIq", 2, 3, -5) + struct.pack("<3H", 5, 6, 7), 32).tolist() == [0, 1, 2]
    assert codecs.izip(struct.pack("<BIq", 3, 2, 100) + raw_deflate(bytes([0, 9])), 32).tolist() == [100, 109]
    # a line of four (1 + 1.5 j), an outlier, a flat line of two; differences of one byte
    kinds, diff, length = bytes([0b010]), bytes([0, 0, 0, 0, 0, 1, 2]), bytes([4, 1, 2])
    dy, dx, first, outlier = bytes([3, 0]), bytes([2, 0]), bytes([1, 7]), bytes([250])
    parts = [kinds, diff, length, dy, dx, first, outlier]
    head = struct.pack("<BI", 0, 7) + struct.pack("<10I", 0, 3, 1, *map(len, parts)) + struct.pack("<6q", 0, 0, 0, 0, 0, 1000)
    assert codecs.izip(head + b"".join(parts), 32).tolist() == [1, 2, 4, 5, 1250, 8, 9]
    # constant and deflated streams
    how = codecs.CONSTANT << 4 | codecs.ZIPPED << 8
    parts = [kinds, b"", raw_deflate(length), dy, dx, first, outlier]
    head = struct.pack("<BI", 0, 7) + struct.pack("<10I", how, 3, 1, 1, 7, len(parts[2]), 2, 2, 2, 1) + struct.pack("<6q", 10, 0, 0, 0, 0, 0)
    assert codecs.izip(head + b"".join(parts), 8).tolist() == [11, 12, 14, 15, 250, 17, 17]
    with pytest.raises(a.FormatError):
        codecs.izip(b"\0\1", 32)


def test_zip_and_qualities():
    frame = a.Frame(0, 1, 0, 5, b"", ())
    assert codecs.unzipped([frame], b"hello") == b"hello" and codecs.unzipped([], raw_deflate(b"hello" * 9)) == b"hello" * 9
    assert codecs.unzipped([], zlib.compress(b"hello" * 9)) == b"hello" * 9
    assert codecs.unzipped([a.Frame(0, 2, 0, 9, b"", (4,))], raw_deflate(bytes(10))) == bytes(10)
    with pytest.raises(a.FormatError):
        codecs.unzipped([a.Frame(0, 1, 0, 99, b"\1", ())], b"\xff" * 40)
    got = codecs.quads(bytes([70, 10, 11, 12, 81, 82, 83, 45, 88, 46, 91, 47]), 6, -6, 40)
    assert got.tolist() == [[30, -30, -29, -28], [-5] * 4, [40, -6, -6, -6], [5, -5, -6, -6], [6, -6, -6, -5], [7, -6, -6, -8]]
    for bad in (bytes([92, 1]), bytes([70, 1]), b""):
        with pytest.raises(a.FormatError):
            codecs.quads(bad, 1, -6, 40)
    inner = a.Frame(0, 1, 0, 8, bytes([34, 80]), ())
    assert codecs.qualities([a.Frame(0, 1, 0, 2, b"", ()), inner], bytes([82, 82])).tolist() == [40, 40]
    assert codecs.qualities([], zlib.compress(bytes([2, 3]))).tolist() == [2, 3]
    assert codecs.qualities([], struct.pack("<BIq", 2, 2, 30) + bytes([1, 2])).tolist() == [31, 32]
    assert codecs.qualities([a.Frame(0, 1, 0, 3, b"\1", (5, 0))], raw_deflate(bytes([1, 2, 3]))).tolist() == [6, 7, 8]


def test_extents():
    assert [x.tolist() for x in codecs.extents(a.PageMap([2, 3], [2, 1]))] == [[0, 2, 4], [2, 2, 3]]
    assert [x.tolist() for x in codecs.extents(a.PageMap([2], [4], "repeats", [3, 1]))] == [[0, 0, 0, 2], [2, 2, 2, 2]]
    assert [x.tolist() for x in codecs.extents(a.PageMap([2], [2], "offsets", [7, 1]))] == [[7, 1], [2, 2]]
    with pytest.raises(a.FormatError):
        codecs.extents(a.PageMap([2], [4], "repeats", [3]))


def locator(page, size, rows, start):
    return struct.pack("<QIIq", page, size, rows, start)


def test_columns_and_overlays():
    header = struct.pack("<IIQQIIB7x", a.COLUMN_MAGIC, 1, 0, 0, 2, 4, 1)
    c = columns.Column.of(None, "c", header + locator(0, 9, 10, 1) + locator(3, 9, 10, 11))
    assert (c.page, c.checksum, c.first_row(), c.rows()) == (4, 1, 1, 20) and c.find(11).page == 3 and c.find(21) is None and c.find(0) is None
    assert [b.start_id for b in c.window(5, 10)] == [1]
    over = locator(8, 7, 4, 8) + locator(9, 1 << 31, 0, 11) + locator(5, 6, 2, 30) + locator(6, 6, 2, 30)
    assert columns.overlay_blobs(over) == [a.Blob(8, 4, 8, 7), a.Blob(30, 2, 6, 6)] and len(columns.overlay_blobs(over, 1)) == 1
    layered = columns.Column.of(None, "c", header + locator(0, 9, 10, 1) + locator(3, 9, 10, 12), idx0=over)
    assert [b.start_id for b in layered.blobs] == [8, 12, 30]  # the first base blob is overlaid
    # version 3: counts and page size come from a member of their own; without locators all data are one blob
    idx = bytes(24) + struct.pack("<III", 1, 0, 2) + bytes([2])
    later = columns.Column.of(None, "c", struct.pack("<II", a.COLUMN_MAGIC, 3), idx, idx0=over)
    assert (later.page, later.checksum, [b.start_id for b in later.blobs]) == (2, 2, [8])
    single = columns.Column.of(None, "c", struct.pack("<II", a.COLUMN_MAGIC, 3), bytes(37), size=50)
    assert single.blobs == [a.Blob(1, 0, 0, 50)] and single.find(10**6) and single.page == 1


def test_trailers():
    import hashlib

    body = writer.blob(b"xy", [1, 1])[:-4]
    assert codecs.opened(body + struct.pack("<I", codecs.crc(body)), 1, 2)[2] == codecs.opened(body + hashlib.md5(body).digest(), 2, 2)[2] == codecs.opened(body, 0, 2)[2] == b"xy"
    for kind in (1, 2):
        with pytest.raises(a.FormatError):
            codecs.opened(body + bytes(16), kind, 2)


def test_names_masks_and_lengths():
    assert columns.split_names(b"a\0bc\0", None, 2) == columns.split_names(b"a\nbc", None, 2) == [b"a", b"bc"]
    assert columns.split_names(b"abcd", None, 2) == [b"ab", b"cd"] and columns.split_names(b"abc", a.PageMap([1, 2], [1, 1]), 2) == [b"a", b"bc"]
    with pytest.raises(a.FormatError):
        columns.split_names(b"abc", None, 2)
    assert columns.masked("ACGT", bytes([15, 0])) == "ACNT" and columns.masked("ACGT", b"") == "ACGT"
    assert columns.split_lengths(250, 2, [100, 100]) == [100, 100, 50] and columns.split_lengths(7, 2) == [3, 4] and columns.split_lengths(5, 1) == [5]


def test_metadata_tree():
    tree = writer.tree([writer.metadata_node("A", b"v", [writer.metadata_node("B", b"w")], {"k": b"x"}), writer.metadata_node("unaligned")])
    assert columns.metadata_nodes(tree) == [("A", 0, b"v", {"k": b"x"}), ("A/B", 1, b"w", {}), ("unaligned", 0, b"", {})]


ROWS = [{"row_id": k + 1, "READ": "ACGN"[: k % 5] * 2, "QUALITY": "I#5!"[: k % 5] * 2, "READ_LEN": [len("ACGN"[: k % 5])] * 2, "READ_TYPE": [1, 0], "READ_FILTER": [0, 1], "X": 1000 - k, "Y": k * k, "NAME": f"n{k}"} for k in range(600)]


def archive_of(rows):
    w = writer.Writer()
    for k in range(0, len(rows), writer.BLOB_ROWS):
        w.add(rows[k : k + writer.BLOB_ROWS])
    return w.finished()


def test_archive_by_ranges(spark, tmp_path):
    content = archive_of(ROWS)
    (tmp_path / "x.sra").write_bytes(content)
    one = columns.Archive(str(tmp_path / "x.sra"))
    assert one.tables() == ["SEQUENCE"] and one.base() == "tbl/SEQUENCE/col" and not one.is_aligned() and one.location("nowhere") is None
    assert one.range("tbl/SEQUENCE/col/READ/idx1", 4, 4) == struct.pack("<I", 1)
    with pytest.raises(a.FormatError):
        one.range("tbl/SEQUENCE/col/READ/idx1", 0, 10**6)
    rows = relations.archive_rows(spark, str(tmp_path), ["READ", "QUALITY", "READ_LEN", "READ_TYPE", "READ_FILTER", "X", "Y", "NAME", "SPOT_GROUP"], first=250, last=520).collect()
    assert [r.row_id for r in sorted(rows, key=lambda r: r.row_id)] == list(range(250, 521))
    for r in rows:
        want = ROWS[r.row_id - 1]
        assert (r.READ, bytes(q + 33 for q in r.QUALITY).decode(), r.READ_LEN, r.READ_TYPE, r.READ_FILTER, r.X, r.Y, r.NAME, r.SPOT_GROUP) == (*(want[c] for c in ("READ", "QUALITY", "READ_LEN", "READ_TYPE", "READ_FILTER")), [want["X"]], [want["Y"]], want["NAME"], None)
    assert relations.validated(spark, str(tmp_path)).first().errors == []
    torn = bytearray(content)
    torn[-400] ^= 1  # within the last column's last blob
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "y.sra").write_bytes(bytes(torn))
    bad = relations.validated(spark, str(tmp_path / "bad")).first()
    assert len(bad.errors) == 1 and "CRC" in bad.errors[0]
    with pytest.raises(a.FormatError):
        columns.Archive(str(tmp_path / "bad" / "y.sra")).require_plain("NONE")


def test_aligned_archives_are_refused(tmp_path):
    members = {f"tbl/{t}/col/{c}/idx1": b"" for t, c in (("SEQUENCE", "CMP_READ"), ("PRIMARY_ALIGNMENT", "X"), ("REFERENCE", "X"))}
    (tmp_path / "x.sra").write_bytes(writer.container(members))
    one = columns.Archive(str(tmp_path / "x.sra"))
    assert one.is_aligned()
    with pytest.raises(a.FormatError, match="reference"):
        one.require_plain("SEQUENCE")
