"""Archives built by hand."""

import struct
import zlib

import numpy as np
import pytest

from spotweave.sources import archive as a
from spotweave.sources import relations


def tree(nodes):
    body = b"".join(nodes)
    kind = "<u1" if len(body) <= 256 else "<u2" if len(body) <= 65536 else "<u4"
    starts = np.cumsum([0, *map(len, nodes)])[:-1].astype(kind)
    return struct.pack("<II", len(nodes), len(body)) + starts.tobytes() + body if nodes else struct.pack("<I", 0)


def node(name, code, rest=b""):
    return struct.pack("<H", len(name)) + name.encode() + bytes(12) + bytes([code]) + rest


def container():
    files = tree([node("data", a.FILE, struct.pack("<QQ", 0, 5)), node("none", a.EMPTY), node("link", a.SOFTLINK, struct.pack("<H", 4) + b"data")])
    toc = tree([node("col", a.DIRECTORY, tree([node("READ", a.DIRECTORY, files)]))])
    return a.MAGIC + struct.pack("<IIQ", a.BYTE_ORDER, 1, a.HEADER_BYTES + len(toc)) + toc + b"hello"


def test_toc(spark, tmp_path):
    data, toc = a.read_toc(container())
    assert [(e.path, e.kind) for e in toc] == [("col", "dir"), ("col/READ", "dir"), ("col/READ/data", "file"), ("col/READ/none", "empty"), ("col/READ/link", "softlink")]
    e = a.resolve(toc, "col/READ/link")
    assert container()[data + e.offset :][: e.size] == b"hello"
    (tmp_path / "x.sra").write_bytes(container())
    assert relations.archive_members(spark, str(tmp_path)).where("kind = 'file'").first().size == 5
    for bad in (b"x" * 40, container()[:60]):
        with pytest.raises(a.FormatError):
            a.read_toc(bad)


def test_locators():
    rows = struct.pack("<QIIq", 10, 7, 4, 5) + struct.pack("<QIIq", 0, 9, 4, 1)
    v1 = struct.pack("<II", a.COLUMN_MAGIC, 1) + bytes(16) + struct.pack("<II", 2, 1) + bytes(8) + rows
    assert a.column_blobs(v1) == [a.Blob(1, 4, 0, 9), a.Blob(5, 4, 10, 7)]
    # accumulated ids and pages
    block = struct.pack("<QQ", 1, 100) + struct.pack("<II", 4, 6) + struct.pack("<II", 20, 30)
    v2 = struct.pack("<II", a.COLUMN_MAGIC, 3) + struct.pack("<QIIq", 0, len(block) | 2 << 27 | 2 << 29, 10, 1)
    assert a.column_blobs(v2, block) == [a.Blob(1, 4, 100, 20), a.Blob(5, 6, 120, 30)]
    # predicted ids and pages: the size is the count
    v2 = struct.pack("<II", a.COLUMN_MAGIC, 3) + struct.pack("<QIIq", 0, 3 | 3 << 27 | 3 << 29, 12, 1)
    with pytest.raises((a.FormatError, struct.error)):
        a.column_blobs(v2, b"")


def test_numbers_and_checksum():
    assert a.Cursor(bytes([0x81, 0x00])).unsigned() == 128 and a.Cursor(bytes([0xC1, 0x00])).signed() == -128
    assert a.checksum(b"123456789") == 0x89A1897F
    with pytest.raises(a.FormatError):
        a.Cursor(b"\xff" * 11).unsigned()


def test_page_maps():
    assert a.page_map(bytes([0, 9]), 4) == a.PageMap([9], [4])
    assert a.page_map(bytes([1, 9, 2, 1, 3]), 4) == a.PageMap([9], [4], "repeats", [1, 3])
    assert a.page_map(bytes([2, 2, 5, 6, 1, 3]), 4) == a.PageMap([5, 6], [1, 3])
    squeeze = zlib.compressobj(9, zlib.DEFLATED, -15)
    body = squeeze.compress(bytes([5, 6, 1, 1, 6, 0])) + squeeze.flush()
    assert a.page_map(bytes([2 << 2 | 2, 2]) + body, 2) == a.PageMap([5, 6], [1, 1], "offsets", [6, 0])


def test_envelopes():
    assert a.envelope(bytes([0b01100000]) + b"abc", 3) == ([], a.PageMap([1], [3]), b"abc", 0)
    frame = bytes([0, 1, 2, 3, 8, 1, 1, 7, 0x45])
    got = a.envelope(bytes([0x80, len(frame), 2]) + frame + bytes([0, 1]) + b"xy", 2)
    assert got == ([a.Frame(1, 2, 3, 8, bytes([7]), (-5,))], a.PageMap([1], [2]), b"xy", 0)


def test_windows_of_an_archive_are_dealt_together(spark, tmp_path):
    """Whatever the size of the table of windows, tasks are as many as cores at least; an archive's neighbours share one."""
    from tests.test_codecs import ROWS, archive_of

    for k in range(12):
        (tmp_path / f"{k}.sra").write_bytes(archive_of(ROWS))
    rows = relations.archive_rows(spark, str(tmp_path), ["READ_LEN"])
    assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    parts = rows.rdd.map(lambda r: r.archive).glom().map(set).collect()
    assert sum(map(len, parts)) == 12 and sum(bool(p) for p in parts) > 1


def test_neighbouring_windows_are_joined():
    w = [("a", 1, 256), ("a", 257, 512), ("a", 600, 700), ("b", 701, 800), ("b", 801, 9000), ("b", 9001, 9002)]
    assert list(relations._joined(w)) == [("a", 1, 512), ("a", 600, 700), ("b", 701, 800), ("b", 801, 9000), ("b", 9001, 9002)]


def test_reads_cut_from_spots(spark, tmp_path):
    """Reads that overrun their spot, masks, qualities of any byte, and columns that an archive lacks."""
    from spotweave.sources import columns, writer

    rows = [{"row_id": 1, "READ": "ACGTN", "QUALITY": "IIII#", "READ_LEN": [2, 0, 9], "READ_TYPE": [1, 0], "READ_FILTER": [0, 1, 2], "X": 1, "Y": 2, "NAME": "n"}, {"row_id": 2, "READ": "", "QUALITY": "", "READ_LEN": [], "READ_TYPE": [], "READ_FILTER": [], "X": 3, "Y": 4, "NAME": "m"}]
    w = writer.Writer()
    w.add(rows)
    (tmp_path / "x.sra").write_bytes(w.finished())
    got = relations.archive_reads(spark, str(tmp_path), ["read_len", "read_type", "read_filter", "bases", "quality", "NAME", "SPOT_GROUP"]).collect()
    assert [tuple(r)[1:] for r in got] == [(1, 1, 2, 1, 0, "AC", "II", "n", None), (1, 2, 0, 0, 1, "", "", "n", None), (1, 3, 9, None, 2, "GTN", "II#", "n", None)]
    data = bytes(range(256))
    assert columns.decoded_array("QUALITY", writer.blob(zlib.compress(data), [200, 56], writer.frame(1, 256)), 1, 2).to_pylist() == [data[:200], data[200:]]
    assert columns.masked_rows(columns.arrow_rows("READ", np.frombuffer(b"ACGTA", np.uint8), np.array([0, 4, 5])), columns.arrow_rows("ALTREAD", np.array([15, 0, 15, 1, 15], np.uint8), np.array([0, 2, 5]))).to_pylist() == ["ACNT", "N"]


def test_routing_within_batches_equals_the_window(spark):
    import random

    from spotweave.operators import routing

    rng, rows = random.Random(2), []
    for spot in range(300):
        rows += [(spot, k + 1, rng.choice([0, 5, 12, 20]), rng.choice([0, 1, 3, 5, None])) for k in range(rng.randrange(1, 6))]
    df = spark.createDataFrame(rows, "spot_id bigint, mate_idx int, read_len int, read_type int")
    column = lambda k, no=0: np.array([no if r[k] is None else r[k] for r in rows])
    for mode in ("split3", "split_files", "split_spot"):
        for rule in (routing.ReadFilter(), routing.ReadFilter(10), routing.ReadFilter(10, False)):
            kept, slot = routing.routed_arrays(column(0), column(1), column(2), column(3, -1), mode, rule)
            want = {(r.spot_id, r.mate_idx): r.slot for r in routing.routed(df, mode, rule).collect()}
            assert {r[:2]: s for r, k, s in zip(rows, kept, slot, strict=True) if k} == want
