"""Transforms of blob contents as whole-array steps: bit planes, line segments, packed bits, deflate, log-odds qualities.

Every decoder takes bytes and gives a numpy array or bytes; integers are little-endian and wrap at their width.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from spotweave.sources.archive import MOST_RATIO, FormatError, Frame, PageMap, envelope, inflate

# Slopes that mean differences to the element before (added, subtracted, by lowest bit).
DELTA_UP, DELTA_DOWN, DELTA_BOTH = 0x7FFFFFFFFFFFFFF0, 0x7FFFFFFFFFFFFFF1, 0x7FFFFFFFFFFFFFF2
# How a stream of a segmented blob is stored.
CONSTANT, ZIPPED, ABSENT = 1, 2, 3
STREAMS = ("type", "diff", "length", "dy", "dx", "a", "outlier")
# Fixed values of the log-odds code: two single-byte quads, the range of bytes that stand for a patterned quad.
QUAD_BAD, QUAD_GOOD, PATTERNS = 81, 82, (83, 91)
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checked(n: int, source: int) -> int:
    """A size to allocate, refused if it is out of all proportion to the bytes that ask for it."""
    if n < 0 or n > max(1 << 20, source * MOST_RATIO):
        raise FormatError("data unfold beyond all measure")
    return n


def crc(data: bytes) -> int:
    """CRC-32, highest bit first, begun at 0, not inverted: the common one over mirrored bytes, mirrored back."""
    return int(f"{zlib.crc32(data.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


def integers(raw: bytes, n: int) -> np.ndarray:
    """n whole numbers of the width that the bytes have room for: 1, 2, 4 or 8 bytes."""
    if not n or not raw:
        return np.zeros(n, np.int64)
    width = len(raw) // n
    if width not in (1, 2, 4, 8):
        raise FormatError(f"numbers of {width} bytes")
    return np.frombuffer(raw, f"<u{width}", n).astype(np.uint64).view(np.int64)


def element(raw: bytes, index: int, n: int) -> int:
    return int(integers(raw, n)[index])


def fit(values: np.ndarray, bits: int) -> np.ndarray:
    return values.view(np.uint64).astype(f"<u{bits // 8}")


def unpacked(raw: bytes, packed_bits: int, n: int) -> np.ndarray:
    """n numbers of so many bits each, the highest bit first."""
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * packed_bits).reshape(n, packed_bits).astype(np.uint64)
    return bits @ (np.uint64(1) << np.arange(packed_bits - 1, -1, -1, dtype=np.uint64))


def deltas(raw: np.ndarray, slope: int) -> np.ndarray:
    """Signed steps of a series by the rule that its slope names."""
    if slope == DELTA_UP:
        return raw
    if slope == DELTA_DOWN:
        return -raw
    half = (raw.view(np.uint64) >> np.uint64(1)).view(np.int64)
    return np.where(raw & 1, -half, half)


def series(raw: np.ndarray, first: int, slope: int) -> np.ndarray:
    """A series from its first value and the steps of all others."""
    steps = deltas(raw, slope).copy()
    steps[:1] = np.int64(first)
    return np.cumsum(steps)


def bit_planes(data: bytes, planes: int, n: int) -> np.ndarray:
    """One deflated stream of n bytes for each set bit, lowest byte first; a short one ends in zeros."""
    value, rest = np.zeros(checked(8 * n, len(data)) // 8, np.uint64), data
    for k in range(8):
        if planes >> k & 1:
            stream = zlib.decompressobj(-15)
            try:
                plane = stream.decompress(rest, max(n, 1)) if n else b""
            except zlib.error as e:
                raise FormatError(f"plane {k} is no deflated stream") from e
            if stream.unconsumed_tail:  # what is beyond n bytes is passed over
                while stream.unconsumed_tail and stream.decompress(stream.unconsumed_tail, 1 << 16):
                    pass
            rest = stream.unused_data
            value[: len(plane)] |= np.frombuffer(plane, np.uint8)[:n].astype(np.uint64) << np.uint64(8 * k)
    return value.view(np.int64)


def irzip(data: bytes, bits: int, n: int, low: int, slope: int, planes: int, second: tuple[int, int] | None = None) -> np.ndarray:
    """Byte-plane integers: a straight line under them, steps, or two interleaved series of steps."""
    raw = bit_planes(data, planes, n)
    with np.errstate(over="ignore"):
        if second is not None:
            out, pick = np.zeros(n, np.int64), (raw & 1).astype(bool)
            half = (raw.view(np.uint64) >> np.uint64(1)).view(np.int64)
            for own, first, step in ((~pick, low, slope), (pick, *second)):
                out[own] = series(half[own], first, step)
        elif slope in (DELTA_UP, DELTA_DOWN, DELTA_BOTH):
            out = series(raw, low, slope)
        else:
            out = raw + np.int64(low) + np.arange(n) * np.int64(slope)
    return fit(out, bits)


def segment_kinds(raw: bytes, n: int) -> np.ndarray:
    """Whether each segment holds outliers: a bitmap, lowest bit first."""
    if len(raw) * 8 < n:
        raise FormatError("a bitmap of segments is cut short")
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n, bitorder="little").astype(bool)


def izip(data: bytes, bits: int) -> np.ndarray:
    """Packed or deflated numbers above a minimum, or line segments with differences and outliers."""
    try:
        flags, n = struct.unpack_from("<BI", data)
        checked(n * bits // 8, len(data))
        kind = flags & 3
        with np.errstate(over="ignore"):
            if kind:
                low, at = (0, 5) if kind == 1 else (struct.unpack_from("<q", data, 5)[0], 13)
                return fit(integers(data[at:] if kind == 2 else inflate(data[at:]), n) + np.int64(low), bits)
            return fit(_segmented(data, n), bits)
    except (struct.error, zlib.error, ValueError) as e:
        raise FormatError("segmented numbers are cut short") from e


def _segmented(data: bytes, n: int) -> np.ndarray:
    how, count, outliers, *sizes = struct.unpack_from("<10I", data, 5)
    lows = dict(zip(STREAMS[1:], struct.unpack_from("<6q", data, 45), strict=True))
    at, stored, checked_count = 93, {}, checked(count, len(data))
    flag = {name: how >> 4 * k & 15 for k, name in enumerate(STREAMS)}
    for name, size in zip(STREAMS, sizes, strict=True):
        held = flag[name] not in (CONSTANT, ABSENT)
        stored[name] = (inflate(data[at : at + size]) if flag[name] == ZIPPED else data[at : at + size]) if held else b""
        at += size if held else 0

    def stream(name: str, k: int) -> np.ndarray:  # a constant stream has its minimum everywhere
        return integers(stored[name], k) + np.int64(lows[name])

    odd = segment_kinds(stored["type"], checked_count) if outliers else np.zeros(checked_count, bool)
    lengths = np.maximum(stream("length", count), 0)
    starts = np.cumsum(lengths) - lengths
    part = np.repeat(np.arange(count), lengths)[:n]
    out, place = np.zeros(n, np.int64), np.arange(len(part)) - starts[part]
    line = ~odd[part]
    rank = np.cumsum(~odd) - 1
    u = rank[part[line]]
    lines = int((~odd).sum())
    dy, dx, a = (stream(name, lines).astype(float) for name in ("dy", "dx", "a"))
    slope = np.divide(dy, dx, out=np.zeros(lines), where=dx != 0)
    out[: len(part)][line] = np.trunc(a[u] + place[line] * slope[u]).astype(np.int64) + stream("diff", n)[: len(part)][line]
    out[: len(part)][~line] = stream("outlier", int(lengths[odd].sum()))[: int((~line).sum())]
    return out


def verbatim(frames: list[Frame], data: bytes) -> bool:
    """Whether the header says that the data are as they were."""
    return bool(frames) and frames[0].version >= 1 and not frames[0].ops and not frames[0].args and frames[0].size == len(data)


def unzipped(frames: list[Frame], data: bytes) -> bytes:
    """Deflated or zlib'd bytes, or such as were too few to deflate."""
    if not data or verbatim(frames, data):
        return data
    for raw in (True, False):
        try:
            out = inflate(data, raw)
        except zlib.error:
            continue
        if out:
            if raw and frames and frames[0].version == 2 and frames[0].args:
                out = out[: (8 * len(out) - (8 - frames[0].args[0]) + 7) // 8]
            return out
    if frames and frames[0].version >= 1 and len(data) > 12:
        raise FormatError("neither a deflated nor a zlib stream")
    return data


def numbers(frames: list[Frame], data: bytes, bits: int = 32) -> np.ndarray:
    """The integers of a column's blob, before rows are expanded."""
    if not frames or frames[0].version < 1:
        return izip(data, bits)
    if verbatim(frames, data):
        return np.frombuffer(data, f"<u{bits // 8}")
    f = frames[0]
    args = (*f.args, 0, 0)[:2]
    second = (f.args[2], f.args[3]) if len(f.args) > 3 else None
    return irzip(data, bits, f.size * 8 // bits, *args, f.ops[0] if f.ops else 0xFF, second)


def quads(data: bytes, n: int, low: int, high: int) -> np.ndarray:
    """(n x 4) log-odds of the four bases: four literal bytes, a known quad, or a byte and its counterpart in one place."""
    out, at = np.full((n, 4), low, np.int64), 0
    for j in range(n):
        if at >= len(data):
            raise FormatError(f"{j} of {n} quads")
        b = data[at]
        if b < QUAD_BAD:
            if at + 4 > len(data):
                raise FormatError("a quad is cut short")
            out[j] = [x - 40 for x in data[at : at + 4]]
            at += 4
        elif b in (QUAD_BAD, QUAD_GOOD):
            out[j] = [-5] * 4 if b == QUAD_BAD else [high, low, low, low]
            at += 1
        else:
            if not PATTERNS[0] <= b <= PATTERNS[1] or at + 2 > len(data):
                raise FormatError(f"unknown quad {b}")
            group, slot = divmod(b - PATTERNS[0], 3)
            v = int(np.int8(np.uint8((data[at + 1] - 40) & 0xFF)))
            out[j, 0], out[j, slot + 1] = v, (-v, 1 - v, -1 - v)[group]
            at += 2
    return out.astype(np.int8)


def phred_of_odds(odds: np.ndarray) -> np.ndarray:
    """10 * log10(1 + 10^(x / 10)) of the first base's log-odds, rounded."""
    return np.floor(10 * np.log10(1 + 10 ** (odds[:, 0].astype(float) / 10)) + 0.5).astype(np.uint8)


def qualities(frames: list[Frame], data: bytes) -> np.ndarray:
    """Phred scores: log-odds quads, zlib, bit planes or segments, whichever the blob holds."""
    if data and len(frames) >= 2 and len(frames[1].ops) == 2 and frames[1].size > 0 and frames[1].size % 4 == 0:
        try:
            return phred_of_odds(quads(unzipped(frames, data), frames[1].size // 4, frames[1].ops[0] - 40, frames[1].ops[1] - 40))
        except FormatError:
            pass
    if data and data[0] != 0x78:
        if frames and frames[0].version >= 1 and (frames[0].ops or frames[0].args):
            f = frames[0]
            try:
                return irzip(data, 8, f.size, *(*f.args, 0, 0)[:2], f.ops[0] if f.ops else 0xFF)
            except FormatError:
                pass
        if not verbatim(frames, data):
            try:
                got = izip(data, 8)
                if len(got):
                    return got
            except FormatError:
                pass
    return np.frombuffer(unzipped(frames, data), np.uint8)


def extents(m: PageMap) -> tuple[np.ndarray, np.ndarray]:
    """(offset, length) of every row in elements; offsets go on by stored records, not by rows."""
    lengths = np.repeat(np.array(m.lengths, np.int64), np.array(m.leng_runs, np.int64))
    if m.kind == "offsets":
        return np.array(m.map, np.int64), lengths
    if m.kind == "identity":
        return np.cumsum(lengths) - lengths, lengths
    runs = np.array(m.map, np.int64)
    firsts = np.cumsum(runs) - runs
    if int(runs.sum()) != len(lengths):
        raise FormatError("records serve more or fewer rows than there are")
    own = lengths[firsts]
    record = np.repeat(np.arange(len(runs)), runs)
    return (np.cumsum(own) - own)[record], lengths


def trailer_size(kind: int) -> int:
    return {0: 0, 1: 4, 2: 16}[kind]


def opened(raw: bytes, kind: int, rows: int) -> tuple[list[Frame], PageMap | None, bytes, int]:
    """A blob's envelope after its trailer was verified (none, CRC-32 or MD5 over all before it)."""
    import hashlib

    size = trailer_size(kind)
    body, tail = (raw[: len(raw) - size], raw[len(raw) - size :]) if size else (raw, b"")
    if kind == 1 and crc(body) != int.from_bytes(tail, "little"):
        raise FormatError("a blob's CRC-32 differs")
    if kind == 2 and hashlib.md5(body).digest() != tail:
        raise FormatError("a blob's MD5 differs")
    return envelope(body, rows)
