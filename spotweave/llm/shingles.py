"""Words and word shingles of many texts at once, as 64-bit hashes, in whole-array steps."""

from __future__ import annotations

import numpy as np

from spotweave.llm.common import keys, mix

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets of the rows among the words); words are [^\\x20\\x09-\\x0D]+, A-Z lower-cased.

    A word's hash is multilinear in its bytes (each times a fixed random key by its place in the word), then mixed.
    """
    rows = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    text = LOWER[raw] if lower else raw
    inside = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)  # a row ends before here
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    spans = np.diff(np.append(starts, len(raw)))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, spans)
    with np.errstate(over="ignore"):
        value = (text[starts[0] :].astype(np.uint64) + np.uint64(1)) * keys(int(spans.max()))[place]
        value[~inside[starts[0] :]] = 0
        hashes = mix(np.add.reduceat(value, starts - starts[0]))
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def shingle_hashes(words: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of `width` words of a row, offsets of the rows among them); a row with fewer words, but one at
    least, has its whole sequence as one; a row without words has none."""
    n = np.diff(at)
    counts = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(out_at[-1]), np.uint64)
    with np.errstate(over="ignore"):
        k = keys(width + 1)
        if len(words) >= width:
            runs = sum((words[i : len(words) - width + 1 + i] * k[i] for i in range(width)), np.zeros(1, np.uint64))
            full = np.flatnonzero(n >= width)
            if len(full):
                c = counts[full]
                source = np.repeat(at[:-1][full] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
                target = np.repeat(out_at[:-1][full] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
                out[target] = runs[source]
        for r in np.flatnonzero((n > 0) & (n < width)).tolist():
            w = words[at[r] : at[r + 1]]
            out[out_at[r]] = (w * k[: len(w)]).sum() + k[width] * np.uint64(len(w))
    return mix(out), out_at


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Each row's distinct shingles, ascending by hash."""
    hashes, at = shingle_hashes(*word_hashes(raw, offsets), width)
    return [np.unique(hashes[a:b]) for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
