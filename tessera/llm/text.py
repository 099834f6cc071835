"""Whole-batch text primitives over the UTF-8 buffers of Arrow string arrays.

Texts are handled as one contiguous byte array with row offsets, cut into
chunks of about a megabyte at row borders, so the working set of a task stays
bounded by its longest text and no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_ROOT = np.uint64(0x9E3779B97F4A7C15 | 1)
_ROOT_INV = np.uint64(pow(int(_ROOT), -1, 1 << 64))
_BYTE_KEYS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    """The first n powers of the hash root ("up") or of its inverse ("down"), modulo 2**64."""
    if len(_powers[which]) < n:
        full = np.full(n + n // 4, _ROOT if which == "up" else _ROOT_INV, np.uint64)
        full[0] = 1
        _powers[which] = np.multiply.accumulate(full)
    return _powers[which][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None and offsets.size else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past row, bytes, offsets) of runs of rows holding about `limit` bytes; a longer text is a run of its own."""
    data, offs = buffer(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, every other byte as it is."""
    return _LOWER[data]


class Words:
    """Words of a chunk, a word being a longest run free of ASCII white space within one row.

    starts, ends: byte positions; counts: words of each row; first: index of each row's first word (rows + 1).
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs = data, offs
        n = len(data)
        inside = ~_SEP[data]
        edge = np.zeros(n + 1, bool)
        edge[offs[:-1]] = True
        edge[n] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = True, True
            np.logical_or(~inside[:-1], edge[1:n], out=before[1:])
            np.logical_or(~inside[1:], edge[1:n], out=after[:-1])
        self.starts = np.flatnonzero(inside & before)
        self.ends = np.flatnonzero(inside & after) + 1
        self.first = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same in every chunk, task and run."""
        return spans(self.data, self.starts, self.ends)


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans by prefix sums of a polynomial, then mixed."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_KEYS[data] * _power("up", n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", n + 1)[starts])


def code_points(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and where each row's begin (rows + 1)."""
    if not (data & 0x80).any():
        return data.astype(np.uint32), offs
    head = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[head]
    point = lead.astype(np.uint32)
    for least, most, size in ((0xC0, 0xE0, 2), (0xE0, 0xF0, 3), (0xF0, 0xF8, 4)):
        some = np.flatnonzero((lead >= least) & (lead < most))
        value = point[some] & np.uint32(0x7F >> size)
        for k in range(1, size):
            value = (value << np.uint32(6)) | (data[head[some] + k] & 0x3F)
        point[some] = value
    return point, np.searchsorted(head, offs)


def char_grams(data: np.ndarray, offs: np.ndarray, most: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order from 1 to `most` (3 at most): hashes of so many bits of all n-grams of code points within rows, and where each row's begin (rows + 1)."""
    point, border = code_points(data, offs)
    code, wide = point, point.astype(np.uint64)
    keep = np.ones(len(point), bool)
    rows = list(zip(border[:-1].tolist(), border[1:].tolist(), strict=True))
    for n in range(1, most + 1):
        code = point if n == 1 else (code[:-1].astype(np.uint64) << np.uint64(21)) | wide[n - 1 :]
        for lo, hi in rows:  # grams that would reach over the row's end
            keep[max(lo, hi - n + 1) : hi] = False
        if n == 1:
            found = code * np.uint32(2654435761) >> np.uint32(32 - bits)
        else:
            found = ((code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int32)
        yield found[keep[: len(found)]].astype(np.int32), np.concatenate([[0], np.cumsum(np.maximum(np.diff(border) - n + 1, 0))])


def grams(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n bytes as one unsigned number, n <= 8) of all byte n-grams within rows, and their first position in each row (rows + 1)."""
    size = max(0, len(data) - n + 1)
    code = np.zeros(size, np.uint64 if n > 4 else np.uint32)
    for k in range(n):
        code = (code << code.dtype.type(8)) | data[k : k + size]
    if n == 1:
        return code, offs
    keep = np.ones(size, bool)
    for border in offs[1:-1]:
        keep[max(0, border - n + 1) : border] = False
    per_row = np.maximum(np.diff(offs) - n + 1, 0)
    first = np.concatenate([[0], np.cumsum(per_row)])
    code = code[keep]
    return code[: first[-1]], first


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs given by their borders; an empty run sums to zero."""
    if values.dtype.kind != "f":
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
        return total[first[1:]] - total[first[:-1]]
    out = np.zeros(len(first) - 1)
    some = np.flatnonzero(first[1:] > first[:-1])
    if len(some):
        out[some] = np.add.reduceat(values[: first[-1]].astype(np.float64), first[some])
    return out
