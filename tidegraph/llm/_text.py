"""Numpy views of Arrow text columns: words, hashes and code points of many rows at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: 0x20 and 0x09-0x0D: what separates words everywhere in this package.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK = 4 << 20

_rng = np.random.default_rng(0x7469)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    at = offsets_of(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def offsets_of(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffer = column.buffers()[1]
    if buffer is None:
        return np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(buffer, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows' UTF-8 bytes end to end, and their offsets; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    at, data = offsets_of(column), column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row the index of its first word (rows + 1 entries)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = at[:-1][at[:-1] < len(data)]
    first[edge] |= inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = at[1:][at[1:] > 0] - 1
    last[edge] |= inside[edge]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n, _P))]).astype(np.uint64)
    return _powers


_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_BLOCK = 1 << 17
with np.errstate(over="ignore"):
    _backs = np.concatenate([[np.uint64(1)], np.cumprod(np.full(_BLOCK, _INVERSE))]).astype(np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: the sum of their values times the powers of ``_P`` by their place in the
    word, taken as differences of running sums over blocks of words."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            base = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, base + _BLOCK, "right")))
            size = int(ends[j - 1]) - base
            run = np.zeros(size + 1, np.uint64)
            if size <= _BLOCK:
                np.cumsum(_BYTE[data[base : base + size]] * powers(size)[:size], out=run[1:])
                first = starts[i:j] - base
                out[i:j] = (run[ends[i:j] - base] - run[first]) * _backs[first]
            else:  # one very long word
                power = np.uint64(1)
                for a in range(base, base + size, _BLOCK):
                    part = _BYTE[data[a : min(a + _BLOCK, base + size)]]
                    out[i] += (part * powers(_BLOCK)[: len(part)]).sum(dtype=np.uint64) * power
                    power *= powers(_BLOCK + 1)[_BLOCK]
            i = j
        return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_A = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of ``width`` words, and the rows' offsets in them.

    A row of fewer words has one shingle, all its words; a row of none has none.
    """
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(at[-1]), np.uint64)
    with np.errstate(over="ignore"):
        if len(hashes) >= width:
            size = len(hashes) - width + 1
            run = np.full(size, np.uint64(width))
            for j in range(width):
                run += hashes[j : j + size] * _A[j]
            run = mix(run)
            full = np.flatnonzero(n >= width)
            if len(full):
                place = np.arange(int(count[full].sum())) - np.repeat(np.cumsum(count[full]) - count[full], count[full])
                out[place + np.repeat(at[full], count[full])] = run[place + np.repeat(first[full], count[full])]
        for row in np.flatnonzero((n > 0) & (n < width)):
            own = hashes[first[row] : first[row + 1]]
            out[at[row]] = mix(np.array([(own * _A[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64))[0]
    return out, at


def code_points(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' code points end to end (uint32) and their offsets."""
    points = np.frombuffer(bytes(data).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, lead[at]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: np.ndarray, at: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind) if kind else pa.array(values))
