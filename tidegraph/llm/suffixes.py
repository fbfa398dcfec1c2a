"""Removal of long repeated byte strings by a distributed difference-cover sort of suffixes.

All positions whose next 200 bytes also start elsewhere are found as follows.

1.  Filter (lossless).  Of the hashed 81-byte names in a 200-byte window the least is its
    anchor.  Equal windows have equal anchors, so a window can repeat only if its anchor
    does; only texts with such windows go on, and of them only what these windows cover.
2.  Sampled triples.  The positions that are 1 or 2 modulo 3 are the sample: whatever two
    positions are compared, one of the next two steps brings both into it.  A sampled position
    is named by the triple of 8-byte words that starts there: all triples are sorted,
    equal ones share a rank, and the rank is the name.  A triple that occurs once gets no
    name, and nothing that contains it is looked at again, as it cannot repeat.
3.  Recursion on names.  Triples of names 24 bytes apart are sorted and named in the same
    way (72 bytes), then triples of those (72 and 126 bytes on: 198 bytes).  Both steps
    are multiples of 3, so a triple of a sampled position is made of sampled ones.
4.  Merge.  The remaining third joins by the one or two bytes before the next sampled
    position: two positions meet under (name, 2 bytes) when both are sampled, else under
    (byte, name, byte) or (2 bytes, name), whichever brings both into the sample.
5.  Equal prefixes are neighbours in that order; the windows of neighbours are marked.

Names are exact: keys are compared byte by byte, and a rank stands for one string.  Hashes
only choose candidates in step 1, the order in which equal keys meet, and (as 128 bits) which texts are
equal.

Work is dealt out in parts of ``PART`` bytes of text, one row each.  A part sorts its own keys and sends
each distinct one once, in packed blocks, to the range of the order that it falls into;
the range sorts what all parts sent and answers with ranks in the sender's order.  So a key that
is found everywhere costs one entry a part, and rows are blocks, never positions.  Texts
that share their least 27-byte name lie in the same or neighbouring parts, so that most copies
of a passage are one key already when they are sent.

Rows of equal text are one text (with its number of holders) throughout.  Texts are judged on the
input; bytes of marked windows are cut out once.

Defined results: null text is empty; texts under 200 bytes keep all; each repeated row is a
document of its own, so it and its twin lose all of 200 bytes and more; an empty table gives an empty
table; columns beside ``doc_id`` and ``text`` are not read, whatever they are called.  A very long text is handled whole
by one task, at some hundred bytes of memory a byte of text that may repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph import scratch
from tidegraph.llm import _text

LENGTH = 200
#: Bytes of text of a part, of a slice of it that is hashed at once, and keys that a range of the order sorts.
PART = 4 << 20
SLICE = 1 << 16
RANGE_KEYS = 1 << 20
_NAME = 81
_W = LENGTH - _NAME + 1  # names in a window
_NEAR = 27
_ROUNDS = ((24, 8, 16), (72, 24, 48), (198, 72, 126))  # bytes named, and where the second and third of a triple start
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
_PARTS = "h binary, ends binary, data binary"
_STATE = f"t long, {_PARTS}, runs binary, names binary"
_CUT = "h1 long, h2 long, n_removed long, spans array<struct<start: long, end: long>>, kept binary, sha string"


def _triple(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    h = x * _A + (y ^ (y >> np.uint64(31))) * _B + (z ^ (z >> np.uint64(29))) * _C
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def hashed(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes (a power of 3) from each position on."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        x, step = _text._BYTE[data], 1
        while step < size:
            x = _triple(x[: len(x) - 2 * step], x[step : len(x) - step], x[2 * step :])
            step *= 3
        return _text.mix(x) | np.uint64(1)


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i .. i + width) for every i that has so many."""
    have = 1
    while have * 2 <= width:
        x = op(x[: len(x) - have], x[have:])
        have *= 2
    return op(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def _over_end(at: np.ndarray, n: int) -> np.ndarray:
    """For texts laid end to end (offsets ``at``): whether the window of each of the first n positions runs over its text's end."""
    out = np.ones(n + LENGTH, bool)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= LENGTH:
            out[a : b - LENGTH + 1] = False
    return out[:n]


def anchors(names: np.ndarray, over: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(least name of each window, positions that are the least name of some window)``, without windows that are ``over``."""
    least = _slide(names, _W, np.minimum)
    pad = np.zeros(_W - 1, np.uint64)
    most = _slide(np.concatenate([pad, np.where(over, np.uint64(0), least), pad]), _W, np.maximum)
    return least, np.flatnonzero(most == names)


def _sliced(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE bytes."""
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE, "right")) - 1)
        yield i, j
        i = j


def _anchored(data: np.ndarray, at: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(offset, names, least, over, anchor positions)`` of each slice of a part."""
    out = []
    for i, j in _sliced(at):
        part = data[at[i] : at[j]]
        if len(part) >= LENGTH:
            names = hashed(part, _NAME)
            over = _over_end(at[i : j + 1] - at[i], len(names) - _W + 1)
            least, where = anchors(names, over)
            out.append((int(at[i]), names, least, over, where))
    return out


# ---- keys, ranges, ranks


def _order(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(order, first place of each distinct key in it, hashes)``; keys are rows of ``columns``.
    Keys go by their hashes, as far as these and the place of a key fit into 64 bits together."""
    with np.errstate(over="ignore"):
        h = columns[0].astype(np.uint64)
        for k, c in zip((_B, _C), columns[1:], strict=False):
            h = (h ^ (h >> np.uint64(29))) * k + c
        h = _text.mix(h)
    n = len(h)
    places = (np.uint64(1) << np.uint64(n.bit_length())) - np.uint64(1)
    packed = (h & ~places) | np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & places).astype(np.int64)
    new = np.zeros(n, bool)
    for c in columns:
        x = c[order]
        new[1:] |= x[1:] != x[:-1]
    new[:1] = True
    packed &= ~places
    alike = packed[1:] == packed[:-1]
    if (alike & new[1:]).any():  # different keys that the order does not tell apart: sort them by themselves
        run = np.concatenate([[0], np.cumsum(~alike)])
        mixed = np.zeros(run[-1] + 1, bool)
        mixed[run[1:][alike & new[1:]]] = True
        at = np.flatnonzero(mixed[run])
        some = order[at]
        order[at] = some[np.lexsort((some, *(c[some] for c in columns), run[at]))]
        new[:] = False
        for c in columns:
            x = c[order]
            new[1:] |= x[1:] != x[:-1]
        new[:1] = True
    return order, np.flatnonzero(new), h


def _send(t: int, columns: list[np.ndarray], ranges: int) -> Iterator[pa.RecordBatch]:
    """A part's distinct keys, cut into ranges: ``(r, t, width, keys, twice)``."""
    if not len(columns[0]):
        return
    order, first, h = _order(columns)
    twice = np.diff(np.append(first, len(order))) > 1
    width = 4 if all(int(c.max()) < 1 << 32 for c in columns) else 8
    lead = order[first]
    keys = [c[lead].astype(f"<u{width}") for c in columns]
    # Hashes ascend by their upper 32 bits: the lower bits may give way to the place of a key.
    cut = np.searchsorted((h[lead] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1))
    have = np.flatnonzero(np.diff(cut))
    for some in np.array_split(have, -(-len(have) // 64)):
        spans = [slice(cut[r], cut[r + 1]) for r in some]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(some.astype(np.int64)),
                pa.array(np.full(len(some), t, np.int64)),
                pa.array(np.full(len(some), width, np.int32)),
                pa.array([b"".join(k[s].tobytes() for k in keys) for s in spans], pa.binary()),
                pa.array([np.packbits(twice[s]).tobytes() for s in spans], pa.binary()),
                pa.array(np.array([s.stop - s.start for s in spans], np.int64)),
            ],
            ["r", "t", "width", "keys", "twice", "n"],
        )


_SENT = "r long, t long, width int, keys binary, twice binary, n long"


def _ranker(columns: int, ranges: int, named: bool):
    """The work of one range: ranks of the keys of all parts, or only whether they occur twice."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        r, out = key[0].as_py(), []
        rows = list(zip(*(table.column(k).to_pylist() for k in ("t", "width", "keys", "twice", "n")), strict=True))
        parts = [np.frombuffer(x[2], f"<u{x[1]}").reshape(columns, x[4]) for x in rows]
        order, first, _ = _order([np.concatenate([p[c] for p in parts]).astype(np.uint64) for c in range(columns)])
        many = np.concatenate([np.unpackbits(np.frombuffer(x[3], np.uint8), count=x[4]) for x in rows])[order]
        size = np.diff(np.append(first, len(order)))
        seen = (size > 1) | (many[first] > 0)
        name = np.where(seen, np.cumsum(seen) * ranges + r, 0).astype(np.uint64)
        answer = np.empty(len(order), np.uint64)
        answer[order] = np.repeat(name, size)
        at = np.cumsum([0, *[x[4] for x in rows]])
        for i, x in enumerate(rows):
            own = answer[at[i] : at[i + 1]]
            wide = 4 if not len(own) or int(own.max()) < 1 << 32 else 8
            blob = own.astype(f"<u{wide}").tobytes() if named else np.packbits(own > 0).tobytes()
            out.append((x[0], r, wide, x[4], blob))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        return pa.table([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], ["t", "r", "width", "n", "names"])

    return run


def _answers(rows: list[dict], named: bool) -> np.ndarray:
    """The answers of all ranges to a part, in the order of its distinct keys."""
    rows = sorted(rows, key=lambda x: x["r"])
    if named:
        return np.concatenate([np.frombuffer(x["names"], f"<u{x['width']}").astype(np.uint64) for x in rows])
    return np.concatenate([np.unpackbits(np.frombuffer(x["names"], np.uint8), count=x["n"]) for x in rows])


def _of_keys(columns: list[np.ndarray], answers: np.ndarray) -> np.ndarray:
    """The answers, which are of distinct keys in order, for every key."""
    order, first, _ = _order(columns)
    out = np.empty(len(order), answers.dtype)
    out[order] = np.repeat(answers, np.diff(np.append(first, len(order))))
    return out


def _rounded(parts: DataFrame, emit, columns: int, ranges: int, named: bool) -> DataFrame:
    """``parts`` with the column ``back``: what the ranges answer to the keys that ``emit`` makes of each part.
    Parts without keys are left out."""
    sent = parts.mapInArrow(emit(ranges), _SENT)
    back = sent.groupBy("r").applyInArrow(_ranker(columns, ranges, named), "t long, r long, width int, n long, names binary")
    back = back.groupBy("t").agg(F.collect_list(F.struct("r", "width", "n", "names")).alias("back"))
    return parts.join(back.hint("merge"), "t")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _longs(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<i8")


# ---- the steps of a part


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least 27-byte name of each text."""
    for batch in batches:
        for part in _text.slices(batch, limit=SLICE):
            data, at = _text.text_bytes(part.column(part.schema.get_field_index("text")))
            names = hashed(np.concatenate([data, np.zeros(_NEAR, np.uint8)]), _NEAR)
            names[np.minimum(at[1:, None] - 1 - np.arange(_NEAR - 1), len(names) - 1).ravel()] = _MOST  # those that run over the end
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_text.signed(np.minimum.reduceat(names[: at[-1]], at[:-1])))], [*part.schema.names, "near"])


def _gather(part_bytes: int):
    """Texts as parts."""

    def part(h: list[int], held: list[bytes]) -> pa.RecordBatch:
        ends = np.cumsum([len(x) for x in held]).astype("<i8")
        return pa.RecordBatch.from_arrays([pa.array([np.array(h, "<i8").tobytes()], pa.binary()), pa.array([ends.tobytes()], pa.binary()), pa.array([b"".join(held)], pa.binary())], ["h", "ends", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h: list[int] = []
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for h1, h2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                h += [h1, h2]
                held.append(text)
                size += len(text)
                if size >= part_bytes:
                    yield part(h, held)
                    h, held, size = [], [], 0
        if held:
            yield part(h, held)

    return run


def _send_anchors(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _rows(batches):
            at = np.append(0, _longs(x["ends"]))
            found = [names[where] for _, names, _, _, where in _anchored(np.frombuffer(x["data"], np.uint8), at)]
            if found:
                yield from _send(x["t"], [np.concatenate(found)], ranges)

    return run


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that have windows with a repeated anchor, and the runs of bytes that these cover."""
    for x in _rows(batches):
        at, data = np.append(0, _longs(x["ends"])), np.frombuffer(x["data"], np.uint8)
        slices = _anchored(data, at)
        flags = _of_keys([np.concatenate([names[where] for _, names, _, _, where in slices])], _answers(x["back"], False)) > 0
        start = np.zeros(len(data) + 1, bool)
        for offset, names, least, over, where in slices:
            own, flags = flags[: len(where)], flags[len(where) :]
            seen = np.full(len(names), _MOST)
            seen[where[own]] = names[where[own]]
            start[offset : offset + len(least)] |= (_slide(seen, _W, np.minimum) == least) & ~over
        if not start.any():
            continue
        places = np.flatnonzero(start)
        change = start.astype(np.int8)
        change[places + LENGTH] -= 1
        covered = np.cumsum(change[:-1], dtype=np.int32) > 0
        size = np.diff(at)
        kept = np.zeros(len(size), bool)
        kept[np.searchsorted(at, places, "right") - 1] = True
        keep = np.repeat(kept, size)
        covered, ends = covered[keep], np.cumsum(size[kept])
        new, last = covered.copy(), covered.copy()
        new[1:] &= ~covered[:-1]
        new[ends[:-1]] = covered[ends[:-1]]
        last[:-1] &= ~covered[1:]
        last[ends - 1] = covered[ends - 1]
        runs = np.stack([np.flatnonzero(new), np.flatnonzero(last) + 1])
        h = _longs(x["h"]).reshape(-1, 2)[kept]
        yield _state(x["t"], h.tobytes(), ends.astype("<i8").tobytes(), data[keep].tobytes(), runs.astype("<i8").tobytes(), b"")


def _state(t: int, h: bytes, ends: bytes, data: bytes, runs: bytes, names: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([t], pa.int64()), *[pa.array([v], pa.binary()) for v in (h, ends, data, runs, names)]], ["t", "h", "ends", "data", "runs", "names"])


class Runs:
    """The runs of a part laid end to end, each from a multiple of 3 on, with the names so far."""

    def __init__(self, row: dict):
        self.start, end = _longs(row["runs"]).reshape(2, -1)
        self.size = end - self.start
        self.room = (self.size + 2) // 3 * 3
        self.begin = np.cumsum(self.room) - self.room
        total = int(self.room.sum())
        here = np.arange(total, dtype=np.int32)
        self.left = np.maximum(np.repeat((self.begin + self.size).astype(np.int32), self.room) - here, 0)  # bytes to the end of the run
        data = np.frombuffer(row["data"], np.uint8)
        self.bytes = np.zeros(total + LENGTH + 8, np.uint8)
        for to, a, b in zip(self.begin.tolist(), self.start.tolist(), end.tolist(), strict=True):
            self.bytes[to : to + b - a] = data[a:b]
        self.sampled = np.flatnonzero((here % 3 != 0) & (self.left >= _ROUNDS[0][0])).astype(np.int32)
        self.names = np.zeros(total + LENGTH, np.uint64)
        if row["names"]:
            self.names[self.sampled] = np.frombuffer(row["names"], f"<u{len(row['names']) // max(1, len(self.sampled))}")

    def source(self, places: np.ndarray) -> np.ndarray:
        """Where positions lie in the part's data."""
        run = np.searchsorted(self.begin, places, "right") - 1
        return self.start[run] + places - self.begin[run]

    def triples(self, level: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """``(sampled positions that can repeat, their triples)``."""
        size, second, third = _ROUNDS[level]
        p = self.sampled[self.left[self.sampled] >= size]
        if level == 0:
            words = np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes, strides=(1,))
            return p, [words[p], words[p + second], words[p + third]]
        n = self.names
        p = p[(n[p] > 0) & (n[p + second] > 0) & (n[p + third] > 0)]
        return p, [n[p], n[p + second], n[p + third]]

    def merged(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """``(window starts, their keys)``: two keys a window, one for each other class of positions that it is compared with."""
        i = np.flatnonzero(self.left >= LENGTH).astype(np.int32)
        b, kind, last = self.bytes, i % 3, LENGTH - 1
        where, names, tails = [], [], []
        # Which class is left out, how far the sampled position is, and the two bytes beside its name.
        for tag, (out, step, one, two) in enumerate(((0, 0, last - 1, last), (2, 1, 0, last), (1, 2, 0, 1))):
            p = i[kind != out]
            name = self.names[p + step]
            p, name = p[name > 0], name[name > 0]
            where.append(p)
            names.append(name)
            tails.append((b[p + one].astype(np.uint32) << np.uint32(8)) | b[p + two] | np.uint32(tag << 16))
        return np.concatenate(where), [np.concatenate(names), np.concatenate(tails)]


def _send_level(level: int):
    def of(ranges: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in _rows(batches):
                runs = Runs(x)
                yield from _send(x["t"], (runs.triples(level) if level < len(_ROUNDS) else runs.merged())[1], ranges)

        return run

    return of


def _rename(level: int):
    """Names of the next length in place of the last ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _rows(batches):
            runs = Runs(x)
            p, columns = runs.triples(level)
            runs.names[:] = 0
            runs.names[p] = _of_keys(columns, _answers(x["back"], True))
            own = runs.names[runs.sampled]
            if own.any():
                wide = 4 if int(own.max()) < 1 << 32 else 8
                yield _state(x["t"], x["h"], x["ends"], x["data"], x["runs"], own.astype(f"<u{wide}").tobytes())

    return run


def cut(data: np.ndarray, at: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, bytes, list[tuple[int, int]]]]:
    """``(text, what is left, maximal runs cut out)`` of each text that holds a window starting at ``starts``."""
    first = np.zeros(len(data) + 1, np.int8)
    first[starts] = 1
    starts = np.flatnonzero(first)
    first[starts + LENGTH] -= 1
    gone = np.cumsum(first[:-1], dtype=np.int32) > 0
    held = np.zeros(len(at) - 1, bool)
    held[np.searchsorted(at, starts, "right") - 1] = True
    for i in np.flatnonzero(held).tolist():
        own = gone[at[i] : at[i + 1]]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
        yield i, data[at[i] : at[i + 1]][~own].tobytes(), list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for x in _rows(batches):
        runs = Runs(x)
        where, columns = runs.merged()
        starts = runs.source(where[_of_keys(columns, _answers(x["back"], False)) > 0])
        at, h = np.append(0, _longs(x["ends"])), _longs(x["h"]).reshape(-1, 2)
        out = [(*h[i].tolist(), int(at[i + 1] - at[i]) - len(kept), [{"start": a, "end": b} for a, b in spans], kept, hashlib.sha256(kept).hexdigest()) for i, kept, spans in cut(np.frombuffer(x["data"], np.uint8), at, starts)]
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int64(), span, pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], ["h1", "h2", "n_removed", "spans", "kept", "sha"])


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"), F.octet_length(text).cast("long").alias("n_bytes")
    )


def removals(docs: DataFrame, part_bytes: int = PART, range_keys: int = RANGE_KEYS) -> tuple[DataFrame, DataFrame]:
    """``(classes, results)``: the holders of texts that several rows have, ``(h1, h2, holders)``, and for texts that lose bytes
    ``(h1, h2, n_removed, spans, kept, sha)``."""
    spark = docs.sparkSession
    scratch.ship_package(spark)

    def ranges(keys: int) -> int:
        return max(1, -(-keys // range_keys))

    same = _keyed(docs).where(F.col("n_bytes") >= LENGTH).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("holders"), F.any_value("text").alias("text"))
    texts = same.mapInArrow(_mark, "h1 long, h2 long, holders long, text string, near long")
    texts = scratch.materialize(texts, "texts")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    classes = scratch.materialize(texts.where("holders > 1").select("h1", "h2", "holders"), "classes")
    some = max(1, -(-size // (4 * part_bytes)))
    dealt = texts.select("h1", "h2", "text", "near").repartitionByRange(some, "near", "h1").sortWithinPartitions("near", "h1")
    parts = dealt.mapInArrow(_gather(part_bytes), _PARTS).withColumn("t", F.monotonically_increasing_id())
    parts = scratch.replace(parts, "parts", texts)
    state = _rounded(parts, _send_anchors, 1, ranges(size // 50), False).mapInArrow(_narrow, _STATE)
    state = scratch.replace(state, "state", parts)
    size = state.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    for level in range(len(_ROUNDS)):
        state = scratch.replace(_rounded(state, _send_level(level), 3, ranges(size * 2 // 3), True).mapInArrow(_rename(level), _STATE), "state", state)
    return classes, scratch.replace(_rounded(state, _send_level(len(_ROUNDS)), 2, ranges(size * 2), False).mapInArrow(_cut, _CUT), "cut", state)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(docs)


def digest(docs: DataFrame, part_bytes: int = PART, range_keys: int = RANGE_KEYS) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of each row."""
    classes, results = removals(docs, part_bytes, range_keys)
    results = results.select("h1", "h2", "n_removed", F.size("spans").cast("long").alias("n_spans"), "sha")
    verdict = scratch.materialize(classes.join(results.hint("merge"), ["h1", "h2"], "full"), "verdict")
    rows = _keyed(docs).select("doc_id", "h1", "h2", "n_bytes", F.sha2("text", 256).alias("own"))
    out = rows.join(verdict.hint("merge"), ["h1", "h2"], "left")
    whole = F.col("holders").isNotNull()
    none = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", none)).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", none)).alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "own")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with ``text`` less its repeated strings.  Where a cut splits a
    character, the broken bytes read as U+FFFD."""
    classes, results = removals(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.struct("*").alias("row"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"))
    out = own.join(classes.hint("merge"), ["h1", "h2"], "left").join(results.select("h1", "h2", F.decode("kept", "UTF-8").alias("kept")).hint("merge"), ["h1", "h2"], "left")
    text = F.when(F.col("holders").isNotNull(), "").otherwise(F.coalesce("kept", F.coalesce(F.col("row.text"), F.lit(""))))
    return out.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
