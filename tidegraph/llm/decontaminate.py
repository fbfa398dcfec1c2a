"""Benchmark decontamination by the q-gram lemma.

Texts and items are compared as lower-cased code points with every run of white space
as one space.  An item of m code points may be found with up to
``k = floor(RATE * m)`` edits.  By the q-gram lemma such an occurrence shares at least
``m - Q + 1 - k * Q`` of the item's q-grams, on diagonals (place in text - place in
item) that lie within k of each other.  So:

1.  Every text position is looked up in a table of the items' q-grams; places with
    too few of them for any item, as far around as the longest item reaches, are passed over.
2.  The remaining hits are counted in diagonal bands of width 2k that overlap by k, so
    every run of k diagonals lies in one band whole.  Bands under the bound go.  A text position counts once a band
    for all near places of its q-gram in an item, so one repeated letter makes few entries, and hits
    are counted in chunks of at most ``CHUNK`` entries.
3.  What is left is verified by banded alignment: edit distance of the item to the
    best stretch of the band's region, over the diagonals of that band and k around it.

The items are a stated query set, searched in blocks of at most ``BLOCK_CHARS`` code
points (one pass over the texts per block), so what is sent to executors is bounded.

Items of under ``Q`` code points have no q-gram: they are found where they are a whole line of a text
(white space and case aside).

Defined results: null and empty texts or items match nothing; each repeated row is searched; of several places of an item in one row the one of fewest
edits counts, then the first; an empty table gives an empty result; only ``doc_id`` and ``text`` are read, whatever other columns are called; a very long text is
searched whole by one task, at some 60 bytes a code point.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph import scratch
from tidegraph.llm import _text

Q = 12
RATE = 0.06
BLOCK_CHARS = 2_000_000
CHUNK = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22
_lower: np.ndarray | None = None


def lower_table() -> np.ndarray:
    """Code point to lower-case code point (white space to a space); where lower case is longer, the point itself."""
    global _lower
    if _lower is None:
        table = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x20000):
            c = chr(i)
            if c.isspace():
                table[i] = 32
            elif c.isupper() or unicodedata.category(c) == "Lt":
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _lower = table
    return _lower


def normalize(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalized points, rows' offsets in them, and each one's place in ``points``."""
    low = lower_table()[points]
    keep = np.ones(len(low), bool)
    blank = low == 32
    keep[1:] = ~(blank[1:] & blank[:-1])
    edge = at[:-1][at[:-1] < len(low)]
    keep[edge] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return low[keep], total[at], np.flatnonzero(keep)


def grams(points: np.ndarray) -> np.ndarray:
    """Hash of the Q code points from each position on."""
    if len(points) < Q:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        one = points.astype(np.uint64) + np.uint64(1)
        two = one[:-1] * _BASE + one[1:]
        four = two[:-2] * _BASE**2 + two[2:]
        eight = four[:-4] * _BASE**4 + four[4:]
        h = eight[:-4] * _BASE**4 + four[8:]
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Items:
    """A block of items with their q-gram postings and bounds.

    The budget of edits is a share of RATE, as far as the bound asks for two q-grams at least: items of
    Q to 23 code points have a budget of none.
    """

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.points, texts = [], [], []
        #: Normalized items without q-grams.
        self.short: dict[str, list[int]] = {}
        for item, text in rows:
            raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
            p = trimmed(normalize(raw, np.array([0, len(raw)]))[0])
            if not len(p):
                continue
            if len(p) < Q:
                self.short.setdefault(p.tobytes().decode("utf-32-le", "surrogatepass"), []).append(len(self.ids))
            else:
                texts.append(len(self.ids))
            self.ids.append(item)
            self.points.append(p)
        m = np.array([len(p) for p in self.points], np.int64)
        k = np.floor(RATE * m).astype(np.int64)
        # The bound must ask for two grams at least; short items get a smaller budget.
        self.k = np.minimum(k, np.maximum(0, (m - Q - 1) // Q))
        self.m, self.least = m, m - Q + 1 - self.k * Q
        if not texts:
            self.hash = np.zeros(0, np.uint64)
            return
        h = [grams(self.points[i]) for i in texts]
        item = np.repeat(texts, [len(x) for x in h])
        place = np.concatenate([np.arange(len(x), dtype=np.int64) for x in h])
        h = np.concatenate(h)
        order = np.lexsort((place, item, h))
        h, item, place = h[order], item[order], place[order]
        # Places of a q-gram in an item at most a band's step apart are one run.
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (item[1:] != item[:-1]) | (place[1:] - place[:-1] > self.k[item[1:]] + 1)
        start = np.flatnonzero(new)
        h, self.item, self.low = h[start], item[start], place[start]
        self.high = place[np.append(start[1:], len(place)) - 1]
        self.hash, self.first = np.unique(h, return_index=True)
        self.last = np.append(self.first[1:], len(h))
        self.table = np.zeros(1 << _BITS, bool)
        self.table[(self.hash >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        # A stretch of `span` positions must hold `dense` hits somewhere in any occurrence.
        m, k, least = m[texts], self.k[texts], self.least[texts]
        self.span, self.reach = int((m + k).min()), int((m + k).max())
        self.dense = int((least // -(-(m + k) // self.span)).min())


def trimmed(points: np.ndarray) -> np.ndarray:
    """Normalized points without a space at either end."""
    a = 1 if len(points) and points[0] == 32 else 0
    return points[a : len(points) - 1 if len(points) > a and points[-1] == 32 else len(points)]


def distance(item: np.ndarray, region: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """Edit distance (at most k) of ``item`` to its best stretch of ``region``, with the stretch.

    Row by row over the item; a row holds the diagonals (place in region - place in item) from -k to
    len(region) - len(item) + k, beyond which no path of k edits goes.  The first of the best ends is taken.
    """
    m, n, far = len(item), len(region), 1 << 20
    width = n - m + 2 * k + 1
    if width <= 0:
        return None
    steps = np.arange(width, dtype=np.int32)
    wall = np.full(k + 1, 0xFFFFFFFF, np.uint32)
    padded = np.concatenate([wall, region, np.full(width, 0xFFFFFFFF, np.uint32)])
    row = np.where((steps >= k) & (steps - k <= n), 0, far).astype(np.int32)
    begin = np.maximum(steps - k, 0)
    take, origin = np.empty(width, np.int32), np.empty(width, np.int32)
    for i, c in enumerate(item, 1):
        sub = row + (padded[i : i + width] != c)
        take[:-1], take[-1] = row[1:] + 1, far
        origin[:-1], origin[-1] = begin[1:], 0
        less = sub <= take
        np.copyto(take, sub, where=less)
        np.copyto(origin, begin, where=less)
        take[max(0, n - i + k + 1) :] = far  # beyond the region
        lifted = take - steps
        low = np.minimum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == low, steps, 0))
        row, begin = low + steps, origin[source]
        row[max(0, n - i + k + 1) :] = far
        if row.min() > k:
            return None
    at = int(row.argmin())
    return (int(row[at]), int(begin[at]), m + at - k) if row[at] <= k else None


def _whole_lines(items: Items, points: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Short items that are a whole line of a row, at the first such line."""
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    for r, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        cut = np.flatnonzero(points[a:b] == 10)
        for s, t in zip([0, *(cut + 1).tolist()], [*cut.tolist(), b - a], strict=True):
            line = points[a + s : a + t]
            if len(line):
                norm, _, back = normalize(line, np.array([0, len(line)]))
                p = trimmed(norm)
                for i in items.short.get(p.tobytes().decode("utf-32-le", "surrogatepass"), ()) if 0 < len(p) < Q else ():
                    lead = int(norm[0] == 32)
                    out.setdefault((r, i), (0, s + int(back[lead]), s + int(back[lead + len(p) - 1]) + 1))
    return [(r, i, *v) for (r, i), v in sorted(out.items())]


def _bands(items: Items, row: np.ndarray, local: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row and item, band, as one number; text positions in it)`` of hits ``found`` at places ``local`` of rows."""
    count = items.last[found] - items.first[found]
    run = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(items.first[found], count)
    item = items.item[run]
    width = items.k[item] + 1
    place = np.repeat(local, count)
    low, high = (place - items.high[run]) // width - 1, (place - items.low[run]) // width
    size = high - low + 1
    key = ((np.repeat(row, count) * len(items.ids) + item) << 32) + (low + (1 << 30))
    keys = np.repeat(key, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return np.unique(keys, return_counts=True)


def search(items: Items, points: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """``(row, item index, edits, start, end)`` of each item found in a row; start and end in its code points.

    An item found several times in one row counts once, at its best and then first place.
    """
    lines = _whole_lines(items, points, at) if items.short else []
    return sorted(lines + _search(items, points, at))


def _search(items: Items, points: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    norm, to, back = normalize(points, at)
    h = grams(norm)
    if not len(h) or not len(items.hash):
        return []
    hit = items.table[(h >> np.uint64(64 - _BITS)).astype(np.int64)]
    total = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
    ahead = np.minimum(np.arange(len(h)) + items.span, len(h))
    dense = np.concatenate([[0], np.cumsum(total[ahead] - total[:-1] >= items.dense, dtype=np.int32)])
    # A dense stretch only tells where to look: all hits as far around it as an occurrence may reach are counted.
    behind, beyond = np.maximum(np.arange(len(h)) - items.reach, 0), np.minimum(np.arange(len(h)) + items.reach + 1, len(h))
    hit &= dense[beyond] - dense[behind] > 0
    where = np.flatnonzero(hit)
    found = np.searchsorted(items.hash, h[where])
    found[found == len(items.hash)] = 0
    true = items.hash[found] == h[where]
    where, found = where[true], found[true]
    row = np.searchsorted(to, where, "right") - 1
    inside = where + Q <= to[row + 1]
    where, found, row = where[inside], found[inside], row[inside]
    if not len(where):
        return []
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    # Entries of each hit: two bands a run of places, and one more for each step that a run is long.
    weight = np.add.reduceat(2 + (items.high - items.low) // (items.k[items.item] + 1), items.first)[found]
    local, chunk = where - to[row], np.cumsum(weight) // CHUNK
    edge = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
    heads, sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(chunk)], strict=True):
        more = _bands(items, row[a:b], local[a:b], found[a:b])
        heads, inverse = np.unique(np.concatenate([heads, more[0]]), return_inverse=True)
        sizes = np.bincount(inverse, weights=np.concatenate([sizes, more[1]])).astype(np.int64)
    enough = sizes >= items.least[(heads >> 32) % len(items.ids)]
    for head in heads[enough].tolist():
        r, i = divmod(head >> 32, len(items.ids))
        k = int(items.k[i])
        low = ((head & 0xFFFFFFFF) - (1 << 30)) * (k + 1) - k
        start = max(0, low) + int(to[r])
        region = norm[start : min(int(to[r + 1]), int(to[r]) + low + 4 * k + 2 + int(items.m[i]) + k)]
        best = out.get((r, i))
        exact = region.tobytes().find(items.points[i].tobytes())
        if exact >= 0 and exact % 4 == 0:
            match = (0, exact // 4, exact // 4 + int(items.m[i]))
        elif best and best[0] == 0:
            continue
        else:
            match = distance(items.points[i], region, k)
        if match:
            e, s, t = match
            new = (e, int(back[start + s] - at[r]), int(back[start + max(t, s + 1) - 1] - at[r]) + 1)
            out[r, i] = min(best, new) if best else new
    return [(r, i, *v) for (r, i), v in sorted(out.items())]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, edits, start, end)``: each benchmark item found in each document."""
    spark = docs.sparkSession
    scratch.ship_package(spark)
    out = None
    for rows in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value)
            for batch in batches:
                for part in _text.slices(batch, limit=1 << 17):
                    ids = part.column(part.schema.get_field_index("doc_id")).to_pylist()
                    data, at = _text.text_bytes(part.column(part.schema.get_field_index("text")))
                    found = search(items, *_text.code_points(data, at))
                    cols = list(zip(*[(ids[r], items.ids[i], e, s, t) for r, i, e, s, t in found], strict=True)) or [()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "edits", "start", "end"])

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, edits long, start long, end long")
        out = found if out is None else out.unionByName(found)
    return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most BLOCK_CHARS code points; one empty block if there are none."""
    rows, size, any_ = [], 0, False
    for r in benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        if rows and size + len(r["text"]) > BLOCK_CHARS:
            yield rows
            rows, size, any_ = [], 0, True
        rows.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if rows or not any_:
        yield rows


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document holds no benchmark item."""
    # Written first, so that the join knows its size: it is broadcast only when small.
    found = scratch.materialize(leaks(docs, benchmark).select(F.col("doc_id").alias("_leaked")).distinct(), "leaked")
    return docs.alias("d").join(found.alias("f"), F.col("d.doc_id") == F.col("f._leaked"), "left_anti").select("d.*")


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
