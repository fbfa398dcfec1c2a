"""MinHash near-dedup with odd sketches.

A text is its set of distinct five-word shingles.  128 MinHash values give 32 bands of
four and, folded by parity, an odd sketch of 512 bits: the XOR of two sketches
has about ``256 * (1 - exp(-(1 - J)))`` bits set, which tells similarities near the
threshold apart far better than it tells low ones.

1.  Rows of equal set become one class (a combined ``min`` per set digest) with a number of its own, so a group
    of thousands of copies is one vertex from here on.
2.  Bands: every class that shares a band value with others is compared with one class
    of that bucket, the hub (the one with most company) - one candidate a row, never all
    pairs.  A candidate whose sketches differ by more than ``MAX_BITS`` is far below 0.75
    (over five standard errors); the rest are confirmed on the full sets.
3.  A class that its hub does not confirm is left over.  While many are left, they get
    another round with a hub of their own.  At last every class of a bucket that is not in
    the bucket's largest component meets the whole bucket, but for classes of its own
    component: of two classes in different components one is always among these, whichever
    hub took them out.  The condition of that join is lossless (:func:`_may_link`, parity
    bitmaps of the whole sets), so that next to nothing but links comes out of it: no link
    that could join two components is lost.
4.  Connected components of the confirmed links and of the classes that rows of one ``doc_id`` are in, then back to all rows.

A pair of similarity 0.75 shares no band with probability (1 - 0.75**4)**32 < 6e-6.

Defined results: null, empty or blank texts have no shingles and stand alone; with one
to four words the whole sequence is the only shingle; rows of one ``doc_id`` (repeated
rows) are one document with the union of the rows' links; a null ``doc_id`` links with nothing and
is kept; an empty table gives an empty table; columns beside ``doc_id`` and ``text``
are not read, whatever they are called; a very long text is one set, held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph import scratch
from tidegraph.llm import _text
from tidegraph.operators.components import connected_components

WIDTH = 5
BANDS, ROWS = 32, 4
K = BANDS * ROWS
SKETCH_BITS = 512
WORDS64 = SKETCH_BITS // 64
MAX_BITS = 100
#: Bits of the parity bitmap of a whole set.
WIDE_BITS = 2048
#: Star rounds before the left-over classes meet all of their bucket.
STAR_ROUNDS = 4
PERCENT = 75
#: Sketch comparisons (inside a join, none emitted) for which no further star round pays.
FEW_MEETINGS = 20_000_000

_XOR = (_text.mix(np.arange(1, K + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)[:, None]
_MUL = (_text.mix(np.arange(1001, K + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)


def signature(distinct: np.ndarray) -> np.ndarray:
    """The K MinHash values (uint32) of one set of 64-bit hashes, taken in blocks."""
    low = np.full(K, np.uint32(0xFFFFFFFF))
    folded = (distinct ^ (distinct >> np.uint64(32))).astype(np.uint32)
    with np.errstate(over="ignore"):
        for a in range(0, len(folded), 2048):
            x = (folded[None, a : a + 2048] ^ _XOR) * _MUL
            np.minimum(low, (x ^ (x >> np.uint32(15))).min(axis=1), out=low)
    return low


def odd_sketches(signatures: np.ndarray) -> np.ndarray:
    """(rows, WORDS64) uint64: bit h(i, value i) flipped for each of the K values."""
    n = len(signatures)
    bit = _text.mix(signatures.astype(np.uint64) + (np.arange(K, dtype=np.uint64) << np.uint64(33))) % np.uint64(SKETCH_BITS)
    flat = (np.arange(n, dtype=np.int64)[:, None] * SKETCH_BITS + bit.astype(np.int64)).ravel()
    odd = (np.bincount(flat, minlength=n * SKETCH_BITS) & 1).astype(np.uint8).reshape(n, SKETCH_BITS)
    return np.packbits(odd, axis=1).view(np.uint64)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    parts = signatures.astype(np.uint64).reshape(len(signatures), BANDS, ROWS)
    with np.errstate(over="ignore"):
        total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(40), parts.shape[:2]).copy()
        for r in range(ROWS):
            total = _text.mix(total * np.uint64(31) + parts[:, :, r])
    return total


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in _text.slices(batch):
        data, at = _text.text_bytes(part.column(part.schema.get_field_index("text")))
        low = _text.LOWER[data]
        starts, ends, first = _text.words(low, at)
        runs, to = _text.shingles(_text.word_hashes(low, starts, ends), first, WIDTH)
        yield part, [np.unique(runs[to[i] : to[i + 1]]) for i in range(part.num_rows)]


_SKETCH = [f"s{i}" for i in range(WORDS64)]
_WIDE = [f"w{i}" for i in range(WIDE_BITS // 64)]
_SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, " + ", ".join(f"{c} long" for c in _SKETCH)
_SETS = "x long, d1 long, d2 long, size long, grams array<long>, " + ", ".join(f"{c} long" for c in _WIDE)


def _digests(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    with np.errstate(over="ignore"):
        d1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
        d2 = np.array([_text.mix(s + np.uint64(11)).sum(dtype=np.uint64) for s in sets], np.uint64)
    return pa.array(_text.signed(d1)), pa.array(_text.signed(d2))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, sets in _sets(batch):
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            sig = np.stack([signature(sets[i]) for i in full]) if len(full) else np.zeros((0, K), np.uint32)
            sketch = np.zeros((len(n), WORDS64), np.uint64)
            sketch[full] = odd_sketches(sig)
            at = np.concatenate([[0], np.cumsum((n > 0) * BANDS)])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(part.schema.get_field_index("doc_id")).cast(pa.int64()),
                    pa.array(n),
                    *_digests(sets),
                    _text.list_array(_text.signed(band_keys(sig).ravel()), at),
                    *[pa.array(_text.signed(np.ascontiguousarray(sketch[:, i]))) for i in range(WORDS64)],
                ],
                ["doc_id", "n_shingles", "d1", "d2", "bands", *_SKETCH],
            )


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The full sets, and the parity bitmap of each whole set."""
    for batch in batches:
        for part, sets in _sets(batch):
            size = np.array([len(s) for s in sets], np.int64)
            at = np.concatenate([[0], np.cumsum(size)])
            flat = np.concatenate(sets)
            bit = np.repeat(np.arange(len(sets)) * WIDE_BITS, size) + (flat >> np.uint64(64 - WIDE_BITS.bit_length() + 1)).astype(np.int64)
            odd = (np.bincount(bit, minlength=len(sets) * WIDE_BITS) & 1).astype(np.uint8).reshape(len(sets), WIDE_BITS)
            wide = np.packbits(odd, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("x")), *_digests(sets), pa.array(size), _text.list_array(_text.signed(flat), at), *[pa.array(np.ascontiguousarray(wide[:, i])) for i in range(len(_WIDE))]],
                ["x", "d1", "d2", "size", "grams", *_WIDE],
            )


def _confirm(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact test of 100 * |A and B| >= 75 * |A or B| on sorted sets."""
    for batch in pairs:
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        u, v = cols["gu"], cols["gv"]
        fu, au = u.values.to_numpy(zero_copy_only=False).view(np.uint64), np.asarray(u.offsets)
        fv, av = v.values.to_numpy(zero_copy_only=False).view(np.uint64), np.asarray(v.offsets)
        yes = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            a, b = fu[au[i] : au[i + 1]], fv[av[i] : av[i + 1]]
            if len(a) * 100 < len(b) * PERCENT or len(b) * 100 < len(a) * PERCENT:
                continue
            both = np.concatenate([a, b])
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            yes[i] = 100 * shared >= PERCENT * (len(both) - shared)
        yield pa.RecordBatch.from_arrays([cols["u"].filter(pa.array(yes)), cols["v"].filter(pa.array(yes))], ["u", "v"])


def _differ(a: str, b: str, columns: list[str]):
    total = F.lit(0)
    for c in columns:
        total = total + F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")))
    return total


def _may_link(a: str, b: str):
    """False only for pairs under the similarity: the XOR of two sets' parity bitmaps has no
    more bits than the sets have differing elements, and a link allows (|x| + |y|) / 7 of these."""
    return _differ(a, b, _WIDE) * (100 + PERCENT) <= (F.col(f"{a}.size") + F.col(f"{b}.size")) * (100 - PERCENT)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs ``(u, v)`` whose full sets are similar enough."""
    slim = sets.drop("grams")
    near = pairs.alias("p").join(slim.alias("a"), F.col("p.u") == F.col("a.x")).join(slim.alias("b"), F.col("p.v") == F.col("b.x"))
    near = scratch.materialize(near.where(_may_link("a", "b")).select("p.u", "p.v").distinct(), "near")
    left = near.join(sets.select(F.col("x").alias("u"), F.col("grams").alias("gu")), "u")
    both = left.join(sets.select(F.col("x").alias("v"), F.col("grams").alias("gv")), "v")
    return scratch.materialize(both.select("u", "v", "gu", "gv").mapInArrow(_confirm, "u long, v long").distinct(), "links")


def _meetings(rest: DataFrame, bucket: DataFrame) -> int:
    """Comparisons that joining the left-over classes with their buckets takes."""
    r = rest.groupBy("band").agg(F.count(F.lit(1)).alias("r"))
    b = bucket.groupBy("band").agg(F.count(F.lit(1)).alias("b"))
    return int(r.join(b, "band").agg(F.coalesce(F.sum(F.col("r").cast("double") * F.col("b")), F.lit(0.0)).alias("n")).first()["n"])


def _hubs(rows: DataFrame) -> DataFrame:
    """``(band, hub)``: the class of each bucket that has most company over all its buckets, then the smallest."""
    return scratch.materialize(rows.groupBy("band").agg(F.min(F.struct(-F.col("company"), "x")).alias("m")).select("band", F.col("m.x").alias("hub")), "hubs")


def near_duplicate_links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(signed, reps, links)``: signed has ``doc_id``, ``n_shingles`` and the set digest of every row, reps the
    classes ``(d1, d2, n_shingles, rep, x)`` with their smallest document and number, links has confirmed ``(u, v)`` between classes,
    enough for all components."""
    scratch.ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    signed = scratch.materialize(rows.mapInArrow(_sign, _SIGNED), "signed")
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = some.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep")).withColumn("x", F.monotonically_increasing_id())
    reps = scratch.materialize(reps, "reps")
    own = signed.alias("s").join(reps.alias("r").hint("merge"), (F.col("s.doc_id") == F.col("r.rep")) & (F.col("s.d1") == F.col("r.d1")) & (F.col("s.d2") == F.col("r.d2")))
    own = scratch.materialize(own.select("r.x", "bands", *_SKETCH).dropDuplicates(["x"]), "own")
    banded = own.select("x", F.explode("bands").alias("band"))
    shared = scratch.materialize(banded.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared")
    bucket = scratch.materialize(banded.join(shared.hint("merge"), "band"), "bucket")
    company = scratch.materialize(bucket.groupBy("x").agg(F.sum("c").alias("company")), "company")
    bucket = scratch.materialize(bucket.select("band", "x").join(company.hint("merge"), "x"), "bucket")
    # Only here are texts dealt out by id, once: the sets of all classes that share a bucket.
    wanted = reps.join(company.select("x").hint("merge"), "x", "left_semi").select("x", F.col("rep").alias("doc_id"), "d1", "d2")
    wanted = scratch.materialize(wanted, "wanted")
    sets = rows.join(wanted.select("x", "doc_id").hint("merge"), "doc_id").select("x", "text").mapInArrow(_shingle_rows, _SETS)
    # A document may have rows of other texts: only its set of the right digest counts.
    sets = scratch.materialize(sets.join(wanted.drop("doc_id").hint("merge"), ["x", "d1", "d2"], "left_semi").drop("d1", "d2") if _several(signed) else sets.drop("d1", "d2"), "sets")
    sketch = own.drop("bands").join(company.select("x").hint("merge"), "x", "left_semi")
    sketch = scratch.materialize(sketch, "sketch")
    rest, links, some_left = bucket, None, None
    for _ in range(STAR_ROUNDS):
        left = scratch.materialize(rest.join(_hubs(rest).hint("merge"), "band").where("x <> hub"), "left")
        pairs = left.select(F.least("hub", "x").alias("u"), F.greatest("hub", "x").alias("v")).distinct()
        near = (
            pairs.alias("p").join(sketch.alias("a"), F.col("p.u") == F.col("a.x")).join(sketch.alias("b"), F.col("p.v") == F.col("b.x"))
            .where(_differ("a", "b", _SKETCH) <= MAX_BITS).select("p.u", "p.v")
        )
        found = _confirmed(scratch.materialize(near, "pairs"), sets)
        links = found if links is None else links.unionByName(found)
        linked = links.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(links.select(F.col("v").alias("a"), F.col("u").alias("b")))
        rest = left.alias("l").join(linked.alias("k").hint("merge"), (F.col("k.a") == F.col("l.hub")) & (F.col("k.b") == F.col("l.x")), "left_anti").select("band", "x", "company")
        rest = scratch.materialize(rest, "rest")
        if some_left is None:
            # Where hub 1 confirms all, the bucket is one component.  Later hubs only add links:
            # what they confirm has not met what hub 1 confirmed, so it stays for the final join.
            if rest.isEmpty():
                return signed, reps, links
            some_left = scratch.materialize(rest.select("band").distinct(), "some_left")
        if rest.isEmpty() or _meetings(rest, bucket) <= FEW_MEETINGS:
            break
    parts = scratch.materialize(connected_components(links, "u", "v"), "parts")
    slim = sets.drop("grams")

    whole = bucket.select("band", "x").join(some_left.hint("merge"), "band", "left_semi").join(parts.hint("merge"), F.col("x") == F.col("node"), "left")
    whole = scratch.materialize(whole.select("band", "x", F.coalesce("component", "x").alias("component")), "whole")
    sizes = whole.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("band").agg(F.max(F.struct("n", "component"))["component"].alias("largest"), F.count(F.lit(1)).alias("several")).where("several > 1")
    whole = scratch.materialize(whole.join(largest.hint("merge"), "band"), "whole").join(slim, "x")
    a, b = whole.where("component <> largest").alias("a"), whole.alias("b")
    meet = a.join(b.hint("merge"), (F.col("a.band") == F.col("b.band")) & (F.col("a.component") != F.col("b.component")) & _may_link("a", "b"))
    pairs = meet.select(F.least("a.x", "b.x").alias("u"), F.greatest("a.x", "b.x").alias("v")).distinct()
    return signed, reps, links.unionByName(_confirmed(scratch.materialize(pairs, "pairs"), sets))


def _mixed(signed: DataFrame) -> DataFrame:
    """``(doc_id, d1, d2, n_shingles)``: for documents with rows of several sets, the least of these."""
    key = F.struct("d1", "d2", "n_shingles")
    each = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(key).alias("a"), F.max(key).alias("b"))
    return each.where("a <> b").select("doc_id", "a.d1", "a.d2", "a.n_shingles")


def _several(signed: DataFrame) -> bool:
    return not _mixed(signed).isEmpty()


def _bridges(signed: DataFrame, reps: DataFrame) -> DataFrame:
    """Links between the classes that rows of one ``doc_id`` are in."""
    key = ["d1", "d2", "n_shingles"]
    mixed = scratch.materialize(_mixed(signed), "mixed")
    first = mixed.join(reps.hint("merge"), key).select("doc_id", F.col("x").alias("u"))
    rest = signed.select("doc_id", *key).join(mixed.select("doc_id").hint("merge"), "doc_id", "left_semi").distinct().join(reps.hint("merge"), key).select("doc_id", F.col("x").alias("v"))
    return first.join(rest, "doc_id").where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs``."""
    signed, reps, links = near_duplicate_links(docs)
    if _several(signed):
        links = links.unionByName(_bridges(signed, reps))
    parts = scratch.materialize(connected_components(links, "u", "v"), "parts")
    classes = reps.join(parts.hint("merge"), F.col("x") == F.col("node"), "left").withColumn("component", F.coalesce("component", "x"))
    classes = scratch.materialize(classes.select("d1", "d2", "n_shingles", "rep", "component"), "classes")
    least = classes.groupBy("component").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    labels = classes.join(least.select("component", "least").hint("merge"), "component", "left").select("d1", "d2", "n_shingles", F.coalesce("least", "rep").alias("label"))
    labels = scratch.materialize(labels, "labels")
    out = signed.select("doc_id", "n_shingles", "d1", "d2").join(labels.hint("merge"), ["d1", "d2", "n_shingles"], "left")
    # Without shingles or id a row stands alone.
    label = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("label")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", label.alias("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op2_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
