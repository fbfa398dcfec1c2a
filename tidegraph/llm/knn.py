"""Quality classifier: votes of the nearest labelled texts in a latent-semantic space.

A text has two views of equal weight, each of length one.  The first is its hashed character trigrams (case
kept, white space as one mark).  The second tells how its words come back: for each word the distance to the same
word before it in the text (A-Z in either case), counted by powers of two, in per cent of its words; words that
were not there before count for its length only, so that texts without returns are not alike for that.  Counts are log-scaled and weighted by
the document frequencies of all texts.  The space is spanned by the
leading singular vectors of at most ``SAMPLE`` labelled texts (a documented bound: those
of smallest hash of their id).  Their vectors, at most ``SAMPLE`` x ``RANK`` floats, are
broadcast; every text is projected and its cosines with all of them are computed in
exact blocks; the ``NEIGHBOURS`` nearest, and all that tie with the last of them, vote with their similarity as weight.

Defined results: a text without trigrams (null, empty, one or two characters) or with no
positive similarity gets the share of label 1 in the sample; so do all with no labels
(share 0.5); null labels are not learned; of several labels of a document the largest
counts; a labelled document with several rows is learned by the least of its texts; repeated rows are scored each; an empty table
gives an empty table; other columns are not read, whatever they are called; a very long text is held whole by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph import scratch
from tidegraph.llm import _text

BUCKETS = 8192
#: The last buckets: words that were not there before, and distances of 1, 2-3, 4-7 ... 2**14 and more words.
RETURNS = 16
GRAMS = BUCKETS - RETURNS
SAMPLE = 4096
RANK = 64
NEIGHBOURS = 25
CUT = 0.3


def _returns(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each row the per cent of its words by their distance to the same word before, in ``RETURNS`` classes."""
    low = _text.LOWER[data]
    starts, ends, first = _text.words(low, at)
    hashes = _text.word_hashes(low, starts, ends)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    order = np.lexsort((hashes, row))  # stable: equal words of a row in their order
    back = (hashes[order][1:] == hashes[order][:-1]) & (row[order][1:] == row[order][:-1])
    kind = np.zeros(len(order), np.int64)
    kind[1:][back] = np.minimum(np.frexp(np.diff(order)[back].astype(float))[1], RETURNS - 1)
    found = np.bincount(row[order] * RETURNS + kind, minlength=(len(at) - 1) * RETURNS).reshape(-1, RETURNS)
    return 100 * found // np.maximum(np.diff(first), 1)[:, None]


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, bucket, count)`` of the byte trigrams of each row, and of its words' returns in the last ``RETURNS`` buckets."""
    if len(data) < 3:
        none = np.zeros(0, np.int64)
        return none, none, none
    x = np.where(_text.SPACE[data], 32, data).astype(np.uint32)
    key = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    key = ((key * np.uint32(0x9E3779B1)) >> np.uint32(19)) % np.uint32(GRAMS)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[:-2]
    inside = np.arange(len(key)) + 3 <= at[1:][row]
    flat = row[inside] * BUCKETS + key[inside].astype(np.int64)
    count = np.bincount(flat, minlength=(len(at) - 1) * BUCKETS)
    views = count.reshape(len(at) - 1, BUCKETS)
    views[:, GRAMS:] = np.where(np.diff(at)[:, None] >= 3, _returns(data, at), 0)
    filled = np.flatnonzero(count)
    return filled // BUCKETS, filled % BUCKETS, count[filled]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS + 1, np.int64)
    for batch in batches:
        for part in _text.slices(batch, limit=1 << 19):
            _, bucket, _ = features(*_text.text_bytes(part.column(0)))
            total[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
            total[BUCKETS] += part.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(total)], ["bucket", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _text.slices(batch, limit=1 << 19):
            row, bucket, count = features(*_text.text_bytes(part.column(0)))
            at = np.searchsorted(row, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), _text.list_array(bucket.astype(np.int32), at), _text.list_array(count.astype(np.int32), at)], ["h", "label", "bucket", "n"])


class Model:
    def __init__(self, frequency: np.ndarray, labels: np.ndarray, rows: np.ndarray, buckets: np.ndarray, counts: np.ndarray):
        self.idf = np.log((1 + frequency[BUCKETS]) / (1 + frequency[:BUCKETS])).astype(np.float32) + np.float32(1)
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.vectors = np.zeros((0, 1), np.float32)
        if not len(labels):
            return
        x = np.zeros((len(labels), BUCKETS), np.float32)
        x[rows, buckets] = self._weight(buckets, counts)
        self._level(x)
        rank = min(RANK, len(labels))
        span = np.linalg.qr(x @ np.random.default_rng(17).standard_normal((BUCKETS, min(rank + 16, len(labels))), dtype=np.float32))[0]
        for _ in range(3):
            span = np.linalg.qr(x @ (x.T @ span))[0]
        self.basis = np.ascontiguousarray(np.linalg.svd(span.T @ x, full_matrices=False)[2][:rank].T)
        self.vectors = self._unit(x @ self.basis)

    def _weight(self, bucket: np.ndarray, count: np.ndarray) -> np.ndarray:
        return (1 + np.log(count.astype(np.float32))) * self.idf[bucket]

    def _level(self, x: np.ndarray) -> None:
        """Bring both views of each row to length one, then leave out the words that were not there before."""
        for view in (x[:, :GRAMS], x[:, GRAMS:]):
            view /= np.maximum(np.linalg.norm(view, axis=1, keepdims=True), 1e-9)
        x[:, GRAMS] = 0

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def scores(self, n: int, row: np.ndarray, bucket: np.ndarray, count: np.ndarray) -> np.ndarray:
        out = np.full(n, self.prior)
        if not len(self.vectors) or not len(row):
            return out
        w = self._weight(bucket, count)
        for a in range(0, n, 256):
            lo, hi = np.searchsorted(row, [a, min(n, a + 256)])
            x = np.zeros((min(n, a + 256) - a, BUCKETS), np.float32)
            x[row[lo:hi] - a, bucket[lo:hi]] = w[lo:hi]
            self._level(x)
            cosine = self._unit(x @ self.basis) @ self.vectors.T
            k = min(NEIGHBOURS, cosine.shape[1])
            last = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k, None]
            weight = np.where(cosine >= last, np.maximum(cosine, 0), 0)
            total = weight.sum(axis=1)
            some = total > 1e-6
            out[a : a + len(x)][some] = (weight @ self.labels)[some] / total[some]
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` rows of ``labels`` (``doc_id``, ``quality``) that have a text in ``docs``."""
    scratch.ship_package(docs.sparkSession)
    counted = docs.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(BUCKETS + 1, np.int64)
    frequency[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    one = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    # `sample` ids at most: a bounded side to broadcast.
    few = one.withColumn("h", F.xxhash64(F.lit("sample"), F.col("doc_id"))).orderBy("h", "doc_id").limit(sample)
    # One row to a document, so that what reaches the driver is bounded too.
    texts = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("h", "label").agg(F.min("text").alias("text"))
    chosen = texts.select("text", "h", "label").mapInArrow(_sparse, "h long, label int, bucket array<int>, n array<int>")
    table = chosen.toArrow().combine_chunks().sort_by("h").slice(0, sample)
    if not table.num_rows:
        return Model(frequency, np.zeros(0), *[np.zeros(0, np.int64)] * 3)
    bucket, n = table.column("bucket").combine_chunks(), table.column("n").combine_chunks()
    rows = np.repeat(np.arange(table.num_rows), np.diff(np.asarray(bucket.offsets)))
    return Model(frequency, table.column("label").to_numpy(), rows, bucket.flatten().to_numpy(), n.flatten().to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, predicted)`` for each row."""
    scratch.ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, limit=1 << 19):
                s = shared.value.scores(part.num_rows, *features(*_text.text_bytes(part.column(1))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s.astype(np.float64)), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    part = F.crc32(F.col("doc_id").cast("string")) % 5
    model = fit(docs, labels.where(part != 0))
    return score(docs, model).withColumn("held_out", F.coalesce(part == 0, F.lit(False))).select("doc_id", "held_out", "score", "predicted")
