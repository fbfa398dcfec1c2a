"""Language identification: script ranges, per-word scores, and Viterbi over the words of a text.

Training counts hashed character trigrams (word ends included) per language over all
training texts; the model is one log-probability per language and bucket, so its size
is bounded by languages times ``BUCKETS`` whatever the corpus.  A word is a maximal run
of letters.  Its script (by ranges of code points) leaves only the languages whose
training letters use that script; among these its score is the sum of its trigrams' log
probabilities.  Viterbi with ``SWITCH`` as the price of changing language labels each
word, and runs of equal labels are the spans.  All texts of a slice take each
Viterbi step together, so the steps are numpy calls and not Python loops over words.

The prediction of a text is the language of most letters (ties: the first by name)
and the score the share of its letters that have this label.

Defined results: null text, or text without a letter, is ``und`` with score 0; null
``lang`` or null text trains nothing; with nothing learned all is ``und``; repeated rows count
and are labelled each; an empty table gives an empty table; ``lang``, ``source`` and
``doc_id`` are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph import scratch
from tidegraph.llm import _text
from tidegraph.llm.decontaminate import lower_table

BUCKETS = 1 << 15
SWITCH = 8.0
SMOOTH = 0.5
SHARE = 0.005
#: Languages one model learns at most, the commonest by their letters; their names are the only part of it that the data set.
MAX_LANGS = 1000
#: First code points of script ranges, and the scripts' numbers (0: other).  Fixed values.
RANGES = [
    (0x0000, 1), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 0), (0x0750, 6), (0x0780, 0), (0x08A0, 6),
    (0x0900, 7), (0x0980, 8), (0x0A00, 9), (0x0A80, 10), (0x0B00, 11), (0x0B80, 12), (0x0C00, 13), (0x0C80, 14), (0x0D00, 15), (0x0D80, 16),
    (0x0E00, 17), (0x0E80, 18), (0x0F00, 19), (0x1000, 20), (0x10A0, 21), (0x1100, 22), (0x1200, 23), (0x13A0, 0), (0x1780, 24), (0x1800, 0),
    (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x2C60, 1), (0x2C80, 0), (0x2DE0, 3), (0x2E00, 0), (0x2E80, 25), (0x3040, 26), (0x3100, 25),
    (0x3130, 22), (0x3190, 25), (0xA640, 3), (0xA6A0, 0), (0xA720, 1), (0xA800, 0), (0xAC00, 22), (0xD7B0, 0), (0xF900, 25), (0xFB00, 1),
    (0xFB13, 4), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0), (0xFE70, 6), (0xFF00, 1), (0xFF66, 26), (0xFFA0, 22), (0xFFE0, 0), (0x20000, 25),
]
SCRIPTS = 27
_STARTS = np.array([a for a, _ in RANGES], np.uint32)
_NUMBER = np.array([b for _, b in RANGES], np.int64)
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.zeros(0x110000, bool)
        _letters[:0x32000] = [chr(i).isalpha() for i in range(0x32000)]
    return _letters


def grams_of(points: np.ndarray, at: np.ndarray):
    """``(bucket of each letter, its word, first letter of each word, words' scripts, words' offsets by row)``."""
    low = lower_table()[points]
    inside = letter_table()[points]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = at[:-1][at[:-1] < len(low)]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = at[1:][at[1:] > 0] - 1
    last[edge] = inside[edge]
    where = np.flatnonzero(inside)
    before, after = low[np.maximum(where - 1, 0)], low[np.minimum(where + 1, len(low) - 1)]
    before[first[where]], after[last[where]] = 0, 0
    key = (before.astype(np.uint64) << np.uint64(42)) | (low[where].astype(np.uint64) << np.uint64(21)) | after
    bucket = ((_text.mix(key) >> np.uint64(48)) % np.uint64(BUCKETS)).astype(np.int32)
    starts = np.flatnonzero(first)
    begin = np.searchsorted(where, starts)
    script = _NUMBER[np.searchsorted(_STARTS, points[starts], "right") - 1]
    return bucket, begin, script, np.searchsorted(starts, at)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of one partition: (lang, bucket, n); buckets from BUCKETS on count letters by script."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in _text.slices(batch, limit=1 << 19):
            langs = part.column(1).to_pylist()
            points, at = _text.code_points(*_text.text_bytes(part.column(0)))
            bucket, begin, script, first = grams_of(points, at)
            ends = np.append(begin, len(bucket))
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs], np.int64)
            word_lang = np.repeat(number, np.diff(first))
            size = np.diff(ends)
            grams = np.bincount(np.repeat(word_lang, size) * BUCKETS + bucket.astype(np.int64), minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
            scripts = np.bincount(word_lang * SCRIPTS + script, weights=size, minlength=len(names) * SCRIPTS).reshape(len(names), SCRIPTS)
            for i, name in enumerate(names):
                both = np.concatenate([grams[i], scripts[i].astype(np.int64)])
                total[name] = total[name] + both if name in total else both
    for name, n in sorted(total.items()):
        filled = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(filled), pa.string()), pa.array(filled), pa.array(n[filled])], ["lang", "bucket", "n"])


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        grams, scripts = counts[:, :BUCKETS].astype(np.float64) + SMOOTH, counts[:, BUCKETS:].astype(np.float64)
        self.logp = np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32)
        allowed = scripts >= SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        allowed[:, ~allowed.any(axis=0)] = True
        self.closed = np.where(allowed, 0, -1e6).astype(np.float32)

    def words(self, points: np.ndarray, at: np.ndarray):
        """``(scores by word and language, letters by word, words' offsets by row)``."""
        bucket, begin, script, first = grams_of(points, at)
        score = np.zeros((len(begin), len(self.langs)), np.float32)
        if len(begin):
            for i in range(len(self.langs)):
                score[:, i] = np.add.reduceat(self.logp[i][bucket], begin) + self.closed[i][script]
        return score, np.diff(np.append(begin, len(bucket))), first


def viterbi(score: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of every word, row by row of the table, all rows in step."""
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    start, count = first[:-1][order], count[order]
    label = np.zeros(len(score), np.int64)
    if not len(score) or score.shape[1] == 1:
        return label
    came = np.zeros(score.shape, np.uint16)
    own = np.arange(score.shape[1], dtype=np.uint16)
    steps = int(count[0])
    active = np.searchsorted(-count, -np.arange(steps), "left")  # rows with more than t words
    best = score[start[: active[0]]].copy()
    final = np.zeros(len(count), np.int64)
    for t in range(1, steps):
        n = active[t]
        if n < len(best):
            final[n : len(best)] = best[n:].argmax(axis=1)
            best = best[:n]
        top = best.argmax(axis=1)
        jump = best[np.arange(n), top][:, None] - switch
        place = start[:n] + t
        stay = best >= jump
        came[place] = np.where(stay, own, top[:, None])
        best = np.where(stay, best, jump) + score[place]
    final[: len(best)] = best.argmax(axis=1)
    at = final
    for t in range(steps - 1, -1, -1):
        n = active[t]
        place = start[:n] + t
        label[place] = at[:n]
        if t:
            at[:n] = came[place, at[:n]]
    return label


def train(docs: DataFrame) -> Model | None:
    """A model from all rows of ``docs`` with ``text`` and ``lang``."""
    scratch.ship_package(docs.sparkSession)
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    sums = rows.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums = scratch.materialize(sums, "grams")
    # A dirty column may hold any number of names: the commonest are learned.
    common = sums.groupBy("lang").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "lang").limit(MAX_LANGS).select("lang")
    common = scratch.materialize(common, "langs")
    langs = sorted(r["lang"] for r in common.collect())
    if not langs:
        return None
    counts = np.zeros((len(langs), BUCKETS + SCRIPTS), np.int64)
    # MAX_LANGS names at most: a bounded side to broadcast, and MAX_LANGS x (BUCKETS + SCRIPTS) numbers at most.
    table = sums.join(F.broadcast(common), "lang").toArrow()
    number = pc.index_in(table.column("lang"), value_set=pa.array(langs, table.column("lang").type)).to_numpy()
    counts[number, table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return Model(langs, counts)


def _each(docs: DataFrame, model: Model | None, make, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, limit=1 << 20):
                yield make(part, shared.value)

    return docs.mapInArrow(run, schema)


def _predict(part: pa.RecordBatch, model: Model | None) -> pa.RecordBatch:
    n = part.num_rows
    pred, score = np.array(["und"] * n, object), np.zeros(n)
    if model:
        points, at = _text.code_points(*_text.text_bytes(part.column(1)))
        words, letters, first = model.words(points, at)
        label = viterbi(words, first)
        kinds = len(model.langs)
        row = np.repeat(np.arange(n), np.diff(first))
        share = np.bincount(row * kinds + label, weights=letters, minlength=n * kinds).reshape(n, kinds)
        some = share.sum(axis=1) > 0
        top = share.argmax(axis=1)
        pred[some] = np.array(model.langs, object)[top[some]]
        score[some] = share[some, top[some]] / share[some].sum(axis=1)
    return pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])


def _spans(part: pa.RecordBatch, model: Model | None) -> pa.RecordBatch:
    out: list[list[dict]] = [[] for _ in range(part.num_rows)]
    if model:
        points, at = _text.code_points(*_text.text_bytes(part.column(1)))
        words, _, first = model.words(points, at)
        label = viterbi(words, first)
        for i in range(part.num_rows):
            own = label[first[i] : first[i + 1]]
            if not len(own):
                continue
            cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            out[i] = [{"first_word": int(a), "words": int(b - a), "lang": model.langs[own[a]]} for a, b in zip(cut, [*cut[1:], len(own)], strict=True)]
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))
    return pa.RecordBatch.from_arrays([part.column(0), pa.array(out, kind)], ["doc_id", "spans"])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, lang_pred, score)`` for each row."""
    return _each(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, _predict, "doc_id long, lang_pred string, score double")


def spans(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, spans)``: runs of words of one language, in order."""
    schema = "doc_id long, spans array<struct<first_word: long, words: long, lang: string>>"
    return _each(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, _spans, schema)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    part = F.crc32(F.col("doc_id").cast("string")) % 3
    model = train(docs.where(part != 1))
    return predict(docs, model).withColumn("held_out", F.coalesce(part == 1, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score")
