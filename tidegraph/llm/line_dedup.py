"""Line dedup: levelled sorted runs of line hashes, merge-anti-joined batch by batch.

The documents are taken in batches of rising ``doc_id``.  A batch reduces its lines
to one row per key (the smallest holder), anti-joins the runs written so far by sort
merge, and writes what is new as a run of its own, sorted by hash.  When a level
has ``FANOUT`` runs they are compacted to one run of the next level, so the number
of runs grows with the logarithm of the number of batches.  Since batches rise,
the holder noted in a run is the smallest ``doc_id`` of all, and a last merge join
of the lines with the runs marks what goes.

Everything is built from DataFrame functions; no Python runs on the executors.

Defined results: null text is one empty line; an empty table gives an empty table;
rows that repeat a ``doc_id`` are one document (each row keeps the lines that the
document holds first); a null ``doc_id`` counts as one document after all others.
Columns beside ``doc_id`` and ``text`` are not read, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph import scratch

BATCHES = 8
FANOUT = 4
MIN_CHARS = 10
#: 0x20 and 0x09-0x0D.
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LAST = (1 << 63) - 1


def line_key(line: Column) -> Column:
    """The line without blanks at both ends and with A-Z lower-cased."""
    key = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(key) == F.char_length(key), F.lower(key)).otherwise(F.translate(key, _UPPER, _LOWER))


def _lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_doc"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("_row"),
        F.col("text").alias("_text"),
    )


def _batch_bounds(docs: DataFrame, batches: int) -> list[int]:
    """Inner bounds of ``doc_id`` ranges of about equal size."""
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"]
    return sorted({int(c) for c in cuts or []})


def _sorted_run(df: DataFrame, name: str) -> DataFrame:
    return scratch.materialize(df.sortWithinPartitions("h1", "h2"), name)


def first_holders(lines: DataFrame, batches: int, fanout: int = FANOUT) -> DataFrame:
    """``(h1, h2, owner)``: each key once, with the smallest document holding it."""
    levels: list[list[DataFrame]] = [[]]
    for b in range(batches):
        new = lines.where(F.col("batch") == b).groupBy("h1", "h2").agg(F.min("_doc").alias("owner"))
        for run in (run for level in levels for run in level):
            new = new.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        levels[0].append(_sorted_run(new, "run0"))
        k = 0
        while len(levels[k]) >= fanout:
            merged = levels[k][0]
            for run in levels[k][1:]:
                merged = merged.unionByName(run)
            if k + 1 == len(levels):
                levels.append([])
            levels[k + 1].append(_sorted_run(merged.repartition("h1", "h2"), f"run{k + 1}"))
            for run in levels[k]:
                scratch.drop(run)
            levels[k] = []
            k += 1
    runs = [run for level in levels for run in level]
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out


def dropped_lines(docs: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(_doc, _row, _gone)``: for each row that loses lines, their 0-based places."""
    bounds = _batch_bounds(docs, batches)
    batch = F.lit(0)
    for c in bounds:
        batch = batch + F.when(F.col("_doc") > c, 1).otherwise(0)
    lines = (
        _rows(docs)
        .select("_doc", "_row", F.posexplode(_lines_of(F.col("_text"))).alias("place", "line"))
        .select("_doc", "_row", "place", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("_doc", "_row", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), batch.alias("batch"))
    )
    lines = scratch.materialize(lines, "lines", partition_by="batch")
    owners = first_holders(lines, len(bounds) + 1)
    lost = lines.join(owners.hint("merge"), ["h1", "h2"]).where("owner < _doc")
    return lost.groupBy("_doc", "_row").agg(F.collect_set("place").alias("_gone"))


def dedup_lines(docs: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS, counts: bool = True) -> DataFrame:
    """The rows of ``docs`` with ``text`` less its repeated lines, ``n_lines`` and ``n_dropped``.

    A line of at least ``min_chars`` code points (blanks at its ends aside, A-Z in
    either case) that several documents hold stays only in the one of smallest
    ``doc_id``.  Columns called ``n_lines`` or ``n_dropped`` are replaced, unless ``counts``
    is false: then neither is added.
    """
    gone = dropped_lines(docs, batches, min_chars)
    keys = _rows(docs).columns[:2]
    rest = [c for c in docs.columns if c != "text"]  # whatever they are called, they go through as they are
    own = docs.select(
        "text", F.struct(*rest).alias("_rest"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias(keys[0]), F.xxhash64(F.coalesce("text", F.lit(""))).alias(keys[1])
    )
    lines = _lines_of(F.col("text"))
    n = F.size(lines)
    lost = F.coalesce(F.size("_gone"), F.lit(0))
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(F.col("_lines"), i)), "\n")
    )
    joined = own.join(gone, keys, "left").withColumn("_lines", F.when(F.col("_gone").isNotNull(), lines))
    added = [n.cast("long").alias("n_lines"), lost.cast("long").alias("n_dropped")] if counts else []
    names = ("n_lines", "n_dropped") if counts else ()
    return joined.select(*[text.alias(c) if c == "text" else F.col("_rest")[c].alias(c) for c in docs.columns if c not in names], *added)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, n, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS n
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
firsts AS (SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10 GROUP BY key),
marked AS (SELECT l.doc_id, l.n, l.line, coalesce(f.owner < l.doc_id, false) AS gone
           FROM lines l LEFT JOIN firsts f ON l.key = f.key AND length(l.key) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
