"""Quality rules: thresholds learned per language and source from mergeable quantile sketches.

Three measures of a text are turned into integers.  Each (language, source, measure)
has a log-linear histogram as its quantile sketch: a value keeps its ``BITS`` leading
binary digits, so any quantile is known within one part in 2**(BITS-1), the sketch
has a few hundred bins at most, and two sketches merge by adding counts.  That sum is
an ordinary partial aggregation, so a hot source is combined before it is shuffled.
A document goes if a measure lies outside ``quartile +- FENCE * interquartile range``,
widened by the measure's slack.  Only texts that pass the base rules feed the sketches.

DataFrame functions only; no Python on the executors.

Defined results: null or empty text has no words and fails the base rules; null
``lang`` or ``source`` is a group of its own; an empty table gives an empty table;
repeated rows are judged each; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph import scratch

BITS = 7
FENCE = 4
MIN_WORDS = 10
#: measure: (expression over the counts, slack below or None, slack above)
MEASURES = {
    "word_len": ("100 * word_chars DIV n_words", 150, 150),
    "symbols": ("1000 * n_symbols DIV n_words", None, 100),
    "dup_lines": ("1000 * n_dup_lines DIV n_full_lines", None, 300),
}
_BLANK = " \t\n\x0b\x0c\r"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words that lie in 5-word windows found twice or more.

    Windows are compared by 64-bit hash within one text.  Sorting (hash, place) puts
    equal windows side by side; the places of windows that have an equal neighbour,
    sorted, cover five words each, less what the next one covers.
    """

    def repeated(pairs: Column) -> Column:
        n = F.size(pairs)
        same = lambda a, i: F.coalesce(F.get(pairs, i)["h"] == a["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(pairs, lambda p, i: same(p, i + 1) | ((i > 0) & same(p, F.greatest(i - 1, F.lit(0))))), lambda p: p["i"]))

    def covered(places: Column) -> Column:
        step = F.transform(places, lambda p, i: F.coalesce(F.least(F.get(places, i + 1) - p, F.lit(5)), F.lit(5)))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    windows = lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.struct(F.xxhash64(F.slice(w, i + 1, F.lit(5))).alias("h"), i.alias("i"))
    )
    found = _let(words, lambda w: F.when(F.size(w) >= 6, _let(F.sort_array(windows(w)), lambda p: _let(repeated(p), covered))).otherwise(F.lit(0)))
    return found


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts, ``n_full_lines`` and ``base_failed``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    full = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(_BLANK)) != "")
    sizes = lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("r"))
    lines = lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d"))
    chars = F.char_length(text)
    out = (
        docs.withColumn("_w", _let(words, sizes))
        .withColumn("_l", _let(full, lines))
        .withColumn("n_words", F.col("_w.n"))
        .withColumn("word_chars", F.char_length(F.translate(text, _BLANK, "")).cast("long"))
        .withColumn("n_symbols", (chars - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long"))
        .withColumn("n_full_lines", F.col("_l.n"))
        .withColumn("n_dup_lines", F.col("_l.n") - F.col("_l.d"))
        .withColumn("n_repeat_words", F.col("_w.r"))
        .drop("_w", "_l")
    )
    return out.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words"))


def _values() -> Column:
    return F.array(*[F.struct(F.lit(k).alias("m"), F.expr(e).cast("long").alias("v")) for k, (e, _, _) in MEASURES.items()])


def sketches(counted: DataFrame) -> DataFrame:
    """``(lang, source, m, bin, n)``: the quantile sketches, one row per filled bin; mergeable by ``sum(n)``."""
    long = counted.where("NOT base_failed").select("lang", "source", F.explode(_values()).alias("x")).select("lang", "source", "x.m", "x.v")
    shift = f"greatest(length(bin(v)) - {BITS}, 0)"
    return long.withColumn("bin", F.expr(f"shiftleft(shiftright(v, {shift}), {shift})")).groupBy("lang", "source", "m", "bin").agg(F.count(F.lit(1)).alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """``(lang, source, <measure>_lo, <measure>_hi)``: the fences of each group."""
    group = ["lang", "source", "m"]
    total = sketch.groupBy(*group).agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"))
    step = lambda a, x: F.struct(
        (a["c"] + x["n"]).alias("c"),
        F.when(a["q1"].isNull() & ((a["c"] + x["n"]) * 4 >= F.col("total")), x["bin"]).otherwise(a["q1"]).alias("q1"),
        F.when(a["q3"].isNull() & ((a["c"] + x["n"]) * 4 >= F.col("total") * 3), x["bin"]).otherwise(a["q3"]).alias("q3"),
    )
    start = F.struct(F.lit(0).cast("long").alias("c"), F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q3"))
    q = total.withColumn("q", F.aggregate("bins", start, step))
    out = []
    for m, (_, low, high) in MEASURES.items():
        q1, q3 = F.max(F.when(F.col("m") == m, F.col("q.q1"))), F.max(F.when(F.col("m") == m, F.col("q.q3")))
        if low is not None:
            out.append((q1 - FENCE * (q3 - q1) - low).alias(f"{m}_lo"))
        out.append((q3 + FENCE * (q3 - q1) + high).alias(f"{m}_hi"))
    return q.groupBy("lang", "source").agg(*out)


def judged_counts(counted: DataFrame) -> DataFrame:
    """``counted`` (a materialized result of :func:`with_counts`) with ``kept``."""
    limits = scratch.materialize(thresholds(sketches(counted)), "limits")
    names = [c for c in limits.columns if c not in ("lang", "source")]
    null = F.lit("\0")
    limits = limits.select(F.coalesce("lang", null).alias("_lang"), F.coalesce("source", null).alias("_source"), *[F.col(c).alias(f"_{c}") for c in names])
    own = counted.withColumn("_lang", F.coalesce("lang", null)).withColumn("_source", F.coalesce("source", null))
    fine = ~F.col("base_failed")
    for m, (e, low, _) in MEASURES.items():
        v = F.expr(e.replace("DIV n_words", "DIV nullif(n_words, 0)").replace("DIV n_full_lines", "DIV nullif(n_full_lines, 0)"))
        fine = fine & (v <= F.col(f"_{m}_hi"))
        if low is not None:
            fine = fine & (v >= F.col(f"_{m}_lo"))
    # The limits were written before this join is planned: they are broadcast only
    # if their size in bytes is under Spark's threshold, else both sides shuffle and
    # adaptive execution splits a hot group.
    joined = own.join(limits, ["_lang", "_source"], "left")
    return joined.withColumn("kept", F.coalesce(fine, F.lit(False))).drop("_lang", "_source", "n_full_lines", *[f"_{c}" for c in names])


def judged(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts, ``base_failed`` and ``kept``.

    Needs ``text``, ``lang`` and ``source``; columns named like those added are replaced.
    """
    used = ("text", "lang", "source")
    rest = [c for c in docs.columns if c not in used]  # whatever they are called, they go through as they are
    own = docs.select(*used, F.struct(*rest).alias("_rest")) if rest else docs.select(*used)
    out = judged_counts(scratch.materialize(with_counts(own), "counted"))
    added = [c for c in out.columns if c not in (*used, "_rest")]
    return out.select(*[F.col(c) if c in used else F.col("_rest")[c].alias(c) for c in docs.columns if c not in added], *added)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    slim = scratch.materialize(with_counts(docs).drop("text"), "counted")
    return judged_counts(slim).select("doc_id", *_COUNTS, "base_failed", "kept")


def _sql() -> str:
    sql = lambda e: e.replace(" DIV ", " // ")
    values = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{m}' AS m, {sql(e)} AS v FROM good" for m, (e, _, _) in MEASURES.items())
    fences = ", ".join(
        f"max(CASE WHEN m = '{m}' THEN q3 + {FENCE} * (q3 - q1) + {high} END) AS {m}_hi"
        + (f", max(CASE WHEN m = '{m}' THEN q1 - {FENCE} * (q3 - q1) - {low} END) AS {m}_lo" if low is not None else "")
        for m, (_, low, high) in MEASURES.items()
    )
    fine = " AND ".join(
        f"({sql(e).replace('// ', '// nullif(')}, 0)) <= {m}_hi" + (f" AND ({sql(e).replace('// ', '// nullif(')}, 0)) >= {m}_lo" if low is not None else "")
        for m, (e, low, _) in MEASURES.items()
    )
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
win AS (SELECT doc_id, i, w[i:i+4] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 6)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS r FROM rep, range(0, 5) o(k) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n, count(DISTINCT l) AS u FROM
         (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, lang, source, len(w.w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
         coalesce(ln.n, 0)::BIGINT AS n_full_lines, coalesce(ln.n - ln.u, 0)::BIGINT AS n_dup_lines,
         coalesce(cov.r, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (doc_id) LEFT JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)),
based AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted),
good AS (SELECT * FROM based WHERE NOT base_failed),
v AS ({values}),
s AS (SELECT lang, source, m, (v >> greatest(length(bin(v)) - {BITS}, 0)::INT) << greatest(length(bin(v)) - {BITS}, 0)::INT AS bin, count(*) AS n
      FROM v GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, m ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY lang, source, m) AS total FROM s),
q AS (SELECT lang, source, m, min(CASE WHEN cum * 4 >= total THEN bin END) AS q1, min(CASE WHEN cum * 4 >= 3 * total THEN bin END) AS q3
      FROM c GROUP BY ALL),
lim AS (SELECT lang, source, {fences} FROM q GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(NOT base_failed AND {fine}, false) AS kept
FROM based LEFT JOIN lim ON based.lang IS NOT DISTINCT FROM lim.lang AND based.source IS NOT DISTINCT FROM lim.source
"""


OP4_SQL = _sql()
