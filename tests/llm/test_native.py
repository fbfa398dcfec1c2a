"""Quality rules and line dedup against plain Python; plans without Python."""

import hashlib
import re
from collections import Counter

from tidegraph.llm import line_dedup, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_words string, batch int, gone int"
TEXTS = [None, "", " \n ", "one two three four five six seven eight nine ten", "a b c d e f a b c d e a b c d e\nx", "Same Line Here\nother text 1", "  same line here\t\nSAME LINE HERE\nuniqüe ÄÖ line", "short\nshort", "same line here\n\n", "äÖ long line number two\nx y", "ÄÖ long line number two", "äÖ LONG line number two\n|#|# % & <b> z"]


def frame(spark, texts=TEXTS):
    rows = [(i if i != 7 else None, t, "en" if i % 2 else None, "s", "x", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5]], SCHEMA)


def test_counts(spark):
    for r in quality.judged(frame(spark)).collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for k in range(5)}
        full = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)


def test_thresholds_adapt(spark):
    clean = "word another thing with several letters making up this line nicely today"
    rows = [(i, f"{clean} n{i}", "en", "s", "x", 1, 2) for i in range(40)] + [(99, "## ".join(clean.split()) + " ##", "en", "s", "x", 1, 2)]
    got = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not got.pop(99) and all(got.values())
    assert quality.judged(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_lines(rows):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    owner = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            d2 = 1 << 63 if d is None else d
            owner[low(line)] = min(owner.get(low(line), d2), d2)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(low(x)) < 10 or owner[low(x)] == (1 << 63 if d is None else d)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines(spark):
    df = frame(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    for batches in (1, 3, 8):
        got = line_dedup.dedup_lines(df, batches).selectExpr("doc_id", "n_lines", "n_dropped", "sha2(text, 256) AS s").collect()
        assert sorted((tuple(r) for r in got), key=str) == brute_lines(rows)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_plans_are_native(spark):
    for df in (quality.op4_quality_rules(spark, "/root/testdata/sf0.001"), line_dedup.op9_line_dedup(spark, "/root/testdata/sf0.001")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
