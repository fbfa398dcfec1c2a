"""The pipeline against the same stages in plain Python and SQL."""

import re

import duckdb
import sentencepiece

import corpus_pipeline
from tidegraph.llm import pieces, quality

from test_minhash import brute as components
from test_native import brute_lines  # noqa: F401  (same folder)

DIR = "/root/testdata/sf0.001"


def lines_left(rows):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    owner = {}
    for d, t in sorted(rows):
        for line in t.split("\n"):
            owner.setdefault(low(line), d)
    return [(d, "\n".join(x for x in t.split("\n") if len(low(x)) < 10 or owner[low(x)] == d)) for d, t in rows]


def test_all_stages(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    kept = {r[0] for r in con.sql(f"SELECT doc_id FROM ({quality.OP4_SQL}) WHERE kept").fetchall()}
    rows = [r for r in con.sql("SELECT doc_id, text FROM documents").fetchall() if r[0] in kept]
    rows = lines_left(rows)
    group = components(rows)
    rows = [(d, t) for d, t in rows if group[d][1] == d]
    norm = lambda s: re.sub(r"\s+", " ", s).strip().lower()
    items = [norm(r[0]) for r in con.sql("SELECT text FROM benchmark").fetchall()]
    rows = [(d, t) for d, t in rows if not any(i in norm(t) for i in items)]
    ref = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = {d: ref.encode(t) for d, t in rows}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, DIR).collect()}
    assert got == want and len(kept) < 200


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_dedup", "decontamination", "sentencepiece"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DIR).schema.simpleString() == docs.schema.simpleString()


def test_stages_with_clashing_columns_repeats_and_a_long_text(spark):
    """Columns named like those the operators use go through every stage as they are; so do nulls and an empty table."""
    names = "_gone _doc _row _lines _rest _text _w _l _leaked h1 h2 owner place key batch x u v d1 kept base_failed n_lines n_words rep node component t r".split()
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(60)
    long = "".join(f"Sentence number {i} of a text that goes on with words like {i * 7919 % 1013} and {i * 31 % 977}.\n" for i in range(16_000))
    row = docs.first()
    more = [(10**9, long, "en", "a", 1), (10**9, long, "en", "a", 1), (10**9 + 1, None, None, None, None), (None, "", None, None, None), (row.doc_id, row.text, row.lang, row.source, row.n_chars)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    wide = docs.selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain = stage(spark, docs, DIR).collect()
        out = stage(spark, wide, DIR)
        assert out.columns == wide.columns, name
        got = out.collect()
        own = lambda rows: sorted((tuple(r)[:5] for r in rows), key=str)
        assert own(got) == own(plain), name
        assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in got for c in names), name
        assert name == "quality_rules" or any(r.doc_id == 10**9 for r in got), name  # the long text repeats itself
        assert stage(spark, wide.limit(0), DIR).count() == 0, name
