"""Encoding against the library, and exact round trips."""

import random

import numpy as np
import pyarrow as pa
import sentencepiece

from tidegraph.llm import _text, pieces

REF = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
VOCABULARY = pieces.Vocabulary()


def encoded(texts):
    encoder = pieces.Encoder(VOCABULARY)
    ids, to = encoder.encode(*_text.text_bytes(pa.array(texts, pa.string())))
    back, at = encoder.decode(ids, to)
    return [ids[a:b].tolist() for a, b in zip(to[:-1], to[1:])], [back[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:])]


def test_random_texts_match_the_library():
    rng = random.Random(3)
    letters = "aaabcdeest   \n\tñüß漢😀.,!0019THEthe▁\x00"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    ids, back = encoded(texts)
    assert ids == [REF.encode(t) for t in texts]
    assert back == [t.replace("▁", " ") for t in texts]


def test_edges_and_long_runs():
    texts = [None, "", " ", "  ", "a" * 5000, "ab" * 3000, "the" * 2000, " " * 100, "x" + " " * 77 + "y", "漢字" * 400]
    ids, back = encoded(texts)
    assert ids == [REF.encode(t or "") for t in texts]
    assert back == [t or "" for t in texts]


def test_stream_commits_with_a_bounded_window():
    lattice, rng = pieces.Lattice(VOCABULARY), random.Random(1)
    text = "".join(rng.choice("theandingofre") for _ in range(20000))
    out, widest = [], 0
    for i in range(0, len(text), 100):
        out += lattice.feed(text[i : i + 100])
        widest = max(widest, len(lattice.text))
    out += lattice.finish()
    assert REF.decode(out) == text
    assert widest <= 4 * VOCABULARY.longest
    whole = pieces.Lattice(VOCABULARY)
    ids = [*whole.feed("▁" + text), *whole.finish()]
    assert ids == REF.encode(text)


def test_dataframes(spark):
    rows = [(1, "Hello  world\n", "x", 5), (2, None, None, None), (2, "", "y", 1), (None, "ñandú 漢", "z", 2), (1, "Hello  world\n", "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = pieces.encode(df)
    assert sorted((r.doc_id or 0, r.ids) for r in got.collect()) == sorted((d or 0, REF.encode(t or "")) for d, t, *_ in rows)
    assert got.where("NOT round_trip").count() == 0
    back = pieces.decode(got).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((d or 0, t or "") for d, t, *_ in rows)
    assert pieces.encode(df.limit(0)).count() == 0
    assert np.array(got.select("n_tokens").collect()).sum() == sum(len(REF.encode(t or "")) for _, t, *_ in rows)


def test_documents_table(spark):
    rows = pieces.op3_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts) and all(r.round_trip and r.ids == REF.encode(texts[r.doc_id]) for r in rows)


def test_runs_of_one_hash_are_told_apart(monkeypatch):
    """With a hash that tells almost nothing apart the ids stay those of the library."""
    monkeypatch.setattr(_text, "word_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    texts = ["the cat sat on the mat and the dog ran", "une autre phrase avec d'autres mots", "a b c a", ""]
    assert encoded(texts)[0] == [REF.encode(t) for t in texts]


def test_word_hashes_do_not_depend_on_their_place():
    words = [b"a", b"word", "übung".encode(), b"x" * 300_000, b"word", b"tail"]
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    whole = _text.word_hashes(data, starts, ends)
    alone = [_text.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] for w in words]
    assert whole.tolist() == [int(x) for x in alone] and len(set(alone)) == 5


def test_runs_share_the_nodes_of_a_common_beginning():
    """Runs in order give the library's ids, and only nodes behind the shared beginning are looked at."""

    class Counted(dict):
        asked = 0

        def get(self, key):
            Counted.asked += 1
            return super().get(key)

    encoder, rng = pieces.Encoder(VOCABULARY), random.Random(8)
    encoder.kind = Counted(encoder.kind)
    words = sorted({"unbelievabl" + "".join(rng.choice("aeinrt漢ß") for _ in range(rng.randint(0, 3))) for _ in range(300)} | {"", "un", "x" * 80, "▁▁a"})
    text = " ".join(words)
    ids, to = encoder.encode(*_text.text_bytes(pa.array([text, *words])))
    assert [ids[a:b].tolist() for a, b in zip(to[:-1], to[1:])] == [REF.encode(t) for t in [text, *words]]
    assert Counted.asked < 12 * len(words)
    alone = [encoder.run_ids([w])[0] for w in words]
    assert encoder.run_ids(words) == alone and encoder.run_ids(words[::-1]) == alone[::-1]
