"""Held-out accuracy and exact parts of the learned operators."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegraph.llm import _text, gru_lm, knn, language

DIR = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score double, h long"


def test_language_of_held_out_documents(spark):
    got = language.op5_language_id(spark, DIR)
    truth = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", F.col("lang").alias("truth"))
    rows = got.join(truth, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == truth.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang_pred == r.truth for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixed_texts_scripts_and_edges(spark):
    rows = [(i, t, lang, 1.0, 2) for i, (t, lang) in enumerate([("the cat and the dog " * 20, "en"), ("der hund und die katze " * 20, "de"), ("это кошка и собака " * 20, "ru"), (None, "en"), ("xx", None)])]
    df = spark.createDataFrame(rows, SCHEMA)
    model = language.train(df)
    assert model.langs == ["de", "en", "ru"]
    new = spark.createDataFrame([(1, "the dog and the cat der hund und die katze und der hund собака кошка это", "x", 0.0, 1), (2, "123 !", None, 0.0, 1), (3, None, None, 0.0, 1), (4, "собака", None, 0.0, 1)], SCHEMA)
    spans = {r.doc_id: [(s.first_word, s.words, s.lang) for s in r.spans] for r in language.spans(new, model).collect()}
    assert spans == {1: [(0, 5, "en"), (5, 8, "de"), (13, 3, "ru")], 2: [], 3: [], 4: [(0, 1, "ru")]}
    got = {r.doc_id: r.lang_pred for r in language.predict(new, model).collect()}
    assert got == {1: "de", 2: "und", 3: "und", 4: "ru"}
    assert language.train(df.limit(0)) is None
    assert [r.lang_pred for r in language.predict(new, None).collect()] == ["und"] * 4 and language.predict(new.limit(0), model).count() == 0


def test_dirty_languages(spark, monkeypatch):
    """Of too many names the commonest are learned; nothing fails."""
    monkeypatch.setattr(language, "MAX_LANGS", 2)
    rows = [(1, "the cat and the dog " * 9, "en", 1.0, 2), (2, "der hund und die katze " * 9, "de", 1.0, 2), (3, "la", "x", 1.0, 2), (4, "le", "y", 1.0, 2)]
    model = language.train(spark.createDataFrame(rows, SCHEMA))
    assert model.langs == ["de", "en"]


def test_viterbi_in_step_is_viterbi():
    rng = np.random.default_rng(0)
    first = np.array([0, 5, 5, 17, 18, 30])
    score = rng.normal(0, 4, (30, 3)).astype(np.float32)
    got = language.viterbi(score, first, 3.0)
    for a, b in zip(first[:-1], first[1:]):
        own = score[a:b]
        value = lambda path: sum(own[i, p] for i, p in enumerate(path)) - 3.0 * sum(x != y for x, y in zip(path, path[1:]))
        best = own[0].copy() if len(own) else np.zeros(1)
        for s in own[1:]:
            best = np.maximum(best, best.max() - 3.0) + s
        assert value(got[a:b].tolist()) == pytest.approx(float(best.max()), abs=1e-3) if len(own) else True


def test_quality_of_held_out_labels(spark):
    got = knn.op8_quality_classifier(spark, "/root/testdata/sf0.1")
    truth = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    held = got.where("held_out").join(truth, "doc_id").select("score", "predicted", "quality").collect()
    good, bad = [r.score for r in held if r.quality == 1], np.array([r.score for r in held if r.quality == 0])
    auc = np.mean([(g > bad).mean() + 0.5 * (g == bad).mean() for g in good])
    assert auc > 0.98 and np.mean([r.predicted == r.quality for r in held]) > 0.9


def test_cosines_are_exact_and_edges(spark):
    rows = [(1, "aaaa bbbb", None, 0.0, 1), (2, "aaaa bbbb cccc", None, 0.0, 1), (3, "#### !!!!", None, 0.0, 1), (4, None, None, 0.0, 1), (5, "", None, 0.0, 1), (2, "aaaa bbbb cccc", None, 0.0, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (3, None), (9, 1), (None, 0)], "doc_id long, quality int")
    model = knn.fit(docs, labels)
    got = {r.doc_id: r.score for r in knn.score(docs, model).collect()}
    assert got[1] > 0.9 and got[3] < 0.1 and got[4] == got[5] == pytest.approx(model.prior)
    none = knn.fit(docs, labels.limit(0))
    assert all(r.score == 0.5 and r.predicted == 1 for r in knn.score(docs, none).collect())
    assert knn.score(docs.limit(0), model).count() == 0


def test_votes_against_a_dense_loop(spark):
    """Features, cosines, ties and votes in plain numbers; repeated rows of a labelled document count once."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.limit(3))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality")
    model = knn.fit(docs, labels)
    assert len(model.labels) == len(model.vectors) <= labels.count()

    def vector(text):
        data = (text or "").encode()
        count = Counter()
        for i in range(len(data) - 2):
            x = [32 if b == 32 or 9 <= b <= 13 else b for b in data[i : i + 3]]
            key = ((x[0] << 16 | x[1] << 8 | x[2]) * 0x9E3779B1) % (1 << 32) >> 19
            count[key % knn.GRAMS] += 1
        words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in data))
        last, kinds = {}, Counter()
        for i, w in enumerate(words):
            kinds[min(int(math.log2(i - last[w])) + 1, knn.RETURNS - 1) if w in last else 0] += 1
            last[w] = i
        if count:
            count.update({knn.GRAMS + k: 100 * n // len(words) for k, n in kinds.items()})
        out = np.zeros(knn.BUCKETS)
        for k, n in count.items():
            out[k] = (1 + math.log(n)) * model.idf[k] if n else 0
        for view in (out[: knn.GRAMS], out[knn.GRAMS :]):
            view /= max(np.linalg.norm(view), 1e-9)
        out[knn.GRAMS] = 0
        v = out @ model.basis.astype(float)
        return v / max(np.linalg.norm(v), 1e-9)

    rows = docs.collect()
    got = sorted((r.doc_id, r.score) for r in knn.score(docs, model).collect())
    assert len(got) == len(rows)
    for (doc, score), r in zip(got, sorted(rows, key=lambda r: r.doc_id)):
        cosine = model.vectors.astype(float) @ vector(r.text)
        weight = np.where(cosine >= np.sort(cosine)[-knn.NEIGHBOURS] - 1e-6, np.maximum(cosine, 0), 0)
        want = (weight * model.labels).sum() / weight.sum() if weight.sum() > 1e-6 else model.prior
        assert doc == r.doc_id and score == pytest.approx(min(1, max(0, want)), abs=2e-3)


def test_language_model_base_and_gain(spark):
    rows = gru_lm.op10_lm_scoring(spark, DIR).collect()
    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    texts = {r.doc_id: low(r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts}
    count = Counter()
    for d, w in texts.items():
        if not held[d]:
            count.update([*w, "\0"])
    total, types = sum(count.values()), len(count)
    assert len(rows) == len(texts)
    for r in rows:
        w = [*texts[r.doc_id], "\0"]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(count[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 0.1) / (total + 0.1 * (types + 1))) for x in w))
    assert all(r.score < 0 for r in rows)
    # Context helps: held-out texts without unseen words lie above their unigram scores.
    known = [r for r in rows if r.held_out and r.n_known == r.n_tokens]
    assert sum(r.score - r.base_score for r in known) > 0.1 * sum(r.n_tokens for r in known)


def _model(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    return docs, *gru_lm.train(docs)


def test_language_model_is_a_distribution(spark):
    """Scores against a loop in plain words; the words of all kinds share at most one; noise lies under prose."""
    docs, model, counts = _model(spark)
    v, net = model.vocabulary, model.network
    count = {bytes(r.w): r.n for r in gru_lm.word_counts(docs).select("w", "n").collect()}
    hot = {int(h): i for i, h in enumerate(v.h)}
    prose = [r.text for r in docs.where("length(text) BETWEEN 200 AND 900").orderBy("doc_id").limit(5).collect()]
    rng = np.random.default_rng(1)
    noise = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 8)) for _ in range(80)) for _ in range(3)]
    texts = prose + noise + ["", None, "x" * 500 + " the the", "été 漢字 \u20ac"]

    def one(word: bytes):
        data, at = np.frombuffer(word, np.uint8), np.array([0])
        h = int(_text.word_hashes(data, at, np.array([len(word)]))[0])
        k = int(gru_lm.spelled(v.table, data, at, np.array([len(word)]))[0])
        if h in hot:
            return int(v.symbol[hot[h]]), float(v.share[hot[h]])
        n = count.get(word, 0)
        share = math.log10((1 - model.unseen[k]) * n / max(model.mass[k], 1)) if n else math.log10(model.unseen[k]) + float(v.letters.log10_of(data, at, np.array([len(word)]), np.array([k]))[0])
        return gru_lm.OWN + gru_lm.CLUSTERS + k, share

    def plain(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        total, h, before = 0.0, np.zeros((1, gru_lm.HIDDEN), np.float32), np.array([gru_lm.END_SYMBOL])
        for symbol, share in [*(one(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", low)), (gru_lm.END_SYMBOL, 0.0)]:
            h = net.step(h, before)
            z = (h @ net.p["leave"] + net.p["base"])[0].astype(float)
            cls = int(gru_lm._CLASS[symbol])
            total += (z[cls] - np.log(np.exp(z - z.max()).sum()) - z.max()) / math.log(10) + share
            if gru_lm.SINGLES <= symbol < gru_lm.OWN:
                g, m = divmod(symbol - gru_lm.SINGLES, gru_lm.MEMBERS)
                z = (h @ net.p["inner"][g] + net.p["inner_base"][g])[0].astype(float)
                total += (z[m] - np.log(np.exp(z - z.max()).sum()) - z.max()) / math.log(10)
            before = np.array([symbol])
        return total

    df = spark.createDataFrame([(i, t, None, 0.0, 1) for i, t in enumerate(texts)], SCHEMA)
    rows = {r.doc_id: r for r in gru_lm.score(df, model, counts).collect()}
    for i, t in enumerate(texts):
        assert rows[i].score == pytest.approx(plain(t), rel=1e-3, abs=1e-3)
    per = [rows[i].score / rows[i].n_tokens for i in range(8)]
    assert max(per[5:]) < min(per[:5]) - 3
    # In every class: what its words have, seen ones and the share left to unseen strings, is at most one.
    each = np.bincount(gru_lm._CLASS[v.symbol], weights=10**v.share, minlength=gru_lm.CLASSES)
    alone = np.r_[0 : gru_lm.SINGLES, gru_lm.CLASSES - 1, gru_lm.SINGLES + gru_lm.GROUPS : gru_lm.SINGLES + gru_lm.GROUPS + gru_lm.CLUSTERS]
    assert np.allclose(each[alone][each[alone] > 0], 1)
    rare = Counter()
    for w, n in count.items():
        if w and int(_text.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) not in hot:
            rare[int(gru_lm.spelled(v.table, np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])] += n
    assert [rare[k] for k in range(gru_lm.CLUSTERS)] == list(model.mass)


def test_letter_model_is_a_distribution():
    words = [b"abc", b"abd", b"zzz", b"a"]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    letters = gru_lm.Letters(data)
    k = np.zeros(4, np.int64)
    letters.learn(np.bincount(np.concatenate(letters.places(data, starts, ends, k)[:3]), minlength=letters.SIZE))
    legal = [b for b in range(256) if not _text.SPACE[b]]

    def total(prefix: bytes, depth: int) -> float:
        """All strings from a prefix on, of at most depth bytes more."""
        if depth == 0:
            return 0.0
        more = [prefix + bytes([b]) for b in legal]
        flat = np.frombuffer(b"".join(more), np.uint8)
        at = np.arange(len(more)) * (len(prefix) + 1)
        return float((10 ** letters.log10_of(flat, at, at + len(prefix) + 1, np.zeros(len(more), np.int64))).sum())

    assert 0.01 < total(b"", 1) + total(b"a", 1) + total(b"ab", 1) + total(b"q", 1) <= 1


def test_gradients_and_carried_state():
    rng = np.random.default_rng(3)
    net = gru_lm.Network(np.ones(gru_lm.CLASSES))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.m, net.v = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    before, after = rng.integers(0, gru_lm.SYMBOLS, (5, 3)), rng.integers(0, gru_lm.SYMBOLS, (5, 3))
    after[0] = gru_lm.SINGLES, gru_lm.SINGLES + 1, gru_lm.OWN - 1
    h0 = np.zeros((3, gru_lm.HIDDEN))

    def loss(p):
        n = gru_lm.Network(np.ones(gru_lm.CLASSES))
        n.p, h, out = p, h0, 0.0
        for b, a in zip(before, after):
            h = n.step(h, b)
            z = h @ p["leave"] + p["base"]
            out -= (z[np.arange(3), gru_lm._CLASS[a]] - gru_lm._logsumexp(z)).sum()
            for i, w in enumerate(a):
                if gru_lm.SINGLES <= w < gru_lm.OWN:
                    g, m = divmod(w - gru_lm.SINGLES, gru_lm.MEMBERS)
                    z = h[i : i + 1] @ p["inner"][g] + p["inner_base"][g]
                    out -= z[0, m] - gru_lm._logsumexp(z)[0]
        return out / after.size

    start = {k: v.copy() for k, v in net.p.items()}
    _, got = net.learn(h0, before, after, 0.0)
    assert got == pytest.approx(loss(start))
    slopes = {}
    for k in net.NAMES:
        places = {"enter": (1, int(before[0, 0]), 7), "inner": (0, 3, 1), "inner_base": (0, 1)}
        i = places.get(k) or tuple(int(rng.integers(0, n)) for n in start[k].shape)
        up, down = {x: y.copy() for x, y in start.items()}, {x: y.copy() for x, y in start.items()}
        up[k][i] += 1e-5
        down[k][i] -= 1e-5
        slopes[k] = (loss(up) - loss(down)) / 2e-5, net.m[k][i] * 10
    # All gradients are scaled by the same factor, which keeps their common length at one or less.
    scale = slopes["base"][1] / slopes["base"][0]
    assert 0 < scale <= 1 + 1e-3
    for want, got in slopes.values():
        assert got == pytest.approx(want * scale, rel=2e-3, abs=1e-7)
    words, first = rng.integers(0, gru_lm.SYMBOLS, 200), np.array([0, 3, 3, 150, 200])
    whole = net.log10_of(words, first)
    for j, (a, b) in enumerate(zip(first[:-1], first[1:])):
        assert whole[j] == pytest.approx(net.log10_of(words[a:b], np.array([0, b - a]))[0] if b > a else 0.0)


def test_language_model_edges(spark):
    docs = spark.createDataFrame([(1, "a b a", None, 0.0, 1), (2, None, None, 0.0, 1), (None, "a c", None, 0.0, 1), (1, "a b a", None, 0.0, 1)], SCHEMA)
    model, counts = gru_lm.train(docs)
    rows = gru_lm.score(docs, model, counts).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 3, 4, 4] and all(r.train_tokens == 12 and r.n_known == r.n_tokens for r in rows)
    assert gru_lm.score(docs.limit(0), model, counts).count() == 0
    empty, none = gru_lm.train(docs.limit(0))
    assert all(r.score == r.base_score and r.n_known == 0 for r in gru_lm.score(docs, empty, none).collect())


def test_every_class_is_learned_with_the_state_carried(monkeypatch):
    """All classes of a group are learned once, in order, each window from the state that the last one left."""
    seen, states = [], []
    real = gru_lm.Network.learn

    def learn(self, h, before, after, rate):
        out = real(self, h, before, after, rate)
        seen.append((before.copy(), after.copy()))
        states.append((h.copy(), out[0].copy()))
        return out

    monkeypatch.setattr(gru_lm.Network, "learn", learn)

    class Shared:
        def __init__(self, value):
            self.value = value

    class Plain:
        def read(self, column):
            return (np.array(column.to_pylist(), np.int64),)

    def plain(batches, column):
        yield from ([b] for b in batches)

    monkeypatch.setattr(gru_lm, "_groups", plain)
    for n in (10, 1000, 20_011):
        seen.clear()
        states.clear()
        classes = np.random.default_rng(n).integers(0, gru_lm.SYMBOLS, n)
        batch = pa.RecordBatch.from_arrays([pa.array(classes)], ["text"])
        list(gru_lm._adapt(Shared(Plain()), Shared(gru_lm.Network(np.ones(gru_lm.CLASSES))))(iter([batch])))
        after = np.concatenate([a for _, a in seen]).T.ravel()
        before = np.concatenate([b for b, _ in seen]).T.ravel()
        assert (after[after >= 0] == classes).all() and (before[after >= 0][1:] == classes[:-1]).all() and before[0] == gru_lm.END_SYMBOL
        for (_, left), (begin, _) in zip(states, states[1:]):
            assert (left == begin).all() and left.any()


def test_softmaxes_take_each_word_once(monkeypatch):
    """Words of one group alone: its softmax has a row a word, none for other groups, and blocks change nothing."""
    rows, real = [], gru_lm._exp
    monkeypatch.setattr(gru_lm, "_exp", lambda x, bound: rows.append(len(x)) or real(x, bound))
    rng = np.random.default_rng(4)
    words = rng.integers(gru_lm.SINGLES, gru_lm.SINGLES + gru_lm.MEMBERS, (6, 50))
    after = words.copy()
    after[4:, 45:] = -1
    got = []
    for block in (1024, 7):
        monkeypatch.setattr(gru_lm, "BLOCK", block, raising=False)
        net = gru_lm.Network(np.ones(gru_lm.CLASSES))
        rows.clear()
        h, loss = net.learn(np.zeros((50, gru_lm.HIDDEN), np.float32), words, after, 0.01)
        assert sum(rows) == 2 * 290
        rows.clear()
        score = net.log10_of(words.ravel(), np.array([0, 120, 300]))
        assert sum(rows) == 2 * 300
        got.append(np.concatenate([[loss], h.ravel(), net.flat(), score]))
    assert np.allclose(got[0], got[1], atol=1e-3)


def test_sums_by_word():
    rng = np.random.default_rng(6)
    for n in (0, 1, 500):
        key, rows = np.minimum(rng.geometric(0.05, n), 99), rng.standard_normal((n, 5))
        want = np.zeros((100, 5))
        np.add.at(want, key, rows)
        assert np.allclose(gru_lm._sums(rows, key, 100), want)
