"""Language-model scores: a gated recurrent network over words with a class-factored softmax.

Counts.  Every word of every training text is counted (combined in the tasks, then by
word).  Words at or above a count that at most ``HOT`` words reach are broadcast with
their counts, a bounded table; the tokens of all other words are joined with the full
counts, so no count is estimated or cut off.

Probability of a word = that of its class given the state x that of the word in its class given the state.

* The ``SINGLES`` commonest words and the end of a text are classes of their own.
* The next ``GROUPS`` x ``MEMBERS`` words form classes of ``MEMBERS`` words of like spelling; the word in the class is a
  second softmax of the state.
* All other words fall into ``CLUSTERS`` classes by spelling (spherical k-means of hashed letter
  trigrams of at most ``SPELLED`` bytes, fitted on the hot words), hot and rare ones apart.  A word's share in its
  class is its share of the class' training tokens.  A rare class leaves its Good-Turing share (words
  seen once) to words never seen, and these are told apart by a letter model:
  each byte given the three before it and the cluster, learned on all words, which sums to at most one over all strings.

So the probabilities of all words that can be written sum to at most one.

Network.  A gated recurrent unit reads the words (those of the shared classes as their class); weights are learned by truncated
backpropagation through time with Adam, in numpy: first on the driver over a bounded
start sample (``START_DOCS`` texts, ``START_BYTES`` bytes), then in one pass where every task goes on from these
weights over every window of all its training texts, the state carried from window to
window, and the tasks' weights are averaged by tokens.  Scoring carries the state from window to
window, so a text of any length gets its complete log likelihood; texts run in lockstep.

Defined results: null text is empty and has one token, its end; repeated rows count and
are scored each; a null ``doc_id`` belongs to the training part; with no training text the score is the base
score; an empty table gives an empty table; other columns are not read, whatever they are called; a very long text is read whole by one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph import scratch
from tidegraph.llm import _text

HOT = 1 << 17
LEAST_HOT = 3
SINGLES, GROUPS, MEMBERS, CLUSTERS = 24, 16, 64, 12
#: What the network reads: single words, members of groups, hot and rare clusters, the end.
OWN = SINGLES + GROUPS * MEMBERS
SYMBOLS = OWN + 2 * CLUSTERS + 1
END_SYMBOL = SYMBOLS - 1
CLASSES = SINGLES + GROUPS + 2 * CLUSTERS + 1
_CLASS = np.concatenate([np.arange(SINGLES), SINGLES + np.repeat(np.arange(GROUPS), MEMBERS), SINGLES + GROUPS + np.arange(2 * CLUSTERS + 1)])
HIDDEN = 24
START_DOCS, START_BYTES = 1200, 8 << 20
WINDOW = 24
STREAMS, START_STREAMS = 192, 64
GROUP_BYTES = 8 << 20
#: Rows of a softmax at once, and the count above which the rows of a word are summed by themselves.
BLOCK, OFTEN = 1024, 24
TRIGRAMS = 4096
SPELLED = 64
#: The hash that stands for the end of a text; its row in the counts has no word.
END = np.uint64(1)


def _words(column: pa.Array):
    data, at = _text.text_bytes(column)
    low = _text.LOWER[data]
    return low, *_text.words(low, at)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

    def merged() -> pa.RecordBatch:
        h = np.concatenate([x[0] for x in held])
        unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate([x[1] for x in held])).astype(np.int64)
        w = pa.concat_arrays([x[2] for x in held]).take(pa.array(first))
        return pa.RecordBatch.from_arrays([pa.array(_text.signed(unique)), w, pa.array(n)], ["h", "w", "n"])

    texts = size = 0
    for batch in batches:
        for part in _text.slices(batch, limit=1 << 20):
            low, starts, ends, _ = _words(part.column(0))
            texts += part.num_rows
            unique, first, count = np.unique(_text.word_hashes(low, starts, ends), return_index=True, return_counts=True)
            width = ends[first] - starts[first]
            at = np.concatenate([[0], np.cumsum(width)])
            flat = low[np.arange(at[-1]) + np.repeat(starts[first] - at[:-1], width)]
            held.append((unique, count, pa.Array.from_buffers(pa.binary(), len(unique), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])))
            size += len(unique)
            if size > 1_000_000:
                out = merged()
                held = [(out.column(0).to_numpy().view(np.uint64), out.column(2).to_numpy(), out.column(1))]
                size = out.num_rows
                if size > 500_000:
                    yield out
                    held, size = [], 0
    if held:
        yield merged()
    yield pa.RecordBatch.from_arrays([pa.array([int(END)], pa.int64()), pa.array([b""], pa.binary()), pa.array([texts], pa.int64())], ["h", "w", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """``(h, w, n)``: every word of ``docs`` with its hash and count, and a row for the ends of texts."""
    scratch.ship_package(docs.sparkSession)
    parts = docs.select("text").mapInArrow(_count, "h long, w binary, n long")
    return scratch.materialize(parts.groupBy("h", "w").agg(F.sum("n").alias("n")).where("n > 0"), "words")


def _trigrams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of words (a space at both ends), and each word's first."""
    size = ends - starts
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) + np.repeat(starts - begin, size)
    x = data[place].astype(np.uint32)
    before, after = np.full_like(x, 32), np.full_like(x, 32)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[begin], after[begin + size - 1] = 32, 32
    key = (before << np.uint32(16)) | (x << np.uint32(8)) | after
    return ((key * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64), begin


def spelled(table: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The spelling cluster of each word."""
    if not len(starts):
        return np.zeros(0, np.int64)
    out, ends = [], np.minimum(ends, starts + SPELLED)
    for a in range(0, len(starts), 1 << 15):
        bucket, begin = _trigrams(data, starts[a : a + (1 << 15)], ends[a : a + (1 << 15)])
        out.append(np.add.reduceat(table[bucket], begin).argmax(axis=1))
    return np.concatenate(out)


class Letters:
    """Probabilities of words as strings: byte after byte given the three before it and the word's cluster, backed off to
    the three alone and then to the last.  Contexts are hashed, which leaves every one a distribution.  Bytes that
    are none of the ``KNOWN`` commonest share a symbol, and its probability."""

    KNOWN = 62
    BITS = (6, 14, 16)
    SIZE = sum(64 << b for b in BITS)
    WEIGHT = np.float32(8)

    def __init__(self, data: np.ndarray):
        often = np.bincount(data, minlength=256)
        top = np.argsort(-often, kind="stable")[: min(self.KNOWN, int((often > 0).sum()))]
        self.symbol = np.full(256, 63, np.uint8)
        self.symbol[top] = np.arange(1, len(top) + 1)
        self.learn(np.zeros(self.SIZE))

    def places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each byte and end of each word its places in the three tables, and each word's first."""
        if not len(starts):
            none = np.zeros(0, np.int64)
            return none, none, none, none
        size = ends - starts + 1
        begin = np.cumsum(size) - size
        source = np.arange(int(size.sum())) + np.repeat(starts - begin, size)
        now = self.symbol[data[np.minimum(source, len(data) - 1)]].astype(np.uint32)
        now[begin + size - 1] = 0

        def shifted(x: np.ndarray) -> np.ndarray:
            out = np.empty_like(x)
            out[1:] = x[:-1]
            out[begin] = 0
            return out

        one = shifted(now)
        two = shifted(one)
        context = one | (two << np.uint32(6)) | (shifted(two) << np.uint32(12))
        mult = np.uint32(0x9E3779B1)
        three = (context * mult) >> np.uint32(32 - self.BITS[1])
        with_cluster = (((context << np.uint32(4)) | np.repeat(cluster, size).astype(np.uint32)) * mult) >> np.uint32(32 - self.BITS[2])
        at = np.cumsum([0, *[64 << b for b in self.BITS]])
        return tuple(at[i] + (c.astype(np.int64) << 6 | now) for i, c in enumerate((one, three, with_cluster))) + (begin,)

    def learn(self, count: np.ndarray) -> None:
        self.count = count.astype(np.float32)
        self.total = self.count.reshape(-1, 64).sum(axis=1)

    def log10_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0)
        *places, begin = self.places(data, starts, ends, cluster)
        p = (self.count[places[0]] + np.float32(0.05)) / (self.total[places[0] >> 6] + np.float32(0.05 * 64))
        for x in places[1:]:
            p = (self.count[x] + self.WEIGHT * p) / (self.total[x >> 6] + self.WEIGHT)
        p[(places[0] & 63) == 63] /= 256 - self.KNOWN
        return np.add.reduceat(np.log10(p).astype(np.float64), begin)


def _cluster_table(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """(TRIGRAMS, CLUSTERS) linear scores of spherical k-means over projected trigrams."""
    rng = np.random.default_rng(23)
    project = rng.standard_normal((TRIGRAMS, 48)).astype(np.float32)
    bucket, begin = _trigrams(data, starts, ends)
    x = np.add.reduceat(project[bucket], begin)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centre = x[rng.choice(len(x), CLUSTERS, replace=len(x) < CLUSTERS, p=weight / weight.sum())]
    for _ in range(15):
        own = (x @ centre.T).argmax(axis=1)
        for k in range(CLUSTERS):
            total = (x[own == k] * weight[own == k, None]).sum(axis=0)
            norm = np.linalg.norm(total)
            if norm > 0:
                centre[k] = total / norm
    return project @ centre.T.astype(np.float32)


class Network:
    """Weights and their gradients; words in, log probabilities of the next class and of the word in its group out."""

    NAMES = ("enter", "turn", "bias", "leave", "base", "inner", "inner_base")

    def __init__(self, prior: np.ndarray, members: np.ndarray | None = None, seed: int = 5):
        """``prior``: weight of each class; ``members``: weight of each word of the groups, 0 where there is none."""
        rng = np.random.default_rng(seed)
        f = np.float32
        members = np.ones((GROUPS, MEMBERS)) if members is None else members
        self.p = {
            # Of the update gate, the reset gate and the new state.
            "enter": (rng.standard_normal((3, CLASSES, HIDDEN)) * 0.3).astype(f)[:, _CLASS],
            "turn": (rng.standard_normal((3, HIDDEN, HIDDEN)) / np.sqrt(HIDDEN)).astype(f),
            "bias": np.stack([np.ones(HIDDEN), np.zeros(HIDDEN), np.zeros(HIDDEN)]).astype(f),
            "leave": (rng.standard_normal((HIDDEN, CLASSES)) * 0.1).astype(f),
            "base": np.log(prior / prior.sum()).astype(f),
            "inner": (rng.standard_normal((GROUPS, HIDDEN, MEMBERS)) * 0.1).astype(f),
            "inner_base": np.where(members > 0, np.log(np.maximum(members, 1e-9) / np.maximum(members.sum(axis=1, keepdims=True), 1e-9)), -1e4).astype(f),
        }
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.NAMES])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            size = self.p[k].size
            self.p[k] = flat[at : at + size].reshape(self.p[k].shape).astype(np.float32)
            at += size

    def laid(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Weights as a step takes them: of words and of the state for both gates side by side, negated, and for the new state; biases are in those of words."""
        enter, turn = self.p["enter"] + self.p["bias"][:, None], self.p["turn"]
        gates = [-x[:2].transpose(1, 0, 2).reshape(x.shape[1], -1) for x in (enter, turn)]
        return gates[0], enter[2], gates[1], turn[2]

    def step(self, h: np.ndarray, before: np.ndarray, laid: tuple | None = None) -> np.ndarray:
        """The state after another word; ``laid``: the weights, if they are laid out already."""
        in_gates, in_new, to_gates, to_new = laid or self.laid()
        gate = h @ to_gates
        gate += in_gates.take(before, axis=0)
        _logistic(gate)
        new = h @ to_new
        new *= gate[:, HIDDEN:]
        new += in_new.take(before, axis=0)
        np.tanh(new, out=new)
        out = h - new
        out *= gate[:, :HIDDEN]
        out += new
        return out

    def learn(self, count: np.ndarray) -> None:
        self.count = count.astype(np.float32)
        self.total = self.count.reshape(-1, 64).sum(axis=1)

    def log10_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0)
        *places, begin = self.places(data, starts, ends, cluster)
        p = (self.count[places[0]] + np.float32(0.05)) / (self.total[places[0] >> 6] + np.float32(0.05 * 64))
        for x in places[1:]:
            p = (self.count[x] + self.WEIGHT * p) / (self.total[x >> 6] + self.WEIGHT)
        p[(places[0] & 63) == 63] /= 256 - self.KNOWN
        return np.add.reduceat(np.log10(p).astype(np.float64), begin)


def _cluster_table(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """(TRIGRAMS, CLUSTERS) linear scores of spherical k-means over projected trigrams."""
    rng = np.random.default_rng(23)
    project = rng.standard_normal((TRIGRAMS, 48)).astype(np.float32)
    bucket, begin = _trigrams(data, starts, ends)
    x = np.add.reduceat(project[bucket], begin)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centre = x[rng.choice(len(x), CLUSTERS, replace=len(x) < CLUSTERS, p=weight / weight.sum())]
    for _ in range(15):
        own = (x @ centre.T).argmax(axis=1)
        for k in range(CLUSTERS):
            total = (x[own == k] * weight[own == k, None]).sum(axis=0)
            norm = np.linalg.norm(total)
            if norm > 0:
                centre[k] = total / norm
    return project @ centre.T.astype(np.float32)


class Network:
    """Weights and their gradients; words in, log probabilities of the next class and of the word in its group out."""

    NAMES = ("enter", "turn", "bias", "leave", "base", "inner", "inner_base")

    def __init__(self, prior: np.ndarray, members: np.ndarray | None = None, seed: int = 5):
        """``prior``: weight of each class; ``members``: weight of each word of the groups, 0 where there is none."""
        rng = np.random.default_rng(seed)
        f = np.float32
        members = np.ones((GROUPS, MEMBERS)) if members is None else members
        self.p = {
            # Of the update gate, the reset gate and the new state.
            "enter": (rng.standard_normal((3, CLASSES, HIDDEN)) * 0.3).astype(f)[:, _CLASS],
            "turn": (rng.standard_normal((3, HIDDEN, HIDDEN)) / np.sqrt(HIDDEN)).astype(f),
            "bias": np.stack([np.ones(HIDDEN), np.zeros(HIDDEN), np.zeros(HIDDEN)]).astype(f),
            "leave": (rng.standard_normal((HIDDEN, CLASSES)) * 0.1).astype(f),
            "base": np.log(prior / prior.sum()).astype(f),
            "inner": (rng.standard_normal((GROUPS, HIDDEN, MEMBERS)) * 0.1).astype(f),
            "inner_base": np.where(members > 0, np.log(np.maximum(members, 1e-9) / np.maximum(members.sum(axis=1, keepdims=True), 1e-9)), -1e4).astype(f),
        }
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.NAMES])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            size = self.p[k].size
            self.p[k] = flat[at : at + size].reshape(self.p[k].shape).astype(np.float32)
            at += size

    def laid(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Weights as a step takes them: of words and of the state for both gates side by side, negated, and for the new state; biases are in those of words."""
        enter, turn = self.p["enter"] + self.p["bias"][:, None], self.p["turn"]
        gates = [-x[:2].transpose(1, 0, 2).reshape(x.shape[1], -1) for x in (enter, turn)]
        return gates[0], enter[2], gates[1], turn[2]

    def step(self, h: np.ndarray, before: np.ndarray, laid: tuple | None = None) -> np.ndarray:
        """The state after another word; ``laid``: the weights, if they are laid out already."""
        in_gates, in_new, to_gates, to_new = laid or self.laid()
        gate = h @ to_gates
        gate += in_gates.take(before, axis=0)
        _logistic(gate)
        new = h @ to_new
        new *= gate[:, HIDDEN:]
        new += in_new.take(before, axis=0)
        np.tanh(new, out=new)
        out = h - new
        out *= gate[:, :HIDDEN]
        out += new
        return out

    def grouped(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of groups, group after group: ``(their places in wanted, members, where each group begins)``."""
        place = np.flatnonzero((wanted >= SINGLES) & (wanted < OWN))
        word = (wanted[place] - SINGLES).astype(np.uint16)
        order = np.argsort(word, kind="stable")
        place, word = place[order], word[order].astype(np.int64)
        return place, word % MEMBERS, np.searchsorted(word, np.arange(GROUPS + 1) * MEMBERS)

    def learn(self, h: np.ndarray, before: np.ndarray, after: np.ndarray, rate: float) -> tuple[np.ndarray, float]:
        """One truncated backpropagation over (steps, streams) words, -1 in ``after`` where a stream is over; the state is carried on."""
        p, n = self.p, HIDDEN
        steps, streams = before.shape
        in_gates, in_new, to_gates, to_new = self.laid()
        gates, news = in_gates.take(before, axis=0), in_new.take(before, axis=0)
        hs, ans = np.empty((steps + 1, streams, n), news.dtype), np.empty_like(news)
        hs[0] = h
        for t in range(steps):
            gate = gates[t]
            gate += hs[t] @ to_gates
            _logistic(gate)
            a = np.matmul(hs[t], to_new, out=ans[t])
            new = news[t]
            new += gate[:, n:] * a
            np.tanh(new, out=new)
            now = np.subtract(hs[t], new, out=hs[t + 1])
            now *= gate[:, :n]
            now += new
        order, edge = _by_word(after.ravel())
        # With a last column of ones, whose weights are the bases.
        states = np.ones((steps * streams, n + 1), hs.dtype)
        states[:, :n] = hs[1:].reshape(-1, n)
        states, wanted = states.take(order, axis=0), after.ravel().take(order)
        over = int(np.searchsorted(wanted, 0))
        one, loss, sorted_back = 1 / (len(wanted) - over), 0.0, np.zeros((len(wanted), n), hs.dtype)
        leave, inner = np.concatenate([p["leave"], p["base"][None]]), np.concatenate([p["inner"], p["inner_base"][:, None]], axis=1)
        g_leave, g_inner = np.zeros_like(leave), np.zeros_like(inner)
        bound, cls = _bound(p["leave"], p["base"]), _CLASS[wanted]
        for a in range(over, len(wanted), BLOCK):
            own = slice(a, a + BLOCK)
            loss += _learn_softmax(states[own], leave, bound, cls[own], one, g_leave, sorted_back[own])
        bound, member = _bound(p["inner"], p["inner_base"]), (wanted - SINGLES) % MEMBERS
        for k in range(GROUPS):
            for a in range(edge[k], edge[k + 1], BLOCK):
                own = slice(a, min(a + BLOCK, edge[k + 1]))
                loss += _learn_softmax(states[own], inner[k], bound, member[own], one, g_inner[k], sorted_back[own])
        loss *= one
        g = {"leave": g_leave[:n], "base": g_leave[n], "inner": g_inner[:, :n], "inner_base": g_inner[:, n]}
        back = np.empty_like(sorted_back)
        back[order] = sorted_back
        back = back.reshape(steps, streams, n)
        # What the gradient of a step is multiplied with, for all steps at once.
        z, r = np.ascontiguousarray(gates[:, :, :n]), np.ascontiguousarray(gates[:, :, n:])
        kept = 1 - z
        to_z = hs[:-1] - news
        to_z *= z
        to_z *= kept
        news *= news
        to_new = np.subtract(1, news, out=news)
        to_new *= kept
        to_r = np.subtract(1, r, out=kept)
        to_r *= r
        to_r *= ans
        # Gradients of the update gate, the reset gate and the new state's share of the last one, side by side.
        da, dnews = np.empty((steps, streams, 3 * n), hs.dtype), ans
        back_turn = np.ascontiguousarray(p["turn"].transpose(0, 2, 1)).reshape(3 * n, n)
        dh = np.zeros_like(hs[0])
        for t in range(steps - 1, -1, -1):
            dh += back[t]
            dnew = np.multiply(dh, to_new[t], out=dnews[t])
            d = da[t]
            np.multiply(dh, to_z[t], out=d[:, :n])
            np.multiply(dnew, to_r[t], out=d[:, n : 2 * n])
            np.multiply(dnew, r[t], out=d[:, 2 * n :])
            dh *= z[t]
            dh += d @ back_turn
        g["turn"] = (hs[:-1].transpose(0, 2, 1) @ da).sum(axis=0).reshape(n, 3, n).transpose(1, 0, 2)
        da[:, :, 2 * n :] = dnews
        enter = _sums(da.reshape(-1, 3 * n), before.ravel(), SYMBOLS)
        g["bias"] = enter.sum(axis=0).reshape(3, n)
        g["enter"] = enter.reshape(SYMBOLS, 3, n).transpose(1, 0, 2)
        g = {k: np.ascontiguousarray(x) for k, x in g.items()}
        h = hs[-1]
        self.t += 1
        size = math.sqrt(sum(float(np.dot(x.ravel(), x.ravel())) for x in g.values()))
        clip = min(1.0, 1.0 / max(size, 1e-9))
        for k, x in g.items():
            m, v = self.m[k], self.v[k]
            x *= 0.1 * clip
            m *= 0.9
            m += x
            x *= x
            v *= 0.99
            v += x
            np.sqrt(v, out=x)
            x *= (1 - 0.99**self.t) ** -0.5
            x += 1e-6
            np.divide(m, x, out=x)
            x *= rate / (1 - 0.9**self.t)
            p[k] -= x
        return h, loss

    def learn_stream(self, words: np.ndarray, rate: float, most: int = STREAMS) -> float:
        """Learn every word of a sequence, the first as what follows an end; it is cut into at most ``most`` streams side by side."""
        if not len(words):
            return np.nan
        length = -(-len(words) // max(1, min(most, len(words) // WINDOW)))
        streams = -(-len(words) // length)

        def grid(x: np.ndarray, fill: int) -> np.ndarray:
            return np.concatenate([x, np.full(streams * length - len(x), fill, x.dtype)]).reshape(streams, length).T

        before, after = grid(np.concatenate([[END_SYMBOL], words[:-1]]), END_SYMBOL), grid(words, -1)
        h, losses = np.zeros((streams, HIDDEN), np.float32), []
        for a in range(0, length, WINDOW):
            h, loss = self.learn(h, before[a : a + WINDOW], after[a : a + WINDOW], rate)
            losses.append(loss)
        return float(np.mean(losses))

    def log10_of(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Sum over each row's words of log10 p(word's class, word in its group | those before); rows in lockstep, state carried."""
        count = np.diff(first)
        order = np.argsort(-count, kind="stable")
        start, count = first[:-1][order], count[order]
        total = np.zeros(len(count))
        h = np.zeros((len(count), HIDDEN), np.float32)
        before = np.full(len(count), END_SYMBOL)
        steps = int(count[0]) if len(count) else 0
        active = np.searchsorted(-count, -np.arange(steps), "left")
        leave, base, inner, inner_base = (self.p[k] for k in ("leave", "base", "inner", "inner_base"))
        bound, inner_bound, laid = _bound(leave, base), _bound(inner, inner_base), self.laid()
        for a in range(0, steps, WINDOW):
            states, wanted, rows = [], [], []
            for t in range(a, min(a + WINDOW, steps)):
                n = active[t]
                h = self.step(h[:n], before[:n], laid)
                now = words[start[:n] + t]
                states.append(h)
                wanted.append(now)
                rows.append(np.arange(n))
                before = now
            want = np.concatenate(wanted)
            by_word, edge = _by_word(want)
            states, want = np.concatenate(states).take(by_word, axis=0), want.take(by_word)
            got, cls, member = np.empty(len(want), np.float32), _CLASS[want], (want - SINGLES) % MEMBERS
            for b in range(0, len(want), BLOCK):
                own = slice(b, b + BLOCK)
                z = states[own] @ leave
                z += base
                got[own] = z[np.arange(len(z)), cls[own]] - _logsumexp(z, bound)
            for k in range(GROUPS):
                for b in range(edge[k], edge[k + 1], BLOCK):
                    own = slice(b, min(b + BLOCK, edge[k + 1]))
                    z = states[own] @ inner[k]
                    z += inner_base[k]
                    got[own] += z[np.arange(len(z)), member[own]] - _logsumexp(z, inner_bound)
            total += np.bincount(np.concatenate(rows).take(by_word), weights=got, minlength=len(total))
        out = np.zeros(len(total))
        out[order] = total / np.log(10)
        return out


def _logistic(x: np.ndarray) -> None:
    """The logistic function of -x, in place."""
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


def _by_word(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of places by their word (-1: none, first), and where in it each group begins."""
    order = np.argsort((wanted + 1).astype(np.uint16), kind="stable")
    return order, np.searchsorted(wanted.take(order), SINGLES + np.arange(GROUPS + 1) * MEMBERS).tolist()


def _learn_softmax(x: np.ndarray, weights: np.ndarray, bound: float, wanted: np.ndarray, one: float, gradient: np.ndarray, back: np.ndarray) -> float:
    """Adds to the gradient of the weights and, but for their last row, to that of ``x``; returns the loss."""
    z, row = x @ weights, np.arange(len(x))
    total = _exp(z, bound)
    loss = -float(np.log(np.maximum(z[row, wanted] / total[:, 0], 1e-30)).sum())
    z *= one / total
    z[row, wanted] -= one
    gradient += x.T @ z
    back += z @ weights[:-1].T
    return loss


def _sums(rows: np.ndarray, key: np.ndarray, size: int) -> np.ndarray:
    """Sum of the rows of each key below ``size``: of frequent keys by key, of the others by their first row, their second and so on."""
    order, count = np.argsort(key.astype(np.uint16), kind="stable"), np.bincount(key, minlength=size)
    begin = np.cumsum(count) - count
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    often = np.flatnonzero(count > OFTEN)
    for k, a, n in zip(often.tolist(), begin[often].tolist(), count[often].tolist(), strict=True):
        np.add.reduce(rows.take(order[a : a + n], axis=0), axis=0, out=out[k])
    few = np.flatnonzero((count > 0) & (count <= OFTEN))
    few = few[np.argsort(-count[few], kind="stable")]
    if len(few):
        begin, count = begin[few], -count[few]
        sums = rows.take(order[begin], axis=0)
        for i in range(1, -int(count[0])):
            n = int(np.searchsorted(count, -i, "left"))
            sums[:n] += rows.take(order[begin[:n] + i], axis=0)
        out[few] = sums
    return out


def _bound(weights: np.ndarray, base: np.ndarray) -> float:
    """What no logit of a state, whose numbers lie between -1 and 1, exceeds."""
    return float((np.abs(weights).sum(axis=-2) + base).max())


def _exp(x: np.ndarray, bound: float) -> np.ndarray:
    """exp of logits in place, over the greatest of each row where ``bound`` lets them be large; returns the rows' sums."""
    if bound > 40:
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    return x @ np.ones((x.shape[1], 1), x.dtype)


def _logsumexp(x: np.ndarray, bound: float = np.inf) -> np.ndarray:
    """Of each row; x is overwritten."""
    if bound <= 40:
        return np.log(_exp(x, bound)[:, 0])
    top = x.max(axis=1)
    return top + np.log(_exp(x, bound)[:, 0])


class Vocabulary:
    """Hot words: sorted hashes with symbol, log10 share in a class that has no softmax of its own, and count."""

    def __init__(self, h: np.ndarray, w: list[bytes], n: np.ndarray, total: int, types: int):
        order = np.argsort(h)
        self.h, self.n = h[order], n[order]
        self.begin = np.minimum(np.searchsorted(self.h, np.arange(1 << 20, dtype=np.uint64) << np.uint64(44)), max(0, len(h) - 1)).astype(np.int32)
        words = [w[i] or b" " for i in order]
        size = np.array([len(x) for x in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(size)
        real = self.h != END
        self.table = np.zeros((TRIGRAMS, CLUSTERS), np.float32)
        if real.any():
            self.table = _cluster_table(data, (ends - size)[real], ends[real], np.sqrt(self.n[real].astype(float)))
        cluster = spelled(self.table, data, ends - size, ends)
        self.symbol = OWN + cluster
        top = np.argsort(-np.where(real, self.n, 0), kind="stable")[: min(OWN, int(real.sum()))]
        self.symbol[top[:SINGLES]] = np.arange(min(SINGLES, len(top)))
        rest = top[SINGLES:]
        rest = rest[np.argsort(cluster[rest], kind="stable")]  # groups of like spelling, common words first
        self.symbol[rest] = SINGLES + np.arange(len(rest))
        self.symbol[~real] = END_SYMBOL
        self.mass = np.bincount(_CLASS[self.symbol], weights=self.n, minlength=CLASSES)
        self.members = np.bincount(self.symbol, weights=self.n, minlength=SYMBOLS)[SINGLES:OWN].reshape(GROUPS, MEMBERS)
        self.share = np.where(self.symbol < OWN, 0.0, np.log10(self.n / self.mass[_CLASS[self.symbol]]))
        self.floor = total + 0.1 * (types + 1)
        self.base = np.log10((self.n + 0.1) / self.floor)
        self.letters = Letters(data)
        places = self.letters.places(data, (ends - size)[real], ends[real], cluster[real])[:3]
        self.spelled = np.bincount(np.concatenate(places), minlength=Letters.SIZE)  # for the letter model, until the rare words are added

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(place in the vocabulary, whether it is that word)`` of each hash, by its upper bits and a few steps on."""
        if not len(self.h):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = self.begin[hashes >> np.uint64(44)]
        found = self.h[at]
        behind = np.flatnonzero(found < hashes)
        while len(behind):
            behind = behind[at[behind] + 1 < len(self.h)]
            at[behind] += 1
            found[behind] = self.h[at[behind]]
            behind = behind[found[behind] < hashes[behind]]
        return at, found == hashes

    def read(self, column: pa.Array, spell: bool = False):
        """``(symbols with ends, rows' offsets, hot places and rows, (rare hashes, clusters, spelling, rows))`` of texts."""
        low, starts, ends, first = _words(column)
        hashes = _text.word_hashes(low, starts, ends)
        at, hot = self.look_up(hashes)
        symbols = np.where(hot, self.symbol[at], 0) if len(self.h) else np.zeros(len(hashes), np.int64)
        rare = np.flatnonzero(~hot)
        cluster = spelled(self.table, low, starts[rare], ends[rare])
        symbols[rare] = OWN + CLUSTERS + cluster
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        words = np.insert(symbols.astype(np.int32), first[1:], END_SYMBOL)
        return words, first + np.arange(len(first)), at[hot], row[hot], (hashes[rare], cluster, self.letters.log10_of(low, starts[rare], ends[rare], cluster) if spell else None, row[rare])


def _groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold about GROUP_BYTES of text."""
    held, size = [], 0
    for batch in batches:
        for part in _text.slices(batch, limit=1 << 20):
            at = _text.offsets_of(part.column(column))
            held.append(part)
            size += int(at[-1] - at[0])
            if size >= GROUP_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _adapt(vocabulary: Vocabulary, network: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(np.ones(CLASSES))
        own.load(network.value.flat())
        tokens = 0
        for held in _groups(batches, 0):
            words = np.concatenate([vocabulary.value.read(x.column(0))[0] for x in held])
            own.learn_stream(words, 0.003)
            tokens += len(words)
        if tokens:
            flat = own.flat()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat.astype(np.float64) * tokens), pa.array(np.full(len(flat), float(tokens)))], ["i", "x", "n"])

    return run


def _start(docs: DataFrame, vocabulary) -> np.ndarray:
    """The words of the start sample: the texts of the first ids by hash, of as many as fit into START_BYTES.
    Ids and sizes are ranked first; texts of the chosen ids alone are read, one to an id."""
    size = F.octet_length("text")
    key = F.xxhash64(F.col("doc_id").cast("string"), F.lit("start"))
    ranked = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").where(size <= START_BYTES // 16).groupBy("doc_id", key.alias("key")).agg(F.max(size).alias("size"))
    ids, left = set(), START_BYTES
    for r in ranked.orderBy("key", "doc_id").limit(START_DOCS).collect():
        if r["size"] <= left:
            ids.add(r["doc_id"])
            left -= r["size"]
    if not ids:
        return np.zeros(0, np.int64)
    texts = docs.where(F.col("doc_id").isin(sorted(ids)) & (size <= START_BYTES // 16)).groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id").select("text").toArrow().combine_chunks()
    parts = [vocabulary.read(b.column(0))[0] for b in texts.to_batches() if b.num_rows]
    return np.concatenate(parts)


class Model:
    def __init__(self, vocabulary: Vocabulary, network: Network | None, unseen: np.ndarray, mass: np.ndarray, total: int, types: int):
        self.vocabulary, self.network, self.unseen, self.mass, self.total, self.types = vocabulary, network, unseen, mass, total, types


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of all rows of ``docs``, and ``(h, n)``, the counts of all words."""
    spark = docs.sparkSession
    counts = word_counts(docs)
    total, types = (int(x or 0) for x in counts.agg(F.sum("n"), F.count(F.lit(1))).first())
    # The least count that at most HOT words reach, from the (small) table of counts of counts.
    # Words seen once or twice are never hot: they stand for the words not seen.
    cut, reached = None, 0
    for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).toLocalIterator():
        reached += r["k"]
        if reached > HOT or r["n"] < LEAST_HOT:
            break
        cut = r["n"]
    hot = counts.where(F.col("n") >= (cut if cut is not None else 1 << 62)).select("h", F.substring("w", 1, SPELLED).alias("w"), "n").toArrow()
    vocabulary = Vocabulary(hot.column("h").to_numpy().view(np.uint64), hot.column("w").to_pylist(), hot.column("n").to_numpy(), total, types)
    bare = spark.sparkContext.broadcast((vocabulary.table, vocabulary.letters))

    def rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens and words seen once of each cluster (keys 0 and 1 a cluster), and the letter model's counts (from 2 * CLUSTERS on)."""
        table, letters = bare.value
        few, many = np.zeros(2 * CLUSTERS), np.zeros(letters.SIZE)
        held: list[np.ndarray] = []
        for batch in batches:
            data, at = _text.text_bytes(batch.column(0).cast(pa.binary()))
            k, n = spelled(table, data, at[:-1], at[1:]), batch.column(1).to_numpy()
            few[::2] += np.bincount(k, weights=n, minlength=CLUSTERS)
            few[1::2] += np.bincount(k, weights=n == 1, minlength=CLUSTERS)
            if len(k):
                held += letters.places(data, at[:-1], at[1:], k)[:3]
            if sum(map(len, held)) > 1 << 22:
                many += np.bincount(np.concatenate(held), minlength=letters.SIZE)
                held = []
        if held:
            many += np.bincount(np.concatenate(held), minlength=letters.SIZE)
        total = np.concatenate([few, many])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["k", "n"])

    rare = counts.where(F.col("n") < (cut if cut is not None else 1 << 62)).where(F.length("w") > 0).select("w", "n")
    sums = rare.mapInArrow(rare_words, "k long, n double").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    key, sums = sums.column("k").to_numpy(), sums.column("n").to_numpy()
    few = np.zeros(2 * CLUSTERS)
    few[key[key < len(few)]] = sums[key < len(few)]
    mass, once = few[::2], few[1::2]
    vocabulary.spelled[key[key >= len(few)] - len(few)] += sums[key >= len(few)].astype(np.int64)
    vocabulary.letters.learn(vocabulary.spelled)
    del vocabulary.spelled
    shared = spark.sparkContext.broadcast(vocabulary)
    unseen = np.clip((once + 0.5) / (mass + 1), 1e-6, 0.9)
    prior = vocabulary.mass + 0.5
    prior[SINGLES + GROUPS + CLUSTERS : SINGLES + GROUPS + 2 * CLUSTERS] += mass
    network = None
    if total:
        network = Network(prior, vocabulary.members)
        words = _start(docs, vocabulary)
        for rate in (0.01, 0.005, 0.003):
            network.learn_stream(words, rate, START_STREAMS)
        first = spark.sparkContext.broadcast(network)
        learned = docs.select("text").mapInArrow(_adapt(shared, first), "i long, x double, n double").groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x")).toArrow()
        if learned.num_rows:
            flat = np.zeros(learned.num_rows)
            flat[learned.column("i").to_numpy()] = learned.column("x").to_numpy()
            network.load(flat)
    return Model(vocabulary, network, unseen, mass, total, types), counts.select("h", "n")


_SCORED = "doc_id long, n_tokens long, hot_known long, hot_base double, hot_score double, rare array<struct<h: long, k: int, tf: int, s: float>>"


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` for each row of ``docs``."""
    spark = docs.sparkSession
    scratch.ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        v = m.vocabulary
        end, has_end = v.look_up(np.array([END]))
        end_base = float(v.base[end[0]]) if has_end[0] else float(np.log10(0.1 / v.floor))
        kind = pa.struct([("h", pa.int64()), ("k", pa.int32()), ("tf", pa.int32()), ("s", pa.float32())])
        for held in _groups(batches, 1):
            parts = [v.read(x.column(1), spell=True) for x in held]
            rows = np.array([x.num_rows for x in held])
            words = np.concatenate([p[0] for p in parts])
            base_at = np.cumsum([0, *[len(p[0]) for p in parts]])
            first = np.concatenate([*[p[1][:-1] + b for p, b in zip(parts, base_at, strict=False)], [base_at[-1]]])
            net = m.network.log10_of(words, first) if m.network else np.zeros(int(rows.sum()))
            done = 0
            for x, p in zip(held, parts, strict=True):
                _, at, hot, hot_row, (h, k, letters, row) = p
                n = x.num_rows
                size = np.diff(at)
                known = np.bincount(hot_row, minlength=n) + int(has_end[0])
                base = np.bincount(hot_row, weights=v.base[hot], minlength=n) + end_base
                share = np.bincount(hot_row, weights=v.share[hot], minlength=n) + net[done : done + n]
                done += n
                order = np.lexsort((h, row))
                h, k, letters, row = h[order], k[order], letters[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                edge = np.flatnonzero(new)
                tf = np.diff(np.append(edge, len(h)))
                to = np.searchsorted(row[edge], np.arange(n + 1))
                items = pa.StructArray.from_arrays([pa.array(_text.signed(h[edge])), pa.array(k[edge].astype(np.int32)), pa.array(tf.astype(np.int32)), pa.array(letters[edge].astype(np.float32))], fields=list(kind))
                rare = pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), items)
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array(size), pa.array(known), pa.array(base), pa.array(share), rare], ["doc_id", "n_tokens", "hot_known", "hot_base", "hot_score", "rare"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCORED)
    scored = scratch.materialize(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("rare").alias("x")).select("row", "x.h", "x.k", "x.tf", "x.s")
    # Counts of a hash are summed, should two words ever share one.
    n = F.coalesce("n", F.lit(0))
    share = F.lit(0.0)
    for k in range(CLUSTERS):
        seen = F.log10(n * F.lit(float((1 - model.unseen[k]) / max(model.mass[k], 1.0))))
        share = share + F.when(F.col("k") == k, F.when(n > 0, seen).otherwise(F.col("s") + F.lit(float(np.log10(model.unseen[k]))))).otherwise(0.0)
    terms = rare.join(counts.hint("merge"), "h", "left").select(
        "row",
        F.when(n > 0, F.col("tf")).otherwise(0).alias("known"),
        (F.col("tf") * F.log10((n + 0.1) / F.lit(float(model.vocabulary.floor)))).alias("base"),
        (F.col("tf") * share).alias("share"),
    )
    sums = terms.groupBy("row").agg(F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("share").alias("share"))
    out = scored.drop("rare").join(sums, "row", "left")
    base = F.col("hot_base") + F.coalesce("base", F.lit(0.0))
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("hot_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("hot_score") + F.coalesce("share", F.lit(0.0)) if model.network else base).alias("score"),
    )


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    part = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10, F.lit(1))
    model, counts = train(docs.where(part != 0))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    return score(docs, model, counts).withColumn("held_out", held).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
