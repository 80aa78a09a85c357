"""A gated recurrent language model with class-factored output, in numpy.

The vocabulary is all words of the training documents. The commonest `head` words have
vectors of their own and lie in classes by frequency; all others lie in classes by their
last two bytes. The network gives each class's probability, then, within a head class,
each word's; within a tail class a word has its share of the class's training tokens, less
what is held back for words never seen (as much as words seen once have). Known words and
one unseen word for each tail class thus sum to one.

Training is truncated backpropagation: streams of whole documents are read in windows, the
state carried from window to window and cleared where a document begins. Blocks of documents
are dealt into groups of some MB by a hash, whatever tasks there are. The first few blocks
warm the network up; then, in ROUNDS rounds, every group of a round trains from
the average of the round before on its own blocks, one after another. Gradients are taken on
all training documents, as are counts, classes and shares.
Scoring reads every document whole, many abreast, each carrying its state to its end.

Words are known by 48 hash bits and their last two bytes; their counts meet in buckets of
packed arrays, so no task needs the vocabulary. Texts are split once, and travel as
compressed blocks of their words' numbers.

Cases: null and empty texts are one end token; a null id counts as the empty text when
documents are held out. Without training documents all words are unseen and the network
stays as it begins. Repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, crc_mod, delete, packed, raw, scratch, ship, shuffles_deleted, slices, starts, table, text_bytes, unpacked
from .substrings import mix, word_hashes

HEAD, PER_CLASS, TAIL, HIDDEN = 2000, 50, 88, 32
STREAMS, STEPS, RATE = 256, 16, 0.01
#: rows of the output layer that are computed at a time
PIECE = 1024
#: numbers that the optimiser takes at a time; rows of a key that are summed together with those of others
ADAM_PIECE, FEW = 1 << 15, 16
BUCKET_BYTES, BLOCK_BYTES = 16 << 20, 6 << 20
#: text that a group learns from on average, and that warms up; rounds of groups
GROUP_BYTES, WARM_BLOCKS, ROUNDS = 32 << 20, 3, 2
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: the end token's key, which no word has
END = np.uint64(0)


def word_keys(w: Words) -> np.ndarray:
    """48 hash bits and the last two bytes of every word."""
    if not w.n:
        return np.zeros(0, np.uint64)
    last = w.packed[w.offsets[1:] - 1].astype(np.uint64)
    before = np.where(np.diff(w.offsets) > 1, w.packed[np.maximum(w.offsets[1:] - 2, 0)], 0).astype(np.uint64)
    return (word_hashes(w) & np.uint64(0xFFFFFFFFFFFF0000)) | before << np.uint64(8) | last


class Coded:
    """The words of a batch of lower-cased texts: token i is distinct word codes[i], whose key is keys[codes[i]]; text d has tokens first[d] to first[d + 1].

    Keys are made, and looked up, once for each distinct word."""

    def __init__(self, texts: pa.Array):
        w = Words(texts, lower=True)
        self.first, self.n = w.first, w.n
        self.codes, distinct = w.coded()
        distinct_words = Words.__new__(Words)
        distinct_words.packed, distinct_words.offsets = raw(distinct)
        distinct_words.n = len(distinct)
        self.keys = word_keys(distinct_words)


class Block:
    """Documents as numbers, which later passes read instead of splitting texts again: document d has tokens first[d] to first[d + 1], token i is distinct word codes[i], whose key is keys[codes[i]]."""

    def __init__(self, data: bytes):
        row = unpacked(data)
        self.doc_id, self.held_out, n, codes, keys = (row.column(i).values for i in range(5))
        self.first = np.concatenate([[0], np.cumsum(n.to_numpy())])
        self.codes, self.keys = codes.to_numpy(), keys.to_numpy()

    @staticmethod
    def packed(docs: pa.RecordBatch, w: Coded) -> bytes:
        # most blocks have fewer than 65,536 distinct words
        codes = w.codes.astype(np.uint16 if len(w.keys) <= 1 << 16 else np.int32)
        columns = [docs.column("doc_id"), docs.column("held_out"), pa.array(np.diff(w.first)), pa.array(codes), pa.array(w.keys)]
        return packed(pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in columns], ["doc_id", "held_out", "n", "codes", "keys"]))


# --- the network ---------------------------------------------------------------------


@dataclass
class Vocabulary:
    """Head words by key, classes, and what tail words share; N and V as counted."""

    keys: np.ndarray
    order: np.ndarray
    tail_of: np.ndarray
    mass: np.ndarray
    unseen: np.ndarray
    tokens: int
    types: int
    class_bias: np.ndarray
    word_bias: np.ndarray
    head_classes: int

    @staticmethod
    def build(head: list[tuple[int, int]], suffixes: np.ndarray, tokens: int, types: int, most: int = HEAD) -> Vocabulary:
        """From (key, count) of the commonest words, and rows (suffix, tokens, types, singles) over all words."""
        n = len(head)
        keys = np.array([k for k, _ in head], np.uint64)
        count = np.array([c for _, c in head], float)
        stats = np.zeros((65536, 3))
        if len(suffixes):
            stats[suffixes[:, 0]] = suffixes[:, 1:]
        own = (keys & np.uint64(0xFFFF)).astype(int)
        np.subtract.at(stats, own, np.stack([count, np.ones(n), (count == 1).astype(float)], axis=1).reshape(-1, 3))
        ranked = np.lexsort((np.arange(65536), -stats[:, 0]))[: TAIL - 1]
        tail_of = np.full(65536, TAIL - 1, np.int64)
        tail_of[ranked] = np.arange(len(ranked))
        total = np.zeros((TAIL, 3))
        np.add.at(total, tail_of, stats)
        # a class without training tokens is all unseen words
        unseen = np.where(total[:, 0] > 0, (total[:, 2] + 1) / (total[:, 0] + 2), 1.0)
        unseen = np.minimum(unseen, np.where(total[:, 0] > 0, 0.9, 1.0))
        classes = -(-most // PER_CLASS)
        mass = np.zeros(classes)
        np.add.at(mass, np.arange(n) // PER_CLASS, count)
        bias = np.log(np.concatenate([mass, total[:, 0]]) + 1.0)
        word = np.full(classes * PER_CLASS, -30.0)
        word[:n] = np.log(count)
        # a head class that the corpus does not fill has no words, and must have no probability
        bias[:classes][mass == 0] = -30.0
        return Vocabulary(np.sort(keys), np.argsort(keys), tail_of, total[:, 0], unseen, tokens, types, bias.astype(np.float32), word.astype(np.float32), classes)

    def ids(self, keys: np.ndarray) -> np.ndarray:
        """Head words by rank; tail words as their class, after all head places."""
        out = self.head_classes * PER_CLASS + self.tail_of[(keys & np.uint64(0xFFFF)).astype(np.int64)]
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            out = np.where(self.keys[at] == keys, self.order[at], out)
        return out

    def within(self, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Log probability of tail words in their classes; 0 for head words."""
        tail = ids - self.head_classes * PER_CLASS
        out = np.zeros(len(ids))
        at = np.flatnonzero(tail >= 0)
        k = tail[at]
        with np.errstate(divide="ignore"):
            out[at] = np.where(count[at] > 0, np.log1p(-np.minimum(self.unseen[k], 1 - 1e-12)) + np.log(np.maximum(count[at], 1)) - np.log(np.maximum(self.mass[k], 1)), np.log(self.unseen[k]))
        return out


@dataclass
class Network:
    head_classes: int
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def new(v: Vocabulary, hidden: int = HIDDEN, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        places, classes = v.head_classes * PER_CLASS, v.head_classes + TAIL
        draw = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        w = {"x": draw(places + TAIL, 3 * hidden), "u": draw(hidden, 3 * hidden), "b": np.zeros(3 * hidden, np.float32), "c": draw(hidden, classes) * np.float32(0.1), "cb": v.class_bias.copy(), "w": draw(places, hidden) * np.float32(0.1), "wb": v.word_bias.copy()}
        w["b"][:hidden] = 1.0  # states are kept at first
        return Network(v.head_classes, w)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.weights[k].ravel() for k in sorted(self.weights)])

    def filled(self, flat: np.ndarray) -> Network:
        out, at = {}, 0
        for k in sorted(self.weights):
            size = self.weights[k].size
            out[k] = flat[at : at + size].reshape(self.weights[k].shape).astype(np.float32)
            at += size
        return Network(self.head_classes, out)

    def stepper(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """A function of tokens and states that gives the states behind them, while the weights stay as they are."""
        n = self.weights["u"].shape[0]
        tables, parts = ([np.ascontiguousarray(x[:, k * n : (k + 1) * n]) for k in range(3)] for x in self.halved())

        def step(token: np.ndarray, h: np.ndarray) -> np.ndarray:
            z, r, new = (x.take(token, axis=0) for x in tables)
            for gate, part in ((z, parts[0]), (r, parts[1])):
                gate += h @ part
                np.tanh(gate, out=gate)
                gate *= 0.5
                gate += 0.5
            r *= h @ parts[2]
            new += r
            np.tanh(new, out=new)
            out = h - new
            out *= z
            out += new
            return out

        return step

    def halved(self) -> tuple[np.ndarray, np.ndarray]:
        """What words and states add to both gates and the new state; for gates half of it, of which their sigmoid is a tanh."""
        u = self.weights["u"]
        half = np.repeat(np.array([0.5, 0.5, 1], u.dtype), len(u))
        table = self.weights["x"] + self.weights["b"]
        table *= half
        return table, u * half

    def outputs(self) -> tuple[np.ndarray, float, np.ndarray, float]:
        """Weights from states and a one, which takes the bias, to classes and, for each head class, to its words; and their reach."""
        w = self.weights
        inside, bias = w["w"].reshape(self.head_classes, PER_CLASS, -1), w["wb"].reshape(self.head_classes, PER_CLASS, 1)
        to_class = np.concatenate([w["c"], (w["cb"] - w["cb"].max())[None]])
        return to_class, reach(w["c"], 0), np.concatenate([inside, bias - bias.max(axis=1, keepdims=True)], axis=2), reach(w["w"], 1)

    def kinds(self, target: np.ndarray) -> np.ndarray:
        places = self.head_classes * PER_CLASS
        return np.where(target < places, target // PER_CLASS, self.head_classes + target - places)

    def log_probability(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log probability of each target's class, and within it of a head word."""
        to_class, far, to_word, far_inside = self.outputs()
        kind, out = self.kinds(target), np.empty(len(target))
        h = np.concatenate([h, np.ones((len(h), 1), h.dtype)], axis=1)
        for i in range(0, len(kind), PIECE):
            out[i : i + PIECE] = softmax(h[i : i + PIECE] @ to_class, far, kind[i : i + PIECE])[0]
        order, cut = by_class(kind, self.head_classes)
        out[order] += softmax(by_words(h[order], to_word, cut), far_inside, target[order] % PER_CLASS)[0]
        return out

    def gradients(self, token: np.ndarray, target: np.ndarray, h: np.ndarray, end: int) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Mean loss over a window (steps x streams), its gradients, and the state at its end. The state is cleared before an end token."""
        w, n = self.weights, h.shape[1]
        steps, streams = token.shape
        size, kind_of = steps * streams, w["u"].dtype
        table, u = self.halved()
        # a step's gates and states are tables of units x streams, so that any of them side by side are unbroken memory
        to_gates, to_new = (np.ascontiguousarray(x.T) for x in (u[:, : 2 * n], u[:, 2 * n :]))
        carried = (token != end).astype(kind_of)
        gates, rows = np.empty((steps, 3 * n, streams), kind_of), np.empty((steps, streams, 3 * n), kind_of)
        before, hu, states = (np.empty((steps, n, streams), kind_of) for _ in range(3))
        work, moved = np.empty((3 * n, streams), kind_of), np.empty((n, streams), kind_of)
        h = h.T
        for t in range(steps):
            gates[t] = table.take(token[t], axis=0).T
            np.multiply(h, carried[t], out=before[t])
            both, new = gates[t, : 2 * n], gates[t, 2 * n :]
            both += np.matmul(to_gates, before[t], out=work[: 2 * n])
            np.tanh(both, out=both)
            both *= 0.5
            both += 0.5
            new += np.multiply(both[n:], np.matmul(to_new, before[t], out=hu[t]), out=moved)
            np.tanh(new, out=new)
            h = np.subtract(before[t], new, out=states[t])
            h *= both[:n]
            h += new
        flat = np.ones((size, n + 1), kind_of)
        flat.reshape(steps, streams, n + 1)[:, :, :n] = states.transpose(0, 2, 1)
        goal = target.ravel()
        kind, scale = self.kinds(goal), kind_of.type(1 / size)
        to_class, far, to_word, far_inside = self.outputs()
        back, out_of_class, g_class, loss = np.empty((size, n), kind_of), np.ascontiguousarray(w["c"].T), np.zeros_like(to_class), 0.0
        for i in range(0, size, PIECE):  # pieces that stay in a processor's cache
            own, part = flat[i : i + PIECE], back[i : i + PIECE]
            logit = own @ to_class
            log_p, share = softmax(logit, far, kind[i : i + PIECE], scale)
            loss -= log_p.sum()
            g_class += (own * share).T @ logit
            np.matmul(logit, out_of_class, out=part)
            part *= share
        order, cut = by_class(kind, self.head_classes)
        own, g_word, pull = flat[order], np.zeros_like(to_word), np.empty((len(order), n), kind_of)
        inner = by_words(own, to_word, cut)
        log_p, share = softmax(inner, far_inside, goal[order] % PER_CLASS, scale)
        loss -= log_p.sum()
        own *= share
        for k in np.flatnonzero(np.diff(cut)).tolist():
            i, j = cut[k], cut[k + 1]
            np.matmul(inner[i:j].T, own[i:j], out=g_word[k])
            np.matmul(inner[i:j], w["w"][k * PER_CLASS : (k + 1) * PER_CLASS], out=pull[i:j])
        pull *= share
        back[order] += pull
        back = np.ascontiguousarray(back.reshape(steps, streams, n).transpose(0, 2, 1))
        later, rest, g_u = np.zeros((n, streams), kind_of), np.empty((2 * n, streams), kind_of), np.zeros_like(u)
        d_z, d_r, d_new = work[:n], work[n : 2 * n], work[2 * n :]
        for t in range(steps - 1, -1, -1):
            both, new, d = gates[t, : 2 * n], gates[t, 2 * n :], back[t]
            z, r = both[:n], both[n:]
            d += later
            np.subtract(1, both, out=rest)
            rest[:n] *= d
            rest[n:] *= r
            np.multiply(new, new, out=d_new)
            np.subtract(1, d_new, out=d_new)
            d_new *= rest[:n]
            np.subtract(before[t], new, out=d_z)
            d_z *= z
            d_z *= rest[:n]
            np.multiply(d_new, hu[t], out=d_r)
            d_r *= rest[n:]
            rows[t] = work.T
            d_new *= r
            g_u += before[t] @ work.T
            np.matmul(w["u"], work, out=later)
            d *= z
            later += d
            later *= carried[t]
        g = {"u": g_u, "c": g_class[:n], "cb": g_class[n], "wb": g_word[:, :, n].ravel()}
        g["w"] = np.ascontiguousarray(g_word[:, :, :n]).reshape(-1, n)
        g["x"] = row_sums(token.ravel(), rows.reshape(size, 3 * n), len(w["x"]))
        g["b"] = g["x"].sum(axis=0)
        return float(loss / size), g, np.ascontiguousarray(h.T)


def reach(weights: np.ndarray, axis: int) -> float:
    """How far from their biases logits can lie, as states lie within 1."""
    return float(np.abs(weights).sum(axis=axis).max(initial=0))


def softmax(logit: np.ndarray, far: float, target: np.ndarray, scale: np.floating | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probability of each row's target, where the logits without their biases (of which the largest is 0) lie within `far`. If scale is given, logit becomes a matrix that, times the second result by rows, is the loss's gradient times scale."""
    every = np.arange(len(target))
    if far > 40:  # exponentials of rows that lie lower or higher might not be numbers
        logit -= logit.max(axis=1, keepdims=True)
    out = logit[every, target].astype(np.float64)
    np.exp(logit, out=logit)
    total = logit @ np.ones(logit.shape[1], logit.dtype)
    out -= np.log(total)
    if scale is None:
        return out, None
    logit[every, target] -= total
    return out, (scale / total)[:, None]


def by_words(own: np.ndarray, to_word: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Logits of the words of each row's class, where rows cut[k] to cut[k + 1] have class k."""
    out = np.empty((len(own), to_word.shape[1]), own.dtype)
    for k in np.flatnonzero(np.diff(cut)).tolist():
        np.matmul(own[cut[k] : cut[k + 1]], to_word[k].T, out=out[cut[k] : cut[k + 1]])
    return out


def row_sums(key: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each key, of n."""
    key, out = narrow(key), np.zeros((n, rows.shape[1]), rows.dtype)
    order = np.argsort(key, kind="stable")
    some, cut = starts(key[order])
    begin, count = np.array(cut[:-1], np.int64), np.diff(cut)
    # keys of few rows together, the first row of each, then the second, and so on; those of many by themselves
    few = np.flatnonzero(count <= FEW)
    few = few[np.argsort(-count[few], kind="stable")]
    more = np.searchsorted(-count[few], -np.arange(1, FEW + 1), "right").tolist()
    total = np.zeros((len(few), rows.shape[1]), rows.dtype)
    for k, m in enumerate(more):
        if not m:
            break
        total[:m] += rows.take(order[begin[few[:m]] + k], axis=0)
    out[some[few]] = total
    ones = np.ones(len(key), rows.dtype)
    for k in np.flatnonzero(count > FEW).tolist():
        i, j = cut[k], cut[k + 1]
        np.matmul(ones[i:j], rows.take(order[i:j], axis=0), out=out[some[k]])
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """Small numbers in two bytes, which are sorted by counting."""
    return x.astype(np.int16) if x.max(initial=0) < 1 << 15 else x


def by_class(kind: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the first `classes` classes, one class after another, and where each begins."""
    kind = narrow(kind)
    order = np.argsort(kind, kind="stable")
    cut = np.searchsorted(kind[order], np.arange(classes + 1, dtype=kind.dtype))
    return order[: cut[-1]], cut


class Adam:
    def __init__(self):
        self.t, self.m, self.v = 0, {}, {}

    def update(self, w: dict[str, np.ndarray], g: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float(np.vdot(x, x)) for x in g.values())))
        clip = min(1.0, 1.0 / (norm + 1e-12))
        # m is kept 10 times as large as the mean, and v 100 times as large as that of squares, which saves passes
        root = (0.01 / (1 - 0.99**self.t)) ** 0.5
        size, least = 0.1 * rate / (1 - 0.9**self.t) / root, 1e-7 / root
        for k, whole in g.items():
            if k not in self.m:
                self.m[k], self.v[k] = (np.zeros(whole.size, whole.dtype) for _ in range(2))
            for i in range(0, whole.size, ADAM_PIECE):
                part = slice(i, i + ADAM_PIECE)
                x, m, v = whole.reshape(-1)[part], self.m[k][part], self.v[k][part]
                if clip < 1:
                    x *= clip
                m *= 0.9
                m += x
                x *= x
                v *= 0.99
                v += x
                np.sqrt(v, out=x)
                x += least
                np.divide(m, x, out=x)
                x *= size
                w[k].reshape(-1)[part] -= x


def train(net: Network, stream: np.ndarray, end: int, streams: int = STREAMS, steps: int = STEPS, rate: float = RATE, adam: Adam | None = None, span: tuple[float, float] = (0.0, 1.0)) -> tuple[Network, list[float]]:
    """Truncated backpropagation over a stream of ids, in which each document begins with the end token. The stream may be one of several that one optimiser takes: `span` is its part of them all."""
    net = Network(net.head_classes, {k: x.copy() for k, x in net.weights.items()})
    streams = max(1, min(streams, (len(stream) - 1) // (4 * steps)))
    size = -(-(len(stream) - 1) // streams)
    if size < 1:
        return net, []
    # streams are of one length: what the last lacks is read from the beginning
    stream = np.concatenate([stream, stream[1 : size * streams + 2 - len(stream)]])
    token = stream[: size * streams].reshape(streams, size).T
    target = stream[1 : size * streams + 1].reshape(streams, size).T
    adam, h, losses = adam or Adam(), np.zeros((streams, net.weights["u"].shape[0]), np.float32), []
    for t in range(0, size, steps):
        loss, g, h = net.gradients(token[t : t + steps], target[t : t + steps], h, end)
        adam.update(net.weights, g, rate * (1 - 0.8 * (span[0] + (span[1] - span[0]) * t / size)))
        losses.append(loss)
    return net, losses


def score_documents(net: Network, ids: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """Log probability (without tail words' shares) of each document's words and its end; document d has ids[first[d]:first[d + 1]]."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    length, begin, step = n[order], first[:-1][order], net.stepper()
    out = np.zeros(len(n))
    h = np.zeros((len(n), net.weights["u"].shape[0]), np.float32)
    # at place t, documents active[t] are read, of which active[t + 1] have a word there and the others end
    active = np.searchsorted(-length, -np.arange(-1, int(length.max(initial=-1)) + 1), "left").tolist()
    held, rows, goals, size = [], [], [], 0

    def flush() -> None:
        nonlocal held, rows, goals, size
        if held:
            got = net.log_probability(np.concatenate(held), np.concatenate(goals))
            out[:] += np.bincount(np.concatenate(rows), got, len(n))
        held, rows, goals, size = [], [], [], 0

    for t in range(len(active) - 1):
        k, more = active[t], active[t + 1]
        token = ids[begin[:k] + t - 1] if t else np.full(k, end)
        goal = np.full(k, end)
        goal[:more] = ids[begin[:more] + t]
        h = step(token, h[:k])
        held.append(h)
        rows.append(order[:k])
        goals.append(goal)
        size += k
        if size >= 16384:
            flush()
    flush()
    return out


# --- Spark ---------------------------------------------------------------------------


def _blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """kind 0: a block's documents, as numbers; kind 1: for a bucket, the keys in a block and their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 24
        for nth, b in enumerate(slices(batches, most=BLOCK_BYTES)):
            w = Coded(b.column("text"))
            learned = ~b.column("held_out").to_numpy(zero_copy_only=False)
            # two words may have one key
            keys, inverse = np.unique(w.keys, return_inverse=True)
            count = np.bincount(w.codes, np.repeat(learned, np.diff(w.first)), len(w.keys))
            count = np.bincount(inverse, count, len(keys)).astype(np.int64)
            keys, count = np.append(END, keys), np.append(int(learned.sum()), count)
            bucket = (mix(keys) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            some, cut = starts(bucket[order])
            data = [np.stack([keys[o].view(np.int64), count[o]]).tobytes() for o in (order[i:j] for i, j in zip(cut[:-1], cut[1:]))]
            block = np.full(len(some) + 1, part + nth)
            yield pa.RecordBatch.from_arrays([pa.array([0] + [1] * len(some), pa.int32()), pa.array(block), pa.array([-1, *some.tolist()], pa.int64()), pa.array([Block.packed(b, w), *data], pa.binary())], ["kind", "block", "bucket", "data"])

    return docs.mapInArrow(run, "kind int, block long, bucket long, data binary")


def _meet(key, group):
    """One bucket: every block's keys with their counts over all blocks, suffix totals, and the commonest words."""
    parts = [np.frombuffer(x.as_py(), np.int64).reshape(2, -1) for x in group.column("data")]
    every, count = np.concatenate(parts, axis=1)
    keys, inverse = np.unique(every.view(np.uint64), return_inverse=True)
    total = np.bincount(inverse, count, len(keys)).astype(np.int64)
    of = total[inverse]
    rows, at = [], 0
    for block, p in zip(group.column("block").to_pylist(), parts):
        rows.append((0, block, 0, 0, 0, 0, np.stack([p[0], of[at : at + p.shape[1]]]).tobytes()))
        at += p.shape[1]
    seen = np.flatnonzero(total)
    suffix = (keys[seen] & np.uint64(0xFFFF)).astype(np.int64)
    stats = [np.bincount(suffix, x, 65536).astype(np.int64) for x in (total[seen], np.ones(len(seen)), total[seen] == 1)]
    rows += [(1, 0, s, *(int(x[s]) for x in stats), b"") for s in np.flatnonzero(stats[0]).tolist()]
    top = seen[np.argsort(-total[seen], kind="stable")[:HEAD]]
    rows += [(2, 0, int(keys[i].view(np.int64)), int(total[i]), 0, 0, b"") for i in top.tolist()]
    kinds = [pa.int32(), *[pa.int64()] * 5, pa.binary()]
    return pa.table({n: pa.array([r[k] for r in rows], kinds[k]) for k, n in enumerate(("kind", "block", "a", "b", "c", "d", "data"))})


def _by_kind(df: DataFrame) -> tuple[dict[int, DataFrame], str]:
    """df as a table in the shared folder, split by kind, so that each kind is read alone; and where it is."""
    path = scratch(df.sparkSession)
    with shuffles_deleted(df.sparkSession):
        df.write.partitionBy("kind").parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    return {k: read.where(F.col("kind") == k).drop("kind") for k in range(3)}, path


def _replies(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    keys, count = np.concatenate([np.frombuffer(x, np.int64).reshape(2, -1) for x in data], axis=1)
    order = np.argsort(keys.view(np.uint64))
    return keys.view(np.uint64)[order], count[order]


def learn(blobs: DataFrame, vocabulary: Vocabulary, groups: int, chunks: int = 16, fan: int = 32) -> Network:
    """The network's weights: a warm start from some blocks, then the average of what groups of blocks learn from there, round by round."""
    net = Network.new(vocabulary)
    spark = blobs.sparkSession
    end = int(vocabulary.ids(np.array([END], np.uint64))[0])
    schema = "chunk int, part long, data binary, weight double"

    def taught(start: Network, rate: float) -> Callable:
        shared = spark.sparkContext.broadcast((vocabulary, start))  # of one size at any input

        def run(key, group):
            v, net = shared.value
            adam, weight, order = Adam(), 0.0, np.argsort(group.column("block").to_numpy())
            for k, i in enumerate(order.tolist()):
                w = Block(group.column("data")[i].as_py())
                ids = v.ids(w.keys)[w.codes]
                learned = np.flatnonzero(~w.held_out.to_numpy(zero_copy_only=False))
                stream = np.concatenate([x for d in learned.tolist() for x in ([end], ids[w.first[d] : w.first[d + 1]])] + [[end]]).astype(np.int64)
                if len(stream) > 1:
                    net, weight = train(net, stream, end, rate=rate, adam=adam, span=(k / len(order), (k + 1) / len(order)))[0], weight + len(stream)
            parts = [p.tobytes() for p in np.array_split(net.flat() * np.float64(weight), chunks)] if weight else []
            n = len(parts)
            return pa.table({"chunk": pa.array(range(n), pa.int32()), "part": pa.array([key[0].as_py()] * n, pa.int64()), "data": pa.array(parts, pa.binary()), "weight": pa.array([weight] * n, pa.float64())})

        return run

    def add(key, group):
        data = sum(np.frombuffer(x.as_py(), np.float64) for x in group.column("data"))
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), "data": pa.array([data.tobytes()], pa.binary()), "weight": pa.array([float(np.sum(group.column("weight").to_numpy()))])})

    def averaged(df: DataFrame, start: Network, rate: float) -> Network:
        with shuffles_deleted(spark):
            sums, left = df.groupBy("part").applyInArrow(taught(start, rate), schema), groups
            while True:  # a tree: no task adds up more than `fan` parts, however many groups have learned
                sums = sums.withColumn("part", F.floor(F.col("part") / fan)).groupBy("chunk", "part").applyInArrow(add, schema)
                left = -(-left // fan)
                if left <= 1:
                    break
            rows = sorted((r.chunk, r.weight, bytes(r.data)) for r in sums.collect())
        return start.filled(np.concatenate([np.frombuffer(d, np.float64) / w for _, w, d in rows])) if rows else start

    dealt = blobs.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(groups)))
    first = [r[0] for r in blobs.select("block").orderBy("block").limit(WARM_BLOCKS).collect()]
    net = averaged(dealt.where(F.col("block").isin(first)).withColumn("part", F.lit(0).cast("long")), net, RATE)
    for k in range(min(ROUNDS, groups)):
        net = averaged(dealt.where(F.col("part") % ROUNDS == k), net, RATE / 2)
    return net


def score(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Scores of every row of doc_id, text, held_out; only rows that are not held out are learned from."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "held_out")
    size = text_bytes(docs)
    parts, path = _by_kind(_blocks(docs, max(8, size // bucket_bytes)))
    blobs = parts[0].select("block", "data")
    met, _ = _by_kind(parts[1].groupBy("bucket").applyInArrow(_meet, "kind int, block long, a long, b long, c long, d long, data binary"))
    delete(spark, f"{path}/kind=1")  # asked and answered
    suffix = met[1].groupBy("a").agg(*(F.sum(c).alias(c) for c in "bcd")).collect()  # at most 65,536 rows
    head = [(r.a % (1 << 64), r.b) for r in met[2].orderBy(F.desc("b"), "a").limit(HEAD).collect()]
    stats = np.array([(r.a, r.b, r.c, r.d) for r in suffix], np.int64).reshape(-1, 4)
    vocabulary = Vocabulary.build(head, stats, int(stats[:, 1].sum()), int(stats[:, 2].sum()))
    net = learn(blobs, vocabulary, max(1, size // GROUP_BYTES))
    shared = spark.sparkContext.broadcast((vocabulary, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, net = shared.value
        end = int(v.ids(np.array([END], np.uint64))[0])
        for b in batches:
            for blob, replies in zip(b.column("data"), b.column("replies")):
                known, total = _replies(replies.as_py())
                w = Block(blob.as_py())
                count = total[np.searchsorted(known, w.keys)]
                of_end = int(total[np.searchsorted(known, END)])
                ids = v.ids(w.keys)
                log_base = np.log10((count + 1) / (v.tokens + v.types + 1))
                end_base = np.log10((of_end + 1) / (v.tokens + v.types + 1))
                n = np.diff(w.first)
                add = lambda x, per: np.diff(np.concatenate([[0.0], np.cumsum(x[w.codes])])[w.first]) + per
                end_within = float(v.within(np.array([end]), np.array([of_end]))[0])
                found = (score_documents(net, ids[w.codes], w.first, end) + add(v.within(ids, count), end_within)) / np.log(10)
                known_n = np.diff(np.concatenate([[0], np.cumsum((count > 0)[w.codes])])[w.first]) + (of_end > 0)
                yield pa.RecordBatch.from_arrays([w.doc_id, w.held_out, pa.array(n + 1), pa.array(known_n), pa.array(np.full(len(n), v.tokens)), pa.array(add(log_base, end_base)), pa.array(found)], [x.split()[0] for x in RESULT.split(", ")])

    # one row a block on either side
    gathered = met[0].groupBy("block").agg(F.collect_list("data").alias("replies"))
    return blobs.join(gathered, "block").select("data", "replies").mapInArrow(run, RESULT)


def op2_recurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs.select("doc_id", "text", (crc_mod("doc_id", 7) == 2).alias("held_out")))
