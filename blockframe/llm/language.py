"""Language identification by error-correcting output codes.

Every language has a codeword; one binary n-gram classifier predicts each of its bits
from hashed byte n-grams within words. A text's margins are decoded by loss weighting:
the language whose codeword costs the least logistic loss, each bit weighted by its
accuracy in training, wins. The text is flagged ambiguous when the next codeword's loss is
so near that the two differ by less than MARGIN of their sum: for texts of one language it
is nearly all of it, for halves of two some 0.6. Classifiers are fitted on at most `per_language` distinct texts of each
language, those with the smallest hashes; the bound is a parameter. Copies of a text count
once, so that they neither fill the sample nor keep others out. Everything else covers all rows.

Cases: null texts, empty ones and those without a letter are `und` with score 0. Null
languages are not learned from. With no or one language to learn, that answer is given to
every text with a letter (`und` if none). Repeated rows are predicted alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, Words, crc_mod, ship, slices, table

PER_LANGUAGE, DIMS, BITS, ORDERS, MARGIN = 1000, 1 << 12, 24, (1, 2, 3), 0.85
_LETTER = regex.compile(r"\p{L}")
RESULT = "doc_id long, lang_pred string, score double, ambiguous boolean, runner_up string"


def gram_rows(vocab: pa.Array, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams (n of ORDERS, over bytes with a mark at either end) of each distinct word: ids and offsets."""
    n = len(vocab)
    if not n:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    _, offs, data = vocab.buffers()
    offs = np.frombuffer(offs, np.int32)[vocab.offset : vocab.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    length = np.diff(offs)
    at = offs[:-1] - offs[0] + 2 * np.arange(n)
    marked = np.zeros(int(length.sum()) + 2 * n, np.uint64)
    marked[np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, length)] = LOWER[data]
    ends = at + length + 2
    word = np.repeat(np.arange(n), length + 2)
    out_id, out_word = [], []
    for order in ORDERS:
        key = np.full(len(marked) - order + 1, order, np.uint64)
        for k in range(order):
            key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ (marked[k : len(marked) - order + 1 + k] + np.uint64(1))
        inside = np.arange(len(key)) + order <= ends[word[: len(key)]]
        mixed = (key * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - int(dims).bit_length() + 1)
        out_id.append(mixed[inside].astype(np.int64))
        out_word.append(word[: len(key)][inside])
    ids, words = np.concatenate(out_id), np.concatenate(out_word)
    order = np.argsort(words, kind="stable")
    return ids[order], np.searchsorted(words[order], np.arange(n + 1))


def features(texts: pa.Array, dims: int = DIMS) -> np.ndarray:
    """Relative n-gram frequencies of each text, scaled to unit length."""
    w = Words(texts)
    codes, vocab = w.coded()
    ids, offs = gram_rows(vocab, dims)
    out = np.zeros((len(texts), dims), np.float32)
    for d in range(len(texts)):
        own, times = np.unique(codes[w.first[d] : w.first[d + 1]], return_counts=True)
        if len(own):
            length = offs[own + 1] - offs[own]
            at = np.repeat(offs[own] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
            out[d] = np.sqrt(np.bincount(ids[at], np.repeat(times, length), dims))
            out[d] /= np.linalg.norm(out[d])
    return out


def codewords(n: int, bits: int = BITS, seed: int = 7) -> np.ndarray:
    """n codewords of +1/-1, far apart: one-against-rest bits first, then random splits, the best of many draws."""
    own = np.where(np.eye(n, dtype=bool), 1, -1)
    if n < 3:
        return own
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(200):
        extra = rng.choice([-1, 1], (n, max(0, bits - n)))
        extra = extra[:, np.abs(extra.sum(axis=0)) < n]
        code = np.hstack([own, extra])
        near = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        if near > far:
            best, far = code, near
    return best


class Model:
    """Languages, their codewords, and a weight vector and reliability for each bit."""

    def __init__(self, x: np.ndarray, labels: list[str], steps: int = 120, rate: float = 8.0, decay: float = 1e-5):
        self.languages = sorted(set(labels))
        y = np.array([self.languages.index(v) for v in labels], int)
        self.code = codewords(len(self.languages))
        self.weights = np.zeros((x.shape[1], self.code.shape[1]), np.float32)
        self.bias = np.zeros(self.code.shape[1], np.float32)
        self.trust = np.ones(self.code.shape[1], np.float32)
        if len(self.languages) < 2:
            return
        target = ((self.code[y] + 1) / 2).astype(np.float32)
        # rows weigh so that each language counts alike
        row = (1 / np.bincount(y)[y] / len(self.languages)).astype(np.float32)[:, None]
        speed = np.zeros_like(self.weights)
        for _ in range(steps):  # full-batch logistic regression with momentum
            error = (1 / (1 + np.exp(-(x @ self.weights + self.bias))) - target) * row
            speed = 0.9 * speed - rate * (x.T @ error + decay * self.weights)
            self.weights += speed
            self.bias -= rate * error.sum(axis=0)
        right = (((x @ self.weights + self.bias) > 0) == (target > 0.5)) * row
        accuracy = np.clip(right.sum(axis=0), 0.5, 0.999)
        self.trust = np.log(accuracy / (1 - accuracy)).astype(np.float32)
        self.trust /= self.trust.sum() or 1

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nearest language, next nearest, the share of belief of the nearest, and whether the two are nearly as near."""
        loss = np.stack([(np.logaddexp(0, -margins * c) * self.trust).sum(axis=1) for c in self.code], axis=1)
        order = np.argsort(loss, axis=1, kind="stable")
        belief = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * self.code.shape[1])
        rows = np.arange(len(loss))
        least, next_ = loss[rows, order[:, 0]], loss[rows, order[:, 1]]
        return order[:, 0], order[:, 1], belief[rows, order[:, 0]] / belief.sum(axis=1), next_ - least < MARGIN * (next_ + least)

    def predict(self, texts: pa.Array, dims: int = DIMS) -> list[tuple[str, float, bool, str | None]]:
        letters = [bool(t and _LETTER.search(t)) for t in texts.to_pylist()]
        if not self.languages:
            return [("und", 0.0, False, None)] * len(letters)
        if len(self.languages) == 1:
            return [(self.languages[0], 1.0, False, None) if k else ("und", 0.0, False, None) for k in letters]
        # each distinct word's grams are summed once: a text needs the word sums, its norm and nothing else
        found = self.decode(self.margins(texts, dims))
        return [(self.languages[a], float(s), bool(u), self.languages[b]) if k else ("und", 0.0, False, None) for k, a, b, s, u in zip(letters, *found)]

    def margins(self, texts: pa.Array, dims: int) -> np.ndarray:
        out = np.empty((len(texts), self.weights.shape[1]), np.float32)
        for i in range(0, len(texts), 256):
            out[i : i + 256] = features(texts[i : i + 256], dims) @ self.weights + self.bias
        return out


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, dims: int = DIMS, seed: int = 7) -> Model:
    """A model from text and lang. Distinct texts are counted by sketches, and some more than wanted drawn by a hash of the text; of these,
    copies become one and the first `per_language` stay, whose features, not texts, reach the driver."""
    ship(docs.sparkSession)
    have = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    counts = {r.lang: r.n for r in have.groupBy("lang").agg(F.approx_count_distinct("text").alias("n")).collect()}
    if not counts:
        return Model(np.zeros((0, dims), np.float32), [])
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.3 * per_language / max(1, n)))])
    drawn = have.withColumn("draw", F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40)))
    distinct = drawn.where(F.col("draw") < share[F.col("lang")]).groupBy("lang", "draw", F.xxhash64("text").alias("name")).agg(F.first("text").alias("text"))
    # some 1.3 times the wanted number meet here
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "name"))
    sample = distinct.withColumn("nth", first).where(F.col("nth") <= per_language).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                x = features(part.column("text"), dims).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary()), part.column("lang")], ["x", "lang"])

    rows = sorted((r.lang, bytes(r.x)) for r in sample.mapInArrow(run, "x binary, lang string").collect())
    return Model(np.frombuffer(b"".join(x for _, x in rows), np.float16).reshape(-1, dims).astype(np.float32), [v for v, _ in rows])


def identify(docs: DataFrame, model: Model, dims: int = DIMS) -> DataFrame:
    """Language, score and ambiguity of every row's text, in one narrow pass."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # dims x bits floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=4 << 20):
            got = list(zip(*shared.value.predict(b.column("text"), dims)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(got[0], pa.string()), pa.array(got[1], pa.float64()), pa.array(got[2], pa.bool_()), pa.array(got[3], pa.string())], [x.split()[0] for x in RESULT.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(crc_mod("doc_id", 3) != 1).select("text", "lang"))
    return identify(docs, model).withColumn("held_out", crc_mod("doc_id", 3) == 1)
