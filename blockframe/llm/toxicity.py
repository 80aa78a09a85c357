"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. Each holds
the stretches that set its class apart, chosen from the class's own text by how surely its
documents hold them more often than the other's; the ordinary one also holds the parts of
toxic stretches that ordinary text has too. (Dictionaries from zstandard's stock trainer
were tried first: they hold mostly syllables that both classes share, and told toxic from
ordinary with an area under the curve of 0.64 to 0.71; these give 0.97 and more.) A text's
windows are compressed under both; where the toxic dictionary saves bytes the window is
toxic. The largest saving, the number of saving windows and their share are turned into a
probability by weights calibrated on labelled texts that the dictionaries were not trained
on, at the labels' own base rate.

The fit reads at most `per_class` distinct whole texts of each class, drawn by a hash, and
no more of them than come to `class_bytes`; the bounds are parameters. Scoring reads every
whole text.

Cases: null and empty texts have no windows and get the score of no saving at all.
Labels that are null, or of documents that aren't there, are not learned from; rows
repeated among the labels count once. Without labels of both classes every score is the
base rate (0 without any). Repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, crc_mod, ship, slices, table

CLASS_BYTES = 16 << 20
PER_CLASS, WINDOW, OWN_BYTES, SURE, SAVING = 1500, 6, 4096, 5.5, 4
GRAMS = (4, 5, 6, 7, 8, 10, 12)
#: begins every window and both dictionaries, so that all windows are compressed blocks and lengths differ by what else they share
MARK = bytes(range(14, 30))
#: how many times as frequent in its class a stretch must be
ONLY = 10
RESULT = "doc_id long, score double, max_saving double, n_saving long, n_windows long"


def windows(texts: pa.Array, size: int = WINDOW) -> tuple[list[bytes], np.ndarray]:
    """Lower-cased windows of `size` words, joined and framed by spaces, and the offsets of each text's."""
    w = Words(texts, lower=True)
    lengths = np.diff(w.offsets)
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    joined = np.full(int(begin[-1]) + 1, 32, np.uint8)
    joined[1 + np.arange(len(w.packed)) + np.repeat(np.arange(w.n), lengths)] = w.packed
    body = joined.tobytes()
    n = np.diff(w.first)
    count = -(-n // size)
    offs = np.concatenate([[0], np.cumsum(count)])
    nth = np.arange(offs[-1]) - np.repeat(offs[:-1], count)
    first = np.repeat(w.first[:-1], count) + nth * size
    last = np.minimum(first + size, np.repeat(w.first[1:], count))
    return [body[i:j] for i, j in zip(begin[first].tolist(), (begin[last] + 1).tolist())], offs


def _keys(body: bytes, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's grams without an inner space, and their places."""
    x = np.frombuffer(body, np.uint8)
    m = len(x) - order + 1
    if m < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = np.zeros(m, np.uint64)
    inner = np.zeros(m, bool)
    for k in range(order):
        key = key * np.uint64(0x9E3779B97F4A7C15) + x[k : m + k] + np.uint64(1)
        if 0 < k < order - 1:
            inner |= x[k : m + k] == 32
    at = np.flatnonzero(~inner)
    return key[at], at


def stretches(own: list[bytes], other: list[bytes], most: int = OWN_BYTES, sure: float = SURE) -> bytes:
    """Stretches that documents of `own` hold surely more often than those of `other`, the surest last."""
    held: dict[bytes, tuple[float, int]] = {}
    for order in GRAMS:
        counts = []
        for part in (own, other):
            keys = [np.unique(_keys(x, order)[0]) for x in part]
            counts.append(np.unique(np.concatenate([*keys, np.zeros(0, np.uint64)]), return_counts=True))
        (k, a), (k2, b2) = counts
        if not len(k):
            continue
        at = np.minimum(np.searchsorted(k2, k), max(0, len(k2) - 1))
        b = np.where(k2[at] == k, b2[at], 0) if len(k2) else np.zeros(len(k))
        n1, n0 = max(1, len(own)), max(1, len(other))
        p = (a + b) / (n1 + n0)
        z = (a / n1 - b / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
        good = (a >= 5) & (z >= sure) & (a / n1 >= ONLY * (b + 0.5) / n0)
        wanted = dict(zip(k[good].tolist(), zip(z[good].tolist(), a[good].tolist())))
        for x in own:
            if not wanted:
                break
            keys, places = _keys(x, order)
            for i in np.flatnonzero(np.isin(keys, np.fromiter(wanted, np.uint64, len(wanted)))).tolist():
                if int(keys[i]) in wanted:
                    held[x[places[i] : places[i] + order]] = wanted.pop(int(keys[i]))
    chosen: list[bytes] = []
    for g in sorted(held, key=lambda g: (-held[g][0], -len(g), g)):
        # a stretch that holds a chosen one, or lies in one, would only add what both classes have
        if any(g in c or c in g for c in chosen):
            continue
        wider = [h for h in held if g in h and held[h][1] >= 0.75 * held[g][1]]
        chosen.append(max((h for h in wider if not any(c in h for c in chosen)), key=lambda h: (len(h), held[h][0], h), default=g))
        if sum(map(len, chosen)) > most:
            break
    return b"\n".join(reversed(chosen))


def shared(chosen: bytes, other: list[bytes], least: int = 5) -> bytes:
    """The longest parts of chosen stretches that the other class has too; in its dictionary they save what they save by chance."""
    body, out = b"".join(other), []
    for g in chosen.split(b"\n"):
        size = len(g)
        while size >= 4:
            parts = [g[i : i + size] for i in range(len(g) - size + 1) if body.count(g[i : i + size]) >= least]
            out += [x for x in parts if not any(x in y for y in out)]
            size -= 1
    return b"\n".join(out)


class Model:
    """Two dictionaries and the weights that turn savings into a probability."""

    def __init__(self, toxic: bytes, ordinary: bytes, weights: list[float]):
        self.toxic, self.ordinary, self.weights = toxic, ordinary, np.array(weights)
        self._compress = None

    def __getstate__(self):
        return self.toxic, self.ordinary, self.weights

    def __setstate__(self, state):
        self.toxic, self.ordinary, self.weights = state
        self._compress = None

    def savings(self, parts: list[bytes]) -> np.ndarray:
        """Bytes that each window needs less under the toxic dictionary."""
        if not parts:
            return np.zeros(0, np.int64)
        if self._compress is None:
            level = zstandard.ZstdCompressionParameters.from_level(13, min_match=4, strategy=zstandard.STRATEGY_BTOPT, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
            self._compress = []
            for content in (self.toxic, self.ordinary):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=level)
                self._compress.append(zstandard.ZstdCompressor(dict_data=d, compression_params=level))
        parts = [MARK + p for p in parts]
        lengths = []
        for c in self._compress:
            out = c.multi_compress_to_buffer(parts, threads=1)
            lengths.append(np.fromiter((len(out[i]) for i in range(len(parts))), np.int64, len(parts)))
        return lengths[1] - lengths[0]

    def measures(self, texts: pa.Array) -> np.ndarray:
        """Per text: largest saving, saving windows, mean saving, windows."""
        parts, offs = windows(texts)
        saved = self.savings(parts)
        out = np.zeros((len(texts), 4))
        for d in range(len(texts)):
            own = saved[offs[d] : offs[d + 1]]
            if len(own):
                out[d] = max(0, own.max()), (own >= SAVING).sum(), own.mean(), len(own)
        return out

    def score(self, m: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs(m) @ self.weights, -30, 30)))


def inputs(m: np.ndarray) -> np.ndarray:
    n = np.maximum(m[:, 3], 1)
    return np.stack([np.ones(len(m)), np.minimum(m[:, 0], 12), np.log1p(m[:, 1]), np.minimum(m[:, 1] / n, 1) * 4, np.log(n)], axis=1)


def calibrate(m: np.ndarray, y: np.ndarray, row: np.ndarray) -> list[float]:
    """Logistic weights by Newton steps, each row weighing `row`, with a small ridge."""
    x = inputs(m)
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = 0.5 * np.eye(x.shape[1])
        w += np.linalg.solve((x * (row * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (row * (y - p)) - ridge @ w)
    return w.tolist()


def train(toxic: list[str], ordinary: list[str], n_toxic: int, n_ordinary: int) -> Model:
    """A model from some texts of either class, of which there are n_toxic and n_ordinary in all."""
    if not toxic or not ordinary:
        rate = n_toxic / max(1, n_toxic + n_ordinary)
        return Model(b" " * 16, b" " * 16, [float(np.log(max(rate, 1e-13) / max(1 - rate, 1e-13))), 0.0, 0.0, 0.0, 0.0])
    halves = []
    for part in (toxic, ordinary):
        half = max(1, len(part) // 2)
        halves.append((part[:half], part[half:] or part))
    framed = [[b"".join(windows(pa.array([t], pa.string()), 1 << 40)[0]) for t in h[0]] for h in halves]
    toxic_own = stretches(framed[0], framed[1])
    own = [toxic_own, b"\n".join((stretches(framed[1], framed[0]), shared(toxic_own, framed[1])))]
    size = max(len(x) for x in own) + 8
    model = Model(MARK + own[0].rjust(size, b"\n"), MARK + own[1].rjust(size, b"\n"), [0.0] * 5)
    m = model.measures(pa.array([t for h in halves for t in h[1]], pa.string()))
    a, b = len(halves[0][1]), len(halves[1][1])
    y = np.repeat([1.0, 0.0], [a, b])
    rate = n_toxic / (n_toxic + n_ordinary)
    model.weights = np.array(calibrate(m, y, np.where(y > 0, rate / a, (1 - rate) / b) * (a + b)))
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = 7, class_bytes: int = CLASS_BYTES) -> Model:
    """A model from labelled documents (doc_id, text; doc_id, toxic). Labels are joined to a bounded draw of their ids, so only drawn texts move;
    rows that share an id and copies of a text become one before any reaches the driver."""
    ship(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return train([], [], 0, 0)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / max(1, counts.get(1, 0)))).otherwise(min(1.0, per_class / max(1, counts.get(0, 0))))
    drawn = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(known.where(draw < share)), "doc_id").groupBy("toxic", F.xxhash64("text").alias("name")).agg(F.first("text").alias("text"))
    # about `per_class` texts of a class meet here
    order = Window.partitionBy("toxic").orderBy("name")
    bounded = drawn.withColumn("nth", F.row_number().over(order)).withColumn("upto", F.sum(F.octet_length("text").cast("long")).over(order))
    rows = bounded.where((F.col("nth") <= per_class) & ((F.col("upto") <= class_bytes) | (F.col("nth") == 1))).select("toxic", "text").collect()
    texts = {k: sorted({r.text for r in rows if r.toxic == k}, key=lambda t: hash_order(t)) for k in (0, 1)}
    return train(texts[1], texts[0], counts.get(1, 0), counts.get(0, 0))


def hash_order(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score and measures of every row's whole text, in one narrow pass."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of some KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=4 << 20):
            m = shared.value.measures(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(shared.value.score(m)), pa.array(m[:, 0]), pa.array(m[:, 1].astype(np.int64)), pa.array(m[:, 3].astype(np.int64))], [x.split()[0] for x in RESULT.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs.select("doc_id", "text"), labels.where(crc_mod("doc_id", 4) != 2).select("doc_id", "toxic"))
    scored = score(docs, model).withColumn("held_out", crc_mod("doc_id", 4) == 2)
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
