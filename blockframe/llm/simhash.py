"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's 64-bit fingerprint takes the majority of its shingle hashes' bits. Two
fingerprints within `radius` bits have a common variant within half the radius of
each, so every fingerprint stands for all its variants and fingerprints that share
one are linked. Variants are dealt out by their first `prefix` bits: a fingerprint is
sent once to each prefix that one of its variants has (1 + p + p(p-1)/2 of them for
radius 4), and the receiving task makes those of its variants that start so. What is
shuffled is thus fingerprints, packed by prefix and some tens for each, instead of 2,081
variants; the variants exist only inside a task, in slices of bounded size.

All holders of a variant lie within the radius of each other, so the sorted holders
are linked in a chain: no pairs within a group are emitted, and every link is verified
by its distance. A task reduces its links to a spanning forest. Components are then
found over distinct fingerprints by alternating star contractions, each round written
to the shared folder.

Cases: null and empty texts, and texts without words, have fingerprint zero and are
linked like any other; texts with fewer words than a shingle are one shingle. Repeated
rows share a class. A null id is larger than any other and stays null where it is alone.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Words, discard, hot_join, ship, slices, table, written

SHINGLE, RADIUS, SEED = 4, 4, 42
#: a column that keep_one and keep_similar add for a while
ROW = "__simhash_row"
#: fingerprints that a task of the variant join gets on average, which sets the prefix
PER_TASK = 1 << 15
#: variants sorted at a time in a task
SLICE = 1 << 22


def shingle_bits(texts: pa.Array, n: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Fingerprints (uint64) of a batch of texts."""
    out = np.zeros(len(texts), np.uint64)
    for d, every in enumerate(shingle_hashes(texts, n, seed)):
        total = np.zeros(64, np.int64)
        for a in range(0, len(every), 65536):
            total += np.unpackbits(every[a : a + 65536].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        if len(every):
            out[d] = np.packbits(2 * total > len(every)).view(">u8")[0]
    return out


def fingerprints(docs: DataFrame, n: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, row and fingerprint (fp, a signed long) of every row, in one narrow pass."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(shingle_bits(b.column("text"), n, seed).view(np.int64))], ["doc_id", "row", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_hash().alias("row")).mapInArrow(run, "doc_id long, row long, fp long")


@functools.cache
def masks(bits: int, most: int) -> np.ndarray:
    """All masks of at most `most` of the lowest `bits` bits."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in itertools.combinations(range(bits), k)], np.uint64)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each of n nodes' components under edges (a, b)."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def bucket_links(prefix: int, bits: int, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among fingerprints that share a variant starting with `prefix` (of `bits` bits)."""
    fps = np.unique(fps)
    if len(fps) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    half, low = radius // 2, 64 - bits
    top = fps >> np.uint64(low) if bits else np.zeros_like(fps)
    away = np.bitwise_count(top ^ np.uint64(prefix)).astype(int)
    keep = (1 << low) - 1 if low < 64 else (1 << 64) - 1
    base = fps & np.uint64(keep)
    label = np.arange(len(fps))
    # a slice takes the variants whose next `more` bits are equal, so that few are sorted at a time
    made = sum(int((away == t).sum()) * len(masks(low, half - t)) for t in range(half + 1))
    more = 0
    while made >> more > SLICE and more < 12:
        more += 1
    inner = low - more
    for cell in range(1 << more):
        variants, owners = [], []
        cut = (base >> np.uint64(inner)) if inner else base
        gap = np.bitwise_count(cut ^ np.uint64(cell)).astype(int) if more else np.zeros(len(fps), int)
        rest = base & np.uint64((1 << inner) - 1)
        for left in range(half + 1):
            own = np.flatnonzero(half - away - gap == left)
            if len(own):
                m = masks(inner, left)
                variants.append((rest[own, None] ^ m[None, :]).ravel())
                owners.append(np.repeat(own, len(m)))
        if not variants:
            continue
        v, o = np.concatenate(variants), np.concatenate(owners)
        order = np.argsort(v)
        v, o = v[order], o[order]
        same = np.flatnonzero(v[1:] == v[:-1])
        a, b = o[same], o[same + 1]
        true = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        pairs = np.unique(np.minimum(a, b)[true] * len(fps) + np.maximum(a, b)[true])
        x, y = pairs // len(fps), pairs % len(fps)
        label = forest(len(fps), np.concatenate([x, np.arange(len(fps))]), np.concatenate([y, label]))
    child = np.flatnonzero(label != np.arange(len(fps)))
    return fps[child], fps[label[child]]


def links(fps: DataFrame, radius: int = RADIUS, per_task: int = PER_TASK) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that join all within the radius.

    Any two distinct fingerprints within the radius end up connected; every link is itself within a chain of such pairs."""
    if radius % 2:
        raise ValueError(f"half of the radius must be whole: {radius}")
    half = radius // 2
    count = fps.count()
    bits = 0
    while bits < 30 and count * len(masks(bits, half)) >> bits > per_task:
        bits += 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = masks(bits, half)
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            top = fp >> np.uint64(64 - bits) if bits else np.zeros_like(fp)
            to = (top[:, None] ^ flips[None, :]).ravel()
            order = np.argsort(to)
            to, sent = to[order], np.repeat(fp, len(flips))[order]
            # a row for each prefix that a batch sends to, with all that it sends there
            cut = np.append(np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])), len(to))
            data = [sent[i:j].tobytes() for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(to[cut[:-1]].view(np.int64)), pa.array(data, pa.binary())], ["prefix", "fps"])

    def meet(key, group):
        got = np.frombuffer(b"".join(group.column("fps").to_pylist()), np.uint64)
        a, b = bucket_links(key[0].as_py(), bits, got, radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return fps.mapInArrow(deal, "prefix long, fps binary").groupBy("prefix").applyInArrow(meet, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) of all nodes that edges (a, b) touch.

    Alternating star contraction: each round links every node's larger neighbours, then its
    smaller ones, to the smallest; rounds are logarithmic in a component's size. Neighbours
    meet by a minimum with partial counts and a join, never as a list, and the neighbours of
    a star's centre in no one task."""

    def least_of(pairs: DataFrame) -> DataFrame:
        """Of each u its smallest v of pairs (or u) as m, with their number."""
        return pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")

    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before, rows = None, now.count()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # each step is a table: a join takes its sides several times, so that one plan of a round would hold the first step dozens of times
        least = written(least_of(both))
        large = written(hot_join(both.where("v > u"), least, "u", 2 * rows).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        discard(least)
        least, last = written(least_of(large)), now
        now = written(hot_join(large, least, "u", 2 * rows).select("v", "m").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        for x in (last, large, least):
            discard(x)
        # as many edges as nodes with a parent, and parents without one: a forest of stars
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first())
        if state == before:
            break
        before, rows = state, state[0]
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def _classes(marked: DataFrame, reps: DataFrame, label: DataFrame, on: str, rows: int) -> DataFrame:
    """marked with its class's first row (`first`: id and row); reps has the first row of each `on` and how many rows have it, label the component of each node. reps is not needed any more then."""
    joined = written(reps.join(label, "node", "left").select(on, "first", "n", F.coalesce("label", "node").alias("label")))
    best = joined.groupBy("label").agg(F.min("first").alias("best"), F.count(F.lit(1)).alias("n"))
    of = written(hot_join(joined.select(on, "label", F.col("n").alias("times")), best, "label", rows).select(on, F.col("best").alias("first"), F.col("times").alias("n")))
    discard(joined)
    discard(reps)
    return hot_join(marked, of, on, rows)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, n: int = SHINGLE, seed: int = SEED, per_task: int = PER_TASK) -> DataFrame:
    """doc_id, row (a hash of id and text), fp (signed), component_id and first_row (its row) of every row."""
    marked = written(fingerprints(docs, n, seed))
    rows = marked.count()
    # one representative for each distinct fingerprint; copies need no links
    reps = written(marked.groupBy("fp").agg(F.min(_order()).alias("first"), F.count(F.lit(1)).alias("n")).withColumn("node", F.col("fp")))
    found = _classes(marked, reps, components(links(reps.select("fp"), radius, per_task)), "fp", rows)
    return found.select("doc_id", "row", "fp", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("first_row"))


def _order():
    """What the first row of a class is the least of: null ids are last, and rows that share an id go by their hashes."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))


def _firsts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that are the first of their class by found (row, first_row), rows repeated with id and text once, and all rows without an id."""
    keep = found.where("doc_id IS NOT NULL AND row = first_row").select(F.col("row").alias(ROW)).distinct()
    own = docs.where("doc_id IS NOT NULL").withColumn(ROW, row_hash())
    return own.join(keep.hint("merge"), ROW, "left_semi").dropDuplicates([ROW]).drop(ROW).unionByName(docs.where("doc_id IS NULL"))


def row_hash():
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


def keep_one(docs: DataFrame, radius: int = RADIUS, n: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Of each class of near-duplicates the first row, that with the smallest id, with all its columns.

    A row repeated with id and text is kept once. Rows without an id take part in classes, but as nothing can name them, none is dropped."""
    return _firsts(docs, near_duplicates(docs, radius, n, seed))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- similarity classes --------------------------------------------------------------
#
# A radius of 4 bits in 64 links texts whose shingles are some 0.96 alike. To link from a
# similarity of 0.8, a text gets several independent short keys, each hashed by balls: a pair
# meets if one of its keys differs by at most two bits. Longer fingerprints then tell most
# pairs: those three standard deviations nearer than a pair of the wanted similarity are
# links, those more than two farther are none. What lies between is compared exactly, by
# the texts' sets of shingles: of the pairs that meet, those nearest first, as many as would
# join what is not joined yet.

WORDS, KEY_BITS, VERIFY = 10, 32, 2
#: keys that a task of the key join gets on average
KEYS_PER_TASK = 1 << 18


def shingle_hashes(texts: pa.Array, n: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """Hashes (uint64) of every text's shingles, repeats included, A-Z lower-cased; a text with fewer words is one shingle."""
    w = Words(texts)
    lengths = np.diff(w.offsets)
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    joined = np.full(int(begin[-1]), 32, np.uint8)
    joined[np.arange(len(w.packed)) + np.repeat(np.arange(w.n), lengths)] = LOWER[w.packed]
    body, digest = joined.tobytes(), xxhash.xxh64_intdigest
    starts, ends = begin[:-1], begin[:-1] + lengths
    for d in range(len(texts)):
        i, j = int(w.first[d]), int(w.first[d + 1])
        size = min(n, j - i)
        lo, hi = (starts[i : j - size + 1], ends[i + size - 1 : j]) if size else (starts[:0], ends[:0])
        yield np.fromiter((digest(body[s:e], seed) for s, e in zip(lo.tolist(), hi.tolist())), np.uint64, len(lo))


def signature_words(texts: pa.Array, n: int, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """`words` independent 64-bit fingerprints of each text, from one hash of each shingle."""
    out, odd = np.zeros((len(texts), words), np.uint64), 2 * np.arange(words, dtype=np.uint64) + np.uint64(1)
    for d, every in enumerate(shingle_hashes(texts, n, seed)):
        total = np.zeros(64 * words, np.int64)
        for a in range(0, len(every), 8192):
            many = every[a : a + 8192, None] * odd[None, :]
            many = (many ^ (many >> np.uint64(31))) * np.uint64(0xC4CEB9FE1A85EC53)
            many ^= many >> np.uint64(33)
            total += np.unpackbits(many.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
        if len(every):
            out[d] = np.packbits(2 * total > len(every)).view(np.uint64)
    return out


def levels(similarity: float, bits: int) -> list[int]:
    """Increasing distances of `bits` bits: of sure links, then of likelier and less likely ones, up to the last that may be a link."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return [max(0, round(p * bits + k * np.sqrt(bits * p * (1 - p)))) for k in (-3, -2, -1, 0, 1, 2)]


def roots(label: np.ndarray, x: np.ndarray) -> np.ndarray:
    x = label[x]
    while (label[x] != x).any():
        x = label[x]
    return x


def linked(words: np.ndarray, groups: list[np.ndarray], most: int, label: np.ndarray) -> list[tuple[int, int]]:
    """Joins, in label, what pairs within a group join whose distance is at most `most`; the pairs that did.

    Pairs that are joined already are not looked at, so that a large group of copies costs its size, not its square."""
    found = []
    for g in groups:
        for i in range(len(g) - 1):
            own = roots(label, g[i:])
            rest = np.flatnonzero(own != own[0])
            if not len(rest):
                continue
            far = np.bitwise_count(words[g[i + rest]] ^ words[g[i]]).sum(axis=1)
            rest, far = rest[far <= most], far[far <= most]
            # of each other class the nearest
            rest = rest[np.lexsort((far, own[rest]))]
            rest = rest[np.unique(own[rest], return_index=True)[1]]
            if len(rest):
                found += [(int(g[i]), int(g[i + k])) for k in rest]
                label[np.append(own[rest], own[0])] = min(int(own[rest].min()), int(own[0]))
    return found


def key_links(prefix: int, bits: int, keys: np.ndarray, words: np.ndarray, steps: list[int]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Among holders of variants (within one bit of each key) that start with a prefix: the smallest member of what sure links join; and the nearest pairs of others that would join more."""
    label, groups, more = np.arange(len(keys)), {}, 0
    while len(keys) * (1 + KEY_BITS) >> more > SLICE and bits + more < KEY_BITS:
        more += 1
    for top in range(prefix << more, (prefix + 1) << more):  # variants that start alike, so that few are sorted at a time
        low = KEY_BITS - bits - more
        away = np.bitwise_count((keys >> np.uint64(low)) ^ np.uint64(top))
        base = keys & np.uint64((1 << low) - 1)
        own, near = np.flatnonzero(away == 0), np.flatnonzero(away == 1)
        m = masks(low, 1)
        v = np.concatenate([(base[own, None] ^ m[None, :]).ravel(), base[near]])
        o = np.concatenate([np.repeat(own, len(m)), near])
        order = np.argsort(v)
        v, o = v[order], o[order]
        if not len(v):
            continue
        same = v[1:] == v[:-1]
        a, b = o[:-1][same], o[1:][same]
        good = np.bitwise_count(words[a] ^ words[b]).sum(axis=1) <= steps[0]
        # neighbours first, all at once; then the groups in which they left more than one class
        label = forest(len(keys), np.concatenate([a[good], np.arange(len(keys))]), np.concatenate([b[good], label]))
        cut = np.concatenate([[0], np.flatnonzero(~same) + 1, [len(v)]])
        mixed = np.zeros(len(v), bool)
        mixed[1:] = same & (label[o[1:]] != label[o[:-1]])
        for i in np.flatnonzero(np.add.reduceat(mixed, cut[:-1]) > 0).tolist():
            g = np.unique(o[cut[i] : cut[i + 1]])
            groups[g.tobytes()] = g
    left, sure, pairs = list(groups.values()), label, []
    for k, most in enumerate(steps):
        left = [g for g in left if len(np.unique(roots(label, g))) > 1]
        pairs += linked(words, left, most, label)
        if not k:
            sure, pairs = roots(label, np.arange(len(label))), []
    return sure, pairs


#: what is sent of a key: its node, itself, and the words that verify it
SENT = np.dtype([("node", "<i8"), ("key", "<u4"), ("words", "<u8", VERIFY)])


def similar_links(nodes: DataFrame, similarity: float, per_task: int = KEYS_PER_TASK) -> DataFrame:
    """Links (a, b, sure) among nodes (node, keys: all fingerprint words packed) that are at least so similar, or may be."""
    count = nodes.count()
    bits = 0
    while bits < 24 and count * (1 + bits) >> bits > per_task:
        bits += 1
    steps = levels(similarity, 64 * VERIFY)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = masks(bits, 1)
        for b in batches:
            node = b.column("node").to_numpy()
            words = np.frombuffer(b"".join(b.column("keys").to_pylist()), np.uint64).reshape(len(node), -1)
            keys = np.concatenate([words >> np.uint64(32), words & np.uint64(0xFFFFFFFF)], axis=1)
            to_rows, data_rows = [], []
            for t in range(keys.shape[1]):
                to = ((keys[:, t] >> np.uint64(KEY_BITS - bits))[:, None] ^ flips[None, :]).ravel()
                order = np.argsort(to, kind="stable")
                to, of = to[order], order // len(flips)
                # the words that verify are not those that make the key
                other = [(t + 1 + k) % words.shape[1] for k in range(VERIFY)]
                sent = np.empty(len(of), SENT)
                sent["node"], sent["key"], sent["words"] = node[of], keys[of, t], words[of][:, other]
                cut = np.append(np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])), len(to))
                to_rows += [(t << bits) | int(x) for x in to[cut[:-1]]]
                data_rows += [sent[i:j].tobytes() for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(to_rows, pa.int64()), pa.array(data_rows, pa.binary())], ["bucket", "data"])

    def meet(key, group):
        got = np.frombuffer(b"".join(group.column("data").to_pylist()), SENT)
        label, pairs = key_links(key[0].as_py() & ((1 << bits) - 1), bits, got["key"].astype(np.uint64), np.ascontiguousarray(got["words"]), steps)
        child = np.flatnonzero(label != np.arange(len(label)))
        node, (x, y) = got["node"], np.array(pairs, np.int64).reshape(-1, 2).T
        a, b = node[np.append(child, x)], node[np.append(label[child], y)]
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b)), "sure": pa.array(np.repeat([True, False], [len(child), len(x)]))})

    made = nodes.mapInArrow(deal, "bucket long, data binary").groupBy("bucket").applyInArrow(meet, "a long, b long, sure boolean")
    return made.where("a <> b").groupBy("a", "b").agg(F.max("sure").alias("sure"))


def verified(pairs: DataFrame, docs: DataFrame, similarity: float, n: int) -> DataFrame:
    """The pairs (a, b) whose texts' sets of shingles have at least that Jaccard similarity; docs: row, text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [np.unique(h.astype(np.uint32)).tobytes() for h in shingle_hashes(b.column("text"), n)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(got, pa.binary())], ["node", "own"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y")):
                x, y = np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    nodes = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    # no broadcast here, whatever the size: the rows that are looked for grow with the documents
    own = written(docs.join(nodes.hint("merge"), "row", "left_semi").dropDuplicates(["row"]).select("row", "text").mapInArrow(sets, "node long, own binary"))
    side = lambda k, c: own.select(F.col("node").alias(k), F.col("own").alias(c))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def similar_classes(docs: DataFrame, similarity: float = 0.8, n: int = 5, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, row, component_id and first_row of every row with an id: classes of texts whose n-word shingles are at least so similar, directly or by way of others.

    A pair of similarity 0.8 meets in some key with a probability of about 0.9, one of 0.9 with nearly 1; a pair that meets is compared exactly unless it is clearly more or less alike."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = signature_words(b.column("text"), n, words, seed)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array([x.tobytes() for x in got], pa.binary())], ["doc_id", "row", "keys"])

    marked = written(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_hash().alias("row")).mapInArrow(run, "doc_id long, row long, keys binary"))
    rows = marked.count()
    # texts with the same words of fingerprint are one node, named by its first row
    reps = written(marked.groupBy("keys").agg(F.min(_order()).alias("first"), F.count(F.lit(1)).alias("n")).withColumn("node", F.col("first.row")))
    links = written(similar_links(reps, similarity))
    unsure = verified(links.where("NOT sure").select("a", "b"), docs.where("doc_id IS NOT NULL").select(row_hash().alias("row"), F.coalesce("text", F.lit("")).alias("text")), similarity, n)
    found = _classes(marked, reps, components(links.where("sure").select("a", "b").unionByName(unsure)), "keys", rows)
    discard(links)
    return found.select("doc_id", "row", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("first_row"))


def keep_similar(docs: DataFrame, similarity: float = 0.8, n: int = 5) -> DataFrame:
    """Of each class of similar texts the first row, that with the smallest id, with all its columns.

    A row repeated with id and text is kept once, and so is one of several texts of a class that share its smallest id. Rows without an id cannot be named and all stay."""
    return _firsts(docs, similar_classes(docs, similarity, n))
