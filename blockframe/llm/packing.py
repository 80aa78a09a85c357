"""Best-fit packing by bin completion.

Texts become token ids; only those longer than a sequence are cut. How pieces are
packed depends on their lengths alone, and a histogram of lengths has at most
`capacity` entries however large the corpus, so the search runs on it: around the
largest length left, undominated fillings are enumerated and searched depth first
within waste bounds, best-fit-decreasing solutions being the incumbents. Its result
is a short list of runs (a filling, how often), bounded by the capacity too. Every
piece then finds its place from its length and its rank among equals, which comes
from counts per block and length: no piece meets all others anywhere.

Cases: null and empty texts give one piece, the end id alone. Repeated rows, and rows
with equal or null ids, are packed each for itself. Empty tables give no rows.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, Memo, Words, ragged, raw, ship, slices, table, vocabulary_path, written

CAPACITY = 2048
#: nodes that a search may take, some milliseconds each
NODES = 5000
#: nodes on the way down whose fillings are kept in memory
AWAKE = 32
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, block long, nth long"
_encoders: dict = {}
#: 1 for ASCII letters and digits, 2 for ASCII signs that the vocabulary's pattern always parts from them, 0 for the rest
KIND = np.zeros(256, np.uint8)
KIND[33:127] = 2
KIND[48:58] = KIND[65:91] = KIND[97:123] = 1
KIND[ord("'")] = 0


class Encoder:
    """Ids of texts under word_bpe_49k.json, each distinct stretch being encoded once.

    White space parts tokens in this vocabulary, and so does a change between ASCII
    letters or digits and signs. Texts that hold a special token's name are encoded whole."""

    def __init__(self, folder: str | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json", folder))
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo = Memo(self.encode)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the offsets of each text's."""
        w = Parts(texts)
        codes, vocab = w.coded()
        row = self.memo.find(vocab)
        at, offs = ragged(row[codes], self.memo.offsets)
        ids, offs = self.memo.ids[at], offs[w.first]
        data, cut = raw(texts)
        body = data.tobytes()
        if any(s in body for s in self.special):
            parts = []
            for d in range(len(texts)):
                text = body[cut[d] : cut[d + 1]]
                whole = any(s in text for s in self.special)
                parts.append(np.array(self.encode([text.decode("utf-8", "replace")])[0], np.int32) if whole else ids[offs[d] : offs[d + 1]])
            offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            ids = np.concatenate(parts)
        return ids, offs


class Parts(Words):
    """Stretches of texts that the vocabulary encodes apart, A-Z lower-cased as it does."""

    def __init__(self, texts: pa.Array):
        super().__init__(texts)
        at = np.zeros(len(self.packed), bool)
        kind = KIND[self.packed]
        at[1:] = (kind[1:] + kind[:-1] == 3) & (kind[1:] != 0) & (kind[:-1] != 0)
        word_start = at.copy()
        word_start[self.offsets[:-1]] = True
        offsets = np.append(np.flatnonzero(word_start), len(self.packed))
        self.first = np.searchsorted(offsets[:-1], self.offsets[self.first])
        self.offsets, self.packed, self.n = offsets, LOWER[self.packed], len(offsets) - 1


def encoder(folder: str | None) -> Encoder:
    if folder not in _encoders:
        _encoders[folder] = Encoder(folder)
    return _encoders[folder]


def pieces(docs: DataFrame, capacity: int = CAPACITY, folder: str | None = None) -> DataFrame:
    """Pieces of every text; block and nth number the pieces of a task that are equally long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in slices(batches):
            ids, offs = encoder(folder).ids(b.column("text"))
            ids, offs = np.insert(ids, offs[1:], 0).astype("<u4"), offs + np.arange(len(offs))
            total = np.diff(offs)
            count = -(-total // capacity)
            doc = np.repeat(np.arange(len(total)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(capacity, total[doc] - start)
            view, first = memoryview(ids.tobytes()), (offs[doc] + start) * 4
            crc = [zlib.crc32(view[i:j]) for i, j in zip(first.tolist(), (first + 4 * length).tolist())]
            order = np.argsort(length, kind="stable")
            equal = length[order]
            begin = np.searchsorted(equal, equal, "left")
            nth = np.empty(len(doc), np.int64)
            nth[order] = np.arange(len(doc)) - begin + seen[equal]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(doc)).cast(pa.int64()), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), block), pa.int64()), pa.array(nth)],
                [x.split()[0] for x in PIECES.split(", ")],
            )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: runs of (lengths of one sequence, how many such sequences)."""
    left, runs = counts.copy(), []
    largest = capacity
    while True:
        while largest and not left[largest]:
            largest -= 1
        if not largest:
            return runs
        fill, room = [largest], capacity - largest
        left[largest] -= 1
        while room:
            fits = np.flatnonzero(left[1 : room + 1])
            if not len(fits):
                break
            n = int(fits[-1]) + 1
            fill.append(n)
            left[n] -= 1
            room -= n
        kinds, need = np.unique(fill, return_counts=True)
        more = int((left[kinds] // need).min())
        left[kinds] -= more * need
        runs.append((tuple(fill), more + 1))


def lower_bound(left: np.ndarray, capacity: int) -> int:
    """Sequences that a histogram needs at least (Martello and Toth's second bound): for every a, pieces above capacity - a
    lie alone, others above half of it apart, and those from a to half of it fill what room the latter leave), or by number."""
    half, a = capacity // 2, np.arange(capacity // 2 + 1)
    pieces, size = np.cumsum(left), np.cumsum(left * np.arange(len(left)))
    apart = pieces[capacity - a] - pieces[half]
    over = size[half] - np.where(a > 0, size[np.maximum(a, 1) - 1], 0) - (apart * capacity - (size[capacity - a] - size[half]))
    few = np.arange(1, 17)  # of pieces above a (k + 1)th of the capacity at most k lie together
    return max(int((pieces[-1] - pieces[capacity - a] + apart + np.maximum(0, -(-over // capacity))).max()), int((-(-(pieces[-1] - pieces[capacity // (few + 1)]) // few)).max()))


def dominated(filling: tuple[int, ...], spare: int, others: int) -> bool:
    """Whether a piece that is left over (bits of `others`: their lengths) could take the place of some of a filling's
    pieces, or of its waste `spare`, without the filling getting emptier: of one or none for a longer one, of several for one as long."""
    one = several = 0  # bits: sums of exactly one, and of two pieces or more
    for n in filling:
        several |= several << n | one << n
        one |= 1 << n
    if several & others:
        return True
    sums, d = 1 | one | several, 1
    # sums moved up by 1 to spare bits, by doubling
    moved = sums << 1 if spare else 0
    while d < spare:
        by = min(d, spare - d)
        moved |= moved << by
        d += by
    return bool(moved & others)


def fillings(left: np.ndarray, room: int, tries: Iterator | None = None) -> Iterator[tuple[int, tuple[int, ...]]]:
    """All undominated fillings of a room, made one by one: (waste, lengths), fullest first and then longest pieces first.
    Each that is made, dominated or not, takes one of `tries`; without any left the fillings end.

    The sums that the shorter lengths can make are known as bits, so that the search for a
    filling of a given sum meets no dead end."""
    lengths = (np.flatnonzero(left[1 : room + 1]) + 1)[::-1].tolist()
    count, everything = [int(left[n]) for n in lengths], (2 << room) - 1
    reach = [1] * (len(lengths) + 1)
    for i in range(len(lengths) - 1, -1, -1):
        sums, more, step = reach[i + 1], min(count[i], room // lengths[i]), 1
        while more > 0:
            take = min(step, more)
            sums |= sums << take * lengths[i] & everything
            more, step = more - take, 2 * step
        reach[i] = sums

    def exactly(i: int, total: int) -> Iterator[tuple[int, ...]]:
        if not total:
            yield ()
            return
        while i < len(lengths):
            n = lengths[i]
            for k in range(min(count[i], total // n), 0, -1):
                if reach[i + 1] >> total - k * n & 1:
                    for rest in exactly(i + 1, total - k * n):
                        yield (n,) * k + rest
            i += 1
            if not reach[i] >> total & 1:
                return

    bits = sum(1 << n for n in lengths)
    for spare in range(room + 1):
        if not reach[0] >> room - spare & 1:
            continue
        for f in exactly(0, room - spare):
            if tries is not None and next(tries, None) is None:
                return
            used = Counter(f)
            if not dominated(f, spare, bits ^ sum(1 << n for n, k in used.items() if left[n] == k)):
                yield spare, f


def bin_completion(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Runs of fillings that hold counts[n] pieces of each length n in as few sequences as found.

    Best-fit decreasing gives the first incumbent. If it does not meet the lower bound, a
    depth-first search follows: at each node the largest length left opens a sequence,
    whose undominated fillings are tried fullest first, each as often as its pieces last,
    and after those once. A filling is pruned when the waste so far and its own leave no
    way below the incumbent, and a node when the lower bound of what is left does. The
    rest of every sixteenth node is completed by best fit for a new incumbent. The search
    is complete: it ends when the incumbent meets the lower bound or nothing is left to
    try. As it may take exponential time, it also ends after `nodes` nodes, or ten times
    as many fillings made."""
    total, bound = int((counts * np.arange(len(counts))).sum()), lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    size, spent, tries = sum(n for _, n in best), 0, iter(range(10 * nodes))

    root = Node(counts, None, 0, 0)
    stack = [root] if size > bound else []
    while stack and size > bound and spent < nodes:
        node = stack[-1]
        f, times, spare = node.option((size - 1) * capacity - total, capacity, tries)
        if not times:
            stack.pop()
            continue
        spent += 1
        after = node.left.copy()
        kinds, need = np.unique(f, return_counts=True)
        after[kinds] -= times * need
        child = Node(after, (node.runs, (f, times)), node.used + times, node.waste + times * spare)
        if not after.any():
            if child.used < size:
                best, size = child.all_runs(), child.used
            continue
        if child.used + lower_bound(after, capacity) >= size:
            continue
        if spent % 16 == 1:
            rest = best_fit(after, capacity)
            if child.used + sum(n for _, n in rest) < size:
                best, size = [*child.all_runs(), *rest], child.used + sum(n for _, n in rest)
        stack.append(child)
        if len(stack) > AWAKE:
            stack[-AWAKE - 1].fillings = None
    return best


class Node:
    """A node of the search: what is left, the runs so far (the last, behind all before), sequences and waste so far, and how far its options have been tried."""

    def __init__(self, left: np.ndarray, runs: tuple | None, used: int, waste: int):
        self.left, self.runs, self.used, self.waste = left, runs, used, waste
        self.once, self.seen, self.fillings = False, 0, None

    def option(self, most: int, capacity: int, tries: Iterator) -> tuple[tuple[int, ...], int, int]:
        """The next filling, with the largest length, how often, and its waste; () and 0 times if none is left. `most` waste leaves a way below the incumbent."""
        largest = int(np.flatnonzero(self.left)[-1])
        while True:
            if self.fillings is None:  # they take memory, and are made anew where a node has slept
                rest = self.left.copy()
                rest[largest] -= 1
                self.fillings = itertools.islice(fillings(rest, capacity - largest, tries), self.seen, None)
            for spare, f in self.fillings:
                self.seen += 1
                if self.waste + spare > most:
                    break
                f = (largest, *f)
                kinds, need = np.unique(f, return_counts=True)
                times = int((self.left[kinds] // need).min())
                times = min(times, (most - self.waste) // spare) if spare else times
                if not self.once or times > 1:
                    return f, 1 if self.once else times, spare
            if self.once:
                return (), 0, 0
            self.once, self.seen, self.fillings = True, 0, None

    def all_runs(self) -> list[tuple[tuple[int, ...], int]]:
        out, at = [], self.runs
        while at:
            at, run = at
            out.append(run)
        return out[::-1]


class Plan:
    """Where the r-th piece of a length goes: arrays sorted by (length, first rank)."""

    def __init__(self, runs: list[tuple[tuple[int, ...], int]]):
        rows, given, sequence = [], {}, 0
        for fill, times in runs:
            offset = 0
            for n in sorted(set(fill), reverse=True):
                per = fill.count(n)
                rows.append((n, given.get(n, 0), sequence, per, offset))
                given[n] = given.get(n, 0) + per * times
                offset += n * per
            sequence += times
        self.table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.keys = self.table[:, 0] << 48 | self.table[:, 1]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = self.table[np.searchsorted(self.keys, length << 48 | rank, "right") - 1]
        nth = rank - row[:, 1]
        return row[:, 2] + nth // row[:, 3], row[:, 4] + nth % row[:, 3] * length


def pack(docs: DataFrame, capacity: int = CAPACITY, folder: str | None = None, nodes: int = NODES) -> DataFrame:
    """Every piece with its sequence and its place there.

    Two shuffles, both of counts per (block, length); the pieces, without their ids, are
    joined to those by the same key, of which no block has more than its own pieces."""
    made = written(pieces(docs, capacity, folder))
    counts = made.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        histogram[length] = n
    plan = Plan(bin_completion(histogram, capacity, nodes))
    before = counts.select("length", "block", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    ranked = made.join(before, ["length", "block"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = plan.place(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
