"""Benchmark decontamination by a prefix-filtered join.

Each benchmark item gives its windows of `n` consecutive words (one shorter window
where it has fewer words). The words of a window are ordered by rarity in the corpus;
since a window must be contained whole, its necessary prefix is one word, the rarest.
A document's positions that hold a prefix word are joined to the windows indexed under
it; the word's position in the window fixes where the window would begin, so windows
that would leave the document are dropped by length and position alone, and only the
rest are verified word by word, exactly.

The benchmark side is taken in blocks of at most `block_bytes` of text, each a pass
over the documents: a block is what a worker holds, whatever the benchmark's size.
Its index is arrays: for a full block of random text they take 61 MB pickled, and some
320 MB while they are made.

Cases: null or empty texts have no words and no hits; items without words have no
windows; repeated items with one id count once; null ids count as the empty text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_ALNUM, Words, ragged, ship, slices, table, text_bytes, written

N_WORDS, MIN_ITEMS, BLOCK_BYTES = 8, 2, 16 << 20
#: the row number that drop_contaminated adds for a while
ROW = "__decontamination_row"
HITS = "doc_id long, row long, n_words long, spans array<long>, items array<string>"


class Index:
    """Distinct windows of some items under their rarest words, as arrays: where each is first found in the items' word codes, and the items that have it."""

    def __init__(self, items: list[tuple[str, str]], rarity: Callable[[pa.Array], np.ndarray], n: int):
        words = Words(pa.array([t for _, t in items], pa.string()), NOT_ALNUM, lower=True)
        codes, self.vocab = words.coded()
        self.codes, self.ids = codes.astype(np.int32), [i for i, _ in items]
        # rarity as a rank, so that equally rare words have one order everywhere
        rank = np.empty(len(self.vocab), np.int32)
        rank[np.argsort(rarity(self.vocab), kind="stable")] = np.arange(len(rank), dtype=np.int32)
        size = np.diff(words.first)
        many = np.where(size > 0, np.maximum(1, size - n + 1), 0)
        owner = np.repeat(np.arange(len(size), dtype=np.int32), many)
        start = (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + words.first[owner]).astype(np.int32)
        length = np.minimum(size, n)[owner].astype(np.int32)
        name = length.astype(np.uint64)
        for k in range(n):
            name = name * np.uint64(0x9E3779B97F4A7C15) + np.where(k < length, self._word(start, k), -1).astype(np.uint64)
            name ^= name >> np.uint64(29)
        order = np.argsort(name, kind="stable")
        start, length, owner = start[order], length[order], owner[order]
        new = np.ones(len(order), bool)
        new[1:] = name[order[1:]] != name[order[:-1]]
        for k in range(n):  # equal names are compared word by word
            new[1:] |= (length[1:] != length[:-1]) | ((k < length[1:]) & (self._word(start[1:], k) != self._word(start[:-1], k)))
        cut = np.flatnonzero(new)
        #: items of window i: self.owner[self.owners[i]:self.owners[i + 1]]
        self.owner, self.owners = owner, np.append(cut, len(owner))
        self.start, self.length = start[cut], length[cut]
        self.at = np.zeros(len(cut), np.int32)
        best = np.full(len(cut), len(rank), np.int32)
        for k in range(n):
            own = np.where(k < self.length, rank[self._word(self.start, k)] if len(rank) else 0, len(rank))
            self.at[own < best] = k
            best = np.minimum(best, own)
        key = self._word(self.start, self.at)
        self.order = np.argsort(key, kind="stable").astype(np.int32)
        self.begin = np.searchsorted(key[self.order], np.arange(len(self.vocab) + 1))

    def _word(self, start: np.ndarray, k: int | np.ndarray) -> np.ndarray:
        return self.codes[np.minimum(start + k, len(self.codes) - 1)] if len(self.codes) else np.zeros(len(start), np.int32)

    def items(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Item numbers that have some windows, one window after another, and the offsets of each window's."""
        at, offsets = ragged(windows, self.owners)
        return self.owner[at], offsets

    def find(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words and window numbers of all occurrences; codes number words by self.vocab, -1: not in it."""
        count = np.where(codes >= 0, self.begin[codes + 1] - self.begin[codes], 0)
        hit = np.flatnonzero(count)
        doc = np.searchsorted(first, hit, "right")
        doc_begin, doc_end = first[doc - 1], first[doc]
        starts, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        # a frequent word may head many windows: candidates are made and verified in pieces
        total = np.cumsum(count[hit])
        cut = np.searchsorted(total, np.arange(2_000_000, total[-1] if len(total) else 0, 2_000_000))
        for part in np.split(np.arange(len(hit)), cut):
            many = count[hit[part]]
            of = np.repeat(part, many)
            window = self.order[np.repeat(self.begin[codes[hit[part]]] - (np.cumsum(many) - many), many) + np.arange(len(of))]
            start = hit[of] - self.at[window]
            fits = (start >= doc_begin[of]) & (start + self.length[window] <= doc_end[of])
            start, window = start[fits], window[fits]
            for k in range(int(self.length.max(initial=0))):
                if not len(start):
                    break
                same = (k >= self.length[window]) | (codes[np.minimum(start + k, len(codes) - 1)] == self._word(self.start[window], k))
                start, window = start[same], window[same]
            starts.append(start)
            windows.append(window)
        return np.concatenate(starts), np.concatenate(windows)


def _occurrences(texts: pa.Array, index: Index) -> tuple[np.ndarray, list[list[int]], list[list[str]]]:
    """Per text: number of words, [from, to) pairs of hit words (merged), ids of items found."""
    w = Words(texts, NOT_ALNUM, lower=True)
    local, vocab = w.coded()
    known = pc.index_in(vocab, value_set=index.vocab).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    start, window = index.find(known[local], w.first) if w.n and len(index.start) else (np.zeros(0, np.int64),) * 2
    mark = np.zeros(w.n + 1, np.int64)
    np.add.at(mark, start, 1)
    np.add.at(mark, start + (index.length[window] if len(start) else 0), -1)
    hit = np.concatenate([[False], np.cumsum(mark[:-1]) > 0, [False]])
    lo, hi = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(~hit[1:] & hit[:-1])
    n = np.diff(w.first)
    spans: list[list[int]] = [[] for _ in n]
    items: list[set[str]] = [set() for _ in n]
    if len(start):
        pairs = np.unique((np.searchsorted(w.first, start, "right") - 1) * len(index.start) + window)
        found, offsets = index.items(pairs % len(index.start))
        pairs = np.unique(np.repeat(pairs // len(index.start), np.diff(offsets)) * len(index.ids) + found)
        for d, k in zip((pairs // len(index.ids)).tolist(), (pairs % len(index.ids)).tolist()):
            items[d].add(index.ids[k])
    for i, j in zip(lo.tolist(), hi.tolist()):
        d = int(np.searchsorted(w.first, i, "right")) - 1
        while i < j:  # a run may go on in the next text
            end = min(j, int(w.first[d + 1]))
            if end > i:
                spans[d] += [i - int(w.first[d]), end - int(w.first[d])]
            i, d = end, d + 1
    return n, spans, [sorted(x) for x in items]


def corpus_rarity(docs: DataFrame, known: pa.Array) -> np.ndarray:
    """How often distinct words, those of a block's items, occur in all documents: one row per such word and task, then one per word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known) + 1, np.int64)
        for b in slices(batches):
            w = Words(b.column("text"), NOT_ALNUM, lower=True)
            codes, words = w.coded()
            count = np.bincount(codes, minlength=len(words))
            np.add.at(total, pc.index_in(words, value_set=known).fill_null(len(known)).to_numpy(zero_copy_only=False), count)
        some = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["word", "n"])

    counts = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()  # at most the words of one block
    out = np.zeros(len(known), np.int64)
    out[counts.column("word").to_numpy()] = counts.column("n").to_numpy()
    return out


def item_blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of about so many bytes; the driver holds one block at a time."""
    texts = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    k = max(1, -(-text_bytes(texts) // block_bytes))
    for i in range(k):
        part = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(k)) == i) if k > 1 else texts
        block = [(r.item_id, r.text) for r in part.distinct().collect()]
        if block or k == 1:
            yield block


def hits(docs: DataFrame, items: DataFrame, n: int = N_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs (doc_id, text, row) and block of items: words, merged [from, to) hit spans, ids of items found."""
    ship(docs.sparkSession)
    out = None
    for block in item_blocks(items, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(Index(block, lambda words: corpus_rarity(docs, words), n))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                words, spans, found = _occurrences(b.column("text"), shared.value)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("row"), pa.array(words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))], ["doc_id", "row", "n_words", "spans", "items"])

        part = docs.select("doc_id", "text", "row").mapInArrow(run, HITS)
        out = part if out is None else out.unionByName(part)
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans, items = b.column("spans").to_pylist(), b.column("items").to_pylist()
        n_hit, n_items, sha = [], [], []
        for s, x in zip(spans, items):
            end = total = 0
            for lo, hi in sorted(zip(s[::2], s[1::2])):
                total += max(0, hi - max(lo, end))
                end = max(end, hi)
            found = sorted(set(x))
            n_hit.append(total)
            n_items.append(len(found))
            sha.append(hashlib.sha256(",".join(found).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])


def contamination(docs: DataFrame, items: DataFrame, n: int = N_WORDS, min_items: int = MIN_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs; with one block, a narrow pass. Further blocks are merged per row by a shuffle."""
    many = text_bytes(items) > block_bytes
    # blocks meet again by row, since a repeated row has nothing else of its own
    docs = docs.select("doc_id", "text", (F.monotonically_increasing_id() if many else F.lit(0)).cast("long").alias("row"))
    found = hits(written(docs) if many else docs, items, n, block_bytes)
    if many:
        found = found.groupBy("doc_id", "row", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return found.mapInArrow(_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string").withColumn("contaminated", F.col("n_items") >= min_items)


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = N_WORDS, min_items: int = MIN_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows that do not hold windows of `min_items` items or more, with all their columns. Each row is judged by its own text, whatever its id and however many blocks the items take."""
    ship(docs.sparkSession)
    if text_bytes(items) > block_bytes:
        marked = written(docs.withColumn(ROW, F.monotonically_increasing_id()))
        found = hits(marked.select("doc_id", "text", F.col(ROW).alias("row")), items, n, block_bytes)
        bad = found.where(F.size("items") > 0).groupBy("row").agg(F.size(F.array_distinct(F.flatten(F.collect_list("items")))).alias("n")).where(F.col("n") >= min_items)
        return marked.join(bad.select(F.col("row").alias(ROW)), ROW, "left_anti").drop(ROW)
    (block,) = item_blocks(items, block_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(Index(block, lambda words: corpus_rarity(docs, words), n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = _occurrences(b.column("text"), shared.value)[2]
            yield b.filter(pa.array([len(x) < min_items for x in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Words and windows written out; windows meet documents by equality of the joined words, one join per window length.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT coalesce(item_id::varchar, '') AS item_id, coalesce(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') AS win FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, win)),
hw AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS k FROM m) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::bigint AS n_words, coalesce(hw.n_hit, 0)::bigint AS n_hit, coalesce(hi.n_items, 0)::bigint AS n_items,
  sha256(coalesce(hi.ids, '')) AS items_sha256, coalesce(hi.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
