"""Substring deduplication with a compressed FM-index per shard.

A passage is a duplicate if the `n` words of some window in it also start in a document
with a smaller id. To bring equal windows to one shard without sending every text to every
shard, each window is named by its minimiser, the smallest hash among its word 5-grams:
equal windows have equal minimisers. Documents are first written as compressed blocks. Every
block then sends each of its distinct minimisers once, with the smallest and the largest
document id that have it and their number, packed by hash bucket, and learns which ones
documents with other ids have too: only their windows can be duplicates. Runs of such
windows with one minimiser go to its shard, packed and compressed. A minimiser in more than
`hot` documents is split further: each block sends its distinct windows once, with their
smallest document id, to the shard of their own content, and learns the smallest of all.
So no passage, however common, gathers more than one entry of each block in a task.

Each shard indexes its distinct runs and streams them through the index: matching
statistics by backward search over the wavelet matrix give, at every word, the longest match
ending there, and where it reaches n words the interval of places, whose smallest document
id decides for every occurrence; and every block learns the covered words of its documents.

Cases: null and empty texts have no words; a null id is larger than any other and equal to
none; rows that repeat an id do not remove each other's words. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, discard, packed, ragged, ship, slices, starts, table, unpacked, written
from .fmindex import FMIndex

N_WORDS, GRAM, HOT = 13, 5, 500
#: bytes of text whose minimisers one bucket, or whose runs one shard, gets on average
BUCKET_BYTES, SHARD_BYTES = 16 << 20, 8 << 20
LAST = (1 << 63) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_tables: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    if len(_tables.get(base, ())) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _tables[base] = np.multiply.accumulate(steps)
    return _tables[base][:n]


def word_hashes(w: Words, at_once: int = 1 << 19) -> np.ndarray:
    """64-bit hashes of all words: differences of one running polynomial, each brought back to its word's start."""
    out = np.empty(w.n, np.uint64)
    inverse = pow(int(_ODD), -1, 1 << 64)
    i = 0
    while i < w.n:  # some hundred thousand bytes at a time, or one word
        j = max(i + 1, int(np.searchsorted(w.offsets, w.offsets[i] + at_once, "right")) - 1)
        offsets = w.offsets[i : j + 1] - w.offsets[i]
        size = int(offsets[-1])
        total = np.zeros(size + 1, np.uint64)
        np.cumsum((w.packed[w.offsets[i] : w.offsets[j]].astype(np.uint64) + np.uint64(1)) * _powers(int(_ODD), size), out=total[1:])
        out[i:j] = (total[offsets[1:]] - total[offsets[:-1]]) * _powers(inverse, size + 1)[offsets[:-1]] + np.diff(offsets).astype(np.uint64)
        i = j
    return mix(out)


def minimisers(w: Words, n: int = N_WORDS, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows of n words within texts, and the windows' minimisers."""
    h = word_hashes(w)
    m = len(h) - n + 1
    if m < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.zeros(len(h) - gram + 1, np.uint64)
    for k in range(gram):
        grams = grams * _ODD + h[k : len(grams) + k]
    grams = mix(grams)
    width = n - gram + 1
    low, have = grams, 1
    while have < width:
        by = min(have, width - have)
        low = np.minimum(low[: len(low) - by], low[by:])
        have += by
    inside = np.repeat(w.first[1:] - n, np.diff(w.first))[:m]
    start = np.flatnonzero(np.arange(m) <= inside)
    return start, low[start]


def _blocks(docs: DataFrame) -> DataFrame:
    """block, size, data: the rows of docs (with doc_id and text) packed by some MB of text, as a table in the shared folder."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 24
        for number, b in enumerate(slices(batches), part):
            size = int(pc.sum(pc.binary_length(b.column("text"))).as_py() or 0)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([size], pa.int64()), pa.array([packed(b)], pa.binary())], ["block", "size", "data"])

    return written(docs.mapInArrow(run, "block long, size long, data binary"))


def _ids(b: pa.RecordBatch) -> np.ndarray:
    """Document ids of a block's rows; a null one is the last."""
    return b.column("doc_id").cast(pa.int64()).fill_null(LAST).to_numpy()


def _replies(block: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """block, told: rows about a block's documents, packed for the block that asked for them."""
    order = np.argsort(block, kind="stable")
    own, cut = starts(block[order])
    rows = pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))
    data = [packed(rows.take(pa.array(order[i:j]))) for i, j in zip(cut[:-1], cut[1:])]
    return pa.table({"block": pa.array(own, pa.int64()), "told": pa.array(data, pa.binary())})


def _gathered(replies: DataFrame) -> DataFrame:
    """block and all that it is told, of which there is no more than it has words."""
    return replies.groupBy("block").agg(F.collect_list("told").alias("told"))


def _told(told: pa.Scalar) -> pa.Table:
    return pa.Table.from_batches([unpacked(x) for x in told.as_py()])


def shared_minimisers(blocks: DataFrame, buckets: int, n: int = N_WORDS, hot: int = HOT) -> DataFrame:
    """block, told (low, hot): the minimisers of a block that documents with different ids have, and whether more than `hot` do."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in batches:
            for number, blob in zip(blobs.column("block").to_pylist(), blobs.column("data")):
                b = unpacked(blob.as_py())
                w, ids = Words(b.column("text")), _ids(b)
                start, low = minimisers(w, n)
                doc = np.searchsorted(w.first, start, "right") - 1
                new = np.ones(len(low), bool)
                new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
                low, doc = low[new], ids[doc[new]]
                order = np.argsort(low, kind="stable")
                low, cut = starts(low[order])
                if not len(low):
                    continue
                doc = doc[order]
                least, most, count = np.minimum.reduceat(doc, cut[:-1]), np.maximum.reduceat(doc, cut[:-1]), np.diff(cut)
                bucket = (mix(low) % np.uint64(buckets)).astype(np.int64)
                # most minimisers are in one document: they need no second id and number
                order = np.lexsort((count > 1, bucket))
                some, cut = starts(bucket[order])
                data, more = [], []
                for i, j in zip(cut[:-1], cut[1:]):
                    own = order[i:j]
                    many = own[count[own] > 1]
                    data.append(np.stack([low[own].view(np.int64), least[own]]).tobytes())
                    more.append(np.stack([most[many], count[many]]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(np.full(len(some), number), pa.int64()), pa.array(data, pa.binary()), pa.array(more, pa.binary())], ["bucket", "block", "data", "more"])

    def meet(key, group):
        parts = [np.frombuffer(x.as_py(), np.int64).reshape(2, -1) for x in group.column("data")]
        more = [np.frombuffer(x.as_py(), np.int64).reshape(2, -1) for x in group.column("more")]
        low, least = np.concatenate(parts, axis=1)
        most, count = least.copy(), np.ones(len(low), np.int64)
        at = 0
        for p, m in zip(parts, more):  # the minimisers of several documents are a part's last
            at += p.shape[1]
            if m.shape[1]:
                most[at - m.shape[1] : at], count[at - m.shape[1] : at] = m
        block = np.repeat(group.column("block").to_numpy(), [p.shape[1] for p in parts])
        order = np.argsort(low, kind="stable")
        cut = np.array(starts(low[order])[1])
        size = np.diff(cut)
        apart = np.minimum.reduceat(least[order], cut[:-1]) < np.maximum.reduceat(most[order], cut[:-1])
        often = np.add.reduceat(count[order], cut[:-1]) > hot
        some = np.flatnonzero(np.repeat(apart, size))
        return _replies(block[order][some], low=low[order][some], hot=np.repeat(often, size)[some])

    sent = blocks.select("block", "data").mapInArrow(deal, "bucket long, block long, data binary, more binary")
    return _gathered(sent.groupBy("bucket").applyInArrow(meet, "block long, told binary"))


RUNS = "kind int, block long, shard long, data binary"


def runs(blocks: DataFrame, told: DataFrame, shards: int, n: int = N_WORDS) -> DataFrame:
    """Candidate windows. kind 0: packs for a shard of what a block sends there: runs (content, words joined by a space) and
    where they occur (doc_id, doc, at), or the block's distinct windows of hot minimisers: the smallest doc_id, doc their number,
    at -1, or -2 if the block has them several times. kind 1: where a block has those windows (nth, doc_id, doc, at)."""

    def row(kind: int, block: int, shard: np.ndarray, data: list[bytes]) -> pa.RecordBatch:
        many = len(data)
        return pa.RecordBatch.from_arrays([pa.array(np.full(many, kind), pa.int32()), pa.array(np.full(many, block), pa.int64()), pa.array(shard, pa.int64()), pa.array(data, pa.binary())], ["kind", "block", "shard", "data"])

    def dealt(block: int, shard: np.ndarray, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        order = np.argsort(shard, kind="stable")
        some, cut = starts(shard[order])
        if len(some):
            yield row(0, block, some, [packed(rows.take(pa.array(order[i:j]))) for i, j in zip(cut[:-1], cut[1:])])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in batches:
            for number, blob, replies in zip(blobs.column("block").to_pylist(), blobs.column("data"), blobs.column("told")):
                b, shared = unpacked(blob.as_py()), _told(replies).sort_by("low")
                w = Words(b.column("text"))
                start, low = minimisers(w, n)
                have = shared.column("low").to_numpy()
                order = np.argsort(low.view(np.int64), kind="stable")  # sorted, both sides are in cache
                at = np.empty(len(low), np.int64)
                at[order] = np.minimum(np.searchsorted(have, low.view(np.int64)[order]), len(have) - 1)
                pick = np.flatnonzero(have[at] == low.view(np.int64))
                if not len(pick):
                    continue
                kind = 1 + shared.column("hot").to_numpy()[at[pick]].astype(np.int8)
                start, low = start[pick], low[pick]
                doc = np.searchsorted(w.first, start, "right") - 1
                new = np.ones(len(pick), bool)
                new[1:] = (kind[1:] == 2) | (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
                begin = np.flatnonzero(new)
                last = np.append(begin[1:], len(pick)) - 1
                lengths = np.diff(w.offsets)
                place = np.concatenate([[0], np.cumsum(lengths + 1)])
                joined = np.full(int(place[-1]), 32, np.uint8)
                joined[np.arange(len(w.packed)) + np.repeat(np.arange(w.n), lengths)] = w.packed
                body = joined.tobytes()
                content = [body[i:j] for i, j in zip(place[start[begin]].tolist(), (place[start[last] + n] - 1).tolist())]
                d = doc[begin]
                rows = pa.RecordBatch.from_arrays([pa.array(content, pa.binary()), pa.array(_ids(b)[d]), pa.array(d.astype(np.int32)), pa.array((start[begin] - w.first[d]).astype(np.int32))], ["content", "doc_id", "doc", "at"])
                plain, many = np.flatnonzero(kind[begin] == 1), np.flatnonzero(kind[begin] == 2)
                yield from dealt(number, (mix(low[begin][plain]) % np.uint64(shards)).astype(np.int64), rows.take(pa.array(plain)))
                if len(many):
                    one = rows.take(pa.array(many))
                    coded = one.column("content").dictionary_encode()
                    nth, ids = coded.indices.to_numpy(zero_copy_only=False), one.column("doc_id").to_numpy()
                    least = np.full(len(coded.dictionary), LAST)
                    np.minimum.at(least, nth, ids)
                    name = np.fromiter((xxhash.xxh3_64_intdigest(c) for c in coded.dictionary.to_pylist()), np.uint64, len(least))
                    single = np.bincount(nth, minlength=len(least)) == 1
                    distinct = pa.RecordBatch.from_arrays([coded.dictionary, pa.array(least), pa.array(np.arange(len(least), dtype=np.int32)), pa.array(np.where(single, -1, -2).astype(np.int32))], ["content", "doc_id", "doc", "at"])
                    yield from dealt(number, (name % np.uint64(shards)).astype(np.int64), distinct)
                    where = pa.RecordBatch.from_arrays([pa.array(nth, pa.int32()), *(one.column(c) for c in ("doc_id", "doc", "at"))], ["nth", "doc_id", "doc", "at"])
                    yield row(1, number, np.array([-1]), [packed(where)])

    return blocks.select("block", "data").join(told, "block").mapInArrow(make, RUNS)


def search_shard(contents: pa.Array, owner: np.ndarray, n: int = N_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """For distinct texts (words joined by spaces) and their smallest document ids: per window, the smallest id it starts in; offsets of each text's windows."""
    w = Words(contents)
    codes, _ = w.coded()
    count = np.diff(w.first)
    # texts one after another, each followed by the symbol 0
    begin = w.first[:-1] + np.arange(len(count))
    text = np.zeros(w.n + len(count), np.int64)
    text[np.arange(w.n) + np.repeat(np.arange(len(count)), count)] = codes + 1
    index = FMIndex(text)
    windows = np.maximum(count - n + 1, 0)
    offs = np.concatenate([[0], np.cumsum(windows)])
    row = np.repeat(np.arange(len(count)), windows)
    ends = begin[row] + np.arange(offs[-1]) - offs[row] + n
    length, lo, hi = index.matching(text, ends, n, own=True)
    least = owner[row].copy()
    found = np.flatnonzero(length == n)
    if len(found):
        of = np.repeat(owner, count + 1)[index.order]
        at, inverse = np.unique(lo[found], return_inverse=True)
        end = np.zeros(len(at), np.int64)
        end[inverse] = hi[found]
        # intervals of equally long patterns are apart, so minima over them come from one pass
        edge = np.stack([at, end], axis=1).ravel()
        least[found] = np.minimum.reduceat(np.append(of, LAST), edge)[::2][inverse]
    return least, offs


def removed_by_shard(made: DataFrame, n: int = N_WORDS) -> DataFrame:
    """block, told (doc, at, least): windows that a smaller document has, of the runs in packs (block, shard, data); and for a block's distinct
    windows (doc: their number, at: -1) the smallest document id, unless it is that of the block's only one. A shard has its distinct runs indexed, and all their occurrences."""

    def search(key, group):
        parts = [unpacked(x.as_py()) for x in group.column("data")]
        rows = pa.Table.from_batches(parts).combine_chunks()
        coded = rows.column("content").combine_chunks().dictionary_encode()
        run = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids, doc, at = (rows.column(c).to_numpy() for c in ("doc_id", "doc", "at"))
        owner = np.full(len(coded.dictionary), LAST)
        np.minimum.at(owner, run, ids)
        least, offs = search_shard(coded.dictionary, owner, n)
        block = np.repeat(group.column("block").to_numpy(), [p.num_rows for p in parts])
        plain, own = np.flatnonzero(at >= 0), least[offs[run]]
        hot = np.flatnonzero((at == -2) | (at == -1) & (own < ids))
        place, cut = ragged(run[plain], offs)
        row = np.repeat(plain, np.diff(cut))
        start = at[row] + np.arange(len(row)) - np.repeat(cut[:-1], np.diff(cut))
        gone = np.flatnonzero(least[place] < ids[row])
        row, start = row[gone], start[gone]
        every = np.append(row, hot)
        return _replies(block[every], doc=doc[every], at=np.append(start, np.full(len(hot), -1)).astype(np.int32), least=np.append(np.zeros(len(row), np.int64), own[hot]))

    return made.groupBy("shard").applyInArrow(search, "block long, told binary")


def coverage(docs: DataFrame, n: int = N_WORDS, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """data, told: the blocks of docs, and what each is told of its duplicate windows (null: it has none)."""
    blocks = _blocks(docs)
    size = blocks.agg(F.sum("size")).first()[0] or 0
    made = written(runs(blocks, shared_minimisers(blocks, max(8, size // bucket_bytes), n, hot), max(8, size // shard_bytes), n))
    replies = removed_by_shard(made.where("kind = 0").select("block", "shard", "data"), n)
    found = written(_gathered(replies.unionByName(made.where("kind = 1").select("block", F.col("data").alias("told")))))
    discard(made)
    return blocks.select("block", "data").join(found, "block", "left").select("data", "told")


_NONE = pa.RecordBatch.from_arrays([pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.int64())], ["doc", "at", "least"])


def covered_words(w: Words, told: pa.Scalar, n: int) -> np.ndarray:
    """Flags of a block's words that its duplicate windows cover."""
    mark = np.zeros(w.n + 1, np.int64)
    if told.is_valid:
        parts = [unpacked(x) for x in told.as_py()]
        replies = pa.Table.from_batches([p for p in parts if "least" in p.schema.names] or [_NONE])
        doc, at, least = (replies.column(c).to_numpy() for c in ("doc", "at", "least"))
        begin = [at[at >= 0] + w.first[doc[at >= 0]]]
        first_of = np.full(int(doc[at < 0].max(initial=-1)) + 1, LAST)
        first_of[doc[at < 0]] = least[at < 0]
        for p in parts:
            if "nth" in p.schema.names:
                nth, ids, doc, at = (p.column(c).to_numpy() for c in ("nth", "doc_id", "doc", "at"))
                heard = nth < len(first_of)
                heard[heard] = first_of[nth[heard]] < ids[heard]
                begin.append(at[heard] + w.first[doc[heard]])
        at = np.unique(np.concatenate(begin))
        mark[at] += 1
        mark[at + n] -= 1
    return np.cumsum(mark[:-1]) > 0


def removals(docs: DataFrame, n: int = N_WORDS, **sizes: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in batches:
            for blob, told in zip(blobs.column("data"), blobs.column("told")):
                b = unpacked(blob.as_py())
                w = Words(b.column("text"))
                gone = covered_words(w, told, n)
                lengths = np.diff(w.offsets)
                place = np.concatenate([[0], np.cumsum(np.where(gone, 0, lengths + 1))])
                joined = np.full(int(place[-1]), 32, np.uint8)
                own = np.repeat(~gone, lengths)
                joined[(np.arange(len(w.packed)) - np.repeat(w.offsets[:-1] - place[:-1], lengths))[own]] = w.packed[own]
                body = memoryview(joined)
                cut = place[w.first].tolist()
                sha = [hashlib.sha256(body[i : max(i, j - 1)]).hexdigest() for i, j in zip(cut[:-1], cut[1:])]
                total = np.concatenate([[0], np.cumsum(gone)])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(w.first), pa.int64()), pa.array(np.diff(total[w.first]), pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    found = coverage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), n, **sizes)
    return found.mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_texts(docs: DataFrame, n: int = N_WORDS, **sizes: int) -> DataFrame:
    """docs with duplicate words cut from text, each with the white space after it; n_chars, if there, counts anew. Texts of which nothing is left are dropped."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in batches:
            for blob, told in zip(blobs.column("data"), blobs.column("told")):
                b = unpacked(blob.as_py())
                w = Words(b.column("text"))
                gone = covered_words(w, told, n)
                total = np.concatenate([[0], np.cumsum(gone)])
                lost = np.diff(total[w.first])
                text, body = b.column("text").to_pylist(), w.data.tobytes()
                for d in np.flatnonzero(lost).tolist():
                    i, j = int(w.first[d]), int(w.first[d + 1])
                    begin, until = w.starts[i:j].tolist(), [*w.starts[i + 1 : j].tolist(), int(w.text_offsets[d + 1])]
                    parts = [body[int(w.text_offsets[d]) : begin[0]]] + [body[begin[k] : until[k]] for k in np.flatnonzero(~gone[i:j]).tolist()]
                    text[d] = b"".join(parts).decode("utf-8", "replace")
                cols = dict(zip(b.schema.names, b.columns))
                cols["text"] = pa.array(text, b.schema.field("text").type)
                if "n_chars" in cols:
                    fresh = pa.array([len(t) if k else None for t, k in zip(text, lost.tolist())], pa.int64()).cast(b.schema.field("n_chars").type)
                    cols["n_chars"] = pc.coalesce(fresh, cols["n_chars"])
                empty = (lost == np.diff(w.first)) & (lost > 0)
                yield pa.RecordBatch.from_arrays(list(cols.values()), b.schema.names).filter(pa.array(~empty))

    return coverage(docs, n, **sizes).mapInArrow(cut, docs.schema)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"))


#: Windows as joined words; a window's first document is the smallest id it starts in.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
least AS (SELECT s, min(doc_id) AS first_id FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT win.doc_id, win.i, unnest(range(0, 13)) AS k FROM win JOIN least USING (s) WHERE least.first_id < win.doc_id)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p WHERE gone.p IS NULL GROUP BY words.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::bigint AS n_words, coalesce(n.n, 0)::bigint AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
