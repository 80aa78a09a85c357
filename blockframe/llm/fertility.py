"""Quality rules by tokeniser fertility.

Public vocabularies are run over the words of each text. Measured are characters
per token under both vocabularies, the share of byte-fallback tokens, and the
entropy of the token distribution in bits. Each language in each script has rejection
bands for the four figures; a text outside one of its bands is rejected.

The bands come from the corpus itself: over all texts within the base rules and the
outer bounds, the median of a figure and its quartiles, taken exactly from counts of its thousandths; the
band reaches WIDE robust standard deviations (the quartiles' distance over 1.349, at
least FLOOR of the median) to either side. Outer bounds per script, which are fixed, hold
besides. One pass over the texts measures; its result is a table in the shared folder,
from which the counts and then the verdicts are read.

Cases: null and empty texts have no words, zero counts, null measures, and fail the
base rules. Texts of any length are read whole. Repeated rows each give a row. A text
without letters takes the bands of `other`. A language in a script with fewer texts than
LEAST, or than a thousandth of all, has no bands of its own, and neither has a null one:
they take those of all texts in the script, and where these are too few as well, the
outer bounds alone.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import SPACE, Memo, Words, ragged, ship, slices, sums, table, vocabulary_path, written


@dataclass(frozen=True)
class Band:
    """What a script's texts must lie in: characters per piece and per byte-BPE token, share of byte fallback, bits of entropy."""

    piece_chars: tuple[float, float] = (1.0, 12.0)
    byte_chars: tuple[float, float] = (1.0, 12.0)
    max_fallback: float = 0.25
    entropy: tuple[float, float] = (2.5, 16.0)


#: Outer bounds per script. Alphabets give several characters a token; scripts that the vocabularies hardly know fall back to bytes and give below one.
BANDS = {
    "latin": Band((1.5, 12.0), (1.5, 12.0), 0.10, (4.0, 16.0)),
    "cyrillic": Band((1.0, 12.0), (0.4, 12.0), 0.15, (3.0, 16.0)),
    "greek": Band((0.7, 12.0), (0.4, 12.0), 0.50, (3.0, 16.0)),
    "arabic": Band((0.6, 12.0), (0.4, 12.0), 0.60, (3.0, 16.0)),
    "han": Band((0.25, 4.0), (0.25, 4.0), 0.85, (3.0, 16.0)),
    "other": Band((0.25, 12.0), (0.25, 12.0), 0.95, (2.5, 16.0)),
}
#: robust standard deviations to either side of the median, the least such deviation as a share of the median, and texts that a language or script needs
WIDE, FLOOR, LEAST = 4.0, 0.015, 200
MEASURES = ("piece_chars", "byte_chars", "fallback_share", "entropy_bits")
#: fallback below this share is never too much
FALLBACK = 0.05
SCRIPTS = ("latin", "cyrillic", "greek", "arabic", "han", "other")
#: Script of a letter by its first UTF-8 byte; 255 where the byte starts no letter.
LEAD = np.full(256, 255, np.uint8)
LEAD[65:91] = LEAD[97:123] = LEAD[0xC3:0xCA] = 0
LEAD[0xD0:0xD4] = 1
LEAD[0xCE:0xD0] = 2
LEAD[0xD8:0xDC] = 3
LEAD[0xE3:0xEE] = 4
LEAD[[0xD4, 0xD5, 0xD6, 0xD7, 0xDC, 0xDD, 0xDE, 0xDF, 0xE0, 0xE1, 0xF0]] = 5
#: 1 for the first byte of a character that is no white space
CHAR = (((np.arange(256) & 0xC0) != 0x80) & ~SPACE).astype(np.int64)
SYMBOL = np.zeros(256, np.int64)
SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = 1
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, script string, piece_chars double, byte_chars double, fallback_share double, entropy_bits double"
_memos: dict = {}


def _encoders(folder: str | None) -> tuple[Memo, Memo, np.ndarray]:
    """Memoised encoders of this worker; the last item marks byte-fallback pieces."""
    if folder not in _memos:
        import base64

        import sentencepiece
        import tiktoken

        piece = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model", folder))
        with open(vocabulary_path("byte_bpe_50k.tiktoken", folder), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        byte = tiktoken.Encoding("fertility", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        is_byte = np.array([piece.is_byte(i) for i in range(piece.get_piece_size())])
        # of the second vocabulary only the number of tokens is wanted: one id that says how many
        _memos[folder] = (Memo(lambda w: piece.encode(w, num_threads=1)), Memo(lambda w: [[len(byte.encode_ordinary(" " + x))] for x in w]), is_byte)
    return _memos[folder]


def repeated_window_words(codes: np.ndarray, n: int = 3) -> int:
    """Words inside windows of n words that occur twice or more; codes number the words of one text."""
    m = len(codes) - n + 1
    if m < 2:
        return 0
    size = int(codes.max()) + 1
    key, top = codes[:m].astype(np.int64), size
    for k in range(1, n):
        if top * size >= 1 << 62:  # ranks instead of keys that would not fit
            key = np.unique(key, return_inverse=True)[1]
            top = m
        key = key * size + codes[k : m + k]
        top *= size
    order = np.argsort(key)
    same = key[order]
    same = same[1:] == same[:-1]
    if not same.any():
        return 0
    twice = np.zeros(m, bool)
    twice[1:] = same
    twice[:-1] |= same
    hit = order[twice]
    mark = np.zeros(len(codes) + 1, np.int64)
    np.add.at(mark, hit, 1)
    np.add.at(mark, hit + n, -1)
    return int((np.cumsum(mark[:-1]) > 0).sum())


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    """Per text, lines with a word that equal an earlier line of it."""
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    owner = pc.list_parent_indices(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lines.flatten()
    w = Words(flat)
    worded = np.diff(w.first) > 0
    code = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner, code = owner[worded], code[worded]
    n = np.bincount(owner, minlength=len(texts))
    distinct = np.unique(owner * (int(code.max(initial=0)) + 1) + code)
    return n - np.bincount(distinct // (int(code.max(initial=0)) + 1), minlength=len(texts))


def measure(texts: pa.Array, folder: str | None = None, bands: dict[str, Band] = BANDS) -> dict[str, np.ndarray]:
    """Counts, measures and verdicts by the outer bounds of a batch of texts."""
    w = Words(texts)
    codes, vocab = w.coded()
    n = np.diff(w.first)
    # bytes of each text by value: every count of characters follows from it
    seen = np.stack([np.bincount(w.data[i:j], minlength=256) for i, j in zip(w.text_offsets[:-1], w.text_offsets[1:])])
    out = {"n_words": n, "word_chars": seen @ CHAR, "n_symbols": seen @ SYMBOL, "n_dup_lines": duplicate_lines(texts)}
    piece, byte, is_byte = _encoders(folder)
    row = piece.find(vocab)
    tokens = np.zeros(len(n), np.int64)
    fallback, entropy, repeat = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n), np.int64)
    for d in range(len(n)):
        own = codes[w.first[d] : w.first[d + 1]]
        if not len(own):
            continue
        repeat[d] = repeated_window_words(own)
        at, _ = ragged(row[own], piece.offsets)
        ids = np.sort(piece.ids[at])
        cut = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]])
        count = np.diff(cut)
        cut = cut[:-1]
        tokens[d] = len(ids)
        fallback[d] = count[is_byte[ids[cut]]].sum() / len(ids)
        p = count / len(ids)
        entropy[d] = -(p * np.log2(p)).sum()
    row = byte.find(vocab)
    byte_tokens = sums(byte.ids[byte.offsets[row]][codes] if w.n else np.zeros(0, np.int64), w.first)
    letters = np.stack([seen[:, LEAD == k].sum(axis=1) for k in range(len(SCRIPTS))])
    script = np.where(letters.any(axis=0), letters.argmax(axis=0), len(SCRIPTS) - 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        out |= {"n_repeat_words": repeat, "piece_chars": out["word_chars"] / tokens, "byte_chars": out["word_chars"] / byte_tokens, "fallback_share": fallback, "entropy_bits": entropy}
    out["base_failed"] = (n < 50) | (100 * repeat > 50 * n)
    every = [bands[k] for k in SCRIPTS]
    edge = np.array([(*b.piece_chars, *b.byte_chars, b.max_fallback, *b.entropy) for b in every])[script].T
    fits = (out["piece_chars"] >= edge[0]) & (out["piece_chars"] <= edge[1]) & (out["byte_chars"] >= edge[2]) & (out["byte_chars"] <= edge[3]) & (fallback <= edge[4]) & (entropy >= edge[5]) & (entropy <= edge[6])
    out["kept"] = ~out["base_failed"] & fits
    out["script"] = script
    return out


def _columns(ids: pa.Array, m: dict[str, np.ndarray]) -> pa.RecordBatch:
    none = m["n_words"] == 0
    cols = [ids.cast(pa.int64())]
    cols += [pa.array(m[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    cols += [pa.array(m["base_failed"]), pa.array(m["kept"]), pa.array([SCRIPTS[k] for k in m["script"]], pa.string())]
    cols += [pa.array(np.asarray(m[k], float), pa.float64(), mask=none) for k in ("piece_chars", "byte_chars", "fallback_share", "entropy_bits")]
    return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SCHEMA.split(", ")])


def edges(measured: DataFrame, wide: float = WIDE, floor: float = FLOOR, least: int = LEAST) -> DataFrame:
    """script, lang (null: all languages) and `low`, `high` of the four measures, of groups with enough texts that `kept` so far.

    A text counts at its own language and at null, in thousandths of each measure: what is shuffled and sorted is
    one row for each group and thousandth that occur, partial sums having been taken before."""
    sound = measured.where("kept")
    enough = max(least, sound.count() // 1000)
    each = sound.select("script", "lang", *MEASURES)
    each = each.unionByName(each.where("lang IS NOT NULL").withColumn("lang", F.lit(None).cast("string")))
    bins = each.select("script", "lang", F.posexplode(F.array(*(F.floor(F.col(c) * 1000).cast("long") for c in MEASURES))).alias("m", "bin"))
    counts = bins.groupBy("script", "lang", "m", "bin").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("script", "lang", "m")
    ranked = counts.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("total", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bin"))) / 1000
    found = ranked.groupBy("script", "lang", "m").agg(at(0.25).alias("a"), at(0.5).alias("mid"), at(0.75).alias("b"), F.first("total").alias("total"))
    found = found.where(F.col("total") >= enough)
    reach = wide * F.greatest((F.col("b") - F.col("a")) / 1.349, floor * F.col("mid"))
    fallback = F.col("m") == MEASURES.index("fallback_share")
    low = F.when(fallback, F.lit(0.0)).otherwise(F.col("mid") - reach)
    high = F.when(fallback, F.greatest(F.col("mid") + reach, F.lit(FALLBACK))).otherwise(F.col("mid") + reach)
    own = found.select("script", "lang", "m", low.alias("low"), high.alias("high"))
    one = lambda c, k: F.max(F.when(F.col("m") == k, F.col(c)))
    return own.groupBy("script", "lang").agg(F.array(*(one("low", k) for k in range(len(MEASURES)))).alias("low"), F.array(*(one("high", k) for k in range(len(MEASURES)))).alias("high"))


def judged(measured: DataFrame, **bands: float) -> DataFrame:
    """measured, with `kept` false for what lies outside the corpus's own bands as well."""
    # a language or script with bands has a thousandth of all texts at least, so there are at most 1,000 of each
    found = edges(measured, **bands)
    of_lang = found.where("lang IS NOT NULL").select(F.col("script").alias("_s"), F.col("lang").alias("_l"), F.struct("low", "high").alias("_own"))
    of_script = found.where("lang IS NULL").select(F.col("script").alias("_t"), F.struct("low", "high").alias("_all"))
    joined = measured.join(F.broadcast(of_lang), (F.col("script") == F.col("_s")) & (F.col("lang") == F.col("_l")), "left").join(F.broadcast(of_script), F.col("script") == F.col("_t"), "left")
    edge = F.coalesce("_own", "_all")
    fits = [F.coalesce(F.col(c).between(edge["low"][k], edge["high"][k]), F.lit(True)) for k, c in enumerate(MEASURES)]
    return joined.withColumn("kept", functools.reduce(operator.and_, fits, F.col("kept"))).drop("_s", "_l", "_own", "_t", "_all")


def measures(docs: DataFrame, folder: str | None = None, bands: dict[str, Band] = BANDS, texts: bool = False) -> DataFrame:
    """The counts and measures of every row and its language, in one narrow pass, as a table in the shared folder; with the row of docs itself (`doc`), if it passes the outer bounds."""
    ship(docs.sparkSession)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(whole.alias("doc"), lang.alias("lang")) if texts else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang"))
    schema = StructType([*StructType.fromDDL(SCHEMA), *(f for f in rows.schema if f.name in ("lang", "doc"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if texts:
            batches = (pa.RecordBatch.from_arrays([*b.columns, *(b.column("doc").field(c) for c in ("doc_id", "text"))], ["doc", "lang", "doc_id", "text"]) for b in batches)
        more = [c.name for c in schema if c.name in ("doc", "lang")]
        for b in slices(batches):
            out = _columns(b.column("doc_id"), measure(b.column("text"), folder, bands))
            out = pa.RecordBatch.from_arrays([*out.columns, *(b.column(c) for c in more)], [*out.schema.names, *more])
            yield out.filter(out.column("kept")) if texts else out

    return written(rows.mapInArrow(run, schema))


def quality(docs: DataFrame, folder: str | None = None, bands: dict[str, Band] = BANDS, **wide: float) -> DataFrame:
    """Counts, measures and verdict of every row: texts are read once, and only counts of measures are shuffled."""
    return judged(measures(docs, folder, bands), **wide).drop("lang")


def keep_quality(docs: DataFrame, folder: str | None = None, bands: dict[str, Band] = BANDS, **wide: float) -> DataFrame:
    """The rows that the rules keep, with all their columns."""
    # what fails the base rules or the outer bounds takes no part in the bands, and is not written
    return judged(measures(docs, folder, bands, texts=True), **wide).where("kept").select("doc.*")


def op3_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
