"""Chat formatting in budgeted windows.

A conversation's turns become windows of at most `budget` tokens. Prefix sums of the
turns' token counts choose turn-aligned spans: each window begins with the system turn
(the conversation's first, if its role is `system`), then repeats as many of the last
turns before the span as `history` tokens allow, then goes on with new turns while they
fit. Only new assistant turns are under the loss mask, so each is a target once; a
repeated one is masked. A turn that is longer than a budget has a window of its own,
flagged over_budget: turns are never cut.

Rows are dealt by conversation and sorted by turn; each task streams its rows and holds
no more than a window, so a conversation of any length needs bounded memory. (Its digest
is sequential by definition, so one conversation is one task's stream.)

Cases: null texts and roles are empty ones; null turns come first; rows that repeat a
turn are all kept, ordered by role and text; a null conversation id is one conversation.
Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table, vocabulary_path

BUDGET, HISTORY = 1024, 256
#: what marks turns; `open` role `mid` text `close`
OPEN, MID, CLOSE = "<s>[INST]", "[/INST]", "</s>"
_CONTROL = r"([<\[])(\\*)(/?INST\]|/?s>)"
_ESCAPE, _UNESCAPE = re.compile(_CONTROL), re.compile(r"([<\[])\\(\\*)(/?INST\]|/?s>)")
WINDOWS = "conv_id long, window int, text string, loss_spans array<int>, n_repeated int, has_system boolean, n_tokens int, over_budget boolean"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long, n_over_budget long"
_tokenizers: dict = {}


def escape(text: str) -> str:
    """Puts a backslash into every control string, behind those that are there already: nothing that marks turns is left."""
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def counter(folder: str | None = None) -> Callable[[str], int]:
    """Tokens of a text under byte_bpe_multi_50k."""
    if folder not in _tokenizers:
        import base64

        import tiktoken

        with open(vocabulary_path("byte_bpe_multi_50k.tiktoken", folder), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _tokenizers[folder] = lambda text: len(encoding.encode_ordinary(text))
    return _tokenizers[folder]


def render(turns: list[tuple[str, str]], new: int) -> tuple[str, list[int]]:
    """Text of some turns, and the [from, to) places of assistant texts from turn `new` on."""
    parts, spans, at = [], [], 0
    for k, (role, text) in enumerate(turns):
        head, body = f"{OPEN}{escape(role)}{MID}", escape(text)
        parts += [head, body, CLOSE]
        if k >= new and role == "assistant":
            spans += [at + len(head), at + len(head) + len(body)]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(text: str) -> list[tuple[str, str]]:
    """Turns of a rendered text."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        mid = text.index(MID, at)
        end = text.index(CLOSE, mid)
        turns.append((unescape(text[at + len(OPEN) : mid]), unescape(text[mid + len(MID) : end])))
        at = end + len(CLOSE)
    return turns


def windows(turns: Iterator[tuple[str, str]], budget: int = BUDGET, history: int = HISTORY, count: Callable[[str], int] | None = None) -> Iterator[dict]:
    """Windows of one conversation, whose turns are read once, in order."""
    count = count or counter()
    system: list[tuple[str, str]] = []
    held: list[tuple[str, str]] = []  # repeated turns, then new ones
    # prefix sums: the tokens of the conversation before each held turn, and behind the last
    sums, own, new, number = [0], 0, 0, 0

    def window() -> dict:
        nonlocal number
        text, spans = render(system + held, len(system) * (number > 0) + new)
        tokens = own + sums[-1] - sums[0]
        out = {"window": number, "text": text, "loss_spans": spans, "n_repeated": new, "has_system": bool(system), "n_tokens": tokens, "over_budget": tokens > budget}
        number += 1
        return out

    first = True
    for role, text in turns:
        size = count(f"{OPEN}{escape(role)}{MID}{escape(text)}{CLOSE}")
        if first and role == "system":
            system, own, first = [(role, text)], size, False
            continue
        first = False
        room = budget - own
        if len(held) > new and sums[-1] - sums[0] + size > room:
            yield window()
            # the longest run of last turns whose sum fits the history, and the next turn beside it
            k = min(bisect_left(sums, sums[-1] - min(history, room - size)), len(held))
            held, sums = held[k:], sums[k:]
            new = len(held)
        held.append((role, text))
        sums.append(sums[-1] + size)
    if system or held:
        yield window()


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator]]:
    """(id, its rows) of sorted batches; the rows of one conversation must be read before the next is asked for."""
    rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(b.num_columns))))
    ahead = next(rows, None)
    while ahead is not None:
        key = ahead[0]

        def own():
            nonlocal ahead
            while ahead is not None and ahead[0] == key:
                now, ahead = ahead, next(rows, None)
                yield now[1:]

        part = own()
        yield key, part
        for _ in part:
            pass


def format_conversations(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY, folder: str | None = None) -> DataFrame:
    """Windows of all conversations: one shuffle, and windows of a conversation stay together and in order."""
    ship(rows.sparkSession)
    names = WINDOWS.split(", ")[1:]
    kinds = [pa.int32(), pa.string(), pa.list_(pa.int32()), pa.int32(), pa.bool_(), pa.int32(), pa.bool_()]
    schema = pa.schema([("conv_id", pa.int64()), *((n.split()[0], k) for n, k in zip(names, kinds))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = [], 0
        for key, turns in _conversations(batches):
            for w in windows(turns, budget, history, counter(folder)):
                made.append({"conv_id": key, **w})
                size += len(w["text"])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(made, schema=schema)
                    made, size = [], 0
        yield pa.RecordBatch.from_pylist(made, schema=schema)

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    sorted_rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *text).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return sorted_rows.select("conv_id", "role", "text").mapInArrow(run, WINDOWS)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for key, rows in _conversations(batches):
        turns_sha, loss_sha = hashlib.sha256(), hashlib.sha256()
        n = loss = chars = over = count = 0
        for number, text, spans, repeated, system, _, too_long in rows:
            turns = parse(text)
            skip = repeated + (system and number > 0)
            for role, body in turns[skip:]:
                turns_sha.update(f"{role}\n{body}\n".encode())
                n += 1
            for i, j in zip(spans[::2], spans[1::2]):
                target = unescape(text[i:j])
                loss += len(target)
                loss_sha.update(target.encode())
            chars += len(text)
            over += too_long
            count += 1
        out.append((key, n, turns_sha.hexdigest(), loss, loss_sha.hexdigest(), chars, count, over))
    names = [x.split()[0] for x in DIGEST.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(len(names))], names)


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from windows as format_conversations leaves them: in order, a conversation in one partition."""
    return formatted.mapInArrow(_read_back, DIGEST)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(rows.unionByName(own)))
