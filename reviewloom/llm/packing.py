"""Packing of tokenized documents into sequences by minimum bin slack.

Each document is tokenized whole, ended by ``END_ID`` and cut at every
``capacity`` ids, which leaves one shorter piece. What remains is bin packing of
pieces whose lengths take at most ``capacity`` values, so the whole corpus is a
histogram of that many counts. Minimum bin slack fills one window after another:
the longest remaining length starts it, and a subset-sum programme over bitsets
of reachable sums picks the multiset of remaining lengths that comes closest to
the capacity. The counts found are used for as many windows as the histogram
allows, so the plan is short however large the corpus is. Spark tokenizes, counts,
numbers the pieces of each length and looks every piece up in the plan.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reviewloom.llm.common import checkpointed

CAPACITY = 1024
END_ID = 0
CACHED_CHUNKS = 150_000
# Fixed value: how this vocabulary's byte-level pre-tokenizer cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# White space as that pattern sees it.
_BLANK = "\t-\r \x85\xa0  -     　"
_ODD_BLANK = re.compile(f" (?:[{_BLANK}]|$)")
_CHUNK = re.compile(f" ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


def _ranks(model: dict) -> dict[bytes, int] | None:
    """Token bytes by id, if ids follow the order of merges; else nothing."""
    alphabet, vocab = byte_alphabet(), model["vocab"]
    previous = -1
    for merge in model["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        if vocab[left + right] <= previous:
            return None
        previous = vocab[left + right]
    if any(c not in alphabet for token in vocab for c in token):
        vocab = {t: i for t, i in vocab.items() if all(c in alphabet for c in t)}
    return {bytes(alphabet[c] for c in token): i for token, i in vocab.items()}


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], bytes]:
    """Whole text -> its ids as little-endian unsigned 32-bit numbers.

    A text is cut before every single space that a word follows, where the
    pre-tokenizer cuts as well; chunks recur, so their ids are remembered. A text
    with a special token in it goes to the tokenizer as a whole.
    """
    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = [t["content"] for t in spec["added_tokens"]]
    before = spec.get("pre_tokenizer") or {}
    cut = before.get("type") == "ByteLevel" and before.get("use_regex", True)
    ranks = None
    if cut and not before.get("add_prefix_space") and spec.get("normalizer") is None:
        ranks = _ranks(spec["model"])

    def whole(text: str) -> bytes:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    if ranks is None:
        return whole
    own = {t: i for t, i in ranks.items() if t.decode("utf-8", "replace") not in special}
    fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own, special_tokens={})

    class Remembered(dict):
        """Chunk -> ids of ``prefix`` and chunk, computed once while there is room."""

        def __init__(self, prefix: str):
            super().__init__()
            self.prefix = prefix

        def __missing__(self, chunk: str) -> bytes:
            if len(self) >= CACHED_CHUNKS:
                self.clear()
            ids = np.array(fast.encode_ordinary(self.prefix + chunk), "<u4").tobytes()
            if len(chunk) <= 64:
                self[chunk] = ids
            return ids

    chunks, words = Remembered(""), Remembered(" ")

    def encode(text: str) -> bytes:
        if any(token in text for token in special):
            return whole(text)
        if _ODD_BLANK.search(text):
            return b"".join([chunks[c] for c in _CHUNK.findall(text)])
        first, *rest = text.split(" ")
        return (chunks[first] if first else b"") + b"".join([words[w] for w in rest])

    return encode


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    encode, task = encoder(path), TaskContext.get().partitionId()
    seen = np.zeros(capacity + 1, np.int64)
    end = np.array([END_ID], "<u4").tobytes()
    for batch in batches:
        rows, starts, lengths, sums, totals, numbers = [], [], [], [], [], []
        for row, text in enumerate(batch.column(1)):
            ids = memoryview(encode(text.as_py() or "") + end)
            total = len(ids) // 4
            for start in range(0, total, capacity):
                length = min(capacity, total - start)
                rows.append(row)
                starts.append(start)
                lengths.append(length)
                sums.append(zlib.crc32(ids[4 * start : 4 * (start + length)]))
                totals.append(total)
                numbers.append(seen[length])
                seen[length] += 1
        columns = [pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals, numbers)]
        yield pa.record_batch(
            [
                batch.column(0).take(pa.array(rows, pa.int64())),
                *columns,
                pa.array([task] * len(rows), pa.int64()),
            ],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "number", "task"],
        )


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of the counted lengths with the least slack that holds the longest one."""
    longest = max(counts)
    room = capacity - longest
    left = Counter(counts)
    left[longest] -= 1
    stages, reach, limit = [], 1, (1 << (room + 1)) - 1
    for length in sorted((x for x, n in left.items() if n > 0 and x <= room), reverse=True):
        stages.append((length, reach))
        copies, step = left[length], 1
        while copies and length * step <= room:
            step = min(step, copies)
            reach |= (reach << (length * step)) & limit
            copies -= step
            step *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen = Counter({longest: 1})
    for length, before in reversed(stages):
        while not before >> total & 1:
            total -= length
            chosen[length] += 1
    return dict(chosen)


def plan_windows(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(windows, lengths in each) until all counted pieces are used."""
    left, plan = dict(counts), []
    while left:
        chosen = fill(left, capacity)
        times = min(left[length] // n for length, n in chosen.items())
        plan.append((times, chosen))
        for length, n in chosen.items():
            left[length] -= times * n
            if not left[length]:
                del left[length]
    return plan


def _plan_rows(plan: list[tuple[int, dict[int, int]]]) -> list[tuple[int, ...]]:
    """(length, first number, end, first sequence, pieces in each, offset in each)."""
    rows, used, sequence = [], Counter(), 0
    for times, chosen in plan:
        offset = 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            rows.append((length, used[length], used[length] + times * n, sequence, n, offset))
            used[length] += times * n
            offset += n * length
        sequence += times
    return rows


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    Columns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A
    null text is empty; an empty document is its end id alone. Rows without id and
    repeated rows are documents like any other. An empty table gives an empty
    result. ``tokenizer`` is the path of a tokenizer file on every machine.
    """
    pieces = checkpointed(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")).mapInArrow(
            lambda batches: _pieces(batches, tokenizer, capacity),
            "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, number long, task long",
        )
    )
    by_task = checkpointed(pieces.groupBy("task", "length").agg(F.count("*").alias("n")))
    # At most ``capacity`` rows, however many documents there are.
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = docs.sparkSession.createDataFrame(
        _plan_rows(plan_windows(counts, capacity)),
        "length long, low long, high long, sequence long, each long, base long",
    )
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0))).select(
        "task", "length", "skip"
    )
    numbered = pieces.join(offsets, ["task", "length"]).withColumn("nth", F.col("number") + F.col("skip"))
    place = F.col("nth") - F.col("low")
    return (
        numbered.join(F.broadcast(plan), "length")
        .filter("nth >= low and nth < high")
        .select(
            "doc_id",
            "start",
            "length",
            "ids_crc32",
            "doc_tokens",
            (F.col("sequence") + F.floor(place / F.col("each"))).alias("sequence_id"),
            (F.col("base") + place % F.col("each") * F.col("length")).alias("offset"),
        )
    )
