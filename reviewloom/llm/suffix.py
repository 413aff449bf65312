"""Removal of repeated byte strings by bucket-pointer refinement.

A suffix array of all bytes of a corpus is many times the corpus. Buckets of
q-grams are enough here, because only strings of ``WINDOW`` bytes matter:

1. Each window hands itself to one q-gram in it, the one with the smallest hash
   (the leftmost of equals). Equal windows choose alike, so only about every 35th
   position becomes the pointer of a bucket. Its run of windows goes with it.
2. A bucket is refined by the identifier of what surrounds its pointers, all windows
   they own. Pointers of equal surroundings are copies: the first, by document and
   start, stays and the windows of the others are to be removed. A bucket that is
   left with one pointer is done.
3. The first pointers of what is left are refined by the identifiers (rolling
   hashes) of every window they own, which are made from each other by reusing the
   prefix sums of the shared text. Again the first of equal windows stays.

Copies inside one batch are resolved there. Buckets with many different
surroundings go by whole windows instead of by q-gram, so that no task gets a common
phrase. Shuffled are pointers (about 24 bytes for 35 bytes of text), the surroundings
of the few that step 2 leaves, and the texts once: both joins with the texts read the
same exchange.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import row_slices, small_side, text_bytes, whole_groups, written

WINDOW = 100
GRAM = 32
CHOICES = WINDOW - GRAM + 1  # q-grams in a window
HOT = 1000  # pointers of a bucket from which it goes by whole windows
PIECE_BITS = 20
PIECE = 1 << PIECE_BITS
HELD = 200_000  # surroundings a task holds to resolve repeats among them
_MULTIPLIER = 0x9E3779B97F4A7C15
_U = np.uint64


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random number of each byte; powers of an odd number and of its inverse."""
    codes = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * _U(2) + _U(1)
    inverse = pow(_MULTIPLIER, -1, 1 << 64)

    def powers(base: int) -> np.ndarray:
        out = np.full(PIECE + 1, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return codes, powers(_MULTIPLIER), powers(inverse)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(32)) * _U(0xD6E8FEB86659FD93)
    return (x ^ x >> _U(29)) * _U(0xC2B2AE3D27D4EB4F)


def _sums(data: np.ndarray) -> np.ndarray:
    codes, powers, _ = _tables()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * powers[: len(data)], out=sums[1:])
    return sums


def _hashes(sums: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the strings of ``length`` bytes that start at ``at``."""
    return _mix((sums[at + length] - sums[at]) * _tables()[2][at])


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    least = values
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def pointers(data: np.ndarray, offsets: np.ndarray):
    """(row, pointer, first window, number of windows, hash) of all rows, in order.

    ``data`` holds at most ``PIECE`` bytes, the rows' texts one after another.
    """
    lengths = np.maximum(np.diff(offsets) - WINDOW + 1, 0)
    if not lengths.sum():
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty, empty
    ends = np.cumsum(lengths)
    starts = np.arange(ends[-1]) + np.repeat(offsets[:-1] - (ends - lengths), lengths)
    hashes = _hashes(_sums(data), np.arange(len(data) - GRAM + 1), GRAM)
    low = _U(PIECE - 1)
    ranked = hashes & ~low | np.arange(len(hashes), dtype=np.uint64)
    chosen = (_sliding_least(ranked, CHOICES)[starts] & low).astype(np.int64)
    first = np.flatnonzero(np.diff(chosen, prepend=-1))
    row = np.searchsorted(ends, first, "right")
    at = chosen[first]
    count = np.diff(np.append(first, len(chosen)))
    base = offsets[row]
    return row, at - base, starts[first] - base, count, hashes[at].view(np.int64)


def pack_code(at, first, count, mark):
    """Pointer, windows before it, number of windows and the text's mark in one long."""
    return ((at << 7 | at - first) << 7 | count - 1) << 16 | mark


def unpack_code(code):
    at = code >> 30
    return at, at - (code >> 23 & 127), (code >> 16 & 127) + 1, code & 0xFFFF


def _surroundings_of(data: np.ndarray, at, first, count) -> np.ndarray:
    """Identifiers of the bytes of each pointer's windows and its place in them."""
    sums = _sums(data)
    whole = (sums[first + count - 1 + WINDOW] - sums[first]) * _tables()[2][first]
    return _mix(whole + ((at - first) << 7 | count).astype(np.uint64) * _U(_MULTIPLIER))


def pack_class(surroundings: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """44 bits of the identifier, and how many different surroundings the batch has, below 2^20."""
    return (
        surroundings >> _U(20) << _U(20) | np.minimum(seen, (1 << 20) - 1).astype(np.uint64)
    ).view(np.int64)


def _pointed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, gram, doc, code, kind, until): one row for each bucket and surroundings of a batch.

    The first row of a bucket is keyed by its q-gram and carries the number of
    surroundings; the others are known to go on and are spread. Copies within the
    batch become intervals to remove, ``until`` being their end.
    """
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        doc, mark = (batch.column(c).to_numpy() for c in ("doc", "mark"))
        parts = []
        for low, high in row_slices(offsets, PIECE):
            own = data[offsets[low] : offsets[high]]
            edges = offsets[low : high + 1] - offsets[low]
            # A longer text is cut so that every window lies in one piece.
            for start in range(0, max(len(own) - WINDOW + 1, 1), PIECE - WINDOW + 1):
                piece = own[start : start + PIECE]
                if len(own) > PIECE:
                    edges = np.array([0, len(piece)])
                row, at, first, count, hashes = pointers(piece, edges)
                base = edges[row]
                around = _surroundings_of(piece, at + base, first + base, count)
                parts.append((row + low, at + start, first + start, count, hashes, around))
                if len(own) <= PIECE:
                    break
        if not parts:
            continue
        row, at, first, count, hashes, around = map(np.concatenate, zip(*parts))
        owner, marks = doc[row], mark[row].astype(np.int64)
        order = np.lexsort((at, owner, around, hashes))
        hashes, around, owner, marks, at, first, count = (
            x[order] for x in (hashes, around, owner, marks, at, first, count)
        )
        new_gram = np.ones(len(hashes), bool)
        new_gram[1:] = hashes[1:] != hashes[:-1]
        new = new_gram.copy()
        new[1:] |= around[1:] != around[:-1]
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        copy = (owner != owner[head]) | (at != at[head])
        yield _intervals_out(*_merged(*_windows(owner[copy], marks[copy], first[copy], count[copy])))

        # A repeated row stands where its document does; one of them is enough.
        code = pack_code(at, first, count, marks)
        kept = ~copy & (new | (marks != marks[head]))
        gram_of = np.cumsum(new_gram) - 1
        seen = np.bincount(gram_of[kept])[gram_of] * new_gram
        kept, seen = np.flatnonzero(kept), seen.astype(np.int64)
        spread = _mix(hashes.view(np.uint64) + code.view(np.uint64)).view(np.int64)
        leads = seen[kept] > 0
        yield pa.record_batch(
            [
                pa.array(np.where(leads, hashes[kept], spread[kept])),
                pa.array(np.where(leads, 0, hashes[kept])),
                pa.array(owner[kept]),
                pa.array(code[kept]),
                pa.array(pack_class(around[kept], seen[kept])),
                pa.array(np.zeros(len(kept), np.int64)),
            ],
            names=_POINTER_NAMES,
        )


_POINTER_NAMES = ["key", "gram", "doc", "code", "kind", "until"]
_POINTERS = ", ".join(f"{name} long" for name in _POINTER_NAMES)


def _windows(doc, mark, first, count):
    """One line for each window."""
    line = np.repeat(np.arange(len(doc)), count)
    step = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)
    return doc[line], mark[line], first[line] + step


def _intervals_out(doc, mark, start, end) -> pa.RecordBatch:
    """Intervals to remove, as rows among pointers; spread by where they are."""
    spread = _mix(doc.astype(np.uint64) * _U(_MULTIPLIER) + start.astype(np.uint64))
    code = pack_code(start, start, np.ones(len(doc), np.int64), mark)
    none = np.zeros(len(doc), np.int64)
    columns = (spread.view(np.int64), none, doc, code, none, end)
    return pa.record_batch([pa.array(x, pa.int64()) for x in columns], names=_POINTER_NAMES)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, doc, code, total, until): copies as intervals, and what must be refined further."""
    names = ["gram", "doc", "code", "total", "until"]
    for group in whole_groups(batches, "key"):
        key, gram, doc, code, kind, until = (group.column(c).to_numpy() for c in _POINTER_NAMES)
        seen = kind & (1 << 20) - 1
        lead = np.flatnonzero((until == 0) & (seen > 0))
        rest = np.flatnonzero((until > 0) | (seen == 0))
        yield pa.record_batch(
            [pa.array(x[rest]) for x in (gram, doc, code, np.zeros_like(seen), until)], names=names
        )
        key, doc, code, kind, seen = (x[lead] for x in (key, doc, code, kind, seen))
        around, at = kind >> 20, code >> 30
        order = np.lexsort((at, doc, around, key))
        key, doc, code, around, seen, at = (x[order] for x in (key, doc, code, around, seen, at))
        new_key = np.ones(len(key), bool)
        new_key[1:] = key[1:] != key[:-1]
        new = new_key.copy()
        new[1:] |= around[1:] != around[:-1]
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        copy = (doc != doc[head]) | (at != at[head])
        bucket = np.cumsum(new_key) - 1
        # More than one kind of surroundings, here or in a batch.
        kinds = np.bincount(bucket, new) + np.bincount(bucket, seen - 1)
        total = np.bincount(bucket, seen)[bucket].astype(np.int64)
        mixed = (kinds > 1)[bucket] & ~copy if len(key) else copy
        _, first, count, _ = unpack_code(code)
        start_code = pack_code(first, first, np.ones(len(key), np.int64), code & 0xFFFF)
        end = first + count - 1 + WINDOW
        yield pa.record_batch(
            [
                pa.array(np.concatenate([x[mixed], y[copy]]))
                for x, y in (
                    (key, key),
                    (doc, doc),
                    (code, start_code),
                    (total, total),
                    (np.zeros_like(end), end),
                )
            ],
            names=names,
        )


def _merged(doc, mark, start):
    """Intervals covered by the windows that start at ``start``."""
    order = np.lexsort((start, mark, doc))
    doc, mark, start = doc[order], mark[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (start[1:] > start[:-1] + WINDOW)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1 if len(doc) else first
    return doc[first], mark[first], start[first], start[last] + WINDOW


_SURROUNDED = "key long, doc long, code long, until long, part binary"


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each repeated pointer the bytes of its windows; those equal in the task are resolved.

    ``until`` is 0 for what others must see, else the end of an interval to remove.
    """
    held: dict[bytes, tuple[int, int]] = {}
    resolved: list[tuple[int, int, int, int]] = []  # doc, mark, first window, windows

    def place(key, doc: int, code: int) -> None:
        """Keep the first occurrence of equal bytes; what loses is resolved."""
        before = held.setdefault(key, (doc, code))
        if before == (doc, code):
            return
        at, first, count, mark = unpack_code(code)
        old_at, old_first, old_count, old_mark = unpack_code(before[1])
        if (doc, at) == (before[0], old_at):
            same.append((key, doc, code))
        elif (doc, at) < (before[0], old_at):
            held[key] = (doc, code)
            resolved.append((before[0], old_mark, old_first, old_count))
        else:
            resolved.append((doc, mark, first, count))

    same: list = []

    def flush() -> Iterator[pa.RecordBatch]:
        rows = [(key, *value) for key, value in held.items()] + same
        keys = [key for key, _, _ in rows]
        names = np.array([k[0] for k in keys], np.int64)
        yield pa.record_batch(
            [
                pa.array(names, pa.int64()),
                pa.array([doc for _, doc, _ in rows], pa.int64()),
                pa.array([code for _, _, code in rows], pa.int64()),
                pa.array(np.zeros(len(rows), np.int64)),
                pa.array([k[1] for k in keys], pa.binary()),
            ],
            names=["key", "doc", "code", "until", "part"],
        )
        if resolved:
            doc, mark, start, end = _merged(*_windows(*np.array(resolved, np.int64).T))
            code = pack_code(start, start, np.ones(len(doc), np.int64), mark)
            spread = _mix(doc.view(np.uint64) * _U(_MULTIPLIER) + start.view(np.uint64))
            yield pa.record_batch(
                [
                    pa.array(spread.view(np.int64)),
                    pa.array(doc),
                    pa.array(code),
                    pa.array(end),
                    pa.nulls(len(doc), pa.binary()),
                ],
                names=["key", "doc", "code", "until", "part"],
            )
        held.clear()
        resolved.clear()
        same.clear()

    digest = xxhash.xxh64_intdigest
    for batch in batches:
        for doc, text, codes in zip(*(batch.column(c) for c in ("doc", "text", "codes"))):
            doc, data = doc.as_py(), text.as_py().encode("utf-8")
            for item in codes.as_py():
                code = item["code"]
                at, first, count, mark = unpack_code(code)
                if not item["hot"]:
                    gram = digest(data[at : at + GRAM]) - (1 << 63)
                    place((gram, data[first : first + count - 1 + WINDOW], at - first), doc, code)
                    continue
                for start in range(first, first + count):
                    window = digest(data[start : start + WINDOW], 1) - (1 << 63)
                    place((window, None), doc, pack_code(start, start, 1, mark))
            if len(held) + len(resolved) >= HELD:
                yield from flush()
    yield from flush()


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, mark, start, end): intervals of windows that are not the first of their kind."""
    names = ["doc", "mark", "start", "end"]
    for group in whole_groups(batches, "key"):
        key, doc, code, until = (group.column(c).to_numpy() for c in ("key", "doc", "code", "until"))
        at, first, count, mark = unpack_code(code)
        done = np.flatnonzero(until > 0)
        yield pa.record_batch([pa.array(x[done]) for x in (doc, mark, first, until)], names=names)
        open_ = np.flatnonzero(until == 0)
        if not len(open_):
            continue
        key, doc, first, count, mark = (x[open_] for x in (key, doc, first, count, mark))
        # A row by whole window has no bytes and one window; its key tells it apart.
        parts = group.column("part").combine_chunks().take(pa.array(open_))
        line = np.repeat(np.arange(len(key)), count)
        step = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)
        bytes_, offsets = _binary(parts)
        identity = np.zeros(len(line), np.uint64)
        ends = np.cumsum(count)
        for low, high in row_slices(offsets, PIECE):
            own = slice(ends[low] - count[low], ends[high - 1])
            start = offsets[line[own]] - offsets[low] + step[own]
            has = np.diff(offsets)[line[own]] > 0
            sums = _sums(bytes_[offsets[low] : offsets[high]])
            identity[own][has] = _hashes(sums, start[has], WINDOW)
        identity = _mix(identity + key[line].view(np.uint64) * _U(_MULTIPLIER))
        owner, start = doc[line], first[line] + step
        order = np.lexsort((start, owner, identity))
        identity, owner, start, marks = identity[order], owner[order], start[order], mark[line][order]
        new = np.ones(len(identity), bool)
        new[1:] = identity[1:] != identity[:-1]
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (owner != owner[head]) | (start != start[head])
        found = _merged(owner[later], marks[later], start[later])
        yield pa.record_batch([pa.array(x) for x in found], names=names)


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.fill_null(b"").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def remove_spans(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of ``data``, and the maximal runs removed."""
    runs: list[list[int]] = []
    for start, end in sorted(spans):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    kept, last = [], 0
    for start, end in runs:
        kept.append(data[last:start])
        last = end
    kept.append(data[last:])
    return b"".join(kept), [(a, b) for a, b in runs]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text"), batch.column("spans")):
            data = (text.as_py() or "").encode("utf-8")
            kept, runs = remove_spans(data, [(s["start"], s["end"]) for s in spans.as_py() or []])
            rows.append((len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
        size, removed, runs, digest = zip(*rows) if rows else ((), (), (), ())
        yield pa.record_batch(
            [
                batch.column("doc"),
                pa.array(size, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array([len(r) for r in runs], pa.int64()),
                pa.array(digest, pa.string()),
                pa.array(
                    [[{"start": a, "end": b} for a, b in r] for r in runs],
                    pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
                ),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for every row of ``docs``.

    ``spans`` are the maximal removed runs in bytes, end exclusive. A null text is
    empty. Rows without id take no part and keep all their bytes. A repeated row is
    the same document, so it removes nothing from itself; two texts under one id
    rank equal, and only the starts within them order them. An empty table gives an
    empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text")).withColumn(
        "mark", F.xxhash64("text").bitwiseAND(F.lit(0xFFFF).cast("long"))
    )
    rows = every.filter("doc is not null")
    # Only to have candidates; the removal below reads every row.
    long_enough = rows.filter(F.octet_length("text") >= WINDOW)
    found = written(
        long_enough.mapInArrow(_pointed, _POINTERS)
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_repeated, "gram long, doc long, code long, total long, until long")
    )
    open_ = found.filter("until = 0")
    hot = small_side(
        open_.filter(F.col("total") > HOT).select("gram", F.lit(True).alias("hot")).distinct()
    )
    mark = F.col("code").bitwiseAND(F.lit(0xFFFF).cast("long")).alias("mark")
    code = F.struct("code", F.coalesce("hot", F.lit(False)).alias("hot"))
    by_doc = (
        open_.join(hot, "gram", "left")
        .select("doc", mark, code.alias("code"))
        .groupBy("doc", "mark")
        .agg(F.collect_list("code").alias("codes"))
    )
    refined = (
        by_doc.join(rows, ["doc", "mark"])
        .select("doc", "text", "codes")
        .mapInArrow(_surroundings, _SURROUNDED)
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_refined, "doc long, mark long, start long, end long")
    )
    copies = found.filter("until > 0").select(
        "doc", mark, F.shiftright("code", 30).alias("start"), F.col("until").alias("end")
    )
    spans = (
        copies.union(refined)
        .groupBy("doc", "mark")
        .agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    )
    return (
        rows.join(spans, ["doc", "mark"], "left")
        .select("doc", "text", "spans")
        .union(
            every.filter("doc is null").select(
                "doc", "text", F.lit(None).cast("array<struct<start:long,end:long>>")
            )
        )
        .mapInArrow(
            _cut,
            "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
            "spans array<struct<start:long,end:long>>",
        )
    )
