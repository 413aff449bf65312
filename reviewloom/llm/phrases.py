"""Collocations: phrases whose words keep company more than their counts explain.

Phrases are counted level by level. The words of a language get ids by falling
frequency, a phrase of n words is the pair (id of its first n - 1 words, id of its
last word), and such pairs are counted by direct-address tiling: the grid of ids is
cut into tiles of ``EDGE`` x ``EDGE`` cells. Frequent ids are small, so the tiles
near the origin are dense and are counted in place by ``bincount``; all other pairs
are sorted coordinates. Pairs that are frequent get ids by frequency again and are
the left sides of the next level.

A task counts a few megabytes of text at a time and Spark adds the counts up, so a
hot pair, language or document is one row per slice in the shuffle. Texts are cut at
piece ends only, which no phrase crosses.

Tasks know the ids of the ``HEAD`` most frequent phrases of a level (a bound on the
broadcast, not on the result). Other frequent phrases are marks in a bitmap of fixed
size: what hits it gets an id within the slice and is counted by its words. A false
mark costs a row that the frequency limit drops; nothing frequent is ever missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.common import row_slices, text_bytes, written

HEAD = 1 << 17
HEAD_BYTES = 64  # longer phrases are marks, which bounds the broadcast in bytes
MARKS = 1 << 26
EDGE = 256
DENSE_CELLS = 4  # a tile is dense from one pair for so many cells
GRID = 64  # only the first GRID x GRID tiles can be dense
SLICE_BYTES = 1 << 21
ROWS_AT_ONCE = 1 << 16  # of a batch that leaves a task, and of Python objects made at once
_BITMAP_BITS = 32768  # of one row of Spark's bitmap functions

_BLANK, _BREAK, _WORD = 0, 1, 2
_CLASS = np.full(256, _WORD, np.uint8)
_CLASS[[0x20, 0x09]] = _BLANK
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """Lower-cased bytes of the texts of one language, cut where pieces end."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    for low, high in row_slices(offsets, 2 * SLICE_BYTES):
        yield from _by_language(batch.slice(low, high - low))
        # What Arrow keeps for later would count as this worker's memory.
        pa.default_memory_pool().release_unused()


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    coded = batch.column("lang").dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False)
    for number, lang in enumerate(coded.dictionary.to_pylist()):
        data, offsets = text_bytes(batch.column("text").take(pa.array(np.flatnonzero(which == number))))
        data = np.insert(data, offsets[1:], 0x0A)
        np.take(_LOWER, data, out=data, mode="clip")
        ends = np.flatnonzero(_CLASS[data] == _BREAK) + 1
        low = 0
        while low < len(data):
            at = int(np.searchsorted(ends, low + SLICE_BYTES, "right"))
            first = int(np.searchsorted(ends, low, "right"))
            high = int(ends[max(at - 1, first)])
            yield lang, data[low:high]
            low = high


def words_of(data: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number of each word in order, and the piece it stands in."""
    kind = _CLASS[data]
    inside = kind == _WORD
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(
        pa.large_binary(),
        len(starts),
        [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[inside].tobytes())],
    ).dictionary_encode()
    breaks = np.flatnonzero(kind == _BREAK)
    return words.dictionary, words.indices.to_numpy(), np.searchsorted(breaks, starts)


def count_cells(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of ids and how often each occurs."""
    if not len(left):
        return left, right, np.empty(0, np.int64)
    row, column = left // EDGE, right // EDGE
    near = (row < GRID) & (column < GRID)
    tile = row * GRID + column
    sizes = np.bincount(tile[near], minlength=GRID * GRID)
    slot = np.full(GRID * GRID, -1)
    dense = np.flatnonzero(sizes * DENSE_CELLS >= EDGE * EDGE)
    slot[dense] = np.arange(len(dense))
    direct = near.copy()
    direct[near] = slot[tile[near]] >= 0

    cell = (slot[tile[direct]] * EDGE + left[direct] % EDGE) * EDGE + right[direct] % EDGE
    seen = np.bincount(cell, minlength=len(dense) * EDGE * EDGE)
    used = np.flatnonzero(seen)
    home = dense[used // (EDGE * EDGE)]
    out_left = home // GRID * EDGE + used // EDGE % EDGE
    out_right = home % GRID * EDGE + used % EDGE

    span = int(right.max()) + 1
    codes, times = np.unique(left[~direct] * span + right[~direct], return_counts=True)
    return (
        np.concatenate([out_left, codes // span]),
        np.concatenate([out_right, codes % span]),
        np.concatenate([seen[used], times]),
    )


def _hashes(phrases: pa.Array, seed: int) -> np.ndarray:
    digest, out = xxhash.xxh64_intdigest, np.empty(len(phrases), np.uint64)
    for low in range(0, len(phrases), ROWS_AT_ONCE):
        part = phrases.slice(low, ROWS_AT_ONCE).to_pylist()
        out[low : low + len(part)] = [digest(phrase, seed) for phrase in part]
    return out


class Level:
    """The frequent phrases of one length, as tasks know them."""

    def __init__(self, heads: dict[str, pa.Array], marks: np.ndarray | None):
        self.heads, self.marks = heads, marks

    def ids(self, lang: str, phrases: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """The id of each phrase, -1 if it is not frequent, and the phrases by id.

        The id is the rank by frequency, or for a marked phrase a number above all ranks.
        """
        head = self.heads.get(lang, pa.array([], pa.large_binary()))
        ids = pc.fill_null(pc.index_in(phrases, value_set=head), -1).to_numpy().astype(np.int64)
        rest = np.flatnonzero(ids < 0)
        if self.marks is not None and len(rest):
            seed = xxhash.xxh64_intdigest(lang.encode(), 42)
            at = _hashes(phrases.take(pa.array(rest)), seed) % np.uint64(MARKS)
            marked = self.marks[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1
            rest = rest[marked.astype(bool)]
            ids[rest] = len(head) + rest
        return ids, pa.concat_arrays([head, phrases])


def _joined(names: pa.Array, words: pa.Array, left: np.ndarray, right: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(
        names.take(pa.array(left)), words.take(pa.array(right)), pa.scalar(b" ", pa.large_binary())
    )


def _phrases(lang: str, data: np.ndarray, levels: list[Level]) -> tuple[pa.Array, np.ndarray]:
    """Phrases one word longer than the levels known, with their counts in a slice."""
    distinct, number, piece = words_of(data)
    if not levels:
        return distinct, np.bincount(number, minlength=len(distinct))
    ids, words = levels[0].ids(lang, distinct)
    word = ids[number]
    here, names = word, words  # id of the phrase that starts at each word
    for size in range(2, len(levels) + 2):
        count = max(len(word) - size + 1, 0)
        left, right = here[:count], word[size - 1 :]
        fits = (left >= 0) & (here[1 : count + 1] >= 0) & (right >= 0)
        fits &= piece[:count] == piece[size - 1 :]
        at = np.flatnonzero(fits)
        if size == len(levels) + 1:
            left, right, seen = count_cells(left[at], right[at])
            return _joined(names, words, left, right), seen
        span = int(word.max(initial=0)) + 1
        codes, which = np.unique(left[at] * span + right[at], return_inverse=True)
        found, longer = levels[size - 1].ids(lang, _joined(names, words, codes // span, codes % span))
        here = np.full(len(word), -1, np.int64)
        here[at] = found[which]
        names = longer
    raise AssertionError("unreachable")


def _counted(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    levels = [one.value for one in shared]
    for batch in batches:
        for lang, data in _slices(batch):
            phrases, seen = _phrases(lang, data, levels)
            phrases = phrases.cast(pa.large_string()).cast(pa.string())
            if not levels:  # the row without phrase counts all words
                phrases = pa.concat_arrays([phrases, pa.nulls(1, pa.string())])
                seen = np.append(seen, seen.sum())
            for low in range(0, len(seen), ROWS_AT_ONCE):
                part = pa.array(seen[low : low + ROWS_AT_ONCE])
                yield pa.record_batch(
                    [pa.repeat(pa.scalar(lang), len(part)), phrases.slice(low, ROWS_AT_ONCE), part],
                    names=["lang", "phrase", "seen"],
                )


def _position() -> Column:
    return F.pmod(F.xxhash64("lang", "phrase"), F.lit(MARKS))


def _known(level: DataFrame, head: int) -> Level:
    """Ranks of the most frequent phrases, marks for the others."""
    # At most 64 bands for each doubling of the count, so the driver gets a few thousand rows.
    short = (F.octet_length("phrase") <= HEAD_BYTES) & (F.octet_length("lang") <= HEAD_BYTES)
    bands = level.filter(short).groupBy(F.floor(F.log2("seen") * 64).alias("band"))
    bands = bands.agg(F.count("*").alias("n"), F.min("seen").alias("least"))
    room, least = head, None
    for band in sorted(bands.collect(), key=lambda row: -row.band):
        room -= band.n
        if room < 0:
            break
        least = band.least
    ranked = short & (F.col("seen") >= least) if least is not None else F.lit(False)
    top = level.filter(ranked).toArrow().sort_by([("lang", "ascending"), ("seen", "descending"), ("phrase", "ascending")])
    heads = {}
    langs = top.column("lang").combine_chunks()
    phrases = top.column("phrase").combine_chunks().cast(pa.large_binary())
    for lang in pc.unique(langs).to_pylist():
        heads[lang] = phrases.filter(pc.equal(langs, lang))
    place = _position() + 1  # Spark's bitmap functions count from one
    bitmaps = (
        level.filter(~ranked)
        .groupBy(F.bitmap_bucket_number(place).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
        .collect()
    )
    marks = np.zeros(MARKS // 8, np.uint8) if bitmaps else None
    for row in bitmaps:
        low = (row.bucket - 1) * _BITMAP_BITS // 8
        marks[low : low + len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return Level(heads, marks)


def phrase_counts(docs: DataFrame, longest: int, least: int, head: int = HEAD) -> list[DataFrame]:
    """For each length, (lang, phrase, seen) of the phrases seen ``least`` times or more.

    ``docs`` has ``lang`` and ``text``. The first frame also has a row without phrase
    for each language, with the number of all its words.
    """
    context, found, shared = docs.sparkSession.sparkContext, [], []
    while len(found) < longest:
        known = list(shared)
        found.append(
            written(
                docs.mapInArrow(
                    lambda batches, known=known: _counted(batches, known), "lang string, phrase string, seen long"
                )
                .groupBy("lang", "phrase")
                .agg(F.sum("seen").alias("seen"))
                .filter((F.col("seen") >= least) | F.col("phrase").isNull())
            )
        )
        if len(found) < longest:
            shared.append(context.broadcast(_known(found[-1].filter("phrase is not null"), head)))
    return found


def _parts(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    longest: int = 3,
    least: int = 10,
    share: int = 50,
    top: int = 2000,
    head: int = HEAD,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    A phrase of two to ``longest`` words seen ``a >= least`` times scores
    ``1000000 * a * a // (l * r)`` at its worst cut into two parts seen l and r times;
    equal cuts go to the first. A phrase inside a longer one that has ``share`` per cent
    of its occurrences is left out. Equal scores go by count, then by phrase.

    A null text is empty, a null language is ``und``. Repeated rows count each time.
    Texts of any length count whole, in slices. A language without phrases has no row;
    an empty table gives an empty result. Columns of other names are ignored.
    """
    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.col(text_col).alias("text"),
    )
    levels = phrase_counts(rows, longest, least, head)
    totals = levels[0].filter("phrase is null").select("lang", F.col("seen").alias("n"))
    counts = levels[0].filter("phrase is not null")
    for level in levels[1:]:
        counts = counts.union(level)
    words = F.split("phrase", " ")
    candidates = levels[1]
    for level in levels[2:]:
        candidates = candidates.union(level)
    candidates = candidates.select("lang", "phrase", F.col("seen").alias("a"), words.alias("words"))

    # Every cut of every candidate, with the counts of both parts.
    size = F.size("words")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).select(
        "lang",
        "phrase",
        "a",
        "k",
        _parts(F.col("words"), F.lit(1), F.col("k")).alias("first"),
        _parts(F.col("words"), F.col("k") + 1, size).alias("rest"),
    )
    # Null-free keys; AQE splits the partition of a very common word.
    part = counts.withColumnRenamed("phrase", "first").withColumnRenamed("seen", "l")
    cuts = cuts.join(part, ["lang", "first"])
    part = counts.withColumnRenamed("phrase", "rest").withColumnRenamed("seen", "r")
    cuts = cuts.join(part, ["lang", "rest"])
    exact = {name: F.col(name).cast("decimal(19,0)") for name in "alr"}
    cuts = cuts.select(
        "lang", "phrase", "a", "k", "l", "r",
        exact["a"].alias("_a"), exact["l"].alias("_l"), exact["r"].alias("_r"),
    ).withColumn("score", F.expr("cast(1000000 as decimal(7,0)) * (_a * _a) div (_l * _r)"))
    worst = cuts.groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )

    # The most frequent longer candidate around each shorter one.
    spans = F.flatten(
        F.transform(
            F.filter(F.sequence(F.lit(2), F.lit(max(longest - 1, 2))), lambda n: n < size),
            lambda n: F.transform(
                F.sequence(F.lit(1), size - n + 1), lambda i: _parts(F.col("words"), i, n)
            ),
        )
    )
    around = (
        candidates.filter(size > 2)
        .select("lang", "a", F.explode(spans).alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("around"))
    )
    best = (
        worst.join(around, ["lang", "phrase"], "left")
        .filter(F.col("around").isNull() | (100 * F.col("around") < share * F.col("a")))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    # No task ranks a whole language: the best of many shares, then of few, then of all.
    for shares in (1024, 16, 1):
        deal = F.pmod(F.xxhash64("phrase"), F.lit(shares))
        order = Window.partitionBy("lang", "deal").orderBy(F.desc("score"), F.desc("a"), "phrase")
        best = (
            best.withColumn("deal", deal)
            .withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= top)
        )
    return (
        best
        .join(totals, "lang")
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
