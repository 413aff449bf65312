"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds one filter per language: slot i is a bitmask of
the languages that have bit i set, so ``PROBES`` look-ups and their AND return all
languages whose filter holds an n-gram. Per language the set bits are counted
over the whole text and corrected for the filter's false positives; the language
with the most n-grams wins, and its share of all n-grams is the score.

An n-gram enters a language's filter if it is typical for it: among the labelled
texts it must be at least ``TYPICAL`` times as frequent there as in the language
where it is most frequent. The filters are fitted on about ``SAMPLE_DOCS`` labelled
documents of each language, drawn by the hash of their id; prediction reads every
text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import row_slices, text_bytes

NGRAM = 4  # bytes, of lower-cased text with one blank for each run of non-letters
SLOT_BITS = 22
PROBES = 3
TYPICAL = 0.25
LEAST_SEEN = 2
SAMPLE_DOCS = 4000
SLICE_BYTES = 1 << 20
UNKNOWN = "und"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_CLEAN = np.where(_LETTER, np.arange(256), 32).astype(np.uint8)


def ngrams(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, n-grams, offsets of rows in them) of slices of the texts."""
    lowered = pc.binary_join_element_wise("", pc.utf8_lower(texts.fill_null("")), "", " ")
    data, offsets = text_bytes(lowered)
    for low, high in row_slices(offsets, SLICE_BYTES):
        part = _CLEAN[data[offsets[low] : offsets[high]]]
        edges = offsets[low : high + 1] - offsets[low]
        keep = np.ones(len(part), bool)
        keep[1:] = (part[1:] != 32) | (part[:-1] != 32)
        keep[edges[:-1]] = True  # every row starts with a blank
        part = part[keep]
        edges = np.concatenate([[0], np.cumsum(keep)])[edges]
        grams = np.zeros(max(len(part) - NGRAM + 1, 0), np.uint64)
        for step in range(NGRAM):
            grams |= part[step : step + len(grams)].astype(np.uint64) << np.uint64(8 * step)
        counts = np.maximum(np.diff(edges) - NGRAM + 1, 0)
        ends = np.cumsum(counts)
        at = np.arange(ends[-1]) + np.repeat(edges[:-1] - (ends - counts), counts)
        yield low, grams[at], np.concatenate([[0], ends])


def slots(grams: np.ndarray, probe: int) -> np.ndarray:
    mixed = (grams ^ grams >> np.uint64(15)) * _ODD[probe]
    return (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


@dataclass
class Filters:
    """Bit-sliced filters: ``slots`` x ceil(languages / 8) bytes, and what they were fitted on."""

    languages: list[str]
    common: int  # the language most documents have
    table: np.ndarray
    wrong: np.ndarray  # false positive rate of each language

    @classmethod
    def build(cls, languages, common, language: np.ndarray, gram: np.ndarray, seen: np.ndarray):
        """From the n-grams seen in each language (an index), with their counts."""
        totals = np.bincount(language, seen, len(languages))
        share = seen / totals[language]
        keys, column = np.unique(gram, return_inverse=True)
        most = np.zeros(len(keys))
        np.maximum.at(most, column, share)
        typical = (share >= TYPICAL * most[column]) & (seen >= LEAST_SEEN)
        language, gram = language[typical], gram[typical].astype(np.uint64)
        table = np.zeros((1 << SLOT_BITS, -(-len(languages) // 8)), np.uint8)
        bit = (128 >> (language % 8)).astype(np.uint8)
        for probe in range(PROBES):
            np.bitwise_or.at(table, (slots(gram, probe), language // 8), bit)
        full = np.array(
            [np.count_nonzero(table[:, i // 8] & (128 >> (i % 8))) for i in range(len(languages))]
        )
        return cls(languages, common, table, (full / len(table)) ** PROBES)

    def judge(self, grams: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language index and score of each row of n-grams."""
        total = np.diff(edges)
        found = np.zeros((len(total), len(self.languages)))
        some = np.flatnonzero(total)
        if len(some):
            held = self.table[slots(grams, 0)]
            for probe in range(1, PROBES):
                held &= self.table[slots(grams, probe)]
            bits = np.unpackbits(held, axis=1, count=len(self.languages))
            found[some] = np.add.reduceat(bits, edges[some], axis=0, dtype=np.int64)
        # found = true + (total - true) * wrong
        true = np.maximum(found - total[:, None] * self.wrong, 0) / (1 - self.wrong)
        best = true.argmax(axis=1)
        top = true[np.arange(len(best)), best]
        best[top == 0] = self.common
        return best, np.clip(top / np.maximum(total, 1), 0, 1)


def _counted(batches: Iterator[pa.RecordBatch], number: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        which = np.array([number[x.as_py()] for x in batch.column("lang")], np.int64)
        for low, grams, edges in ngrams(batch.column("text")):
            rows = np.repeat(which[low : low + len(edges) - 1], np.diff(edges))
            keys, seen = np.unique(rows.astype(np.uint64) << np.uint64(32) | grams, return_counts=True)
            yield pa.record_batch(
                [
                    pa.array((keys >> np.uint64(32)).astype(np.int64)),
                    pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)),
                    pa.array(seen),
                ],
                names=["language", "gram", "seen"],
            )


def fit(labelled: DataFrame) -> Filters | None:
    """Filters from (doc_id, text, lang) rows with text and language; none without rows."""
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    scale = 1 << 20
    share = F.create_map(
        *(
            F.lit(x)
            for name in languages
            for x in (name, min(scale, scale * SAMPLE_DOCS // counts[name] + 1))
        )
    )
    drawn = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < share[F.col("lang")])
    number = {name: i for i, name in enumerate(languages)}
    seen = (
        drawn.select("text", "lang")
        .mapInArrow(lambda b: _counted(b, number), "language long, gram long, seen long")
        .groupBy("language", "gram")
        .agg(F.sum("seen").alias("seen"))
        .filter(F.col("seen") >= LEAST_SEEN)
        .toPandas()
    )
    if seen.empty:
        return None
    common = max(number.values(), key=lambda i: counts[languages[i]])
    columns = (seen[c].to_numpy() for c in ("language", "gram", "seen"))
    return Filters.build(languages, common, *columns)


def _judged(texts: pa.Array, filters: Filters) -> tuple[np.ndarray, np.ndarray]:
    best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    for low, grams, edges in ngrams(texts):
        high = low + len(edges) - 1
        best[low:high], score[low:high] = filters.judge(grams, edges)
    return best, score


def _predicted(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    filters: Filters = shared.value
    for batch in batches:
        best, score = _judged(batch.column("text"), filters)
        known = batch.column("known").to_numpy(zero_copy_only=False)
        names = [filters.languages[i] if k else UNKNOWN for i, k in zip(best, known)]
        yield pa.record_batch(
            [
                batch.column("doc_id"),
                batch.column("held_out"),
                pa.array(names, pa.string()),
                pa.array(np.where(known, score, 0.0)),
            ],
            names=["doc_id", "held_out", "lang_pred", "score"],
        )


def _labelled_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
    ).withColumn("held_out", F.coalesce(held_out, F.lit(False)))


def _taught(rows: DataFrame) -> Filters | None:
    usable = "not held_out and doc_id is not null and text is not null and lang is not null"
    return fit(rows.filter(usable))


def _has_letter(text: str):
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``.

    Documents with ``crc32(id as text) % 4 = 2`` are held out: they, and rows
    without id, text or language, teach nothing. A null text and one without a
    letter are ``und`` with score 0, and so is every text if nothing was learned.
    A text none of whose n-grams is known gets the most frequent language with
    score 0; equal counts go to the first language by name. Repeated rows are
    judged one by one. An empty table gives an empty result.
    """
    rows = _labelled_rows(docs, id_col, text_col, lang_col)
    filters = _taught(rows)
    if filters is None:
        return rows.select(
            "doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")
        )
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    return rows.select("doc_id", "text", "held_out", _has_letter("text").alias("known")).mapInArrow(
        lambda batches: _predicted(batches, shared),
        "doc_id long, held_out boolean, lang_pred string, score double",
    )


def in_known_language(
    docs: DataFrame,
    least: float,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language with at least the score ``least``."""
    filters = _taught(_labelled_rows(docs, id_col, text_col, lang_col))
    if filters is None:
        return docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, score = _judged(batch.column(text_col), shared.value)
            yield batch.filter(pa.array(score >= least))

    return docs.filter(_has_letter(text_col)).mapInArrow(kept, docs.schema)
