"""Removal of repeated runs of lines by prefix doubling over line-id sequences.

The corpus is the sequence of its lines' ids, one sequence per document; its suffixes
are the positions of lines. A suffix's rank at a width is its place in the order of all
runs of that many lines. The rank at the doubled width comes from the pair of its own
rank and of the rank one width further on: the distinct pairs are sorted over the
cluster by range, and their places in that order are the new ranks. Suffixes of equal
rank are an interval of the suffix array whose longest common prefix is at least that
many lines. Widths between two doublings need no rank of their own: two runs of the
last width that overlap name them.

Only suffixes whose rank repeats go on, since a longer common prefix starts with a
shorter one. In every interval the first suffix, by document and line, keeps its run;
the runs of the others are later copies and go if they have ``MIN_WORDS`` words
together. Widths up to ``MIN_WORDS`` lines are enough: as each line has a word, a longer
maximal run is the union of its runs of that width. A run made of two that both have
enough words is the union of these and does not go on. Blank lines are no part of the
sequence. Line ids are hashes of 128 bits; ranks are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import checkpointed, free_names

MIN_WORDS = 5
BLANKS = " \t\r\x0b\x0c"


def _name(value: Column) -> Column:
    """A name of 128 bits: texts are cut where names are equal, without a look at the lines."""
    return F.unhex(F.md5(value))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """The id, and a hash that tells texts of one id apart."""
    return F.col(id_col).cast("long").alias("_doc"), F.xxhash64(
        F.coalesce(F.col(text_col), F.lit(""))
    ).alias("_mark")


def _intervals(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows whose ``keys`` repeat, with the keys' rank and whether an earlier row has them.

    Ranks follow the order of the keys and have gaps.
    """
    rows = checkpointed(rows)
    # Cut off, so that Spark may split the join's partition of a common run.
    first = checkpointed(
        rows.groupBy(*keys)
        .agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .orderBy(*keys)
        .select(*keys, "first", F.monotonically_increasing_id().alias("rank"))
    )
    later = F.struct("doc", "at") > F.col("first")
    return checkpointed(
        rows.join(first, [*keys]).select(
            "doc", "mark", "at", "words", "rank", later.alias("later")
        )
    )


def later_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """(_doc, _mark, _runs): per text, (first line, lines) of later copies, among its non-blank lines."""
    lines = F.filter(
        F.transform(F.split(text_col, "\n"), lambda s: F.btrim(s, F.lit(BLANKS))), lambda s: s != ""
    )
    enough = F.col("line").rlike(rf"(?:\S++\s++){{{min_words - 1}}}\S")
    words = F.when(enough, min_words).otherwise(F.size(F.split("line", r"\s+")))
    # ``words``: of the first 1, 2, ... lines of the run, at most ``min_words``.
    ranked = _intervals(
        docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
        .select(*_keyed(docs, id_col, text_col), F.posexplode(lines).alias("at", "line"))
        .select(
            F.col("_doc").alias("doc"),
            F.col("_mark").alias("mark"),
            "at",
            _name(F.col("line")).alias("name"),
            F.array(words).alias("words"),
        ),
        "name",
    )

    def runs(size: int) -> DataFrame:
        return ranked.filter(F.col("later") & (F.element_at("words", -1) >= min_words)).select(
            "doc", "mark", F.struct("at", F.lit(size).alias("lines")).alias("run")
        )

    width, found = 1, runs(1)
    while width < min_words and not ranked.filter(F.element_at("words", -1) < min_words).isEmpty():
        before = ranked.select("doc", "mark", "at", "words", F.col("rank").alias("left"))
        # Repeated rows of a document have equal ranks, so one of them is enough.
        after = ranked.select(
            "doc",
            "mark",
            F.col("at").alias("from"),
            F.col("words").alias("others"),
            F.col("rank").alias("right"),
        ).dropDuplicates(["doc", "mark", "from"])
        for step in range(1, min(width, min_words - width) + 1):
            sums = F.transform(
                "others", lambda n: F.least(F.lit(min_words), n + F.element_at("words", step))
            )
            ranked = _intervals(
                before.join(after.withColumn("at", F.col("from") - step), ["doc", "mark", "at"])
                .filter(F.least(F.element_at("words", -1), F.element_at("others", -1)) < min_words)
                .select(
                    "doc",
                    "mark",
                    "at",
                    "left",
                    "right",
                    F.concat(F.slice("words", 1, step), sums).alias("words"),
                ),
                "left",
                "right",
            )
            found = found.union(runs(width + step))
        width *= 2
    return found.groupBy(F.col("doc").alias("_doc"), F.col("mark").alias("_mark")).agg(
        F.collect_set("run").alias("_runs")
    )


def cut_lines(text: str, runs: list[tuple[int, int]]) -> tuple[str, int, list[tuple[int, int]]]:
    """(kept text, lines removed, maximal runs removed) of one text."""
    gone: list[list[int]] = []
    for start, count in sorted(runs):
        if gone and start <= gone[-1][1]:
            gone[-1][1] = max(gone[-1][1], start + count)
        else:
            gone.append([start, start + count])
    kept, at, removed, edge = [], 0, 0, 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            while edge < len(gone) and gone[edge][1] <= at:
                edge += 1
            inside = edge < len(gone) and gone[edge][0] <= at
            at += 1
            if inside:
                removed += 1
                continue
        kept.append(line)
    return "\n".join(kept), removed, [(a, b - a) for a, b in gone]


def _runs(value) -> list[tuple[int, int]]:
    return [(r["at"], r["lines"]) for r in value.as_py() or []]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, runs in zip(batch.column("text"), batch.column("_runs")):
            text = text.as_py() or ""
            kept, removed, gone = cut_lines(text, _runs(runs))
            digest = hashlib.sha256(kept.encode("utf-8")).hexdigest()
            rows.append((text.count("\n") + 1, removed, len(gone), max((n for _, n in gone), default=0), digest))
        columns = list(zip(*rows)) if rows else [[]] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.record_batch(
            [batch.column("_doc"), *(pa.array(c, kind) for c, kind in zip(columns, kinds))],
            names=["doc_id", "n_lines", "n_removed", "n_runs", "longest_run", "kept_sha256"],
        )


def _matched(docs: DataFrame, runs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the columns of ``runs``, under names that ``docs`` does not have."""
    names = free_names(docs.columns, *runs.columns)
    keys = dict(zip(names, _keyed(docs, id_col, text_col)))
    return docs.withColumns(keys).join(runs.toDF(*names), names[:2], "left")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, n_runs, longest_run, kept_sha256) for every row of ``docs``.

    Lines end at line feeds; blanks at their ends do not count. A null text is one
    empty line. Rows without id take no part and keep their lines. A repeated row is
    the same document and removes nothing from itself; texts under one id are
    ordered by line alone. An empty table gives an empty result.
    """
    runs = later_runs(docs, id_col, text_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return (
        _matched(slim, runs, "doc_id", "text")
        .select("_doc", "text", "_runs")
        .mapInArrow(
            _digests,
            "doc_id long, n_lines long, n_removed long, n_runs long, longest_run long, kept_sha256 string",
        )
    )


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later copies of line runs cut from the text; other columns as they are.

    Every row stays, with its line feeds between the lines that are kept. A null text
    stays null, and a row without id keeps its text. Of equal rows none counts as a
    copy of another; texts under one id are ordered by line alone, ties between them
    keeping both. Texts of any length are cut whole. An empty table stays empty.
    Columns may have any name.
    """
    names = docs.columns
    place = names.index(text_col)
    found = free_names(names, "_doc", "_mark", "_runs")[2]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                t.as_py() if t.as_py() is None or r.as_py() is None else cut_lines(t.as_py(), _runs(r))[0]
                for t, r in zip(batch.column(text_col), batch.column(found))
            ]
            columns = [batch.column(c) for c in names]
            columns[place] = pa.array(texts, pa.string())
            yield pa.record_batch(columns, names=names)

    runs = later_runs(docs, id_col, text_col)
    return (
        _matched(docs, runs, id_col, text_col).select(*names, found).mapInArrow(cut, docs.schema)
    )
