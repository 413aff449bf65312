"""Quality classifier: logistic regression on hashed word n-grams.

A token is a run of word characters or a run of punctuation, in its own case. Tokens
and pairs of neighbouring tokens are hashed to ``DIMS`` numbers; a text is the vector
of ``1 + log(count)`` of its numbers, of length one, and a constant. The weights are
trained by follow-the-regularised-leader updates: each coordinate keeps the sum ``z``
of its adjusted gradients and the sum ``n`` of their squares, its step shrinks with
``n``, and it weighs nothing until ``z`` passes ``L1``. A score is the sparse dot product
with the weights, through the logistic function.

The updates go document by document, in one task that reads about ``TRAIN_DOCS``
labelled documents, drawn by the hash of their ids, ``EPOCHS`` times in an order of
hashes. Spark sorts that stream (and spills it); the task holds one batch and the
weights. Everything else runs over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import row_slices, text_bytes

DIMS = 1 << 18
TRAIN_DOCS = 8_000  # bound of the sample that is learned from
EPOCHS = 6
STEP, SMOOTH, L1, L2 = 2.0, 1.0, 0.01, 0.1
SLICE_BYTES = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLANK, _WORD, _SIGN = 0, 1, 2
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[:33] = _BLANK
_KIND[127] = _BLANK
for _low, _high in (b"09", b"AZ", b"az"):
    _KIND[_low : _high + 1] = _WORD
_KIND[128:] = _WORD


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each token, and the text it stands in."""
    kind = _KIND[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    full = kind[starts] != _BLANK
    starts, ends = starts[full], ends[full]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each token; each distinct token is hashed once."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    inside = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    words = pa.Array.from_buffers(
        pa.large_binary(),
        len(starts),
        [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[inside].tobytes())],
    ).dictionary_encode()
    distinct = words.dictionary.to_pylist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w) for w in distinct), np.uint64, len(distinct))
    return hashes[words.indices.to_numpy()]


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges of rows: first row, end, and row, number and value of every feature."""
    data, offsets = text_bytes(texts)
    for low, high in row_slices(offsets, SLICE_BYTES):
        own = offsets[low : high + 1] - offsets[low]
        part = data[offsets[low] : offsets[high]]
        rows = high - low
        if not len(part):
            none = np.empty(0, np.int64)
            yield low, high, none, none, np.empty(0)
            continue
        starts, ends, text = tokens(part, own)
        single = _hashes(part, starts, ends)
        paired = text[1:] == text[:-1]
        double = ((single[:-1] * _MIX) ^ single[1:])[paired] * _MIX
        hashes = np.concatenate([single * _MIX, double])
        number = (hashes >> np.uint64(64 - DIMS.bit_length() + 1)).astype(np.int64)
        row = np.concatenate([text, text[1:][paired]])
        keys, seen = np.unique(row * DIMS + number, return_counts=True)
        row, number = keys // DIMS, keys % DIMS
        value = 1 + np.log(seen)
        length = np.sqrt(np.bincount(row, value * value, minlength=rows))
        yield low, high, row, number, value / length[row]


class Ftrl:
    """Weights of the features and, last, of the constant."""

    def __init__(self):
        self.z, self.n = np.zeros(DIMS + 1), np.zeros(DIMS + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((SMOOTH + np.sqrt(self.n[at])) / STEP + L2)

    def learn(self, number: np.ndarray, value: np.ndarray, label: int) -> None:
        """One update by a document's features; the constant is added here."""
        at, x = np.append(number, DIMS), np.append(value, 1.0)
        w = self.weights(at)
        gradient = (logistic(w @ x) - label) * x
        n = self.n[at]
        grown = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(grown) - np.sqrt(n)) / STEP * w
        self.n[at] = grown


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def scores(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    out = np.empty(len(texts))
    for low, high, row, number, value in features(texts):
        out[low:high] = np.bincount(row, value * weights[number], minlength=high - low)
    return logistic(out + weights[DIMS])


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = Ftrl()
    for batch in batches:
        label = batch.column("label").to_numpy()
        for low, high, row, number, value in features(batch.column("text")):
            edges = np.searchsorted(row, np.arange(high - low + 1))
            for i, (start, end) in enumerate(zip(edges, edges[1:])):
                model.learn(number[start:end], value[start:end], label[low + i])
    yield pa.record_batch([pa.array([model.weights().tobytes()], pa.binary())], names=["weights"])


def train(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights learned from (doc_id, text) and (doc_id, label), a bounded sample of both.

    A document with both labels teaches nothing; of repeated documents the least text teaches.
    """
    known = (
        labels.filter("doc_id is not null and label in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("label").cast("int").alias("label"), F.max("label").alias("_most"))
        .filter("label = _most")
        .drop("_most")
    )
    share = min(1 << 20, (TRAIN_DOCS << 20) // max(known.count(), 1) + 1)
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)
    taught = (
        docs.filter("doc_id is not null")
        .join(F.broadcast(drawn.limit(2 * TRAIN_DOCS)), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    )
    stream = taught.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))))
    stream = stream.withColumn("order", F.xxhash64("epoch", "doc_id"))
    learned = (
        stream.repartition(1)
        .sortWithinPartitions("epoch", "order", "doc_id")
        .select("label", "text")
        .mapInArrow(_trained, "weights binary")
        .collect()
    )
    # Spark starts no task for a stream that it knows to be empty.
    return np.frombuffer(learned[0].weights, np.float64) if learned else np.zeros(DIMS + 1)


def _judged(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = scores(batch.column("text"), shared.value)
        yield pa.record_batch(
            [
                batch.column("doc_id"),
                batch.column("held_out"),
                pa.array(found),
                pa.array((found >= 0.5).astype(np.int32)),
            ],
            names=["doc_id", "held_out", "score", "predicted"],
        )


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    label_col: str = "quality",
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Documents with ``crc32(id as text) % 3 = 1`` are held out; they, rows without id and
    labels other than 0 and 1 teach nothing. Contradicting labels of one id teach
    nothing, equal ones once. A null or empty text has only the constant as a feature;
    without any label every score is 0.5 and every prediction 1. Texts of any length
    count whole. Repeated rows are scored one by one, an empty table gives an empty
    result, columns of other names are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    rows = rows.withColumn("held_out", F.coalesce(out, F.lit(False)))
    known = labels.select(
        F.col(label_id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label")
    )
    weights = train(rows.select("doc_id", "text"), known.filter(~out))
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return rows.mapInArrow(
        lambda batches: _judged(batches, shared),
        "doc_id long, held_out boolean, score double, predicted int",
    )
