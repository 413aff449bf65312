"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

A text, its blanks written as marks, is cut into marked words; pieces never reach
over the start of a mark. The distinct words of a batch that were not met before
are sorted, which is the depth-first order of their trie, and the forward entries
of a common prefix are reused by the words below it.

The vocabulary is of the byte-pair kind, where the right segmentation is not the one
of the best sum of scores but the one that merging by score ends in. It is the only
path through the lattice of pieces on which each two neighbours, merged by
themselves, come out as these two again. So the forward entry of a prefix is the last
piece of its only admissible path; a step is admitted by its left neighbour, and what
two pieces merge to is remembered. Results equal the library's. This departs from a
Viterbi pass in that the entry is no score; what prefixes share is the same.

Along the trie goes the longest suffix that still begins a piece, so that only pieces
which do end at a character are tried there, the longest first.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CACHED_WORDS = 300_000
CACHED_PAIRS = 500_000
CACHED_STEPS = 500_000
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_PROBE = "ﬁ²Åé\t x 　  A­\n"


class Pieces:
    """Vocabulary, encoder and decoder of one model file."""

    def __init__(self, path: str):
        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.id = {model.id_to_piece(i): i for i in plain}
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.byte = {
            int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)
        }
        self.begins = {piece[:n] for piece in self.id for n in range(1, len(piece) + 1)}
        self.literal = model.normalize(_PROBE) == MARK + _PROBE.replace(" ", MARK)
        self.words: dict[str, bytes] = {}
        # For each piece, whether it may follow a left neighbour.
        self.follows: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        # For a suffix and the next character: the new suffix and the pieces that end in it.
        self.steps: dict[str, tuple[str, tuple[tuple[int, str], ...]]] = {}
        self.data = {piece: i.to_bytes(4, "little") for piece, i in self.id.items()}
        self.bytes_of = [b""] * model.get_piece_size()
        for piece, i in self.id.items():
            self.bytes_of[i] = piece.encode("utf-8")
        for value, i in self.byte.items():
            self.bytes_of[i] = bytes([value])

    def merge(self, text: str) -> list[str]:
        """Merge the best-scored neighbours, the leftmost of equals, until none merges."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def admits(self, left: str, right: str) -> bool:
        """Whether two neighbours (left may be empty) stay as they are; remembered."""
        if self.pairs >= CACHED_PAIRS:
            for lefts in self.follows.values():
                lefts.clear()
            self.pairs = 0
        found = self.merge(left + right) == ([left, right] if left else [right])
        self.follows.setdefault(right, {})[left] = found
        self.pairs += 1
        return found

    def step(self, grown: str) -> tuple[str, tuple[tuple[int, str], ...]]:
        """(longest suffix that begins a piece, (length, piece) of those that end it); remembered."""
        if len(self.steps) >= CACHED_STEPS:
            self.steps.clear()
        at = 0
        while at < len(grown) and grown[at:] not in self.begins:
            at += 1
        tails = [grown[i:] for i in range(at, len(grown) - 1)]
        ends = [tail for tail in tails if tail in self.id] + [grown[-1]]
        for tail in ends:
            self.follows.setdefault(tail, {})
        self.steps[grown] = found = (grown[at:], tuple((len(tail), tail) for tail in ends))
        return found

    def _ids(self, parts: list[str]) -> bytes:
        """Ids of parts some of which are no pieces."""
        ids: list[int] = []
        for part in parts:
            known = self.id.get(part)
            if known is not None:
                ids.append(known)
            elif self.byte:
                ids.extend(self.byte[b] for b in part.encode("utf-8"))
            elif not ids or ids[-1] != self.model.unk_id():
                ids.append(self.model.unk_id())
        return np.array(ids, "<i4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Encode sorted distinct words, depth first through their trie."""
        previous, lasts, suffixes = "", [""], [""]
        steps, follows, data = self.steps, self.follows, self.data
        for word in words:
            shared, most = 0, min(len(previous), len(word))
            while shared < most and previous[shared] == word[shared]:
                shared += 1
            del lasts[shared + 1 :], suffixes[shared + 1 :]
            suffix, end = suffixes[shared], shared
            for letter in word[shared:]:
                end += 1
                grown = suffix + letter
                known = steps.get(grown)
                suffix, ending = self.step(grown) if known is None else known
                for length, piece in ending:
                    left = lasts[end - length]
                    admitted = follows[piece].get(left)
                    if admitted is None:
                        admitted = self.admits(left, piece)
                    if admitted:
                        break
                lasts.append(piece)
                suffixes.append(suffix)
            parts = []
            while end:
                parts.append(lasts[end])
                end -= len(lasts[end])
            parts.reverse()
            try:
                self.words[word] = b"".join([data[part] for part in parts])
            except KeyError:
                self.words[word] = self._ids(parts)
            previous = word

    def marked_words(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.literal:
            return _WORD.findall(self.model.normalize(text))
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            return _WORD.findall(MARK + text.replace(" ", MARK))
        return [MARK + word for word in text.split(" ")]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        split = [self.marked_words(text) for text in texts]
        if len(self.words) >= CACHED_WORDS:
            self.words.clear()
        self.learn(sorted({word for words in split for word in words} - self.words.keys()))
        known = self.words
        return [b"".join([known[word] for word in words]) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: marks become blanks, the first one goes."""
        known = ids[(ids >= 0) & (ids < len(self.bytes_of))]
        data = b"".join(map(self.bytes_of.__getitem__, known.tolist()))
        text = data.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, step: int = 500) -> Iterator[pa.RecordBatch]:
    model = pieces(path)
    for batch in batches:
        for low in range(0, batch.num_rows, step):
            part = batch.slice(low, step)
            rows = model.encode([t or "" for t in part.column(1).to_pylist()])
            ends = np.cumsum([0, *(len(r) // 4 for r in rows)])
            ids = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), "<i4"))
            )
            yield pa.record_batch([part.column(0), ids], names=["doc_id", "ids"])


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the whole text of every row of ``docs`` as piece ids.

    A null or empty text has no ids. Rows without id and repeated rows are encoded
    like others. An empty table gives an empty result. ``model`` is the path of a
    model file on every machine.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(
        lambda batches: _encoded(batches, model), "doc_id long, ids array<int>"
    )


def _numbers(column: pa.Array) -> Iterator[np.ndarray]:
    """The ids of each row, as views of the column's buffer; null is none."""
    column = column.fill_null([])
    ends, ids = column.offsets.to_numpy(), column.values.to_numpy()
    for low, high in zip(ends[:-1], ends[1:]):
        yield ids[low:high]


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the text of every row of piece ids; null ids are no ids."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            found = [own.decode(ids) for ids in _numbers(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col)).mapInArrow(
        texts, "doc_id long, text string"
    )


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_ids, ids_sha256, decoded_sha256): digests of the ids and of the text they give back."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            rows = list(_numbers(batch.column(1)))
            sha = lambda data: hashlib.sha256(data).hexdigest()
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([len(ids) for ids in rows], pa.int64()),
                    pa.array([sha(ids.astype("<i4").tobytes()) for ids in rows], pa.string()),
                    pa.array([sha(own.decode(ids).encode("utf-8")) for ids in rows], pa.string()),
                ],
                names=["doc_id", "n_ids", "ids_sha256", "decoded_sha256"],
            )

    return encode(docs, model).mapInArrow(
        digests, "doc_id long, n_ids long, ids_sha256 string, decoded_sha256 string"
    )
