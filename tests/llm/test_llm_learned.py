"""Collocations, the quality classifier and hard negatives against brute force."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from reviewloom.llm import negatives, phrases, quality
from reviewloom.llm.negatives import hard_negatives
from reviewloom.llm.phrases import collocations, count_cells
from reviewloom.llm.quality import quality_scores, train

# Collocations


def plain_collocations(rows, longest=3, least=10, share=50, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, words), a in candidates.items():
        inside = any(
            other == lang and len(longer) > len(words) and 100 * b >= share * a
            and any(longer[i : i + len(words)] == words for i in range(len(longer)))
            for (other, longer), b in candidates.items()
        )
        if inside:
            continue
        cuts = [(counts[lang, words[:k]], counts[lang, words[k:]]) for k in range(1, len(words))]
        score, _, left, right = min((10**6 * a * a // (l * r), k, l, r) for k, (l, r) in enumerate(cuts))
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, right, totals[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1)
    )


def awkward_texts():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(30)] + ["É", "İx", "\x1cq", "x" * 5000, "日本", "a b"]
    rows = []
    for i in range(120):
        picked = rng.zipf(1.6, 60) % len(words)
        text = ""
        for w in picked:
            text += words[w].upper() if rng.random() < 0.1 else words[w]
            text += rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", ";", "\r", "\x0b!"])
        rows.append((["en", "fr", None, "l" * 100][i % 4], text))
    rows += [("en", None), ("fr", ""), (None, " \t\n.,"), ("solo", "one")]
    rows += [("en", "new york city is far. " * 40)] * 3
    return rows


@pytest.mark.parametrize("head", [phrases.HEAD, 3, 0])
def test_collocations_equal_brute_force(spark, head):
    """Whether tasks know the phrases by rank, a few of them, or none."""
    rows = awkward_texts()
    frame = spark.createDataFrame(
        [(a, b, 0, "x", 1) for a, b in rows], "lang string, text string, phrase int, seen string, a int"
    ).repartition(3)
    found = sorted(tuple(r) for r in collocations(frame, head=head).collect())
    assert found == plain_collocations(rows)
    assert len(found) > 50


def test_longer_and_fewer_collocations(spark):
    rows = awkward_texts()
    frame = spark.createDataFrame(rows, "lang string, text string")
    found = sorted(tuple(r) for r in collocations(frame, longest=5, least=4, share=80, top=7, head=5).collect())
    assert found == plain_collocations(rows, 5, 4, 80, 7)
    assert any(r[2].count(" ") == 4 for r in found)
    found = sorted(tuple(r) for r in collocations(frame, longest=2).collect())
    assert found == plain_collocations(rows, 2)


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE_BYTES", 64)
    texts = ["One, two. " * 50, "no end " * 50, None, ""]
    batch = pa.record_batch([pa.array(["en"] * 4), pa.array(texts)], names=["lang", "text"])
    slices = [data.tobytes() for _, data in phrases._slices(batch)]
    assert b"".join(slices).decode() == "".join((t or "").lower() + "\n" for t in texts)
    assert all(len(s) <= 64 or s.count(b"no end") == 50 for s in slices)
    assert all(phrases._CLASS[s[-1]] == 1 for s in slices)


def test_tiles_and_coordinates_count_alike():
    rng = np.random.default_rng(2)
    left = np.minimum(rng.zipf(1.3, 300_000), 200_000) - 1
    right = np.minimum(rng.zipf(1.3, 300_000), 200_000) - 1
    a, b, n = count_cells(left, right)
    assert Counter(zip(left.tolist(), right.tolist())) == dict(zip(zip(a.tolist(), b.tolist()), n.tolist()))
    assert len(a) == len(set(zip(a.tolist(), b.tolist())))


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 3 * 10**12, 10**13 + 1, 4 * 10**12 + 3
    frame = spark.sql(f"select {a}L as a, {l}L as l, {r}L as r").selectExpr(
        "cast(a as decimal(19,0)) _a", "cast(l as decimal(19,0)) _l", "cast(r as decimal(19,0)) _r"
    )
    found = frame.selectExpr("cast(1000000 as decimal(7,0)) * (_a * _a) div (_l * _r)").first()[0]
    assert found == 10**6 * a * a // (l * r)


def test_no_collocations(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations(empty).collect() == []
    assert collocations(spark.createDataFrame([(None, None)], "lang string, text string")).collect() == []


# Quality classifier


def plain_features(text):
    """Token runs and neighbouring pairs, hashed, with logarithmic counts, of length one."""
    found = re.findall("[0-9A-Za-z\u0080-\U0010ffff]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+", text or "")
    mask = (1 << 64) - 1
    mix = 0x9E3779B97F4A7C15
    one = [xxhash.xxh64_intdigest(t.encode()) for t in found]
    hashes = [h * mix & mask for h in one]
    hashes += [((h * mix & mask) ^ g) * mix & mask for h, g in zip(one, one[1:])]
    counts = Counter(h >> (64 - 18) for h in hashes)
    values = {k: 1 + math.log(v) for k, v in counts.items()}
    length = math.sqrt(sum(v * v for v in values.values()))
    return {k: v / length for k, v in values.items()}


def plain_training(docs, labels):
    """Follow-the-regularised-leader, coordinate by coordinate."""
    known = {}
    for i, label in labels:
        if i is not None and label in (0, 1) and zlib.crc32(str(i).encode()) % 3 != 1:
            known.setdefault(i, set()).add(label)
    texts = {}
    for i, text in docs:
        if i in known and len(known[i]) == 1:
            texts[i] = min(texts.get(i, text or ""), text or "")
    z, n = Counter(), Counter()

    def weight(k):
        if abs(z[k]) <= quality.L1:
            return 0.0
        return -(z[k] - math.copysign(quality.L1, z[k])) / (
            (quality.SMOOTH + math.sqrt(n[k])) / quality.STEP + quality.L2
        )

    def order(epoch):
        def key(i):
            h = xxhash.xxh64_intdigest(epoch.to_bytes(4, "little"), 42)
            h = xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), h)
            return h - (1 << 64) if h >> 63 else h

        return key

    for epoch in range(1, quality.EPOCHS + 1):
        for i in sorted(texts, key=order(epoch)):
            x = plain_features(texts[i]) | {quality.DIMS: 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - min(known[i])) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / quality.STEP * w[k]
                n[k] += g * g
    return {k: weight(k) for k in n}


@pytest.fixture(scope="module")
def judged_texts(spark):
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for i in range(90):
        good = i % 3 > 0
        words = [f"w{x}" for x in rng.zipf(1.5, 40) % 50]
        docs.append((i, (" " if good else "!!! ").join(words) + (". Ende ß" if good else "$$$")))
        labels.append((i, int(good)))
    docs += [(90, None), (91, ""), (92, " \n\t"), (3, docs[4][1]), (3, docs[3][1]), (None, docs[5][1]), (93, "w1 é!!" * 60000)]
    labels += [(91, 1), (1, 0), (2, 1), (90, None), (None, 1), (92, 7), (777, 0)]
    frames = (
        spark.createDataFrame([(i, t, 0, 1.0, "x") for i, t in docs], "doc_id long, text string, label int, score double, order string"),
        spark.createDataFrame([(i, q, "x") for i, q in labels], "doc_id long, quality int, text string"),
    )
    return docs, labels, *frames


def test_quality_scores_equal_plain_training(judged_texts):
    docs, labels, frame, label_frame = judged_texts
    weights = plain_training(docs, labels)
    expected = []
    for i, text in docs:
        x = plain_features(text) | {quality.DIMS: 1.0}
        score = 1 / (1 + math.exp(-sum(weights.get(k, 0.0) * v for k, v in x.items())))
        held = i is not None and zlib.crc32(str(i).encode()) % 3 == 1
        expected.append((str(i), held, round(score, 9), int(score >= 0.5)))
    found = [(str(r.doc_id), r.held_out, round(r.score, 9), r.predicted) for r in quality_scores(frame, label_frame).collect()]
    assert sorted(found) == sorted(expected)


def test_quality_of_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality_scores(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    good = [r.predicted for r in judged if r.quality == 1]
    bad = [r.predicted for r in judged if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.15 * len(bad)


def test_quality_without_labels_or_documents(judged_texts):
    _, _, frame, label_frame = judged_texts
    rows = quality_scores(frame, label_frame.limit(0)).collect()
    assert {(r.score, r.predicted) for r in rows} == {(0.5, 1)}
    assert quality_scores(frame.limit(0), label_frame).collect() == []


def test_held_out_labels_teach_nothing(judged_texts):
    docs, labels, frame, label_frame = judged_texts
    held = [i for i, _ in labels if i is not None and zlib.crc32(str(i).encode()) % 3 == 1]
    less = label_frame.filter(~label_frame.doc_id.isin(held))
    first, second = (
        sorted((str(r.doc_id), r.score) for r in quality_scores(frame, some).collect()) for some in (label_frame, less)
    )
    assert first == second


# Hard negatives


def plain_negatives(rows, positives=5, negatives_=5, scale=256):
    whole = []
    for i, v, label in {(i, tuple(v) if v is not None else None, label) for i, v, label in rows}:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole.append((i, label, tuple(math.floor(scale * float(x)) for x in v)))
    out = []
    for i, label, v in whole:
        if i % 100:
            continue
        scored = [
            (-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in whole if len(w) == len(v)
        ]
        scored = [(max(min(s, (1 << 63) - 1), -(1 << 63) + 1), j, other) for s, j, other in scored]
        near = sorted((s, j) for s, j, other in scored if other == label and j != i)[:positives]
        for p, j in near:
            low, high = -(-80 * -p // 100), -p
            fits = sorted((s, k) for s, k, other in scored if other != label and low <= -s <= high)
            out += [(i, j, rank, k, -p, -s) for rank, (s, k) in enumerate(fits[:negatives_], 1)]
    return sorted(out)


def vector_rows():
    rng = np.random.default_rng(9)
    f32 = lambda v: [float(x) for x in np.array(v, np.float32)]
    centres = rng.standard_normal((4, 12))
    rows = [(i, f32(centres[i % 4] + 0.3 * rng.standard_normal(12)), i % 5) for i in range(600)]
    rows += [(600 + i, rows[0][1], i % 2) for i in range(220)]  # a third are copies of an anchor
    rows += [(900, f32(rng.standard_normal(3)), 1), (901, f32(rng.standard_normal(3)), 1), (902, f32(rng.standard_normal(3)), 2)]
    rows += [(1000, [0.0] * 12, 0), (1001, [0.0] * 12, 0), (1100, [], 1), (1101, [], 1), (1102, [], 2)]
    rows += [(1200, None, 1), (1300, [float("nan")] * 12, 1), (1400, [None] * 12, 1), (1500, rows[3][1], None)]
    rows += [(None, rows[5][1], 1), rows[100], rows[100], (200, rows[7][1], 3), (1600, [float("inf")] + [1.0] * 11, 2)]
    return rows


@pytest.mark.parametrize("cell", [negatives.CELL_VALUES, 2000])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, cell):
    """In one cell and in many."""
    monkeypatch.setattr(negatives, "CELL_VALUES", cell)
    rows = vector_rows()
    frame = spark.createDataFrame(
        [(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, anchor int, cell string"
    ).repartition(4)
    found = sorted(tuple(r) for r in hard_negatives(frame).collect())
    assert found == plain_negatives(rows)
    assert len(found) > 100


def test_huge_vectors_are_scored_exactly(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(6) * 10.0 ** (i % 5 * 2 + 1)], i % 3) for i in range(300)]
    rows += [(400, [1e200] * 6, 0), (401, [1e200] * 6, 0), (402, [1e199] * 6, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = sorted(tuple(r) for r in hard_negatives(frame).collect())
    assert found == plain_negatives(rows)
    largest = spark.createDataFrame([(0, [1.7e308] * 2, 0), (1, [1.7e308] * 2, 0), (2, [1.7e308] * 2, 1)], frame.schema)
    most = (1 << 63) - 1
    assert [tuple(r) for r in hard_negatives(largest).collect()] == [(0, 1, 1, 2, most, most)]


def test_bounds_hold_and_prune(spark):
    """No score lies outside its interval; on clustered vectors most rows are not scored."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 32))
    vectors = np.floor(256 * (centres[rng.integers(0, 12, 2000)] + 0.05 * rng.standard_normal((2000, 32))))
    directions = negatives.spread_directions(vectors[:500], 16)
    norms = np.linalg.norm(vectors, axis=1)
    angles = np.arccos(np.clip(vectors / norms[:, None] @ directions.T, -1, 1))
    overlapping = 0
    for a in range(0, 2000, 100):
        low, high = negatives._bounds(norms[a], angles[a], norms, angles, 32)
        scores = vectors @ vectors[a]
        assert (low <= scores).all() and (scores <= high).all()
        best = np.sort(scores)[-6]
        overlapping += ((high >= 0.8 * best) & (low <= best)).sum()
    assert overlapping < 0.4 * 20 * 2000


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives(empty).collect() == []
