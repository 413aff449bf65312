"""Operators on documents against brute force, on small and awkward tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reviewloom.llm import pii, suffix
from reviewloom.llm.language import UNKNOWN, identify, in_known_language
from reviewloom.llm.lines import cut_lines, repeated_lines, without_repeated_lines
from reviewloom.llm.packing import encoder, fill, pack, plan_windows
from reviewloom.llm.pieces import decode, encode, pieces, round_trip
from reviewloom.llm.pii import KINDS, masked, span_digest
from reviewloom.llm.simhash import fingerprint, simhash_groups

BYTES = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
BLANKS = " \t\r\x0b\x0c"
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    syllables = ["the", "re", "ing", "on", "an", "er", "é", "sh", "ou", "ti"]
    out = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(words)]
    return " ".join(w + ("\n" if rng.random() < 0.05 else "") for w in out)


@pytest.fixture(scope="module")
def texts() -> list[tuple[int | None, str | None]]:
    base = [prose(i, 120) for i in range(6)]
    passage = prose(99, 60)
    return [
        (1, base[0]),
        (2, base[0]),  # exact copy
        (3, base[1] + " " + passage),
        (4, passage + "\n" + base[2]),
        (5, base[1] + " " + passage + " x"),
        (6, None),
        (7, ""),
        (8, "short line here with words\n" * 40),
        (9, "a\n" * 60),
        (10, base[3] * 30),
        (11, base[4]),
        (11, base[4]),  # repeated row
        (12, "x" * 3000),
        (13, "\n \n\t\n"),
        (14, "one\ntwo\nthree four\nfive\nsix"),
        (15, "zero\none\ntwo\nthree four\nfive\nsix"),
        (None, base[5]),
        (None, base[0]),
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """The documents with columns that clash with the operators' own names."""
    rows = [(i, t, "en", 0, "k", 1) for i, t in texts]
    schema = "doc_id long, text string, lang string, mark int, key string, node int"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_empty_tables_give_empty_results(empty):
    for result in (
        span_digest(empty),
        simhash_groups(empty),
        round_trip(empty, MODEL),
        suffix.repeated_bytes(empty),
        repeated_lines(empty),
        without_repeated_lines(empty),
        identify(empty),
        in_known_language(empty, 0.3),
        pack(empty, BYTES),
        masked(empty),
    ):
        assert result.collect() == []


# Personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        value = int(c) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> str:
    out = []
    for kind in KINDS:
        for m in re.finditer(PLAIN[kind], text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            passes = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if passes:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


AWKWARD = [
    None, "", "a@b.c_x@d.e.f z@q", "x@y.z@w.v 1.2.3.4.5.6.7.8 0001.2.3.4 256.1.1.1 1.2.3",
    "+1 (743) 555-3824 and +123 +1-2-3-4-5-6-7-8-9 é😀 4111111111111111",
    "4111 1111 1111 1111 4111-1111-1111-1112", "1" * 20000, "a" * 30000, "a@" * 500, "+" * 50 + "1 1",
    "10.0.0.1 0.0.0.0 000.00.0.010 0255.0256.1.1 0256.1.1.1 255.255.255.255", "0" * 4000 + ".1.2.3",
]


def test_base_spans_equal_plain_patterns(spark):
    rows = spark.createDataFrame(list(enumerate(AWKWARD)), "doc_id long, text string")
    for row in span_digest(rows).collect():
        expected = base_spans(AWKWARD[row.doc_id])
        assert row.base_sha256 == sha(expected), row.doc_id
        counts = Counter(s.split(":")[0] for s in expected.split(",") if s)
        extra = Counter(s.split(":")[0] for s in row.spans.split(",") if s)
        assert all(extra[k] >= counts[k] for k in KINDS)


def test_base_spans_of_random_texts(spark):
    draw = random.Random(7)
    texts = ["".join(draw.choices("001258.. -+()@a_\u00e9", k=draw.randint(5, 120))) for _ in range(1500)]
    texts += [".".join(str(draw.choice([0, 1, 9, 10, 99, 100, 200, 255, 256, 300])) for _ in range(4)) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in span_digest(rows).collect():
        assert row.base_sha256 == sha(base_spans(texts[row.doc_id])), texts[row.doc_id]


def test_contexts_find_unseen_identifiers_and_leave_others(spark):
    seeds = [f"word{i} call phone: +1 ({200 + i}) 555-{1000 + i} now" for i in range(12)]
    found = ["zz call phone: 555-1234-99 now", "lot 555-1234-99 here"]
    clean = ["clean 123-4567-89 text", "nothing at all"]
    rows = spark.createDataFrame(list(enumerate(seeds + found + clean)), "doc_id long, text string")
    spans = {r.doc_id: (r.spans, r.n_phone) for r in span_digest(rows).collect()}
    assert spans[12] == ("phone:15:26", 1) and spans[13] == ("phone:4:15", 1)
    assert spans[14] == ("", 0) and spans[15] == ("", 0)
    hidden = {r.doc_id: r.text for r in masked(rows).collect()}
    assert hidden[0] == "word0 call phone: <PHONE> now" and hidden[13] == "lot <PHONE> here"
    assert hidden[14] == clean[0]


def test_what_is_learned_teaches_further_patterns(spark):
    both = [f"555-77{i}0-{i}9" for i in range(10)]
    texts = [f"w call phone: +1 ({200 + i}) 555-{1000 + i} now" for i in range(30)]
    texts += [f"w call phone: {n} now" for n in both] + [f"please reach fax: {n} ok" for n in both]
    texts += ["please reach fax: 555-9999-31 ok", "please reach fax: 12345 ok", "order part no: 555-9999-32 ok"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in span_digest(rows).collect()}
    assert all(spans[i].startswith("phone:") for i in range(51))
    assert spans[50] == "phone:18:29" and spans[51] == spans[52] == ""


def test_contexts_reach_across_other_numbers(spark):
    texts = [f"line {i} phone: +1555123{i:04d} x{i}" for i in range(10, 30)]
    texts += ["line 77 phone: 5551234567 zz", "7654321, line 78 phone: 5559999888, 5553332221", "see 5559999888 there"]
    texts += ["row 77 total: 8881234567 zz"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in span_digest(rows).collect()}
    assert spans[20] == "phone:15:25" and spans[21] == "phone:24:34" and spans[22] == "phone:4:14"
    assert spans[23] == ""


def test_contexts_are_the_text_around_a_match(spark):
    draw = random.Random(5)
    texts = ["".join(draw.choices("12a \n,\u00e9\U0001f600", k=draw.randint(0, 400))) for _ in range(200)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in frame.select("text", pii._located(F.col("text"), "[0-9]++", F.lit("x")).alias("found")).collect():
        assert [(s.start, s.end) for s in r.found] == [m.span() for m in re.finditer("[0-9]+", r.text)]
        for s in r.found:
            assert s.before == r.text[max(0, s.start - pii.CONTEXT) : s.start]
            assert s.after == r.text[s.end : s.end + pii.CONTEXT]


def test_columns_of_any_name(docs, texts):
    clashing = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(["_id", "_hash", "_spans", "_doc", "_mark", "_runs", "doc", "at"])))
    for stage in (masked, without_repeated_lines):
        assert stage(clashing).columns == clashing.columns
        found = Counter((r.doc_id, r.text, r._spans, r._runs) for r in stage(clashing).collect())
        assert found == Counter((r.doc_id, r.text, 2, 5) for r in stage(docs).collect())
        assert stage(clashing.limit(0)).collect() == []


def test_many_overlapping_spans_are_masked(spark):
    draw = random.Random(3)
    parts = ["+4111 1111 1111 1111", "u{}@h.example", "10.0.{}.1", "+1 (743) 555-{}", "word", "4111111111111111@x.y"]
    texts = [" ".join(draw.choice(parts).format(draw.randint(100, 250)) for _ in range(n)) for n in (1, 7, 127, 128, 129, 900)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in span_digest(rows).collect()}
    for row in masked(rows).collect():
        found = [(int(s.split(":")[1]), -int(s.split(":")[2]), s.split(":")[0]) for s in spans[row.doc_id].split(",") if s]
        at, out, text = 0, "", texts[row.doc_id]
        for start, end, kind in sorted(found):
            if start >= at:
                out += f"{text[at:start]}<{kind.upper()}>"
            at = max(at, -end)
        assert row.text == out + text[at:]


def test_personal_data_keeps_rows(docs, texts):
    assert Counter(r.doc_id for r in span_digest(docs).collect()) == Counter(i for i, _ in texts)
    assert masked(docs).columns == docs.columns
    assert masked(docs).count() == len(texts)


# SimHash


def plain_fingerprint(text: str | None) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode())
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_plain_ones(texts):
    for _, text in [*texts, (0, "One"), (0, "A b\x0bC\x0c"), (0, "É é e\u00a0f g h")]:
        assert fingerprint(text) == plain_fingerprint(text)


def components(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def test_simhash_groups_equal_brute_force(docs, texts):
    prints = {i: plain_fingerprint(t) for i, t in texts if i is not None}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    expected = components(prints, links)
    rows = simhash_groups(docs).collect()
    assert len(rows) == len(texts)
    for row in rows:
        if row.doc_id is not None:
            assert int(row.fingerprint, 16) == prints[row.doc_id]
            assert row.component_id == expected[row.doc_id]


def test_pigeonring_loses_no_pair(spark, monkeypatch):
    from reviewloom.llm import simhash

    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 40, np.uint64)
    bits = []
    for centre in centres:
        for _ in range(12):
            flips = rng.choice(64, rng.integers(0, 6), replace=False)
            bits.append(int(centre) ^ int(sum(1 << int(f) for f in flips)))
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 4)  # buckets in cells
    rows = spark.createDataFrame([(i, b - (1 << 64) if b >> 63 else b) for i, b in enumerate(bits)], "doc_id long, b long")
    monkeypatch.setattr(
        simhash, "_fingerprints", lambda batches, width: (x.rename_columns(["doc_id", "bits"]) for x in batches)
    )
    found = {r.doc_id: r.component_id for r in simhash_groups(rows, text_col="b").collect()}
    links = [(i, j) for i in range(len(bits)) for j in range(i) if (bits[i] ^ bits[j]).bit_count() <= 4]
    assert found == components(range(len(bits)), links)

# Pipeline stage of near duplicates


def test_stage_keeps_one_document_of_each_group(spark, docs, texts):
    from reviewloom.llm import stages

    kept = stages.simhash_near_dedup(spark, docs, "").collect()
    prints = [(i, fingerprint(t)) for i, t in texts]
    expected = set()
    for i, own in prints:
        group = {own}
        while True:
            more = {p for _, p in prints if any((p ^ g).bit_count() <= 4 for g in group)}
            if more == group:
                break
            group = more
        expected.add(min((j for j, p in prints if p in group and j is not None), default=None))
    assert sorted(r.doc_id for r in kept) == sorted(expected - {None})
    assert all((r.doc_id, r.text) in texts for r in kept)


def test_stage_work_follows_the_copies_not_their_pairs(spark, monkeypatch):
    """Each of 400 near copies gives at most one link for each of its ten keys."""
    from reviewloom.llm import simhash, stages

    base = prose(7, 200).split()
    rows = []
    for i in range(400):
        words = list(base)
        words[i % 200] = f"x{i}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    made, find = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda edges: made.append(edges.count()) or find(edges))
    kept = stages.simhash_near_dedup(spark, frame, "").count()
    assert len({fingerprint(t) for _, t in rows}) > 100
    assert kept < 40 and 0 < made[0] <= 10 * 400


# SentencePiece


def test_pieces_equal_the_library(docs, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(1)
    some = [t or "" for _, t in texts] + [" ", "  a  b\n c\tx", "▁x▁▁y", "日本語😀 ﬁ²", "     ", "<s> <0x0A>"]
    some += ["".join(rng.choice("aab  c▁é日\n😀xthe ing") for _ in range(rng.randrange(40))) for _ in range(300)]
    for text, ids in zip(some, pieces(MODEL).encode(some)):
        assert np.frombuffer(ids, "<i4").tolist() == model.encode(text)
    ids = encode(docs, MODEL)
    back = sorted((str(r.doc_id), r.text) for r in decode(ids, MODEL).collect())
    assert back == sorted((str(i), t or "") for i, t in texts)


def test_round_trip_digests(docs, texts):
    found = sorted((str(r.doc_id), r.decoded_sha256) for r in round_trip(docs, MODEL).collect())
    assert found == sorted((str(i), sha(t or "")) for i, t in texts)


# Suffix buckets


def plain_bytes(rows):
    seen, out = set(), {}
    for doc, text in sorted({r for r in rows if r[0] is not None}, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(data[i : i + 100])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out[doc] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [1000, 1])
def test_repeated_bytes_equal_brute_force(docs, texts, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    texts = [(i, t or "") for i, t in texts]
    expected = plain_bytes(texts)
    rows = suffix.repeated_bytes(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[r.doc_id], r.doc_id


def test_long_text_in_pieces(spark):
    text = prose(7, 400_000)  # longer than a piece
    assert len(text.encode()) > 2 * suffix.PIECE
    rows = [(1, text), (2, text[500_000:600_000])]
    found = {r.doc_id: r for r in suffix.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].n_removed == 0 and found[2].n_removed == found[2].n_bytes


# Lines


def all_runs(rows, min_words=5):
    """Per text, the lines removed by later copies of runs of every length."""
    docs = {i: [s.strip(BLANKS) for s in t.split("\n") if s.strip(BLANKS)] for i, t in rows}
    gone, seen = {i: set() for i in docs}, set()
    for i in sorted(docs):
        for at in range(len(docs[i])):
            for end in range(at + 1, len(docs[i]) + 1):
                run = tuple(docs[i][at:end])
                if run in seen and sum(len(s.split()) for s in run) >= min_words:
                    gone[i].update(range(at, end))
                seen.add(run)
    return {i: len(g) for i, g in gone.items()}


def test_repeated_lines_equal_brute_force(docs, texts):
    expected = all_runs([(i, t) for i, t in texts if i is not None and t is not None])
    assert expected[15] == 5 and expected[8] == 39 and expected[9] > 0
    for r in repeated_lines(docs).collect():
        assert r.n_removed == expected.get(r.doc_id, 0), r.doc_id
    kept = without_repeated_lines(docs)
    assert kept.columns == docs.columns and kept.count() == len(texts)
    by_id = {r.doc_id: r.text for r in kept.collect()}
    assert by_id[6] is None and by_id[2].strip() == "" and by_id[1] == dict(texts)[1]


def test_runs_of_short_lines(spark):
    rows = [(1, "a b\nc d\ne f\ng h\nx"), (2, "q\na b\nc d\ne f\ng h\ny"), (3, "c d\nz")]
    found = {r.doc_id: r.n_removed for r in repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 0, 2: 4, 3: 0}
    assert cut_lines("a\n\nb\nc", [(1, 1)]) == ("a\n\nc", 1, [(1, 1)])


def test_runs_of_every_length(spark):
    words = ["a b", "c d", "e f"]
    menu = ["home", "news", "shop", "help", "about", "login", "cart"]
    edge = ["x", "y", "one two three four five six", "z"]
    rows = [(1, "p\n" + "\n".join(words) + "\nq"), (2, "r\n" + "\n".join(words) + "\ns")]
    for n in (5, 6, 7):
        rows += [(n * 10 + k, f"{n} {k}\n" + "\n".join(f"{m}{n}" for m in menu[:n])) for k in (0, 1)]
    rows += [(100, "\n".join(edge)), (101, "v\n" + "\n".join(edge) + "\nw")]
    expected = {2: 3, 51: 5, 61: 6, 71: 7, 101: 4}
    draw = random.Random(11)
    lines = ["a", "b", "c", "d e", "f g h", "one two three four five six"]
    rows += [(200 + k, "\n".join(draw.choices(lines, k=draw.randint(1, 14)))) for k in range(60)]
    found = {r.doc_id: r.n_removed for r in repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: n for i, n in found.items() if i < 200 and n} == expected
    assert found == all_runs(rows)


# Language

LANGS = {"en": "the of and with this that ing tion".split(), "fr": "les une pour êtes où ça dans nous".split()}


def language_rows(n: int):
    rng, rows = random.Random(3), []
    for i in range(n):
        lang = "en" if i % 3 else "fr"
        rows.append((i, " ".join(rng.choices(LANGS[lang], k=rng.randint(5, 40))), lang))
    return rows


def test_language_of_held_out_documents(spark):
    rows = language_rows(300)
    extra = [(900, None, "en"), (901, "", "en"), (902, "12 34 !", "fr"), (903, "les une pour", None), (None, "the of and", "en")]
    frame = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in identify(frame).collect()}
    for i, _, lang in rows:
        assert found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert found[i].lang_pred == lang and 0 <= found[i].score <= 1
    assert [found[i].lang_pred for i in (900, 901, 902, 903, None)] == [UNKNOWN] * 3 + ["fr", "en"]
    assert found[902].score == 0 and found[None].held_out is False
    kept = in_known_language(frame, 0.3)
    assert kept.count() == 302 and kept.columns == frame.columns


def test_language_without_labels_is_unknown(spark):
    frame = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in identify(frame).collect()] == [(UNKNOWN, 0.0)]


# Packing


def test_ids_equal_the_tokenizer(texts):
    tokenizer, ours = Tokenizer.from_file(BYTES), encoder(BYTES)
    more = [" ", "  a  b", " a", "a\n\n b\n", "x<|endoftext|>y z", "it's 12ab ²½ \x1c y\x85z", "日本語 です", "a \n b", " \n"]
    for text in [t or "" for _, t in texts] + more:
        assert np.frombuffer(ours(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_windows_are_filled_by_least_slack():
    assert fill({7: 1, 5: 1, 4: 1, 3: 2}, 10) == {7: 1, 3: 1}
    assert fill({6: 1, 5: 9, 2: 2}, 10) == {6: 1, 2: 2}
    rng = random.Random(2)
    for _ in range(30):
        counts = Counter(rng.choices(range(1, 65), k=rng.randint(1, 300)))
        plan = plan_windows(dict(counts), 64)
        used = Counter()
        for times, chosen in plan:
            assert sum(k * n for k, n in chosen.items()) <= 64
            for k, n in chosen.items():
                used[k] += times * n
        assert used == counts


def test_packing_places_every_id_once(docs, texts):
    tokenizer = Tokenizer.from_file(BYTES)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts}
    rows = pack(docs, BYTES, capacity=256).collect()
    fills = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fills[r.sequence_id]
        fills[r.sequence_id] += r.length
        if r.doc_id is not None:
            own = ids[r.doc_id][r.start : r.start + r.length]
            assert len(own) == r.length and r.doc_tokens == len(ids[r.doc_id])
            assert zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
    assert max(fills.values()) <= 256
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts)
    assert sum(fills.values()) == total


def test_extra_columns_do_not_matter(docs):
    slim = docs.select("doc_id", "text", "lang")
    for run in (span_digest, simhash_groups, repeated_lines, identify):
        order = lambda df: sorted(map(str, df.collect()))
        assert order(run(docs)) == order(run(slim))
    assert F is not None
