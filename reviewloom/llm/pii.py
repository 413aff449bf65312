"""Personal data by base patterns and bootstrapped contextual extraction.

Base spans of each kind come from regular expressions and checks. They are the
seeds: the words around them are lexical patterns (the two words before, and the
word on either side). Number runs and address-like tokens that no base span
touches are the other instances. Spark scores the graph of patterns and instances
in rounds: a pattern is worth the mean score of the distinct instances it
extracts, smoothed; an instance is worth what its patterns give it together, and what is
accepted supports further patterns, also such as no seed stands in.
Instances that end above ``ACCEPT`` are identifiers that no base pattern knows,
and all their occurrences become spans of the kind.

Everything here is Spark expressions. A span's position follows from the lengths
of what ``split`` leaves between the matches. The expressions use possessive
quantifiers and start only at the border of a run, so a long run is read once
and needs no stack.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import checkpointed, free_names

KINDS = ("email", "ip", "card", "phone")
# The base patterns, as linear forms of the documented ones.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# A text without this character has no match.
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
CANDIDATE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"
    r"|(?:\G|(?<![A-Za-z0-9+(]))[+(]?[0-9][0-9 ().:/-]*[0-9]"
)
BLOCK = 128  # appending copies a list, so spans are listed block by block
# Code points looked at on either side of an instance, whatever stands there. Without a
# bound, every instance in a long list without blanks would carry the list.
CONTEXT = 48
FOLLOWING = rf"(?=([\s\S]{{0,{CONTEXT}}}))"

SUPPORT = 3  # distinct instances a pattern needs
SMOOTHING = 2.0
TRUST = 0.5  # patterns below this teach nothing
ACCEPT = 0.8
ROUNDS = 3


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    size = F.length(digits)

    def value(i: Column) -> Column:
        digit = digits.substr(size - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, digit).when(digit > 4, digit * 2 - 9).otherwise(digit * 2)

    places = F.sequence(F.lit(0), size - 1)
    return F.aggregate(places, F.lit(0), lambda total, i: total + value(i)) % 10 == 0


def _passing(kind: str):
    """The check of a kind, on a span."""
    return lambda span: _passes(kind, span["value"])


def _passes(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return found.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)


SPAN = "struct<kind:string,start:int,end:int,value:string,before:string,after:string>"


def _located(text: Column, pattern: str, kind: Column) -> Column:
    """All matches as spans with what the text holds before and after each.

    ``pieces`` alternates with ``found``: piece, match, piece, match, ..., piece. The
    state carries the end of the text so far, earlier matches included.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    after = F.regexp_extract_all(text, F.lit(f"(?:{pattern}){FOLLOWING}"), F.lit(1))
    both = F.struct(pieces.alias("pieces"), found.alias("found"), after.alias("after"))

    def spans(parts: Column) -> Column:
        pieces, found, after = parts["pieces"], parts["found"], parts["after"]
        none = F.array().cast(f"array<{SPAN}>")

        def step(state: Column, i: Column) -> Column:
            piece, match = F.get(pieces, i), F.get(found, i)
            first = state["at"] + F.length(piece)
            last = first + F.length(match)
            before = F.right(F.concat(state["tail"], piece), F.lit(CONTEXT))
            span = F.struct(
                kind.alias("kind"),
                first.alias("start"),
                last.alias("end"),
                match.alias("value"),
                before.alias("before"),
                F.get(after, i).alias("after"),
            )
            return F.struct(
                last.alias("at"),
                F.right(F.concat(before, match), F.lit(CONTEXT)).alias("tail"),
                F.array_append(state["out"], span).alias("out"),
            )

        def block(state: Column, first: Column) -> Column:
            numbers = F.sequence(first, F.least(first + (BLOCK - 1), F.size(found) - 1))
            begin = F.struct(state["at"].alias("at"), state["tail"].alias("tail"), none.alias("out"))
            inner = F.aggregate(numbers, begin, step)
            joined = lambda done: F.struct(
                done["at"].alias("at"),
                done["tail"].alias("tail"),
                F.array_append(state["out"], done["out"]).alias("out"),
            )
            return F.get(F.transform(F.array(inner), joined), F.lit(0))

        blocks = F.when(
            F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1, F.lit(BLOCK))
        ).otherwise(F.array().cast("array<int>"))
        start = F.struct(
            F.lit(0).alias("at"),
            F.lit("").alias("tail"),
            F.array().cast(f"array<array<{SPAN}>>").alias("out"),
        )
        return F.aggregate(blocks, start, block, lambda state: F.flatten(state["out"]))

    # A lambda over one value keeps the two passes over the text from being repeated.
    return F.get(F.transform(F.array(both), spans), F.lit(0))


def base_spans(text: Column) -> Column:
    """The base spans of a text, by kind as listed, then start."""
    has_digit, none = text.rlike("[0-9]"), F.array().cast(f"array<{SPAN}>")
    lists = []
    for kind in KINDS:
        needed = NEEDED[kind]
        possible = text.contains(needed) if needed else has_digit
        if kind in ("ip", "phone"):
            possible = possible & has_digit
        found = F.filter(_located(text, PATTERNS[kind], F.lit(kind)), _passing(kind))
        lists.append(F.when(possible, found).otherwise(none))
    return F.concat(*lists)


def _touched(span: Column, spans: Column) -> Column:
    """Whether one of ``spans``, which are in order and apart, overlaps ``span``.

    Halving finds the last one that starts before the span ends.
    """

    def step(state: Column, _: Column) -> Column:
        middle = F.shiftright(state["low"] + state["high"], 1)
        between = state["high"] - state["low"] > 1
        before = F.get(spans, middle)["start"] < span["end"]
        return F.struct(
            F.when(between & before, middle).otherwise(state["low"]).alias("low"),
            F.when(between & ~before, middle).otherwise(state["high"]).alias("high"),
        )

    halvings = F.sequence(F.lit(1), F.length(F.bin(F.size(spans))))
    start = F.struct(F.lit(-1).alias("low"), F.size(spans).alias("high"))
    last = F.aggregate(halvings, start, step, lambda state: F.get(spans, state["low"])["end"])
    return F.coalesce(last > span["start"], F.lit(False))


def candidate_spans(text: Column, base: Column) -> Column:
    """Other address-like tokens and number runs, of no kind yet."""
    possible = text.contains("@") | text.rlike("[0-9]")
    found = _located(text, CANDIDATE, F.lit(None).cast("string"))
    digits = lambda s: F.length(F.regexp_replace(s["value"], "[^0-9]", ""))
    of_kind = lambda kind: F.filter(base, lambda b: b["kind"] == kind).alias(kind)
    parts = F.struct(found.alias("found"), *map(of_kind, KINDS))

    def apart(p: Column) -> Column:
        touched = lambda s: functools.reduce(operator.or_, (_touched(s, p[kind]) for kind in KINDS))
        likely = lambda s: s["value"].contains("@") | digits(s).between(7, 19)
        return F.filter(p["found"], lambda s: likely(s) & ~touched(s))

    kept = F.get(F.transform(F.array(parts), apart), F.lit(0))
    return F.when(possible, kept).otherwise(F.array().cast(f"array<{SPAN}>"))


def _word(side: Column, pattern: str) -> Column:
    """A context word: lower case, digits made alike, marks at its ends dropped."""
    word = F.lower(F.regexp_extract(side, pattern, 1))
    return F.regexp_replace(F.regexp_replace(word, "[0-9]", "0"), r"^[^\p{L}0:#=]+|[^\p{L}0:#=]+$", "")


def _graph(rows: DataFrame) -> DataFrame:
    """(pattern, instance, kind): distinct edges; the kind of a seed, else null."""
    last = _word(F.col("before"), r"(\S+)\s*$")
    second = _word(F.col("before"), r"(\S+)\s+\S+\s*$")
    following = _word(F.col("after"), r"^\s*(\S+)")
    patterns = F.array(
        F.when((last != "") & (second != ""), F.concat_ws(" ", F.lit("<"), second, last)),
        F.when((last != "") & (following != ""), F.concat_ws(" ", F.lit("<>"), last, following)),
    )
    return (
        rows.withColumn("pattern", F.explode(F.filter(patterns, lambda p: p.isNotNull())))
        .select("pattern", F.col("value").alias("instance"), "kind")
        .distinct()
    )


def _fits(kind: Column, value: Column) -> Column:
    """Whether an instance looks enough like the kind to become one of it."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return (
        F.when(kind == "email", value.contains("@"))
        .when(kind == "ip", value.rlike("[.:]") & ~value.contains("@"))
        .when(kind == "card", (digits >= 12) & ~value.contains("@"))
        .otherwise(digits.between(7, 15) & ~value.contains("@"))
    )


def learned_instances(rows: DataFrame) -> DataFrame:
    """(value, kind) of instances without a kind that the patterns of seeds vouch for.

    ``rows`` are occurrences (kind, value, before, after). A pattern is trusted with a
    kind from ``SUPPORT`` distinct instances on, which are seeds or were accepted in the
    round before, so what seeds teach spreads by one pattern a round. Patterns that
    extract fewer instances leave the graph.
    """
    edges = _graph(rows)
    # What each pattern extracts, known kind or not.
    size = (
        edges.groupBy("pattern").agg(F.count("*").alias("extracted")).filter(F.col("extracted") >= SUPPORT)
    )
    edges = checkpointed(edges.join(size, "pattern"))
    seeds = checkpointed(
        edges.filter("kind is not null")
        .groupBy("pattern", "kind", "extracted")
        .agg(F.count("*").cast("double").alias("gained"), F.count("*").alias("known"))
    )
    unknown = edges.filter("kind is null").drop("kind")
    scores = None
    for _ in range(ROUNDS):
        learned = seeds
        if scores is not None:
            gained = (
                unknown.join(scores, "instance")
                .groupBy("pattern", "kind", "extracted")
                .agg(
                    F.sum("score").alias("gained"),
                    F.count(F.when(F.col("score") >= ACCEPT, 1)).alias("known"),
                )
            )
            learned = (
                seeds.union(gained)
                .groupBy("pattern", "kind", "extracted")
                .agg(F.sum("gained").alias("gained"), F.sum("known").alias("known"))
            )
        trust = learned.filter(F.col("known") >= SUPPORT).select(
            "pattern", "kind", (F.col("gained") / (F.col("extracted") + SMOOTHING)).alias("trust")
        ).filter(F.col("trust") >= TRUST)
        scores = checkpointed(
            unknown.join(trust, "pattern")
            .filter(_fits(F.col("kind"), F.col("instance")))
            .groupBy("instance", "kind")
            .agg((1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("score"))
        )
    best = scores.groupBy("instance").agg(
        F.max(F.struct("score", F.col("kind").alias("kind"))).alias("best")
    )
    return best.filter(F.col("best.score") >= ACCEPT).select(
        F.col("instance").alias("value"), F.col("best.kind").alias("kind")
    )


def personal_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text_hash, base, spans): arrays of (kind, start, end) for every row.

    ``spans`` holds the base spans and those found by context, both by kind as
    listed, then start, in code points with the end exclusive. A null text is
    empty. Repeated rows give repeated results; rows without id are read like
    others. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
        .select("doc_id", F.xxhash64("text").alias("text_hash"), "text", base_spans(F.col("text")).alias("base"))
        .select("*", candidate_spans(F.col("text"), F.col("base")).alias("others"))
        .withColumn("row", F.monotonically_increasing_id())
        .drop("text")
    )
    found = checkpointed(found)
    occurrences = found.select("row", F.explode(F.concat("base", "others")).alias("s")).select("row", "s.*")
    learned = learned_instances(occurrences)
    extra = (
        occurrences.filter("kind is null")
        .drop("kind")
        .join(learned, "value")
        .groupBy("row")
        .agg(F.collect_list(F.struct("kind", "start", "end")).alias("extra"))
    )
    slim = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["end"]))
    order = lambda s: F.struct(
        F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("place"), s["start"], s["end"], s["kind"]
    )
    whole = F.concat(slim(F.col("base")), F.coalesce("extra", F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    ordered = F.array_sort(F.transform(whole, order))
    return found.join(extra, "row", "left").select(
        "doc_id",
        "text_hash",
        slim(F.col("base")).alias("base"),
        F.transform(ordered, lambda s: F.struct(s["kind"], s["start"], s["end"])).alias("spans"),
    )


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def span_digest(docs: DataFrame) -> DataFrame:
    """Counts per kind, digest of the base spans and list of all spans, per document."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return personal_spans(docs).select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlaps become one.

    Every row stays. A null text stays null, a text without spans as it is; texts of any
    length are masked whole. Rows without id are masked like others, repeated rows alike.
    Of spans that start together the longest names the mask, then the first kind by
    name. An empty table stays empty. Columns may have any name.
    """
    own_id, own_hash, own = free_names(docs.columns, "_id", "_hash", "_spans")
    spans = (
        personal_spans(docs, id_col, text_col)
        .filter(F.size("spans") > 0)
        .select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash), F.col("spans").alias(own))
        .dropDuplicates([own_id, own_hash])
    )
    text = F.col(text_col)
    by_start = F.array_sort(
        F.transform(own, lambda s: F.struct(s["start"], (-s["end"]).alias("end"), s["kind"]))
    )
    # Each span covers from where the previous ones ended; the piece before it is kept.
    # A block of spans works on its own section of the text.
    def covered(spans: Column) -> Column:
        def block(state: Column, first: Column) -> Column:
            last = F.least(first + (BLOCK - 1), F.size(spans) - 1)
            width = F.greatest(F.get(spans, last)["start"] - state["at"], F.lit(0))
            section = F.struct(state["at"].alias("at"), text.substr(state["at"] + 1, width).alias("text"))

            def pieces(part: Column) -> Column:
                def step(inner: Column, i: Column) -> Column:
                    s = F.get(spans, i)
                    kept = part["text"].substr(inner["at"] - part["at"] + 1, s["start"] - inner["at"])
                    piece = F.concat(kept, F.lit("<"), F.upper(s["kind"]), F.lit(">"))
                    return F.struct(
                        F.greatest(inner["at"], -s["end"]).alias("at"),
                        F.when(s["start"] >= inner["at"], F.array_append(inner["out"], piece))
                        .otherwise(inner["out"])
                        .alias("out"),
                    )

                begin = F.struct(part["at"].alias("at"), F.array().cast("array<string>").alias("out"))
                return F.aggregate(F.sequence(first, last), begin, step)

            joined = lambda done: F.struct(
                done["at"].alias("at"),
                F.array_append(state["out"], F.array_join(done["out"], "")).alias("out"),
            )
            inner = F.get(F.transform(F.array(section), pieces), F.lit(0))
            return F.get(F.transform(F.array(inner), joined), F.lit(0))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        rest = lambda state: text.substr(state["at"] + 1, F.length(text))
        return F.aggregate(
            F.sequence(F.lit(0), F.size(spans) - 1, F.lit(BLOCK)),
            start,
            block,
            lambda state: F.concat(F.array_join(state["out"], ""), rest(state)),
        )

    # A lambda over one value keeps the sorting from being repeated.
    hidden = F.get(F.transform(F.array(by_start), covered), F.lit(0))
    key = (F.col(id_col).cast("long").eqNullSafe(F.col(own_id))) & (
        F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(own_hash)
    )
    return docs.join(spans, key, "left").select(
        *(
            F.when(F.col(own).isNotNull(), hidden).otherwise(text).alias(c) if c == text_col else F.col(c)
            for c in docs.columns
        )
    )
