"""SQL for the operators that SQL can express on whole tables, in DuckDB's dialect.

Each is the plain definition of the result: every 100-byte string, every run of
lines, every pair of one label.
"""

from __future__ import annotations

SUFFIX_DEDUP = """
with texts as (
    select doc_id, hex(encode(coalesce(text, ''))) as h from documents
), strings as (
    select doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) as name
    from texts, unnest(range(0, length(h) // 2 - 99)) as u(i)
), later as (
    select doc_id, i, lag(i) over (partition by doc_id order by i) as before
    from (select *, row_number() over (partition by name order by doc_id, i) as nth from strings)
    where nth > 1
), islands as (
    select *, sum(case when before + 100 >= i then 0 else 1 end)
        over (partition by doc_id order by i) as island
    from later
), spans as (
    select doc_id, min(i) as first, max(i) + 100 as last from islands group by doc_id, island
), gaps as (
    select doc_id, first, last, lag(last, 1, 0) over (partition by doc_id order by first) as since
    from spans
), removed as (
    select doc_id, sum(last - first) as n_removed, count(*) as n_spans, max(last) as last,
        string_agg(substr(h, 2 * since + 1, 2 * (first - since)), '' order by first) as kept
    from gaps join texts using (doc_id) group by doc_id
)
select doc_id,
    cast(length(h) // 2 as bigint) as n_bytes,
    cast(coalesce(n_removed, 0) as bigint) as n_removed,
    cast(coalesce(n_spans, 0) as bigint) as n_spans,
    sha256(unhex(concat(coalesce(kept, ''), substr(h, 2 * coalesce(last, 0) + 1)))) as kept_sha256
from texts left join removed using (doc_id)
"""

# Each line has a word, so longer runs are unions of those of five lines.
LINE_DEDUP = """
with texts as (
    select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents
), lines as (
    select doc_id, place, parts[place] as line,
        trim(parts[place], concat(' ', chr(9), chr(11), chr(12), chr(13))) as bare
    from texts, unnest(range(1, len(parts) + 1)) as u(place)
), filled as (
    select doc_id, place, bare,
        len(regexp_split_to_array(bare, '[ \\t\\r\\x0b\\x0c]+')) as words,
        row_number() over (partition by doc_id order by place) - 1 as spot
    from lines where bare <> ''
), runs as (
""" + " union all ".join(
    f"""
    select doc_id, spot, {width} as width,
        string_agg(bare, chr(10)) over ahead as name,
        sum(words) over ahead as words, count(*) over ahead as n
    from filled
    window ahead as (
        partition by doc_id order by spot rows between current row and {width - 1} following
    )"""
    for width in range(1, 6)
) + """
), copies as (
    select doc_id, spot, width
    from (
        select *, row_number() over (partition by width, name order by doc_id, spot) as nth
        from runs where n = width and words >= 5
    ) where nth > 1
), gone as (
    select distinct doc_id, spot + step as spot
    from copies, unnest(range(0, width)) as u(step)
), islands as (
    select doc_id, count(*) as size
    from (select *, spot - row_number() over (partition by doc_id order by spot) as island from gone)
    group by doc_id, island
), removed as (
    select doc_id, sum(size) as n_removed, count(*) as n_runs, max(size) as longest_run
    from islands group by doc_id
), kept as (
    select doc_id, string_agg(line, chr(10) order by place) as text
    from lines left join filled using (doc_id, place) left join gone using (doc_id, spot)
    where gone.spot is null group by doc_id
)
select doc_id,
    cast(len(parts) as bigint) as n_lines,
    cast(coalesce(n_removed, 0) as bigint) as n_removed,
    cast(coalesce(n_runs, 0) as bigint) as n_runs,
    cast(coalesce(longest_run, 0) as bigint) as longest_run,
    sha256(coalesce(kept.text, '')) as kept_sha256
from texts left join removed using (doc_id) left join kept using (doc_id)
"""

EMBEDDING_NEAR_DEDUP = """
with recursive vectors as (
    select vec_id, label, cast(embedding as double[]) as v from embeddings
), usable as (
    select vec_id, any_value(label) as label, any_value(v) as v
    from (select *, unnest(v) as x from vectors where label is not null)
    group by vec_id having bool_and(coalesce(isfinite(x), false)) and bool_or(x <> 0)
), links as (
    select a.vec_id as x, b.vec_id as y
    from usable a join usable b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
    where list_cosine_similarity(a.v, b.v) >= 0.98
), reached as (
    select vec_id, vec_id as component_id from vectors
    union
    select y, component_id from reached join links on x = vec_id where component_id < y
), least as (
    select vec_id, min(component_id) as component_id from reached group by vec_id
), counted as (
    select x as vec_id, count(*) as n_links from links group by x
)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept
from least left join counted using (vec_id)
"""

COLLOCATIONS = r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\n\x0b\x0c\r]')) as piece
    from documents
), bags as (
    select lang, regexp_extract_all(piece, '[^ \t]+') as words from pieces
), spots as (
    select lang, words, size, unnest(range(1, len(words) - size + 2)) as i
    from bags, (values (1), (2), (3)) as sizes(size)
), counts as (
    select lang, size, array_to_string(words[i : i + size - 1], ' ') as phrase, count(*) as f
    from spots group by all
), totals as (
    select lang, cast(sum(f) as bigint) as n from counts where size = 1 group by lang
), candidates as (
    select lang, size, phrase, f as a, string_split(phrase, ' ') as words
    from counts where size > 1 and f >= 10
), cuts as (
    select lang, size, phrase, a, k,
        array_to_string(words[:k], ' ') as first, array_to_string(words[k + 1 :], ' ') as rest
    from candidates, (values (1), (2)) as places(k) where k < size
), scored as (
    select c.lang, c.size, c.phrase, c.a, k, l.f as l, r.f as r,
        cast(1000000 * cast(a as hugeint) * a // (cast(l.f as hugeint) * r.f) as bigint) as score
    from cuts c
    join counts l on l.lang = c.lang and l.phrase = c.first
    join counts r on r.lang = c.lang and r.phrase = c.rest
), worst as (
    select * from scored
    qualify row_number() over (partition by lang, phrase order by score, k) = 1
), around as (
    select lang, phrase, max(a) as a from (
        select lang, a, array_to_string(words[:2], ' ') as phrase from candidates where size = 3
        union all
        select lang, a, array_to_string(words[2:], ' ') from candidates where size = 3
    ) group by lang, phrase
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank,
    phrase, a, l, r, n, score
from (
    select w.* from worst w left join around o on o.lang = w.lang and o.phrase = w.phrase and w.size = 2
    where o.a is null or 100 * o.a < 50 * w.a
) join totals using (lang)
qualify rank <= 2000
"""

HARD_NEGATIVES = """
with vectors as (
    select distinct vec_id, embedding,
        case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
), whole as (
    select vec_id, label, [floor(256 * cast(x as double)) for x in embedding] as v from vectors
    where len([x for x in embedding if x is null or not isfinite(x)]) = 0
), scores as (
    select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
        cast(list_dot_product(a.v, b.v) as bigint) as score
    from whole a join whole b on len(a.v) = len(b.v) and a.vec_id <> b.vec_id
    where a.vec_id % 100 = 0
), positives as (
    select anchor_id, vec_id as positive_id, score as positive_score from scores where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id,
    cast(row_number() over (
        partition by anchor_id, positive_id order by score desc, vec_id) as integer) as rank,
    vec_id as negative_id, positive_score, score as negative_score
from positives join scores using (anchor_id)
where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify rank <= 5
"""

ORACLES: dict[str, str] = {
    "op6_suffix_dedup": SUFFIX_DEDUP,
    "op7_line_dedup": LINE_DEDUP,
    "op10_embedding_near_dedup": EMBEDDING_NEAR_DEDUP,
    "op11_collocations": COLLOCATIONS,
    "op13_hard_negatives": HARD_NEGATIVES,
}
