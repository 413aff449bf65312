"""For every query, the same result as SQL over the given tables.

The statements are written against the base tables, not against the stand-ins,
so that they check the operators independently.
"""

from __future__ import annotations

# Building blocks: cleaned stand-in rows as common table expressions.

LINES = """
lines AS (
  SELECT l_partkey AS appid, l_orderkey AS order_id, {playtime} / 60.0 AS hours,
         CAST(l_returnflag <> 'R' AS BIGINT) AS voted_up,
         l_linenumber - 1 AS votes, CAST(l_linenumber - 1 > 0 AS BIGINT) AS helpful,
         CAST(l_linestatus = 'O' AS BIGINT) AS early,
         l_shipdate AS review_date,
         4 + length(CAST(l_orderkey AS VARCHAR)) AS review_length
  FROM lineitem
)"""

TEXTS = r"""
texts AS (
  SELECT d.doc_id, CAST(substr(d.source, 4) AS BIGINT) AS appid, d.lang AS language,
         d.text AS review, d.n_chars / 60.0 AS hours,
         CAST(l.quality AS BIGINT) AS voted_up,
         CAST(l.quality + l.toxic > 0 AS BIGINT) AS helpful,
         CAST(l.toxic AS BIGINT) AS early,
         CAST(length(d.text) AS BIGINT) AS review_length,
         CAST(len(string_split(trim(regexp_replace(
           d.text, '[\s\x0b\x{85}\p{Z}]+', ' ', 'g')), ' ')) AS BIGINT) AS review_word_count,
         CAST(length(d.text) > 8000 AS BIGINT) AS extreme_text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

GAMES = """
games AS (
  SELECT o_orderkey AS appid, 'Order ' || o_orderkey AS game_name,
         CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS release_date,
         CAST(floor(o_totalprice / 100000) * 100000 AS BIGINT) AS price_floor,
         o_orderpriority = '4-NOT SPECIFIED' AS no_estimate,
         o_custkey, o_totalprice, o_orderstatus, o_orderpriority, o_orderkey,
         CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS urgency
  FROM orders
)"""

GAME_OWNERS = """
owners AS (
  SELECT *,
         CASE WHEN no_estimate THEN '0 - 0'
              ELSE price_floor || ' - ' || (price_floor + 100000) END AS estimated_owners,
         CASE WHEN no_estimate THEN 0 ELSE price_floor END AS owner_lower,
         CASE WHEN no_estimate THEN 0 ELSE price_floor + 100000 END AS owner_upper,
         CASE WHEN NOT no_estimate THEN price_floor + 50000.0 END::DOUBLE AS owner_midpoint
  FROM games
)"""

JOINED = """
joined AS (
  SELECT l.order_id AS appid, game_name, review_date, release_date, hours, voted_up, helpful,
         early, CAST(date_diff('day', release_date, CAST(review_date AS DATE)) AS BIGINT) AS days
  FROM lines l LEFT JOIN games g ON l.order_id = g.appid
),
staged AS (
  SELECT *,
         CAST(days < 0 AS BIGINT) AS before_release,
         CASE WHEN days IS NULL THEN 'Missing release date'
              WHEN days < 0 THEN 'Before release'
              WHEN days BETWEEN 0 AND 30 THEN 'First 30 days'
              WHEN days BETWEEN 31 AND 180 THEN '1-6 months'
              WHEN days BETWEEN 181 AND 365 THEN '6-12 months'
              WHEN days BETWEEN 366 AND 1095 THEN '1-3 years'
              ELSE '3+ years' END AS lifecycle_group
  FROM joined
)"""

PART_GENRES = """
genres AS (
  SELECT p_partkey AS "appID", p_name AS name,
         unnest(list_append(string_split(p_name, ' '), p_type)) AS genre
  FROM part
)"""

PART_EDGES = """
edges AS (
  SELECT a.genre, b.genre AS genre_2, count(*) AS shared_games
  FROM genres a JOIN genres b ON a."appID" = b."appID" AND a.genre < b.genre
  GROUP BY ALL
)"""

BASKETS = """
baskets AS (
  SELECT l_orderkey AS "appID", p_type AS genre
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def _lines(playtime: str = "l_quantity") -> str:
    return LINES.format(playtime=playtime)


UNTAXED_NULL = "(CASE WHEN l_tax <> 0 THEN l_quantity END)"


LENGTH = ", round(median(review_length), 6) AS median_review_length"
VOTES = ", round(median(votes), 6) AS median_helpful_votes"


def _quartiles(rows: str, source: str, medians: str = "", keep_nulls: bool = True) -> str:
    last = "ELSE 'Very High'" if keep_nulls else "WHEN hours > q3 THEN 'Very High'"
    return f"""{_with(rows)},
cuts AS (
  SELECT quantile_cont(hours, 0.25) AS q1, quantile_cont(hours, 0.5) AS q2,
         quantile_cont(hours, 0.75) AS q3
  FROM {source}
),
labelled AS (
  SELECT *, CASE WHEN hours <= q1 THEN 'Low' WHEN hours <= q2 THEN 'Moderate'
                 WHEN hours <= q3 THEN 'High' {last} END AS playtime_group
  FROM {source}, cuts
)
SELECT playtime_group, count(*) AS review_count,
       round(avg(voted_up), 6) AS approval_rate,
       round(avg(helpful), 6) AS helpful_review_rate,
       round(median(hours), 6) AS median_playtime_hours {medians}
FROM labelled WHERE playtime_group IS NOT NULL
GROUP BY playtime_group"""


def _rollup(rows: str, source: str, keys: str, length: bool) -> str:
    return f"""{_with(rows)}
SELECT {keys}, count(*) AS review_count,
       round(avg(voted_up), 6) AS approval_rate,
       round(avg(helpful), 6) AS helpful_review_rate,
       round(avg(early), 6) AS early_access_share,
       round(median(hours), 6) AS median_playtime_hours {LENGTH if length else ""}
FROM {source} GROUP BY ALL"""


MONTH = "CAST(date_trunc('month', review_date) AS TIMESTAMP) AS review_month"

EVENTS = """
happened AS (
  SELECT user_id AS appid, value / 60.0 AS hours,
         CAST(event_type <> 'error' AS BIGINT) AS voted_up,
         CAST(floor(value / 50) > 0 AS BIGINT) AS helpful,
         CAST(event_type = 'signup' AS BIGINT) AS early,
         date_trunc('second', ts) AS review_date, props, ts
  FROM events
)"""

ORACLES = {
    "contract_scan": """
SELECT doc_id::DOUBLE AS doc_id, lang, source, n_chars::DOUBLE AS n_chars FROM documents""",
    "clean_reviews": """
SELECT l_partkey AS appid, 'Part ' || l_partkey AS game,
       l_extendedprice AS author_playtime_forever, l_quantity AS author_playtime_at_review,
       lower(l_returnflag) AS language,
       l_returnflag || ' ' || l_linestatus || ' ' || l_orderkey AS review,
       CAST(epoch(l_shipdate) AS BIGINT) AS timestamp_created,
       CAST(l_returnflag <> 'R' AS BIGINT) AS voted_up,
       CAST(l_linenumber - 1 AS BIGINT) AS votes_up,
       l_discount AS weighted_vote_score,
       CAST(l_tax > 0.04::DOUBLE AS BIGINT) AS steam_purchase,
       CAST(l_discount = 0 AS BIGINT) AS received_for_free,
       CAST(l_linestatus = 'O' AS BIGINT) AS written_during_early_access,
       l_shipdate AS review_date, l_quantity / 60.0 AS playtime_hours_at_review,
       CAST(l_linenumber > 1 AS BIGINT) AS received_helpful_vote
FROM lineitem""",
    "clean_games": f"""{_with(GAMES, GAME_OWNERS)}
SELECT appid AS "appID", game_name AS name, release_date, estimated_owners,
       o_custkey AS peak_ccu, o_totalprice AS price, urgency <= 2 AS windows,
       urgency = 3 AS mac, urgency >= 4 AS linux, urgency AS metacritic_score,
       o_custkey AS positive, urgency AS negative, o_orderkey AS recommendations,
       urgency AS average_playtime_forever, urgency AS median_playtime_forever,
       CAST(o_custkey AS VARCHAR) AS developers, o_orderstatus AS publishers,
       replace(o_orderpriority, '-', '|') AS categories,
       CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus || '|' || o_orderpriority END
         AS genres,
       owner_lower, owner_upper, owner_midpoint
FROM owners""",
    "text_features": f"""{_with(TEXTS)}
SELECT doc_id, language, review_length, review_word_count, helpful AS received_helpful_vote,
       extreme_text
FROM texts""",
    "text_feature_stats": f"""{_with(TEXTS)}
SELECT median(review_length)::DOUBLE AS median_review_length,
       median(review_word_count)::DOUBLE AS median_word_count,
       CAST(sum(extreme_text) AS BIGINT) AS extreme_text_count,
       round(avg(helpful), 6) AS helpful_review_rate
FROM texts""",
    "longest_texts": f"""{_with(TEXTS)}
SELECT doc_id, appid, language, review_length, review_word_count,
       substr(review, 1, 200) AS review_preview
FROM texts ORDER BY review_length DESC, doc_id LIMIT 10""",
    "extreme_text_counts": f"""{_with(TEXTS)}
SELECT extreme_text, count(*) AS count FROM texts GROUP BY extreme_text""",
    "epoch_timestamps": f"""{_with(EVENTS)}
SELECT appid, epoch_us(ts) // 1000000 AS timestamp_created, review_date, {MONTH}
FROM happened""",
    "playtime_quartile_summary": _quartiles(_lines(), "lines"),
    "playtime_quartile_summary_continuous": _quartiles(_lines("l_extendedprice"), "lines"),
    "playtime_quartile_summary_null_playtime": _quartiles(_lines(UNTAXED_NULL), "lines"),
    "playtime_quartile_summary_unlabelled_nulls": _quartiles(
        _lines(UNTAXED_NULL), "lines", keep_nulls=False
    ),
    "ordered_bucket_summary": _quartiles(TEXTS, "texts", LENGTH),
    "playtime_quartile_summary_votes": _quartiles(
        _lines(), "lines", VOTES + LENGTH, keep_nulls=False
    ),
    "playtime_cut_points": f"""{_with(_lines("l_extendedprice"))}
SELECT round(quantile_cont(hours, 0.25), 6) AS q1, round(quantile_cont(hours, 0.5), 6) AS q2,
       round(quantile_cont(hours, 0.75), 6) AS q3
FROM lines""",
    "playtime_quantiles": f"""{_with(_lines())}
SELECT round(quantile_cont(hours, 0.25), 6) AS q25, round(quantile_cont(hours, 0.5), 6) AS q50,
       round(quantile_cont(hours, 0.75), 6) AS q75, round(quantile_cont(hours, 0.9), 6) AS q90,
       round(quantile_cont(hours, 0.95), 6) AS q95, round(quantile_cont(hours, 0.99), 6) AS q99,
       round(min(hours), 6) AS min, round(max(hours), 6) AS max
FROM lines""",
    "filter_language_quantiles": f"""{_with(TEXTS)}
SELECT round(quantile_cont(review_length::DOUBLE, 0.5), 6) AS q50,
       round(quantile_cont(review_length::DOUBLE, 0.75), 6) AS q75,
       round(quantile_cont(review_length::DOUBLE, 0.9), 6) AS q90,
       round(quantile_cont(review_length::DOUBLE, 0.95), 6) AS q95,
       round(quantile_cont(review_length::DOUBLE, 0.99), 6) AS q99,
       round(quantile_cont(review_length::DOUBLE, 0.999), 6) AS q999
FROM texts WHERE language = 'en'""",
    "nearest_quantile": """
WITH sorted AS (SELECT list_sort(list(l_extendedprice)) AS v FROM lineitem)
SELECT v[CAST(floor((len(v) - 1) * 0.75 + 0.5) AS BIGINT) + 1] AS q75,
       v[CAST(floor((len(v) - 1) * 0.9 + 0.5) AS BIGINT) + 1] AS q90
FROM sorted""",
    "owner_bounds": """
SELECT CAST(p_partkey AS VARCHAR) AS "appID",
       CASE WHEN p_size = 1 THEN '0 - 0' ELSE (p_size * 1000) || ' - ' || (p_size * 2000) END
         AS estimated_owners,
       CAST(CASE WHEN p_size = 1 THEN 0 ELSE p_size * 1000 END AS BIGINT) AS owner_lower,
       CAST(CASE WHEN p_size = 1 THEN 0 ELSE p_size * 2000 END AS BIGINT) AS owner_upper,
       CASE WHEN p_size <> 1 THEN p_size * 1500.0 END::DOUBLE AS owner_midpoint
FROM part""",
    "owner_bucket_counts": """
SELECT CASE WHEN p_size = 1 THEN '0 - 0' ELSE (p_size * 1000) || ' - ' || (p_size * 2000) END
         AS estimated_owners, count(*) AS game_count
FROM part GROUP BY 1""",
    "missing_owner_estimates": """
SELECT count(*) AS missing_owner_estimates FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'""",
    "list_population": """
SELECT count(*) AS total_games, sum(len([]))::BIGINT AS games_with_tags,
       count(*) FILTER (o_orderstatus <> 'P') AS games_with_genres,
       count(*) FILTER (len(string_split(o_orderpriority, '-')) > 0) AS games_with_categories
FROM orders""",
    "explode_genres": f"""{_with(PART_GENRES)}
SELECT "appID", name, genre FROM genres""",
    "explode_categories": """
SELECT CAST(p_partkey AS VARCHAR) AS "appID", p_name AS name, p_brand AS category
FROM part WHERE p_size > 25""",
    "genre_table_size": f"""{_with(PART_GENRES)}
SELECT count(*) AS genre_rows, count(DISTINCT genre) AS unique_genres FROM genres""",
    "genre_counts": f"""{_with(PART_GENRES)}
SELECT genre, count(*) AS game_count FROM genres GROUP BY genre""",
    "top_genres": f"""{_with(PART_GENRES)}
SELECT genre, count(*) AS game_count FROM genres GROUP BY genre
ORDER BY game_count DESC, genre LIMIT 15""",
    "review_game_left_join": f"""{_with(_lines(), GAMES, GAME_OWNERS)}
SELECT l.order_id AS appid, 'Part ' || l.appid AS game, review_date, voted_up,
       hours AS playtime_hours_at_review, game_name, release_date, estimated_owners,
       owner_lower, owner_upper, owner_midpoint, o_custkey AS peak_ccu, o_totalprice AS price,
       urgency AS metacritic_score
FROM lines l LEFT JOIN owners g ON l.order_id = g.appid""",
    "lifecycle_features": f"""{_with(_lines(), GAMES, JOINED)}
SELECT appid, review_date, release_date, days AS days_since_release, before_release,
       lifecycle_group
FROM staged""",
    "lifecycle_summary": f"""{_with(_lines(), GAMES, JOINED)}
SELECT lifecycle_group, count(*) AS review_count, round(avg(voted_up), 6) AS approval_rate,
       round(avg(helpful), 6) AS helpful_review_rate,
       round(avg(early), 6) AS early_access_share,
       round(median(hours), 6) AS median_playtime_hours
FROM staged GROUP BY lifecycle_group""",
    "lifecycle_counts": f"""{_with(_lines(), GAMES, JOINED)}
SELECT lifecycle_group, count(*) AS review_count FROM staged GROUP BY lifecycle_group""",
    "early_access_crosstab": f"""{_with(_lines(), GAMES, JOINED)}
SELECT before_release, early AS written_during_early_access, count(*) AS review_count
FROM staged GROUP BY ALL""",
    "days_since_release_stats": f"""{_with(_lines(), GAMES, JOINED)}
SELECT min(days) AS min_days, median(days)::DOUBLE AS median_days, max(days) AS max_days,
       count(*) FILTER (days < 0) AS reviews_before_release
FROM staged""",
    "pre_release_games": f"""{_with(_lines(), GAMES, JOINED)}
SELECT appid, game_name, release_date, count(*) AS pre_release_reviews,
       CAST(sum(early) AS BIGINT) AS early_access_reviews,
       min(days) AS earliest_days_before_release
FROM staged WHERE days < 0 GROUP BY appid, game_name, release_date""",
    "join_audit": """
SELECT count(*) AS total_rows, count(*) - count(l.doc_id) AS unmatched_rows,
       round(avg((l.doc_id IS NOT NULL)::INT), 9) AS coverage
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "join_coverage_rate": """
SELECT count(*) AS total_rows, count(*) - count(l.doc_id) AS unmatched_rows,
       round(avg((l.doc_id IS NOT NULL)::INT), 9) AS coverage
FROM pages p LEFT JOIN labels l ON p.page_id = l.doc_id""",
    "repeated_keys": """
SELECT conv_id, count(*) AS n_rows FROM conversations
WHERE conv_id IS NOT NULL GROUP BY conv_id HAVING count(*) > 1""",
    "flag_unknown_as_zero": """
SELECT d.doc_id, (quality = 1)::BIGINT AS good, coalesce((quality = 1)::BIGINT, 0) AS good_or_zero
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "unmatched_rows": """
SELECT doc_id, lang, source FROM documents
WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)""",
    "game_review_summary": _rollup(_lines(), "lines", "appid", True),
    "source_review_summary": _rollup(TEXTS, "texts", "appid", True),
    "game_monthly_reviews": _rollup(_lines(), "lines", f"appid, {MONTH}", False),
    "user_monthly_events": _rollup(EVENTS, "happened", f"appid, {MONTH}", False),
    "game_month_rows": """
SELECT count(*) AS game_month_rows
FROM (SELECT DISTINCT l_partkey, date_trunc('month', l_shipdate) FROM lineitem)""",
    "genre_edges": f"""{_with(PART_GENRES, PART_EDGES)}
SELECT genre, genre_2, shared_games FROM edges""",
    "genre_edges_from_long": f"""{_with(PART_GENRES, PART_EDGES)}
SELECT genre, genre_2, shared_games FROM edges""",
    "cooccurrence_pairs": f"""{_with(BASKETS)}
SELECT a.genre, b.genre AS genre_2, count(*) AS shared_games
FROM baskets a JOIN baskets b ON a."appID" = b."appID" AND a.genre < b.genre
GROUP BY ALL""",
    "cooccurrence_pairs_dedupe": f"""{_with(BASKETS)}, once AS (SELECT DISTINCT * FROM baskets)
SELECT a.genre, b.genre AS genre_2, count(*) AS shared_games
FROM once a JOIN once b ON a."appID" = b."appID" AND a.genre < b.genre
GROUP BY ALL""",
    "edge_size": f"""{_with(PART_GENRES, PART_EDGES)}
SELECT count(*) AS edge_count, max(shared_games) AS max_shared_games FROM edges""",
    "edge_threshold_sweep": f"""{_with(PART_GENRES, PART_EDGES)}
SELECT count(*) AS all_edges,
       count(*) FILTER (shared_games >= 5) AS edges_5_plus,
       count(*) FILTER (shared_games >= 10) AS edges_10_plus,
       count(*) FILTER (shared_games >= 25) AS edges_25_plus,
       count(*) FILTER (shared_games >= 50) AS edges_50_plus,
       count(*) FILTER (shared_games >= 100) AS edges_100_plus
FROM edges""",
    "edge_weight_stats": f"""{_with(PART_GENRES, PART_EDGES)},
sorted AS (SELECT list_sort(list(shared_games)) AS v FROM edges)
SELECT v[1] AS min, (SELECT median(shared_games)::DOUBLE FROM edges) AS median,
       v[CAST(floor((len(v) - 1) * 0.75 + 0.5) AS BIGINT) + 1]::DOUBLE AS q75,
       v[CAST(floor((len(v) - 1) * 0.9 + 0.5) AS BIGINT) + 1]::DOUBLE AS q90,
       v[len(v)] AS max
FROM sorted""",
    "strong_edges": f"""{_with(PART_GENRES, PART_EDGES)}
SELECT genre, genre_2, shared_games FROM edges WHERE shared_games >= 40""",
    "network_node_count": f"""{_with(PART_GENRES, PART_EDGES)}
SELECT count(*) AS genres_in_network
FROM (SELECT genre FROM edges WHERE shared_games >= 40
      UNION SELECT genre_2 FROM edges WHERE shared_games >= 40)""",
    "network_nodes": f"""{_with(PART_GENRES, PART_EDGES)}
SELECT genre AS id, genre AS label, genre || ': ' || format('{{:,}}', count(*)) || ' games' AS title,
       count(*) AS value
FROM genres
WHERE genre IN (SELECT genre FROM edges WHERE shared_games >= 40
                UNION SELECT genre_2 FROM edges WHERE shared_games >= 40)
GROUP BY genre""",
    "network_edges": f"""{_with(PART_GENRES, PART_EDGES)}
SELECT genre AS "from", genre_2 AS "to",
       format('{{:,}}', shared_games) || ' shared games' AS title, shared_games AS value
FROM edges WHERE shared_games >= 40""",
    "table_profile": """
WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id))
SELECT unnest(CAST([1, 2, 3, 4, 5, 6, 7] AS BIGINT[])) AS position,
       unnest(['doc_id', 'text', 'lang', 'source', 'n_chars', 'quality', 'toxic']) AS column_name,
       unnest(['bigint', 'string', 'string', 'string', 'bigint', 'int', 'int']) AS data_type,
       unnest(list_value(count(*), count(*), count(*), count(*), count(*), count(*), count(*)))
         AS row_count,
       unnest(list_value(count(*) - count(doc_id), count(*) - count(text),
                         count(*) - count(lang), count(*) - count(source),
                         count(*) - count(n_chars), count(*) - count(quality),
                         count(*) - count(toxic))) AS null_count
FROM d""",
    "null_profile": """
WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id))
SELECT unnest(['appid', 'author_playtime_at_review', 'language', 'review', 'timestamp_created',
               'voted_up', 'votes_up', 'weighted_vote_score', 'written_during_early_access'])
         AS column_name,
       unnest(list_value(count(*) - count(source), count(*) - count(n_chars),
                         count(*) - count(lang), count(*) - count(text),
                         count(*) - count(doc_id), count(*) - count(quality),
                         count(*) - count(quality + toxic), count(*),
                         count(*) - count(toxic))) AS null_count
FROM d""",
    "binary_domain_check": """
WITH d AS (
  SELECT quality, toxic, quality + toxic AS votes FROM documents LEFT JOIN labels USING (doc_id)
)
SELECT unnest(['voted_up', 'votes_up', 'received_for_free']) AS column_name,
       unnest(list_value(count(*) FILTER (quality = 0), count(*) FILTER (votes = 0),
                         count(*) FILTER (toxic = 0))) AS zeros,
       unnest(list_value(count(*) FILTER (quality = 1), count(*) FILTER (votes = 1),
                         count(*) FILTER (toxic = 1))) AS ones,
       unnest(list_value(count(*) FILTER (quality IS NULL), count(*) FILTER (votes IS NULL),
                         count(*) FILTER (toxic IS NULL))) AS nulls,
       unnest(list_value(count(*) FILTER (quality NOT IN (0, 1)),
                         count(*) FILTER (votes NOT IN (0, 1)),
                         count(*) FILTER (toxic NOT IN (0, 1)))) AS other_values
FROM d""",
    "value_counts": """
SELECT CAST(quality AS DOUBLE) AS voted_up, count(*) AS count
FROM documents JOIN labels USING (doc_id) GROUP BY quality""",
    "language_mix": """
SELECT lang, count(*) AS count FROM documents GROUP BY lang
ORDER BY count DESC, lang LIMIT 15""",
    "describe_numeric": f"""{_with(TEXTS)},
stacked AS (
  SELECT 'review_length' AS column_name, review_length::DOUBLE AS v FROM texts
  UNION ALL SELECT 'review_word_count', review_word_count::DOUBLE FROM texts
)
SELECT column_name, count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
       min(v) AS min, round(quantile_cont(v, 0.25), 6) AS q25,
       round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75,
       max(v) AS max
FROM stacked GROUP BY column_name""",
    "review_key_profile": """
SELECT count(DISTINCT l_partkey) FILTER (l_returnflag <> 'R') AS unique_keys,
       CAST(min(l_partkey) FILTER (l_returnflag <> 'R') AS DOUBLE) AS min_key,
       CAST(max(l_partkey) FILTER (l_returnflag <> 'R') AS DOUBLE) AS max_key,
       count(*) FILTER (l_returnflag = 'R') AS parse_failures
FROM lineitem""",
    "game_key_profile": """
SELECT count(DISTINCT o_orderkey) FILTER (o_orderstatus <> 'P') AS unique_keys,
       CAST(min(o_orderkey) FILTER (o_orderstatus <> 'P') AS DOUBLE) AS min_key,
       CAST(max(o_orderkey) FILTER (o_orderstatus <> 'P') AS DOUBLE) AS max_key,
       count(*) FILTER (o_orderstatus = 'P') AS parse_failures
FROM orders""",
}
