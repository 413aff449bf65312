"""The registered queries: operators over whole stand-in tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.functions.columns import epoch_to_timestamp, flag, month_start
from reviewloom.operators import buckets, clean, features, network, quality, summaries
from reviewloom.plans import standins
from reviewloom.sources.contracts import ANY
from reviewloom.sources.files import scan_contract

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Edge weights at which the part network is cut; other tables have other weights.
PART_THRESHOLDS = (5, 10, 25, 50, 100)
PART_STRONG = 40
# The quantiles that are reported.
TEXT_QUANTILES = {"q50": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95, "q99": 0.99, "q999": 0.999}
PLAYTIME_QUANTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95, "q99": 0.99}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles, rounded, as their last digits depend on the order of summation."""
    kinds = (T.DoubleType, T.DecimalType)
    floats = [f.name for f in df.schema if isinstance(f.dataType, kinds)]
    return df.withColumns({name: F.round(F.col(name).cast("double"), digits) for name in floats})


def _line_reviews(spark, sf_dir, **kwargs) -> DataFrame:
    return clean.clean_reviews(standins.lineitem_reviews(spark, sf_dir, **kwargs))


def _text_reviews(spark, sf_dir) -> DataFrame:
    raw = standins.document_reviews(spark, sf_dir)
    return features.text_features(clean.clean_reviews(raw, keep=["doc_id"]))


def _lifecycle(spark, sf_dir, columns=("appID", "release_date")) -> DataFrame:
    games = clean.clean_games(standins.order_games(spark, sf_dir)).select(*columns)
    return features.add_lifecycle(_line_reviews(spark, sf_dir, appid="l_orderkey"), games)


def _part_genres(spark, sf_dir) -> DataFrame:
    games = standins.part_games(spark, sf_dir).withColumn("appID", F.col("appID").cast("bigint"))
    return network.explode_list(games)


def _part_edges(spark, sf_dir) -> DataFrame:
    return network.list_edges(standins.part_games(spark, sf_dir))


# Cleaning and features


@query
def clean_reviews(spark, sf_dir):
    return _line_reviews(spark, sf_dir)


@query
def clean_games(spark, sf_dir):
    games = clean.clean_games(standins.order_games(spark, sf_dir))
    lists = ["developers", "publishers", "categories", "genres"]
    return games.withColumns({name: F.array_join(name, "|") for name in lists})


@query
def text_features(spark, sf_dir):
    return _text_reviews(spark, sf_dir).select(
        "doc_id",
        "language",
        "review_length",
        "review_word_count",
        "received_helpful_vote",
        "extreme_text",
    )


@query
def text_feature_stats(spark, sf_dir):
    return _round(features.text_feature_stats(_text_reviews(spark, sf_dir)))


@query
def longest_texts(spark, sf_dir):
    reviews = clean.clean_reviews(standins.document_reviews(spark, sf_dir), keep=["doc_id"])
    texts = reviews.select("doc_id", "appid", "language", "review")
    return features.longest_texts(texts, tie_break="doc_id")


@query
def extreme_text_counts(spark, sf_dir):
    return quality.value_counts(_text_reviews(spark, sf_dir), "extreme_text")


@query
def epoch_timestamps(spark, sf_dir):
    seconds = standins.event_reviews(spark, sf_dir).select(
        F.col("timestamp_created").cast("bigint").alias("timestamp_created"), "appid", "review"
    )
    stamped = seconds.withColumn("review_date", epoch_to_timestamp(F.col("timestamp_created")))
    return stamped.select(
        F.col("appid").cast("bigint").alias("appid"),
        "timestamp_created",
        "review_date",
        month_start(F.col("review_date")).alias("review_month"),
    )


# A scan whose columns are cast to a contract, whatever types the files hold.
DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.DoubleType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", ANY),
        T.StructField("n_chars", T.DecimalType(20, 2)),
    ]
)


@query
def contract_scan(spark, sf_dir):
    """Documents read file by file under a contract of other numeric types."""
    scanned = scan_contract(spark, [f"{sf_dir}/documents.parquet"], DOCUMENTS)
    return scanned.withColumn("n_chars", F.col("n_chars").cast("double"))


# Playtime quartiles


@query
def playtime_quartile_summary(spark, sf_dir):
    return _round(summaries.playtime_summary(_line_reviews(spark, sf_dir)))


@query
def playtime_quartile_summary_continuous(spark, sf_dir):
    reviews = _line_reviews(spark, sf_dir, playtime="l_extendedprice")
    return _round(summaries.playtime_summary(reviews))


def _untaxed_as_null() -> F.Column:
    return F.when(F.col("l_tax") != 0, F.col("l_quantity"))


@query
def playtime_quartile_summary_null_playtime(spark, sf_dir):
    reviews = _line_reviews(spark, sf_dir, playtime=_untaxed_as_null())
    return _round(summaries.playtime_summary(reviews))


@query
def playtime_quartile_summary_unlabelled_nulls(spark, sf_dir):
    reviews = _line_reviews(spark, sf_dir, playtime=_untaxed_as_null())
    return _round(summaries.playtime_summary(reviews, null_bucket=False))


@query
def ordered_bucket_summary(spark, sf_dir):
    return _round(
        summaries.playtime_summary(
            _text_reviews(spark, sf_dir), medians={"median_review_length": "review_length"}
        )
    )


@query
def playtime_quartile_summary_votes(spark, sf_dir):
    medians = {"median_helpful_votes": "votes_up", "median_review_length": "review_length"}
    reviews = features.text_features(_line_reviews(spark, sf_dir))
    return _round(summaries.playtime_summary(reviews, null_bucket=False, medians=medians))


@query
def playtime_cut_points(spark, sf_dir):
    reviews = _line_reviews(spark, sf_dir, playtime="l_extendedprice")
    return _round(
        buckets.quantile_report(
            reviews, "playtime_hours_at_review", {"q1": 0.25, "q2": 0.5, "q3": 0.75}
        )
    )


@query
def playtime_quantiles(spark, sf_dir):
    return _round(
        buckets.quantile_report(
            _line_reviews(spark, sf_dir),
            "playtime_hours_at_review",
            PLAYTIME_QUANTILES,
            extremes=True,
        )
    )


@query
def filter_language_quantiles(spark, sf_dir):
    english = _text_reviews(spark, sf_dir).where(F.col("language") == "en")
    return _round(buckets.quantile_report(english, "review_length", TEXT_QUANTILES))


@query
def nearest_quantile(spark, sf_dir):
    return buckets.quantile_report(
        standins.table(spark, sf_dir, "lineitem"),
        "l_extendedprice",
        {"q75": 0.75, "q90": 0.9},
        interpolation="nearest",
    )


# Catalogue


@query
def owner_bounds(spark, sf_dir):
    games = clean.owner_bounds(standins.part_games(spark, sf_dir))
    return games.select(
        "appID", "estimated_owners", "owner_lower", "owner_upper", "owner_midpoint"
    )


@query
def owner_bucket_counts(spark, sf_dir):
    return clean.owner_bucket_counts(standins.part_games(spark, sf_dir))


@query
def missing_owner_estimates(spark, sf_dir):
    return clean.missing_owner_estimates(clean.clean_games(standins.order_games(spark, sf_dir)))


@query
def list_population(spark, sf_dir):
    # Pending orders have no genres, no order has tags.
    return quality.list_population(
        standins.order_games(spark, sf_dir), ["tags", "genres", "categories"]
    )


@query
def explode_genres(spark, sf_dir):
    return _part_genres(spark, sf_dir)


@query
def explode_categories(spark, sf_dir):
    return network.explode_list(
        standins.part_games(spark, sf_dir), column="categories", item="category"
    )


@query
def genre_table_size(spark, sf_dir):
    return network.item_table_size(_part_genres(spark, sf_dir))


@query
def genre_counts(spark, sf_dir):
    return network.item_counts(_part_genres(spark, sf_dir))


@query
def top_genres(spark, sf_dir):
    return network.item_counts(_part_genres(spark, sf_dir), k=15)


# Join, lifecycle, early access


@query
def review_game_left_join(spark, sf_dir):
    games = clean.clean_games(standins.order_games(spark, sf_dir)).select(
        "appID",
        "name",
        "release_date",
        "estimated_owners",
        "owner_lower",
        "owner_upper",
        "owner_midpoint",
        "peak_ccu",
        "price",
        "metacritic_score",
    )
    reviews = _line_reviews(spark, sf_dir, appid="l_orderkey").select(
        "appid", "game", "review_date", "voted_up", "playtime_hours_at_review"
    )
    return features.join_games(reviews, games)


@query
def lifecycle_features(spark, sf_dir):
    return _lifecycle(spark, sf_dir).select(
        "appid",
        "review_date",
        "release_date",
        "days_since_release",
        "before_release",
        "lifecycle_group",
    )


@query
def lifecycle_summary(spark, sf_dir):
    return _round(summaries.lifecycle_summary(_lifecycle(spark, sf_dir)))


@query
def lifecycle_counts(spark, sf_dir):
    return summaries.lifecycle_counts(_lifecycle(spark, sf_dir))


@query
def early_access_crosstab(spark, sf_dir):
    return summaries.flag_crosstab(
        _lifecycle(spark, sf_dir), "before_release", "written_during_early_access"
    )


@query
def days_since_release_stats(spark, sf_dir):
    return summaries.lag_stats(_lifecycle(spark, sf_dir))


@query
def pre_release_games(spark, sf_dir):
    return summaries.pre_release_games(
        _lifecycle(spark, sf_dir, ["appID", "name", "release_date"])
    )


@query
def join_audit(spark, sf_dir):
    documents = standins.table(spark, sf_dir, "documents").select("doc_id")
    return _round(
        quality.join_audit(documents, standins.table(spark, sf_dir, "labels"), "doc_id"), 9
    )


@query
def join_coverage_rate(spark, sf_dir):
    pages = standins.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"))
    return _round(quality.join_audit(pages, standins.table(spark, sf_dir, "labels"), "doc_id"), 9)


@query
def repeated_keys(spark, sf_dir):
    return quality.repeated_keys(standins.table(spark, sf_dir, "conversations"), "conv_id")


@query
def flag_unknown_as_zero(spark, sf_dir):
    documents = standins.table(spark, sf_dir, "documents").select("doc_id")
    labels = standins.table(spark, sf_dir, "labels").select("doc_id", "quality")
    good = F.col("quality") == 1
    return documents.join(labels, "doc_id", "left").select(
        "doc_id", flag(good).alias("good"), flag(good, unknown=0).alias("good_or_zero")
    )


@query
def unmatched_rows(spark, sf_dir):
    documents = standins.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return quality.unmatched_rows(documents, standins.table(spark, sf_dir, "labels"), "doc_id")


# Rollups


def _with_length(reviews: DataFrame) -> DataFrame:
    return features.text_features(reviews)


@query
def game_review_summary(spark, sf_dir):
    return _round(summaries.game_review_summary(_with_length(_line_reviews(spark, sf_dir))))


@query
def source_review_summary(spark, sf_dir):
    return _round(summaries.game_review_summary(_text_reviews(spark, sf_dir)))


@query
def game_monthly_reviews(spark, sf_dir):
    return _round(summaries.game_monthly_reviews(_line_reviews(spark, sf_dir)))


@query
def user_monthly_events(spark, sf_dir):
    return _round(
        summaries.game_monthly_reviews(clean.clean_reviews(standins.event_reviews(spark, sf_dir)))
    )


@query
def game_month_rows(spark, sf_dir):
    reviews = _line_reviews(spark, sf_dir)
    months = reviews.select("appid", month_start(F.col("review_date")).alias("review_month"))
    return summaries.row_count(months.distinct(), "game_month_rows")


# Co-occurrence network


@query
def genre_edges(spark, sf_dir):
    return _part_edges(spark, sf_dir)


@query
def genre_edges_from_long(spark, sf_dir):
    return network.cooccurrence_edges(_part_genres(spark, sf_dir))


@query
def cooccurrence_pairs(spark, sf_dir):
    return network.cooccurrence_edges(standins.order_baskets(spark, sf_dir))


@query
def cooccurrence_pairs_dedupe(spark, sf_dir):
    return network.cooccurrence_edges(standins.order_baskets(spark, sf_dir), dedupe=True)


@query
def edge_size(spark, sf_dir):
    return network.edge_size(_part_edges(spark, sf_dir))


@query
def edge_threshold_sweep(spark, sf_dir):
    return network.threshold_sweep(_part_edges(spark, sf_dir), PART_THRESHOLDS)


@query
def edge_weight_stats(spark, sf_dir):
    return network.edge_stats(_part_edges(spark, sf_dir))


@query
def strong_edges(spark, sf_dir):
    return network.strong_edges(_part_edges(spark, sf_dir), PART_STRONG)


@query
def network_node_count(spark, sf_dir):
    return network.node_count(network.strong_edges(_part_edges(spark, sf_dir), PART_STRONG))


@query
def network_nodes(spark, sf_dir):
    edges = network.strong_edges(_part_edges(spark, sf_dir), PART_STRONG)
    return network.network_nodes(_part_genres(spark, sf_dir), edges)


@query
def network_edges(spark, sf_dir):
    return network.network_edges(
        network.strong_edges(_part_edges(spark, sf_dir), PART_STRONG)
    )


# Profiles


@query
def table_profile(spark, sf_dir):
    documents = standins.table(spark, sf_dir, "documents")
    labels = standins.table(spark, sf_dir, "labels")
    return quality.table_profile(documents.join(labels, "doc_id", "left"))


@query
def null_profile(spark, sf_dir):
    return quality.null_profile(
        standins.document_reviews(spark, sf_dir),
        [
            "appid",
            "author_playtime_at_review",
            "language",
            "review",
            "timestamp_created",
            "voted_up",
            "votes_up",
            "weighted_vote_score",
            "written_during_early_access",
        ],
    )


@query
def binary_domain_check(spark, sf_dir):
    return quality.binary_domain_check(
        standins.document_reviews(spark, sf_dir), ["voted_up", "votes_up", "received_for_free"]
    )


@query
def value_counts(spark, sf_dir):
    return quality.value_counts(standins.document_reviews(spark, sf_dir), "voted_up")


@query
def language_mix(spark, sf_dir):
    return quality.value_counts(standins.table(spark, sf_dir, "documents"), "lang", k=15)


@query
def describe_numeric(spark, sf_dir):
    return _round(
        quality.describe_numeric(
            _text_reviews(spark, sf_dir), ["review_length", "review_word_count"]
        )
    )


@query
def review_key_profile(spark, sf_dir):
    # The keys of returned items have a letter in front and cannot be read as numbers.
    lines = standins.table(spark, sf_dir, "lineitem")
    returned = F.when(F.col("l_returnflag") == "R", "R").otherwise("")
    return quality.key_profile(lines.select(F.concat(returned, "l_partkey").alias("appid")), "appid")


@query
def game_key_profile(spark, sf_dir):
    # The priority has no number in it, the key of every other order has.
    games = standins.order_games(spark, sf_dir).select(
        F.when(F.size("genres") > 0, F.col("appID")).otherwise(F.col("release_date")).alias("appID")
    )
    return quality.key_profile(games, "appID")
