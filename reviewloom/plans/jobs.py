"""Batch jobs: raw Parquet in, result tables out.

Run one with ``python -m reviewloom``, or on a cluster with ``spark-submit`` and
the package as ``--py-files``; see ``reviewloom/__main__.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewloom.operators import clean, features, network, summaries
from reviewloom.sources.contracts import GAMES, REVIEWS
from reviewloom.sources.files import scan_parquet, write_csv, write_parquet


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned reviews; the footer of every file is checked first."""
    raw = scan_parquet(spark, path, contract=REVIEWS, check_files=True)
    return clean.clean_reviews(raw)


def read_games(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned catalogue."""
    return clean.clean_games(scan_parquet(spark, path, contract=GAMES, check_files=True))


def playtime_job(spark: SparkSession, reviews: str, out: str) -> None:
    """Playtime quartile summary."""
    summary = summaries.playtime_summary(read_reviews(spark, reviews))
    _write_summary(summary, f"{out}/q1_playtime_summary")


def lifecycle_job(spark: SparkSession, reviews: str, games: str, out: str) -> None:
    """Lifecycle summary and early-access cross-tab."""
    releases = read_games(spark, games).select("appID", "release_date")
    joined = features.add_lifecycle(read_reviews(spark, reviews), releases)
    summary, crosstab = summaries.lifecycle_report(joined)
    _write_summary(summary, f"{out}/q2_lifecycle_summary")
    _write_summary(crosstab, f"{out}/q2_early_access_check")


def rollup_job(spark: SparkSession, reviews: str, out: str) -> None:
    """One row per game, and one row per game and month."""
    typed = features.text_features(read_reviews(spark, reviews))
    games, months = summaries.rollup_report(typed)
    write_parquet(games, f"{out}/game_review_summary")
    write_parquet(months, f"{out}/game_monthly_reviews")


def catalogue_job(spark: SparkSession, games: str, out: str) -> None:
    """Cleaned catalogue and its long form by genre."""
    cleaned = read_games(spark, games)
    write_parquet(cleaned, f"{out}/games_clean")
    write_parquet(network.explode_list(cleaned), f"{out}/game_genres")


def network_job(
    spark: SparkSession, games: str, out: str, threshold: int = network.STRONG_EDGE
) -> None:
    """Strong edges of the genre network, and its node and edge tables."""
    cleaned = read_games(spark, games)
    edges = network.list_edges(cleaned)
    write_parquet(network.strong_edges(edges, threshold), f"{out}/genre_edges", single_file=True)
    strong = scan_parquet(spark, f"{out}/genre_edges")
    nodes = network.network_nodes(network.explode_list(cleaned), strong)
    write_parquet(nodes, f"{out}/network_nodes", single_file=True)
    write_parquet(network.network_edges(strong), f"{out}/network_edges", single_file=True)


def _write_summary(summary: DataFrame, path: str) -> None:
    """A few rows, as Parquet and as CSV made from it."""
    write_parquet(summary, path, single_file=True)
    write_csv(scan_parquet(summary.sparkSession, path), f"{path}_csv")


JOBS = {
    "playtime": (playtime_job, ["reviews", "out"]),
    "lifecycle": (lifecycle_job, ["reviews", "games", "out"]),
    "rollup": (rollup_job, ["reviews", "out"]),
    "catalogue": (catalogue_job, ["games", "out"]),
    "network": (network_job, ["games", "out"]),
}
