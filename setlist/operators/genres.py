"""Repair of genres that exist more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setlist.catalog import Catalog


def genre_canonical(c: Catalog) -> DataFrame:
    """The surviving genre rows: of each name the one with the lowest id."""
    return c.genre.groupBy("name").agg(F.min("genre_id").alias("genre_id")).select("genre_id", "name")


def genre_links_repointed(c: Catalog) -> DataFrame:
    """Artist links with every duplicate genre replaced by its survivor, each link once."""
    survivors = genre_canonical(c).select(F.col("genre_id").alias("survivor"), F.col("name").alias("_name"))
    mapping = c.genre.join(survivors, F.col("name").eqNullSafe(F.col("_name"))).select("genre_id", "survivor")
    return c.artist_genre.join(mapping, "genre_id").select("artist_id", F.col("survivor").alias("genre_id")).distinct()


def repair_genres(c: Catalog) -> Catalog:
    return c.with_tables(genre=genre_canonical(c), artist_genre=genre_links_repointed(c))


def genre_repair_report(c: Catalog) -> DataFrame:
    """Number of genre names, and of rows before and after the repair."""
    sizes = c.genre.groupBy("name").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("unique_names"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"),
        F.count("*").alias("rows_after"),
    )


def genre_names(c: Catalog) -> DataFrame:
    return c.genre.select("name").distinct().orderBy("name")
