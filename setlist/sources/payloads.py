"""Landed payloads of the music API: JSON text in, typed rows out.

A payload row has `raw` (the JSON text) and `load_seq` (the order in which payloads apply).
Page rows also have `page_no`, track pages the `playlist_key` they belong to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setlist.functions.labels import album_url
from setlist.operators.groups import position_block, running_total
from setlist.operators.merge import present
from setlist.schema import (
    ALBUM_PAYLOAD, ARTIST_PAYLOAD, FEATURE_COLUMNS, FEATURES_PAYLOAD, PLAYLIST_PAGE,
    PLAYLIST_PAYLOAD, TRACK_PAGE, TRACK_PAYLOAD,
)

PAGES_PER_BLOCK = 1024
# Enough of a page to count its items; the parser skips all else.
BARE_PAGE = "items array<struct<href:string>>"


LANDED = "raw string, load_seq bigint, playlist_key string, page_no bigint, owner string"


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Landed payload rows: JSON lines whose `raw` is the payload's text."""
    return spark.read.schema(LANDED).json(path)


def _parsed(payloads: DataFrame, schema: T.StructType) -> DataFrame:
    return payloads.select("*", F.from_json("raw", schema).alias("p"), F.json_object_keys("raw").alias("_keys"))


def _has(name: str) -> Column:
    return F.coalesce(F.array_contains("_keys", name), F.lit(False)).alias(present(name))


def playlist_rows(payloads: DataFrame) -> DataFrame:
    return _parsed(payloads, PLAYLIST_PAYLOAD).select(
        F.col("p.id").alias("spotify_id"), "load_seq", "p.name", "p.description",
        F.col("p.external_urls.spotify").alias("spotify_url"), "p.images", _has("images"),
    )


def artist_rows(payloads: DataFrame) -> DataFrame:
    return _parsed(payloads, ARTIST_PAYLOAD).select(
        F.col("p.id").alias("spotify_id"), "load_seq", "p.name",
        F.col("p.external_urls.spotify").alias("spotify_url"),
        "p.popularity", _has("popularity"), F.col("p.followers.total").alias("followers"), _has("followers"),
        "p.images", _has("images"), "p.genres",
    )


def track_rows(payloads: DataFrame) -> DataFrame:
    return _parsed(payloads, TRACK_PAYLOAD).select("load_seq", "p.*").transform(track_columns)


def track_columns(tracks: DataFrame) -> DataFrame:
    """Payload fields of a track under the catalogue's column names; album and artists stay nested.

    `load_order` is where the payload stands in its load: on a page by playlist and position.
    """
    place = ("playlist_key", "position") if "position" in tracks.columns else (F.lit(""), F.lit(0).cast("bigint"))
    order = F.struct("load_seq", *[F.col(c).alias(n) if isinstance(c, str) else c.alias(n) for c, n in zip(place, ("source", "position"))])
    return tracks.select(
        F.col("id").alias("spotify_id"), "load_seq", order.alias("load_order"), "name", "duration_ms", "explicit", "popularity",
        F.col("external_ids.isrc").alias("isrc_id"), F.col("external_urls.spotify").alias("spotify_url"),
        "preview_url", "artists", "album",
    )


def album_rows(payloads: DataFrame) -> DataFrame:
    return _parsed(payloads, ALBUM_PAYLOAD).select(
        F.col("p.id").alias("spotify_id"), "load_seq", "p.name", "p.images", album_url(F.col("p.id")).alias("spotify_url"),
        "p.label", _has("label"), "p.popularity", _has("popularity"), "p.artists",
    )


def features_rows(payloads: DataFrame) -> DataFrame:
    """Audio features; only the mapped fields survive, the payload's other keys are dropped."""
    return _parsed(payloads, FEATURES_PAYLOAD).select(
        F.col("p.id").alias("spotify_id"), "load_seq", "p.analysis_url",
        *[F.col(f"p.{name}").alias(name) for name in FEATURE_COLUMNS],
    )


def track_page_items(pages: DataFrame) -> DataFrame:
    """Played tracks of landed track pages, with their position in the whole playlist.

    A page says how many items lie on it, so positions need a running total over pages (one
    row per page), not over tracks. Pages are shuffled as texts, which are smaller, and parsed whole where their items come apart.
    """
    bare = F.from_json("raw", BARE_PAGE)["items"]
    counted = pages.select("playlist_key", "load_seq", "page_no", "raw", F.size(bare).alias("n_items"))
    placed = running_total(
        counted, "before", F.col("n_items"), ["playlist_key", "load_seq"], [F.col("page_no")],
        [position_block("page_no", PAGES_PER_BLOCK)], totals_from=counted.drop("raw"), later=F.col("page_no") >= PAGES_PER_BLOCK,
    )
    items = F.from_json("raw", TRACK_PAGE)["items"]
    return placed.select(
        "playlist_key", "page_no", "load_seq", "before", F.posexplode(items).alias("pos", "item")
    ).select(
        "playlist_key", "page_no", "load_seq", (F.col("before") + F.col("pos")).alias("position"), "item.track.*"
    )


def listing_items(pages: DataFrame) -> DataFrame:
    """Playlists of landed listing pages, one row per playlist, first position kept."""
    rows = pages.select("page_no", F.posexplode(F.from_json("raw", PLAYLIST_PAGE)["items"]).alias("pos", "p"))
    entries = rows.groupBy("p.id").agg(F.min_by(F.struct("p", "page_no", "pos"), F.struct("page_no", "pos")).alias("e"))
    return entries.select("e.page_no", "e.pos", "e.p.*").withColumnRenamed("id", "spotify_id")


def filter_listing(listing: DataFrame, *markers: str) -> DataFrame:
    """Entries whose name holds all markers, whatever the case."""
    name = F.lower("name")
    for marker in markers:
        listing = listing.where(name.contains(marker.lower()))
    return listing


def playlists_of_user(pages: DataFrame, user: str) -> DataFrame:
    """First listing page of a user."""
    return listing_items(pages.where((F.col("owner") == user) & (F.col("page_no") == 0)))


def payload_by_id(payloads: DataFrame, spotify_id: str) -> DataFrame:
    return payloads.where(F.get_json_object("raw", "$.id") == spotify_id)


def payloads_for_ids(payloads: DataFrame, ids: DataFrame) -> DataFrame:
    """Payloads whose id is in the one-column frame `ids`."""
    wanted = ids.select(F.col(ids.columns[0]).alias("payload_id"))
    return payloads.withColumn("payload_id", F.get_json_object("raw", "$.id")).join(wanted, "payload_id", "left_semi")


def compact_tracks(items: DataFrame) -> DataFrame:
    """Short form of played tracks: artists in one text, title, album, address."""
    return items.select(
        "playlist_key", "position", F.array_join("artists.name", ", ").alias("artist"),
        F.col("name").alias("title"), F.col("album.name").alias("album"), F.col("external_urls.spotify").alias("url"),
    )


def random_entry(listing: DataFrame, seed: int) -> DataFrame:
    """One entry by chance; the same seed gives the same entry."""
    return listing.orderBy(F.md5(F.concat("spotify_id", F.lit(f"|{seed}"))), "spotify_id").limit(1)
