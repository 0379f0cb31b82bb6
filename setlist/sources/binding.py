"""The catalogue seen through the driver's order tables.

Orders stand for playlists, line items for played tracks, parts for tracks, brands for albums,
suppliers for artists and nations for genres; see FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setlist.catalog import Catalog
from setlist.operators.groups import positions
from setlist.schema import CONTINUOUS_FEATURES, IMAGES

# Multipliers that spread the stand-in features over 0.000 .. 0.999.
FEATURE_FACTORS = {
    "valence": 7, "energy": 11, "acousticness": 13, "danceability": 17,
    "instrumentalness": 19, "liveness": 23, "loudness": 29, "speechiness": 31,
}


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _images(prefix: str, key: Column, widths: dict[str, int | None]) -> Column:
    return F.array(*[
        F.struct(
            F.concat(F.lit(f"http://img/{prefix}/"), key.cast("string"), F.lit(f"/{mark}")).alias("url"),
            F.lit(width).cast("int").alias("width"),
            F.lit(width).cast("int").alias("height"),
        )
        for mark, width in widths.items()
    ]).cast(IMAGES)


def _no_images() -> Column:
    return F.array().cast(IMAGES)


# Line numbers of an order that are numbered in one block.
LINES = 4096

# Columns of the driver's tables that the binding uses; a declared schema saves a look into the files.
DRIVER_TABLES = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_size int",
    "supplier": "s_suppkey bigint, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "documents": "doc_id bigint, text string",
    "benchmark": "item_id bigint, text string",
}


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(DRIVER_TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def bound_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    def read(name: str) -> DataFrame:
        return driver_table(spark, sf_dir, name)

    def playlist() -> DataFrame:
        key = _text("o_orderkey")
        day = F.col("o_orderdate").cast("date")
        return read("orders").select(
            F.col("o_orderkey").alias("playlist_id"),
            F.concat(F.lit("pl"), key).alias("spotify_id"),
            F.concat(F.lit("http://list/"), key).alias("spotify_url"),
            F.concat(F.lit("Set "), "o_orderpriority", F.lit(" :: "), day.cast("string")).alias("name"),
            F.col("o_orderpriority").alias("description"),
            day.alias("date"),
            F.when(F.col("o_orderstatus") == "P", _no_images())
            .otherwise(_images("pl", key, {"a": None, "b": None})).alias("images"),
        )

    def playlist_track() -> DataFrame:
        plays = read("lineitem").select(
            F.col("l_orderkey").alias("playlist_id"), F.col("l_partkey").alias("track_id"), "l_linenumber"
        )
        order = ["l_linenumber", "track_id"]  # lines alike in both give the same rows, whichever comes first
        # Line numbers tell the lines of an order apart, so a block of them is bounded; most orders have one.
        blocks, later = [F.floor(F.col("l_linenumber") / LINES)], F.col("l_linenumber") >= LINES
        placed = positions(plays, "sequence", ["playlist_id"], [F.col(c) for c in order], blocks, later)
        return placed.select("playlist_id", "track_id", "sequence")

    def track() -> DataFrame:
        key, size = _text("p_partkey"), F.col("p_size")
        return read("part").select(
            F.col("p_partkey").alias("track_id"),
            F.concat(F.lit("tr"), key).alias("spotify_id"),
            F.col("p_name").alias("name"),
            (60000 + size * 1000).cast("bigint").alias("duration_ms"),
            (size % 2 == 0).alias("explicit"),
            (size * 2).cast("bigint").alias("popularity"),
            F.concat(F.lit("ISRC"), key).alias("isrc_id"),
            F.concat(F.lit("http://track/"), key).alias("spotify_url"),
            F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("http://preview/"), key)).alias("preview_url"),
            F.when(size != 50, F.substring("p_brand", 7, 10).cast("bigint")).alias("album_id"),
        )

    def artist() -> DataFrame:
        key, nation = _text("s_suppkey"), F.col("s_nationkey")
        balance = F.floor(F.abs("s_acctbal")).cast("bigint")
        return read("supplier").select(
            F.col("s_suppkey").alias("artist_id"),
            F.concat(F.lit("Artist "), (F.col("s_suppkey") % 80).cast("string")).alias("name"),
            F.concat(F.lit("ar"), key).alias("spotify_id"),
            F.concat(F.lit("http://artist/"), key).alias("spotify_url"),
            F.when(nation < 10, _images("ar", key, {"a": 640, "b": 640, "c": 64}))
            .when(nation < 20, _images("ar", key, {"a": 320, "b": 64}))
            .otherwise(_no_images()).alias("images"),
            (balance % 101).alias("popularity"),
            (balance * 100).alias("followers"),
        )

    def album() -> DataFrame:
        brands = read("part").select("p_brand").distinct()
        key = F.substring("p_brand", 7, 10)
        return brands.select(
            key.cast("bigint").alias("album_id"),
            F.concat(F.lit("al"), key).alias("spotify_id"),
            F.concat(F.lit("https://open.spotify.com/album/al"), key).alias("spotify_url"),
            F.concat(F.lit("Album "), "p_brand").alias("name"),
            F.concat(F.lit("Label "), key).alias("label"),
            F.when(key.cast("int") < 20, _images("al", key, {"a": 640, "b": 300, "c": 300, "d": 64}))
            .otherwise(_images("al", key, {"a": 64})).alias("images"),
            (key.cast("bigint") * 4).alias("popularity"),
        )

    def genre() -> DataFrame:
        regions = read("region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("name"))
        return read("nation").join(regions, "n_regionkey").select(
            F.col("n_nationkey").cast("bigint").alias("genre_id"), "name"
        )

    def artist_genre() -> DataFrame:
        suppliers = read("supplier")
        own = suppliers.select(F.col("s_suppkey").alias("artist_id"), F.col("s_nationkey").cast("bigint").alias("genre_id"))
        other = suppliers.select(F.col("s_suppkey").alias("artist_id"), (F.col("s_suppkey") % 25).alias("genre_id"))
        return own.unionByName(other).distinct()

    def track_artist() -> DataFrame:
        pairs = read("lineitem").select(F.col("l_partkey").alias("track_id"), F.col("l_suppkey").alias("artist_id"))
        return pairs.distinct()

    def track_artist_place() -> DataFrame:
        return spark.sql("select 0L as track_id, 0L as artist_id, 0L as place where false")

    def audio_features() -> DataFrame:
        key = F.col("p_partkey")
        values = {name: (key * factor % 1000) / F.lit(1000).cast("double") for name, factor in FEATURE_FACTORS.items()}
        values["valence"] = F.when(key % 19 != 0, values["valence"])
        return read("part").where(key % 17 != 0).select(
            key.alias("features_id"), key.alias("track_id"),
            F.concat(F.lit("http://analysis/"), _text("p_partkey")).alias("analysis_url"),
            (key % 14 - 1).cast("int").alias("key"), (key % 3).cast("int").alias("mode"),
            (60 + F.col("p_size") * F.lit(2.5).cast("double")).alias("tempo"),
            (3 + key % 3).cast("int").alias("time_signature"),
            *[values[name].alias(name) for name in CONTINUOUS_FEATURES],
        )

    def album_artist() -> DataFrame:
        albums = track().where("album_id is not null").select("track_id", "album_id")
        return albums.join(track_artist(), "track_id").select("album_id", "artist_id").distinct()

    def album_track() -> DataFrame:
        return track().where("album_id is not null").select("album_id", "track_id")

    makers = {f.__name__: f for f in (
        playlist, playlist_track, track, artist, album, genre, artist_genre, track_artist,
        track_artist_place, audio_features, album_artist, album_track,
    )}
    return Catalog(lambda name: makers[name]())
