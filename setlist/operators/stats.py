"""Counts, sums and histograms over played tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setlist.catalog import Catalog
from setlist.functions import bins
from setlist.operators.relations import one_features_row
from setlist.schema import CONTINUOUS_FEATURES

# Sums of feature x duration are taken over whole millionths, so they do not depend on the order of rows.
MILLION = 1_000_000


def _exact_sum(value: Column) -> Column:
    millionths = F.rint(value * MILLION).cast("bigint").cast("decimal(20,0)")
    return F.coalesce(F.sum(millionths).cast("double") / MILLION, F.lit(0.0))


def track_plays(c: Catalog) -> DataFrame:
    """How often each track was played."""
    return c.playlist_track.groupBy("track_id").agg(F.count("*").alias("plays"))


def artist_play_counts(c: Catalog) -> DataFrame:
    """Plays per artist name; a play counts once for each artist of the track, namesakes merge.

    Plays are counted per track and summed per artist before names come in, so the
    (play, artist) pairs are never built.
    """
    per_artist = (
        c.track_artist.join(track_plays(c), "track_id").groupBy("artist_id").agg(F.sum("plays").alias("plays"))
    )
    return (
        per_artist.join(c.artist.select("artist_id", "name"), "artist_id")
        .groupBy("name").agg(F.sum("plays").alias("count"))
    )


def top_artists(c: Catalog, n: int = 5) -> DataFrame:
    return artist_play_counts(c).orderBy(F.desc("count"), "name").limit(n)


def artists_min_plays(c: Catalog, least: int = 5) -> DataFrame:
    return artist_play_counts(c).where(F.col("count") >= least).orderBy(F.desc("count"), "name")


def play_count_histogram(c: Catalog) -> DataFrame:
    """How many artists were played that often; nameless ones do not count."""
    return artist_play_counts(c).groupBy("count").agg(F.count("name").alias("artists")).orderBy(F.desc("count"))


def genre_track_counts(c: Catalog) -> DataFrame:
    """Tracks per genre name, once for each of the track's artists that has the genre."""
    named = c.track.where("name is not null").select("track_id")
    per_artist = c.track_artist.join(named, "track_id").groupBy("artist_id").agg(F.count("*").alias("n"))
    per_genre = c.artist_genre.join(per_artist, "artist_id").groupBy("genre_id").agg(F.sum("n").alias("n"))
    names = c.genre.where("name is not null").select("genre_id", F.col("name").alias("genre"))
    return per_genre.join(names, "genre_id").groupBy("genre").agg(F.sum("n").alias("tracks"))


def top_genres(c: Catalog, n: int = 50) -> DataFrame:
    return genre_track_counts(c).orderBy(F.desc("tracks"), "genre").limit(n)


def _plays_of_tracks(c: Catalog, *features: str) -> DataFrame:
    """(playlist_id, duration_ms, features) of each played track that has features."""
    tracks = c.track.select("track_id", "duration_ms").join(c.audio_features.select("track_id", *features), "track_id")
    return c.playlist_track.select("playlist_id", "track_id").join(tracks, "track_id").drop("track_id")


def gross_valence(c: Catalog) -> DataFrame:
    """Valence weighted by duration, summed per playlist name.

    Sums are taken per playlist before its name comes in, so plays are not shuffled for the name.
    """
    weight = (F.rint(F.col("valence") * F.col("duration_ms") * MILLION)).cast("bigint").cast("decimal(20,0)")
    per_list = _plays_of_tracks(c, "valence").groupBy("playlist_id").agg(F.sum(weight).alias("weight"))
    names = c.playlist.where("name is not null").select("playlist_id", F.col("name").alias("playlist_name"))
    total = F.coalesce(F.sum("weight").cast("double") / MILLION, F.lit(0.0))
    return (
        per_list.join(names, "playlist_id").groupBy("playlist_name").agg(total.alias("gross_valence"))
        .orderBy(F.desc("gross_valence"), "playlist_name")
    )


_HALF = 2**31


def _pair_code(first: Column, second: Column) -> Column:
    """Two ints as one long, ordered like the pair. `mode` counts struct values wrongly."""
    return F.shiftleft(first.cast("bigint"), 32) + second + F.lit(_HALF)


def playlist_stats(c: Catalog) -> DataFrame:
    """A playlist's features in one row: most frequent key, mode, pair of both and time signature
    (the lowest of equally frequent ones), mean tempo, and each continuous feature times duration, summed."""
    plays = _plays_of_tracks(c, "key", "mode", "tempo", "time_signature", *CONTINUOUS_FEATURES)
    summary = plays.groupBy("playlist_id").agg(
        F.mode("key", True).alias("key"),
        F.mode("mode", True).alias("mode"),
        F.mode(_pair_code(F.col("key"), F.col("mode")), True).alias("_pair"),
        F.avg("tempo").alias("tempo"),
        F.mode("time_signature", True).alias("time_signature"),
        *[_exact_sum(F.col(name) * F.col("duration_ms")).alias(name) for name in CONTINUOUS_FEATURES],
    )
    pair_key = F.shiftright("_pair", 32)
    pair_mode = F.col("_pair") - F.shiftleft(pair_key, 32) - _HALF
    pair = {"pair_key": pair_key.cast("int"), "pair_mode": pair_mode.cast("int")}
    names = c.playlist.select("playlist_id", F.col("name").alias("playlist_name"))
    return summary.withColumns(pair).drop("_pair").join(names, "playlist_id")


def artist_track_counts(c: Catalog) -> DataFrame:
    """Tracks of every artist, zero included."""
    counts = c.track_artist.distinct().groupBy("artist_id").agg(F.count("*").alias("tracks"))
    return c.artist.select("artist_id", "name").join(counts, "artist_id", "left").select(
        "artist_id", "name", F.coalesce("tracks", F.lit(0)).alias("tracks")
    )


def histogram(values: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """Rows (or summed `weight`) per round bin of a column: at most ten bins, empty ones not listed."""
    value = F.col(column).cast("double")
    known = values.where(F.col(column).isNotNull())
    low, high = F.col("low"), F.col("high")
    edges = (
        known.agg(F.min(value).alias("low"), F.max(value).alias("high"))
        .withColumn("step", bins.bin_step(low, high))
        .select(F.struct(
            bins.bin_start(low, F.col("step")).alias("start"), bins.bin_stop(high, F.col("step")).alias("stop"), "step"
        ))
        .scalar()
    )
    numbered = known.withColumn("_edges", edges).withColumn(
        "bin", bins.bin_number(value, F.col("_edges.start"), F.col("_edges.stop"), F.col("_edges.step"))
    )
    total = F.sum(weight) if weight else F.count("*")
    left = F.round(F.col("_edges.start") + F.col("bin") * F.col("_edges.step"), 9)
    right = F.round(F.col("_edges.start") + (F.col("bin") + 1) * F.col("_edges.step"), 9)
    return numbered.groupBy("bin", left.alias("bin_start"), right.alias("bin_end")).agg(total.alias("count")).orderBy("bin")


def energy_histogram(c: Catalog, playlists: DataFrame | None = None) -> DataFrame:
    """Played tracks (of the given playlists) per energy bin; plays are counted per track first."""
    if playlists is not None:
        c = c.with_tables(playlist_track=c.playlist_track.join(playlists.select("playlist_id"), "playlist_id", "left_semi"))
    return histogram(track_plays(c).join(one_features_row(c).select("track_id", "energy"), "track_id"), "energy", "plays")
