"""Catalogue relationships as joins: one row per related pair, nothing gathered into lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setlist.catalog import Catalog
from setlist.functions import labels as L
from setlist.operators.groups import join_keeping_left, joined_text, ordered_values, position_block, positions, positions_without, repeated_text, repeated_value
from setlist.schema import FEATURE_COLUMNS, TABLES

# Added to places, so that they come after all ids.
PLACED = 1 << 62
# Partitions, at least, over which rows are dealt before their repeated texts are written out.
TEXT_PARTITIONS = 256


def one_features_row(c: Catalog) -> DataFrame:
    """Audio features, at most one row per track: the one with the lowest id."""
    rest = [name for name in c.audio_features.columns if name != "track_id"]
    first = c.audio_features.groupBy("track_id").agg(F.min_by(F.struct(*rest), "features_id").alias("f"))
    return first.select("track_id", "f.*")


def placed_artists(c: Catalog) -> DataFrame:
    """`track_artist` with `link_order`, a number that puts a track's artists in order, unique in a track.

    Links that a load gave a place come in the order of their places, after those without one, which go by id.
    """
    placed = c.track_artist.join(c.track_artist_place, ["track_id", "artist_id"], "left")
    return placed.select("track_id", "artist_id", F.coalesce(F.col("place") + F.lit(PLACED), "artist_id").alias("link_order"))


def track_artist_names(c: Catalog, separator: str = ", ") -> DataFrame:
    """`track_id` and the names of its artists in one text, in the order they were linked."""
    named = placed_artists(c).join(c.artist.select("artist_id", "name"), "artist_id")
    names = ordered_values(named, "names", ["track_id"], "link_order", F.col("name"))
    return names.select("track_id", F.array_join("names", separator).alias("artists"))


def feature_records(c: Catalog) -> DataFrame:
    """Feature values with key and mode spelled out."""
    return c.audio_features.select(
        "features_id", "track_id", "key", L.key_label(F.col("key")).alias("key_str"),
        "mode", L.mode_label(F.col("mode")).alias("mode_str"),
        *[name for name in FEATURE_COLUMNS if name not in ("key", "mode")],
    )


def track_records(c: Catalog) -> DataFrame:
    """All scalar facts of a track in one row, keyed by `track_pk`; lacking album or features give nulls."""
    albums = c.album.select("album_id", F.col("name").alias("album"))
    features = one_features_row(c).drop("analysis_url")
    return (
        c.track.join(features, "track_id", "left")
        .join(track_artist_names(c), "track_id", "left")
        .join(albums, "album_id", "left")
        .select(
            F.col("track_id").alias("track_pk"), F.col("spotify_id").alias("track_id"), "name", "duration_ms", "explicit",
            "popularity", "album", F.coalesce("artists", F.lit("")).alias("artists"), "features_id",
            "key", record_labels()["key_str"].alias("key_str"), "mode", record_labels()["mode_str"].alias("mode_str"),
            *[name for name in FEATURE_COLUMNS if name not in ("key", "mode")],
        )
    )


def record_labels() -> dict[str, Column]:
    """Key and mode of a record spelled out."""
    return {"key_str": F.coalesce(L.key_label(F.col("key")), F.lit("")), "mode_str": L.mode_label(F.col("mode"))}


def record_durations(c: Catalog) -> DataFrame:
    """`track_pk` and duration, as many rows per track as `track_records` has."""
    tracks = c.track.join(c.album.select("album_id"), "album_id", "left")
    return tracks.select(F.col("track_id").alias("track_pk"), "duration_ms")


def track_flat(c: Catalog, strict: bool = False) -> DataFrame:
    """The flat track record; `strict` leaves out tracks that lack an album or features."""
    records = track_records(c)
    if strict:
        records = records.where("album is not null and features_id is not null")
    return records.drop("track_pk", "features_id")


# --- played tracks ---------------------------------------------------------------------------


def playlist_tracks_outer(c: Catalog) -> DataFrame:
    """Every playlist with its tracks and their artists, kept also where there are none."""
    lists = c.playlist.select("playlist_id", F.col("name").alias("playlist_name"))
    return join_keeping_left(lists, c.playlist_track, "playlist_id").join(c.track_artist, "track_id", "left").select(
        "playlist_id", "playlist_name", "sequence", "track_id", "artist_id"
    )


def playlist_tracklist(c: Catalog) -> DataFrame:
    """Tracks of each playlist in playing order."""
    return (
        c.playlist_track.join(c.track.select("track_id", F.col("name").alias("track")), "track_id")
        .join(c.playlist.select("playlist_id", F.col("name").alias("playlist_name")), "playlist_id")
        .select("playlist_id", "playlist_name", "sequence", "track_id", "track")
        .orderBy("playlist_id", "sequence", "track_id")
    )


def enumerate_tracks(c: Catalog) -> DataFrame:
    """Position (from 0, without gaps) and track of each playlist item."""
    placed = positions(
        c.playlist_track, "position", ["playlist_id"], [F.col("sequence"), F.col("track_id")], [position_block()]
    )
    return placed.join(c.track.select("track_id", "name"), "track_id").select("playlist_id", "position", "track_id", "name")


def remove_at_position(c: Catalog, doomed: DataFrame) -> DataFrame:
    """`playlist_track` without the items at the given (playlist_id, position), renumbered."""
    order = [F.col("sequence"), F.col("track_id")]
    left = positions_without(c.playlist_track, "new_position", "playlist_id", order, position_block(), doomed)
    return left.select("playlist_id", "track_id", F.col("new_position").alias("sequence"))


def track_playlists(c: Catalog) -> DataFrame:
    """Playlists a track was played on, once per play."""
    return c.playlist_track.join(c.playlist.select("playlist_id", "name", "date"), "playlist_id").select(
        "track_id", "playlist_id", "sequence", F.col("name").alias("playlist_name"), "date"
    )


def plays_with_features(c: Catalog) -> DataFrame:
    """Played tracks with their playlist, duration and audio features (inner joins).

    Playlists come first, on the bare plays; tracks last, so that more joins by track need no other shuffle.
    """
    tracks = c.track.select("track_id", "name", "duration_ms").join(
        c.audio_features.select("track_id", "analysis_url", "features_id", *FEATURE_COLUMNS), "track_id"
    )
    lists = c.playlist.select("playlist_id", F.col("name").alias("playlist_name"), "date")
    return c.playlist_track.join(lists, "playlist_id").join(tracks, "track_id")


def playlist_features(c: Catalog) -> DataFrame:
    """Played tracks with features and artists, one row per play and artist."""
    artists = c.track_artist.join(c.artist.select("artist_id", F.col("name").alias("artist")), "artist_id")
    return plays_with_features(c).join(artists, "track_id").select(
        "date", "playlist_name", "playlist_id", "sequence", "track_id", "name", "artist_id", "artist", "duration_ms",
        *FEATURE_COLUMNS,
    )


def feature_projection(columns: None | str | list[str]) -> list[Column]:
    """Which feature columns to show: all, SQL expressions as they stand, or names with or without `af.`."""
    names = [f.name for f in TABLES["audio_features"]]
    if columns is None:
        return [F.col(f"af.{name}") for name in names]
    if isinstance(columns, str):
        return [F.expr(part) for part in _split_expressions(columns)]
    wanted = [name.removeprefix("af.") for name in columns]
    unknown = sorted(set(wanted) - set(names))
    if unknown:
        raise ValueError(f"no such audio features: {', '.join(unknown)}")
    return [F.col(f"af.{name}") for name in wanted]


def _split_expressions(text: str) -> list[str]:
    """Parts of a select list: commas inside parentheses or quotes do not part."""
    parts, depth, quote, start = [], 0, "", 0
    for i, char in enumerate(text):
        if quote:
            quote = "" if char == quote else quote
        elif char in "'\"`":
            quote = char
        elif char in "()":
            depth += 1 if char == "(" else -1
        elif char == "," and not depth:
            parts.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*parts, text[start:]] if p.strip()]


def playlist_as_df_runs(c: Catalog) -> DataFrame:
    """Artists of each track *name* and how often its plays name them: the repeated artist text as runs.

    A row stands for `times` mentions one after the other, so it is as short for a track played a billion
    times as for one played once.
    """
    with_artist = c.track_artist.select("track_id", "artist_id").join(
        c.artist.select("artist_id", F.col("name").alias("artist")), "artist_id"
    )
    n_features = c.audio_features.groupBy("track_id").agg(F.count("*").alias("_n_features"))
    n_plays = c.playlist_track.join(c.playlist.select("playlist_id"), "playlist_id", "left_semi")
    weights = n_plays.groupBy("track_id").agg(F.count("*").alias("_n_plays")).join(n_features, "track_id")
    named = with_artist.join(weights, "track_id").join(c.track.select("track_id", "name"), "track_id")
    return named.groupBy("name", "artist_id", "artist").agg(F.sum(F.col("_n_plays") * F.col("_n_features")).alias("times"))


def playlist_as_df(
    c: Catalog, columns: None | str | list[str] = None, distinct_artists: bool = True
) -> DataFrame:
    """One row per track *name*: its artists in one text, all else from its earliest play.

    Artist names come once each, or with `distinct_artists=False` once per play and artist.
    Plays are counted per track and summed per (name, artist) before any text is built. The repeated
    text is one string per name, so it must stay below 2 GB; `playlist_as_df_runs` has no such limit. It is
    written out in the result's rows only, one at a time: what is gathered and joined are the runs. Rows are dealt evenly before it,
    because the runs say little of the size of their texts and whoever stores the rows may hold those of a task together.
    """
    af = c.audio_features.select(*[f.name for f in TABLES["audio_features"]])
    with_artist = c.track_artist.join(c.artist.select("artist_id"), "artist_id", "left_semi")
    playable = c.track.select("track_id", "name").join(with_artist.select("track_id"), "track_id", "left_semi")

    # earliest play per track first: from there on there is one row per track, not per play
    plays = c.playlist_track.join(c.playlist.select("playlist_id", "date"), "playlist_id")
    per_track = plays.groupBy("track_id").agg(F.min(F.struct("date", "playlist_id", "sequence")).alias("_play"))
    options = per_track.join(playable, "track_id").join(af.select("track_id", "features_id"), "track_id")
    first = options.groupBy("name").agg(
        F.min_by(F.struct("_play.playlist_id", "track_id", "features_id"), F.struct("_play", "features_id")).alias("_at")
    )
    at = first.select("name", "_at.*").alias("at")
    shown = [F.col("p.date"), F.col("p.name").alias("playlist_name"), F.col("p.playlist_id"), F.col("t.name"), F.col("t.duration_ms")]
    chosen = (
        at.join(c.track.alias("t"), F.col("at.track_id") == F.col("t.track_id"))
        .join(af.alias("af"), F.col("at.features_id") == F.col("af.features_id"))
        .join(c.playlist.alias("p"), F.col("at.playlist_id") == F.col("p.playlist_id"))
        .select(*shown, *feature_projection(columns))
    )

    runs = playlist_as_df_runs(c)
    value = F.col("artist") if distinct_artists else repeated_value(F.col("artist"), F.col("times"))
    names = ordered_values(runs, "_names", ["name"], "artist_id", value).withColumnRenamed("name", "_name")
    text = joined_text(F.col("_names"), ";") if distinct_artists else repeated_text(F.col("_names"), ";")
    joined = chosen.join(names, F.col("name").eqNullSafe(F.col("_name")))
    if not distinct_artists:
        usual = int(joined.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        joined = joined.repartition(max(usual, TEXT_PARTITIONS))
    joined = joined.withColumn("artist", text).drop("_name", "_names")
    front = ["date", "playlist_name", "playlist_id", "name", "artist", "duration_ms"]
    return joined.select(*front, *[column for column in chosen.columns if column not in front])


# --- pairs ---------------------------------------------------------------------------------------


def track_genre_pairs(c: Catalog) -> DataFrame:
    """Track name and genre name through the track's artists, with repeats."""
    return (
        c.track.join(c.track_artist, "track_id").join(c.artist_genre, "artist_id")
        .join(c.genre.select("genre_id", F.col("name").alias("genre")), "genre_id")
        .select(F.col("name").alias("track"), "genre")
    )


def artist_tracks(c: Catalog) -> DataFrame:
    names = c.artist.select("artist_id", F.col("name").alias("artist"))
    return names.join(c.track_artist.distinct(), "artist_id").join(c.track.select("track_id", F.col("name").alias("track")), "track_id").select(
        "artist_id", "artist", "track_id", "track"
    )


def artist_albums(c: Catalog) -> DataFrame:
    names = c.artist.select("artist_id", F.col("name").alias("artist"))
    return names.join(c.album_artist.distinct(), "artist_id").join(c.album.select("album_id", F.col("name").alias("album")), "album_id").select(
        "artist_id", "artist", "album_id", "album"
    )


def genre_artists(c: Catalog) -> DataFrame:
    names = c.genre.select("genre_id", F.col("name").alias("genre"))
    return names.join(c.artist_genre.distinct(), "genre_id").join(c.artist.select("artist_id", F.col("name").alias("artist")), "artist_id").select(
        "genre_id", "genre", "artist_id", "artist"
    )


def track_album(c: Catalog) -> DataFrame:
    albums = c.album.select("album_id", F.col("name").alias("album"))
    return c.track.select("track_id", F.col("name").alias("track"), "album_id").join(albums, "album_id", "left").select(
        "track_id", "track", "album_id", "album"
    )


def track_features(c: Catalog) -> DataFrame:
    return c.track.select("track_id", F.col("name").alias("track")).join(
        one_features_row(c).drop("analysis_url"), "track_id", "left"
    )


# --- filters -----------------------------------------------------------------------------------------


def playlist_by_name(c: Catalog, name: str) -> DataFrame:
    return c.playlist.where(F.col("name") == name)


def first_with_name_part(listing: DataFrame, part: str) -> DataFrame:
    """First listing entry whose name holds `part` (matching case)."""
    return listing.where(F.col("name").contains(part)).orderBy("page_no", "pos", "spotify_id").limit(1)


def previewless_tracks(c: Catalog, n: int | None = None) -> DataFrame:
    rows = c.track.where("preview_url is null")
    return rows if n is None else rows.orderBy("track_id").limit(n)


def tracks_missing_album(c: Catalog) -> DataFrame:
    return c.track.where("album_id is null")


def display_labels(c: Catalog) -> DataFrame:
    """How playlists, artists and tracks are called on screen."""
    lists = c.playlist.select(F.lit("playlist").alias("kind"), F.col("playlist_id").alias("id"), L.entity_label(F.col("name"), "Playlist").alias("label"))
    people = c.artist.select(F.lit("artist").alias("kind"), F.col("artist_id").alias("id"), L.entity_label(F.col("name"), "Artist").alias("label"))
    tracks = c.track.join(track_artist_names(c), "track_id", "left").select(
        F.lit("track").alias("kind"), F.col("track_id").alias("id"),
        L.track_label(F.col("name"), F.coalesce("artists", F.lit(""))).alias("label"),
    )
    return lists.unionByName(people).unionByName(tracks)
