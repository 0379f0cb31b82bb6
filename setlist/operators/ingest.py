"""Ingest: landed payloads merged into the catalogue.

Each stage takes whole tables, so one call loads one playlist or all of them. Payload rows
are folded to one row per key (map-side first) before any join, therefore a track, artist or
playlist that fills much of a load does not skew the joins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setlist.catalog import Catalog
from setlist.functions.labels import title_date
from setlist.operators.merge import Change, Hold, fold_by_key, merge_by_key, missing_rows, present
from setlist.operators.numbering import number_new_keys
from setlist.schema import FEATURE_COLUMNS, TABLES
from setlist.sources import payloads as P

TRACK_FIELDS = ["name", "duration_ms", "explicit", "popularity", "isrc_id", "spotify_url", "preview_url"]
# Within one load the artists named on tracks apply first, full artist payloads next, those named on albums last.
FROM_TRACK, FROM_ARTIST, FROM_ALBUM = 0, 1, 2

Stage = Callable[[str, DataFrame], DataFrame]


@dataclass(frozen=True)
class Landed:
    """Landed payload frames of one load."""

    playlists: DataFrame
    track_pages: DataFrame
    artists: DataFrame
    tracks: DataFrame
    albums: DataFrame
    features: DataFrame | None = None


def _lazy(df: DataFrame) -> DataFrame:
    return df


# --- headers -----------------------------------------------------------------------------


def merge_playlists(playlist: DataFrame, rows: DataFrame, hold: Hold = _lazy, changed_only: bool = False) -> DataFrame:
    """Name, description and url always overwrite; images if the key is there, date if the name has one."""
    dated = rows.withColumn("date", title_date(F.col("name"))).withColumn(present("date"), F.col("date").isNotNull())
    return merge_by_key(
        playlist, dated, "spotify_id", "playlist_id", ["name", "description", "spotify_url"], ["images", "date"], hold=hold,
        changed_only=changed_only,
    )


def patch_images(playlist: DataFrame, rows: DataFrame) -> DataFrame:
    """Only the images of known playlists change."""
    known = rows.join(playlist.select("spotify_id"), "spotify_id", "left_semi")
    return merge_by_key(playlist, known, "spotify_id", None, [], ["images"])


# --- tracks ------------------------------------------------------------------------------


def merge_tracks(track: DataFrame, rows: DataFrame, hold: Hold = _lazy, changed_only: bool = False) -> DataFrame:
    """All mapped track fields overwrite; the album stays as it is.

    A track that stands on a load's pages more than once is taken from its last place there.
    """
    return merge_by_key(track, rows, "spotify_id", "track_id", TRACK_FIELDS, [], "load_order", hold, changed_only)


def with_track_ids(rows: DataFrame, track: DataFrame, key: str) -> DataFrame:
    return rows.join(track.select(F.col("spotify_id").alias(key), "track_id"), key)


def with_artist_ids(rows: DataFrame, artist: DataFrame, key: str) -> DataFrame:
    return rows.join(artist.select(F.col("spotify_id").alias(key), "artist_id"), key)


def played_tracks(items: DataFrame, playlist: DataFrame, track: DataFrame) -> Change:
    """Link rows of the loaded playlists are replaced by the items of their last load."""
    last = items.groupBy("playlist_key").agg(F.max("load_seq").alias("load_seq"))
    plays = items.select("playlist_key", "load_seq", "position", F.col("id").alias("track_key"))
    loaded = last.join(playlist.select(F.col("spotify_id").alias("playlist_key"), "playlist_id"), "playlist_key")
    new = with_track_ids(plays.join(loaded, ["playlist_key", "load_seq"]), track, "track_key")
    rows = new.select("playlist_id", "track_id", F.col("position").cast("bigint").alias("sequence"))
    return Change(rows, "playlist_id", loaded.select("playlist_id"))


def replace_playlist_tracks(
    playlist_track: DataFrame, items: DataFrame, playlist: DataFrame, track: DataFrame
) -> DataFrame:
    return played_tracks(items, playlist, track).applied(playlist_track)


def new_track_artists(track_artist: DataFrame, rows: DataFrame, track: DataFrame, artist: DataFrame) -> DataFrame:
    """Links of the payloads that are not there yet."""
    lists = rows.select(F.col("spotify_id").alias("track_key"), F.col("artists.id").alias("ids")).distinct()
    named = lists.select("track_key", F.explode("ids").alias("artist_key")).distinct()
    return missing_rows(track_artist, with_artist_ids(with_track_ids(named, track, "track_key"), artist, "artist_key"))


def new_track_places(
    track_artist: DataFrame, links: DataFrame, rows: DataFrame, track: DataFrame, artist: DataFrame
) -> DataFrame:
    """Places of new links (rows of `links`): after the track's links so far, in the order the payloads first name the artists."""
    at = F.struct("load_order", "pos")
    # a track's plays mostly name the same list, so the first place of each list comes before its artists
    lists = rows.select(F.col("spotify_id").alias("track_key"), "load_order", F.col("artists.id").alias("ids"))
    lists = lists.groupBy("track_key", "ids").agg(F.min("load_order").alias("load_order"))
    named = lists.select("track_key", "load_order", F.posexplode("ids").alias("pos", "artist_key"))
    first = named.groupBy("track_key", "artist_key").agg(F.min(at).alias("at"))
    placed = with_artist_ids(with_track_ids(first, track, "track_key"), artist, "artist_key").join(links, ["track_id", "artist_id"], "left_semi")
    so_far = track_artist.join(links.select("track_id").distinct(), "track_id", "left_semi").groupBy("track_id").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("track_id").orderBy("at", "artist_id")) - 1
    return placed.join(so_far, "track_id", "left").select(
        "track_id", "artist_id", (F.coalesce("n", F.lit(0)) + rank).cast("bigint").alias("place"))


def append_track_artists(track_artist: DataFrame, rows: DataFrame, track: DataFrame, artist: DataFrame) -> DataFrame:
    return track_artist.unionByName(new_track_artists(track_artist, rows, track, artist))


# --- artists and genres --------------------------------------------------------------------


def artist_mentions(rows: DataFrame, phase: int, hold: Hold = _lazy) -> DataFrame:
    """Simplified artists inside track or album payloads: id, name and url only.

    They apply in the order of load, kind of payload, place of the payload and place in its list. Only the
    mentions of an artist's last load are given, as no earlier one can count. An artist is named once per play, so
    this load comes from counting map-side (a number per artist, `hold` may write it) and not from sorting all mentions.
    """
    at = F.col("load_order") if "load_order" in rows.columns else F.struct("load_seq", F.col("spotify_id").alias("source"), F.lit(0).cast("bigint").alias("position"))
    load = _own_load(rows, at)[0]
    last = hold(rows.select(load.alias("load"), F.explode("artists.id").alias("last_id")).groupBy("last_id").agg(F.max("load").alias("last_load")))
    named = rows.select("load_seq", at.alias("at"), F.posexplode("artists").alias("place", "a"))
    late = (F.col("a.id") == F.col("last_id")) & _own_load(named, F.col("at"))[0].eqNullSafe(F.col("last_load"))
    named = named.join(last, late, "left_semi")
    return named.select(
        F.col("a.id").alias("spotify_id"), _artist_order(named, F.col("at"), phase, F.col("place")).alias("load_order"),
        "a.name", F.col("a.external_urls.spotify").alias("spotify_url"),
    )


def _own_load(rows: DataFrame, at: Column) -> tuple[Column, Column]:
    """The load of a payload, and its own number in a load of many playlists."""
    if isinstance(rows.schema["load_seq"].dataType, T.StructType):
        return at["load_seq"]["listed"], at["load_seq"]["seq"]
    return at["load_seq"], F.lit(0).cast("bigint")


def _artist_order(rows: DataFrame, at: Column, phase: int, place: Column) -> Column:
    """Load, kind of payload, place. In a load of many playlists a payload's own number comes after its kind."""
    load, own = _own_load(rows, at)
    return F.struct(
        load.alias("load_seq"), F.lit(phase).alias("phase"), own.alias("own"), at["source"].alias("source"),
        at["position"].alias("position"), place.alias("place"))


def artist_details(rows: DataFrame) -> DataFrame:
    at = F.struct("load_seq", F.lit("").alias("source"), F.lit(0).cast("bigint").alias("position"))
    return rows.withColumn("load_order", _artist_order(rows, at, FROM_ARTIST, F.lit(0))).drop("load_seq")


def merge_artists(artist: DataFrame, *sources: DataFrame, hold: Hold = _lazy, changed_only: bool = False) -> DataFrame:
    """Name and url always overwrite; popularity, followers and images if the key is there."""
    optional = ["popularity", "followers", "images"]
    types = {f.name: f.dataType for f in TABLES["artist"]}

    def shaped(rows: DataFrame) -> DataFrame:
        for name in optional:
            if present(name) not in rows.columns:
                rows = rows.withColumn(name, F.lit(None).cast(types[name])).withColumn(present(name), F.lit(False))
        return rows.select("spotify_id", "load_order", "name", "spotify_url", *optional, *map(present, optional))

    first, *rest = map(shaped, sources)
    for more in rest:
        first = first.unionByName(more)
    return merge_by_key(artist, first, "spotify_id", "artist_id", ["name", "spotify_url"], optional, "load_order", hold, changed_only)


def artists_to_refresh(catalog: Catalog, playlists: DataFrame | None = None) -> DataFrame:
    """Natural ids of all artists with a track on the (given) playlists."""
    plays = catalog.playlist_track
    if playlists is not None:
        plays = plays.join(playlists.select("playlist_id"), "playlist_id", "left_semi")
    links = catalog.track_artist.join(plays.select("track_id").distinct(), "track_id", "left_semi")
    ids = links.select("artist_id").distinct()
    return catalog.artist.join(ids, "artist_id", "left_semi").select("spotify_id").distinct()


def loaded_artists(catalog: Catalog, tracks: DataFrame, track: DataFrame) -> DataFrame:
    """Natural ids of the artists of loaded tracks: those the load names and those linked before."""
    ids = track.join(tracks.select("spotify_id").distinct(), "spotify_id", "left_semi").select("track_id")
    linked = catalog.track_artist.join(ids, "track_id", "left_semi").select("artist_id").distinct()
    known = catalog.artist.join(linked, "artist_id", "left_semi").select("spotify_id")
    return tracks.select(F.explode("artists.id").alias("spotify_id")).unionByName(known).distinct()


def new_genres(genre: DataFrame, names: DataFrame) -> DataFrame:
    fresh = names.select("name").dropna().distinct().join(genre, "name", "left_anti")
    return number_new_keys(fresh, "name", "genre_id", genre).select(genre.columns)


def merge_genres(genre: DataFrame, names: DataFrame) -> DataFrame:
    """Genres not known by name get a row; known ones stay, duplicates included."""
    return genre.unionByName(new_genres(genre, names))


def genre_mentions(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("spotify_id").alias("artist_key"), F.explode("genres").alias("name")).dropna().distinct()


def new_artist_genres(artist_genre: DataFrame, mentions: DataFrame, artist: DataFrame, genre: DataFrame) -> DataFrame:
    """Links for genre names an artist does not have yet; of equal names the first genre row is taken."""
    had = artist_genre.join(genre, "genre_id").select("artist_id", "name")
    missing = with_artist_ids(mentions, artist, "artist_key").join(had, ["artist_id", "name"], "left_anti")
    first = genre.groupBy("name").agg(F.min("genre_id").alias("genre_id"))
    return missing_rows(artist_genre, missing.join(first, "name"))


def append_artist_genres(artist_genre: DataFrame, mentions: DataFrame, artist: DataFrame, genre: DataFrame) -> DataFrame:
    return artist_genre.unionByName(new_artist_genres(artist_genre, mentions, artist, genre))


# --- albums --------------------------------------------------------------------------------


def merge_albums(album: DataFrame, rows: DataFrame, hold: Hold = _lazy, changed_only: bool = False) -> DataFrame:
    """Name, images and the url made from the id overwrite; label and popularity if the key is there."""
    return merge_by_key(
        album, rows, "spotify_id", "album_id", ["name", "images", "spotify_url"], ["label", "popularity"], hold=hold,
        changed_only=changed_only,
    )


def new_album_artists(album_artist: DataFrame, rows: DataFrame, album: DataFrame, artist: DataFrame) -> DataFrame:
    named = rows.select(F.col("spotify_id").alias("album_key"), F.explode("artists.id").alias("artist_key")).distinct()
    keyed = named.join(album.select(F.col("spotify_id").alias("album_key"), "album_id"), "album_key")
    return missing_rows(album_artist, with_artist_ids(keyed, artist, "artist_key"))


def append_album_artists(album_artist: DataFrame, rows: DataFrame, album: DataFrame, artist: DataFrame) -> DataFrame:
    return album_artist.unionByName(new_album_artists(album_artist, rows, album, artist))


def wanted_albums(track: DataFrame, rows: DataFrame) -> DataFrame:
    """Album keys for tracks that have no album, by each track's last payload."""
    missing = track.where("album_id is null").select("spotify_id", "track_id")
    named = rows.select("spotify_id", "load_seq", F.col("album.id").alias("album_key"))
    return fold_by_key(named, "spotify_id", ["album_key"], []).join(missing, "spotify_id").dropna(subset=["album_key"])


def fill_missing_albums(
    track: DataFrame, wanted: DataFrame, album: DataFrame, arrived: DataFrame, changed_only: bool = False
) -> DataFrame:
    """Set the album of tracks without one, where the album's payload has arrived."""
    usable = album.select(F.col("spotify_id").alias("album_key"), F.col("album_id").alias("new_album_id")).join(
        arrived.select(F.col("spotify_id").alias("album_key")), "album_key", "left_semi"
    )
    found = wanted.join(usable, "album_key").select("track_id", "new_album_id")
    return (
        track.join(found, "track_id", "inner" if changed_only else "left")
        .withColumn("album_id", F.coalesce("album_id", "new_album_id"))
        .select(track.columns)
    )


def album_rejects(wanted: DataFrame, arrived: DataFrame) -> DataFrame:
    """Tracks that stay without album because its payload is not there."""
    have = arrived.select(F.col("spotify_id").alias("album_key"))
    return wanted.join(have, "album_key", "left_anti").select("spotify_id", "album_key")


# --- audio features ---------------------------------------------------------------------------


def new_audio_features(audio_features: DataFrame, rows: DataFrame, track: DataFrame) -> DataFrame:
    """Features for tracks that have none yet."""
    fields = ["analysis_url", *FEATURE_COLUMNS]
    folded = fold_by_key(rows, "spotify_id", fields, [])
    fresh = folded.join(track.select("spotify_id", "track_id"), "spotify_id").join(
        audio_features.select("track_id"), "track_id", "left_anti"
    )
    numbered = number_new_keys(fresh, "spotify_id", "features_id", audio_features)
    return numbered.select(audio_features.columns)


def attach_audio_features(audio_features: DataFrame, rows: DataFrame, track: DataFrame) -> DataFrame:
    return audio_features.unionByName(new_audio_features(audio_features, rows, track))


# --- deletes ----------------------------------------------------------------------------------


def delete_playlists(catalog: Catalog, doomed: DataFrame) -> Catalog:
    """Remove playlists (by `playlist_id`) and their link rows."""
    ids = doomed.select("playlist_id")
    return catalog.with_tables(
        playlist=catalog.playlist.join(ids, "playlist_id", "left_anti"),
        playlist_track=catalog.playlist_track.join(ids, "playlist_id", "left_anti"),
    )


# --- whole job ----------------------------------------------------------------------------------


def changes(catalog: Catalog, landed: Landed, stage: Stage = lambda name, df: df) -> tuple[dict[str, Change], DataFrame]:
    """What loading everything landed changes in each table, and the rejected (track, album) pairs.

    Only rows that the load touches are made and staged: the catalogue's tables are looked up by
    key, never rewritten. `stage` may write a finished frame and hand it back read from disk:
    payloads are then parsed once and the lineage of a long load is cut.
    """
    def folded(name: str) -> Hold:
        return lambda df: stage(f"{name}_folded", df)

    items = stage("items", P.track_page_items(landed.track_pages))
    tracks = P.track_columns(items)

    headers = stage("playlist_rows", P.playlist_rows(landed.playlists))
    playlist = Change(stage("playlist", merge_playlists(catalog.playlist, headers, folded("playlist"), True)), "playlist_id")
    track = Change(stage("track_fields", merge_tracks(catalog.track, tracks, folded("track"), True)), "track_id")
    lists = playlist.applied(catalog.playlist).select("spotify_id", "playlist_id")
    played = played_tracks(items, lists, track.rows)
    played = Change(stage("playlist_track", played.rows), "playlist_id", stage("replaced_playlists", played.gone))

    after_fields = track.applied(catalog.track)
    wanted = stage("wanted_albums", wanted_albums(after_fields, P.track_rows(landed.tracks)))
    albums = stage("album_rows", P.album_rows(P.payloads_for_ids(landed.albums, wanted.select("album_key"))))
    album = Change(stage("album", merge_albums(catalog.album, albums, folded("album"), True)), "album_id")
    filled = stage("filled_tracks", fill_missing_albums(after_fields, wanted, album.rows, albums, True))
    track = Change(stage("track", Change(filled, "track_id").applied(track.rows)), "track_id")

    details = stage("artist_rows", P.artist_rows(P.payloads_for_ids(landed.artists, loaded_artists(catalog, tracks, track.rows))))
    artist = Change(stage("artist", merge_artists(
        catalog.artist, artist_mentions(tracks, FROM_TRACK, lambda df: stage("artist_loads", df)), artist_details(details),
        artist_mentions(albums, FROM_ALBUM),
        hold=folded("artist"), changed_only=True,
    )), "artist_id")

    links = stage("track_artist", new_track_artists(catalog.track_artist, tracks, track.rows, artist.rows))
    places = stage("track_artist_place", new_track_places(catalog.track_artist, links, tracks, track.rows, artist.rows))

    mentions = stage("genre_mentions", genre_mentions(details))
    genre = Change(stage("genre", new_genres(catalog.genre, mentions)))
    found = {
        "playlist": playlist, "track": track, "playlist_track": played, "album": album, "artist": artist, "genre": genre,
        "track_artist": Change(links), "track_artist_place": Change(places),
        "album_artist": Change(stage("album_artist", new_album_artists(catalog.album_artist, albums, album.rows, artist.rows))),
        "artist_genre": Change(stage("artist_genre", new_artist_genres(
            catalog.artist_genre, mentions, artist.rows, genre.applied(catalog.genre)))),
    }
    if landed.features is not None:
        rows = stage("features_rows", P.features_rows(landed.features))
        songs = track.applied(catalog.track).select("spotify_id", "track_id")
        found["audio_features"] = Change(stage("audio_features", new_audio_features(catalog.audio_features, rows, songs)))
    return found, album_rejects(wanted, albums)


def ingest(catalog: Catalog, landed: Landed, stage: Stage = lambda name, df: df) -> tuple[Catalog, DataFrame]:
    """Load everything landed; gives the new catalogue and the rejected (track, album) pairs.

    As it stands all stays lazy; see `changes` for `stage`.
    """
    found, rejects = changes(catalog, landed, stage)
    return catalog.with_tables(**{name: change.applied(catalog.table(name)) for name, change in found.items()}), rejects
