"""The data behind each page, as flat rows. Requests come as a frame, so one run answers many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setlist.catalog import Catalog
from setlist.functions import images as I
from setlist.functions import labels as L
from setlist.operators.groups import ordered_values
from setlist.operators.relations import one_features_row, placed_artists, track_artist_names
from setlist.schema import CONTINUOUS_FEATURES

PORTRAIT, THUMBNAIL = 640, 300

# Columns a reader may sort a track table by.
SORTABLE = [
    "artists", "track", "popularity", "valence", "danceability", "energy", "acousticness", "instrumentalness",
    "liveness", "loudness", "speechiness", "key", "tempo", "time_signature",
]


def playlist_index(c: Catalog) -> DataFrame:
    """All playlists, newest first, with their picture."""
    return c.playlist.select(
        "playlist_id", "date", I.first_image(F.col("images")).alias("image_url")
    ).orderBy(F.desc_nulls_last("date"), "playlist_id")


def track_cells(c: Catalog, separator: str = ", ") -> DataFrame:
    """The cells of the track table, one row per track."""
    cells = _cells(c, track_artist_names(c, separator))
    return cells.withColumn("artists", F.coalesce("artists", F.lit("")))


def _cells(c: Catalog, artists: DataFrame) -> DataFrame:
    """The cells of the track table with the columns of `artists`, a frame by track."""
    features = one_features_row(c).select(
        "track_id", F.col("key").alias("_key"), F.col("mode").alias("_mode"), "tempo", "time_signature", *CONTINUOUS_FEATURES
    )
    tracks = c.track.select("track_id", "spotify_url", F.col("name").alias("track"), "popularity", L.filled(F.col("preview_url")).alias("has_preview"))
    theirs = [name for name in artists.columns if name != "track_id"]
    return (
        tracks.join(features, "track_id", "left").join(artists, "track_id", "left")
        .select(
            "track_id", "has_preview", "spotify_url", *theirs, "track", "popularity",
            *CONTINUOUS_FEATURES,
            L.key_mode_label(F.col("_key"), F.col("_mode")).alias("key"), "tempo", "time_signature",
        )
    )


def track_links(c: Catalog) -> DataFrame:
    """What a row of the track table links to: the track, its preview and each of its artists; one row per artist.

    Tracks without an artist have one row. `place` numbers a track's artists from 0 in the order they were linked.
    """
    tracks = c.track.select(
        "track_id", "spotify_id", "spotify_url", "preview_url", L.filled(F.col("preview_url")).alias("has_preview"),
        F.col("album_id").isNotNull().alias("has_album"))
    people = placed_artists(c).join(c.artist.select("artist_id", F.col("spotify_id").alias("id"), "name"), "artist_id")
    listed = ordered_values(people, "links", ["track_id"], "link_order", F.struct("id", "name"))
    linked = tracks.join(listed, "track_id", "left").select(*tracks.columns, F.posexplode_outer("links").alias("place", "a"))
    return linked.select(*tracks.columns, "place", F.col("a.id").alias("artist_spotify_id"), F.col("a.name").alias("artist"))


# Columns a reader may sort the artists of a genre by.
GENRE_SORTABLE = ["name", "popularity", "followers"]


def sorted_genre_artists(c: Catalog, column: str, descending: bool = False, names: DataFrame | None = None) -> DataFrame:
    """The artist table of each genre by one of its columns, either way; followers by number; ties by id."""
    if column not in GENRE_SORTABLE:
        raise ValueError(f"cannot sort by {column}")
    page = genre_page(c, names).join(c.artist.select("artist_id", F.col("followers").alias("_followers")), "artist_id")
    key = F.col("_followers" if column == "followers" else column)
    return page.orderBy("genre", key.desc_nulls_last() if descending else key.asc_nulls_last(), "artist_id").drop("_followers")


def sorted_tracks(c: Catalog, column: str, descending: bool = False) -> DataFrame:
    """The track table by one of its columns, either way; ties by id."""
    if column not in SORTABLE:
        raise ValueError(f"cannot sort by {column}")
    order = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return track_cells(c).orderBy(order, "track_id")


def playlist_page(c: Catalog, requests: DataFrame, ordered: bool = True) -> DataFrame:
    """Playlists and their track table for requested dates (`date_str`).

    `status` is `ok`, `not found` (no playlist that day) or `invalid` (no date); the latter two
    have one row without a playlist. For a large batch of dates `ordered=False` saves the sort
    of everything; `sequence` still gives the order on each page.
    """
    asked = requests.select("date_str", L.path_date(F.col("date_str")).alias("date")).distinct()
    page = _page_rows(c, asked, track_cells(c))
    return page.orderBy("date", "playlist_id", "sequence") if ordered else page


def playlist_page_rows(c: Catalog, requests: DataFrame, ordered: bool = True) -> DataFrame:
    """As `playlist_page`, with what a row links to: the track's own id, its preview and its artists.

    `links` is an array of (id, name), in the order the artists were linked; empty without artists,
    null in the one row of a date or playlist without tracks.
    """
    asked = requests.select("date_str", L.path_date(F.col("date_str")).alias("date")).distinct()
    people = placed_artists(c).join(c.artist.select("artist_id", F.col("spotify_id").alias("id"), "name"), "artist_id")
    listed = ordered_values(people, "links", ["track_id"], "link_order", F.struct("id", "name"))
    own = c.track.select("track_id", F.col("spotify_id").alias("track_spotify_id"), "preview_url")
    linked = own.join(listed, "track_id", "left").withColumn("links", F.coalesce("links", F.array().cast(listed.schema["links"].dataType)))
    cells = _cells(c, linked).withColumn("artists", F.array_join("links.name", ", "))
    page = _page_rows(c, asked, cells)
    return page.orderBy("date", "playlist_id", "sequence") if ordered else page


def _page_rows(c: Catalog, asked: DataFrame, cells: DataFrame) -> DataFrame:
    """Played tracks of the asked dates' playlists, and one row for each date or playlist without any.

    The three kinds of rows are inner joins and anti joins on keys only, so that neither a date with
    very many playlists nor a long playlist is the side of an outer join that cannot be split.
    """
    lists = c.playlist.select(
        "date", "playlist_id", F.col("name").alias("playlist_name"), I.first_image(F.col("images")).alias("image_url"),
        F.col("spotify_url").alias("playlist_url"), F.col("description"), L.filled(F.col("description")).alias("has_description"),
    )
    found = asked.join(lists, "date").withColumn("status", F.lit("ok"))
    played = found.join(c.playlist_track, "playlist_id").join(cells, "track_id")
    with_tracks = c.playlist_track.join(c.track.select("track_id"), "track_id", "left_semi").select("playlist_id").distinct()
    silent = found.join(with_tracks, "playlist_id", "left_anti")
    status = F.when(F.col("date").isNull(), "invalid").otherwise("not found")
    lost = asked.join(lists.select("date").distinct(), "date", "left_anti").withColumn("status", status)
    return played.unionByName(silent, allowMissingColumns=True).unionByName(lost, allowMissingColumns=True)


def artist_page(c: Catalog, spotify_ids: DataFrame | None = None) -> DataFrame:
    """Head of an artist's page: picture, popularity, followers, genres. One row per natural id."""
    artist = _first_artists(c, spotify_ids)
    linked = c.artist_genre
    if spotify_ids is not None:
        linked = linked.join(artist, "artist_id", "left_semi")
    genres = ordered_values(linked.join(c.genre.withColumnRenamed("name", "genre"), "genre_id"), "genres", ["artist_id"], "genre_id", F.col("genre"))
    return artist.join(genres, "artist_id", "left").select(
        "artist_id", "spotify_id", "name", I.pick_image(F.col("images"), PORTRAIT).alias("image_url"), "popularity",
        L.thousands(F.col("followers")).alias("followers"), F.coalesce(F.array_join("genres", ", "), F.lit("")).alias("genres"),
    )


def _first_artists(c: Catalog, spotify_ids: DataFrame | None) -> DataFrame:
    artist = c.artist
    if spotify_ids is not None:
        artist = artist.join(spotify_ids.select("spotify_id"), "spotify_id", "left_semi")
    first = artist.groupBy("spotify_id").agg(F.min("artist_id").alias("artist_id"))
    return artist.join(first, ["artist_id", "spotify_id"], "left_semi")


def artist_page_tracks(c: Catalog, spotify_ids: DataFrame | None = None, ordered: bool = True) -> DataFrame:
    """Track table of an artist's page; `ordered=False` as for `playlist_page`."""
    artist = _first_artists(c, spotify_ids).select("artist_id", "spotify_id")
    links = c.track_artist.distinct().join(artist, "artist_id")
    page = links.join(track_cells(c), "track_id")
    return page.orderBy("artist_id", "track_id") if ordered else page


def artist_page_albums(c: Catalog, spotify_ids: DataFrame | None = None) -> DataFrame:
    """Albums of an artist's page with their picture."""
    artist = _first_artists(c, spotify_ids).select("artist_id", F.col("spotify_id").alias("artist_spotify_id"))
    links = c.album_artist.distinct().join(artist, "artist_id")
    albums = c.album.select("album_id", "spotify_url", F.col("name").alias("album"), I.pick_image(F.col("images"), PORTRAIT).alias("image_url"))
    return links.join(albums, "album_id").orderBy("artist_id", "album_id")


def genre_page(c: Catalog, names: DataFrame | None = None) -> DataFrame:
    """Artists of a genre, most popular first, with their other genres. Of equal names the first row counts."""
    genre = c.genre.where("name is not null")
    if names is not None:
        genre = genre.join(names.select("name"), "name", "left_semi")
    first = genre.groupBy("name").agg(F.min("genre_id").alias("genre_id")).withColumnRenamed("name", "genre")
    members = c.artist_genre.join(first, "genre_id").select("genre", "artist_id").distinct()
    theirs = c.artist_genre.join(members.select("artist_id").distinct(), "artist_id", "left_semi")
    genres = ordered_values(
        theirs.join(c.genre.select("genre_id", F.col("name").alias("genre")), "genre_id"), "genres", ["artist_id"], "genre_id", F.col("genre")
    )
    shown = c.artist.select("artist_id", "spotify_id", "name", "popularity", L.thousands(F.col("followers")).alias("followers"))
    return (
        members.join(shown, "artist_id").join(genres, "artist_id")
        .withColumn("other_genres", F.array_join(F.filter("genres", lambda g: g != F.col("genre")), "; "))
        .drop("genres")
        .orderBy("genre", F.desc_nulls_last("popularity"), "artist_id")
    )


def search_page(c: Catalog, hits: DataFrame) -> DataFrame:
    """Result rows for hits (`track_id`, further columns are kept): artists, album and its picture."""
    artists = track_artist_names(c, "; ")
    albums = c.album.select("album_id", F.col("name").alias("album"), I.pick_image(F.col("images"), THUMBNAIL).alias("image_url"))
    tracks = c.track.select("track_id", F.col("name").alias("track"), L.filled(F.col("preview_url")).alias("has_preview"), "album_id")
    return (
        hits.join(tracks, "track_id").join(artists, "track_id", "left").join(albums, "album_id", "left")
        .select(*hits.columns, "track", F.coalesce("artists", F.lit("")).alias("artists"), "album", "image_url", "has_preview")
        .orderBy("track_id")
    )


def search_page_playlists(c: Catalog, hits: DataFrame) -> DataFrame:
    """Playlist tiles under the results: one row per hit and play."""
    lists = c.playlist.select("playlist_id", "date", I.first_image(F.col("images")).alias("image_url"))
    return hits.join(c.playlist_track, "track_id").join(lists, "playlist_id").select(
        *hits.columns, "playlist_id", "sequence", "date", "image_url"
    )
