"""Declared schemas of the catalogue tables and of the payload objects."""

from __future__ import annotations

from pyspark.sql import types as T

LONG, INT, DOUBLE, STRING = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()
BOOLEAN, DATE = T.BooleanType(), T.DateType()


def fields(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


IMAGES = T.ArrayType(fields(url=STRING, width=INT, height=INT))

# Continuous audio features; the eight that a playlist summary weighs by duration.
CONTINUOUS_FEATURES = [
    "acousticness", "danceability", "energy", "instrumentalness",
    "liveness", "loudness", "speechiness", "valence",
]
FEATURE_COLUMNS = ["key", "mode", "tempo", "time_signature", *CONTINUOUS_FEATURES]

_FEATURES = dict(key=INT, mode=INT, tempo=DOUBLE, time_signature=INT, **{name: DOUBLE for name in CONTINUOUS_FEATURES})

TABLES: dict[str, T.StructType] = {
    "playlist": fields(
        playlist_id=LONG, spotify_id=STRING, spotify_url=STRING, name=STRING, description=STRING, date=DATE, images=IMAGES
    ),
    "artist": fields(
        artist_id=LONG, name=STRING, spotify_id=STRING, spotify_url=STRING, images=IMAGES, popularity=LONG, followers=LONG
    ),
    "track": fields(
        track_id=LONG, spotify_id=STRING, name=STRING, duration_ms=LONG, explicit=BOOLEAN, popularity=LONG,
        isrc_id=STRING, spotify_url=STRING, preview_url=STRING, album_id=LONG,
    ),
    "playlist_track": fields(playlist_id=LONG, track_id=LONG, sequence=LONG),
    "genre": fields(genre_id=LONG, name=STRING),
    "audio_features": fields(features_id=LONG, track_id=LONG, analysis_url=STRING, **_FEATURES),
    "album": fields(
        album_id=LONG, spotify_id=STRING, spotify_url=STRING, name=STRING, label=STRING, images=IMAGES, popularity=LONG
    ),
    "track_artist": fields(track_id=LONG, artist_id=LONG),
    # The order in which a load linked the artists of a track; links without a row here stand before them, by id.
    "track_artist_place": fields(track_id=LONG, artist_id=LONG, place=LONG),
    "artist_genre": fields(artist_id=LONG, genre_id=LONG),
    "album_artist": fields(album_id=LONG, artist_id=LONG),
    "album_track": fields(album_id=LONG, track_id=LONG),
}

# Surrogate id and natural key of the entity tables.
ENTITY_KEYS = {
    "playlist": ("playlist_id", "spotify_id"), "artist": ("artist_id", "spotify_id"), "track": ("track_id", "spotify_id"),
    "album": ("album_id", "spotify_id"), "genre": ("genre_id", "name"),
}

URLS = fields(spotify=STRING)
SIMPLE_ARTIST = fields(id=STRING, name=STRING, external_urls=URLS)
PLAYLIST_PAYLOAD = fields(id=STRING, name=STRING, description=STRING, owner=STRING, images=IMAGES, external_urls=URLS)
ARTIST_PAYLOAD = fields(
    id=STRING, name=STRING, external_urls=URLS, popularity=LONG, followers=fields(total=LONG), images=IMAGES,
    genres=T.ArrayType(STRING),
)
TRACK_PAYLOAD = fields(
    id=STRING, name=STRING, duration_ms=LONG, explicit=BOOLEAN, popularity=LONG, external_ids=fields(isrc=STRING),
    external_urls=URLS, preview_url=STRING, artists=T.ArrayType(SIMPLE_ARTIST), album=fields(id=STRING, name=STRING),
)
ALBUM_PAYLOAD = fields(
    id=STRING, name=STRING, images=IMAGES, label=STRING, popularity=LONG, artists=T.ArrayType(SIMPLE_ARTIST)
)
FEATURES_PAYLOAD = fields(id=STRING, analysis_url=STRING, **_FEATURES)
PLAYLIST_PAGE = fields(items=T.ArrayType(PLAYLIST_PAYLOAD), next=STRING)
TRACK_PAGE = fields(items=T.ArrayType(fields(track=TRACK_PAYLOAD)), next=STRING)
