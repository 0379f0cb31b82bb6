"""Payloads written from the bound catalogue, in the shape the music API delivers them.

Some keys are left out or null on purpose (by order status, priority, nation or album), so
that the merges meet all the cases of FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setlist.catalog import Catalog
from setlist.operators.groups import ordered_values, position_block, positions
from setlist.operators.ingest import Landed
from setlist.schema import FEATURE_COLUMNS, IMAGES
from setlist.sources.payloads import PAGES_PER_BLOCK

PAGE_SIZE = 3
LISTING_PAGE_SIZE = 50
OLD_IMAGE = "http://img/old"

_WITH_NULLS = {"ignoreNullFields": "false"}


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), _WITH_NULLS)


def _urls(url: Column | str = "spotify_url") -> Column:
    return F.struct(F.col(url).alias("spotify") if isinstance(url, str) else url.alias("spotify")).alias("external_urls")


def _id() -> Column:
    return F.col("spotify_id").alias("id")


def one_image(url: str) -> Column:
    return F.array(F.struct(F.lit(url).alias("url"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"))).cast(IMAGES)


def playlist_payloads(c: Catalog) -> DataFrame:
    """Two payloads per playlist: an early draft without date, then the final one.

    The final one lacks `images` for priority 5-LOW; the draft lacks them for 1-URGENT and 5-LOW
    playlists of an even year.
    """
    p = c.playlist
    low = F.col("description") == "5-LOW"
    bare = low & (F.year("date") % 2 == 0) | (F.col("description") == "1-URGENT")
    draft = [_id(), F.lit("draft").alias("name"), F.lit("first").alias("description"), _urls()]
    final = [_id(), "name", F.when(F.col("description") != "3-MEDIUM", F.col("description")).alias("description"), _urls()]
    early = p.select(
        F.when(bare, _json(*draft)).otherwise(_json(*draft, one_image("http://img/draft").alias("images"))).alias("raw"),
        (F.col("playlist_id") * 2).alias("load_seq"),
    )
    late = p.select(
        F.when(low, _json(*final)).otherwise(_json(*final, F.col("images"))).alias("raw"),
        (F.col("playlist_id") * 2 + 1).alias("load_seq"),
    )
    return early.unionByName(late)


def _simple_artists(links: DataFrame, key: str, artist: DataFrame) -> DataFrame:
    named = links.join(artist.select("artist_id", _id(), "name", _urls()), "artist_id")
    return ordered_values(named, "artists", [key], "artist_id", F.struct("id", "name", "external_urls"))


def _track_fields() -> list[Column]:
    """Fields of a track payload, in its order."""
    return [
        _id(), F.col("name"), F.col("duration_ms"), F.col("explicit"), F.col("popularity"),
        F.struct(F.col("isrc_id").alias("isrc")).alias("external_ids"), _urls(), F.col("preview_url"),
        F.coalesce("artists", F.array()).alias("artists"),
        F.struct(F.col("album_key").alias("id"), F.concat(F.lit("Album of "), "album_key").alias("name")).alias("album"),
    ]


def track_objects(c: Catalog, album_of: DataFrame) -> DataFrame:
    """`track_id` and the track payload as a struct; `album_of` gives every track an album key."""
    artists = _simple_artists(c.track_artist, "track_id", c.artist)
    return c.track.join(album_of, "track_id").join(artists, "track_id", "left").select(
        "track_id", F.struct(*_track_fields()).alias("track")
    )


def album_keys(parts: DataFrame) -> DataFrame:
    return parts.select(
        F.col("p_partkey").alias("track_id"), F.concat(F.lit("al"), F.substring("p_brand", 7, 10)).alias("album_key")
    )


def track_payloads(c: Catalog, album_of: DataFrame) -> DataFrame:
    objects = track_objects(c, album_of)
    return objects.select(F.to_json("track", _WITH_NULLS).alias("raw"), F.col("track_id").alias("load_seq"))


def track_texts(c: Catalog, album_of: DataFrame, reverse: bool = False) -> DataFrame:
    """`track_id` and the JSON text of its payload, cut behind the name: `head` without and `tail` with the brace that closes it.

    `nth` tells the payloads of a repeated track apart, in the order of their fields; `named` says whether there is a name.
    """
    scalars = ["spotify_id", "name", "duration_ms", "explicit", "popularity", "isrc_id", "spotify_url", "preview_url", "album_key"]
    nth = F.row_number().over(Window.partitionBy("track_id").orderBy(*scalars))
    tracks = c.track.join(album_of, "track_id").withColumn("nth", nth)
    artists = _simple_artists(c.track_artist, "track_id", c.artist)
    if reverse:
        artists = artists.withColumn("artists", F.reverse("artists"))
    head, rest = _json(_id(), F.col("name")), _json(*_track_fields()[2:])
    return tracks.join(artists, "track_id", "left").select(
        "track_id", "spotify_id", "nth", F.col("name").isNotNull().alias("named"),
        F.substring(head, F.lit(1), F.length(head) - 1).alias("head"),
        F.concat(F.lit(","), F.substring(rest, F.lit(2), F.length(rest))).alias("tail"),
    )


def track_pages(c: Catalog, album_of: DataFrame, playlists: DataFrame | None = None, versions: bool = False) -> DataFrame:
    """Track pages of all (or the given) playlists; with `versions` a track has another name on each place, and its artists in reverse.

    A track's text is made once and goes with its plays to the playlists, the one shuffle of whole texts. It is by playlist and
    block of pages, so positions over the pages need no other one, and the items of a page come from one sort. That sort names the
    block as it is, not as a window's column: so the order is known to what reads the pages, and parsed pages are never sorted.
    """
    plays = c.playlist_track
    if playlists is not None:
        plays = plays.join(playlists.select("playlist_id"), "playlist_id", "left_semi")
    text = F.concat("head", "tail")
    if versions:
        mark = F.concat(F.lit(" @"), F.col("sequence").cast("string"))
        marked = F.concat(F.substring("head", F.lit(1), F.length("head") - 1), mark, F.lit('"'), "tail")
        text = F.when(F.col("named"), marked).otherwise(text)
    placed = plays.withColumn("page_no", F.floor(F.col("sequence") / PAGE_SIZE)).join(track_texts(c, album_of, versions), "track_id").select(
        F.concat(F.lit("pl"), F.col("playlist_id").cast("string")).alias("playlist_key"), F.col("playlist_id").alias("load_seq"),
        "page_no", "sequence", "spotify_id", "nth", text.alias("text"),
    )
    block = position_block("page_no", PAGES_PER_BLOCK)
    page = Window.partitionBy("playlist_key", "load_seq", block, "page_no").orderBy("sequence", "spotify_id", "nth")
    whole = page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pages = (
        placed.repartition("playlist_key", "load_seq", block)
        .sortWithinPartitions("playlist_key", "load_seq", block, "page_no", "sequence", "spotify_id", "nth")
        .select("*", F.collect_list(F.struct("sequence", "text")).over(whole).alias("items"), F.row_number().over(page).alias("place"))
        .where("place = 1")
    )
    items = F.transform(F.array_distinct("items"), lambda i: F.concat(F.lit('{"track":'), i["text"], F.lit("}")))
    return pages.select(
        "playlist_key", "page_no", "load_seq",
        F.concat(
            F.lit('{"items":['), F.array_join(items, ","), F.lit('],"next":'),
            F.coalesce(F.concat(F.lit('"page/'), (F.col("page_no") + 1).cast("string"), F.lit('"')), F.lit("null")), F.lit("}"),
        ).alias("raw"),
    )


def listing_pages(c: Catalog) -> DataFrame:
    """Listing pages per owner, newest playlist first; the owner is the playlist's priority class."""
    owned = c.playlist.withColumn("owner", F.col("description"))
    newest = [F.col("date").desc(), F.col("playlist_id")]
    placed = positions(owned, "pos", ["owner"], newest, [F.datediff(F.lit("2100-01-01").cast("date"), "date")])
    entry = F.struct(_id(), "name", "description", "owner", "images", _urls())
    pages = ordered_values(
        placed.withColumn("page_no", F.floor(F.col("pos") / LISTING_PAGE_SIZE)), "items", ["owner", "page_no"], "pos", entry
    )
    return pages.select(
        "owner", "page_no", _json(F.col("items"), F.concat(F.lit("page/"), (F.col("page_no") + 1).cast("string")).alias("next")).alias("raw")
    )


def artist_payloads(c: Catalog) -> DataFrame:
    """Full artist payloads: without `popularity` up to 20 and from 60 to 70, with a null one from 81 up."""
    genres = ordered_values(
        c.artist_genre.join(c.genre.withColumnRenamed("name", "genre"), "genre_id"), "genres", ["artist_id"], "genre_id", F.col("genre")
    )
    popularity = F.when(F.col("popularity") <= 80, F.col("popularity")).alias("popularity")
    fields = [_id(), "name", _urls(), F.struct(F.col("followers").alias("total")).alias("followers"), "images", "genres"]
    return c.artist.join(genres, "artist_id", "left").select(
        F.when((F.col("popularity") <= 20) | F.col("popularity").between(60, 70), _json(*fields)).otherwise(_json(*fields, popularity)).alias("raw"),
        F.col("artist_id").alias("load_seq"),
    )


def album_payloads(c: Catalog) -> DataFrame:
    """Album payloads up to popularity 80 (id 20); label only above 20, popularity only below 60."""
    artists = _simple_artists(c.album_artist, "album_id", c.artist)
    fields = [_id(), "name", "images", F.coalesce("artists", F.array()).alias("artists")]
    popularity = F.col("popularity")
    return c.album.join(artists, "album_id", "left").where(popularity <= 80).select(
        F.when(popularity <= 20, _json(*fields, "popularity"))
        .when(popularity < 60, _json(*fields, "popularity", "label"))
        .otherwise(_json(*fields, "label")).alias("raw"),
        F.col("album_id").alias("load_seq"),
    )


def features_payloads(c: Catalog) -> DataFrame:
    extra = [
        F.lit("audio_features").alias("type"), F.concat(F.lit("uri:"), "spotify_id").alias("uri"),
        F.col("spotify_url").alias("track_href"), F.col("duration_ms"),
    ]
    known = c.track.select("track_id", "spotify_id", "spotify_url", "duration_ms")
    return c.audio_features.join(known, "track_id").select(
        _json(_id(), "analysis_url", *FEATURE_COLUMNS, *extra).alias("raw"), F.col("track_id").alias("load_seq")
    )


def landed_load(c: Catalog, parts: DataFrame, since: str) -> Landed:
    """Everything landed for the playlists dated `since` or later, with all lookups."""
    album_of = album_keys(parts)
    recent = c.playlist.where(F.col("date") >= since)
    return Landed(
        playlists=playlist_payloads(c.with_tables(playlist=recent)),
        track_pages=track_pages(c, album_of, recent),
        artists=artist_payloads(c),
        tracks=track_payloads(c, album_of),
        albums=album_payloads(c),
        features=features_payloads(c),
    )


def earlier_state(c: Catalog, until: str) -> Catalog:
    """The catalogue as an earlier load left it: playlists before `until`, older field values."""
    playlist = c.playlist.where(F.col("date") < until).select(
        "playlist_id", "spotify_id", "spotify_url", F.lit("old name").alias("name"), F.lit("old").alias("description"),
        F.lit(None).cast("date").alias("date"), one_image(OLD_IMAGE).alias("images"),
    )
    track = c.track.where("not explicit").withColumn("name", F.concat(F.lit("old "), "name"))
    kept = c.playlist_track.join(playlist.select("playlist_id"), "playlist_id", "left_semi").join(
        track.select("track_id"), "track_id", "left_semi"
    )
    artist = c.artist.where("popularity >= 50").withColumns({"name": F.upper("name"), "popularity": F.lit(7).cast("bigint")})
    album = c.album.where("popularity >= 40").withColumns({"label": F.lit("old label"), "popularity": F.lit(1).cast("bigint")})
    genre = c.genre.where("name <= 'ASIA'")
    return c.with_tables(
        playlist=playlist,
        playlist_track=kept.withColumn("sequence", F.col("sequence") + 100),
        track=track,
        artist=artist,
        album=album,
        genre=genre,
        track_artist=c.track_artist.join(track, "track_id", "left_semi").join(artist, "artist_id", "left_semi"),
        artist_genre=c.artist_genre.join(genre, "genre_id", "left_semi").join(artist, "artist_id", "left_semi"),
        album_artist=c.album_artist.join(album, "album_id", "left_semi").join(artist, "artist_id", "left_semi"),
        audio_features=c.audio_features.join(track, "track_id", "left_semi"),
    )
