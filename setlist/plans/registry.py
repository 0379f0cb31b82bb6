"""Every query by name, over the driver's tables."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setlist.catalog import Catalog
from setlist.functions import images as I
from setlist.operators import genres, ingest, relations, search, sinks, stats, timeline
from setlist.operators.groups import join_keeping_left, positions
from setlist.operators.index import StoredIndex
from setlist.operators.sinks import Scratch, written_stage
from setlist.plans import jobs, pages
from setlist.session import shared_dir, tune
from setlist.sources import landed, payloads, tables
from setlist.sources.binding import bound_catalog, driver_table
from setlist.sources.store import Store

Query = Callable[[SparkSession, str], DataFrame]

# Playlists dated before KNOWN_UNTIL are in the catalogue when a load starts; the load brings
# those dated LOADED_SINCE or later, so one year is loaded again.
KNOWN_UNTIL, LOADED_SINCE = "1997-01-01", "1996-01-01"
ONE_QUERY = "small-ring artist brand"
INDEX_BUCKETS = 8
STORE_BUCKETS = 8
LISTING_MARKERS = ("SET", "Urgent")
PLAYLIST_NAME = "Set 2-HIGH :: 1996-06-06"

QUERIES: dict[str, Query] = {}


def query(make: Callable[[Catalog], DataFrame]) -> Callable[[Catalog], DataFrame]:
    """Register a query over the bound catalogue."""
    QUERIES[make.__name__] = lambda spark, sf_dir: make(bound_catalog(tune(spark), sf_dir))
    return make


def raw_query(make: Query) -> Query:
    """Register a query that needs the session or the driver's own tables."""
    QUERIES[make.__name__] = lambda spark, sf_dir: make(tune(spark), sf_dir)
    return make


def _no_images(df: DataFrame) -> DataFrame:
    """Images as text: urls in order."""
    return df.withColumn("images", F.array_join("images.url", " "))


# --- scans and landed payloads ------------------------------------------------------------------


@query
def scan_catalog(c: Catalog) -> DataFrame:
    return tables.table_profile(c, [
        "playlist", "playlist_track", "track", "artist", "album", "genre", "audio_features",
        "track_artist", "artist_genre", "album_artist", "album_track",
    ])


@query
def natural_key_duplicates(c: Catalog) -> DataFrame:
    return tables.natural_key_duplicates(c)


for _name in ("playlist", "artist", "album"):
    QUERIES[f"scan_{_name}"] = lambda spark, sf_dir, name=_name: _no_images(bound_catalog(tune(spark), sf_dir).table(name))
for _name in ("playlist_track", "track", "genre", "audio_features", "track_artist", "artist_genre", "album_artist", "album_track"):
    QUERIES[f"scan_{_name}"] = lambda spark, sf_dir, name=_name: bound_catalog(tune(spark), sf_dir).table(name)


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return driver_table(spark, sf_dir, "part")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed track pages; what reads them follows in their partitions, so they are not written and shuffled again."""
    return landed.track_pages(bound_catalog(spark, sf_dir), landed.album_keys(_parts(spark, sf_dir)))


@raw_query
def explode_track_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = payloads.track_page_items(_pages(spark, sf_dir))
    return items.select("playlist_key", "page_no", "position", F.col("id").alias("track_key"))


@raw_query
def compact_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.compact_tracks(payloads.track_page_items(_pages(spark, sf_dir)))


def _listing(c: Catalog) -> DataFrame:
    return payloads.listing_items(landed.listing_pages(c))


@query
def filter_playlist_listing(c: Catalog) -> DataFrame:
    return payloads.filter_listing(_listing(c), *LISTING_MARKERS).select("spotify_id", "name", "page_no", "pos")


@query
def playlists_of_user(c: Catalog) -> DataFrame:
    return payloads.playlists_of_user(landed.listing_pages(c), "2-HIGH").select("spotify_id", "name", "owner", "pos")


@query
def random_playlist(c: Catalog) -> DataFrame:
    return payloads.random_entry(payloads.filter_listing(_listing(c), *LISTING_MARKERS), seed=7).select("spotify_id", "name")


@query
def artist_payload_by_id(c: Catalog) -> DataFrame:
    one = payloads.payload_by_id(landed.artist_payloads(c), "ar7")
    return payloads.artist_rows(one).select("spotify_id", "name", "popularity", "followers")


@query
def payloads_for_ids(c: Catalog) -> DataFrame:
    found = payloads.payloads_for_ids(landed.artist_payloads(c), ingest.artists_to_refresh(c))
    return payloads.artist_rows(found).select("spotify_id", "name", "popularity", "has_popularity", "followers")


# --- merges -----------------------------------------------------------------------------------------


def _before(c: Catalog) -> Catalog:
    return landed.earlier_state(c, KNOWN_UNTIL)


def _once(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Parsed payload rows, written so that the merge does not parse them again for each use."""
    return written_stage(spark)("rows", rows)


@raw_query
def merge_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bound_catalog(spark, sf_dir)
    rows = _once(spark, payloads.playlist_rows(landed.playlist_payloads(c)))
    return _no_images(ingest.merge_playlists(_before(c).playlist, rows))


def _track_rows(spark: SparkSession, c: Catalog, sf_dir: str) -> DataFrame:
    return _once(spark, payloads.track_rows(landed.track_payloads(c, landed.album_keys(_parts(spark, sf_dir)))))


def _artist_rows(spark: SparkSession, c: Catalog) -> DataFrame:
    return _once(spark, payloads.artist_rows(landed.artist_payloads(c)))


@raw_query
def merge_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bound_catalog(spark, sf_dir)
    return ingest.merge_tracks(_before(c).track, _track_rows(spark, c, sf_dir))


@raw_query
def merge_track_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks from pages that name them differently on each place: the last place of the last playlist counts."""
    c = bound_catalog(spark, sf_dir)
    stage = written_stage(spark)
    pages_ = landed.track_pages(c, landed.album_keys(_parts(spark, sf_dir)), versions=True)
    items = stage("items", payloads.track_page_items(pages_))
    merged = ingest.merge_tracks(_before(c).track, payloads.track_columns(items))
    return merged.select("spotify_id", "name", "duration_ms", "popularity")


@raw_query
def append_track_artist_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bound_catalog(spark, sf_dir)
    return ingest.append_track_artists(_before(c).track_artist, _track_rows(spark, c, sf_dir), c.track, c.artist)


@raw_query
def ordered_track_artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artists of each track after payloads that name them in reverse: earlier links first, new ones as the payload has them."""
    c, before = bound_catalog(spark, sf_dir), _before(bound_catalog(spark, sf_dir))
    stage = written_stage(spark)
    items = stage("items", payloads.track_page_items(landed.track_pages(c, landed.album_keys(_parts(spark, sf_dir)), versions=True)))
    tracks = payloads.track_columns(items)
    links = stage("links", ingest.new_track_artists(before.track_artist, tracks, c.track, c.artist))
    places = stage("places", ingest.new_track_places(before.track_artist, links, tracks, c.track, c.artist))
    after = c.with_tables(track_artist=before.track_artist.unionByName(links), track_artist_place=places)
    return relations.track_artist_names(after)


@raw_query
def merge_artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bound_catalog(spark, sf_dir)
    mentions = ingest.artist_mentions(_track_rows(spark, c, sf_dir), ingest.FROM_TRACK)
    details = ingest.artist_details(_artist_rows(spark, c))
    return _no_images(ingest.merge_artists(_before(c).artist, mentions, details))


@raw_query
def merge_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bound_catalog(spark, sf_dir)
    return ingest.merge_genres(_before(c).genre, ingest.genre_mentions(_artist_rows(spark, c)))


@raw_query
def append_artist_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bound_catalog(spark, sf_dir)
    mentions = ingest.genre_mentions(_artist_rows(spark, c))
    return ingest.append_artist_genres(_before(c).artist_genre, mentions, c.artist, c.genre)


@query
def artists_to_refresh(c: Catalog) -> DataFrame:
    return ingest.artists_to_refresh(c, c.playlist.where(F.col("date") >= LOADED_SINCE))


@raw_query
def merge_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bound_catalog(spark, sf_dir)
    rows = _once(spark, payloads.album_rows(landed.album_payloads(c)))
    return _no_images(ingest.merge_albums(_before(c).album, rows))


def _wanted(spark: SparkSession, sf_dir: str) -> tuple[Catalog, DataFrame, DataFrame]:
    c = bound_catalog(spark, sf_dir)
    wanted = ingest.wanted_albums(c.track, _track_rows(spark, c, sf_dir))
    arrived = payloads.album_rows(payloads.payloads_for_ids(landed.album_payloads(c), wanted.select("album_key")))
    return c, wanted, arrived


@raw_query
def fill_missing_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, wanted, arrived = _wanted(spark, sf_dir)
    return ingest.fill_missing_albums(c.track, wanted, c.album, arrived).select("track_id", "spotify_id", "album_id")


@raw_query
def album_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, wanted, arrived = _wanted(spark, sf_dir)
    return ingest.album_rejects(wanted, arrived)


@raw_query
def attach_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bound_catalog(spark, sf_dir)
    rows = _once(spark, payloads.features_rows(landed.features_payloads(c)))
    return ingest.attach_audio_features(_before(c).audio_features, rows, c.track)


@raw_query
def patch_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bound_catalog(spark, sf_dir)
    rows = _once(spark, payloads.playlist_rows(landed.playlist_payloads(c)))
    return _no_images(ingest.patch_images(_before(c).playlist, rows))


@query
def delete_playlist(c: Catalog) -> DataFrame:
    after = ingest.delete_playlists(c, c.playlist.where(F.col("date") < KNOWN_UNTIL))
    return join_keeping_left(after.playlist.select("playlist_id", "name"), after.playlist_track, "playlist_id")


@query
def remove_at_position(c: Catalog) -> DataFrame:
    return relations.remove_at_position(c, c.playlist.select("playlist_id", F.lit(1).alias("position")))


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[Catalog, DataFrame]:
    c = bound_catalog(spark, sf_dir)
    stage = written_stage(spark)
    load = landed.landed_load(c, _parts(spark, sf_dir), LOADED_SINCE)
    files = {f.name: stage(f"landed_{f.name}", getattr(load, f.name)) for f in fields(load)}
    before = _before(c)
    known = {name: stage(f"known_{name}", before.table(name)) for name in ("playlist", "playlist_track", "track", "artist")}
    return ingest.ingest(before.with_tables(**known), ingest.Landed(**files), stage)


@raw_query
def ingest_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    after, _ = _ingested(spark, sf_dir)
    lists = after.playlist.select("playlist_id", F.col("spotify_id").alias("playlist_key"), "name", "date")
    songs = after.track.select("track_id", F.col("spotify_id").alias("track_key"), F.col("name").alias("track"), "album_id")
    albums = after.album.select("album_id", F.col("spotify_id").alias("album_key"))
    return (
        join_keeping_left(lists, after.playlist_track, "playlist_id").join(songs, "track_id", "left").join(albums, "album_id", "left")
        .select("playlist_key", "name", "date", "sequence", "track_key", "track", "album_key")
    )


@raw_query
def ingest_table_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    after, _ = _ingested(spark, sf_dir)
    names = ["playlist", "playlist_track", "track", "artist", "album", "genre", "audio_features", "track_artist", "artist_genre", "album_artist"]
    return tables.table_profile(after, names).select("table_name", "n_rows")


def _stored(spark: SparkSession, sf_dir: str, newest_only: bool) -> DataFrame:
    """Links of all playlists after the earlier catalogue, kept in a store, was loaded into."""
    c = bound_catalog(spark, sf_dir)
    root = _fresh_folder(spark, "store")
    kept = Store(spark, f"{root}/tables", STORE_BUCKETS)
    kept.create(_before(c))
    with Scratch(spark) as stage:
        load = landed.landed_load(c, _parts(spark, sf_dir), "1900-01-01")
        files = {f.name: stage(f.name, getattr(load, f.name)) for f in fields(load)}
        jobs.load_into(kept, StoredIndex(spark, f"{root}/index", INDEX_BUCKETS), landed.listing_pages(c), ingest.Landed(**files), list(LISTING_MARKERS), newest_only)
    after = kept.catalog()
    lists = after.playlist.select("playlist_id", F.col("spotify_id").alias("playlist_key"), "name")
    songs = after.track.select("track_id", F.col("spotify_id").alias("track_key"), F.col("name").alias("track"))
    return after.playlist_track.join(lists, "playlist_id").join(songs, "track_id").select("playlist_key", "name", "sequence", "track_key", "track")


@raw_query
def load_latest_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, True)


@raw_query
def load_all_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, False)


@query
def latest_listing_entry(c: Catalog) -> DataFrame:
    listing = payloads.filter_listing(_listing(c), *LISTING_MARKERS)
    return listing.orderBy("page_no", "pos", "spotify_id").limit(1).select("spotify_id", "name")


@query
def ingest_all_order(c: Catalog) -> DataFrame:
    """Listing entries oldest first, with the order in which they load."""
    listing = payloads.filter_listing(_listing(c), *LISTING_MARKERS).select(
        "spotify_id", "name", (F.col("page_no") * landed.LISTING_PAGE_SIZE + F.col("pos")).alias("listing_pos"), "owner"
    )
    placed = positions(
        listing, "load_seq", ["owner"], [F.desc("listing_pos")], [-F.floor(F.col("listing_pos") / 4096)]
    )
    return placed.select("spotify_id", "name", "listing_pos", "load_seq").orderBy("load_seq")


# --- relationships, projections, filters ---------------------------------------------------------------

for _make in (
    relations.playlist_tracks_outer, relations.playlist_tracklist, relations.enumerate_tracks, relations.track_playlists,
    relations.playlist_features, relations.playlist_as_df, relations.playlist_as_df_runs, relations.track_genre_pairs, relations.artist_tracks,
    relations.artist_albums, relations.genre_artists, relations.track_album, relations.track_features,
    relations.track_flat, relations.feature_records, relations.tracks_missing_album, relations.display_labels,
    search.search_doc_rows, search.track_artist_runs, search.track_artist_concat, search.search_docs,
    stats.artist_play_counts, stats.top_artists, stats.artists_min_plays, stats.play_count_histogram,
    stats.genre_track_counts, stats.top_genres, stats.gross_valence, stats.playlist_stats, stats.artist_track_counts, stats.energy_histogram,
    genres.genre_canonical, genres.genre_links_repointed, genres.genre_repair_report, genres.genre_names,
    pages.playlist_index, pages.track_links, pages.artist_page, pages.artist_page_albums, pages.genre_page,
):
    query(_make)


@query
def playlist_features_projected(c: Catalog) -> DataFrame:
    return relations.playlist_as_df(c, ["valence", "af.energy", "tempo"])


@query
def playlist_as_df_repeated(c: Catalog) -> DataFrame:
    return relations.playlist_as_df(c, "af.valence * 100 AS valence_pct, af.key", distinct_artists=False)


@query
def track_artist_concat_repeated(c: Catalog) -> DataFrame:
    return search.track_artist_concat(c, distinct_artists=False)


@query
def playlist_by_name(c: Catalog) -> DataFrame:
    return relations.playlist_by_name(c, PLAYLIST_NAME).select("playlist_id", "spotify_id", "name", "date")


@query
def playlist_name_contains(c: Catalog) -> DataFrame:
    return relations.first_with_name_part(_listing(c), "1996-06").select("spotify_id", "name")


LONG_PLAYLISTS = """
    select p.spotify_id, p.name, count(*) as n_tracks, sum(t.duration_ms) as duration_ms
    from playlist p join playlist_track pt on pt.playlist_id = p.playlist_id join track t on t.track_id = pt.track_id
    where p.date >= :since and t.popularity >= :popularity group by p.spotify_id, p.name, p.playlist_id"""


@raw_query
def sql_long_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SQL text with parameters over the catalogue's tables."""
    args = {"since": datetime.date(1996, 1, 1), "popularity": 20}
    return tables.sql_frame(spark, bound_catalog(spark, sf_dir), LONG_PLAYLISTS, "playlist", "playlist_track", "track", args=args)


@raw_query
def saved_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts and id ranges of the tables after they were saved, missing ones made empty, and read again."""
    c, folder = bound_catalog(spark, sf_dir), _fresh_folder(spark, "saved")
    sinks.save_catalog(c, folder, ["playlist", "track", "artist", "genre", "artist_genre"])
    sinks.create_tables(spark, folder)
    return tables.table_profile(tables.read_catalog(spark, folder), ["playlist", "track", "artist", "genre", "artist_genre", "album", "audio_features"])


@query
def track_json(c: Catalog) -> DataFrame:
    records = relations.track_records(c).drop("features_id")
    return timeline.record_json(records, "track_pk")


@query
def feature_json(c: Catalog) -> DataFrame:
    return timeline.record_json(relations.feature_records(c), "features_id", "track_id")


@query
def previewless_tracks(c: Catalog) -> DataFrame:
    return relations.previewless_tracks(c)


@query
def previewless_tracks_head(c: Catalog) -> DataFrame:
    return relations.previewless_tracks(c, 10)


@query
def pick_images(c: Catalog) -> DataFrame:
    images = F.col("images")
    both = c.artist.select(F.lit("artist").alias("kind"), F.col("artist_id").alias("id"), "images").unionByName(
        c.album.select(F.lit("album").alias("kind"), F.col("album_id").alias("id"), "images")
    )
    return both.select(
        "kind", "id", I.pick_image(images, 640).alias("exact_640"), I.pick_image(images, 300, min_size=1).alias("exact_300"),
        I.pick_image(images, max_size=400).alias("max_400"), I.pick_image(images, min_size=100).alias("min_100"),
        I.pick_image(images, max_size=640, min_size=100).alias("between"), I.pick_image(images, min_size=9000).alias("too_big"),
        I.pick_image(images, max_size=0).alias("first"),
    )


# --- timeline --------------------------------------------------------------------------------------------


@query
def playlist_timeline(c: Catalog) -> DataFrame:
    return timeline.timeline(c).select("playlist_id", "sequence", "track_id", "duration_ms", "start_time_ms")


@query
def flat_all(c: Catalog) -> DataFrame:
    return timeline.timeline(c, records_last=True)


@query
def flat_strict(c: Catalog) -> DataFrame:
    return timeline.timeline(c, strict=True).select("playlist_id", "sequence", "track_id", "album", "energy", "start_time_ms")


@query
def flat_head(c: Catalog) -> DataFrame:
    return timeline.flat_head(c).select("date", "playlist_id", "sequence", "track_id", "name", "start_time_ms")


@query
def flat_count(c: Catalog) -> DataFrame:
    lists = c.playlist_track.join(c.playlist.select("playlist_id"), "playlist_id", "left_semi")
    return lists.join(c.track.select("track_id"), "track_id", "left_semi").agg(F.count("*").alias("n"))


@query
def flat_by_track_name(c: Catalog) -> DataFrame:
    flat = timeline.flat_by_track_name(c, "small ring")
    return flat.select("playlist_id", "sequence", "track_id", "name", "artists", "start_time_ms")


@query
def prune_flat(c: Catalog) -> DataFrame:
    return timeline.prune_flat(timeline.timeline(c, records_last=True))


@query
def threshold_flag(c: Catalog) -> DataFrame:
    return timeline.flagged(timeline.timeline(c, records_last=True))


@query
def timeline_json(c: Catalog) -> DataFrame:
    return timeline.timeline_json(timeline.timeline(c, records_last=True))


@query
def timeline_json_arrays(c: Catalog) -> DataFrame:
    return timeline.timeline_json_arrays(timeline.timeline(c)).drop("first_position")


@query
def timeline_json_parsed(c: Catalog) -> DataFrame:
    """The JSON arrays read back."""
    arrays = timeline.timeline_json_arrays(timeline.timeline(c))
    records = F.from_json("records", "array<struct<track_id:string,name:string,date:string,key_str:string,start_time_ms:bigint,energy:double>>")
    split = arrays.select("playlist_id", "first_position", F.posexplode(records).alias("at", "r"))
    return split.select("playlist_id", (F.col("first_position") + F.col("at")).cast("int").alias("pos"), "r.*")


# --- search ------------------------------------------------------------------------------------------------


def _fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _index(spark: SparkSession, c: Catalog) -> DataFrame:
    return search.write_index(search.search_postings(search.search_docs(c)), _fresh_folder(spark, "index"), INDEX_BUCKETS)


def _stored_index(spark: SparkSession, docs: DataFrame, fields_: tuple[str, ...] = search.FIELDS) -> StoredIndex:
    index = StoredIndex(spark, _fresh_folder(spark, "index"), INDEX_BUCKETS)
    index.append(docs, "first", fields_)
    return index


def _one_search(spark: SparkSession, c: Catalog) -> DataFrame:
    return search.search(_index(spark, c), ONE_QUERY)


@query
def search_postings(c: Catalog) -> DataFrame:
    return search.search_postings(search.search_docs(c))


@raw_query
def search_index_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of the earlier playlists, to which all later playlists' tracks were added, twice by one batch."""
    c = bound_catalog(spark, sf_dir)
    early, late = F.col("date") < KNOWN_UNTIL, F.col("date") >= KNOWN_UNTIL
    index = _stored_index(spark, search.search_docs(c, playlists=c.playlist.where(early)))
    for _ in range(2):
        index.append(search.search_docs(c, playlists=c.playlist.where(late)), "late")
    return index.postings().select("token", "track_id", "field", "pos")


@raw_query
def search_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bound_catalog(spark, sf_dir)
    return search.matching_tracks(c, _one_search(spark, c))


@query
def search_tracks_scan(c: Catalog) -> DataFrame:
    return search.matching_tracks(c, search.search_scan(search.search_docs(c), ONE_QUERY))


def _name_queries(c: Catalog) -> DataFrame:
    """Every track, artist and album name as a query."""
    names = [c.table(t).select(F.concat(F.lit(f"{t} "), "name").alias("query_id"), F.col("name").alias("query")) for t in ("track", "artist", "album")]
    return names[0].unionByName(names[1]).unionByName(names[2]).distinct()


@raw_query
def search_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bound_catalog(spark, sf_dir)
    return _stored_index(spark, search.search_docs(c)).search_many(_name_queries(c))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return driver_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("track_id"), "text")


@raw_query
def search_blank_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of queries without a word (empty, blank, missing, signs only) beside one with words."""
    kind = F.substring("o_orderpriority", 1, 1)
    text = F.when(kind == "1", "").when(kind == "2", "  ").when(kind == "4", '" -').when(kind == "5", "small ring")
    asked = driver_table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("query_id"), text.alias("query")).distinct()
    hits = _stored_index(spark, search.search_docs(bound_catalog(spark, sf_dir))).search_many(asked)
    found = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    return asked.join(found, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n_hits"))


@raw_query
def document_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_postings(_documents(spark, sf_dir), ("text",)).select("track_id", "pos", "token")


@raw_query
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold all words of a benchmark passage, for every passage."""
    index = _stored_index(spark, _documents(spark, sf_dir), ("text",))
    asked = driver_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return index.search_many(asked).select("query_id", F.col("track_id").alias("doc_id"))


# --- pages ---------------------------------------------------------------------------------------------------


def _dates_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests: every ship date (some without a playlist) and every priority (no date at all)."""
    days = driver_table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy-M-d").alias("date_str"))
    words = driver_table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("date_str"))
    return days.unionByName(words).distinct()


@raw_query
def playlist_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.playlist_page(bound_catalog(spark, sf_dir), _dates_asked(spark, sf_dir), ordered=False)


@raw_query
def playlist_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page with all links; a row's artists as text, so that SQL can give them."""
    page = pages.playlist_page_rows(bound_catalog(spark, sf_dir), _dates_asked(spark, sf_dir), ordered=False)
    people = F.transform("links", lambda a: F.concat(a["id"], F.lit("="), a["name"]))
    return page.select(
        "date_str", "status", "playlist_id", "sequence", "track_id", "track_spotify_id", "preview_url", "has_preview", "artists",
        F.array_join(people, "|").alias("artist_links"))


@query
def artist_page_tracks(c: Catalog) -> DataFrame:
    return pages.artist_page_tracks(c, ordered=False)


@query
def sorted_tracks(c: Catalog) -> DataFrame:
    return pages.sorted_tracks(c, "energy", descending=True)


@query
def sorted_genre_artists(c: Catalog) -> DataFrame:
    return pages.sorted_genre_artists(c, "followers", descending=True).drop("other_genres")


@raw_query
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bound_catalog(spark, sf_dir)
    return pages.search_page(c, _one_search(spark, c))


@raw_query
def search_page_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bound_catalog(spark, sf_dir)
    return pages.search_page_playlists(c, _one_search(spark, c))
