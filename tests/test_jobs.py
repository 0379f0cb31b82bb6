import json

from helpers import rows
from setlist.catalog import catalog_from_frames
from setlist.operators import search as S
from setlist.plans import jobs
from setlist.schema import TABLES
from test_merge import artist, landed_world, track


def test_listing_order_of_a_page_with_very_many_items(spark):
    load = landed_world(spark, [{"id": "a"}, {"id": "b"}], [("a", 0, 0, []), ("b", 0, 0, [])], [], [], [])
    listing = spark.createDataFrame([("a", 0, 1_000_001), ("b", 1, 0)], "spotify_id string, page_no bigint, pos int")
    order = {r["playlist_key"]: r["load_seq"] for r in jobs.in_listing_order(load, listing).track_pages.collect()}
    assert order["b"] < order["a"]  # b is further down the listing, so older, and applies first


def test_load_latest_then_all(spark, tmp_path):
    t1, t2, t3 = track("t1", "al"), track("t2", "al"), track("t3", "al", name="newest name")
    old3 = track("t3", "al", name="older name")

    def head(i, name):
        return {"id": i, "name": name, "description": None, "external_urls": {}}

    heads = [head("p1", "Mix 2020-01-01 club"), head("p2", "MIX 2020-02-02 Club"), head("p3", "unrelated")]
    listing = spark.createDataFrame(
        [(0, json.dumps({"items": [heads[2], heads[1]], "next": "x"})), (1, json.dumps({"items": [heads[0]], "next": None}))], "page_no bigint, raw string"
    )
    pages = [("p1", 0, 0, [t1, old3]), ("p2", 0, 0, [t2, t3]), ("p3", 0, 0, [t1])]
    albums = [{"id": "al", "name": "Disc", "images": []}]
    load = landed_world(spark, heads, pages, [artist("x", "Xenia", popularity=1, genres=["rock"])], [t1, t2, t3], albums)

    first, rejects = jobs.load_latest(spark, catalog_from_frames(spark), listing, load, ["mix", "club"], str(tmp_path / "v1"))
    assert rows(first.playlist, "spotify_id") == [("p2",)] and rejects.count() == 0
    index = S.read_index(spark, str(tmp_path / "v1" / "search_index"))
    hits = S.matching_tracks(first, S.search(index, "xenia newest"))
    assert rows(hits, "spotify_id") == [("t3",)]

    second, _ = jobs.load_all(spark, first, listing, load, ["mix", "club"], str(tmp_path / "v2"))
    assert rows(second.playlist, "spotify_id") == [("p1",), ("p2",)]
    # p2 is newer than p1, so its track payload applies last
    assert dict(rows(second.track, "spotify_id", "name"))["t3"] == "newest name"
    assert second.playlist_track.count() == 4

    twice = second.with_tables(genre=second.genre.union(spark.createDataFrame([(10**6, "rock")], TABLES["genre"])))
    fixed = jobs.repair(spark, twice, str(tmp_path / "v3"))
    assert fixed.genre.count() == 1 and fixed.artist_genre.count() == 1
