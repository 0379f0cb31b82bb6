import json
import random

from pyspark.sql import functions as F

from helpers import rows
from setlist.catalog import catalog_from_frames
from setlist.operators import ingest
from setlist.operators.merge import append_missing, merge_by_key
from setlist.operators.sinks import written_stage
from setlist.schema import TABLES
from setlist.sources import payloads as P


def payload_frame(spark, objects, **extra):
    data = [(json.dumps(o), i) for i, o in enumerate(objects)]
    return spark.createDataFrame(data, "raw string, load_seq bigint")


def artist(sid, name, **more):
    return {"id": sid, "name": name, "external_urls": {"spotify": f"u/{sid}"}, **more}


def test_artist_merge_keeps_what_is_absent(spark):
    old = spark.createDataFrame([(1, "Old", "a", "u", None, 7, 70), (2, "Stay", "z", "u", None, 1, 2)], TABLES["artist"])
    landed = [
        artist("a", "A1"), artist("a", "A2", popularity=9, followers={"total": 5}), artist("a", "A3"),
        artist("b", "B", popularity=None), artist("c", "C1", popularity=3), artist("c", "C2", popularity=None), artist("d", "D"),
    ]
    parsed = ingest.artist_details(P.artist_rows(payload_frame(spark, landed)))
    got = {r["spotify_id"]: r for r in ingest.merge_artists(old, parsed).collect()}
    assert (got["a"]["artist_id"], got["a"]["name"], got["a"]["popularity"], got["a"]["followers"]) == (1, "A3", 9, 5)
    assert (got["z"]["artist_id"], got["z"]["name"], got["z"]["popularity"]) == (2, "Stay", 1)
    assert got["b"]["popularity"] is None and got["c"]["popularity"] is None and got["d"]["popularity"] is None
    assert len({r["artist_id"] for r in got.values()}) == 5 and all(got[k]["artist_id"] > 2 for k in "bcd")


def test_explicit_null_overwrites(spark):
    old = spark.createDataFrame([(1, "A", "a", "u", None, 7, 70)], TABLES["artist"])
    absent = ingest.artist_details(P.artist_rows(payload_frame(spark, [artist("a", "A")])))
    null = ingest.artist_details(P.artist_rows(payload_frame(spark, [artist("a", "A", popularity=None)])))
    assert ingest.merge_artists(old, absent).first()["popularity"] == 7
    assert ingest.merge_artists(old, null).first()["popularity"] is None


def test_full_payload_beats_mention_of_the_same_load(spark):
    tracks = spark.createDataFrame(
        [("t", 0, [("a", "mention", ("m",))])], "spotify_id string, load_seq bigint, artists array<struct<id:string,name:string,external_urls:struct<spotify:string>>>"
    )
    full = ingest.artist_details(P.artist_rows(payload_frame(spark, [artist("a", "full", popularity=4)])))
    empty = spark.createDataFrame([], TABLES["artist"])
    got = ingest.merge_artists(empty, ingest.artist_mentions(tracks, ingest.FROM_TRACK), full).first()
    assert (got["name"], got["popularity"]) == ("full", 4)


def test_random_batches_against_a_dict(spark):
    rng = random.Random(11)
    model, table = {}, spark.createDataFrame([], "id bigint, k string, a int, b int")
    for _ in range(3):
        batch = [
            (rng.choice("pqrstuv"), seq, rng.randrange(9), rng.choice([None, 1, 2]), rng.random() < 0.5) for seq in range(12)
        ]
        for k, _, a, b, has in batch:
            row = model.setdefault(k, {"b": None})
            row["a"] = a
            if has:
                row["b"] = b
        source = spark.createDataFrame(batch, "k string, load_seq int, a int, b int, has_b boolean")
        merged = merge_by_key(table, source, "k", "id", ["a"], ["b"])
        assert rows(merged, "k", "a", "b") == sorted(((k, v["a"], v["b"]) for k, v in model.items()), key=repr)
        before = dict(rows(table, "k", "id"))
        after = dict(rows(merged, "k", "id"))
        assert all(after[k] == i for k, i in before.items()) and len(set(after.values())) == len(after)
        assert rows(merge_by_key(merged, source, "k", "id", ["a"], ["b"])) == rows(merged)
        table = spark.createDataFrame(merged.collect(), merged.schema)


def test_append_missing(spark):
    old = spark.createDataFrame([(1, 1), (2, 2)], "track_id bigint, artist_id bigint")
    new = spark.createDataFrame([(1, 1), (3, 3), (3, 3), (4, None)], "track_id bigint, artist_id bigint")
    assert rows(append_missing(old, new)) == [(1, 1), (2, 2), (3, 3)]


def test_genres_by_name(spark):
    genre = spark.createDataFrame([(1, "rock"), (2, "rock"), (3, "pop")], TABLES["genre"])
    people = spark.createDataFrame([(5, "A", "a", "u", None, 1, 1)], TABLES["artist"])
    links = spark.createDataFrame([(5, 2)], TABLES["artist_genre"])
    parsed = P.artist_rows(payload_frame(spark, [artist("a", "A", genres=["rock", "pop", "pop", "jazz"]), artist("b", "B")]))
    told = ingest.genre_mentions(parsed)
    merged = ingest.merge_genres(genre, told)
    assert sorted(r["name"] for r in merged.collect()) == ["jazz", "pop", "rock", "rock"]
    new = ingest.append_artist_genres(links, told, people, merged)
    jazz = merged.where("name = 'jazz'").first()["genre_id"]
    assert rows(new, "artist_id", "genre_id") == sorted([(5, 2), (5, 3), (5, jazz)], key=repr)


def track(sid, album, artists=("x",), name=None):
    return {
        "id": sid, "name": name or f"song {sid}", "duration_ms": 1000, "explicit": False, "popularity": 1, "external_ids": {},
        "external_urls": {"spotify": "u"}, "preview_url": None, "artists": [artist(a, a.upper()) for a in artists],
        "album": {"id": album, "name": album},
    }


def landed_world(spark, playlists, pages, artists, tracks, albums):
    page_rows = [(p, n, s, json.dumps({"items": [{"track": t} for t in items]})) for p, n, s, items in pages]
    return ingest.Landed(
        playlists=payload_frame(spark, playlists),
        track_pages=spark.createDataFrame(page_rows, "playlist_key string, page_no bigint, load_seq bigint, raw string"),
        artists=payload_frame(spark, artists), tracks=payload_frame(spark, tracks), albums=payload_frame(spark, albums),
    )


def test_whole_load_and_reload(spark):
    t1, t2, t3 = track("t1", "al1", ("x", "y")), track("t2", "al2"), track("t3", "gone")
    lists = [{"id": "p", "name": "mix 2020-05-06", "description": "d", "external_urls": {"spotify": "u"}}]
    albums = [{"id": a, "name": a, "images": [], "artists": [artist("x", "X")] * 2} for a in ("al1", "al2", "unused")]
    people = [artist(a, a.upper(), popularity=1, genres=["rock"]) for a in ("x", "y")]
    load = landed_world(spark, lists, [("p", 0, 0, [t1, t2]), ("p", 1, 0, [t1, t3])], people, [t1, t2, t3], albums)
    empty = catalog_from_frames(spark)
    got, rejects = ingest.ingest(empty, load, written_stage(spark))

    plays = got.playlist_track.join(got.track, "track_id")
    assert rows(plays, "sequence", "spotify_id") == [(0, "t1"), (1, "t2"), (2, "t1"), (3, "t3")]
    assert str(got.playlist.first()["date"]) == "2020-05-06"
    named = got.track.join(got.album.select("album_id", F.col("spotify_id").alias("album")), "album_id", "left")
    assert rows(named, "spotify_id", "album") == [("t1", "al1"), ("t2", "al2"), ("t3", None)]
    assert rows(rejects, "spotify_id", "album_key") == [("t3", "gone")]
    assert sorted(r["spotify_id"] for r in got.album.collect()) == ["al1", "al2"]
    assert got.album_artist.count() == 2 and got.track_artist.count() == 4 and got.artist_genre.count() == 2

    # the same playlist again, shorter: its rows are replaced, all else stays
    again = landed_world(spark, lists, [("p", 0, 1, [t2])], people, [t1, t2, t3], albums)
    after, _ = ingest.ingest(got, again, written_stage(spark))
    assert rows(after.playlist_track.join(after.track, "track_id"), "sequence", "spotify_id") == [(0, "t2")]
    assert rows(after.track, "track_id", "spotify_id") == rows(got.track, "track_id", "spotify_id")
    assert rows(after.artist, "artist_id", "name", "popularity") == rows(got.artist, "artist_id", "name", "popularity")
    assert after.track_artist.count() == 4 and after.album_artist.count() == 2


def test_two_loads_of_a_playlist_in_one_batch(spark):
    t1, t2 = track("t1", "a"), track("t2", "a")
    items = P.track_page_items(landed_world(spark, [], [("p", 0, 0, [t1, t1, t1]), ("p", 0, 9, [t2]), ("p", 1, 9, [t1])], [], [], []).track_pages)
    known = spark.createDataFrame([(4, "p", None, "n", None, None, None)], TABLES["playlist"])
    songs = spark.createDataFrame([(1, "t1"), (2, "t2")], "track_id bigint, spotify_id string")
    old = spark.createDataFrame([(4, 1, 0), (4, 1, 1), (5, 2, 0)], TABLES["playlist_track"])
    got = ingest.replace_playlist_tracks(old, items, known, songs)
    assert rows(got, "playlist_id", "track_id", "sequence") == [(4, 1, 1), (4, 2, 0), (5, 2, 0)]


def test_features_only_for_tracks_without(spark):
    have = spark.createDataFrame([(3, 1, "u", 1, 0, 99.0, 4) + (0.5,) * 8], TABLES["audio_features"])
    songs = spark.createDataFrame([(1, "t1"), (2, "t2")], "track_id bigint, spotify_id string")
    landed = [{"id": s, "key": 5, "tempo": 120.5, "type": "x", "uri": "y", "duration_ms": 3} for s in ("t1", "t2", "t9")]
    got = ingest.attach_audio_features(have, P.features_rows(payload_frame(spark, landed)), songs)
    assert rows(got, "track_id", "key", "tempo") == [(1, 1, 99.0), (2, 5, 120.5)]


def test_delete_and_patch(spark):
    lists = spark.createDataFrame([(1, "p", None, "n", None, None, None), (2, "q", None, "m", None, None, None)], TABLES["playlist"])
    plays = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], TABLES["playlist_track"])
    c = catalog_from_frames(spark, playlist=lists, playlist_track=plays)
    after = ingest.delete_playlists(c, lists.where("name = 'n'"))
    assert rows(after.playlist, "playlist_id") == [(2,)] and rows(after.playlist_track, "playlist_id") == [(2,)]
    new = [{"id": "p", "name": "ignored", "images": [{"url": "i", "width": 1, "height": 1}]}, {"id": "new", "name": "x", "images": []}]
    patched = ingest.patch_images(lists, P.playlist_rows(payload_frame(spark, new)))
    assert rows(patched.selectExpr("spotify_id", "name", "images[0].url AS url")) == [("p", "n", "i"), ("q", "m", None)]


def test_listing(spark):
    def entry(i, name):
        return {"id": i, "name": name, "description": None, "external_urls": {}}

    pages = [(0, [entry("a", "MIX of Birds"), entry("b", "other")]), (1, [entry("c", "birds mix"), entry("a", "MIX of Birds")])]
    df = spark.createDataFrame([(n, json.dumps({"items": items, "next": None})) for n, items in pages], "page_no bigint, raw string")
    listing = P.listing_items(df)
    assert rows(P.filter_listing(listing, "mix", "BIRDS"), "spotify_id", "page_no", "pos") == [("a", 0, 0), ("c", 1, 0)]
    picks = {P.random_entry(listing, seed).first()["spotify_id"] for seed in range(20)}
    assert len(picks) > 1 and P.random_entry(listing, 3).collect() == P.random_entry(listing.repartition(3), 3).collect()
