import datetime
import json

import pytest
from pyspark.sql import functions as F

from helpers import rows
from setlist.catalog import catalog_from_frames
from setlist.operators import genres, relations, sinks, stats, timeline
from setlist.plans import pages
from setlist.schema import CONTINUOUS_FEATURES, TABLES
from setlist.sources import tables
from setlist.sources.tables import read_catalog, sql_frame


def features(track_id, key=0, mode=0, features_id=None, **values):
    row = {name: 0.5 for name in CONTINUOUS_FEATURES} | values
    return (features_id or track_id, track_id, None, key, mode, 100.0, 4, *[row[n] for n in CONTINUOUS_FEATURES])


@pytest.fixture(scope="module")
def tiny(spark):
    def table(name, data):
        return spark.createDataFrame(data, TABLES[name])

    from datetime import date

    return catalog_from_frames(
        spark,
        playlist=table("playlist", [(1, "p1", "u", "one", "", date(2020, 1, 2), []), (2, "p2", "u", "two", "d", date(2020, 1, 2), None), (3, "p3", "u", "three", None, None, [])]),
        playlist_track=table("playlist_track", [(1, 10, 0), (1, 11, 1), (1, 10, 2), (2, 12, 0)]),
        track=table("track", [
            (10, "t10", "same", 10, False, 1, None, "u", "pv", 1), (11, "t11", "same", 20, False, None, None, "u", "", None),
            (12, "t12", "other", 5, True, 3, None, "u", None, 1), (13, "t13", "unplayed", 5, True, 9, None, "u", None, 1),
        ]),
        artist=table("artist", [(1, "A", "a1", "u", [("x", 640, 640)], 5, 1234567), (2, "A", "a2", "u", [], None, 0), (3, None, "a3", "u", None, 9, None)]),
        album=table("album", [(1, "al", "u", "disc", None, [("s", 300, 300)], 1)]),
        genre=table("genre", [(1, "rock"), (2, "pop"), (3, "rock"), (4, None), (5, None)]),
        artist_genre=table("artist_genre", [(1, 1), (1, 3), (1, 2), (2, 3), (3, 4), (3, 5)]),
        track_artist=table("track_artist", [(10, 1), (10, 2), (11, 3), (12, 2), (13, 1)]),
        album_artist=table("album_artist", [(1, 1)]),
        audio_features=table("audio_features", [features(10, key=-1), features(10, key=5, features_id=99), features(12, mode=1, valence=None)]),
    )


def test_plays_merge_namesakes(tiny):
    assert rows(stats.artist_play_counts(tiny), "name", "count") == sorted([("A", 5), (None, 1)], key=repr)
    assert rows(stats.play_count_histogram(tiny)) == [(1, 0), (5, 1)]


def test_genre_counts(tiny):
    # 10 counts through both artists, artist 1 holds rock twice; the nameless genre drops out
    assert rows(stats.genre_track_counts(tiny)) == [("pop", 2), ("rock", 6)]


def test_track_counts_keep_zero(spark, tiny):
    lonely = tiny.with_tables(track_artist=spark.createDataFrame([(10, 1)], TABLES["track_artist"]))
    assert rows(stats.artist_track_counts(lonely), "artist_id", "tracks") == [(1, 1), (2, 0), (3, 0)]


def test_timeline(tiny):
    flat = timeline.timeline(tiny)
    got = rows(flat, "playlist_id", "sequence", "track_id", "start_time_ms", "album", "artists", "key_str", "date")
    assert got == [
        (1, 0, "t10", 0, "disc", "A, A", "B", "2020-01-02"), (1, 1, "t11", 10, None, "", "", "2020-01-02"),
        (1, 2, "t10", 30, "disc", "A, A", "B", "2020-01-02"), (2, 0, "t12", 0, "disc", "A", "C", "2020-01-02"),
    ]
    assert rows(timeline.timeline(tiny, strict=True), "playlist_id", "sequence", "start_time_ms") == [(1, 0, 0), (1, 2, 30), (2, 0, 0)]
    one = timeline.timeline(tiny, tiny.playlist.where("name = 'two'"))
    assert rows(one, "playlist_id", "track_id") == [(2, "t12")]


def test_start_times_follow_each_other(bound):
    from pyspark.sql import Window

    w = Window.partitionBy("playlist_id").orderBy("sequence")
    flat = timeline.timeline(bound).withColumn("next", F.lead("start_time_ms").over(w))
    assert flat.where("next is not null and next <> start_time_ms + duration_ms").count() == 0


def test_json(tiny):
    arrays = {r["playlist_id"]: json.loads(r["records"]) for r in timeline.timeline_json_arrays(timeline.timeline(tiny)).collect()}
    assert [x["track_id"] for x in arrays[1]] == ["t10", "t11", "t10"]
    assert arrays[1][1]["album"] is None and arrays[1][2]["start_time_ms"] == 30 and arrays[1][0]["month"] == 1
    parts = timeline.timeline_json_arrays(timeline.timeline(tiny), length=2).where("playlist_id = 1").orderBy("part").collect()
    assert [len(json.loads(p["records"])) for p in parts] == [2, 1]
    assert len(timeline.timeline_json(timeline.timeline(tiny)).collect()) == 4


def test_playlist_as_df(tiny):
    got = {r["name"]: r for r in relations.playlist_as_df(tiny, ["valence", "af.key"]).collect()}
    assert set(got) == {"same", "other"} and got["same"]["artist"] == "A;A" and got["same"]["key"] == -1
    repeated = {r["name"]: r for r in relations.playlist_as_df(tiny, "af.key + 1 AS up, concat(t.name, ',') AS label", distinct_artists=False).collect()}
    assert repeated["same"]["artist"] == "A;A;A;A;A;A;A;A" and repeated["same"]["up"] == 0 and repeated["other"]["label"] == "other,"
    with pytest.raises(ValueError):
        relations.playlist_as_df(tiny, ["nope"])


def test_playlist_stats(tiny):
    got = {r["playlist_id"]: r for r in stats.playlist_stats(tiny).collect()}
    assert (got[1]["key"], got[1]["mode"], got[1]["pair_key"], got[1]["pair_mode"]) == (-1, 0, -1, 0)
    assert got[2]["valence"] == 0.0 and got[2]["energy"] == 2.5


def test_genre_repair(tiny):
    fixed = genres.repair_genres(tiny)
    assert rows(fixed.genre, "genre_id", "name") == sorted([(1, "rock"), (2, "pop"), (4, None)], key=repr)
    assert rows(fixed.artist_genre, "artist_id", "genre_id") == [(1, 1), (1, 2), (2, 1), (3, 4)]
    assert rows(genres.genre_repair_report(tiny)) == [(3, 5, 3)]
    assert rows(genres.genre_repair_report(fixed)) == [(3, 3, 3)]


def test_genre_page_takes_the_first_row_of_a_name(tiny):
    got = pages.genre_page(tiny).collect()
    assert [(r["genre"], r["artist_id"], r["other_genres"], r["followers"]) for r in got] == [
        ("pop", 1, "rock; rock", "1,234,567"), ("rock", 1, "pop", "1,234,567"),
    ]


def test_playlist_page(spark, tiny):
    asked = spark.createDataFrame([("2020-1-2",), ("2020-1-3",), ("nonsense",)], "date_str string")
    got = rows(pages.playlist_page(tiny, asked), "date_str", "status", "playlist_id", "sequence", "track", "has_description")
    assert got == sorted([
        ("2020-1-2", "ok", 1, 0, "same", False), ("2020-1-2", "ok", 1, 1, "same", False), ("2020-1-2", "ok", 1, 2, "same", False),
        ("2020-1-2", "ok", 2, 0, "other", True), ("2020-1-3", "not found", None, None, None, None), ("nonsense", "invalid", None, None, None, None),
    ], key=repr)


def test_playlist_page_rows(spark, tiny):
    asked = spark.createDataFrame([("2020-1-2",), ("2020-1-3",)], "date_str string")
    page = pages.playlist_page_rows(tiny, asked)
    got = {(r["playlist_id"], r["sequence"]): (r["track_spotify_id"], r["preview_url"], r["links"], r["artists"]) for r in page.collect()}
    assert got == {
        (1, 0): ("t10", "pv", [("a1", "A"), ("a2", "A")], "A, A"), (1, 1): ("t11", "", [("a3", None)], ""),
        (1, 2): ("t10", "pv", [("a1", "A"), ("a2", "A")], "A, A"), (2, 0): ("t12", None, [("a2", "A")], "A"),
        (None, None): (None, None, None, None),
    }
    alone = tiny.with_tables(track_artist=tiny.track_artist.limit(0), playlist_track=tiny.playlist_track.where("playlist_id = 1"))
    got = {(r["playlist_id"], r["sequence"]): (r["status"], r["links"], r["artists"]) for r in pages.playlist_page_rows(alone, asked).collect()}
    assert got == {(1, 0): ("ok", [], ""), (1, 1): ("ok", [], ""), (1, 2): ("ok", [], ""), (2, None): ("ok", None, None), (None, None): ("not found", None, None)}


def _final_plan(df):
    """The plan as it was run, without the one that was planned first."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_timeline_reads_the_plays_once(bound):
    plan = _final_plan(timeline.timeline(bound).select("playlist_id", "sequence", "track_id", "duration_ms", "start_time_ms"))
    assert plan.count("lineitem.parquet") == 1 and plan.count("Exchange hashpartitioning") <= 5


def test_page_reads_the_plays_twice(spark, bound):
    # rows and keys of the plays, and the links of tracks and artists
    asked = spark.createDataFrame([("1996-06-06",)], "date_str string")
    assert _final_plan(pages.playlist_page_rows(bound, asked)).count("lineitem.parquet") <= 3


def test_artist_page(spark, tiny):
    one = spark.createDataFrame([("a1",)], "spotify_id string")
    head = pages.artist_page(tiny, one).collect()
    assert [(r["artist_id"], r["image_url"], r["followers"], r["genres"]) for r in head] == [(1, "x", "1,234,567", "rock, pop, rock")]
    assert rows(pages.artist_page_tracks(tiny, one), "track_id", "has_preview", "key") == [(10, True, "B major"), (13, False, " ")]
    assert rows(pages.artist_page_albums(tiny, one), "album_id", "image_url") == [(1, None)]


def test_sorted_tracks(tiny):
    down = [r["track_id"] for r in pages.sorted_tracks(tiny, "popularity", descending=True).collect()]
    assert down == [13, 12, 10, 11]
    assert [r["track_id"] for r in pages.sorted_tracks(tiny, "track").collect()] == [12, 10, 11, 13]
    with pytest.raises(ValueError):
        pages.sorted_tracks(tiny, "has_preview")


def test_search_page(spark, tiny):
    hits = spark.createDataFrame([(10,), (11,)], "track_id bigint")
    assert rows(pages.search_page(tiny, hits), "track_id", "artists", "album", "image_url", "has_preview") == [
        (10, "A; A", "disc", "s", True), (11, "", None, None, False),
    ]
    assert rows(pages.search_page_playlists(tiny, hits), "track_id", "playlist_id", "sequence") == [(10, 1, 0), (10, 1, 2), (11, 1, 1)]


def test_remove_at_position(spark, tiny):
    doomed = spark.createDataFrame([(1, 1), (2, 5)], "playlist_id bigint, position bigint")
    assert rows(relations.remove_at_position(tiny, doomed), "playlist_id", "sequence", "track_id") == [(1, 0, 10), (1, 1, 10), (2, 0, 12)]


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(0.5,), (0.5,), (None,)], "x double")
    got = stats.histogram(df, "x").collect()
    assert sum(r["count"] for r in got) == 2


def test_sql_frame(spark, tiny):
    got = sql_frame(spark, tiny, "select name, count(*) as n from track group by name", "track")
    assert ("same", 2) in rows(got)


def test_round_trip(spark, tiny, tmp_path):
    folder = str(tmp_path / "v1")
    sinks.save_catalog(tiny, folder)
    back = read_catalog(spark, folder)
    for name in TABLES:
        assert rows(back.table(name)) == rows(tiny.table(name)), name
    with pytest.raises(Exception):
        sinks.save_catalog(tiny, folder)


def test_create_tables(spark, tmp_path):
    folder = str(tmp_path / "db")
    sinks.create_tables(spark, folder)
    sinks.create_tables(spark, folder)
    assert all(read_catalog(spark, folder).table(name).count() == 0 for name in TABLES)


def test_write_json(spark, tiny, tmp_path):
    folder = str(tmp_path / "json")
    sinks.write_json(timeline.timeline(tiny), folder)
    assert spark.read.json(folder).count() == 4


def test_json_positions_do_not_depend_on_the_array_length(tiny):
    flat = timeline.timeline(tiny)
    def positions(length):
        parts = timeline.timeline_json_arrays(flat, length=length).collect()
        return sorted((r["playlist_id"], r["first_position"] + i) for r in parts for i in range(len(json.loads(r["records"]))))
    assert positions(1) == positions(2) == positions(10_000)


def test_sql_with_parameters_leaves_no_views(spark, bound):
    text = "select count(*) as n from playlist where date >= :since and description = :kind"
    got = tables.sql_frame(spark, bound, text, "playlist", args={"since": datetime.date(1996, 1, 1), "kind": "2-HIGH"})
    want = bound.playlist.where("date >= date'1996-01-01' and description = '2-HIGH'").count()
    assert got.first()["n"] == want > 0
    assert not spark.catalog.tableExists("playlist")
    with pytest.raises(Exception):
        tables.sql_frame(spark, bound, "select nothing from playlist", "playlist")
    assert not spark.catalog.tableExists("playlist")  # also after a text that fails
    spark.range(1).createOrReplaceTempView("playlist")
    try:
        with pytest.raises(ValueError, match="named playlist"):
            tables.sql_frame(spark, bound, text, "playlist")
        assert spark.table("playlist").columns == ["id"]
    finally:
        spark.catalog.dropTempView("playlist")


def test_runs_are_the_repeated_text(spark, bound):
    runs = relations.playlist_as_df_runs(bound).collect()
    texts = {}
    for r in sorted(runs, key=lambda r: (r["name"], r["artist_id"])):
        texts.setdefault(r["name"], []).extend([r["artist"]] * r["times"])
    got = relations.playlist_as_df(bound, ["valence"], distinct_artists=False).collect()
    assert {r["name"]: r["artist"] for r in got} == {name: ";".join(names) for name, names in texts.items()}


def test_link_rows_of_tracks_without_artist_or_album(spark):
    c = catalog_from_frames(
        spark,
        track=spark.createDataFrame([(1, "a", "A", 1, True, 1, "i", "u", "", None), (2, "b", "B", 1, True, 1, "i", "v", "p", 5)], TABLES["track"]),
        artist=spark.createDataFrame([(8, "X", "x", "u", None, 1, 10), (7, "Y", "y", "u", None, None, 2000)], TABLES["artist"]),
        track_artist=spark.createDataFrame([(2, 8), (2, 7)], TABLES["track_artist"]),
        genre=spark.createDataFrame([(1, "rock")], TABLES["genre"]),
        artist_genre=spark.createDataFrame([(7, 1), (8, 1)], TABLES["artist_genre"]),
    )
    got = rows(pages.track_links(c), "track_id", "preview_url", "has_preview", "has_album", "place", "artist_spotify_id")
    assert got == sorted([(1, "", False, False, None, None), (2, "p", True, True, 0, "y"), (2, "p", True, True, 1, "x")], key=repr)
    for column, down, order in (("followers", True, ["Y", "X"]), ("followers", False, ["X", "Y"]), ("popularity", False, ["X", "Y"]), ("name", True, ["Y", "X"])):
        assert [r["name"] for r in pages.sorted_genre_artists(c, column, down).collect()] == order
    with pytest.raises(ValueError):
        pages.sorted_genre_artists(c, "other_genres")


def test_page_of_a_date_without_playlists(spark, bound):
    asked = spark.createDataFrame([("1996-06-06",), ("1900-1-1",), ("nonsense",), (None,)], "date_str string")
    got = {r["date_str"]: r["status"] for r in pages.playlist_page(bound, asked).select("date_str", "status").distinct().collect()}
    assert got["1900-1-1"] == "not found" and got["nonsense"] == "invalid" and got[None] == "invalid"


def test_json_records_write_nulls(spark):
    df = spark.createDataFrame([(1, None, 0.5, "é\"")], "k int, a int, b double, c string")
    assert timeline.record_json(df, "k").first()["record"] == '{"a":null,"b":0.5,"c":"é\\""}'
