"""Plans and rows of the jobs that were reshaped for larger tables."""

import json
import time

from pyspark.sql import functions as F

from helpers import SF, rows
from setlist.operators import groups, ingest, relations, search, timeline
from setlist.operators.index import StoredIndex
from setlist.operators.sinks import Scratch
from setlist.plans.registry import QUERIES
from setlist.session import CLEANUP_SETTING, tune
from setlist.sources import landed, payloads
from setlist.sources.binding import driver_table


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _below(plan, mark):
    """Plan lines below the first line with the mark."""
    lines = plan.split("\n")
    at = next(i for i, line in enumerate(lines) if mark in line)
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-"))
    out = []
    for line in lines[at + 1:]:
        if len(line) - len(line.lstrip(" :+-")) <= depth:
            break
        out.append(line)
    return out


def test_records_come_after_the_start_times(bound):
    late = timeline.timeline(bound, records_last=True)
    assert late.columns == timeline.timeline(bound).columns
    assert rows(late) == rows(timeline.timeline(bound))
    assert not any("array_join" in line for line in _below(_plan(late), "Window [sum("))


def test_records_last_with_tracks_twice(bound):
    few = bound.playlist.where("playlist_id < 40")
    twice = bound.with_tables(track=bound.track.unionByName(bound.track), playlist=few.unionByName(few))
    columns = ["playlist_id", "sequence", "track_id", "start_time_ms"]
    assert rows(timeline.timeline(twice, few, records_last=True), *columns) == rows(timeline.timeline(twice, few), *columns)


def test_flat_queries_take_records_last(spark):
    for name in ("threshold_flag", "prune_flat", "flat_all", "timeline_json"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "_nth" in plan, name


def test_page_texts_are_the_payloads(spark, bound):
    odd = bound.with_tables(track=bound.track.withColumn(
        "name", F.when(F.col("track_id") % 3 == 0, F.lit(None)).when(F.col("track_id") % 3 == 1, F.concat(F.col("name"), F.lit('"\\ é\n'))).otherwise(F.col("name"))))
    albums = landed.album_keys(driver_table(spark, SF, "part"))
    wanted = {r["track_id"]: r["text"] for r in landed.track_objects(odd, albums).select("track_id", F.to_json("track", {"ignoreNullFields": "false"}).alias("text")).collect()}
    plays = {}
    for r in odd.playlist_track.where("playlist_id < 60").collect():
        plays.setdefault((r["playlist_id"], r["sequence"] // landed.PAGE_SIZE), []).append((r["sequence"], json.loads(wanted[r["track_id"]])))
    for versions in (False, True):
        pages = landed.track_pages(odd, albums, odd.playlist.where("playlist_id < 60"), versions=versions).collect()
        assert {(p["load_seq"], p["page_no"]) for p in pages} == set(plays)
        for p in pages:
            items = []
            for sequence, track in sorted(plays[p["load_seq"], p["page_no"]], key=lambda x: x[0]):
                if versions:
                    track = {**track, "name": track["name"] and f"{track['name']} @{sequence}", "artists": track["artists"][::-1]}
                items.append({"track": track})
            assert json.loads(p["raw"]) == {"items": items, "next": f"page/{p['page_no'] + 1}"}


def test_page_items_follow_in_the_partitions_of_their_pages(spark, bound):
    pages = landed.track_pages(bound, landed.album_keys(driver_table(spark, SF, "part")))
    plan = _plan(payloads.track_page_items(pages))
    below = _below(plan, "Window [sum(n_items")
    first = next(i for i, line in enumerate(below) if "collect_list" in line and "Window" in line)
    assert not any("Exchange" in line for line in below[:first])
    exchange = next(line for line in below[first:] if "Exchange" in line)
    assert "REPARTITION_BY_COL" in exchange


def test_parsed_pages_are_not_sorted(spark, bound):
    pages = landed.track_pages(bound, landed.album_keys(driver_table(spark, SF, "part")))
    below = _below(_plan(payloads.track_page_items(pages)), "Window [sum(n_items")
    parsed = next(i for i, line in enumerate(below) if "from_json" in line)
    assert not any("Sort [" in line for line in below[:parsed])


def test_stages_of_a_load_leave_no_shuffle_files(spark, tmp_path):
    def files():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {name for name in blocks.mkString(" ").split() if name.startswith("shuffle_")}

    before, setting = files(), spark.conf.get(CLEANUP_SETTING, None)
    kept = spark.range(1000).withColumn("key", F.col("id") % 10).repartition(3, "key")
    out = Scratch(spark, str(tmp_path))("rows", kept)
    for _ in range(50):  # Spark removes them in the background
        left = files() - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(CLEANUP_SETTING, None) == setting
    assert out.count() == 1000


def test_only_the_last_loads_mentions_count(spark):
    artist = "array<struct<id:string,name:string,external_urls:struct<spotify:string>>>"
    mention = lambda name: ("a1", name, ("u",))
    tracks = spark.createDataFrame(
        [("t1", 1, (1, "p1", 0), [mention("first")]), ("t2", 2, (2, "p2", 0), [mention("x"), mention("y")]), ("t2", 2, (2, "p2", 1), [mention("last")]),
         ("t3", 1, (1, "p1", 1), [("a2", "other", ("v",))])],
        f"spotify_id string, load_seq bigint, load_order struct<load_seq:bigint,source:string,position:bigint>, artists {artist}")
    said = ingest.artist_mentions(tracks, ingest.FROM_TRACK)
    assert sorted(r["name"] for r in said.collect()) == ["last", "other", "x", "y"]


def test_features_join_playlists_first(bound):
    plan = relations.plays_with_features(bound)._jdf.queryExecution().optimizedPlan().toString()
    assert "track_id" in next(line for line in plan.split("\n") if "Join Inner" in line)


def test_words_of_one_token_make_no_places(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red red red blue"), (2, "red-blue"), (3, "blue red"), (4, "red")], "track_id bigint, text string")
    index = StoredIndex(spark, str(tmp_path / "index"), 2)
    index.append(docs, "one", ("text",))
    asked = spark.createDataFrame([("q1", "red blue"), ("q2", "red-blue"), ("q3", "red"), ("q4", "red-blue red"), ("q5", "green red")], "query_id string, query string")
    found = index.search_many(asked)
    assert rows(found) == [("q1", 1), ("q1", 2), ("q1", 3), ("q2", 1), ("q2", 2), ("q3", 1), ("q3", 2), ("q3", 3), ("q3", 4), ("q4", 1), ("q4", 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "(n_tokens" in plan and plan.count("= 1)") >= 1


def test_postings_are_not_broadcast(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red blue"), (2, "red-blue"), (3, "blue")], "track_id bigint, text string")
    index = StoredIndex(spark, str(tmp_path / "index"), 2)
    index.append(docs, "one", ("text",))
    asked = spark.createDataFrame([("q1", "red blue"), ("q2", "red-blue")], "query_id string, query string")
    found = index.search_many(asked)
    lines = _plan(found).split("\n")
    marks = [i for i, line in enumerate(lines) if "BroadcastExchange" in line]
    assert sum("SortMergeJoin" in line for line in lines) >= 3
    assert not any("track_id" in line for i in marks for line in _below("\n".join(lines[i:]), "BroadcastExchange"))
    assert rows(found) == [("q1", 1), ("q1", 2), ("q2", 1), ("q2", 2)]


def test_repeated_texts_are_written_out_last(bound):
    plan = _plan(relations.playlist_as_df(bound, "af.key", distinct_artists=False)).replace("== Initial Plan ==", "")
    lines = plan.split("\n")
    made = [i for i, line in enumerate(lines) if "repeat(" in line]
    first = next(i for i, line in enumerate(lines) if "Join" in line or "Exchange" in line)
    assert made and max(made) < first
    plan = _plan(search.track_artist_concat(bound, distinct_artists=False))
    below = [line for at in [plan.find("Exchange")] for line in plan[at:].split("\n")]
    assert not any("repeat(" in line for line in below)


def test_repeated_texts_are_spread_over_tasks(bound):
    told = relations.playlist_as_df(bound, "af.key", distinct_artists=False).select("name", F.spark_partition_id().alias("task"))
    tasks = [r["task"] for r in told.collect()]
    assert len(tasks) > 20 and max(tasks.count(t) for t in tasks) <= 4


def test_repeated_text_of_runs(spark):
    runs = spark.createDataFrame([(1, 10, "a", 2), (1, 3, "b", 1), (1, 7, None, 4), (1, 4, "", 2), (2, 1, None, 1)], "k int, id long, name string, times long")
    got = groups.ordered_values(runs, "r", ["k"], "id", groups.repeated_value(F.col("name"), F.col("times")))
    assert rows(got.select("k", groups.repeated_text(F.col("r"), ";").alias("text"))) == [(1, "b;;;a;a"), (2, None)]


def test_merged_partitions_stay_small(spark):
    key, fresh = "spark.sql.adaptive.advisoryPartitionSizeInBytes", spark.newSession()
    assert tune(fresh).conf.get(key) == "16m"
    fresh.conf.set(key, "8m")
    assert tune(fresh).conf.get(key) == "8m"
