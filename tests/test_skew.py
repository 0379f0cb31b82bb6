"""Results stay the same when one playlist, track, artist or genre holds a large share of all
rows and every join has to shuffle and split."""

import contextlib
import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from setlist.catalog import catalog_from_frames
from setlist.operators import genres, ingest, relations, search, stats, timeline
from setlist.plans import pages
from setlist.schema import CONTINUOUS_FEATURES, TABLES

SPLIT_ALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@contextlib.contextmanager
def settings(spark, values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """3,000 plays: half on playlist 0, half of track 0; artist 0 on most tracks; genre rows mostly one name."""
    rng = random.Random(2)
    plays, used = [], {}
    for _ in range(3000):
        p = 0 if rng.random() < 0.5 else rng.randrange(1, 60)
        used[p] = used.get(p, -1) + 1
        plays.append((p, 0 if rng.random() < 0.5 else rng.randrange(1, 50), used[p]))
    links = {(t, 0) for t in range(40)} | {(0, a) for a in range(30)} | {(t, rng.randrange(30)) for t in range(50)}
    values = [[round(rng.random(), 3) for _ in CONTINUOUS_FEATURES] for _ in range(50)]
    data = {
        "playlist": [(i, f"p{i}", "u", f"name {i % 7}", None, None, []) for i in range(65)],
        "playlist_track": plays,
        "track": [(i, f"t{i}", f"song {i % 9}", 1000 + i, False, i, None, "u", None, i % 4 or None) for i in range(50)],
        "artist": [(i, f"art {i % 11}", f"a{i}", "u", [], i, i) for i in range(30)],
        "album": [(i, f"al{i}", "u", f"disc {i}", None, [], 1) for i in range(1, 4)],
        "genre": [(i, "rock" if i % 3 else f"g{i}") for i in range(40)],
        "artist_genre": sorted({(0, g) for g in range(40)} | {(rng.randrange(30), rng.randrange(40)) for _ in range(60)}),
        "track_artist": sorted(links),
        "audio_features": [(i, i, None, i % 12, i % 2, 100.0 + i, 4, *values[i]) for i in range(0, 50, 2)] + [(100, 1, None, 1, 1, 90.0, 3, *values[1])],
        "album_artist": [(1, 0), (2, 1)],
    }
    folder = str(tmp_path_factory.mktemp("hot"))
    for name, table in data.items():
        # several files, so that a hot reduce partition is made of several map outputs
        spark.createDataFrame(table, TABLES[name]).repartition(4).write.parquet(f"{folder}/{name}")
    return catalog_from_frames(spark, **{name: spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}") for name in data}), data


QUERIES = {
    "timeline": timeline.timeline,
    "plays": stats.artist_play_counts,
    "genres": stats.genre_track_counts,
    "valence": stats.gross_valence,
    "summary": stats.playlist_stats,
    "outer": relations.playlist_tracks_outer,
    "as_df": relations.playlist_as_df,
    "as_df_repeated": lambda c: relations.playlist_as_df(c, distinct_artists=False),
    "features": relations.playlist_features,
    "positions": relations.enumerate_tracks,
    "removed": lambda c: relations.remove_at_position(c, c.playlist.select("playlist_id", F.lit(3).alias("position"))),
    "docs": search.search_docs,
    "doc_rows": search.search_doc_rows,
    "repair": genres.genre_links_repointed,
    "genre_page": pages.genre_page,
    "artist_tracks": pages.artist_page_tracks,
    "json": lambda c: timeline.timeline_json_arrays(timeline.timeline(c), length=100),
    "refresh": ingest.artists_to_refresh,
}


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows_when_all_joins_split(spark, hot, name):
    usual = rows(QUERIES[name](hot[0]))
    with settings(spark, SPLIT_ALL):
        split = rows(QUERIES[name](hot[0]))
    assert usual and usual == split


def test_skewed_join_is_split(spark, hot):
    with settings(spark, SPLIT_ALL):
        df = timeline.timeline(hot[0])
        df.write.format("noop").mode("overwrite").save()
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_hot_playlist_by_hand(hot):
    c, data = hot
    duration = {t[0]: t[3] for t in data["track"]}
    wanted, clock = [], {}
    for p, t, s in sorted(data["playlist_track"], key=lambda r: (r[0], r[2])):
        wanted.append((p, s, f"t{t}", clock.get(p, 0)))
        clock[p] = clock.get(p, 0) + duration[t]
    assert rows(timeline.timeline(c), "playlist_id", "sequence", "track_id", "start_time_ms") == sorted(wanted, key=repr)


def test_hot_track_plays_by_hand(hot):
    c, data = hot
    names = {a[0]: a[1] for a in data["artist"]}
    wanted = {}
    for _, t, _ in data["playlist_track"]:
        for t2, a in data["track_artist"]:
            if t2 == t:
                wanted[names[a]] = wanted.get(names[a], 0) + 1
    assert dict(rows(stats.artist_play_counts(c), "name", "count")) == wanted
