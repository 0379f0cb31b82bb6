import random
import uuid

import pytest

from helpers import rows
from setlist.operators import search as S
from setlist.session import shared_dir

DOCS = [(1, "Björk;Foo", "Rock-n-Roll Ghost", "Alb"), (2, "Foo", "bar", "ghost rock"), (7, "rock ghost", "n roll", "x 7"),
        (8, "the rock", "n roll", None), (9, "Foo;Bar", "the the", "éclair İstanbul")]
HITS = [
    ("ghost", [1, 2, 7]), ("bjork", [1]), ("BJÖRK", [1]), ("rock-n-roll", [1]), ("rock ghost", [1, 2, 7]), ("foo bar", [2, 9]),
    ("roll ghost", [1, 7]), ("7", [7]), ("1", []), ("ro", []), ("!", []), ("foo OR bar", []), ("gho*", []), ("! ghost", [1, 2, 7]),
    ("", []), ("   ", []), ('foo"bar', [2, 9]), ("foo;bar", [9]), ("the-the", [9]), ("the the", [8, 9]), ("eclair istanbul", [9]), ("n-roll", [1, 7, 8]),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "track_id bigint, artist string, track string, album string")


@pytest.fixture(scope="module")
def index(spark, docs):
    return S.write_index(S.search_postings(docs), f"{shared_dir(spark)}/{uuid.uuid4().hex}", buckets=4)


@pytest.mark.parametrize("query, hits", HITS)
def test_one_query(docs, index, query, hits):
    assert [r[0] for r in rows(S.search(index, query, buckets=4))] == hits
    assert [r[0] for r in rows(S.search_scan(docs, query))] == hits


def test_many_queries(spark, index):
    asked = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(HITS)], "query_id bigint, query string")
    wanted = sorted(((i, h) for i, (_, hits) in enumerate(HITS) for h in hits), key=repr)
    assert rows(S.search_many(index, asked), "query_id", "track_id") == wanted


def test_random_texts_with_a_common_token(spark):
    rng = random.Random(5)
    words = ["the"] * 6 + list("abcdefgh")
    data = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))) for i in range(80)]
    texts = spark.createDataFrame(data, "track_id bigint, text string")
    queries = [" ".join("-".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 4))) for _ in range(40)]

    def brute(text, query):
        return all(f" {w.replace('-', ' ')} " in f" {text} " for w in query.split())

    asked = spark.createDataFrame(list(enumerate(queries)), "query_id bigint, query string")
    got = S.search_many(S.search_postings(texts, ("text",)), asked)
    wanted = sorted(((q, i) for q, query in enumerate(queries) for i, text in data if brute(text, query)), key=repr)
    assert rows(got, "query_id", "track_id") == wanted


def test_index_prunes_buckets(index):
    plan = S.search(index, "ghost", buckets=4)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [" in plan


def test_repeated_names_match_across_the_border(spark):
    from setlist.catalog import catalog_from_frames
    from setlist.schema import TABLES

    c = catalog_from_frames(
        spark,
        playlist=spark.createDataFrame([(1, "p", None, "n", None, None, None)], TABLES["playlist"]),
        playlist_track=spark.createDataFrame([(1, 1, 0), (1, 1, 1)], TABLES["playlist_track"]),
        track=spark.createDataFrame([(1, "t", "song", 1, False, 1, None, None, None, 1)], TABLES["track"]),
        album=spark.createDataFrame([(1, "al", None, "disc", None, None, 1)], TABLES["album"]),
        artist=spark.createDataFrame([(1, "foo", "a", None, None, 1, 1)], TABLES["artist"]),
        track_artist=spark.createDataFrame([(1, 1)], TABLES["track_artist"]),
    )
    assert S.search_docs(c).first()["artist"] == "foo"
    repeated = S.search_docs(c, distinct_artists=False)
    assert repeated.first()["artist"] == "foo;foo"
    assert rows(S.search(S.search_postings(repeated), "foo;foo")) == [(1,)]
    assert rows(S.search(S.search_postings(S.search_docs(c)), "foo;foo")) == []


@pytest.mark.parametrize("buckets", [4, 8, 64])
def test_a_stored_index_knows_its_buckets(spark, buckets):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, "delta alpha")], "track_id bigint, text string")
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    stored = S.write_index(S.search_postings(docs, ("text",)), path, buckets=buckets)
    assert [r[0] for r in rows(S.search(stored, "alpha"))] == [1, 3]
    more = S.write_index(S.search_postings(docs.where("track_id = 1"), ("text",)), path, buckets=5, mode="append")
    assert [r[0] for r in rows(S.search(more, "alpha"))] == [1, 3]
