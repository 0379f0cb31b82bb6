"""Blocked group work against brute force, with one group holding most rows."""

import random

from pyspark.sql import functions as F

from helpers import rows
from setlist.operators.groups import joined_text, ordered_values, position_block, positions, positions_without, running_total
from setlist.operators.numbering import number_new_keys


def _skewed(n=600, seed=1):
    rng = random.Random(seed)
    data, next_pos = [], {}
    for _ in range(n):
        group = 0 if rng.random() < 0.6 else rng.randrange(1, 20)
        pos = next_pos.get(group, 0)
        next_pos[group] = pos + 1
        data.append((group, pos, rng.randrange(1, 50)))
    rng.shuffle(data)
    return data


def test_running_total(spark):
    data = _skewed()
    df = spark.createDataFrame(data, "g bigint, seq bigint, v bigint")
    info = spark.createDataFrame([(g, f"name {g}") for g in range(20)], "g bigint, label string")
    got = running_total(
        df, "start", F.col("v"), ["g"], [F.col("seq")], [position_block("seq", 16)], totals_from=df.select("g", "seq", "v"), group_info=info
    )
    wanted = sorted(
        ((g, s, v, f"name {g}", sum(v2 for g2, s2, v2 in data if g2 == g and s2 < s)) for g, s, v in data), key=repr
    )
    assert rows(got, "g", "seq", "v", "label", "start") == wanted


def test_positions_closes_gaps(spark):
    df = spark.createDataFrame([("a", 10), ("a", 500), ("a", 501), ("b", 7)], "g string, seq bigint")
    got = positions(df, "p", ["g"], [F.col("seq")], [position_block("seq", 4)])
    assert rows(got, "g", "seq", "p") == [("a", 10, 0), ("a", 500, 1), ("a", 501, 2), ("b", 7, 0)]


def test_ordered_values(spark):
    rng = random.Random(3)
    data = [("hot", i, f"n{i}") for i in range(300)] + [("cold", 7, None), ("cold", 3, "x"), ("none", 1, None)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, id bigint, name string")
    got = ordered_values(df, "names", ["k"], "id", F.col("name"), size=8).withColumn("text", joined_text(F.col("names"), ";"))
    found = {r["k"]: (r["names"], r["text"]) for r in got.collect()}
    assert found["hot"][0] == [f"n{i}" for i in range(300)]
    assert found["cold"] == (["x"], "x")
    assert found["none"] == ([], None)


def test_new_ids(spark):
    known = spark.createDataFrame([(41,), (7,)], "id bigint")
    keys = spark.createDataFrame([(f"k{i}",) for i in range(500)], "k string")
    first = number_new_keys(keys, "k", "id", known, digits=1)
    again = number_new_keys(keys.repartition(7), "k", "id", known, digits=1)
    assert rows(first, "k", "id") == rows(again, "k", "id")
    ids = [r["id"] for r in first.collect()]
    assert len(set(ids)) == 500 and min(ids) > 41
    empty = spark.createDataFrame([], "id bigint")
    assert min(r["id"] for r in number_new_keys(keys, "k", "id", empty, digits=1).collect()) >= 1


def test_positions_without_against_lists(spark):
    import random

    rng = random.Random(4)
    data = [(g, s, 100 * g + i) for g in range(6) for i, s in enumerate(sorted(rng.sample(range(300), 25)))]
    gone = [(g, p) for g in range(6) for p in rng.sample(range(30), 6 * g)] + [(0, 3), (0, 3), (99, 1), (1, None)]
    doomed = spark.createDataFrame(gone, "g int, position int")
    df = spark.createDataFrame(data, "g int, seq int, track int").repartition(3)
    want = []
    for g in range(6):
        left = [t for p, (_, _, t) in enumerate(r for r in data if r[0] == g) if (g, p) not in gone]
        want += [(g, p, t) for p, t in enumerate(left)]
    for size in (4, 16, 1000):
        got = positions_without(df, "p", "g", [F.col("seq")], position_block("seq", size), doomed)
        assert rows(got, "g", "p", "track") == sorted(want, key=repr)


def test_removal_numbers_the_table_once(spark, tmp_path):
    from setlist.catalog import catalog_from_frames
    from setlist.operators.relations import remove_at_position
    from setlist.schema import TABLES

    spark.createDataFrame([(p, t, t) for p in range(9) for t in range(5)], TABLES["playlist_track"]).write.parquet(str(tmp_path / "pt"))
    c = catalog_from_frames(spark, playlist_track=spark.read.parquet(str(tmp_path / "pt")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = remove_at_position(c, spark.createDataFrame([(3, 1)], "playlist_id bigint, position int"))
        assert got.count() == 44
        got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") <= 6


def test_totals_of_later_blocks_only(spark):
    data = [(1, i, 1) for i in range(10)] + [(2, i, 2) for i in range(3)]
    df = spark.createDataFrame(data, "g int, seq int, v int")
    order, block = [F.col("seq")], [position_block("seq", 4)]
    plain = running_total(df, "t", F.col("v"), ["g"], order, block)
    assert rows(running_total(df, "t", F.col("v"), ["g"], order, block, later=F.col("seq") >= 4), "g", "seq", "t") == rows(plain, "g", "seq", "t")
