"""What written stages leave on disk."""

import os
import time

from pyspark.sql import functions as F

from setlist.llm.common import CLEANUP_SETTING, scratch_dir, written
from setlist.llm.jaccard_join import near_duplicates


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {name for name in blocks.mkString(" ").split() if name.startswith("shuffle_")}


def test_written_stage_leaves_no_shuffle_files(spark):
    rows = spark.range(10_000).withColumn("key", F.col("id") % 100)
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    setting, before = spark.conf.get(CLEANUP_SETTING, None), shuffle_files(spark)
    out = written(rows.join(counts, "key").repartition(3, "key"), "dealt")
    for _ in range(50):  # Spark removes them in the background
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(CLEANUP_SETTING, None) == setting
    assert out.count() == 10_000 and {r["n"] for r in out.select("n").collect()} == {100}


def test_stages_that_nothing_reads_any_more_are_removed(spark, make_docs):
    folder = scratch_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    words = [f"w{i}" for i in range(200)]
    data = [(i, " ".join([*words, f"end{i % 4}"]), "en", "a") for i in range(12)]
    found = near_duplicates(make_docs(data))
    assert {r["component_id"] for r in found.collect()} == {0} and found.count() == 12
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert {"jaccard-rows", "jaccard-sketches"} <= left
    assert not left & {"jaccard-filter", "jaccard-keys", "jaccard-met", "jaccard-members", "jaccard-leaders0", "jaccard-pairs-0", "jaccard-sets-0"}
