"""Rows keep their ids when Spark cuts the input's files otherwise in each pass, as after a lost executor."""

import glob
import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from setlist.llm import common, decontaminate, exact_dedup, jaccard_join, lm_score

PASSAGE = " ".join(f"item{i}" for i in range(30))


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(n))


@pytest.fixture
def table(spark, make_docs, tmp_path, monkeypatch):
    """A table of some files; after every written stage its files are dealt to other partitions."""
    data = []
    for i in range(150):
        text = prose(i // 3, 40)
        if i % 3 == 2:
            text += " more words" if i % 2 else f" {PASSAGE}"
        data.append((i, text, "en", "a"))
    path = str(tmp_path / "documents.parquet")
    make_docs(data).repartition(12, "doc_id").write.parquet(path)
    size = max(map(os.path.getsize, glob.glob(f"{path}/*.parquet")))
    sizes = iter([str(128 << 20), str(size)] * 500)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)

    def deal_anew():
        spark.conf.set(key, next(sizes))

    def written(df, name):
        out = common_written(df, name)
        deal_anew()
        return out

    common_written = common.written
    for module in (common, decontaminate, exact_dedup, jaccard_join, lm_score):
        monkeypatch.setattr(module, "written", written)
    deal_anew()
    yield data, spark.read.parquet(path)
    spark.conf.set(key, before)


def ids(frame, spark, flip):
    """The ids in both ways of dealing the input to the lazily read result."""
    found = []
    for size in flip:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        found.append(sorted(r["doc_id"] for r in frame.select("doc_id").collect()))
    assert found[0] == found[1]
    return found[0]


FLIP = (str(128 << 20), "6000")


def test_exact_copies(spark, table):
    data, docs = table
    first = {}
    for i, text, *_ in data:
        first.setdefault(text, i)
    assert ids(exact_dedup.drop_copies(docs), spark, FLIP) == sorted(first.values())


def test_near_copies(spark, table):
    data, docs = table
    found = jaccard_join.near_duplicates(docs).collect()
    heads = sorted({r["component_id"] for r in found})
    assert len(found) == len(data) and set(range(0, 150, 3)) <= set(heads) and len(heads) < 150
    assert ids(jaccard_join.keep_one(docs), spark, FLIP) == heads


def test_passages(spark, table):
    data, docs = table
    benchmark = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    leaking = sorted(i for i, text, *_ in data if PASSAGE in text)
    assert ids(decontaminate.find_leaks(docs, benchmark), spark, FLIP) == leaking
    assert ids(decontaminate.clean_documents(docs, benchmark), spark, FLIP) == sorted(set(range(150)) - set(leaking))


def test_scores(spark, table):
    data, docs = table
    count = Counter(w for _, text, *_ in data for w in [*text.split(), None])
    total, distinct = sum(count.values()), len(count)
    for first, second in (FLIP, FLIP[::-1]):
        spark.conf.set("spark.sql.files.maxPartitionBytes", first)
        scored = lm_score.score_texts(docs, F.lit(False))
        spark.conf.set("spark.sql.files.maxPartitionBytes", second)
        found = scored.collect()
        assert sorted(r["doc_id"] for r in found) == list(range(150))
        for r in found:
            alone = [(count[w] + 1) / (total + distinct + 1) for w in [*data[r["doc_id"]][1].split(), None]]
            assert math.isclose(r["base_score"], sum(map(math.log10, alone)), rel_tol=1e-9)
