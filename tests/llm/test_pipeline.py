"""The pipeline's stages and the whole of it on planted rows."""

import random

import pytest

import corpus_pipeline as cp
from setlist.llm import common

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy int, doc string, key long"
WORDS = {lang: [f"{a}{b}{c}" for a in heads for b in "aeiou" for c in tails] for lang, heads, tails in (
    ("aa", ["str", "kl", "fr", "ght"], ["nd", "rk", "lt"]), ("bb", ["mi", "lo", "za", "que"], ["no", "ta", "via"]))}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Documents by kind, and the folder with their tables."""
    rng = random.Random(8)
    clean = [(i, prose(rng, "aa" if i % 2 else "bb", 60), "aa" if i % 2 else "bb") for i in range(1, 41)]
    item = prose(rng, "aa", 30)
    exact = [(100 + i, clean[i][1].replace(" ", "  "), None) for i in range(5)]  # longer, so these stay
    near = [(200 + i, clean[10 + i][1] + " kland", None) for i in range(5)]
    leaks = [(300 + i, f"{prose(rng, 'aa', 20)} {item} {prose(rng, 'aa', 20)}", "aa") for i in range(4)]
    strange = [(400, "ωψξζ ψωξζ", None), (401, "123 456 -- 789", None), (402, None, "aa"), (403, " \n", None), (404, "", "bb")]
    rows = [(i, t, lang, f"src{i % 5}" if i % 7 else None, None if t is None else len(t), 7, "own", 5) for i, t, lang in clean + exact + near + leaks + strange]
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    ids = {"clean": {c[0] for c in clean}, "exact": {c[0] for c in exact}, "near": {c[0] for c in near}, "leaks": {c[0] for c in leaks}}
    return folder, ids, rows


def step(spark, folder, k, docs):
    return cp.STAGES[k][1](spark, docs, folder)


def ids_of(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_each_stage_and_the_whole(spark, planted, tmp_path):
    folder, ids, rows = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {r[0] for r in rows}
    # what each stage takes away, told from how the rows were made
    gone = [{400, 401, 402, 403, 404}, {i + 1 for i in range(5)}, {200 + i for i in range(5)}, ids["leaks"]]
    scratch = common.scratch_dir(spark)
    for k, lost in enumerate(gone):
        kept -= lost
        out = step(spark, folder, k, docs)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert ids_of(docs) == sorted(kept), cp.STAGES[k][0]
    last = step(spark, folder, 4, docs)
    assert last.columns == [*columns, "copy_", "n_copies"]
    got = [r.asDict() for r in last.collect()]
    assert {r["doc_id"] for r in got} <= kept and all(r["copy"] == 7 and r["doc"] == "own" and r["key"] == 5 for r in got)
    for r in got:
        assert sorted(x["copy_"] for x in got if x["doc_id"] == r["doc_id"]) == list(range(r["n_copies"]))

    import os

    left = [name for name in os.listdir(scratch.removeprefix("file://")) if name.startswith(tuple(f.__name__ + "-" for _, f in cp.STAGES[:-1]))]
    assert left == []  # each stage has removed the scratch of the one before

    whole = [r.asDict() for r in cp.run(spark, folder).collect()]
    assert sorted((r["doc_id"], r["copy_"]) for r in whole) == sorted((r["doc_id"], r["copy_"]) for r in got)


def test_unstored_results_keep_their_scratch(spark, planted):
    """A stage fed with a lazy frame must not remove what that frame still reads."""
    folder, _, rows = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lazy = step(spark, folder, 2, step(spark, folder, 1, step(spark, folder, 0, docs)))
    assert len(ids_of(lazy)) == len(rows) - 15


def test_empty_table(spark, planted):
    folder = planted[0]
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, folder).count() == 0


