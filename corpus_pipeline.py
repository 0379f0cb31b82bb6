"""The corpus pipeline: from raw documents to a mixed training set, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again, and returns a
frame with the columns of documents; the last adds the number of each copy. What a stage writes on its
way goes to a folder of its own, which the next stage removes: by then the result is stored. A frame
that still reads from that folder, because it was not stored, keeps it.

Every stage: an empty table gives an empty result; further columns, whatever their names, are carried; a
null or empty text is a text without words. What else a stage does with odd rows is said with it.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setlist.llm import decontaminate, exact_dedup, jaccard_join, language_id, mixing
from setlist.llm.common import STAGE_SETTING, remove_folder, scratch_dir, written
from setlist.llm.queries import MIX_SEED, SOURCE_WEIGHTS, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Near duplicates are components of an iterated join, which SQL on the tables cannot state; each stage
# and the whole are compared with brute-force versions in tests/llm.
ORACLE_SQL: str | None = None

# The session setting that names the folder of the stage before.
BEFORE_SETTING = "spark.setlist.stage.before"


def _remove_before(spark: SparkSession, docs: DataFrame) -> None:
    folder = spark.conf.get(BEFORE_SETTING, None)
    if folder and not any(folder in name for name in docs.inputFiles()):
        remove_folder(spark, f"{scratch_dir(spark)}/{folder}")
        spark.conf.unset(BEFORE_SETTING)


def in_own_folder(stage: Stage) -> Stage:
    """The stage, writing its scratch to a folder of its own and removing that of the stage before."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _remove_before(spark, docs)
        folder = f"{stage.__name__}-{uuid.uuid4().hex}"
        spark.conf.set(STAGE_SETTING, folder)
        try:
            return stage(spark, docs, sf_dir)
        finally:
            spark.conf.unset(STAGE_SETTING)
            spark.conf.set(BEFORE_SETTING, folder)
    return run_stage


@in_own_folder
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go; profiles come from the labelled training part.

    Texts without a letter and texts that share no n-gram with any language go. Without a labelled
    document nothing can be recognised and all go.
    """
    profiles = language_id.learn_profiles(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.reject_unknown(docs, profiles)


@in_own_folder
def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space one row stays: the longest text, then the smallest id.

    All texts without anything but white space are equal. Rows that repeat an id and a text: one stays.
    """
    return exact_dedup.drop_copies(docs)


@in_own_folder
def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id stays; texts without words all stay."""
    return jaccard_join.keep_one(docs)


@in_own_folder
def no_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window like a benchmark item go, whole; texts without words stay."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


@in_own_folder
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents in shuffled order, with `copy` (from 0) and `n_copies`.

    Columns of docs with these names stay as they are; the new ones then get an underscore more. A null
    source is a source of its own; rows that repeat an id and a text have the same number of copies.
    """
    copies = mixing.mixed(docs, SOURCE_WEIGHTS, seed=MIX_SEED)
    new = [F.col(name).alias(_free(name, docs.columns)) for name in ("copy", "n_copies")]
    return copies.select(*[F.col("doc")[c].alias(c) for c in docs.columns], *new)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("exact_dedup", no_exact_copies),
    ("near_duplicates", no_near_copies),
    ("decontaminate", no_benchmark_passages),
    ("mix_sources", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if kept:
            remove_folder(spark, kept)  # the stage after it has been stored
        kept = docs.inputFiles()[0].rsplit("/", 1)[0] if docs.inputFiles() else None
    return STAGES[-1][1](spark, docs, sf_dir)
