"""Exact duplicates by two-pass Bloom filtering.

Pass one hashes every text and counts filter cells; cells hit at least twice form a bit set of
bounded size. Pass two tests every row against it: rows that miss cannot have an equal and pass
straight through, only possibly repeated rows shuffle (their digest, or for `drop_copies` the
row). A filter that is too small for the corpus sends more rows through the shuffle; the result
is exact at any size.

Defined cases: a null text counts as empty; equal texts are those identical after white space is
deleted, so all blank rows are one group. Of equal texts the longest original stays, then the
smallest id (null ids last), then the first row of the scan, so of rows repeated whole exactly
one is kept. An empty table gives an empty result. Further columns are carried by `drop_copies`,
whatever their names, and not read by `exact_groups`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setlist.llm.common import SPACE_CLASS, bloom_segments, filter_bits, maybe_member, numbered, with_row_id, written


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", "")


def _digests(rows: DataFrame, bits_per_key: int, hashes: int, max_filter_bits: int):
    """Written digest rows (doc_id, row_id, n_chars, sha, repeats) of doc_id, row_id and text, and the filter they were tested with."""
    keyed = rows.select("doc_id", "row_id", "text", F.xxhash64(normalised(F.col("text"))).alias("hash"))
    bits = filter_bits(rows.count(), bits_per_key, max_filter_bits)
    segments = written(bloom_segments(keyed, "hash", bits, hashes, twice=True), "exact-filter")
    tested = maybe_member(keyed, "hash", segments, bits, hashes, "repeats")
    digest = tested.select(
        "doc_id", "row_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        F.sha2(normalised(F.col("text")), 256).alias("sha"), "repeats",
    )
    return written(digest, "exact-digest"), segments, bits


def _grouped(digest: DataFrame) -> DataFrame:
    possible = digest.where("repeats")
    groups = possible.groupBy("sha").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("best"),
    )
    # Written, so that both sides of the join are exchanged for it and AQE can split a hot digest.
    groups = written(groups, "exact-groups")
    decided = possible.join(groups, "sha").select(
        "doc_id", "row_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row_id") == F.col("best.row_id")).alias("kept"), "sha",
    )
    alone = digest.where("not repeats").select(
        "doc_id", "row_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha",
    )
    return alone.unionByName(decided)


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    bits_per_key: int = 8, hashes: int = 2, max_filter_bits: int = 1 << 31,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    # The ids are those of the scan that writes the digests; the filter's pass does not use them.
    rows = with_row_id(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    digest, _, _ = _digests(rows, bits_per_key, hashes, max_filter_bits)
    return _grouped(digest).select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def drop_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    bits_per_key: int = 8, hashes: int = 2, max_filter_bits: int = 1 << 31,
) -> DataFrame:
    """The rows that stay, with all their columns; only possibly repeated rows are shuffled."""
    rows = numbered(docs.select(F.struct("*").alias("doc")), "exact-rows")
    text = F.col(f"doc.{text_col}").alias("text")
    digest, segments, bits = _digests(
        rows.select(F.col(f"doc.{id_col}").alias("doc_id"), "row_id", text), bits_per_key, hashes, max_filter_bits)
    stay = _grouped(digest.where("repeats")).where("kept").select(F.col("row_id").alias("stay_id"))
    keyed = rows.select("doc", "row_id", F.xxhash64(normalised(text)).alias("hash"))
    tested = maybe_member(keyed, "hash", segments, bits, hashes, "repeats").select("doc", "row_id", "repeats")
    alone = tested.where("not repeats").select("doc")
    kept = tested.where("repeats").join(stay, F.col("row_id") == F.col("stay_id"), "left_semi").select("doc")
    return alone.unionByName(kept).select("doc.*")
