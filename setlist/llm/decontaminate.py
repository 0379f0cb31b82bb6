"""Benchmark passages in documents: SimHash fingerprints of item-sized windows, then exact similarity.

1. Windows. A window that is similar enough shares a word shingle with an item of its size, so
   only windows around shared shingles get a fingerprint: for every item size, those aligned with
   a shared shingle and those that begin at a run of shared shingles. (A best window can always be
   moved left to the start of such a run without losing a shared shingle.)
2. Fingerprints. Two 64-bit SimHashes of a window: one over its shingles as often as they occur, one
   over each shingle once. A shingle that only one side repeats upsets the first, a passage that
   both sides repeat the second; a pair need only be near by one of them.
3. Multi-index. The fingerprint is cut into radius + 1 blocks; two fingerprints within the radius
   agree on a block, so an equi-join on (kind, item size, block, value) finds all of them.
4. Verification. Weighted Jaccard similarity of the two shingle multisets, sum of the smaller over
   sum of the greater counts.

Without repeated shingles a similarity of 0.8 means about 10 +- 3 differing bits of 64; the default
radius of 24 lies five deviations above, so its blocks are 2 or 3 bits wide: the index selects little, and
no cut of any number of bits could select much and be sure of pairs that differ in a sixth of them.
Documents shuffle only if they share a shingle.

Defined cases: null or empty texts hold nothing. Items with fewer than five words have no shingle
and are never found. A document shorter than an item is one window. Words are lower-cased (A-Z)
runs without white space. Repeated rows are searched each for itself; repeated items are all
reported. Empty tables give no rows; `clean_documents` carries all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from setlist.llm.common import bloom_segments, filter_bits, maybe_member, numbered, with_row_id, words, written

SHINGLE = 5
BITS = 64


def _shingled(rows: DataFrame, text: str) -> DataFrame:
    """Replace the text by `shingles`, the hashes of all runs of five words, in order."""
    hashed = rows.withColumn("hashes", F.transform(words(F.coalesce(F.col(text), F.lit(""))), lambda w: F.xxhash64(w))).drop(text)
    at = lambda i, k: F.get(F.col("hashes"), i + k)
    runs = F.transform(
        F.when(F.size("hashes") >= SHINGLE, F.sequence(F.lit(0), F.size("hashes") - SHINGLE)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*[at(i, k) for k in range(SHINGLE)]))
    return hashed.withColumn("shingles", runs).drop("hashes")


def simhash(shingles: Column) -> Column:
    """The SimHash of an array of 64-bit hashes; every occurrence counts once."""
    def bit(b: Column) -> Column:
        votes = F.aggregate(shingles, F.lit(0), lambda acc, h: acc + F.when(F.getbit(h, b) == 1, 1).otherwise(-1))
        return F.when(votes > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), bit)
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def both_prints(shingles: Column) -> Column:
    return F.array(simhash(shingles), simhash(F.array_distinct(shingles)))


def blocks(fingerprint: Column, radius: int) -> Column:
    """The radius + 1 blocks of a fingerprint as (block, value)."""
    n = radius + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return F.array(*[
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1).cast("long")).alias("value"))
        for i in range(n)
    ])


def _small(side: DataFrame, rows: int, at_most: int) -> DataFrame:
    """Broadcast a side whose counted rows are within the bound, else leave the join to Spark."""
    return F.broadcast(side) if rows <= at_most else side


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", min_similarity: float = 0.8, radius: int = 24,
    broadcast_rows: int = 2_000_000,
) -> DataFrame:
    """One row per (row of docs, item) found: doc_id, row_id, item_id, start, n_words, hamming, similarity of the best window.

    `start` counts words from 0; `hamming` is that of the nearer kind of fingerprint.
    """
    texts = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "leak-docs")
    return _leaks(texts, benchmark, item_col, item_text_col, min_similarity, radius, broadcast_rows)


def _leaks(
    texts: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text",
    min_similarity: float = 0.8, radius: int = 24, broadcast_rows: int = 2_000_000,
) -> DataFrame:
    """`find_leaks` of a written table of row_id, doc_id and text."""
    items = _shingled(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), "text")
    items = with_row_id(items, "item_row").withColumn("n_item", F.size("shingles"))
    items = written(items.withColumn("item_prints", both_prints(F.col("shingles"))), "leak-items").where("n_item > 0")
    n_shingles = items.agg(F.coalesce(F.sum("n_item"), F.lit(0))).first()[0]
    item_shingles = items.select("n_item", F.posexplode("shingles").alias("item_pos", "shingle")).distinct()

    # Outer: for an inner explode Spark derives a filter on the array and pushes it down, where it
    # would build the whole array again for each of its elements.
    all_shingles = _shingled(texts.select("row_id", "text"), "text").select(
        "row_id", F.size("shingles").alias("n_doc"), F.posexplode_outer("shingles").alias("pos", "shingle"))
    shared = written(
        all_shingles.join(_small(item_shingles, n_shingles, broadcast_rows), "shingle").select("row_id", "n_doc", "n_item", "pos", "item_pos"),
        "leak-shared")

    before = F.lag("pos").over(W.partitionBy("row_id", "n_item").orderBy("pos"))
    runs = (
        shared.select("row_id", "n_doc", "n_item", "pos").distinct().withColumn("before", before)
        .where(F.col("before").isNull() | (F.col("before") < F.col("pos") - 1)).select("row_id", "n_doc", "n_item", F.col("pos").alias("at"))
    )
    aligned = shared.select("row_id", "n_doc", "n_item", (F.col("pos") - F.col("item_pos")).alias("at"))
    last = F.greatest(F.lit(0), F.col("n_doc") - F.col("n_item"))
    windows = runs.unionByName(aligned).select("row_id", "n_item", F.greatest(F.lit(0), F.least("at", last)).alias("start")).distinct()
    per_row = written(windows.groupBy("row_id").agg(F.collect_list(F.struct("n_item", "start")).alias("windows")), "leak-windows")

    bits = filter_bits(per_row.count())
    segments = written(bloom_segments(per_row, "row_id", bits, 2), "leak-filter")
    touched = maybe_member(texts, "row_id", segments, bits, 2, "touched").where("touched").drop("touched")
    cut = (
        _shingled(touched.join(per_row, "row_id"), "text").select("doc_id", "row_id", "shingles", F.explode("windows").alias("w"))
        .select("doc_id", "row_id", "w.n_item", "w.start", F.slice("shingles", F.col("w.start") + 1, F.col("w.n_item")).alias("window"))
    )
    prints = written(cut.withColumn("prints", both_prints(F.col("window"))), "leak-prints")

    n_items = items.count()
    index = items.select("n_item", "item_row", "item_id", F.posexplode("item_prints").alias("kind", "item_print")).select(
        "*", F.inline(blocks(F.col("item_print"), radius)))
    probes = prints.select("row_id", "n_item", "start", F.posexplode("prints").alias("kind", "print")).select(
        "*", F.inline(blocks(F.col("print"), radius)))
    near = (
        probes.join(_small(index, 2 * n_items * (radius + 1), broadcast_rows), ["kind", "n_item", "block", "value"])
        .withColumn("hamming", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))).where(F.col("hamming") <= radius)
        .groupBy("row_id", "n_item", "start", "item_row").agg(F.min("hamming").alias("hamming"))
    )

    # Verify: counts of each shingle in the window against its count in the item.
    in_window = prints.select("doc_id", "row_id", "n_item", "start", F.size("window").alias("n_window"), F.explode("window").alias("shingle"))
    in_window = in_window.groupBy("doc_id", "row_id", "n_item", "start", "n_window", "shingle").agg(F.count("*").alias("n"))
    in_item = items.select("item_row", "item_id", F.explode("shingles").alias("shingle")).groupBy("item_row", "item_id", "shingle").agg(F.count("*").alias("m"))
    common = (
        in_window.join(_small(in_item, n_shingles, broadcast_rows), "shingle")
        .groupBy("doc_id", "row_id", "n_item", "start", "n_window", "item_row", "item_id").agg(F.sum(F.least("n", "m")).alias("both"))
    )
    union = F.col("n_window") + F.col("n_item") - F.col("both")
    verified = (
        common.join(near, ["row_id", "n_item", "start", "item_row"]).withColumn("similarity", F.col("both") / union)
        .where(F.col("both") >= F.lit(min_similarity) * union)
    )
    best = F.max_by(
        F.struct("start", (F.col("n_window") + SHINGLE - 1).alias("n_words"), "hamming", "similarity"),
        F.struct("similarity", -F.col("start")))
    return verified.groupBy("doc_id", "row_id", "item_row", "item_id").agg(best.alias("b")).select("doc_id", "row_id", "item_id", "b.*")


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    docs_once = numbered(docs.select(F.struct("*").alias("doc")), "leak-docs")
    texts = docs_once.select("row_id", F.col(f"doc.{id_col}").alias("doc_id"), F.col(f"doc.{text_col}").alias("text"))
    leaks = written(_leaks(texts, benchmark, **settings).select("row_id").distinct(), "leak-rows")
    bits = filter_bits(leaks.count())
    segments = written(bloom_segments(leaks, "row_id", bits, 2), "leak-rows-filter")
    rows = maybe_member(docs_once, "row_id", segments, bits, 2, "suspect")
    clean = rows.where("not suspect").select("doc")
    checked = rows.where("suspect").join(leaks, "row_id", "left_anti").select("doc")
    return clean.unionByName(checked).select("doc.*")
