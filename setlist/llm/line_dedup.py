"""Repeated lines across documents, returned as per-document bitmaps.

Lines become hashes, range-partitioned by (hash, document) and sorted by document, greatest first,
and position; each sorted run is streamed into one row per (line, document), so a line that is in
a third of all documents spreads over many partitions. The first occurrence in that order is the
greatest document, which keeps the line. The result per document is a bit set of dropped lines
(64 per word, trailing zero words cut), never text.

Defined cases: null or empty text is one empty line. A line's key has white space stripped at both
ends and A-Z lower-cased. Every row counts as a document; rows that share an id and a text share a
bitmap, and all rows of the greatest id keep their lines. A null id sorts below all others. Empty
tables give empty results; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setlist.llm.common import SPACES, ascii_lower, bloom_segments, filter_bits, maybe_member, written


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("doc_hash", F.xxhash64("doc_id", "text"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Documents that lose lines: doc_id, doc_hash, n_dropped, dropped (array of 64-bit words, bit i = line i)."""
    exploded = _texts(docs, id_col, text_col).select("doc_id", "doc_hash", F.posexplode_outer(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = exploded.select("doc_id", "doc_hash", "pos", F.btrim(ascii_lower(F.col("line")), F.lit(SPACES)).alias("key"))
    lines = written(
        keyed.where(F.char_length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"), "doc_id", "doc_hash", "pos"),
        "line-keys",
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = (
        lines.repartitionByRange(parts, "h1", "h2", F.col("doc_id").desc())
        .sortWithinPartitions("h1", "h2", F.col("doc_id").desc(), "pos")
        .groupBy("h1", "h2", "doc_id", "doc_hash").agg(F.collect_set("pos").alias("positions"))
    )
    # Written, so that both sides of the next join are exchanged for it and AQE can split a hot line.
    keys = written(
        runs.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        .where(F.col("n_docs") >= min_docs).select("h1", "h2", "last_doc"),
        "repeated-lines",
    )
    losing = (
        runs.join(keys, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
        .select("doc_id", "doc_hash", F.explode("positions").alias("pos"))
    )
    by_word = losing.groupBy("doc_id", "doc_hash", F.expr("pos div 64").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    entries = by_word.groupBy("doc_id", "doc_hash").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"),
        F.max("word").alias("last_word"), F.sum(F.bit_count("bits")).alias("n_dropped"))
    dense = F.expr("transform(sequence(0L, last_word), w -> coalesce(try_element_at(words, w), 0L))")
    return entries.select("doc_id", "doc_hash", F.col("n_dropped").cast("long").alias("n_dropped"), dense.alias("dropped"))


def without_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5,
    max_filter_bits: int = 1 << 31,
) -> DataFrame:
    """Every document: doc_id, n_lines, n_dropped, text (its kept lines). Only documents that may lose lines shuffle."""
    bitmaps = written(dropped_lines(docs, id_col, text_col, min_chars, min_docs), "line-bitmaps")
    keyed = bitmaps.withColumn("doc_key", F.xxhash64("doc_id", "doc_hash"))
    bits = filter_bits(bitmaps.count(), 8, max_filter_bits)
    segments = written(bloom_segments(keyed, "doc_key", bits, 2), "line-filter")
    texts = _texts(docs, id_col, text_col).withColumn("doc_key", F.xxhash64("doc_id", "doc_hash"))
    tested = maybe_member(texts, "doc_key", segments, bits, 2, "loses").withColumn("lines", F.split("text", "\n", -1))
    whole = tested.where("not loses").select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), "text")
    marks = keyed.select(F.col("doc_key").alias("mark_key"), F.col("doc_id").alias("mark_id"), "n_dropped", "dropped")
    cut = (
        tested.where("loses").select("doc_id", "doc_key", "text")
        .join(marks, (F.col("doc_key") == F.col("mark_key")) & F.col("doc_id").eqNullSafe(F.col("mark_id")), "left")
        .withColumn("lines", F.split("text", "\n", -1))
        .select(
            "doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"),
            F.array_join(F.filter("lines", lambda _, i: F.coalesce(
                F.getbit(F.get(F.col("dropped"), (i / 64).cast("int")), i % 64) == 0, F.lit(True))), "\n").alias("text"),
        )
    )
    return whole.unionByName(cut)
