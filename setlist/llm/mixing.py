"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share of the corpus over its actual share, by characters, so the
expected size of the mixture is that of the corpus. Each row draws its number of copies by
inverting the Poisson distribution at a uniform number hashed from (seed, id, text): the draw is
the same on every attempt. Copies are then shuffled globally by a hash order.

A source may be so small that its rows have very many copies each. Its draws are made in chunks, once
for each (id, source, text), and its copies are numbered in chunks, dealt over tasks.

Rates are one row per source. Up to `broadcast_sources` counted sources they are broadcast, beyond
that Spark joins them (and splits a hot source).

Defined cases: a null source is a source of its own with its own weight (key None). Sources
without a stated weight have weight 1; weights of absent sources are not used. Null or empty texts
count one character, so that a source of blank rows has a rate. Weight 0 drops a source. Rows that
repeat id and text draw the same number. An empty table gives none. Columns of docs, whatever
their names, are carried by `mixed`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP = 500.0  # rates above this are drawn as a sum, so that exp(-rate) stays far from underflow
GREAT = 50_000.0  # rates above this are drawn and copied in chunks
DRAWS = 100  # of one chunk
COPIES = 100_000  # of one chunk


def source_rates(docs: DataFrame, weights: dict[str | None, float], source_col: str = "source", text_col: str = "text") -> DataFrame:
    """source, size (characters), rate (mean number of copies)."""
    size = F.greatest(F.lit(1), F.char_length(F.coalesce(F.col(text_col), F.lit("")))).cast("long")
    sizes = docs.select(F.col(source_col).alias("source"), size.alias("size")).groupBy("source").agg(F.sum("size").alias("size"))
    weight = F.lit(1.0)
    for source, w in weights.items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(source)), float(w)).otherwise(weight)
    weighted = sizes.withColumn("weight", weight)
    totals = weighted.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight")).first()
    if not totals["all_weight"]:
        return weighted.select("source", "size", F.lit(0.0).alias("rate"))
    rate = F.col("weight") / F.lit(totals["all_weight"]) * F.lit(totals["all_size"]) / F.col("size")
    return weighted.select("source", "size", rate.alias("rate"))


def _uniform(seed: int, id_col: str, text_col: str, draw) -> "F.Column":
    """A number in [0, 1) from 52 bits of an MD5 of (seed, draw, id, text's MD5)."""
    key = F.concat_ws("|", F.lit(str(seed)), draw.cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(text_col))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_inverse(u, rate) -> "F.Column":
    """The smallest n whose cumulative Poisson probability exceeds u."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("below"), F.lit(0).alias("n"))
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")

    def step(acc, k):
        p = acc["p"] * rate / k
        return F.when(acc["below"] > u, acc).otherwise(F.struct(p.alias("p"), (acc["below"] + p).alias("below"), k.alias("n")))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["n"]


def mixed(
    docs: DataFrame, weights: dict[str | None, float], id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    seed: int = 17, broadcast_sources: int = 100_000,
) -> DataFrame:
    """Copies in global hash order: doc (all columns of docs as a struct), copy (from 0), n_copies, rate, shuffle_key."""
    rates = source_rates(docs, weights, source_col, text_col).select(F.col("source").alias("rate_source"), "rate")
    n_sources, greatest = rates.agg(F.count("*"), F.coalesce(F.max("rate"), F.lit(0.0))).first()
    side = F.broadcast(rates) if n_sources <= broadcast_sources else rates
    rows = docs.select(
        F.struct("*").alias("doc"), F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("text_md5"))
    rated = rows.join(side, F.col("source").eqNullSafe(F.col("rate_source")))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("long")

    def drawn(first, last):
        # Most rates need one draw; a great rate is a sum of equal independent parts.
        return F.aggregate(
            F.transform(F.sequence(first, last), lambda j: poisson_inverse(_uniform(seed, "id", "text_md5", j), F.col("rate") / F.col("parts"))),
            F.lit(0).cast("long"), lambda acc, n: acc + n)

    parted = rated.withColumn("parts", parts)
    few = parted if greatest <= GREAT else parted.where(F.col("rate") <= GREAT)
    copies = few.withColumn("n_copies", drawn(F.lit(1).cast("long"), F.col("parts"))).where("n_copies > 0").select(
        "doc", "id", "text_md5", "rate", "n_copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_copies") - 1)).alias("copy"))
    if greatest > GREAT:
        many = parted.where(F.col("rate") > GREAT)
        key = ["id", "source", "text_md5"]
        chunks = many.select(*key, "rate", "parts").distinct().withColumn(
            "first", F.explode(F.sequence(F.lit(1).cast("long"), F.col("parts"), F.lit(DRAWS).cast("long")))).repartition(*key, "first")
        sums = chunks.withColumn("n", drawn(F.col("first"), F.least("parts", F.col("first") + (DRAWS - 1)))).groupBy(*key).agg(F.sum("n").alias("n_copies"))
        sums = sums.where("n_copies > 0").select(*[F.col(c).alias(f"of_{c}") for c in key], "n_copies")
        same = F.col("id").eqNullSafe(F.col("of_id")) & F.col("source").eqNullSafe(F.col("of_source")) & (F.col("text_md5") == F.col("of_text_md5"))
        pieces = many.join(sums, same).select(
            "doc", "id", "text_md5", "rate", "n_copies",
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_copies") - 1, F.lit(COPIES).cast("long"))).alias("first")
        ).repartition("id", "text_md5", "first")
        copies = copies.unionByName(pieces.select(
            "doc", "id", "text_md5", "rate", "n_copies",
            F.explode(F.sequence(F.col("first"), F.least(F.col("first") + (COPIES - 1), F.col("n_copies") - 1))).alias("copy")))
    order = F.xxhash64(F.lit(seed), F.col("id"), F.col("text_md5"), F.col("copy"))
    return copies.select("doc", "copy", "n_copies", "rate", order.alias("shuffle_key")).orderBy("shuffle_key", "copy")
