"""Surrogate ids for new keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Hex digits of the key's digest that make a bucket: 16^3 buckets.
BUCKET_DIGITS = 3


def number_new_keys(
    new: DataFrame, key: str, id_col: str, known: DataFrame, digits: int = BUCKET_DIGITS
) -> DataFrame:
    """`new` with ids above the greatest one in `known`.

    Keys of `new` are unique. They fall into even buckets by digest and are ranked inside their
    bucket; bucket b hands out every 16^digits-th number. So no count of other buckets is
    needed, rows are shuffled once, and the ids depend on the keys only: a recomputed task
    gives the same ones. Ids are unique, not without gaps.
    """
    buckets = 16**digits
    bucket = F.conv(F.substring(F.md5(key), 1, digits), 16, 10).cast("bigint")
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    top = known.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("bigint")).scalar()
    return (
        new.withColumn("_bucket", bucket)
        .withColumn("_nth", (rank - 1) * F.lit(buckets).cast("bigint"))
        .withColumn(id_col, top + 1 + F.col("_bucket") + F.col("_nth"))
        .drop("_bucket", "_nth")
    )
