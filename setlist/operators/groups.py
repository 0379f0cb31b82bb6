"""Ordered work inside groups that may be huge.

A plain window or `collect_list` hands a whole group to one task. The helpers here cut a group
into blocks first, work per (group, block), and only then put the per-block results in order,
so a single playlist, track or artist may hold a large share of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ids per slice of `ordered_values`, positions per block of a playlist.
SLICE = 4096
BLOCK = 65536


def position_block(sequence: str = "sequence", size: int = BLOCK) -> Column:
    return F.floor(F.col(sequence) / size)


def running_total(
    rows: DataFrame,
    out: str,
    value: Column,
    group: list[str],
    order: list[Column],
    blocks: list[Column],
    totals_from: DataFrame | None = None,
    group_info: DataFrame | None = None,
    later: Column | None = None,
) -> DataFrame:
    """Sum of `value` over all earlier rows of the group (0 for the first), as column `out`.

    `blocks` is a coarse, order-preserving part of `order`. Rows are shuffled once, by (group,
    block); the block totals are summed map-side first. `totals_from` may name a slimmer frame
    with the same rows to take the totals from. `group_info` has one row per group whose
    columns are to be added; it is joined to the block totals, so the rows need no shuffle for it.
    `later` may say which rows lie beyond the first block: totals are then taken only of groups that
    have such rows, mostly none, and all other groups start at 0.
    """
    names = [f"_block{i}" for i in range(len(blocks))]
    keys = [*group, *names]
    cut = dict(zip(names, blocks))
    slim = totals_from or rows
    if later is not None:
        if group_info is not None:
            raise ValueError("group_info needs the totals of all groups")
        slim = slim.join(slim.where(later).select(*group).distinct(), group, "left_semi")
    totals = slim.withColumns(cut).groupBy(*keys).agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*group).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    how = "left"  # every block has a start; Spark drops a left join whose columns nobody reads
    if group_info is not None:
        starts, how = starts.join(group_info, group), "inner"
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumns(cut)
        .withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, keys, how)
        .withColumn(out, F.coalesce("_start", F.lit(0)) + F.col("_inside"))
        .drop(*names, "_inside", "_start")
    )


def positions(
    rows: DataFrame, out: str, group: list[str], order: list[Column], blocks: list[Column], later: Column | None = None
) -> DataFrame:
    """Zero-based position of each row in its group."""
    return running_total(rows, out, F.lit(1).cast("bigint"), group, order, blocks, later=later)


def positions_without(
    rows: DataFrame, out: str, group: str, order: list[Column], block: Column, doomed: DataFrame
) -> DataFrame:
    """Rows but those at the doomed (group, `position`)s, with their position among the rows left.

    A row's new position is its old one less the number of doomed ones before it. The block of a doomed
    position follows from the starts of the blocks; each block then knows its own doomed positions
    and how many lie in earlier blocks. Rows are shuffled once, by (group, block), and numbered once.
    """
    cut = rows.withColumn("_block", block)
    counts = cut.groupBy(group, "_block").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    asked = doomed.select(F.col(group).alias("_group"), F.col("position").alias("_gone"))
    inside = (F.col(group) == F.col("_group")) & (F.col("_gone") >= F.col("_start")) & (F.col("_gone") < F.col("_start") + F.col("_n"))
    hit = starts.join(asked, inside, "left").groupBy(group, "_block").agg(
        F.first("_start").alias("_start"), F.collect_set("_gone").alias("_doomed"))
    hit = hit.withColumn("_less", F.coalesce(F.sum(F.size("_doomed")).over(earlier), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(group, "_block").orderBy(*order)) - 1
    placed = cut.withColumn("_inside", place).join(hit, [group, "_block"]).withColumn("_at", F.col("_start") + F.col("_inside"))
    kept = placed.where(~F.array_contains("_doomed", F.col("_at")))
    new = F.col("_at") - F.col("_less") - F.size(F.filter("_doomed", lambda x: x < F.col("_at")))
    return kept.withColumn(out, new.cast("bigint")).drop("_block", "_inside", "_start", "_doomed", "_less", "_at")


def ordered_values(
    rows: DataFrame, out: str, keys: list[str], id_col: str, value: Column, size: int = SLICE
) -> DataFrame:
    """Array of the non-null values of each key, in order of a (within the key unique) numeric id.

    Values are gathered per (key, id range) first: such a slice holds at most `size` ids,
    however many rows the key has and however often one is repeated; the second step only puts
    finished slices in order.
    """
    sliced = (
        rows.withColumn("_slice", F.floor(F.col(id_col) / size))
        .groupBy(*keys, "_slice")
        .agg(F.array_sort(F.collect_set(F.struct(F.col(id_col).alias("id"), value.alias("value")))).alias("_pairs"))
        .select(*keys, "_slice", F.filter(F.col("_pairs.value"), lambda v: v.isNotNull()).alias("_values"))
    )
    parts = F.array_sort(F.collect_list(F.struct("_slice", "_values")))
    return sliced.groupBy(*keys).agg(F.flatten(F.transform(parts, lambda p: p["_values"])).alias(out))


def join_keeping_left(
    left: DataFrame, right: DataFrame, key: str, right_keys: DataFrame | None = None
) -> DataFrame:
    """Left outer join for a right side in which one key may hold a large share of the rows.

    Spark splits a skewed right side of an inner join only, so partnerless rows come apart.
    `right_keys` may name a cheaper frame with the keys of `right`.
    """
    keys = (right if right_keys is None else right_keys).select(key).distinct()
    lonely = left.join(keys, key, "left_anti")
    return left.join(right, key).unionByName(lonely, allowMissingColumns=True)


def joined_text(values: Column, separator: str) -> Column:
    """Values joined by a separator; null when there are none."""
    return F.when(F.size(values) > 0, F.array_join(values, separator))


def repeated_value(value: Column, times: Column) -> Column:
    """A value that stands for `times` equal ones, for `repeated_text`; null for a null value."""
    return F.when(value.isNotNull(), F.struct(value.alias("value"), times.cast("int").alias("times")))


def repeated_text(runs: Column, separator: str) -> Column:
    """The text of `joined_text` with each value as often as its run says; null when there are none."""
    text = lambda r: F.concat(F.repeat(F.concat(r["value"], F.lit(separator)), r["times"] - 1), r["value"])
    return joined_text(F.transform(runs, text), separator)
