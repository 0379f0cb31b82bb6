"""Merge of payload rows into a catalogue table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setlist.operators.numbering import number_new_keys

Hold = Callable[[DataFrame], DataFrame]


def present(name: str) -> str:
    """Name of the source column that tells whether the payload had this key."""
    return f"has_{name}"


def fold_by_key(
    source: DataFrame, key: str, always: list[str], if_present: list[str], order: str = "load_seq"
) -> DataFrame:
    """One row per key: each column's last value in load order, absent ones not counting.

    `order` may be a struct, compared field by field. Of rows with the same order the greatest values
    win, so the result does not depend on how the rows lie.
    """
    last = []
    if always:
        last.append(F.max(F.struct(F.col(order).alias("at"), F.struct(*always).alias("v"))).alias("_always"))
    for name in if_present:
        # rows without the key give null, which max leaves out
        had = F.when(F.col(present(name)), F.struct(F.col(order).alias("at"), F.col(name).alias("v")))
        last += [F.max(had).alias(name), F.max(present(name)).alias(present(name))]
    if not last:
        return source.where(F.col(key).isNotNull()).select(key).distinct()
    folded = source.where(F.col(key).isNotNull()).groupBy(key).agg(*last)
    return folded.select(
        key,
        *[F.col("_always.v")[name].alias(name) for name in always],
        *[c for name in if_present for c in (F.col(name)["v"].alias(name), F.col(present(name)))],
    )


def merge_by_key(
    target: DataFrame,
    source: DataFrame,
    key: str,
    id_col: str | None,
    always: list[str],
    if_present: list[str] = (),
    order: str = "load_seq",
    hold: Hold = lambda df: df,
    changed_only: bool = False,
) -> DataFrame:
    """Upsert `source` into `target` on a natural key.

    `always` columns are overwritten by the last payload; `if_present` columns by the last
    payload that had the key (an explicit null counts, an absent key does not). Keys new to
    the target get the next surrogate ids. The folded source is used twice, for updates and for
    new rows; `hold` may write it and read it back, so that it is folded once. With `changed_only`
    the result has the rows of the source's keys alone, not the rest of the target.
    """
    if_present = list(if_present)
    news = hold(fold_by_key(source, key, always, if_present, order))

    t, n = target.alias("t"), news.alias("n")
    matched = F.col(f"n.{key}").isNotNull()

    def kept(name: str):
        old = F.col(f"t.{name}")
        if name in always:
            return F.when(matched, F.col(f"n.{name}")).otherwise(old).alias(name)
        if name in if_present:
            return F.when(F.col(f"n.{present(name)}"), F.col(f"n.{name}")).otherwise(old).alias(name)
        return old.alias(name)

    updated = t.join(n, F.col(f"t.{key}") == F.col(f"n.{key}"), "inner" if changed_only else "left").select(*map(kept, target.columns))

    fresh = news.join(target.select(key), key, "left_anti")
    if id_col:
        fresh = number_new_keys(fresh, key, id_col, target)
    types = {f.name: f.dataType for f in target.schema}
    inserted = fresh.select(*[
        (F.col(name) if name in fresh.columns else F.lit(None)).cast(types[name]).alias(name)
        for name in target.columns
    ])
    return updated.unionByName(inserted)


def missing_rows(target: DataFrame, source: DataFrame) -> DataFrame:
    """Rows of `source` the target does not have, each once."""
    columns = target.columns
    return source.select(*columns).dropna().distinct().join(target, columns, "left_anti")


def append_missing(target: DataFrame, source: DataFrame) -> DataFrame:
    """`target` plus those rows of `source` it does not have yet, each once; never removes."""
    return target.unionByName(missing_rows(target, source))


@dataclass(frozen=True)
class Change:
    """What a load does to one table: `rows` come, and where `key` is given, rows with their keys or the keys in `gone` go."""

    rows: DataFrame
    key: str | None = None
    gone: DataFrame | None = None

    def keys(self) -> DataFrame:
        """The keys whose old rows go."""
        return (self.rows if self.gone is None else self.gone).select(self.key)

    def applied(self, table: DataFrame) -> DataFrame:
        kept = table if self.key is None else table.join(self.keys(), self.key, "left_anti")
        return kept.unionByName(self.rows.select(table.columns))
