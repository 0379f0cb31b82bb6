"""Hard negatives for anchors: rows of another label whose score lies in a window below a positive's.

A row's score is the integer inner product of its quantised vector with the anchor's. An anchor's
positives are its best rows of the same label. Each positive opens a window of scores, and the best
negatives of every window are wanted. The windows of an anchor overlap: their upper limits cut the
scores into disjoint slots, slot k reaching from below the next lower limit up to the k-th one. Tasks
keep the best few rows of each slot, so a row is looked at once however many windows hold it; at the
end a window is a merge of its slot and all lower ones, cut at its lower limit.

All rows are scored against all anchors in cells of an anchor group (at most ANCHORS_A_CELL) and a
slice of the rows (at most ROWS_A_CELL or a 64th of all). Cells are bounded, so neither a frequent
label nor a common vector makes a task large; a cell returns a few rows an anchor.

Defined results:
* rows with a null label or vector, or with a null or non-finite component, take no part;
* equal scores are ordered by the smaller id, null ids last; repeated rows count each for itself, and
  only the anchor's own row is left out of its positives;
* an anchor without rows of its label has no positives and no result; a negative positive score opens
  an empty window; an empty table gives an empty result;
* components missing from a shorter vector count as zero;
* scores are exact 64-bit integers; a quantised component beyond +-sqrt(2**62 / components), 2**28 at
  64 components, counts as that limit;
* columns beside those named are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setlist.llm.common import numbered, written
from setlist.llm.vectors import matrix, whole

ANCHORS_A_CELL, ROWS_A_CELL, LEAST_ROWS = 8192, 65536, 1024
BLOCK = 1024  # anchors or rows of one matrix product

BEST = pa.schema([("anchor_row", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])
BEST_DDL = "anchor_row long, slot int, score long, id long"


def quantised(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as whole numbers in double precision, or in 64 bits where sums may pass 2**53."""
    q = np.floor(vectors * scale)
    width = max(1, vectors.shape[1])
    if np.abs(q).max(initial=0) ** 2 * width < 2**52:
        return q
    limit = int((2**62 / width) ** 0.5)
    return np.clip(q, -limit, limit).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b, as 64-bit integers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if a.dtype != b.dtype:
        a, b = a.astype(np.int64), b.astype(np.int64)
    return (a @ b.T).astype(np.int64)


def first_of_groups(anchor: np.ndarray, slot: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores of every (anchor, slot), equal scores by the smaller place."""
    order = np.lexsort((place, -score, slot, anchor))
    a, s = anchor[order], slot[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < k]


def by_id(rows: pa.Table) -> pa.Table:
    return rows.sort_by([("id", "ascending")])  # nulls come last


def best_table(anchors: pa.Table, rows: pa.Table, found: list[tuple[np.ndarray, ...]], k: int) -> pa.Table:
    if not found:
        return BEST.empty_table()
    anchor, slot, score, place = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = first_of_groups(anchor, slot, score, place, k)
    return pa.table({
        "anchor_row": anchors["row_id"].take(pa.array(anchor[keep])), "slot": pa.array(slot[keep], pa.int32()),
        "score": pa.array(score[keep], pa.int64()), "id": rows["id"].take(pa.array(place[keep])),
    }).cast(BEST)


def positives_of_cell(k: int, scale: int):
    """The k best other rows for every anchor; all rows of the cell have the anchors' label."""
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return BEST.empty_table()
        rows = by_id(rows)
        a, x = quantised(matrix(anchors["vector"]), scale), quantised(matrix(rows["vector"]), scale)
        own = {int(r): i for i, r in enumerate(rows["row_id"].to_numpy())}
        at = np.array([own.get(int(r), -1) for r in anchors["row_id"].to_numpy()])
        found = []
        for first in range(0, len(a), BLOCK):
            block = at[first:first + BLOCK]
            for low in range(0, len(x), BLOCK):
                score = products(a[first:first + BLOCK], x[low:low + BLOCK])
                open_to = np.ones(score.shape, dtype=bool)
                here = np.flatnonzero((block >= low) & (block < low + score.shape[1]))
                open_to[here, block[here] - low] = False
                if score.shape[1] > k + 1:
                    # One more than k, as the anchor itself may be among them.
                    open_to &= score >= np.partition(score, -(k + 1), axis=1)[:, -(k + 1)][:, None]
                i, j = np.nonzero(open_to)
                got = (i + first, np.zeros(len(i), dtype=np.int32), score[i, j], j + low)
                keep = first_of_groups(*got, k)
                found.append(tuple(c[keep] for c in got))
        return best_table(anchors, rows, found, k)
    return run


def slots_of_cell(k: int, scale: int):
    """The k best rows of other labels in every slot of every anchor."""
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return BEST.empty_table()
        rows = by_id(rows)
        a, x = quantised(matrix(anchors["vector"]), scale), quantised(matrix(rows["vector"]), scale)
        label_a, label_x = anchors["label"].to_numpy(), rows["label"].to_numpy()
        tops, lows = anchors["tops"].to_pylist(), anchors["lows"].to_pylist()
        n_slots = max(map(len, tops))
        top = np.full((len(a), n_slots), np.iinfo(np.int64).min)  # no score is this low
        low = np.full((len(a), n_slots), np.iinfo(np.int64).max)
        for i, (t, b) in enumerate(zip(tops, lows, strict=True)):
            top[i, :len(t)], low[i, :len(t)] = t, b
        reach = low.min(axis=1)
        found = []
        for first in range(0, len(a), BLOCK):
            part = slice(first, first + BLOCK)
            for start in range(0, len(x), BLOCK):
                score = products(a[part], x[start:start + BLOCK])
                fits = (score <= top[part, 0][:, None]) & (score >= reach[part][:, None])
                fits &= label_a[part][:, None] != label_x[start:start + BLOCK][None, :]
                i, j = np.nonzero(fits)
                if not len(i):
                    continue
                s = score[i, j]
                slot = (s[:, None] <= top[part][i]).sum(axis=1) - 1  # limits descend
                inside = s >= low[part][i, slot]
                got = (i[inside] + first, slot[inside].astype(np.int32), s[inside], j[inside] + start)
                keep = first_of_groups(*got, k)
                found.append(tuple(c[keep] for c in got))
        return best_table(anchors, rows, found, k)
    return run


def _share(key: str, parts: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), key), parts).cast("int")


def _first(df: DataFrame, keys: list[str], k: int, order: str = "nth") -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return df.withColumn(order, F.row_number().over(best)).where(F.col(order) <= k)


def _cells(anchors: DataFrame, rows: DataFrame, keys: list[str], work) -> DataFrame:
    """Anchors of every group met with every slice of the rows, by the columns group, slice and `keys`."""
    left = anchors.withColumn("slice", F.explode(F.expr("sequence(0, slices - 1)")))
    right = rows.withColumn("group", F.explode(F.expr("sequence(0, groups - 1)")))
    by = [*keys, "group", "slice"]
    # Both sides come from one table; new columns tell them apart.
    left, right = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (left, right))
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(work, BEST_DDL)


def _dealt(rows: DataFrame, sizes: DataFrame | None, n: int, n_anchors: int) -> DataFrame:
    """Rows with their slice and anchor group, and how many of both there are (for their label, given `sizes`)."""
    most = max(LEAST_ROWS, min(ROWS_A_CELL, -(-n // 64)))
    if sizes is None:
        rows = rows.withColumn("n", F.lit(n).cast("long")).withColumn("n_anchors", F.lit(n_anchors).cast("long"))
    else:
        rows = rows.join(sizes, "label")
    return (
        rows.withColumn("slices", F.expr(f"cast(greatest(1, ceil(n / {most})) as int)"))
        .withColumn("groups", F.expr(f"cast(greatest(1, ceil(n_anchors / {ANCHORS_A_CELL})) as int)"))
        .withColumn("slice", _share("row_id", F.col("slices"), 1)).withColumn("group", _share("row_id", F.col("groups"), 2))
        .drop("n", "n_anchors")
    )


def hard_negatives(
    rows: DataFrame, is_anchor: Column, id: str, label: str, vector: str,
    positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95, scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows where `is_anchor` holds.

    For each anchor and each of its best `positives`, the best `negatives` rows of other labels with
    low_percent * positive_score <= 100 * negative_score <= high_percent * positive_score.
    """
    taken = rows.where(F.col(label).isNotNull() & whole(F.col(vector))).select(
        F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    stored = numbered(taken, "negatives-rows")
    sizes = stored.groupBy("label").agg(F.count("*").alias("n"), F.count_if("anchor").alias("n_anchors")).where("n_anchors > 0")
    n, n_anchors = stored.agg(F.count("*"), F.count_if("anchor")).first()

    dealt = _dealt(stored, sizes, n, n_anchors)
    best = _cells(dealt.where("anchor").drop("anchor", "groups"), dealt.drop("anchor", "slices"), ["label"],
                  positives_of_cell(positives, scale))
    chosen = written(_first(best, ["anchor_row"], positives).select("anchor_row", "nth", "score", "id"), "negatives-positives")

    # Windows of an anchor, highest first; slot k reaches from above the next window's top down to its own low.
    whole_score = F.col("score").cast("decimal(20,0)")
    windows = chosen.withColumn("top", F.floor(whole_score * high_percent / 100).cast("long")).withColumn(
        "low", F.ceil(whole_score * low_percent / 100).cast("long")).where("low <= top")
    limits = windows.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("nth", "top", "low", "id", "score"))).alias("w"))
    limits = limits.select(
        F.col("anchor_row").alias("row_id"), F.col("w.top").alias("tops"),
        F.expr("transform(w, (x, i) -> greatest(x.low, if(i + 1 < size(w), w[i + 1].top + 1, x.low)))").alias("lows"))
    flat = _dealt(stored, None, n, n_anchors)
    anchors = flat.where("anchor").drop("anchor", "groups").join(limits, "row_id")
    slots = _cells(anchors, flat.drop("anchor", "slices"), [], slots_of_cell(negatives, scale))
    kept = _first(slots, ["anchor_row", "slot"], negatives)

    # The windows of an anchor and the at most positives * negatives rows of its slots, merged per window.
    pool = kept.groupBy("anchor_row").agg(F.collect_list(
        F.struct((-F.col("score")).alias("down"), F.col("id").isNull().alias("last"), F.col("id"), F.col("score"), F.col("slot"))).alias("pool"))
    slot_of = F.row_number().over(Window.partitionBy("anchor_row").orderBy("nth")) - 1
    opened = windows.withColumn("slot", slot_of).join(pool, "anchor_row").join(
        stored.where("anchor").select(F.col("row_id").alias("anchor_row"), F.col("id").alias("anchor_id")), "anchor_row")
    merged = F.slice(F.array_sort(F.filter("pool", lambda x: (x["slot"] >= F.col("slot")) & (x["score"] >= F.col("low")))), 1, negatives)
    listed = opened.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.posexplode(merged))
    return listed.select(
        "anchor_id", "positive_id", (F.col("pos") + 1).alias("rank"), F.col("col.id").alias("negative_id"), "positive_score",
        F.col("col.score").alias("negative_score"))
