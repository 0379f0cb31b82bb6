"""Merkle manifest of a dataset: a tree of hashes per group, a tree over the groups, a proof per row.

Leaves of a group ascend by their order columns; every two consecutive nodes become the hash of their
digests (hex text, one after the other), the last node alone if it has no partner, until one is left. The
groups' roots, ordered by group (null first, then by bytes), are the leaves of the tree over them.

The tree is kept as an append log. Builders take aligned runs of 2**HEIGHT nodes of one level and append
every node when it is complete: leaves in order, a parent right after its last child. So a builder's log
is the postorder of its subtree, and where a node stands follows from sizes alone (`position`): nothing
has to be searched for or linked. Roots of builders are the leaves of the builders HEIGHT levels up.
Proofs are read from above: a builder hands each of its leaves the siblings at their known places,
followed by the siblings above its own root.

A log holds 2**HEIGHT leaves, so a large group is many even builders. Ranks come from a range-partitioned,
sorted and stored table and the row counts of its partitions.

Defined results: a null group is a group of its own and comes first; null order values come first;
repeated rows are leaves each; rows that agree in group, order and leaf are interchangeable; an empty
table has no trees and no rows; a group of one row has its leaf as root. Columns beside those named
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setlist.llm.common import written

HEIGHT = 8
RUN = 1 << HEIGHT  # leaves of one builder
DIGEST = 32

STEPS_DDL = "array<struct<side: string, digest: string>>"
STEPS = pa.list_(pa.struct([("side", pa.string()), ("digest", pa.string())]))


# ------------------------------------------------------------------ the tree


def parent(left: bytes, right: bytes = b"") -> bytes:
    return sha256((left.hex() + right.hex()).encode()).digest()


def height_of(n: int) -> int:
    return max(0, n - 1).bit_length()


def position(level: int, index: int, n: int) -> int:
    """Place of a node in the log of a tree of n leaves.

    Before the first leaf of its subtree, `first` leaves and all subtrees they complete were appended:
    2 * first - (ones in first), as each one bit of first is a complete tree of 2 * size - 1 nodes. Its
    own subtree ends with it.
    """
    first = index << level
    leaves = min(1 << level, n - first)
    own = sum(-(-leaves >> t) for t in range(level + 1))
    return 2 * first - first.bit_count() + own - 1


def log_of(leaves: list[bytes], height: int) -> bytes:
    """The nodes over the leaves up to `height`, in the order they are complete."""
    log, waiting = [], [None] * (height + 1)
    for node in leaves:
        log.append(node)
        level = 0
        while waiting[level] is not None:
            node, waiting[level] = parent(waiting[level], node), None
            log.append(node)
            level += 1
        waiting[level] = node
    # Close the right edge: nodes without a partner are hashed alone.
    node = None
    for level in range(height):
        if waiting[level] is not None:
            node = parent(waiting[level]) if node is None else parent(waiting[level], node)
        elif node is not None:
            node = parent(node)
        else:
            continue
        log.append(node)
    return b"".join(log)


def siblings(log: bytes, leaf: int, n: int, height: int) -> list[dict]:
    """The steps from a leaf to the builder's root: at each level the sibling and its side, or none."""
    steps = []
    for level in range(height):
        index = leaf >> level
        other = index ^ 1
        if other < -(-n >> level):
            at = position(level, other, n) * DIGEST
            steps.append({"side": "left" if other < index else "right", "digest": log[at:at + DIGEST].hex()})
        else:
            steps.append({"side": "none", "digest": ""})
    return steps


def builder_height(n: int) -> int:
    """Levels of the builders of a level of n nodes: the topmost stops at its root."""
    return height_of(n) if n <= RUN else HEIGHT


def folded(leaf: Column, steps: Column) -> Column:
    """The root that follows from a leaf's digest and its siblings."""
    up = lambda node, s: F.sha2(
        F.when(s["side"] == "left", F.concat(s["digest"], node)).otherwise(F.concat(node, s["digest"])), 256)
    return F.aggregate(steps, leaf, up)


# ------------------------------------------------------------------ ranks


def ranked(rows: DataFrame, group: str, order: list[str], stage: str) -> DataFrame:
    """Rows with `idx`, their rank in the group from 0 in ascending order, and `n`, the group's size.

    A group may hold most of the rows: they are dealt by ranges of (group, order), and a last column
    spreads rows that agree in all of these.
    """
    keys = [group, *order, "tie"]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    stored = written(dealt.drop("tie").withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), stage)
    counts = stored.groupBy(group, "part").agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    earlier = Window.partitionBy(group).orderBy("part")
    begins = counts.select(
        group, "part", "first", (F.sum("rows").over(earlier) - F.col("rows")).alias("before"),
        F.sum("rows").over(Window.partitionBy(group)).alias("n"))
    return stored.join(begins, [group, "part"]).withColumn("idx", F.col("before") + F.col("place") - F.col("first")).drop(
        "part", "place", "first", "before")


# ------------------------------------------------------------------ builders


def _write_logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        logs = []
        for n, members in zip(batch.column("n").to_pylist(), batch.column("digests").to_pylist(), strict=True):
            logs.append(log_of(members, builder_height(n)))
        columns = [c for c in batch.schema.names if c != "digests"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(logs, pa.binary())], [*columns, "log"])


def _read_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each leaf of a builder, its own siblings followed by those above the builder."""
    for batch in batches:
        at, idx, steps = [], [], []
        rows = zip(*(batch.column(c).to_pylist() for c in ("n", "block", "size", "log", "steps")), strict=True)
        for i, (n, block, size, log, above) in enumerate(rows):
            height = builder_height(n)
            for leaf in range(size):
                at.append(i)
                idx.append(block * RUN + leaf)
                steps.append(siblings(log, leaf, size, height) + above)
        take = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("tree").take(take), pa.array(idx, pa.int64()), pa.array(steps, STEPS)], ["tree", "idx", "steps"])


def _log_rows(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree, place, digest = [], [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("tree", "n", "leaves", "block", "size", "log")), strict=True)
            for name, n, leaves, block, size, log in rows:
                for up in range(1 if level else 0, builder_height(n) + 1):
                    for k in range(-(-size >> up)):
                        at = position(up, k, size) * DIGEST
                        tree.append(name)
                        place.append(position(level + up, (block * RUN >> up) + k, leaves))
                        digest.append(log[at:at + DIGEST].hex())
            yield pa.RecordBatch.from_arrays(
                [pa.array(tree, pa.string()), pa.array(place, pa.int64()), pa.array(digest, pa.string())], ["tree", "position", "digest"])
    return run


class Forest:
    """Trees over `leaves` (tree, idx, n, digest as hex text), built level by level and stored as logs.

    levels[r] has the builders over nodes of level r * HEIGHT: tree, block (which run), size (its nodes),
    n (nodes of that level in the tree), leaves (of the tree), log. roots: tree, digest.
    """

    def __init__(self, leaves: DataFrame, stage: str):
        nodes = leaves.select("tree", "idx", "n", F.col("n").alias("leaves"), F.unhex("digest").alias("digest"))
        self.levels: list[DataFrame] = []
        while True:
            built = self._built(nodes, f"{stage}-log{len(self.levels)}")
            self.levels.append(built)
            above = built.where(F.col("n") > RUN)
            if above.isEmpty():
                break
            nodes = above.select(
                "tree", F.col("block").alias("idx"), F.ceil(F.col("n") / RUN).cast("long").alias("n"), "leaves", _root().alias("digest"))
        tops = [level.where(F.col("n") <= RUN).select("tree", F.lower(F.hex(_root())).alias("digest")) for level in self.levels]
        self.roots = tops[0]
        for more in tops[1:]:
            self.roots = self.roots.unionByName(more)

    @staticmethod
    def _built(nodes: DataFrame, stage: str) -> DataFrame:
        runs = nodes.groupBy("tree", (F.col("idx") / RUN).cast("long").alias("block")).agg(
            F.first("n").alias("n"), F.first("leaves").alias("leaves"), F.count("*").alias("size"),
            F.sort_array(F.collect_list(F.struct("idx", "digest")))["digest"].alias("digests"))
        ddl = "tree string, block long, n long, leaves long, size long, log binary"
        return written(runs.mapInArrow(_write_logs, ddl), stage)

    def paths(self, above: DataFrame) -> DataFrame:
        """tree, idx, steps for every leaf; `above` (tree, steps) continues each tree's path."""
        lower = None
        for level in reversed(self.levels):
            top = level.where(F.col("n") <= RUN).join(above, "tree")
            if lower is not None:
                inner = level.where(F.col("n") > RUN).join(lower.withColumnRenamed("idx", "block"), ["tree", "block"])
                top = top.unionByName(inner.select(top.columns))
            lower = top.mapInArrow(_read_paths, f"tree string, idx long, steps {STEPS_DDL}")
        return lower

    def log(self) -> DataFrame:
        """tree, position, digest: every node once, at its place in its tree's whole postorder log."""
        found = None
        for r, level in enumerate(self.levels):
            rows = level.mapInArrow(_log_rows(r * HEIGHT), "tree string, position long, digest string")
            found = rows if found is None else found.unionByName(rows)
        return found


def _root() -> Column:
    """The last node of a builder's log."""
    return F.expr(f"substring(log, octet_length(log) - {DIGEST - 1}, {DIGEST})")


# ------------------------------------------------------------------ the manifest


def field_text(columns: list[str]) -> Column:
    """Values one after the other, each as its number of UTF-8 bytes, a colon and the value; null as a dash."""
    text = lambda c: F.col(c).cast("string")
    return F.concat(*[F.coalesce(F.concat(F.octet_length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in columns])


class Manifest:
    """Trees over the rows of a table, by group, and the tree over the groups.

    rows: tree, idx, n and the given columns; forest: the trees of the groups; top: the tree over them.
    `group` is text, `leaf` a hex digest.
    """

    def __init__(self, rows: DataFrame, group: str, order: list[str], leaf: str, stage: str = "manifest"):
        # Null is the smallest tree name, every other name starts with the same character.
        named = rows.withColumn("tree", F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("")))
        self.rows = ranked(named, "tree", [*order, leaf], f"{stage}-rows")
        self.forest = Forest(self.rows.withColumnRenamed(leaf, "digest"), stage)
        roots = self.forest.roots.withColumnRenamed("tree", "member").withColumn("tree", F.lit("top"))
        self.members = ranked(roots, "tree", ["member"], f"{stage}-groups")
        self.top = Forest(self.members, f"{stage}-top")

    def proofs(self) -> DataFrame:
        """The rows with `subroot`, `root` and `steps`, their siblings from the leaf up to the root."""
        none = F.array().cast(STEPS_DDL)
        over = self.top.paths(self.top.roots.select("tree", none.alias("steps")))
        groups = written(
            self.members.join(over, ["tree", "idx"]).join(self.top.roots.withColumnRenamed("digest", "root"), "tree")
            .select(F.col("member").alias("tree"), F.col("digest").alias("subroot"), "root", "steps"), "manifest-heads")
        paths = self.forest.paths(groups.select("tree", "steps"))
        return self.rows.join(paths, ["tree", "idx"]).join(groups.drop("steps"), "tree")
