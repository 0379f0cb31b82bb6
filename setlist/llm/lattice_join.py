"""Near-duplicate embeddings by lattice hashing.

A table projects vectors of unit length at random to `blocks` times eight dimensions and decodes each
eight to the nearest point of the lattice E8; the points' hash is the vector's cell. Near vectors
often share a cell, and where they do not, one of them mostly lies in a cell next to the other's: a
vector also probes the `probes` cells that lie nearest beyond a wall of its own. Two vectors meet in a
table if they share a home cell or one probes the other's home. Several tables, drawn
independently, leave few near pairs without a meeting; every pair that meets is verified by its exact
cosine. Given the tables, the result does not depend on partitions or order.

Copies first become one class with a size, so a common vector costs one row. A cell with more than
TILE members is cut into tiles, which meet in pairs: no task holds a whole cell, and pairs never
leave a task: what comes out is a row per member, with its number of new links and the smallest
member it hangs together with there. A pair that meets in several cells is counted in one of the first such
table, which both members' codes tell.

Work is in proportion to the pairs that meet. In a group of many different near vectors all pairs
are compared, in tiles (their exact number of links is asked for); copies are not compared at all.

Defined results: vectors that are null, zero or hold a null or non-finite component, and rows with a null
label, link with nothing; vectors of different length do not link; repeated rows are vectors each and
link with each other; `component` is the smallest id reachable (nulls aside), a null id alone has a null
component; an empty table gives an empty result. Columns beside those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setlist.llm.common import numbered, written
from setlist.llm.components import connected
from setlist.llm.hashing import mix
from setlist.llm.vectors import matrix, whole

# Production parameters. At a cosine of 0.98 a pair of 64 components meets in one table in 0.8 of cases
# (0.9 at 0.99), so three tables miss 0.008 of the pairs at the limit; unrelated ones meet in 0.0001.
TABLES, BLOCKS, PROBES, CELL, SEED = 3, 2, 3, 2.0, 11
TILE = 1024


def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minuses."""
    found = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            found.append(v)
    found += [np.array(v) for v in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(found)


def _nearest_even(y: np.ndarray) -> np.ndarray:
    """The nearest points with whole entries of even sum."""
    point = np.rint(y)
    rest = y - point
    rows = np.flatnonzero(point.sum(axis=1) % 2 != 0)
    worst = np.abs(rest[rows]).argmax(axis=1)
    point[rows, worst] += np.where(rest[rows, worst] >= 0, 1.0, -1.0)
    return point


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest point of E8 = even points and even points moved by one half, row by row."""
    a, b = _nearest_even(y), _nearest_even(y - 0.5) + 0.5
    nearer = ((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


def _hashed(points: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of every row of lattice points, which are multiples of one half."""
    whole_points = np.rint(points * 2).astype(np.int64).astype(np.uint64)
    out = np.full(points.shape[:-1], salt + 1, dtype=np.uint64)
    for k in range(points.shape[-1]):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + whole_points[..., k])
    return out.astype(np.int64)


class Lattice:
    """The tables of one vector length."""

    def __init__(self, width: int, tables: int, blocks: int, probes: int, cell: float, seed: int):
        rng = np.random.default_rng([seed, width])
        self.probes, self.blocks = probes, blocks
        self.maps = [(rng.normal(size=(width, 8 * blocks)) / cell, rng.uniform(0, 2, size=8 * blocks)) for _ in range(tables)]
        self.steps = _neighbours()

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """For each vector and table the home cell, then the probed cells."""
        out = np.empty((len(unit), len(self.maps), 1 + self.probes), dtype=np.int64)
        rows = np.arange(len(unit))
        for t, (project, shift) in enumerate(self.maps):
            y = unit @ project + shift
            home = np.concatenate([decode(y[:, 8 * b:8 * b + 8]) for b in range(self.blocks)], axis=1)
            out[:, t, 0] = _hashed(home, t)
            # The wall towards a neighbouring point is the nearer, the longer the rest reaches its way.
            reach = np.concatenate([(y - home)[:, 8 * b:8 * b + 8] @ self.steps.T for b in range(self.blocks)], axis=1)
            for p in range(self.probes):
                best = reach.argmax(axis=1)
                reach[rows, best] = -np.inf
                moved = home.copy()
                columns = (best // len(self.steps) * 8)[:, None] + np.arange(8)
                moved[rows[:, None], columns] += self.steps[best % len(self.steps)]
                out[:, t, 1 + p] = _hashed(moved, t)
        return out


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; zero rows stay zero."""
    scaled = vectors / np.maximum(np.abs(vectors).max(axis=1, initial=0.0), np.finfo(float).tiny)[:, None]
    length = np.sqrt((scaled**2).sum(axis=1))
    return scaled / np.where(length > 0, length, 1.0)[:, None]


def encoder(parameters: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices: dict[int, Lattice] = {}
        for batch in batches:
            lists = batch.column("vector")
            width = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            codes: list = [None] * len(width)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                lattice = lattices.setdefault(int(w), Lattice(int(w), *parameters))
                for i, c in zip(at, lattice.codes(units(matrix(lists.take(pa.array(at))))), strict=True):
                    codes[i] = c.ravel()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(codes, pa.list_(pa.int64()))], [*batch.schema.names, "codes"])
    return run


# ------------------------------------------------------------------ cells

FOUND = pa.schema([("class", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
FOUND_DDL = "class long, links long, root long"
# A cell: same label, vector length, table and code; tiles a <= b of a large one.
CELL_KEY = ["label", "width", "tab", "cell", "tile_a", "tile_b"]


def _met_before(codes: np.ndarray, i: np.ndarray, j: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Which pairs meet in a table before theirs."""
    met = np.zeros(len(i), dtype=bool)
    for t in range(int(tables.max(initial=0))):
        a, b = codes[i, t], codes[j, t]
        meet = (a[:, :1] == b).any(axis=1) | (a == b[:, :1]).any(axis=1)
        met |= meet & (tables > t)
    return met


def _here(codes: np.ndarray, i: np.ndarray, j: np.ndarray, tables: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """False in the greater home cell of pairs that probe each other's: they meet in both."""
    a, b = codes[i, tables], codes[j, tables]
    both = (a[:, 1:] == b[:, :1]).any(axis=1) & (b[:, 1:] == a[:, :1]).any(axis=1)
    return ~both | (cell == np.minimum(a[:, 0], b[:, 0]))


def _groups(key: np.ndarray) -> np.ndarray:
    """Borders of runs of equal keys, with 0 and the length."""
    return np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(key)] if len(key) else np.zeros(1, dtype=int)


def linked_pairs(part: dict[str, np.ndarray], borders: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs that meet in a cell of this part for the first time, with a cosine of the threshold or more."""
    unit, home, own = part["unit"], part["home"], part["own"]
    left, right = [], []
    sizes = np.diff(borders)
    # Small cells together: all pairs of all cells of one size at once.
    for size in np.unique(sizes[(sizes > 1) & (sizes <= 16)]):
        first = borders[:-1][sizes == size]
        for a, b in combinations(range(size), 2):
            i, j = first + a, first + b
            near = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
            left.append(i[near])
            right.append(j[near])
    for first, end in zip(borders[:-1][sizes > 16], borders[1:][sizes > 16], strict=True):
        near = np.triu(unit[first:end] @ unit[first:end].T >= threshold, 1)
        i, j = np.nonzero(near)
        left.append(i + first)
        right.append(j + first)
    i, j = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (left, right))
    # Probing members only meet home members; different tiles meet across only.
    meet = (home[i] | home[j]) & ((own[i] != own[j]) | part["inner"][i])
    i, j = i[meet], j[meet]
    fresh = ~_met_before(part["codes"], i, j, part["tab"][i]) & _here(part["codes"], i, j, part["tab"][i], part["cell"][i])
    return i[fresh], j[fresh]


def _lowest(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For every member the smallest id it hangs together with by these pairs."""
    root = ids.copy()
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        if (root == before).all():
            return root


def comparer(threshold: float, tables: int, per_table: int):
    """Compare the members of each cell; rows arrive sorted by cell, and a cell is at most two tiles."""
    def compared(rows: pa.Table) -> pa.RecordBatch | None:
        rows = rows.combine_chunks()
        numbers = {c: rows[c].to_numpy() for c in ("class", "size", "home", "own", *CELL_KEY)}
        borders = _groups(np.stack([numbers[c] for c in CELL_KEY], axis=1))
        sizes = np.diff(borders)
        keep = np.repeat(sizes > 1, sizes)
        if not keep.any():
            return None
        at = np.flatnonzero(keep)
        borders = np.r_[0, np.cumsum(sizes[sizes > 1])]
        part = {c: v[at] for c, v in numbers.items()}
        part["unit"] = units(matrix(rows["vector"].take(pa.array(at))))
        part["codes"] = matrix_of_codes(rows["codes"].take(pa.array(at)), tables, per_table)
        part["inner"] = part["tile_a"] == part["tile_b"]
        i, j = linked_pairs(part, borders, threshold)
        links = np.bincount(i, weights=part["size"][j], minlength=len(at)) + np.bincount(j, weights=part["size"][i], minlength=len(at))
        # The same class has several places here, one for each of its cells: roots go over places of one cell.
        root = _lowest(len(at), i, j, part["class"])
        some = links > 0
        return pa.record_batch([
            pa.array(part["class"][some], pa.int64()), pa.array(links[some].astype(np.int64)), pa.array(root[some], pa.int64())], schema=FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # rows of cells that are not complete yet
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            key = np.stack([held[c].to_numpy() for c in CELL_KEY], axis=1)
            last = int(_groups(key)[-2]) if len(key) else 0
            if last:
                out = compared(held.slice(0, last))
                held = held.slice(last)
                if out is not None:
                    yield out
        if held is not None and held.num_rows:
            out = compared(held)
            if out is not None:
                yield out
    return run


def matrix_of_codes(column: pa.ChunkedArray, tables: int, per_table: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, tables, per_table)


def _members(classes: DataFrame, tables: int, per_table: int) -> DataFrame:
    """A row for each class and cell, with `home` where it lives there."""
    entries = classes.select("*", F.posexplode("codes").alias("k", "cell"))
    return entries.withColumn("tab", F.expr(f"cast(k div {per_table} as int)")).withColumn("home", F.col("k") % per_table == 0).drop("k")


def near_vectors(
    rows: DataFrame, id: str, label: str, vector: str, threshold: float = 0.98,
    tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, cell: float = CELL, seed: int = SEED, tile: int = TILE,
) -> DataFrame:
    """row_id, id, n_links, component: for every row how many others of its label it links with, and its component."""
    per_table = 1 + probes
    items = F.transform(F.col(vector), lambda x: x.cast("double"))
    usable = F.col(label).isNotNull() & whole(F.col(vector)) & F.coalesce(F.exists(F.col(vector), lambda x: x != 0), F.lit(False))
    base = numbered(rows.select(
        F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"),
        usable.alias("usable"), F.xxhash64(F.lit(1), items).alias("h1"), F.xxhash64(F.lit(2), items).alias("h2")), "lattice-rows")

    # Copies: 128 bits of hash over the components.
    copies = ["label", "h1", "h2"]
    groups = written(base.where("usable").groupBy(*copies).agg(F.min("row_id").alias("class"), F.count("*").alias("size")), "lattice-classes")
    firsts = base.select(F.col("row_id").alias("class"), "vector").join(groups.select("class", "label", "size"), "class")
    kind = "float" if rows.schema[vector].dataType.elementType == T.FloatType() else "double"
    schema = f"class long, vector array<{kind}>, label long, size long, codes array<long>"
    plain = firsts.select("class", F.col("vector").cast(f"array<{kind}>").alias("vector"), "label", "size")
    classes = written(plain.mapInArrow(encoder((tables, blocks, probes, cell, seed)), schema), "lattice-codes")
    classes = classes.withColumn("width", F.size("vector"))

    place = ["label", "width", "tab", "cell"]
    counts = _members(classes.select("label", "width", "codes"), tables, per_table).groupBy(*place).agg(
        F.count("*").alias("n"), F.count_if("home").alias("homes"))
    shared = written(counts.where("n > 1 and homes > 0").select(*place, F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "lattice-cells")

    # Keys first: only members of shared cells fetch their vector, and only once a cell and tile pair.
    own = F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int")
    keys = _members(classes.select("class", "label", "width", "codes"), tables, per_table).drop("codes").join(shared, place).withColumn("own", own)
    keys = keys.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)"))).select(
        "class", "home", "own", *place, F.least("own", "other").alias("tile_a"), F.greatest("own", "other").alias("tile_b"))
    met = keys.join(classes.select("class", "size", "vector", "codes"), "class")
    found = written(
        met.repartition(*CELL_KEY).sortWithinPartitions(*CELL_KEY).mapInArrow(comparer(threshold, tables, per_table), FOUND_DDL), "lattice-found")

    links = found.groupBy("class").agg(F.sum("links").alias("others"))
    hung = connected(found.where("class <> root").select("class", "root"), "class", "root")
    ids = base.where("usable").join(groups, copies).select("class", "id")
    lowest = ids.groupBy("class").agg(F.min("id").alias("id"))
    hung = written(hung.select(F.col("node").alias("class"), "component"), "lattice-hung")
    least = lowest.join(hung, "class", "left").groupBy(F.coalesce("component", "class").alias("component")).agg(F.min("id").alias("least"))
    heads = groups.join(links, "class", "left").join(hung, "class", "left").withColumn(
        "component", F.coalesce("component", "class")).join(least, "component")
    heads = written(heads.select(*copies, (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "least"), "lattice-heads")
    alone = base.where("not usable").select("row_id", "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return base.where("usable").join(heads, copies).select("row_id", "id", "n_links", F.col("least").alias("component")).unionByName(alone)
