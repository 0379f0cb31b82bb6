"""Shared helpers: the scratch folder, written stages, word rules and segmented Bloom filters.

Row ids: `with_row_id` numbers rows by their place in the scan. The place is not the same in the
next scan, not even of a table: Spark cuts files by the number of cores alive. Operators that need
the ids in more than one pass take `numbered`, which scans once and stores the id with the row.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the white space of every contract here.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

SEGMENT_BITS = 32768  # bits of one binary of bitmap_construct_agg


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in a single-process session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="setlist-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


# The session setting that names the running stage's part of the scratch folder.
STAGE_SETTING = "spark.setlist.stage"


def remove_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stage_folder(spark: SparkSession) -> str:
    """The scratch folder, or the running stage's folder in it."""
    return f"{scratch_dir(spark)}/{spark.conf.get(STAGE_SETTING, '')}".rstrip("/")


# Spark's setting that removes the shuffle files of an execution when it ends.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame into the shared folder and read it back: later stages survive lost executors.

    The shuffle files of the write go when it ends, not with the driver's next garbage collection: a
    query of many written stages would hold those of all of them.
    """
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP_SETTING, None)
    spark.conf.set(CLEANUP_SETTING, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_SETTING)
        else:
            spark.conf.set(CLEANUP_SETTING, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Remove the files of written frames that nothing reads any more."""
    for df in frames:
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            remove_folder(df.sparkSession, folder)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    return df.withColumn(name, F.monotonically_increasing_id())


def numbered(df: DataFrame, stage: str) -> DataFrame:
    """The rows with a stored `row_id`, written in one scan: the same in all passes that read them."""
    return written(with_row_id(df), stage)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of anything but white space; no words: empty array."""
    parts = F.split(F.btrim(ascii_lower(text), F.lit(SPACES)), SPACE_CLASS + "+", -1)
    return F.filter(parts, lambda w: w != "")


# ------------------------------------------------------------------ segmented Bloom filters


def filter_bits(n_keys: int, bits_per_key: int = 8, at_most: int = 1 << 31) -> int:
    """A power of two near bits_per_key * n_keys, from one segment up to `at_most` bits."""
    bits = SEGMENT_BITS
    while bits < n_keys * bits_per_key and bits < at_most:
        bits *= 2
    return bits


def cell(key: Column, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(i), key), F.lit(bits))


def bloom_segments(keys: DataFrame, key: str, bits: int, hashes: int, twice: bool = False) -> DataFrame:
    """The filter of a key column as rows (segment, bitmap); with `twice` only cells hit twice or more.

    Cells are counted with map-side partial aggregation, so a frequent key is one row per task.
    The table has at most bits / 32768 rows of 4 KB.
    """
    cells = keys.select(F.explode(F.array(*[cell(F.col(key), i, bits) for i in range(hashes)])).alias("cell"))
    counted = cells.groupBy("cell").agg(F.count("*").alias("hits"))
    if twice:
        counted = counted.where("hits > 1")
    place = F.col("cell").cast("long")
    return (
        counted.select(F.expr(f"cell div {SEGMENT_BITS}").alias("segment"), (place % SEGMENT_BITS).alias("bit"))
        .groupBy("segment").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    )


def _longs(bitmap: str) -> Column:
    """A segment's bitmap as longs, eight bytes each: made once per segment, so that a test is plain arithmetic."""
    places = F.sequence(F.lit(0), F.lit(SEGMENT_BITS // 64 - 1))
    return F.transform(places, lambda i: F.conv(F.hex(F.substring(bitmap, i * 8 + 1, F.lit(8))), 16, -10).cast("bigint"))


def maybe_member(df: DataFrame, key: str, segments: DataFrame, bits: int, hashes: int, out: str) -> DataFrame:
    """Add boolean `out`: false only for keys that are surely not in the filter.

    The segments are broadcast; their size is bounded by `filter_bits(at_most=...)` / 8 bytes.
    """
    found, tests = df, []
    for i in range(hashes):
        at, seg, bitmap = f"{out}_at{i}", f"{out}_segment{i}", f"{out}_bitmap{i}"
        side = F.broadcast(segments.select(F.col("segment").alias(seg), _longs("bitmap").alias(bitmap)))
        found = found.withColumn(at, cell(F.col(key), i, bits))
        found = found.join(side, F.expr(f"{at} div {SEGMENT_BITS}") == F.col(seg), "left")
        held = F.expr(f"{bitmap}[cast(({at} % {SEGMENT_BITS}) div 64 as int)]")
        place = F.expr(f"cast(56 - {at} div 8 % 8 * 8 + {at} % 8 as int)")  # the first byte is the highest
        tests.append(F.coalesce(F.getbit(held, place) == 1, F.lit(False)))
    member = tests[0]
    for test in tests[1:]:
        member = member & test
    return found.select(*[F.col(f"`{c}`") for c in df.columns], member.alias(out))
