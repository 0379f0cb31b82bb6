"""Writing tables. A table is always written to a fresh folder, never over one that is read."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from setlist.catalog import Catalog
from setlist.schema import TABLES
from setlist.session import shared_dir, shuffles_removed
from setlist.sources import folders


def save_catalog(catalog: Catalog, folder: str, names: Iterable[str] = TABLES) -> None:
    """Write tables to a new folder (one per version); an existing one is refused."""
    for name in names:
        catalog.table(name).write.mode("errorifexists").parquet(f"{folder}/{name}")


def create_tables(spark: SparkSession, folder: str) -> None:
    """Make the tables that are not there yet, empty."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}")


class Scratch:
    """A stage for loads that writes each frame to the shared folder and reads it back.

    The written table cuts the lineage and outlives lost executors; payload texts are long and alike, so it is
    packed with zstd. The shuffle files of a write go when it ends: a load of many stages would hold those of all. `remove` deletes all of it, once
    what was made from it has been stored; as a context manager it does so at the end, also of a failed load.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.root = spark, f"{folder or shared_dir(spark)}/stage-{uuid.uuid4().hex}"

    def __call__(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        with shuffles_removed(self.spark):
            df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        folders.remove(self.spark, self.root)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure) -> None:
        self.remove()


def written_stage(spark: SparkSession, folder: str | None = None) -> Callable[[str, DataFrame], DataFrame]:
    """A stage whose files stay, for results that are read after it."""
    return Scratch(spark, folder)


def write_json(rows: DataFrame, folder: str) -> None:
    """JSON lines, one object per row."""
    rows.write.mode("errorifexists").json(folder)
