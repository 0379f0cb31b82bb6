"""The catalogue: its tables as lazily made DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from setlist.schema import TABLES


class Catalog:
    """Catalogue tables by attribute, e.g. `catalog.track`; a table is only read when asked for."""

    def __init__(self, load: Callable[[str], DataFrame], tables: dict[str, DataFrame] | None = None):
        self._load = load
        self._tables = dict(tables or {})

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self._load(name)
        return self._tables[name]

    def with_tables(self, **tables: DataFrame) -> Catalog:
        """The same catalogue with some tables exchanged."""
        return Catalog(self.table, tables)

    def register_views(self, spark: SparkSession, *names: str) -> None:
        """Expose tables to `spark.sql` under their own names."""
        for name in names or TABLES:
            self.table(name).createOrReplaceTempView(name)


def catalog_from_frames(spark: SparkSession, **tables: DataFrame) -> Catalog:
    """A catalogue over given frames; tables not given are empty."""
    return Catalog(lambda name: spark.createDataFrame([], TABLES[name]), tables)
