"""Incremental load: new playlist payloads in a folder are ingested batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from setlist.catalog import Catalog
from setlist.operators.ingest import Landed, ingest
from setlist.operators.sinks import written_stage
from setlist.schema import TABLES
from setlist.session import shared_dir
from setlist.sources.payloads import LANDED, read_landed
from setlist.sources.tables import read_catalog


def version_folder(root: str, version: int) -> str:
    return f"{root}/v{version:08d}"


def save_version(catalog: Catalog, root: str, version: int) -> None:
    """Write a catalogue version. A repeated batch writes its own version again, never the one it reads."""
    for name in TABLES:
        catalog.table(name).write.mode("overwrite").parquet(f"{version_folder(root, version)}/{name}")


def load_batch(spark: SparkSession, landing: str, root: str, playlists: DataFrame, batch_id: int) -> None:
    """Version `batch_id` plus the landed playlists becomes version `batch_id + 1`."""
    before = read_catalog(spark, version_folder(root, batch_id))
    keys = playlists.select(F.get_json_object("raw", "$.id").alias("playlist_key")).distinct()
    pages = read_landed(spark, f"{landing}/track_pages").join(keys, "playlist_key", "left_semi")
    lookups = {name: read_landed(spark, f"{landing}/{name}") for name in ("artists", "tracks", "albums")}
    after, rejects = ingest(before, Landed(playlists=playlists, track_pages=pages, **lookups), written_stage(spark))
    save_version(after, root, batch_id + 1)
    rejects.write.mode("overwrite").parquet(f"{version_folder(root, batch_id + 1)}/album_rejects")


def follow_landing(spark: SparkSession, landing: str, root: str, checkpoint: str | None = None) -> StreamingQuery:
    """Ingest everything landed under `landing/playlists` that has not been ingested yet, then stop.

    `root` must hold version 0. The stream's own checkpoint remembers which files are done.
    """
    files = spark.readStream.schema(LANDED).json(f"{landing}/playlists")
    return (
        files.writeStream.foreachBatch(lambda batch, batch_id: load_batch(spark, landing, root, batch, batch_id))
        .option("checkpointLocation", checkpoint or f"{shared_dir(spark)}/follow-landing")
        .trigger(availableNow=True)
        .start()
    )
