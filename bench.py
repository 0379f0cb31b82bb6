"""Time the headline queries; prints one JSON line.

Each query is built and run to the end (all rows, to a sink that drops them) once, after a
short warm-up query that is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from setlist.plans.registry import QUERIES  # noqa: E402
from setlist.session import build_session  # noqa: E402

HEADLINE = [
    "top_artists", "genre_track_counts", "play_count_histogram", "playlist_timeline", "flat_all", "playlist_as_df",
    "playlist_stats", "gross_valence", "energy_histogram", "track_genre_pairs", "search_doc_rows", "search_postings",
    "search_tracks", "search_tracks_scan", "search_names", "search_documents", "playlist_page", "artist_page_tracks",
    "genre_page", "explode_track_pages", "merge_playlists", "merge_tracks", "genre_links_repointed", "ingest_playlists",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]", "setlist-bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["artist_play_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale}))


if __name__ == "__main__":
    main()
