import json

from helpers import rows
from setlist.operators import sinks
from setlist.sources.tables import read_catalog
from setlist.streaming.loader import follow_landing, version_folder
from test_merge import artist, track


def _land(folder, name, file, lines):
    target = folder / name
    target.mkdir(parents=True, exist_ok=True)
    (target / file).write_text("\n".join(json.dumps(line) for line in lines))


def _payload(obj, seq, **more):
    return {"raw": json.dumps(obj), "load_seq": seq, **more}


def test_follow_landing(spark, tmp_path):
    landing, root, mark = tmp_path / "landing", str(tmp_path / "db"), str(tmp_path / "mark")
    sinks.create_tables(spark, version_folder(root, 0))
    songs = {s: track(s, "al") for s in ("t1", "t2")}
    _land(landing, "artists", "a.json", [_payload(artist("x", "X", popularity=1), 0)])
    _land(landing, "tracks", "a.json", [_payload(t, 0) for t in songs.values()])
    _land(landing, "albums", "a.json", [_payload({"id": "al", "name": "Al", "images": []}, 0)])

    def playlist(i, items):
        obj = {"id": f"p{i}", "name": f"list {i} 2021-01-0{i}", "description": None, "external_urls": {}}
        _land(landing, "track_pages", f"{i}.json", [_payload({"items": [{"track": songs[s]} for s in items]}, i, playlist_key=f"p{i}", page_no=0)])
        _land(landing, "playlists", f"{i}.json", [_payload(obj, i)])

    playlist(1, ["t1"])
    follow_landing(spark, str(landing), root, mark).awaitTermination()
    first = read_catalog(spark, version_folder(root, 1))
    assert rows(first.playlist, "spotify_id") == [("p1",)]

    playlist(2, ["t2", "t1"])
    follow_landing(spark, str(landing), root, mark).awaitTermination()
    second = read_catalog(spark, version_folder(root, 2))
    assert rows(second.playlist, "spotify_id") == [("p1",), ("p2",)]
    plays = second.playlist_track.join(second.playlist.select("playlist_id", "name"), "playlist_id").join(second.track.select("track_id", "spotify_id"), "track_id")
    assert rows(plays, "name", "sequence", "spotify_id") == [("list 1 2021-01-01", 0, "t1"), ("list 2 2021-01-02", 0, "t2"), ("list 2 2021-01-02", 1, "t1")]
    assert rows(second.track, "spotify_id", "album_id")[0][1] is not None
