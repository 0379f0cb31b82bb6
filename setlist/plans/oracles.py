"""SQL counterparts of the queries, for DuckDB over the driver's tables.

The catalogue views below repeat the binding of FIXTURES.md; each query is written on its own
terms, not as a copy of the DataFrame plan.
"""

from __future__ import annotations

import re

FEATURE_FACTORS = {
    "acousticness": 13, "danceability": 17, "energy": 11, "instrumentalness": 19,
    "liveness": 23, "loudness": 29, "speechiness": 31, "valence": 7,
}
_CONTINUOUS = ", ".join(FEATURE_FACTORS)
_FEATURES = f"key, mode, tempo, time_signature, {_CONTINUOUS}"


def _feature(name: str, factor: int) -> str:
    value = f"(p_partkey * {factor} % 1000) / cast(1000 as double)"
    if name == "valence":
        value = f"case when p_partkey % 19 <> 0 then {value} end"
    return f"{value} as {name}"


VIEWS: dict[str, str] = {
    "playlist": """
        select o_orderkey as playlist_id, 'pl' || o_orderkey as spotify_id, 'http://list/' || o_orderkey as spotify_url,
          'Set ' || o_orderpriority || ' :: ' || cast(cast(o_orderdate as date) as varchar) as name,
          o_orderpriority as description, cast(o_orderdate as date) as date,
          case when o_orderstatus = 'P' then '' else 'http://img/pl/' || o_orderkey || '/a http://img/pl/' || o_orderkey || '/b' end as images,
          case when o_orderstatus <> 'P' then 'http://img/pl/' || o_orderkey || '/a' end as image_url
        from orders""",
    "playlist_track": """
        select l_orderkey as playlist_id, l_partkey as track_id,
          row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 as sequence
        from lineitem""",
    "track": """
        select p_partkey as track_id, 'tr' || p_partkey as spotify_id, p_name as name,
          cast(60000 + p_size * 1000 as bigint) as duration_ms, p_size % 2 = 0 as explicit, cast(p_size * 2 as bigint) as popularity,
          'ISRC' || p_partkey as isrc_id, 'http://track/' || p_partkey as spotify_url,
          case when p_partkey % 5 <> 0 then 'http://preview/' || p_partkey end as preview_url,
          case when p_size <> 50 then cast(substring(p_brand, 7) as bigint) end as album_id
        from part""",
    "brand": "select p_partkey as track_id, cast(substring(p_brand, 7) as bigint) as brand from part",
    "artist": """
        select s_suppkey as artist_id, 'Artist ' || (s_suppkey % 80) as name, 'ar' || s_suppkey as spotify_id,
          'http://artist/' || s_suppkey as spotify_url,
          case when s_nationkey < 10 then 'http://img/ar/' || s_suppkey || '/a http://img/ar/' || s_suppkey || '/b http://img/ar/' || s_suppkey || '/c'
               when s_nationkey < 20 then 'http://img/ar/' || s_suppkey || '/a http://img/ar/' || s_suppkey || '/b' else '' end as images,
          cast(floor(abs(s_acctbal)) as bigint) % 101 as popularity, cast(floor(abs(s_acctbal)) as bigint) * 100 as followers
        from supplier""",
    "album": """
        select distinct cast(substring(p_brand, 7) as bigint) as album_id, 'al' || substring(p_brand, 7) as spotify_id,
          'https://open.spotify.com/album/al' || substring(p_brand, 7) as spotify_url, 'Album ' || p_brand as name,
          'Label ' || substring(p_brand, 7) as label,
          case when cast(substring(p_brand, 7) as int) < 20
               then 'http://img/al/' || substring(p_brand, 7) || '/a http://img/al/' || substring(p_brand, 7) || '/b http://img/al/'
                    || substring(p_brand, 7) || '/c http://img/al/' || substring(p_brand, 7) || '/d'
               else 'http://img/al/' || substring(p_brand, 7) || '/a' end as images,
          cast(substring(p_brand, 7) as bigint) * 4 as popularity
        from part""",
    "genre": "select cast(n_nationkey as bigint) as genre_id, r_name as name from nation join region on n_regionkey = r_regionkey",
    "artist_genre": """
        select s_suppkey as artist_id, cast(s_nationkey as bigint) as genre_id from supplier
        union select s_suppkey, s_suppkey % 25 from supplier""",
    "track_artist": "select distinct l_partkey as track_id, l_suppkey as artist_id from lineitem",
    "audio_features": f"""
        select p_partkey as features_id, p_partkey as track_id, 'http://analysis/' || p_partkey as analysis_url,
          cast(p_partkey % 14 - 1 as int) as key, cast(p_partkey % 3 as int) as mode,
          60 + p_size * cast(2.5 as double) as tempo, cast(3 + p_partkey % 3 as int) as time_signature,
          {', '.join(_feature(n, f) for n, f in FEATURE_FACTORS.items())}
        from part where p_partkey % 17 <> 0""",
    "album_artist": """
        select distinct t.album_id, ta.artist_id from track t join track_artist ta on t.track_id = ta.track_id
        where t.album_id is not null""",
    "album_track": "select album_id, track_id from track where album_id is not null",
    # helpers of several queries
    "track_names": """
        select t.track_id, string_agg(a.name, ', ' order by a.artist_id) as artists
        from track t join track_artist ta on t.track_id = ta.track_id join artist a on a.artist_id = ta.artist_id group by t.track_id""",
    # The names of the twelve pitches.
    "labelled": """
        select *, case when key between -12 and 11 then
            list_extract(['C','C♯','D','E♭','E','F','F♯','G','A♭','A','B♭','B'], case when key < 0 then key + 13 else key + 1 end) else '' end as key_str,
          case mode when 0 then 'major' when 1 then 'minor' else '' end as mode_str
        from audio_features""",
    "records": f"""
        select t.track_id as track_pk, t.spotify_id as track_id, t.name, t.duration_ms, t.explicit, t.popularity, al.name as album,
          coalesce(n.artists, '') as artists, f.key, coalesce(f.key_str, '') as key_str, f.mode, coalesce(f.mode_str, '') as mode_str,
          f.tempo, f.time_signature, {_CONTINUOUS}
        from track t left join album al on al.album_id = t.album_id
        left join track_names n on n.track_id = t.track_id left join labelled f on f.track_id = t.track_id""",
    "started": """
        select b.playlist_id, b.sequence, b.track_id, cast(coalesce((
            select sum(t.duration_ms) from playlist_track e join track t on t.track_id = e.track_id
            where e.playlist_id = b.playlist_id and e.sequence < b.sequence), 0) as bigint) as start_time_ms
        from playlist_track b""",
    "flat": """
        select s.playlist_id, s.sequence, r.* exclude (track_pk), s.start_time_ms, strftime(p.date, '%Y-%m-%d') as date,
          cast(year(p.date) as int) as year, cast(month(p.date) as int) as month, cast(day(p.date) as int) as day
        from started s join playlist p on p.playlist_id = s.playlist_id join records r on r.track_pk = s.track_id""",
    "cells": f"""
        select t.track_id, coalesce(t.preview_url <> '', false) as has_preview, t.spotify_url, coalesce(n.artists, '') as artists,
          t.name as track, t.popularity, {_CONTINUOUS}, coalesce(f.key_str, '') || ' ' || coalesce(f.mode_str, '') as key,
          f.tempo, f.time_signature
        from track t left join track_names n on n.track_id = t.track_id left join labelled f on f.track_id = t.track_id""",
    "listing": """
        select spotify_id, name, description as owner, row_number() over (partition by description order by date desc, playlist_id) - 1 as r
        from playlist""",
    "artist_plays": """
        select a.name, count(*) as count from artist a join track_artist ta on a.artist_id = ta.artist_id
        join playlist_track pt on pt.track_id = ta.track_id group by a.name""",
    "genre_plays": """
        select g.name as genre, count(t.name) as tracks from track t join track_artist ta on t.track_id = ta.track_id
        join artist_genre ag on ag.artist_id = ta.artist_id join genre g on g.genre_id = ag.genre_id group by g.name""",
    "doc_rows": """
        select p.playlist_id, pt.sequence, t.track_id, t.name as track, a.artist_id, a.name as artist, al.name as album
        from playlist p join playlist_track pt on p.playlist_id = pt.playlist_id join track t on t.track_id = pt.track_id
        join track_artist ta on ta.track_id = t.track_id join artist a on a.artist_id = ta.artist_id
        join album al on al.album_id = t.album_id""",
    "docs": """
        select track_id, string_agg(artist, ';' order by artist_id) as artist, track, album
        from (select distinct track_id, track, artist_id, artist, album from doc_rows) group by track_id, track, album""",
    "doc_text": """
        select track_id, field, ' ' || array_to_string(regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+'), ' ') || ' ' as norm
        from (select track_id, 'artist' as field, artist as text from docs
              union all select track_id, 'track', track from docs union all select track_id, 'album', album from docs)""",
    "hits": """
        select distinct d1.track_id from doc_text d1 join doc_text d2 on d1.track_id = d2.track_id join doc_text d3 on d1.track_id = d3.track_id
        where contains(d1.norm, ' small ring ') and contains(d2.norm, ' artist ') and contains(d3.norm, ' brand ')""",
    "played": f"""
        select p.playlist_id, p.name as playlist_name, p.date, pt.sequence, t.track_id, t.name, t.duration_ms, {_FEATURES},
          f.features_id, f.analysis_url
        from playlist_track pt join playlist p on p.playlist_id = pt.playlist_id join track t on t.track_id = pt.track_id
        join audio_features f on f.track_id = t.track_id""",
    "first_play": """
        select * from (select *, row_number() over (partition by name order by date, playlist_id, sequence) as rn from played
                       where track_id in (select track_id from track_artist)) where rn = 1""",
    "name_artists": """
        select name, string_agg(artist, ';' order by artist_id) as artist from (
          select distinct b.name, a.artist_id, a.name as artist from played b join track_artist ta on ta.track_id = b.track_id
          join artist a on a.artist_id = ta.artist_id) group by name""",
    "loaded": "select * from playlist where date >= date '1996-01-01'",
    "loaded_tracks": "select distinct track_id from playlist_track where playlist_id in (select playlist_id from loaded)",
    "new_images": """
        select playlist_id, date < date '1997-01-01' as known,
          case when description <> '5-LOW' then images when year(date) % 2 = 1 then 'http://img/draft'
               when date < date '1997-01-01' then 'http://img/old' end as new_images
        from playlist""",
}


def _numbered(keys: str, key: str) -> str:
    """Keys with the number a new key gets on top of the ids already given: bucket b hands out b + 1, b + 4097, ..."""
    return f"""
        select {key}, 1 + b + 4096 * (row_number() over (partition by b order by {key}) - 1) as n
        from (select {key}, cast('0x' || substring(md5({key}), 1, 3) as bigint) as b from ({keys}))"""


def _profile(table: str, column: str) -> str:
    return f"select '{table}' as table_name, count(*) as n_rows, min({column}) as min_id, max({column}) as max_id from {table}"


_IDS = {
    "playlist": "playlist_id", "playlist_track": "playlist_id", "track": "track_id", "artist": "artist_id", "album": "album_id",
    "genre": "genre_id", "audio_features": "features_id", "track_artist": "track_id", "artist_genre": "artist_id",
    "album_artist": "album_id", "album_track": "album_id",
}
_SONG_COLUMNS = "t.track_id, t.spotify_id, t.name, t.duration_ms, t.explicit, t.popularity, t.isrc_id, t.spotify_url, t.preview_url"

def _object(fields: str) -> str:
    """SQL of a JSON object of these columns."""
    return f"json_object({', '.join(f"'{f}', {f}" for f in fields.split())})"


_FEATURE_FIELDS = "key key_str mode mode_str tempo time_signature " + " ".join(FEATURE_FACTORS)
_RECORD_FIELDS = "track_id name duration_ms explicit popularity album artists " + _FEATURE_FIELDS
_FLAT_FIELDS = _RECORD_FIELDS + " date year month day start_time_ms"

# Links after some listed playlists were loaded on top of the earlier state.
_STORED = """
        with wanted as (select p.playlist_id from listing l join playlist p on p.spotify_id = l.spotify_id where {wanted}),
        touched as (select distinct track_id from playlist_track where playlist_id in (select playlist_id from wanted)),
        lists as (
          select playlist_id, spotify_id as playlist_key, name from playlist where playlist_id in (select playlist_id from wanted)
          union all select playlist_id, spotify_id, 'old name' from playlist
            where date < date '1997-01-01' and playlist_id not in (select playlist_id from wanted)),
        plays as (
          select * from playlist_track where playlist_id in (select playlist_id from wanted)
          union all select pt.playlist_id, pt.track_id, pt.sequence + 100 from playlist_track pt join track t on t.track_id = pt.track_id
            where not t.explicit and pt.playlist_id not in (select playlist_id from wanted))
        select l.playlist_key, l.name, p.sequence, t.spotify_id as track_key,
          case when t.track_id in (select track_id from touched) then t.name else 'old ' || t.name end as track
        from lists l join plays p on p.playlist_id = l.playlist_id join track t on t.track_id = p.track_id"""

_BODIES: dict[str, str] = {
    # scans and landed payloads
    "scan_catalog": " union all ".join(_profile(t, c) for t, c in _IDS.items()),
    "natural_key_duplicates": " union all ".join(
        f"select '{t}' as table_name, {k} as natural_key, count(*) as n_rows from {t} group by {k} having count(*) > 1"
        for t, k in {"playlist": "spotify_id", "artist": "spotify_id", "track": "spotify_id", "album": "spotify_id", "genre": "name"}.items()
    ),
    "scan_playlist": "select * exclude (image_url) from playlist",
    **{f"scan_{t}": f"select * from {t}" for t in _IDS if t != "playlist"},
    "explode_track_pages": """
        select 'pl' || playlist_id as playlist_key, sequence // 3 as page_no, sequence as position, 'tr' || track_id as track_key
        from playlist_track""",
    "compact_tracks": """
        select 'pl' || pt.playlist_id as playlist_key, pt.sequence as position, coalesce(n.artists, '') as artist, t.name as title,
          'Album of al' || b.brand as album, t.spotify_url as url
        from playlist_track pt join track t on t.track_id = pt.track_id join brand b on b.track_id = t.track_id
        left join track_names n on n.track_id = t.track_id""",
    "filter_playlist_listing": """
        select spotify_id, name, r // 50 as page_no, r % 50 as pos from listing where name ilike '%set%' and name ilike '%urgent%'""",
    "playlists_of_user": "select spotify_id, name, owner, r as pos from listing where owner = '2-HIGH' and r < 50",
    "artist_payload_by_id": """
        select spotify_id, name, case when popularity between 21 and 59 or popularity between 71 and 80 then popularity end as popularity, followers
        from artist where artist_id = 7""",
    "payloads_for_ids": """
        select spotify_id, name, case when popularity between 21 and 59 or popularity between 71 and 80 then popularity end as popularity,
          popularity between 21 and 59 or popularity > 70 as has_popularity, followers
        from artist where artist_id in (select artist_id from track_artist)""",
    # merges
    "merge_playlists": f"""
        select case when i.known then p.playlist_id
            else (select max(playlist_id) from playlist where date < date '1997-01-01') + k.n end as playlist_id,
          p.spotify_id, p.spotify_url, p.name, nullif(p.description, '3-MEDIUM') as description,
          case when year(p.date) >= 2000 then p.date end as date, i.new_images as images
        from playlist p join new_images i on i.playlist_id = p.playlist_id
        left join ({_numbered("select spotify_id from playlist where date >= date '1997-01-01'", "spotify_id")}) k on k.spotify_id = p.spotify_id""",
    "merge_tracks": f"""
        select case when t.explicit then (select max(track_id) from track where not explicit) + k.n else t.track_id end as track_id,
          {_SONG_COLUMNS.replace('t.track_id, ', '')}, case when not t.explicit then t.album_id end as album_id
        from track t left join ({_numbered("select spotify_id from track where explicit", "spotify_id")}) k on k.spotify_id = t.spotify_id""",
    "append_track_artist_links": "select track_id, artist_id from track_artist",
    "ordered_track_artists": """
        with links as (select ta.track_id, a.artist_id, a.name, not t.explicit and a.popularity >= 50 as early
                       from track_artist ta join track t on t.track_id = ta.track_id join artist a on a.artist_id = ta.artist_id)
        select track_id, string_agg(name, ', ' order by not early, case when early then artist_id else -artist_id end) as artists
        from links group by track_id""",
    "merge_artists": f"""
        select case when a.popularity >= 50 then a.artist_id else (select max(artist_id) from artist where popularity >= 50) + k.n end as artist_id,
          a.name, a.spotify_id, a.spotify_url, a.images,
          case when a.popularity between 60 and 70 then 7 when a.popularity between 21 and 80 then a.popularity end as popularity, a.followers
        from artist a left join ({_numbered("select spotify_id from artist where popularity < 50", "spotify_id")}) k on k.spotify_id = a.spotify_id""",
    "merge_genres": f"""
        select genre_id, name from genre where name <= 'ASIA' union all
        select (select max(genre_id) from genre where name <= 'ASIA') + n, name
        from ({_numbered("select distinct name from genre join artist_genre using (genre_id) where name > 'ASIA'", "name")})""",
    "append_artist_genres": """
        with had as (select ag.artist_id, ag.genre_id, g.name from artist_genre ag join genre g on g.genre_id = ag.genre_id
                     join artist a on a.artist_id = ag.artist_id where g.name <= 'ASIA' and a.popularity >= 50),
        told as (select distinct ag.artist_id, g.name from artist_genre ag join genre g on g.genre_id = ag.genre_id)
        select artist_id, genre_id from had union all
        select t.artist_id, (select min(genre_id) from genre g where g.name = t.name) from told t
        where not exists (select 1 from had h where h.artist_id = t.artist_id and h.name = t.name)""",
    "artists_to_refresh": """
        select spotify_id from artist where artist_id in (
          select artist_id from track_artist where track_id in (select track_id from loaded_tracks))""",
    "merge_albums": f"""
        select case when a.album_id >= 10 then a.album_id else (select max(album_id) from album) + k.n end as album_id,
          a.spotify_id, a.spotify_url, a.name,
          case when a.album_id > 20 then 'old label' when a.album_id > 5 then a.label end as label, a.images,
          case when a.album_id >= 15 then 1 else a.popularity end as popularity
        from album a left join ({_numbered("select spotify_id from album where album_id < 10", "spotify_id")}) k on k.spotify_id = a.spotify_id""",
    "fill_missing_albums": """
        select t.track_id, t.spotify_id, coalesce(t.album_id, case when b.brand <= 20 then b.brand end) as album_id
        from track t join brand b on b.track_id = t.track_id""",
    "album_rejects": """
        select t.spotify_id, 'al' || b.brand as album_key from track t join brand b on b.track_id = t.track_id
        where t.album_id is null and b.brand > 20""",
    "attach_audio_features": f"""
        select case when t.explicit then (select max(features_id) from audio_features f join track t on t.track_id = f.track_id where not t.explicit) + k.n
            else f.features_id end as features_id, f.track_id, f.analysis_url, {_FEATURES}
        from audio_features f join track t on t.track_id = f.track_id
        left join ({_numbered("select t.spotify_id from audio_features f join track t on t.track_id = f.track_id where t.explicit", "spotify_id")}) k
          on k.spotify_id = t.spotify_id""",
    "patch_images": """
        select p.playlist_id, p.spotify_id, p.spotify_url, 'old name' as name, 'old' as description, cast(null as date) as date, i.new_images as images
        from playlist p join new_images i on i.playlist_id = p.playlist_id where i.known""",
    "delete_playlist": """
        select p.playlist_id, p.name, pt.track_id, pt.sequence from playlist p left join playlist_track pt on pt.playlist_id = p.playlist_id
        where p.date >= date '1997-01-01'""",
    "remove_at_position": """
        select playlist_id, track_id, case when sequence > 1 then sequence - 1 else sequence end as sequence
        from playlist_track where sequence <> 1""",
    "ingest_playlists": """
        with lists as (
          select playlist_id, spotify_id as playlist_key, name, case when year(date) >= 2000 then date end as date from loaded
          union all select playlist_id, spotify_id, 'old name', cast(null as date) from playlist where date < date '1996-01-01'),
        plays as (
          select pt.* from playlist_track pt join loaded l on l.playlist_id = pt.playlist_id
          union all select pt.playlist_id, pt.track_id, pt.sequence + 100 from playlist_track pt
            join playlist p on p.playlist_id = pt.playlist_id join track t on t.track_id = pt.track_id
            where p.date < date '1996-01-01' and not t.explicit),
        songs as (
          select t.track_id, t.spotify_id as track_key, case when l.track_id is null then 'old ' || t.name else t.name end as track,
            case when t.explicit and b.brand <= 20 or not t.explicit and b.brand >= 10 then 'al' || b.brand end as album_key
          from track t join brand b on b.track_id = t.track_id left join loaded_tracks l on l.track_id = t.track_id)
        select l.playlist_key, l.name, l.date, p.sequence, s.track_key, s.track, s.album_key
        from lists l left join plays p on p.playlist_id = l.playlist_id left join songs s on s.track_id = p.track_id""",
    "ingest_table_sizes": """
        with songs as (select * from track where not explicit or track_id in (select track_id from loaded_tracks)),
        arrived as (select distinct b.brand as album_id from track t join brand b on b.track_id = t.track_id
          where t.explicit and t.track_id in (select track_id from loaded_tracks) and b.brand <= 20),
        popular as (select artist_id from artist where popularity >= 50),
        early_genres as (select ag.artist_id, ag.genre_id, g.name from artist_genre ag join genre g on g.genre_id = ag.genre_id
          where g.name <= 'ASIA' and ag.artist_id in (select artist_id from popular)),
        told as (select distinct ag.artist_id, g.name from artist_genre ag join genre g on g.genre_id = ag.genre_id)
        select 'playlist' as table_name, (select count(*) from playlist) as n_rows
        union all select 'playlist_track', (select count(*) from playlist_track pt join playlist p on p.playlist_id = pt.playlist_id
          join track t on t.track_id = pt.track_id where p.date >= date '1996-01-01' or not t.explicit)
        union all select 'track', (select count(*) from songs)
        union all select 'artist', (select count(*) from artist)
        union all select 'album', (select count(*) from album where album_id >= 10 or album_id in (select album_id from arrived))
        union all select 'genre', (select count(*) from genre where name <= 'ASIA') + (select count(distinct name) from told where name > 'ASIA')
        union all select 'audio_features', (select count(*) from audio_features where track_id in (select track_id from songs))
        union all select 'track_artist', (select count(*) from track_artist ta join track t on t.track_id = ta.track_id
          where t.track_id in (select track_id from loaded_tracks) or not t.explicit and ta.artist_id in (select artist_id from popular))
        union all select 'artist_genre', (select count(*) from early_genres) + (select count(*) from told t
          where not exists (select 1 from early_genres e where e.artist_id = t.artist_id and e.name = t.name))
        union all select 'album_artist', (select count(*) from album_artist where album_id in (select album_id from arrived)
          or album_id >= 10 and artist_id in (select artist_id from popular))""",
    "merge_track_versions": """
        with last as (select track_id, max_by(sequence, playlist_id * 1000000 + sequence) as sequence from playlist_track group by track_id)
        select t.spotify_id, case when l.track_id is null then 'old ' || t.name else t.name || ' @' || l.sequence end as name, t.duration_ms, t.popularity
        from track t left join last l on l.track_id = t.track_id where l.track_id is not null or not t.explicit""",
    **{f"load_{what}_tables": _STORED.format(wanted=wanted) for what, wanted in {
        "latest": "owner = '1-URGENT' and r = 0", "all": "owner = '1-URGENT'"}.items()},
    "latest_listing_entry": "select spotify_id, name from listing where owner = '1-URGENT' and r = 0",
    "ingest_all_order": """
        select spotify_id, name, r as listing_pos, (select count(*) from listing where owner = '1-URGENT') - 1 - r as load_seq
        from listing where owner = '1-URGENT'""",
    # relationships
    "playlist_tracks_outer": """
        select p.playlist_id, p.name as playlist_name, pt.sequence, pt.track_id, ta.artist_id from playlist p
        left join playlist_track pt on pt.playlist_id = p.playlist_id left join track_artist ta on ta.track_id = pt.track_id""",
    "playlist_tracklist": """
        select p.playlist_id, p.name as playlist_name, pt.sequence, t.track_id, t.name as track from playlist p
        join playlist_track pt on pt.playlist_id = p.playlist_id join track t on t.track_id = pt.track_id""",
    "enumerate_tracks": """
        select pt.playlist_id, pt.sequence as position, t.track_id, t.name from playlist_track pt join track t on t.track_id = pt.track_id""",
    "track_playlists": """
        select pt.track_id, pt.playlist_id, pt.sequence, p.name as playlist_name, p.date
        from playlist_track pt join playlist p on p.playlist_id = pt.playlist_id""",
    "playlist_features": f"""
        select b.date, b.playlist_name, b.playlist_id, b.sequence, b.track_id, b.name, a.artist_id, a.name as artist, b.duration_ms, {_FEATURES}
        from played b join track_artist ta on ta.track_id = b.track_id join artist a on a.artist_id = ta.artist_id""",
    "playlist_as_df": f"""
        select f.date, f.playlist_name, f.playlist_id, f.name, n.artist, f.duration_ms, f.features_id, f.track_id, f.analysis_url, {_FEATURES}
        from first_play f join name_artists n on n.name = f.name""",
    "playlist_features_projected": """
        select f.date, f.playlist_name, f.playlist_id, f.name, n.artist, f.duration_ms, f.valence, f.energy, f.tempo
        from first_play f join name_artists n on n.name = f.name""",
    "playlist_as_df_repeated": """
        select f.date, f.playlist_name, f.playlist_id, f.name, n.artist, f.duration_ms, f.valence * 100 as valence_pct, f.key
        from first_play f join (
          select b.name, string_agg(a.name, ';' order by a.artist_id) as artist from played b join track_artist ta on ta.track_id = b.track_id
          join artist a on a.artist_id = ta.artist_id group by b.name) n on n.name = f.name""",
    "playlist_as_df_runs": """
        select b.name, a.artist_id, a.name as artist, count(*) as times from played b join track_artist ta on ta.track_id = b.track_id
        join artist a on a.artist_id = ta.artist_id group by all""",
    "sql_long_playlists": """
        select p.spotify_id, p.name, count(*) as n_tracks, cast(sum(t.duration_ms) as bigint) as duration_ms
        from playlist p join playlist_track pt on pt.playlist_id = p.playlist_id join track t on t.track_id = pt.track_id
        where p.date >= date '1996-01-01' and t.popularity >= 20 group by p.spotify_id, p.name""",
    "saved_tables": " union all ".join(
        [_profile(t, _IDS[t]) for t in ("playlist", "track", "artist", "genre", "artist_genre")]
        + [f"select '{t}', 0, null, null" for t in ("album", "audio_features")]),
    "random_playlist": """
        select spotify_id, name from listing where name ilike '%set%' and name ilike '%urgent%' order by md5(spotify_id || '|7') limit 1""",
    "track_links": """
        select t.track_id, t.spotify_id, t.spotify_url, t.preview_url, coalesce(t.preview_url <> '', false) as has_preview, t.album_id is not null as has_album,
          cast(row_number() over (partition by t.track_id order by a.artist_id) - 1 as int) as place, a.spotify_id as artist_spotify_id, a.name as artist
        from track t join track_artist ta on ta.track_id = t.track_id join artist a on a.artist_id = ta.artist_id
        union all select t.track_id, t.spotify_id, t.spotify_url, t.preview_url, coalesce(t.preview_url <> '', false), t.album_id is not null, null, null, null
        from track t where t.track_id not in (select track_id from track_artist)""",
    "sorted_genre_artists": """
        with firsts as (select name as genre, min(genre_id) as genre_id from genre group by name)
        select f.genre, a.artist_id, a.spotify_id, a.name, a.popularity, format('{:,}', a.followers) as followers
        from firsts f join artist_genre ag on ag.genre_id = f.genre_id join artist a on a.artist_id = ag.artist_id
        order by f.genre, a.followers desc, a.artist_id""",
    "search_blank_queries": """
        select distinct o_orderpriority as query_id, case when o_orderpriority like '5%' then (
            select count(distinct d1.track_id) from doc_text d1 join doc_text d2 on d1.track_id = d2.track_id
            where contains(d1.norm, ' small ') and contains(d2.norm, ' ring ')) else 0 end as n_hits from orders""",
    "track_genre_pairs": """
        select t.name as track, g.name as genre from track t join track_artist ta on t.track_id = ta.track_id
        join artist_genre ag on ag.artist_id = ta.artist_id join genre g on g.genre_id = ag.genre_id""",
    "artist_tracks": """
        select a.artist_id, a.name as artist, t.track_id, t.name as track from artist a join track_artist ta on ta.artist_id = a.artist_id
        join track t on t.track_id = ta.track_id""",
    "artist_albums": """
        select a.artist_id, a.name as artist, al.album_id, al.name as album from artist a join album_artist aa on aa.artist_id = a.artist_id
        join album al on al.album_id = aa.album_id""",
    "genre_artists": """
        select g.genre_id, g.name as genre, a.artist_id, a.name as artist from genre g join artist_genre ag on ag.genre_id = g.genre_id
        join artist a on a.artist_id = ag.artist_id""",
    "track_album": """
        select t.track_id, t.name as track, al.album_id, al.name as album from track t left join album al on al.album_id = t.album_id""",
    "track_features": f"""
        select t.track_id, t.name as track, f.features_id, {_FEATURES} from track t left join audio_features f on f.track_id = t.track_id""",
    "track_flat": "select * exclude (track_pk) from records",
    "feature_records": f"select features_id, track_id, key, key_str, mode, mode_str, tempo, time_signature, {_CONTINUOUS} from labelled",
    "tracks_missing_album": "select * from track where album_id is null",
    "previewless_tracks": "select * from track where preview_url is null",
    "previewless_tracks_head": "select * from track where preview_url is null order by track_id limit 10",
    "playlist_by_name": "select playlist_id, spotify_id, name, date from playlist where name = 'Set 2-HIGH :: 1996-06-06'",
    "playlist_name_contains": "select spotify_id, name from listing where name like '%1996-06%' order by r, spotify_id limit 1",
    "display_labels": """
        select 'playlist' as kind, playlist_id as id, name || ' (Playlist)' as label from playlist
        union all select 'artist', artist_id, name || ' (Artist)' from artist
        union all select 'track', t.track_id, t.name || ' by ' || coalesce(n.artists, '') from track t left join track_names n on n.track_id = t.track_id""",
    "pick_images": """
        select 'artist' as kind, s_suppkey as id,
          case when s_nationkey < 10 then u || 'b' end as exact_640, cast(null as varchar) as exact_300,
          case when s_nationkey < 10 then u || 'c' when s_nationkey < 20 then u || 'a' end as max_400,
          case when s_nationkey < 10 then u || 'b' when s_nationkey < 20 then u || 'a' end as min_100,
          case when s_nationkey < 10 then u || 'b' when s_nationkey < 20 then u || 'a' end as "between",
          cast(null as varchar) as too_big, case when s_nationkey < 20 then u || 'a' end as "first"
        from (select *, 'http://img/ar/' || s_suppkey || '/' as u from supplier)
        union all select 'album', album_id, case when album_id < 20 then u || 'a' end, case when album_id < 20 then u || 'c' end,
          case when album_id < 20 then u || 'c' else u || 'a' end, case when album_id < 20 then u || 'a' end,
          case when album_id < 20 then u || 'a' end, null, u || 'a'
        from (select *, 'http://img/al/' || album_id || '/' as u from album)""",
    # timeline
    "playlist_timeline": """
        select s.playlist_id, s.sequence, t.spotify_id as track_id, t.duration_ms, s.start_time_ms
        from started s join track t on t.track_id = s.track_id""",
    "flat_all": "select * from flat",
    "flat_strict": """
        select playlist_id, sequence, track_id, album, energy, start_time_ms from flat where album is not null and energy is not null""",
    "flat_head": """
        select date, playlist_id, sequence, track_id, name, start_time_ms from flat order by date, playlist_id, sequence limit 1000""",
    "flat_count": "select count(*) as n from playlist_track",
    "flat_by_track_name": "select playlist_id, sequence, track_id, name, artists, start_time_ms from flat where name = 'small ring'",
    "prune_flat": "select name, artists, acousticness, time_signature, track_id from flat",
    "threshold_flag": """
        select name, artists, acousticness, time_signature, track_id, case when acousticness > 0.9 then 'red' else 'lightgrey' end as color from flat""",
    "track_json": f"select track_pk, cast({_object(_RECORD_FIELDS)} as varchar) as record from records",
    "feature_json": f"select features_id, track_id, cast({_object(_FEATURE_FIELDS)} as varchar) as record from labelled",
    "timeline_json": f"select playlist_id, sequence, cast({_object(_FLAT_FIELDS)} as varchar) as record from flat",
    "timeline_json_arrays": f"""
        select playlist_id, sequence // 10000 as part,
          '[' || string_agg(cast({_object(_FLAT_FIELDS)} as varchar), ',' order by sequence) || ']' as records
        from flat group by playlist_id, sequence // 10000""",
    "timeline_json_parsed": """
        select playlist_id, sequence as pos, track_id, name, date, key_str, start_time_ms, energy from flat""",
    # statistics
    "artist_play_counts": "select * from artist_plays",
    "top_artists": "select * from artist_plays order by count desc, name limit 5",
    "artists_min_plays": "select * from artist_plays where count >= 5",
    "play_count_histogram": "select count, count(name) as artists from artist_plays group by count",
    "genre_track_counts": "select * from genre_plays",
    "top_genres": "select * from genre_plays order by tracks desc, genre limit 50",
    "gross_valence": """
        select playlist_name, cast(coalesce(sum(cast(valence * duration_ms as decimal(38, 6))), 0) as double) as gross_valence
        from played group by playlist_name""",
    "playlist_stats": f"""
        with ranked as (
          select playlist_id, 'key' as what, key as a, 0 as b, count(*) as n from played where key is not null group by all
          union all select playlist_id, 'mode', mode, 0, count(*) from played where mode is not null group by all
          union all select playlist_id, 'time', time_signature, 0, count(*) from played where time_signature is not null group by all
          union all select playlist_id, 'pair', key, mode, count(*) from played where key is not null and mode is not null group by all),
        top as (select * from (select *, row_number() over (partition by playlist_id, what order by n desc, a, b) as rn from ranked) where rn = 1)
        select p.playlist_id, p.playlist_name, max(k.a) as key, max(m.a) as mode, avg(p.tempo) as tempo, max(t.a) as time_signature,
          {', '.join(f'cast(coalesce(sum(cast({n} * duration_ms as decimal(38, 6))), 0) as double) as {n}' for n in FEATURE_FACTORS)},
          max(x.a) as pair_key, max(x.b) as pair_mode
        from played p left join top k on k.playlist_id = p.playlist_id and k.what = 'key'
        left join top m on m.playlist_id = p.playlist_id and m.what = 'mode'
        left join top t on t.playlist_id = p.playlist_id and t.what = 'time'
        left join top x on x.playlist_id = p.playlist_id and x.what = 'pair'
        group by p.playlist_id, p.playlist_name""",
    "artist_track_counts": """
        select a.artist_id, a.name, (select count(*) from track_artist ta where ta.artist_id = a.artist_id) as tracks from artist a""",
    "energy_histogram": """
        with v as (select f.energy as x from playlist_track pt join audio_features f on f.track_id = pt.track_id),
        r as (select min(x) as lo, max(x) as hi from v),
        s as (select lo, hi, (select min(step) from (values (0.001), (0.002), (0.005), (0.01), (0.02), (0.05), (0.1), (0.2), (0.5), (1.0)) c(step)
                              where (hi - lo) / step <= 10) as step from r),
        e as (select cast(floor(lo / step + 1e-9) as bigint) as first, cast(ceil(hi / step) as bigint) as last, cast(step as double) as step from s),
        b as (select cast(least(floor(v.x / e.step + 1e-9), e.last - 1) as bigint) as k, e.* from v, e)
        select cast(k - first as int) as bin, round(k * step, 9) as bin_start, round((k + 1) * step, 9) as bin_end, count(*) as count
        from b group by k, first, step""",
    # genres
    "genre_canonical": "select min(genre_id) as genre_id, name from genre group by name",
    "genre_links_repointed": """
        select distinct ag.artist_id, (select min(o.genre_id) from genre o where o.name = g.name) as genre_id
        from artist_genre ag join genre g on g.genre_id = ag.genre_id""",
    "genre_repair_report": "select count(distinct name) as unique_names, count(*) as rows_before, count(distinct name) as rows_after from genre",
    "genre_names": "select distinct name from genre order by name",
    # search
    "search_doc_rows": "select * from doc_rows",
    "track_artist_runs": "select track_id, track, artist_id, artist, count(*) as times from doc_rows group by all",
    "track_artist_concat": "select track_id, track, artist from docs",
    "track_artist_concat_repeated": "select track_id, track, string_agg(artist, ';' order by artist_id) as artist from doc_rows group by track_id, track",
    "search_docs": "select * from docs",
    "search_postings": """
        select token, track_id, field, cast(pos - 1 as int) as pos from (
          select track_id, field, unnest(string_split(trim(norm), ' ')) as token, generate_subscripts(string_split(trim(norm), ' '), 1) as pos from doc_text)""",
    "search_tracks": "select * from track where track_id in (select track_id from hits)",
    "search_names": """
        with q as (select 'track ' || name as query_id, name as query from track union select 'artist ' || name, name from artist
                   union select 'album ' || name, name from album),
        w as (select query_id, ' ' || array_to_string(regexp_extract_all(lower(strip_accents(word)), '[\\p{L}\\p{N}]+'), ' ') || ' ' as phrase
              from (select query_id, unnest(string_split(query, ' ')) as word from q)),
        n as (select query_id, count(distinct phrase) as n from w group by query_id),
        m as (select distinct w.query_id, w.phrase, d.track_id from w join doc_text d on contains(d.norm, w.phrase))
        select m.query_id, m.track_id from m join n on n.query_id = m.query_id group by m.query_id, m.track_id, n.n having count(*) = n.n""",
    "document_postings": """
        with d as (select doc_id, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+') as toks from documents)
        select doc_id as track_id, cast(unnest(generate_series(0, len(toks) - 1)) as int) as pos, unnest(toks) as token from d where len(toks) > 0""",
    "search_documents": """
        with d as (select doc_id, ' ' || array_to_string(regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+'), ' ') || ' ' as norm from documents),
        w as (select distinct item_id, array_to_string(regexp_extract_all(lower(strip_accents(word)), '[\\p{L}\\p{N}]+'), ' ') as phrase
              from (select item_id, unnest(regexp_split_to_array(text, '[\\s"]+')) as word from benchmark)),
        p as (select item_id, ' ' || phrase || ' ' as phrase from w where phrase <> ''),
        n as (select item_id, count(*) as n from p group by item_id)
        select p.item_id as query_id, d.doc_id from p join d on contains(d.norm, p.phrase) join n on n.item_id = p.item_id
        group by p.item_id, d.doc_id, n.n having count(*) = n.n""",
    # pages
    "playlist_index": "select playlist_id, date, image_url from playlist",
    "playlist_page": """
        with asked as (
          select distinct year(l_shipdate) || '-' || month(l_shipdate) || '-' || day(l_shipdate) as date_str, cast(l_shipdate as date) as date from lineitem
          union select o_orderpriority, null from orders)
        select a.date_str, a.date, p.playlist_id, p.name as playlist_name, p.image_url, p.spotify_url as playlist_url, p.description,
          case when p.playlist_id is not null then true end as has_description,
          case when a.date is null then 'invalid' when p.playlist_id is null then 'not found' else 'ok' end as status,
          pt.sequence, c.*
        from asked a left join playlist p on p.date = a.date left join playlist_track pt on pt.playlist_id = p.playlist_id
        left join cells c on c.track_id = pt.track_id""",
    "playlist_page_rows": """
        with asked as (
          select distinct year(l_shipdate) || '-' || month(l_shipdate) || '-' || day(l_shipdate) as date_str, cast(l_shipdate as date) as date from lineitem
          union select o_orderpriority, null from orders),
        people as (
          select ta.track_id, string_agg(a.spotify_id || '=' || a.name, '|' order by a.artist_id) as artist_links
          from track_artist ta join artist a on a.artist_id = ta.artist_id group by ta.track_id)
        select a.date_str, case when a.date is null then 'invalid' when p.playlist_id is null then 'not found' else 'ok' end as status,
          p.playlist_id, pt.sequence, c.track_id, t.spotify_id as track_spotify_id, t.preview_url, c.has_preview, c.artists,
          case when c.track_id is not null then coalesce(l.artist_links, '') end as artist_links
        from asked a left join playlist p on p.date = a.date left join playlist_track pt on pt.playlist_id = p.playlist_id
        left join cells c on c.track_id = pt.track_id left join track t on t.track_id = c.track_id
        left join people l on l.track_id = c.track_id""",
    "sorted_tracks": "select * from cells order by energy desc nulls last, track_id",
    "artist_page": """
        select a.artist_id, a.spotify_id, a.name, case when s.s_nationkey < 10 then 'http://img/ar/' || a.artist_id || '/b' end as image_url,
          a.popularity, format('{:,}', a.followers) as followers, string_agg(g.name, ', ' order by g.genre_id) as genres
        from artist a join supplier s on s.s_suppkey = a.artist_id join artist_genre ag on ag.artist_id = a.artist_id
        join genre g on g.genre_id = ag.genre_id group by all""",
    "artist_page_tracks": """
        select c.*, a.artist_id, a.spotify_id from artist a join track_artist ta on ta.artist_id = a.artist_id join cells c on c.track_id = ta.track_id""",
    "artist_page_albums": """
        select al.album_id, a.artist_id, a.spotify_id as artist_spotify_id, al.spotify_url, al.name as album,
          case when al.album_id < 20 then 'http://img/al/' || al.album_id || '/a' end as image_url
        from artist a join album_artist aa on aa.artist_id = a.artist_id join album al on al.album_id = aa.album_id""",
    "genre_page": """
        with firsts as (select name as genre, min(genre_id) as genre_id from genre group by name),
        theirs as (select ag.artist_id, g.genre_id, g.name from artist_genre ag join genre g on g.genre_id = ag.genre_id)
        select f.genre, a.artist_id, a.spotify_id, a.name, a.popularity, format('{:,}', a.followers) as followers,
          coalesce((select string_agg(t.name, '; ' order by t.genre_id) from theirs t where t.artist_id = a.artist_id and t.name <> f.genre), '') as other_genres
        from firsts f join artist_genre ag on ag.genre_id = f.genre_id join artist a on a.artist_id = ag.artist_id""",
    "search_page": """
        select t.track_id, t.name as track, replace(n.artists, ', ', '; ') as artists, al.name as album,
          case when al.album_id < 20 then 'http://img/al/' || al.album_id || '/c' end as image_url, coalesce(t.preview_url <> '', false) as has_preview
        from hits h join track t on t.track_id = h.track_id join track_names n on n.track_id = t.track_id join album al on al.album_id = t.album_id""",
    "search_page_playlists": """
        select h.track_id, p.playlist_id, pt.sequence, p.date, p.image_url from hits h join playlist_track pt on pt.track_id = h.track_id
        join playlist p on p.playlist_id = pt.playlist_id""",
}
_BODIES["search_index_increment"] = _BODIES["search_postings"]
_BODIES["search_tracks_scan"] = _BODIES["search_tracks"]


def _needed(sql: str, found: list[str]) -> list[str]:
    """Views a text uses, each after the views it uses itself."""
    for word in re.findall(r"\b(?:from|join|,)\s+(\w+)", sql):
        if word in VIEWS and word not in found:
            _needed(VIEWS[word], found)
            found.append(word)
    return found


def _with_views(body: str) -> str:
    views = ", ".join(f"{name} as ({VIEWS[name].strip()})" for name in _needed(body, []))
    body = body.strip()
    if body.startswith("with "):
        return f"with {views}, {body[5:]}" if views else body
    return f"with {views} {body}" if views else body


ORACLES: dict[str, str] = {name: _with_views(body) for name, body in _BODIES.items()}
