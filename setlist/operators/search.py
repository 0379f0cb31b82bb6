"""Phrase search over an inverted index kept as a plain table.

Index rows are (token, track_id, field, pos). A query is a set of words parted by blanks; a
word is a phrase of one or more tokens that must stand side by side in one field, and all
words must match. There are no operators, prefixes or ranks; results come in id order.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from setlist.catalog import Catalog
from setlist.functions.text import query_words, tokens
from setlist.operators.groups import joined_text, ordered_values, repeated_text, repeated_value
from setlist.operators.stats import track_plays

FIELDS = ("artist", "track", "album")
# Folders of the stored index.
BUCKETS = 64


# --- documents -------------------------------------------------------------------------------


def search_doc_rows(c: Catalog) -> DataFrame:
    """Played tracks with artist and album, one row per play and artist (inner joins)."""
    return (
        c.playlist_track.join(c.playlist.select("playlist_id"), "playlist_id", "left_semi")
        .join(c.track.select("track_id", F.col("name").alias("track"), "album_id"), "track_id")
        .join(c.album.select("album_id", F.col("name").alias("album")), "album_id")
        .join(c.track_artist, "track_id")
        .join(c.artist.select("artist_id", F.col("name").alias("artist")), "artist_id")
        .select("playlist_id", "sequence", "track_id", "track", "artist_id", "artist", "album")
    )


def track_artist_runs(c: Catalog, playlists: DataFrame | None = None) -> DataFrame:
    """Artists of each played track with an album, and how often play x artist pairs them.

    This is the run-length form of the repeated artist text: however often a track was
    played, it has one row per artist.
    """
    plays = c.playlist_track.join(c.playlist.select("playlist_id"), "playlist_id", "left_semi")
    if playlists is not None:
        plays = plays.join(playlists.select("playlist_id"), "playlist_id", "left_semi")
    counted = track_plays(c.with_tables(playlist_track=plays))
    tracks = c.track.join(c.album.select("album_id"), "album_id", "left_semi").select("track_id", F.col("name").alias("track"))
    links = c.track_artist.groupBy("track_id", "artist_id").agg(F.count("*").alias("links"))
    return (
        links.join(tracks, "track_id").join(counted, "track_id")
        .join(c.artist.select("artist_id", F.col("name").alias("artist")), "artist_id")
        .select("track_id", "track", "artist_id", "artist", (F.col("links") * F.col("plays")).alias("times"))
    )


def track_artist_concat(c: Catalog, distinct_artists: bool = True, playlists: DataFrame | None = None) -> DataFrame:
    """Artist names of each played track in one text, each once or, if asked, once per play."""
    value = F.col("artist") if distinct_artists else repeated_value(F.col("artist"), F.col("times"))
    names = ordered_values(track_artist_runs(c, playlists), "names", ["track_id", "track"], "artist_id", value)
    text = joined_text(F.col("names"), ";") if distinct_artists else repeated_text(F.col("names"), ";")
    return names.select("track_id", "track", text.alias("artist"))


def search_docs(c: Catalog, distinct_artists: bool = True, playlists: DataFrame | None = None) -> DataFrame:
    """One row per searchable track: it has been played and has an artist and an album."""
    album = c.track.select("track_id", "album_id").join(c.album.select("album_id", F.col("name").alias("album")), "album_id")
    texts = track_artist_concat(c, distinct_artists, playlists)
    return texts.join(album, "track_id").select("track_id", "artist", "track", "album")


def search_postings(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "track_id") -> DataFrame:
    """Every token of every field with its position; whole texts, one scan for all fields."""
    texts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    split = docs.select(F.col(id_col).alias("track_id"), F.explode(texts).alias("f"))
    return split.select("track_id", "f.field", F.posexplode(tokens(F.col("f.text"))).alias("pos", "token")).select(
        "token", "track_id", "field", "pos"
    )


# --- stored index ------------------------------------------------------------------------------


def bucket_of(token: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def write_index(postings: DataFrame, path: str, buckets: int = BUCKETS, mode: str = "errorifexists") -> DataFrame:
    """Store the index by token bucket, sorted by token within files, and read it back.

    The rebalance splits a bucket that a very common token blows up into several tasks and
    files; on reading, bucket folders are pruned and files skipped by token. The number of
    buckets is stored with the index and an index that is appended to keeps its own.
    """
    if mode == "append":
        buckets = index_buckets(read_index(postings.sparkSession, path)) or buckets
    keyed = postings.withColumn("buckets", F.lit(buckets)).withColumn("bucket", bucket_of(F.col("token"), buckets))
    (
        keyed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token")
        .write.mode(mode).partitionBy("buckets", "bucket").parquet(path)
    )
    return read_index(postings.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("token string, track_id bigint, field string, pos int, buckets int, bucket int").parquet(path)


def index_buckets(index: DataFrame) -> int | None:
    """The number of buckets an index was written with; none if it has no rows."""
    row = index.select("buckets").first()
    return row["buckets"] if row else None


def new_postings(c: Catalog, postings: DataFrame, playlists: DataFrame, distinct_artists: bool = True) -> DataFrame:
    """Index rows for tracks of the given playlists that the index does not know yet."""
    docs = search_docs(c, distinct_artists, playlists)
    known = postings.select("track_id").distinct()
    return search_postings(docs.join(known, "track_id", "left_anti"))


# --- queries -------------------------------------------------------------------------------------


def query_terms(queries: DataFrame) -> DataFrame:
    """Tokens of each query of (query_id, query); words without a token do not count."""
    phrases = F.filter(F.transform(query_words(F.col("query")), tokens), lambda t: F.size(t) > 0)
    words = queries.select("query_id", phrases.alias("words"))
    split = words.select("query_id", F.size("words").alias("n_words"), F.posexplode("words").alias("word_no", "phrase"))
    return split.select(
        "query_id", "n_words", "word_no", F.size("phrase").alias("n_tokens"), F.posexplode("phrase").alias("tok_no", "token")
    )


def _terms_of(spark: SparkSession, query: str) -> list[Row]:
    """The terms of one query text, a handful of rows."""
    one = spark.range(1).select(F.lit(0).alias("query_id"), F.lit(query).alias("query"))
    return query_terms(one).withColumn("digest", F.xxhash64("token")).collect()


def search(postings: DataFrame, query: str, buckets: int | None = None) -> DataFrame:
    """Ids of the tracks that match one query.

    The few tokens of the query are known before the scan, so buckets and tokens are literal
    filters. A stored index knows its number of buckets; `buckets` is not needed and must not differ. All further groups are small: they hold the places of one phrase in one track.
    """
    terms = _terms_of(postings.sparkSession, query)
    if not terms:
        return postings.select("track_id").where(F.lit(False))

    wanted = sorted({t.token for t in terms})
    hits = postings.where(F.col("token").isin(wanted))
    if "bucket" in postings.columns:
        stored = index_buckets(postings)
        if buckets is not None and stored is not None and buckets != stored:
            raise ValueError(f"the index has {stored} buckets, not {buckets}")
        hits = hits.where(F.col("bucket").isin(sorted({t.digest % (stored or 1) for t in terms})))

    places = F.array(*[
        F.struct(F.lit(t.token).alias("token"), F.lit(t.word_no).alias("word_no"),
                 F.lit(t.tok_no).alias("tok_no"), F.lit(t.n_tokens).alias("n_tokens"))
        for t in terms
    ])
    matching = F.filter(places, lambda p: p["token"] == F.col("token"))
    rows = hits.select("track_id", "field", "pos", F.explode(matching).alias("p"))
    return matches(rows.select("track_id", "field", "pos", "p.*").withColumn("n_words", F.lit(terms[0].n_words)), ["track_id"])


def phrase_words(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Words of each key that have all their tokens side by side somewhere."""
    whole = (
        rows.groupBy(*keys, "n_words", "word_no", "n_tokens", "field", (F.col("pos") - F.col("tok_no")).alias("start"))
        .agg(F.count_distinct("tok_no").alias("n")).where("n = n_tokens")
    )
    return whole.select(*keys, "n_words", "word_no").distinct()


def with_all_words(words: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that have as many words as they should; `words` has each once."""
    return words.groupBy(*keys, "n_words").agg(F.count("*").alias("n")).where("n = n_words").select(*keys)


def matches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys for which every word has all its tokens side by side somewhere."""
    return with_all_words(phrase_words(rows, keys), keys)


def search_many(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, track_id) matches for a whole table of queries (query_id, query).

    Each query starts from its rarest token; only tracks that have it are checked for the
    other words, by a join on (token, track), which stays even for common tokens.
    """
    terms = query_terms(queries)
    needed = postings.select("token", "track_id", "field", "pos").join(
        terms.select("token").distinct(), "token", "left_semi"
    )
    frequency = needed.groupBy("token").agg(F.count("*").alias("n"))
    rarest = (
        terms.join(frequency, "token", "left")
        .groupBy("query_id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    )
    candidates = rarest.join(needed.select("token", "track_id").distinct(), "token").select("query_id", "track_id")
    checks = candidates.join(terms, "query_id").join(needed, ["token", "track_id"])
    return matches(checks, ["query_id", "track_id"])


def search_scan(docs: DataFrame, query: str, fields: tuple[str, ...] = FIELDS, id_col: str = "track_id") -> DataFrame:
    """The same matches for one query without an index: every text is split and looked through."""
    phrases: dict[int, list[str]] = {}
    for t in sorted(_terms_of(docs.sparkSession, query), key=lambda t: (t.word_no, t.tok_no)):
        phrases.setdefault(t.word_no, []).append(t.token)
    if not phrases:
        return docs.select(F.col(id_col).alias("track_id")).where(F.lit(False))

    def stands_in(phrase: list[str], text: Column) -> Column:
        wanted, n = F.array(*map(F.lit, phrase)), F.lit(len(phrase))
        starts = F.when(F.size(text) >= n, F.sequence(F.lit(1), F.size(text) - n + 1))
        return F.coalesce(F.exists(starts, lambda i: F.slice(text, i, n) == wanted), F.lit(False))

    texts = F.array(*[tokens(F.coalesce(f, F.lit(""))) for f in fields])
    rows = docs.select(F.col(id_col).alias("track_id"), texts.alias("texts"))
    for phrase in phrases.values():
        rows = rows.where(F.exists("texts", partial(stands_in, phrase)))
    return rows.select("track_id")


def matching_tracks(c: Catalog, hits: DataFrame) -> DataFrame:
    """Whole track rows of the hits, in id order."""
    return c.track.join(hits, "track_id", "left_semi").orderBy("track_id")
