"""URL verdicts from rule lists, held in Bloom filter cascades.

A cascade gives exact membership for every key of a known universe: level 0 encodes the listed
keys, level 1 the keys of the corpus that level 0 passes wrongly, level 2 the listed keys that
level 1 passes wrongly, and so on until nothing is passed wrongly. A url is judged by a map-side
look-up of its candidate keys; no row is joined. The universe is every candidate key of every url.
Level 0 takes about log2(universe / listed) bits per listed key, so all levels together are some
bytes per listed key, whatever the corpus.

Candidate keys of a url: for every listed pair of label count and path length, the host's last
labels and the path's beginning.

Defined cases: a null url, or one without `://`, has an empty host and path and meets no rule. Of
fitting rules the longest text wins, of equally long ones the longest host; a rule on both lists
blocks. Without a rule the url is blocked if its host or a parent domain is a listed host, else
allowed. Empty lists fit nothing; repeated urls get a row each; further columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setlist.llm.common import ascii_lower, written


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    text, pattern = F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> list[Column]:
    """Keys (last labels of the host + beginning of the path) of a url, one per (labels, path length); null if too short."""
    n_dots = F.char_length(host) - F.char_length(F.replace(host, F.lit("."), F.lit("")))
    keys = []
    for n_labels, n_path in shapes:
        fits = (host != "") & (n_dots + 1 >= n_labels) & (F.char_length(path) >= n_path)
        keys.append(F.when(fits, F.concat(F.substring_index(host, ".", -n_labels), F.substring(path, 1, n_path))))
    return keys


def _cell(key: Column, level: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(level * 64 + i), key), F.lit(bits).cast("long"))


@dataclass
class Level:
    """One Bloom filter: its bits as a one-row frame with an array of 64-bit words."""

    number: int
    bits: int
    hashes: int
    words: DataFrame

    def passes(self, key: Column) -> Column:
        words, test = self.words.scalar(), F.lit(True)
        for i in range(self.hashes):
            at = _cell(key, self.number, i, self.bits)
            test = test & (F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1)
        return test


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def contains(self, key: Column) -> Column:
        member = F.lit(False)
        for level in reversed(self.levels):
            member = level.passes(key) & ~member
        return member


def _encode(keys: DataFrame, number: int, bits: int, hashes: int) -> Level:
    cells = keys.select(F.explode(F.array(*[_cell(F.col("key"), number, i, bits) for i in range(hashes)])).alias("cell"))
    by_word = cells.groupBy(F.shiftright("cell", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(cell % 64 as int)))").alias("bits"))
    dense = keys.sparkSession.range(bits // 64).join(by_word, F.col("id") == F.col("word"), "left")
    row = dense.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("all"))
    return Level(number, bits, hashes, written(row.select(F.col("all.bits").alias("words")), "cascade-level"))


def build_cascade(listed: DataFrame, universe: DataFrame, universe_size: int, max_levels: int = 64) -> Cascade:
    """A cascade for column `key` of `listed`, exact for every `key` of `universe`.

    `universe_size` is an upper estimate that only sets the size of level 0.
    """
    listed = written(listed.select("key").distinct(), "cascade-listed")
    count, cascade = listed.count(), Cascade()
    if not count:
        return cascade
    inside, outside = listed, universe.select("key")
    hashes = max(2, min(16, math.ceil(math.log2(max(2, universe_size / count)))))
    for number in range(max_levels):
        bits = 64
        while bits < 1.44 * hashes * count:
            bits *= 2
        level = _encode(inside, number, bits, hashes)
        cascade.levels.append(level)
        wrong = outside.where(level.passes(F.col("key"))).distinct()
        wrong = written(wrong.join(listed, "key", "left_anti") if number == 0 else wrong, "cascade-wrong")
        count = wrong.count()
        if not count:
            return cascade
        inside, outside, hashes = wrong, inside, 2
    raise RuntimeError("the cascade does not end: a key of one side equals one of the other")


def _keys(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    keys = F.array(*[F.lit(host + path) for host, path in rules]).cast("array<string>")
    return spark.range(1).select(F.explode(keys).alias("key"))


def _shapes(rules: list[tuple[str, str]]) -> list[tuple[int, int]]:
    return sorted({(host.count(".") + 1, len(path)) for host, path in rules})


def judge_urls(
    pages: DataFrame, allow: list[tuple[str, str]], block: list[tuple[str, str]], blocked_hosts: list[str],
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """One row per page: page_id, host, path, rule (or null), verdict."""
    spark = pages.sparkSession
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    hosts = [(host, "") for host in blocked_hosts]
    rule_shapes, host_shapes = _shapes(allow + block), _shapes(hosts)
    rule_keys = [f"rule_key_{i}" for i in range(len(rule_shapes))]
    host_keys = [f"host_key_{i}" for i in range(len(host_shapes))]
    found = candidate_keys(F.col("host"), F.col("path"), rule_shapes + host_shapes)
    keyed = urls.select("page_id", "host", "path", *[key.alias(name) for key, name in zip(found, rule_keys + host_keys)])
    n_urls = pages.count()

    def cascade(rules: list[tuple[str, str]], names: list[str]) -> Cascade:
        universe = keyed.select(F.explode(F.array_compact(F.array(*names).cast("array<string>"))).alias("key"))
        return build_cascade(_keys(spark, rules), universe, n_urls * max(1, len(names)))

    allowed, denied, bad_hosts = cascade(allow, rule_keys), cascade(block, rule_keys), cascade(hosts, host_keys)
    fitting = [
        F.when(allowed.contains(F.col(k)) | denied.contains(F.col(k)), F.struct(
            F.char_length(k).alias("size"), F.char_length(F.substring_index(k, "/", 1)).alias("host_size"), F.col(k).alias("rule")))
        for k in rule_keys
    ]
    no_rule = F.lit(None).cast("struct<size:int,host_size:int,rule:string>")
    by_host = F.lit(False)
    for key in host_keys:
        by_host = by_host | F.coalesce(bad_hosts.contains(F.col(key)), F.lit(False))
    ruled = keyed.select("page_id", "host", "path", F.array_max(F.array(no_rule, *fitting))["rule"].alias("rule"), by_host.alias("bad_host"))
    verdict = (
        F.when(denied.contains(F.col("rule")), "block").when(F.col("rule").isNotNull(), "allow")
        .when(F.col("bad_host"), "block").otherwise("allow")
    )
    return ruled.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
