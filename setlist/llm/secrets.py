"""Secrets in text: fixed patterns, and a pair of character Markov models for the rest.

Positions of matches come from the lengths of the parts between matches, summed per document by a
window over its (few) match rows; texts are not shuffled. The Markov models are first-order over
ASCII characters: one of random strings, one of ordinary tokens, and a token is a secret when its
mean log-likelihood ratio per character passes `threshold`.

The models are fitted on a bounded sample, `sample_rows` documents chosen by a hash of the row.
Labels come by construction: the sample's own tokens, less those a fixed pattern finds, are
ordinary; encoded digests of the sampled rows are random strings.

Defined cases: null text counts as empty and has no span. Rows that repeat each get a row. A
candidate that overlaps a fixed-pattern span is not reported again. Empty tables give no rows;
further columns are not read. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from setlist.llm.common import SPACE_CLASS, with_row_id

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ["assign", "access", "hex", "markov"]

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
LONG_HEX = r"[0-9a-f]{24,}"
LETTERS = 128  # ASCII codes
SYMBOLS = 66  # of a candidate, about
BACK_OFF = 10.0  # weight of P(b) in P(b|a)


def _matches(text: Column, kind: int, pattern: str, keep, screen: str) -> Column:
    """Matches of a pattern in order: kind, index, length of the part before, length, kept, text.

    `screen` is a pattern every text with a kept match has; other texts are passed over.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, gap: F.struct(
        F.lit(kind).alias("kind"), F.char_length(gap).alias("gap"), F.char_length(m).alias("size"), keep(m).alias("keep"),
        (m if kind == 3 else F.lit(None).cast("string")).alias("token")))
    indexed = F.transform(pairs, lambda x, i: F.struct(
        x["kind"].alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["size"].alias("size"), x["keep"].alias("keep"), x["token"].alias("token")))
    return F.when(text.rlike(screen), indexed)


def _ratio_table(docs: DataFrame, sample_rows: int) -> Column:
    """A literal array: log P(b|a, random) - log P(b|a, ordinary) at position a * 128 + b.

    Its 16,384 numbers pass the driver; their count does not depend on the data.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    tokens = sample.select(F.explode(F.split("text", SPACE_CLASS + "+")).alias("token"))
    ordinary = tokens.where(
        F.col("token").rlike("^[A-Za-z0-9+/_=-]{6,}$") & ~F.col("token").rlike(LONG_HEX) & ~F.col("token").rlike(ACCESS + "{16}")
        & ~((F.char_length("token") >= 20) & F.col("token").rlike("[0-9]") & F.col("token").rlike("[A-Za-z]"))  # could be secrets
    ).select(F.lit(0).alias("label"), "token")
    digest = F.sha2(F.concat_ws(" ", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string")), 256)
    random = sample.select(F.explode(F.array(
        F.regexp_replace(F.base64(F.unhex(digest)), r"[\r\n]", ""), digest, F.upper(F.substring(digest, 1, 32)),
        F.regexp_replace(F.base64(F.unhex(F.sha2(digest, 384))), r"[\r\n]", ""),
    )).alias("token")).select(F.lit(1).alias("label"), "token")
    chars = ordinary.unionByName(random).select("label", F.split("token", "").alias("c")).where(F.size("c") > 1)
    pairs = chars.select("label", F.explode(F.zip_with(
        F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1),
        lambda a, b: F.ascii(a) * LETTERS + F.ascii(b))).alias("pair"))
    counts = pairs.where((F.col("pair") >= 0) & (F.col("pair") < LETTERS * LETTERS)).groupBy("pair").agg(
        F.sum(1 - F.col("label")).alias("n0"), F.sum("label").alias("n1"))
    grid = docs.sparkSession.range(LETTERS * LETTERS).join(counts, F.col("id") == F.col("pair"), "left").select(
        "id", F.expr(f"id div {LETTERS}").alias("a"), (F.col("id") % LETTERS).alias("b"), F.coalesce("n0", F.lit(0)).alias("n0"), F.coalesce("n1", F.lit(0)).alias("n1"))
    first, second, whole = W.partitionBy("a"), W.partitionBy("b"), W.partitionBy()  # over the 16,384 rows of the grid

    def log_p(n: str) -> Column:
        """Log P(b|a), smoothed with P(b), so that rare contexts fall back on how common b is."""
        alone = (F.sum(n).over(second) + 0.5) / (F.sum(n).over(whole) + 0.5 * SYMBOLS)
        return F.log((F.col(n) + BACK_OFF * alone) / (F.sum(n).over(first) + BACK_OFF))

    scored = grid.select("id", (log_p("n1") - log_p("n0")).alias("ratio"))
    ratios = [row["ratio"] for row in scored.orderBy("id").collect()]
    return F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 20_000, threshold: float = 0.4,
) -> DataFrame:
    """One row per document: doc_id and spans, an array of (start, kind, end) in order; kind is an index into KINDS."""
    texts = with_row_id(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    ratios = _ratio_table(texts, sample_rows)
    text = F.col("text")
    matches = F.flatten(F.array_compact(F.array(
        _matches(text, 0, ASSIGN, lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 6, r"(?i:passw|secret|token|api_?key)"),
        _matches(text, 1, ACCESS, lambda m: F.char_length(m) >= 20, ACCESS + "{16}"),
        _matches(text, 2, HEX, lambda m: F.char_length(m) >= 24, LONG_HEX),
        _matches(text, 3, CANDIDATE, lambda m: F.lit(True), CANDIDATE),
    )))
    rows = texts.select("doc_id", "row_id", F.explode_outer(matches).alias("m")).select("doc_id", "row_id", "m.*")
    order = W.partitionBy("row_id", "kind").orderBy("i")
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order)).withColumn("start", F.col("end") - F.col("size"))
    chars = F.split("token", "")
    steps = F.zip_with(
        F.slice(chars, F.lit(1), F.size(chars) - 1), F.slice(chars, F.lit(2), F.size(chars) - 1),
        lambda a, b: F.get(ratios, F.ascii(a) * LETTERS + F.ascii(b)))
    mean = F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x) / (F.col("size") - 1)
    judged = placed.withColumn("keep", F.when(F.col("kind") == 3, mean > threshold).otherwise(F.col("keep")))
    span = F.struct("start", "kind", "end")
    per_doc = judged.groupBy("row_id", "doc_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("keep") & (F.col("kind") < 3), span))).alias("base"),
        F.sort_array(F.collect_list(F.when(F.col("keep") & (F.col("kind") == 3), span))).alias("more"))
    new = F.filter("more", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return per_doc.select("doc_id", "base", F.sort_array(F.concat("base", new)).alias("spans"))


def span_text(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
