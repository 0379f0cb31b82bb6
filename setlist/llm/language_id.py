"""Language identification by rank-order n-gram profiles.

A profile is the most frequent character n-grams (1 to 3 letters, word ends marked by a space) in
order of frequency. A document gets the language whose profile is nearest to its own by the
out-of-place distance: the sum over the document's n-grams of the difference of ranks, or the
profile length where the language's profile lacks the n-gram.

Training counts all n-grams of all training texts inside tasks and sums them by Spark; the profiles
(labels x profile length rows) are all that reaches the driver. Texts are worked through in pieces
of a million characters, so memory is bounded for very long ones; counts are those of the whole.

Defined cases: a text that is null or without a letter is `und` with score 0, as is everything if
nothing was learned. Equal distances go to the first label in order; equal counts rank by code
point. Rows that repeat each get a row, a null id takes part like the empty one. Empty tables give
no rows; `reject_unknown` carries all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
PIECE = 1_000_000
SPACE = 32
_fold: np.ndarray | None = None


def _folding() -> np.ndarray:
    """For every code point its lower-case letter, or a space for what is no letter."""
    global _fold
    if _fold is None:
        fold = np.full(0x110000, SPACE, dtype=np.int64)
        for code in range(0x110000):
            char = chr(code)
            if char.isalpha():
                low = char.lower()
                fold[code] = ord(low) if len(low) == 1 else code
        _fold = fold
    return _fold


def _letters(text: str, before_space: bool) -> np.ndarray:
    """Folded code points with runs of spaces made one; leading spaces go if one came before."""
    codes = _folding()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")]
    space = codes == SPACE
    again = np.empty(len(codes), dtype=bool)
    again[:1] = before_space
    again[1:] = space[:-1]
    return codes[~(space & again)]


def _keys(text: str) -> Iterator[np.ndarray]:
    """Keys of the n-grams of a text, piece by piece: up to three code points of 21 bits."""
    carry = np.array([SPACE], dtype=np.int64)
    for at in range(0, len(text), PIECE):
        last = at + PIECE >= len(text)
        new = _letters(text[at:at + PIECE], carry[-1] == SPACE)
        if last and len(new) and new[-1] != SPACE or last and not len(new) and carry[-1] != SPACE:
            new = np.append(new, SPACE)
        run = np.concatenate([carry, new])
        pairs = run[len(carry) - 1:]
        bi = pairs[:-1] << 21 | pairs[1:]
        tri = run[:-2] << 42 | run[1:-1] << 21 | run[2:]
        yield np.concatenate([new[new != SPACE], bi, tri[run[1:-1] != SPACE]])
        carry = run[-2:]


def _counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum counts by key."""
    all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(all_keys, kind="stable")
    ordered = all_keys[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, dtype=np.int64)
    return ordered[first], np.add.reduceat(all_counts[order], first) if len(first) else np.empty(0, dtype=np.int64)


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, dtype=np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)])


def _text_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    pieces = [_unique(keys) for keys in _keys(text)]
    if len(pieces) == 1:
        return pieces[0]
    if not pieces:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return _counted([k for k, _ in pieces], [c for _, c in pieces])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts per label of one task's texts."""
    held: dict[str, list] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            for keys in _keys(text.as_py() or ""):
                entry = held.setdefault(lang, [[], 0, np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)])
                entry[0].append(keys)
                entry[1] += len(keys)
                if entry[1] > 2 * PIECE:
                    _fold_in(entry)
    for lang, entry in held.items():
        _fold_in(entry)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(entry[2]), pa.string()), pa.array(entry[2]), pa.array(entry[3])], ["lang", "gram", "n"])


def _fold_in(entry: list) -> None:
    keys, counts = _unique(np.concatenate(entry[0])) if entry[0] else (entry[2][:0], entry[3][:0])
    entry[2], entry[3] = _counted([entry[2], keys], [entry[3], counts])
    entry[0], entry[1] = [], 0


def learn_profiles(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", length: int = 400) -> dict[str, list[int]]:
    """Label -> keys of its `length` most frequent n-grams, most frequent first."""
    counts = (
        labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
        .mapInArrow(_count_batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= length).select("lang", "gram", "rank")
    profiles: dict[str, list[tuple[int, int]]] = {}
    for row in top.collect():
        profiles.setdefault(row["lang"], []).append((row["rank"], row["gram"]))
    return {lang: [gram for _, gram in sorted(ranked)] for lang, ranked in sorted(profiles.items())}


class Matcher:
    """Profiles as one matrix of ranks, by label and n-gram."""

    def __init__(self, profiles: dict[str, list[int]], length: int):
        self.labels, self.length = sorted(profiles), length
        self.grams = np.unique(np.concatenate([np.array(p, dtype=np.int64) for p in profiles.values()])) if profiles else np.empty(0, dtype=np.int64)
        self.ranks = np.full((len(self.labels), len(self.grams)), -1, dtype=np.int64)
        for i, label in enumerate(self.labels):
            self.ranks[i, np.searchsorted(self.grams, profiles[label])] = np.arange(len(profiles[label]))

    def predict(self, text: str | None) -> tuple[str, float]:
        keys, counts = _text_counts(text or "")
        if not len(keys) or not len(self.grams):
            return UNKNOWN, 0.0
        if len(keys) > self.length:  # all that may rank, ties included
            least = np.partition(counts, len(counts) - self.length)[len(counts) - self.length]
            keys, counts = keys[counts >= least], counts[counts >= least]
        keys = keys[np.argsort(-counts, kind="stable")][: self.length]
        at = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        known = self.grams[at] == keys
        ranks = self.ranks[:, at]
        apart = np.where(known & (ranks >= 0), np.abs(ranks - np.arange(len(keys))), self.length)
        distance = apart.sum(axis=1)
        best = int(np.argmin(distance))
        return self.labels[best], float(1 - distance[best] / (self.length * len(keys)))


def held_out(id_col: Column, parts: int = 3, part: int = 1) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % parts == part


def predict_languages(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", length: int = 400) -> DataFrame:
    """The rows of docs as struct `doc`, with lang_pred and score."""
    matcher = Matcher(profiles, length)
    rows = docs.select(F.struct("*").alias("doc"), F.col(text_col).alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [matcher.predict(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                ["doc", "lang_pred", "score"])

    schema = T.StructType([rows.schema["doc"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(predict, schema)


def reject_unknown(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", length: int = 400) -> DataFrame:
    """The rows of docs with a known language, with all their columns.

    A text that shares no n-gram with any profile has score 0: its label is only the first in order.
    """
    return predict_languages(docs, profiles, text_col, length).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") > 0)).select("doc.*")
