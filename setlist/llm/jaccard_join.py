"""Near duplicates: an exact Jaccard join on word shingles by parity sketches.

A document's set is its distinct five-word shingles. Sets are linked when their Jaccard similarity
reaches the threshold; the result is the linked components.

Sketch. The shingles of a set are dealt by hash to W words of 64 bits and XORed into them: a
parity sketch. A shingle that two sets do not share changes one word at most, so the number of
differing words is a lower bound of the symmetric difference. At Jaccard similarity t that
difference is at most d = (1-t)/(1+t) * (a+b), and b <= a/t, so at most d(a) of a set's words can
differ from any linked set's.

Pigeonhole. Among the first d(a)+1 non-empty words in one order that holds for all sets, a linked
pair has one in common: of the common words take the first; only differing words come before it.
These words are a set's keys. If a set has no more than d(a) non-empty words, it also emits a key
for its size band, so that such (rare) sets meet. The order is by how common the word's shingles
are, rarest first, from counts of all shingles of all documents in a table of fixed size, then by
hash: passages that many documents share rank last and give few keys.

Positions. A differing word of which both sets hold an odd number of shingles stands for two unshared
shingles, any other for at least one. So the odd words that come before the first common word in
either set's order number no more than the symmetric difference, both sets taken together. A key
carries that count; a pair meets by a key only where the two counts add up to what its sizes allow,
and so one of the two is at most half of it: only such keys lead, the others wait to be led. Sets
that have a common passage and little else in common thus never meet by the passage.

Size bands. W depends on the band of the set's size (a factor of 16 wide); a set near enough to a
limit to be linked across it emits keys in both bands.

Filter. A second sketch has one bit per token hash, two to four bits per shingle, folded to the
narrower one for a pair of unlike sizes. Its Hamming distance is a lower bound of the symmetric
difference as well, so a pair whose bits differ in more places than its sizes allow goes before any
set is fetched. Keys that only one set has are left out by a two-pass Bloom filter of bounded size.

Groups. Equal sets become one class first. For the sets that share a key, in rounds: each is
compared with one set of the key's largest component only, and then those known to be in one
component are seen as one. The leading set is drawn anew for every key and round, so that a set
meets as many leaders as it has keys. Rounds end early when the pairs left are no more than the
keys of all sets, or a round finds no link. What is left, pairs that share a key in different
components, is compared in full, so no link that could change a component is left out. A group of
copies that are all near each other costs as many comparisons as it has members and not its
square; copies of one text that are edited too much to be linked are still compared in pairs.

Verification is exact on 64-bit shingle hashes: links need |A & B| * (100 + T) >= T * (a + b).

Defined cases: null texts, and texts without words, have an empty set, size 0, are linked with
nothing and are components of their own. Texts of fewer words than a shingle are one shingle. Rows
that repeat an id and a text are one component; rows with a null id take part, and a component of
null ids alone has a null component id. `keep_one` keeps of each component the row of the smallest
id (the first of the scan among equals). Empty tables give no rows; columns of docs, whatever
their names, are carried by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setlist.llm.common import bloom_segments, discard, filter_bits, maybe_member, numbered, written
from setlist.llm.components import connected
from setlist.llm.hashing import U64, mix, pieces, shingle_hashes, word_hashes

CELLS = 1 << 20  # of the table of shingle counts
CHUNK = 4096  # cells of one row of that table
BAND = 16
PIECE = 4_000_000  # bytes of text hashed at once
SHORT = 64  # words of the sketch that members of a key carry if their set is large
FOLDED = 16  # words of the folded sketch that all members of a key carry


def _sets(texts: list[bytes], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Index and sorted distinct shingles of each text."""
    for first, end in pieces(texts, PIECE):
        hashes, counts = word_hashes(texts[first:end])
        runs = shingle_hashes(hashes, size)  # of the whole piece; those across two texts are skipped
        at = 0
        for i, n in enumerate(counts):
            yield first + i, np.unique(runs[at:at + n - size + 1] if n >= size else shingle_hashes(hashes[at:at + n], size))
            at += n


def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> U64(44)).astype(np.int64)


def _sum_counts(docs: DataFrame, size: int) -> np.ndarray:
    """Common-ness class of every cell: log2 of how often all texts have a shingle in it.

    It only ranks a set's words. Texts shorter than a shingle are not counted.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            texts = _bytes(batch.column("text"))
            for first, end in pieces(texts, PIECE):
                hashes, counts = word_hashes(texts[first:end])
                if len(hashes) >= size:
                    text = np.repeat(np.arange(len(counts)), counts)
                    inside = text[:len(text) - size + 1] == text[size - 1:]
                    total += np.bincount(_cells(shingle_hashes(hashes, size)[inside]), minlength=CELLS)
        for chunk in range(CELLS // CHUNK):
            part = total[chunk * CHUNK:(chunk + 1) * CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([part.tolist()], pa.list_(pa.int64()))], ["chunk", "counts"])

    partial = docs.select("text").mapInArrow(count, "chunk long, counts array<long>")
    spread = partial.withColumn("salt", F.spark_partition_id() % 32)

    def add(keys, frame):
        return keys_frame(keys[0], np.sum(np.stack(frame["counts"].to_numpy()), axis=0))

    def keys_frame(chunk, counts):
        import pandas as pd

        return pd.DataFrame({"chunk": [chunk], "counts": [counts.tolist()]})

    schema = "chunk long, counts array<long>"
    once = spread.groupBy("chunk", "salt").applyInPandas(add, schema)
    table = np.zeros(CELLS, dtype=np.int64)
    for row in once.groupBy("chunk").applyInPandas(add, schema).toLocalIterator():
        table[row["chunk"] * CHUNK:(row["chunk"] + 1) * CHUNK] = row["counts"]
    return np.frexp(table.astype(np.float64))[1].astype(np.uint8)


def _difference(n: int, percent: int) -> int:
    """The greatest symmetric difference of a set of n with any set linked to it."""
    largest = n * 100 // percent
    return (100 - percent) * (n + largest) // (100 + percent)


def _band(n: int) -> int:
    band, upper = 0, BAND
    while n >= upper:
        band, upper = band + 1, upper * BAND
    return band


def _bands(n: int, percent: int) -> set[int]:
    """The bands in which a set of n meets the sets it may be linked with: its own and the next, if in reach."""
    return {_band(n), _band(max(1, n * 100 // percent))}


def sketch_keys(shingles: np.ndarray, commonness: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of one set, the first d+1 words of its parity sketches, per band; and how many odd words come before each."""
    n, keys, before = len(shingles), [], []
    budget = _difference(n, percent) + 1
    cls = commonness[_cells(shingles)].astype(np.int64)
    for band in sorted(_bands(n, percent)):
        width = U64(BAND ** (band + 1))
        slot = mix(shingles ^ U64(0x5851F42D4C957F2D)) % width
        order = np.argsort(slot)  # the order inside a word does not matter
        ordered = slot[order]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        word = np.bitwise_xor.reduceat(mix(shingles[order]), first)
        rare = np.minimum.reduceat(cls[order], first)  # a word is no more common than its rarest shingle
        salt = U64(band * 0x632BE59BD9B4E019 % 2**64)
        key = mix(word ^ mix(ordered[first] + salt))
        odd = np.diff(np.r_[first, n]) & 1
        chosen = np.lexsort((key, rare))[:budget]
        keys.append(key[chosen])
        before.append(np.cumsum(odd[chosen]) - odd[chosen])
        if len(key) < budget:  # such sets may have no word in common: no count is known
            keys.append(mix(np.array([salt + U64(1)], dtype=U64)))
            before.append(np.zeros(1, dtype=np.int64))
    found, at = np.unique(np.concatenate(keys), return_index=True)
    return found, np.concatenate(before)[at]


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """Parity sketch: words of 64 bits, a power of two of them, two to four bits per shingle."""
    words = 1
    while words * 32 < len(shingles):
        words *= 2
    place = mix(shingles + U64(0x6A09E667F3BCC909)) & U64(words * 64 - 1)
    odd = np.bincount(place.astype(np.int64), minlength=words * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def folded_bits(shingles: np.ndarray) -> np.ndarray:
    """The parity sketch at FOLDED words, whatever the set's size: its Hamming distance is a lower bound as well."""
    place = mix(shingles + U64(0x6A09E667F3BCC909)) & U64(FOLDED * 64 - 1)
    odd = np.bincount(place.astype(np.int64), minlength=FOLDED * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def short_bits(bits: np.ndarray) -> np.ndarray | None:
    """The sketch folded to SHORT words at most, none if FOLDED words hold it."""
    if len(bits) <= FOLDED:
        return None
    return np.bitwise_xor.reduce(bits.reshape(-1, SHORT), axis=0) if len(bits) > SHORT else bits


def _sketches(docs: DataFrame, commonness: np.ndarray, size: int, percent: int) -> DataFrame:
    """row_id, doc_id, n_shingles, set hashes h1 and h2, keys, before (odd words before each key), bits (the parity sketch), folded (at a fixed width), short (if it is wider, its form of SHORT words at most)."""
    shared = docs.sparkSession.sparkContext.broadcast(commonness)  # one byte per cell

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h1, h2, keys, before, bits, folded, short = [], [], [], [], [], [], [], []
            for _, s in _sets(_bytes(batch.column("text")), size):
                n.append(len(s))
                h1.append(int(np.bitwise_xor.reduce(mix(s)).view(np.int64)) if len(s) else 0)
                h2.append(int(np.add.reduce(mix(s ^ U64(0x2545F4914F6CDD1D))).view(np.int64)) if len(s) else 0)
                key, odd = sketch_keys(s, shared.value, percent) if len(s) else (np.empty(0, dtype=U64), np.empty(0, dtype=np.int64))
                keys.append(key.view(np.int64))
                before.append(odd.astype(np.int32))
                bits.append(parity_bits(s))
                folded.append(folded_bits(s))
                short.append(short_bits(bits[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(before, pa.list_(pa.int32())), pa.array(bits, pa.list_(pa.int64())),
                 pa.array(folded, pa.list_(pa.int64())), pa.array(short, pa.list_(pa.int64()))],
                ["row_id", "doc_id", "n_shingles", "h1", "h2", "keys", "before", "bits", "folded", "short"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("row_id", "doc_id", "text").mapInArrow(
        sketch, f"row_id long, doc_id {id_type}, n_shingles long, h1 long, h2 long, keys array<long>, before array<int>, bits array<long>, folded array<long>, short array<long>")


def _close(pairs: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sizes and parity sketches allow."""
    side = lambda name: sketched.select(F.col("row_id").alias(name), F.col("n_shingles").alias(f"n{name}"), F.col("bits").alias(f"bits_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(_near("bits_a", "bits_b", "na", "nb", percent)).select("a", "b")


def _near(x: str, y: str, n: str, m: str, percent: int) -> Column:
    """Whether two sketches differ in no more bits than their sets' sizes allow.

    The wider one is folded; it is at most twice as wide, as sizes differ by less than a factor of two.
    """
    narrow = F.least(F.size(x), F.size(y))
    fold = lambda bits: F.when(F.size(bits) > narrow, F.zip_with(
        F.slice(bits, F.lit(1), narrow), F.slice(bits, narrow + 1, narrow), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(bits))
    differ = F.aggregate(F.zip_with(fold(x), fold(y), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, k: acc + k)
    return (F.greatest(F.size(x), F.size(y)) <= narrow * 2) & (differ * (100 + percent) <= (F.col(n) + F.col(m)) * (100 - percent))


def _near_folded(x: str, y: str, n: str, m: str, percent: int) -> Column:
    """Whether two sketches of FOLDED words differ in no more bits than their sets' sizes allow: plain arithmetic, cheap for every pair."""
    differ = sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(1, FOLDED)), F.bit_count(F.col(x)[0].bitwiseXOR(F.col(y)[0])))
    return differ * (100 + percent) <= (F.col(n) + F.col(m)) * (100 - percent)


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity, from the whole texts of the documents in question."""
    pairs = written(pairs, f"jaccard-pairs-{name}")
    if pairs.isEmpty():
        return pairs
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("row_id")).distinct()
    bits = filter_bits(2 * pairs.count())
    segments = written(bloom_segments(wanted, "row_id", bits, 2), f"jaccard-wanted-{name}")
    asked = maybe_member(texts.select("row_id", "text"), "row_id", segments, bits, 2, "asked").where("asked").select("row_id", "text")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for _, s in _sets(_bytes(batch.column("text")), size)]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(sets, pa.list_(pa.int64()))], ["row_id", "shingles"])

    sets = written(asked.mapInArrow(shingle, "row_id long, shingles array<long>"), f"jaccard-sets-{name}")
    left = pairs.join(sets.select(F.col("row_id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("row_id").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    linked = both.where(common * (100 + percent) >= (F.size("sa") + F.size("sb")).cast("long") * percent).select("a", "b")
    links = written(linked, f"jaccard-links-{name}")
    discard(pairs, segments, sets)
    return links


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, rounds: int = 4,
    max_filter_bits: int = 1 << 31,
) -> DataFrame:
    """One row per row of docs: row_id, doc_id, n_shingles, component_id, first_row (the row that stands for the component)."""
    texts = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "jaccard-rows")
    return _components(texts, size, percent, rounds, max_filter_bits)


def _components(texts: DataFrame, size: int, percent: int, rounds: int = 4, max_filter_bits: int = 1 << 31) -> DataFrame:
    """`near_duplicates` of a written table of row_id, doc_id and text."""
    sketched = written(_sketches(texts, _sum_counts(texts, size), size, percent), "jaccard-sketches")

    # Classes of equal sets; the class is named by its first row. Empty sets stand alone.
    full = sketched.where("n_shingles > 0")
    classes = written(full.groupBy("n_shingles", "h1", "h2").agg(F.min("row_id").alias("rep"), F.count("*").alias("rows")), "jaccard-classes")
    sets = _first_of_class(full, classes)

    # Only keys that meet another set matter: a filter of cells hit twice, then exact counts.
    n_keys = full.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    bits = filter_bits(n_keys, 8, max_filter_bits)
    exploded = sets.select(
        F.col("row_id").alias("rep"), F.col("n_shingles").alias("n"), F.explode(F.arrays_zip("keys", "before")).alias("k")
    ).select("rep", "n", F.col("k.keys").alias("key"), F.col("k.before").alias("before"))
    segments = written(bloom_segments(exploded, "key", bits, 1, twice=True), "jaccard-filter")
    keyed = written(maybe_member(exploded, "key", segments, bits, 1, "meets").where("meets").drop("meets"), "jaccard-keys")
    leads = F.col("before") * 2 * percent <= F.col("n") * (100 - percent)
    met = written(
        keyed.groupBy("key").agg(F.count("*").alias("members"), F.max(leads).alias("led")).where("members > 1 and led").select("key"), "jaccard-met")
    members = written(keyed.join(met, "key"), "jaccard-members")
    discard(segments, keyed, met)

    n_members = members.count()
    links = tried = merged = None
    current = members.withColumn("comp", F.col("rep"))
    for number in range(rounds):
        parts = current.groupBy("key", "comp").agg(
            F.count("*").alias("m"), F.min(F.struct(F.xxhash64("key", "rep", F.lit(number)).alias("draw"), "rep", "n", "before")).alias("set"))
        leaders = written(
            parts.groupBy("key").agg(
                F.min(F.struct((-F.col("m")).alias("m"), "comp", "set")).alias("l"), F.count("*").alias("parts"),
                F.sum("m").cast("double").alias("all"), F.sum(F.col("m").cast("double") * F.col("m")).alias("within"))
            .where("parts > 1").select(
                "key", F.col("l.comp").alias("lcomp"), F.col("l.set.rep").alias("lead"), F.col("l.set.n").alias("ln"),
                F.col("l.set.before").alias("lbefore"), ((F.col("all") * F.col("all") - F.col("within")) / 2).alias("left")),
            f"jaccard-leaders{number}")
        if merged is not None and leaders.agg(F.coalesce(F.sum("left"), F.lit(0.0))).first()[0] <= n_members:
            break
        star = (
            current.join(leaders, "key").where("comp <> lcomp").where(_may_reach("n", "ln", percent) & _may_start("n", "before", "ln", "lbefore", percent))
            .select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()
        )
        star = written(star if tried is None else star.join(tried, ["a", "b"], "left_anti"), f"jaccard-star{number}")
        if merged is not None and star.isEmpty():
            break  # all have been compared with the sets that lead their keys
        found = _verified(_close(star, sketched, percent), texts, size, percent, str(number))
        tried = star if tried is None else tried.unionByName(star)
        if merged is not None and found.isEmpty():
            break  # components and leaders stay as they are
        links = found if links is None else links.unionByName(found)
        merged = written(connected(links, "a", "b"), f"jaccard-components{number}")
        # Components only grow: a key whose sets are all in one has no part in later rounds.
        before, members = current, current.select("key", "rep", "n", "before").join(leaders.select("key"), "key", "left_semi")
        current = written(
            members.join(merged.select(F.col("node").alias("rep"), "component"), "rep", "left")
            .select("key", "rep", "n", "before", F.coalesce("component", "rep").alias("comp")), f"jaccard-current{number}")
        discard(before, leaders)

    # The rest: sets that share a key and are still in different components; one of each pair leads.
    open_keys = written(
        current.groupBy("key").agg(F.min("comp").alias("first"), F.max("comp").alias("last"), F.max(leads).alias("led"))
        .where("first < last and led").select("key"), "jaccard-open")
    # Members carry their folded and, of large sets, short sketch, so that a pair that cannot be linked is never made into a row.
    short = sketched.select(F.col("row_id").alias("rep"), "folded", "short")
    rest = written(current.join(open_keys, "key", "left_semi").withColumn("leads", leads).join(short, "rep"), "jaccard-left")
    other = rest.select("key", *[F.col(c).alias(f"b{c}") for c in ("rep", "n", "before", "comp", "leads", "folded", "short")])
    pairs = (
        rest.where("leads").join(other, "key").where("comp <> bcomp and (rep < brep or not bleads)")
        .where(_may_reach("n", "bn", percent) & _may_start("n", "before", "bn", "bbefore", percent))
        .where(_near_folded("folded", "bfolded", "n", "bn", percent))
        .where(F.col("short").isNull() | F.col("bshort").isNull() | _near("short", "bshort", "n", "bn", percent))
        .select(F.least("rep", "brep").alias("a"), F.greatest("rep", "brep").alias("b")).distinct()
    )
    pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
    found = _verified(_close(written(pairs, "jaccard-rest"), sketched, percent), texts, size, percent, "rest")
    if merged is None or not found.isEmpty():
        merged = written(connected(found if links is None else links.unionByName(found), "a", "b"), "jaccard-components")

    rep_component = classes.join(merged.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "n_shingles", "h1", "h2", F.coalesce("component", "rep").alias("component"))
    placed = full.select("row_id", "doc_id", "n_shingles", "h1", "h2").join(rep_component, ["n_shingles", "h1", "h2"]).select(
        "row_id", "doc_id", "n_shingles", "component")
    placed = placed.unionByName(sketched.where("n_shingles = 0").select("row_id", "doc_id", "n_shingles", F.col("row_id").alias("component")))
    placed = written(placed, "jaccard-placed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id"))
    heads = placed.groupBy("component").agg(first.alias("f"))
    return placed.join(heads, "component").select(
        "row_id", "doc_id", "n_shingles", F.col("f.doc_id").alias("component_id"), F.col("f.row_id").alias("first_row"))


def _may_reach(n: str, m: str, percent: int):
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent)


def _may_start(n: str, before: str, m: str, m_before: str, percent: int):
    """Whether a common word with so many odd words before it in either set may be the first one of a linked pair."""
    return (F.col(before) + F.col(m_before)) * (100 + percent) <= (F.col(n) + F.col(m)) * (100 - percent)


def _first_of_class(full: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows that stand for their class. Only rows that may be copies are joined; the rest pass straight through."""
    copied = classes.where("rows > 1")
    bits = filter_bits(copied.count())
    hashed = full.withColumn("class_hash", F.xxhash64("n_shingles", "h1", "h2"))
    segments = written(bloom_segments(copied.select(F.xxhash64("n_shingles", "h1", "h2").alias("class_hash")), "class_hash", bits, 2), "jaccard-copied")
    tested = maybe_member(hashed, "class_hash", segments, bits, 2, "copied")
    first = tested.where("copied").join(classes.select(F.col("rep").alias("row_id")), "row_id", "left_semi")
    return tested.where("not copied").unionByName(first).select("row_id", "n_shingles", "keys", "before")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with all columns of docs."""
    rows = numbered(docs.select(F.struct("*").alias("doc")), "jaccard-rows")
    texts = rows.select("row_id", F.col(f"doc.{id_col}").alias("doc_id"), F.col(f"doc.{text_col}").alias("text"))
    stay = _components(texts, size, percent).where("row_id = first_row").select("row_id")
    return rows.join(stay, "row_id", "left_semi").select("doc.*")
