"""Language-model scores from an Elias-Fano n-gram trie that is never in one place.

The model is a bigram model over all training texts, without pruning. Per word w after v:
P(w|v) = (c(v,w) + MU * P(w)) / (c(v) + MU), P(w) = (c(w) + 1) / (N + V + 1).

The work moves n-grams to the model, not the model to the texts:
1. Texts form blocks of some megabytes, written in one scan with a number each: words, and the words'
   numbers in order. All later steps read these. A block sends its distinct words and bigrams with
   their training counts, sorted and delta-coded, to parts by ranges of hash.
2. A part adds up the counts of all blocks. Bigram parts build their share of the trie: contexts,
   monotone pointers and successors as Elias-Fano sequences in a memory-mapped file, one quantised
   code per bigram, and look up every block's bigrams by successor search in their context. The
   answers, a code per bigram and a count per word, go back to the blocks.
3. A block puts counts and codes to its token numbers and sums the scores of its documents.
A context is dealt in 16 slices by its successor, so that one as frequent as "the" is even; c(v) is
the word count of v. Codes stand for c(v,w), exact up to 64 and within 4 % above; smoothing is
applied when scoring, because the other factors belong to other parts.

Words are known by 64-bit hashes, bigrams by 64-bit hashes of the pair.

Defined cases: null text counts as empty and has one token, the end. Without training rows N = V =
0. Every row counts and is scored for itself, repeated ones too; a null id takes part like the
empty one. A text longer than a block is a block of its own. Empty tables give no rows; further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setlist.llm.common import written
from setlist.llm.elias_fano import U64, NgramTrie
from setlist.llm.hashing import mix, pieces, word_hashes

BLOCK = 12_000_000  # bytes of text
PIECE = 4_000_000
MU = 2.0
BEGIN, END = U64(0xB5297A4D3F84D5B5), U64(0x68E31DA4B5297A4D)
LOW = U64(0xFFFFFFFF)

# Counts behind the codes of 16 bits: exact ones, then steps of 8 % past the greatest 64-bit count.
CODEBOOK = np.array([*range(65), *(64 * 1.08 ** k for k in range(1, 515))])
_LIMITS = (CODEBOOK[1:] + CODEBOOK[:-1]) / 2


def _pack(numbers: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers as compressed byte planes."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8").astype(U64)


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=U64(0)))


def _unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpack(data, n), dtype=U64)


def _part(upper: np.ndarray, parts: int) -> np.ndarray:
    """Which of `parts` equal ranges of 32-bit numbers each number is in."""
    return ((upper & LOW) * U64(parts) >> U64(32)).astype(np.int64)


def _bigrams(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Bigram keys: context and slice in the upper half, successor in the lower half."""
    context = mix(before ^ mix((token >> U64(60)) + U64(1)))
    return (context & ~LOW) | (token & LOW)


class Block:
    """Tokens of some documents: hashes in order, an end after each document's words."""

    def __init__(self, texts: list[bytes]):
        hashes, lengths = [], []
        for first, end in pieces(texts, PIECE):
            h, counts = word_hashes(texts[first:end])
            hashes.append(np.insert(h, np.cumsum(counts), END))
            lengths.append(counts + 1)
        self.tokens, self.lengths = np.concatenate(hashes), np.concatenate(lengths)
        self.words, self.which = np.unique(self.tokens, return_inverse=True)


def _before(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    before = np.r_[BEGIN, tokens[:-1]]
    before[np.r_[0, np.cumsum(lengths)[:-1]]] = BEGIN
    return before


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list, list]]:
    """(number, texts, ids, held out) of the blocks of one partition; documents keep their order."""
    number, size, texts, ids, held = 0, 0, [], [], []
    for batch in batches:
        columns = (batch.column("text").cast(pa.binary()).to_pylist(), batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist())
        for text, doc_id, out in zip(*columns):
            text = text or b""
            if texts and size + len(text) > BLOCK:
                yield number, texts, ids, held
                number, size, texts, ids, held = number + 1, 0, [], [], []
            texts.append(text)
            ids.append(doc_id)
            held.append(out)
            size += len(text)
    if texts:
        yield number, texts, ids, held


def _block_id(number: int) -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 32 | number


def _shipped(parts: int):
    """Written blocks to rows (part, block, n, keys, counts); word parts first, bigram parts after."""
    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (batch.slice(i, 1).to_pydict() for batch in batches for i in range(batch.num_rows)):
            block = row["block"][0]
            words = _unpack_sorted(row["data"][0], row["n"][0])
            index_of = _unpack(row["stream"][0], row["n_stream"][0]).astype(np.int64)
            lengths = np.array(row["lengths"][0], dtype=np.int64)
            tokens = words[index_of]
            train = np.repeat(~np.array(row["held"][0], dtype=bool), lengths)
            pairs, which = np.unique(_bigrams(_before(tokens, lengths), tokens), return_inverse=True)
            for base, keys, index in ((0, words, index_of), (parts, pairs, which)):
                counts = np.bincount(index[train], minlength=len(keys)).astype(U64)
                ends = np.searchsorted(_part(keys >> U64(32), parts), np.arange(parts), side="right")
                rows = {"part": [], "block": [], "n": [], "keys": [], "counts": []}
                for part, (a, b) in enumerate(zip(np.r_[0, ends[:-1]], ends)):
                    if b > a:
                        for name, value in zip(rows, (base + part, block, int(b - a), _pack_sorted(keys[a:b]), _pack(counts[a:b]))):
                            rows[name].append(value)
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema(
                    [("part", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))
    return ship


_ANSWER = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("data", pa.binary()), ("n_tokens", pa.int64()), ("n_words", pa.int64())])


def _answered(parts: int):
    """One part: add up, build, look up; a row per block, and for words a row with the totals (block -1)."""
    def answer(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        keys = np.empty(0, dtype=U64)
        totals = np.empty(0, dtype=U64)
        held_keys, held_counts, size = [], [], 0

        def add_up() -> None:
            nonlocal keys, totals, held_keys, held_counts, size
            all_keys, all_counts = np.concatenate([keys, *held_keys]), np.concatenate([totals, *held_counts])
            order = np.argsort(all_keys, kind="stable")
            all_keys = all_keys[order]
            first = np.flatnonzero(np.r_[True, all_keys[1:] != all_keys[:-1]]) if len(all_keys) else np.empty(0, dtype=np.int64)
            keys, totals = all_keys[first], np.add.reduceat(all_counts[order], first) if len(first) else all_counts
            held_keys, held_counts, size = [], [], 0

        blocks = table.column("block").to_pylist()
        sizes = table.column("n").to_pylist()
        for n, k, c in zip(sizes, table.column("keys"), table.column("counts")):
            own, counts = _unpack_sorted(k.as_py(), n), _unpack(c.as_py(), n)
            seen = counts > 0
            held_keys.append(own[seen])
            held_counts.append(counts[seen])
            size += int(seen.sum())
            if size > 4_000_000:
                add_up()
        add_up()
        data = []
        if part < parts:
            for n, k in zip(sizes, table.column("keys")):
                own = _unpack_sorted(k.as_py(), n)
                at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
                data.append(_pack(np.where(keys[at] == own, totals[at], U64(0)) if len(keys) else np.zeros(n, dtype=U64)))
            blocks, sizes, data = [*blocks, -1], [*sizes, 0], [*data, b""]
        else:
            trie = NgramTrie(keys, np.searchsorted(_LIMITS, totals.astype(np.float64)))
            for n, k in zip(sizes, table.column("keys")):
                data.append(pa.compress(trie.look_up(_unpack_sorted(k.as_py(), n)).tobytes(), codec="zstd", asbytes=True))
        many = len(blocks)
        return pa.Table.from_pydict({
            "block": blocks, "part": [part] * many, "n": sizes, "data": data,
            "n_tokens": [int(totals.sum())] * many, "n_words": [len(keys)] * many}, schema=_ANSWER)
    return answer


def _streams(id_type: pa.DataType):
    """Blocks to one row each: the block's words and its token numbers, with the documents' ids and lengths."""
    schema = pa.schema([
        ("block", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("data", pa.binary()), ("stream", pa.binary()), ("n_stream", pa.int64()),
        ("ids", pa.list_(id_type)), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64()))])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, texts, ids, held in _blocks(batches):
            block = Block(texts)
            yield pa.RecordBatch.from_pydict({
                "block": [_block_id(number)], "part": [-1], "n": [len(block.words)], "data": [_pack_sorted(block.words)],
                "stream": [_pack(block.which.astype(U64))], "n_stream": [len(block.which)],
                "ids": [ids], "held": [held], "lengths": [block.lengths.tolist()]}, schema=schema)
    return stream


def _scored(parts: int, n_tokens: int, n_words: int, id_type: pa.DataType):
    schema = pa.schema([
        ("doc_id", id_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    floor = n_tokens + n_words + 1

    def score(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        part, sizes = table.column("part").to_pylist(), table.column("n").to_pylist()
        counts, codes, own = [], [], None
        for i, (p, n) in enumerate(zip(part, sizes)):
            if p < 0:
                own = i
            elif p < parts:
                counts.append(_unpack(table.column("data")[i].as_py(), n))
            else:
                codes.append(np.frombuffer(pa.decompress(table.column("data")[i].as_py(), decompressed_size=2 * n, codec="zstd", asbytes=True), dtype=np.uint16))
        words = _unpack_sorted(table.column("data")[own].as_py(), sizes[own])
        count = np.concatenate(counts).astype(np.float64)
        which = _unpack(table.column("stream")[own].as_py(), table.column("n_stream")[own].as_py()).astype(np.int64)
        lengths = np.array(table.column("lengths")[own].as_py(), dtype=np.int64)
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        tokens = words[which]
        _, pair = np.unique(_bigrams(_before(tokens, lengths), tokens), return_inverse=True)
        seen = CODEBOOK[np.concatenate(codes)][pair]
        n_before = np.r_[0.0, count[which[:-1]]]
        n_before[starts] = count[np.searchsorted(words, END)]  # documents begin as often as they end
        own_count = count[which]
        alone = (own_count + 1) / floor
        return pa.Table.from_arrays([
            table.column("ids")[own].values, table.column("held")[own].values, pa.array(lengths),
            pa.array(np.add.reduceat((own_count > 0).astype(np.int64), starts)), pa.array(np.full(len(lengths), n_tokens, dtype=np.int64)),
            pa.array(np.add.reduceat(np.log10(alone), starts)),
            pa.array(np.add.reduceat(np.log10((seen + MU * alone) / (n_before + MU)), starts))], schema=schema)
    return score


def held_out(id_col: Column, parts: int = 7, part: int = 2) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % parts == part


def score_texts(docs: DataFrame, is_held_out: Column, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 16_000_000) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The number of parts follows the size of the corpus, about `part_bytes` of text for each.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    texts = docs.select(F.col(id_col).alias("doc_id"), is_held_out.alias("held_out"), F.col(text_col).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(8, -(-size // part_bytes))
    id_spark = texts.schema["doc_id"].dataType
    id_name, id_arrow = id_spark.simpleString(), to_arrow_type(id_spark)

    stream_type = f"block long, part long, n long, data binary, stream binary, n_stream long, ids array<{id_name}>, held array<boolean>, lengths array<long>"
    streams = written(texts.mapInArrow(_streams(id_arrow), stream_type), "lm-blocks")
    shipped = streams.select("block", "n", "data", "stream", "n_stream", "held", "lengths").mapInArrow(
        _shipped(parts), "part long, block long, n long, keys binary, counts binary")
    answers = written(
        shipped.groupBy("part").applyInArrow(_answered(parts), "block long, part long, n long, data binary, n_tokens long, n_words long"),
        "lm-answers")
    total = answers.where("block = -1").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    together = streams.unionByName(answers.where("block >= 0").select("block", "part", "n", "data"), allowMissingColumns=True)
    result = f"doc_id {id_name}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return together.groupBy("block").applyInArrow(_scored(parts, int(total[0]), int(total[1]), id_arrow), result)
