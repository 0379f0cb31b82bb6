"""Rows with very many copies are drawn and copied in chunks."""

from collections import Counter

from setlist.llm import mixing


def test_chunks_give_the_same_copies(make_docs, monkeypatch):
    data = [(i, "x" * 40, "en", "a") for i in range(300)] + [(900, "", "en", None), (900, "", "en", None), (None, "y", "en", "stray")]
    docs = make_docs(data).select("doc_id", "text", "source")
    take = lambda: mixing.mixed(docs, {"a": 1.0}).select("doc.doc_id", "doc.source", "copy", "n_copies", "shuffle_key").collect()
    whole = take()
    monkeypatch.setattr(mixing, "GREAT", 100.0)
    monkeypatch.setattr(mixing, "DRAWS", 3)
    monkeypatch.setattr(mixing, "COPIES", 70)
    assert Counter(take()) == Counter(whole)
    assert max(r["n_copies"] for r in whole) > 1000


def test_a_stray_row_of_a_large_corpus(make_docs):
    docs = make_docs([(i, "x" * 5000, "en", "a") for i in range(100)] + [(900, "", "en", None)]).select("doc_id", "text", "source")
    copies = mixing.mixed(docs, {"a": 1.0})
    assert dict(copies.dtypes)["n_copies"] == dict(copies.dtypes)["copy"] == "bigint"
    assert "array" not in dict(copies.dtypes).values()
    stray = copies.where("doc.doc_id = 900").selectExpr("count(*) n", "count(distinct copy) d", "min(copy) a", "max(copy) b", "max(n_copies) c").first()
    assert stray["n"] == stray["d"] == stray["b"] + 1 == stray["c"] and stray["a"] == 0 and abs(stray["n"] - 250_000) < 4000


def test_folded_sketch_is_the_sketch_folded():
    import numpy as np

    from setlist.llm import jaccard_join as J

    for n in (0, 1, 40, 600, 5000):
        shingles = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
        bits, folded = J.parity_bits(shingles), J.folded_bits(shingles)
        assert len(folded) == J.FOLDED
        narrow = min(len(bits), J.FOLDED)
        assert (np.bitwise_xor.reduce(bits.reshape(-1, narrow), axis=0) == np.bitwise_xor.reduce(folded.reshape(-1, narrow), axis=0)).all()
        assert (J.short_bits(bits) is None) == (len(bits) <= J.FOLDED)
