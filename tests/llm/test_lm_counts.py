"""Great bigram counts keep their size."""

import numpy as np

from setlist.llm import lm_score


def test_no_count_saturates():
    counts = np.array([10**8, 10**9, 10**13, 2**62], dtype=np.float64)
    codes = np.searchsorted(lm_score._LIMITS, counts)
    trie = lm_score.NgramTrie(np.arange(len(counts), dtype=np.uint64), codes)
    read = lm_score.CODEBOOK[trie.look_up(np.arange(len(counts), dtype=np.uint64))]
    assert np.all(np.abs(read / counts - 1) < 0.041)
