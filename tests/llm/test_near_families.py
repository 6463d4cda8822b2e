import time

import numpy as np
import pyarrow as pa

from tidewater.llm import ngram_join
from tidewater.llm.common import Powers, word_hashes


def family(n=900):
    """Sets around one of 400 hashes, most of them too far from each other to link; and which of them link."""
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 50, 400)).astype(np.uint64)
    sets = []
    for _ in range(n):
        s = base.copy()
        at = rng.choice(len(base), rng.integers(20, 90), replace=False)
        s[at] = rng.integers(1 << 50, 1 << 56, len(at))
        sets.append(np.unique(s))
    holds = np.array([np.isin(base, s) for s in sets]).astype(np.float32)
    size = np.array([len(s) for s in sets])
    overlap = (holds @ holds.T).astype(int)
    return sets, size, 100 * overlap >= 75 * (size[:, None] + size - overlap)


def components_of(links, n):
    label = np.arange(n)
    for i, j in links:
        label[label == max(label[i], label[j])] = min(label[i], label[j])
    return label


def test_a_large_family_of_near_copies():
    """Every link that connects, at a small cost for a pair: 900 sets took 70 s of CPU, and take about one and a half."""
    sets, size, near = family()
    want = components_of(np.argwhere(np.triu(near, 1)), len(sets))
    assert 100 < len(set(want)) < 800
    start = time.process_time()
    found = ngram_join.links_within(np.arange(len(sets)), size, sets)
    took = time.process_time() - start
    assert all(near[i, j] for i, j in found) and (components_of(found, len(sets)) == want).all()
    assert took < 20
    # half of the sets against the others, each with what connects it already
    asks = np.arange(len(sets)) % 2 == 1
    sides = [np.flatnonzero(asks), np.flatnonzero(~asks)]
    known = np.arange(len(sets))
    for x in sides:
        known[x] = x[components_of(np.argwhere(np.triu(near[np.ix_(x, x)], 1)), len(x))]
    start = time.process_time()
    found = ngram_join.links_between(known, size, sets, known, asks)
    assert time.process_time() - start < 20
    assert (components_of(found, len(sets))[known] == want).all()


def test_probes_by_bits_and_by_search():
    """Lists of all lengths, many and few positions at a time, give the sizes of overlaps."""
    rng = np.random.default_rng(5)
    sets = [np.unique(np.concatenate([rng.integers(0, 30, 20), rng.integers(100, 1000, 60)])).astype(np.uint64) for _ in range(200)]
    index = ngram_join.Index(sets)
    for s in sets[:10]:
        for found in (np.arange(200), np.array([7]), np.array([3, 150]), np.empty(0, np.int64)):
            assert index.probe(index.lists(s), found).tolist() == [len(np.intersect1d(s, sets[i])) for i in found]


def test_words_in_lower_case():
    """A to Z alone, also in long words; other letters and bytes stay."""
    texts = ["Ab cD É", "ab cd É", "ab cd é", "X" * 80, "x" * 80, None]
    a, b, c, long, short, none = word_hashes(pa.array(texts), Powers(), lower=True)
    assert a.tolist() == b.tolist() != c.tolist() and long.tolist() == short.tolist() and not len(none)
