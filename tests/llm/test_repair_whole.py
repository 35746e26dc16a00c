"""Re-Pair to its end: no pair that occurs often enough is left."""

from collections import Counter

import numpy as np

from ledgerloom.llm import repair


def _left(symbols, last):
    """Counts of pairs within documents, a pair that overlaps itself counted once."""
    out, at = Counter(), -2
    for k, (a, b) in enumerate(zip(symbols[:-1].tolist(), symbols[1:].tolist())):
        if last[k] or (a == b and at == k - 1):
            continue
        out[a, b] += 1
        at = k if a == b else -2
    return out


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(2)
    once = rng.integers(1, repair.BASE, 2000)
    texts = [np.append(once, 0) for _ in range(40)] + [np.append(rng.integers(1, 60, 3000), 0) for _ in range(20)] + [np.array([7] * 5000 + [0])]
    ids, last = np.concatenate(texts), np.zeros(sum(map(len, texts)), dtype=bool)
    last[np.cumsum([len(t) for t in texts]) - 1] = True
    symbols, rules, ends = repair.compress(ids, last)
    assert len(rules) < repair.MAX_RULES and max(_left(symbols, ends).values()) < repair.MIN_COUNT
    assert repair.expansion_lengths(rules).max() > 1000 and ends.sum() == len(texts)
    flat = repair.unpack_shards(repair.pack_shard(0, list(range(len(texts))), [t.astype("<u4").tobytes() for t in texts]) + b"\0")
    assert np.array_equal(next(iter(flat)).tokens(), ids)
