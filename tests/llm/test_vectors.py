"""Operators 11 to 13 against brute force, and their edges: nulls, ties, repeated rows, empty tables, clashing names."""

import hashlib
import heapq
import math
import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from ledgerloom.llm import hamerly, mixing, vectors, vqcodes
from ledgerloom.llm import queries as Q

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, code string, cluster int, error long, cells string, l0 int"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, l, "c", 1, 2, "x", 3) for i, v, l in rows], SCHEMA)


def _odd(dim):
    one = [0.5] * dim
    return [(1, one, 1), (1, one, 1), (2, None, 1), (3, [math.nan, *one[1:]], 1), (4, [math.inf, *one[1:]], 2), (5, [None, *one[1:]], 2), (6, one[:-1], 2), (7, [], 2), (None, [-x for x in one], None), (8, [-0.001] * dim, None)]


@pytest.mark.parametrize("width", [1, 2, 3, 4, 16, 17])
def test_bounds_lose_no_entry(width):
    rng = np.random.default_rng(width)
    for spread in (3, 1000, 1 << 24):
        x = rng.integers(-spread, spread + 1, (2500, width))
        entries = np.concatenate([x[:60], x[:20], rng.integers(-spread, spread + 1, (50, width))])
        full = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        index, distance, _ = vqcodes.Codebook(entries).nearest(x)
        assert (index == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


def test_bounds_save_distances(spark):
    x = np.array([r.cells for r in vectors.whole_vectors(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), 1024, 64, ["vec_id"]).collect()], dtype=np.int64)[:, :16]
    _, _, exact = vqcodes.Codebook(x[:256]).nearest(x)
    assert exact < 0.7 * len(x) * 256


def _codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, np.floor(1024 * np.array(v, dtype=np.float64)).astype(int), l) for i, v, l in rows]
    first = {}
    for i, v, _ in kept:
        first[i] = min(first.get(i, tuple(v)), tuple(v))
    ids = sorted(first, key=lambda i: (i is None, i))[:entries]
    width = len(kept[0][1]) // parts
    books = [[np.array(first[i][j * width : (j + 1) * width]) for i in ids] for j in range(parts)]
    near = lambda p, b: min(((p - e) @ (p - e), k) for k, e in enumerate(b))
    for k in range(rounds + 1):
        found = [[near(v[j * width : (j + 1) * width], books[j]) for j in range(parts)] for _, v, _ in kept]
        if k == rounds:
            break
        for j in range(parts):
            groups = defaultdict(list)
            for (_, v, _), f in zip(kept, found):
                groups[f[j][1]].append(v[j * width : (j + 1) * width])
            for e, vs in groups.items():
                books[j][e] = np.array([int(t) // len(vs) for t in sum(vs)])
    by_label = defaultdict(int)
    for (_, _, l), f in zip(kept, found):
        by_label[l] += sum(int(d) for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{e:02x}" for _, e in f), sum(int(d) for d, _ in f), by_label[l], digest) for (i, _, l), f in zip(kept, found))


def test_codes(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(40), [rng.choice([-1.5, -0.3, 0.0, 0.2, 7.25]) for _ in range(8)], rng.choice([None, 1, 2])) for _ in range(120)]
    got = vqcodes.compress(_frame(spark, rows), entries=16)
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()) == _codes(rows, entries=16)


def test_codes_of_odd_rows(spark):
    rows = _odd(8)
    got = vqcodes.compress(_frame(spark, rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    kept = [r for r in rows if r[0] in (None, 1, 8)]
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()) == _codes(kept)
    assert vqcodes.compress(_frame(spark, rows).limit(0)).collect() == []
    assert vqcodes.compress(_frame(spark, [(1, None, 1), (2, [1.0, 2.0], 1)])).collect() == []
    with pytest.raises(Exception, match="do not fit"):
        vqcodes.compress(_frame(spark, [(1, [1e30] * 8, 1)])).collect()


def test_decoding(spark):
    df = vectors.whole_vectors(_frame(spark, [(k, [k / 8] * 8, 1) for k in range(9)]), 1024, 8, ["vec_id", "label"])
    books = vqcodes.train(df, 8)
    back = vqcodes.decode(vqcodes.encode(df, books, 8, ["vec_id"]), books)
    assert {r.vec_id: r.vector for r in back.collect()} == {k: [k / 8] * 8 for k in range(9)}


def _clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    digest = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else digest(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        for n, vs in groups.items():
            centres[n] = [sum(c) // len(vs) for c in zip(*vs)]
    found = [(i, *near(v)) for i, v in kept]
    own = defaultdict(int)
    for _, d, n in found:
        own[n] += d
    sha = lambda n: hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()
    return sorted((str(i), n, d, own[n], sum(own.values()), sha(n)) for i, d, n in found)


def _rows(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_clusters(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(150), [rng.choice([-1.0, 0.0, 0.01, 0.5]) for _ in range(5)], 0) for _ in range(200)]
    for k in (1, 2, 16):
        assert _rows(hamerly.cluster(_frame(spark, rows), k=k, dim=5)) == _clusters([r[:2] for r in rows], k)
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert _rows(Q.op13_hamerly_clusters(spark, SMALL)) == _clusters(data)


def _held(state, centres):
    """The share of vectors that the last round scanned; every bound is checked."""
    rows = state.collect()
    x = np.array([r.cells for r in rows])
    d = np.sqrt(np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1))
    own = np.array([r.cluster for r in rows])
    rest = d.copy()
    rest[np.arange(len(x)), own] = np.inf
    assert (np.array([r.upper for r in rows]) >= d[np.arange(len(x)), own]).all()
    assert (np.array([r.lower for r in rows]) <= rest.min(axis=1)).all()
    return np.mean([r.scanned for r in rows])


def test_bounds_hold_and_save_scans(spark):
    """Vectors of the table lie between clusters, so few are settled by bounds; of vectors in clear groups most are."""
    kept = vectors.whole_vectors(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), 64, 64, ["vec_id"])
    assert _held(*hamerly.fit(kept, 64)) < 1
    rng = random.Random(4)
    groups = [(k, [(k % 16) * 8 * (p == k % 4) + rng.random() / 4 for p in range(4)], 0) for k in range(2000)]
    assert _held(*hamerly.fit(vectors.whole_vectors(_frame(spark, groups), 64, 4, ["vec_id"]), 4)) < 0.5


def test_clusters_of_odd_rows(spark):
    rows = _odd(5)
    got = hamerly.cluster(_frame(spark, rows), dim=5)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert _rows(got) == _clusters([r[:2] for r in rows if r[0] in (None, 1, 8)])
    assert hamerly.cluster(_frame(spark, rows).limit(0), dim=5).collect() == []
    assert hamerly.cluster(_frame(spark, rows), dim=64).collect() == []


def _deal(parties, seats):
    """Seats one by one to the highest quotient, the first of equals."""
    got = [0] * len(parties)
    heap = [(-float(v), k) for k, v in enumerate(parties) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats):
        _, k = heapq.heappop(heap)
        got[k] += 1
        heapq.heappush(heap, (-(float(parties[k]) / (2 * got[k] + 1)), k))
    return got


def _targets(sizes, weights, most):
    total, cut = sum(sizes), set()
    while True:
        rest, shares = total - sum(most * sizes[k] for k in cut), sum(weights[k % len(weights)] for k in range(len(sizes)) if k not in cut) or 1
        more = {k for k in range(len(sizes)) if k not in cut and Fraction(weights[k % len(weights)] * rest, shares) > most * sizes[k]}
        if not more:
            return [float(most * s) if k in cut else weights[k % len(weights)] * rest / shares for k, s in enumerate(sizes)]
        cut |= more


def _check_mix(rows, got, block):
    """Sizes, targets, sources' words and bounds; rows: (doc_id, source, text)."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(size(t) for _, s, t in rows if s == n) for n in names]
    want = dict(zip(names, zip(sizes, _targets(sizes, (5, 2, 1), 3))))
    assert sorted((str(r.doc_id), str(r.source), r.size) for r in got) == sorted((str(i), str(s), size(t)) for i, s, t in rows)
    taken = defaultdict(int)
    for r in got:
        assert (r.source_size, r.target) == want[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    seats = _deal([t for _, t in want.values()], (sum(sizes) + block // 2) // block)
    shards = len(rows) // mixing.PER_SHARD * 2 + 1
    for (name, (own, target)), q in zip(want.items(), seats):
        assert abs(taken[name] - min(q * block, 3 * own)) <= (block * shards if q * block > 2.5 * own else 0), name
        assert abs(taken[name] - target) <= block * (1 + shards)
    return taken


def test_mix(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "b", "B", "é", None, "", "c"]), " ".join("w" * rng.randint(0, 1) for _ in range(rng.randint(0, 400)))) for k in range(300)]
    rows += [(1000 + k, "hot", "x " * 700) for k in range(150)] + [(1, "tiny", "one two"), (1, "tiny", "one two"), (None, "tiny", None), (2, "empty", " \t\n")]
    df = spark.createDataFrame([(i, s, t, 5, "n", 1.0) for i, s, t in rows], "doc_id long, source string, text string, size int, name string, taken double")
    got = mixing.mix(df).collect()
    _check_mix(rows, got, mixing.BLOCK)
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert mixing.mix(df.limit(0)).collect() == []
    assert [r.taken for r in mixing.mix(df.where("source = 'empty'")).collect()] == [0]


def test_mix_down_a_tree_of_shards(spark):
    """So many small shards that the tree has two levels."""
    rows = [(k, f"s{k % 3}" if k % 4 else "hot", "w " * (k % 37)) for k in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), per_shard=5, block=4).collect()
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source, r.target] += r.taken
    for (_, target), n in taken.items():
        assert abs(n - target) <= 0.02 * target + 4


@pytest.mark.parametrize("seed", range(4))
def test_seats_by_divisors_are_those_of_quotients(spark, seed):
    rng = random.Random(seed)
    votes = [rng.choice([0, 1, 7, 7, rng.randint(1, 10_000)]) for _ in range(rng.randint(1, 60))]
    seats = rng.choice([0, 1, len(votes), 1000]) if sum(votes) else 0
    children = spark.createDataFrame([("p", k, v) for k, v in enumerate(votes)], "parent string, child long, words long")
    parents = spark.createDataFrame([("p", seats)], "parent string, quota long")
    got = {r.child: r.quota for r in mixing.child_quotas(children, parents, ["parent"], "child").collect()}
    assert [got[k] for k in range(len(votes))] == _deal(votes, seats)


def test_queries_over_small_tables(spark):
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    _check_mix(docs, Q.op12_source_mixing(spark, SMALL).collect(), mixing.BLOCK)
