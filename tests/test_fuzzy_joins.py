"""Fuzzy joins against every pair: no pair at the threshold is lost, and the queries that SQL cannot express."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import aliases as L
from ledgerloom.operators import catalogs as C
from ledgerloom.operators import entities as E
from ledgerloom.operators.candidates import candidates, containing
from ledgerloom.queries import queries


def _names(rng, n):
    words = ["steel", "pump", "acme", "traders", "ltd", "blue", "ab", "x", "ö", "123", "4500", "water"]
    out = {"".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(n)}
    for name in list(out)[: n // 2]:
        k = rng.randrange(len(name) + 1)
        out.add(name[:k] + rng.choice("abz9 ") + name[k + rng.randint(0, 1) :])
    return sorted(out - {""})


@pytest.mark.parametrize("threshold", [0.6, 0.75, 0.85, 0.95])
def test_no_pair_is_lost(spark, threshold):
    rng = random.Random(int(threshold * 100))
    left, right = _names(rng, 50), _names(rng, 50)
    frame = lambda xs: spark.createDataFrame([(x,) for x in [*xs, "", None]], "n string")
    got = {(r.left_n, r.right_n) for r in candidates(frame(left), frame(right), threshold).collect()}
    want = {(a, b) for a in left for b in right if SequenceMatcher(None, b, a).ratio() >= threshold}
    assert want <= got and len(got) < len(left) * len(right)
    pairs = {(r.left_n, r.right_n) for r in E.fuzzy_pairs(frame(left), frame(right), threshold).collect()}
    assert pairs == want
    inside = {(r.left_n, r.right_n) for r in containing(frame(left), frame(right)).collect()}
    assert inside == {(a, b) for a in left for b in right if b in a}


def test_vendor_lookup_takes_the_first(spark):
    rng = random.Random(2)
    learned, said = [x.strip().upper() for x in _names(rng, 20) if x.strip()], [x.strip().upper() for x in _names(rng, 30) if x.strip()]
    texts = spark.createDataFrame(list(enumerate(said)), "doc int, vendor_name string")
    got = {r.doc: r.learned for r in C.vendor_lookup(texts, spark.createDataFrame(list(enumerate(learned)), "ord int, vendor string")).collect()}
    hit = lambda v, n: v in n or n in v or SequenceMatcher(None, v, n).ratio() > 0.6
    assert got == {k: next((v for v in learned if hit(v, n)), None) for k, n in enumerate(said)}


def test_entities(spark, sf_dir):
    """j07 over all suppliers: equal tax number, else the smallest id alike."""
    rows = {r.key: (r.entity_id, r.matched_by) for r in queries()["j07_entities"](spark, sf_dir).collect()}
    known = {r.s_suppkey: r.s_name for r in spark.read.parquet(f"{sf_dir}/supplier.parquet").collect()}
    clean = lambda s: "".join(c for c in s.lower() if c.isalnum())
    for key, name in known.items():
        seen = name[1:] if key % 7 == 0 else name
        if key % 3 == 0:
            assert rows[key] == (min(k for k in known if k % 90 == key % 90), "gstin")
        else:
            alike = [k for k, n in known.items() if clean(n) == clean(seen) or SequenceMatcher(None, clean(n), clean(seen)).ratio() >= 0.85]
            assert rows[key] == ((min(alike), "name") if alike else (None, None))


def test_suggestions_and_aliases(spark, sf_dir):
    """f45 over the whole vocabulary, f42 over all aliases."""
    words = {w for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").distinct().collect() for w in r.p_name.lower().split() if len(w) >= 3}
    rows = {r.alias: r.suggested_canonical for r in queries()["f45_suggest"](spark, sf_dir).collect()}
    for token, found in rows.items():
        assert found == max((SequenceMatcher(None, w, token).ratio(), w) for w in words)[1]
    assert set(rows) == {"widgt", "boltt"}
    got = {r.text: (r.canonical, r.match_type) for r in queries()["f42_resolve"](spark, sf_dir).collect()}

    def subsequence(short, long):
        it = iter(long)
        return len(short) < len(long) and all(c in it for c in short)

    from ledgerloom.plans.text_plans import part_aliases

    known = [(r.alias, r.canonical) for r in part_aliases(spark, sf_dir).orderBy("ord").collect()]
    kinds = set()
    for said, (canonical, kind) in got.items():
        kinds.add(kind)
        text = said.lower()
        exact = next(((c, "exact" if text == c else "alias") for a, c in known if a == text), None)
        best = None
        for a, c in known:
            if subsequence(text, c) or subsequence(text, a):
                r = len(text) / len(c)
                if best is None or r > best[1]:
                    best = c, max(0.8, r)
        close = max(((max(SequenceMatcher(None, text, a).ratio(), SequenceMatcher(None, text, c).ratio()), -k, c) for k, (a, c) in enumerate(known)), default=None)
        want = exact if exact else (best[0], "abbreviation") if best else (close[2], "fuzzy") if close[0] >= 0.75 else (None, None)
        assert (canonical, kind) == want, said
    assert kinds == {"alias", "abbreviation", "fuzzy", None}


def test_item_lines(spark, sf_dir):
    """s31 over all documents: a line per item and no repeat."""
    rows = queries()["s31_text_items"](spark, sf_dir)
    assert rows.groupBy("doc", "line").count().where("count > 1").count() == 0
    assert rows.groupBy("doc", F.lower("description"), "amount", "qty").count().where("count > 1").count() == 0
    assert rows.select("doc").distinct().count() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey").distinct().count()
