"""Spans of aliases against every choice of them."""

import random
import re
from collections import defaultdict

from ledgerloom.operators import aliases as L
from ledgerloom.plans.text_plans import phrase_aliases
from ledgerloom.queries import queries

SPANS = "doc string, start int, end int, canonical string, weight double"


def _best(spans, at=0):
    """The greatest sum of weights without overlap."""
    later = [s for s in spans if s[1] >= at]
    if not later:
        return 0.0
    s = min(later, key=lambda x: (x[2], x[1]))
    rest = [x for x in later if x is not s]
    return max(s[4] + _best(rest, s[2]), _best(rest, at))


def test_spans_are_the_best_choice(spark):
    rng = random.Random(5)
    rows = [(f"d{d}", a, a + rng.randint(1, 4), f"c{rng.randrange(3)}", rng.choice([1.0, 1.5, 2.0, 0.5])) for d in range(30) for a in [rng.randrange(14) for _ in range(rng.randint(1, 9))]]
    got = defaultdict(list)
    for r in L.choose_spans(spark.createDataFrame(rows + rows[:9], SPANS)).collect():
        got[r.doc].append((r.start, r.end, r.weight))
    for d in {r[0] for r in rows}:
        mine = sorted(got[d])
        assert all(a[1] <= b[0] for a, b in zip(mine, mine[1:]))
        assert abs(sum(x[2] for x in mine) - _best(sorted({r for r in rows if r[0] == d}))) < 1e-9
    assert L.choose_spans(spark.createDataFrame([], SPANS)).count() == 0


def test_spans_of_all_turns(spark, sf_dir):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    known = defaultdict(float)
    for r in phrase_aliases(spark, sf_dir).collect():
        known[" ".join(words(r.alias)), r.canonical] = max(known[" ".join(words(r.alias)), r.canonical], r.confidence)
    by_key = defaultdict(list)
    for (k, c), conf in known.items():
        by_key[k].append((c, conf))
    got = defaultdict(list)
    for r in queries()["f43_spans"](spark, sf_dir).collect():
        got[r.doc].append(r)
    texts = {r.doc: r.text for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr("concat_ws('/', conv_id, turn, xxhash64(role, text)) as doc", "text").collect()}
    assert got and set(got) <= set(texts)
    for doc, text in texts.items():
        ws = words(text)
        n = len(ws)
        best = [0.0] * (n + 1)
        for end in range(1, n + 1):
            best[end] = best[end - 1]
            for start in range(max(0, end - 4), end):
                for _, conf in by_key.get(" ".join(ws[start:end]), ()):
                    best[end] = max(best[end], best[start] + (end - start) * conf)
        mine = sorted(got[doc], key=lambda r: r.start)
        assert all(a.end <= b.start for a, b in zip(mine, mine[1:]))
        assert abs(sum(r.weight for r in mine) - best[n]) < 1e-9
        assert all(any(c == r.canonical for c, _ in by_key[" ".join(ws[r.start : r.end])]) for r in mine)
