"""Look-ups and duplicates against every pair, and how many pairs they make."""

import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from ledgerloom import views as V
from ledgerloom.operators import candidates as N
from ledgerloom.operators import entities as E
from ledgerloom.queries import queries

HEAD = "id long, document_no string, document_type string, document_date date, grand_total_final decimal(14,2)"
LINE = "document_id long, line_no int, item_code string, description string, qty decimal(20,8), rate decimal(20,8), final_value decimal(20,8)"


def _ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def test_catalog_lookup(spark, sf_dir):
    got = {(r.description, r.vendor_id): (r.entry, round(r.score, 9)) for r in queries()["j10_catalog_lookup"](spark, sf_dir).collect()}
    import re

    rows = [(r.description, r.vendor_id, r.document_id) for r in V.items(spark, sf_dir).select("description", "vendor_id", "document_id").collect()]
    cat = {(x.title(), v) for x, v, k in rows if k % 2}
    names = {n for n, _ in cat}
    scores = defaultdict(dict)
    want = {}
    for desc, v in {(re.sub("[aeiou](?=[^aeiou ]*$)", "", x).lower(), v) for x, v, _ in rows}:
        for n in names:
            if n not in scores[desc]:
                scores[desc][n] = _ratio(n.lower(), desc)
        own = [(scores[desc][n], n) for n, o in cat if o == v and scores[desc][n] >= 0.7]
        all_ = [(s, n) for n, s in scores[desc].items() if s >= 0.75]
        if own or all_:
            s, n = max(own or all_)
            want[desc, v] = (n, round(s, 9))
    assert got == want and any(s < 1 for _, s in want.values())


def test_vendor_lookup(spark, sf_dir):
    rows = queries()["j11_vendor_lookup"](spark, sf_dir).collect()
    learned = [f"{r.s_name[:12]}{r.s_suppkey % 1000}" for r in spark.read.parquet(f"{sf_dir}/supplier.parquet").orderBy("s_suppkey").collect()]
    assert len(rows) == spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    for r in rows:
        n = r.vendor_name.upper().strip()
        assert r.learned == next((v for v in learned if v.upper() in n or n in v.upper() or _ratio(v.upper(), n) > 0.6), None)


@pytest.mark.parametrize("n", [10, 100, 1000])
def test_pairs_grow_with_names_that_are_all_alike(spark, n, monkeypatch):
    names = spark.range(n).select(F.concat(F.lit("supplier"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("n"), "id")
    seen = []

    def pairs(l, r):
        met = E.fuzzy_pairs(l, r).checkpoint()
        seen.append(met.count())
        return met

    got = {r.left_n: r.id for r in N.first_hits(names, names, pairs).collect()}
    ordered = [r.n for r in names.orderBy("id").collect()]
    assert got == {x: next(k for k, y in enumerate(ordered) if _ratio(y, x) >= 0.85) for x in ordered}
    assert sum(seen) <= 2 * N.FIRST * n


def _brute(new, new_items, old, old_items):
    lines = lambda items: defaultdict(list, {d: [x for x in items if x[0] == d] for d in {x[0] for x in items}})
    a, b = lines(new_items), lines(old_items)
    out = {}
    for i, no, kind, day, total in new:
        keyed = [o for o in old if no and o[1] == no and o[2] == kind]
        band = [o for o in old if total is not None and o[4] is not None and abs(total - o[4]) < Decimal("0.5")]
        for o in sorted(keyed or band):
            if (total is not None and o[4] is not None and abs(total - o[4]) > Decimal("0.5")) or (day and o[3] and day != o[3]):
                continue
            mine, theirs = a[i], b[o[0]]
            if not mine or not theirs:
                if no:
                    out[i] = o[0]
                    break
                continue
            near = lambda x, y: abs(x[4] - y[4]) < Decimal("0.01") and abs(x[5] - y[5]) < Decimal("0.5") and abs(x[6] - y[6]) < Decimal("0.5") and ((x[2] and x[2] == y[2]) or (not (x[2] and x[2] == y[2]) and _ratio(x[3], y[3]) >= 0.85))
            if len(mine) == len(theirs) and all(any(near(x, y) for y in theirs) for x in mine):
                out[i] = o[0]
                break
    return out


@pytest.mark.parametrize("seed", range(3))
def test_duplicates_are_those_of_every_pair(spark, seed):
    rng = random.Random(seed)
    money = lambda: Decimal(rng.choice(["0.00", "0.00", "0.30", "10.00", "10.49", "10.50"]))
    day = lambda: rng.choice([None, dt.date(2024, 1, 1), dt.date(2024, 1, 1), dt.date(2024, 2, 1)])
    doc = lambda k: (k, rng.choice([None, "", "N1", "N2", f"X{k}"]), rng.choice(["quotation", "invoice"]), day(), rng.choice([money(), money(), None]))
    line = lambda k, n: (k, n, rng.choice([None, "", "A1"]), rng.choice(["steel bolt", "steel bolts", "nut"]), Decimal(rng.choice(["1", "1.005", "2"])), Decimal("5") + rng.choice([0, Decimal("0.4"), 1]), Decimal(rng.choice(["9.9", "10", "10.3"])))
    old, new = [doc(k) for k in range(60)], [doc(k) for k in range(100, 160)]
    items = lambda docs: [line(d[0], n) for d in docs for n in range(rng.choice([0, 1, 1, 2]))]
    old_items, new_items = items(old), items(new)
    f = spark.createDataFrame
    got = E.duplicate_documents(f(new, HEAD), f(new_items, LINE), f(old, HEAD), f(old_items, LINE))
    want = _brute(new, new_items, old, old_items)
    assert {r.new_id: r.duplicate_of for r in got.collect()} == want and want


def test_a_total_that_half_the_table_has(spark):
    """2,000 documents of total 0: different lines meet their own copy only, equal ones count as one."""
    n = 2000
    docs = lambda base: spark.range(n).select((F.col("id") + base).alias("id"), F.lit(None).cast("string").alias("document_no"), F.lit("quotation").alias("document_type"), F.lit("2024-01-01").cast("date").alias("document_date"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).cast("decimal(14,2)").alias("grand_total_final"))
    items = lambda base: spark.range(n).select((F.col("id") + base).alias("document_id"), F.lit(1).alias("line_no"), F.lit("A").alias("item_code"), F.lit("bolt").alias("description"), F.lit(1).cast("decimal(20,8)").alias("qty"), F.when(F.col("id") % 4 == 0, 1).otherwise(F.col("id") * 3).cast("decimal(20,8)").alias("rate"), F.lit(7).cast("decimal(20,8)").alias("final_value"))
    got = {r.new_id - 10_000: r.duplicate_of for r in E.duplicate_documents(docs(10_000), items(10_000), docs(0), items(0)).collect()}
    assert got == {k: 0 if k % 4 == 0 else k for k in range(n)}
    plain = E._classes(docs(0), items(0), ["document_no", "document_type"]).where("id = class")
    pairs = E._line_candidates(plain.withColumn("id", F.col("id") + 10_000), items(10_000), plain, items(0), 0.5).count()
    assert pairs <= 2 * n
