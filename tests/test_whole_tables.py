"""Queries over whole tables and whole texts; their rows are held against DuckDB in test_oracle."""

import duckdb

from ledgerloom.operators import reconcile
from ledgerloom.queries import queries


def _duck(sf_dir, sql, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con.execute(sql).fetchall()


def test_unroll_holds_long_texts(spark, sf_dir):
    got = sorted((r.doc_id, r["count"]) for r in queries()["s28_unroll"](spark, sf_dir).groupBy("doc_id").count().collect())
    texts = _duck(sf_dir, "select doc_id, coalesce(text, '') from documents", "documents")
    assert got == sorted((d, t.count("\n") + 1) for d, t in texts) and any(len(t) >= 2000 for _, t in texts)


def test_no_query_over_a_subset_of_ids(spark):
    sf_dir = "/root/testdata/sf0.01"
    ids = {d for (d,) in _duck(sf_dir, "select distinct l_orderkey from lineitem join part on l_partkey = p_partkey", "lineitem", "part")}
    assert {r.doc for r in queries()["s31_text_items"](spark, sf_dir).select("doc").distinct().collect()} == ids
    assert {r.document_id for r in queries()["k09_edit_lines"](spark, sf_dir).select("document_id").distinct().collect()} == ids
    assert queries()["p14_in_document"](spark, sf_dir).where("document_id > 500").count() > 0
    assert queries()["a12e_verify"](spark, sf_dir).count() == _duck(sf_dir, "select count(*) from orders", "orders")[0][0]
    pairs = queries()["j08_band_join"](spark, sf_dir).collect()
    assert {r.new_id for r in pairs} == {r.old_id for r in pairs if r.new_id == r.old_id} == set(range(0, 15000, 50))


def _page(spark, taxable, final, *rows):
    """subtotal_ok, final_ok, net_due, total_discounts of one document; rows: final, discount, description, item_code."""
    docs = spark.createDataFrame([(1, taxable, final)], "id long, grand_total_taxable double, grand_total_final double").selectExpr("id", "cast(grand_total_taxable as decimal(14,2)) as grand_total_taxable", "cast(grand_total_final as decimal(14,2)) as grand_total_final")
    items = spark.createDataFrame([(1, f, o, t, k) for f, o, t, k in rows], "document_id long, f double, o double, description string, item_code string").selectExpr("document_id", "cast(f as decimal(20,8)) as final_value", "cast(null as decimal(20,8)) as gross_amount", "cast(o as decimal(20,8)) as discount_amount", "description", "item_code")
    r = reconcile.reconcile_quotation(docs, items).first()
    return r.subtotal_ok, r.final_ok, float(r.net_due), float(r.total_discounts)


def test_quotation_check(spark):
    a = (1000.0, 0.0, "bolt", "A1")
    assert _page(spark, None, None, a) == (True, True, 1000, 0)
    assert _page(spark, None, 1001.0, a) == (True, True, 1001, 0)
    assert _page(spark, None, 27.21, a) == (True, False, 1000, 0)
    assert _page(spark, None, 700.0, a) == (True, True, 700, 300)
    assert _page(spark, 847.0, 1000.0, a) == (True, True, 1000, 0)
    assert _page(spark, 5000.0, 9000.0, a) == (False, False, 1000, 4000)
    assert _page(spark, 1000.0, 9000.0, a) == (True, False, 1000, 0)
    assert _page(spark, 800.0, 850.0, (1000.0, 150.0, "bolt", "A1")) == (True, True, 850, 150)
    assert _page(spark, None, 1000.0, a, (1000.0, 0.0, " Grand Total", "item-2")) == (True, True, 1000, 0)
    assert _page(spark, None, 2000.0, a, (1000.0, 0.0, "Grand Total", "B7")) == (True, True, 2000, 0)
