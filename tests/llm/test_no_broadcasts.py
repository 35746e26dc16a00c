"""Tables behind an explode, which Spark sizes too low, stay off the driver."""

from pyspark.sql import functions as F

from ledgerloom.llm import simhash


def test_variants_are_never_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("ledgerloom.llm.common.shared_dir", lambda s: f"file://{tmp_path}")
    plans, found = [], simhash.components

    def watch(edges):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return found(edges)

    monkeypatch.setattr(simhash, "components", watch)
    base = [12345, -987654321, 1 << 40]
    rows = [(b ^ x,) for b in base for x in (0, 1, 3, 1 << 20 | 1 << 33)] + [(0x0F0F0F0F0F0F0F0F,)]
    got = {r.fp: r.component for r in simhash.link_components(spark.createDataFrame(rows, "fp long").withColumn("least", F.col("fp"))).collect()}
    assert len(plans) == 2 and not any("Broadcast" in p for p in plans)
    assert len(got) == 13 and len(set(got.values())) == 4 and all(got[b ^ 3] == got[b] for b in base)
