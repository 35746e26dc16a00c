"""The pipeline's stages against brute force over what each one is given."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import simhash, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage, as (documents by id, last rows)."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, fn in corpus_pipeline.STAGES:
        docs = fn(spark, docs, SF).cache()
        out.append(docs)
    return out


def _texts(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def test_stages_keep_columns(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    for df in stages[:-1]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def test_toxicity_stage(spark, stages):
    model = toxicity.fit(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    want = {d for d, t in _texts(stages[0]).items() if 1 - model.probabilities(__import__("numpy").array([model.score(t.encode())]))[0, 0] < toxicity.REJECT}
    assert set(_texts(stages[1])) == want


def test_exact_stage(stages):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    groups = defaultdict(list)
    for d, t in _texts(stages[1]).items():
        groups[lower(t)].append(d)
    assert set(_texts(stages[2])) == {max(g) for g in groups.values()}


def test_near_stage(stages):
    fps = {d: simhash.fingerprint(t.encode()) for d, t in _texts(stages[2]).items()}
    comp = {d: d for d in fps}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    assert set(_texts(stages[3])) == {d for d in ids if find(d) == d}


def test_decontamination_stage(spark, stages):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        ws = words(r.text)
        n = min(10, len(ws))
        windows |= {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1) if ws}
    sizes = {len(w) for w in windows}
    hit = lambda ws: any(tuple(ws[k : k + n]) in windows for n in sizes for k in range(len(ws) - n + 1))
    assert set(_texts(stages[4])) == {d for d, t in _texts(stages[3]).items() if not hit(words(t))}


def test_packing_stage_and_run(spark, stages):
    packed = stages[5]
    assert {r.doc_id for r in packed.collect()} == set(_texts(stages[4]))
    run = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert sorted(map(str, run.select(*key).collect())) == sorted(map(str, packed.select(*key).collect()))
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
