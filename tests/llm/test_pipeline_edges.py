"""The pipeline on tables with nulls, repeated rows, clashing column names, and none at all."""

import corpus_pipeline
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, key long, node long, component string, fp string, kept boolean"
WORDS = "river stone cloud table green window letter garden".split()


def _write(spark, folder, docs):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    bench = [(1, None), (2, ""), (3, "one two three four five six seven eight nine ten eleven"), (3, "one two three four five six seven eight nine ten eleven")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def _doc(k, text):
    return (k, text, "en", None, None, 1, 2, 3, "c", "f", True)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    long = " ".join(f"{WORDS[k % 8]}{k}" for k in range(20_000))
    docs = [_doc(1, None), _doc(2, ""), _doc(3, "Same text of a few words"), _doc(4, "same TEXT of a few words"), _doc(4, "same TEXT of a few words"), _doc(None, "a text without number"), _doc(5, long), _doc(6, "so one two three four five six seven eight nine ten eleven it was"), _doc(7, "é ünï 中文 😀 words")]
    return _write(spark, tmp_path_factory.mktemp("odd"), docs)


def test_odd_documents(spark, folder):
    packed = corpus_pipeline.run(spark, folder).collect()
    # Empty texts and equal ones leave one document each, the contaminated one goes.
    assert sorted(str(d) for d in {r.doc_id for r in packed}) == ["2", "4", "5", "7", "None"]
    assert sum(r.length for r in packed if r.doc_id == 2) == 1 and len({(r.doc_id, r.start) for r in packed}) == len(packed)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).dtypes == docs.dtypes


def test_no_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, _write(spark, tmp_path, [])).count() == 0
