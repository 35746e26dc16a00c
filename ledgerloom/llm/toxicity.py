"""Toxicity severity (operator 10): cumulative-link ordinal regression on sparse word features.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector for all thresholds,
theta_0 < theta_1 < ... . Grades come from the label table: 0 not toxic, 1
toxic, 2 toxic and of low quality. A feature is a word or a word's beginning
(4 to 8 characters, so that inflected forms share one), with two values: log(1 +
count) and the share of the document's words. The vocabulary is chosen by a
two-proportion test over the labelled sample, in which near copies of a text
count once. Weights are not negative (evidence only adds up, nothing excuses
it) and fitting is accelerated proximal gradient with an L1 term.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import STEP_BYTES, arrow_map, byte_texts, materialize, sliced
from .decontam import words

#: Labelled rows used for fitting at most (a hash of doc_id decides which), words kept, and documents a word needs.
MAX_LABELLED, MAX_WORDS, MIN_DOCS = 12_000, 2_000, 5
#: z of the two-proportion test that a word must reach.
MIN_Z = 5.0
L1, STEPS = 1e-4, 1500
#: A document is rejected when P(grade >= 1) reaches this.
REJECT = 0.3
GRADES = 3
#: Characters of the beginnings, and the cap of the share, in percent of the words.
STEM, MAX_SHARE = (4, 8), 3.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def features(text: bytes) -> tuple[Counter, int]:
    """Counts of words and of words' beginnings (marked with *), and the number of words."""
    ws = words(text)
    out: Counter = Counter()
    for w, n in Counter(ws).items():
        out[w] += n
        if len(w) > STEM[0]:
            chars = w.decode("utf-8", "replace")
            for k in range(STEM[0], min(STEM[1], len(chars) - 1) + 1):
                out[chars[:k].encode() + b"*"] += n
    return out, len(ws)


def values(n: int, total: int) -> tuple[float, float]:
    return float(np.log1p(n)), min(100.0 * n / total, MAX_SHARE)


@dataclass
class OrdinalModel:
    """Two weights by feature, for count and share, and ordered thresholds."""

    weights: dict[bytes, tuple[float, float]] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=lambda: [30.0, 31.0])

    def __post_init__(self):
        #: Where a beginning that counts may start; few words share one.
        self._heads = {f[:-1].decode("utf-8", "replace")[: STEM[0]] for f in self.weights if f.endswith(b"*")}

    def _hits(self, word: bytes) -> list[bytes]:
        """The features of a word that have weights."""
        out = [word] if word in self.weights else []
        if len(word) > STEM[0] and (chars := word.decode("utf-8", "replace"))[: STEM[0]] in self._heads:
            stems = (chars[:k].encode() + b"*" for k in range(STEM[0], min(STEM[1], len(chars) - 1) + 1))
            out += [f for f in stems if f in self.weights]
        return out

    def score(self, text: bytes) -> float:
        """w.x, at a look-up or two per distinct word."""
        counts = Counter(ws := words(text))
        found: Counter = Counter()
        for w, n in counts.items():
            for f in self._hits(w):
                found[f] += n
        total = 0.0
        for f, n in sorted(found.items()):
            (a, b), (x, y) = self.weights[f], values(n, len(ws))
            total += a * x + b * y
        return total

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """P(grade = k), one column per grade."""
        below = _sigmoid(np.asarray(self.thresholds)[None, :] - scores[:, None])
        edges = np.concatenate([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))], axis=1)
        return np.diff(edges, axis=1)


def fit_ordinal(docs: list[list[tuple[int, float]]], grades: np.ndarray, n_words: int, n_grades: int = GRADES, l1: float = L1, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights >= 0 and thresholds that minimise mean negative log-likelihood + l1 * w, by accelerated proximal gradient.

    Thresholds are theta_0 plus positive gaps (softplus), so they stay ordered.
    """
    row = np.concatenate([np.full(len(d), i) for i, d in enumerate(docs)]).astype(np.int64) if docs else np.zeros(0, np.int64)
    col = np.array([c for d in docs for c, _ in d], dtype=np.int64)
    val = np.array([v for d in docs for _, v in d], dtype=np.float64)
    n = len(grades)
    base = np.array([(np.sum(grades <= k) + 1) / (n + 2) for k in range(n_grades - 1)])
    cut = np.log(base / (1 - base))
    raw = np.concatenate([cut[:1], np.log(np.expm1(np.maximum(np.diff(cut), 1e-2)))])
    w = np.zeros(n_words)
    # The score's curvature is at most 1/4 a row; the largest eigenvalue of X'X bounds the step.
    v = np.ones(n_words)
    top = 1.0
    for _ in range(20):
        u = np.bincount(row, val * v[col], minlength=n)
        v = np.bincount(col, val * u[row], minlength=n_words)
        top = np.linalg.norm(v) or 1.0
        v /= top
    rate = 1.0 / (0.5 * top / n + 1.0)
    yw, yr, t = w.copy(), raw.copy(), 1.0
    for _ in range(steps):
        gaps = np.log1p(np.exp(yr[1:]))
        theta = np.concatenate([yr[:1], yr[0] + np.cumsum(gaps)])
        s = np.bincount(row, val * yw[col], minlength=n)
        lo = np.where(grades > 0, _sigmoid(theta[np.maximum(grades - 1, 0)] - s), 0.0)
        hi = np.where(grades < n_grades - 1, _sigmoid(theta[np.minimum(grades, n_grades - 2)] - s), 1.0)
        p = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = np.where(grades < n_grades - 1, hi * (1 - hi), 0) / p, np.where(grades > 0, lo * (1 - lo), 0) / p
        gs = (d_hi - d_lo) / n
        gw = np.bincount(col, val * gs[row], minlength=n_words)
        gt = np.array([np.sum(d_lo[grades == k + 1]) - np.sum(d_hi[grades == k]) for k in range(n_grades - 1)]) / n
        gr = np.concatenate([[gt.sum()], [gt[k + 1 :].sum() * _sigmoid(yr[k + 1 : k + 2])[0] for k in range(n_grades - 2)]])
        nw = yw - rate * gw
        nw = np.maximum(nw - rate * l1, 0)
        nr = yr - rate * gr
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        yw, yr = nw + (t - 1) / nt * (nw - w), nr + (t - 1) / nt * (nr - raw)
        w, raw, t = nw, nr, nt
    gaps = np.log1p(np.exp(raw[1:]))
    return w, np.concatenate([raw[:1], raw[0] + np.cumsum(gaps)])


def _sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """Labelled texts: (doc_id, grade, n_words, words, counts), about `limit` at most by a hash of doc_id; near copies once."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") <= 0, 0).when(F.col("quality") == 0, 2).otherwise(1)).alias("grade"))
    n = known.count()
    if n > limit:
        known = known.where(F.pmod(F.xxhash64(F.lit(10), "doc_id"), F.lit(1 << 20)) < int((1 << 20) * limit / n))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known.withColumnRenamed("doc_id", "__id"), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "grade")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("grade", T.IntegerType()), T.StructField("sketch", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        for k, text in enumerate(byte_texts(batch, "text")):
            # One text at a time: a text's words and counts are gone before the next one's are made.
            ws = words(text)
            sketch = min((xxhash.xxh64_intdigest(b" ".join(ws[k : k + 5])) for k in range(max(1, len(ws) - 4))), default=0) - (1 << 63)
            bag, n = features(text)
            yield {"doc_id": [batch.column(0)[k].as_py()], "grade": [batch.column(2)[k].as_py()], "sketch": [sketch], "n_words": [n], "words": [list(bag)], "counts": [list(bag.values())]}

    bags = materialize(arrow_map(rows, step, schema), "labelled")
    first = bags.groupBy("sketch").agg(F.min("doc_id").alias("__first"))
    return bags.join(first.withColumnRenamed("sketch", "__s"), (F.col("sketch") == F.col("__s")) & (F.col("doc_id") == F.col("__first"))).select("doc_id", "grade", "n_words", "words", "counts")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> OrdinalModel:
    """Fit on labelled documents: at most about `max_labelled` rows and MAX_WORDS words reach the driver.

    A document's grade is the worst of its labels; null ids and labels are
    ignored; a doc_id that occurs several times counts with each of its texts
    unless they are near copies. Without labels of both kinds, or words that
    tell them apart, the model accepts everything. Ties among words go by name.
    """
    sample = materialize(_sample(docs, labels, max_labelled), "sample")
    n, pos = sample.agg(F.count("*"), F.sum((F.col("grade") > 0).cast("long"))).first()
    if not pos or pos == n:
        return OrdinalModel()
    by_word = sample.select("grade", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum((F.col("grade") > 0).cast("long")).alias("k")).where(F.col("n") >= MIN_DOCS)
    p = F.col("n") / F.lit(n)
    z = (F.col("k") / F.lit(pos) - (F.col("n") - F.col("k")) / F.lit(n - pos)) / F.sqrt(p * (1 - p) * F.lit(1 / pos + 1 / (n - pos)) + F.lit(1e-12))
    chosen = [bytes(r.word) for r in by_word.withColumn("z", z).where(F.col("z") >= MIN_Z).orderBy(F.col("z").desc(), "word").limit(MAX_WORDS).collect()]
    if not chosen:
        return OrdinalModel()
    at = {w: k for k, w in enumerate(chosen)}
    table = F.broadcast(sample.sparkSession.createDataFrame([(bytearray(w), k) for w, k in at.items()], "word binary, col int"))
    pairs = sample.select("doc_id", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("doc_id", F.col("x.words").alias("word"), F.col("x.counts").alias("count")).join(table, "word").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("col", "count"))).alias("xs"))
    rows = sorted(sample.select("doc_id", "grade", "n_words").join(pairs, "doc_id", "left").collect(), key=lambda r: (r.doc_id, r.grade))
    feats = [[(2 * x["col"] + part, v) for x in r.xs or [] for part, v in enumerate(values(x["count"], r.n_words))] for r in rows]
    w, theta = fit_ordinal(feats, np.array([r.grade for r in rows]), 2 * len(chosen))
    return OrdinalModel({word: (float(w[2 * k]), float(w[2 * k + 1])) for word, k in at.items() if w[2 * k] or w[2 * k + 1]}, [float(x) for x in theta])


SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("rejected", T.BooleanType())])


def score(docs: DataFrame, model: OrdinalModel, reject: float = REJECT) -> DataFrame:
    """One row per document row: expected severity, P(grade >= 1), likeliest grade (the lower on ties), verdict.

    Null and empty texts score zero words. Repeated rows and ids are scored
    each; extra columns are ignored; an empty table gives no rows.
    """

    def step(batch: pa.RecordBatch) -> dict:
        probs = model.probabilities(np.array([model.score(t) for t in byte_texts(batch, "text")], dtype=float))
        toxic = 1 - probs[:, 0]
        return {"doc_id": batch.column(0).cast(pa.int64()).to_pylist(), "severity": probs @ np.arange(probs.shape[1]), "p_toxic": toxic, "grade": np.argmax(probs, axis=1).astype(np.int32), "rejected": toxic >= reject}

    return arrow_map(docs.select("doc_id", "text"), step, SCORES)


def drop_toxic(docs: DataFrame, model: OrdinalModel, reject: float = REJECT) -> DataFrame:
    """`docs` without rejected rows, all columns as they were, in one pass and without a shuffle; of repeated rows all stay or go, null texts stay unless the model rejects no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, STEP_BYTES):
                probs = model.probabilities(np.array([model.score(t) for t in byte_texts(part, "text")], dtype=float))
                yield part.filter(pa.array(1 - probs[:, 0] < reject))

    return docs.mapInArrow(run, docs.schema)
