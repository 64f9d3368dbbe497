"""Quality classification by ordinal cumulative-link regression on graded ratings.

A text's features are the hashed distinct words and punctuation tails in it, and how much its
words repeat. One set of weights is shared by all grades: with score s, P(grade <= k) is the
logistic function of threshold k minus s, with ordered thresholds. Expected grade and the tail
probability of the top grade come from these; selection uses the latter.

Training uses TRAINED labelled documents at most (in the order of a hash, whole texts), turned
into feature ids on the executors. Defined results: null and empty texts have no features, so
score the same; without labels, or with one grade only, weights stay zero and thresholds follow
the counts; labels with null parts are left out; equal texts get equal rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm import common

TRAINED = 8000
BITS = 18
GRADES = 3
CORE = re.compile(r"(\W*)(.*?)(\W*)\Z", re.S)
_HASHED: dict[str, tuple[int, ...]] = {}


def hashed(word: str) -> tuple[int, ...]:
    """Feature ids of one word: its lower-case core, and its punctuation where there is any of note."""
    found = _HASHED.get(word)
    if found is None:
        lead, core, tail = CORE.match(word).groups()
        marks = (lead + "_" + tail) if len(lead + tail) > 1 or not core else ""
        names = ([f"w {core.lower()}"] if core else []) + ([f"m {marks}"] if marks else [])
        found = tuple(crc32(x.encode("utf-8", "surrogatepass")) >> (32 - BITS) for x in names)
        if len(_HASHED) > 300_000:
            _HASHED.clear()
        _HASHED[word] = found
    return found


def features(text: str | None) -> np.ndarray:
    words = (text or "").split()
    distinct = set(words)
    out = {i for w in distinct for i in hashed(w)}
    if words:
        out.add(crc32(f"r {min(9, 10 * len(distinct) // len(words))} {min(6, len(words).bit_length() // 2)}".encode()) >> (32 - BITS))
    return np.fromiter(out, np.int64, len(out))


def grade(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 poor, 2 good."""
    return F.when(toxic > 0, 0).when(quality > 0, 2).otherwise(1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def likelihood(params: np.ndarray, y: np.ndarray, row: np.ndarray, feature: np.ndarray, n_features: int, k: int) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood and its gradient. params: weights, first threshold, logarithms of the gaps to the next ones.

    row, feature: which features each row has.
    """
    n = len(y)
    w, first, gaps = params[:n_features], params[n_features], params[n_features + 1 :]
    cuts = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
    s = np.bincount(row, w[feature], n)
    upper = np.where(y < k, sigmoid(cuts[np.minimum(y, k - 1)] - s), 1.0)
    lower = np.where(y > 0, sigmoid(cuts[np.maximum(y - 1, 0)] - s), 0.0)
    p = np.maximum(upper - lower, 1e-9)
    du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p  # of log p, by each cut
    gw = np.bincount(feature, (du - dl)[row], n_features) / n
    gc = np.array([-(du[y == j].sum() - dl[y == j + 1].sum()) / n for j in range(k)])
    gg = np.array([gc[j + 1 :].sum() for j in range(k - 1)]) * np.exp(gaps)
    return -float(np.log(p).mean()), np.concatenate([gw, [gc.sum()], gg])


class CumulativeLink:
    """P(grade <= k) = sigmoid(thresholds[k] - s), with s the sum of the features' weights."""

    def __init__(self, grades: int = GRADES):
        self.weights, self.thresholds = np.zeros(1 << BITS, np.float32), np.linspace(-1, 1, grades - 1)

    def fit(self, rows: list[np.ndarray], y: np.ndarray, rounds: int = 150, rate: float = 0.05, ridge: float = 2e-4, least: int = 5) -> CumulativeLink:
        if not len(y):
            return self
        n, k = len(y), len(self.thresholds)
        share = np.clip([(y <= j).mean() for j in range(k)], 1e-3, 1 - 1e-3)
        share = np.maximum.accumulate(share + np.arange(k) * 1e-6)
        self.thresholds = np.log(share / (1 - share))
        if len(set(y.tolist())) < 2:
            return self
        sizes = np.array([len(r) for r in rows])
        flat = np.concatenate(rows)
        row = np.repeat(np.arange(n), sizes)
        seen = np.bincount(flat, minlength=1 << BITS)
        common_enough = seen[flat] >= least  # rarer features tell nothing
        ids, local = np.unique(flat[common_enough], return_inverse=True)
        row = row[common_enough]
        w, gaps = np.zeros(len(ids)), np.log(np.maximum(np.diff(self.thresholds), 1e-3))
        first = self.thresholds[0]
        params = np.concatenate([w, [first], gaps])
        m, v = np.zeros_like(params), np.zeros_like(params)
        for t in range(1, rounds + 1):
            _, g = likelihood(params, y, row, local, len(ids), k)
            g[: len(ids)] += ridge * params[: len(ids)]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            params = params - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.weights[ids] = params[: len(ids)]
        self.thresholds = params[len(ids)] + np.concatenate([[0], np.cumsum(np.exp(params[len(ids) + 1 :]))])
        return self

    def score(self, text: str | None) -> float:
        return float(self.weights[features(text)].sum())

    def judge(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and the probability of the top grade."""
        at_most = sigmoid(self.thresholds[None, :] - s[:, None])
        return (1 - at_most).sum(axis=1), 1 - at_most[:, -1]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, trained: int = TRAINED) -> CumulativeLink:
    """docs: doc_id, text; labels: doc_id, quality, toxic. Documents in held_out() are never looked at."""
    picked = labels.where("doc_id is not null and quality is not null and toxic is not null").where(~held_out())
    picked = picked.select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("y"), F.xxhash64("doc_id", F.lit(3)).alias("h")).orderBy("h", "doc_id", "y").limit(trained).drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [features(t.as_py()).astype("<i4").tobytes() for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["y"], pa.array(packed, pa.binary())], ["doc_id", "y", "ids"])

    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, ids binary").toArrow().sort_by("doc_id")
    return CumulativeLink().fit([np.frombuffer(x.as_py(), "<i4").astype(np.int64) for x in rows["ids"]], rows["y"].to_numpy().astype(int))


def graded(docs: DataFrame, model: CumulativeLink) -> DataFrame:
    """docs with a struct `grade` of expected_grade, top_probability and kept."""
    model_of = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: 2**BITS weights

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model_of.value
        for texts in batches:
            expected, top = m.judge(np.array([m.score(t.as_py()) for t in texts], float))
            yield pa.StructArray.from_arrays([pa.array(expected), pa.array(top), pa.array(top >= 0.5)], ["expected_grade", "top_probability", "kept"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn("grade", F.arrow_udf(run, "expected_grade double, top_probability double, kept boolean")("text"))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return graded(docs, model).select("doc_id", held_out().alias("held_out"), "grade.*")
