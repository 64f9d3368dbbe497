"""Language identification by the nearest of several centroids for each language.

Texts become TF-IDF vectors of hashed character bigrams and trigrams around letters (case
folded, non-letters act as one word boundary), normalised to unit length. The vectors of each
language are clustered by spherical k-means; a text takes the language of the closest centroid
by cosine. A text further away from it than nearly all the texts that the centroid was made of
is flagged `rejected`; its language is still the nearest one.

Training looks at no more than PER_LANGUAGE texts of a language and MAX_TEXTS in all, in the
order of a hash, and at whole texts. Defined results: null texts and texts without a letter are
"und" with score 0; without any training text all are "und"; equal texts get equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.llm import common

#: Bounds of the training sample.
PER_LANGUAGE, MAX_TEXTS = 1000, 8000
BITS, CLUSTERS, ROUNDS, REJECT_SHARE = 13, 4, 8, 0.995
_FOLDED: np.ndarray | None = None


def folded() -> np.ndarray:
    """By code point: the code point of its lower case if it is a letter, else 0."""
    global _FOLDED
    if _FOLDED is None:
        out = np.zeros(0x110000, np.uint32)
        for c in map(chr, range(0x110000)):
            if c.isalpha():
                out[ord(c)] = ord(c.lower()[0])
        _FOLDED = out
    return _FOLDED


def grams(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams, or None for a text without letters."""
    if not text:
        return None
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.concatenate([[np.uint32(0)], folded()[codes], [np.uint32(0)]]).astype(np.uint32)
    keep = (x[1:] != 0) | (x[:-1] != 0)  # runs of non-letters shrink to one boundary
    x = np.concatenate([x[:1], x[1:][keep]])
    if len(x) < 3:
        return None
    a, b, c = x[:-2], x[1:-1], x[2:]
    two = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D)
    three = (two ^ (c + np.uint32(0x165667B1))) * np.uint32(0x27D4EB2F)
    shift, real = np.uint32(32 - BITS), b != 0
    return np.bincount(two[real] >> shift, minlength=1 << BITS) + np.bincount(three[real] >> shift, minlength=1 << BITS)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


class Centroids:
    def __init__(self, texts: list[str], langs: list[str], clusters: int = CLUSTERS, seed: int = 7):
        found = [(g, lang) for g, lang in zip(map(grams, texts), langs, strict=True) if g is not None]
        self.langs: list[str] = []
        self.idf = np.ones(1 << BITS, np.float32)
        if not found:
            return
        df = np.zeros(1 << BITS)
        for g, _ in found:
            df += g > 0
        self.idf = (np.log((1 + len(found)) / (1 + df)) + 1).astype(np.float32)
        centres, bounds, rng = [], [], np.random.default_rng(seed)
        for lang in sorted({x[1] for x in found}):
            x = np.stack([self.vector(g) for g, own in found if own == lang])
            c = x[rng.choice(len(x), min(clusters, len(x)), replace=False)]
            for _ in range(ROUNDS):
                near = (x @ c.T).argmax(axis=1)
                c = unit(np.stack([x[near == i].sum(axis=0) if (near == i).any() else c[i] for i in range(len(c))]))
            close = x @ c.T
            near = close.argmax(axis=1)
            for i in range(len(c)):
                if (near == i).any():
                    centres.append(c[i])
                    bounds.append(1 - np.quantile(close[near == i, i], 1 - REJECT_SHARE))
                    self.langs.append(lang)
        self.centres, self.bounds = np.stack(centres).astype(np.float32), np.array(bounds)

    def vector(self, g: np.ndarray) -> np.ndarray:
        return unit(np.sqrt(g).astype(np.float32) * self.idf)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        g = grams(text) if self.langs else None
        if g is None:
            return "und", 0.0, True
        close = self.centres @ self.vector(g)
        i = int(close.argmax())
        return self.langs[i], float(min(1.0, max(0.0, close[i]))), bool(1 - close[i] > self.bounds[i])


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, max_texts: int = MAX_TEXTS) -> Centroids:
    """docs: text, lang. Hashes of distinct texts are picked first; only then are the picked texts fetched.

    A language's hashes are spread evenly, so those below a cut of four times its share hold its first
    per_language ones; only these are ordered, and no task sees more of a language than that, whatever
    the table's size. At most max_texts languages can have a text in the sample, so no more are carried.
    """
    texts = docs.where("lang is not null and text is not null").select("lang", F.xxhash64("text").alias("h"), "text")
    langs = texts.groupBy("lang").agg(F.approx_count_distinct("h").alias("distinct")).orderBy("lang").limit(max_texts)
    low = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) * F.col("distinct") < 4.0 * per_language
    keys = texts.select("lang", "h").join(F.broadcast(langs), "lang").where(low).select("lang", "h").distinct()
    order = F.shiftrightunsigned("h", 11)
    by_lang = Window.partitionBy("lang").orderBy(order, "h")
    keys = keys.withColumn("n", F.row_number().over(by_lang)).where(F.col("n") <= per_language).orderBy("n", "lang").limit(max_texts).select("lang", "h")
    picked = texts.join(F.broadcast(keys), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).orderBy("lang", "h").toArrow()
    return Centroids(picked["text"].to_pylist(), picked["lang"].to_pylist())


def identified(docs: DataFrame, model: Centroids) -> DataFrame:
    """docs with a struct `language` of lang_pred, score and rejected, from the text alone."""
    model_of = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: centroids and idf

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model_of.value
        for texts in batches:
            langs, scores, rejected = zip(*(m.predict(t.as_py()) for t in texts), strict=True) if len(texts) else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["lang_pred", "score", "rejected"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn("language", F.arrow_udf(run, "lang_pred string, score double, rejected boolean")("text"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    model = fit(docs.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return identified(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "language.*")
