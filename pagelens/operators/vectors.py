"""Keyword vectors in long form, and seeded cosine k-means with automatic k.

Context, lexical and coverage blocks are built by joins and aggregations; only the clustering of
one group (at most MAX_CLUSTERED vectors of a few hundred dimensions) runs in a grouped map.
engine="mllib" replaces it for point sets without such a bound.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens import lexicon as L
from pagelens.functions import text as T

CONTEXT_WEIGHT, LEXICAL_WEIGHT, COVERAGE_WEIGHT = 1.6, 0.9, 0.5
SEED, K_MIN, K_MAX, ROUNDS, SINGLETON_COST = 42, 2, 8, 60, 0.35


def selected(kw: DataFrame) -> DataFrame:
    """Keywords that go into clustering: the first of each group that has enough of them."""
    n = F.count("*").over(Window.partitionBy("group_id"))
    return kw.where(F.col("rank") <= L.MAX_CLUSTERED).withColumn("__n", n).where("__n >= 6").drop("__n")


def lexical_vocabulary(kw: DataFrame) -> DataFrame:
    """group_id, token, freq, dim (from 0): the most frequent tokens of the selected terms."""
    toks = kw.select("group_id", "rank", F.posexplode(F.split("term", " ")).alias("pos", "token")).where(~F.col("token").isin(*L.STOPWORDS))
    df = toks.groupBy("group_id", "token").agg(F.count("*").alias("freq"), F.min(F.struct("rank", "pos")).alias("first"))
    df = df.withColumn("dim", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("freq"), "first")) - 1)
    return df.where(F.col("dim") < L.DIMS).select("group_id", "token", "freq", "dim")


def context_segments(docs: DataFrame) -> DataFrame:
    """group_id, doc_idx, seg, toks: content tokens of each segment that has two or more."""
    parts = [F.nullif(F.coalesce(F.col(f"fields.{k}"), F.lit("")), F.lit("")) for k in ("title", "description", "h1", "h2", "h3", "body")]
    df = docs.select("group_id", "doc_idx", F.transform(T.segments(F.concat_ws(". ", *parts)), T.tokens).alias("s"))
    kept = F.transform("s", lambda t: F.filter(t, lambda x: ~x.isin(*L.STOPWORDS) & (F.length(x) >= 3)))
    return df.select("group_id", "doc_idx", F.posexplode(kept).alias("seg", "toks")).where(F.size("toks") >= 2)


def context_vocabulary(segs: DataFrame) -> DataFrame:
    toks = segs.select("group_id", "doc_idx", "seg", F.posexplode("toks").alias("pos", "token"))
    df = toks.groupBy("group_id", "token").agg(F.count("*").alias("freq"), F.min(F.struct("doc_idx", "seg", "pos")).alias("first"))
    df = df.withColumn("dim", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("freq"), "first")) - 1)
    return df.where(F.col("dim") < L.DIMS).select("group_id", "token", "freq", "dim")


def _lists(kw: DataFrame, *vocab: DataFrame) -> DataFrame:
    """group_id, terms and their ranks, and a map of each vocabulary's tokens to dimensions: a few hundred entries for each group.

    Joined by group_id alone, they find terms and tokens without a shuffle by those.
    """
    pairs = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
    return reduce(lambda df, v: df.join(v, "group_id"), [x.groupBy("group_id").agg(pairs("token", "dim").alias("dims")) for x in vocab], kw.groupBy("group_id").agg(pairs("term", "rank").alias("ranks")))


def _dims(tokens: Column) -> Column:
    """Dimensions of those tokens that have one."""
    return F.filter(F.transform(tokens, lambda t: F.try_element_at("dims", t)), lambda d: d.isNotNull())


def cooccurrence(kw: DataFrame, segs: DataFrame, vocab: DataFrame) -> DataFrame:
    """group_id, term, dim, c, rank: the n-grams of each segment that are keywords of its group, where substring tests would need all pairs."""
    starts = lambda n: F.when(F.size("toks") >= n, F.sequence(F.lit(1), F.size("toks") - (n - 1))).otherwise(F.array().cast("array<int>"))
    each = lambda n: F.transform(starts(n), lambda i: F.array_join(F.slice("toks", i, n), " "))
    found = F.array_intersect(F.flatten(F.array(each(1), each(2), each(3))), F.map_keys("ranks"))
    hits = segs.join(_lists(kw, vocab), "group_id").withColumn("found", found).where(F.size("found") > 0)
    hits = hits.select("group_id", _dims(F.col("toks")).alias("at"), F.explode(F.transform("found", lambda t: F.struct(t.alias("term"), F.try_element_at("ranks", t).alias("rank")))).alias("t"))
    return hits.select("group_id", "t.term", "t.rank", F.explode("at").alias("dim")).groupBy("group_id", "term", "dim").agg(F.count("*").alias("c"), F.max("rank").alias("rank"))


def ppmi(cells: DataFrame) -> DataFrame:
    """Positive pointwise mutual information of the counts, each row scaled to unit length; zeros are left out."""
    s = lambda *by: F.sum("c").over(Window.partitionBy(*by))
    df = cells.withColumn("v", F.greatest(F.lit(0.0), F.ln(F.col("c") * s("group_id") / (s("group_id", "term") * s("group_id", "dim"))))).where("v > 0")
    return df.withColumn("v", F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("group_id", "term")))).select("group_id", "term", "rank", "dim", "v")


def assembled(kw: DataFrame, docs: DataFrame) -> DataFrame:
    """group_id, term, rank, block, dim, v: the three weighted blocks of each vector, before scaling to unit length."""
    segs, key = context_segments(docs), ["group_id", "term", "rank"]
    ctx = ppmi(cooccurrence(kw, segs, context_vocabulary(segs))).select(*key, F.lit(0).alias("block"), "dim", (F.col("v") * CONTEXT_WEIGHT).alias("v"))
    lex = kw.select(*key).join(_lists(kw, lexical_vocabulary(kw)), "group_id").select(*key, F.explode(_dims(F.split("term", " "))).alias("dim"))
    lex = lex.groupBy(*key, "dim").count().select(*key, F.lit(1).alias("block"), "dim", (F.col("count") * LEXICAL_WEIGHT).alias("v"))
    cov = kw.select(*key, F.lit(2).alias("block"), F.posexplode(F.concat(F.array("tfidf"), "competitor_tfidf")).alias("dim", "x")).select(*key, "block", "dim", (F.col("x") * COVERAGE_WEIGHT).alias("v"))
    return ctx.unionByName(lex).unionByName(cov)


def l2(v: Column) -> Column:
    """Scaled to unit length; zero vectors stay."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def random_stream(seed: int):
    """32-bit mixing generator (public-domain "mulberry32"): yields doubles in [0, 1)."""
    state, word = seed & 0xFFFFFFFF, 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & word
        x = state
        x = ((x ^ (x >> 15)) * (x | 1)) & word
        x = x ^ ((x + ((x ^ (x >> 7)) * (x | 61) & word)) & word)
        yield ((x ^ (x >> 14)) & word) / 4294967296


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.where(n > 0, x / np.where(n > 0, n, 1), x)


def seeds(x: np.ndarray, k: int, draw) -> np.ndarray:
    chosen, near = [x[int(next(draw) * len(x))]], np.full(len(x), np.inf)
    while len(chosen) < k:
        near = np.minimum(near, 1 - x @ chosen[-1])
        mass = np.cumsum(near * near)
        if mass[-1] == 0:
            chosen.append(np.eye(1, x.shape[1])[0])
            continue
        aim = next(draw) * mass[-1]
        chosen.append(x[min(int(np.searchsorted(mass, aim, side="left")), len(x) - 1)])
    return np.stack(chosen)


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, float]:
    """Assignment, centroids and inertia of Lloyd's algorithm under cosine distance; x has unit rows."""
    centres, own, inertia = seeds(x, k, random_stream(seed)), np.full(len(x), -1), 0.0
    for _ in range(rounds):
        d = 1 - x @ centres.T
        near = d.argmin(axis=1)
        inertia, moved = float((d[np.arange(len(x)), near] ** 2).sum()), (near != own).any()
        own = near
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = np.bincount(own, minlength=k) == 0
        if empty.any():
            sums[empty] = x[int(d[np.arange(len(x)), own].argmax())]
        centres = _unit(sums)
        if not moved:
            break
    return own, centres, inertia


def silhouette(x: np.ndarray, own: np.ndarray, k: int) -> float:
    n, sizes = len(x), np.bincount(own, minlength=k)
    if k < 2 or n <= k or (sizes == 0).any():
        return -1.0
    d = 1 - x @ x.T
    np.fill_diagonal(d, 0)
    sums = d @ np.eye(k)[own]
    mine = sizes[own]
    a = np.where(mine > 1, sums[np.arange(n), own] / np.maximum(mine - 1, 1), 0)
    mean = sums / sizes
    mean[np.arange(n), own] = np.inf
    b = mean.min(axis=1)
    top = np.maximum(a, b)
    return float(np.where(top == 0, 0, (b - a) / np.where(top == 0, 1, top)).mean())


def auto_cluster(x: np.ndarray, k_min: int = K_MIN, k_max: int = K_MAX, seed: int = SEED, penalize: bool = True) -> tuple[np.ndarray, int, float]:
    """Assignment, k and silhouette of the best k; the smallest k wins ties."""
    n = len(x)
    if n < 4:
        return np.zeros(n, int), min(n, 1), -1.0
    best = None
    for k in range(k_min, max(k_min, min(k_max, n // 3)) + 1):
        own, _, _ = kmeans(x, k, seed=seed)
        score = silhouette(x, own, k)
        ranked = score - SINGLETON_COST * float((np.bincount(own, minlength=k) < 2).sum()) / k if penalize else score
        if best is None or ranked > best[0]:
            best = (ranked, own, k, score)
    return best[1], best[2], best[3]


def clustered_groups(long: DataFrame) -> DataFrame:
    """One row for each group: group_id, terms, ranks, clusters (of each term), k, silhouette. long: as assembled() gives it; a group is one analysis of bounded size."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        found = pdf[["term", "rank"]].drop_duplicates().sort_values("rank")
        terms = found["term"].tolist()
        dims = sorted(set(zip(pdf["block"], pdf["dim"], strict=True)))
        x = np.zeros((len(terms), len(dims)))
        row, col = {t: i for i, t in enumerate(terms)}, {d: i for i, d in enumerate(dims)}
        for t, b, d, v in zip(pdf["term"], pdf["block"], pdf["dim"], pdf["v"], strict=True):
            x[row[t], col[(b, d)]] += v
        own, k, score = auto_cluster(_unit(x))
        return pd.DataFrame({"group_id": [pdf["group_id"].iloc[0]], "terms": [terms], "ranks": [found["rank"].tolist()], "clusters": [own.tolist()], "k": [k], "silhouette": [score]})

    return long.groupBy("group_id").applyInPandas(one, "group_id string, terms array<string>, ranks array<int>, clusters array<int>, k int, silhouette double")


def clustered(long: DataFrame) -> DataFrame:
    """group_id, term, cluster, k, silhouette. long: as assembled() gives it."""
    df = clustered_groups(long).select("group_id", F.explode(F.arrays_zip("terms", "clusters")).alias("x"), "k", "silhouette")
    return df.select("group_id", F.col("x.terms").alias("term"), F.col("x.clusters").alias("cluster"), "k", "silhouette")


def members(kw: DataFrame, groups: DataFrame) -> DataFrame:
    """Keyword rows with cluster, k and silhouette. groups: as clustered_groups() gives them.

    A group's clusters come to its keywords as one row, so keywords that are dealt out by group stay where they are.
    """
    own = groups.select("group_id", F.map_from_arrays("ranks", "clusters").alias("__own"), "k", "silhouette")
    df = kw.join(own, "group_id").withColumn("cluster", F.try_element_at("__own", F.col("rank"))).where("cluster is not null")
    return df.select(*kw.columns, "cluster", "k", "silhouette")


def clustered_at_scale(points: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """points (id, v array<double>) of any number: MLlib's k-means with cosine distance. Adds cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    df = points.withColumn("__v", array_to_vector("v"))
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", featuresCol="__v", predictionCol="cluster").fit(df)
    return model.transform(df).drop("__v")


def theme() -> Column:
    cov, t, s = F.col("avg_coverage"), F.col("avg_target"), F.col("avg_comp")
    return (
        F.when(F.col("comp_count") == 0, "onpage").when(cov < 0.15, "unique").when((t < 0.1) & (cov >= 0.4), "gap").when((cov >= 0.6) & (t < s * 0.7), "weak")
        .when(t >= s, "strength").otherwise("contested")
    )


# Label and advice by theme.
THEMES = {
    "onpage": ("On-page topic", "Add competitors to see how this topic compares to the category."),
    "unique": ("Only you", "No one else in the set covers this. Either a real differentiator or off-topic drift — decide which."),
    "gap": ("Content gap", "The category covers this topic and this page does not. Highest-leverage place to add a section."),
    "weak": ("Table stakes, underweight", "Everyone covers this and you do so weakly. Strengthen it before chasing new topics."),
    "strength": ("Your strength", "You lead the set here. Keep this copy and build internal links around it."),
    "contested": ("Contested", "You are level with the category. Depth and freshness decide this one."),
}


def theme_texts(key: Column) -> tuple[Column, Column]:
    """Label and advice of a theme."""
    known = F.create_map(*(x for k, (label, text) in THEMES.items() for x in (F.lit(k), F.struct(F.lit(label).alias("label"), F.lit(text).alias("advice")))))
    return F.try_element_at(known, key)["label"], F.try_element_at(known, key)["advice"]


def labels(members: DataFrame) -> DataFrame:
    """group_id, cluster, label: the tokens that the best members share. members: group_id, cluster, term, rank."""
    m = members.withColumn("r", F.row_number().over(Window.partitionBy("group_id", "cluster").orderBy("rank")) - 1)
    toks = m.where("r < 25").select("group_id", "cluster", "r", F.posexplode(F.split("term", " ")).alias("pos", "token")).where(~F.col("token").isin(*L.STOPWORDS) & (F.length("token") >= 3))
    w = toks.groupBy("group_id", "cluster", "token").agg(F.round(F.sum(1 / (1 + 0.15 * F.col("r"))), 9).alias("w"), F.min(F.struct("r", "pos")).alias("first"))
    w = w.withColumn("o", F.row_number().over(Window.partitionBy("group_id", "cluster").orderBy(F.desc("w"), "first"))).where("o <= 3")
    named = w.groupBy("group_id", "cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "token"))), lambda x: x["token"]), " · ").alias("label"))
    first = m.where("r = 0").select("group_id", "cluster", F.col("term").alias("fallback"))
    return first.join(named, ["group_id", "cluster"], "left").select("group_id", "cluster", F.coalesce("label", "fallback").alias("label"))


def summaries(members: DataFrame) -> DataFrame:
    """One row for each cluster. members: keyword rows with cluster and silhouette.

    Averages add up in the order of rank: themes compare them with limits that they often meet exactly, where another
    order would change the last digit and with it the theme. A cluster has at most MAX_VOCAB members.
    """
    mean = lambda name: (F.aggregate("__rows", F.lit(0.0), lambda s, x: s + x[name]) / F.col("size")).alias(name)
    rows = F.struct("rank", F.col("coverage").alias("avg_coverage"), F.col("target_strength").alias("avg_target"), F.col("comp_strength").alias("avg_comp"))
    df = members.groupBy("group_id", "cluster").agg(
        F.count("*").alias("size"), F.sort_array(F.collect_list(rows)).alias("__rows"), F.floor(F.round(F.avg("score"), 9) + 0.5).cast("int").alias("avg_score"),
        F.max("comp_count").alias("comp_count"), F.max("silhouette").alias("silhouette"),
    )
    df = df.select("group_id", "cluster", "size", "avg_score", "comp_count", "silhouette", *map(mean, ("avg_coverage", "avg_target", "avg_comp")))
    df = df.join(labels(members), ["group_id", "cluster"]).withColumn("theme", theme())
    label, text = theme_texts(F.col("theme"))
    df = df.withColumns({"theme_label": label, "advice": text})
    return df.withColumn("id", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("avg_score"), "cluster")) - 1)
