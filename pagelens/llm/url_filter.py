"""URL filtering: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from the urls that a rule decides (block is the positive class), on a sample
bounded by MAX_LABELLED rows in hash order; the fitted trees are a few kilobytes and travel
with the task closure.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and
is judged by the trees; repeated urls get equal verdicts; without labelled urls, or with labels
of one class only, the trees give that class (allow where there is none).
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm import common

#: (verdict, host, path), as given.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Labelled urls that training looks at, at most.
MAX_LABELLED = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Host and path of the longest rule that fits, else null, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def decided(df: DataFrame, rules=RULES) -> DataFrame:
    """df (host, path) with rule and ruled, its verdict."""
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    return df.withColumns({"rule": rule, "ruled": verdict})


FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "n_params", "hyphens", "has_fragment", "tld_rate", "tld_n", "domain_rate", "domain_n"]


def suffixes(h: str) -> tuple[str, str]:
    parts = h.split(".")
    return parts[-1], ".".join(parts[-2:])


def lexical(url: str | None, h: str, p: str) -> list[float]:
    u = url or ""
    counts = Counter(u)
    entropy = -sum(c / len(u) * math.log2(c / len(u)) for c in counts.values()) if u else 0.0
    query = re.search(r"\?([^#]*)", u)
    return [
        len(u), len(h), len(p), sum(1 for x in p.split("/") if x), h.count(".") + 1 if h else 0, sum(map(u.count, "0123456789")) / max(1, len(u)), entropy,
        sum(1 for x in re.split("[&;]", query[1]) if x) if query else 0, u.count("-"), float("#" in u),
    ]


class SuffixStatistics:
    """Smoothed block rate and log count of a host's last label and last two labels."""

    def __init__(self, hosts: list[str], y: np.ndarray, strength: float = 20.0):
        self.prior, self.strength, self.seen = float(y.mean()) if len(y) else 0.5, strength, [{}, {}]
        for h, label in zip(hosts, y, strict=True):
            for level, s in zip(self.seen, suffixes(h), strict=True):
                n, blocked = level.get(s, (0, 0))
                level[s] = (n + 1, blocked + int(label))

    def of(self, h: str, own: int | None = None) -> list[float]:
        """own: the label of the row itself, which is taken out again while training."""
        out = []
        for level, s in zip(self.seen, suffixes(h), strict=True):
            n, blocked = level.get(s, (0, 0))
            if own is not None:
                n, blocked = n - 1, blocked - own
            out += [(blocked + self.strength * self.prior) / (n + self.strength), math.log1p(n)]
        return out


class BoostedTrees:
    """Gradient boosting of the logistic loss with histogram-split trees of fixed depth."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 8, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.base, self.edges, self.nodes = 0.0, [], []

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b, p = self.binned(x), min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base = math.log(p / (1 - p))
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            split, leaf = self._tree(b, y - p, p * (1 - p))
            self.nodes.append((split, leaf))
            score += self.rate * leaf[self._leaves(b, split)]
        return self

    def _tree(self, b, g, h):
        """split: (feature, bin) by node in heap order, feature -1 where all go left; leaf: values."""
        inner = 2**self.depth - 1
        split, at = np.full((inner, 2), -1), np.zeros(len(g), int)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = 1e-9
            gs, hs = g[rows].sum(), h[rows].sum()
            for j, edges in enumerate(self.edges):
                if not len(edges) or len(rows) < 2 * self.least:
                    continue
                w = len(edges) + 1
                gl, hl, nl = (np.cumsum(np.bincount(b[rows, j], v, w))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
                gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                gain[(nl < self.least) | (len(rows) - nl < self.least)] = 0
                if gain.max() > best:
                    best, split[node] = gain.max(), (j, int(gain.argmax()))
            right = b[rows, split[node, 0]] > split[node, 1] if split[node, 0] >= 0 else np.zeros(len(rows), bool)
            at[rows] = 2 * node + 1 + right
        leaf = np.bincount(at - inner, g, inner + 1) / (np.bincount(at - inner, h, inner + 1) + self.ridge)
        return split, leaf

    def _leaves(self, b, split):
        at = np.zeros(len(b), int)
        for _ in range(self.depth):
            j, cut = split[at, 0], split[at, 1]
            at = 2 * at + 1 + ((j >= 0) & (b[np.arange(len(b)), j] > cut))
        return at - len(split)

    def probability(self, x: np.ndarray) -> np.ndarray:
        b, score = self.binned(x), np.full(len(x), self.base)
        for split, leaf in self.nodes:
            score += self.rate * leaf[self._leaves(b, split)]
        return 1 / (1 + np.exp(-score))


class UrlModel:
    def __init__(self, rows: list[tuple[str | None, str, str, int]]):
        y = np.array([r[3] for r in rows], float)
        self.suffix = SuffixStatistics([r[1] for r in rows], y)
        self.constant = float(y[0]) if len(set(y)) == 1 else 0.0 if not len(y) else None
        if self.constant is None:
            self.trees = BoostedTrees().fit(np.array([lexical(u, h, p) + self.suffix.of(h, int(t)) for u, h, p, t in rows], float), y)

    def probability(self, urls, hosts, paths) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(urls), self.constant)
        return self.trees.probability(np.array([lexical(u, h, p) + self.suffix.of(h) for u, h, p in zip(urls, hosts, paths, strict=True)], float).reshape(-1, len(FEATURES)))


def fit(labelled: DataFrame, max_rows: int = MAX_LABELLED) -> UrlModel:
    """labelled: (url, host, path, ruled). The sample is the first max_rows distinct urls in hash order."""
    picked = labelled.select("url", "host", "path", F.expr("int(ruled = 'block')").alias("y"))
    return UrlModel([(r.url, r.host, r.path, r.y) for r in common.sampled(picked, max_rows, "url", 42)])


def filtered(pages: DataFrame, rules=RULES, max_rows: int = MAX_LABELLED) -> DataFrame:
    """pages with a struct `url_filter` of host, path, rule, block_probability and verdict; all other columns stay as they are."""
    parts = decided(pages.select("url").withColumns({"host": host(F.col("url")), "path": path(F.col("url"))}), rules)
    model = fit(parts.where("ruled is not null"), max_rows)

    @F.pandas_udf("double")
    def judge(u: pd.Series, h: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series(model.probability([x if isinstance(x, str) else None for x in u], list(h), list(p)))

    h, p = host(F.col("url")), path(F.col("url"))
    rule, ruled = matched(h, p, rules)
    df = pages.withColumn("url_filter", F.struct(h.alias("host"), p.alias("path"), rule.alias("rule"), ruled.alias("ruled"), judge("url", h, p).alias("block_probability")))
    at = F.col("url_filter")
    verdict = F.coalesce(at["ruled"], F.when(at["block_probability"] >= 0.5, "block").otherwise("allow"))
    return df.withColumn("url_filter", F.struct(*(at[k].alias(k) for k in ("host", "path", "rule", "block_probability")), verdict.alias("verdict")))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filtered(common.table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.selectExpr("page_id", *(f"url_filter.{k}" for k in ("host", "path", "rule", "verdict")), "round(url_filter.block_probability, 6) as block_probability")
