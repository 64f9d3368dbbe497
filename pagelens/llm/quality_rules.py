"""Quality rules: fixed base rules and a learned decision list, as Spark expressions throughout.

Statistics of a text are row-local array and string expressions, so scoring has no shuffle. The
decision list is learned by sequential covering: from labelled documents, binned statistics are
counted by Spark into cells; on those counts each rule is grown condition by condition (by
information gain on two thirds of the labels), pruned on the last third, and kept while it
stays precise there; covered cells are removed before the next rule. The list comes out as an
ordered conditional expression of threshold conjunctions.

Learning looks at MAX_LABELLED labelled rows at most, in the order of a hash.

Defined results: a null or empty text has no words and fails the base rules; without labels the
list is empty, so the base rules alone decide; repeated rows get equal results; labels with null
quality are left out; a document labelled several times counts once for each label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm import common

MAX_LABELLED = 10_000
WINDOW = 5
#: Thresholds that conditions may use, by statistic.
EDGES = {
    "symbol_ratio": (0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4),
    "repeat_ratio": (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75),
    "dup_line_ratio": (0.02, 0.05, 0.1, 0.2, 0.35, 0.5),
    "upper_ratio": (0.02, 0.04, 0.06, 0.1, 0.2, 0.4, 0.7),
    "bang_ratio": (0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2),
    "mean_word": (2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 9.0, 12.0),
    "n_words": (20.0, 50.0, 100.0, 200.0, 500.0, 1000.0, 3000.0),
}


def _count(text: Column, keep: str) -> Column:
    """How many characters of the class keep the text has."""
    return F.length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("long")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct `quality` of the statistics of the whole text; other columns are kept."""
    t, q = F.col("__t"), F.col("__q")
    df = docs.withColumn("__t", common.whole_text(text)).withColumn("__w", F.array_remove(F.split("__t", common.SPACE), ""))
    n = F.size("__w")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__w", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({"__h": windows, "__l": lines})
    repeated = F.size(F.array_distinct("__h")) < F.size("__h")
    df = df.withColumn("__s", F.when(repeated, F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    hash_at = lambda j: F.get(F.col("__s"), j)["h"]
    twice = F.filter(F.transform("__s", lambda x, j: F.when((x["h"] == hash_at(j - 1)) | (x["h"] == hash_at(j + 1)), x["i"])), lambda i: i.isNotNull())
    df = df.withColumn("__p", F.when(repeated, F.sort_array(twice)))
    steps = F.zip_with(F.expr("slice(__p, 2, size(__p))"), F.expr("slice(__p, 1, size(__p) - 1)"), lambda b, a: F.least(F.lit(WINDOW), b - a))
    covered = F.when(F.col("__p").isNotNull(), F.aggregate(steps, F.lit(WINDOW), lambda s, x: s + x)).otherwise(0)
    df = df.withColumn("__q", F.struct(
        n.cast("long").alias("n_words"), F.length(F.array_join("__w", "")).cast("long").alias("word_chars"), _count(t, "#*$%&|<>").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"), _count(t, r"\p{Lu}").alias("n_upper"), _count(t, "!").alias("n_bangs"),
    ))
    over = lambda a, b: F.when(q[b] > 0, q[a] / q[b]).otherwise(F.lit(0.0))
    ratios = {"symbol_ratio": over("n_symbols", "word_chars"), "repeat_ratio": over("n_repeat_words", "n_words"), "dup_line_ratio": over("n_dup_lines", "n_lines"),
              "upper_ratio": over("n_upper", "word_chars"), "bang_ratio": over("n_bangs", "word_chars"), "mean_word": over("word_chars", "n_words")}
    # Always true, but not deterministic: keeps the optimizer from pushing filters on the statistics below
    # the steps above, where each would be computed once more, and inside the lambdas once for each element.
    here = F.spark_partition_id() >= 0
    failed = F.when(here, (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"]))
    df = df.withColumn("quality", F.struct("__q.*", *(c.alias(k) for k, c in ratios.items()), failed.alias("base_failed")))
    return df.drop("__t", "__w", "__h", "__l", "__s", "__p", "__q")


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    edge: int

    def holds(self, bins: dict[str, int]) -> bool:
        return (bins[self.statistic] > self.edge) == self.above

    def column(self, at) -> Column:
        limit = EDGES[self.statistic][self.edge]
        return at(self.statistic) > limit if self.above else at(self.statistic) <= limit

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {EDGES[self.statistic][self.edge]}"


#: bins by statistic, whether the cell is for pruning, good and bad documents.
Cell = tuple[dict[str, int], bool, int, int]


def cells(labelled: DataFrame) -> list[Cell]:
    """Counts of good and bad documents by binned statistics; as many cells as labelled rows at most."""
    at = F.col("quality")
    bins = [F.aggregate(F.array(*(F.when(at[k] > e, 1).otherwise(0) for e in edges)), F.lit(0), lambda s, x: s + x).alias(k) for k, edges in EDGES.items()]
    prune = F.expr("pmod(xxhash64(doc_id, 23), 3) = 0").alias("prune")
    df = labelled.where(~at["base_failed"]).select(*bins, prune, "label").groupBy(*EDGES, "prune")
    rows = df.agg(F.count_if(F.col("label") > 0).alias("good"), F.count_if(F.col("label") <= 0).alias("bad")).collect()
    return sorted((({k: r[k] for k in EDGES}, r.prune, r.good, r.bad) for r in rows), key=lambda c: (*c[0].values(), c[1]))


def learn(found: list[Cell], precision: float = 0.9, support: int = 5, max_rules: int = 12, max_conditions: int = 4) -> list[list[Condition]]:
    """Rules for bad documents, in order."""
    every = [Condition(k, above, i) for k, edges in EDGES.items() for i in range(len(edges)) for above in (True, False)]
    if not found:
        return []
    holds = np.array([[x.holds(c[0]) for x in every] for c in found])
    pruning, good, bad = np.array([c[1] for c in found], bool), np.array([c[2] for c in found], float), np.array([c[3] for c in found], float)
    rules, left = [], np.ones(len(found), bool)
    while len(rules) < max_rules:
        inside, rule = left & ~pruning, []
        while good[inside].sum() and len(rule) < max_conditions:
            b, g = bad[inside] @ holds[inside], good[inside] @ holds[inside]
            base = bad[inside].sum() / (bad[inside].sum() + good[inside].sum())
            gain = np.where(b >= support, b * (np.log2(np.maximum(b, 1e-9) / np.maximum(b + g, 1e-9)) - np.log2(max(base, 1e-9))), 0)
            if gain.max() <= 1e-9:
                break
            rule.append(int(gain.argmax()))
            inside &= holds[:, rule[-1]]
        scored = []
        for k in range(1, len(rule) + 1):
            on = left & pruning & holds[:, rule[:k]].all(axis=1)
            b, g = bad[on].sum(), good[on].sum()
            if b >= max(1, support // 2):
                scored.append((b / (b + g), b, -k))
        if not scored or max(scored)[0] < precision:
            break
        rule = rule[: -max(scored)[2]]
        rules.append([every[i] for i in rule])
        left &= ~holds[:, rule].all(axis=1)
    return rules


def first_rule(rules: list[list[Condition]]) -> Column:
    """Number from 1 of the first rule that fires, else null: an ordered conditional expression."""
    at = lambda k: F.col("quality")[k]
    out = F.lit(None).cast("int")
    for number in range(len(rules), 0, -1):
        fires = F.lit(True)
        for condition in rules[number - 1]:
            fires = fires & condition.column(at)
        out = F.when(fires, number).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[list[Condition]]:
    """docs: doc_id, text; labels: doc_id, quality (good above 0)."""
    sample = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").alias("label"), F.xxhash64("doc_id", F.lit(11)).alias("__o"))
    sample = sample.orderBy("__o", "doc_id", "label").limit(max_labelled).drop("__o")
    return learn(cells(with_statistics(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))))


def judged(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """docs with `quality`, extended by rule (that rejects) and kept."""
    df = with_statistics(docs).withColumn("__rule", first_rule(rules))
    kept = ~F.col("quality.base_failed") & F.col("__rule").isNull()
    return df.withColumn("quality", F.struct("quality.*", F.col("__rule").alias("rule"), kept.alias("kept"))).drop("__rule")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, common.table(spark, sf_dir, "labels"))
    return judged(docs, rules).selectExpr("doc_id", *(f"quality.{k}" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")))
