"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents are counted into cells of (source, language, topic). Token weights of the cells are
raked in turn to the target shares of each of the three margins until all agree; a cell's factor
is its raked weight over its tokens. Documents are then drawn with probability min(1, rate *
factor), where the rate makes the expected tokens equal the budget. A draw depends only on the
document's id and a seed, so runs and retries agree.

Cells are counted first. Up to MAX_CELLS of them, so of proven size, they are raked on the driver
and broadcast; beyond that the same sweeps, with the same limit and tolerance, run over the cell
table by way of its margins, and documents join it. Hot classes matter to neither: documents are
pre-aggregated before any shuffle, and the rows of frequent classes and cells stay where they are.
Margins that the sweeps cannot bring to their targets are reported by a warning.

Defined results: null source, lang or topic form a class of their own; a target for a class that
has no documents is spread over the others; a class without a target keeps a zero weight, so its
documents have probability 0; documents with empty or null text count as one token; documents
that repeat an id are drawn alike; an empty table gives no rows.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm import common

MAX_CELLS = 50_000
#: Raking stops when no margin is off by more than this share of its target, or after so many sweeps.
TOLERANCE, SWEEPS = 1e-9, 200
DIMENSIONS = ("source", "lang", "topic")
NONE = "(none)"
#: Targets of the query: shares to this power, so that large classes lose and small ones gain.
TEMPERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
BUDGET = 0.5


def tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def topic(text: Column) -> Column:
    """A class by form, from the whole text."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(t, F.lit(" | ")), "table").when(t.rlike("(?i)licen[cs]e|copyright"), "legal").when(F.length(F.regexp_replace(t, "[^0-9]+", "")) * 50 > F.length(t), "numeric")
        .when(F.length(t) < 600, "brief").when(F.length(t) < 3000, "article").otherwise("long")
    )


def classified(docs: DataFrame, topics: Column | None = None) -> DataFrame:
    """docs with a struct `mix` of source, lang, topic and tokens."""
    return docs.withColumn("mix", F.struct(F.coalesce("source", F.lit(NONE)).alias("source"), F.coalesce("lang", F.lit(NONE)).alias("lang"), (topic(F.col("text")) if topics is None else F.coalesce(topics, F.lit(NONE))).alias("topic"), tokens(F.col("text")).alias("tokens")))


def cells(df: DataFrame) -> DataFrame:
    return df.groupBy(*(F.col(f"mix.{d}").alias(d) for d in DIMENSIONS)).agg(F.sum("mix.tokens").alias("tokens"), F.count("*").alias("n"))


def tempered(found: DataFrame, power: dict[str, float]) -> dict[str, DataFrame]:
    """Target shares by dimension: (class, share), proportional to the class's tokens to a power."""
    return {d: found.groupBy(F.col(d).alias("class")).agg(F.pow(F.sum("tokens"), F.lit(p)).alias("share")) for d, p in power.items()}


def rake(rows: list[dict], targets: dict[str, dict[str, float]], sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> list[float]:
    """Raked weights of the cells; each has tokens and its class by dimension."""
    total = float(sum(r["tokens"] for r in rows))
    w = [float(r["tokens"]) for r in rows]
    for _ in range(sweeps):
        worst = 0.0
        for d, share in targets.items():
            sums: dict[str, float] = {}
            for r, x in zip(rows, w, strict=True):
                sums[r[d]] = sums.get(r[d], 0.0) + x
            there = sum(share.get(c, 0.0) for c, s in sums.items() if s > 0) or 1.0
            factor = {c: total * share.get(c, 0.0) / there / s if s > 0 else 0.0 for c, s in sums.items()}
            worst = max([worst, *(abs(f - 1) for c, f in factor.items() if sums[c] > 0)])
            w = [x * factor[r[d]] for r, x in zip(rows, w, strict=True)]
        if worst < tolerance:
            break
    else:
        unreached(worst, sweeps)
    return w


def unreached(worst: float, sweeps: int) -> None:
    warnings.warn(f"after {sweeps} sweeps a margin was still scaled by {1 + worst:.6g}: the targets contradict each other or the empty cells", stacklevel=3)


def rate_for(rows: list[tuple[float, float]], budget: float) -> float:
    """The rate at which sum(tokens * min(1, rate * factor)) is the budget; rows: (tokens, factor)."""
    rate, capped = 0.0, 0.0
    left = sorted((x for x in rows if x[1] > 0), key=lambda x: -x[1])
    rest = sum(t * f for t, f in left)
    for t, f in left:
        rate = (budget - capped) / rest if rest > 0 else rate
        if rate * f <= 1:
            return max(0.0, rate)
        capped, rest = capped + t, rest - t * f
    return float("inf") if left else 0.0


def _local(found: DataFrame, targets: dict[str, DataFrame], budget: float) -> DataFrame:
    rows = sorted((r.asDict() for r in found.collect()), key=lambda r: [r[d] for d in DIMENSIONS])
    w = rake(rows, {d: {r["class"]: r["share"] for r in t.join(found.select(F.col(d).alias("class")).distinct(), "class").collect()} for d, t in targets.items()})
    total = sum(r["tokens"] for r in rows)
    factors = [x / r["tokens"] for r, x in zip(rows, w, strict=True)]
    rate = rate_for([(r["tokens"], f) for r, f in zip(rows, factors, strict=True)], budget * total)
    out = [(*(r[d] for d in DIMENSIONS), f, min(1.0, rate * f) if f > 0 else 0.0) for r, f in zip(rows, factors, strict=True)]
    return found.sparkSession.createDataFrame(out, "source string, lang string, topic string, factor double, probability double")


def _spread(found: DataFrame, targets: dict[str, DataFrame], budget: float, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """The same over the cell table, written out after each sweep."""
    spark, n = found.sparkSession, found.count()
    total = found.agg(F.sum("tokens")).first()[0]
    df = common.written(found.withColumns({"w": F.col("tokens").cast("double"), "off": F.lit(0.0)}), "cells")
    if not n:
        return df.select(*DIMENSIONS, F.lit(0.0).alias("factor"), F.lit(0.0).alias("probability"))
    for _ in range(sweeps):
        before, df, steps = df, df.withColumn("off", F.lit(0.0)), []
        for d, target in targets.items():
            margin = df.groupBy(d).agg(F.sum("w").alias("s"), F.count("*").alias("n")).join(target.select(F.col("class").alias(d), "share"), d, "left")
            margin = common.written(margin.select(d, "s", "n", F.coalesce("share", F.lit(0.0)).alias("share")), "margin")
            there = margin.where("s > 0").agg(F.sum("share")).first()[0] or 1.0
            factor = F.when(F.col("s") > 0, F.lit(float(total)) * F.col("share") / there / F.col("s")).otherwise(0.0)
            margin = margin.select(d, "n", factor.alias("f"), F.when(F.col("s") > 0, F.abs(factor - 1)).otherwise(0.0).alias("gap"))
            df = common.by_heavy(df, margin, d, "n", n).select(*DIMENSIONS, "tokens", (F.col("w") * F.col("f")).alias("w"), F.greatest("off", "gap").alias("off"))
            steps.append(margin)
        df = common.written(df, "cells")
        worst = df.agg(F.max("off")).first()[0]
        common.remove(spark, before, *steps)
        if worst < tolerance:
            break
    else:
        unreached(worst, sweeps)
    df = df.withColumn("factor", F.col("w") / F.col("tokens"))
    rate = 0.0
    while True:  # each round either moves a cell over the cap or is the last
        full = F.col("factor") * rate > 1
        capped, rest = df.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        new = (budget * total - capped) / rest if rest else rate
        if new <= rate * (1 + 1e-12):
            break
        rate = new
    return df.select(*DIMENSIONS, "factor", F.when(F.col("factor") > 0, F.least(F.lit(1.0), F.col("factor") * rate)).otherwise(0.0).alias("probability"))


def mixed(
    docs: DataFrame, power: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, seed: int = 41, max_cells: int = MAX_CELLS, topics: Column | None = None
) -> DataFrame:
    """docs with `mix` extended by factor, probability and kept (drawn or not).

    targets: tables (class, share) by dimension; a dimension without one is not held to anything.
    topics: the topic of a document where a learned one is at hand; else topic().
    """
    df = classified(docs, topics)
    counted = common.written(cells(df), "cells")
    found, rows = counted.drop("n"), counted.agg(F.sum("n")).first()[0] or 0
    targets = targets or tempered(found, power or TEMPERS)
    n = found.count()
    local = n <= max_cells
    weights = (_local if local else _spread)(found, targets, budget)
    weights = weights.select(F.struct(*DIMENSIONS).alias("__cell"), F.col("factor").alias("__factor"), F.col("probability").alias("__probability"))
    alone = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))  # so that documents without an id are not drawn all or none
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", alone, F.lit(seed)), 11) / F.lit(float(1 << 53))
    df = df.withColumn("__cell", F.struct(*(F.col(f"mix.{d}").alias(d) for d in DIMENSIONS)))
    if local:
        df = df.join(F.broadcast(weights), "__cell")
    else:
        weights = weights.join(counted.select(F.struct(*DIMENSIONS).alias("__cell"), F.col("n").alias("__n")), "__cell")
        df = common.by_heavy(df, common.written(weights, "weights"), "__cell", "__n", rows)
    mix = F.struct("mix.*", F.col("__factor").alias("factor"), F.col("__probability").alias("probability"), (draw < F.col("__probability")).alias("kept"))
    return df.withColumn("mix", mix).select(*docs_columns(docs), "mix")


def docs_columns(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c != "mix"]


def margins(mix: DataFrame) -> DataFrame:
    """What mixed() did, by dimension and class: tokens there, raked weight, and tokens expected of the draw."""
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(f"mix.{d}").alias("class")) for d in DIMENSIONS))).alias("m")
    df = mix.select("mix.tokens", "mix.factor", "mix.probability", each).select("m.*", "tokens", (F.col("tokens") * F.col("factor")).alias("w"), (F.col("tokens") * F.col("probability")).alias("e"))
    return df.groupBy("dimension", "class").agg(F.sum("tokens").alias("tokens"), F.sum("w").alias("weight"), F.sum("e").alias("expected"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mix = mixed(docs)
    return mix.select("doc_id", "mix.source", "mix.lang", "mix.topic", "mix.tokens", F.round("mix.factor", 6).alias("factor"), F.round("mix.probability", 6).alias("probability"), "mix.kept")
