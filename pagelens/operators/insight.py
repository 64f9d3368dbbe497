"""Benchmarks against the category, and recommendations, for every group at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import text as T

# Metrics, their format, and whether more is better (null: neither).
METRICS = [("Word count", "number", True), ("Title length", "chars", None), ("Headings", "number", True), ("Internal links", "number", True), ("Images", "number", True), ("Uses structured data", "percent", True), ("Has meta description", "percent", True)]


def benchmarks(docs: DataFrame) -> DataFrame:
    """group_id, ord, metric, you, category, format, higher_is_better. Groups without competitors have none."""
    values = [F.col("word_count"), F.length("title"), F.size("headings"), F.col("links.internal"), F.col("images.total"), F.when(F.size("schema_types") > 0, 100).otherwise(0), F.when(F.col("meta_description") != "", 100).otherwise(0)]
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(m).alias("metric"), F.lit(f).alias("format"), F.lit(h).cast("boolean").alias("higher_is_better"), v.cast("double").alias("v")) for i, ((m, f, h), v) in enumerate(zip(METRICS, values, strict=True))))
    df = docs.select("group_id", "doc_idx", F.explode(rows).alias("m")).select("group_id", "doc_idx", "m.*")
    other = F.when(F.col("doc_idx") > 0, F.col("v"))
    middle = F.median(other)
    even = F.count(other) % 2 == 0
    category = F.when(F.col("format") == "percent", F.floor(F.round(F.avg(other), 9) + 0.5)).otherwise(F.when(even, F.floor(middle + 0.5)).otherwise(middle))
    df = df.groupBy("group_id", "ord", "metric", "format", "higher_is_better").agg(F.max(F.when(F.col("doc_idx") == 0, F.col("v"))).alias("you"), F.count(other).alias("__n"), category.cast("double").alias("category"))
    return df.where("__n > 0").drop("__n")


def title_suggestion(target: Column, term: Column) -> Column:
    brand = F.split_part(F.regexp_replace(target["hostname"], r"^www\.", ""), F.lit("."), F.lit(1))
    brand = F.concat(F.upper(F.left(brand, F.lit(1))), F.substr(brand, F.lit(2)))
    existing = F.trim(F.regexp_extract(target["title"], r"(?s)^([^|\-–—]*)", 1))
    generic = (F.length(existing) < 12) | F.lower(existing).isin("home", "welcome", "index", "untitled", "page")
    nice = T.title_case(term)
    base = F.when(generic, nice).otherwise(F.concat(nice, F.lit(" — "), existing))
    full = F.when(brand != "", F.concat(base, F.lit(" | "), brand)).otherwise(base)
    return F.when(F.length(full) > 60, F.concat(F.left(full, F.lit(57)), F.lit("…"))).otherwise(full)


def description_suggestion(target: Column, term: Column) -> Column:
    existing = F.trim(target["meta_description"])
    merged = F.concat(existing, F.lit(" Learn more about "), term, F.lit("."))
    return (
        F.when(existing == "", F.concat(F.lit("Write ~150 characters covering \""), term, F.lit("\" and the outcome a reader gets from this page.")))
        .when(F.length(merged) <= 160, merged).otherwise(F.concat(F.lit("Rework the existing description to lead with \""), term, F.lit("\" (keep it under 160 characters).")))
    )


def primary_terms(kw: DataFrame) -> DataFrame:
    """group_id, primary: the term a page is about, with the fallbacks in order."""
    worth = F.round(F.col("target_strength") * F.when(F.col("words") >= 2, 1.15).otherwise(1.0), 9)
    owned = ~F.col("boilerplate") & (F.col("target_strength") > 0)
    tier = F.when(owned & ((F.col("comp_count") == 0) | (F.col("coverage") > 0)), 0).when(owned, 1).when(~F.col("boilerplate"), 2).otherwise(3)
    order = F.struct(tier.alias("t"), F.when(tier <= 1, -worth).otherwise(F.lit(0.0)).alias("w"), F.col("rank").alias("r"))
    return kw.groupBy("group_id").agg(F.min_by("term", order).alias("primary"), F.max("comp_count").alias("comp_count"))


def recommendations(kw: DataFrame, target: DataFrame) -> DataFrame:
    """group_id, ord, priority, title, detail, example, terms, of every target, with keywords or without. target: as keywords.targets() gives it."""

    def first(test: Column, n: int, name: str) -> DataFrame:
        w = Window.partitionBy("group_id").orderBy("rank")
        df = kw.where(~F.col("boilerplate") & test).withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
        return df.groupBy("group_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias(name))

    df = target.join(primary_terms(kw), "group_id", "left").withColumn("comp_count", F.coalesce("comp_count", "rivals"))
    df = df.join(first(F.col("status").isin("missing", "absent") & (F.col("words") >= 2), 6, "gaps"), "group_id", "left")
    df = df.join(first(F.col("status") == "underused", 5, "weak"), "group_id", "left").join(first(F.col("status").isin("defend", "primary"), 5, "strong"), "group_id", "left")
    p, t, rivals = F.col("primary"), F.col("target"), F.col("comp_count") > 0
    lacks = lambda k: ~F.contains(F.lower(t[k]), p)
    quoted = lambda a, b: F.concat(F.lit(a + '"'), p, F.lit('"' + b))
    none, nothing = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    row = lambda i, pr, title, ex=none, terms=nothing, detail=none: F.struct(F.lit(i).alias("ord"), F.lit(pr).alias("priority"), title.alias("title"), detail.alias("detail"), ex.alias("example"), terms.alias("terms"))
    every = lambda k: F.array_join(F.transform(k, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", ")
    said = lambda a, k, b: F.concat(F.lit(a), every(F.col(k)), F.lit(b))
    n = F.size("gaps")
    # Titles and details.
    rows = F.array(
        F.when(p.isNotNull() & lacks("title"), row(1, "high", quoted("Put ", " in the title tag"), title_suggestion(t, p), nothing, F.lit("It is the strongest topical term for this page but does not appear in the title — the highest-weight element you control."))),
        F.when(p.isNotNull() & lacks("h1"), row(2, "high", quoted("Work ", " into the H1"), none, nothing, F.lit("The H1 and title should agree on the page topic. Right now they do not both contain the primary term."))),
        F.when(p.isNotNull() & lacks("meta_description"), row(3, "medium", quoted("Mention ", " in the meta description"), description_suggestion(t, p), nothing, F.lit("Matched terms are bolded in the search snippet, which lifts click-through even when rank is unchanged."))),
        F.when(rivals & F.col("gaps").isNotNull(), row(4, "high", F.concat(F.lit("Cover "), n, F.when(n == 1, " topic").otherwise(" topics"), F.lit(" the category ranks for and you do not")), none, F.col("gaps"), said("Competitors consistently cover: ", "gaps", ". Each is a section this page is missing."))),
        F.when(rivals & F.col("weak").isNotNull(), row(5, "medium", F.lit("Strengthen terms you only mention in passing"), none, F.col("weak"), said("", "weak", " appear on this page far more weakly than across the category. Promote them into headings rather than burying them in body copy."))),
        F.when(F.col("strong").isNotNull(), row(6, "low", F.lit("Defend what you already lead on"), none, F.col("strong"), said("You are strongest on ", "strong", ". Keep this copy intact and point internal links at this page using those phrases as anchor text."))),
        F.when(~rivals, row(7, "medium", F.lit("Add competitor URLs for the comparison"), none, nothing, F.lit("Keyword scores right now reflect only this page. Add 3–5 sites in the same category to unlock gap analysis, clustering and benchmarks."))),
    )
    return df.select("group_id", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("group_id", "r.*")
