"""The on-page audit: 29 rules as Column pairs, exploded to rows, and the weighted score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import urls as U
from pagelens.operators import audit_text

# Weights by severity, category titles.
WEIGHTS = {"critical": 5, "warning": 2, "notice": 1}
CATEGORIES = {"meta": "Meta & indexing", "content": "Content", "structure": "Structure", "links": "Links", "media": "Media", "social": "Social & schema", "technical": "Technical"}


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    severity: str | Column
    fails: Column
    applies: Column | None = None


def _worse(test: Column) -> Column:
    return F.when(test, "warning").otherwise("notice")


def heading_skip() -> Column:
    """Whether some heading is more than one level below the one before it."""
    h = F.col("headings")
    return F.exists(F.transform(h, lambda x, i: F.coalesce((i > 0) & (x["level"] - F.get(h, i - 1)["level"] > 1), F.lit(False))), lambda b: b)


def shared_word(a: Column, b: Column) -> Column:
    words = lambda s: F.regexp_extract_all(F.lower(s), F.lit("([a-z0-9]{4,})"), F.lit(1))
    return F.arrays_overlap(words(a), words(b))


def rules() -> list[Rule]:
    c = F.col
    t, d, robots, n, img, link = F.trim("title"), F.trim("meta_description"), F.lower("meta_robots"), c("word_count"), c("images"), c("links")
    lt, ld, hs = F.length(t), F.length(d), F.size("headings")
    return [
        Rule("title-missing", "meta", "critical", t == ""),
        Rule("title-length", "meta", _worse((lt < 20) | (lt > 70)), (lt < 30) | (lt > 60), t != ""),
        Rule("description-missing", "meta", "warning", d == ""),
        Rule("description-length", "meta", "notice", (ld < 70) | (ld > 165), d != ""),
        Rule("noindex", "meta", "critical", robots.contains("noindex")),
        Rule("meta-nofollow", "meta", "warning", robots.contains("nofollow")),
        Rule("canonical-missing", "meta", "warning", c("canonical") == ""),
        Rule("canonical-mismatch", "meta", "notice", F.coalesce((U.hostname(c("url")) != "") & (U.without_slash(U.resolved(c("canonical"), c("url"))) != U.without_slash(c("url"))), F.lit(False)), (c("canonical") != "") & (c("url") != "")),
        Rule("h1-missing", "structure", "critical", c("h1_count") == 0),
        Rule("h1-multiple", "structure", "warning", c("h1_count") > 1),
        Rule("heading-skip", "structure", "notice", heading_skip()),
        Rule("few-headings", "structure", "notice", (hs < 3) & (n > 400)),
        Rule("thin-content", "content", _worse(n < 150), n < 300),
        Rule("title-h1-mismatch", "content", "notice", (t != "") & (c("fields.h1") != "") & ~shared_word(c("fields.h1"), t)),
        Rule("img-alt", "media", _worse(img["missing_alt"] > 5), img["missing_alt"] > 0),
        Rule("img-dimensions", "media", "notice", (img["total"] > 3) & (img["no_dimensions"] > img["total"] * 0.5)),
        Rule("img-lazy", "media", "notice", (img["total"] > 8) & (img["no_lazy"] > img["total"] * 0.7)),
        Rule("few-internal-links", "links", "warning", link["internal"] < 3),
        Rule("generic-anchors", "links", "notice", link["generic_anchor"] > 3),
        Rule("empty-anchors", "links", "notice", link["empty_anchor"] > 0),
        Rule("og-missing", "social", "notice", (c("og.title") == "") | (c("og.description") == "")),
        Rule("og-image", "social", "notice", c("og.image") == ""),
        Rule("schema-missing", "social", "warning", F.size("schema_types") == 0),
        Rule("schema-invalid", "social", "warning", c("invalid_json_ld") > 0),
        Rule("no-https", "technical", "critical", c("protocol") == "http:"),
        Rule("viewport", "technical", "critical", c("viewport") == ""),
        Rule("lang", "technical", "notice", c("lang") == ""),
        Rule("url-slug", "technical", "notice", U.slug_unclean(c("pathname"))),
        Rule("dom-size", "technical", "notice", c("dom_nodes") > 2500),
    ]


def outcomes(records: DataFrame, texts: bool = False) -> DataFrame:
    """page_id, rule_no, rule_id, category, severity, weight, failed of each rule that applies; with title, detail, fix, passed and value where texts are asked for."""
    each, of = [], audit_text.values() if texts else {}
    for number, r in enumerate(rules(), 1):
        severity = F.lit(r.severity) if isinstance(r.severity, str) else r.severity
        row = F.struct(F.lit(number).alias("rule_no"), F.lit(r.id).alias("rule_id"), F.lit(r.category).alias("category"), severity.alias("severity"), F.coalesce(r.fails, F.lit(False)).alias("failed"), *(audit_text.texts(r.id, of) if texts else []))
        each.append(row if r.applies is None else F.when(r.applies, row))
    df = records.select("page_id", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("r")).select("page_id", "r.*")
    weight = F.when(F.col("severity") == "critical", WEIGHTS["critical"]).when(F.col("severity") == "warning", WEIGHTS["warning"]).otherwise(WEIGHTS["notice"])
    return df.withColumn("weight", weight)


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 65, "C").when(score >= 50, "D").otherwise("F")


def scores(found: DataFrame) -> DataFrame:
    """Score, grade and counts of each page, in one partial aggregation."""
    lost, total = F.sum(F.when(F.col("failed"), F.col("weight")).otherwise(0)), F.sum("weight")
    worth = F.greatest(F.lit(0), F.floor(100 - lost / F.greatest(total, F.lit(1)) * 100 + 0.5)).cast("int")
    failed = lambda s: F.count_if(F.col("failed") & (F.col("severity") == s)).alias(s)
    df = found.groupBy("page_id").agg(total.alias("total_weight"), lost.alias("lost_weight"), worth.alias("score"), failed("critical"), failed("warning"), failed("notice"), F.count_if(~F.col("failed")).alias("passed"))
    return df.withColumn("grade", grade(F.col("score")))


def findings(found: DataFrame) -> DataFrame:
    """Failed rules of each page, by severity, then rule order; with their texts if found has them."""
    order = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    w = Window.partitionBy("page_id").orderBy(order, "rule_no")
    told = [c for c in ("title", "detail", "fix", "value") if c in found.columns]
    return found.where("failed").select("page_id", "rule_id", "category", "severity", F.row_number().over(w).alias("position"), *told)


def passes(found: DataFrame) -> DataFrame:
    """Rules that each page passed, in rule order; found: outcomes() with texts."""
    w = Window.partitionBy("page_id").orderBy("rule_no")
    return found.where("not failed").select("page_id", "rule_id", "category", F.col("passed").alias("label"), F.row_number().over(w).alias("position"))
