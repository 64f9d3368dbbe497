"""Presentation queries: filters, sorts, pages, tones and formats, as Columns and small transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Statuses of each filter mode.
MODES = {"gap": ("missing", "absent"), "defend": ("defend", "primary"), "underused": ("underused",), "unique": ("unique",)}
PAGE, MORE = 40, 60


def filtered(kw: DataFrame, mode: str = "all", search: str = "") -> DataFrame:
    df = kw.where(F.contains("term", F.lit(search.strip().lower()))) if search.strip() else kw
    return df if mode == "all" else df.where(F.col("status").isin(*MODES[mode]))


def ordered(kw: DataFrame, key: str = "score", descending: bool = True) -> DataFrame:
    """Adds position in each group; ties keep the table's order."""
    col = F.desc(key) if descending else F.asc(key)
    return kw.withColumn("position", F.row_number().over(Window.partitionBy("group_id").orderBy(col, "rank")))


def page(df: DataFrame, shown: int = PAGE) -> DataFrame:
    """Rows up to `shown` of each group and how many remain. df: as ordered() gives it."""
    n = F.count("*").over(Window.partitionBy("group_id"))
    return df.withColumn("remaining", F.greatest(F.lit(0), n - shown)).where(F.col("position") <= shown)


def placement_hint() -> Column:
    return F.when(F.col("status").isin("missing", "underused"), F.array_join(F.slice("placements", 1, 2), ", ")).otherwise("")


def benchmark_tone(you: Column, category: Column, better: Column) -> Column:
    ratio = you / F.nullif(category, F.lit(0))
    tone = F.when(ratio >= 0.9, "ok").when(ratio >= 0.6, "warning").otherwise("critical")
    return F.when(F.coalesce(better, F.lit(False)) & (category > 0), tone).otherwise("")


def formatted(value: Column, kind: Column) -> Column:
    """value is a whole number here."""
    n = F.floor(value + 0.5).cast("string")
    return F.when(kind == "percent", F.concat(n, F.lit("%"))).when(kind == "chars", F.concat(n, F.lit(" ch"))).otherwise(n)


def headline(score: Column) -> Column:
    return F.when(score >= 90, "Strong on-page SEO").when(score >= 75, "Solid, with room to improve").when(score >= 60, "Needs work").otherwise("Significant issues")


def tone(score: Column, good: int = 80, fair: int = 60) -> Column:
    return F.when(score >= good, "ok").when(score >= fair, "warning").otherwise("critical")


def ago(seconds: Column) -> Column:
    s = F.floor(seconds)
    of = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(s < 60, "just now").when(s < 3600, of(60, "m")).when(s < 86400, of(3600, "h")).otherwise(of(86400, "d"))


def opportunity(members: DataFrame, most: int = 30) -> DataFrame:
    """x, y in [0, 1] of the best members of each cluster."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))
    df = members.withColumn("r", F.row_number().over(Window.partitionBy("group_id", "cluster").orderBy("rank")))
    return df.where(F.col("r") <= most).select("group_id", "cluster", "term", unit("target_strength").alias("x"), unit("demand").alias("y"))
