"""Page cache, fetch outcomes and exports. Nothing reads a clock: `as_of` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import urls as U

TTL_HOURS = 6


def outcome(df: DataFrame) -> DataFrame:
    """Adds code: the first that applies of cached, permission, timeout, network, http, type, empty, ok.

    df: cached, has_permission, error_name, status, content_type, title, word_count.
    """
    typed = F.coalesce("content_type", F.lit(""))
    code = (
        F.when(F.col("cached"), "CACHED").when(~F.col("has_permission"), "PERMISSION").when(F.col("error_name") == "AbortError", "TIMEOUT").when(F.col("error_name").isNotNull(), "NETWORK")
        .when(~F.col("status").between(200, 299), "HTTP").when((typed != "") & ~F.lower(typed).rlike("text/html|application/xhtml"), "TYPE").when((F.col("title") == "") & (F.col("word_count") < 20), "EMPTY").otherwise("OK")
    )
    return df.withColumn("code", code)


def to_fetch(df: DataFrame, parallel: int = 3) -> DataFrame:
    """Normalised urls, the first of equal ones, in order of pos; at most `parallel` tasks work on them."""
    df = df.withColumn("url", U.normalized(F.col("raw_url"))).where("url is not null")
    df = df.withColumn("__r", F.row_number().over(Window.partitionBy("url").orderBy("pos"))).where("__r = 1").drop("__r")
    return df.repartition(parallel).sortWithinPartitions("pos")


def fresh(cache: DataFrame, as_of: Column, hours: int = TTL_HOURS) -> DataFrame:
    return cache.where(F.col("saved_at") >= as_of - F.make_interval(hours=F.lit(hours)))


def pruned(cache: DataFrame) -> DataFrame:
    """Without the older half, rounded up."""
    w = Window.orderBy("saved_at", "url")  # a cache of one client; ids and times only
    keys = cache.select("url", "saved_at").withColumn("__r", F.row_number().over(w))
    half = F.ceil(F.count("*").over(Window.partitionBy()) / 2)
    return cache.join(keys.withColumn("__half", half).where("__r <= __half").select("url"), "url", "left_anti")


def cleared(cache: DataFrame, prefix: str) -> DataFrame:
    return cache.where(~F.startswith("url", F.lit(prefix)))


def exported(kw: DataFrame, most: int = 150) -> DataFrame:
    """One JSON line for each of the first keywords of a group, numbers to three decimals."""
    nums = [F.round(F.col(c), 3).alias(c) for c in ("coverage", "comp_strength", "target_strength", "demand", "gap")]
    return kw.where(F.col("rank") <= most).select("group_id", "rank", F.to_json(F.struct("term", "words", "score", "status", *nums)).alias("json"))


def split_inputs(raw: Column) -> Column:
    """Addresses typed one to a line or with commas."""
    return F.filter(F.transform(F.split(raw, "[\n,]"), U.trimmed), lambda x: x != "")
