"""Streams of pages: extraction, audit and profiles are row-local, so they run as they stand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.operators import audit, html

PAGES = "page_id long, url string, html string, fetched_at timestamp"


def audited(stream: DataFrame) -> DataFrame:
    """Rule outcomes of each page of a stream of (page_id, url, html): no state."""
    return audit.outcomes(html.extract(stream))


def newest(stream: DataFrame, hours: int = 6) -> DataFrame:
    """Each url once within the cache's time to live: the streaming form of the page cache."""
    return stream.withWatermark("fetched_at", f"{hours} hours").dropDuplicatesWithinWatermark(["url"])


def arrivals(stream: DataFrame) -> DataFrame:
    """Pages by host and hour."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#:]+)", 1))
    return stream.withWatermark("fetched_at", "2 hours").groupBy(F.window("fetched_at", "1 hour"), host.alias("host")).count()
