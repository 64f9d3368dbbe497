"""A page source over HTTP, and its checks as Columns.

The source is a Python data source: spark.read.format("pagelens_http").option("urls", ...). It
opens connections only when read, at most `parallel` at a time (one partition each).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_BYTES, TIMEOUT_S, CAP = 2_000_000, 12, 3 << 20
SCHEMA = "page_id long, url string, status int, content_type string, html string, error string"


def verdict(status: Column, content_type: Column, declared: Column, size: Column) -> Column:
    kind = F.coalesce(content_type, F.lit(""))
    html = kind.contains("text/html") | kind.contains("application/xhtml+xml")
    return F.when(~status.between(200, 299), "HTTP").when(~html, "TYPE").when((declared > MAX_BYTES) | (size > MAX_BYTES), "SIZE").otherwise("OK")


def capped(html: Column) -> Column:
    return F.left(html, F.lit(CAP))


class _Part(InputPartition):
    def __init__(self, rows: list[tuple[int, str]]):
        self.rows = rows


class HttpReader(DataSourceReader):
    def __init__(self, options: dict):
        urls = [u.strip() for u in options.get("urls", "").replace(",", "\n").split("\n") if u.strip()]
        self.rows, self.parallel = list(enumerate(dict.fromkeys(urls))), max(1, int(options.get("parallel", 3)))

    def partitions(self) -> list[InputPartition]:
        return [_Part(self.rows[i :: self.parallel]) for i in range(min(self.parallel, len(self.rows)))] or [_Part([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import urllib.error
        import urllib.request

        for i, url in partition.rows:
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers={"accept": "text/html,application/xhtml+xml"}), timeout=TIMEOUT_S) as r:
                    body = r.read(MAX_BYTES + 1)
                    fine = len(body) <= MAX_BYTES
                    yield i, r.url, r.status, r.headers.get("content-type"), body.decode("utf-8", "replace") if fine else None, None if fine else "SIZE"
            except urllib.error.HTTPError as e:
                yield i, url, e.code, None, None, "HTTP"
            except TimeoutError:
                yield i, url, None, None, None, "TIMEOUT"
            except OSError:
                yield i, url, None, None, None, "NETWORK"


class HttpPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pagelens_http"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HttpReader:
        return HttpReader(self.options)
