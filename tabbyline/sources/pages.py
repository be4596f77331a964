"""A data source that fetches pages: `spark.read.format("pages").options(...)`."""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Seconds to wait for a page (fixed value).
TIMEOUT = 30


class _Host(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class PageReader(DataSourceReader):
    """One partition for each host, so that a host is asked by one task at a time, with a pause between pages."""

    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.delay = float(options.get("delay", 0))
        self.agent = options.get("useragent", "tabbyline/0.1")
        self.agents = {o.removeprefix("useragent."): v for o, v in options.items() if o.startswith("useragent.")}
        self.retries = int(options.get("retries", 0))
        self.pause = float(options.get("pause", 0))

    def partitions(self) -> list[InputPartition]:
        hosts: dict[str, list[str]] = {}
        for url in self.urls:
            hosts.setdefault(urllib.parse.urlsplit(url).netloc, []).append(url)
        return [_Host(urls) for urls in hosts.values()] or [_Host([])]

    def read(self, partition: _Host) -> Iterator[tuple]:
        for n, url in enumerate(partition.urls):
            if n and self.delay:
                time.sleep(self.delay)
            for attempt in range(self.retries + 1):
                final_url, html, error = self._fetch(url)
                if error is None or error.startswith("HTTP 4"):
                    break
                if attempt < self.retries:
                    time.sleep(self.pause)
            yield url, final_url, html, error

    def _fetch(self, url: str) -> tuple[str | None, str | None, str | None]:
        agent = self.agents.get(urllib.parse.urlsplit(url).netloc, self.agent)
        request = urllib.request.Request(url, headers={"User-Agent": agent, "Accept": "text/html"})
        try:
            with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
                charset = answer.headers.get_content_charset() or "utf-8"
                return answer.geturl(), answer.read().decode(charset, "replace"), None
        except urllib.error.HTTPError as failed:
            return None, None, f"HTTP {failed.code}"
        except (OSError, ValueError) as failed:
            return None, None, str(getattr(failed, "reason", failed))


class PageSource(DataSource):
    """Options: urls (one a line), delay (seconds between pages of a host), useragent, useragent.<host> for one host,
    retries (after failures other than a 4xx answer) and pause (seconds before each). Redirects are followed."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "url string, final_url string, html string, error string"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)
