"""A batch data source of articles from a paged JSON service; the fetcher is injected, so no network is needed to test it."""
from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "title string, type string, url string, extract string"


USER_AGENT = "textloom/1.0"


def pause(status: int, headers: dict, attempt: int) -> float | None:
    """Seconds until another attempt may succeed: a refused one names them or doubles, a failing server doubles; None: no other attempt."""
    if status != 429 and status < 500:
        return None
    named = headers.get("Retry-After") if status == 429 else None
    return float(2**attempt if named is None else named)


def get_with_retries(fetch: Callable[[int], tuple[int, dict, dict]], page: int, retries: int = 5, sleep: Callable[[float], None] = time.sleep) -> dict | None:
    """The body of fetch(page), which gives (status, headers, body); None for errors, and after `retries` attempts."""
    for attempt in range(retries):
        status, headers, body = fetch(page)
        if (wait := pause(status, headers, attempt)) is None:
            return body if status < 400 else None
        sleep(wait)
    return None


class HttpFetch:
    """fetch(page) of a JSON service by the standard library, with a User-Agent; url may hold {page}."""

    def __init__(self, url: str, timeout: float = 30.0, user_agent: str = USER_AGENT):
        self.url, self.timeout, self.user_agent = url, timeout, user_agent

    def __call__(self, page: int) -> tuple[int, dict, dict]:
        request = urllib.request.Request(self.url.format(page=page), headers={"User-Agent": self.user_agent, "Accept": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return answer.status, dict(answer.headers), json.loads(answer.read())
        except urllib.error.HTTPError as e:
            return e.code, dict(e.headers), {}


def article_source(name: str, fetch: Callable[[int], tuple[int, dict, dict]]) -> type[DataSource]:
    """A DataSource class for spark.dataSource.register; option pages says how many, partitions how many readers."""

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.pages, self.parts = int(options.get("pages", 10)), int(options.get("partitions", 2))

        def partitions(self):
            return [InputPartition(k) for k in range(self.parts)]

        def read(self, partition) -> Iterator[tuple]:
            for page in range(partition.value, self.pages, self.parts):
                if body := get_with_retries(fetch, page):
                    yield body.get("title"), body.get("type"), body.get("url"), body.get("extract")

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return Reader(self.options)

    return Source
