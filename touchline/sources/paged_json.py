"""A batch data source for paged JSON services: one partition for each page.

options: url (with {page}), pages, token_env (environment variable with a key that is added as `key`), timeout (seconds, 30) and retries (3, with
growing pauses; Spark's own task retries come on top). `get` of PagedJson can be replaced, so tests and offline runs read files.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def page_url(base: str, page: int, params: dict[str, str]) -> str:
    query = urlencode(sorted(params.items()))
    url = base.replace("{page}", str(page))
    return f"{url}{'&' if '?' in url else '?'}{query}" if query else url


def page_rows(text: str) -> list[dict]:
    """The records of a page: its `data`, or the page itself."""
    body = json.loads(text)
    data = body.get("data", []) if isinstance(body, dict) else body
    return data if isinstance(data, list) else [data]


def page_count(text: str) -> int:
    """max_page of a page's pager, or 1."""
    body = json.loads(text)
    return int(((body.get("pager") or {}) if isinstance(body, dict) else {}).get("max_page") or 1)


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


class PagedJsonReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def params(self) -> dict[str, str]:
        name = self.options.get("token_env")
        return {"key": os.environ[name]} if name else {}

    def get(self, page: int) -> str:
        url, tries = page_url(self.options["url"], page, self.params()), int(self.options.get("retries") or 3)
        for k in range(tries + 1):
            try:
                with urlopen(url, timeout=float(self.options.get("timeout") or 30)) as reply:  # noqa: S310
                    return reply.read().decode()
            except OSError as error:  # URLError, timeouts and lost connections; a client error but "too many requests" stays one
                if k == tries or 400 <= getattr(error, "code", 500) < 500 and error.code != 429:
                    raise
                time.sleep(2**k)
        raise AssertionError

    def partitions(self) -> list[InputPartition]:
        pages = self.options.get("pages")
        return [Page(i) for i in range(1, (int(pages) if pages else page_count(self.get(1))) + 1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        for row in page_rows(self.get(partition.number)):
            yield (partition.number, json.dumps(row, sort_keys=True))


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, record string"

    def reader(self, schema) -> DataSourceReader:
        return PagedJsonReader(self.options)
