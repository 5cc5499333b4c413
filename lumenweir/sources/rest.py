"""A paginated REST source as a Spark data source: format "paged_rest". Connectors are options of it.

Options: pages, the number of pages that are read in parallel; page_param; url; items, the field of a page's JSON that lists
its rows; token, sent as a bearer token. Rows are (page, item): the item as JSON text, to be parsed with a schema. A page
that the service asks to retry later is waited for and tried again a few times; another failure ends the task, which Spark
tries again.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TRIES = 4


class PagedRest(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        return "page int, item string"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(dict(self.options))


class _Pages(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(1, int(self.options.get("pages", 1)) + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page, o = partition.value, self.options
        sign = "&" if "?" in o["url"] else "?"
        request = urllib.request.Request(f"{o['url']}{sign}{o.get('page_param', 'page')}={page}", headers={"Authorization": f"Bearer {o['token']}"} if "token" in o else {})
        for k in range(TRIES):
            try:
                with urllib.request.urlopen(request, timeout=60) as reply:
                    body = json.load(reply)
                break
            except urllib.error.HTTPError as e:
                if e.code != 429 or k == TRIES - 1:
                    raise
                time.sleep(float(e.headers.get("Retry-After", 2**k)))
        for item in body[o["items"]] if "items" in o else body:
            yield page, json.dumps(item, ensure_ascii=False)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedRest)
