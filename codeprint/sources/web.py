"""A Python data source that fetches pages, one partition for each; it needs a network."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagesDataSource(DataSource):
    """``spark.read.format("codeprint_pages")``; options: urls (a JSON list), timeout, interval, token, attempts.

    Rows: url, status, body, error.  A failed fetch is a row with its error, so one page never fails the scan."""

    @classmethod
    def name(cls) -> str:
        return "codeprint_pages"

    def schema(self) -> str:
        return "url string, status int, body string, error string"

    def reader(self, schema) -> PagesReader:  # noqa: ANN001
        return PagesReader(self.options)


class PagesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls = json.loads(options.get("urls", "[]"))
        self.timeout, self.interval = float(options.get("timeout", 10)), float(options.get("interval", 0))
        self.token, self.attempts = options.get("token"), int(options.get("attempts", 1))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        error = None
        for _ in range(self.attempts):
            time.sleep(self.interval)
            request = urllib.request.Request(partition.value, headers={"Authorization": f"Bearer {self.token}"} if self.token else {})
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as got:  # noqa: S310
                    yield partition.value, got.status, got.read().decode("utf-8", "replace"), None
                    return
            except (OSError, ValueError) as e:
                error = str(e)
        yield partition.value, None, None, error
