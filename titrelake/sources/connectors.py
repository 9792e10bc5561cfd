"""Connectors to outside services, as interfaces: a page source for HTTP APIs and a model client that may be absent."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def retry(call: Callable[[], str], times: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """The call's result; failures are tried again with growing pauses."""
    for k in range(times):
        try:
            return call()
        except OSError:
            if k == times - 1:
                raise
            sleep(wait * 2**k)
    raise AssertionError


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from urllib.request import urlopen

        yield partition.value, retry(lambda: urlopen(partition.value, timeout=60).read().decode())


class HttpPages(DataSource):
    """spark.read.format("http_pages").option("urls", json list): (url, body), one task for each url."""

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return "url string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options.get("urls", "[]")))


class Model:
    """A language model behind a callable; without one, every caller takes its deterministic way."""

    def __init__(self, ask: Callable[[str], str] | None = None) -> None:
        self.ask = ask

    @property
    def available(self) -> bool:
        return self.ask is not None

    def json(self, prompt: str) -> dict | None:
        """The object in the model's answer; None without a model or an object."""
        if self.ask is None:
            return None
        text = self.ask(prompt)
        a, b = text.find("{"), text.rfind("}")
        try:
            return json.loads(text[a : b + 1]) if 0 <= a < b else None
        except ValueError:
            return None
