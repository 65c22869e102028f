"""Named indexes of a root folder: opening, aliases, statistics, and search with latencies."""

from __future__ import annotations

import time
from collections import OrderedDict, defaultdict

from pyspark.sql import DataFrame, SparkSession

from termloom.plans import index as I
from termloom.plans.config import SearchOptions
from termloom.plans.search import search


class Catalog:
    """Every sub-folder of ``root`` that holds an index, by name."""

    def __init__(self, spark: SparkSession, root: str, cache: int = 1024):
        from termloom.streaming.segments import Folder

        self.spark, self.root, self.folder = spark, root, Folder(spark, root)
        self.aliases: dict[str, str] = {}
        self.opened: dict[str, I.Index] = {}
        self.plans: OrderedDict = OrderedDict()
        self.size, self.latencies, self.failures = cache, defaultdict(list), []

    def datasets(self) -> list[str]:
        return sorted(x for x in self.folder.names() if self.folder.exists(f"{x}/meta"))

    def alias(self, name: str, target: str) -> None:
        if target not in self.datasets():
            raise KeyError(f"no index is named {target}")
        self.aliases[name] = target
        self.plans.clear()

    def open(self, name: str) -> I.Index:
        name = self.aliases.get(name, name)
        if name not in self.opened:
            self.opened[name] = I.load(self.spark, f"{self.root}/{name}")
        return self.opened[name]

    def reload(self, name: str) -> I.Index:
        self.opened.pop(self.aliases.get(name, name), None)
        self.plans.clear()
        return self.open(name)

    def stats(self, name: str) -> dict:
        index = self.open(name)
        return {**index.stats, "avgdl": index.avgdl, **index.config.as_dict()}

    def search(self, name: str, queries: DataFrame | str, options: SearchOptions = SearchOptions()) -> DataFrame:
        """The plan of a search; plans of literal queries are kept, the least recently used goes first."""
        key = (self.aliases.get(name, name), queries, repr(options)) if isinstance(queries, str) else None
        if key in self.plans:
            self.plans.move_to_end(key)
            return self.plans[key]
        try:
            out = search(self.open(name), queries, options)
        except Exception as e:
            self.failures.append((name, str(e)))
            raise
        if key and not options.facets:
            self.plans[key] = out
            while len(self.plans) > self.size:
                self.plans.popitem(last=False)
        return out

    def timed(self, name: str, queries: DataFrame | str, options: SearchOptions = SearchOptions()) -> list:
        """The rows of a search (k of each query), its seconds noted."""
        began = time.perf_counter()
        rows = self.search(name, queries, options).collect()
        self.latencies[name].append(time.perf_counter() - began)
        return rows

    def metrics(self, name: str) -> dict[str, float]:
        """p50, p95 and p99 of the noted seconds: the value at place floor(n * share)."""
        t = sorted(self.latencies[name])
        return {f"p{p}": t[min(len(t) - 1, len(t) * p // 100)] for p in (50, 95, 99)} if t else {}
