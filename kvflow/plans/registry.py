"""Named map, reduce and combine functions, in three tiers.

* native: a map is a function of the lines (file, value) to (key, value); a reduce of those pairs to (key, value) columns,
  all in Catalyst's sight;
* python: the plain signatures map(file, contents) -> [(key, value)], reduce(key, values) -> value, combine like reduce,
  run on whole Arrow batches.
"""

from __future__ import annotations

import importlib.util
import inspect
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvflow.functions import text, web
from kvflow.operators import crawl_clean
from kvflow.sources import lines as sources

Native = Callable[[DataFrame], DataFrame]
MapFunction = Callable[[str, str], Iterable[tuple[str, str]]]
ReduceFunction = Callable[[str, list[str]], str]


class ConfigError(ValueError):
    """The job names something that does not exist or does not fit."""


@dataclass(frozen=True)
class Entry:
    function: Any
    native: bool
    #: Reduces to which a combine function may be applied before.
    combines: frozenset[str] = frozenset()


@dataclass
class Registry:
    maps: dict[str, Entry] = field(default_factory=dict)
    reduces: dict[str, Entry] = field(default_factory=dict)
    combines: dict[str, Entry] = field(default_factory=dict)

    def register_map(self, name: str, function: MapFunction | Native, native: bool = False) -> None:
        """The last registration of a name holds."""
        self.maps[name] = Entry(function, native)

    def register_reduce(self, name: str, function: ReduceFunction | Native, native: bool = False) -> None:
        self.reduces[name] = Entry(function, native)

    def register_combine(self, name: str, function: ReduceFunction | Native, combines: Iterable[str], native: bool = False) -> None:
        self.combines[name] = Entry(function, native, frozenset(combines))

    def resolve(self, map_name: str, reduce_name: str, combine_name: str = "") -> tuple[Entry, Entry, Entry | None]:
        """Functions of a job at submission. Unknown maps and reduces are errors, as is a combine not made for the reduce; an
        unknown combine is ignored."""
        if map_name not in self.maps:
            raise ConfigError(f"unknown map function: {map_name}")
        if reduce_name not in self.reduces:
            raise ConfigError(f"unknown reduce function: {reduce_name}")
        combine = self.combines.get(combine_name)
        if combine and reduce_name not in combine.combines:
            raise ConfigError(f"combine function {combine_name} does not fit reduce function {reduce_name}")
        return self.maps[map_name], self.reduces[reduce_name], combine

    def load_plugin(self, path: str, prefix: str = "plugin") -> list[str]:
        """Registers what a Python file has of Map, Reduce and Combine as {prefix}_map and so on, and returns the names."""
        spec = importlib.util.spec_from_file_location(f"kvflow_plugin_{prefix}", path)
        if spec is None or spec.loader is None:
            raise ConfigError(f"not a plugin: {path}")
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        # Functions of a loaded file travel to the executors by value.
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(_listed(module))
        names = []
        for symbol, kind in (("Map", "map"), ("Reduce", "reduce"), ("Combine", "combine")):
            function = getattr(module, symbol, None)
            if function is None:
                continue
            if not callable(function) or len(inspect.signature(function).parameters) != 2:
                raise ConfigError(f"{symbol} in {path} has the wrong signature")
            name = f"{prefix}_{kind}"
            if kind == "combine":
                self.register_combine(name, function, [f"{prefix}_reduce"])
            else:
                (self.register_map if kind == "map" else self.register_reduce)(name, function)
            names.append(name)
        return names


def _listed(module: Any) -> Any:
    import sys

    sys.modules[module.__name__] = module
    return module


def _wordcount_map(lines: DataFrame) -> DataFrame:
    return lines.select(text.words(F.col("value")).alias("key"), F.lit("1").alias("value"))


def _wordcount_reduce(pairs: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum(text.integer_or_skip(F.col("value"))), F.lit(0))
    return pairs.groupBy("key").agg(total.cast("string").alias("value"))


def _crawl_map(lines: DataFrame) -> DataFrame:
    records = sources.crawl_records(lines)
    return crawl_clean.cleaned_rows(records, F.lit(0)).select(F.col("domain").alias("key"), F.col("cleaned").alias("value"))


def _crawl_reduce(pairs: DataFrame) -> DataFrame:
    # Lines have no order across splits; texts of a domain are merged in their own order, so that reruns agree.
    rows = pairs.select(F.col("key").alias("domain"), F.col("value").alias("cleaned"), F.lit(0).alias("ord"))
    merged = crawl_clean.merged_per_domain(rows)
    return merged.select(F.col("domain").alias("key"), web.emit_crawl_json(F.col("count"), F.col("merged_text"), F.col("unique_count")).alias("value"))


def builtin() -> Registry:
    registry = Registry()
    registry.register_map("wordcount_map", _wordcount_map, native=True)
    registry.register_reduce("wordcount_reduce", _wordcount_reduce, native=True)
    # Sums of sums are sums, so the reduce is its own combine.
    registry.register_combine("wordcount_combine", _wordcount_reduce, ["wordcount_reduce"], native=True)
    registry.register_map("crawl_clean_map", _crawl_map, native=True)
    registry.register_reduce("crawl_clean_reduce", _crawl_reduce, native=True)
    return registry


REGISTRY = builtin()
