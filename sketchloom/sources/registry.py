"""Sources and stores by the names that configurations have, and plug-ins that add to them."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from sketchloom.operators import series
from sketchloom.operators.kinds import Kind, kind
from sketchloom.sources import graphite
from sketchloom.sources.config import Config, taken
from sketchloom.streaming import ingest

#: A listener makes a stream of observations; a store, by its entries, says where records are, writes and reads them.
Listener = Callable[[SparkSession, dict[str, Any]], DataFrame]


@dataclass(frozen=True)
class Store:
    """path: the place that entries of a configuration name."""

    path: Callable[[dict[str, Any]], str]
    write: Callable[[DataFrame, str], None] = series.write
    read: Callable[[SparkSession, str], DataFrame] = ingest.stored


_LISTENERS: dict[str, Listener] = {}
_STORES: dict[str, Store] = {}


def register_listener(name: str, listener: Listener) -> None:
    _LISTENERS[name] = listener


def register_store(name: str, store: Store) -> None:
    _STORES[name] = store


def _found(table: dict[str, Any], name: str) -> Any:
    if name not in table:
        raise KeyError(f"no registration for: {name!r}")
    return table[name]


def listener(name: str) -> Listener:
    return _found(_LISTENERS, name)


def store(name: str) -> Store:
    return _found(_STORES, name)


def load_plugins(config: Config) -> None:
    """Imports the modules that main.plugins names; each registers what it has."""
    for name in config.plugins:
        importlib.import_module(name)


@dataclass
class Resolved:
    """What a configuration names: a kind of distribution, a store and its path, and listeners with their entries."""

    kind: Kind
    store: Store
    path: str
    listeners: list[tuple[Listener, dict[str, Any]]]


def resolve(config: Config) -> Resolved:
    """After its plug-ins are loaded; a name that nothing is registered for raises KeyError."""
    load_plugins(config)
    own = store(config.database[0])
    return Resolved(kind(config.distribution[0]), own, own.path(config.database[1]), [(listener(name), entries) for name, entries in config.listeners])


def _graphite(spark: SparkSession, entries: dict[str, Any]) -> DataFrame:
    host, _, port = taken(entries, "address", str, ":1111").rpartition(":")
    return graphite.read_socket(spark, host or "localhost", int(port))


register_listener("graphite", _graphite)
register_store("files", Store(lambda entries: taken(entries, "directory", str, "data")))
