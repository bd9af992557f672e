"""Configuration files: one database, one distribution, any number of listeners."""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from sketchloom.functions.driver import duration_ns

#: The default configuration.
DEFAULT = """\
[main]
duration = "10m"
plugins = []

[database.files]
directory = "data"
size = 256
cap = 400
files = 2

[dist.tdigest]
compression = 5.0

[api]
address = ":8080"
origin = "*"

[[listeners.graphite]]
address = ":1111"
"""


@dataclass
class Config:
    duration_ns: int
    database: tuple[str, dict[str, Any]]
    distribution: tuple[str, dict[str, Any]]
    listeners: list[tuple[str, dict[str, Any]]] = field(default_factory=list)
    plugins: list[str] = field(default_factory=list)
    api: dict[str, Any] = field(default_factory=dict)


def taken(table: dict[str, Any], name: str, kind: type, default: Any = None) -> Any:
    """An entry of that type; a missing one is the default, another type an error."""
    value = table.get(name)
    if value is None:
        return kind() if default is None else default
    if not isinstance(value, kind) or isinstance(value, bool) != (kind is bool):
        raise TypeError(f"{name}: expected {kind.__name__}, found {type(value).__name__}")
    return value


def loads(text: str) -> Config:
    """A configuration from TOML; exactly one database and one distribution."""
    data = tomllib.loads(text)
    main = taken(data, "main", dict)
    only = {}
    for what in ("database", "dist"):
        found = taken(data, what, dict)
        if len(found) != 1:
            raise ValueError(f"exactly one {what}, not {len(found)}")
        name = next(iter(found))
        only[what] = (name, taken(found, name, dict))
    listeners = []
    for name, entries in taken(data, "listeners", dict).items():
        listeners += [(name, e) for e in (entries if isinstance(entries, list) else [entries])]
    return Config(duration_ns(taken(main, "duration", str, "10m")), only["database"], only["dist"], listeners, taken(main, "plugins", list), taken(data, "api", dict))


def load(path: str | Path) -> Config:
    return loads(Path(path).read_text())


def _text(x: str) -> str:
    return json.dumps(x, ensure_ascii=False).replace("\x7f", "\\u007f")


def _key(x: str) -> str:
    return x if re.fullmatch("[A-Za-z0-9_-]+", x) else _text(x)


def _value(x: Any) -> str:
    return str(x).lower() if isinstance(x, bool) else _text(x) if isinstance(x, str) else f"[{', '.join(map(_value, x))}]" if isinstance(x, list) else str(x)


def dumps(config: Config) -> str:
    """The configuration as TOML, which loads() reads back."""
    rows = lambda t: "".join(f"{_key(k)} = {_value(v)}\n" for k, v in t.items())
    out = f'[main]\nduration = "{config.duration_ns}ns"\nplugins = {_value(config.plugins)}\n'
    for what, (name, entries) in (("database", config.database), ("dist", config.distribution)):
        out += f"\n[{what}.{_key(name)}]\n{rows(entries)}"
    if config.api:
        out += f"\n[api]\n{rows({k: v for k, v in config.api.items() if not isinstance(v, dict)})}"
        out += "".join(f"\n[api.{_key(k)}]\n{rows(v)}" for k, v in config.api.items() if isinstance(v, dict))
    for name, entries in config.listeners:
        out += f"\n[[listeners.{_key(name)}]]\n{rows(entries)}"
    return out
