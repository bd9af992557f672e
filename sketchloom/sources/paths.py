"""Metric names as folder names and back, as columns and as functions.

Dots part folders; a dot next to another, or at either end, is written %2e; a slash is %2f and
a percent sign %25.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_ESCAPES = {"%2e": ".", "%2f": "/", "%25": "%"}
_PARTS = re.compile(r"(\.*)(.*?)(\.*)", re.DOTALL)


def to_path(metric: str) -> str:
    """'foo..bar' gives 'foo/%2ebar'; the empty name the empty path."""
    before, core, after = _PARTS.fullmatch(metric).groups()
    if not core:
        return "%2e" * len(metric)
    core = core.replace("%", "%25").replace("/", "%2f")
    core = re.sub(r"\.+", lambda m: "/" + "%2e" * (len(m[0]) - 1), core)
    return ("%2e" * len(before) + "/" if before else "") + core + ("/" + "%2e" * len(after) if after else "")


def to_metric(path: str) -> str:
    """The inverse of to_path(); a bare dot or another escape raises an error."""
    if re.search(r"\.|%(?!2e|2f|25)", path):
        raise ValueError(f"not a metric's path: {path!r}")
    ends = re.search(r"/(%2e)*$", path)
    names = re.sub(r"(?<=%2e)/|(?<=/)/", "", path).replace("/", ".")
    names = re.sub("%2e|%2f|%25", lambda m: _ESCAPES[m[0]], names)
    return names[:-1] if ends else names


def path_column(metric: Column) -> Column:
    """to_path() of a column."""
    dots = lambda n: F.repeat(F.lit("%2e"), n.cast("int"))
    before = F.length(F.regexp_extract(metric, r"^\.*", 0))
    after = F.length(F.regexp_extract(metric, r"\.*$", 0))
    core = F.substring(metric, before + 1, F.greatest(F.lit(0), F.length(metric) - before - after))
    core = F.replace(F.replace(core, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2f"))
    core = F.regexp_replace(core, r"(?<!\.)\.", "/")  # the first dot of a run parts folders
    core = F.replace(core, F.lit("."), F.lit("%2e"))
    lead = F.when(before > 0, F.concat(dots(before), F.lit("/"))).otherwise("")
    trail = F.when(after > 0, F.concat(F.lit("/"), dots(after))).otherwise("")
    return F.when(before == F.length(metric), dots(before)).otherwise(F.concat(lead, core, trail))


def metric_column(path: Column) -> Column:
    """to_metric() of a column; null where that raises an error."""
    names = F.regexp_replace(path, "(?<=%2e)/|(?<=/)/", "")
    for escape, plain in (("/", "."), ("%2e", "."), ("%2f", "/"), ("%25", "%")):
        names = F.replace(names, F.lit(escape), F.lit(plain))
    names = F.when(path.rlike("/(%2e)*$"), F.substring(names, F.lit(1), F.length(names) - 1)).otherwise(names)
    return F.when(~path.rlike(r"\.|%(?!2e|2f|25)"), names)
