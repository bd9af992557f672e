"""Metric search: terms of dotted globs, as regular expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchloom.functions.scalar import LOWER, UPPER, ascii_lower

_LOWERED = str.maketrans(UPPER, LOWER)
#: A glob's star: at least one more character, and then any within the component.
_STAR = r"(?=[^.])[^.]*?"


def _component(glob: str, anywhere: bool) -> str:
    parts = [_STAR] if anywhere else []
    for c in glob:
        parts.append(_STAR if c == "*" else "[^.]" if c == "?" else re.escape(c))
    return "".join(parts)


def term_regex(term: str) -> str:
    """What a metric (A-Z lower-cased) must contain to match one search term.

    The term's components must match components in a row; each matches anywhere in its
    component, which must not be empty, and need not reach its end.
    """
    return r"(?:^|\.)" + r"[^.]*\.".join(_component(c, True) for c in term.translate(_LOWERED).split("."))


def glob_regex(glob: str) -> str:
    """What a name (A-Z lower-cased) must begin with to match a bare glob."""
    star = r"(?=.).*?"
    return "^" + "".join(star if c == "*" else "." if c == "?" else re.escape(c) for c in glob.translate(_LOWERED))


def matches(metric: Column, query: str) -> Column:
    """All of the query's terms, parted by white space, match; the empty query matches all."""
    return reduce(lambda a, b: a & b, (ascii_lower(metric).rlike(term_regex(t)) for t in query.split()), F.lit(True))


def search(names: DataFrame, query: str, results: int = 10) -> DataFrame:
    """The first `results` names in byte order that match."""
    if results < 0:
        raise ValueError("results must not be negative")
    return names.select("metric").where(matches(F.col("metric"), query)).distinct().orderBy("metric").limit(results)
