"""Kinds of distribution: how each is built, merged and asked.

`exact` keeps the sorted values and answers exactly; `kll` is Spark's native quantile sketch,
of bounded size and wholly inside the JVM; `tdigest` is a merging t-digest in numpy, for
callers who need an interpolating sketch that can be asked any rank.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from sketchloom.operators import tdigest


@dataclass(frozen=True)
class Kind:
    """Column builders of one kind; build and merge aggregate, the others don't."""

    name: str
    build: Callable[[Column], Column]
    merge: Callable[[Column], Column]
    quantiles: Callable[[Column, list[float]], Column]
    cdf: Callable[[Column, float], Column]


def sorted_quantile(values: Column, q: float) -> Column:
    """The quantile q of a sorted array, between neighbours in proportion; null of an empty one."""
    at = F.lit(float(q)) * (F.size(values) - 1)
    low = F.try_element_at(values, F.floor(at).cast("int") + 1)
    high = F.try_element_at(values, F.ceil(at).cast("int") + 1)
    return F.when(F.size(values) > 0, low + (high - low) * (at - F.floor(at)))


def sorted_cdf(values: Column, x: Column | float) -> Column:
    """The share of an array's values up to x."""
    return F.try_divide(F.size(F.filter(values, lambda v: v <= x)).cast("double"), F.size(values))


_REGISTRY: dict[str, Kind] = {}


def register(kind: Kind) -> None:
    """Makes a kind known by its name; one of the same name is replaced."""
    _REGISTRY[kind.name] = kind


def kind(name: str) -> Kind:
    if name not in _REGISTRY:
        raise KeyError(f"no registration for: {name!r}")
    return _REGISTRY[name]


def kinds() -> list[str]:
    return sorted(_REGISTRY)


def _kll(name: str, *args: Column) -> Column:
    return F.call_function(f"kll_{name}_double", *args)


@F.pandas_udf(BinaryType())
def _tdigest_build(values: pd.Series) -> bytes:
    return tdigest.build(values.to_numpy())


@F.pandas_udf(BinaryType())
def _tdigest_merge(sketches: pd.Series) -> bytes:
    return tdigest.merge(list(sketches))


def _tdigest_quantiles(sketch: Column, qs: list[float]) -> Column:
    @F.pandas_udf("array<double>")
    def asked(sketches: pd.Series) -> pd.Series:
        return sketches.map(lambda s: None if s is None else [float(x) for x in tdigest.quantiles(s, qs)])

    return asked(sketch)


def _tdigest_cdf(sketch: Column, x: float) -> Column:
    @F.pandas_udf("double")
    def asked(sketches: pd.Series) -> pd.Series:
        return sketches.map(lambda s: None if s is None else float(tdigest.cdf(s, x)))

    return asked(sketch)


register(Kind("exact", lambda v: F.array_sort(F.collect_list(v)), lambda d: F.array_sort(F.flatten(F.collect_list(d))), lambda d, qs: F.array(*(sorted_quantile(d, q) for q in qs)), sorted_cdf))
register(Kind("kll", lambda v: _kll("sketch_agg", v), lambda d: _kll("merge_agg", d), lambda d, qs: _kll("sketch_get_quantile", d, F.array(*(F.lit(float(q)) for q in qs))), lambda d, x: _kll("sketch_get_rank", d, F.lit(float(x)))))
register(Kind("tdigest", lambda v: _tdigest_build(v), lambda d: _tdigest_merge(d), _tdigest_quantiles, _tdigest_cdf))
