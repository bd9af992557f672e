"""The rows that the engine works on."""

from __future__ import annotations

#: One input point. `seq` orders points of equal value; ts is event time.
OBSERVATION = "metric string, us long, value double, id long"
#: One distribution of a metric over [start_ns, end_ns). `distribution` is an array of double for the kind `exact`, else binary.
RECORD_FIELDS = ("metric", "start_ns", "end_ns", "observations", "min", "max", "min_id", "max_id", "merged", "kind", "distribution")
#: One column of a heatmap: `w` pixels from `x` on.
COLUMN_FIELDS = ("metric", "x", "w", "data", "obs_sec")
