"""Helpers that run on the driver: durations, axis units, a small generator."""

from __future__ import annotations

import re

#: Nanoseconds of duration units.
UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}
_PART = re.compile(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)")
HOUR = UNITS["h"]


def duration_ns(text: str) -> int:
    """Nanoseconds of '10m', '1h30m', '-1.5s' and the like."""
    sign, body = (-1, text[1:]) if text[:1] == "-" else (1, text.removeprefix("+"))
    if body == "0":
        return 0
    parts = _PART.findall(body)
    if not parts or "".join(a + b for a, b in parts) != body:
        raise ValueError(f"not a duration: {text!r}")
    return sign * round(sum(float(a) * UNITS[b] for a, b in parts))


def axis_unit_ns(span_ns: int, width: int) -> int:
    """The largest of 1 h, 2 h, 4 h and further even hours up to 24 h that is under a hundred pixels' time; 1 h at least."""
    if width < 100:
        raise ValueError("a width of at least 100")
    room = span_ns // (width // 100)
    return max([h for h in (1, *range(2, 25, 2)) if h * HOUR < room], default=1) * HOUR


def axis_labels_ns(now_ns: int, span_ns: int, width: int) -> list[int]:
    """Times of an axis' labels, ascending: multiples of its unit after the span's start."""
    unit = axis_unit_ns(span_ns, width)
    first = ((now_ns - span_ns) // unit + 1) * unit
    return list(range(first, now_ns + 1, unit))


class Pcg:
    """A permuted congruential generator (XSH RR, 64 bits of state, 32 of output)."""

    def __init__(self, state: int, sequence: int) -> None:
        self.step = (sequence << 1 | 1) & (1 << 64) - 1
        self.state = 0
        self.next()
        self.state = (self.state + state) & (1 << 64) - 1
        self.next()

    def next(self) -> int:
        old = self.state
        self.state = (old * 6364136223846793005 + self.step) & (1 << 64) - 1
        x, turn = (old >> 18 ^ old) >> 27 & 0xFFFFFFFF, old >> 59
        return (x >> turn | x << (-turn & 31)) & 0xFFFFFFFF
