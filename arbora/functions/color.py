"""Colours of values, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below the scale, above it, and the default stops (fixed values).
BELOW, ABOVE, DEFAULT = "#808080", "#c0c0c0", (("#0000ff", 0.0), ("#ff0000", 100.0))


def _rgb(color: str) -> tuple[int, int, int]:
    c = color.lstrip("#")
    c = "".join(2 * x for x in c) if len(c) == 3 else c
    return tuple(int(c[i : i + 2], 16) for i in (0, 2, 4))


def heat(x: Column, stops: tuple[tuple[str, float], ...] = DEFAULT) -> Column:
    """Piecewise linear between (colour, value) stops."""
    out = F.when(x < stops[0][1], F.lit(BELOW))
    for (a, low), (b, high) in zip(stops, stops[1:], strict=False):
        part = (x - low) / (high - low)
        mixed = [F.lower(F.lpad(F.hex(F.floor(p + (q - p) * part + 0.5).cast("long")), 2, "0")) for p, q in zip(_rgb(a), _rgb(b), strict=True)]
        out = out.when(x <= high, F.concat(F.lit("#"), *mixed))
    return out.when(x.isNotNull(), F.lit(ABOVE))


def auto(label: Column) -> Column:
    """A colour of its own for each label."""
    return F.concat(F.lit("#"), F.substring(F.md5(label.cast("binary")), 1, 6))
