"""Exact order statistics of a column of any size, without sorting it.

The place that is asked for is bracketed by two approximate quantiles whose error is known; what lies
below the bracket is counted, and the search goes on inside it.  Each pass leaves a few hundredths of
the rows, until those that are left may be sorted or are all alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that are sorted at once, and the relative error of a bracket's ends.
FEW, ERROR = 10_000, 0.01


def nth(rows: DataFrame, value: str, place: int, total: int | None = None, few: int = FEW) -> float | None:
    """The value at ``place``, from 0, of the ascending order of a numeric column without nulls and NaNs; None past its end.

    ``rows`` must be cheap to read: each pass scans it.
    """
    own = rows.select(F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    inside, left = own, own.count() if total is None else total
    if not 0 <= place < left:
        return None
    while left > few:
        at = place / left
        low, high = inside.approxQuantile("v", [max(0.0, at - 2 * ERROR), min(1.0, at + 2 * ERROR)], ERROR)
        below, within = inside.agg(F.coalesce(F.sum((F.col("v") < low).cast("long")), F.lit(0)), F.coalesce(F.sum(F.col("v").between(low, high).cast("long")), F.lit(0))).first()
        if not below <= place < below + within or within == left:  # cannot be unless the sketch breaks its bound, or nearly all are alike
            first, last = inside.agg(F.min("v"), F.max("v")).first()
            if first == last:
                return first
            low, high = (first, (first + last) / 2) if place < inside.filter(F.col("v") <= (first + last) / 2).count() else ((first + last) / 2, last)
            inside = inside.filter(F.col("v").between(low, high) if low == first else (F.col("v") > low))
            before = 0 if low == first else own.filter(F.col("v") <= low).count() - own.filter(F.col("v") < first).count()
            place, left = place - before, inside.count()
            continue
        if low == high:
            return low
        inside, place, left = inside.filter(F.col("v").between(low, high)), place - below, within
    return sorted(r["v"] for r in inside.collect())[place]  # at most ``few`` numbers


def quantile_places(total: int, parts: int) -> list[int]:
    """The places of the elements that cut ``total`` of them into parts, rounded down."""
    return [total * k // parts for k in range(1, parts)]
