"""Line differences of texts in unified form."""

from __future__ import annotations

import difflib
from itertools import islice

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines of a difference that are told.
MOST_LINES = 40


def unified_diff(old: Column, new: Column, most: int | None = MOST_LINES) -> Column:
    """The first ``most`` lines (all of them if None) of the difference of two texts, three lines of context around each change; none for equal texts.

    Null texts are empty.
    """

    def told(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[] if x == y else list(islice(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), lineterm=""), most)) for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(told, "array<string>")(old, new)
