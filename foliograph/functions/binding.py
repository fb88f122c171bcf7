"""Values that are computed once for a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body mentions it.

    Inside a lambda Spark would otherwise evaluate the inlined expression again for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
