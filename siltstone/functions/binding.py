"""Names for parts of an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, with ``value`` computed once a row, however often it is used, inside of lambda functions too."""
    return F.get(F.transform(F.array(value), of), F.lit(0))
