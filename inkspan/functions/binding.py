"""A value that an expression names many times, computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` bound to a variable: it is computed once a row however often ``use`` names it, and the
    expression does not grow by a copy for each name."""
    return F.transform(F.array(value), use)[0]
