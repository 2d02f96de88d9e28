"""Helpers for expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once.

    What stands inside a lambda is computed for each element anew, however
    often it is written out; a value that is bound this way is not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
