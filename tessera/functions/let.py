"""Binding of a computed column within one expression.

Spark inlines a column wherever it is used, so an array that a lambda indexes would be made anew for
each element. A lambda's argument is made once: `let` passes the value through a one-element array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]
