"""Let-binding for lambdas of higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` applied to a value that is evaluated once.

    An expression referred to inside a lambda is evaluated again for every element; a lambda
    variable is not.
    """
    return F.element_at(F.transform(F.array(value), use), 1)
