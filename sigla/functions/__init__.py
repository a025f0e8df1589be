"""Expressions, and vectorised functions where there is no built-in expression."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import functions as F


def vectorised(returns: str) -> Callable:
    """A Pandas UDF that is made when it is used: its type can only be parsed in a session."""

    def wrap(f: Callable) -> Callable:
        @wraps(f)
        def column(*arguments):
            return F.pandas_udf(f, returns)(*arguments)

        return column

    return wrap
