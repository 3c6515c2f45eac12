"""Arrow functions that can be declared before there is a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_function(returns: str) -> Callable:
    """As pandas_udf, but made when it is first applied."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def apply(*columns) -> Column:
            return F.pandas_udf(f, returns)(*columns)

        return apply

    return wrap
