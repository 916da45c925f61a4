"""Name an intermediate value inside an expression, and build large expressions once."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Without this an expression used twice, or used inside a lambda, is computed
    again at each use.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def built_once(build: Callable) -> Callable:
    """Keep what a function builds for the life of the application.

    A Column that names its inputs is bound to no table and fits any query; building a
    large one takes seconds. Arguments must be hashable.
    """
    kept: dict = {}

    @wraps(build)
    def reuse(*arguments):
        key = (SparkSession.active().sparkContext.applicationId, arguments)
        if key not in kept:
            kept[key] = build(*arguments)
        return kept[key]

    return reuse
