"""Steps that stay out of a stage's one generated method."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def apart(value: Column, step: Callable[[Column], Column]) -> Column:
    """``step(value)`` as a lambda, so that Spark compiles the projection that holds it in small methods.

    A stage's columns otherwise become one method, which the JVM doesn't compile when many patterns make it long.
    """
    return F.element_at(F.transform(F.array(value), step), 1)
