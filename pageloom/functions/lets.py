"""Naming intermediate values, and reusing long expressions."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Catalyst may inline an alias that is referenced a single time, also when that
    reference sits inside a lambda that runs once per element. Binding the value
    as a lambda variable keeps an expensive array from being rebuilt per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


@functools.cache
def _built_lambda(body: Callable[..., Column], *options) -> Column | None:
    """The lambda of ``body`` as a reusable node, where this PySpark lets us keep it."""
    try:
        from pyspark.sql.classic.column import Column as ClassicColumn
        from pyspark.sql.functions.builtin import _create_lambda

        return ClassicColumn(_create_lambda(lambda x: body(x, *options)))
    except (ImportError, AttributeError, AssertionError):
        return None


def shared(body: Callable[..., Column]) -> Callable[..., Column]:
    """Make a long one-argument Column function cheap to use many times.

    Building an expression costs a gateway round trip per node, which adds up when a
    plan applies the same long function to many fields. The function's lambda is built
    once and handed out again. Further arguments must be plain hashable values.
    """

    @functools.wraps(body)
    def apply(value: Column, *options) -> Column:
        built = _built_lambda(body, *options)
        if built is None:
            return let(value, lambda x: body(x, *options))
        return F.get(F.call_function("transform", F.array(value), built), F.lit(0))

    return apply
