"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    Rules that refer to the same part over and over would otherwise multiply into very
    large expressions when they are nested.
    """
    return F.transform(F.array(value), body)[0]
