"""Building blocks for expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable is bound to it, where plain reuse would repeat it in every call of an inner lambda."""
    return F.get(F.transform(F.array(value), body), 0)
