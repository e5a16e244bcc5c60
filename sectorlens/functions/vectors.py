"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def inner_product(left: str | Column, right: str | Column) -> Column:
    products = F.zip_with(_column(left), _column(right), lambda a, b: a.cast("double") * b)
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def l2_normalise(column: str | Column) -> Column:
    """The vector scaled to length 1; a zero vector stays."""
    vector = _column(column)
    squares = F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    # The length travels in a one-element array, so it is computed once per vector.
    return F.flatten(
        F.transform(
            F.array(F.sqrt(squares)),
            lambda norm: F.transform(vector, lambda v: F.when(norm > 0, v.cast("double") / norm).otherwise(v.cast("double"))),
        )
    )
