"""Vector arithmetic on array columns.

Give ``width`` when the vector length is known: the sum is then written out
element by element and compiled by Spark.  Without it the higher-order array
functions are used, which work for any length but run interpreted.  The two
agree on vectors of that width; ``with_width`` holds a table to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNROLL_LIMIT = 128


def width_message(width: int) -> str:
    return f"every vector needs exactly {width} values, none NULL"


def of_width(v: Column, width: int) -> Column:
    """``v``; the job fails where it is NULL or has another width."""
    return F.when(F.size(v) == width, v).otherwise(F.raise_error(F.lit(width_message(width))))


def with_width(df: DataFrame, **widths: int) -> DataFrame:
    """``df`` with the named vector columns held to their widths."""
    return df.withColumns({name: of_width(F.col(name), width) for name, width in widths.items()})


def tree_sum(terms: list[Column]) -> Column:
    """Sum columns as a balanced tree, so wide vectors give shallow plans."""
    while len(terms) > 1:
        terms = [
            terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i]
            for i in range(0, len(terms), 2)
        ]
    return terms[0]


def sum_over(
    a: Column, b: Column, term: Callable[[Column, Column], Column], width: int | None
) -> Column:
    """Sum of ``term(a[j], b[j])`` over j, as a double."""
    if width is not None and 0 < width <= UNROLL_LIMIT:
        return tree_sum([term(a[j], b[j]).cast("double") for j in range(width)])
    return F.aggregate(
        F.zip_with(a, b, lambda u, v: term(u, v).cast("double")),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def squared_distance(a: Column, b: Column, width: int | None = None) -> Column:
    return sum_over(a, b, lambda u, v: (u - v) * (u - v), width)


def euclidean(a: Column, b: Column, width: int | None = None) -> Column:
    return F.sqrt(squared_distance(a, b, width))


def hamming(a: Column, b: Column, width: int | None = None) -> Column:
    return sum_over(a, b, lambda u, v: F.abs(u - v), width)


def scale(v: Column, weight: Column) -> Column:
    """weight * v, element by element."""
    return F.transform(v, lambda u: u * weight)


def scale_complement(v: Column, weight: Column) -> Column:
    """weight * (1 - v), element by element."""
    return F.transform(v, lambda u: (F.lit(1.0) - u) * weight)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda u, v: u + v)


def divide(v: Column, by: Column) -> Column:
    """v / by, element by element; NULL where ``by`` is 0."""
    return F.transform(v, lambda u: F.try_divide(u, by))
