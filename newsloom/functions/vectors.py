"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def vec_dot(a: Column, b: Column) -> Column:
    """Inner product; operands of different length are an error."""
    product = _sum(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y))
    return F.when(F.size(a) == F.size(b), product).otherwise(
        F.raise_error(F.lit("vectors differ in length"))
    )


def vec_norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(as_doubles(v), lambda x: x * x)))


def vec_cosine(a: Column, b: Column) -> Column:
    """Cosine; null when a vector has no direction."""
    scale = vec_norm(a) * vec_norm(b)
    return F.when(scale > 0, vec_dot(a, b) / scale)


def vec_scale(v: Column, factor: Column) -> Column:
    return F.transform(as_doubles(v), lambda x: x * factor)


def vec_unit(v: Column) -> Column:
    """Vector scaled to length one; a zero vector stays zero."""
    # The length is bound once as an array element: a lambda body that contained
    # the whole norm would recompute it for every component.
    return F.element_at(
        F.transform(
            F.array(F.struct(as_doubles(v).alias("v"), vec_norm(v).alias("n"))),
            lambda s: F.transform(
                s["v"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(x)
            ),
        ),
        1,
    )


def vec_sum(v: Column, weight: Column | None = None, over: WindowSpec | None = None) -> Column:
    """Element-wise (weighted) sum over a group, combined map-side, or over a window."""
    vector = array_to_vector(as_doubles(v))
    if weight is not None:
        vector = array_to_vector(vec_scale(v, weight.cast("double")))
    summary = Summarizer.metrics("sum").summary(vector)
    return vector_to_array((summary if over is None else summary.over(over))["sum"])


def vec_sum_of(v: Column, width: int, weight: Column | None = None) -> Column:
    """Element-wise (weighted) sum of vectors of ``width`` components over a group.

    A plain sum per component: the groups of a task stay in one hash table of fixed rows, where
    ``vec_sum`` sorts the vectors themselves once a task has many groups.
    """
    same = F.when(F.size(v) == width, as_doubles(v)).otherwise(
        F.raise_error(F.lit("vectors differ in length")).cast("array<double>")
    )
    factor = F.lit(1.0) if weight is None else weight.cast("double")
    sums = [F.sum(F.get(same, F.lit(i)) * factor) for i in range(width)]
    return F.array(*sums).cast("array<double>")


def sigmoid(x: Column, bound: float = 6.0) -> Column:
    clamped = F.greatest(F.least(x, F.lit(bound)), F.lit(-bound))
    return 1.0 / (1.0 + F.exp(-clamped))


def parse_vec(c: Column) -> Column:
    """``"1.0,2.5"`` as an array of doubles; empty pieces are ignored."""
    parts = F.filter(F.split(c, ","), lambda s: F.trim(s) != "")
    return F.transform(parts, lambda s: F.trim(s).cast("double"))


def format_vec(v: Column) -> Column:
    return F.array_join(F.transform(as_doubles(v), lambda x: x.cast("string")), ",")
