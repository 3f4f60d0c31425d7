"""Vectors as ARRAY<DOUBLE>: dot products, norms, centroids, variances."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(x: str | Column) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda a, v: a + v)


def dot(x: str | Column, y: str | Column) -> Column:
    return total(F.zip_with(_c(x), _c(y), lambda a, b: a * b))


def scaled(x: str | Column, by: Column) -> Column:
    return F.transform(_c(x), lambda v: v * by)


def unit(x: str | Column) -> Column:
    """The vector divided by its norm; null if that is zero.  The norm is bound once, as an array of one."""
    v = _c(x)
    return F.get(F.transform(F.array(F.sqrt(dot(v, v))), lambda norm: F.when(norm > 0, F.transform(v, lambda e: e / norm))), F.lit(0))


def finite(x: str | Column) -> Column:
    """Present, and every component a finite number."""
    return F.coalesce(F.forall(_c(x), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def cosine(x: str | Column, y: str | Column) -> Column:
    """Null if a norm is zero."""
    return dot(x, y) / F.nullif(F.sqrt(dot(x, x) * dot(y, y)), F.lit(0.0))


def pearson(x: str | Column, y: str | Column) -> Column:
    """Over components; null if a vector is constant, that is if its variance is below what rounding leaves of its mean square."""
    n = F.size(_c(x))
    mx, my = total(x) / n, total(y) / n
    sx, sy = dot(x, x) / n, dot(y, y) / n
    cov = dot(x, y) / n - mx * my
    vx, vy = sx - mx * mx, sy - my * my
    return F.when((vx > 1e-12 * sx) & (vy > 1e-12 * sy), cov / F.sqrt(vx * vy))


def distance2(x: str | Column, y: str | Column) -> Column:
    return total(F.zip_with(_c(x), _c(y), lambda a, b: (a - b) * (a - b)))


def moments(df: DataFrame, keys: list, vec: str = "vec") -> DataFrame:
    """Per group: n, mean (array) and spread, the sum over dimensions of the sample variance.

    One buffer per group leaves each task, whatever the number of dimensions."""
    with_v = df.withColumn("__v", array_to_vector(_c(vec)))
    got = with_v.groupBy(*keys).agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("__v")).alias("m"))
    spread = total(vector_to_array(F.col("m.variance")))
    return got.select(*[k if isinstance(k, str) else k for k in keys], F.col("m.count").alias("n"), vector_to_array(F.col("m.mean")).alias("mean"), spread.alias("spread"))


def e_distance(mx: Column, my: Column, nx: Column, ny: Column, sx: Column, sy: Column) -> Column:
    """Bias-corrected energy distance on squared Euclidean distances, in linear time: 2|mx-my|^2 - 2 sx/nx - 2 sy/ny.

    ``s`` is the sum over dimensions of the sample variance.  Null if a side has fewer than two members."""
    return F.when((nx >= 2) & (ny >= 2), 2 * distance2(mx, my) - 2 * sx / nx - 2 * sy / ny)


def pooled(vec: str | Column, width: int) -> Column:
    """Means of consecutive runs of ``width`` components."""
    v = _c(vec)
    n = (F.size(v) / width).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: total(F.slice(v, i * width + 1, width)) / width)
