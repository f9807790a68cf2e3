"""Image resampling by separable weights: two equi-joins and two sums.

Each axis has a sparse table of weights (old place, new place, weight) that holds everything that happens along it: the
Gaussian that keeps a shrinking image from aliasing, the spline's prefilter, and its interpolation. Edges are mirrored about the
centre of the last pixel. The tables have some forty rows a new place, whatever the number of images.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .raster import KEY

#: Smaller weights are left out; they are worth less than a millionth of a grey level of a 16-bit image.
LEAST_WEIGHT = 1e-12
#: Standard deviations after which the Gaussian ends.
TRUNCATE = 4.0


def _mirrored(place: np.ndarray, n: int) -> np.ndarray:
    """Places outside 0 … n - 1 reflected at the first and last pixel's centre."""
    if n == 1:
        return np.zeros_like(place)
    period = 2 * (n - 1)
    place = np.abs(place) % period
    return np.minimum(place, period - place)


def bspline(order: int, x: np.ndarray) -> np.ndarray:
    """The centred B-spline of an order, by the recursion from the box."""
    if order == 0:
        return ((x >= -0.5) & (x < 0.5)).astype(float)
    h = (order + 1) / 2
    return ((x + h) * bspline(order - 1, x + 0.5) + (h - x) * bspline(order - 1, x - 0.5)) / order


def _spread(rows: np.ndarray, places: np.ndarray, weights: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape)
    np.add.at(out, (rows, places), weights)
    return out


@lru_cache(32)
def axis_weights(n_in: int, n_out: int, order: int, anti_aliasing: bool) -> np.ndarray:
    """(n_out, n_in) weights along one axis."""
    centre = (np.arange(n_out) + 0.5) * n_in / n_out - 0.5
    if order == 0:
        taps = np.floor(centre + 0.5)[:, None]
    else:
        first = np.floor(centre if order % 2 else centre + 0.5) - order // 2
        taps = first[:, None] + np.arange(order + 1)
    weights = np.ones_like(taps) if order == 0 else bspline(order, centre[:, None] - taps)
    out = _spread(np.repeat(np.arange(n_out), taps.shape[1]), _mirrored(taps.astype(np.int64), n_in).ravel(), weights.ravel(), (n_out, n_in))
    places = np.arange(n_in)
    if order > 1 and n_in > 1:  # coefficients whose spline goes through the pixels
        near = np.arange(-(order // 2), order // 2 + 1)
        at = _mirrored(places[:, None] + near, n_in)
        through = _spread(np.repeat(places, len(near)), at.ravel(), np.tile(bspline(order, near.astype(float)), n_in), (n_in, n_in))
        out = np.linalg.solve(through.T, out.T).T
    sigma = (n_in / n_out - 1) / 2
    if anti_aliasing and sigma > 0:
        reach = int(TRUNCATE * sigma + 0.5)
        near = np.arange(-reach, reach + 1)
        bell = np.exp(-(near**2) / (2 * sigma**2))
        at = _mirrored(places[:, None] + near, n_in)
        out = out @ _spread(np.repeat(places, len(near)), at.ravel(), np.tile(bell / bell.sum(), n_in), (n_in, n_in))
    return out


def weight_table(spark: SparkSession, n_in: int, n_out: int, order: int, anti_aliasing: bool, name: str) -> DataFrame:
    """The axis as rows (name, name_new, name_w)."""
    w = axis_weights(n_in, n_out, order, anti_aliasing)
    new, old = np.nonzero(np.abs(w) >= LEAST_WEIGHT)
    rows = list(zip(old.tolist(), new.tolist(), w[new, old].tolist(), strict=True))
    return spark.createDataFrame(rows, f"{name} int, {name}_new int, {name}_w double")


def resample(image: DataFrame, from_shape: tuple[int, int], to_shape: tuple[int, int], order: int = 1, anti_aliasing: bool = True, value: str = "value", levels: tuple[float, float] | None = None) -> DataFrame:
    """(seq, frame, y, x, value) of images in another size; places that are not there are 0 [O-135].

    Splines of ``order`` 0 to 5. Results stay within the values of their own image; ``levels`` rounds to whole
    grey levels, halves to even, within that range. Null values count as 0.
    """
    if not 0 <= order <= 5:
        raise ValueError("order must lie between 0 and 5")
    spark = image.sparkSession
    rows, columns = (F.broadcast(weight_table(spark, a, b, order, anti_aliasing, n)) for a, b, n in zip(from_shape, to_shape, "yx", strict=True))  # bounded by the image's sides
    cells = image.select(*KEY, "y", "x", F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    bounds = cells.groupBy(*KEY).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))
    some = F.col("n") < from_shape[0] * from_shape[1]  # absent places are zeros
    bounds = bounds.select(*KEY, F.when(some, F.least("low", F.lit(0.0))).otherwise(F.col("low")).alias("low"), F.when(some, F.greatest("high", F.lit(0.0))).otherwise(F.col("high")).alias("high"))
    half = cells.join(rows, "y").groupBy(*KEY, "y_new", "x").agg(F.sum(F.col("v") * F.col("y_w")).alias("v"))
    out = half.join(columns, "x").groupBy(*KEY, "y_new", "x_new").agg(F.sum(F.col("v") * F.col("x_w")).alias("v")).join(bounds, KEY)
    v = F.least(F.greatest("v", "low"), F.col("high"))
    if levels is not None:
        v = F.least(F.greatest(F.rint(v), F.lit(float(levels[0]))), F.lit(float(levels[1])))
    return out.select(*KEY, F.col("y_new").alias("y"), F.col("x_new").alias("x"), v.alias(value))
