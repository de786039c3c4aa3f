"""Element-wise functions of vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def convert(v: Column, kind: str) -> Column:
    """Every element cast (fractions are cut off when the target is whole)."""
    return F.transform(v, lambda x: x.cast(kind))


def root(v: Column) -> Column:
    """Square root of every element; null where an element is negative."""
    return F.transform(v, lambda x: F.when(x >= 0, F.sqrt(x.cast("double"))))


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def _scaled(v: Column, total: Column) -> Column:
    return F.when(total > 0, F.transform(v, lambda x: x / total)).otherwise(v)


def norm_sum1(v: Column) -> Column:
    """Elements by their sum; unchanged where it isn't positive."""
    v = v.cast("array<double>")
    return _scaled(v, _total(v))


def norm_l2(v: Column) -> Column:
    """Elements by the Euclidean norm; unchanged where it is 0."""
    v = v.cast("array<double>")
    return _scaled(v, F.sqrt(_total(F.transform(v, lambda x: x * x))))


def norm_max1(v: Column) -> Column:
    """Elements by their maximum; unchanged where it isn't positive."""
    v = v.cast("array<double>")
    return _scaled(v, F.array_max(v))


def quantize_u8(v: Column, rounding: bool = False) -> Column:
    """[0, 1] to whole numbers 0..255: the next larger one, or the nearest; values outside are clamped."""
    step = (lambda x: F.round(x * 255)) if rounding else (lambda x: F.ceil(x * 255).cast("double"))
    return F.transform(v.cast("array<double>"), lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), step(x))).cast("int"))


def rootsift(v: Column) -> Column:
    """Square roots of the elements divided by their sum."""
    return root(norm_sum1(v))


def mix(key: Column, seed: int = 0) -> Column:
    """A pseudo-random number in 0 .. 2^32-1 of a whole number, the same in every engine."""
    full = F.lit(4294967296)
    first = F.pmod(F.pmod(key.cast("long"), F.lit(1_000_003)) * 2654435761 + 1013904223 * seed, full)
    return F.pmod((F.pmod(first, F.lit(65521)) * 65497 + F.floor(first / 65521)) * 1664525, full)


def rescale_keypoints(points: Column, fx: Column | float, fy: Column | float) -> Column:
    """Keypoints (array of struct with x, y, radius, angle and more) in the coordinates of an image fx times as wide and fy times as high.

    The radius grows by the geometric mean; other fields stay.
    """
    fx, fy = F.lit(fx) if not isinstance(fx, Column) else fx, F.lit(fy) if not isinstance(fy, Column) else fy
    return F.transform(points, lambda p: p.withField("x", p["x"] * fx).withField("y", p["y"] * fy).withField("radius", p["radius"] * F.sqrt(fx * fy)))


def scale_convert(v: Column, factor: float, kind: str) -> Column:
    """Elements times factor, rounded if the target is whole, cast to kind."""
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    return F.transform(v.cast("array<double>"), lambda x: (F.round(x * factor) if whole else x * factor).cast(kind))
