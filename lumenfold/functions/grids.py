"""Measures of small luminance grids held in an array column (row by row); all inside the JVM, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_gray(values: Column) -> Column:
    """Array of numbers to integers 0..255, scaled from its own minimum and maximum (all equal: 0)."""
    lo, hi = F.array_min(values).cast("double"), F.array_max(values).cast("double")
    return F.transform(values, lambda x: F.when(hi == lo, F.lit(0)).otherwise(F.floor((x.cast("double") - lo) / (hi - lo) * 255).cast("int")))


def _inner(width: int, height: int) -> Column:
    """1-based positions of the inner cells."""
    return F.array(*[F.lit(y * width + x + 1) for y in range(1, height - 1) for x in range(1, width - 1)])


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def _at(g: Column, i: Column) -> Column:
    return F.element_at(g, i.cast("int")).cast("double")


def sharpness(g: Column, width: int = 8, height: int = 8) -> Column:
    def one(i: Column) -> Column:
        return F.abs(_at(g, i) * 4 - _at(g, i - 1) - _at(g, i + 1) - _at(g, i - width) - _at(g, i + width))

    return F.least(_mean(F.transform(_inner(width, height), one)) / 100, F.lit(1.0))


def exposure(g: Column) -> Column:
    light = F.transform(g, lambda x: x / F.lit(255.0))
    share = lambda f: F.size(F.filter(light, f)) / F.size(g)
    dark, bright = share(lambda x: x < 0.1), share(lambda x: x > 0.9)
    e = _mean(light) - F.when(dark > 0.3, (dark - 0.3) * 0.5).otherwise(0.0) + F.when(bright > 0.3, (bright - 0.3) * 0.5).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), e))


def contrast(g: Column) -> Column:
    light = F.transform(g, lambda x: x / F.lit(255.0))
    m, m2 = _mean(light), _mean(F.transform(light, lambda x: x * x))
    return F.least(F.sqrt(F.greatest(F.lit(0.0), m2 - m * m)) / 0.4, F.lit(1.0))


def noise(g: Column, width: int = 8, height: int = 8) -> Column:
    """Mean deviation of the eight neighbours where the cell is close to their mean; 0.5 where none is."""
    around = [-width - 1, -width, -width + 1, -1, 1, width - 1, width, width + 1]

    def one(i: Column) -> Column:
        near = F.array(*[_at(g, i + d) for d in around])
        mean, sq = _mean(near), _mean(F.transform(near, lambda x: x * x))
        return F.when(F.abs(_at(g, i) - mean) < 10, F.sqrt(F.greatest(F.lit(0.0), sq - mean * mean)))

    smooth = F.array_compact(F.transform(_inner(width, height), one))
    return F.when(F.size(smooth) == 0, F.lit(0.5)).otherwise(F.least(_mean(smooth) / 50, F.lit(1.0)))


def edges(g: Column, width: int = 8, height: int = 8) -> Column:
    """struct of the shares of strong, medium and weak edges among all cells."""

    def one(i: Column) -> Column:
        p = lambda dx, dy: _at(g, i + dx + dy * width)
        gx = p(1, -1) + p(1, 0) * 2 + p(1, 1) - p(-1, -1) - p(-1, 0) * 2 - p(-1, 1)
        gy = p(-1, 1) + p(0, 1) * 2 + p(1, 1) - p(-1, -1) - p(0, -1) * 2 - p(1, -1)
        return F.sqrt(gx * gx + gy * gy)

    m = F.transform(_inner(width, height), one)
    share = lambda lo, hi: (F.size(F.filter(m, lambda x: (x > lo) & (x <= hi))) / F.size(g))
    return F.struct(share(50, 1e9).alias("strong"), share(20, 50).alias("medium"), share(5, 20).alias("weak"))


def histogram(g: Column, bins: int = 16) -> Column:
    """Shares of the cells by bin of value."""
    b = F.transform(g, lambda x: F.floor(x / F.lit(255.0) * (bins - 1)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.size(F.filter(b, lambda x: x == k)) / F.size(g))


def moments(g: Column, width: int = 8) -> Column:
    """struct<mass, cx, cy, hu1, hu2>; zeros for an empty mass."""
    cells = F.transform(g, lambda v, i: F.struct((v / F.lit(255.0)).alias("v"), (i % width).cast("double").alias("x"), F.floor(i / width).cast("double").alias("y")))
    s = lambda f: F.aggregate(F.transform(cells, f), F.lit(0.0), lambda a, x: a + x)
    m00, m10, m01 = s(lambda c: c.v), s(lambda c: c.x * c.v), s(lambda c: c.y * c.v)
    m11, m20, m02 = s(lambda c: c.x * c.y * c.v), s(lambda c: c.x * c.x * c.v), s(lambda c: c.y * c.y * c.v)
    z = lambda v: F.when(m00 == 0, F.lit(0.0)).otherwise(v)
    a20, a02, a11 = m20 - m10 * m10 / m00, m02 - m01 * m01 / m00, m11 - m10 * m01 / m00
    return F.struct(m00.alias("mass"), z(m10 / m00).alias("cx"), z(m01 / m00).alias("cy"), z(a20 + a02).alias("hu1"), z((a20 - a02) * (a20 - a02) + a11 * a11 * 4).alias("hu2"))
