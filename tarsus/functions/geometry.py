"""Boxes as column expressions: conversion, clipping, square context crops (PRJ4, PRJ5, VAL30)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_corners(box: Column) -> Column:
    """[x, y, width, height] as [left, top, right, bottom]."""
    x, y, w, h = (F.get(box, F.lit(i)) for i in range(4))
    return F.array(x, y, x + w, y + h)


def clip(box: Column, width: Column, height: Column) -> Column:
    """A corner box cut to the image; null if nothing of it lies inside."""
    x0, y0, x1, y1 = (F.get(box, F.lit(i)).cast("double") for i in range(4))
    w, h = width.cast("double"), height.cast("double")
    cut = F.array(F.greatest(x0, F.lit(0.0)), F.greatest(y0, F.lit(0.0)), F.least(x1, w), F.least(y1, h))
    return F.when((F.get(cut, F.lit(0)) < F.get(cut, F.lit(2))) & (F.get(cut, F.lit(1)) < F.get(cut, F.lit(3))), cut)


def valid_box(box: Column) -> Column:
    """Four finite numbers that span an area."""
    finite = F.forall(box, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(box) == 4) & finite & (F.get(box, F.lit(2)) > F.get(box, F.lit(0))) & (F.get(box, F.lit(3)) > F.get(box, F.lit(1))), F.lit(False))


def square_crop(box: Column, width: Column, height: Column, context: float = 1.1) -> Column:
    """struct(side, left, top, right, bottom, pad_left, pad_top, pad_right, pad_bottom): the square around a corner box.

    The side covers the box's pixels and the longer edge times the context. The square is centred on the box as far
    as it still covers it; padding is what lies outside the image.
    """
    x0, y0, x1, y1 = (F.get(box, F.lit(i)).cast("double") for i in range(4))
    pixels = F.greatest(F.ceil(x1) - F.floor(x0), F.ceil(y1) - F.floor(y0))
    side = F.greatest(F.lit(1), F.ceil(F.greatest(x1 - x0, y1 - y0) * context), pixels).cast("int")

    def origin(low: Column, high: Column) -> Column:
        centred = F.floor((low + high) / 2 - side / 2)
        return F.least(F.floor(low), F.greatest(F.ceil(high) - side, centred)).cast("int")

    left, top, zero = origin(x0, x1), origin(y0, y1), F.lit(0)
    right, bottom = left + side, top + side
    return F.struct(
        side.alias("side"), left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"),
        F.greatest(-left, zero).alias("pad_left"), F.greatest(-top, zero).alias("pad_top"),
        F.greatest(right - width.cast("int"), zero).alias("pad_right"), F.greatest(bottom - height.cast("int"), zero).alias("pad_bottom"),
    )
