"""Boxes as structs of four doubles, with their corners in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def box(x0, y0, x1, y1) -> Column:
    a, b, c, d = (F.lit(v).cast("double") if not isinstance(v, Column) else v.cast("double") for v in (x0, y0, x1, y1))
    return F.struct(F.least(a, c).alias("x0"), F.least(b, d).alias("y0"), F.greatest(a, c).alias("x1"), F.greatest(b, d).alias("y1"))


def from_xywh(x, y, w, h) -> Column:
    return box(x, y, x + w, y + h)


def from_points(points: Column) -> Column:
    """The box around an array of points (x, y)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def center(b: Column) -> Column:
    return F.struct(((b["x0"] + b["x1"]) / 2).alias("x"), ((b["y0"] + b["y1"]) / 2).alias("y"))


def is_empty(b: Column) -> Column:
    return (width(b) <= 0) | (height(b) <= 0)


def translate(b: Column, dx, dy) -> Column:
    return box(b["x0"] + dx, b["y0"] + dy, b["x1"] + dx, b["y1"] + dy)


def scale(b: Column, sx, sy=None) -> Column:
    sy = sx if sy is None else sy
    return box(b["x0"] * sx, b["y0"] * sy, b["x1"] * sx, b["y1"] * sy)


def pad(b: Column, by) -> Column:
    return box(b["x0"] - by, b["y0"] - by, b["x1"] + by, b["y1"] + by)


def clip(b: Column, x0, y0, x1, y1) -> Column:
    low, high = lambda v, a: F.greatest(v, F.lit(a) if not isinstance(a, Column) else a), lambda v, a: F.least(v, F.lit(a) if not isinstance(a, Column) else a)
    x0, y0, x1, y1 = (v.cast("double") if isinstance(v, Column) else float(v) for v in (x0, y0, x1, y1))
    return box(high(low(b["x0"], x0), x1), high(low(b["y0"], y0), y1), high(low(b["x1"], x0), x1), high(low(b["y1"], y0), y1))


def normalized(b: Column, w: Column, h: Column) -> Column:
    """In units of a page; a size that is not positive is an error."""
    bad = F.raise_error(F.lit("page sizes must be positive")).cast(BOX)
    return F.when((w > 0) & (h > 0), box(b["x0"] / w, b["y0"] / h, b["x1"] / w, b["y1"] / h)).otherwise(bad)


def union(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"))


def intersects(a: Column, b: Column) -> Column:
    """Boxes that only touch do not intersect."""
    return (F.greatest(a["x0"], b["x0"]) < F.least(a["x1"], b["x1"])) & (F.greatest(a["y0"], b["y0"]) < F.least(a["y1"], b["y1"]))


def intersection(a: Column, b: Column) -> Column:
    both = F.struct(F.greatest(a["x0"], b["x0"]).alias("x0"), F.greatest(a["y0"], b["y0"]).alias("y0"), F.least(a["x1"], b["x1"]).alias("x1"), F.least(a["y1"], b["y1"]).alias("y1"))
    return F.when(intersects(a, b), both)


def iou(a: Column, b: Column) -> Column:
    shared = F.coalesce(area(intersection(a, b)), F.lit(0.0))
    total = area(a) + area(b) - shared
    return F.when((shared > 0) & (total > 0), shared / total).otherwise(0.0)


def contains(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x0"]) & (a["y0"] <= b["y0"]) & (a["x1"] >= b["x1"]) & (a["y1"] >= b["y1"])


def as_int(b: Column) -> Column:
    return F.array(F.floor(b["x0"]), F.floor(b["y0"]), F.ceil(b["x1"]), F.ceil(b["y1"]))


def as_xywh(b: Column) -> Column:
    return F.array(b["x0"], b["y0"], width(b), height(b))


def polygon(b: Column) -> Column:
    """Corners clockwise from the top left, flat."""
    return F.array(b["x0"], b["y0"], b["x1"], b["y0"], b["x1"], b["y1"], b["x0"], b["y1"])
