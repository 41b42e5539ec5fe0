"""Box algebra as column expressions. A box is four columns `x0, y0, x1, y1` (pixels, y downwards)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def area(self) -> Column:
        zero = F.lit(0)
        return F.greatest(zero, self.width) * F.greatest(zero, self.height)

    @property
    def cx(self) -> Column:
        return (self.x0 + self.x1) / 2

    @property
    def cy(self) -> Column:
        return (self.y0 + self.y1) / 2

    @property
    def is_positive(self) -> Column:
        return (self.width > 0) & (self.height > 0)

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + n) for n, c in zip(self._fields, self)]

    def struct(self) -> Column:
        return F.struct(*self.columns())


def box(prefix: str = "", suffix: str = "", of: Column | None = None) -> Box:
    """The box held in columns `<prefix>x0<suffix>` …, or in the fields of a struct column."""
    if of is not None:
        return Box(*(of[n] for n in Box._fields))
    return Box(*(F.col(f"{prefix}{n}{suffix}") for n in Box._fields))


def rounded_center(b: Box) -> tuple[Column, Column]:
    """Integer center with ties to even."""
    return F.bround(b.cx, 0).cast("long"), F.bround(b.cy, 0).cast("long")


def intersection(a: Box, b: Box) -> Box:
    """Common part; not positive when the boxes do not overlap."""
    return Box(F.greatest(a.x0, b.x0), F.greatest(a.y0, b.y0), F.least(a.x1, b.x1), F.least(a.y1, b.y1))


def intersection_area(a: Box, b: Box) -> Column:
    return intersection(a, b).area


def union_box(a: Box, b: Box) -> Box:
    return Box(F.least(a.x0, b.x0), F.least(a.y0, b.y0), F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 when the union is empty."""
    inter = intersection_area(a, b)
    union = a.area + b.area - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def is_finite(value: Column) -> Column:
    value = value.cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def sequence_issue(values: Column, size: int = 4) -> Column:
    """NULL for a valid coordinate array, otherwise `field_count` or `non_finite`."""
    return (
        F.when(values.isNull() | (F.size(values) != size), F.lit("field_count"))
        .when(~F.forall(values, is_finite), F.lit("non_finite"))
    )


def from_array(values: Column) -> Box:
    return Box(*(F.get(values, F.lit(i)).cast("double") for i in range(4)))


def clip(b: Box, width: Column, height: Column, tolerance: float = 1e-9) -> tuple[Box, Column]:
    """Box clipped to the image and a flag telling whether clipping moved an edge."""
    zero = F.lit(0)
    clipped = Box(F.greatest(b.x0, zero), F.greatest(b.y0, zero), F.least(b.x1, width), F.least(b.y1, height))
    moved = F.lit(False)
    for before, after in zip(b, clipped):
        moved = moved | (F.abs(before - after) > tolerance)
    return clipped, moved


def expand_min_height(b: Box, minimum: Column | float, image_height: Column | float) -> tuple[Box, Column]:
    """Grow a thin box to `minimum` around its center, shifted back inside the image."""
    minimum = minimum if isinstance(minimum, Column) else F.lit(minimum)
    limit = image_height if isinstance(image_height, Column) else F.lit(image_height)
    needed = (minimum > 0) & (b.height < minimum)
    wanted = F.least(minimum, limit)
    top = F.greatest(F.lit(0.0), F.least(b.cy - wanted / 2, limit - wanted))
    return (
        Box(b.x0, F.when(needed, top).otherwise(b.y0), b.x1, F.when(needed, top + wanted).otherwise(b.y1)),
        needed,
    )


def normalize(b: Box, size: Column | int, tolerance: float = 1e-9) -> tuple[list[Column], Column]:
    """Center form scaled to the tile and clamped to [0, 1], with a flag for values out of range."""
    size = size if isinstance(size, Column) else F.lit(size)
    raw = [b.cx / size, b.cy / size, b.width / size, b.height / size]
    bad = ~b.is_positive
    for value in raw:
        bad = bad | (value < -tolerance) | (value > 1 + tolerance)
    return [F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)) for v in raw], bad


def denormalize(cx: Column, cy: Column, w: Column, h: Column, size: Column | int) -> Box:
    size = size if isinstance(size, Column) else F.lit(size)
    return Box(cx * size - w * size / 2, cy * size - h * size / 2, cx * size + w * size / 2, cy * size + h * size / 2)


def scale(b: Box, sx: Column | float, sy: Column | float) -> Box:
    return Box(b.x0 * sx, b.y0 * sy, b.x1 * sx, b.y1 * sy)


def to_page(b: Box, tile_x: Column, tile_y: Column, width: Column, height: Column) -> Box:
    """Tile coordinates to page coordinates, clamped to the page."""
    def clamp(value: Column, top: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(value, top))

    return Box(clamp(b.x0 + tile_x, width), clamp(b.y0 + tile_y, height),
               clamp(b.x1 + tile_x, width), clamp(b.y1 + tile_y, height))


def values_close(left: Column, right: Column, tolerance: float = 1e-7) -> Column:
    """Same length and every pair of values within `tolerance`."""
    return (F.size(left) == F.size(right)) & F.forall(
        F.zip_with(left, right, lambda a, b: F.abs(a - b) <= tolerance), lambda ok: F.coalesce(ok, F.lit(False)))


def size_bucket(area: Column) -> Column:
    return (F.when(area < 64, "tiny_lt_64px2").when(area < 256, "small_64_to_255px2")
            .otherwise("medium_ge_256px2"))
