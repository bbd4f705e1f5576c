"""Boxes as column expressions.

A box is four double columns. All functions are plain expressions, so they stay in generated code
and can be join predicates. Any null coordinate gives null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @staticmethod
    def named(prefix: str = "") -> Box:
        """Columns prefix + x0, y0, x1, y1."""
        return Box(*[F.col(f"{prefix}{k}") for k in ("x0", "y0", "x1", "y1")])

    @staticmethod
    def of_struct(c: Column) -> Box:
        return Box(c["x0"], c["y0"], c["x1"], c["y1"])

    @staticmethod
    def of_array(c: Column) -> Box:
        return Box(*[F.get(c, F.lit(i)) for i in range(4)])

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def center(self) -> tuple[Column, Column]:
        return (self.x0 + self.x1) / 2, (self.y0 + self.y1) / 2

    @property
    def area(self) -> Column:
        """Width times height; negative sides count as 0."""
        return _positive(self.width) * _positive(self.height)

    def struct(self) -> Column:
        return F.struct(self.x0.alias("x0"), self.y0.alias("y0"), self.x1.alias("x1"), self.y1.alias("y1"))

    def array(self) -> Column:
        return F.array(self.x0, self.y0, self.x1, self.y1)


def _zero() -> Column:
    return F.lit(0.0)


def _known(value: Column, *needed: Column) -> Column:
    """greatest and least skip nulls; a null side has to give null."""
    bad = needed[0].isNull()
    for n in needed[1:]:
        bad = bad | n.isNull()
    return F.when(~bad, value)


def _positive(value: Column) -> Column:
    return _known(F.greatest(value, _zero()), value)


def _share(part: Column, whole: Column) -> Column:
    """part / whole; 0 where whole is 0."""
    return F.when(whole == 0, _zero()).otherwise(F.try_divide(part, whole))


def x_overlap(a: Box, b: Box) -> Column:
    return _positive(_known(F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0), a.x0, a.x1, b.x0, b.x1))


def y_overlap(a: Box, b: Box) -> Column:
    return _positive(_known(F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0), a.y0, a.y1, b.y0, b.y1))


def intersection_area(a: Box, b: Box) -> Column:
    return x_overlap(a, b) * y_overlap(a, b)


def intersection(a: Box, b: Box) -> Column:
    """The common box as a struct, or null if there is none."""
    box = Box(F.greatest(a.x0, b.x0), F.greatest(a.y0, b.y0), F.least(a.x1, b.x1), F.least(a.y1, b.y1))
    return F.when((box.x0 <= box.x1) & (box.y0 <= box.y1), box.struct())


def is_in(a: Box, b: Box) -> Column:
    """a lies in b, edges included."""
    return (a.x0 >= b.x0) & (a.y0 >= b.y0) & (a.x1 <= b.x1) & (a.y1 <= b.y1)


def is_overlapping(a: Box, b: Box) -> Column:
    """Common inner points."""
    return (a.x0 < b.x1) & (a.x1 > b.x0) & (a.y0 < b.y1) & (a.y1 > b.y0)


def relative_position(a: Box, b: Box) -> Column:
    """Where b lies strictly beside a: left, right, bottom (smaller y), top."""
    return F.struct((b.x1 < a.x0).alias("left"), (a.x1 < b.x0).alias("right"), (b.y1 < a.y0).alias("bottom"), (a.y1 < b.y0).alias("top"))


def edge_distance(a: Box, b: Box) -> Column:
    """Euclidean distance of the nearest points; 0 for boxes that meet."""
    dx = _known(F.greatest(a.x0 - b.x1, b.x0 - a.x1, _zero()), a.x0, a.x1, b.x0, b.x1)
    dy = _known(F.greatest(a.y0 - b.y1, b.y0 - a.y1, _zero()), a.y0, a.y1, b.y0, b.y1)
    return F.sqrt(dx * dx + dy * dy)


def center_distance(a: Box, b: Box) -> Column:
    (ax, ay), (bx, by) = a.center, b.center
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def iou(a: Box, b: Box) -> Column:
    inter = intersection_area(a, b)
    return F.when((a.area == 0) | (b.area == 0), _zero()).otherwise(F.try_divide(inter, a.area + b.area - inter))


def overlap_of_first(a: Box, b: Box) -> Column:
    """Share of a that b covers."""
    return _share(intersection_area(a, b), a.area)


def overlap_of_smaller(a: Box, b: Box) -> Column:
    return _share(intersection_area(a, b), F.least(a.area, b.area))


def smaller_if_overlapping(a: Box, b: Box, ratio: float) -> Column:
    """The smaller box (a on a tie) where more than ratio of it is covered, else null."""
    return F.when(overlap_of_smaller(a, b) > ratio, F.when(a.area <= b.area, a.struct()).otherwise(b.struct()))


def x_overlap_of_first(a: Box, b: Box) -> Column:
    return _share(x_overlap(a, b), a.width)


def x_overlap_of_narrower(a: Box, b: Box) -> Column:
    return _share(x_overlap(a, b), F.least(a.width, b.width))


def y_overlap_of_lower(a: Box, b: Box) -> Column:
    """y-overlap in heights of the box that is less high."""
    return _share(y_overlap(a, b), F.least(a.height, b.height))


def is_same_line(a: Box, b: Box, threshold: float = 0.8) -> Column:
    return y_overlap_of_lower(a, b) > threshold


def is_same_column(a: Box, b: Box, threshold: float = 0.8) -> Column:
    return x_overlap_of_narrower(a, b) > threshold


def is_mostly_inside(small: Box, big: Box, threshold: float = 0.8) -> Column:
    return intersection_area(small, big) >= threshold * small.area


def contains_point(box: Box, x: Column, y: Column) -> Column:
    return (box.x0 <= x) & (x <= box.x1) & (box.y0 <= y) & (y <= box.y1)


def union_box(a: Box, b: Box) -> Column:
    """Smallest box of whole numbers around both."""
    return F.struct(
        F.floor(F.least(a.x0, b.x0)).cast("double").alias("x0"), F.floor(F.least(a.y0, b.y0)).cast("double").alias("y0"), F.ceil(F.greatest(a.x1, b.x1)).cast("double").alias("x1"), F.ceil(F.greatest(a.y1, b.y1)).cast("double").alias("y1")
    )


def vertical_gap(a: Box, b: Box) -> Column:
    """struct(top, bottom) of the space between two boxes one above the other, null if they share a height."""
    return F.when(a.y1 <= b.y0, F.struct(a.y1.alias("top"), b.y0.alias("bottom"))).when(b.y1 <= a.y0, F.struct(b.y1.alias("top"), a.y0.alias("bottom")))


def meets_gap(box: Box, gap: Column) -> Column:
    return (box.y1 > gap["top"]) & (box.y0 < gap["bottom"])


def to_grid(box: Box, page_width: Column, page_height: Column, size: int = 1000) -> Column:
    """Whole coordinates on a size x size grid, cut off towards 0; array<int>."""
    cell = lambda v, whole: (v * size / whole).cast("int")
    return F.array(cell(box.x0, page_width), cell(box.y0, page_height), cell(box.x1, page_width), cell(box.y1, page_height))


def to_unit(box: Box, page_width: Column, page_height: Column) -> Column:
    """Coordinates as shares of the page, held within it, three places; a box of values up to 1 is one already."""
    own = _known(F.greatest(box.x0, box.y0, box.x1, box.y1), box.x0, box.y0, box.x1, box.y1) <= 1
    part = lambda v, whole: F.bround(F.least(F.greatest(F.when(own, v).otherwise(F.try_divide(v, whole)), _zero()), F.lit(1.0)), 3)
    return F.array(part(box.x0, page_width), part(box.y0, page_height), part(box.x1, page_width), part(box.y1, page_height))


def relative_box(child: Box, parent: Box) -> Column:
    """Child coordinates as shares of the parent box, held within it, three places."""
    part = lambda v, low, whole: F.bround(F.least(F.greatest(_share(v - low, whole), _zero()), F.lit(1.0)), 3)
    return F.array(
        part(child.x0, parent.x0, parent.width), part(child.y0, parent.y0, parent.height), part(child.x1, parent.x0, parent.width), part(child.y1, parent.y0, parent.height)
    )


def to_page(box: Box, page_width: Column, page_height: Column) -> Column:
    """A box of shares in whole page units, corners put right."""
    x = [(v * page_width).cast("int") for v in (box.x0, box.x1)]
    y = [(v * page_height).cast("int") for v in (box.y0, box.y1)]
    return F.array(F.least(*x), F.least(*y), F.greatest(*x), F.greatest(*y))


def whole_box(box: Box, page_width: Column, page_height: Column) -> Column:
    """Smallest box of whole numbers around box, held within the page; null if nothing is left."""
    x0, y0 = F.greatest(F.floor(box.x0), F.lit(0)), F.greatest(F.floor(box.y0), F.lit(0))
    x1, y1 = F.least(F.ceil(box.x1), page_width), F.least(F.ceil(box.y1), page_height)
    return F.when((x0 < x1) & (y0 < y1), F.array(*[v.cast("int") for v in (x0, y0, x1, y1)]))


def scaled_box(box: Box, scale_x: Column, scale_y: Column) -> Column:
    """Detection units to page units, cut off towards 0."""
    return F.array(*[(v / s).cast("int") for v, s in ((box.x0, scale_x), (box.y0, scale_y), (box.x1, scale_x), (box.y1, scale_y))])


def is_crop(box: Box) -> Column:
    return (box.x0 < box.x1) & (box.y0 < box.y1)


def corners(box: Box) -> Column:
    """The four corners, clockwise from the upper left, as array<array<double>>."""
    return F.array(F.array(box.x0, box.y0), F.array(box.x1, box.y0), F.array(box.x1, box.y1), F.array(box.x0, box.y1))


def box_of_corners(points: Column) -> Column:
    """array(x0, y0, x1, y1) from the first three corners."""
    at = lambda i, k: F.get(F.get(points, F.lit(i)), F.lit(k))
    return F.array(at(0, 0), at(0, 1), at(1, 0), at(2, 1))


def is_aligned(points: Column) -> Column:
    """Exactly two distinct x and two distinct y."""
    kinds = lambda k: F.size(F.array_distinct(F.transform(points, lambda p: F.get(p, F.lit(k)))))
    return (kinds(0) == 2) & (kinds(1) == 2)


def is_skewed(points: Column) -> Column:
    """The third corner's height over the second isn't within a fifth of the mean side height."""
    y = lambda i: F.get(F.get(points, F.lit(i)), F.lit(1))
    height = ((y(3) - y(0)) + (y(2) - y(1))) / 2
    return ~((height * 0.8 <= y(2) - y(0)) & (y(2) - y(0) <= height * 1.2))


def hull(boxes: Column) -> Column:
    """Extent of an array of box structs."""
    low = lambda k: F.array_min(F.transform(boxes, lambda b: b[k]))
    high = lambda k: F.array_max(F.transform(boxes, lambda b: b[k]))
    return F.struct(low("x0").alias("x0"), low("y0").alias("y0"), high("x1").alias("x1"), high("y1").alias("y1"))
