"""Boxes [x0, y0, x1, y1] and page annotations [page, x0, y0, x1, y1]."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def upright(box: Column) -> Column:
    """With y0 <= y1; boxes of other than four numbers become null."""
    x0, y0, x1, y1 = (F.get(box, i) for i in range(4))
    return F.when(F.size(box) == 4, F.array(x0, F.least(y0, y1), x1, F.greatest(y0, y1)))


def centre_inside(box: Column, outer: Column) -> Column:
    cx, cy = (F.get(box, 0) + F.get(box, 2)) / 2, (F.get(box, 1) + F.get(box, 3)) / 2
    return (cx >= F.get(outer, 0)) & (cx <= F.get(outer, 2)) & (cy >= F.get(outer, 1)) & (cy <= F.get(outer, 3))


def page_of(boxes: Column, fallback: Column) -> Column:
    """Page of the first annotation, else the 0-based fallback plus one."""
    return F.coalesce(F.get(F.get(boxes, 0), 0).cast("int"), fallback + 1)


#: Height of a page, and how far above the middle line a line of the same page may begin.
PAGE_HEIGHT, ABOVE = 841, 50


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is computed once however often it is used: functions of arrays are repeated otherwise."""
    return F.get(F.transform(F.array(value), then), 0)


def union_of(boxes: Column) -> Column:
    """The box around all boxes of four numbers or more; null without one."""
    side = lambda whole, f, i: f(F.transform(whole, lambda b: F.get(b, F.lit(i))))
    around = lambda whole: F.when(F.size(whole) > 0, F.array(side(whole, F.array_min, 0), side(whole, F.array_min, 1), side(whole, F.array_max, 2), side(whole, F.array_max, 3)))
    return _once(F.filter(boxes, lambda b: F.size(b) >= 4), around)


def lines_box(lines: Column, block: Column) -> Column:
    """The box around a block's lines (array<struct<bbox, spans array<struct<cross_page>>>>) that are on its own page.

    Lines with a span marked as of the next page don't count, unless all are. Without such marks a block whose own box is
    no higher than a page counts whole; in a higher one lines that begin far above the middle one are on the next page.
    Null without a line with a box."""
    top = lambda l: F.get(l["bbox"], F.lit(1))
    crosses = lambda l: F.coalesce(F.exists(l["spans"], lambda s: F.coalesce(s["cross_page"], F.lit(False))), F.lit(False))
    fits = _once(block, lambda b: (F.size(b) >= 4) & (F.get(b, F.lit(3)) - F.get(b, F.lit(1)) <= PAGE_HEIGHT))
    middle = lambda boxed: _once(F.array_sort(F.transform(boxed, top)), lambda tops: F.get(tops, F.floor(F.size(tops) / 2).cast("int")))
    low = lambda boxed: _once(middle(boxed), lambda m: F.filter(boxed, lambda l: top(l) >= m - ABOVE))
    unmarked = lambda boxed: F.when(fits, boxed).otherwise(low(boxed))
    here = lambda boxed: _once(F.filter(boxed, lambda l: ~crosses(l)), lambda h: F.when(F.size(h) > 0, h).otherwise(unmarked(boxed)))
    own = _once(F.filter(lines, lambda l: F.size(l["bbox"]) >= 4), lambda boxed: F.when(F.exists(lines, crosses), here(boxed)).otherwise(unmarked(boxed)))
    return union_of(F.transform(own, lambda l: l["bbox"]))
