"""How many levels and siblings a viewport holds, and how a tree's two sides share them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pixels of a level, of a sibling, of the margin.
LEVEL, SIBLING, MARGIN = 130, 78, 160


def _within(n: int, low: int, high: int) -> int:
    return min(high, max(low, n))


@dataclass(frozen=True)
class Capacity:
    orientation: str
    depth_slots: int
    breadth_slots: int
    max_nodes: int


@dataclass(frozen=True)
class Sides:
    ancestor_depth: int
    descendant_depth: int
    ancestor_fanout: int
    root_fanout: int
    branch_fanout: int


def capacity(width: float, height: float) -> Capacity:
    upright = height > width
    along, across = (height, width) if upright else (width, height)
    depth = _within(math.floor(max(along - MARGIN, 200) / LEVEL), 2, 7)
    breadth = _within(math.floor(max(across - MARGIN, 120) / SIBLING), 3, 14)
    return Capacity("vertical" if upright else "horizontal", depth, breadth, _within(depth * min(breadth, 8), 8, 48))


def sides(room: Capacity, up: int, down: int) -> Sides:
    """Shares the levels between up ancestor hops and down descendant hops that are there."""
    levels, wide = room.depth_slots - 1, room.breadth_slots
    fanout = wide
    if down <= 0:
        above, below = min(levels, up), 0
    elif down >= 3:  # a deep tree below leaves room for the nearest parent only
        above = min(1, up)
        below, fanout = min(levels - above, down), 1
    elif up <= 0:
        above, below = 0, min(levels, down)
    elif levels < 2:
        above, below = 0, min(1, down)
        fanout = 0
    else:
        share = math.floor(levels * up / (up + down) + 0.5)
        above = _within(share, 1, min(up, levels - 1))
        below = min(levels - above, down)
        above += min(levels - above - below, up - above)
        fanout = min(wide, 3)
    return Sides(above, below, max(fanout, 1 if above else 0), wide, max(2, math.ceil(wide / 2)))


# The same as expressions, for viewports in rows.


def _clamped(c: Column, low: int, high: int) -> Column:
    return F.least(F.lit(high), F.greatest(c, F.lit(low)))


def _int(c: Column) -> Column:
    return c.cast("int")


def capacity_of(width: Column, height: Column) -> Column:
    """capacity as a struct."""
    slots = lambda length, least, each: _int(F.floor(F.greatest(length - MARGIN, F.lit(least)) / each))
    depth = _clamped(slots(F.greatest(width, height), 200, LEVEL), 2, 7)
    breadth = _clamped(slots(F.least(width, height), 120, SIBLING), 3, 14)
    nodes = _clamped(depth * F.least(breadth, F.lit(8)), 8, 48)
    return F.struct(F.when(height > width, "vertical").otherwise("horizontal").alias("orientation"), depth.alias("depth_slots"), breadth.alias("breadth_slots"), nodes.alias("max_nodes"))


def sides_of(depth_slots: Column, breadth_slots: Column, up: Column, down: Column) -> Column:
    """sides as a struct."""
    levels, wide, none = depth_slots - 1, breadth_slots, F.lit(0)
    share = _int(F.floor(levels * up / F.greatest(up + down, F.lit(1)) + 0.5))
    by_case = lambda none_below, deep, none_above, tight, shared: F.when(down <= 0, none_below).when(down >= 3, deep).when(up <= 0, none_above).when(levels < 2, tight).otherwise(shared)
    above = by_case(F.least(levels, up), F.least(F.lit(1), up), none, none, F.least(F.greatest(share, F.lit(1)), up, levels - 1))
    below = by_case(none, F.least(levels - above, down), F.least(levels, down), F.least(F.lit(1), down), F.least(levels - above, down))
    rest = by_case(none, none, none, none, F.least(levels - above - below, up - above))
    fanout = by_case(wide, F.lit(1), wide, none, F.least(wide, F.lit(3)))
    ancestors = above + rest
    return F.struct(ancestors.alias("ancestor_depth"), below.alias("descendant_depth"), F.greatest(fanout, F.when(ancestors > 0, 1).otherwise(0)).alias("ancestor_fanout"),
                    wide.alias("root_fanout"), F.greatest(F.lit(2), _int(F.ceil(wide / 2))).alias("branch_fanout"))
