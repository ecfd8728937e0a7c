"""Pixel, box and tile expressions. ``pix = y * width + x``; boxes are structs ``x, y, w, h``; -1 is "no pixel"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Steps (dx, dy) clockwise from up.
FOUR = ((0, -1), (1, 0), (0, 1), (-1, 0))
EIGHT = ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))


def x_of(pix: Column, width: int) -> Column:
    return (pix % width).cast("int")


def y_of(pix: Column, width: int) -> Column:
    return F.floor(pix / width).cast("int")


def neighbours(pix: Column, width: int, height: int, steps=FOUR) -> Column:
    """Array of the neighbouring pixels in the order of ``steps``; -1 outside the image."""
    x, y = pix % width, F.floor(pix / width)

    def one(dx: int, dy: int) -> Column:
        inside = F.lit(True)
        if dx:
            inside &= (x < width - 1) if dx > 0 else (x > 0)
        if dy:
            inside &= (y < height - 1) if dy > 0 else (y > 0)
        return F.when(inside, pix + dy * width + dx).otherwise(F.lit(-1)).cast("long")

    return F.array(*[one(dx, dy) for dx, dy in steps])


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), w.cast("int").alias("w"), h.cast("int").alias("h"))


def merged_box(a: Column, b: Column) -> Column:
    """The hull of two boxes."""
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return box(x, y, F.greatest(a["x"] + a["w"], b["x"] + b["w"]) - x, F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - y)


def box_inside(b: Column, low_x, low_y, high_x, high_y) -> Column:
    """All pixels of the box are within the inclusive bounds."""
    return (b["x"] >= low_x) & (b["y"] >= low_y) & (b["x"] + b["w"] - 1 <= high_x) & (b["y"] + b["h"] - 1 <= high_y)


def box_strictly_inside(b: Column, low_x, low_y, high_x, high_y) -> Column:
    """No pixel of the box is on or beyond the bounds."""
    return (b["x"] > low_x) & (b["y"] > low_y) & (b["x"] + b["w"] - 1 < high_x) & (b["y"] + b["h"] - 1 < high_y)


def box_outside(b: Column, low_x, low_y, high_x, high_y) -> Column:
    """No pixel of the box is within the inclusive bounds."""
    return (b["x"] > high_x) | (b["y"] > high_y) | (b["x"] + b["w"] - 1 < low_x) | (b["y"] + b["h"] - 1 < low_y)


def tile_to_image_pixel(local: Column, tile_width, x0, y0, width: int) -> Column:
    """The image pixel of a pixel numbered inside a tile."""
    return ((F.floor(local / tile_width) + y0) * width + local % tile_width + x0).cast("long")


def tile_to_image_box(b: Column, x0, y0) -> Column:
    return box(b["x"] + x0, b["y"] + y0, b["w"], b["h"])


def in_tile(x: Column, y: Column, tile: dict[str, Column]) -> Column:
    return (x >= tile["x0"]) & (x < tile["x0"] + tile["w"]) & (y >= tile["y0"]) & (y < tile["y0"] + tile["h"])


def at_tile_border(x: Column, y: Column, tile: dict[str, Column], width: int, height: int) -> Column:
    """Inside the tile and on one of its sides that isn't a side of the image."""
    left = (tile["x0"] > 0) & (x == tile["x0"])
    top = (tile["y0"] > 0) & (y == tile["y0"])
    right = (tile["x0"] + tile["w"] < width) & (x == tile["x0"] + tile["w"] - 1)
    bottom = (tile["y0"] + tile["h"] < height) & (y == tile["y0"] + tile["h"] - 1)
    return in_tile(x, y, tile) & (left | top | right | bottom)


def on_lines(x: Column, y: Column, columns, rows) -> Column:
    """On one of the given columns or rows."""
    return x.isin(*columns) | y.isin(*rows)


def almost_equal(a: Column, b: Column, epsilon: float) -> Column:
    return F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * epsilon
