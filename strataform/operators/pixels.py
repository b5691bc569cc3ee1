"""Projection to the x-y plane: bounding boxes, sparse pixel images, neighbour masks and thinning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: neighbours 0..7 as (row, column) offsets, rows growing down
NEIGHBOURS = ((0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1))


def bounding_box(points: DataFrame) -> DataFrame:
    """cloud_id, n, min_x, max_x, min_y, max_y."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    return points.groupBy("cloud_id").agg(F.count("*").alias("n"), F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y"))


def image(boxes: DataFrame, size: float) -> DataFrame:
    """cloud_id, min_x, min_y, width, height."""
    width, height = (F.ceil((F.col(f"max_{c}") - F.col(f"min_{c}")) / size).cast("bigint") for c in "xy")
    return boxes.select("cloud_id", "min_x", "min_y", width.alias("width"), height.alias("height"))


def pixelize(points: DataFrame, images: DataFrame, size: float, threshold: int = 1) -> DataFrame:
    """Occupied pixels: cloud_id, row, col, n, x, y (centroid), value. Points on the far edge are left out.

    One row an image joins the points: the planner broadcasts it while it is small.
    """
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    placed = points.join(images, "cloud_id").withColumns({"col": F.floor((x - F.col("min_x")) / size).cast("bigint"), "row": F.floor((y - F.col("min_y")) / size).cast("bigint")})
    inside = placed.filter("col < width AND row < height")
    return inside.groupBy("cloud_id", "row", "col").agg(F.count("*").alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y")).withColumn("value", F.col("n") >= threshold)


def neighbour_masks(foreground: DataFrame) -> DataFrame:
    """Foreground pixels with the bit mask of their foreground neighbours."""
    bits = F.explode(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc"), F.lit(1 << k).alias("bit")) for k, (r, c) in enumerate(NEIGHBOURS)] + [F.struct(F.lit(0).alias("dr"), F.lit(0).alias("dc"), F.lit(256).alias("bit"))]))
    # each pixel tells those it is a neighbour of; bit 8 marks the pixel itself
    told = foreground.select("cloud_id", "row", "col", bits.alias("b")).select("cloud_id", (F.col("row") - F.col("b.dr")).alias("row"), (F.col("col") - F.col("b.dc")).alias("col"), "b.bit")
    return told.groupBy("cloud_id", "row", "col").agg(F.sum("bit").alias("mask")).filter("mask >= 256").withColumn("mask", F.col("mask") - 256)


def removable(first: bool) -> list[bool]:
    """For each neighbour mask: whether a thinning pass removes the pixel.

    One crossing, two or three neighbour pairs, and the directional condition of the pass.
    """
    out = []
    for mask in range(256):
        e, ne, n, nw, w, sw, s, se = nb = [bool(mask >> k & 1) for k in range(8)]
        ring = nb + nb[:1]
        crossings = sum(not ring[2 * k] and (ring[2 * k + 1] or ring[2 * k + 2]) for k in range(4))
        pairs = min(sum(ring[2 * k] or ring[2 * k + 1] for k in range(4)), sum(ring[2 * k + 1] or ring[2 * k + 2] for k in range(4)))
        open_side = not ((ne or n or not se) and e) if first else not ((sw or s or not nw) and w)
        out.append(crossings == 1 and 2 <= pairs <= 3 and open_side)
    return out


def thin_once(foreground: DataFrame, images: DataFrame, first: bool = True) -> DataFrame:
    """Foreground after one pass, decided on the frozen image; border pixels stay."""
    table = F.array(*map(F.lit, removable(first)))
    masks = neighbour_masks(foreground).join(images.select("cloud_id", "width", "height"), "cloud_id")
    inner = (F.col("row") >= 1) & (F.col("row") <= F.col("height") - 2) & (F.col("col") >= 1) & (F.col("col") <= F.col("width") - 2)
    return masks.filter(~(inner & F.element_at(table, (F.col("mask") + 1).cast("int")))).select("cloud_id", "row", "col")


def thin_pixels(row: np.ndarray, col: np.ndarray, height: int, width: int) -> np.ndarray:
    """Which pixels stay after both passes in turn until nothing changes; memory follows the pixels, not the image."""
    key = row.astype(np.int64) * (width + 2) + col + 1  # a column to spare on both sides, so that rows do not touch
    order = np.argsort(key)
    key, stay = key[order], np.ones(len(key), bool)
    inner = ((row >= 1) & (row <= height - 2) & (col >= 1) & (col <= width - 2))[order]
    tables = [np.array(removable(first)) for first in (True, False)]
    # place of each pixel's neighbours among all pixels; the last place stands for none
    places = []
    for r, c in NEIGHBOURS:
        want = key + r * (width + 2) + c
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        places.append(np.where(key[at] == want, at, len(key)))
    changed = len(key) > 0
    while changed:
        changed = False
        for table in tables:
            here = np.append(stay, False)
            mask = sum(here[at].astype(np.int64) << k for k, at in enumerate(places))
            gone = stay & inner & table[mask]
            changed |= bool(gone.any())
            stay &= ~gone
    out = np.empty(len(stay), bool)
    out[order] = stay
    return out


def thin_image(image: np.ndarray) -> np.ndarray:
    """The same on a dense image."""
    row, col = np.nonzero(image)
    stay = thin_pixels(row, col, *image.shape)
    out = np.zeros_like(image)
    out[row[stay], col[stay]] = True
    return out


def thin(foreground: DataFrame, images: DataFrame) -> DataFrame:
    """Foreground thinned to its skeleton; one group is the foreground of one image."""

    def run(group):
        stay = thin_pixels(group["row"].to_numpy(), group["col"].to_numpy(), int(group["height"].iloc[0]), int(group["width"].iloc[0]))
        return group.loc[stay, ["cloud_id", "row", "col"]]

    joined = foreground.select("cloud_id", "row", "col").join(images.select("cloud_id", "width", "height"), "cloud_id")
    return joined.groupBy("cloud_id").applyInPandas(run, "cloud_id string, row bigint, col bigint")
