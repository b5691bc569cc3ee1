"""From matches to a rigid transform: 2D fit, inliers, nearest voxels and the vertical offset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rigid2d(matches: DataFrame, *keys: str) -> DataFrame:
    """Least-squares turn and shift from (sx, sy) to (tx, ty): keys, n, yaw, dx, dy; from sums only.

    A column ``w`` weighs the matches if there is one.
    """
    w = F.col("w") if "w" in matches.columns else F.lit(1.0)
    mean = lambda c: (F.sum(w * F.col(c)) / F.sum(w)).alias(f"m{c}")
    product = lambda a, b: (F.sum(w * F.col(a) * F.col(b)) / F.sum(w)).alias(f"{a}{b}")
    sums = matches.groupBy(*keys).agg(F.count("*").alias("n"), *map(mean, ("sx", "sy", "tx", "ty")), *(product(a, b) for a in ("sx", "sy") for b in ("tx", "ty")))
    cross = F.expr("(sxty - msx * mty) - (sytx - msy * mtx)")
    dot = F.expr("(sxtx - msx * mtx) + (syty - msy * mty)")
    turned = sums.withColumn("yaw", F.atan2(cross, dot))
    return turned.select(*keys, "n", "yaw", F.expr("mtx - (cos(yaw) * msx - sin(yaw) * msy)").alias("dx"), F.expr("mty - (sin(yaw) * msx + cos(yaw) * msy)").alias("dy"))


def moved2d(points: DataFrame) -> DataFrame:
    """Points with x, y under their row's yaw, dx, dy."""
    return points.withColumns({"x": F.expr("cos(yaw) * x - sin(yaw) * y + dx"), "y": F.expr("sin(yaw) * x + cos(yaw) * y + dy")})


def _around(frame: DataFrame, size: float, axes: str) -> DataFrame:
    """A row for each cell beside or at the point's own, as g<axis>."""
    for c in axes:
        own = F.floor(F.col(c) / size).cast("bigint")
        frame = frame.withColumn(f"g{c}", F.explode(F.array(own - 1, own, own + 1)))
    return frame


def inliers(source: DataFrame, target: DataFrame, distance: float, keys: tuple[str, ...], on: tuple[str, ...]) -> DataFrame:
    """How many source points have a target point within ``distance``: keys, inliers.

    Both have x, y and ``on``; source has ``keys`` as well. Nine cells of that size
    make the search an equi-join, exact within the distance.
    """
    cells = target.select(*on, F.col("x").alias("x2"), F.col("y").alias("y2"), *[F.floor(F.col(c) / distance).cast("bigint").alias(f"g{c}") for c in "xy"])
    near = F.expr(f"(x - x2) * (x - x2) + (y - y2) * (y - y2) <= {distance!r} * {distance!r}")
    asked = _around(source.withColumn("row", F.monotonically_increasing_id()), distance, "xy")
    hit = asked.join(cells, [*on, "gx", "gy"]).filter(near).select(*keys, "row").distinct()
    return hit.groupBy(*keys).agg(F.count("*").alias("inliers"))


def nearest(source: DataFrame, target: DataFrame, radius: float, on: tuple[str, ...], key: tuple[str, ...], target_key: tuple[str, ...], axes: str = "xyz") -> DataFrame:
    """Nearest target within ``radius`` of each source row, ties to the least key: on, key, t_<target_key>, distance.

    Cells of the radius around a row hold every target within it.
    """
    cells = target.select(*on, *[F.col(k).alias(f"t_{k}") for k in target_key], *[F.col(c).alias(f"t{c}") for c in "xyz"], *[F.floor(F.col(c) / radius).cast("bigint").alias(f"g{c}") for c in axes])
    square = " + ".join(f"({c} - t{c}) * ({c} - t{c})" for c in axes)
    joined = _around(source, radius, axes).join(cells, [*on, *[f"g{c}" for c in axes]]).withColumn("distance", F.expr(f"sqrt({square})"))
    best = F.min(F.struct(F.round("distance", 9).alias("r"), *[f"t_{k}" for k in target_key], "distance", "z", "tz"))
    found = joined.filter(F.col("distance") <= radius).groupBy(*on, *key).agg(best.alias("best"))
    return found.select(*on, *key, *[f"best.t_{k}" for k in target_key], "best.distance", "best.z", "best.tz")


def z_offset(found: DataFrame, width: float, *keys: str) -> DataFrame:
    """Vertical offset per key: mean of z differences in the best-supported bin of ``width`` and both beside it.

    Support of a bin counts its neighbours too; ties go to the lowest bin.
    """
    d = found.withColumn("dz", F.col("tz") - F.col("z")).withColumn("bin", F.floor(F.round(F.col("dz") / width, 9)).cast("bigint"))
    bins = d.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.sum("dz").alias("total"))
    wide = bins.withColumn("at", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1))).groupBy(*keys, "at").agg(F.sum("n").alias("support"), F.sum("total").alias("total"))
    best = wide.groupBy(*keys).agg(F.max(F.struct("support", (-F.col("at")).alias("low"), "total")).alias("b"))
    return best.select(*keys, "b.support", (F.col("b.total") / F.col("b.support")).alias("dz"))
