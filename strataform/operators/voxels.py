"""Voxel grids: downsampling, planarity by principal components, near-vertical and ground selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.functions import geometry as G

KEY = ("cloud_id", "vx", "vy", "vz")


def binned(points: DataFrame, size: float) -> DataFrame:
    """Points with their voxel vx, vy, vz."""
    return points.withColumns({f"v{c}": G.cell(F.col(c).cast("double"), size) for c in "xyz"})


def downsample(points: DataFrame, size: float) -> DataFrame:
    """One centroid per occupied voxel: cloud_id, vx, vy, vz, n, x, y, z."""
    return binned(points, size).groupBy(*KEY).agg(F.count("*").alias("n"), *[F.avg(F.col(c).cast("double")).alias(c) for c in "xyz"])


def statistics(points: DataFrame, size: float, least: int = 3) -> DataFrame:
    """Count, centroid and covariance of voxels of at least ``least`` points; partial sums before the shuffle."""
    d = {c: F.col(c).cast("double") for c in "xyz"}
    return (
        binned(points, size)
        .groupBy(*KEY)
        .agg(
            F.count("*").alias("n"),
            *[F.avg(d[c]).alias(f"c{c}") for c in "xyz"],
            *[F.var_pop(d[c]).alias(f"s{c}{c}") for c in "xyz"],
            *[F.covar_pop(d[a], d[b]).alias(f"s{a}{b}") for a, b in ("xy", "xz", "yz")],
        )
        .filter(F.col("n") >= least)
    )


def principal(voxels: DataFrame) -> DataFrame:
    """Eigenvalues l0 >= l1 >= l2 of the covariance and the unit normal (nx, ny, nz) of the least, nz >= 0.

    The normal is the longest cross product of two rows of the covariance less
    its least eigenvalue; null where all points coincide or lie on a line.
    """
    rows = (("sxx - l2", "sxy", "sxz"), ("sxy", "syy - l2", "syz"), ("sxz", "syz", "szz - l2"))

    def cross(u: tuple[str, ...], v: tuple[str, ...]) -> str:
        x, y, z = (f"(({u[i]}) * ({v[j]}) - ({u[j]}) * ({v[i]}))" for i, j in ((1, 2), (2, 0), (0, 1)))
        return f"named_struct('size', {x} * {x} + {y} * {y} + {z} * {z}, 'x', {x}, 'y', {y}, 'z', {z})"

    best = f"array_max(array({cross(rows[0], rows[1])}, {cross(rows[0], rows[2])}, {cross(rows[1], rows[2])}))"
    unit = "CASE WHEN best.z < 0 THEN -1 ELSE 1 END / nullif(sqrt(best.size), 0)"
    whole = "named_struct('l0', l0, 'l1', l1, 'l2', l2, " + ", ".join(f"'n{c}', best.{c} * unit" for c in "xyz") + ")"
    # each step is bound once by a lambda: as columns they would be copied into every filter that is pushed below them
    steps = [*G.eigenvalues("sxx", "syy", "szz", "sxy", "sxz", "syz").items(), ("best", best), ("unit", unit)]
    for name, step in reversed(steps):
        whole = f"transform(array({step}), {name} -> {whole})[0]"
    return voxels.withColumn("axes", F.expr(whole)).select("*", "axes.*").drop("axes")


def planar(voxels: DataFrame) -> DataFrame:
    """Flat and not linear voxels."""
    return voxels.filter("30 * l2 < l1 AND l0 < 6 * l1")


def perpendicular(voxels: DataFrame, max_angle: float = 30.0, space: tuple[float, float, float] = (0.0, 0.0, 1.0)) -> DataFrame:
    """Voxels whose plane is within ``max_angle`` of perpendicular to the reference plane: walls, for the ground."""
    dot = sum((F.col(f"n{c}") * float(s) for c, s in zip("xyz", space, strict=True)), F.lit(0.0)) / float(sum(s * s for s in space)) ** 0.5
    return voxels.filter(90 - F.degrees(F.acos(F.least(F.lit(1.0), F.abs(dot)))) < max_angle)


def ground(voxels: DataFrame, max_angle: float = 30.0) -> DataFrame:
    """Voxels whose normal is within ``max_angle`` of vertical."""
    return voxels.filter(F.degrees(F.acos(F.least(F.lit(1.0), F.abs(F.col("nz"))))) < max_angle)


def points_in(points: DataFrame, voxels: DataFrame, size: float) -> DataFrame:
    """Points that lie in one of the voxels."""
    return binned(points, size).join(voxels.select(*KEY), list(KEY), "left_semi").drop("vx", "vy", "vz")
