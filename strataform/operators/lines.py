"""Lines of a pixel image by weighted Hough voting, and the graph of their crossings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataform.functions import geometry as G


def votes(pixels: DataFrame, size: float, thetas: int = 180) -> DataFrame:
    """Weight in every occupied cell of (theta, rho): cloud_id, theta, rho, votes. Summed before the shuffle."""
    angle = F.col("theta") * (math.pi / thetas)
    cast = pixels.withColumn("theta", F.explode(F.sequence(F.lit(0), F.lit(thetas - 1))))
    rho = F.floor(F.round((F.col("x") * F.cos(angle) + F.col("y") * F.sin(angle)) / size, 9)).cast("bigint")
    return cast.withColumn("rho", rho).groupBy("cloud_id", "theta", "rho").agg(F.sum("n").alias("votes"))


def top_lines(cells: DataFrame, size: float, thetas: int = 180, most: int = 20) -> DataFrame:
    """The ``most`` strongest local maxima of every cloud as lines a x + b y + c = 0: cloud_id, line_id, a, b, c, votes."""
    around = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(r).alias("r")) for t in (-1, 0, 1) for r in (-1, 0, 1)]))
    told = cells.withColumn("d", around).select("cloud_id", (F.col("theta") + F.col("d.t")).alias("at_theta"), (F.col("rho") + F.col("d.r")).alias("at_rho"), F.struct("votes", (-F.col("theta")).alias("t"), (-F.col("rho")).alias("r")).alias("s"))
    best = told.groupBy("cloud_id", "at_theta", "at_rho").agg(F.max("s").alias("s")).filter("s.t = -at_theta AND s.r = -at_rho")
    peaks = best.select("cloud_id", F.col("at_theta").alias("theta"), F.col("at_rho").alias("rho"), F.col("s.votes").alias("votes"))
    order = Window.partitionBy("cloud_id").orderBy(F.desc("votes"), "theta", "rho")
    angle = F.col("theta") * (math.pi / thetas)
    return (
        peaks.withColumn("line_id", F.row_number().over(order) - 1)
        .filter(F.col("line_id") < most)
        .select("cloud_id", "line_id", F.cos(angle).alias("a"), F.sin(angle).alias("b"), (-(F.col("rho") + 0.5) * size).alias("c"), "votes")
    )


def intersections(lines: DataFrame) -> DataFrame:
    """Crossings of every two lines of a cloud: cloud_id, line0, line1, x, y, angle. Parallel lines have none."""
    one = lines.select("cloud_id", F.col("line_id").alias("line0"), *[F.col(c).cast("double").alias(f"{c}1") for c in "abc"])
    two = lines.select("cloud_id", F.col("line_id").alias("line1"), *[F.col(c).cast("double").alias(f"{c}2") for c in "abc"])
    det = F.expr("a1 * b2 - a2 * b1")
    safe = F.nullif(det, F.lit(0.0))  # the optimizer may move a division ahead of the filter
    return (
        one.join(two, (one["cloud_id"] == two["cloud_id"]) & (F.col("line0") < F.col("line1")))
        .drop(two["cloud_id"])
        .filter(F.abs(det) >= 1e-12)
        .select(
            "cloud_id", "line0", "line1",
            (F.expr("b1 * c2 - b2 * c1") / safe).alias("x"), (F.expr("a2 * c1 - a1 * c2") / safe).alias("y"),
            G.acute_angle(F.col("a1"), F.col("b1"), F.col("a2"), F.col("b2")).alias("angle"),
        )
    )


def nodes(lines: DataFrame, radius: float, least_angle: float = 3.0, right_tolerance: float = 3.0) -> DataFrame:
    """Graph nodes: crossings within ``radius`` of the origin and not too acute, numbered from 0 in line order."""
    near = intersections(lines).filter((G.hypot(F.col("x"), F.col("y")) <= radius) & (F.col("angle") >= least_angle))
    order = Window.partitionBy("cloud_id").orderBy("line0", "line1")
    return near.withColumn("id", F.row_number().over(order) - 1).withColumn("is_right", F.abs(F.col("angle") - 90) <= right_tolerance)


def edges(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """Edges between neighbours along every line: cloud_id, line_id, u, v, length."""
    incident = nodes.select("cloud_id", "id", "x", "y", F.explode(F.array("line0", "line1")).alias("line_id"))
    along = incident.join(lines.select("cloud_id", "line_id", "a", "b"), ["cloud_id", "line_id"]).withColumn("t", F.col("b") * F.col("x") - F.col("a") * F.col("y"))
    order = Window.partitionBy("cloud_id", "line_id").orderBy("t", "id")
    nxt = along.withColumns({"v": F.lead("id").over(order), "x2": F.lead("x").over(order), "y2": F.lead("y").over(order)})
    return nxt.filter("v IS NOT NULL").select("cloud_id", "line_id", F.col("id").alias("u"), "v", G.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")).alias("length"))


def slots(nodes: DataFrame, lines: DataFrame, edges: DataFrame) -> DataFrame:
    """Four direction slots of every node and the neighbour in each: cloud_id, id, slot, angle, line_id, neighbour.

    Directions run clockwise; slot 0 is turned so that sectors 0 and 2 fit the
    node's acute angle best (the first that does). An edge goes to the slot
    nearest its direction, the later neighbour replacing an earlier one; edges
    without length go nowhere.
    """
    turn = lambda c: F.pmod(c, F.lit(360.0))
    own = lambda k: lines.select("cloud_id", F.col("line_id").alias(f"line{k}"), F.col("a").alias(f"a{k}"), F.col("b").alias(f"b{k}"))
    joined = nodes.join(own(0), ["cloud_id", "line0"]).join(own(1), ["cloud_id", "line1"])
    ahead = lambda k: F.degrees(F.atan2(-F.col(f"a{k}"), F.col(f"b{k}")))
    four = F.array(*[F.struct((-turn(ahead(k) + back)).alias("d"), F.col(f"line{k}").alias("line_id")) for k in (0, 1) for back in (0.0, 180.0)])
    spread = joined.withColumn("dirs", F.array_sort(four))
    # minus the angle ascending is the angle descending
    sector = "transform(sequence(0, 3), k -> pmod(dirs[(k + 1) % 4].d - dirs[k].d, 360.0))"
    error = "transform(sequence(0, 3), k -> struct(round(abs(sectors[k] - angle) + abs(sectors[(k + 2) % 4] - angle), 9) AS e, k AS k))"
    turned = spread.withColumn("sectors", F.expr(sector)).withColumn("start", F.expr(f"array_min({error}).k"))
    placed = turned.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("at", F.expr("dirs[(slot + start) % 4]"))
    slot = placed.select("cloud_id", "id", "slot", (-F.col("at.d")).alias("angle"), "at.line_id")

    both = edges.filter("length > 0").select("cloud_id", "line_id", "u", "v").unionByName(edges.filter("length > 0").select("cloud_id", "line_id", F.col("v").alias("u"), F.col("u").alias("v")))
    where = nodes.select("cloud_id", F.col("id").alias("v"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    here = nodes.select("cloud_id", F.col("id").alias("u"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    going = both.join(here, ["cloud_id", "u"]).join(where, ["cloud_id", "v"]).withColumn("heading", turn(F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")))))
    choices = slot.select("cloud_id", F.col("id").alias("u"), "slot", "angle")
    gap = F.abs(F.pmod(F.col("heading") - F.col("angle") + 180.0, F.lit(360.0)) - 180.0)
    fit = going.join(choices, ["cloud_id", "u"]).groupBy("cloud_id", "u", "v").agg(F.min(F.struct(F.round(gap, 9).alias("gap"), "slot")).alias("best"))
    last = fit.groupBy("cloud_id", F.col("u").alias("id"), F.col("best.slot").alias("slot")).agg(F.max("v").alias("neighbour"))
    return slot.join(last, ["cloud_id", "id", "slot"], "left")
