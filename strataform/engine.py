"""The whole registration as one object: scans in, transforms out, all pairs together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataform import scratch
from strataform.functions import geometry as G
from strataform.operators import lines as L
from strataform.operators import matching as M
from strataform.operators import pixels as P
from strataform.operators import solve as S
from strataform.operators import voxels as V
from strataform.params import Params


class PointCloudEngine:
    """Registers pairs of scans. Every step up to the lines is done once per scan, however many pairs share it."""

    def __init__(self, spark: SparkSession, params: Params | None = None) -> None:
        self.spark = spark
        self.params = params or Params()

    def voxels(self, points: DataFrame) -> DataFrame:
        """Planar voxels with their normals."""
        p = self.params
        return V.planar(V.principal(V.statistics(points, p.voxel, p.min_points)))

    def structure(self, points: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Pixels of the near-vertical points, their images, and the lines in them."""
        return self._structure(points, self.voxels(points))

    def _structure(self, points: DataFrame, voxels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        p = self.params
        walls = V.points_in(points, V.perpendicular(voxels, p.max_tilt), p.voxel)
        images = P.image(P.bounding_box(walls), p.voxel)
        pixels = P.pixelize(walls, images, p.voxel, p.threshold_count)
        thinned = pixels.join(P.thin(pixels.filter("value"), images), ["cloud_id", "row", "col"], "left_semi")
        return pixels, images, L.top_lines(L.votes(thinned, p.voxel, p.thetas), p.voxel, p.thetas, p.max_line_num)

    def register(self, points: DataFrame, pairs: DataFrame) -> DataFrame:
        """Transform of every pair: pair_id, source, target, transform (16 numbers by row), inliers, weight, success, reason.

        points: cloud_id, point_id, x, y, z; pairs: pair_id, source, target. A pair
        that cannot be registered has a null transform and the reason why. The steps
        run at the call, into tables that ``scratch.clear`` deletes; the result is lazy.
        """
        # each step is written: the plan of the next stays short, and a lost executor costs no earlier step
        p = self.params
        voxels = scratch.written(self.voxels(points), "voxels")
        pixels, images, lines = (scratch.written(d, name) for d, name in zip(self._structure(points, voxels), ("pixels", "images", "lines"), strict=True))
        sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit("src").alias("side"), F.col("source").alias("cloud_id")), F.struct(F.lit("tgt").alias("side"), F.col("target").alias("cloud_id")))).alias("s")).select("pair_id", "s.side", "s.cloud_id")
        reach = images.select("cloud_id", (F.sqrt(F.col("width") * F.col("width") + F.col("height") * F.col("height")) * p.voxel / 2).alias("half"))
        # crossings are measured from the middle of the scan's own image
        centre = images.select("cloud_id", (F.col("min_x") + F.col("width") * p.voxel / 2).alias("mx"), (F.col("min_y") + F.col("height") * p.voxel / 2).alias("my"))
        radius = sides.join(reach, "cloud_id").groupBy("pair_id").agg(F.avg("half").alias("radius"))
        crossed = L.intersections(lines).join(centre, "cloud_id")
        near = sides.join(crossed, "cloud_id").join(radius, "pair_id").filter((G.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my")) <= F.col("radius")) & (F.col("angle") >= 3.0))
        graph = F.concat_ws("/", "pair_id", "side")
        order = Window.partitionBy("cloud_id").orderBy("line0", "line1")
        nodes = near.withColumn("cloud_id", graph).withColumn("id", F.row_number().over(order) - 1).withColumn("is_right", F.abs(F.col("angle") - 90) <= p.angle_tolerance)
        nodes = scratch.written(nodes, "nodes")
        own = sides.join(lines, "cloud_id").withColumn("cloud_id", graph).select("cloud_id", "line_id", "a", "b", "c")
        slots = L.slots(nodes, own, L.edges(nodes, own)).groupBy("cloud_id", "id").agg(F.sort_array(F.collect_list(F.struct("slot", "neighbour"))).alias("s"))
        graphs = nodes.join(slots, ["cloud_id", "id"]).select("pair_id", "side", "id", "x", "y", "angle", "is_right", F.col("s.neighbour").alias("slots"))
        src, tgt = nodes.filter("side = 'src'"), nodes.filter("side = 'tgt'")
        ranked = scratch.written(M.best_seeds(M.seeds(src, tgt, p.angle_tolerance), src, tgt), "seeds")
        found = scratch.written(M.match(graphs, ranked, p.epsilon, p.angle_tolerance), "subgraphs")

        fits = S.rigid2d(found.select("pair_id", "candidate", F.explode("matches").alias("m")).select("pair_id", "candidate", "m.*"), "pair_id", "candidate")
        placed = fits.join(pairs, "pair_id")
        here = S.moved2d(placed.join(pixels.select(F.col("cloud_id").alias("source"), "x", "y"), "source")).select("pair_id", "candidate", "target", "x", "y")
        there = pixels.select(F.col("cloud_id").alias("target"), "x", "y")
        scored = S.inliers(here, there, p.tau, ("pair_id", "candidate"), ("target",)).join(fits, ["pair_id", "candidate"]).join(found.select("pair_id", "candidate", "weight"), ["pair_id", "candidate"])
        best = scratch.written(scored.groupBy("pair_id").agg(F.max(F.struct("inliers", "weight", (-F.col("candidate")).alias("first"), "yaw", "dx", "dy")).alias("b")).select("pair_id", "b.*"), "best")

        flat = V.ground(voxels, p.max_tilt).select("cloud_id", "vx", "vy", "vz", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
        down = S.moved2d(best.join(pairs, "pair_id").join(flat.withColumnRenamed("cloud_id", "source"), "source"))
        up = flat.withColumnRenamed("cloud_id", "target")
        close = S.nearest(down.select("pair_id", "target", "vx", "vy", "vz", "x", "y", "z"), up, p.voxel, ("target",), ("pair_id", "vx", "vy", "vz"), ("vx", "vy", "vz"), "xy")
        lifted = best.join(S.z_offset(close, p.tau / 2, "pair_id"), "pair_id", "left").withColumn("dz", F.coalesce("dz", F.lit(0.0)))
        whole = lifted.select("pair_id", G.yaw_matrix(F.col("yaw"), F.col("dx"), F.col("dy"), F.col("dz")).alias("transform"), "inliers", "weight")
        seen = points.select("cloud_id").distinct()
        missing = sides.join(seen, "cloud_id", "left_anti").groupBy("pair_id").agg(F.concat(F.lit("no points: "), F.array_join(F.array_sort(F.collect_set("cloud_id")), ", ")).alias("missing"))
        sided = nodes.groupBy("pair_id").agg(F.count_distinct("side").alias("sides"))
        seeded, grown = ranked.select("pair_id", F.lit(True).alias("seeded")).distinct(), found.select("pair_id", F.lit(True).alias("grown")).distinct()
        told = pairs.join(whole, "pair_id", "left").join(missing, "pair_id", "left").join(sided, "pair_id", "left").join(seeded, "pair_id", "left").join(grown, "pair_id", "left")
        reason = (
            F.when(F.col("transform").isNotNull(), F.lit(None).cast("string"))
            .when(F.col("missing").isNotNull(), F.col("missing"))
            .when(F.coalesce("sides", F.lit(0)) < 2, "no crossing lines in a scan")
            .when(F.col("seeded").isNull(), "no crossings of like angle")
            .when(F.col("grown").isNull(), "no congruent subgraph")
            .otherwise("no inliers")
        )
        return told.select(*pairs.columns, "transform", "inliers", "weight", F.col("transform").isNotNull().alias("success"), reason.alias("reason"))
