"""Command line: register the pairs of a configuration and report the errors."""

from __future__ import annotations

import argparse
import time

from pyspark import StorageLevel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strataform import scratch
from strataform.engine import PointCloudEngine
from strataform.functions import geometry as G
from strataform.operators import scoring, voxels
from strataform.params import Params
from strataform.sources import ply, tables


def main() -> None:
    parser = argparse.ArgumentParser(prog="strataform", description=__doc__)
    parser.add_argument("yaml", help="data set configuration")
    parser.add_argument("resolution", type=float)
    parser.add_argument("max_rotation", type=float, help="degrees")
    parser.add_argument("max_translation", type=float, help="metres")
    parser.add_argument("--out", default="results")
    args = parser.parse_args()
    spark = SparkSession.builder.getOrCreate()
    pairs = tables.config(spark, args.yaml)
    first = pairs.first()
    scans = ply.scan(spark, f"{first.root}/{first.raw_data}/*.ply").persist(StorageLevel.DISK_ONLY)
    points, broken = scans.filter("error IS NULL"), scans.filter("error IS NOT NULL").select("cloud_id", "error")
    small = voxels.downsample(points, args.resolution).select("cloud_id", F.row_number().over(_order()).alias("point_id"), "x", "y", "z")
    known = pairs.withColumn("pair_id", F.col("pair_idx").cast("string"))
    began = time.monotonic()
    found = PointCloudEngine(spark, Params(resolution=args.resolution)).register(small, known.select("pair_id", "source", "target"))
    found = found.persist()
    n = found.count()
    share = (time.monotonic() - began) / max(1, n)  # all pairs run in one plan: each gets its share of the whole time
    truth = tables.with_truth(known, tables.ground_truth(spark, f"{first.root}/{first.groundtruth}/*"))
    scored = truth.join(found.select("pair_id", "transform", "reason"), "pair_id").withColumns(
        {"rotation_error": G.rotation_error(F.col("truth"), F.col("transform")), "translation_error": G.translation_error(F.col("truth"), F.col("transform")), "time_s": F.lit(share)}
    )
    results = scored.withColumn("success", scoring.success(F.col("rotation_error"), F.col("translation_error"), args.max_rotation, args.max_translation)).cache()
    tables.write_results(results, f"{args.out}/results")
    tables.write_transforms(results, f"{args.out}/transforms")
    broken.show(truncate=False)
    results.select("pair_idx", "source", "target", "rotation_error", "translation_error", "time_s", "success", "reason").orderBy("pair_idx").show(1000, truncate=False)
    scoring.summary(results).show(truncate=False)
    scratch.clear(spark)


def _order():
    from pyspark.sql import Window

    return Window.partitionBy("cloud_id").orderBy("vx", "vy", "vz")


if __name__ == "__main__":
    main()
