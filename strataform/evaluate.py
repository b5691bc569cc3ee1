"""Command line: score estimated transforms against the true ones of a data set."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.operators import scoring
from strataform.sources import ply, tables


def evaluate(spark: SparkSession, yaml: str, estimates: str, max_rotation: float = 5.0, max_translation: float = 2.0, times: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores of every pair and their summary.

    Estimates belong to the pairs by their place in the file; a pair without one
    has null errors and no success. Without a table of times no pair has a time,
    and so none is a success.
    """
    pairs = tables.config(spark, yaml)
    first = pairs.first()
    if first is None:
        raise ValueError(f"{yaml} lists no pairs")
    known = tables.with_truth(pairs, tables.ground_truth(spark, f"{first.root}/{first.groundtruth}/*")).join(tables.estimates(spark, estimates), "pair_idx", "left")
    points, _ = ply.read(spark, f"{first.root}/{first.raw_data}/*.ply")
    took = tables.run_times(spark, times) if times else spark.createDataFrame([], "source string, target string, time_s double")
    scores = scoring.scored(known.withColumn("cloud_id", F.col("source")), points, took, "cloud_id", ["source", "target"], max_rotation, max_translation)
    return scores, scoring.summary(scores)


def main() -> None:
    parser = argparse.ArgumentParser(prog="strataform.evaluate", description=__doc__)
    parser.add_argument("--yaml", required=True)
    parser.add_argument("--est", required=True, help="estimated transforms, four lines a pair")
    parser.add_argument("--reg", help="results with a time per pair")
    parser.add_argument("--rot_th", type=float, default=5.0, help="degrees")
    parser.add_argument("--trans_th", type=float, default=2.0, help="metres")
    parser.add_argument("--out", default="evaluation")
    args = parser.parse_args()
    spark = SparkSession.builder.getOrCreate()
    scores, summary = evaluate(spark, args.yaml, args.est, args.rot_th, args.trans_th, args.reg)
    scores = scores.persist()
    tables.write_scores(scores, scoring.summary(scores), args.out)
    summary.show(truncate=False)


if __name__ == "__main__":
    main()
