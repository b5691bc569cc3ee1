"""Point clouds, lines and transforms derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Seven clouds c1..c7 from lineitem, points numbered from 1; with ``more`` of its columns."""
    order = Window.partitionBy("l_linenumber").orderBy("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return _table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("cloud_id"),
        F.row_number().over(order).alias("point_id"),
        F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 2000.0).alias("y"),
        (F.col("l_discount") * 100.0).alias("z"),
        *more,
    )


def points_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without point numbers, which spares their sort."""
    return _table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("cloud_id"),
        F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 2000.0).alias("y"),
        (F.col("l_discount") * 100.0).alias("z"),
    )


def points_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten clouds e0..e9 with negative coordinates, from the embeddings."""
    return _table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("e"), F.col("label").cast("string")).alias("cloud_id"), F.col("vec_id").alias("point_id"), *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")]
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 40 customers make a pair of graphs, src and tgt, of twenty lines a side; cloud_id is pair/side."""
    key = F.col("c_custkey")
    own = F.pmod(key, F.lit(40))
    return _table(spark, sf_dir, "customer").select(
        F.concat(F.lit("p"), F.floor(key / 40).cast("string"), F.lit("/"), F.when(own % 2 == 0, "src").otherwise("tgt")).alias("cloud_id"),
        F.floor(own / 2).cast("int").alias("line_id"),
        F.cos(F.pi() * own / 41.0).alias("a"),
        F.sin(F.pi() * own / 41.0).alias("b"),
        (F.col("c_acctbal") / 2000.0).alias("c"),
    )


def transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True and estimated yaw, and an error of translation."""
    key = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(
        key.alias("pair_idx"),
        F.concat(F.col("c_nationkey").cast("string"), F.lit(".ply")).alias("source"),
        F.concat((key % 7).cast("string"), F.lit(".ply")).alias("target"),
        (F.col("c_acctbal") / 1000.0).alias("yaw_gt"),
        (F.col("c_acctbal") / 1000.0 + (key % 13).cast("double") * F.lit(0.01)).alias("yaw_est"),
        ((key % 5).cast("double") * F.lit(0.5)).alias("terr"),
    )


def runtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds per pair, for some pairs only."""
    return _table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("pair_idx")).agg((F.min("o_totalprice") / 1000.0).alias("time_s"))


#: The same views for DuckDB.
SQL = {
    "points": """points AS (SELECT concat('c', l_linenumber::VARCHAR) AS cloud_id, l_quantity AS x, l_extendedprice / 2000.0::DOUBLE AS y, l_discount * 100.0::DOUBLE AS z FROM lineitem)""",
    "points_small": """points_small AS (SELECT concat('e', label::VARCHAR) AS cloud_id, vec_id AS point_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)""",
    "lines": """lines AS (SELECT concat('p', floor(c_custkey / 40)::BIGINT::VARCHAR, '/', CASE WHEN c_custkey % 2 = 0 THEN 'src' ELSE 'tgt' END) AS cloud_id, floor((c_custkey % 40) / 2)::INT AS line_id,
  cos(pi() * (c_custkey % 40) / 41.0::DOUBLE) AS a, sin(pi() * (c_custkey % 40) / 41.0::DOUBLE) AS b, c_acctbal / 2000.0::DOUBLE AS c FROM customer)""",
    "transforms": """transforms AS (SELECT c_custkey AS pair_idx, concat(c_nationkey::VARCHAR, '.ply') AS source, concat((c_custkey % 7)::VARCHAR, '.ply') AS target,
  c_acctbal / 1000.0::DOUBLE AS yaw_gt, c_acctbal / 1000.0::DOUBLE + (c_custkey % 13)::DOUBLE * 0.01::DOUBLE AS yaw_est, (c_custkey % 5)::DOUBLE * 0.5::DOUBLE AS terr FROM customer)""",
    "runtimes": """runtimes AS (SELECT o_custkey AS pair_idx, min(o_totalprice) / 1000.0::DOUBLE AS time_s FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)""",
}
