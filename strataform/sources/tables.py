"""Configurations, transforms, run times and results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAIRS = "dataset string, root string, groundtruth string, raw_data string, pair_idx int, source string, target string, transformation_file string"
IDENTITY = [float(k % 5 == 0) for k in range(16)]


def config(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of a YAML data set, one row each."""
    import yaml

    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    d = yaml.safe_load(text)
    if not isinstance(d, dict) or "pairs" not in d:
        raise ValueError(f"{path} lists no pairs")
    rows = [
        (d.get("dataset_name"), d.get("root"), d.get("groundtruth"), d.get("raw_data"), k, p["source"], p["target"], p.get("transformation_file")) for k, p in enumerate(d["pairs"])
    ]
    return spark.createDataFrame(rows, PAIRS)


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """4x4 matrices, one a file: transformation_file, truth (16 numbers by row)."""
    numbers = F.transform(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("transformation_file"), numbers.alias("truth"))
    return files.filter(F.size("truth") == 16)


def with_truth(pairs: DataFrame, truths: DataFrame) -> DataFrame:
    """Pairs with their true transform; where the file is missing, the identity, and gt_missing."""
    joined = pairs.join(truths, "transformation_file", "left")
    return joined.withColumn("gt_missing", F.col("truth").isNull()).withColumn("truth", F.coalesce("truth", F.array(*map(F.lit, IDENTITY))))


def estimates(spark: SparkSession, path: str) -> DataFrame:
    """Matrices one below another in one file: pair_idx, estimate; a matrix of -1 is a failure, null."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("at", "line"))
    parsed = lines.select(F.floor(F.col("at") / 4).cast("int").alias("pair_idx"), "at", F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.cast("double")).alias("row"))
    rows = parsed.groupBy("pair_idx").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "row"))), lambda x: x["row"])).alias("m"))
    return rows.select("pair_idx", F.when(~F.forall("m", lambda x: x == -1.0), F.col("m")).alias("estimate"))


def run_times(spark: SparkSession, path: str) -> DataFrame:
    """source, target, time_s from a results CSV; the last line of a pair counts. The column says ms and holds seconds."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line")).filter(F.trim("line") != "")
    cut = raw.withColumn("f", F.transform(F.split("line", ","), lambda x: F.trim(x)))
    head = cut.filter("at = 0").select(F.transform("f", lambda x: F.lower(x)).alias("names"))
    named = cut.filter("at > 0").crossJoin(F.broadcast(head))  # the header: one row
    pick = lambda name: F.element_at("f", F.array_position("names", name).cast("int"))
    rows = named.select("at", pick("source").alias("source"), pick("target").alias("target"), pick("time(ms)").cast("double").alias("time_s"))
    return rows.groupBy("source", "target").agg(F.max_by("time_s", "at").alias("time_s"))


def write_results(results: DataFrame, path: str) -> None:
    """Results as one CSV in pair order; what is missing becomes -1."""
    names = {"pair_idx": "Pair_ID", "source": "Source", "target": "Target", "rotation_error": "Rotation_Error(deg)", "translation_error": "Translation_Error(m)", "time_s": "Time(s)"}
    rows = results.orderBy("pair_idx").select(*[F.coalesce(F.col(c), F.lit(-1)).alias(n) if c not in ("source", "target") else F.col(c).alias(n) for c, n in names.items()])
    rows.coalesce(1).write.option("header", True).csv(path)


def write_transforms(results: DataFrame, path: str) -> None:
    """Transforms as text, four lines a pair in pair order; -1 throughout for a failure."""
    m = F.coalesce("transform", F.array(*[F.lit(-1.0)] * 16))
    rows = results.select("pair_idx", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("r"), m.alias("m"))
    line = F.format_string("%.12f %.12f %.12f %.12f", *[F.element_at("m", F.col("r") * 4 + k + 1) for k in range(4)])
    order = Window.orderBy("pair_idx", "r")
    rows.withColumn("n", F.row_number().over(order)).orderBy("n").select(line.alias("value")).coalesce(1).write.text(path)


def write_scores(scores: DataFrame, summary: DataFrame, path: str) -> None:
    """Both tables of a scoring as CSV, ``path``/pairs and ``path``/summary."""
    pair = F.concat_ws("->", "source", "target").alias("pair")
    scores.orderBy("pair_idx").select(pair, "rotation_error", "translation_error", F.col("rmse").alias("RMSE"), F.col("median_error").alias("MeE"), "time_s", "success").coalesce(1).write.option("header", True).csv(f"{path}/pairs")
    summary.coalesce(1).write.option("header", True).csv(f"{path}/summary")
