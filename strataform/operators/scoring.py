"""Estimated against true transforms, per pair and in summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataform import scratch
from strataform.functions import geometry as G


def success(rotation: Column, translation: Column, max_rotation: float, max_translation: float, inclusive: bool = True, time: Column | None = None) -> Column:
    """Whether both errors are within their thresholds, and ``time``, if given, is positive; what is missing is none."""
    good = (rotation <= max_rotation) & (translation <= max_translation) if inclusive else (rotation < max_rotation) & (translation < max_translation)
    if time is not None:
        good = good & (F.nanvl(time, F.lit(0.0)) > 0)
    return F.coalesce(good, F.lit(False))


CELLS, LEVELS = 1024, 2


def medians(values: DataFrame, key: str, value: str) -> DataFrame:
    """Exact median of every key: key, median. Null and NaN values do not count.

    The one or two middle ranks are found by counting: the range that holds a rank is
    cut into cells, and only the cell that holds it is cut again, so a key with most
    of the rows is never sorted in one task; what is left at the end is one cell of
    the last cut. ``values`` is read a few times and should be a table.
    """
    given = values.select(key, F.col(value).alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    told = given.groupBy(key).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    ranks = F.explode(F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)))).alias("rank")
    asked = told.select(key, ranks, "low", "high", F.lit(0).cast("bigint").alias("before"))
    for _ in range(LEVELS):
        asked = scratch.written(asked, "ranks")
        inside = given.join(asked, key).filter("v BETWEEN low AND high")
        part = F.when(F.col("high") > F.col("low"), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * CELLS)).otherwise(0)
        cells = inside.groupBy(key, "rank", "before", part.alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.col("before") + F.sum("n").over(Window.partitionBy(key, "rank").orderBy("cell"))
        asked = cells.withColumn("upto", upto).filter("upto > rank AND upto - n <= rank").select(key, "rank", "low", "high", (F.col("upto") - F.col("n")).alias("before"))
    asked = scratch.written(asked, "ranks")
    order = Window.partitionBy(key, "rank").orderBy("v")
    left = given.join(asked.filter("low < high"), key).filter("v BETWEEN low AND high").withColumn("at", F.col("before") + F.row_number().over(order) - 1)
    found = left.filter("at = rank").select(key, "v").unionAll(asked.filter("low = high").select(key, F.col("low").alias("v")))
    return found.groupBy(key).agg(F.avg("v").alias("median"))


#: A cloud up to so many points is measured whole in a task, which takes about so many errors or so many pairs; more
#: errors if that makes over so many shares a partition, and as many pairs as points, up to so many.
POINTS, ERRORS, PAIRS, SHARES, MOST_PAIRS = 1 << 20, 1 << 26, 1 << 13, 4, 1 << 17
_GAPS = [f"g{k}" for k in range(12)]


def _measured(points, pairs):
    """n, rmse and median of every pair's errors on one cloud, a few pairs at a time; nulls do not count, and NaN only in the mean."""
    import numpy as np
    import pyarrow as pa

    whole = points.filter(points["given"])
    x, y, z = (whole[c].to_numpy() for c in "xyz")
    gaps = np.column_stack([pairs[c].to_numpy(zero_copy_only=False) for c in _GAPS])
    m, step = len(x), max(1, (1 << 16) // max(1, len(x)))
    rmse, median, counted = np.zeros(len(gaps)), np.zeros(len(gaps)), np.zeros(len(gaps), np.int64)
    for at in range(0, len(gaps) if m else 0, step):
        part, square = slice(at, at + step), 0.0
        g = gaps[part, :, None]
        with np.errstate(all="ignore"):
            for k in (0, 4, 8):
                d = g[:, k] * x + g[:, k + 1] * y + g[:, k + 2] * z + g[:, k + 3]
                square = square + d * d
            rmse[part] = np.sqrt(square.mean(axis=1))
            v = counted[part] = m - np.isnan(square).sum(axis=1)
            if (v == m).all():
                square.partition(((m - 1) // 2, m // 2), axis=1)
            else:
                square.sort(axis=1)  # NaN at the end
            rows = np.arange(len(v))
            median[part] = (np.sqrt(square[rows, np.maximum(v - 1, 0) // 2]) + np.sqrt(square[rows, v // 2])) / 2
    known = pairs["known"].to_numpy(zero_copy_only=False)
    column = lambda values, there: pa.array(values, mask=~there)
    return pa.table({"pair_idx": pairs["pair_idx"], "n": np.full(len(gaps), points.num_rows), "rmse": column(rmse, known & (m > 0)), "median_error": column(median, known & (counted > 0))})


def residuals(points: DataFrame, pairs: DataFrame, key: str, most: int = POINTS) -> DataFrame:
    """RMSE and exact median of the distances between points under both transforms: pair_idx, n, rmse, median_error.

    pairs: pair_idx, ``key``, truth, estimate (row-major 4x4). The errors are as many
    as points times pairs and are never written: a task holds a cloud and measures its
    share of the cloud's pairs. Every share is sent the whole cloud, so there are no
    more of them than tasks can use. Clouds above ``most`` points, and pairs of several
    rows, have their errors counted by ranges, computed anew for each count.
    """
    place = [F.col(c).cast("double").alias(c) for c in "xyz"]
    points = points.select(key, *place, (F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()).alias("given"))
    gaps = [(F.col("truth")[k].cast("double") - F.col("estimate")[k].cast("double")).alias(c) for k, c in enumerate(_GAPS)]
    pairs = pairs.select("pair_idx", key, *gaps).withColumn("known", F.forall(F.array(*_GAPS), lambda x: x.isNotNull()))
    # small tables, so that the joins with them move no pair and no point
    sizes = points.groupBy(key).agg(F.count("*").alias("size")).join(pairs.groupBy(key).agg(F.count("*").alias("pairs")), key)
    sizes = scratch.written(sizes, "clouds")
    spread = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: a stated number is not merged
    work = F.col("size").cast("double") * F.col("pairs")
    each = max(ERRORS, (sizes.filter(F.col("size") <= most).agg(F.sum(work)).first()[0] or 0) / (SHARES * spread))
    held = F.least(F.greatest(F.lit(PAIRS), F.col("size")), F.lit(MOST_PAIRS))
    clouds = sizes.select(key, "size", F.greatest(F.ceil(work / each), F.ceil(F.col("pairs") / held)).alias("shares"))
    again = scratch.written(pairs.groupBy("pair_idx").agg(F.count("*").alias("times")).filter("times > 1").select(F.col("pair_idx").alias("again")), "pairs")
    once = pairs.join(clouds, key).join(again, F.col("pair_idx").eqNullSafe(F.col("again")), "left_anti")
    left = points.join(clouds.filter(F.col("size") <= most), key).select(key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)).alias("share"), "x", "y", "z", "given")
    right = once.filter(F.col("size") <= most).withColumn("share", F.pmod(F.xxhash64("pair_idx"), F.col("shares"))).drop("size", "shares")
    left, right = (d.repartition(spread, key, "share").groupBy(key, "share") for d in (left, right.toDF(*right.columns)))
    kind = pairs.schema["pair_idx"].dataType.simpleString()
    whole = left.cogroup(right).applyInArrow(_measured, f"pair_idx {kind}, n bigint, rmse double, median_error double")
    beyond = pairs.join(clouds, key).join(again, F.col("pair_idx").eqNullSafe(F.col("again")), "left")
    rest = scratch.written(beyond.filter((F.col("size") > most) | F.col("again").isNotNull()).select(*pairs.columns), "pairs")
    return whole if rest.isEmpty() else whole.unionByName(_counted(points, rest, key))


def _counted(points: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """The same by aggregates, for pairs with more errors than a task should hold."""
    apart = [sum((F.col(_GAPS[4 * k + i]) * F.col(c) for i, c in enumerate("xyz")), F.lit(0.0)) + F.col(_GAPS[4 * k + 3]) for k in range(3)]
    errors = points.join(pairs, key).select("pair_idx", F.sqrt(sum((d * d for d in apart), F.lit(0.0))).alias("error"))
    sums = errors.groupBy("pair_idx").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"))
    found = medians(errors, "pair_idx", "error").select(F.col("pair_idx").alias("at"), F.col("median").alias("median_error"))
    return sums.join(found, F.col("pair_idx").eqNullSafe(F.col("at")), "left").drop("at")


def scored(pairs: DataFrame, points: DataFrame, times: DataFrame, key: str, time_key: str | list[str], max_rotation: float, max_translation: float) -> DataFrame:
    """All errors of every pair, its run time, and success by strict thresholds and a positive time.

    pairs: pair_idx, source, target, ``key`` (of the cloud to measure on), truth,
    estimate (null after a failure); times: ``time_key``, time_s. Errors of
    rotation and translation count to four places.
    """
    errors = pairs.withColumns({"rotation_error": G.rotation_error(F.col("truth"), F.col("estimate")), "translation_error": G.translation_error(F.col("truth"), F.col("estimate"))})
    spread = residuals(points, pairs.select("pair_idx", key, "truth", "estimate").filter("estimate IS NOT NULL"), key).drop("n")
    joined = errors.join(spread, "pair_idx", "left").join(times, time_key, "left")
    good = success(F.round("rotation_error", 4), F.round("translation_error", 4), max_rotation, max_translation, inclusive=False, time=F.col("time_s"))
    return joined.select("pair_idx", "source", "target", "rotation_error", "translation_error", "rmse", "median_error", "time_s", good.alias("success"))


def summary(results: DataFrame) -> DataFrame:
    """One row over results with success, rotation_error, translation_error and time_s, and rmse and median_error if they are there; means over no success are null."""
    time = F.nanvl(F.col("time_s"), F.lit(None).cast("double"))
    good = lambda c: F.avg(F.when(F.col("success"), c))
    return results.agg(
        F.count("*").alias("pairs"),
        F.count_if("success").alias("successes"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        good(F.col("rotation_error")).alias("mean_rotation_error"),
        good(F.col("translation_error")).alias("mean_translation_error"),
        *[good(F.col(c)).alias(f"mean_{c}") for c in ("rmse", "median_error") if c in results.columns],
        F.avg(time).alias("mean_time_s"),
        good(time).alias("mean_time_s_success"),
    )
