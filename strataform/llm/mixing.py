"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key -ln(u) / weight from a hash of its id, so
reruns agree and heavier documents come first. A source whose target is e whole
epochs and a rest takes each document e times, and then the documents of least
key whose sizes, summed in that order, fit the rest. Of the documents left, the
one whose size is nearest to what is still missing goes in last, if that helps.

The boundary of every source is found by radix selection: keys are cut into 256
ranges, sizes are summed per source and range, and only the range that holds the
boundary is cut again. So a source that holds a third of all rows is never sorted
in one task; what is left at the end is 1/65,536 of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataform.llm import scratch

RANGES, LEVELS = 256, 2


def word_count(text: Column) -> Column:
    """Runs outside ASCII white space; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Target of every source: columns source, source_size, target, from columns source, source_size.

    Weights repeat over the sources in code point order, null last. All sizes are
    shared by weight; a target stops at ``most`` times its source's size, and the
    excess is shared again until none is above. One row per source goes through a
    window without a key: sources are few beside documents.
    """
    each = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    placed = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", each)
    by_ratio = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), "place")
    every = Window.partitionBy()
    summed = (
        placed.withColumn("total", F.sum("source_size").over(every))
        .withColumn("capped", F.coalesce(F.sum(most * F.col("source_size")).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    )
    level = (F.col("total") - F.col("capped")).cast("double") / F.col("open")
    # a source is below its cap once its share by weight, given that all of smaller ratio are capped, fits
    free = summed.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= most * F.col("source_size"))
    final = free.withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("source_size") / F.col("weight"), "place", "level"))).over(every)["level"])
    share = F.coalesce(F.least((most * F.col("source_size")).cast("double"), F.col("level") * F.col("weight")), (most * F.col("source_size")).cast("double"))
    return final.select("source", "source_size", share.alias("target"))


def key_of(id_col: Column, weight: Column, seed: int) -> Column:
    """Exponential key -ln(u) / weight, with u in (0, 1) from the id's MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 12)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)
    usable = F.when((weight > 0) & ~F.isnan(weight.cast("double")), weight.cast("double"))
    return -F.log(u) / F.coalesce(usable, F.lit(1.0))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    size_col: str | None = None,
    weight_col: str | None = None,
    row_col: str | None = None,
    weights: tuple[int, ...] = (5, 2, 1),
    most: int = 3,
    seed: int = 1,
) -> DataFrame:
    """How often the mix takes each document.

    Returns one row per input row: doc_id, source, size, source_size, target,
    copies and taken (size * copies). Sizes are words, or those in ``size_col``;
    null and empty texts have size 0. ``weight_col`` holds quality weights for the fractional part; a null,
    zero, negative or NaN weight counts as 1. A null source is a source of its
    own, a null id draws as the empty id. Repeated rows are separate documents
    with the same key, taken in any order among themselves; ``row_col``, a written
    integer that no two rows share, comes back as ``row`` to tell them apart. An empty table gives an empty result; other columns
    are ignored, whatever their names.
    """
    weight = F.col(weight_col) if weight_col else F.lit(1.0)
    size = F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)) if size_col else word_count(F.col(text_col))
    key = key_of(F.col(id_col), weight, seed)
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    # exp(-key) is uniform for weight 1 and falls with the key, so equal ranges of it hold few documents each
    place = F.least(F.lit(RANGES**LEVELS - 1), F.floor((1 - F.exp(-key)) * RANGES**LEVELS)).cast("int")
    slim = scratch.written(
        docs.select(row.alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), key.alias("key"), place.alias("place")),
        "sizes",
    )
    sizes = slim.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    goals = scratch.written(
        targets(sizes, weights, most)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")),
        "targets",
    )

    # per source: the range that holds the boundary, and the sizes before it
    edge = goals.select("source", "rest", F.lit(0).alias("from"), F.lit(0).cast("bigint").alias("before"))
    for level in range(LEVELS):
        width = RANGES ** (LEVELS - 1 - level)
        cell = F.floor((F.col("place") - F.col("from")) / width).cast("int")
        inner = slim.join(edge, slim["source"].eqNullSafe(edge["source"])).filter(f"place >= `from` AND place < `from` + {width * RANGES}")
        sums = inner.groupBy(edge["source"], "rest", "from", "before", cell.alias("cell")).agg(F.sum("size").cast("bigint").alias("n"))
        upto = sums.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("source").orderBy("cell")))
        reached = F.max(F.when(F.col("upto") - F.col("n") <= F.col("rest"), F.struct("cell", (F.col("upto") - F.col("n")).alias("before"))))
        edge = scratch.written(
            upto.groupBy("source", "rest", "from").agg(reached.alias("hit")).select("source", "rest", (F.col("from") + F.col("hit.cell") * width).alias("from"), F.col("hit.before").alias("before")),
            "edge",
        )

    joined = slim.join(goals, slim["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    cut = edge.select(F.col("source").alias("edge_source"), F.col("from").alias("edge"), "before")
    known = joined.join(cut, F.col("source").eqNullSafe(F.col("edge_source")), "left")
    at = scratch.written(known.filter("place = edge"), "boundary")
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    near = at.withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    far = known.filter("edge IS NULL OR place <> edge").withColumn("before", F.when(F.col("place") < F.col("edge"), F.lit(0)))
    fits = F.when((F.col("place") < F.col("edge")) | (F.col("before") + F.col("size") <= F.col("rest")), 1).otherwise(0)
    picked = scratch.written(
        far.unionByName(near).select("row", "doc_id", "source", "key", "size", "source_size", "target", "rest", (F.col("epochs") + fits).alias("copies"), fits.alias("fits")), "picked"
    )
    missing = picked.groupBy("source", "rest").agg((F.col("rest") - F.sum(F.col("size") * F.col("fits"))).alias("missing"))
    left = picked.filter("fits = 0").join(missing.select(F.col("source").alias("of"), "missing"), F.col("source").eqNullSafe(F.col("of")))
    nearest = F.min(F.struct(F.abs(F.col("missing") - F.col("size")).alias("off"), "key", "row"))
    last = left.groupBy("source", "missing").agg(nearest.alias("best")).filter("best.off < missing").select(F.col("best.row").alias("row"), F.lit(1).alias("last"))
    copies = F.col("copies") + F.coalesce("last", F.lit(0))
    return picked.join(last, "row", "left").select(
        *(["row"] if row_col else []), "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken")
    )
