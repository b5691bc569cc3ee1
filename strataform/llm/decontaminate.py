"""Benchmark passages in training text by winnowing, in DataFrame functions only.

Benchmark items are cut into windows of 10 words (an item of fewer words is one
window). The fingerprint of a window is the least hash of the 5-word sequences in
it, so equal windows have equal fingerprints, and every shared span of a window's
length is met.

1. The distinct fingerprints of every document's windows are joined with those of
   the benchmark. Documents go by a 128-bit hash of their text, so copies are one.
2. The texts that were hit are dealt out by that hash, and each hit is extended to
   the windows that carry its fingerprint. These are joined with the benchmark's
   windows word by word; all the words of those that match are hits.
3. What was found goes back to the documents by the hash of their text.

All documents are read once in each step, whatever the size of the benchmark. Nothing
is collected but the lengths of windows, ten at most. The benchmark's tables are
written first, so Spark knows their size: it broadcasts them below its own threshold
and shuffles beyond, splitting skewed keys. Where a text is in very many documents,
its rows are dealt out in ``SHARES`` shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.llm import scratch

GRAM = 5
SHARES = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_list(text: Column) -> Column:
    """Lower-cased (A-Z) words: runs of digits, letters and anything beyond ASCII. Null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN), "")


def _grams(length: int) -> str:
    """SQL for the hashes of the sequences that fingerprint windows of this length, over column ``words``."""
    k = min(GRAM, length)
    args = ", ".join(f"words[i + {j}]" for j in range(k))
    return f"CASE WHEN size(words) >= {length} THEN transform(sequence(0, size(words) - {k}), i -> xxhash64({args})) ELSE array() END"


def _fingerprint(length: int, grams: str, i: str) -> str:
    """SQL for the least hash of the sequences in window i, told apart by the window's length."""
    k = min(GRAM, length)
    each = [f"{grams}[{i} + {j}]" for j in range(length - k + 1)]
    return f"({f'least({chr(44).join(each)})' if len(each) > 1 else each[0]} ^ {length}L)"


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct (length, window, item_id): the windows of every item as text."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), word_list(F.col(text_col)).alias("words")).filter("size(words) > 0")
    starts = F.expr(f"CASE WHEN size(words) < {window} THEN array(1) ELSE sequence(1, size(words) - {window - 1}) END")
    cut = items.select("item_id", "words", F.explode(starts).alias("start"))
    return cut.select(
        F.expr(f"least(size(words), {window})").alias("length"), F.expr(f"array_join(slice(words, start, {window}), ' ')").alias("window"), "item_id"
    ).distinct()


def _print() -> list[Column]:
    """Two hashes of the text under seeds of their own."""
    return [F.xxhash64("text").alias("p0"), F.xxhash64(F.lit(1), "text").alias("p1")]


def _windows(lengths: list[int], each: str) -> str:
    """SQL for an array of ``each``, written for window i with fingerprint f, over the windows of all lengths."""
    parts = [
        f"transform(array({_grams(n)}), g -> transform(CASE WHEN size(words) >= {n} THEN sequence(0, size(words) - {n}) ELSE CAST(array() AS array<int>) END, "
        f"i -> {each.format(length=n, f=_fingerprint(n, 'g', 'i'))}))[0]"
        for n in lengths
    ]
    return f"concat({', '.join(parts)})"


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
) -> DataFrame:
    """Which words of every document lie in a window of some benchmark item.

    Returns one row per input row: doc_id, n_words, n_hit, n_items, items_sha256
    (of the ids of the items found, sorted as strings and joined by commas),
    contaminated, and hits (the [start, length] windows found, from word 1). Null
    and empty texts have no words; an item without words has no window. An item
    with a null id hits but is not counted or listed. Repeated rows are separate
    rows; an empty table on either side gives no hits; other columns are ignored,
    whatever their names. Whole texts are searched, however long.
    """
    targets = scratch.written(benchmark_windows(benchmark, item_col, item_text_col, window), "windows")
    lengths = sorted(r[0] for r in targets.select("length").distinct().collect())  # at most `window` values
    share = F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)).cast("int").alias("share")
    every = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    slim = base.select("doc_id", share, *_print(), F.size(word_list(F.col("text"))).cast("bigint").alias("n_words"))
    if not lengths:
        empty = F.expr("CAST(array() AS array<struct<start:int,length:int>>)")
        return slim.select("doc_id", "n_words", F.lit(0).cast("bigint").alias("n_hit"), F.lit(0).cast("bigint").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"), empty.alias("hits"))

    cut = targets.select("length", F.split("window", " ").alias("words"))
    own = [cut.filter(F.col("length") == n).select(F.expr(_grams(n)).alias("g")).select(F.expr(_fingerprint(n, "g", "0")).alias("f")) for n in lengths]
    fingerprints = own[0]
    for more in own[1:]:
        fingerprints = fingerprints.unionAll(more)
    fingerprints = scratch.written(fingerprints.distinct(), "fingerprints")

    texts = base.filter("text IS NOT NULL")
    met = texts.select(*_print(), word_list(F.col("text")).alias("words"))
    met = met.select("p0", "p1", F.explode(F.array_distinct(F.expr(_windows(lengths, "{f}")))).alias("f"))
    met = met.join(fingerprints, "f").groupBy("p0", "p1").agg(F.collect_set("f").alias("met"))
    met = scratch.written(met, "met")

    # one row for each text that was hit; the hint makes it one path at every size
    found = texts.select(*_print(), share, "text").join(met.select("p0", "p1", "met", every).hint("shuffle_hash"), ["p0", "p1", "share"])
    found = found.dropDuplicates(["p0", "p1"]).select("p0", "p1", "met", word_list(F.col("text")).alias("words"))
    spans = "CASE WHEN array_contains(met, {f}) THEN struct(i + 1 AS start, {length} AS length, array_join(slice(words, i + 1, {length}), ' ') AS window) END"
    spans = found.select("p0", "p1", F.explode(F.expr(f"filter({_windows(lengths, spans)}, x -> x IS NOT NULL)")).alias("at")).select("p0", "p1", "at.*")
    hits = spans.join(targets, ["length", "window"]).groupBy("p0", "p1")
    hits = scratch.written(hits.agg(F.collect_set(F.struct("start", "length")).alias("hits"), F.sort_array(F.collect_set("item_id")).alias("items")), "hits")

    joined = slim.join(hits.select("p0", "p1", "hits", "items", every).hint("shuffle_hash"), ["p0", "p1", "share"], "left")
    joined = joined.select("doc_id", "n_words", F.coalesce("hits", F.expr("CAST(array() AS array<struct<start:int,length:int>>)")).alias("hits"), F.coalesce("items", F.expr("CAST(array() AS array<string>)")).alias("items"))
    covered = F.expr("CAST(size(array_distinct(flatten(transform(hits, h -> sequence(h.start, h.start + h.length - 1))))) AS bigint)")
    return joined.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        "hits",
    )
