"""Approximate nearest neighbours by adaptive dimension scan in probed lists.

Vectors are rotated by a random orthogonal matrix, so that any block of columns is
a fair sample of a distance. Centroids, fitted on a bounded sample, deal all rows
into lists. A query probes its nearest lists and scans them in column blocks:
after each block a hypothesis test drops candidates whose partial distance shows
that they lie beyond the query's bound, which is its k-th distance among the sample's
rows in those lists. What is left gets its exact distance on the original vectors.
Result rows come from the lists alone, the sample gives none. A query whose probed
lists gave fewer than k rows is searched again in all lists, without a bound.

Lists grow in number with the square root of the rows: the centroids of the sample,
and beyond what it can fit, a second level of centroids of the residuals, shared by
all of the first, so that a list is a pair of both. Lists are dealt out in shares, so
a list that holds a third of all rows is many tasks. Rows are dealt out once; a task
holds one share and streams its queries past. Only the sample, the rotation and the
centroids are broadcast, all of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataform.llm import scratch
from strataform.llm import words as W

#: Bounds of the fitted sample: rows, numbers in all, and its share of a small table, so that no table is its own sample.
SAMPLE_ROWS, SAMPLE_VALUES, SAMPLE_SHARE = 20_000, 4_000_000, 4
SHARE, QUERIES = 16_384, 64
#: Centroids of the first and of the second level at most.
FIRST, SECOND = 1024, 64
COLUMNS = 16
#: Width of the hypothesis test: larger drops fewer.
EPSILON = 2.1
RECALL = 0.99


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors in the precision in which they came."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T))


def _means(points: np.ndarray, n: int) -> np.ndarray:
    """Centroids of ten rounds, from the first ``n`` points on."""
    out = points[:n].copy()
    for _ in range(10):
        own = _squares(points, out).argmin(axis=1)
        many = np.bincount(own, minlength=n)
        for c in range(points.shape[1]):
            out[:, c] = np.where(many > 0, np.bincount(own, weights=points[:, c], minlength=n) / np.maximum(many, 1), out[:, c])
    return out


class Index:
    """Rotation, centroids, number of lists to probe, and the sample itself."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: int, k: int, seed: int = 5) -> None:
        random = np.random.default_rng(seed)
        self.dim = vectors.shape[1]
        self.rotation = np.linalg.qr(random.standard_normal((self.dim, self.dim)))[0].astype(vectors.dtype)
        self.ids, self.vectors = ids, vectors
        turned = vectors @ self.rotation
        wanted = max(1, int(math.sqrt(rows) / 2))
        lists = max(1, min(FIRST, wanted, len(ids) // 32))
        order = random.permutation(len(turned))
        # fitted on one half, calibrated on the other: fitted vectors lie nearer to their centroids than others do
        fitted, other = turned[order[: (len(order) + 1) // 2]], turned[order[(len(order) + 1) // 2 :]]
        self.first = _means(fitted, lists)
        inner = max(1, min(SECOND, wanted // lists, len(fitted) // 32))
        rest = fitted - self.first[_squares(fitted, self.first).argmin(axis=1)]
        self.second = _means(rest, inner) if inner > 1 else np.zeros((1, self.dim), turned.dtype)
        self.centroids = (self.first[:, None] + self.second[None]).reshape(-1, self.dim)
        self.probes = self._calibrate(other, k)

    def own_list(self, turned: np.ndarray) -> np.ndarray:
        """List of each rotated vector: its nearest centroid, then that of the rest."""
        one = _squares(turned, self.first).argmin(axis=1)
        return one * len(self.second) + _squares(turned - self.first[one], self.second).argmin(axis=1)

    def _calibrate(self, other: np.ndarray, k: int) -> int:
        """Least number of lists in which vectors find RECALL of their nearest others; equal vectors, always in one list, do not count."""
        some = other[:512]
        far = _squares(some, other)
        far[far < 1e-9] = np.inf
        true = np.argsort(far, axis=1, kind="stable")[:, :k]
        counts = np.isfinite(np.take_along_axis(far, true, axis=1))
        if not counts.any():
            return len(self.centroids)
        own = self.own_list(other)
        needed = []
        for at in range(0, len(some), 32):
            rank = np.argsort(np.argsort(_squares(some[at : at + 32], self.centroids), axis=1, kind="stable"), axis=1)
            needed.append(np.take_along_axis(rank, own[true[at : at + 32]], axis=1)[counts[at : at + 32]])
        needed = np.sort(np.concatenate(needed)) + 1
        return int(needed[math.ceil(RECALL * len(needed)) - 1])

    def lists_of(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` lists to probe for each query, nearest first."""
        turned = vectors @ self.rotation
        steps = [np.argsort(_squares(turned[at : at + 32], self.centroids), axis=1, kind="stable")[:, :n] for at in range(0, len(turned), 32)]
        return np.concatenate([np.zeros((0, n), np.int64), *steps])


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a.astype(np.float64) - b.astype(np.float64)) ** 2).sum(axis=-1))


def _exact_pairs(rows: np.ndarray, x: np.ndarray, queries: np.ndarray, q: np.ndarray) -> np.ndarray:
    step = max(1, SAMPLE_VALUES // rows.shape[1])
    return np.concatenate([np.zeros(0), *(_exact(rows[x[at : at + step]], queries[q[at : at + step]]) for at in range(0, len(q), step))])


def _assign(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                own = index.own_list(_matrix(batch.column(1), index.dim) @ index.rotation).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(own), batch.column(0), batch.column(1)], ["list", "id", "vector"])

    return run


def _prepare(index: Index, k: int):
    """For each query: the lists to probe, and the k-th least distance to the sample's rows in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = index.own_list(index.vectors @ index.rotation)
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                own, ids = _matrix(part.column(1), index.dim), part.column(0).to_numpy()
                lists = index.lists_of(own, index.probes).astype(np.int32)
                probed = np.zeros((len(part), len(index.centroids)), bool)
                np.put_along_axis(probed, lists, True, axis=1)
                far = _squares(own, index.vectors)
                far[(ids[:, None] == index.ids[None]) | ~probed[:, places]] = np.inf
                bounds = []
                for i in range(len(part)):
                    near = np.argpartition(far[i], min(4 * k, len(index.ids) - 1))[: 4 * k]
                    score = np.sort(_exact(index.vectors[near[np.isfinite(far[i][near])]], own[i]))
                    bounds.append(float(score[k - 1]) if len(score) >= k else float("inf"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(bounds, pa.float64()), pa.array(lists.tolist(), pa.list_(pa.int32()))], ["query_id", "vector", "bound", "lists"]
                )

    return run


def scan(turned: np.ndarray, queries: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) that survive every block's test, from rotated vectors."""
    dim = turned.shape[1]
    limit = (bounds * (1 + 1e-5)) ** 2
    width = min(COLUMNS, dim)

    def cut(seen: int) -> float:
        return 1.0 if seen >= dim else seen / dim * (1 + EPSILON / math.sqrt(seen)) ** 2

    partial = _squares(queries[:, :width], turned[:, :width])
    q, x = np.nonzero(partial <= limit[:, None] * cut(width) + 1e-6)
    total = partial[q, x]
    while width < dim and len(q):
        to = min(width + COLUMNS, dim)
        total = total + ((turned[x, width:to] - queries[q, width:to]) ** 2).sum(axis=1)
        keep = total <= limit[q] * cut(to) + 1e-6
        q, x, total, width = q[keep], x[keep], total[keep], to
    return q, x


def _search(index: Index, k: int):
    """The k nearest rows in each share for each query that probes it; rows of a share come before its queries."""

    def nearest(ids: np.ndarray, own: np.ndarray, turned: np.ndarray, part: pa.RecordBatch) -> pa.RecordBatch:
        asked, names = _matrix(part.column(4), index.dim), part.column(3).to_numpy()
        q, x = scan(turned, asked @ index.rotation, part.column(5).to_numpy())
        other = ids[x] != names[q]
        q, x = q[other], x[other]
        score = _exact_pairs(own, x, asked, q)
        order = np.lexsort((ids[x], score, q))
        q, x, score = q[order], x[order], score[order]
        # repeated rows of an id must not fill the k places: the nearest of them stays
        codes = np.unique(ids[x], return_inverse=True)[1]
        once = np.sort(np.unique(q * (len(codes) + 1) + codes, return_index=True)[1])
        q, x, score = q[once], x[once], score[once]
        top = np.arange(len(q)) - np.searchsorted(q, q) < k
        return pa.RecordBatch.from_arrays([pa.array(names[q[top]]), pa.array(ids[x[top]]), pa.array(score[top])], ["query_id", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ready = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            kinds = np.stack([batch.column(c).to_numpy() for c in range(3)])
            edges = np.concatenate([[0], np.flatnonzero((kinds[:, 1:] != kinds[:, :-1]).any(axis=0)) + 1, [len(batch)]])
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(low, high - low)
                if key != tuple(kinds[:2, low]):
                    key, held, ready = tuple(kinds[:2, low]), [], None
                if not kinds[2, low]:
                    held.append(part.select([3, 4]))
                    continue
                if not held:
                    continue
                if ready is None:
                    own = np.concatenate([_matrix(h.column(1), index.dim) for h in held])
                    ready = np.concatenate([h.column(0).to_numpy() for h in held]), own, own @ index.rotation
                for at in range(0, len(part), QUERIES):
                    yield nearest(*ready, part.slice(at, QUERIES))

    return run


def search(
    vectors: DataFrame, *, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """The k nearest rows found for each query; queries are the rows whose id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id and score (Euclidean distance in double
    precision on the original vectors), nearest first, ties to the smaller id. A
    query's own id is no candidate. Rows with a null id and vectors that are null,
    empty, zero, or hold null or non-finite components take no part; nor do those
    of another length than most (the greater on ties). A query gets min(k, all
    candidates) rows. Repeated rows of one id count once, with
    the nearest of their vectors. Doubles are searched as doubles. Fewer than two rows give
    an empty result; other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # vectors of floats stay so, which is exact; others are doubles
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    good = "vector IS NOT NULL AND size(vector) > 0 AND forall(vector, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity')) AND exists(vector, v -> v <> 0)"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast(kind).alias("vector")).filter("id IS NOT NULL").filter(good)
    result = "query_id bigint, rank int, vec_id bigint, score double"
    lengths = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], result)
    dim, n = lengths[0]
    rows = rows.filter(F.size("vector") == dim)
    wanted = max(1, min(sample_rows, SAMPLE_VALUES // dim, n // SAMPLE_SHARE))
    chosen = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) < int(min(1.0, wanted / n) * (1 << 30))
    drawn = rows.filter(chosen).dropDuplicates(["id"]).orderBy(F.xxhash64("id", F.lit(17)), "id").limit(2 * wanted).toArrow()
    if not len(drawn):
        drawn = rows.orderBy("id").limit(1).toArrow()
    index = Index(drawn["id"].to_numpy(), _matrix(drawn["vector"].combine_chunks(), dim), n, k)

    listed = scratch.written(W.over(rows, _assign(index), f"list int, id bigint, vector {kind}"), "listed")
    sizes = {r[0]: r[1] for r in listed.groupBy("list").count().collect()}  # at most as many as centroids
    asked = scratch.written(
        W.over(rows.filter(F.col("id") % every == 0).dropDuplicates(["id"]), _prepare(index, k), f"query_id bigint, vector {kind}, bound double, lists array<int>"),
        "queries",
    )
    shares = F.array(*[F.lit(max(1, math.ceil(sizes.get(c, 0) / SHARE))) for c in range(len(index.centroids))])
    dealt = listed.withColumn("share", F.pmod(F.xxhash64("id"), F.element_at(shares, F.col("list") + 1)).cast("int"))
    order = Window.partitionBy("query_id").orderBy("score", "id")

    def nearest(queries: DataFrame) -> DataFrame:
        """The k nearest rows of each query in its lists."""
        probes = queries.select("query_id", "vector", "bound", F.explode("lists").alias("list")).withColumn("share", F.explode(F.sequence(F.lit(0), F.element_at(shares, F.col("list") + 1) - 1)))
        given = dealt.select("list", "share", F.lit(0).alias("kind"), "id", "vector", F.lit(None).cast("double").alias("bound"))
        asking = probes.select("list", "share", F.lit(1).alias("kind"), F.col("query_id").alias("id"), "vector", "bound")
        met = given.unionAll(asking).repartition(parts, "list", "share").sortWithinPartitions("list", "share", "kind")
        found = W.over(met, _search(index, k), "query_id bigint, id bigint, score double")
        ranked = found.groupBy("query_id", "id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")

    first = scratch.written(nearest(asked), "nearest")
    full = first.filter(F.col("rank") == k).select("query_id")
    everywhere = F.sequence(F.lit(0), F.lit(len(index.centroids) - 1))
    short = scratch.written(asked.join(full, "query_id", "left_anti").select("query_id", "vector", F.lit(float("inf")).alias("bound"), everywhere.alias("lists")), "short")
    if short.isEmpty():
        return first
    return first.join(short.select("query_id"), "query_id", "left_anti").unionAll(nearest(short))
