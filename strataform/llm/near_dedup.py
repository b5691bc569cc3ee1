"""Near-duplicate documents by HyperMinHash signatures.

1. One Arrow pass hashes every word shingle of every text. Per document it keeps
   the number of distinct shingles, a 128-bit fingerprint of the whole set, and a
   HyperMinHash sketch: 128 buckets, each holding the least hash of its shingles
   as a leading-zero count and 10 mantissa bits (16 bits in all). Empty buckets
   borrow from a full one in an order fixed per bucket, so short texts band well.
2. Documents with the same fingerprint form a class; only the smallest doc_id of
   a class goes on, so thousands of copies cost one row each.
3. 32 bands of 4 registers. Within a bucket of a band, every class is paired
   with the bucket's smallest id only (a star, never all pairs).
4. Pairs whose collision-corrected Jaccard estimate is far too low go; the rest
   are confirmed on the full shingle sets. Confirmed links make components.
5. A hub with all that met it in some bucket is a family. Families that still
   hold several components get the pairs *between* those components compared on
   their full sets, so a link that does not pass through a hub is found as well. If
   all but the largest component are at most ``FAMILY`` documents and ``SHINGLES``
   shingles, that component is cut into blocks and the rest goes to each. Other
   families are banded again, up to ``DEPTH`` times, each time by the bands after
   the last one: what agrees by chance or by a shared template falls apart,
   near-duplicates stay together. A family whose parts would be more work than
   itself, and what is left in the end, is compared block by block. A comparison
   gives only links that join two components. Nothing is capped.

No task gathers a hub, a node or a family: their rows are dealt out in shares, and
what is known of the hub goes to each share that has rows.

A pair at similarity 0.8 shares no band with probability (1 - 0.8^4)^32 = 5e-8, and
fewer than three with 1.2e-5: so much is missed of pairs that only families banded
three times hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.llm import scratch, words as W

REGISTERS, ROWS_PER_BAND, MANTISSA = 128, 4, 10
BUCKET_BITS = 7
#: Documents and shingles of a family that one task compares, and how often a larger one is banded again.
FAMILY, SHINGLES, DEPTH = 2048, 1 << 20, 3
#: Rows of a hub, or of a node, in one share, in expectation; shares of a node of the links.
SHARE, SHARES = 1024, 64
#: Estimates have a deviation of 0.036 at 0.8; below this margin a pair is not worth confirming.
MARGIN = 0.2


def shingle_keys(w: W.Words, rows: int, k: int) -> tuple[np.ndarray, int]:
    """Sorted distinct (row, shingle) keys: the row in the top bits, the hash below; and the bits of the hash.

    A row of 1 to k-1 words gives its whole word sequence as its only shingle.
    """
    bits = 64 - max(1, (rows - 1).bit_length())
    hashes, whole = w.windows(k)
    length = np.diff(w.first)
    short = np.flatnonzero((length > 0) & (length < k))
    keys = (w.row[: len(hashes)].astype(np.uint64) << np.uint64(bits) | hashes >> np.uint64(64 - bits))[whole]
    if len(short):
        h = W._ranges(w.hash, w.first[:-1][short], w.first[1:][short])
        keys = np.concatenate([keys, short.astype(np.uint64) << np.uint64(bits) | h >> np.uint64(64 - bits)])
    keys.sort()
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys, bits


def _compress(value: np.ndarray, bits: int) -> np.ndarray:
    """Leading zeros and the first mantissa bits of values of so many bits, as 16 bits."""
    exact = value.astype(np.float64)
    exponent = np.frexp(exact)[1]  # 0 for 0
    shift = np.maximum(exponent - 1 - MANTISSA, 0).astype(np.uint64)
    lift = np.maximum(MANTISSA - exponent + 1, 0).astype(np.uint64)
    mantissa = (value >> shift << lift) & np.uint64((1 << MANTISSA) - 1)
    zeros = (bits - exponent).astype(np.uint64)
    return (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)


def _probes() -> np.ndarray:
    """For each bucket, the order in which it looks for a full bucket to borrow from."""
    spread = W.mix(np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + np.uint64(1)).reshape(REGISTERS, REGISTERS)
    return np.argsort(spread, axis=1)


_PROBES = _probes()


def sketch(keys: np.ndarray, bits: int, rows: int) -> np.ndarray:
    """Registers of each row, rows x REGISTERS; all 0xFFFF where a row has no shingle."""
    out = np.full((rows, REGISTERS), 0xFFFF, np.uint16)
    if not len(keys):
        return out
    value_bits = bits - BUCKET_BITS
    cell = keys >> np.uint64(value_bits)
    least = np.concatenate([[True], cell[1:] != cell[:-1]])  # sorted: the first of a cell is its minimum
    value = keys[least] & np.uint64((1 << value_bits) - 1)
    # 40 bits everywhere: the number of row bits, which varies with the chunk, must not show
    out.reshape(-1)[cell[least].astype(np.int64)] = _compress(value >> np.uint64(value_bits - 40), 40)
    full = out != 0xFFFF
    filled = full.any(axis=1)
    row, bucket = np.nonzero(~full & filled[:, None])
    for t in range(REGISTERS):
        if not len(row):
            break
        source = _PROBES[bucket, t]
        found = full[row, source]
        out[row[found], bucket[found]] = out[row[found], source[found]]
        row, bucket = row[~found], bucket[~found]
    return out


def collision_rate() -> float:
    """Chance that the registers of two disjoint sets of like size agree, by summing over the float cells."""
    zeros, mantissa = np.meshgrid(np.arange(40), np.arange(1 << MANTISSA), indexing="ij")
    low = 2.0 ** -(zeros + 1.0) * (1 + mantissa / (1 << MANTISSA))
    high = low + 2.0 ** -(zeros + 1.0) / (1 << MANTISSA)
    rates = []
    for per_bucket in (2.0, 16.0, 256.0):
        cell = np.exp(-per_bucket * low) - np.exp(-per_bucket * high)
        rates.append(float((cell * cell).sum()))
    return max(rates)


def jaccard_estimate(a: np.ndarray, b: np.ndarray, rate: float) -> np.ndarray:
    """Jaccard similarity from registers, less what chance collisions contribute."""
    agree = (a == b).mean(axis=-1)
    return np.maximum(0.0, (agree - rate) / (1 - rate))


def _registers(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros((0, REGISTERS), np.uint16)
    offsets = np.frombuffer(column.buffers()[1], np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[column.offset] : offsets[column.offset + len(column)]]
    return data.view(np.uint16).reshape(len(column), REGISTERS)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in rows], pa.binary())


def _sum_by_row(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    out = np.zeros(rows, np.uint64)
    if len(values):
        at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[at]] = np.add.reduceat(values, at)
    return out


def _sketches(k: int, fold: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, offsets, data in W.texts(batch.column(1)):
                rows = len(offsets) - 1
                keys, bits = shingle_keys(W.words(offsets, data, fold), rows, k)
                row = (keys >> np.uint64(bits)).astype(np.int64)
                # 52 bits whatever the chunk holds, so that fingerprints agree between chunks
                shingle = (keys & np.uint64((1 << bits) - 1)) >> np.uint64(bits - 52)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, rows),
                        pa.array(np.bincount(row, minlength=rows), pa.int64()),
                        pa.array(_sum_by_row(W.mix(shingle + np.uint64(1)), row, rows).view(np.int64)),
                        pa.array(_sum_by_row(W.mix(shingle ^ np.uint64(0x5851F42D4C957F2D)), row, rows).view(np.int64)),
                        _binary(sketch(keys, bits, rows)),
                    ],
                    ["id", "n_shingles", "print1", "print2", "sketch"],
                )

    return run


BANDS = REGISTERS // ROWS_PER_BAND
_WHICH = W.mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def _band_keys(column: pa.Array) -> np.ndarray:
    packed = np.ascontiguousarray(_registers(column)).view(np.uint64)  # 4 registers of 16 bits
    return W.mix(packed ^ _WHICH[None, :])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = _band_keys(batch.column(1)).view(np.int64)
        ids = np.repeat(np.arange(len(batch)), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), batch.column(0).take(pa.array(ids))], ["band", "id"])


def _narrower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of a family (parent, id, component, n_shingles, share, parent_n, last, sketch) for each band after its last one."""
    for batch in batches:
        for at in range(0, len(batch), W.ROWS):
            part = batch.slice(at, W.ROWS)
            parent, last = part.column(0).to_numpy().view(np.uint64), part.column(6).to_numpy()
            row, band = np.nonzero(np.arange(BANDS)[None, :] > last[:, None])
            keys = W.mix(parent[row] ^ W.mix(_band_keys(part.column(7))[row, band]))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), *(part.column(k).take(take) for k in range(6)), pa.array(band.astype(np.int32))],
                ["group", *part.schema.names[:6], "last"],
            )


def _likely(least: float):
    rate = collision_rate()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = jaccard_estimate(_registers(batch.column(2)), _registers(batch.column(3)), rate) >= least
            yield batch.select([0, 1, 4]).filter(pa.array(keep))

    return run


def _sets(k: int, fold: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, offsets, data in W.texts(batch.column(1)):
                rows = len(offsets) - 1
                keys, bits = shingle_keys(W.words(offsets, data, fold), rows, k)
                edge = np.searchsorted(keys >> np.uint64(bits), np.arange(rows + 1, dtype=np.uint64))
                shingle = (keys & np.uint64((1 << bits) - 1)) >> np.uint64(bits - 52)
                sets = pa.array([shingle[edge[i] : edge[i + 1]].tobytes() for i in range(rows)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), sets], ["id", "shingles"])

    return run


def _linked(similarity: tuple[int, int]):
    top, bottom = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([a, b])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(bottom * shared >= top * (len(both) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _across(least: float, similarity: tuple[int, int]):
    """Confirmed links of a block: side 0 with side 1, and with itself if ``own``; only those that join two components."""
    rate, (top, bottom) = collision_rate(), similarity

    def run(table: pa.Table) -> pa.Table:
        ids, component, side = (table[c].to_numpy() for c in ("id", "component", "side"))
        own_too = table["own"][0].as_py()
        registers = _registers(table["sketch"].combine_chunks())
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"]]
        size = np.array([len(x) for x in sets])
        vocabulary, code = np.unique(np.concatenate(sets), return_inverse=True)
        edge = np.concatenate([[0], np.cumsum(size)])
        owner = {c: c for c in component.tolist()}

        def find(x: int) -> int:
            while owner[x] != x:
                owner[x] = x = owner[owner[x]]
            return x

        links = []
        place = np.arange(len(ids))
        for i in np.flatnonzero(side == 0):
            right = place[(component != component[i]) & ((side == 1) | (own_too & (place > i)))]
            right = right[bottom * np.minimum(size[right], size[i]) >= top * np.maximum(size[right], size[i])]
            right = right[jaccard_estimate(registers[right], registers[i], rate) >= least]
            if not len(right):
                continue
            own = np.zeros(len(vocabulary), bool)
            own[code[edge[i] : edge[i + 1]]] = True
            for j in right:
                shared = int(own[code[edge[j] : edge[j + 1]]].sum())
                if bottom * shared >= top * (size[i] + size[j] - shared):
                    x, y = find(int(component[i])), find(int(component[j]))
                    if x != y:
                        owner[max(x, y)] = min(x, y)
                        links.append((int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def _beside(rows: DataFrame, data: DataFrame, key: str, places: DataFrame | None = None) -> DataFrame:
    """Rows with the one row of data of their key, which goes to each share of the key that has rows (those of ``places``)."""
    return rows.join((places or rows).select(key, "share").distinct().join(data, key), [key, "share"])


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable id of every linked id, by alternating large and small stars.

    links: columns a, b of linked ids, in any order and number. Returns id, component.
    Each round is a written table, so lineage stays short; rounds grow with the
    logarithm of the longest chain. No round gathers a component, or the links of
    one node, in one task.
    """
    edges = scratch.written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        # done once every node has one smaller neighbour, which has none: read from the last round's table
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("small")).unionAll(edges.select("b", F.lit(0)).distinct())
        if ends.groupBy("node").agg(F.sum("small").alias("small"), F.count("*").alias("n")).filter("small > 0 AND n > 1").isEmpty():
            break
        up = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.pmod(F.xxhash64("a"), F.lit(SHARES)).cast("int").alias("share"))
        centre = edges.unionAll(up.select("a", "b")).groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = _beside(up, centre, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = scratch.written(small.unionAll(low.select("a", F.col("m").alias("b"))).distinct(), "stars")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


def _share(n: str):
    return F.pmod(F.xxhash64("id"), F.ceil(F.col(n) / SHARE)).cast("int").alias("share")


def _late_links(rows: DataFrame, heads: DataFrame, sets: DataFrame, least: float, similarity: tuple[int, int]) -> list[DataFrame]:
    """Links between components of the same family, by families that fall apart until one task can compare them.

    rows: group, parent, id, component, n_shingles, share, parent_n, last.
    """
    own, found, before = ["group", "id", "component", "n_shingles"], [], None

    def compare(dealt: DataFrame, name: str) -> None:
        full = dealt.join(heads.select("id", "sketch"), "id").join(sets, "id").select("group", "low", "high", "id", "component", "side", "own", "sketch", "shingles")
        found.append(scratch.written(full.groupBy("group", "low", "high").applyInArrow(_across(least, similarity), "a bigint, b bigint"), name))

    def in_blocks(families: DataFrame, name: str) -> None:
        blocks = F.ceil(F.greatest(F.col("n") / FAMILY, F.col("all") / SHINGLES)).cast("int")
        dealt = families.withColumn("blocks", blocks).withColumn("home", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        low, high = F.least("home", "other"), F.greatest("home", "other")
        compare(dealt.select(*own, low.alias("low"), high.alias("high"), (F.col("home") > F.col("other")).cast("int").alias("side"), (low == high).alias("own")), name)

    for depth in range(DEPTH + 1):
        of = F.sum(F.xxhash64("id").cast("decimal(38,0)"))
        told = (
            rows.groupBy("group", "component")
            .agg(F.count("*").alias("c"), F.sum("n_shingles").alias("s"), of.alias("print"), F.first("last").alias("last"), F.first("parent").alias("parent"), F.first("parent_n").alias("parent_n"))
            .groupBy("group")
            .agg(
                F.count("*").alias("components"), F.sum("c").alias("n"), F.sum("s").alias("all"), F.sum("print").alias("print"), F.max(F.struct("c", "s", "component")).alias("top"),
                F.first("last").alias("last"), F.first("parent").alias("parent"), F.first("parent_n").alias("parent_n"),
            )
            .filter("components > 1")
        )
        # of groups of the same documents one is looked at, that of the earliest band
        once = told.groupBy("n", "all", "print").agg(F.min(F.struct("last", "group", "top", "parent", "parent_n")).alias("one")).select("n", "all", "one.group", "one.top", "one.parent", "one.parent_n")
        if before is not None:
            once = scratch.written(once, f"told-{depth}")
            stubborn = scratch.written(once.groupBy("parent").agg(F.sum(F.col("n") * F.col("n")).alias("work"), F.first("parent_n").alias("n")).filter("work >= n * n").select(F.col("parent").alias("group")), f"stubborn-{depth}")
            if not stubborn.isEmpty():
                in_blocks(_beside(before.select(*own, "n", "all", _share("n")), stubborn, "group"), f"stubborn-links-{depth}")
                once = once.join(stubborn.withColumnRenamed("group", "parent"), "parent", "left_anti")
        live = scratch.written(_beside(rows, once.select("group", "n", "all", "top"), "group").select(*own, "n", "all", "top", "last"), f"families-{depth}")
        if live.isEmpty():
            break
        fits = (F.col("n") - F.col("top.c") <= FAMILY) & (F.col("all") - F.col("top.s") <= SHINGLES)
        blocks = F.ceil(F.greatest(F.col("top.c") / FAMILY, F.col("top.s") / SHINGLES)).cast("int")
        in_top = F.col("component") == F.col("top.component")
        places = F.when(in_top, F.array(F.pmod(F.xxhash64("id"), blocks).cast("int"))).otherwise(F.sequence(F.lit(0), blocks - 1))
        small = live.filter(fits).select(*own, in_top.cast("int").alias("side"), F.explode(places).alias("low"), F.lit(-1).alias("high"))
        compare(small.withColumn("own", F.col("low") == 0), f"late-links-{depth}")
        before = live.filter(~fits)
        if before.isEmpty():
            break
        if depth == DEPTH:
            in_blocks(before, "last-links")
            break
        again = before.select(F.col("group").alias("parent"), "id", "component", "n_shingles", _share("n"), F.col("n").alias("parent_n"), "last").join(heads.select("id", "sketch"), "id")
        again = again.select("parent", "id", "component", "n_shingles", "share", "parent_n", "last", "sketch")
        schema = "group bigint, parent bigint, id bigint, component bigint, n_shingles bigint, share int, parent_n bigint, last int"
        rows = scratch.written(W.over(again, _narrower, schema), f"narrower-{depth}")
    return found


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    similarity: tuple[int, int] = (80, 100),
    fold_case: bool = True,
) -> DataFrame:
    """Component of near-duplicates of every document.

    Words are runs outside ASCII white space, A-Z lower-cased with ``fold_case``;
    a text of fewer than ``shingle_words`` words is one shingle. Two documents are
    linked if bottom * intersection >= top * union for similarity (top, bottom).

    Returns one row per input row: doc_id, n_shingles, component_id (the smallest
    id reachable), kept (doc_id = component_id). Null or empty texts, and texts of
    white space only, have no shingle and are linked with nothing. A row with a
    null id is linked with nothing: its component_id is null and it is kept.
    Repeated rows of one id all get that id's component; an empty table gives an
    empty result; other columns are ignored, whatever their names. Ids are integers.
    """
    top, bottom = similarity
    least = top / bottom - MARGIN
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    base = scratch.written(
        W.over(rows, _sketches(shingle_words, fold_case), "id bigint, n_shingles bigint, print1 bigint, print2 bigint, sketch binary"), "sketches"
    )
    full = base.filter("n_shingles > 0 AND id IS NOT NULL")
    same = ["print1", "print2", "n_shingles"]
    # written first: joined straight from its aggregate, a class of very many copies could not be split over tasks
    classes = scratch.written(full.groupBy(*same).agg(F.min("id").alias("head"), F.max("id").alias("far")).filter("head < far").select(*same, "head"), "classes")
    named = scratch.written(full.select("id", *same).join(classes, same, "left").select("id", F.coalesce("head", "id").alias("head")), "heads-of")
    single = full.join(classes, same, "left").filter("head IS NULL OR head = id")
    heads = scratch.written(single.select("id", "n_shingles", "sketch").dropDuplicates(["id"]), "heads")

    banded = W.over(heads.select("id", "sketch"), _bands, "band bigint, id bigint")
    hubs = banded.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("far"), F.count("*").alias("n")).filter("hub < far")
    hubs = scratch.written(hubs.select("band", "hub", "n"), "hubs")  # written first, as above
    met = banded.join(hubs, "band").filter("id <> hub").groupBy("hub", "id").agg(F.max("n").alias("n"))
    met = scratch.written(met.select("hub", "id", _share("n")), "met")

    one = heads.select(F.col("id").alias("hub"), F.col("sketch").alias("sketch_a"))
    likely = _beside(met.join(heads, "id"), one, "hub", met).select("hub", "id", "sketch_a", "sketch", "share")
    likely = W.over(likely, _likely(least), "hub bigint, id bigint, share int")
    # one path at every size: the texts are dealt out by id, and those of compared ids go on
    ids = met.select(F.explode(F.array("hub", "id")).alias("id")).distinct()
    texts = rows.join(ids.hint("shuffle_hash"), "id", "left_semi").dropDuplicates(["id"])
    sets = scratch.written(W.over(texts, _sets(shingle_words, fold_case), "id bigint, shingles binary"), "sets")
    one = sets.select(F.col("id").alias("hub"), F.col("shingles").alias("set_a"))
    confirmed = W.over(_beside(likely.join(sets, "id"), one, "hub", met).select("hub", "id", "set_a", "shingles"), _linked(similarity), "hub bigint, id bigint")
    found = components(confirmed.select(F.col("hub").alias("a"), F.col("id").alias("b")))

    # a family is a hub with all it met; only families in several components are looked at again
    family = met.unionAll(met.select("hub", F.col("hub").alias("id"), F.lit(0).alias("share")).distinct())
    placed = family.join(found, "id", "left").join(heads.select("id", "n_shingles"), "id")
    placed = placed.select(
        F.col("hub").alias("group"), F.lit(0).cast("bigint").alias("parent"), "id", F.coalesce("component", "id").alias("component"), "n_shingles", "share", F.lit(0).cast("bigint").alias("parent_n"), F.lit(-1).alias("last")
    )
    late = _late_links(scratch.written(placed, "families"), heads, sets, least, similarity)
    if late and not all(x.isEmpty() for x in late):
        links = found.select(F.col("id").alias("a"), F.col("component").alias("b"))
        for x in late:
            links = links.unionAll(x)
        found = components(links)

    labelled = named.join(found.withColumnRenamed("id", "head"), "head", "left").select("id", F.coalesce("component", "head").alias("component")).distinct()
    return base.select("id", "n_shingles").join(labelled, "id", "left").select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )
