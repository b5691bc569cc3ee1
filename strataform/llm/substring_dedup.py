"""Repeated passages of documents by prefix-partitioned suffix trees.

A repeat that counts is a window of ``window`` words that also starts earlier. In the
suffix tree of the corpus, cut at that depth, equal windows are the leaves below one
internal node at least ``window`` words deep. The tree is built in parts:

0. A text that is wholly the same as that of a smaller id starts earlier in every
   window; it goes as a whole and takes no further part.
1. Suffixes are dealt out by prefixes of varying length. Of the 6-word sequences in
   a window, the one of least hash is its anchor, so equal windows have equal anchors
   at the same place; windows that follow each other mostly share theirs. An anchor
   that occurs once in the corpus ends the matter for its windows. Those of the others
   form one stretch of words round the anchor, which goes to the group of its anchor.
   An anchor with more than ``group`` stretches gets a longer prefix, ``window`` words
   from the anchor on, and shares by id; so no group exceeds memory, whatever its key.
2. A task codes the words of its stretches, sorts all their suffixes by doubling (1,
   2, 4, 8, 16, ``window`` words) and computes the common prefix of each two
   neighbours. A run of neighbours that have ``window`` words in common is an internal
   node. All its leaves but the first, by (doc_id, start), are repeats.
3. Where an anchor was dealt to several groups, the first leaf of each node goes, as a
   stretch of one window, to the group of the whole window, and step 2 is done again.
4. Repeated windows go back to their document, which drops the words they cover;
   runs of such windows are the maximal repeats.

Words are compared by 40 bits of their hashes, 20 words at a time, after 64 bits of
the anchor's hash: equal codes of a whole window count as equal words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.llm import scratch
from strataform.llm import words as W

ANCHOR = 6
#: Stretches of a group, and those that a task sorts at a time.
GROUP, SORTED = 8_192, 8_192
#: An anchor with more than this share of the repeated ones is dealt out without a join on it; so many there are at most.
HOT = 4096
CODE = 5
_POSITION_BITS = np.uint64(28)


def _window_anchors(w: W.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word that starts a whole window: whether it does, the anchor's word index; and all 6-word hashes.

    The least of the top 36 hash bits wins, the leftmost on ties: the same place in equal windows.
    """
    n = len(w.hash) - window + 1
    if n <= 0:
        return np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams, _ = w.windows(ANCHOR)
    key = grams >> _POSITION_BITS << _POSITION_BITS | np.arange(len(grams), dtype=np.uint64)
    span, width = window - ANCHOR + 1, 1
    while 2 * width <= span:
        key = np.minimum(key[: len(key) - width], key[width:])
        width *= 2
    least = np.minimum(key[:n], key[span - width : span - width + n])
    at = (least & np.uint64((1 << 28) - 1)).astype(np.int64)
    return w.row[:n] == w.row[window - 1 :], at, grams


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, same = batch.column(0).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            for first, offsets, data in W.texts(batch.column(1)):
                w = W.words(offsets, data)
                whole, at, grams = _window_anchors(w, window)
                at = at[whole]
                at = at[_starts(at)]
                row = w.row[at]
                place = at - w.first[row]
                where = W.mix(same[first + row] + place.astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[at].view(np.int64)), pa.array(ids[first + row]), pa.array(place.astype(np.int32)), pa.array(where.view(np.int64))],
                    ["anchor", "id", "at", "place"],
                )

    return run


def _ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., length[0] of them, then those of start[1], and so on."""
    edge = np.cumsum(length)
    return np.arange(edge[-1] if len(edge) else 0) + np.repeat(start - edge + length, length)


STRETCH = "part bigint, id bigint, start int, n int, codes binary, shared boolean"


def _binary(values: np.ndarray, length: np.ndarray) -> pa.Array:
    """One binary value of so many words each, of the low ``CODE`` bytes of every word."""
    low = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CODE])
    offsets = np.concatenate([[0], np.cumsum(length * CODE)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(low)])


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All words of a column of stretches, and how many each has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    wide = np.zeros((len(data) // CODE, 8), np.uint8)
    wide[:, :CODE] = data.reshape(-1, CODE)
    return wide.view("<u8").reshape(-1), np.diff(offsets) // CODE


def _stretches(window: int):
    """The words of all windows of each marked anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            marks = batch.column(2)
            edge = marks.offsets.to_numpy()
            marked_at, marked_shares = (marks.values.field(k).to_numpy() for k in (0, 1))
            for first, offsets, data in W.texts(batch.column(1)):
                w = W.words(offsets, data)
                rows = len(offsets) - 1
                whole, at, grams = _window_anchors(w, window)
                count = np.diff(edge[first : first + rows + 1])
                inner = slice(edge[first], edge[first + rows])
                shares = np.zeros(len(w.hash) + 1, np.int32)
                shares[np.repeat(w.first[:-1], count) + marked_at[inner]] = marked_shares[inner]
                start = np.flatnonzero(whole & (shares[at] > 0))
                if not len(start):
                    continue
                # windows that follow each other with the same anchor are one stretch
                fresh = _starts(at[start])
                low, n = start[fresh], np.diff(np.append(fresh, len(start)))
                anchor, length = at[low], n + window - 1
                row = w.row[low]
                own, share = ids[first + row], shares[anchor].astype(np.uint64)
                long = w.windows(window)[0]
                longer = W.mix(long[np.minimum(anchor, len(long) - 1)] ^ W.mix(own.astype(np.uint64)) % share)
                part = np.where(share > 1, W.mix(grams[anchor] ^ longer), grams[anchor])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.view(np.int64)), pa.array(own), pa.array((low - w.first[row]).astype(np.int32)), pa.array(n.astype(np.int32)), _binary(w.hash[_ragged(low, length)], length), pa.array(share > 1)],
                    ["part", "id", "start", "n", "codes", "shared"],
                )

    return run


class Subtree:
    """Suffixes of some stretches in order, with the common prefix of each and the next, up to ``window`` words."""

    def __init__(self, codes: np.ndarray, suffix: np.ndarray, window: int) -> None:
        rank = np.unique(codes, return_inverse=True)[1]
        ranks, width = {1: rank}, 1
        while width < window:
            step = min(width, window - width)  # the last step overlaps
            follow = np.concatenate([rank[step:], np.zeros(step, np.int64)])
            rank = np.unique(rank * (int(follow.max()) + 1) + follow, return_inverse=True)[1]
            width += step
            ranks[width] = rank
        self.order = np.argsort(rank[suffix], kind="stable")
        sorted_suffix = suffix[self.order]
        a, b = sorted_suffix[:-1], sorted_suffix[1:]
        self.common = np.where(rank[a] == rank[b], window, 0)
        open_ = np.flatnonzero(self.common == 0)
        for size in sorted((k for k in ranks if k < window), reverse=True):
            at = self.common[open_]
            inside = at + size <= window
            same = inside & (ranks[size][np.minimum(a[open_] + at, len(codes) - 1)] == ranks[size][np.minimum(b[open_] + at, len(codes) - 1)])
            self.common[open_] += size * same

    def nodes(self, depth: int) -> np.ndarray:
        """For each suffix in order, the number of its node: a run with at least so many words in common."""
        return np.cumsum(np.concatenate([[0], self.common < depth]))


def _repeats(window: int, firsts: bool = False):
    """Windows of each stretch that have an earlier leaf below their node; or, with ``firsts``, the first leaves of shared stretches as stretches."""

    def judged(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        ids, start, n = (table[c].to_numpy() for c in ("id", "start", "n"))
        codes, length = _codes(table["codes"].chunk(0))
        row = np.repeat(np.arange(len(ids)), n)
        suffix = _ragged(np.cumsum(length) - length, n)
        own, place = ids[row], (start[row] + _ragged(np.zeros(len(n), np.int64), n)).astype(np.int64)
        tree = Subtree(codes, suffix, window)
        node = np.empty(len(suffix), np.int64)
        node[tree.order] = tree.nodes(window)
        order = np.lexsort((place, own, node))
        first = _starts(node[order])
        if firsts:
            met = np.sort(order[first])
            words = codes[_ragged(suffix[met], np.full(len(met), window))]
            key = W._ranges(W.mix(words), np.arange(len(met)) * window, (np.arange(len(met)) + 1) * window)
            one, many = np.ones(len(met), np.int32), np.full(len(met), window)
            return pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(own[met]), pa.array(place[met].astype(np.int32)), pa.array(one), _binary(words, many), pa.array(one < 0)], ["part", "id", "start", "n", "codes", "shared"]
            )
        leaf = np.repeat(order[first], np.diff(np.append(first, len(order))))
        again = np.zeros(len(suffix), bool)
        again[order] = (own[order] != own[leaf]) | (place[order] != place[leaf])
        gone = np.flatnonzero(again)
        edge = np.searchsorted(row[gone], np.arange(len(ids) + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(place[gone].astype(np.int32)))
        some = pa.array(np.diff(edge) > 0)
        return pa.RecordBatch.from_arrays([pa.array(ids).filter(some), lists.filter(some)], ["id", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if firsts:
                batch = batch.filter(batch.column(5))
            held.append(batch)
            rows += len(batch)
            if rows < SORTED:
                continue
            table = pa.Table.from_batches(held)
            part = table["part"].to_numpy()
            cut = int(_starts(part)[-1])  # the last group may go on
            if cut:
                yield judged(table.slice(0, cut))
                held, rows = table.slice(cut).to_batches(), rows - cut
        if rows:
            yield judged(pa.Table.from_batches(held))

    return run


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, starts, copy = batch.column(1), batch.column(2), batch.column(3)
            n_words, n_removed, digest, spans, kept_text = [], [], [], [], []
            for i in range(len(batch)):
                own = (text[i].as_py() or "").encode().split()
                n_words.append(len(own))
                at = np.arange(max(0, len(own) - window + 1)) if copy[i].as_py() else np.array(starts[i].as_py() or (), np.int64)
                cover = np.zeros(len(own) + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
                n_removed.append(int(gone.sum()))
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans.append(edges.reshape(-1, 2).tolist())
                kept = b" ".join(own if not len(at) else [own[k] for k in np.flatnonzero(~gone)])
                digest.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept.decode())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(digest, pa.string()),
                    pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                    pa.array(kept_text, pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "removed_spans", "kept_text"],
            )

    return run


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20, group: int = GROUP) -> DataFrame:
    """Every document without the words of passages that start earlier in the corpus.

    Words are runs outside ASCII white space. A word goes if some ``window`` of
    consecutive words that covers it also starts earlier: in a document of smaller
    id, or earlier in the same one. Windows are those of the input.

    Returns one row per input row: doc_id, n_words, n_removed, kept_sha256 (of the
    kept words joined by one space), removed_spans (maximal [from, to) word
    ranges) and kept_text. Null and empty texts have no words. A null id orders
    after nothing and before nothing: such a row keeps all its words and counts
    for no other. Repeated rows of one id are one document, and none is removed
    on account of the other. An empty table gives an empty result; other columns
    are ignored, whatever their names. Ids are integers, ``window`` is at least 7.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a plain column: an alias of the same name would make the reads of the dealt text differ, and deal it out again
    text = F.col(text_col) if text_col == "text" else F.col(text_col).alias("text")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text)
    named = rows.filter("id IS NOT NULL")
    dealt = named.repartition(parts, "id")  # one exchange of the text, read by all joins below

    texts = named.select("id", F.md5("text").alias("print"))
    heads = texts.filter("print IS NOT NULL").groupBy("print").agg(F.min("id").alias("head"), F.max("id").alias("far")).filter("head < far")
    heads = scratch.written(heads.select("print", "head"), "heads")  # written first, so that a print with very many copies can be split over tasks
    copies = scratch.written(texts.join(heads, "print").filter("id > head").select("id").distinct(), "copies")

    anchors = W.over(named.select("id", "text", F.xxhash64("text").alias("same")), _anchors(window), "anchor bigint, id bigint, at int, place bigint")
    # copies of a text have its anchors at the same places, which makes no anchor a repeated one
    often = anchors.groupBy("anchor").agg(F.count("*").alias("n"), F.min("place").alias("p0"), F.max("place").alias("p1")).filter("p0 <> p1").select("anchor", "n")
    often = scratch.written(often, "often")
    total = often.agg(F.sum("n")).first()[0] or 0
    hot = often.filter(F.col("n") > total / HOT).withColumnRenamed("n", "hot_n")  # fewer than HOT rows
    # hot anchors know their number already; a key of their own keeps them from meeting in one task
    flagged = anchors.drop("place").join(F.broadcast(hot), "anchor", "left")
    flagged = flagged.withColumn("key", F.when(F.col("hot_n").isNull(), F.col("anchor")).otherwise(F.xxhash64("id", "at")))
    known = flagged.join(often.withColumnRenamed("anchor", "key"), "key", "left").withColumn("n", F.coalesce("hot_n", "n")).filter("n IS NOT NULL")
    marks = (
        known.groupBy("id")
        .agg(F.collect_list(F.struct("at", F.ceil(F.col("n") / group).cast("int").alias("shares"))).alias("marks"))
        .join(copies, "id", "left_anti")
    )
    stretches = W.over(dealt.join(marks, "id").select("id", "text", "marks"), _stretches(window), STRETCH).repartition(parts, "part").sortWithinPartitions("part")
    schema = "id bigint, starts array<int>"
    # the shared rows are picked in Python, so that both readers share one exchange
    firsts = W.over(stretches, _repeats(window, firsts=True), STRETCH).repartition(parts, "part").sortWithinPartitions("part")
    repeats = W.over(stretches, _repeats(window), schema).unionAll(W.over(firsts, _repeats(window), schema))
    starts = repeats.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))

    result = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, removed_spans array<array<bigint>>, kept_text string"
    gone = starts.join(copies.withColumn("copy", F.lit(True)), "id", "full").select("id", "starts", "copy")
    nameless = rows.filter("id IS NULL").select("id", "text", F.lit(None).cast("array<int>").alias("starts"), F.lit(None).cast("boolean").alias("copy"))
    return W.over(dealt.join(gone, "id", "left").select("id", "text", "starts", "copy").unionAll(nameless), _kept(window), result)
