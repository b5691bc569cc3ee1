"""Token ids of documents, packed into sequences of equal length.

Documents longer than a sequence are split without loss. Pieces go into sequences
by best fit decreasing: a segment tree over the free room finds the open sequence
with the least room that still fits. Pools of pieces are packed as they come, so
nothing is shuffled, memory is bounded, and a lost task is simply run again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.llm import words as W

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: how this vocabulary's tokenizer splits text, with possessive loops, which split alike but faster
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
LENGTH, POOL = 2048, 1 << 20


class Encoder:
    """Byte-pair encoding with ordinary tokens only."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.free = max(ranks.values()) + 1  # padding

    def encode(self, text: bytes) -> np.ndarray:
        return np.array(self.coding.encode_ordinary(text.decode()), np.uint32)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Room:
    """Segment tree over free room 0..length: the least room of at least some size that an open sequence has."""

    def __init__(self, length: int) -> None:
        self.leaves = 1 << length.bit_length()
        self.any = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def put(self, room: int, sequence: int) -> None:
        self.open.setdefault(room, []).append(sequence)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        k = room + self.leaves
        while k:
            self.any[k] += by
            k //= 2

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, sequence) of the best fit, which is then no longer open; None if nothing fits."""
        k = size + self.leaves
        while not self.any[k]:
            while k & 1:  # a right child: go up
                k //= 2
            if k == 0:
                return None
            k += 1
        while k < self.leaves:
            k = 2 * k if self.any[2 * k] else 2 * k + 1
        room = k - self.leaves
        sequence = self.open[room].pop()
        self._change(room, -1)
        return room, sequence


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Which pieces go into which sequence; every size is at most ``length``."""
    room, out = Room(length), []
    for piece in sorted(range(len(sizes)), key=lambda p: (-sizes[p], p)):
        fit = room.take(sizes[piece])
        if fit is None:
            out.append([piece])
            left, at = length - sizes[piece], len(out) - 1
        else:
            left, at = fit[0] - sizes[piece], fit[1]
            out[at].append(piece)
        if left:
            room.put(left, at)
    return out


def _pack(path: str, length: int, pool: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        kind = np.dtype("<u2" if coder.free < 1 << 16 else "<u4")
        pieces: list[tuple[int | None, int, np.ndarray]] = []
        held = 0

        def emit() -> pa.RecordBatch:
            packed = best_fit_decreasing([len(x[2]) for x in pieces], length)
            ids, edges, resets, docs, froms, used = [], [], [], [], [], []
            for own in packed:
                row = np.full(length, coder.free, kind)
                edge = [0]
                for p in own:
                    row[edge[-1] : edge[-1] + len(pieces[p][2])] = pieces[p][2]
                    edge.append(edge[-1] + len(pieces[p][2]))
                ids.append(row.tobytes())
                edges.append(edge)
                resets.append(edge[:-1])
                docs.append([pieces[p][0] for p in own])
                froms.append([pieces[p][1] for p in own])
                used.append(edge[-1])
            ints = pa.list_(pa.int32())
            arrays = [pa.array(docs, pa.list_(pa.int64())), pa.array(froms, pa.list_(pa.int64())), pa.array(edges, ints), pa.array(resets, ints), pa.array(used, pa.int32()), pa.array(ids, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["doc_ids", "doc_offsets", "cu_seqlens", "position_resets", "n_tokens", "ids"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, offsets, data in W.texts(batch.column(1)):
                for i in range(len(offsets) - 1):
                    ids = coder.encode(data[offsets[i] : offsets[i + 1]].tobytes()).astype(kind)
                    for at in range(0, len(ids), length):
                        piece = ids[at : at + length]
                        pieces.append((names[first + i], at, piece))
                        held += len(piece)
                        if held >= pool:
                            yield emit()
                            pieces, held = [], 0
        if pieces:
            yield emit()

    return run


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, vocabulary: str = VOCABULARY, pool: int = POOL) -> DataFrame:
    """Packed sequences of the token ids of all documents.

    Returns one row per sequence: doc_ids and doc_offsets (of each segment: its
    document, and the place of its first token in that document's ids), cu_seqlens
    (cumulative segment lengths, from 0), position_resets (where position ids
    start again from 0), n_tokens, and ids: a matrix row of ``length`` little-endian
    ids (16 bits if the vocabulary allows, else 32), padded with the first free id.
    Null and empty texts have no tokens and appear in no sequence. Repeated rows
    are separate documents. Ids are integers; a null id stays null. Texts of any
    length are encoded whole and cut. An empty table gives an empty result; other columns are
    ignored, whatever their names. ``vocabulary`` must be at the same path on all
    executors.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_ids array<bigint>, doc_offsets array<bigint>, cu_seqlens array<int>, position_resets array<int>, n_tokens int, ids binary"
    return W.over(rows, _pack(vocabulary, length, pool), schema)

