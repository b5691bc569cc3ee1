"""Language of documents by rank-order n-gram profiles.

The 1- to 3-letter sequences of a language's training texts, most frequent first,
are its profile. A document's own most frequent sequences are compared with every
profile: each adds the difference of its two ranks, or the profile's length if the
profile lacks it; the least sum wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataform.llm import words as W

PROFILE = 400
#: Training documents per language, in expectation: the bound of the labelled sample.
SAMPLE = 2000
_LAST = 0x32400  # no letters beyond


#: Bytes of text whose sequences are held at a time; a longer text is counted part by part.
CHUNK = 1 << 18


@cache
def _letters() -> np.ndarray:
    """Lower case of every code point that is a letter, 0 for all others."""
    out = np.zeros(_LAST + 1, np.uint32)
    for c in range(_LAST):
        if 0xD800 <= c < 0xE000 or not chr(c).isalpha():
            continue
        low = chr(c).lower()
        out[c] = ord(low) if len(low) == 1 else c
    return out


def _points(data: np.ndarray) -> np.ndarray:
    return _letters()[np.minimum(np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), _LAST)]


def _keys(c: np.ndarray, row: np.ndarray, carried: int) -> np.ndarray:
    """Keys, (row in the top 12 bits, hash below), of the sequences that end after the first ``carried`` letters or blanks."""

    def key(size: int) -> np.ndarray:
        low = max(0, carried - size + 1)
        code, own = c[low:], row[low:]
        last = len(code) - size + 1
        if last <= 0:
            return np.zeros(0, np.uint64)
        good = own[:last] == own[size - 1 :]
        if size == 1:
            good &= code > 0
        elif size == 2:
            good &= (code[1:] > 0) | (code[:-1] > 0)
        else:
            good &= code[1:-1] > 0
        at = np.flatnonzero(good)
        value = np.full(len(at), (0, 0, 1 << 62, 1 << 63)[size], np.uint64)
        for k in range(size):
            value |= code[at + k].astype(np.uint64) << np.uint64(21 * (size - 1 - k))
        return own[at].astype(np.uint64) << np.uint64(52) | W.mix(value) >> np.uint64(12)

    return np.concatenate([key(1), key(2), key(3)])


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys.sort()
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))


def _long_counts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``gram_counts`` of one text, part by part: the last two letters or blanks lead the next part."""
    before, closed, has = np.zeros(0, np.uint32), False, False
    keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = 0
    while at < len(data):
        to = min(at + CHUNK, len(data))
        while to < len(data) and data[to] & 0xC0 == 0x80:
            to += 1
        letter = _points(data[at:to])
        keep = letter > 0
        has = has or bool(keep.any())
        blank = ~keep
        keep[1:] |= letter[:-1] > 0
        keep[0] |= closed
        closed = not blank[-1]
        c = np.concatenate([before, letter[keep]])
        more, count = _runs(_keys(c, np.zeros(len(c), np.uint16), len(before)))
        both, where = np.unique(np.concatenate([keys, more]), return_inverse=True)
        n = np.bincount(where, weights=np.concatenate([n, count]), minlength=len(both)).astype(np.int64)
        keys, before, at = both, c[-2:], to
    return keys, n, np.array([has])


def gram_counts(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sequences of a chunk, as sorted keys (row in the top 12 bits, hash below), their counts; and which rows hold a letter.

    A run of anything but letters counts as one blank; a sequence may start or end in a blank, not have one inside.
    """
    rows = len(offsets) - 1
    if rows == 1 and len(data) > CHUNK:
        return _long_counts(data)
    letter = _points(data)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])
    row = np.repeat(np.arange(rows, dtype=np.uint16), np.diff(before[offsets]))
    keep = letter > 0
    has = np.bincount(row[keep], minlength=rows) > 0
    keep[1:] |= letter[:-1] > 0
    return *_runs(_keys(letter[keep], row[keep], 0)), has


_HASH = np.uint64((1 << 52) - 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per language and sequence, summed over each chunk."""
    for batch in batches:
        for first, offsets, data in W.texts(batch.column(1), CHUNK):
            keys, n, _ = gram_counts(offsets, data)
            langs = batch.column(0).slice(first, len(offsets) - 1).dictionary_encode()
            code = langs.indices.to_numpy()[(keys >> np.uint64(52)).astype(np.int64)].astype(np.uint64)
            order = np.argsort(code << np.uint64(52) | keys & _HASH, kind="stable")
            both, start = np.unique((code << np.uint64(52) | keys & _HASH)[order], return_index=True)
            total = np.add.reduceat(n[order], start) if len(both) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array((both >> np.uint64(52)).astype(np.int64))).cast(pa.string()), pa.array((both & _HASH).astype(np.int64)), pa.array(total.astype(np.int64))],
                ["lang", "gram", "n"],
            )


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE, length: int = PROFILE) -> dict[str, list[int]]:
    """Profiles of all languages, from about ``sample`` labelled rows of each, chosen by a hash of the id.

    ``length`` sequences a language come to the driver, nothing that grows with the documents.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id")).filter("lang IS NOT NULL")
    share = None
    for lang, n in rows.groupBy("lang").count().collect():
        if n > sample:
            limit = F.lit(int(sample / n * (1 << 30)))
            known = F.col("lang") == lang
            share = F.when(known, limit) if share is None else share.when(known, limit)
    if share is not None:
        rows = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share.otherwise(F.lit(1 << 30)))
    counts = W.over(rows.select("lang", "text"), _counts, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= length)
    profiles: dict[str, list[int]] = {}
    for r in sorted(ranked.select("lang", "rank", "gram").collect()):
        profiles.setdefault(r.lang, []).append(r.gram)
    return profiles


def _compare(profiles: dict[str, list[int]], length: int, inside: str | None = None):
    langs = sorted(profiles)
    grams = np.unique(np.array([g for lang in langs for g in profiles[lang]], np.int64))
    ranks = np.full((len(grams) + 1, len(langs)), -1, np.int64)
    for k, lang in enumerate(langs):
        ranks[np.searchsorted(grams, np.array(profiles[lang], np.int64)), k] = np.arange(len(profiles[lang]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.struct_field(batch.column(0), inside) if inside else batch.column(1)
            for first, offsets, data in W.texts(column, CHUNK):
                rows = len(offsets) - 1
                keys, n, has = gram_counts(offsets, data)
                row = keys >> np.uint64(52)
                order = np.argsort(row << np.uint64(52) | (np.uint64((1 << 24) - 1) - np.minimum(n, (1 << 24) - 1).astype(np.uint64)) << np.uint64(28) | keys >> np.uint64(24) & np.uint64((1 << 28) - 1))
                row, gram = row[order].astype(np.int64), (keys[order] & _HASH).astype(np.int64)
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                top = rank < length
                row, gram, rank = row[top], gram[top], rank[top]
                at = np.searchsorted(grams, gram)
                at[(at == len(grams)) | (grams[np.minimum(at, len(grams) - 1)] != gram)] = len(grams) if len(grams) else 0
                place = ranks[at]
                off = np.where(place < 0, length, np.abs(place - rank[:, None]))
                far = np.zeros((rows, max(1, len(langs))))
                for k in range(len(langs)):
                    far[:, k] = np.bincount(row, weights=off[:, k], minlength=rows)
                m = np.bincount(row, minlength=rows)
                best = far.argmin(axis=1)
                known = has & (m > 0) & (len(langs) > 0)
                score = np.where(known, 1 - far[np.arange(rows), best] / np.maximum(1, m * length), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), pa.array([langs[b] if k else "und" for b, k in zip(best, known, strict=True)], pa.string()), pa.array(np.clip(score, 0, 1))],
                    ["doc_id", "lang_pred", "score"],
                )

    return run


def predict(docs: DataFrame, profiles: dict[str, list[int]], *, id_col: str = "doc_id", text_col: str = "text", length: int = PROFILE, inside: str | None = None) -> DataFrame:
    """Language of every text.

    Returns one row per input row: doc_id, lang_pred and score, which is 1 less the
    least distance as a share of the greatest possible one. A null text, one
    without a letter, or no profile at all gives ``und`` with score 0; equal
    distances go to the language first in order. Repeated rows are separate
    rows; an empty table gives an empty result; other columns are ignored,
    whatever their names. Whole texts are counted, however long, ``CHUNK`` bytes
    at a time. ``inside`` names the field of the id column that holds the text,
    for ids that are whole rows.
    """
    key = F.col(id_col).alias("doc_id")
    rows = docs.select(key) if inside else docs.select(key, F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return W.over(rows, _compare(profiles, length, inside), f"doc_id {kind}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """Rows that learning leaves aside: crc32 of the id as text, modulo 4, is 2. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
