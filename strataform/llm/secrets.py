"""Secrets in text by grammar inference.

Rules give the base spans. Labelled credentials and labelled ordinary tokens are
read as strings of symbol classes into two prefix trees, whose statistically
compatible states are merged (Hoeffding test on the frequencies of ends and
symbols, recursively) into probabilistic automata. Every long token of a text is
scored by its log-likelihood ratio per symbol under the two automata; tokens above
the calibrated threshold that touch no base span are added as ``format`` spans.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.llm import words as W

# fixed values: the base patterns
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST, TOKEN_LEAST = 6, 20, 24, 20

_NOT_HEX = ~np.isin(np.arange(256), list(b"0123456789abcdef"))
_NOT_TOKEN = ~np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"))
_CLASS = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 else 48 if 48 <= c <= 57 else c for c in range(256))


class Automaton:
    """A probabilistic automaton inferred from strings: counts per state of passing, ending and each symbol."""

    def __init__(self, strings: list[bytes], alpha: float = 0.05) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.seen: list[dict[int, int]] = [{}]
        self.ends = [0]
        self.total = [0]
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        for s in strings:
            at = 0
            self.total[0] += 1
            for c in s:
                if c not in self.step[at]:
                    self.step[at][c] = len(self.step)
                    self.step.append({}), self.seen.append({}), self.ends.append(0), self.total.append(0)
                self.seen[at][c] = self.seen[at].get(c, 0) + 1
                at = self.step[at][c]
                self.total[at] += 1
            self.ends[at] += 1
        self._merge_states()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > self._bound * (n1**-0.5 + n2**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.total[a], self.total[b]
            if self._differ(self.ends[a], n, self.ends[b], m):
                return False
            for c in self.seen[a].keys() | self.seen[b].keys():
                if self._differ(self.seen[a].get(c, 0), n, self.seen[b].get(c, 0), m):
                    return False
                if c in self.step[a] and c in self.step[b]:
                    todo.append((self.step[a][c], self.step[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.total[a] += self.total[b]
            self.ends[a] += self.ends[b]
            for c, n in self.seen[b].items():
                self.seen[a][c] = self.seen[a].get(c, 0) + n
                if c in self.step[a]:
                    todo.append((self.step[a][c], self.step[b][c]))
                else:
                    self.step[a][c] = self.step[b][c]

    def _merge_states(self) -> None:
        kept, fringe = [0], deque((0, c) for c in sorted(self.step[0]))
        while fringe:
            parent, c = fringe.popleft()
            state = self.step[parent][c]
            if state in kept:
                continue
            for known in kept:
                if self._compatible(known, state):
                    self.step[parent][c] = known
                    self._fold(known, state)
                    break
            else:
                kept.append(state)
            for k in kept:  # a fold may have hung new children below any kept state
                fringe.extend((k, s) for s in sorted(self.step[k]) if self.step[k][s] not in kept and (k, s) not in fringe)

    def log_likelihood(self, s: bytes) -> float:
        """Natural log of the probability of ``s``, with a small share for symbols never seen in a state."""
        at, out = 0, 0.0
        for c in s:
            n = self.total[at]
            out += math.log((self.seen[at].get(c, 0) + 0.02) / (n + 1.0))
            at = self.step[at].get(c, 0)
        return out + math.log((self.ends[at] + 0.02) / (self.total[at] + 1.0))


def labelled(n: int, seed: int) -> tuple[list[bytes], list[bytes]]:
    """Generated credentials in well-known formats, and ordinary long tokens."""
    r = random.Random(seed)
    of = lambda symbols, k: "".join(r.choice(symbols) for _ in range(k))
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    every = upper + lower + digits
    word = lambda a=3, b=9: of(lower, r.randint(a, b))
    secret = [
        lambda: "ghp_" + of(every, 36),
        lambda: "sk_live_" + of(every, 24),
        lambda: of(every, r.choice((32, 40, 43))),
        lambda: of(every + "+/", r.choice((40, 42, 43))) + "=",
        lambda: "eyJ" + of(every + "_-", r.randint(30, 60)),
        lambda: "xoxb-" + of(digits, 12) + "-" + of(every, 24),
    ]
    plain = [
        lambda: of(lower, r.randint(20, 40)),
        lambda: "_".join(word() for _ in range(r.randint(3, 6))),
        lambda: "-".join(word() for _ in range(r.randint(3, 7))),
        lambda: "/".join(word() for _ in range(r.randint(3, 6))),
        lambda: "".join(word().capitalize() for _ in range(r.randint(3, 6))),
        lambda: "-".join([word(), word(), word(), of(digits, 4), of(digits, 2)]),
        lambda: of(digits, r.randint(20, 30)),
        lambda: of("=-_", 1) * r.randint(20, 60),
        lambda: of(upper, r.randint(20, 40)),
        lambda: "/".join([word(), of(digits, 4), of(digits, 2), word(), word()]),
    ]
    make = lambda kinds: [x.encode().translate(_CLASS) for x in (r.choice(kinds)() for _ in range(n)) if len(x) >= TOKEN_LEAST]
    return make(secret), make(plain)


class Model:
    """Both automata and the threshold between them."""

    def __init__(self, sample: int = 150, seed: int = 11, recall: float = 0.99) -> None:
        secret, plain = labelled(sample, seed)
        self.secret, self.plain = Automaton(secret), Automaton(plain)
        good, bad = ([self.score(x) for x in strings] for strings in labelled(10 * sample, seed + 1))
        # halfway between the highest ordinary token and what the recall asks for, never below the former
        self.threshold = max(max(bad) + 1e-6, (max(bad) + sorted(good)[int((1 - recall) * len(good))]) / 2)

    def score(self, classes: bytes) -> float:
        return (self.secret.log_likelihood(classes) - self.plain.log_likelihood(classes)) / (len(classes) + 1)


def _scan(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, offsets, data in W.texts(batch.column(1)):
                rows = len(offsets) - 1
                # code points before each byte
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                found: dict[int, list[tuple[int, int, int]]] = {}
                for between, least, kind in ((_NOT_HEX, HEX_LEAST, 2), (_NOT_TOKEN, TOKEN_LEAST, 3)):
                    w = W.words(offsets, data, between=between)
                    for k in np.flatnonzero(w.end - w.start >= least):
                        found.setdefault(int(w.row[k]), []).append((int(w.start[k]), kind, int(w.end[k])))
                counts = np.zeros((3, rows), np.int64)
                digests, spans, scores = [], [], []
                for i in range(rows):
                    low = int(offsets[i])
                    text = data[low : offsets[i + 1]].tobytes()
                    mine = found.get(i, [])
                    base = [x for x in mine if x[1] == 2]
                    base += [(low + m.start(), 0, low + m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
                    base += [(low + m.start(), 1, low + m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
                    base.sort()
                    more, score = [], []
                    for s, kind, e in mine:
                        if kind == 3:
                            own = model.score(text[s - low : e - low].translate(_CLASS))
                            score.append(own)
                            if own >= model.threshold and not any(b[0] < e and s < b[2] for b in base):
                                more.append((s, 3, e))
                    for _, kind, _ in base:
                        counts[kind, i] += 1
                    at = points[low]
                    told = lambda x: ",".join(f"{(*KINDS, 'format')[k]}:{points[s] - at}:{points[e] - at}" for s, k, e in x)  # noqa: B023, E731
                    digests.append(hashlib.sha256(told(base).encode()).hexdigest())
                    spans.append(told(sorted(base + more)))
                    scores.append(max(score, default=None))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(scores, pa.float64())],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "top_score"],
                )

    return run


def secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """Secrets in every text.

    Returns one row per input row: doc_id, n_assign, n_access, n_hex (base spans),
    base_sha256 (of kind:start:end by start, then kind, comma-joined), spans (base
    and added ones, written likewise) and top_score (the best score of a long
    token, null if there is none). Offsets are code points, ends exclusive. Null
    texts are empty; repeated rows are separate rows; an empty table gives an
    empty result; other columns are ignored, whatever their names. Whole texts
    are searched, however long.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, top_score double"
    return W.over(rows, _scan(model or Model()), schema)
