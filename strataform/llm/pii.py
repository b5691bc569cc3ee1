"""Personal data by candidate gradient boosting, in DataFrame functions only.

Rules give the base spans: e-mail, IP, card and phone patterns with their checks.
Generators with high recall then propose further spans (phones without a country
code, identity numbers, account numbers, spelled-out e-mails). Each candidate gets
format and context features as columns; boosted trees, fitted here on generated
labelled examples and written into the plan as CASE expressions, give a score, and
those above the calibrated threshold that do not touch a base span are added.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the base patterns, leftmost and non-overlapping. Possessive loops and the looks around a match
# change no match; they keep the regex engine from trying every start of a long run, and bound its stack.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(BASE)

GENERATORS = {
    "tel": r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z-])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])",
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[{]\x20?at\x20?[)\]}]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?)[A-Za-z0-9-]{1,63}+)++",
}
#: Words before a candidate that speak for or against it.
CONTEXT = {
    "phone_word": r"(?i)\b(?:tel|telephone|phone|call|fax|mobile|cell|whatsapp|dial|reach)\b",
    "id_word": r"(?i)\b(?:ssn|social security|national id|tax id|passport)\b",
    "bank_word": r"(?i)\b(?:iban|account|bank|transfer|payable)\b",
    "mail_word": r"(?i)\b(?:mail|e-mail|email|write|contact|reach)\b",
    "other_word": r"(?i)\b(?:order|version|invoice|ref|part|isbn|page|total|range|build|rows|score|section|dated?|between|serial|lot|pages)\b",
}
FEATURES = ("is_tel", "is_ssn", "is_iban", "is_mail", "digits", "length", "separators", "mixed", "parens", "zeros", *CONTEXT)
REACH = 40


def _hits(text: str, pattern: str) -> str:
    """SQL for the spans of all matches: array of (s, e, v), in code points, from the lengths of what lies between."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return (
        f"transform(array(struct(regexp_extract_all({text}, '{quoted}', 0) AS h)), f -> CASE WHEN size(f.h) = 0 THEN CAST(array() AS array<struct<s:int,e:int,v:string>>) ELSE "
        f"aggregate(zip_with(f.h, slice(split({text}, '{quoted}', -1), 1, size(f.h)), (h, g) -> struct(h, length(g) AS n)), "
        f"named_struct('at', 0, 'out', CAST(array() AS array<struct<s:int,e:int,v:string>>)), "
        f"(a, x) -> named_struct('at', a.at + x.n + length(x.h), 'out', concat(a.out, array(named_struct('s', a.at + x.n, 'e', a.at + x.n + length(x.h), 'v', x.h)))), "
        f"a -> a.out) END)[0]"
    )


def _luhn(digits: str) -> str:
    return (
        f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + CASE WHEN (length({digits}) - i) % 2 = 0 THEN CAST(substring({digits}, i, 1) AS int) "
        f"ELSE CAST(substring({digits}, i, 1) AS int) * 2 - CASE WHEN substring({digits}, i, 1) >= '5' THEN 9 ELSE 0 END END) % 10 = 0"
    )


_VALID = {
    "email": "true",
    "ip": "forall(split(x.v, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(ltrim('0', p) AS int), 0) <= 255)",
    "card": "exists(array(regexp_replace(x.v, '[^0-9]', '')), d -> " + _luhn("d") + ")",
    "phone": "length(regexp_replace(x.v, '[^0-9]', '')) BETWEEN 9 AND 15",
}


def _named(spans: str, kind: str, rank: int) -> str:
    return f"transform({spans}, x -> named_struct('s', x.s, 'rank', {rank}, 'e', x.e, 'kind', '{kind}'))"


def candidates(text: str) -> str:
    """SQL for the generators' spans with their kind and the text before them."""
    parts = [
        f"transform({_hits(text, pattern)}, x -> named_struct('s', x.s, 'rank', {len(KINDS) + k}, 'e', x.e, 'kind', '{kind}', 'v', x.v, "
        f"'before', substring({text}, greatest(1, x.s + 1 - {REACH}), least(x.s, {REACH}))))"
        for k, (kind, pattern) in enumerate(GENERATORS.items())
    ]
    return f"concat({', '.join(parts)})"


def features(c: str) -> dict[str, str]:
    """SQL for each feature of a candidate."""
    out = {f"is_{kind}": f"CAST({c}.kind = '{kind}' AS int)" for kind in GENERATORS}
    out |= {
        "digits": f"length(regexp_replace({c}.v, '[^0-9]', ''))",
        "length": f"length({c}.v)",
        "separators": f"length(regexp_replace({c}.v, '[^ .-]', ''))",
        "mixed": f"size(array_distinct(split(regexp_replace({c}.v, '[^ .-]', ''), '')))",
        "parens": f"CAST({c}.v LIKE '%(%' AS int)",
        "zeros": f"CAST({c}.v RLIKE '(^|[^0-9])0+([^0-9]|$)' AS int)",
    }
    for name, pattern in CONTEXT.items():
        out[name] = f"CAST({c}.before RLIKE '{pattern.replace(chr(92), chr(92) * 2)}' AS int)"
    return out


def examples(n: int, seed: int) -> list[dict]:
    """Generated labelled texts: one candidate each, personal or not, in a context that mostly fits."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    u = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 8)))
    fill = lambda k: " ".join(word() for _ in range(k))
    sep = lambda: r.choice(" .-")
    out = []
    for _ in range(n):
        s, personal = sep(), r.random() < 0.5
        kind = r.choice(("tel", "ssn", "iban", "mail"))
        if kind == "tel":
            value = r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}{s}{d(3)}{s}{d(4)}", f"{d(3)} {d(3)} {d(4)}"))
            cue = r.choice(("call me on", "phone:", "Tel.", "fax", "mobile", "dial", "you can reach me at"))
            other = r.choice((f"{d(2)}.{d(3)}.{d(3)}", f"{d(4)} {d(4)} {d(4)}", f"{d(3)}-{d(4)}-{d(4)}", value))
        elif kind == "ssn":
            value, cue, other = f"{d(3)}-{d(2)}-{d(4)}", r.choice(("SSN", "social security number", "tax id", "national id")), r.choice((f"{d(3)} {d(2)} {d(4)}", f"{d(3)}-{d(2)}-{d(4)}"))
        elif kind == "iban":
            value = f"{r.choice(('DE', 'FR', 'GB', 'ES', 'NL'))}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}"
            cue, other = r.choice(("IBAN", "bank account", "transfer to", "payable to")), f"{u(2)}{d(2)} {u(4)} {u(4)} {u(4)}"
            other = "XQ" + other[2:]
        else:
            value = f"{word()} [at] {word()} [dot] {r.choice(('com', 'org', 'net'))}"
            cue, other = r.choice(("mail me:", "write to", "contact", "e-mail")), f"{word()} (at) {d(2)}.{d(2)}"
        against = r.choice(("order", "version", "invoice", "part", "lot", "serial", "pages", "rows", "total", word(), word(), word()))
        text = f"{fill(6)} {cue if personal else against} {value if personal else other} {fill(3)}"
        out.append({"text": text, "label": int(personal)})
    return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3, leaf: int = 8) -> tuple[float, list]:
    """Gradient boosting of regression trees on the logistic loss, by Newton steps. Trees are nested (feature, cut, left, right) or a leaf's value."""

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int):
        value = float(rate * g[rows].sum() / (h[rows].sum() + 1.0))
        best = None
        if level:
            for k in range(x.shape[1]):
                for cut in np.unique(x[rows, k])[:-1]:
                    low = x[rows, k] <= cut
                    a, b = rows[low], rows[~low]
                    if min(len(a), len(b)) < leaf:
                        continue
                    gain = g[a].sum() ** 2 / (h[a].sum() + 1) + g[b].sum() ** 2 / (h[b].sum() + 1)
                    if best is None or gain > best[0] + 1e-9:
                        best = gain, k, float(cut), a, b
        if best is None or best[0] <= g[rows].sum() ** 2 / (h[rows].sum() + 1) + 1e-6:
            return value
        return best[1], best[2], grow(best[3], g, h, level - 1), grow(best[4], g, h, level - 1)

    start = float(np.log(y.mean() / (1 - y.mean())))
    score, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.arange(len(y)), y - p, p * (1 - p), depth)
        trees.append(tree)
        score += np.array([_value(tree, row) for row in x])
    return start, trees


def _value(tree, row) -> float:
    while not isinstance(tree, float):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def _tree_sql(tree, f: dict[str, str]) -> str:
    if isinstance(tree, float):
        return f"{tree!r}D"
    return f"CASE WHEN {f[FEATURES[tree[0]]]} <= {tree[1]!r}D THEN {_tree_sql(tree[2], f)} ELSE {_tree_sql(tree[3], f)} END"


def fit(spark: SparkSession, *, sample: int = 800, seed: int = 7, precision: float = 0.99) -> tuple[float, list, float]:
    """Start, trees and threshold: fitted on ``sample`` generated examples, calibrated on as many others.

    The threshold is the least score at which the held-out precision is reached.
    """
    rows = [x | {"held": int(k >= sample)} for k, x in enumerate(examples(2 * sample, seed))]
    table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<text:string,label:int,held:int>>")).alias("r")).select("r.*")
    one = table.select("label", "held", F.explode(F.expr(candidates("text"))).alias("c"))
    own = features("c")
    got = np.array(one.select("held", "label", *[F.expr(own[k]).cast("double") for k in FEATURES]).collect(), float)
    train, held = got[got[:, 0] == 0], got[got[:, 0] == 1]
    start, trees = boost(train[:, 2:], train[:, 1])
    score = np.array([start + sum(_value(t, row) for t in trees) for row in held[:, 2:]])
    order = np.argsort(-score, kind="stable")
    right = np.cumsum(held[order, 1]) / np.arange(1, len(order) + 1)
    last = np.append(score[order][1:] != score[order][:-1], True)
    good = np.flatnonzero((right >= precision) & last)
    return start, trees, float(score[order][good[-1]]) if len(good) else float("inf")


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: tuple[float, list, float] | None = None) -> DataFrame:
    """Personal data in every text.

    Returns one row per input row: doc_id, n_email, n_ip, n_card, n_phone (base
    spans), base_sha256 (of kind:start:end by start, then kind, comma-joined),
    spans (base and added ones, written likewise) and redacted (the text with
    each span replaced by [KIND]; where spans overlap, by the first). Offsets are
    code points, ends exclusive. Null texts are empty; repeated rows are separate
    rows; an empty table gives an empty result; other columns are ignored,
    whatever their names. Whole texts are searched, however long.
    """
    start, trees, threshold = model or fit(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for rank, (kind, pattern) in enumerate(BASE.items()):
        rows = rows.withColumn(kind, F.expr(f"filter({_hits('text', pattern)}, x -> {_VALID[kind]})"))
    own = features("c")
    score = " + ".join([f"{start!r}D", *(_tree_sql(t, own) for t in trees)])
    base = f"concat({', '.join(_named(kind, kind, rank) for rank, kind in enumerate(KINDS))})"
    rows = rows.withColumn("base", F.expr(f"array_sort({base})")).withColumn("proposed", F.expr(candidates("text")))
    chosen = f"filter(proposed, c -> NOT exists(base, b -> b.s < c.e AND c.s < b.e) AND {score} >= {threshold if np.isfinite(threshold) else 1e308!r}D)"
    rows = rows.withColumn("more", F.expr(f"CASE WHEN size(proposed) = 0 THEN proposed ELSE {chosen} END"))
    rows = rows.withColumn("all", F.expr("array_sort(concat(base, transform(more, c -> named_struct('s', c.s, 'rank', c.rank, 'e', c.e, 'kind', c.kind))))"))
    written = lambda c: F.expr(f"array_join(transform({c}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')")
    redacted = F.expr(
        "CASE WHEN size(all) = 0 THEN text ELSE aggregate(all, named_struct('at', 0, 'out', ''), (a, x) -> CASE WHEN x.s < a.at THEN a ELSE "
        "named_struct('at', x.e, 'out', concat(a.out, substring(text, a.at + 1, x.s - a.at), '[', upper(x.kind), ']')) END, "
        "a -> concat(a.out, substring(text, a.at + 1, length(text)))) END"
    )
    return rows.select(
        "doc_id",
        *[F.size(kind).cast("bigint").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(written("base"), 256).alias("base_sha256"),
        written("all").alias("spans"),
        redacted.alias("redacted"),
    )
