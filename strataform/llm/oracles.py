"""DuckDB SQL that gives the same rows as the queries, where SQL can express them."""

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MIXING = f"""
WITH rated AS (SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT documents.doc_id, source, len({_WORDS.format("coalesce(text, '')")}) AS size,
         -ln((CAST('0x' || substr(md5('1:' || CAST(documents.doc_id AS VARCHAR)), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
           / CASE q WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS k
  FROM documents LEFT JOIN rated USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, [5, 2, 1][(place % 3 + 1)::INT] AS wt FROM p),
r AS (
  SELECT *, sum(n) OVER () AS total,
         coalesce(sum(3 * n) OVER (ORDER BY n::DOUBLE / wt, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(wt) OVER (ORDER BY n::DOUBLE / wt, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM w),
l AS (SELECT *, (total - capped)::DOUBLE / free::DOUBLE AS lev FROM r),
c AS (SELECT arg_min(lev, n::DOUBLE / wt) AS lev FROM l WHERE lev * wt <= 3 * n),
t AS (
  SELECT source, n, coalesce(least((3 * n)::DOUBLE, c.lev * wt), (3 * n)::DOUBLE) AS target FROM l LEFT JOIN c ON true),
e AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n)::BIGINT ELSE 0 END AS epochs FROM t),
o AS (
  SELECT d.*, n, target, epochs, target - epochs * n AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
f AS (SELECT *, CASE WHEN upto <= rest THEN 1 ELSE 0 END AS fits FROM o),
m AS (SELECT *, rest - sum(size * fits) OVER (PARTITION BY source) AS missing FROM f),
b AS (
  SELECT *, CASE WHEN fits = 0 THEN row_number() OVER (PARTITION BY source, fits ORDER BY abs(missing - size), k, doc_id) END AS nth FROM m)
SELECT doc_id, size, n AS source_size, target,
       (size * (epochs + fits + CASE WHEN nth = 1 AND abs(missing - size) < missing THEN 1 ELSE 0 END))::BIGINT AS taken
FROM b
"""

SUBSTRING = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS i FROM d),
t AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS nth FROM s),
g AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 20)))) AS gone FROM t WHERE nth > 1 GROUP BY doc_id),
k AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, w, gone,
         CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept
  FROM d LEFT JOIN g ON d.doc_id = g.doc_id)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

_ITEM_WORDS = rf"list_filter(regexp_split_to_array({_FOLD}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark),
bi AS (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s FROM bi),
ln AS (SELECT DISTINCT n FROM bw),
di AS (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, ln),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM di),
h AS (
  SELECT doc_id, len(list_distinct(flatten(list(range(i, i + dw.n))))) AS n_hit, list_sort(list_distinct(list(item))) AS items
  FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id
"""

MINHASH = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_FOLD)} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM s),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 80 * (na.n + nb.n - x)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

ORACLES = {
    "op3_source_mixing": MIXING,
    "op4_substring_dedup": SUBSTRING,
    "op5_decontamination": DECONTAMINATION,
    "op10_minhash": MINHASH,
}
