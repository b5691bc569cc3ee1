"""Registered queries of the registration operators, with DuckDB SQL for the same rows. Floats are rounded to 6 places."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataform import scratch
from strataform.functions import geometry as G
from strataform.operators import lines as L
from strataform.operators import matching as M
from strataform.operators import pixels as P
from strataform.operators import scoring as C
from strataform.operators import solve as S
from strataform.operators import voxels as V
from strataform.plans import views

VOXEL, SMALL, PIXEL, RADIUS, ANGLE, LENGTH = 4.0, 0.2, 2.0, 60.0, 3.0, 2.0
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame) -> DataFrame:
    """Floats to 6 places, a hair up first so that means that end in a 5 fall alike, and without negative zeros."""
    return df.select(*[(F.round(F.col(c) + F.lit(1e-9), 6) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def _r(*columns: str) -> str:
    """SQL that rounds each `expression name`."""
    return ", ".join(f"round({c.rsplit(' ', 1)[0]} + 1e-9, 6) + 0.0 AS {c.rsplit(' ', 1)[1]}" for c in columns)


def _floors(size: float) -> str:
    return ", ".join(f"floor({c} / {size}::DOUBLE)::BIGINT AS v{c}" for c in "xyz")


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(views.SQL.get(c, c) for c in ctes) + "\n"


def _binned(source: str, size: float) -> str:
    return f"binned AS (SELECT *, {_floors(size)} FROM {source})"


_STATS = """stats AS (SELECT cloud_id, vx, vy, vz, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz,
  var_pop(x) AS sxx, var_pop(y) AS syy, var_pop(z) AS szz, covar_pop(x, y) AS sxy, covar_pop(x, z) AS sxz, covar_pop(y, z) AS syz
  FROM binned GROUP BY ALL HAVING count(*) >= 3)"""


# written out here, apart from the code under test: the characteristic polynomial's roots by the cosine formula
_EIGEN = [
    "e0 AS (SELECT *, sxx + syy + szz AS tr, sxx * syy + sxx * szz + syy * szz - sxy * sxy - sxz * sxz - syz * syz AS mid FROM stats)",
    "e1 AS (SELECT *, sxx * syy * szz + 2 * sxy * sxz * syz - sxx * syz * syz - syy * sxz * sxz - szz * sxy * sxy AS dt FROM e0)",
    "e2 AS (SELECT *, greatest(tr * tr - 3 * mid, 0.0) AS pp FROM e1)",
    "e3 AS (SELECT *, 2 * tr * tr * tr - 9 * tr * mid + 27 * dt AS qq FROM e2)",
    "e4 AS (SELECT *, CASE WHEN pp = 0 THEN 0.0 ELSE acos(greatest(-1.0, least(1.0, qq / (2 * pp * sqrt(pp))))) / 3 END AS ang FROM e3)",
    "e5 AS (SELECT *, (tr + 2 * sqrt(pp) * cos(ang)) / 3 AS l0, (tr + 2 * sqrt(pp) * cos(ang + 2 * pi() / 3)) / 3 AS l2 FROM e4)",
    "e6 AS (SELECT *, tr - l0 - l2 AS l1 FROM e5)",
    "flat AS (SELECT * FROM e6 WHERE 30 * l2 < l1 AND l0 < 6 * l1)",
]


def _steps() -> list[str]:
    return _EIGEN


_LAST = "e6"
# cosine of the angle between the least eigenvector and z, from its longest cross product
_NORMAL = """crossed AS (SELECT *, unnest([
    [(sxy * syz - sxz * (syy - l2)), (sxz * sxy - (sxx - l2) * syz), ((sxx - l2) * (syy - l2) - sxy * sxy)],
    [(sxy * (szz - l2) - sxz * syz), (sxz * sxz - (sxx - l2) * (szz - l2)), ((sxx - l2) * syz - sxy * sxz)],
    [((syy - l2) * (szz - l2) - syz * syz), (syz * sxz - sxy * (szz - l2)), (sxy * syz - (syy - l2) * sxz)]]) AS nv FROM flat),
tilted AS (SELECT cloud_id, vx, vy, vz, degrees(acos(least(1.0, abs(arg_max(nv[3], nv[1]*nv[1] + nv[2]*nv[2] + nv[3]*nv[3])) / nullif(sqrt(max(nv[1]*nv[1] + nv[2]*nv[2] + nv[3]*nv[3])), 0)))) AS tilt
  FROM crossed GROUP BY ALL)"""


@query(_with("points", _binned("points", VOXEL)) + f"SELECT cloud_id, vx, vy, vz, count(*) AS n, {_r('avg(x) x', 'avg(y) y', 'avg(z) z')} FROM binned GROUP BY ALL")
def voxel_downsample(spark: SparkSession, d: str) -> DataFrame:
    return rounded(V.downsample(views.points_only(spark, d), VOXEL))


@query(_with("points_small", _binned("points_small", SMALL), _STATS) + f"SELECT cloud_id, vx, vy, vz, n, {_r('cx cx', 'cy cy', 'cz cz')} FROM stats")
def voxel_hash_agg(spark: SparkSession, d: str) -> DataFrame:
    return rounded(V.statistics(views.points_small(spark, d), SMALL).select(*V.KEY, "n", "cx", "cy", "cz"))


@query(_with("points", _binned("points", VOXEL), _STATS) + f"SELECT cloud_id, vx, vy, vz, n, {_r(*(f'{c} {c}' for c in ('sxx', 'syy', 'szz', 'sxy', 'sxz', 'syz')))} FROM stats")
def voxel_covariance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(V.statistics(views.points_only(spark, d), VOXEL).drop("cx", "cy", "cz"))


@query(_with("points", _binned("points", VOXEL), _STATS, *_steps()) + f"SELECT cloud_id, vx, vy, vz, {_r('l0 l0', 'l1 l1', 'l2 l2')} FROM {_LAST}")
def voxel_pca_eigenvalues(spark: SparkSession, d: str) -> DataFrame:
    return rounded(V.principal(V.statistics(views.points_only(spark, d), VOXEL)).select(*V.KEY, "l0", "l1", "l2"))


@query(_with("points", _binned("points", VOXEL), _STATS, *_steps()) + "SELECT cloud_id, vx, vy, vz, n FROM flat")
def planar_voxels(spark: SparkSession, d: str) -> DataFrame:
    return V.planar(V.principal(V.statistics(views.points_only(spark, d), VOXEL))).select(*V.KEY, "n")


def _planar(spark: SparkSession, d: str) -> DataFrame:
    return V.planar(V.principal(V.statistics(views.points_only(spark, d), 1.5)))


_PLANAR = ("points", _binned("points", 1.5), _STATS, *_steps(), _NORMAL)


@query(_with(*_PLANAR) + f"SELECT b.cloud_id, {_r('x x', 'y y', 'z z')} FROM binned b JOIN tilted t USING (cloud_id, vx, vy, vz) WHERE 90 - tilt < 30")
def feasible_points(spark: SparkSession, d: str) -> DataFrame:
    return rounded(V.points_in(views.points_only(spark, d), V.perpendicular(_planar(spark, d)), 1.5))


@query(_with(*_PLANAR) + "SELECT cloud_id, vx, vy, vz FROM tilted WHERE tilt < 30")
def ground_voxels(spark: SparkSession, d: str) -> DataFrame:
    return V.ground(_planar(spark, d)).select(*V.KEY)


_BOX = "box AS (SELECT cloud_id, count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM points GROUP BY cloud_id)"
_IMAGE = f"image AS (SELECT cloud_id, min_x, min_y, ceil((max_x - min_x) / {PIXEL}::DOUBLE)::BIGINT AS width, ceil((max_y - min_y) / {PIXEL}::DOUBLE)::BIGINT AS height FROM box)"
_PIXELS = f"""pixels AS (SELECT cloud_id, row, col, count(*) AS n, avg(x) AS x, avg(y) AS y FROM (
  SELECT cloud_id, x, y, width, height, floor((x - min_x) / {PIXEL}::DOUBLE)::BIGINT AS col, floor((y - min_y) / {PIXEL}::DOUBLE)::BIGINT AS row FROM points JOIN image USING (cloud_id))
  WHERE col < width AND row < height GROUP BY ALL)"""


@query(_with("points", _BOX) + f"SELECT cloud_id, n, {_r('min_x min_x', 'max_x max_x', 'min_y min_y', 'max_y max_y')} FROM box")
def cloud_bbox(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.bounding_box(views.points_only(spark, d)))


def _images(spark: SparkSession, d: str) -> DataFrame:
    return P.image(P.bounding_box(views.points_only(spark, d)), PIXEL)


@query(_with("points", _BOX, _IMAGE) + f"SELECT cloud_id, {_r('min_x min_x', 'min_y min_y')}, width, height FROM image")
def image_size(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_images(spark, d))


def _pixels(spark: SparkSession, d: str, threshold: int = 1) -> DataFrame:
    return P.pixelize(views.points_only(spark, d), _images(spark, d), PIXEL, threshold)


@query(_with("points", _BOX, _IMAGE, _PIXELS) + f"SELECT cloud_id, row, col, n, {_r('x x', 'y y')} FROM pixels")
def pixel_agg(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_pixels(spark, d).drop("value"))


#: Half of the pixels or so hold that many points at sf0.01.
FOREGROUND = 10
_FORE = f"fore AS (SELECT cloud_id, row, col FROM pixels WHERE n >= {FOREGROUND})"


@query(_with("points", _BOX, _IMAGE, _PIXELS) + f"SELECT cloud_id, row, col, n, n >= {FOREGROUND} AS value FROM pixels")
def pixel_foreground(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d, FOREGROUND).select("cloud_id", "row", "col", "n", "value")


def _fore(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d, FOREGROUND).filter("value").select("cloud_id", "row", "col")


# fixed values, written out apart from the code under test: neighbours 0..7, anticlockwise from the right, rows growing down
_RING = ((0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1))
_RING_VALUES = ", ".join(f"({r}, {c}, {1 << k})" for k, (r, c) in enumerate(_RING))
_MASKS = f"""masks AS (SELECT f.cloud_id, f.row, f.col, coalesce(sum(o.bit), 0)::BIGINT AS mask
  FROM fore f LEFT JOIN (SELECT g.cloud_id, g.row - n.dr AS row, g.col - n.dc AS col, n.bit FROM fore g, (VALUES {_RING_VALUES}) n(dr, dc, bit)) o
  ON o.cloud_id = f.cloud_id AND o.row = f.row AND o.col = f.col GROUP BY ALL)"""


@query(_with("points", _BOX, _IMAGE, _PIXELS, _FORE, _MASKS) + "SELECT * FROM masks")
def neighbor_mask(spark: SparkSession, d: str) -> DataFrame:
    return P.neighbour_masks(_fore(spark, d))


# one pass from its published conditions: x crossings, n1 and n2 neighbour pairs, and the open side
_THIN = """bits AS (SELECT cloud_id, row, col, width, height, mask & 1 AS b0, mask >> 1 & 1 AS b1, mask >> 2 & 1 AS b2, mask >> 3 & 1 AS b3, mask >> 4 & 1 AS b4, mask >> 5 & 1 AS b5, mask >> 6 & 1 AS b6, mask >> 7 & 1 AS b7
  FROM masks JOIN image USING (cloud_id)),
judged AS (SELECT *, (1 - b0) * (b1 | b2) + (1 - b2) * (b3 | b4) + (1 - b4) * (b5 | b6) + (1 - b6) * (b7 | b0) AS x,
  (b0 | b1) + (b2 | b3) + (b4 | b5) + (b6 | b7) AS n1, (b1 | b2) + (b3 | b4) + (b5 | b6) + (b7 | b0) AS n2, (b1 | b2 | (1 - b7)) & b0 AS closed FROM bits)"""


@query(
    _with("points", _BOX, _IMAGE, _PIXELS, _FORE, _MASKS, _THIN)
    + "SELECT cloud_id, row, col FROM judged WHERE NOT (row BETWEEN 1 AND height - 2 AND col BETWEEN 1 AND width - 2 AND x = 1 AND least(n1, n2) BETWEEN 2 AND 3 AND closed = 0)"
)
def thin_one_pass(spark: SparkSession, d: str) -> DataFrame:
    return P.thin_once(_fore(spark, d), _images(spark, d))


# both passes in turn, as often as one of them still removes a pixel of the cloud: two quiet ones in a row end it
_FIXPOINT = f"""steps AS (SELECT cloud_id, row, col, width, height, 0 AS pass, 0 AS quiet FROM fore JOIN image USING (cloud_id)
  UNION ALL
  SELECT cloud_id, row, col, width, height, pass + 1, CASE WHEN total = 0 THEN quiet + 1 ELSE 0 END FROM (SELECT *, sum(gone::INT) OVER (PARTITION BY cloud_id) AS total FROM (
    SELECT *, row BETWEEN 1 AND height - 2 AND col BETWEEN 1 AND width - 2 AND (1 - b0) * (b1 | b2) + (1 - b2) * (b3 | b4) + (1 - b4) * (b5 | b6) + (1 - b6) * (b7 | b0) = 1
      AND least((b0 | b1) + (b2 | b3) + (b4 | b5) + (b6 | b7), (b1 | b2) + (b3 | b4) + (b5 | b6) + (b7 | b0)) BETWEEN 2 AND 3
      AND CASE WHEN pass % 2 = 0 THEN (b1 | b2 | (1 - b7)) & b0 ELSE (b5 | b6 | (1 - b3)) & b4 END = 0 AS gone
    FROM (SELECT *, mask & 1 AS b0, mask >> 1 & 1 AS b1, mask >> 2 & 1 AS b2, mask >> 3 & 1 AS b3, mask >> 4 & 1 AS b4, mask >> 5 & 1 AS b5, mask >> 6 & 1 AS b6, mask >> 7 & 1 AS b7 FROM (
      SELECT s.cloud_id, s.row, s.col, s.width, s.height, s.pass, s.quiet, coalesce(sum(o.bit), 0)::BIGINT AS mask FROM steps s
      LEFT JOIN (SELECT g.cloud_id, g.row - n.dr AS row, g.col - n.dc AS col, n.bit FROM steps g, (VALUES {_RING_VALUES}) n(dr, dc, bit)) o
      ON o.cloud_id = s.cloud_id AND o.row = s.row AND o.col = s.col WHERE s.quiet < 2 GROUP BY ALL)))) WHERE NOT gone)"""


@query("WITH RECURSIVE " + _with("points", _BOX, _IMAGE, _PIXELS, _FORE, _FIXPOINT)[5:] + "SELECT cloud_id, row, col FROM steps WHERE quiet = 2")
def thin_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    return P.thin(_fore(spark, d), _images(spark, d))


_VOTES = f"""votes AS (SELECT cloud_id, theta, floor(round((x * cos(theta * {math.pi / 180!r}::DOUBLE) + y * sin(theta * {math.pi / 180!r}::DOUBLE)) / {PIXEL}::DOUBLE, 9))::BIGINT AS rho, sum(n)::BIGINT AS votes
  FROM pixels, (SELECT unnest(range(180))::INT AS theta) GROUP BY ALL)"""


@query(_with("points", _BOX, _IMAGE, _PIXELS, _VOTES) + "SELECT * FROM votes")
def hough_votes(spark: SparkSession, d: str) -> DataFrame:
    return L.votes(_pixels(spark, d), PIXEL)


@query(
    _with("points", _BOX, _IMAGE, _PIXELS, _VOTES)
    + f""", peaks AS (SELECT * FROM votes v WHERE NOT EXISTS (SELECT 1 FROM votes w WHERE w.cloud_id = v.cloud_id AND w.theta BETWEEN v.theta - 1 AND v.theta + 1 AND w.rho BETWEEN v.rho - 1 AND v.rho + 1
    AND (w.votes > v.votes OR w.votes = v.votes AND (w.theta < v.theta OR w.theta = v.theta AND w.rho < v.rho)))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY votes DESC, theta, rho) - 1 AS line_id FROM peaks)
SELECT cloud_id, line_id, {_r(f'cos(theta * {math.pi / 180!r}::DOUBLE) a', f'sin(theta * {math.pi / 180!r}::DOUBLE) b', f'(-(rho + 0.5::DOUBLE) * {PIXEL}::DOUBLE) c')}, votes FROM ranked WHERE line_id < 20"""
)
def hough_topk_lines(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.top_lines(L.votes(_pixels(spark, d), PIXEL), PIXEL))


_CROSS = """crossings AS (SELECT p.cloud_id, p.line_id AS line0, q.line_id AS line1,
  (p.b * q.c - q.b * p.c) / (p.a * q.b - q.a * p.b) AS x, (q.a * p.c - p.a * q.c) / (p.a * q.b - q.a * p.b) AS y,
  degrees(acos(least(1.0, abs((p.a * q.a + p.b * q.b) / sqrt((p.a * p.a + p.b * p.b) * (q.a * q.a + q.b * q.b)))))) AS angle
  FROM lines p JOIN lines q ON p.cloud_id = q.cloud_id AND p.line_id < q.line_id WHERE abs(p.a * q.b - q.a * p.b) >= 1e-12)"""
_NODES = f"""nodes AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY line0, line1) - 1 AS id, abs(angle - 90) <= {ANGLE} AS is_right
  FROM crossings WHERE sqrt(x * x + y * y) <= {RADIUS} AND angle >= 3.0)"""


@query(_with("lines", _CROSS) + f"SELECT cloud_id, line0, line1, {_r('x x', 'y y')} FROM crossings")
def line_intersections(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.intersections(views.lines(spark, d)).drop("angle"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return L.nodes(views.lines(spark, d), RADIUS, 3.0, ANGLE)


@query(_with("lines", _CROSS, _NODES) + f"SELECT cloud_id, id, line0, line1, {_r('angle angle')}, is_right FROM nodes")
def acute_angles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_nodes(spark, d).select("cloud_id", "id", "line0", "line1", "angle", "is_right"))


_EDGES = """incident AS (SELECT cloud_id, id, x, y, line0 AS line_id FROM nodes UNION ALL SELECT cloud_id, id, x, y, line1 FROM nodes),
along AS (SELECT i.*, l.b * i.x - l.a * i.y AS t FROM incident i JOIN lines l USING (cloud_id, line_id)),
edges AS (SELECT cloud_id, line_id, id AS u, lead(id) OVER w AS v, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) AS length FROM along WINDOW w AS (PARTITION BY cloud_id, line_id ORDER BY t, id))"""


@query(_with("lines", _CROSS, _NODES, _EDGES) + f"SELECT cloud_id, line_id, u, v, {_r('length length')} FROM edges WHERE v IS NOT NULL")
def line_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.edges(_nodes(spark, d), views.lines(spark, d)))


def _slots(spark: SparkSession, d: str) -> DataFrame:
    nodes, lines = _nodes(spark, d), views.lines(spark, d)
    return L.slots(nodes, lines, L.edges(nodes, lines))


def _turn(x: str) -> str:
    return f"CASE WHEN ({x}) % 360 < 0 THEN ({x}) % 360 + 360 ELSE ({x}) % 360 END"


# four directions of a node by falling angle, the turn whose opposite sectors fit its angle best, edges to their nearest direction
_SLOTS = f"""dirs AS (SELECT n.cloud_id, n.id, n.angle AS acute, l.line_id, {_turn('degrees(atan2(-l.a, l.b)) + back')} AS way
  FROM nodes n JOIN lines l ON l.cloud_id = n.cloud_id AND (l.line_id = n.line0 OR l.line_id = n.line1), (VALUES (0.0::DOUBLE), (180.0::DOUBLE)) h(back)),
placed AS (SELECT *, row_number() OVER (PARTITION BY cloud_id, id ORDER BY way DESC, line_id) - 1 AS k FROM dirs),
sectors AS (SELECT p.cloud_id, p.id, p.k, p.acute, {_turn('p.way - q.way')} AS sector FROM placed p JOIN placed q ON q.cloud_id = p.cloud_id AND q.id = p.id AND q.k = (p.k + 1) % 4),
starts AS (SELECT p.cloud_id, p.id, p.k AS start FROM sectors p JOIN sectors q ON q.cloud_id = p.cloud_id AND q.id = p.id AND q.k = (p.k + 2) % 4
  QUALIFY row_number() OVER (PARTITION BY p.cloud_id, p.id ORDER BY round(abs(p.sector - p.acute) + abs(q.sector - p.acute), 9), p.k) = 1),
choices AS (SELECT p.cloud_id, p.id, (p.k - start + 4) % 4 AS slot, way, line_id FROM placed p JOIN starts USING (cloud_id, id)),
going AS (SELECT e.cloud_id, e.a AS u, e.b AS v, {_turn('degrees(atan2(n.y - m.y, n.x - m.x))')} AS heading
  FROM (SELECT cloud_id, u AS a, v AS b FROM edges WHERE length > 0 UNION ALL SELECT cloud_id, v, u FROM edges WHERE length > 0) e
  JOIN nodes m ON m.cloud_id = e.cloud_id AND m.id = e.a JOIN nodes n ON n.cloud_id = e.cloud_id AND n.id = e.b),
fitted AS (SELECT g.cloud_id, g.u, g.v, c.slot FROM going g JOIN choices c ON c.cloud_id = g.cloud_id AND c.id = g.u
  QUALIFY row_number() OVER (PARTITION BY g.cloud_id, g.u, g.v ORDER BY round(abs({_turn('g.heading - c.way + 180')} - 180), 9), c.slot) = 1),
latest AS (SELECT cloud_id, u AS id, slot, max(v) AS neighbour FROM fitted GROUP BY ALL)"""


@query(_with("lines", _CROSS, _NODES, _EDGES, _SLOTS) + f"SELECT cloud_id, id, slot, {_r('way angle')}, line_id, neighbour FROM choices LEFT JOIN latest USING (cloud_id, id, slot)")
def node_slots(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_slots(spark, d))


def _pair() -> Column:
    return F.substring_index("cloud_id", "/", 1)


def _side(spark: SparkSession, d: str, side: str) -> DataFrame:
    return _nodes(spark, d).filter(F.substring_index("cloud_id", "/", -1) == side).withColumn("pair_id", _pair())


_SEEDS = f"""sided AS (SELECT *, split_part(cloud_id, '/', 1) AS pair_id, split_part(cloud_id, '/', 2) AS side FROM nodes),
seeds AS (SELECT pair_id, s.id AS src, t.id AS tgt, exp(-pow(abs(s.angle - t.angle), 2) / {2 * ANGLE * ANGLE}) AS score, s.x AS sx, s.y AS sy, t.x AS tx, t.y AS ty, s.is_right AND t.is_right AS both_right
  FROM sided s JOIN sided t USING (pair_id) WHERE s.side = 'src' AND t.side = 'tgt' AND abs(s.angle - t.angle) <= {ANGLE})"""
_RANKED = """ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY round(score, 9) DESC, src, tgt) AS rank FROM seeds)
  JOIN (SELECT pair_id, count(*) FILTER (side = 'src') * count(*) FILTER (side = 'tgt') AS most FROM sided GROUP BY pair_id) USING (pair_id)
  WHERE rank <= greatest(1, ceil(0.2::DOUBLE * most)))"""
_GRAPH = ("lines", _CROSS, _NODES, _SEEDS)


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return M.seeds(_side(spark, d, "src"), _side(spark, d, "tgt"), ANGLE)


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return M.best_seeds(_seeds(spark, d), _side(spark, d, "src"), _side(spark, d, "tgt"))


@query(_with(*_GRAPH) + f"SELECT pair_id, src, tgt, {_r('score score')} FROM seeds")
def seed_band_join(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_seeds(spark, d))


@query(_with(*_GRAPH, _RANKED) + f"SELECT r.pair_id, r.src, r.tgt, r.rank, o.shift, {_r('score score')} FROM ranked r, (VALUES (0), (1), (2), (3)) o(shift) WHERE r.both_right OR o.shift IN (0, 2)")
def seed_topk(spark: SparkSession, d: str) -> DataFrame:
    right = lambda side, name: _side(spark, d, side).select("pair_id", F.col("id").alias(name), F.col("is_right").alias(f"{name}_right"))
    best = _ranked(spark, d).join(right("src", "src"), ["pair_id", "src"]).join(right("tgt", "tgt"), ["pair_id", "tgt"])
    turns = F.when(F.col("src_right") & F.col("tgt_right"), F.array(*map(F.lit, range(4)))).otherwise(F.array(F.lit(0), F.lit(2)))
    return rounded(best.select("pair_id", "src", "tgt", "rank", F.explode(turns).alias("shift"), "score"))


@query(_with("lines", _CROSS, _NODES) + f"SELECT p.cloud_id, p.id AS i, q.id AS j, {_r('sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) distance')} FROM nodes p JOIN nodes q ON p.cloud_id = q.cloud_id AND p.id <> q.id")
def distance_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.distances(_nodes(spark, d)))


def _matches(spark: SparkSession, d: str) -> DataFrame:
    at = lambda side, k, c: _side(spark, d, side).select("pair_id", F.col("id").alias(k), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"))
    return _ranked(spark, d).join(at("src", "src", "s"), ["pair_id", "src"]).join(at("tgt", "tgt", "t"), ["pair_id", "tgt"]).withColumn("k", F.col("rank"))


_SIMILAR = f"""similar_pairs AS (SELECT p.pair_id, p.rank AS i, q.rank AS j, abs(sqrt(pow(p.sx - q.sx, 2) + pow(p.sy - q.sy, 2)) - sqrt(pow(p.tx - q.tx, 2) + pow(p.ty - q.ty, 2))) AS d
  FROM ranked p JOIN ranked q ON p.pair_id = q.pair_id AND p.rank < q.rank),
weights AS (SELECT pair_id, i, j, CASE WHEN d <= {LENGTH} THEN exp(-d * d / {2 * LENGTH * LENGTH}) ELSE -1.0::DOUBLE END AS weight FROM similar_pairs)"""


@query(_with(*_GRAPH, _RANKED, _SIMILAR) + f"SELECT pair_id, i, count(*) AS n, count(*) FILTER (weight > 0) AS links, {_r('sum(weight) weight')} FROM weights GROUP BY pair_id, i")
def distance_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The whole triangle of similarities of every pair's ranked seeds, told by its rows: three million cells a pair."""
    nodes = _nodes(spark, d).withColumns({"pair_id": _pair(), "side": F.substring_index("cloud_id", "/", -1)})
    return rounded(M.similarity_rows(_ranked(spark, d), nodes, LENGTH))


@query(_with(*_GRAPH, _RANKED, _SIMILAR) + f"SELECT pair_id, count(*) AS links, {_r('sum(weight) weight')} FROM weights WHERE weight > 0 GROUP BY pair_id")
def clique_weight(spark: SparkSession, d: str) -> DataFrame:
    similar = M.similarity(_matches(spark, d), LENGTH).filter("weight > 0")
    return rounded(similar.groupBy("pair_id").agg(F.count("*").alias("links"), F.sum("weight").alias("weight")))


def _subgraphs(spark: SparkSession, d: str) -> DataFrame:
    lines = views.lines(spark, d)
    nodes = scratch.written(_nodes(spark, d).withColumn("pair_id", _pair()).withColumn("side", F.substring_index("cloud_id", "/", -1)), "nodes")
    own = L.slots(nodes, lines, L.edges(nodes, lines)).groupBy("cloud_id", "id").agg(F.sort_array(F.collect_list(F.struct("slot", "neighbour"))).alias("s"))
    graphs = nodes.join(own, ["cloud_id", "id"]).select("pair_id", "side", "id", "x", "y", "angle", "is_right", F.col("s.neighbour").alias("slots"))
    src, tgt = nodes.filter("side = 'src'"), nodes.filter("side = 'tgt'")
    ranked = M.best_seeds(M.seeds(src, tgt, ANGLE), src, tgt)
    return M.match(graphs, ranked, LENGTH, ANGLE).select("pair_id", "candidate", "weight", F.size("matches").alias("size"), F.explode("matches").alias("m"))


@query()
def congruent_subgraphs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_subgraphs(spark, d).select("pair_id", "candidate", "weight", "size", "m.src", "m.tgt"))


@query()
def max_weight_clique(spark: SparkSession, d: str) -> DataFrame:
    """The heaviest clique among all matches of every pair's candidates, searched to its end."""
    found = _subgraphs(spark, d).select("pair_id", "m.*").distinct()
    order = Window.partitionBy("pair_id").orderBy("src", "tgt")
    best = M.heaviest(found.withColumn("k", F.row_number().over(order)), LENGTH)
    return rounded(best.select("pair_id", F.size("members").cast("bigint").alias("size"), "weight"))


_FIT = """sums AS (SELECT pair_id, count(*) AS n, avg(sx) AS a, avg(sy) AS b, avg(tx) AS c, avg(ty) AS d, avg(sx * tx) AS ac, avg(sx * ty) AS ad, avg(sy * tx) AS bc, avg(sy * ty) AS bd FROM ranked GROUP BY pair_id),
turn AS (SELECT *, atan2((ad - a * d) - (bc - b * c), (ac - a * c) + (bd - b * d)) AS yaw FROM sums),
fit AS (SELECT pair_id, n, yaw, c - (cos(yaw) * a - sin(yaw) * b) AS dx, d - (sin(yaw) * a + cos(yaw) * b) AS dy FROM turn)"""


@query(_with(*_GRAPH, _RANKED, _FIT) + f"SELECT pair_id, n, {_r('yaw yaw', 'dx dx', 'dy dy')} FROM fit")
def rigid2d_fit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.rigid2d(_matches(spark, d), "pair_id"))


@query(
    _with(*_GRAPH, _RANKED, _FIT)
    + f"""SELECT pair_id, count(*) AS inliers FROM (SELECT pair_id, cos(yaw) * x - sin(yaw) * y + dx AS x, sin(yaw) * x + cos(yaw) * y + dy AS y FROM sided JOIN fit USING (pair_id) WHERE side = 'src') s
WHERE EXISTS (SELECT 1 FROM sided t WHERE t.side = 'tgt' AND t.pair_id = s.pair_id AND pow(s.x - t.x, 2) + pow(s.y - t.y, 2) <= {LENGTH * LENGTH}) GROUP BY pair_id"""
)
def inlier_count(spark: SparkSession, d: str) -> DataFrame:
    return _inliers(spark, d, _matches(spark, d))


def _inliers(spark: SparkSession, d: str, matches: DataFrame) -> DataFrame:
    fit = S.rigid2d(matches, "pair_id").drop("n")
    source = S.moved2d(_side(spark, d, "src").select("pair_id", "x", "y").join(fit, "pair_id")).select("pair_id", "x", "y")
    return S.inliers(source, _side(spark, d, "tgt").select("pair_id", "x", "y"), LENGTH, ("pair_id",), ("pair_id",))


_NEAR = f"""centres AS (SELECT cloud_id, vx, vy, vz, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM binned GROUP BY ALL),
joined AS (SELECT s.cloud_id AS pair_id, s.vx, s.vy, s.vz, t.vx AS t_vx, t.vy AS t_vy, t.vz AS t_vz, sqrt(pow(s.x - t.x, 2) + pow(s.y - t.y, 2) + pow(s.z - t.z, 2)) AS distance, s.z, t.z AS tz
  FROM centres s JOIN centres t ON t.cloud_id = 'e0' AND s.cloud_id <> 'e0'),
near AS (SELECT * FROM joined WHERE distance <= {SMALL} QUALIFY row_number() OVER (PARTITION BY pair_id, vx, vy, vz ORDER BY round(distance, 9), t_vx, t_vy, t_vz) = 1)"""


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    centres = V.downsample(views.points_small(spark, d), SMALL).drop("n")
    source = centres.filter("cloud_id <> 'e0'").withColumnRenamed("cloud_id", "pair_id").withColumn("target", F.lit("e0"))
    target = centres.filter("cloud_id = 'e0'").withColumnRenamed("cloud_id", "target")
    return S.nearest(source, target, SMALL, ("target",), ("pair_id", "vx", "vy", "vz"), ("vx", "vy", "vz"))


@query(_with("points_small", _binned("points_small", SMALL), _NEAR) + f"SELECT pair_id, vx, vy, vz, t_vx, t_vy, t_vz, {_r('distance distance')} FROM near")
def nn_voxel_join(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_nearest(spark, d).drop("target", "z", "tz"))


@query(
    _with("points_small", _binned("points_small", SMALL), _NEAR)
    + f""", bins AS (SELECT pair_id, floor(round((tz - z) / {SMALL / 4}::DOUBLE, 9))::BIGINT AS bin, tz - z AS dz FROM near),
wide AS (SELECT pair_id, bin + s AS at_bin, count(*) AS support, sum(dz) AS total FROM bins, (VALUES (-1), (0), (1)) v(s) GROUP BY ALL)
SELECT pair_id, support, {_r('(total / support) dz')} FROM wide QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY support DESC, at_bin) = 1"""
)
def z_offset(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.z_offset(_nearest(spark, d), SMALL / 4, "pair_id"))


def _poses(spark: SparkSession, d: str) -> DataFrame:
    zero = F.lit(0.0)
    return views.transforms(spark, d).withColumns({"truth": G.yaw_matrix(F.col("yaw_gt"), zero, zero, zero), "estimate": G.yaw_matrix(F.col("yaw_est"), F.col("terr"), zero, -F.col("terr"))})


_ENTRIES = {"m00": "cos(yaw_est)", "m01": "-sin(yaw_est)", "m03": "terr", "m10": "sin(yaw_est)", "m11": "cos(yaw_est)", "m13": "0.0::DOUBLE", "m22": "1.0::DOUBLE", "m23": "-terr", "m33": "1.0::DOUBLE"}


@query(_with("transforms") + f"SELECT pair_idx, {_r(*(f'({e}) {n}' for n, e in _ENTRIES.items()))} FROM transforms")
def compose_transform(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_poses(spark, d).select("pair_idx", *[F.col("estimate")[int(n[1]) * 4 + int(n[2])].alias(n) for n in _ENTRIES]))


_ERRORS = """errors AS (SELECT *, degrees(acos(greatest(-1.0, least(1.0, (2 * (cos(yaw_gt) * cos(yaw_est) + sin(yaw_gt) * sin(yaw_est)) + 1 - 1) / 2)))) AS rotation_error, sqrt(2 * terr * terr) AS translation_error FROM transforms)"""


# acos magnifies rounding near 0 degrees: four places
@query(_with("transforms", _ERRORS) + "SELECT pair_idx, round(rotation_error, 4) + 0.0 AS rotation_error FROM errors")
def rotation_error(spark: SparkSession, d: str) -> DataFrame:
    return _poses(spark, d).select("pair_idx", (F.round(G.rotation_error(F.col("truth"), F.col("estimate")), 4) + F.lit(0.0)).alias("rotation_error"))


@query(_with("transforms", _ERRORS) + f"SELECT pair_idx, {_r('translation_error translation_error')} FROM errors")
def translation_error(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_poses(spark, d).select("pair_idx", G.translation_error(F.col("truth"), F.col("estimate")).alias("translation_error")))


@query(
    _with("points_small", "transforms")
    + f""", e AS (SELECT t.pair_idx, sqrt(pow((cos(yaw_gt) - cos(yaw_est)) * x - (sin(yaw_gt) - sin(yaw_est)) * y - terr, 2) + pow((sin(yaw_gt) - sin(yaw_est)) * x + (cos(yaw_gt) - cos(yaw_est)) * y, 2) + terr * terr) AS error
  FROM transforms t JOIN points_small p ON p.cloud_id = concat('e', (t.pair_idx % 10)::VARCHAR))
SELECT pair_idx, count(*) AS n, {_r('sqrt(avg(error * error)) rmse', 'median(error) median_error')} FROM e GROUP BY pair_idx"""
)
def rmse_median_error(spark: SparkSession, d: str) -> DataFrame:
    pairs = _poses(spark, d).select("pair_idx", F.concat(F.lit("e"), (F.col("pair_idx") % 10).cast("string")).alias("cloud_id"), "truth", "estimate")
    return rounded(C.residuals(views.points_small(spark, d), pairs, "cloud_id"))


def _results(spark: SparkSession, d: str) -> DataFrame:
    errors = _poses(spark, d).select("pair_idx", "source", "target", G.rotation_error(F.col("truth"), F.col("estimate")).alias("rotation_error"), G.translation_error(F.col("truth"), F.col("estimate")).alias("translation_error"))
    good = C.success(F.round("rotation_error", 4), F.round("translation_error", 4), 5.0, 2.0)
    return errors.join(views.runtimes(spark, d), "pair_idx", "left").withColumn("success", good)


_RESULTS = "results AS (SELECT pair_idx, source, target, rotation_error, translation_error, time_s, round(rotation_error, 4) <= 5 AND round(translation_error, 4) <= 2 AS success FROM errors LEFT JOIN runtimes USING (pair_idx))"


@query(_with("transforms", "runtimes", _ERRORS, _RESULTS) + f"SELECT pair_idx, source, target, success, {_r('time_s time_s')} FROM results")
def runtime_left_join(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_results(spark, d).select("pair_idx", "source", "target", "success", "time_s"))


@query(
    _with("transforms", "runtimes", _ERRORS, _RESULTS)
    + f"""SELECT count(*) AS pairs, count(*) FILTER (success) AS successes, {_r('avg(success::INT) success_rate')},
  round(avg(rotation_error) FILTER (success), 4) AS mean_rotation_error, {_r('(avg(translation_error) FILTER (success)) mean_translation_error', 'avg(time_s) mean_time_s', '(avg(time_s) FILTER (success)) mean_time_s_success')} FROM results"""
)
def registration_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.summary(_results(spark, d)).withColumn("mean_rotation_error", F.round("mean_rotation_error", 4)))


@query(
    _with("lines", _CROSS, _NODES)
    + """, near AS (SELECT cloud_id, id, list_sort(list(DISTINCT l)) AS own FROM (SELECT cloud_id, id, unnest([line0, line1]) AS l FROM nodes) GROUP BY ALL),
paired AS (SELECT p.cloud_id, p.id AS i, q.id AS j, p.own AS a, q.own AS b FROM near p JOIN near q ON p.cloud_id = q.cloud_id AND p.id < q.id)
SELECT cloud_id, i, j, len(list_intersect(a, b)) AS n_both, len(list_distinct(list_concat(a, b))) AS n_either, len(a) - len(list_intersect(a, b)) AS n_first FROM paired"""
)
def set_algebra(spark: SparkSession, d: str) -> DataFrame:
    own = _nodes(spark, d).select("cloud_id", "id", F.array("line0", "line1").alias("own"))
    one, two = own.select("cloud_id", F.col("id").alias("i"), F.col("own").alias("a")), own.select("cloud_id", F.col("id").alias("j"), F.col("own").alias("b"))
    size = lambda c, n: F.size(c).cast("bigint").alias(n)
    return one.join(two, "cloud_id").filter("i < j").select("cloud_id", "i", "j", size(F.array_intersect("a", "b"), "n_both"), size(F.array_union("a", "b"), "n_either"), size(F.array_except("a", "b"), "n_first"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with their point errors, run times, and success by strict thresholds and a positive time."""
    pairs = _poses(spark, d).select("pair_idx", "source", "target", F.concat(F.lit("e"), (F.col("pair_idx") % 10).cast("string")).alias("cloud_id"), "truth", "estimate")
    return C.scored(pairs, views.points_small(spark, d), views.runtimes(spark, d), "cloud_id", "pair_idx", 5.0, 2.0)


# the rotation error counts with four places, as above
_STRICT = """points_errors AS (SELECT t.pair_idx, sqrt(pow((cos(yaw_gt) - cos(yaw_est)) * x - (sin(yaw_gt) - sin(yaw_est)) * y - terr, 2) + pow((sin(yaw_gt) - sin(yaw_est)) * x + (cos(yaw_gt) - cos(yaw_est)) * y, 2) + terr * terr) AS error
  FROM transforms t JOIN points_small p ON p.cloud_id = concat('e', (t.pair_idx % 10)::VARCHAR)),
spread AS (SELECT pair_idx, sqrt(avg(error * error)) AS rmse, median(error) AS median_error FROM points_errors GROUP BY pair_idx),
scored AS (SELECT e.pair_idx, source, target, rotation_error, translation_error, rmse, median_error, time_s,
    coalesce(round(rotation_error, 4) < 5 AND round(translation_error, 4) < 2 AND time_s > 0, false) AS success
  FROM errors e LEFT JOIN spread USING (pair_idx) LEFT JOIN runtimes USING (pair_idx))"""


@query(_with("points_small", "transforms", "runtimes", _ERRORS, _STRICT) + f"SELECT pair_idx, source, target, success, {_r('translation_error translation_error', 'rmse rmse', 'median_error median_error', 'time_s time_s')} FROM scored")
def strict_success(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_scored(spark, d).select("pair_idx", "source", "target", "success", "translation_error", "rmse", "median_error", "time_s"))


@query(
    _with("points_small", "transforms", "runtimes", _ERRORS, _STRICT)
    + f"""SELECT count(*) AS pairs, count(*) FILTER (success) AS successes, {_r('avg(success::INT) success_rate')}, round(avg(rotation_error) FILTER (success), 4) AS mean_rotation_error,
  {_r('(avg(translation_error) FILTER (success)) mean_translation_error', '(avg(rmse) FILTER (success)) mean_rmse', '(avg(median_error) FILTER (success)) mean_median_error', 'avg(time_s) mean_time_s', '(avg(time_s) FILTER (success)) mean_time_s_success')} FROM scored"""
)
def scoring_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.summary(_scored(spark, d)).withColumn("mean_rotation_error", F.round("mean_rotation_error", 4)))


@query(
    "WITH l AS (SELECT l_linenumber, l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_shipdate FROM lineitem)\n"
    "SELECT concat('c', l_linenumber::VARCHAR) AS cloud_id, l_orderkey AS source_key, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS point_id FROM l"
)
def point_ordinal(spark: SparkSession, d: str) -> DataFrame:
    return views.points(spark, d, "l_orderkey").select("cloud_id", F.col("l_orderkey").alias("source_key"), "point_id")


@query(
    _with("lines")
    + f"""SELECT split_part(s.cloud_id, '/', 1) AS pair_id, s.line_id AS i, t.line_id AS j, {_r('degrees(acos(least(1.0, abs(s.a * t.a + s.b * t.b)))) normal_angle',
        '(abs(s.a * (s.a * s.c - t.a * t.c) + s.b * (s.b * s.c - t.b * t.c)) / 2 + abs(t.a * (s.a * s.c - t.a * t.c) + t.b * (s.b * s.c - t.b * t.c)) / 2) plane_distance')}
  FROM lines s JOIN lines t ON split_part(s.cloud_id, '/', 2) = 'src' AND t.cloud_id = concat(split_part(s.cloud_id, '/', 1), '/tgt')"""
)
def plane_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Every line as an upright plane through its foot, beside every line of its pair's other side."""
    foot = lambda side, k: views.lines(spark, d).filter(F.substring_index("cloud_id", "/", -1) == side).select(
        _pair().alias("pair_id"), F.col("line_id").alias("i" if k == 1 else "j"), F.array("a", "b", F.lit(0.0)).alias(f"n{k}"), F.array(-F.col("a") * F.col("c"), -F.col("b") * F.col("c"), F.lit(0.0)).alias(f"c{k}")
    )
    both = foot("src", 1).join(foot("tgt", 2), "pair_id")
    c1, n1, c2, n2 = (F.col(c) for c in ("c1", "n1", "c2", "n2"))
    return rounded(both.select("pair_id", "i", "j", G.normal_angle(n1, n2).alias("normal_angle"), G.plane_distance(c1, n1, c2, n2).alias("plane_distance")))
