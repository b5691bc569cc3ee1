import importlib
import itertools
import sys

import duckdb
import numpy as np
import pytest

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
from strataform.operators import matching as M  # noqa: E402
from strataform.plans import catalog  # noqa: E402


@pytest.mark.parametrize("name", ["voxel_downsample", "planar_voxels", "neighbor_mask", "hough_topk_lines", "line_graph_edges", "node_slots", "seed_topk", "distance_similarity", "clique_weight", "rigid2d_fit", "inlier_count", "nn_voxel_join", "z_offset", "registration_summary"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    frame = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    told = con.execute(catalog.ORACLES[name])
    order = [[x[0] for x in told.description].index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in frame.collect()) == sorted(str(tuple(r[k] for k in order)) for r in told.fetchall())


def test_thinning_to_the_end_equals_sql(spark):
    folder = FOLDER.replace("sf0.001", "sf0.01")  # no pixel of the smallest tables holds enough points
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    got = [(r.cloud_id, r.row, r.col) for r in catalog.QUERIES["thin_fixpoint"](spark, folder).collect()]
    assert len(got) > 1000 and sorted(got) == sorted(con.execute(catalog.ORACLES["thin_fixpoint"]).fetchall())


def test_all_ranked_seeds_equal_brute_force(spark):
    at = {(r.cloud_id, r.id): (r.x, r.y) for r in catalog._nodes(spark, FOLDER).collect()}
    seeds = sorted(catalog._ranked(spark, FOLDER).collect(), key=lambda r: (r.pair_id, r["rank"]))
    run = lambda name: catalog.QUERIES[name](spark, FOLDER).collect()
    pairs = {p: list(g) for p, g in itertools.groupby(seeds, lambda r: r.pair_id)}
    rows, totals, fits, inliers = {}, {r.pair_id: r for r in run("clique_weight")}, {r.pair_id: r for r in run("rigid2d_fit")}, {r.pair_id: r.inliers for r in run("inlier_count")}
    for r in run("distance_similarity"):
        rows.setdefault(r.pair_id, {})[r.i] = r
    assert len(pairs) == 4 and set(pairs) == set(rows) == set(totals) == set(fits) == set(inliers)
    for pair, ranked in pairs.items():
        s, t = (np.array([at[f"{pair}/{side}", r[side]] for r in ranked]) for side in ("src", "tgt"))
        apart = lambda p: np.hypot(p[:, None, 0] - p[None, :, 0], p[:, None, 1] - p[None, :, 1])
        gap = np.abs(apart(s) - apart(t))
        weight = np.triu(np.where(gap <= catalog.LENGTH, np.exp(-(gap**2) / (2 * catalog.LENGTH**2)), -1.0), 1)
        assert [ranked[k]["rank"] for k in range(len(ranked))] == list(range(1, len(ranked) + 1))
        for k in range(len(ranked) - 1):
            r = rows[pair][k + 1]
            assert (r.n, r.links) == (len(ranked) - 1 - k, (weight[k] > 0).sum()) and abs(r.weight - weight[k].sum()) < 1e-5
        assert totals[pair].links == (weight > 0).sum() and abs(totals[pair].weight - weight[weight > 0].sum()) < 1e-4
        (a, b), (c, d) = (s - s.mean(0)).T, (t - t.mean(0)).T
        yaw = np.arctan2((a * d - b * c).sum(), (a * c + b * d).sum())
        turn = np.array([[np.cos(yaw), -np.sin(yaw)], [np.sin(yaw), np.cos(yaw)]])
        shift = t.mean(0) - turn @ s.mean(0)
        assert fits[pair].n == len(ranked) and np.abs(np.array([fits[pair].yaw, fits[pair].dx, fits[pair].dy]) - [yaw, *shift]).max() < 1e-5
        source, target = (np.array([p for (name, _), p in at.items() if name == f"{pair}/{side}"]) for side in ("src", "tgt"))
        moved = source @ turn.T + shift
        assert inliers[pair] == (((moved[:, None] - target[None]) ** 2).sum(2).min(1) <= catalog.LENGTH**2).sum()


def test_similarity_rows_equal_the_cells_without_making_them(spark):
    rng = np.random.default_rng(5)
    nodes = [(f"q{p}", side, k, *map(float, rng.uniform(0, 6, 2))) for p in range(3) for side in ("src", "tgt") for k in range(12)]
    at = {(p, side, k): (x, y) for p, side, k, x, y in nodes}
    seeds = [(f"q{p}", int(rng.integers(12)), int(rng.integers(12)), k + 1) for p, n in enumerate((70, 2, 1)) for k in range(n)]
    matches = [(p, k, *at[p, "src", s], *at[p, "tgt", t]) for p, s, t, k in seeds]
    ranked = spark.createDataFrame(seeds, "pair_id string, src int, tgt int, rank int")
    found = M.similarity_rows(ranked, spark.createDataFrame(nodes[::-1], "pair_id string, side string, id int, x double, y double"), 1.0)
    cells = {}
    for r in M.similarity(spark.createDataFrame(matches, "pair_id string, k int, sx double, sy double, tx double, ty double"), 1.0).collect():
        cells.setdefault((r.pair_id, r.i), []).append(r.weight)
    got = {(r.pair_id, r.i): r for r in found.collect()}
    assert set(got) == set(cells) and len(got) == 70
    assert all((got[k].n, got[k].links) == (len(w), sum(x > 0 for x in w)) and abs(got[k].weight - sum(w)) < 1e-9 for k, w in cells.items())
    iu, iv = (np.array([s[c] for s in seeds if s[0] == "q0"]) for c in (1, 2))
    apart = lambda side: np.array([[np.hypot(*np.subtract(at["q0", side, i], at["q0", side, j])) for j in range(12)] for i in range(12)])
    blocks = [M._triangle_rows(iu, iv, apart("src"), apart("tgt"), 1.0, cells) for cells in (1, 300, 1 << 16)]
    assert all((b[0] == blocks[0][0]).all() and np.abs(b[1] - blocks[0][1]).max() < 1e-9 for b in blocks)
    plan = catalog.QUERIES["distance_similarity"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.splitlines()[1].lstrip("+- ").startswith("FlatMapCoGroupsInArrow")  # no aggregate over a join of matches


def test_heaviest_cliques_cover_every_pair(spark):
    """No clique of one candidate is heavier than that of all its pair's matches, and small tables give brute force's."""
    best = {r.pair_id: r for r in catalog.QUERIES["max_weight_clique"](spark, FOLDER).collect()}
    grown = {}
    for r in catalog.QUERIES["congruent_subgraphs"](spark, FOLDER).collect():
        grown[r.pair_id] = max(grown.get(r.pair_id, 0.0), r.weight)
    assert set(best) == set(grown) == {"p0", "p1", "p2", "p3"} and all(best[p].weight >= grown[p] - 1e-5 for p in grown)
    rng = np.random.default_rng(3)
    matches = [(f"q{p}", k, *map(float, rng.uniform(0, 4, 4))) for p in range(3) for k in range(9)]
    similar = M.similarity(spark.createDataFrame(matches, "pair_id string, k int, sx double, sy double, tx double, ty double"), 1.0)
    weights = {}
    for r in similar.collect():
        weights.setdefault(r.pair_id, {})[r.i, r.j] = r.weight
    for r in M.cliques(similar).collect():
        w = weights[r.pair_id]
        sets = [c for n in range(2, 10) for c in itertools.combinations(range(9), n) if all(w[e] > 0 for e in itertools.combinations(c, 2))]
        top = max(sum(w[e] for e in itertools.combinations(c, 2)) for c in sets)
        assert abs(r.weight - top) < 1e-9 and abs(sum(w[e] for e in itertools.combinations(r.members, 2)) - top) < 1e-9


def test_heaviest_equals_the_cliques_of_similar_rows(spark):
    """Also for one match, for two that nothing links, and for matches that share a node."""
    rng = np.random.default_rng(8)
    matches = [("a", k, *map(float, rng.integers(0, 5, 4) + rng.uniform(0, 0.2, 4))) for k in range(40)] + [("b", 7, 0.0, 0.0, 0.0, 0.0), ("c", 1, 0.0, 0.0, 0.0, 0.0), ("c", 2, 9.0, 0.0, 0.0, 0.0), ("d", 1, 1.0, 1.0, 0.0, 0.0), ("d", 2, 1.0, 1.0, 0.5, 0.0)]
    frame = spark.createDataFrame(matches, "pair_id string, k int, sx double, sy double, tx double, ty double").repartition(3)
    told = {r.pair_id: r for r in M.cliques(M.similarity(frame, 1.0)).collect()}
    got = {r.pair_id: r for r in M.heaviest(frame, 1.0).collect()}
    assert set(got) == set(told) == {"a", "c", "d"} and got["c"].members == [] and got["c"].weight == 0.0 and len(got["a"].members) > 2
    assert all(got[p].members == told[p].members and abs(got[p].weight - told[p].weight) < 1e-9 for p in told)
    plan = catalog.QUERIES["max_weight_clique"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.splitlines()[1].lstrip("+- ").startswith("FlatMapGroupsInArrow")  # no join of matches with themselves


def test_entry_works_without_the_removable_part(monkeypatch):
    monkeypatch.setitem(sys.modules, "strataform.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    sys.modules.pop("__spark_entry__", None)
    assert "planar_voxels" in entry.queries() and not any(n.startswith("op") for n in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
