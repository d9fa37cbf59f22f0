"""Forests, their persistence and the naming of peaks, against plain code."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from galvana.operators import curves, forest, isolation, labels
from galvana.sources import models

SETTINGS = forest.Settings(trees=6, depth=4, bins=16, seed=7)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    rows = [(k, "charge" if k % 2 else "discharge", *map(float, rng.random(3).round(2)), None) for k in range(160)]
    rows = [(k, leg, a, b, c, "abc"[int(a > 0.4) + int(b > 0.6)]) for k, leg, a, b, c, _ in rows]
    rows += [(500, "charge", None, 0.5, math.nan, "a"), (501, None, 0.1, 0.1, 0.1, "a"), (502, "charge", 0.1, 0.1, 0.1, None), (503, "alone", 0.1, 0.2, 0.3, "a"), (500, "charge", None, 0.5, math.nan, "a")]
    return spark.createDataFrame(rows, "id long, leg string, a double, b double, c double, y string").repartition(3), rows


@pytest.fixture(scope="module")
def forests(table):
    return forest.train(table[0], ["a", "b", "c"], "y", ["id"], "leg", SETTINGS)


def plain_tree(x, y, n, classes, seed, g, t, s):
    """One tree by recursion over all thresholds; x are bins."""
    drawn = np.array([sum(w for w, own in zip(n, y, strict=True) if own == c) for c in range(classes)], float)
    weight = np.where(drawn > 0, drawn.sum() / np.maximum(1, (drawn > 0).sum() * np.maximum(drawn, 1)), 0)
    nodes = [None]
    level = [(0, np.arange(len(x)))]
    for depth in range(s.depth + 1):
        after = []
        for node, rows in level:
            counts = np.array([sum(n[r] for r in rows if y[r] == c) for c in range(classes)], float)
            found = None
            if depth < s.depth and (counts > 0).sum() >= 2:
                order = np.random.default_rng([seed, g, t, node]).permutation(x.shape[1]).tolist()
                best = 1e-12
                for k, f in enumerate(order):
                    if k >= max(1, math.isqrt(x.shape[1])) and found:
                        break
                    for b in range(s.bins - 1):
                        low = np.array([sum(n[r] for r in rows if y[r] == c and x[r, f] <= b) for c in range(classes)], float)
                        if low.sum() < s.least or (counts - low).sum() < s.least:
                            continue
                        gini = lambda p: ((p * weight) ** 2).sum() / (p * weight).sum()
                        gain = gini(low) + gini(counts - low) - gini(counts)
                        if gain > best * (1 + 1e-9):
                            best, found = gain, (f, b)
            nodes[node] = (*(found or (-1, 0)), counts * weight / (counts * weight).sum())
            if found:
                at = len(nodes)
                nodes += [None, None]
                after += [(at, np.array([r for r in rows if x[r, found[0]] <= found[1]])), (at + 1, np.array([r for r in rows if x[r, found[0]] > found[1]]))]
        level = after
    return nodes


def between(values, q):
    values, at = np.sort(values), q * (len(values) - 1)
    lo, hi = values[math.floor(at)], values[math.ceil(at)]
    return lo + (hi - lo) * (at - math.floor(at))


def test_splits_shares_and_votes_equal_plain_code(spark, table, forests):
    df, rows = table
    keys = {r["id"]: r["h"] for r in df.select("id", F.xxhash64("id").alias("h")).collect()}
    assert set(forests.members) == {"charge", "discharge"}
    for g, leg in enumerate(sorted(forests.members)):
        own = [r for r in rows if r[1] == leg and r[5] is not None]
        f = forests.members[leg]
        raw = np.array([[math.nan if v is None else v for v in r[2:5]] for r in own])
        assert np.allclose(f.center, np.nanmedian(raw, axis=0)) and f.rows == len(own) and f.classes == ("a", "b", "c")
        x = np.where(np.isfinite(raw), raw, f.center)
        cuts = [np.unique([between(raw[np.isfinite(raw[:, k]), k], q / 16) for q in range(1, 16)]) for k in range(3)]
        bins = np.array([[sum(v > c for c in cuts[k]) for k, v in enumerate(r)] for r in x])
        y = [f.classes.index(r[5]) for r in own]
        h = np.array([keys[r[0]] for r in own])
        votes, asked = np.zeros((len(own), 3)), np.zeros(len(own), int)
        for t, tree in enumerate(f.trees):
            n = forest.draws(h, t, SETTINGS.seed)
            want = plain_tree(bins, y, n, 3, SETTINGS.seed, g, t, SETTINGS)
            assert tree.feature.tolist() == [w[0] for w in want]
            assert np.allclose(tree.share, [w[2] for w in want])
            inner = tree.feature >= 0
            assert np.allclose(tree.threshold[inner], [cuts[w[0]][w[1]] for w in want if w[0] >= 0])
            out = n == 0
            votes[out] += tree.share[forest._reached(tree, x[out])]
            asked += out
        assert f.oob == pytest.approx(np.mean((votes.argmax(axis=1) == y)[asked > 0]))
        found = {r["id"]: r["p"] for r in df.where(F.col("leg") == leg).select("id", forest.probabilities(forests, df).alias("p")).collect()}
        for r, p in zip(own, f.probabilities(raw), strict=True):
            assert [found[r[0]].get(c, 0.0) for c in f.classes] == pytest.approx(p.tolist())


def test_draws_are_poisson():
    n = np.concatenate([forest.draws(np.arange(20_000), t, 1) for t in range(3)])
    assert abs(n.mean() - 1) < 0.02 and abs(n.var() - 1) < 0.04 and abs((n == 0).mean() - math.exp(-1)) < 0.01


def test_groups_without_two_classes_have_no_forest(spark, table, forests):
    df, _ = table
    rows = {r["id"]: r["p"] for r in df.select("id", forest.probabilities(forests, df).alias("p")).collect()}
    assert rows[503] is None and rows[501] is None and rows[502] is not None
    empty = forest.train(df.where("false"), ["a"], "y", ["id"], "leg", SETTINGS)
    assert empty.members == {} and df.select(forest.probabilities(empty, df).alias("p")).where("p is not null").count() == 0


def test_models_come_back_from_parquet_with_equal_scores(spark, table, forests, tmp_path):
    df, _ = table
    back = models.load(spark, models.save(spark, forests, str(tmp_path / "labels")))
    assert back.by == "leg" and back.members["charge"].oob == forests.members["charge"].oob
    x = np.random.default_rng(1).random((50, 3))
    for leg, f in forests.members.items():
        assert (back.members[leg].probabilities(x) == f.probabilities(x)).all()
    alone = isolation.train(df, ["a", "b", "c"], trees=5, size=32, keys=["id"])
    again = models.load(spark, models.save(spark, alone, str(tmp_path / "isolation")))
    assert (again.scores(x) == alone.scores(x)).all() and (again.watch, again.alert) == (alone.watch, alone.alert)
    path = models.save_table(df.select("id", "a"), str(tmp_path / "table"))
    assert models.load_table(spark, path).count() == df.count()
    old = spark.read.parquet(str(tmp_path / "labels" / "forests")).withColumn("version", F.lit(0))
    old.write.parquet(str(tmp_path / "old" / "forests"))
    with pytest.raises(ValueError, match="version"):
        models.load(spark, str(tmp_path / "old"))


def test_centroids_and_their_windows(spark):
    rows = [("charge", "P1", 3.5 + 0.01 * k, -2.0 * k) for k in range(5)] + [("charge", "P2", 3.7, 4.0)] * 3 + [("charge", "P3", 3.7, 1.0), ("charge", "P3", 3.7, 1.0), ("charge", "P3", 3.9, 1.0)] + [(None, "P1", 1.0, 1.0)]
    found = {r["peak_id"]: r for r in labels.centroids(spark.createDataFrame(rows, "leg string, peak_id string, V double, H double")).collect()}
    assert found["P1"]["V"] == pytest.approx(3.52) and found["P1"]["H_abs"] == pytest.approx(4.0) and found["P1"]["n_ref"] == 5
    assert found["P1"]["v_hi"] - found["P1"]["V"] == pytest.approx(0.03)  # 2 * 1.4826 * 0.01 is below the least
    assert found["P2"]["v_hi"] - 3.7 == pytest.approx(0.06)  # no spread at all: 2 * 1.4826 * 0.03 is above the most
    assert found["P3"]["v_hi"] - 3.7 == pytest.approx(0.06)  # the population's deviation steps in


def test_probability_lowers_the_cost_of_a_match(spark):
    refs = spark.createDataFrame([("charge", "P1", 3.5, 1.0), ("charge", "P2", 3.6, 1.0)], "leg string, peak_id string, V double, H double")
    rows = [("x", 1, "charge", 3.54, 1.0, {"P2": 1.0}), ("x", 1, "charge", 3.2, 1.0, None), ("x", 2, "charge", 3.54, 1.0, {"P1": 0.5, "P2": 0.2})]
    candidates = spark.createDataFrame(rows, "cell_id string, cycle int, leg string, V double, H double, proba map<string,double>")
    found = {(r["cycle"], r["peak_id"]): r for r in curves.assign_peaks(candidates, refs, share=0.5).collect()}
    assert set(found) == {(1, "P2"), (2, "P1")}
    assert found[1, "P2"]["cost"] == pytest.approx(0.06 * 0.5) and found[1, "P2"]["confidence"] == pytest.approx(1 - 0.03 / 0.12)
    assert found[2, "P1"]["cost"] == pytest.approx(0.04 * 0.75) and found[2, "P1"]["probability"] == 0.5


def test_overlap_rows_soft_scores_and_collapses(spark):
    tests = spark.createDataFrame([(1, 50, c, "charge", p, v, 2.0) for c in (48, 49) for p, v in (("P1", 3.5), ("P2", 3.58), ("P3", 3.9))], "cell_id int, life int, cycle int, leg string, peak_id string, V double, H double")
    expected = spark.createDataFrame([(1, 50, "charge", p, v) for p, v in (("P1", 3.51), ("P2", 3.56), ("P3", 3.9))], "cell_id int, life int, leg string, peak_id string, V double")
    routine = [(1, c, "charge", k, v, 1.5) for c in (39, 45, 55, 60, 61) for k, v in enumerate((3.55, 3.6, 4.1))]
    candidates = spark.createDataFrame(routine, "cell_id int, cycle int, leg string, candidate int, V double, H double")
    near = labels.near_cycles(tests, candidates)
    assert sorted(r["cycle"] for r in near.collect()) == [45, 55, 60]
    rows = labels.overlap_rows(tests, expected, candidates, near).collect()
    want = [("routine_0p5", c, p, v) for c in (45, 55, 60) for p, v in (("P1", 3.55), ("P2", 3.6))] + [("rpt_0p33", c, p, v) for c in (48, 49) for p, v in (("P1", 3.5), ("P2", 3.58), ("P3", 3.9))]
    assert sorted((r["source"], r["cycle"], r["peak_id"], r["V"]) for r in rows) == sorted(want)
    out = labels.overlap(tests, expected, candidates, candidates, forest.Settings(trees=8, depth=4, least=2, least_rows=8))
    soft = out["soft"].collect()
    assert len(soft) == 3 * 3 * 3
    for r in soft:
        d = abs(r["V"] - r["V_expected"])
        geom = math.exp(-d / 0.12) if d <= 0.18 else 0.0
        assert r["geom_score"] == pytest.approx(geom) and r["score"] == pytest.approx(0.55 * r["rf_proba"] + 0.45 * geom)
    assert all(len(r["peaks"]) >= 2 for r in out["collapses"].collect())
    best = {(r["cycle"], r["peak_id"]): r["score"] for r in out["links"].collect()}
    for (cycle, peak), own in itertools.groupby(sorted(soft, key=lambda r: (r["cycle"], r["peak_id"])), key=lambda r: (r["cycle"], r["peak_id"])):
        assert best[cycle, peak] == pytest.approx(max(r["score"] for r in own))
