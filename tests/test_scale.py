"""What a step costs, where a plainer one would not end on larger tables, and that its results stay."""

import os

import numpy as np
import pandas as pd
import pytest

from galvana.functions import fits, kernels, ridges
from galvana.operators import curves, dcir, evolution, isolation, wide
from galvana.plans import queries

DATA = "/root/testdata/sf0.001"


def test_a_fit_asks_its_curve_a_few_hundred_times(monkeypatch):
    asked, interp = [0], np.interp

    def counted(*a, **k):
        asked[0] += 1
        return interp(*a, **k)

    rng = np.random.default_rng(5)
    q = np.linspace(0, 900, 400)
    rough = lambda: np.cumsum(rng.gamma(1.0, 0.5, 400))
    monkeypatch.setattr(np, "interp", counted)
    for _ in range(4):
        found = fits.three_parameters(q, rough(), q * 0.95, rough(), 40.0, 0.05)
        assert found["dchg_fit_residual_rms"] > 0
    assert asked[0] < 4 * 1500


def test_fits_of_many_curves_step_together(monkeypatch):
    rng = np.random.default_rng(8)
    even = np.linspace(0, 900, 400)
    curves = [(q, np.cumsum(rng.gamma(1.0, 0.5, len(q))), np.linspace(0, 850, m), np.cumsum(rng.gamma(1.0, 0.5, m))) for q, m in [(even, 400)] * 40 + [(30 * np.sqrt(even), 300), (even[:15], 400)]]
    alone = [fits.three_parameters(*c, 40.0, 0.05) for c in curves]
    asked, solve = [0], np.linalg.solve

    def counted(*a):
        asked[0] += 1
        return solve(*a)

    monkeypatch.setattr(np.linalg, "solve", counted)
    found = fits.three_parameters_many(curves, 40.0, 0.05)
    assert asked[0] < 40 * len(curves)
    for one, of_many in zip(alone, found, strict=True):
        assert list(one) == list(of_many) and one == pytest.approx(of_many, rel=1e-6, abs=1e-9, nan_ok=True)
    assert np.isnan(found[-1]["dchg_fit_dR"]) and not np.isnan(found[-2]["dchg_fit_dR"])
    # A reference whose knots lie unevenly is read where np.interp reads it.
    x, y, q, v = curves[-2]
    root = np.sqrt(fits._weights(q, v))

    def weighed(p):
        r = (v - np.interp(p[0] * q + p[1], x, y, left=np.nan, right=np.nan) + 0.04 * p[2]) * root
        return np.where(np.isnan(r), 0.0, r)

    low, high = (0.5, -255.0, -5.0), (1.2, 255.0, 50.0)
    p, _ = min((fits.robust(weighed, (s, 0.0, 0.0), low, high, 0.05, rest=1e-4) for s in (1.0, 0.9, 1.1)), key=lambda x: x[1])
    loss = lambda r: (np.sqrt(1 + (r / 0.05) ** 2) - 1).sum()
    assert found[-2]["dchg_fit_degenerate_flag"] or loss(weighed([found[-2][c] for c in ("dchg_fit_scale", "dchg_fit_offset", "dchg_fit_dR")])) <= 1.02 * loss(weighed(p))


def test_many_robust_fits_end_where_one_does():
    rng = np.random.default_rng(4)
    t = np.linspace(0, 5, 60)
    y = np.array([a * np.exp(-t / b) for a, b in ((2, 1.3), (1.5, 0.9), (2.6, 2.0), (4, 9))]) + rng.normal(0, 0.01, (4, 60))
    y[:, ::9] += 0.8

    def problem(at):
        def of(p):
            e = np.exp(-t / p[:, 1:])
            return p[:, :1] * e - y[at], np.stack([e, p[:, :1] * e * t / p[:, 1:] ** 2], axis=1)

        return of

    low, high = np.tile([0, 0.1], (4, 1)), np.tile([3, 5], (4, 1))
    p, loss = fits.robust_many(problem, np.ones((4, 2)), low, high, 0.05, width=2)
    for k in range(4):
        one = fits.robust(lambda a: problem([k])(a[None])[0][0], (1, 1), (0, 0.1), (3, 5), 0.05, slopes=lambda a: problem([k])(a[None])[1][0].T)  # noqa: B023
        assert p[k] == pytest.approx(one[0], rel=1e-6) and loss[k] == pytest.approx(one[1])


def test_slopes_and_differences_end_in_the_same_fit():
    q = np.linspace(0, 50, 300)
    shape = lambda x: 4.1 - 0.012 * x - 0.15 * np.tanh((x - 15) / 3)
    v = shape(0.95 * q * 0.9 + 1.5)
    model = lambda p: shape(p[0] * q * 0.9 + p[1]) - v
    down = lambda x: -0.012 - 0.05 / np.cosh((x - 15) / 3) ** 2
    told = fits.robust(model, (1, 0), (0.5, -9), (1.2, 9), 0.05, slopes=lambda p: np.stack([down(p[0] * q * 0.9 + p[1]) * q * 0.9, down(p[0] * q * 0.9 + p[1])], axis=1))
    plain = fits.robust(model, (1, 0), (0.5, -9), (1.2, 9), 0.05)
    assert told[0] == pytest.approx([0.95, 1.5], abs=1e-4) and plain[0] == pytest.approx([0.95, 1.5], abs=1e-4)


def test_tracks_take_contrast_within_a_cells_map(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(0, 1, (4, 1000))
    m[1, :300], m[:, 7], m[3, 8] = np.nan, 0.0, np.nan
    table = spark.createDataFrame([("a", "charge", k, row) for k, row in enumerate(m.tolist())], "cell_id string, leg string, cycle int, curve array<double>")
    want = np.array([r["curve"] for r in evolution.local_contrast(table).orderBy("cycle").collect()], float)
    assert np.allclose(ridges.contrast(m), want, equal_nan=True)
    plan = evolution.tracks(table)._jdf.queryExecution().toString()
    assert "posexplode" not in plan and "Join" not in plan


def test_a_ridge_steps_no_farther_than_its_window():
    m = np.full((3, 60), 0.1)
    m[0, 5], m[1, 50], m[1, 9], m[2, 12] = 9.0, 5.0, 4.0, 9.0
    assert kernels.ridge(m, 1e-3, 6).tolist() == [5, 9, 12]
    assert kernels.ridge(m, 1e-5, 59).tolist() == [5, 50, 12]


def test_peaks_are_sought_once_for_tests_and_routine_cycles(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    tests, routine = queries._tests_and_routine(spark, DATA)
    for part in (tests, routine):
        assert "MapInPandas" not in part._jdf.queryExecution().toString()


def test_breaks_ask_for_each_tail_once(monkeypatch):
    rng = np.random.default_rng(1)
    x = np.arange(84.0)
    y = 100 - 0.1 * x - 0.5 * np.maximum(0, x - 30) - np.maximum(0, x - 60) + rng.normal(0, 0.2, 84)
    asked, maximum = [0], np.maximum

    def counted(*a, **k):
        asked[0] += 1
        return maximum(*a, **k)

    monkeypatch.setattr(np, "maximum", counted)
    found, squares = kernels.break_points(x, y, 2, 10)
    assert asked[0] < 300  # two sums for each first break, not one for each pair
    assert abs(found[0] - 30) <= 2 and abs(found[1] - 60) <= 2
    assert squares == pytest.approx(min(sum(float(((part[1] - np.polyval(np.polyfit(*part, 1), part[0])) ** 2).sum()) for part in ((x[:a], y[:a]), (x[a:b], y[a:b]), (x[b:], y[b:]))) for a in range(29, 33) for b in range(58, 63)), rel=1e-6)


def test_warped_distances_of_many_pairs_are_those_of_each():
    rng = np.random.default_rng(4)
    a, b = rng.normal(0, 1, (5, 20)).cumsum(axis=1), rng.normal(0, 1, (5, 33)).cumsum(axis=1)
    a[3, 4] = np.nan
    assert np.array_equal(kernels.warped_distances(a, b), [kernels.warped_distance(x, y) for x, y in zip(a, b, strict=True)], equal_nan=True)


def test_a_spread_moves_by_the_difference_of_its_ends(spark):
    rows = [("a", b, b, s, v) for b, at in ((1, (0.02, 0.05, 0.08)), (2, (0.01, 0.05, 0.08))) for s, v in zip((80, 50, 20), at, strict=True)]
    table = spark.createDataFrame([(*r, None) for r in rows], "cell_id string, block_id int, block_start int, soc int, V_inf_rest double, relax_completeness double")
    got = dcir.ocv_blocks(table).where("block_id = 2").first()["ocv_drift_mode"]
    d80, d20 = 0.01 - 0.02, 0.08 - 0.08  # the ends move first: the difference of spreads rounds to the other side of 0.01
    wide, line = abs(d20 - d80) > 0.01, abs(d80 + d20) / 6 * 2**0.5 < 0.005
    assert (abs((0.08 - 0.01) - (0.08 - 0.02)) > 0.01) != wide
    assert got == ("spread_and_shift" if wide and line else "spread_change" if wide else "parallel_shift" if line else "local_soc50" if abs(d80 + d20) / 6 * 2 > 0.01 else "stable")


def test_time_constants_are_weighed_all_at_once(monkeypatch):
    asked, solve = [0], fits.signed_solve

    def counted(*a):
        asked[0] += 1
        return solve(*a)

    monkeypatch.setattr(fits, "signed_solve", counted)
    t = np.linspace(0, 7200, 60)
    y = 3.6 - 2e-7 * t - 0.01 * np.exp(-t / 300) - 0.02 * np.exp(-t / 2000)
    taus, x = fits.exponentials(t, y, np.stack([np.ones(60), -t / 3600], axis=1), [(1.0, 2000.0), (10.0, 5000.0)])
    assert asked[0] == 1  # one solve for the chosen pair, not one for each pair of each round
    assert np.abs(x[0] - x[1] * t / 3600 - np.exp(-t[:, None] / taus) @ x[2:] - y).max() < 1e-4


@pytest.mark.parametrize("signed", [True, False])
def test_gains_of_many_choices_are_those_of_each(signed):
    rng = np.random.default_rng(7)
    for k in (1, 2, 3):
        a, y = rng.normal(size=(40, 12, k)), rng.normal(size=(40, 12))
        a[0] = 0
        a[1] = a[1][:, :1]
        gram, moment = np.einsum("nik,nij->nkj", a, a), np.einsum("nik,ni->nk", a, y)
        each = [-fits.signed_solve(g, m, range(k) if signed else ())[1] for g, m in zip(gram, moment, strict=True)]
        assert fits.signed_gains(gram, moment, signed) == pytest.approx(each, rel=1e-9, abs=1e-12)


def test_breaks_are_sought_all_at_once(monkeypatch):
    asked, where = [0], np.where

    def counted(*a):
        asked[0] += 1
        return where(*a)

    rng = np.random.default_rng(8)
    x, y = np.arange(90.0), rng.normal(size=90).cumsum()
    monkeypatch.setattr(np, "where", counted)
    found, squares = kernels.break_points(x, y, 2, 20)
    assert asked[0] <= 10  # a few sums over all places and pairs, none for each first break
    line = lambda a, b: float(((y[a:b] - np.polyval(np.polyfit(x[a:b], y[a:b], 1), x[a:b])) ** 2).sum())
    each = {(a, b): line(0, a) + line(a, b) + line(b, 90) for a in range(20, 51) for b in range(a + 20, 71)}
    assert tuple(found) == min(each, key=each.get) and squares == pytest.approx(min(each.values()))


def test_a_forest_of_its_own_rows_reads_and_scores_them_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(parts):
        for pdf in parts:
            read.add(len(pdf))
            yield pdf

    table = spark.range(600).selectExpr("id as cell_id", "1 as cycle", "case when id % 50 > 0 then sin(id) end as a", "case when id % 100 > 0 then cast(id % 17 as double) end as b")
    counted = table.mapInPandas(seen, table.schema)
    found = {r["cell_id"]: (r["anomaly"], r["flag"]) for r in isolation.fit_predict(counted, ["a", "b"], trees=10, size=64).collect()}
    assert read.value == 600 and {f for _, f in found.values()} == {"unknown", "ok", "watch", "alert"}
    plain = isolation.predict(table, isolation.train(table, ["a", "b"], trees=10, size=64), ["cell_id", "cycle"])
    assert found == {r["cell_id"]: (r["anomaly"], r["flag"]) for r in plain.collect()}
    read.value = 0
    isolation.train(counted, ["a"], trees=3, size=16)
    assert read.value == 600


def test_groups_are_slices_of_a_batch(spark, monkeypatch):
    caught = []
    table = spark.range(1).selectExpr("id as cell_id", "id as leg", "id as row_id", "1.0D as v")
    monkeypatch.setattr(type(table), "mapInPandas", lambda df, run, schema: caught.append(run))
    curves._grouped(table, ["cell_id", "leg"], ["v"], ["row_id"], "total double, n int", lambda g: {"total": g["v"].sum(), "n": len(g["v"])})
    cells = np.repeat(np.arange(50), 4)
    whole = pd.DataFrame({"cell_id": cells, "leg": np.where(cells % 5 == 0, np.nan, 1.0), "v": np.arange(200.0)})
    cut_frames, plain = [0], pd.DataFrame.__getitem__
    slices = type(whole.iloc).__getitem__

    def counted(self, at):
        cut_frames[0] += 1
        return slices(self, at)

    monkeypatch.setattr(type(whole.iloc), "__getitem__", counted)
    batches = [plain(whole, slice(a, z)) for a, z in ((0, 3), (3, 3), (3, 10), (10, 12), (12, 200))]
    found = pd.concat(list(caught[0](iter(batches))))
    assert cut_frames[0] < 60  # a few frames a batch, none for each group
    assert found["n"].tolist() == [4] * 50 and found["total"].tolist() == [16.0 * k + 6 for k in range(50)] and found["leg"].isna().sum() == 10


def test_wide_rows_read_samples_that_were_written_once(spark, monkeypatch):
    class Seen(Exception):
        pass

    def steps(samples, order):
        raise Seen(samples.inputFiles())

    monkeypatch.setattr(wide.protocol, "steps_of", steps)
    table = spark.range(3).selectExpr("1 as cell_id", "1 as cycle", "id as row_id", "id * 1.0D as time", "'charge' as step_type", "1.0D as current", "3.5D as voltage", "id * 1.0D as capacity")
    with pytest.raises(Seen) as seen:
        wide.feature_rows(table)
    assert seen.value.args[0] and all("samples-" in f for f in seen.value.args[0])
