import math

import numpy as np
import pytest

from starfold.operators import catalog, kernels as K
from starfold.sources import synthetic as S


def test_robust_scale_and_locations():
    assert K.robust(np.array([1, 2, 3, 4, 5.0])) == pytest.approx(1.4826)
    assert abs(K.biweights(np.array([[1.0] * 20 + [50.0]]), np.array([21]))[0] - 1) < 1e-6
    assert K.biweights(np.array([[4.0, 2.0, np.inf]]), np.array([2]))[0] == 3.0
    v = np.random.default_rng(4).normal(5, 1, 40)
    c = np.median(v)
    for _ in range(3):
        u = (v - c) / (5 * np.median(np.abs(v - c)))
        w = np.where(np.abs(u) < 1, (1 - u * u) ** 2, 0)
        c += (w * (v - c)).sum() / w.sum()
    assert K.biweights(np.concatenate((v, [np.inf] * 7))[None], np.array([40]))[0] == pytest.approx(c)


def test_box_search_agrees_with_a_plain_one():
    rng = np.random.default_rng(3)
    t = np.sort(rng.uniform(0, 20, 90))
    f = 1 + rng.normal(0, 1e-3, 90)
    err = rng.uniform(5e-4, 2e-3, 90)
    periods, bins = np.array([0.6, 1.7, 4.0, 9.9]), 50
    for error in (None, err):
        got = K.box_search(t, f, periods, bins=bins, error=error)
        w = np.ones(90) if error is None else 1 / error**2 / (1 / error**2).mean()
        mean = (w * f).sum() / 90
        for i, p in enumerate(periods):
            place = np.minimum(((t - t[0]) / p % 1 * bins).astype(int), bins - 1)
            best = (0.0, None)
            for d in K.DURATIONS[K.DURATIONS / p < 0.5]:
                for j in range(bins):
                    inside = (place - j) % bins < max(round(d / p * bins), 1)
                    r, s = w[inside].sum(), (w * (f - mean))[inside].sum()
                    if 0 < r < 90 and s < 0 and s * s / (r * (90 - r) / 90) > best[0] + 1e-15:
                        best = (s * s / (r * (90 - r) / 90), -s / r)
            assert got["power"][i] == pytest.approx(best[0]) and got["depth"][i] == pytest.approx(best[1])


def test_search_by_each_method():
    t = np.arange(0, 20, 0.02)
    f = np.where(np.abs(((t - 1) / 3.1 + 0.5) % 1 - 0.5) * 3.1 < 0.08, 0.99, 1.0) + np.random.default_rng(1).normal(0, 5e-4, len(t))
    for method in ("bls", "TLS"):
        r = K.search(t, f, method, 1.0, 8.0)
        assert abs(r["period"] / 3.1 - 1) < 0.01 and r["snr"] > 7 and len(r["periods"]) == len(r["power"]) and r["method"] == method.lower() and r["tls_fallback"] is None
    wave = 1 + 0.01 * np.sin(2 * np.pi * t / 2.5)
    assert K.search(t, wave, "ls", 0.5)["period"] == pytest.approx(2.5, rel=0.02) and K.search(t, wave, "acf", 0.5)["period"] == pytest.approx(2.5, abs=0.1)
    assert np.isnan(K.search(t[:5], f[:5], "bls")["period"])
    with pytest.raises(ValueError):
        K.search(t, f, "fft")


@pytest.mark.parametrize("method", ["biweight", "median", "savgol", "spline", "gp"])
def test_detrending_flattens_and_keeps_dips(method):
    rng = np.random.default_rng(1)
    t = np.linspace(0, 24, 3000)
    trend = 1 + 0.04 * np.sin(2 * np.pi * t / 9)
    dip = np.abs(((t - 1) / 4 + 0.5) % 1 - 0.5) * 4 < 0.09
    f = trend * np.where(dip, 0.98, 1.0) + rng.normal(0, 5e-4, len(t))
    t2, flat, _ = K.detrend(t, f, method)
    inside = np.abs(((t2 - 1) / 4 + 0.5) % 1 - 0.5) * 4 < 0.08
    assert len(t2) > (0.9 if method == "biweight" else 0.8) * len(t)
    assert flat[~inside].std() < (0.2 if method == "biweight" else 0.35) * trend.std()
    if method == "biweight":  # deeper dips than 20 deviations go as outliers where the trend follows the rest closely
        assert np.median(flat[~inside]) - np.median(flat[inside]) > 0.005


def test_savgol_is_exact_for_its_order():
    x = np.arange(50.0)
    assert np.allclose(K.savgol(3 + 2 * x - 0.1 * x**2, 11, 2), 3 + 2 * x - 0.1 * x**2)


@pytest.mark.parametrize("seed", [1, 3, 5])
def test_two_stage_search_recovers_the_period(seed):
    c = S.light_curve("eclipsing_binary", seed, 16, 8)
    r = K.two_stage(c["time"], c["flux"].astype(float) / np.median(c["flux"]), 0.8, 8.0)
    assert any(abs(r["period"] / (c["true_period"] * k) - 1) < 0.05 for k in (0.5, 1, 2))
    assert r["sde"] > 5 and r["depth"] > 0


def test_fits_recover_depth_and_duration():
    rng = np.random.default_rng(2)
    t = np.arange(0, 20, 0.01)
    f = K.trapezoid((((t - 1) / 3 + 0.5) % 1 - 0.5) * 3, 0.01, 0.2, 0.2) + rng.normal(0, 4e-4, len(t))
    x = K.fit_trapezoid(t, f, 3.0, 1.01, 0.22)
    assert x["depth"] == pytest.approx(0.01, rel=0.1) and x["duration"] == pytest.approx(0.2, rel=0.1) and x["delta_bic"] > 0
    assert 0 < x["t0_err"] < 0.05


def test_posterior_recovers_the_transit():
    rng = np.random.default_rng(2)
    t = np.arange(0, 20, 0.02)
    a = K.a_of_duration(3.0, 0.2, 0.1, 0.2)
    f = K.transit_flux(t, 3.0, 1.0, 0.1, a, 0.2, 0.4, 0.3) + rng.normal(0, 4e-4, len(t))
    p = K.fit_transit(t, f, 3.0, 1.01, 0.22, 0.01, steps=300)
    assert p["fit_method"] == "posterior" and p["rp_rs"] == pytest.approx(0.1, rel=0.1) and p["period"] == pytest.approx(3.0, abs=0.01) and p["delta_bic"] > 0 and p["snr"] > 7
    assert all(p[f"{n}_err_lo"] >= 0 and p[f"{n}_err_hi"] >= 0 for n in K.PARAMETERS) and p["depth"] == pytest.approx(p["rp_rs"] ** 2, rel=0.05) and 60 < p["inclination"] <= 90
    grid = K.model_grid(p)
    assert len(grid["time"]) == 1000 and min(grid["flux"]) < 0.993 and max(grid["flux"]) == 1.0
    fast = K.fit_transit(t, f, 3.0, 1.01, 0.22, 0.01, posterior=False)
    assert fast["fit_method"] == "trapezoid" and np.isnan(fast["period_err_lo"]) and fast["depth_err_lo"] > 0
    none = K.fit_transit(t[:5], f[:5], 3.0, 1.0, 0.2, 0.01, 9.0)
    assert none["fit_method"] == "seed_only" and none["snr"] == 9.0 and none["rp_rs"] == pytest.approx(0.1) and K.fit_transit(t, f, float("nan"), 1.0, 0.2)["warning"] == "no period"
    assert np.allclose(K.transit_flux(t, 3.0, 1.0, 0.1, a, 0.2, 0.4, 0.3, 7, 0.02), K.transit_flux(t, 3.0, 1.0, 0.1, a, 0.2, 0.4, 0.3), atol=3e-3)


def test_autocorrelation_and_false_alarms():
    t = np.arange(0, 20, 0.02)
    assert K.acf_period(t, 1 + 0.01 * np.sin(2 * np.pi * t / 2.5), 0.5)["period"] == pytest.approx(2.5, abs=0.1)
    rng = np.random.default_rng(0)
    assert K.false_alarm(t, rng.normal(1, 1e-3, len(t)), np.array([1.0, 2.0, 3.0]), 9) >= 0.1


def test_synthetic_curves_are_functions_of_their_seed():
    for kind, label in S.KINDS.items():
        a, b = S.light_curve(kind, 7), S.light_curve(kind, 7)
        assert a["label"] == label and len(a["time"]) > 1000 and np.array_equal(a["flux"], b["flux"]) and a["flux"].dtype == np.float32
        assert np.all(np.diff(a["time"]) > 0)
    with pytest.raises(ValueError):
        S.light_curve("comet", 1)


@pytest.mark.parametrize("n,want", [(60, [18, 15, 9, 9, 9]), (16, [5, 4, 3, 2, 2]), (0, [0, 0, 0, 0, 0])])
def test_population_counts(n, want):
    kinds = [k for k, _ in S.population(n)]
    assert [kinds.count(k) for k in S.KINDS] == want
    with pytest.raises(ValueError):
        S.population(3, 0, {"noise": 0.0})


def test_nearest_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(catalog, "QUERY_BLOCK", 3)
    monkeypatch.setattr(catalog, "VECTOR_BLOCK", 7)
    v = np.random.default_rng(0).normal(size=(40, 5)).round(2)
    v[11] = v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in catalog.nearest(df.filter("vec_id % 4 = 0"), df, 3).collect()}
    for i in range(0, 40, 4):
        d = ((v - v[i]) ** 2).sum(axis=1)
        assert [got[i, k] for k in (1, 2, 3)] == sorted(range(40), key=lambda j: (d[j], j))[:3]
    assert catalog.nearest(df.limit(0), df, 3).count() == 0


def test_geometry_numbers(spark):
    from pyspark.sql import functions as F

    from starfold.functions import columns as X

    lit = F.lit
    a = X.a_of_duration(lit(3.0), lit(0.12), lit(0.1), lit(0.3))
    row = spark.range(1).select(
        a.alias("a"), X.inclination_of(a, lit(0.3)).alias("i"), X.density_of(lit(3.0), a).alias("rho"), X.limb_q(lit(0.4), lit(0.3))[0].alias("q1"), X.limb_q(lit(0.4), lit(0.3))[1].alias("q2"),
        X.phase(lit(0.0), lit(2.0), lit(1.0)).alias("p0"), X.phase(lit(0.5), lit(2.0), lit(1.0)).alias("p1"), X.phase(lit(-7.5), lit(2.0), lit(1.0)).alias("p2"), catalog.gaussian_fit(lit(950.0), lit(1000), 4).alias("bic"),
    ).first()
    assert row["a"] == pytest.approx(8.44389388, rel=1e-6) and row["i"] == pytest.approx(87.96393082, rel=1e-6) and row["rho"] == pytest.approx(1265.38799, rel=1e-3)
    assert row["q1"] == pytest.approx(0.49) and row["q2"] == pytest.approx(0.28571429) and (row["p0"], row["p1"]) == (-0.5, -0.25) and -0.5 <= row["p2"] < 0.5
    assert row["bic"] == pytest.approx(950 + 4 * math.log(1000))


def test_rule_scores_of_known_cases(spark):
    from starfold.operators import classify as C, vetting as V

    schema = "tic_id long, primary_significance double, odd_even_depth_sigma double, odd_even_frac_diff double, secondary_snr double, secondary_to_primary double, secondary_depth double, crowdsap double, sweet_metric double, transit_snr double, implied_rp_rjup double, stellar_density_ratio double"
    rows = [(1, 20.0, None, None, 12.0, 0.5, None, None, None, 50.0, None, None), (2, None, None, None, None, None, None, 0.4, None, 50.0, None, None), (3, None, None, None, None, None, None, None, None, 30.0, None, None)]
    got = {r["tic_id"]: r for r in C.labelled(C.softmax(C.rule_scores(V.flags(spark.createDataFrame(rows, schema))))).collect()}
    assert got[1]["class"] == "eclipsing_binary" and got[1]["prob_transit"] == pytest.approx(0.022228, abs=1e-5)
    assert got[2]["class"] == "blend" and got[2]["prob_blend"] == pytest.approx(0.945387, abs=1e-5)
    assert got[3]["class"] == "transit" and got[3]["prob_transit"] == pytest.approx(0.475367, abs=1e-5)


def test_first_finite_of_aliases(spark):
    from starfold.functions import columns as X

    rows = spark.createDataFrame([(1, None, float("nan"), True, 3.0), (2, 5.0, 4.0, False, None)], "id long, fit_depth double, depth double, flag boolean, det_depth double")
    first = lambda names, prefixes=("",): [r["x"] for r in rows.select(X.first_finite(rows.columns, names, prefixes).alias("x")).collect()]
    assert first(("depth",), ("fit_", "", "det_")) == [3.0, 5.0] and first(("flag", "depth")) == [1.0, 0.0] and first(("none",)) == [None, None]


def test_misfit_by_the_points_inside_is_the_whole_one():
    rng = np.random.default_rng(0)
    t, f, err = np.sort(rng.uniform(0, 20, 700)), 1 + rng.normal(0, 1e-3, 700), rng.uniform(5e-4, 2e-3, 700)
    x = np.column_stack((rng.uniform(0.4, 9, 60), rng.uniform(-2, 3, 60), rng.uniform(0.01, 0.5, 60), rng.uniform(1.0, 40, 60), rng.uniform(0, 1.45, 60), rng.uniform(0, 1, 60), rng.uniform(-0.5, 0.5, 60)))
    x[:4, 3], x[:4, 4] = 1.0, 1.2  # nearer than the impact
    y = x.T[:, :, None]
    whole = (((f - K.transit_flux(t, *y)) / err) ** 2).sum(axis=1)
    assert np.allclose(K.transit_misfit(t, f, err, x), whole, rtol=1e-10)


def test_triples_are_those_of_the_samples(spark):
    t = np.arange(0, 12, 0.03)
    f = K.transit_flux(t, 3.0, 1.0, 0.1, 9.0, 0.2, 0.4, 0.3) + np.random.default_rng(1).normal(0, 4e-4, len(t))
    d = K.drawn_rows(t, f, 3.0, 1.01, 0.22, steps=80, walkers=16)
    rows = spark.createDataFrame([(7, p, v) for p, v in zip(d["parameter"], d["value"], strict=True)] + [(7, "b", None), (7, "b", float("nan"))], "tic_id long, parameter string, value double")
    fit = K.fit_transit(t, f, 3.0, 1.01, 0.22, steps=80, walkers=16)
    for r in catalog.percentile_triples(rows).collect():
        assert (r["value"], r["err_lo"], r["err_hi"]) == pytest.approx((fit[r["parameter"]], fit[f"{r['parameter']}_err_lo"], fit[f"{r['parameter']}_err_hi"])), r["parameter"]
        assert r["n"] == fit["n_samples"]


def test_ruwe_comes_through_the_cone(spark):
    targets = spark.createDataFrame([(1, 10.0, 5.0), (2, 200.0, -40.0)], "tic_id long, ra double, dec double")
    sources = spark.createDataFrame([(11, 10.001, 5.0, 9.0, 1.3), (12, 10.0, 5.002, 12.5, 4.0), (13, 200.0, -40.001, 8.0, None)], "source_id long, ra double, dec double, mag double, ruwe double")
    got = {r["tic_id"]: r for r in catalog.neighbours(catalog.cone_search(targets, sources, 0.01)).collect()}
    assert (got[1]["target_id"], got[1]["n_neighbors"], got[1]["delta_mag"], got[1]["target_ruwe"]) == (11, 1, 3.5, 1.3)
    assert (got[2]["n_neighbors"], got[2]["delta_mag"], got[2]["target_ruwe"]) == (0, None, None)


def test_savgol_of_few_points_a_window():
    rng = np.random.default_rng(5)
    for step, n in ((1.0, 12), (1.4, 5), (1.4, 6), (0.9, 40)):
        t, f = np.arange(n) * step, rng.uniform(0.9, 1.1, n)
        assert K.points(t, 3.0) == 3
        trend = K.savgol_trend(t, f, 3.0)
        assert len(trend) == n and np.isfinite(trend).all()
    t = np.arange(30) * 1.0
    assert np.allclose(K.savgol_trend(t, 1 + 0.01 * t * t, 3.0), 1 + 0.01 * t * t)  # parabolas are kept


def test_cone_in_blocks_is_the_whole_one(spark, monkeypatch):
    """Crowded poles and equator, missing magnitudes, sources at exactly the radius; cells in several blocks, and no side broadcast."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    sky = [(i, float(r), float(d), None if i % 40 == 7 else float(m)) for i, (r, d, m) in enumerate(zip(rng.uniform(0, 360, 900), np.concatenate([rng.uniform(86, 90, 300), rng.uniform(-2, 2, 300), rng.uniform(-90, 90, 300)]), rng.integers(6, 12, 900), strict=True))]
    sky += [(900, 10.0, 0.0, 5.0), (901, 10.0, 3.0, 5.5), (902, 13.0, 0.0, 5.0)]
    sources = spark.createDataFrame(sky, "source_id long, ra double, dec double, mag double")
    targets = sources.filter("source_id % 3 = 0").withColumnRenamed("source_id", "tic_id")
    monkeypatch.setattr(catalog, "TARGET_BLOCK", 16)
    monkeypatch.setattr(catalog, "SOURCE_BLOCK", 32)
    cone = catalog.cone_search(targets, sources, 3.0)
    assert "Broadcast" not in cone._jdf.queryExecution().executedPlan().toString()
    ra, dec = np.radians([r[1] for r in sky]), np.radians([r[2] for r in sky])
    pairs = set()
    for i in range(0, len(sky), 3):
        h = np.sin((dec - dec[i]) / 2) ** 2 + np.cos(dec[i]) * np.cos(dec) * np.sin((ra - ra[i]) / 2) ** 2
        pairs |= {(i, int(j)) for j in np.flatnonzero(np.degrees(2 * np.arcsin(np.minimum(np.sqrt(h), 1))) <= 3.0)}
    rows = cone.collect()
    assert len(rows) == len(pairs) and {(r["tic_id"], r["source_id"]) for r in rows} == pairs
    want = {tuple(r) for r in catalog.neighbours(cone).collect()}
    assert {tuple(r) for r in catalog.cone_neighbours(targets, sources, 3.0).collect()} == want and len(want) == len(range(0, len(sky), 3))
    got = catalog.cone_neighbours(targets, sources.withColumn("ruwe", F.col("source_id") / 2.0), 3.0).collect()
    assert got and all(r["target_ruwe"] == r["target_id"] / 2 for r in got)


def test_nearest_by_candidates_are_the_plain_ones():
    """Equal distances, long vectors, queries among the vectors, NaN: rows are those of all exact distances, of which few are told."""
    import pyarrow as pa

    rng = np.random.default_rng(7)
    v = np.concatenate([rng.normal(size=(400, 8)), rng.integers(-2, 3, (400, 8)), 1e6 + rng.normal(size=(100, 8))]).astype(float)
    for rows in (v, np.concatenate([v, np.full((1, 8), np.nan)]), v[:3]):
        ids, asks = np.arange(2 * len(rows)) % len(rows), np.arange(2 * len(rows)) < len(rows)
        m = np.concatenate([rows, rows])
        table = pa.table({"id": ids, "asks": asks, "v": pa.array(m.tolist(), pa.list_(pa.float64()))})
        got = catalog.meeting(5, False)(table)
        want = []
        for q in range(len(rows)):
            d2 = ((rows - rows[q]) ** 2).sum(axis=1)
            want += [(q, int(j), float(d2[j])) for j in np.argsort(d2, kind="stable")[:5]]
        found = list(zip(*(got.column(c).to_pylist() for c in ("query_id", "vec_id", "d2")), strict=True))
        assert repr(found) == repr(want)
    assert max(len(some) for _, some in catalog.candidates(v[:400], np.arange(400), v[:400], 5)) < 20


def test_powers_of_shuffled_curves_are_those_of_the_box_search():
    """One fold serves all shuffles of a curve: the search itself runs once, and every digit stays."""
    rng = np.random.default_rng(11)
    for n in (12, 67, 400):
        t, f = np.sort(rng.uniform(0, 30, n)), 1 + rng.normal(0, 1e-2, n)
        grid = 1 / np.linspace(1 / 13.0, 1 / 0.5, 60)
        many = np.array([f, *(rng.permutation(f) for _ in range(9))])
        want = np.array([K.box_search(t, g, grid)["power"] for g in many])
        assert (K.box_powers(t, many, grid) == want).all()
    calls, search = [], K.box_search
    K.box_search = lambda *a, **b: calls.append(1) or search(*a, **b)
    try:
        fap = K.false_alarm(t, f, grid, 20, 3)
    finally:
        K.box_search = search
    draw = np.random.default_rng(3)
    top = K.sde(search(t, f, grid)["power"])
    assert len(calls) == 1 and fap == (sum(K.sde(search(t, draw.permutation(f), grid)["power"]) >= top for _ in range(20)) + 1) / 21


def _curves(m):
    rng = np.random.default_rng(17)
    out = []
    for i in range(m):
        t = np.sort(rng.uniform(0, 30, 40 + 3 * i))
        out.append((t, K.transit_flux(t, 3.0, 1.0, 0.1 + 0.02 * i, 9.0, 0.2, 0.4, 0.3) + rng.normal(0, 1e-3, len(t)), {"period": 3.0, "t0": 1.01, "duration": 0.3, "tic_id": i}))
    return out


def _alike(a, b):
    assert a.keys() == b.keys()
    for k, v in a.items():
        assert b[k] == v if isinstance(v, str | None) else b[k] == pytest.approx(v, rel=1e-7, abs=1e-12, nan_ok=True), k


def test_curves_fitted_together_are_those_fitted_alone():
    """Curves of different lengths, one that can't be fitted among them; the passes over points are as many as for one curve."""
    curves = _curves(6)
    curves.insert(2, (curves[0][0][:5], curves[0][1][:5], curves[0][2]))
    for posterior in (False, True):
        together = K.fit_transits(curves, posterior, 40, 16, [42 + i for i in range(7)])
        for i, ((t, f, e), got) in enumerate(zip(curves, together, strict=True)):
            _alike(K.fit_transit(t, f, e["period"], e["t0"], e["duration"], posterior=posterior, steps=40, walkers=16, seed=42 + i), got)
    assert together[2]["fit_method"] == "seed_only" and together[3]["fit_method"] == "posterior"
    passes, whole = [], K.transit_misfits
    K.transit_misfits = lambda *a: passes.append(1) or whole(*a)
    try:
        K.drawn_rows_of(curves[3:], 20, 14, [1, 2, 3, 4])
    finally:
        K.transit_misfits = whole
    assert len(passes) <= 1 + 2 * 20


def test_bundles_of_stars_give_a_row_each(spark):
    """Stars in bundles, one alone that is larger than a bundle, one without an id, one that fails: others keep their rows."""
    rows = [(i, float(k), 5.0 + k % 3) for i, n in ((1, 20), (2, 31), (3, 9), (4, K.BUNDLE + 1), (None, 4)) for k in range(n)]
    lc = spark.createDataFrame(rows, "tic_id long, time double, f double").repartition(3)

    def work(curves):
        if any(e["tic_id"] == 3 for *_, e in curves):
            raise ValueError("three")
        return [{"n": len(t), "m": len(curves), "ordered": bool((np.diff(t) > 0).all())} for t, _, e in curves]

    got = {r["tic_id"]: r for r in K.per_stars(lc, work, "n long, m long, ordered boolean", ()).collect()}
    assert {k: r["n"] for k, r in got.items()} == {1: 20, 2: 31, 3: None, 4: K.BUNDLE + 1, None: 4}
    assert got[3]["error"] == "ValueError: three" and got[4]["m"] == 1 and all(r["ordered"] and r["error"] is None for k, r in got.items() if k != 3)
    several = K.per_stars(lc.filter("tic_id < 3").coalesce(1), lambda c: [{"m": len(c)} for _ in c], "m long", ()).collect()
    assert sorted(r["tic_id"] for r in several) == [1, 2]


def _plain_powers(t, fluxes, periods, durations=K.DURATIONS, bins=200):
    """All starts of all widths, period by period."""
    m, n = fluxes.shape
    centred = fluxes - fluxes.mean(axis=1)[:, None]
    counts, rows, out = np.arange(n + 1), np.arange(m), np.zeros((m, len(periods)))
    scale = 1 / np.sqrt(np.maximum(counts * (n - counts), 1).astype(float)) * ((counts > 0) & (counts < n))
    for x, p in enumerate(periods):
        place = K.fold_places(t - t[0], float(t[-1] - t[0]), periods[x : x + 1], bins)[0]
        w, s = np.bincount(place, minlength=bins), np.bincount((place + rows[:, None] * bins).reshape(-1), centred.reshape(-1), m * bins).reshape(m, bins)
        cw, cs = np.concatenate(([0], np.cumsum(np.tile(w, 2)))), np.concatenate((np.zeros((m, 1)), np.cumsum(np.tile(s, 2), axis=1)), axis=1)
        for k in {max(int(np.rint(d / p * bins)), 1) for d in durations if d / p < 0.5}:
            q = cs[:, k : k + bins] - cs[:, :bins]
            ratio = scale[cw[k : k + bins] - cw[:bins]] * q
            j = np.argmin(ratio, axis=1)
            out[:, x] = np.maximum(out[:, x], np.where(q[rows, j] < -1e-9 * np.abs(centred).sum(axis=1), ratio[rows, j], 0.0) ** 2 * n)
    return out


def test_powers_of_many_curves_take_a_box_once_for_each_of_its_contents():
    import time

    rng = np.random.default_rng(4)
    grid = 1 / np.linspace(1 / 15, 2, 60)
    for n, f in ((70, rng.normal(1, 0.1, 70)), (400, rng.normal(1, 0.1, 400)), (50, np.ones(50)), (40, np.where(np.arange(40) % 7 == 0, 0.5, 1.0))):
        t, many = np.sort(rng.uniform(0, 30, n)), np.array([rng.permutation(f) for _ in range(200)])
        assert (K.box_powers(t, many, grid) == _plain_powers(t, many, grid)).all()

    def cpu(work):
        began = time.process_time()
        work()
        return time.process_time() - began

    t, f = np.sort(rng.uniform(0, 30, 70)), rng.normal(1, 0.1, 70)
    many = np.array([rng.permutation(f) for _ in range(200)])
    plain = min(cpu(lambda: (_plain_powers(t, many, grid), K.box_search(t, f, grid), [K.sde(p) for p in many])) for _ in range(4))
    assert min(cpu(lambda: K.false_alarm(t, f, grid, 200, 1)) for _ in range(4)) < 0.75 * plain


def test_moves_are_drawn_at_once_and_are_those_drawn_step_by_step(monkeypatch):
    asked = []

    class Counted:
        def __init__(self, seed, make=np.random.default_rng):
            self.rng = make(seed)

        def __getattr__(self, name):
            if name != "bit_generator":
                asked.append(name)
            return getattr(self.rng, name)

    def plain(seeds, steps, k):
        lots = []
        for rng in map(np.random.default_rng, seeds):
            lots.append([[(rng.random(k), rng.integers(0, k, k), rng.random(k)) for _ in (0, 1)] for _ in range(steps)])
        return lots

    for k, dims in ((16, 7), (7, 7), (2, 3)):
        rngs = [np.random.default_rng(s) for s in (5, 6, 7)]
        got = [K.moves(rngs, steps, [k, k], dims) for steps in (4, 3)]
        for i, lot in enumerate(plain((5, 6, 7), 7, k)):
            for step, halves in enumerate(lot):
                for half, (z, mates, luck) in enumerate(halves):
                    stretch, mate, edge = (v[step - 4 * (step >= 4)] for v in got[step >= 4][half])
                    assert (stretch[i] == (1 + z) ** 2 / 2).all() and (mate[i] == mates).all()
                    assert np.allclose(edge[:, i], (np.log(luck), (dims - 1) * np.log((1 + z) ** 2 / 2)), rtol=1e-14, atol=0)

    monkeypatch.setattr(np.random, "default_rng", Counted)
    start = np.random.Generator(np.random.PCG64(1)).normal(size=(2, 32, 3))
    K.sample(lambda x, own: -0.5 * (x * x).sum(axis=1), start, 300, [1, 2])
    assert len(asked) < 300
