import numpy as np
import pytest

from starfold.operators import blocks, gp, kernels as K, search, tls


def dipping(seed, period, depth, width, noise, days=27.0, step=0.02):
    rng = np.random.default_rng(seed)
    t = np.arange(0, days, step)
    k = float(np.sqrt(depth))
    model = K.transit_flux(t, period, 1.0 + rng.uniform(0, 1), k, K.a_of_duration(period, width, k, 0.2), 0.2, *K.LIMB)
    return t, model + rng.normal(0, noise, len(t))


def dense(t, y, noise, sigma, rho):
    c = np.sqrt(2) * np.pi / rho
    d = np.abs(t[:, None] - t)
    kernel = sigma**2 * np.exp(-c * d) * (np.cos(c * d) + np.sin(c * d))
    whole = kernel + np.diag(np.broadcast_to(noise, len(t)) ** 2)
    return kernel @ np.linalg.solve(whole, y), -0.5 * (y @ np.linalg.solve(whole, y) + np.linalg.slogdet(whole)[1] + len(t) * np.log(2 * np.pi))


@pytest.mark.parametrize("noise", [0.2, "each"])
def test_gaussian_process_is_the_dense_one(noise):
    rng = np.random.default_rng(0)
    t = np.sort(np.concatenate((rng.uniform(0, 20, 280), rng.uniform(5, 5.01, 20))))
    t[7] = t[6]  # a repeated time
    y = rng.normal(0, 1, 300)
    noise = rng.uniform(0.1, 0.5, 300) if noise == "each" else noise
    for rho in (0.1, 0.9, 30.0):
        mean, likelihood = gp.solve(t, y, noise, 1.3, rho)
        want, other = dense(t, y, noise, 1.3, rho)
        assert np.abs(mean - want).max() < 1e-8 and likelihood == pytest.approx(other, abs=1e-6)


def test_likelihood_finds_the_scale():
    rng = np.random.default_rng(4)
    t = np.sort(rng.uniform(0, 60, 400))
    c = np.sqrt(2) * np.pi / 4.0
    d = np.abs(t[:, None] - t)
    y = np.linalg.cholesky(np.exp(-c * d) * (np.cos(c * d) + np.sin(c * d)) + 1e-4 * np.eye(400)) @ rng.normal(size=400)
    rhos = np.array([0.5, 1.0, 2.0, 4.0, 8.0, 16.0])
    assert rhos[gp.likelihoods(t, y, rhos, 1.0, 0.01).argmax()] == 4.0


def test_gaussian_process_takes_stand_ins_where_it_can_not_run():
    t = np.arange(6.0)
    assert np.array_equal(K.gp_trend(t, t + 1, 3.0), K.biweight_trend(t, t + 1, 3.0))
    flat = K.gp_trend(np.arange(50.0), np.ones(50), 3.0)
    assert np.allclose(flat, 1)
    t = np.linspace(0, 10, 500)
    noisy = 1 + 0.01 * np.sin(t) + np.random.default_rng(0).normal(0, 1e-3, 500)
    loose, tight = K.gp_trend(t, noisy, 1.0, np.full(500, 0.1)), K.gp_trend(t, noisy, 1.0, np.full(500, 1e-5))
    assert np.abs(tight - noisy).max() < 1e-4 < np.abs(loose - noisy).max()


def test_template_fit_agrees_with_a_plain_one():
    rng = np.random.default_rng(2)
    t = np.sort(rng.uniform(0, 20, 300))
    dip = np.where(np.abs(((t - 1) / 3.3 + 0.5) % 1 - 0.5) * 3.3 < 0.08, 0.01, 0.0) + rng.normal(0, 1e-3, 300)
    weight = rng.uniform(0.5, 1.5, 300)
    grid = np.array([1.7, 3.3, 9.1])
    got = tls.fitted(t, dip, weight, grid, 1.0, 1.0)
    for i, p in enumerate(grid):
        share = float(tls.transit_share(p, 1.0, 1.0))
        size = int(np.clip(2 ** np.ceil(np.log2(tls.WITHIN / (tls.SHORT * share))), tls.FEWEST, tls.MOST))
        place = np.floor((t - t[0]) / p % 1 * size).astype(int)
        best = 0.0
        for w in sorted({round(tls.WITHIN * tls.STEP**k) for k in range(60)}):
            if w > tls.LONG * share * size or w < tls.SHORT * share * size * 0.999 or w > tls.LONGEST * size:
                continue
            q = tls.profile(w)
            for j in range(size):
                at = (place - j) % size
                inside = at < w
                top, below = (weight * dip)[inside] @ q[at[inside]], weight[inside] @ q[at[inside]] ** 2
                if top > 0 and below > 1e-6 * weight.mean():
                    best = max(best, top * top / below)
        assert got["gain"][i] == pytest.approx(best)
    assert got["gain"].argmax() == 1 and got["depth"][1] == pytest.approx(0.01, rel=0.15)


def test_template_search_finds_shallow_dips_that_the_box_misses():
    """Short, shallow dips of small stars: bins that follow the star's own durations find those that 200 bins smear."""
    hits = {"tls": 0, "bls": 0}
    for seed in range(12):
        period = 6.0 + 0.37 * seed
        t, f = dipping(seed, period, 1.1e-3, 0.035, 1e-3, step=0.005)
        for method in hits:
            found = K.search(t, f, method, 0.5, 13.0, radius=0.2, mass=0.2)["period"]
            hits[method] += min(abs(found / (period * k) - 1) for k in (0.5, 1, 2)) < 0.01
    assert hits["tls"] >= 9 and hits["tls"] >= hits["bls"] + 3, hits


def test_template_search_measures_the_transit():
    t, f = dipping(3, 4.2, 0.004, 0.14, 4e-4)
    r = K.search(t, f, "tls", 0.5, 13.0)
    assert r["period"] == pytest.approx(4.2, rel=2e-3) and r["duration"] == pytest.approx(0.14, rel=0.25) and r["depth"] == pytest.approx(0.0047, rel=0.2) and r["rp_rs"] == pytest.approx(np.sqrt(0.004), rel=0.1)
    assert r["transit_count"] == len(r["transit_times"]) and r["distinct_transit_count"] in (6, 7) and r["odd_even_mismatch"] < 4 and r["sde"] > 7
    flat = K.search(t, np.ones(len(t)), "tls", 0.5, 13.0)
    assert np.isnan(flat["sde"]) and flat["depth"] == 0


def test_periods_follow_the_star():
    few, many = (len(tls.periods(27.0, 0.5, 13.0, r)) for r in (3.0, 0.3))
    grid = tls.periods(27.0, 0.5, 13.0)
    assert few < len(grid) < many and grid[0] == pytest.approx(0.5) and grid[-1] == pytest.approx(13.0) and np.all(np.diff(grid) > 0)


def test_fixed_point_folds_are_those_of_floats():
    rng = np.random.default_rng(1)
    dt = np.sort(rng.uniform(0, 27, 500))
    dt[0] = 0
    periods = rng.uniform(0.4, 20, 50)
    got = K.fold_places(dt, 27.0, periods, 200) - 200 * np.arange(50)[:, None]
    want = np.floor(dt / periods[:, None] % 1 * 200)
    assert (got != want).sum() <= 2
    even = np.arange(0, 20, 0.25)  # all of them on the edges of bins
    assert np.array_equal(K.fold_places(even, 19.75, np.array([2.5]), 10)[0], np.rint(even / 0.25).astype(int) % 10)


def test_blocks_of_periods_find_what_one_task_finds(spark, monkeypatch):
    rows = []
    for star in range(4):
        t, f = dipping(star, 2.0 + star, 0.003, 0.15, 5e-4, days=14.0 + star, step=0.03)
        rows += [(star, float(a), float(b), 5e-4 * (1 + (i + star) % 3)) for i, (a, b) in enumerate(zip(t, f, strict=True)) if star < 3 or i < 90]
    rows.append((9, 1.0, 1.0, 1e-3))
    lc = spark.createDataFrame(rows, "tic_id long, time double, f double, err double")
    for frame in (lc, lc.drop("err")):
        alone = {r["tic_id"]: r for r in blocks.two_stage(frame, 0.6, 6.0).collect()}
        with monkeypatch.context() as m:
            m.setattr(blocks, "WORK", 60_000)
            m.setattr(blocks, "MOST", 7)
            parts = {r["tic_id"]: r for r in blocks.two_stage(frame, 0.6, 6.0).collect()}
        assert set(alone) == set(parts) == {0, 1, 2, 3, 9} and alone[9]["error"] and parts[9]["error"]
        for star in range(4):
            for c in ("period", "t0", "duration", "depth", "sde", "snr", "n_periods"):
                assert parts[star][c] == pytest.approx(alone[star][c], rel=1e-12), (star, c)


def test_grid_size_is_that_of_the_grid(spark):
    from pyspark.sql import functions as F

    for base, low, high, over in ((27.3, 0.5, 13.0, 2.0), (80.0, 2.85, 3.15, 5.0), (1.0, 0.5, 0.55, 2.0)):
        n = spark.range(1).select(blocks.n_periods(F.lit(base), F.lit(low), F.lit(high), over).alias("n")).first()["n"]
        assert n == len(K.frequencies(base, low, high, float(K.DURATIONS[0]), over))


def test_partitions_of_the_box_search_grow_with_the_points(spark):
    """A task holds all bins and boxes of its stars, so more points mean more partitions, not larger ones; adaptive execution does not join them."""
    lc = spark.range(6000).selectExpr("id % 600 as tic_id", "cast(id div 600 as double) as time", "id % 7 as f")
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    for points, want in ((1 << 15, least), (100, 60)):
        dealt = search.by_star(lc, points)
        assert dealt.rdd.getNumPartitions() == want
        hist = search.histogram(dealt, search.fixed_periods(8), 40)
        plan = hist._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and hist.agg({"n": "sum"}).first()[0] == 8 * 6000


def test_short_curves_find_what_long_ones_do_by_the_screened_search(monkeypatch):
    """Random, flat, spiky and tiny curves, sorted and unsorted periods: every number to the last digit."""
    rng = np.random.default_rng(5)
    t = np.sort(rng.uniform(0, 27, 71))
    noise = rng.normal(1, 0.01, 71)
    spiky = np.where(np.arange(71) == 9, 50.0, 1 + 1e-7 * noise)
    grid = K.frequencies(27.0, 0.5, 13.0, 0.3, 2.0)
    cases = [(t, f, p, b) for f in (noise, np.ones(71), spiky, np.round(noise, 2), noise * 1e-30) for p in (grid, rng.permutation(grid)[:400]) for b in (200, 41)]
    cases += [(t[:n], noise[:n], grid, 200) for n in (2, 3, 10)] + [(t, np.where(np.arange(71) == 3, np.nan, noise), grid, 200), (np.sort(rng.uniform(0, 27, 900)), rng.normal(1, 0.01, 900), grid[:300], 200)]
    used = []
    monkeypatch.setattr(K, "box_search_short", lambda *a, f=K.box_search_short: used.append(1) or f(*a))
    short = [K.box_search(t, f, p, bins=b) for t, f, p, b in cases]
    assert len(used) == len(cases)
    monkeypatch.setattr(K, "SHORT", 0)
    for got, (t, f, p, b) in zip(short, cases, strict=True):
        want = K.box_search(t, f, p, bins=b)
        assert len(used) == len(cases) and all(np.array_equal(got[k], want[k]) for k in want), (len(t), len(p), b)


def test_screened_and_long_searches_of_sparse_periods_agree(monkeypatch):
    """Periods far apart are searched in double at once; screened, they have the same numbers to the last digit."""
    rng = np.random.default_rng(6)
    t, dense = np.sort(rng.uniform(0, 27, 71)), K.frequencies(27.0, 0.5, 13.0, 0.04, 3.0)
    sparse = 1 / np.linspace(1 / 13, 2, 60)
    assert K.evenly(dense, K.DURATIONS, 200, 360) and not K.evenly(sparse, K.DURATIONS, 200, 360)
    noise = rng.normal(1, 0.01, 71)
    cases = [(f, p, b) for f in (noise, np.ones(71), np.where(np.arange(71) == 9, 50.0, 1 + 1e-7 * noise), np.round(noise, 2)) for p in (sparse, K.frequencies(27.0, 0.5, 13.0, 0.3, 2.0), rng.permutation(dense)[:400], dense[:3000]) for b in (200, 41)]
    chosen = [K.box_search(t, f, p, bins=b) for f, p, b in cases]
    monkeypatch.setattr(K, "evenly", lambda *a: True)
    for got, (f, p, b) in zip(chosen, cases, strict=True):
        screened, long = K.box_search_short(t, f, p, K.DURATIONS, b), K.box_search_long(t, f, p, K.DURATIONS, b, None)
        assert all(np.array_equal(got[k], screened[k]) and np.array_equal(got[k], long[k]) for k in long), (len(p), b)


def _plain_dips(t, dip, weight, grid):
    """``tls.fitted`` of the sun's radius and mass, a whole array for each step."""
    best, share = {k: np.zeros(len(grid)) for k in ("gain", "duration", "t0", "depth")}, tls.transit_share(grid, 1.0, 1.0)
    bins = np.clip(2 ** np.ceil(np.log2(tls.WITHIN / (tls.SHORT * share))), tls.FEWEST, tls.MOST).astype(int)
    for size in np.unique(bins).tolist():
        at = np.flatnonzero(bins == size)
        widths = np.unique(np.rint(tls.WITHIN * tls.STEP ** np.arange(np.log(tls.LONGEST * size / tls.WITHIN) / np.log(tls.STEP) + 1)).astype(int))
        place = K.fold_places(t - t[0], float(t[-1] - t[0]), grid[at], size).reshape(-1)
        fh, fl = (np.fft.rfft(np.bincount(place, np.tile(v, len(at)), len(at) * size).reshape(-1, size)) for v in (weight, weight * dip))
        for w in widths[widths <= max(tls.LONGEST * size, tls.WITHIN)].tolist():
            q = np.concatenate((tls.profile(w), np.zeros(size - w)))
            ok = np.flatnonzero((w >= tls.SHORT * share[at] * size * 0.999) & ((w <= tls.LONG * share[at] * size) | (w == widths[0])))
            if len(ok):
                top, below = np.fft.irfft(fl[ok] * np.conj(np.fft.rfft(q)), size), np.fft.irfft(fh[ok] * np.conj(np.fft.rfft(q * q)), size)
                gain = np.where((top > 0) & (below > 1e-6 * weight.mean()), top, 0.0) ** 2 / np.maximum(below, 1e-300)
                j = gain.argmax(axis=1)
                rows = np.flatnonzero(gain.max(axis=1) > best["gain"][at[ok]])
                to, j = at[ok[rows]], j[rows]
                best["gain"][to], best["duration"][to], best["t0"][to], best["depth"][to] = gain[rows, j], w / size * grid[to], t[0] + ((j + w / 2) / size % 1.0) * grid[to], top[rows, j] / below[rows, j]
    return best


def test_dips_are_fitted_in_reused_rooms_to_the_last_digit():
    import tracemalloc

    rng = np.random.default_rng(8)
    for n, f, weight in ((70, rng.normal(1, 0.1, 70), np.ones(70)), (300, rng.normal(1, 0.1, 300), rng.uniform(0.5, 2, 300)), (40, np.ones(40), np.ones(40))):
        t = np.sort(rng.uniform(0, 27, n))
        grid = tls.periods(float(t[-1] - t[0]), 0.5, 13.0)
        want = _plain_dips(t, 1 - f, weight, grid)
        tracemalloc.start()
        got = tls.fitted(t, 1 - f, weight, grid, 1.0, 1.0)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert all(np.array_equal(want[k], got[k]) for k in want), n
        assert most < 8 << 20, (n, most)
