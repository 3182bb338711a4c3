"""Queries whose numbers come from iterative kernels, learners or whole pipelines: rows only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from starfold.config import Search
from starfold.operators import blocks, catalog, fold, gp, index, kernels, learn, vetting
from starfold.plans import pipeline
from starfold.plans.stars import FEATURE_NAMES, _flags, features
from starfold.sources.tables import kept_folder, light_curves, stars, table
from starfold.streaming.sessions import star_sessions

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _trend(method: str):
    QUERIES[f"detrend_{method}"] = lambda spark, sf: kernels.detrended(light_curves(spark, sf), method)


for _name in ("biweight", "median", "savgol", "spline", "gp"):
    _trend(_name)


@query()
def gp_scales(spark, sf):
    """The likelihood of each curve under oscillators of one to eight times the window, and which scale has the greatest."""
    def work(t, f, e):
        sigma, rho, noise = gp.settings(t, f, 3.0, None, kernels.robust(f))
        scales = np.array([1.0, 2.0, 4.0, 8.0])
        found = gp.likelihoods(t, f, rho * scales, sigma, noise)
        return {"rho": rho * scales, "log_likelihood": found, "best": found == found.max()}

    return kernels.per_star(light_curves(spark, sf), work, "rho double, log_likelihood double, best boolean", ())


_PERIODS = np.array([1.0 + 0.5 * i for i in range(8)])


_TRANSITS = ("rp_rs", "transit_count", "distinct_transit_count", "depth_mean_odd", "depth_mean_even", "odd_even_mismatch")


@query()
def bls_search(spark, sf):
    """The box search alone over the full grid, without its spectrum."""
    return _search(spark, sf, "bls")


@query()
def tls_search(spark, sf):
    """Limb-darkened dips over the periods and durations that each star's radius and mass allow."""
    return _search(spark, sf, "tls")


@query()
def lomb_scargle_search(spark, sf):
    return _search(spark, sf, "ls")


def _search(spark, sf, method: str):
    def work(t, f, e):
        found = kernels.search(t, f, method, Search.period_min, Search.period_max, radius=e["radius"], mass=e["mass"])
        return {k: found.get(k) for k in ("period", "t0", "duration", "depth", "sde", "snr", "method", "tls_fallback", *(_TRANSITS if method == "tls" else ()))} | {"n_periods": len(found["periods"])}

    none = F.lit(float("nan"))
    lc = light_curves(spark, sf).join(stars(spark, sf).select("tic_id", "radius", "mass"), "tic_id", "left").withColumns({c: F.coalesce(F.col(c), none) for c in ("radius", "mass")})
    more = ", rp_rs double, transit_count long, distinct_transit_count long, depth_mean_odd double, depth_mean_even double, odd_even_mismatch double" if method == "tls" else ""
    return kernels.per_star(lc, work, "period double, t0 double, duration double, depth double, sde double, snr double, n_periods long, method string, tls_fallback string" + more, ("radius", "mass"))


@query()
def bls_kernel(spark, sf):
    """The same periods as the relational box search, by the kernel: 40 bins, three widths."""
    def work(t, f, e):
        b = kernels.box_search(t, f, _PERIODS, np.array([0.1, 0.2, 0.4]), 40)
        return {"period": _PERIODS, **b}

    return kernels.per_star(light_curves(spark, sf), work, "period double, power double, duration double, t0 double, depth double")


@query()
def two_stage_search(spark, sf):
    """Coarse, then fine; a star of very many points is searched by several tasks."""
    return blocks.two_stage(light_curves(spark, sf), Search.period_min, Search.period_max, Search.coarse, Search.fine)


@query()
def acf_period(spark, sf):
    return kernels.per_star(light_curves(spark, sf), lambda t, f, e: kernels.acf_period(t, f, 1.0), "period double, power double")


@query()
def cdpp(spark, sf):
    return kernels.per_star(light_curves(spark, sf), lambda t, f, e: {"cdpp_ppm": kernels.cdpp(t, f, 24.0)}, "cdpp_ppm double")


@query()
def bootstrap_fap(spark, sf):
    """200 shuffles of each curve over 60 periods, uniform in frequency."""
    grid = 1 / np.linspace(1 / Search.period_max, 1 / Search.period_min, 60)
    return kernels.per_star(light_curves(spark, sf), lambda t, f, e: {"fap": kernels.false_alarm(t, f, grid, 200, e["tic_id"])}, "fap double")


_FIT = "t0 double, depth double, duration double, ingress double, t0_err double, depth_err double, duration_err double, bic_transit double, bic_flat double, delta_bic double, v_shape_metric double"


def _fits(lc):
    def work(curves):
        seeds = (np.array([e[c] for _, _, e in curves]) for c in ("period", "t0", "duration"))
        return kernels.fit_trapezoids([c[:2] for c in curves], *seeds, [None] * len(curves))

    return kernels.per_stars(lc, work, _FIT)


@query()
def trapezoid_fit(spark, sf):
    return _fits(light_curves(spark, sf))


@query()
def v_shape_fit(spark, sf):
    return _fits(light_curves(spark, sf)).select("tic_id", "v_shape_metric", F.col("ingress").alias("ingress_egress_ratio"), "error")


@query()
def mcmc_fit(spark, sf):
    """Ten parameters with errors from 32 walkers of 1,500 steps."""
    def work(curves):
        return kernels.fit_transits(curves, seeds=[42 + e["tic_id"] for _, _, e in curves])

    return kernels.per_stars(light_curves(spark, sf), work, kernels.FIT, most=24)


@query()
def posterior_triples(spark, sf):
    """Median and distances to the 16th and 84th percentile of each parameter's own samples, by Spark's percentiles: 14 walkers of 60 steps, where a survey takes 32 of 1,500."""
    def work(curves):
        return kernels.drawn_rows_of(curves, steps=60, walkers=14, seeds=[42 + e["tic_id"] for _, _, e in curves])

    rows = kernels.per_stars(light_curves(spark, sf), work, "parameter string, value double")
    return catalog.percentile_triples(rows.filter("error is null"))


@query()
def mes_measured(spark, sf):
    """Depth over the star's own combined noise of two hours, not over a constant, by the transits seen."""
    lc = light_curves(spark, sf)
    noise = kernels.per_star(lc, lambda t, f, e: {"cdpp_ppm": kernels.cdpp(t, f)}, "cdpp_ppm double").filter("error is null")
    m = vetting.relative_depth(lc).join(fold.transit_counts(lc), "tic_id").join(noise.select("tic_id", "cdpp_ppm"), "tic_id")
    return m.select("tic_id", "cdpp_ppm", vetting.multiple_event(F.col("depth"), F.when(F.col("cdpp_ppm") > 0, F.col("cdpp_ppm")), F.col("n_floor")).alias("mes"))


@query()
def fit_model_grid(spark, sf):
    """The least-squares fit as a curve of 200 phases."""
    def work(curves):
        return [kernels.model_grid(fit, 200) for fit in kernels.fit_transits(curves, posterior=False)]

    return kernels.per_stars(light_curves(spark, sf), work, "time double, flux double")


@query()
def ml_predict(spark, sf):
    """Out-of-fold, calibrated probabilities of the ten groups of ``embeddings``."""
    v = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("double").alias("y"), "embedding")
    columns = [f"x{i}" for i in range(64)]
    rows = v.select("vec_id", "y", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(columns)))
    scored = learn.calibrated(learn.out_of_fold(rows, columns, "vec_id"), "y", 10)
    return scored.select("vec_id", F.col("y").cast("int").alias("label"), *(f"cal_{c}" for c in range(10)))


@query()
def pipeline_catalog(spark, sf):
    """Search, vetting, classes, gated fit, and one catalog row per star, all under the ephemeris that the search finds."""
    return pipeline.process(light_curves(spark, sf).select("tic_id", "time", F.col("f").cast("double").alias("f")), stars(spark, sf))


@query()
def feature_importance_input(spark, sf):
    """All features with missing values filled by exact medians, as a learner takes them."""
    f = features(_flags(spark, sf))
    return learn.filled(f, list(FEATURE_NAMES), learn.medians(f, list(FEATURE_NAMES)))


@query("SELECT tic_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 43200000000 AS stop_us, count(*) AS n, sum(f)::BIGINT AS sum_f, max(f) AS max_f FROM (SELECT *, sum(far) OVER (PARTITION BY tic_id ORDER BY ts) AS seg FROM (SELECT user_id AS tic_id, ts, round(value * 100)::BIGINT AS f, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 12 HOUR)::INT, 0) AS far FROM events)) GROUP BY tic_id, seg")
def star_session_windows(spark, sf):
    """The streaming operator on a finished stream."""
    s = star_sessions(table(spark, sf, "events"))
    return s.select("tic_id", F.unix_micros("start").alias("start_us"), F.unix_micros("stop").alias("stop_us"), "n", "sum_f", "max_f")


@query()
def knn_index(spark, sf):
    """The ten nearest of every twentieth vector by a kept index of all, with the share of true neighbours it finds."""
    v = table(spark, sf, "embeddings")
    path = kept_folder(spark, "index")
    index.build(v, path)
    asked, kept = v.filter("vec_id % 20 = 0"), index.Index(spark, path)
    found = kept.nearest(asked)
    return found.join(index.recall(found, kept.nearest(asked, exact=True)), "query_id")
