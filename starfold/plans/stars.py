"""Queries per star: significance, vetting, geometry, classes, catalog and joins."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from starfold.functions import columns as X
from starfold.operators import catalog, classify, clean, fold, learn, vetting
from starfold.plans.curves import COUNT_SQL, DEPTH_SQL, FOLD_SQL, FOLDED_SQL, SECOND_SQL
from starfold.sources.tables import LC_SQL, STARS_SQL, light_curves, saved, stars, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


SNR_SQL = COUNT_SQL + FOLDED_SQL + """, cad AS (SELECT tic_id, median(step)::DOUBLE AS cadence_us FROM (SELECT tic_id, us - lag(us) OVER (PARTITION BY tic_id ORDER BY us) AS step FROM lc) GROUP BY tic_id),
om AS (SELECT tic_id, f, dt, duration, median(f) FILTER (abs(dt) > duration / 2) OVER (PARTITION BY tic_id) AS om FROM fo), sg0 AS (SELECT tic_id, median(abs(f - om)) FILTER (abs(dt) > duration / 2) * 1.4826::DOUBLE AS sigma, count(*) AS n, max(duration) AS duration FROM om GROUP BY tic_id),
snr AS (SELECT tic_id, CASE WHEN n >= 5 AND sigma > 0 THEN depth / (sigma / sqrt(greatest(duration / (cadence_us / 86400000000.0::DOUBLE) * n_even, 1.0::DOUBLE))) END AS snr FROM sg0 JOIN fd USING (tic_id) JOIN tc USING (tic_id) JOIN cad USING (tic_id))"""
SWEET_SQL = """, sw0 AS (SELECT tic_id, f - (sum(f) OVER (PARTITION BY tic_id))::BIGINT / count(*) OVER (PARTITION BY tic_id) AS y, sin(2 * pi() * time / period) AS s, cos(2 * pi() * time / period) AS c FROM lc),
sw1 AS (SELECT tic_id, count(*) AS n, sum(s) AS s, sum(c) AS c, sum(s * s) AS ss, sum(c * c) AS cc, sum(s * c) AS sc, sum(y * s) AS ys, sum(y * c) AS yc, sum(y * y) AS yy FROM sw0 GROUP BY tic_id),
sw2 AS (SELECT tic_id, n, yy, ys, yc, ss - s * s / n AS a, cc - c * c / n AS b, sc - s * c / n AS d FROM sw1),
swe AS (SELECT tic_id, CASE WHEN n >= 8 AND yy > 0 THEN greatest(0.0::DOUBLE, least((ys * ys * b - 2 * ys * yc * d + yc * yc * a) / (a * b - d * d) / yy, 1.0::DOUBLE)) END AS sweet_metric FROM sw2)"""
_PI = repr(math.pi)
METRIC_SQL = (
    DEPTH_SQL + SECOND_SQL + SNR_SQL + SWEET_SQL + "," + STARS_SQL + f""",
mad AS (SELECT tic_id, max(med)::DOUBLE AS med, median(abs(f - med)) * 1.4826::DOUBLE AS scale FROM (SELECT tic_id, f, median(f) OVER (PARTITION BY tic_id) AS med FROM lc) GROUP BY tic_id),
j AS (SELECT d.*, med, scale, scale / med AS err, all_depth / med AS depth, odd_depth / med AS od, even_depth / med AS ed, secondary_depth / med AS sd, secondary_phase, sec.n AS n_secondary, snr, n_floor, sweet_metric, crowdsap, radius, mass, tmag, 1.0::DOUBLE + 0.5::DOUBLE * (d.tic_id % 7) AS period
  FROM dep d JOIN mad USING (tic_id) LEFT JOIN sec USING (tic_id) JOIN snr USING (tic_id) JOIN tc USING (tic_id) JOIN swe USING (tic_id) LEFT JOIN stars USING (tic_id)),
k AS (SELECT *, CASE WHEN depth > 0 THEN sqrt(least(depth, 1.0::DOUBLE)) END AS k FROM j),
r AS (SELECT *, CASE WHEN depth > 0 THEN sqrt(depth) * radius * {X.RSUN_RJUP!r}::DOUBLE END AS rp, sqrt(greatest((1 + k) * (1 + k) - 0.3::DOUBLE * 0.3::DOUBLE, 0.0::DOUBLE)) / sin({_PI}::DOUBLE * 0.3::DOUBLE / period) AS a FROM k),
mt AS (SELECT tic_id, crowdsap, radius, mass, tmag, round(depth, 6) AS depth, round(od, 6) AS odd_depth, round(ed, 6) AS even_depth, round(abs(od - ed) / (err * sqrt(1.0::DOUBLE / nullif(odd_in, 0) + 1.0::DOUBLE / nullif(even_in, 0))), 6) AS odd_even_depth_sigma,
  round(abs(od - ed) / nullif(abs(depth), 0), 6) AS odd_even_frac_diff, round(sd, 6) AS secondary_depth, round(sd / (err / sqrt(n_secondary::DOUBLE)), 6) AS secondary_snr, round(secondary_phase, 6) AS secondary_phase, round(sd / CASE WHEN depth > 0 THEN depth END, 6) AS secondary_to_primary,
  round(sweet_metric, 6) AS sweet_metric, n_floor::DOUBLE AS n_transits, round(rp, 6) AS implied_rp_rjup,
  round(3 * {_PI}::DOUBLE / ({X.GRAVITY!r}::DOUBLE * (period * 86400.0::DOUBLE) * (period * 86400.0::DOUBLE)) * a * a * a / (mass / (radius * radius * radius) * 1408.0::DOUBLE), 6) AS stellar_density_ratio, round(snr, 6) AS transit_snr,
  round(greatest(sd / (err / sqrt(n_secondary::DOUBLE)), CASE WHEN sd IS NULL THEN 0.0::DOUBLE ELSE 0.0::DOUBLE END) / CASE WHEN snr > 0 THEN snr END, 6) AS uniqueness, round(abs(depth) / (err / sqrt(all_in::DOUBLE)), 6) AS primary_significance, round(err, 6) AS flux_mad FROM r)"""
)
_OK = "(primary_significance IS NULL OR primary_significance >= 10)"
FLAG_SQL = METRIC_SQL + f""", fl AS (SELECT *, coalesce(odd_even_depth_sigma > 5 AND odd_even_frac_diff > 0.10 AND {_OK}, false) AS eb_odd_even, coalesce(secondary_snr > 5 AND secondary_to_primary > 0.15 AND secondary_to_primary < 0.95 AND {_OK}, false) AS eb_secondary, false AS eb_vshape,
  coalesce(crowdsap < 0.9, false) AS blend_contamination, coalesce(sweet_metric > 0.5, false) AS other_variability, coalesce(transit_snr < 7.1, false) AS low_snr, coalesce(implied_rp_rjup > 2, false) AS implied_radius_too_big, coalesce(stellar_density_ratio < 0.2 OR stellar_density_ratio > 5, false) AS density_inconsistent FROM mt)"""


def _metrics(spark, sf):
    return vetting.metrics(light_curves(spark, sf), stars(spark, sf))


def _flags(spark, sf):
    return vetting.flags(_metrics(spark, sf))


@query(FOLD_SQL + SNR_SQL + " SELECT tic_id, round(snr, 6) AS snr FROM snr")
def transit_snr(spark, sf):
    return vetting.transit_snr(light_curves(spark, sf)).select("tic_id", F.round("snr", 6).alias("snr"))


@query(DEPTH_SQL + COUNT_SQL + ", md AS (SELECT tic_id, median(f) AS med FROM lc GROUP BY tic_id) SELECT tic_id, round(all_depth / med / (50.0::DOUBLE * 1e-6) * sqrt(greatest(n_floor, 1)::DOUBLE), 6) AS mes FROM dep JOIN tc USING (tic_id) JOIN md USING (tic_id)")
def mes(spark, sf):
    """Of the depth relative to the star's median, at a noise of 50 millionths."""
    lc = light_curves(spark, sf)
    found = fold.window_depths(lc).join(fold.transit_counts(lc), "tic_id").join(lc.groupBy("tic_id").agg(F.median("f").alias("med")), "tic_id")
    return found.select("tic_id", F.round(vetting.multiple_event(X.ratio(F.col("all_depth"), F.col("med")), F.lit(50.0), F.col("n_floor")), 6).alias("mes"))


@query("WITH " + LC_SQL + SWEET_SQL + " SELECT tic_id, round(sweet_metric, 6) AS sweet_metric FROM swe")
def sweet(spark, sf):
    return vetting.sweet(light_curves(spark, sf)).withColumn("sweet_metric", F.round("sweet_metric", 6))


@query(METRIC_SQL + " SELECT * FROM mt")
def vetting_metrics(spark, sf):
    return _metrics(spark, sf)


def _one(name: str):
    ORACLE_SQL[name] = METRIC_SQL + f" SELECT tic_id, {name} FROM mt"
    QUERIES[name] = lambda spark, sf: _metrics(spark, sf).select("tic_id", name)


_one("uniqueness")
_one("primary_significance")
QUERIES["implied_radius"], ORACLE_SQL["implied_radius"] = lambda spark, sf: _metrics(spark, sf).select("tic_id", "implied_rp_rjup"), METRIC_SQL + " SELECT tic_id, implied_rp_rjup FROM mt"
QUERIES["density_ratio"], ORACLE_SQL["density_ratio"] = lambda spark, sf: _metrics(spark, sf).select("tic_id", "stellar_density_ratio"), METRIC_SQL + " SELECT tic_id, stellar_density_ratio FROM mt"


@query(FLAG_SQL + " SELECT tic_id, " + ", ".join(vetting.FLAGS) + " FROM fl")
def vetting_flags(spark, sf):
    return _flags(spark, sf).select("tic_id", *vetting.FLAGS)


def _lg(x: str, m: str, s: str) -> str:
    return f"CASE WHEN ({x}) IS NULL THEN 0.5 ELSE 1 / (1 + exp(-(({x}) - {m}) / {s})) END"


_L5 = repr(math.log10(5))
_FAR = "CASE WHEN stellar_density_ratio > 0 THEN abs(log10(stellar_density_ratio)) END"
SCORE_SQL = FLAG_SQL + f""", sc AS (SELECT *, 1.0::DOUBLE AS s0,
  CASE WHEN secondary_snr >= 3 OR secondary_depth >= 1e-3 THEN 3.0 * {_lg('CASE WHEN secondary_snr > 0 THEN secondary_snr ELSE 5.0::DOUBLE END', '3.0::DOUBLE', '2.0::DOUBLE')} ELSE 0 END + CASE WHEN implied_rp_rjup > 2 THEN 2.8::DOUBLE * {_lg('implied_rp_rjup', '2.0::DOUBLE', '0.6::DOUBLE')} ELSE 0 END
  + CASE WHEN odd_even_depth_sigma >= 3 THEN 2.6::DOUBLE * {_lg('odd_even_depth_sigma', '3.0::DOUBLE', '1.5::DOUBLE')} ELSE 0 END + CASE WHEN eb_odd_even OR eb_secondary OR eb_vshape THEN 1.8::DOUBLE ELSE 0 END AS s1,
  CASE WHEN crowdsap < 0.9::DOUBLE THEN 2.6::DOUBLE * {_lg('0.9::DOUBLE - crowdsap', '0.2::DOUBLE', '0.12::DOUBLE')} ELSE 0 END + CASE WHEN blend_contamination THEN 2.0 ELSE 0 END AS s2,
  CASE WHEN sweet_metric >= 3 THEN 2.6::DOUBLE * {_lg('sweet_metric', '3.0::DOUBLE', '2.0::DOUBLE')} ELSE 0 END + CASE WHEN transit_snr < 7.1::DOUBLE THEN 2.2::DOUBLE * {_lg('7.1::DOUBLE - transit_snr', '2.0::DOUBLE', '2.0::DOUBLE')} ELSE 0 END
  + CASE WHEN {_FAR} > {_L5}::DOUBLE THEN 1.6::DOUBLE * {_lg(_FAR, _L5 + '::DOUBLE', '0.4::DOUBLE')} ELSE 0 END + CASE WHEN other_variability THEN 1.6::DOUBLE ELSE 0 END AS s3 FROM fl),
sm AS (SELECT *, greatest(s0, s1, s2, s3) AS top FROM sc), pr AS (SELECT *, exp(s0 - top) AS e0, exp(s1 - top) AS e1, exp(s2 - top) AS e2, exp(s3 - top) AS e3 FROM sm),
ru AS (SELECT *, round(e0 / (e0 + e1 + e2 + e3), 6) AS prob_transit, round(e1 / (e0 + e1 + e2 + e3), 6) AS prob_eclipsing_binary, round(e2 / (e0 + e1 + e2 + e3), 6) AS prob_blend, round(e3 / (e0 + e1 + e2 + e3), 6) AS prob_other FROM pr)"""
_PROBS = [f"prob_{c}" for c in classify.CLASSES]


def _rules(spark, sf):
    # a row per star; saved, the metrics' expressions are not unfolded into those of rules, veto and class
    m = classify.softmax(classify.rule_scores(saved(_flags(spark, sf), "metrics")))
    return m.withColumns({p: F.round(p, 6) for p in _PROBS})


@query(SCORE_SQL + " SELECT tic_id, round(s0, 6) AS score_transit, round(s1, 6) AS score_eclipsing_binary, round(s2, 6) AS score_blend, round(s3, 6) AS score_other, prob_transit, prob_eclipsing_binary, prob_blend, prob_other FROM ru")
def rules_scores(spark, sf):
    return _rules(spark, sf).select("tic_id", *(F.round(f"score_{c}", 6).alias(f"score_{c}") for c in classify.CLASSES), *_PROBS)


VETO_SQL = SCORE_SQL + """, fo2 AS (SELECT *, CASE WHEN blend_contamination THEN 'blend' WHEN eb_secondary OR coalesce(secondary_snr, 0) >= 5 OR coalesce(secondary_depth, 0) >= 5e-3 OR implied_radius_too_big OR coalesce(implied_rp_rjup, 0) > 2.5 OR coalesce(odd_even_depth_sigma, 0) >= 5 THEN 'eclipsing_binary' END AS forced FROM ru),
ow AS (SELECT *, CASE forced WHEN 'transit' THEN prob_transit WHEN 'eclipsing_binary' THEN prob_eclipsing_binary WHEN 'blend' THEN prob_blend WHEN 'other' THEN prob_other END AS own FROM fo2), ra AS (SELECT *, greatest(own, 0.9::DOUBLE) AS raised, 1 - own AS rest FROM ow),
ve AS (SELECT * EXCLUDE (prob_transit, prob_eclipsing_binary, prob_blend, prob_other), """ + ", ".join(f"round(CASE WHEN forced IS NULL THEN prob_{c} WHEN forced = '{c}' THEN raised WHEN rest > 0 THEN prob_{c} / rest * (1 - raised) ELSE (1 - raised) / 3 END, 6) AS prob_{c}" for c in classify.CLASSES) + """ FROM ra),
la AS (SELECT *, greatest(prob_transit, prob_eclipsing_binary, prob_blend, prob_other) AS confidence FROM ve), cl AS (SELECT *, CASE WHEN prob_transit = confidence THEN 'transit' WHEN prob_eclipsing_binary = confidence THEN 'eclipsing_binary' WHEN prob_blend = confidence THEN 'blend' ELSE 'other' END AS class FROM la)"""


def _classified(spark, sf):
    m = classify.veto(_rules(spark, sf))
    return classify.labelled(m.withColumns({p: F.round(p, 6) for p in _PROBS}))


@query(VETO_SQL + " SELECT tic_id, forced, prob_transit, prob_eclipsing_binary, prob_blend, prob_other, class, confidence FROM cl")
def ensemble_veto(spark, sf):
    return _classified(spark, sf).select("tic_id", "forced", *_PROBS, "class", "confidence")


@query(FLAG_SQL + ", fb AS (SELECT tic_id, CASE WHEN eb_odd_even OR eb_secondary OR eb_vshape OR implied_radius_too_big THEN 'eclipsing_binary' WHEN blend_contamination THEN 'blend' WHEN coalesce(transit_snr >= 7, false) THEN 'transit' ELSE 'other' END AS class FROM fl) SELECT *, " + ", ".join(f"CASE WHEN class = '{c}' THEN 0.7::DOUBLE ELSE 0.1::DOUBLE END AS prob_{c}" for c in classify.CLASSES) + " FROM fb")
def fallback_classifier(spark, sf):
    return classify.fallback(_flags(spark, sf)).select("tic_id", "class", *_PROBS)


@query(VETO_SQL + " SELECT tic_id, coalesce(class = 'transit' OR (transit_snr >= 7 AND prob_transit >= 0.25), false) AS fits FROM cl")
def fit_gate(spark, sf):
    return classify.fit_gate(_classified(spark, sf)).select("tic_id", "fits")


_FEATURES = ("period", "log_period", "t0", "depth", "log_depth", "duration", "duration_over_period", "transit_snr", "n_transits", "odd_even_depth_sigma", "odd_depth", "even_depth", "secondary_depth", "secondary_snr", "secondary_phase", "secondary_to_primary", "uniqueness", "implied_rp_rjup", "stellar_density_ratio", "rp_rs", "crowdsap", "sweet_metric", "flux_mad", "radius", "mass", "tmag")
#: All features; those that the bound tables have no numbers for are null.
FEATURE_NAMES = learn.FEATURES


def features(m):
    """All features of FEATURE_NAMES from what the metrics have; the rest are null."""
    period = F.lit(1.0) + F.lit(0.5) * (F.col("tic_id") % 7)
    depth = F.col("depth")
    made = {"period": period, "log_period": F.log10(period), "t0": F.lit(0.25), "log_depth": F.when(depth > 0, F.log10(depth)), "duration": F.lit(0.3), "duration_over_period": F.lit(0.3) / period, "rp_rs": F.when(depth > 0, F.sqrt(depth))}
    made = {k: F.round(v, 6) for k, v in made.items()}
    return m.select("tic_id", *((made[n] if n in made else F.col(n) if n in m.columns else F.lit(None)).cast("double").alias(n) for n in FEATURE_NAMES))


_MADE = {"period": "1.0::DOUBLE + 0.5::DOUBLE * (tic_id % 7)", "log_period": "round(log10(1.0::DOUBLE + 0.5::DOUBLE * (tic_id % 7)), 6)", "t0": "0.25::DOUBLE", "log_depth": "round(CASE WHEN depth > 0 THEN log10(depth) END, 6)", "duration": "0.3::DOUBLE", "duration_over_period": "round(0.3::DOUBLE / (1.0::DOUBLE + 0.5::DOUBLE * (tic_id % 7)), 6)", "rp_rs": "round(CASE WHEN depth > 0 THEN sqrt(depth) END, 6)"}


@query(METRIC_SQL + " SELECT tic_id, " + ", ".join(f"{_MADE.get(n, n if n in _FEATURES else 'NULL::DOUBLE')} AS {n}" for n in FEATURE_NAMES) + " FROM mt")
def features_38(spark, sf):
    return features(_metrics(spark, sf))


def _catalog(spark, sf):
    m = _classified(spark, sf)
    return catalog.conform(m.select("tic_id", F.lit(1).alias("sector"), (F.lit(1.0) + F.lit(0.5) * (F.col("tic_id") % 7)).alias("period"), F.lit(0.25).alias("t0"), F.lit(0.3).alias("duration"), "depth", (F.col("depth") * 1e6).alias("depth_ppm"), F.col("transit_snr").alias("snr"), F.lit("ephemeris").alias("detection_method"), "class", "confidence", F.lit("rules").alias("classify_method"), *_PROBS, catalog.joined_flags(vetting.FLAGS).alias("flags")))


_NULLS = ("period_err_lo", "period_err_hi", "t0_err_lo", "t0_err_hi", "duration_err_lo", "duration_err_hi", "depth_err_lo", "depth_err_hi", "sde", "delta_bic")
CATALOG_SQL = VETO_SQL + ", cat AS (SELECT tic_id, 1 AS sector, 1.0::DOUBLE + 0.5::DOUBLE * (tic_id % 7) AS period, 0.25::DOUBLE AS t0, 0.3::DOUBLE AS duration, depth, depth * 1e6 AS depth_ppm, transit_snr AS snr, 'ephemeris' AS detection_method, class, confidence, 'rules' AS classify_method, prob_transit, prob_eclipsing_binary, prob_blend, prob_other, concat_ws(';', " + ", ".join(f"CASE WHEN {f} THEN '{f}' END" for f in vetting.FLAGS) + ") AS flags, '' AS fit_method, " + ", ".join(f"NULL::DOUBLE AS {n}" for n in _NULLS) + ", " + ", ".join(f"false AS {n}" for n in catalog.FLAG_COLUMNS) + " FROM cl)"


@query(CATALOG_SQL + " SELECT * FROM cat")
def catalog_rows(spark, sf):
    return _catalog(spark, sf)


@query(CATALOG_SQL + " SELECT tic_id, sector, period, depth_ppm, duration, snr, sde, class, confidence, flags FROM cat")
def catalog_display(spark, sf):
    return catalog.displayed(_catalog(spark, sf))


@query(CATALOG_SQL + ", kn(class) AS (VALUES ('transit'), ('eclipsing_binary'), ('blend'), ('other')) SELECT coalesce(k.class, c.class) AS class, count(c.tic_id) AS n FROM kn k FULL JOIN cat c ON c.class = k.class GROUP BY 1")
def class_counts(spark, sf):
    return catalog.class_counts(_catalog(spark, sf))


@query(CATALOG_SQL + " SELECT tic_id, class, snr, duration * 24 AS hours FROM cat ORDER BY snr DESC NULLS LAST, tic_id LIMIT 8")
def top_candidates(spark, sf):
    return catalog.top_candidates(_catalog(spark, sf)).select("tic_id", "class", "snr", "hours")


@query(CATALOG_SQL + " SELECT tic_id, greatest(coalesce(snr, 0), coalesce(sde, 0)) AS strength, confidence FROM cat ORDER BY strength DESC, coalesce(confidence, 0) DESC, tic_id LIMIT 20")
def rank_top_k(spark, sf):
    return catalog.ranked(_catalog(spark, sf)).limit(20).select("tic_id", "strength", "confidence")


@query(CATALOG_SQL + " SELECT count(*) AS n, count(*) FILTER (class = 'transit') AS n_transit, median(confidence) AS median_confidence, median(snr) AS median_snr FROM cat")
def catalog_summary(spark, sf):
    return catalog.summary(_catalog(spark, sf))


@query(CATALOG_SQL + " SELECT tic_id, period, depth, snr, class, confidence FROM cat WHERE class IN ('transit', 'blend') AND confidence >= 0.5 AND snr BETWEEN -100 AND 100 AND contains(tic_id::VARCHAR, '1')")
def dashboard_filter(spark, sf):
    # a dashboard filters the same catalog again and again; saved rows also stop filters from unfolding the rules' expressions
    c = saved(_catalog(spark, sf), "catalog")
    return c.filter(F.col("class").isin("transit", "blend") & (F.col("confidence") >= 0.5) & F.col("snr").between(-100, 100) & F.col("tic_id").cast("string").contains("1")).select("tic_id", "period", "depth", "snr", "class", "confidence")


@query("WITH " + LC_SQL + ", c AS (SELECT tic_id, f, median(f) OVER (PARTITION BY tic_id) AS m FROM lc), g AS (SELECT tic_id, count(*) AS n, max(m) AS m, sum(f)::BIGINT AS s, sum(f * f)::BIGINT AS ss, median(abs(f - m)) * 1.4826::DOUBLE AS sig FROM c GROUP BY tic_id) SELECT tic_id, n, round((ss - 2 * m * s + n * m * m) / (sig * sig), 6) AS chi2, round(0.0::DOUBLE * ln(greatest(n, 1)::DOUBLE) + (ss - 2 * m * s + n * m * m) / (sig * sig), 6) AS bic_flat, round(4.0::DOUBLE * ln(greatest(n, 1)::DOUBLE) + (ss - 2 * m * s + n * m * m) / (sig * sig), 6) AS bic_4 FROM g")
def chi2_bic(spark, sf):
    lc = light_curves(spark, sf)
    g = lc.select("tic_id", "f", F.median("f").over(clean.star()).alias("m")).groupBy("tic_id").agg(F.count(F.lit(1)).alias("n"), F.max("m").alias("m"), F.sum("f").alias("s"), F.sum(F.col("f") * F.col("f")).alias("ss"), (F.median(F.abs(F.col("f") - F.col("m"))) * X.MAD_SCALE).alias("sig"))
    chi2 = (F.col("ss") - 2 * F.col("m") * F.col("s") + F.col("n") * F.col("m") * F.col("m")) / (F.col("sig") * F.col("sig"))
    return g.select("tic_id", "n", F.round(chi2, 6).alias("chi2"), F.round(catalog.gaussian_fit(chi2, F.col("n"), 0), 6).alias("bic_flat"), F.round(catalog.gaussian_fit(chi2, F.col("n"), 4), 6).alias("bic_4"))


@query("WITH " + LC_SQL + " SELECT tic_id, round(quantile_cont(f, 0.16), 6) AS p16, round(quantile_cont(f, 0.5), 6) AS p50, round(quantile_cont(f, 0.84), 6) AS p84 FROM lc GROUP BY tic_id")
def posterior_percentiles(spark, sf):
    return light_curves(spark, sf).groupBy("tic_id").agg(*(F.round(F.percentile("f", F.lit(p)), 6).alias(f"p{round(100 * p)}") for p in (0.16, 0.5, 0.84)))


_GEO = "WITH " + LC_SQL + ", g AS (SELECT tic_id, us, (u - floor(u) - 0.5) AS ph, (u - floor(u) - 0.5) * period AS dt, period, duration FROM (SELECT *, (time - t0) / period + 0.5 AS u FROM lc))"


@query(_GEO + ", h AS (SELECT *, duration / 2 AS half, duration / 2 - 0.2::DOUBLE * duration AS flat FROM g) SELECT tic_id, us, round(CASE WHEN abs(dt) <= flat THEN 1 - 0.01::DOUBLE WHEN abs(dt) < half THEN 1 - 0.01::DOUBLE * (half - abs(dt)) / (half - flat) ELSE 1.0::DOUBLE END, 9) AS model FROM h")
def trapezoid_model(spark, sf):
    x = fold.folded(light_curves(spark, sf))
    return x.select("tic_id", "us", F.round(X.trapezoid(F.col("dt"), F.lit(0.01), F.col("duration"), F.lit(0.2)), 9).alias("model"))


def _occ(z: str, p: str) -> str:
    return f"CASE WHEN {z} >= 1 + {p} THEN 0.0::DOUBLE WHEN {z} <= abs(1 - {p}) THEN least({p} * {p}, 1.0::DOUBLE) ELSE ({p} * {p} * acos(greatest(-1.0::DOUBLE, least(({z} * {z} + {p} * {p} - 1) / greatest(2 * {z} * {p}, 1e-12), 1.0::DOUBLE))) + acos(greatest(-1.0::DOUBLE, least(({z} * {z} + 1 - {p} * {p}) / greatest(2 * {z}, 1e-12), 1.0::DOUBLE))) - sqrt(greatest((1 + {p} - {z}) * ({z} + {p} - 1) * ({z} + 1 - {p}) * (1 + {p} + {z}), 0.0::DOUBLE)) / 2) / pi() END"


@query(_GEO + f", q AS (SELECT tic_id, us, abs(ph) * 4 AS z, 0.1::DOUBLE AS p FROM g) SELECT tic_id, us, round({_occ('z', 'p')}, 8) AS blocked FROM q")
def uniform_occultation(spark, sf):
    x = fold.folded(light_curves(spark, sf))
    return x.select("tic_id", "us", F.round(X.occulted(F.abs("phase") * 4, F.lit(0.1)), 8).alias("blocked"))


@query(_GEO + f""", q AS (SELECT tic_id, us, ph * 2 * pi() AS ang, cos(radians(88.0::DOUBLE)) AS ti FROM g), zz AS (SELECT *, 8.0::DOUBLE * sqrt(sin(ang) * sin(ang) + cos(ang) * ti * cos(ang) * ti) AS z, 0.1::DOUBLE AS p FROM q),
m AS (SELECT *, sqrt(greatest(1 - least(z * z, 1.0::DOUBLE), 0.0::DOUBLE)) AS mu FROM zz) SELECT tic_id, us, round(CASE WHEN cos(ang) > 0 THEN 1 - ({_occ('z', 'p')}) * ((1 - 0.4::DOUBLE * (1 - mu) - 0.3::DOUBLE * (1 - mu) * (1 - mu)) / (1 - 0.4::DOUBLE / 3 - 0.3::DOUBLE / 6)) ELSE 1.0::DOUBLE END, 7) AS model FROM m""")
def transit_model_numpy(spark, sf):
    x = fold.folded(light_curves(spark, sf))
    return x.select("tic_id", "us", F.round(X.transit_flux(F.col("phase"), F.lit(0.1), F.lit(8.0), F.lit(88.0), F.lit(0.4), F.lit(0.3)), 7).alias("model"))


_ST = "WITH " + STARS_SQL + ", g AS (SELECT tic_id, 1.0::DOUBLE + 0.5::DOUBLE * (tic_id % 7) AS period, 0.05::DOUBLE + 0.1::DOUBLE * crowdsap AS k, 0.8::DOUBLE * crowdsap AS b, radius, mass FROM stars), a AS (SELECT *, sqrt(greatest((1 + k) * (1 + k) - b * b, 0.0::DOUBLE)) / sin(" + _PI + "::DOUBLE * 0.12::DOUBLE / period) AS a FROM g), i AS (SELECT *, CASE WHEN a <= 0 THEN 90.0::DOUBLE ELSE degrees(acos(greatest(-1.0::DOUBLE, least(b / a, 1.0::DOUBLE)))) END AS inc FROM a)"


def _geometry(spark, sf):
    g = stars(spark, sf).select("tic_id", (F.lit(1.0) + F.lit(0.5) * (F.col("tic_id") % 7)).alias("period"), (F.lit(0.05) + F.lit(0.1) * F.col("crowdsap")).alias("k"), (F.lit(0.8) * F.col("crowdsap")).alias("b"), "radius", "mass")
    return g.withColumn("a", X.a_of_duration(F.col("period"), F.lit(0.12), F.col("k"), F.col("b"))).withColumn("inc", X.inclination_of(F.col("a"), F.col("b")))


@query(_ST + f" SELECT tic_id, round(period / {_PI}::DOUBLE * asin(greatest(-1.0::DOUBLE, least(sqrt(greatest((1 + k) * (1 + k) - b * b, 0.0::DOUBLE)) / (a * sin(radians(inc))), 1.0::DOUBLE))), 8) AS duration FROM i")
def winn_duration(spark, sf):
    c = F.col
    return _geometry(spark, sf).select("tic_id", F.round(X.duration_of(c("period"), c("a"), c("k"), c("b"), c("inc")), 8).alias("duration"))


@query(_ST + f", d AS (SELECT *, 3 * {_PI}::DOUBLE / ({X.GRAVITY!r}::DOUBLE * (period * 86400.0::DOUBLE) * (period * 86400.0::DOUBLE)) * a * a * a AS rho FROM i) SELECT tic_id, round(a, 7) AS a_rs, round(inc, 7) AS inclination, round(a * cos(radians(inc)), 7) AS b_back, round(rho / 1000, 6) AS density, round(cbrt(rho * {X.GRAVITY!r}::DOUBLE * (period * 86400.0::DOUBLE) * (period * 86400.0::DOUBLE) / (3 * {_PI}::DOUBLE)), 7) AS a_back, round(k * radius * {X.RSUN_RJUP!r}::DOUBLE, 7) AS rp_rjup, round(k * radius * {X.RSUN_REARTH!r}::DOUBLE, 6) AS rp_rearth, k * k AS depth FROM d")
def geometry_inverses(spark, sf):
    c = F.col
    rho = X.density_of(c("period"), c("a"))
    return _geometry(spark, sf).select("tic_id", F.round("a", 7).alias("a_rs"), F.round("inc", 7).alias("inclination"), F.round(X.impact_of(c("a"), c("inc")), 7).alias("b_back"), F.round(rho / 1000, 6).alias("density"), F.round(X.a_of_density(c("period"), rho), 7).alias("a_back"), F.round(c("k") * c("radius") * X.RSUN_RJUP, 7).alias("rp_rjup"), F.round(c("k") * c("radius") * X.RSUN_REARTH, 6).alias("rp_rearth"), (c("k") * c("k")).alias("depth"))


@query("WITH " + STARS_SQL + ", u AS (SELECT tic_id, 0.1::DOUBLE + 0.5::DOUBLE * crowdsap AS u1, 0.3::DOUBLE * crowdsap AS u2 FROM stars), q AS (SELECT *, (u1 + u2) * (u1 + u2) AS q1, u1 / (2 * (u1 + u2)) AS q2 FROM u) SELECT tic_id, q1, q2, round(2 * sqrt(q1) * q2, 9) AS u1, round(sqrt(q1) * (1 - 2 * q2), 9) AS u2 FROM q")
def limb_darkening_maps(spark, sf):
    u1, u2 = F.lit(0.1) + F.lit(0.5) * F.col("crowdsap"), F.lit(0.3) * F.col("crowdsap")
    q1, q2 = X.limb_q(u1, u2)
    s = stars(spark, sf).select("tic_id", q1.alias("q1"), q2.alias("q2"))
    b1, b2 = X.limb_u(F.col("q1"), F.col("q2"))
    return s.select("tic_id", "q1", "q2", F.round(b1, 9).alias("u1"), F.round(b2, 9).alias("u2"))


def _predictions(spark, sf):
    return table(spark, sf, "labels").select("doc_id", "quality", (1 - F.col("toxic")).alias("predicted"))


@query("SELECT quality, count(*) FILTER (1 - toxic = 0) AS pred_0, count(*) FILTER (1 - toxic = 1) AS pred_1 FROM labels GROUP BY quality")
def confusion_matrix(spark, sf):
    return catalog.confusion(_predictions(spark, sf), "quality", "predicted", (0, 1))


@query("SELECT label::INT AS label, hit / nullif(p, 0) AS precision, hit / nullif(t, 0) AS recall, 2 * hit / nullif(t + p, 0) AS f1 FROM (SELECT label, sum(t)::BIGINT AS t, sum(p)::BIGINT AS p, sum(hit)::BIGINT AS hit FROM (SELECT quality AS label, 1 AS t, 0 AS p, (quality = 1 - toxic)::INT AS hit FROM labels UNION ALL SELECT 1 - toxic, 0, 1, 0 FROM labels) GROUP BY label)")
def class_scores(spark, sf):
    return catalog.scores(_predictions(spark, sf), "quality", "predicted")


@query("SELECT avg((quality = 1 - toxic)::INT)::DOUBLE AS accuracy, count(*) AS n FROM labels")
def accuracy(spark, sf):
    return _predictions(spark, sf).agg(F.avg((F.col("quality") == F.col("predicted")).cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT c_custkey AS tic_id FROM customer WHERE c_custkey::VARCHAR NOT IN (SELECT user_id::VARCHAR FROM events WHERE value > 60)")
def manifest_anti_join(spark, sf):
    done = table(spark, sf, "events").filter("value > 60").select(F.col("user_id").alias("tic_id"))
    return catalog.pending(table(spark, sf, "customer").select(F.col("c_custkey").alias("tic_id")), done)


@query("WITH " + STARS_SQL + " SELECT s.tic_id, t.truth FROM stars s LEFT JOIN (SELECT user_id AS tic_id, arg_max(event_type, ts) AS truth FROM events GROUP BY user_id) t USING (tic_id)")
def truth_join(spark, sf):
    truth = table(spark, sf, "events").select(F.col("user_id").alias("tic_id"), F.col("event_type").alias("label"), "ts")
    return catalog.with_truth(stars(spark, sf).select("tic_id"), truth, "ts")


_CONE = "WITH " + STARS_SQL + """, t AS (SELECT tic_id, ra AS ra1, dec AS dec1 FROM stars WHERE tic_id % 5 = 0), d AS (SELECT t.tic_id, s.tic_id AS source_id, s.tmag AS mag, degrees(2 * asin(least(sqrt(sin((radians(s.dec) - radians(dec1)) / 2) * sin((radians(s.dec) - radians(dec1)) / 2) + cos(radians(dec1)) * cos(radians(s.dec)) * sin(radians(s.ra - ra1) / 2) * sin(radians(s.ra - ra1) / 2)), 1.0::DOUBLE))) AS distance FROM t JOIN stars s ON abs(s.dec - dec1) <= 3.001),
cone AS (SELECT * FROM d WHERE distance <= 3.0)"""


def _sky(spark, sf):
    s = stars(spark, sf)
    return s.filter("tic_id % 5 = 0"), s.withColumnRenamed("tic_id", "source_id").withColumnRenamed("tmag", "mag")


@query(_CONE + " SELECT tic_id, source_id, round(distance, 6) AS distance FROM cone")
def cone_search(spark, sf):
    return catalog.cone_search(*_sky(spark, sf), 3.0).select("tic_id", "source_id", F.round("distance", 6).alias("distance"))


@query(_CONE + " SELECT tic_id, arg_min(source_id, (mag, source_id)) AS target_id, count(mag) - 1 AS n_neighbors, CASE WHEN count(mag) > 1 THEN list_sort(list(mag))[2] - min(mag) END AS delta_mag FROM cone GROUP BY tic_id")
def cone_neighbours(spark, sf):
    return catalog.cone_neighbours(*_sky(spark, sf), 3.0)


def _knn_sql(cosine: bool) -> str:
    v = "list_transform(embedding, lambda e: e::DOUBLE)"
    unit = "CASE WHEN sz > 0 THEN list_transform(v, lambda e: e / sz) ELSE v END" if cosine else "v"
    return f"WITH e AS (SELECT vec_id, {v} AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda e: e * e))) AS sz FROM e), u AS (SELECT vec_id, {unit} AS v FROM n), d AS (SELECT q.vec_id AS query_id, u.vec_id, round(list_sum(list_transform(range(1, len(u.v) + 1), lambda i: (q.v[i] - u.v[i]) * (q.v[i] - u.v[i]))), 6) AS d2 FROM u q, u WHERE q.vec_id % 20 = 0) SELECT query_id, vec_id, d2, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, vec_id)::INT AS rank FROM d) WHERE rank <= 5"


def _knn(spark, sf, cosine):
    v = table(spark, sf, "embeddings")
    return catalog.nearest(v.filter("vec_id % 20 = 0"), v, 5, cosine).withColumn("d2", F.round("d2", 6))


@query(_knn_sql(False))
def knn_l2(spark, sf):
    return _knn(spark, sf, False)


@query(_knn_sql(True))
def knn_cosine(spark, sf):
    return _knn(spark, sf, True)


# each step once: unfolded into one another, the long chains never end
ORACLE_SQL.update({k: re.sub(r"(\w+(?:\([\w, ]+\))?) AS \((?=SELECT)", r"\1 AS MATERIALIZED (", v) for k, v in ORACLE_SQL.items()})
