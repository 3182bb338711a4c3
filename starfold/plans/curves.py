"""Queries on light curves: cleaning, folding and period search."""

from __future__ import annotations

from pyspark.sql import functions as F

from starfold.functions.columns import MAD_SCALE
from starfold.operators import clean, fold, search
from starfold.sources.tables import LC_SQL, light_curves

QUERIES, ORACLE_SQL = {}, {}
_W = "WITH " + LC_SQL


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


@query(_W + " SELECT tic_id, us, time, f, quality, kind FROM lc")
def lc_ingest(spark, sf):
    return light_curves(spark, sf).select("tic_id", "us", "time", "f", "quality", "kind")


@query(_W + ", m AS (SELECT *, median(f) OVER (PARTITION BY tic_id) AS med FROM lc) SELECT tic_id, us, CASE WHEN abs(med - 1) <= 0.01::DOUBLE + 1e-5 OR med <= 0 THEN f::DOUBLE ELSE f / med END AS flux FROM m")
def lc_normalize(spark, sf):
    return clean.normalized(light_curves(spark, sf)).select("tic_id", "us", "flux")


@query(_W + " SELECT tic_id, us, f, quality FROM lc WHERE (quality & 32) = 0")
def lc_quality_mask(spark, sf):
    return clean.good_quality(light_curves(spark, sf), 32).select("tic_id", "us", "f", "quality")


def _clip_sql(rounds: int) -> str:
    out = _W + ", k0 AS (SELECT tic_id, us, f, true AS keep FROM lc)"
    for i in range(rounds):
        out += f""", a{i} AS (SELECT *, median(f) FILTER (keep) OVER (PARTITION BY tic_id) AS m, count(*) FILTER (keep) OVER (PARTITION BY tic_id) AS n FROM k{i}),
        b{i} AS (SELECT *, median(abs(f - m)) FILTER (keep) OVER (PARTITION BY tic_id) * 1.4826::DOUBLE AS s FROM a{i}),
        k{i + 1} AS (SELECT tic_id, us, f, CASE WHEN n < 3 OR s = 0 THEN keep ELSE keep AND f - m <= s * 5.0::DOUBLE AND f - m >= s * -3.0::DOUBLE END AS keep FROM b{i})"""
    return out + f" SELECT tic_id, us, f, keep FROM k{rounds}"


@query(_clip_sql(1))
def lc_sigma_clip_1(spark, sf):
    return clean.sigma_clipped(light_curves(spark, sf), rounds=1).select("tic_id", "us", "f", "keep")


@query(_clip_sql(5))
def lc_sigma_clip(spark, sf):
    return clean.sigma_clipped(light_curves(spark, sf)).select("tic_id", "us", "f", "keep")


@query(_W + f""", m AS (SELECT tic_id, us, f / median(f) OVER (PARTITION BY tic_id) - 1 AS resid FROM lc), r AS (SELECT *, median(resid) OVER (PARTITION BY tic_id) AS rm FROM m),
s AS (SELECT *, median(abs(resid - rm)) OVER (PARTITION BY tic_id) * {MAD_SCALE}::DOUBLE AS s FROM r) SELECT tic_id, us, s = 0 OR (resid <= s * 3.0::DOUBLE AND resid >= s * -20.0::DOUBLE) AS keep FROM s""")
def lc_outlier_mask(spark, sf):
    return clean.outlier_mask(light_curves(spark, sf)).select("tic_id", "us", "keep")


@query(_W + """, w AS (SELECT tic_id, time, f, min(time) OVER (PARTITION BY tic_id) AS lo, max(time) OVER (PARTITION BY tic_id) AS hi FROM lc),
b AS (SELECT tic_id, f, CASE WHEN hi > lo THEN least(floor((time - lo) / ((hi - lo) / 20)), 19)::INT ELSE 0 END AS bin FROM w),
g AS (SELECT tic_id, bin, count(*) AS n, sum(f)::BIGINT AS s, sum(f * f)::BIGINT AS ss FROM b GROUP BY ALL)
, r AS (SELECT DISTINCT tic_id, unnest(range(0, 20))::INT AS bin FROM lc)
SELECT tic_id, bin, coalesce(n, 0) AS n, s / n AS mean, sqrt(greatest(ss / n - (s / n) * (s / n), 0)) / sqrt(n::DOUBLE) AS err FROM r LEFT JOIN g USING (tic_id, bin)""")
def lc_time_bin(spark, sf):
    return clean.time_binned(light_curves(spark, sf))


@query(_W + " SELECT tic_id, us, f / median(f) OVER (PARTITION BY tic_id, kind) AS flux, dense_rank() OVER (PARTITION BY tic_id ORDER BY kind)::INT AS segment FROM lc")
def lc_stitch(spark, sf):
    return clean.stitched(light_curves(spark, sf)).select("tic_id", "us", "flux", "segment")


@query(_W + ", g AS (SELECT tic_id, us, coalesce((us - lag(us) OVER (PARTITION BY tic_id ORDER BY us) > 43200000000)::INT, 0) AS far FROM lc) SELECT tic_id, us, (sum(far) OVER (PARTITION BY tic_id ORDER BY us))::BIGINT AS segment FROM g")
def lc_gap_segments(spark, sf):
    return clean.gap_segments(light_curves(spark, sf)).select("tic_id", "us", "segment")


@query(_W + """, p AS (SELECT tic_id, list(f ORDER BY us) AS f, list(us ORDER BY us) AS us FROM lc GROUP BY tic_id HAVING count(*) > 2),
q AS (SELECT tic_id, us, list_concat(list_concat(list_reverse(f[2:3]), f), list_reverse(f[len(f) - 2:len(f) - 1])) AS q FROM p),
x AS (SELECT tic_id, us, q, unnest(range(1, len(us) + 1)) AS i FROM q) SELECT tic_id, us[i] AS us, list_median(q[i:i + 4]) AS med FROM x""".replace("list_median(", "list_aggregate(").replace("q[i:i + 4])", "q[i:i + 4], 'median')"))
def lc_running_median(spark, sf):
    return clean.running_median(light_curves(spark, sf))


@query(_W + ", s AS (SELECT tic_id, us - lag(us) OVER (PARTITION BY tic_id ORDER BY us) AS step FROM lc) SELECT tic_id, median(step)::DOUBLE AS cadence_us FROM s GROUP BY tic_id")
def lc_cadence(spark, sf):
    return clean.cadence(light_curves(spark, sf))


@query(_W + ", n AS (SELECT tic_id, us, f, lag(f) OVER (PARTITION BY tic_id ORDER BY us) AS a, lead(f) OVER (PARTITION BY tic_id ORDER BY us) AS b FROM lc) SELECT tic_id, us, f FROM n WHERE f > a AND f > b")
def local_maxima(spark, sf):
    return clean.local_peaks(light_curves(spark, sf)).select("tic_id", "us", "f")


@query(_W + """, m AS (SELECT tic_id, f, median(f) OVER (PARTITION BY tic_id) AS med FROM lc) SELECT tic_id, max(med)::DOUBLE AS med, median(abs(f - med)) AS mad, median(abs(f - med)) * 1.4826::DOUBLE AS scale FROM m GROUP BY tic_id""")
def robust_std(spark, sf):
    return clean.robust_scale(light_curves(spark, sf))


@query(_W + " SELECT tic_id, sha256(string_agg(us::VARCHAR || ':' || f::VARCHAR, ',' ORDER BY us, f)) AS digest FROM lc GROUP BY tic_id")
def content_hash(spark, sf):
    return clean.content_hash(light_curves(spark, sf))


FOLD_SQL = _W + """, x AS (SELECT *, (time - t0) / period + 0.5 AS u FROM lc), fo AS (SELECT *, u - floor(u) - 0.5 AS phase, (u - floor(u) - 0.5) * period AS dt, floor(u)::BIGINT AS cycle, round_even((time - t0) / period, 0)::BIGINT AS cycle_even FROM x)"""


@query(FOLD_SQL + " SELECT tic_id, us, phase, dt, cycle, cycle_even FROM fo")
def phase_fold(spark, sf):
    return fold.folded(light_curves(spark, sf)).select("tic_id", "us", "phase", "dt", "cycle", "cycle_even")


_BINS = FOLD_SQL + ", b AS (SELECT tic_id, f, least(floor((phase + 0.5) * 20), 19)::INT AS bin FROM fo), pb AS (SELECT tic_id, bin, count(*) AS n, sum(f)::BIGINT / count(*) AS mean, median(f) AS median FROM b GROUP BY ALL)"


@query(_BINS + " SELECT tic_id, bin, n, mean FROM pb")
def phase_bin_mean(spark, sf):
    return fold.phase_bins(light_curves(spark, sf)).select("tic_id", "bin", "n", "mean")


@query(_BINS + " SELECT tic_id, bin, median FROM pb")
def phase_bin_median(spark, sf):
    return fold.phase_bins(light_curves(spark, sf)).select("tic_id", "bin", "median")


_FILL = _BINS + """, grid AS (SELECT tic_id, unnest(range(0, 20))::INT AS bin FROM (SELECT DISTINCT tic_id FROM pb)), v AS (SELECT g.tic_id, g.bin, median AS v FROM grid g LEFT JOIN pb USING (tic_id, bin)),
l AS (SELECT *, last_value(v IGNORE NULLS) OVER a AS lv, last_value(CASE WHEN v IS NOT NULL THEN bin END IGNORE NULLS) OVER a AS lb, first_value(v IGNORE NULLS) OVER z AS rv, first_value(CASE WHEN v IS NOT NULL THEN bin END IGNORE NULLS) OVER z AS rb
  FROM v WINDOW a AS (PARTITION BY tic_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY tic_id ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fill AS (SELECT tic_id, bin, coalesce(CASE WHEN lb = rb THEN v ELSE lv + (rv - lv) * (bin - lb) / (rb - lb) END, lv, rv, 0) AS value FROM l)"""


@query(_FILL + " SELECT tic_id, bin, value FROM fill")
def phase_fill_view(spark, sf):
    return fold.filled_view(fold.phase_bins(light_curves(spark, sf)))


@query(_FILL + ", c AS (SELECT tic_id, bin, value - median(value) OVER (PARTITION BY tic_id) AS value FROM fill), d AS (SELECT *, min(value) OVER (PARTITION BY tic_id) AS low FROM c) SELECT tic_id, bin, CASE WHEN low < -1e-12 THEN value / abs(low) ELSE value END AS value FROM d")
def phase_view(spark, sf):
    return fold.normal_view(fold.filled_view(fold.phase_bins(light_curves(spark, sf))))


def _depth_sql(name: str, which: str) -> str:
    i, o = f"abs(dt) <= duration / 2 AND {which}", f"abs(dt) >= duration * 0.75::DOUBLE AND abs(dt) <= duration * 2.5::DOUBLE AND {which}"
    return f"CASE WHEN count(*) FILTER ({i}) >= 1 AND count(*) FILTER ({o}) >= 3 THEN median(f) FILTER ({o}) - (sum(f) FILTER ({i}))::BIGINT / count(*) FILTER ({i}) END AS {name}_depth"


ODD = "((cycle % 2) + 2) % 2 <> 0"
DEPTH_SQL = FOLD_SQL + ", dep AS (SELECT tic_id, " + ", ".join((_depth_sql("all", "true"), _depth_sql("odd", ODD), _depth_sql("even", f"NOT ({ODD})"))) + f", count(*) FILTER (abs(dt) <= duration / 2) AS all_in, count(*) FILTER (abs(dt) <= duration / 2 AND {ODD}) AS odd_in, count(*) FILTER (abs(dt) <= duration / 2 AND NOT ({ODD})) AS even_in, count(*) FILTER (abs(dt) >= duration * 0.75::DOUBLE AND abs(dt) <= duration * 2.5::DOUBLE) AS all_out FROM fo GROUP BY tic_id)"


@query(DEPTH_SQL + " SELECT * FROM dep")
def odd_even_depth(spark, sf):
    return fold.window_depths(light_curves(spark, sf))


_IN, _OUT = "abs(dt) <= duration / 2 * 0.8::DOUBLE", "abs(dt) > duration / 2 AND abs(dt) <= duration / 2 * 3"
FOLDED_SQL = f", fd AS (SELECT tic_id, CASE WHEN count(*) >= 10 AND count(*) FILTER ({_IN}) >= 1 AND count(*) FILTER ({_OUT}) >= 3 THEN median(f) FILTER ({_OUT}) - median(f) FILTER ({_IN}) END AS depth FROM fo GROUP BY tic_id)"


@query(FOLD_SQL + FOLDED_SQL + " SELECT * FROM fd")
def folded_depth(spark, sf):
    return fold.folded_depth(light_curves(spark, sf))


COUNT_SQL = ", tc AS (SELECT tic_id, count(DISTINCT CASE WHEN abs(dt) <= duration / 2 THEN cycle END) AS n_floor, count(DISTINCT CASE WHEN abs(time - t0 - cycle_even * period) <= duration / 2 THEN cycle_even END) AS n_even FROM fo GROUP BY tic_id)"


@query(FOLD_SQL + COUNT_SQL + " SELECT * FROM tc")
def transit_count(spark, sf):
    return fold.transit_counts(light_curves(spark, sf))


@query(FOLD_SQL + """, n AS (SELECT *, median(f) OVER (PARTITION BY tic_id) AS med FROM fo), g AS (SELECT tic_id, median(abs(f - med)) AS mad, count(*) FILTER (abs(dt) > duration / 2) AS n, (sum(f) FILTER (abs(dt) > duration / 2))::BIGINT AS s, (sum(f * f) FILTER (abs(dt) > duration / 2))::BIGINT AS ss FROM n GROUP BY tic_id)
SELECT tic_id, mad * 1.4826::DOUBLE AS flux_mad, CASE WHEN n > 3 THEN sqrt(greatest(ss / n - (s / n) * (s / n), 0)) END AS oot_rms FROM g""")
def noise_features(spark, sf):
    return fold.noise(light_curves(spark, sf))


SECOND_SQL = """, sx AS (SELECT *, median(f) OVER (PARTITION BY tic_id) AS med, duration / period / 2 AS h FROM fo), sg AS (SELECT tic_id, f, phase, med, h, unnest(range(-50, 51)) AS g FROM sx),
sw AS (SELECT *, phase - g / 100.0::DOUBLE + 0.5 AS q FROM sg), sd AS (SELECT tic_id, g, max(med) - sum(f)::BIGINT / count(*) AS depth, count(*) AS n FROM sw WHERE abs(g / 100.0::DOUBLE) >= h * 2 AND abs(q - floor(q) - 0.5) <= h GROUP BY tic_id, g HAVING count(*) >= 3),
sec AS (SELECT tic_id, depth AS secondary_depth, g / 100.0::DOUBLE AS secondary_phase, n FROM (SELECT *, row_number() OVER (PARTITION BY tic_id ORDER BY depth DESC, g) AS rn FROM sd) WHERE rn = 1)"""


@query(FOLD_SQL + SECOND_SQL + " SELECT * FROM sec")
def secondary_scan(spark, sf):
    return fold.secondary_scan(light_curves(spark, sf))


@query(FOLD_SQL + """, r AS (SELECT tic_id, f, least(floor((phase + 0.5) * 60), 59)::INT AS bin, cycle - min(cycle) OVER (PARTITION BY tic_id) AS row, max(cycle) OVER (PARTITION BY tic_id) - min(cycle) OVER (PARTITION BY tic_id) + 1 AS rows_ FROM fo)
SELECT tic_id, row, bin, sum(f)::BIGINT / count(*) AS mean FROM r WHERE rows_ BETWEEN 2 AND 200 GROUP BY tic_id, row, bin""")
def river_grid(spark, sf):
    return fold.river(light_curves(spark, sf))


@query(_W + """, g AS (SELECT tic_id, min(time) AS lo, max(time) AS hi, min(period) AS period, min(t0) AS t0 FROM lc GROUP BY tic_id), n AS (SELECT *, ceil((lo - t0) / period)::BIGINT AS a, floor((hi - t0) / period)::BIGINT AS b FROM g)
SELECT tic_id, epoch, t0 + epoch * period AS time FROM (SELECT *, unnest(range(a, b + 1)) AS epoch FROM n WHERE b >= a AND b - a < 400)""")
def transit_epochs(spark, sf):
    return fold.epochs(light_curves(spark, sf))


_SPAN = _W + ", sp AS (SELECT tic_id, max(time) - min(time) AS baseline FROM lc GROUP BY tic_id)"


_GRID = (_SPAN + """, g AS (SELECT *, 1 / (baseline / 2) AS fmin, 12.0::DOUBLE / (baseline * baseline) AS df FROM sp), n AS (SELECT *, greatest(least(ceil((1.0::DOUBLE - fmin) / df) + 1, 2000000), 16)::INT AS n FROM g WHERE baseline / 2 > 1.0)
SELECT tic_id, n, period_idx::INT AS period_idx, 1 / (fmin + df * (n - 1 - period_idx)) AS period FROM (SELECT *, unnest(range(0, n)) AS period_idx FROM n)""")


@query(_GRID)
def period_grid(spark, sf):
    return search.period_grid(search.spans(light_curves(spark, sf)))


@query(_GRID)
def period_grid_rows(spark, sf):
    """The same grid by a table function."""
    return search.period_grid_rows(search.spans(light_curves(spark, sf)))


@query(_SPAN + """, g AS (SELECT *, 1 / baseline AS df FROM sp WHERE baseline > 1.0), n AS (SELECT *, (floor((1.0::DOUBLE - 1 / baseline) / df) + 1)::INT AS n FROM g)
SELECT tic_id, period_idx::INT AS period_idx, 1 / (1 / baseline + df * (n - 1 - period_idx)) AS period FROM (SELECT *, unnest(range(0, n)) AS period_idx FROM n)""")
def period_grid_cache(spark, sf):
    return search.period_grid_cached(search.spans(light_curves(spark, sf)))


BLS_BINS, BLS_PERIODS, BLS_DURATIONS = 40, 8, (0.1, 0.2, 0.4)
_HIST = _W + f""", per AS (SELECT i::INT AS period_idx, 1.0::DOUBLE + 0.5::DOUBLE * i AS period FROM range(0, {BLS_PERIODS}) r(i)), d0 AS (SELECT tic_id, f, time - min(time) OVER (PARTITION BY tic_id) AS dt FROM lc),
hx AS (SELECT tic_id, period_idx, per.period, f, least(floor((dt / per.period - floor(dt / per.period)) * {BLS_BINS}), {BLS_BINS - 1})::INT AS bin FROM d0, per),
hist AS (SELECT tic_id, period_idx, period, bin, count(*) AS n, sum(f)::BIGINT AS s FROM hx GROUP BY ALL)"""
_DUR = ", ".join(f"({i}, {d}::DOUBLE)" for i, d in enumerate(BLS_DURATIONS))
_BLS = _HIST + f""", tot AS (SELECT tic_id, period_idx, period, sum(n)::BIGINT AS tn, sum(s)::BIGINT AS ts FROM hist GROUP BY ALL),
ring AS (SELECT t.*, b.bin AS start, coalesce(h.n, 0) AS n, coalesce(h.s, 0) AS s FROM tot t CROSS JOIN (SELECT unnest(range(0, {2 * BLS_BINS})) AS bin) b LEFT JOIN hist h ON h.tic_id = t.tic_id AND h.period_idx = t.period_idx AND h.bin = b.bin % {BLS_BINS}),
cum AS (SELECT *, (sum(n) OVER w)::BIGINT AS cn, (sum(s) OVER w)::BIGINT AS cs FROM ring WINDOW w AS (PARTITION BY tic_id, period_idx ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
wid AS (SELECT *, greatest(round_even(len_ / period * {BLS_BINS}, 0), 1)::INT AS width FROM cum, (VALUES {_DUR}) v(dur_idx, len_) WHERE len_ / period < 0.5 AND start < {BLS_BINS}),
box AS (SELECT w.tic_id, w.period_idx, w.period, w.dur_idx, w.start, w.tn, w.ts, e.cn - w.cn + w.n AS bn, e.cs - w.cs + w.s AS bs FROM wid w JOIN cum e ON e.tic_id = w.tic_id AND e.period_idx = w.period_idx AND e.start = w.start + w.width - 1 WHERE w.width < {BLS_BINS}),
pow AS (SELECT tic_id, period_idx, period, dur_idx::INT AS dur_idx, start::INT AS start, (bs - bn::DOUBLE / tn * ts) * (bs - bn::DOUBLE / tn * ts) / (bn::DOUBLE * (tn - bn) / tn) AS power, ts / tn - bs / bn AS depth FROM box WHERE bn > 0 AND bn < tn),
spec AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY tic_id, period_idx ORDER BY power DESC, dur_idx, start) AS rn FROM pow) WHERE rn = 1)"""


def _hist(spark, sf):
    return search.histogram(search.by_star(light_curves(spark, sf)), search.fixed_periods(BLS_PERIODS), BLS_BINS)


def _spectrum(spark, sf):
    return search.spectrum(search.box_power(_hist(spark, sf), BLS_BINS, BLS_DURATIONS))


@query(_HIST + " SELECT * FROM hist")
def bls_histogram(spark, sf):
    return _hist(spark, sf)


@query(_BLS + " SELECT tic_id, period_idx, period, power, dur_idx, start, depth FROM spec")
def bls_power(spark, sf):
    return _spectrum(spark, sf)


# the same with weights: the quality number in the place of an error
_UNITS = "u0 AS (SELECT *, CASE WHEN quality > 0 THEN quality::DOUBLE END AS g FROM lc), u1 AS (SELECT *, coalesce(g, median(g) OVER (PARTITION BY tic_id), 1.0::DOUBLE) AS u FROM u0), u2 AS (SELECT *, round(1 / (u * u) / sum(1 / (u * u)) OVER (PARTITION BY tic_id) * 1000000000)::BIGINT AS w FROM u1), "
_WBLS = (
    _BLS.replace("d0 AS (SELECT tic_id, f, time", _UNITS + "d0 AS (SELECT tic_id, f, w, time").replace("FROM lc),\nhx AS", "FROM u2),\nhx AS")
    .replace("per.period, f, least", "per.period, f, w, least").replace("count(*) AS n, sum(f)::BIGINT AS s", "sum(w)::BIGINT AS n, sum(w * f)::BIGINT AS s")
)


def _weighted(spark, sf):
    lc = clean.weight_units(search.by_star(light_curves(spark, sf)).withColumn("flux_err", F.col("quality").cast("double")))
    return search.histogram(lc, search.fixed_periods(BLS_PERIODS), BLS_BINS, "weight")


@query(_WBLS + " SELECT * FROM hist")
def bls_weighted_histogram(spark, sf):
    """Inverse-variance weights in the bins, as whole numbers that add up to 10**9 by star and period."""
    return _weighted(spark, sf)


@query(_WBLS + " SELECT tic_id, period_idx, period, power, dur_idx, start, depth FROM spec")
def bls_weighted_power(spark, sf):
    return search.spectrum(search.box_power(_weighted(spark, sf), BLS_BINS, BLS_DURATIONS))


_BEST = _BLS + ", best AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY tic_id ORDER BY power DESC, period_idx) AS rn FROM spec) WHERE rn = 1)"


@query(_BEST + " SELECT tic_id, period, power, dur_idx, start, depth FROM best")
def bls_best(spark, sf):
    return search.best_period(_spectrum(spark, sf))


@query(_BEST + " SELECT tic_id, period, period / 2 AS half, period * 2 AS twice, period * 3 AS thrice FROM best")
def harmonics(spark, sf):
    h = search.harmonics(F.col("period"))
    return search.best_period(_spectrum(spark, sf)).select("tic_id", "period", h[0].alias("half"), h[1].alias("twice"), h[2].alias("thrice"))


@query(_BLS + " SELECT tic_id, round((max(power) - median(power)) / stddev_pop(power), 6) AS sde_median FROM spec GROUP BY tic_id")
def sde_median(spark, sf):
    return search.detection_efficiency(_spectrum(spark, sf)).select("tic_id", F.round("sde_median", 6).alias("sde_median"))


@query(_BLS + " SELECT tic_id, round((max(power) - avg(power)) / stddev_pop(power), 6) AS sde_mean FROM spec GROUP BY tic_id")
def sde_mean(spark, sf):
    return search.detection_efficiency(_spectrum(spark, sf)).select("tic_id", F.round("sde_mean", 6).alias("sde_mean"))


@query(_W + f""", per AS (SELECT i::INT AS period_idx, 1.0::DOUBLE + 0.5::DOUBLE * i AS period FROM range(0, {BLS_PERIODS}) r(i)), c AS (SELECT tic_id, time, f - (sum(f) OVER (PARTITION BY tic_id))::BIGINT / count(*) OVER (PARTITION BY tic_id) AS y FROM lc),
x AS (SELECT tic_id, time, y, period_idx, period, 2 * pi() / period AS w FROM c, per), t AS (SELECT tic_id, period_idx, period, w, atan2(sum(sin(2 * w * time)), sum(cos(2 * w * time))) / (2 * w) AS tau FROM x GROUP BY tic_id, period_idx, period, w),
y AS (SELECT x.*, cos(x.w * (time - tau)) AS co, sin(x.w * (time - tau)) AS si FROM x JOIN t USING (tic_id, period_idx))
SELECT tic_id, period_idx, period, round(0.5 * (sum(y * co) * sum(y * co) / sum(co * co) + sum(y * si) * sum(y * si) / sum(si * si)) / (sum(y * y) / count(*)), 5) AS power FROM y GROUP BY tic_id, period_idx, period""")
def lomb_scargle(spark, sf):
    return search.lomb_scargle(light_curves(spark, sf), search.fixed_periods(BLS_PERIODS)).withColumn("power", F.round("power", 5))


@query(_W + """, x AS (SELECT tic_id, us, (f * count(*) OVER (PARTITION BY tic_id) - (sum(f) OVER (PARTITION BY tic_id))::BIGINT)::DOUBLE AS y FROM lc),
n AS (SELECT tic_id, y, row_number() OVER (PARTITION BY tic_id ORDER BY us) AS i FROM x)
SELECT a.tic_id, k::INT AS lag, round(sum(a.y * b.y) / (SELECT sum(z.y * z.y) FROM n z WHERE z.tic_id = a.tic_id), 6) AS acf FROM n a CROSS JOIN range(1, 9) r(k) JOIN n b ON b.tic_id = a.tic_id AND b.i = a.i + k GROUP BY a.tic_id, k""")
def acf_lags(spark, sf):
    return search.autocorrelation(light_curves(spark, sf)).withColumn("acf", F.round("acf", 6))
