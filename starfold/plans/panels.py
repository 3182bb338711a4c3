"""Queries of the views that classifiers take and of a vetting sheet's panels, as tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.functions import columns as X
from starfold.operators import classify, clean, fold
from starfold.plans.curves import FOLD_SQL
from starfold.plans.stars import VETO_SQL, _classified
from starfold.sources.tables import light_curves

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


_FILLED = """, grid AS (SELECT tic_id, unnest(range(0, {n}))::INT AS bin FROM (SELECT DISTINCT tic_id FROM lc)), v AS (SELECT g.tic_id, g.bin, median AS v FROM grid g LEFT JOIN pb USING (tic_id, bin)),
l AS (SELECT *, last_value(v IGNORE NULLS) OVER a AS lv, last_value(CASE WHEN v IS NOT NULL THEN bin END IGNORE NULLS) OVER a AS lb, first_value(v IGNORE NULLS) OVER z AS rv, first_value(CASE WHEN v IS NOT NULL THEN bin END IGNORE NULLS) OVER z AS rb
  FROM v WINDOW a AS (PARTITION BY tic_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY tic_id ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fill AS (SELECT tic_id, bin, coalesce(CASE WHEN lb = rb THEN v ELSE lv + (rv - lv) * (bin - lb) / (rb - lb) END, lv, rv, 0) AS value FROM l),
c AS (SELECT tic_id, bin, value - median(value) OVER (PARTITION BY tic_id) AS value FROM fill), d AS (SELECT *, min(value) OVER (PARTITION BY tic_id) AS low FROM c)
SELECT tic_id, bin, CASE WHEN low < -1e-12 THEN value / abs(low) ELSE value END AS value FROM d"""
_ODD = "((cycle % 2) + 2) % 2 <> 0"


def _view_sql(kind: str, n: int) -> str:
    half = "0.5::DOUBLE" if kind == "global" else f"greatest(least(0.49::DOUBLE, 3.0::DOUBLE * duration / period), {1.0 / n!r}::DOUBLE)"
    phase = "((time - t0) / period - floor((time - t0) / period) - 0.5)" if kind == "secondary" else "phase"
    which = {"odd": _ODD, "even": f"NOT ({_ODD})"}.get(kind, "true")
    return FOLD_SQL + f", w AS (SELECT tic_id, f, {phase} AS ph, {half} AS h FROM fo WHERE {which}), b AS (SELECT tic_id, f, least(floor((ph + h) / (2 * h) * {n}), {n - 1})::INT AS bin FROM w WHERE abs(ph) <= h), pb AS (SELECT tic_id, bin, median(f) AS median FROM b GROUP BY ALL)" + _FILLED.format(n=n)


def _view(spark, sf, kind: str) -> DataFrame:
    return fold.view(light_curves(spark, sf), kind)


for _kind, _n in fold.VIEWS.items():
    QUERIES[f"view_{_kind}"], ORACLE_SQL[f"view_{_kind}"] = partial(_view, kind=_kind), _view_sql(_kind, _n)


def _panel_sql(rows: str, bins: int, more: str = "") -> str:
    return f"SELECT tic_id, bin, any_value(lo) + (bin + 0.5) * ((any_value(hi) - any_value(lo)) / {bins}) AS center, count(*) AS n, sum(f)::BIGINT / count(*) AS mean{more} FROM (SELECT *, least(floor((x - lo) / ((hi - lo) / {bins})), {bins - 1})::INT AS bin FROM (SELECT tic_id, f, x, min(x) OVER (PARTITION BY tic_id) AS lo, max(x) OVER (PARTITION BY tic_id) AS hi FROM ({rows})) WHERE hi > lo) GROUP BY tic_id, bin"


@query(FOLD_SQL + " " + _panel_sql("SELECT tic_id, f, phase AS x FROM fo", 80))
def panel_phase(spark, sf):
    return fold.panel_phase(light_curves(spark, sf))


@query(FOLD_SQL + ", pn AS (" + _panel_sql("SELECT tic_id, f, phase AS x FROM fo", 50) + "), hw AS (SELECT tic_id, 2.5::DOUBLE * max(duration) / max(period) AS half FROM lc GROUP BY tic_id) SELECT pn.* FROM pn JOIN hw USING (tic_id) WHERE abs(center) <= half")
def panel_phase_zoom(spark, sf):
    return fold.panel_phase(light_curves(spark, sf), zoom=True)


def _side_sql(side: str, which: str) -> str:
    return "SELECT * FROM (" + _panel_sql(f"SELECT tic_id, f, phase AS x FROM fo WHERE {which}", 40, f", '{side}' AS side") + ")"


@query(FOLD_SQL + " " + _side_sql("odd", _ODD) + " UNION ALL " + _side_sql("even", f"NOT ({_ODD})"))
def panel_odd_even(spark, sf):
    return fold.panel_odd_even(light_curves(spark, sf))


@query(FOLD_SQL + " " + _panel_sql("SELECT tic_id, f, phase - floor(phase) AS x FROM fo WHERE abs(phase - floor(phase) - 0.5) < 0.15::DOUBLE", 25))
def panel_secondary(spark, sf):
    return fold.panel_secondary(light_curves(spark, sf))


@query(FOLD_SQL + """, r AS (SELECT tic_id, f, least(floor((phase + 0.5) * 60), 59)::INT AS bin, cycle - min(cycle) OVER (PARTITION BY tic_id) AS row, max(cycle) OVER (PARTITION BY tic_id) - min(cycle) OVER (PARTITION BY tic_id) + 1 AS rows_ FROM fo),
g AS (SELECT tic_id, row, bin, sum(f)::BIGINT / count(*) AS mean FROM r WHERE rows_ BETWEEN 2 AND 200 GROUP BY tic_id, row, bin) SELECT tic_id, round(quantile_cont(mean, 0.03), 6) AS low, round(quantile_cont(mean, 0.97), 6) AS high FROM g GROUP BY tic_id""")
def river_range(spark, sf):
    return fold.river_range(fold.river(light_curves(spark, sf))).select("tic_id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(VETO_SQL + ", bars AS (SELECT tic_id, class AS label, unnest(['transit', 'eclipsing_binary', 'blend', 'other']) AS class, unnest([prob_transit, prob_eclipsing_binary, prob_blend, prob_other]) AS probability FROM cl) SELECT tic_id, class, probability, class = label AS chosen FROM bars")
def panel_probabilities(spark, sf):
    return probability_bars(_classified(spark, sf))


@query(VETO_SQL + """, pt AS (SELECT tic_id, 'CLASS' AS line, upper(class) || ' (confidence ' || printf('%.2f', confidence) || ')' AS shown FROM cl UNION ALL SELECT tic_id, 'SNR', coalesce(printf('%.1f', transit_snr), 'n/a') FROM cl
UNION ALL SELECT tic_id, 'FLAGS', coalesce(nullif(concat_ws(', ', CASE WHEN eb_odd_even THEN 'eb_odd_even' END, CASE WHEN eb_secondary THEN 'eb_secondary' END, CASE WHEN eb_vshape THEN 'eb_vshape' END, CASE WHEN blend_contamination THEN 'blend_contamination' END, CASE WHEN other_variability THEN 'other_variability' END, CASE WHEN low_snr THEN 'low_snr' END, CASE WHEN implied_radius_too_big THEN 'implied_radius_too_big' END, CASE WHEN density_inconsistent THEN 'density_inconsistent' END), ''), 'none') FROM cl) SELECT * FROM pt""")
def panel_text(spark, sf):
    return text_lines(_classified(spark, sf))


def probability_bars(rows: DataFrame) -> DataFrame:
    """A bar for each class, and which of them is the row's."""
    bars = F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"prob_{c}").alias("probability")) for c in classify.CLASSES))
    return rows.select("tic_id", F.col("class").alias("label"), F.inline(bars)).select("tic_id", F.col("name").alias("class"), "probability", (F.col("name") == F.col("label")).alias("chosen"))


def text_lines(rows: DataFrame) -> DataFrame:
    """The sheet's summary as (tic_id, line, shown)."""
    from starfold.operators.vetting import FLAGS

    raised = F.concat_ws(", ", *(F.when(F.col(n), n) for n in FLAGS))
    lines = {"CLASS": F.concat(F.upper("class"), F.lit(" (confidence "), X.printed(F.col("confidence"), "%.2f"), F.lit(")")), "SNR": F.coalesce(X.printed(F.col("transit_snr"), "%.1f"), F.lit("n/a")), "FLAGS": F.when(raised == "", "none").otherwise(raised)}
    shown = rows.select("tic_id", *(v.alias(k) for k, v in lines.items()))
    return shown.select("tic_id", F.inline(F.array(*(F.struct(F.lit(k).alias("line"), F.col(k).alias("shown")) for k in lines))))


@query()
def vetting_sheet(spark, sf):
    return sheet(light_curves(spark, sf), _classified(spark, sf))


def sheet(lc: DataFrame, rows: DataFrame) -> DataFrame:
    """All panels of all stars in long form: (tic_id, panel, series, x, y, shown).

    A star that a panel has nothing for is absent from that panel only.  All
    transits are shown, however many: only the queries of single panels end at 200 and 400.
    """
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")

    def part(panel: str, df: DataFrame, series, x, y, shown=text) -> DataFrame:
        return df.select("tic_id", F.lit(panel).alias("panel"), series.cast("string").alias("series"), x.cast("double").alias("x"), y.cast("double").alias("y"), shown.alias("shown"))

    c = F.col
    parts = [
        part("curve", lc, F.lit("points"), c("time"), c("f")), part("curve", fold.epochs(lc, None), F.lit("transits"), c("time"), none),
        part("phase", fold.panel_phase(lc), F.lit("bins"), c("center"), c("mean")), part("phase_zoom", fold.panel_phase(lc, zoom=True), F.lit("bins"), c("center"), c("mean")),
        part("odd_even", fold.panel_odd_even(lc), c("side"), c("center"), c("mean")), part("secondary", fold.panel_secondary(lc), F.lit("bins"), c("center"), c("mean")),
        part("river", fold.river(lc, most=None), c("row"), c("bin"), c("mean")), part("probabilities", probability_bars(rows), c("class"), none, c("probability")), part("text", text_lines(rows), c("line"), none, none, c("shown")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_WEIGHT_SQL = FOLD_SQL + ", q0 AS (SELECT tic_id, us, CASE WHEN quality > 0 THEN quality::DOUBLE END AS g FROM lc), q1 AS (SELECT tic_id, us, coalesce(g, median(g) OVER (PARTITION BY tic_id), 1.0::DOUBLE) AS u FROM q0), q2 AS (SELECT tic_id, us, 1 / (u * u) AS w FROM q1) SELECT tic_id, us, round(w / sum(w) OVER (PARTITION BY tic_id), 9) AS weight FROM q2"


@query(_WEIGHT_SQL)
def inverse_variance_weights(spark, sf):
    """With the quality number in the place of an error."""
    return clean.inverse_variance(light_curves(spark, sf).withColumn("flux_err", F.col("quality").cast("double"))).select("tic_id", "us", F.round("weight", 9).alias("weight"))
