"""Stars whose numbers run out: no point in transit, no spread, all points at one instant, no light."""

import math

import pytest

from starfold.operators import catalog, classify, vetting
from starfold.plans.stars import METRIC_SQL
from tests.oracle import DIR, TABLES


def _curve(tic, times, values):
    return [(i, t, tic, "view", v, '{"k": 1}') for i, (t, v) in enumerate(zip(times, values, strict=True))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The tables with events of five stars: period 1.5 d for star 1, its dip at 0.25 d and 0.3 d long."""
    from datetime import datetime, timedelta

    import duckdb

    at = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    out = [0.25 + 1.5 * k + p for k in range(6) for p in (0.2, 0.3, 0.4, 0.6, 0.75, 0.9, 1.2)]
    both = sorted(out + [0.25 + 1.5 * k for k in range(6)])
    flux = lambda n: [50 + (7 * i % 11) / 10 for i in range(n)]
    rows = _curve(1, map(at, out), flux(len(out))) + _curve(8, map(at, both), [50.0 if i % 8 else 40.0 for i in range(len(both))])
    rows += _curve(15, map(at, both), flux(len(both))) + _curve(22, [at(1.0)] * 20, flux(20)) + _curve(29, map(at, both), [0.0] * len(both))
    path = tmp_path_factory.mktemp("sparse")
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    con.sql("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?, ?, ?, ?)", rows)
    for t in TABLES:
        con.sql(f"COPY (SELECT * FROM {'e' if t == 'events' else repr(f'{DIR}/{t}.parquet')}) TO '{path}/{t}.parquet'")
    return str(path)


def _close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and (math.isnan(a) and math.isnan(b) or a == pytest.approx(b, abs=2e-6)))


def test_metrics_of_sparse_stars_are_those_of_sql(spark, folder):
    import duckdb

    from starfold.plans import registry

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    sql = con.sql(registry.ORACLE_SQL["vetting_metrics"])
    want = {r[0]: dict(zip(sql.columns, r, strict=True)) for r in sql.fetchall()}
    got = {r["tic_id"]: r.asDict() for r in registry.QUERIES["vetting_metrics"](spark, folder).collect()}
    assert set(got) == set(want) == {1, 8, 15, 22, 29} and METRIC_SQL
    assert got[1]["depth"] is None and got[1]["primary_significance"] is None and got[8]["primary_significance"] == math.inf
    for tic in (1, 8, 15, 22, 29):
        assert not {k: (got[tic][k], v) for k, v in want[tic].items() if not _close(got[tic][k], v)}, tic


@pytest.mark.parametrize("name", ["primary_significance", "uniqueness", "transit_snr", "mes", "sweet", "rules_scores", "ensemble_veto", "fallback_classifier", "fit_gate", "catalog_rows", "class_counts", "rank_top_k", "training_rows", "features_38"])
def test_queries_on_sparse_stars_end(spark, folder, name):
    from starfold.plans import registry

    assert registry.QUERIES[name](spark, folder).count() > 0


def test_a_catalog_of_sparse_stars_is_whole(spark, folder):
    from starfold.sources.tables import light_curves, stars

    rows = classify.labelled(classify.veto(classify.softmax(classify.rule_scores(vetting.flags(vetting.metrics(light_curves(spark, folder), stars(spark, folder)))))))
    assert sum(r["n"] for r in catalog.class_counts(rows).collect()) == 5


@pytest.mark.parametrize("name", ["catalog_display", "catalog_summary", "dashboard_filter", "panel_probabilities", "panel_text"])
def test_panels_and_catalogs_of_sparse_stars_end(spark, folder, name):
    from starfold.plans import registry

    registry.QUERIES[name](spark, folder).collect()  # the jobs end without an error


def test_learners_take_infinite_features_as_missing(spark):
    import numpy as np

    from starfold.operators import boosting, learn

    odd = [math.inf, -math.inf, math.nan, None]
    rows = spark.createDataFrame([(i, float(i % 2), odd[i] if i < 4 else float(i), float(i % 2)) for i in range(25)], "tic_id long, y double, a double, b double")
    fill = learn.medians(rows, ["a", "b"])
    assert fill == {"a": 14.0, "b": 0.0}
    data = learn.assembled(rows, ["a", "b"], fill)
    assert [r["vector"].toArray().tolist() for r in data.filter("tic_id < 4").orderBy("tic_id").collect()] == [[14.0, i % 2] for i in range(4)]
    assert learn.forest(data, ["a", "b"], trees=3).featureImportances.toArray()[1] > 0.5
    assert learn.applied(learn.trained(rows, ["a", "b"], trees=3), rows).count() == 25
    trees = boosting.fit(rows, ["a", "b"], classes=2, rounds=1, depth=2)
    assert np.isfinite(trees.edges).all() and len(set(trees.binned(np.array([[v, 0.0] for v in (math.inf, -math.inf, math.nan, 14.0)])).T[0].tolist())) == 1


def test_a_forest_on_sparse_stars_ends(spark, tmp_path):
    """Every point of the stars is there six times: the median step is zero, so signals are infinite."""
    import duckdb

    from starfold.plans import registry

    for t in TABLES:
        times = ", range(6)" if t == "events" else ""
        duckdb.connect().sql(f"COPY (SELECT t.* FROM '{DIR}/{t}.parquet' t{times}) TO '{tmp_path}/{t}.parquet'")
    assert registry.QUERIES["forest_importances"](spark, str(tmp_path)).count() == 38


def test_a_sheet_prints_numbers_as_sql_does(spark):
    import duckdb

    from starfold.operators.vetting import FLAGS
    from starfold.plans.panels import text_lines

    ties = [i / 1000 for i in range(5, 1000, 10)]
    snr = [math.inf, -math.inf, math.nan, None, -0.04, *((2 * i + 1) / 20 for i in range(95))]
    flags = ", ".join(f"{f} boolean" for f in FLAGS)
    rows = spark.createDataFrame([(i, "other", c, s, *[False] * len(FLAGS)) for i, (c, s) in enumerate(zip(ties, snr, strict=True))], f"tic_id long, class string, confidence double, transit_snr double, {flags}")
    got = {(r["tic_id"], r["line"]): r["shown"] for r in text_lines(rows).collect()}
    form = lambda f, v: duckdb.connect().execute(f"SELECT printf('{f}', ?::DOUBLE)", [v]).fetchall()[0][0]
    for i, (c, s) in enumerate(zip(ties, snr, strict=True)):
        assert got[i, "CLASS"] == f"OTHER (confidence {form('%.2f', c)})" and got[i, "SNR"] == ("n/a" if s is None else form("%.1f", s)) and got[i, "FLAGS"] == "none"


def test_points_without_a_star_have_no_row(spark, folder, tmp_path):
    import duckdb

    from starfold.plans import registry

    con = duckdb.connect()
    for t in TABLES:
        more = f" UNION ALL SELECT * REPLACE (NULL::BIGINT AS user_id) FROM '{folder}/{t}.parquet' WHERE user_id = 15" if t == "events" else ""
        con.sql(f"COPY (SELECT * FROM '{folder}/{t}.parquet'{more}) TO '{tmp_path}/{t}.parquet'")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    for name in ("primary_significance", "fallback_classifier"):
        want = con.sql(f"SELECT tic_id FROM ({registry.ORACLE_SQL[name]})").fetchall()
        assert sorted(r["tic_id"] for r in registry.QUERIES[name](spark, str(tmp_path)).collect()) == sorted(r[0] for r in want) == [1, 8, 15, 22, 29]
