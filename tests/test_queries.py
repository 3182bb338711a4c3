import pytest

from starfold.plans import registry
from tests.oracle import DIR, same


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, name):
    same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL) - {"ml_predict", "forest_importances"}))
def test_rows(spark, name):
    df = registry.QUERIES[name](spark, DIR)
    rows = df.collect()
    key = "tic_id" if "tic_id" in df.columns else "query_id"
    assert rows and len({r[key] for r in rows}) > 1 and all(r["class"] for r in rows if name == "ensemble_classes")
    if "error" in df.columns:
        assert all(r["error"] is None for r in rows)


def test_importances(spark):
    rows = registry.QUERIES["forest_importances"](spark, DIR).collect()
    assert len(rows) == 38 and sum(r["importance"] for r in rows) == pytest.approx(1)


def test_box_search_kernel_agrees_with_relations(spark):
    from pyspark.sql import functions as F

    relation = {(r["tic_id"], r["period"]): r for r in registry.QUERIES["bls_power"](spark, DIR).collect()}
    med = {r["tic_id"]: r["med"] for r in registry.QUERIES["robust_std"](spark, DIR).select("tic_id", F.col("med")).collect()}
    better = 0
    for r in registry.QUERIES["bls_kernel"](spark, DIR).collect():
        other = relation[r["tic_id"], r["period"]]
        # the kernel looks for dips only, the relation for any box, in squared units of the median
        assert r["power"] <= other["power"] / med[r["tic_id"]] ** 2 * (1 + 1e-9) + 1e-9
        better += other["depth"] > 0 and abs(r["power"] - other["power"] / med[r["tic_id"]] ** 2) < 1e-6
    assert better > 0


def test_two_stage_search_covers_short_periods(spark, monkeypatch):
    import numpy as np
    from starfold.plans import models

    t = np.sort(np.random.default_rng(1).uniform(0, 30, 200))
    f = np.where(np.abs(((t - 0.4) / 0.73 + 0.5) % 1 - 0.5) * 0.73 < 0.05, 900, 1000)
    lc = spark.createDataFrame([(1, float(a), int(b), 1.0, 0.25, 0.3) for a, b in zip(t, f, strict=True)], "tic_id long, time double, f long, period double, t0 double, duration double")
    monkeypatch.setattr(models, "light_curves", lambda spark, sf: lc)
    r = registry.QUERIES["two_stage_search"](spark, DIR).first()
    assert r["error"] is None and r["n_periods"] > 20_000 and abs(r["period"] - 0.73) < 0.002


def test_long_views_are_filled_in_one_pass(spark):
    import numpy as np
    from starfold.operators import fold

    n, known = 30_001, {7: 1.0, 8: -3.0, 500: 2.5, 29_000: 4.0}
    bins = spark.createDataFrame([(1, b, v) for b, v in known.items()] + [(1, 600, None), (2, 30_001, 1.0)], "tic_id long, bin int, median double")
    filled = fold.filled_view(bins, n, stars=spark.createDataFrame([(1,), (2,), (None,)], "tic_id long"))
    # a frame that ends at the star's last bin is added up again for every row
    assert "unboundedfollowing" not in filled._jdf.queryExecution().executedPlan().toString().lower()
    got = filled.toPandas()
    assert np.allclose(got[got.tic_id == 1].sort_values("bin").value, np.interp(np.arange(n), list(known), list(known.values())), rtol=0, atol=1e-12)
    assert len(got) == 3 * n and not got[got.tic_id != 1].value.any()


def test_views_are_dealt_by_points_not_bytes(spark):
    spread = registry.QUERIES["view_global"](spark, DIR).selectExpr("spark_partition_id() as part").distinct().count()
    assert spread > 2


def test_views_meet_as_arrays(spark):
    from starfold.operators import fold
    from starfold.plans import training
    from starfold.sources.tables import light_curves

    lc = light_curves(spark, DIR)
    rows = training.view_rows(lc, 40, 20)
    # one row a star and view, not one a bin, goes through the last shuffle
    assert "union" not in rows._jdf.queryExecution().executedPlan().toString().lower()
    got = {r["tic_id"]: r["view"] for r in rows.collect()}
    want = {}
    for kind, n in (("global", 40), ("local", 20)):
        for r in fold.view(lc, kind, n).orderBy("tic_id", "bin").collect():
            want.setdefault(r["tic_id"], []).append(r["value"])
    assert got == want and len(got) > 1
