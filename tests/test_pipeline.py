import pytest
from pyspark.sql import functions as F

from starfold import config
from starfold.operators import catalog, classify
from starfold.plans import pipeline
from starfold.sources import synthetic


def test_every_kind_gives_a_row_and_a_report(spark):
    stars = [("transit", 1), ("eclipsing_binary", 2), ("blend", 3), ("variable", 4), ("noise", 5), ("transit", 6)]
    lc = synthetic.generate(spark, stars, 12, 15).withColumn("f", F.col("flux").cast("double"))
    short = spark.createDataFrame([(99, 1.0, 1.0), (99, 2.0, 1.0)], "tic_id long, time double, f double")
    attributes = lc.select("tic_id", "crowdsap", F.lit(1.0).alias("radius"), F.lit(1.0).alias("mass")).distinct()
    setting = config.merged(config.Config(), {"search": {"period_min": 0.8, "period_max": 6, "coarse": 8.0}, "unknown": 1})
    rows = pipeline.process(lc.select("tic_id", "time", "f").unionByName(short), attributes, setting).cache()
    got = {r["tic_id"]: r for r in rows.collect()}
    assert len(got) == 7 and got[99]["error"] and list(rows.columns)[: len(catalog.COLUMNS)] == list(catalog.COLUMNS)
    for i in range(6):
        assert got[i]["error"] is None and got[i]["class"] in classify.CLASSES and sum(got[i][f"prob_{c}"] for c in classify.CLASSES) == pytest.approx(1)
    assert got[1]["class"] == "eclipsing_binary" and got[2]["class"] == "blend"
    assert "## Classes" in pipeline.report(rows)
    fits = [r for r in got.values() if r["fit_method"] == "trapezoid"]
    assert fits and all(r["delta_bic"] is not None and r["depth_err_lo"] >= 0 and r["t0_err_hi"] is not None and r["period_err_lo"] is None for r in fits)
    assert all(got[i]["fit_method"] == "" for i in got if got[i]["class"] == "blend" and got[i]["snr"] is None)
    with_samples = config.merged(setting, {"fit": {"posterior": True, "steps": 60}})
    one = pipeline.fitted(lc.filter("tic_id = 0"), rows.filter("tic_id = 0"), with_samples).first()
    assert one["fit_method"] == "posterior" and one["fit_a_rs"] > 0 and one["fit_period_err_lo"] is not None


def test_models_are_kept(spark, tmp_path):
    from starfold.operators import learn

    rows = spark.createDataFrame([(i, float(i % 2), float(i % 2) + 0.01 * i, None if i == 3 else 1.0) for i in range(40)], "tic_id long, y double, a double, b double")
    names = ["a", "b"]
    data = learn.assembled(rows, names, learn.medians(rows, names))
    model = learn.forest(data, names, trees=5)
    learn.save({"ml": model}, str(tmp_path / "m"))
    with pytest.warns(UserWarning):
        back = learn.load(str(tmp_path / "m"))
    assert list(back) == ["ml"] and back["ml"].transform(data).filter("prediction <> y").count() == 0
    few = learn.calibrated(learn.out_of_fold(rows.limit(9), names, "tic_id", trees=3), "y", 2).collect()
    assert len(few) == 9 and all(r["cal_0"] + r["cal_1"] == pytest.approx(1) for r in few)


def test_config(tmp_path):
    c = config.merged(config.Config(), {"seed": 7, "search": {"period_min": 2}, "other": {}})
    assert c.seed == 7 and c.search.period_min == 2.0 and c.search.period_max == 15.0
    (tmp_path / "c.yaml").write_text("fit:\n  min_snr: 9\n")
    assert config.load(str(tmp_path / "c.yaml")).fit.min_snr == 9.0
    with pytest.warns(UserWarning):
        assert config.load(str(tmp_path / "none.yaml")) == config.Config()


def test_ensemble_weights(spark):
    p = {c: F.lit(v) for c, v in zip(classify.CLASSES, (0.7, 0.1, 0.1, 0.1), strict=True)}
    q = {c: F.lit(v) for c, v in zip(classify.CLASSES, (0.1, 0.7, 0.1, 0.1), strict=True)}
    none = {c: F.lit(None).cast("double") for c in classify.CLASSES}
    row = spark.range(1).select(*(v.alias(k) for k, v in classify.mixed({"rules": p, "ml": q, "cnn": none}).items())).first()
    assert row["transit"] == pytest.approx((0.25 * 0.7 + 0.1) / 1.25) and sum(row) == pytest.approx(1)


def test_errors_reach_search_and_fit(spark):
    """Every fifth point is worthless and says so: with its errors the dip is found and measured, without them it is not."""
    import numpy as np

    rng = np.random.default_rng(5)
    t = np.arange(0, 16, 0.02)
    f = np.where(np.abs(((t - 1) / 3.3 + 0.5) % 1 - 0.5) * 3.3 < 0.08, 0.997, 1.0) + rng.normal(0, 4e-4, len(t))
    err = np.full(len(t), 4e-4)
    bad = np.arange(0, len(t), 5)
    f[bad] += rng.normal(0, 0.03, len(bad))
    err[bad] = 0.03
    lc = spark.createDataFrame([(1, float(a), float(b), float(c)) for a, b, c in zip(t, f, err, strict=True)], "tic_id long, time double, f double, err double")
    setting = config.merged(config.Config(), {"detrend": {"method": "none"}, "search": {"period_min": 0.8, "period_max": 7.0}})
    given, plain = (pipeline.process(x, config=setting).first() for x in (lc, lc.drop("err")))
    assert given["period"] == pytest.approx(3.3, rel=0.01) and given["error"] is None
    assert abs(plain["period"] / 3.3 - 1) > 0.01 or plain["depth"] > 1.5 * given["depth"]
    flat = pipeline.flat_curves(lc, config.merged(setting, {"detrend": {"method": "gp"}}))
    assert flat.filter("err > 0.02").count() > 100


def test_training_and_a_run_with_its_model(spark, tmp_path, monkeypatch):
    from starfold import cli
    from starfold.operators import learn
    from starfold.sources import files

    kinds = [k for _ in range(3) for k in ("transit", "eclipsing_binary", "blend", "variable")]
    lc = synthetic.generate(spark, [(k, i) for i, k in enumerate(kinds)], 10, 30)
    files.write_curves(lc, str(tmp_path / "in"))
    rows = [f"TIC {r['tic_id']},{r['label']}" for r in lc.select("tic_id", "label").distinct().collect()]
    (tmp_path / "labels.csv").write_text("tic_id,label\n" + "\n".join(rows) + "\n")
    (tmp_path / "c.yaml").write_text("search:\n  period_min: 0.8\n  period_max: 4\n  coarse: 12\n")
    monkeypatch.setattr(cli, "session", lambda: spark)
    same = ["--input", str(tmp_path / "in"), "--config", str(tmp_path / "c.yaml")]
    assert cli.main(["train", *same, "--labels", str(tmp_path / "labels.csv"), "--rounds", "3", "--steps", "2", "--filters", "2", "--out", str(tmp_path / "models")]) == 0
    assert set(learn.load(str(tmp_path / "models"))) == {"ml", "cnn"}
    assert cli.main(["train", *same, "--labels", str(tmp_path / "labels.csv"), "--learner", "forest", "--out", str(tmp_path / "forest")]) == 0
    assert set(learn.load(str(tmp_path / "forest"), ("ml",))) == {"ml"}
    assert cli.main(["run", *same, "--models", str(tmp_path / "models"), "--out", str(tmp_path / "out")]) == 0
    got = files.read_catalog(spark, str(tmp_path / "out/catalog")).collect()
    assert len(got) == len(kinds) and {r["classify_method"] for r in got} == {"ensemble"}
    assert all(sum(r[f"prob_{c}"] for c in classify.CLASSES) == pytest.approx(1) for r in got)
    with pytest.warns(UserWarning):  # the forest's folder has no network
        assert cli.main(["run", *same, "--models", str(tmp_path / "forest"), "--out", str(tmp_path / "out2")]) == 0
    other = {r["tic_id"]: r["prob_transit"] for r in files.read_catalog(spark, str(tmp_path / "out2/catalog")).collect()}
    assert any(abs(other[r["tic_id"]] - r["prob_transit"]) > 1e-6 for r in got)
    assert cli.main(["run", "--input", str(tmp_path / "none"), "--out", str(tmp_path / "x")]) == 2


def test_stars_are_vetted_together_as_alone(monkeypatch):
    """One fit of trapezoids for all stars of a bundle; a star without duration has none."""
    import numpy as np

    from starfold.operators import kernels

    rng = np.random.default_rng(3)
    curves = []
    for i, n in enumerate((40, 71, 55, 66)):
        t = np.sort(rng.uniform(0, 27, n))
        curves.append((t, rng.normal(1, 0.01, n), {"period": 1.3 + i, "t0": 0.4, "duration": 0.0 if i == 2 else 0.22, "depth": 0.02, "sde": 5.0, "snr": 8.0}))
    alone = [pipeline.vetted(*c) for c in curves]
    calls = []
    monkeypatch.setattr(kernels, "fit_trapezoids", lambda *a, f=kernels.fit_trapezoids: calls.append(len(a[0])) or f(*a))
    together = pipeline.vetted_stars(curves)
    assert calls == [3] and np.isnan(together[2]["v_shape_metric"])
    for a, b in zip(alone, together, strict=True):
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], rtol=1e-6, atol=0, equal_nan=True) for k in a)
