import numpy as np
import pytest
from pyspark.sql import functions as F

from starfold.operators import boosting as B
from starfold.operators import catalog, learn

NAMES = [f"x{i}" for i in range(6)]


def moons(n, seed):
    """Four classes that no single cut tells apart; the last two features say nothing, some values are missing."""
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(int) + 2 * (x[:, 2] ** 2 + x[:, 3] ** 2 > 1.4)
    x[rng.random(x.shape) < 0.02] = np.nan
    return x, y


def frame(spark, x, y):
    rows = [(i, float(c), *[None if np.isnan(v) else float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "tic_id long, y double, " + ", ".join(f"{n} double" for n in NAMES))


def plain(model, x, y, weight, ids, rounds, depth, rate, ridge, least, subsample, features, seed):
    """The same trees by loops over all rows at once, with nothing shared but bins and draws."""
    bins, classes = model.binned(x), model.classes
    margins = np.zeros((len(x), classes))
    for turn in range(rounds):
        keep = B.hashed(ids, seed + turn) < subsample
        p = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
        step = np.zeros_like(margins)
        for c in range(classes):
            allowed = np.argsort(np.random.default_rng((seed, turn, c)).random(x.shape[1]))[: max(1, round(features * x.shape[1]))]
            g = (p[:, c] - (y == c)) * weight
            h = np.maximum(p[:, c] * (1 - p[:, c]), 1e-6) * weight

            def grow(mine, level, c=c, allowed=allowed, g=g, h=h):
                live = mine & keep
                gt, ht = g[live].sum(), h[live].sum()
                if level == depth:
                    step[mine, c] = -rate * gt / (ht + ridge)
                    return
                best = (1e-9, None)
                for f in sorted(allowed.tolist()):
                    for cut in range(B.BINS - 1):
                        left = live & (bins[:, f] <= cut)
                        gl, hl = g[left].sum(), h[left].sum()
                        if hl >= least and ht - hl >= least:
                            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                            if gain > best[0] + 1e-9:
                                best = (gain, (f, cut))
                if best[1] is None:
                    grow(mine, level + 1)
                    return
                f, cut = best[1]
                grow(mine & (bins[:, f] <= cut), level + 1)
                grow(mine & (bins[:, f] > cut), level + 1)

            grow(np.ones(len(x), bool), 0)
        margins += step
    return margins


def test_trees_are_those_of_one_process(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(B, "KEPT", 2)
    x, y = moons(240, 1)
    df = frame(spark, x, y).repartition(5)
    setting = {"rounds": 5, "depth": 2, "rate": 0.3, "ridge": 2.0, "least": 1.0, "subsample": 0.85, "features": 0.7, "seed": 3}
    model = B.fit(df, NAMES, **setting)
    assert len(model.feature) == 5 and model.edges.shape == (6, 31)
    ids = {r["tic_id"]: r["id"] for r in df.select("tic_id", F.xxhash64("tic_id").alias("id")).collect()}
    counts = np.bincount(y, minlength=4)
    want = plain(model, x, y, len(y) / (4 * counts[y]), np.array([ids[i] for i in range(240)]), **setting)
    got = model.margins(model.binned(x))
    assert np.abs(got - want).max() < 1e-5
    other = B.fit(df.repartition(2), NAMES, **setting)
    assert all(np.array_equal(a, b) for a, b in zip(model.value, other.value, strict=True))
    model.save(spark, str(tmp_path / "m"))
    back = B.Trees.load(spark, str(tmp_path / "m"))
    rows = back.applied(df).orderBy("tic_id").collect()
    assert np.allclose([r["proba"] for r in rows], model.proba(x)) and rows[0].asDict().keys() == {*df.columns, "proba"}


def test_boosting_is_no_worse_than_the_forest(spark):
    x, y = moons(1500, 2)
    df = frame(spark, x, y).repartition(4)
    held_out, train = df.filter("tic_id % 4 = 0"), df.filter("tic_id % 4 <> 0")
    boosted = B.fit(train, NAMES, rounds=40, depth=4, rate=0.2).applied(held_out)
    forest = learn.applied(learn.trained(train, NAMES), held_out)

    def f1(scored):
        told = scored.withColumn("p", (F.array_position("proba", F.array_max("proba")) - 1).cast("double"))
        return {r["label"]: r["f1"] for r in catalog.scores(told, "y", "p").collect()}

    a, b = f1(boosted), f1(forest)
    assert all(a[c] >= b[c] for c in range(4)) and min(a.values()) > 0.8, (a, b)


def test_one_class_missing_columns_and_few_rows(spark):
    df = spark.createDataFrame([(i, 1.0, None, float(i)) for i in range(5)], "tic_id long, y double, a double, b double")
    model = B.fit(df, ["a", "b"], classes=2, rounds=3, depth=2)
    p = [r["proba"] for r in model.applied(df).collect()]
    assert all(r[1] > 0.5 and sum(r) == pytest.approx(1) for r in p)
    few = B.out_of_fold(df, ["a", "b"], "tic_id", classes=2, rounds=2, depth=1).collect()
    assert len(few) == 5


def test_weights_broadcast_a_row_a_class_and_never_the_rows(spark, tmp_path):
    """The side of the join that is sent to all is the counts, whatever the rows' size is taken for."""
    spark.range(3000).selectExpr("id", "cast(id % 3 % 2 as double) as y").write.parquet(str(tmp_path / "rows"))
    got = learn.balanced(spark.read.parquet(str(tmp_path / "rows")), "y")
    assert {(r["y"], r["weight"]): r["n"] for r in got.groupBy("y", "weight").agg(F.count("id").alias("n")).collect()} == {(0.0, 0.75): 2000, (1.0, 1.5): 1000}
    joins = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]
    assert joins and all("BuildRight" in line for line in joins)
