import numpy as np
import pytest

from starfold.operators import catalog, index


def frame(spark, v, first=0):
    return spark.createDataFrame([(first + i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)


@pytest.mark.parametrize("cosine", [False, True])
def test_recall_appending_and_reading_again(spark, tmp_path, cosine):
    rng = np.random.default_rng(0)
    centers = rng.normal(0, 1, (30, 16))
    v = np.float32(centers[rng.integers(0, 30, 1200)] + rng.normal(0, 0.35, (1200, 16)))
    path, all_rows = str(tmp_path / "index"), frame(spark, v)
    index.build(all_rows.filter("vec_id < 900"), path, cosine=cosine)
    kept = index.Index(spark, path)
    assert kept.visits < len(kept.centers) == 30
    kept.add(all_rows.filter("vec_id >= 900"))
    asked = all_rows.filter("vec_id % 20 = 0")
    again = index.Index(spark, path)
    found, exact = again.nearest(asked, 10), again.nearest(asked, 10, exact=True)
    truth = {(r["query_id"], r["rank"]): (r["vec_id"], r["d2"]) for r in catalog.nearest(asked, all_rows, 10, cosine).collect()}
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["d2"]) for r in exact.collect()} == truth
    shares = [r["recall"] for r in index.recall(found, exact).collect()]
    assert len(shares) == 60 and np.mean(shares) >= 0.9
    every = {(r["query_id"], r["rank"]): (r["vec_id"], r["d2"]) for r in again.nearest(asked, 10, visits=30).collect()}
    assert every == truth
    plan = again.lists.filter("cell in (1, 2)")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [In(cell" in plan


def test_large_cells_are_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "VECTOR_BLOCK", 40)
    monkeypatch.setattr(catalog, "QUERY_BLOCK", 7)
    v = np.float32(np.random.default_rng(1).normal(0, 1, (300, 5)))
    v[100:200] = v[0]  # a hot group of copies
    rows, path = frame(spark, v), str(tmp_path / "i")
    index.build(rows, path, cells=4)
    kept = index.Index(spark, path)
    asked = rows.filter("vec_id < 40")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in kept.nearest(asked, 5, visits=4).collect()}
    assert got == {(r["query_id"], r["rank"]): r["vec_id"] for r in catalog.nearest(asked, rows, 5).collect()}


def test_odd_vectors_are_left_out(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (None, [1.0, 1.0]), (5, [float("nan"), 1.0]), (6, [0.0, 0.0])], "vec_id long, embedding array<double>")
    path = str(tmp_path / "i")
    index.build(rows, path, cosine=True)
    kept = index.Index(spark, path)
    assert {r["vec_id"] for r in kept.lists.collect()} == {1, 2, 6} and kept.nearest(rows.filter("vec_id = 1"), 1).first()["vec_id"] == 1
    with pytest.raises(ValueError):
        index.build(rows.limit(0), path)
