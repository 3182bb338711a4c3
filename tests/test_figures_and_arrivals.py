import xml.etree.ElementTree as ET
from collections import Counter

import pytest
from pyspark.sql import functions as F

from starfold import config
from starfold.operators import search
from starfold.plans import figures
from starfold.plans.panels import sheet
from starfold.plans.stars import _classified
from starfold.sources import files, synthetic
from starfold.sources.tables import light_curves, saved
from starfold.streaming import arrivals
from tests.oracle import DIR

SVG = "{http://www.w3.org/2000/svg}"


def test_drawings_have_a_mark_for_each_row_of_the_panels(spark):
    panels = saved(sheet(light_curves(spark, DIR), _classified(spark, DIR)), "panels")
    want = {}
    for r in panels.groupBy("tic_id", "panel", F.col("y").isNull().alias("bare")).count().collect():
        want.setdefault(r["tic_id"], Counter())["transit" if r["panel"] == "curve" and r["bare"] else {"river": "cell", "probabilities": "bar", "text": "text"}.get(r["panel"], r["panel"])] += r["count"]
    rows = figures.drawings(panels).collect()
    assert {r["tic_id"] for r in rows} == set(want)
    for r in rows:
        root = ET.fromstring(r["svg"])
        got = Counter(e.get("class") for e in root.iter() if e.get("class"))
        assert got.pop("title") == len(figures.PLACES) and got == want[r["tic_id"]]
        wide, high = float(root.get("width")), float(root.get("height"))
        for e in root.iter(f"{SVG}circle"):
            assert 0 <= float(e.get("cx")) <= wide and 0 <= float(e.get("cy")) <= high
        assert sum(float(e.get("width")) for e in root.iter(f"{SVG}rect") if e.get("class") == "bar") == pytest.approx(figures.WIDE - 2 * figures.MARGIN, abs=0.05)


def test_sheets_show_all_transits(spark):
    lc = spark.range(2000).select(F.lit(1).cast("long").alias("tic_id"), (F.col("id") * 21600000000).alias("us"), (F.col("id") / 4).alias("time"), (100 + F.col("id") % 4).alias("f"), F.lit(1.0).alias("period"), F.lit(0.25).alias("t0"), F.lit(0.3).alias("duration"))
    panels = saved(sheet(lc, _classified(spark, DIR).filter("tic_id = 1")), "panels")
    assert panels.filter("panel = 'river'").select("series").distinct().count() == 501
    assert panels.filter("series = 'transits'").select("x").distinct().count() == 500
    svg = ET.fromstring(figures.drawings(panels).first()["svg"])
    kinds = Counter(e.get("class") for e in svg.iter())
    assert kinds["transit"] == 500 and kinds["cell"] == panels.filter("panel = 'river'").count() == 2000


def test_odd_panels_are_drawn(spark):
    rows = [(1, "text", "FLAGS", None, None, "a < b & c"), (1, "phase", "bins", 1.0, 5.0, None), (1, "phase", "bins", None, 5.0, None), (1, "other", "bins", 1.0, 1.0, None), (2, "text", "SNR", None, None, None)]
    got = {r["tic_id"]: r["svg"] for r in figures.drawings(spark.createDataFrame(rows, "tic_id long, panel string, series string, x double, y double, shown string")).collect()}
    root = ET.fromstring(got[1])
    assert [e.text for e in root.iter(f"{SVG}text") if e.get("class") == "text"] == ["FLAGS: a < b & c"] and len(list(root.iter(f"{SVG}circle"))) == 1 and 2 not in got


def test_grids_by_the_table_function(spark):
    given = spark.createDataFrame([(1, 20.0, 0.0), (2, 1.5, 0.0), (3, None, 0.0), (4, 90.0, 0.0)], "tic_id long, baseline double, start double")
    same = lambda df: sorted(map(tuple, df.collect()))
    assert same(search.period_grid_rows(given)) == same(search.period_grid(given))
    assert same(search.period_grid_rows(given, high=5.0, oversample=400.0)) == same(search.period_grid(given, high=5.0, oversample=400.0))
    long = search.period_grid_rows(given.filter("tic_id = 4"), 0.01, width=0.04, oversample=0.05)
    assert long.agg(F.count(F.lit(1)), F.max("n")).first() == (404955, 404955) or long.count() == long.first()["n"] > 400_000


def test_a_run_that_was_cut_off_goes_on_without_double_rows(spark, tmp_path, monkeypatch):
    lc = synthetic.generate(spark, [("transit", 1), ("variable", 2), ("noise", 3)], 8, 30)
    setting = config.merged(config.Config(), {"search": {"period_min": 0.9, "period_max": 3.5, "coarse": 20.0}})
    rows = {}
    for r in lc.select("tic_id", "time", "flux").collect():
        rows.setdefault(r["tic_id"], []).append(f"{r['time']},{r['flux']}")
    put = lambda star, name: (tmp_path / "in" / name).write_text("time,flux\n" + "\n".join(rows[star]) + "\n")
    (tmp_path / "in").mkdir()
    put(0, "TIC10.csv")
    put(1, "TIC11.csv")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda: arrivals.follow(spark, folder, out, setting).awaitTermination()
    with monkeypatch.context() as m:
        m.setattr(files, "write_manifest", lambda *_: 1 / 0)  # killed between catalog and manifest
        with pytest.raises(Exception, match="division by zero"):
            run()
    assert arrivals.rows(spark, out).count() == 0
    run()
    assert sorted(r["tic_id"] for r in arrivals.rows(spark, out).collect()) == [10, 11]
    put(2, "TIC12.csv")
    put(1, "again-TIC11.csv")
    run()
    run()
    got = arrivals.rows(spark, out).collect()
    assert sorted(r["tic_id"] for r in got) == [10, 11, 12] and all(r["error"] is None for r in got)
    assert arrivals.rows(spark, str(tmp_path / "none")).count() == 0
