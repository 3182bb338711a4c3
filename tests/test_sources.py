import gzip

import numpy as np
import pytest

from starfold.operators import catalog
from starfold.sources import files, fits, synthetic
from starfold.streaming.sessions import point_stream, star_sessions


def test_csv_aliases(spark, tmp_path):
    (tmp_path / "a.csv").write_text("BTJD,PDCSAP_FLUX,tic_id\n1.0,10,7\nx,11,7\n")
    rows = files.read_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [r["time"] for r in rows] == [1.0, None] and rows[0]["flux"] == 10.0 and rows[0]["flux_err"] is None and int(rows[0]["tic_id"]) == 7
    (tmp_path / "b.csv").write_text("day,light\n1,2\n")
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "b.csv"))


def test_csv_files_of_different_headers_and_without_ids(spark, tmp_path):
    (tmp_path / "TIC-12.csv").write_text("time,flux\n1.0,10\n2.0,11\n")
    (tmp_path / "b.csv").write_text("flux,time,flux_err,tic_id\n20,5.0,0.5,TIC 77\n")
    (tmp_path / "c.csv").write_text("day,light\n1,2\n")
    with pytest.warns(UserWarning):
        rows = files.read_csv(spark, str(tmp_path)).orderBy("time").collect()
    assert [(r["tic_id"], r["time"], r["flux"], r["flux_err"]) for r in rows] == [(12, 1.0, 10.0, None), (12, 2.0, 11.0, None), (77, 5.0, 20.0, 0.5)]
    with pytest.raises(FileNotFoundError):
        files.read_csv(spark, str(tmp_path / "none"))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/x.fit").write_bytes(fits_bytes())
    with pytest.warns(UserWarning):
        both = files.read_folder(spark, str(tmp_path))
    assert {r["tic_id"] for r in both.collect()} == {12, 42, 77} and both.filter("tic_id = 42").first()["teff"] == 5700.0


def test_labels_and_archive(spark, tmp_path):
    (tmp_path / "toi.csv").write_text("# a comment\ntid,toi,tfopwg_disp\n5,100.01,PC\nx,1,FP\n")
    rows = files.read_labels(spark, str(tmp_path / "toi.csv")).collect()
    assert [(r["tid"], r["tfopwg_disp"], r["sectors"]) for r in rows] == [(5, "PC", None), (None, "FP", None)]
    with pytest.warns(UserWarning):
        none = files.read_labels(spark, str(tmp_path / "none.csv"), "kepler")
    assert none.count() == 0 and "koi_period" in none.columns
    with pytest.raises(files.DataUnavailable):
        files.read_remote(spark, 1)


def test_bundle_and_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.5, "transit"), (2, None, None)], "tic_id long, period double, class string")
    panels = spark.createDataFrame([(1, "phase", 0.1, 5.0)], "tic_id long, panel string, x double, y double")
    out = str(tmp_path / "run")
    back = {r["tic_id"]: r for r in files.write_bundle(rows, panels, out).collect()}
    assert back[1]["panel_path"] == f"{out}/panels" and back[2]["panel_path"] is None
    assert [r["tic_id"] for r in files.read_manifest(spark, f"{out}/manifest").orderBy("tic_id").collect()] == ["1", "2"]
    assert files.read_manifest(spark, str(tmp_path / "none")).count() == 0 and spark.read.text(f"{out}/sidecars").count() == 2
    files.write_curves(spark.createDataFrame([(3, 2.0, 1.0), (3, 1.0, 0.5)], "tic_id long, time double, f double"), str(tmp_path / "lc"))
    got = spark.read.option("header", True).csv(str(tmp_path / "lc"))
    assert got.columns == ["tic_id", "time", "flux", "flux_err"] and [r["time"] for r in got.collect()] == ["1.0", "2.0"]
    back = files.read_csv(spark, str(tmp_path / "lc"))
    assert {(r["tic_id"], r["time"], r["flux"]) for r in back.collect()} == {(3, 1.0, 0.5), (3, 2.0, 1.0)}


def test_ids_of_archive_files(spark, tmp_path):
    names = {
        "tess2018206045859-s0001-0000000038846515-0120-s_lc.csv": 38846515, "tess2018206045859-s0001-0000000038846999-0120-s_lc.csv": 38846999, "TIC 0077_s12_2019.csv": 77, "tic_5.csv": 5,
        "kplr011904151-2009131105131_llc.csv": 11904151, "sector12-2018206045859.csv": None, "curve7.csv": None,
    }
    for i, name in enumerate(names):
        (tmp_path / name).write_text(f"time,flux\n{i}.0,1\n")
    got = {int(r["time"]): r["tic_id"] for r in files.read_csv(spark, str(tmp_path)).collect()}
    assert all(got[i] == n for i, n in enumerate(names.values()) if n is not None)
    assert len(set(got.values())) == len(names) and all(abs(got[i]) > 10**12 for i, n in enumerate(names.values()) if n is None)


def card(k, v):
    return f"{k:<8}= {v:>20}".ljust(80)


def fits_bytes():
    head = "".join([card("SIMPLE", "T"), card("BITPIX", "8"), card("NAXIS", "0"), card("TICID", "42"), card("TEFF", "5700.0"), "END".ljust(80)]).ljust(2880)
    table = np.zeros(5, np.dtype([("TIME", ">f8"), ("PDCSAP_FLUX", ">f4"), ("QUALITY", ">i4")]))
    table["TIME"], table["PDCSAP_FLUX"], table["QUALITY"] = np.arange(5), 2.5, [0, 0, 32, 0, 0]
    cards = [card("XTENSION", "'BINTABLE'"), card("BITPIX", "8"), card("NAXIS", "2"), card("NAXIS1", "16"), card("NAXIS2", "5"), card("PCOUNT", "0"), card("GCOUNT", "1"), card("TFIELDS", "3")]
    for i, (n, f) in enumerate((("TIME", "D"), ("PDCSAP_FLUX", "E"), ("QUALITY", "J")), 1):
        cards += [card(f"TTYPE{i}", f"'{n}'"), card(f"TFORM{i}", f"'{f}'")]
    body = table.tobytes()
    return (head + "".join([*cards, "END".ljust(80)]).ljust(2880)).encode() + body + b"\0" * (-len(body) % 2880)


def test_fits(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/a.fits").write_bytes(fits_bytes())
    (tmp_path / "b.fits").write_bytes(b"broken")
    rows = files.read_fits(spark, str(tmp_path)).collect()
    good = [r for r in rows if r["error"] is None]
    assert len(good) == 5 and {r["tic_id"] for r in good} == {42} and sum(r["quality"] for r in good) == 32 and len(rows) == 6


def rice_bytes(values, size, block=32):
    """The Rice code by the book: for each block the shortest of all codes."""
    bits, unpacked, wide = fits.RICE[size]
    mask, out, last = (1 << wide) - 1, "", int(values[0]) & (1 << wide) - 1
    out += format(last, f"0{wide}b")
    for k in range(0, len(values), block):
        diffs = []
        for v in values[k : k + block]:
            d = ((int(v) & mask) - last + (1 << wide - 1) & mask) - (1 << wide - 1)
            diffs.append(d << 1 if d >= 0 else ~(d << 1))
            last = int(v) & mask
        diffs = [d & mask for d in diffs]
        plain = format(unpacked + 1, f"0{bits}b") + "".join(format(d, f"0{wide}b") for d in diffs)
        coded = ["0" * bits] if not any(diffs) else []
        for code in range(unpacked):
            if max(d >> code for d in diffs) < 200:
                coded.append(format(code + 1, f"0{bits}b") + "".join("0" * (d >> code) + "1" + (format(d & (1 << code) - 1, f"0{code}b") if code else "") for d in diffs))
        out += min([plain, *coded], key=len)
    out += "0" * (-len(out) % 8)
    return int(out, 2).to_bytes(len(out) // 8, "big")


@pytest.mark.parametrize("size", [1, 2, 4])
def test_rice_code(size):
    rng = np.random.default_rng(size)
    top = 1 << 8 * size - 1
    for values in (rng.integers(-9, 9, 100), np.zeros(70, int), rng.integers(-top, top, 40), np.array([5]), np.cumsum(rng.integers(-3, 4, 200))):
        values = values % 256 if size == 1 else np.clip(values, -top, top - 1)
        assert np.array_equal(fits.rice(rice_bytes(values, size), len(values), size), values)


def packed_fits(table, per=7):
    """The table as tiles of ``per`` rows: times shuffled and zipped, errors as they are, fluxes zipped, flags by Rice."""
    how = {"TIME": "GZIP_2", "PDCSAP_FLUX": "GZIP_1", "PDCSAP_FLUX_ERR": "NOCOMPRESS", "QUALITY": "RICE_1"}
    heap, heads = b"", []
    for k in range(0, len(table), per):
        for name, kind in how.items():
            x = np.ascontiguousarray(table[name][k : k + per])
            raw = x.tobytes()
            if kind == "GZIP_2":
                raw = np.frombuffer(raw, np.uint8).reshape(len(x), -1).T.tobytes()
            one = rice_bytes(x, 4) if kind == "RICE_1" else raw if kind == "NOCOMPRESS" else gzip.compress(raw)
            heads.append((len(one), len(heap)))
            heap += one
    n = -(-len(table) // per)
    head = "".join([card("SIMPLE", "T"), card("BITPIX", "8"), card("NAXIS", "0"), card("TICID", "43"), "END".ljust(80)]).ljust(2880)
    cards = [card("XTENSION", "'BINTABLE'"), card("BITPIX", "8"), card("NAXIS", "2"), card("NAXIS1", str(8 * len(how))), card("NAXIS2", str(n)), card("PCOUNT", str(len(heap))), card("GCOUNT", "1"), card("TFIELDS", str(len(how))), card("ZTABLE", "T"), card("ZTILELEN", str(per)), card("ZNAXIS1", str(table.dtype.itemsize)), card("ZNAXIS2", str(len(table)))]
    for i, (name, kind) in enumerate(how.items(), 1):
        cards += [card(f"TTYPE{i}", f"'{name}'"), card(f"TFORM{i}", "'1PB'"), card(f"ZFORM{i}", f"'{ {'>f8': 'D', '>f4': 'E', '>i4': 'J'}[table.dtype[name].str] }'"), card(f"ZCTYP{i}", f"'{kind}'")]
    text = "".join([*cards, "END".ljust(80)])
    body = np.array(heads, ">i4").tobytes() + heap
    return (head + text.ljust(-(-len(text) // 2880) * 2880)).encode() + body + b"\0" * (-len(body) % 2880)


def plain_fits(table):
    forms = {">f8": "D", ">f4": "E", ">i4": "J"}
    head = "".join([card("SIMPLE", "T"), card("BITPIX", "8"), card("NAXIS", "0"), card("TICID", "43"), "END".ljust(80)]).ljust(2880)
    cards = [card("XTENSION", "'BINTABLE'"), card("BITPIX", "8"), card("NAXIS", "2"), card("NAXIS1", str(table.dtype.itemsize)), card("NAXIS2", str(len(table))), card("PCOUNT", "0"), card("GCOUNT", "1"), card("TFIELDS", str(len(table.dtype.names)))]
    for i, n in enumerate(table.dtype.names, 1):
        cards += [card(f"TTYPE{i}", f"'{n}'"), card(f"TFORM{i}", f"'{forms[table.dtype[n].str]}'")]
    body = table.tobytes()
    return (head + "".join([*cards, "END".ljust(80)]).ljust(2880)).encode() + body + b"\0" * (-len(body) % 2880)


def test_tables_packed_by_tiles_and_the_data_source(spark, tmp_path):
    rng = np.random.default_rng(0)
    table = np.zeros(60, np.dtype([("TIME", ">f8"), ("PDCSAP_FLUX", ">f4"), ("PDCSAP_FLUX_ERR", ">f4"), ("QUALITY", ">i4")]))
    table["TIME"], table["PDCSAP_FLUX"], table["PDCSAP_FLUX_ERR"], table["QUALITY"] = np.cumsum(rng.random(60)), rng.normal(1000, 3, 60), 3.0, rng.integers(-5, 5000, 60)
    (tmp_path / "a").mkdir()
    (tmp_path / "a/plain.fits").write_bytes(plain_fits(table))
    (tmp_path / "a/packed.fits.fz").write_bytes(packed_fits(table))
    (tmp_path / "zipped.fits.gz").write_bytes(gzip.compress(plain_fits(table)))
    (tmp_path / "bad.fz").write_bytes(packed_fits(table)[:-3000])
    fits.register(spark)
    by_source, by_files = spark.read.format("fits_curves").load(str(tmp_path)), files.read_fits(spark, str(tmp_path))
    for df in (by_source, by_files):
        rows = {}
        for r in df.collect():
            rows.setdefault(r["source_path"].rsplit("/")[-1], []).append((r["tic_id"], r["time"], r["flux"], r["flux_err"], r["quality"]) if r["error"] is None else r["error"])
        assert set(rows) == {"plain.fits", "packed.fits.fz", "zipped.fits.gz", "bad.fz"} and len(rows["bad.fz"]) == 1 and isinstance(rows["bad.fz"][0], str)
        assert rows["plain.fits"] == rows["packed.fits.fz"] == rows["zipped.fits.gz"] and [x[1] for x in rows["plain.fits"]] == table["TIME"].tolist()
    assert by_source.rdd.getNumPartitions() == 4
    few = spark.read.format("fits_curves").option("columns", "tic_id, time").load(f"file://{tmp_path}/a/packed.fits.fz")
    assert few.columns == ["tic_id", "time"] and few.count() == 60


@pytest.mark.parametrize("kind", ["csv", "json", "parquet"])
def test_catalog_round_trip(spark, tmp_path, kind):
    rows = spark.createDataFrame([(1, 2.5, "transit", "x"), (2, None, None, "y")], "tic_id long, period double, class string, extra string")
    files.write_catalog(rows, str(tmp_path / "c"), kind)
    back = files.read_catalog(spark, str(tmp_path / "c"), kind).orderBy("tic_id").collect()
    assert [r["period"] for r in back] == [2.5, None] and [r["class"] for r in back] == ["transit", ""] and back[0]["flag_is_eb"] is False
    assert list(back[0].asDict())[: len(catalog.COLUMNS)] == list(catalog.COLUMNS) and back[1]["extra"] == "y"
    with pytest.raises(ValueError):
        files.write_catalog(rows, str(tmp_path / "d"), "xml")


def test_ids_markdown_and_manifest(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(" TIC 12 ",), ("tic7",), ("none",), (None,)], "x string").select(files.tic_number(F.col("x")).alias("n")).collect()
    assert [r["n"] for r in rows] == [12, 7, None, None]
    assert files.markdown(spark.createDataFrame([(1, 0.5)], "a int, b double")).split("\n")[2] == "| 1 | 0.5 |"
    done = spark.createDataFrame([("1",)], "tic_id string")
    left = catalog.pending(spark.createDataFrame([(1,), (2,), (None,)], "tic_id long"), done).collect()
    assert sorted((r["tic_id"] or 0) for r in left) == [0, 2]


def test_generator_runs_on_executors(spark):
    df = synthetic.generate(spark, [("transit", 1), ("noise", 2)], 3, 20)
    assert {r["kind"] for r in df.select("kind").distinct().collect()} == {"transit", "noise"}


def test_stream_sessions_match_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = star_sessions(point_stream(spark, str(tmp_path / "in"), src.schema)).writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got, want = spark.table("sessions").count(), star_sessions(src).count()
    assert 0 < got <= want
