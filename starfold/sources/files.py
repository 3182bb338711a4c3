"""Light-curve files: CSV by column aliases, FITS binary tables, and the catalog's readers and writers."""

from __future__ import annotations

import gzip
import warnings

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.operators import clean
from starfold.operators.catalog import conform
from starfold.sources import fits

#: Names under which files carry a column, in order of preference.
ALIASES = {
    "time": ("time", "bjd", "btjd", "bkjd", "jd", "t"),
    "flux": ("flux", "pdcsap_flux", "sap_flux", "norm_flux", "f"),
    "flux_err": ("flux_err", "pdcsap_flux_err", "sap_flux_err", "err", "ferr"),
}
META = ("tic_id", "sector", "tmag", "teff", "radius", "crowdsap")
#: Names under which headers carry metadata, in order of preference.
HEADERS = {"tic_id": ("TICID", "TARGETID", "KEPLERID"), "sector": ("SECTOR", "QUARTER", "CAMPAIGN"), "tmag": ("TESSMAG", "TMAG", "KEPMAG"), "teff": ("TEFF",), "radius": ("RADIUS",), "crowdsap": ("CROWDSAP",), "ra": ("RA_OBJ", "RA"), "dec": ("DEC_OBJ", "DEC")}


def alias(columns: list[str], kind: str) -> str | None:
    low = {c.lower(): c for c in reversed(columns)}
    return next((low[a] for a in ALIASES[kind] if a in low), None)


def tic_number(c: Column) -> Column:
    """Digits of an id with or without its prefix; null if there are none."""
    return F.regexp_replace(F.upper(F.trim(c)), r"^TIC\s*", "").try_cast("bigint")


#: How names of archive files carry a star's number: after TIC, as 16 digits, or as nine after kplr or ktwo.
STAR_NUMBER = r"(?i)tic[ _-]*0*(\d+)|(?<!\d)(\d{16})(?!\d)|(?:kplr|ktwo)0*(\d+)"


def plain_name(c: Column) -> Column:
    """A path or name of ``_metadata`` without its escapes, in which a plus is a plus."""
    return F.url_decode(F.regexp_replace(c, r"\+", "%2B"))


def star_number(file_name: Column) -> Column:
    """The star's number in a file's name, null if it has none; other digits are dates, sectors or versions."""
    found = [F.regexp_extract(file_name, STAR_NUMBER, k) for k in (1, 2, 3)]
    return F.coalesce(*(F.when(x != "", x) for x in found)).try_cast("bigint")


class DataUnavailable(RuntimeError):
    """Data that would have to come over a network."""


def read_remote(spark: SparkSession, tic_id: int, sector: int | None = None) -> DataFrame:
    """The interface of an archive's reader; without a network every call fails in the one way callers handle."""
    raise DataUnavailable(f"TIC {tic_id}, sector {sector}: no archive can be reached")


#: The columns of the two label tables.
LABELS = {
    "tess": "tid long, toi double, tfopwg_disp string, pl_orbper double, pl_tranmid double, pl_trandurh double, pl_trandep double, sectors string",
    "kepler": "kepid long, kepoi_name string, koi_disposition string, koi_period double, koi_time0bk double, koi_duration double, koi_depth double, koi_prad double, koi_model_snr double, ra double, dec double",
}


def read_labels(spark: SparkSession, path: str, mission: str = "tess") -> DataFrame:
    """A snapshot of a label table; an empty table of its columns, with a warning, if it can't be read."""
    fields = [f.strip().split() for f in LABELS[mission].split(",")]
    try:
        raw = spark.read.option("header", True).option("comment", "#").csv(path)
        return raw.select(*((F.expr(f"try_cast(`{n}` as {kind})") if n in raw.columns else F.lit(None).cast(kind)).alias(n) for n, kind in fields))
    except Exception as e:  # noqa: BLE001
        warnings.warn(f"no labels: {type(e).__name__}", stacklevel=2)
        return spark.createDataFrame([], LABELS[mission])


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """time, flux, flux_err, metadata of ``META`` and source_path of one file or all in a folder.

    Files may differ in their columns and the order of them: those of one header
    are read together, by their own names.  A file without id takes the star's
    number in its name (see ``star_number``), or a hash of its path.  Files without time or flux are left out
    with a warning; if no other is there, that is an error.
    """
    try:
        lines = spark.read.text(path).select("value", plain_name(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
        heads = lines.filter("block = 0").groupBy("path").agg(F.min_by("value", "at").alias("head"))
        kinds = heads.groupBy("head").agg(F.collect_list("path").alias("paths")).orderBy("head").collect()  # paths, which Spark lists on the driver anyway
    except AnalysisException as e:
        raise FileNotFoundError(str(path)) from e
    out, bad = None, []
    for kind in kinds:
        raw = spark.read.option("header", True).csv(kind["paths"])
        found = {k: alias(raw.columns, k) for k in ALIASES}
        if not found["time"] or not found["flux"]:
            bad.append(f"{kind['paths'][0]}: no column for time or flux among {', '.join(raw.columns)}")
            continue
        number = lambda c, to="double": F.expr(f"try_cast(`{c}` as {to})") if c else F.lit(None).cast(to)
        low = {c.lower(): c for c in raw.columns}
        given = tic_number(F.col(f"`{low['tic_id']}`")) if "tic_id" in low else F.lit(None).cast("long")
        part = raw.select(
            number(found["time"]).alias("time"), number(found["flux"]).cast("float").alias("flux"), number(found["flux_err"]).cast("float").alias("flux_err"),
            F.coalesce(given, star_number(plain_name(F.col("_metadata.file_name"))), F.xxhash64("_metadata.file_path")).alias("tic_id"), *(number(low.get(m)).alias(m) for m in META if m != "tic_id"), F.col("_metadata.file_path").alias("source_path"),
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("; ".join(bad) or f"{path}: no light curves")
    for message in bad:
        warnings.warn(message, stacklevel=2)
    return out


def read_folder(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every light curve of a folder, or of a list of files: FITS at any depth and CSV beside it, as time, flux, flux_err, quality, metadata, source_path, error."""
    import itertools

    if isinstance(path, str):
        tables, binaries = path if path.endswith(".csv") else f"{path.rstrip('/')}/*.csv", path
    else:
        tables, binaries = [p for p in path if p.endswith(".csv")], [p for p in path if not p.endswith(".csv")]
    parts = []
    for reader, which in ((read_fits, binaries), (read_csv, tables)):
        try:
            if which:
                parts.append(reader(spark, which))
        except (FileNotFoundError, ValueError, AnalysisException) as e:
            message = str(e).split("\n")[0]
            if not isinstance(e, FileNotFoundError):
                warnings.warn(message, stacklevel=2)
    if not parts:
        raise ValueError(f"{path}: no light curves")
    return list(itertools.accumulate(parts, lambda a, b: a.unionByName(b, allowMissingColumns=True)))[-1]


def curves(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(tic_id, time, f, err) of all good points under a path or of a list of files, and the stars' attributes.

    ValueError or OSError if there are none.
    """
    raw = read_folder(spark, path)
    if "error" in raw.columns:
        raw = raw.filter("error is null")
    lc = clean.finite_points(raw.withColumns({"f": F.col("flux").cast("double"), "err": F.coalesce(F.col("flux_err").cast("double"), F.lit(float("nan")))}))
    if "quality" in lc.columns:
        lc = lc.filter("coalesce(quality, 0) = 0")
    names = ("crowdsap", "radius", "mass", "teff", "tmag")
    known = lc.groupBy("tic_id").agg(*((F.max(F.col(c).cast("double")) if c in lc.columns else F.lit(None).cast("double")).alias(c) for c in names))
    return lc.select("tic_id", "time", "f", "err"), known


def harvested(header: dict[str, object]) -> dict[str, float | None]:
    """Of each of ``HEADERS`` the first name that has a number."""
    def first(names: tuple[str, ...]) -> float | None:
        for n in names:
            try:
                v = float(str(header[n]))
                if v == v:
                    return v
            except (KeyError, ValueError):
                continue
        return None

    return {k: first(names) for k, names in HEADERS.items()}


FITS = "source_path string, tic_id long, sector int, tmag double, teff double, radius double, crowdsap double, ra double, dec double, time double, flux float, flux_err float, quality int, error string"


def curve_of(name: str, raw: bytes, flux_column: str = "PDCSAP_FLUX") -> pd.DataFrame:
    """The rows of ``FITS`` of one file; a broken one gives one row with its error.

    Without the named flux the first known alias counts; errors are those of the
    column with ``_err`` after its name.
    """
    try:
        header, cols = fits.decoded(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
        low = {k.lower(): v for k, v in cols.items()}
        own = flux_column.lower() if flux_column.lower() in low else alias(list(low), "flux")
        meta = harvested(header)
        flux = low[own]
        meta |= {k: None if meta[k] is None else int(meta[k]) for k in ("tic_id", "sector")}
        out = pd.DataFrame({"source_path": name, **meta, "time": low[alias(list(low), "time")].astype(float), "flux": flux.astype(np.float32), "flux_err": low.get(f"{own}_err", np.full(len(flux), np.nan)).astype(np.float32), "quality": low.get("quality", np.zeros(len(flux))).astype(int), "error": None})
    except Exception as e:  # noqa: BLE001
        out = pd.DataFrame({"source_path": [name], "error": [f"{type(e).__name__}: {e}"]})
    return out.reindex(columns=[f.strip().split()[0] for f in FITS.split(",")])


def read_fits(spark: SparkSession, path: str | list[str], flux_column: str = "PDCSAP_FLUX") -> DataFrame:
    """``FITS`` of the binary tables under ``path``, plain, gzipped or compressed by tiles; see ``curve_of``."""
    def run(frames):
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"], strict=True):
                yield curve_of(name, bytes(raw), flux_column)

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{fits,fit,fz,fits.gz,fit.gz}").load(path)
    return found.select("path", "content").mapInPandas(run, FITS)


def write_catalog(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """csv, json or parquet; of the canonical columns in order, then extras."""
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"unknown format {kind}")
    out = conform(rows).write.mode("overwrite")
    (out.option("header", True).csv if kind == "csv" else getattr(out, kind))(path)


def read_catalog(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    raw = spark.read.option("header", True).csv(path) if kind == "csv" else getattr(spark.read, kind)(path)
    return conform(raw)


def write_sidecars(rows: DataFrame, path: str) -> None:
    """One JSON text per candidate, a line each, in files dealt by id: a folder per star would not bear millions of them."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.select("tic_id", F.to_json(F.struct("*")).alias("value")).repartitionByRange(parts, "tic_id").sortWithinPartitions("tic_id").select("value").write.mode("overwrite").text(path)


def write_curves(lc: DataFrame, path: str) -> None:
    """tic_id, time, flux and flux_err as CSV with headers, in files dealt by id: a star's rows lie together, in order of time."""
    parts = int(lc.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = lc.select("tic_id", "time", F.col("flux" if "flux" in lc.columns else "f").alias("flux"), (F.col("flux_err") if "flux_err" in lc.columns else F.lit(None)).cast("double").alias("flux_err"))
    kept.repartitionByRange(parts, "tic_id").sortWithinPartitions("tic_id", "time").write.mode("overwrite").option("header", True).csv(path)


MANIFEST = "tic_id string, sector string, label string, confidence double, snr double, period double, done boolean"


def write_manifest(rows: DataFrame, path: str) -> None:
    """One record per star of a catalog, for runs that go on where another ended."""
    c = lambda n: F.col(n) if n in rows.columns else F.lit(None)
    rows.select(F.col("tic_id").cast("string").alias("tic_id"), c("sector").cast("string").alias("sector"), c("class").cast("string").alias("label"), *(c(n).cast("double").alias(n) for n in ("confidence", "snr", "period")), F.lit(True).alias("done")).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The records that can be read; none if the manifest is absent, and no broken ones."""
    try:
        return spark.read.schema(MANIFEST).option("mode", "DROPMALFORMED").json(path).filter("tic_id is not null")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)


def write_bundle(rows: DataFrame, panels: DataFrame | None, path: str, kind: str = "parquet") -> DataFrame:
    """A run's output: catalog, sidecars, manifest, and the panels of each star; returns the rows with the place of their panels.

    The panels are one table, clustered by star: ``panel_path`` names the folder, null for stars without any.
    """
    if panels is not None:
        panels.repartition("tic_id").sortWithinPartitions("tic_id", "panel").write.mode("overwrite").parquet(f"{path}/panels")
        drawn = rows.sparkSession.read.parquet(f"{path}/panels").select("tic_id").distinct().withColumn("panel_path", F.lit(f"{path}/panels"))
        rows = rows.join(drawn, "tic_id", "left")
    else:
        rows = rows.withColumn("panel_path", F.lit(None).cast("string"))
    write_catalog(rows, f"{path}/catalog", kind)
    written = read_catalog(rows.sparkSession, f"{path}/catalog", kind)
    write_sidecars(written, f"{path}/sidecars")
    write_manifest(written, f"{path}/manifest")
    return written


def markdown(rows: DataFrame, most: int = 15) -> str:
    """The first rows as a table; ``most`` is the feature."""
    head = rows.limit(most).collect()
    line = lambda cells: "| " + " | ".join(cells) + " |"
    shown = lambda v: "" if v is None else f"{v:.5g}" if isinstance(v, float) else str(v)
    return "\n".join([line(rows.columns), line(["---"] * len(rows.columns)), *(line([shown(v) for v in r]) for r in head)])

