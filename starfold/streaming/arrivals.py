"""Runs that go on: files that arrive in a folder become catalog rows, each star once.

A stream of file names feeds batches.  A batch reads its files, leaves out the
stars that earlier batches have, and writes its rows to a folder of its own
number; its manifest is written after the catalog.  A batch that was cut off
runs again under the same number and replaces what it had written, so a killed
run goes on without a double row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from starfold.config import Config
from starfold.operators import catalog
from starfold.plans import pipeline
from starfold.sources import files


def names(spark: SparkSession, folder: str, most: int = 10_000) -> DataFrame:
    """The paths of light-curve files as they arrive, ``most`` a batch; contents are not read."""
    raw = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.{csv,fits,fit,fz,fits.gz,fit.gz}").option("maxFilesPerTrigger", most)
    return raw.schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path")


def finished(spark: SparkSession, out: str, but: int | None = None) -> DataFrame:
    """The manifest records of all batches, without those of batch ``but``."""
    try:
        rows = spark.read.schema(files.MANIFEST).json(f"{out}/manifest/*").withColumn("_path", F.col("_metadata.file_path"))
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], files.MANIFEST)
    return (rows if but is None else rows.filter(~F.contains("_path", F.lit(f"/batch={but}/")))).filter("tic_id is not null").drop("_path")


def take(batch: DataFrame, number: int, out: str, config: Config, models: dict[str, object] | None) -> None:
    """One batch of paths into ``out``: its catalog, then its manifest."""
    spark = batch.sparkSession
    paths = [r["path"] for r in batch.select("path").distinct().collect()]  # ``most`` names at most
    if not paths:
        return
    lc, known = files.curves(spark, paths)
    lc = catalog.pending(lc, finished(spark, out, number))
    if not lc.isEmpty():
        rows = pipeline.process(lc, known, config, models=models)
        rows.write.mode("overwrite").parquet(f"{out}/catalog/batch={number}")
        files.write_manifest(spark.read.parquet(f"{out}/catalog/batch={number}"), f"{out}/manifest/batch={number}")


def follow(spark: SparkSession, folder: str, out: str, config: Config = Config(), models: dict[str, object] | None = None, most: int = 10_000, once: bool = True) -> StreamingQuery:
    """Starts the run: all files there now if ``once``, and those that come later otherwise."""
    query = names(spark, folder, most).writeStream.foreachBatch(lambda batch, number: take(batch, number, out, config, models)).option("checkpointLocation", f"{out}/progress")
    return (query.trigger(availableNow=True) if once else query).start()


def rows(spark: SparkSession, out: str) -> DataFrame:
    """The catalog of all finished batches: rows of a batch without manifest don't count."""
    done = finished(spark, out).select(F.col("tic_id").cast("long").alias("tic_id")).distinct()
    try:
        found = spark.read.option("mergeSchema", True).parquet(f"{out}/catalog")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return catalog.conform(spark.createDataFrame([], "tic_id long"))
    return found.join(done, "tic_id", "left_semi")
