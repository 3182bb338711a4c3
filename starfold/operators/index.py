"""A nearest-neighbour index that is kept: inverted lists by coarse cell, in a folder.

Cells are centers of k-means on a bounded sample; all vectors are in the lists,
stored by cell, so that a query reads the row groups of a few cells only.  How
many cells a query visits is measured when the index is built, so that the
share of true neighbours found reaches a target.  Vectors may be added later.

A folder holds ``cells`` (cell, center), ``settings`` (one row) and ``lists``
(cell, vec_id, v).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.operators import catalog

#: Vectors that cells and the number of visits are fitted on, at most, and queries among them.
SAMPLE, ASKED = 20_000, 200
#: Cells at most.
MOST = 4096
LISTS = "cell int, vec_id long, v array<double>"


def _vectors(rows: DataFrame) -> DataFrame:
    """vec_id and components as doubles; rows without either, or with a component missing, are left out."""
    v = F.transform("embedding", lambda e: e.cast("double"))
    good = F.col("vec_id").isNotNull() & F.forall(F.col("embedding"), lambda e: e.isNotNull() & ~F.isnan(e.cast("double")))
    return rows.filter(F.coalesce(good, F.lit(False)) & (F.size("embedding") > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy().reshape(batch.num_rows, -1)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ y.T + (y * y).sum(axis=1)[None]


def _visits(sample: np.ndarray, centers: np.ndarray, k: int, recall: float) -> int:
    """Cells to visit so that of the k nearest in the sample a share of ``recall`` lies in them, over sampled queries."""
    asked = sample[:: max(1, len(sample) // ASKED)][:ASKED]
    own = _apart(sample, centers).argmin(axis=1)
    place = np.argsort(np.argsort(_apart(asked, centers), axis=1), axis=1)
    near = np.argsort(_apart(asked, sample), axis=1, kind="stable")[:, :k]
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).reshape(-1))
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def listed(rows: DataFrame, centers: np.ndarray, cosine: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, "v")
            cell = _apart(catalog.directions(x) if cosine else x, centers).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *batch.columns], names=["cell", "vec_id", "v"])

    return rows.mapInArrow(run, LISTS)


def build(rows: DataFrame, path: str, cells: int | None = None, cosine: bool = False, k: int = 10, recall: float = 0.95, seed: int = 42) -> None:
    """An index of (vec_id, embedding) in the folder ``path``; an older one there is replaced.

    The square root of the number of vectors is the number of cells unless given.
    """
    spark, known = rows.sparkSession, _vectors(rows)
    n = known.count()
    if n == 0:
        raise ValueError("no vectors to build an index of")
    share = known.filter(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30))).limit(SAMPLE) if n > SAMPLE else known
    sample = np.array([r["v"] for r in share.select("v").collect()], float)  # SAMPLE rows at most
    sample = catalog.directions(sample) if cosine else sample
    cells = int(min(cells or max(1, round(n**0.5)), MOST, max(1, len(sample) // 2)))
    given = spark.createDataFrame([(x,) for x in sample.tolist()], "v array<double>").select(array_to_vector("v").alias("features"))
    centers = np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(given).clusterCenters()) if cells > 1 else sample.mean(axis=0, keepdims=True)
    visits = _visits(sample, centers, k, recall)
    spark.createDataFrame([(i, c) for i, c in enumerate(centers.tolist())], "cell int, center array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    spark.createDataFrame([(cosine, visits)], "cosine boolean, visits int").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
    _store(listed(known, centers, cosine), path, "overwrite")


def _store(lists: DataFrame, path: str, mode: str) -> None:
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists.repartitionByRange(parts, "cell", "vec_id").sortWithinPartitions("cell", "vec_id").write.mode(mode).parquet(f"{path}/lists")


class Index:
    """An index opened for queries and additions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.centers = np.array([r["center"] for r in spark.read.parquet(f"{path}/cells").orderBy("cell").collect()])  # MOST rows at most
        row = spark.read.parquet(f"{path}/settings").first()
        self.cosine, self.visits = row["cosine"], row["visits"]

    @property
    def lists(self) -> DataFrame:
        return self.spark.read.schema(LISTS).parquet(f"{self.path}/lists")

    def add(self, rows: DataFrame) -> None:
        """More vectors, into the lists of the cells there are; centers and visits stay."""
        _store(listed(_vectors(rows), self.centers, self.cosine), self.path, "append")

    def routed(self, queries: DataFrame, visits: int) -> DataFrame:
        """cell, vec_id, v: each query in the cells it visits."""
        centers, cosine = self.centers, self.cosine

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch, "v")
                near = np.argsort(_apart(catalog.directions(x) if cosine else x, centers), axis=1, kind="stable")[:, :visits]
                who = pa.array(np.repeat(np.arange(len(x)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(near.reshape(-1), pa.int32()), *(c.take(who) for c in batch.columns)], names=["cell", "vec_id", "v"])

        return _vectors(queries).mapInArrow(run, LISTS)

    def nearest(self, queries: DataFrame, k: int = 10, visits: int | None = None, exact: bool = False) -> DataFrame:
        """query_id, vec_id, d2, rank of the k nearest of the vectors in the cells that each query visits, or of all if ``exact``.

        A cell's vectors and its queries meet in blocks of bounded size, so a cell
        of any size is dealt out; only k rows per query leave a block.
        """
        if exact:
            return catalog.nearest(queries, self.lists.select("vec_id", F.col("v").alias("embedding")), k, self.cosine)
        asked = self.routed(queries, min(visits or self.visits, len(self.centers)))
        wanted = [r["cell"] for r in asked.select("cell").distinct().collect()]  # MOST at most
        lists = self.lists.filter(F.col("cell").isin(wanted))  # row groups of other cells are skipped
        sizes = lists.groupBy("cell").count().select("cell", F.ceil(F.col("count") / catalog.VECTOR_BLOCK).cast("int").alias("y"))
        crowds = asked.groupBy("cell").count().select("cell", F.ceil(F.col("count") / catalog.QUERY_BLOCK).cast("int").alias("x"))
        blocks = F.broadcast(sizes.join(crowds, "cell"))  # a row a cell: MOST at most
        deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        rows = asked.join(blocks, "cell").select("cell", deal("x").alias("bx"), each("y").alias("by"), F.lit(True).alias("asks"), F.col("vec_id").alias("id"), "v")
        rows = rows.unionByName(lists.join(blocks, "cell").select("cell", each("x").alias("bx"), deal("y").alias("by"), F.lit(False).alias("asks"), F.col("vec_id").alias("id"), "v"))
        return catalog.best_of(rows.groupBy("cell", "bx", "by").applyInArrow(catalog.meeting(k, self.cosine), catalog.NEAR), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id and the share of its exact neighbours that were found."""
    hit = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
