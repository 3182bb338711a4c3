"""Centroid clustering over subvector dictionaries: exact k-means in integers.

Each shard of vectors is encoded once, without loss: its components are cut
into blocks of two, and each block becomes a dictionary of distinct subvectors
and a code per vector.  A round computes the distances of a block's distinct
subvectors to all centroids once, and a vector's distance is the sum over its
codes.  Centroid sums come from counts of codes, so vectors are never decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.llm.common import load, written
from starfold.llm.shards import opened, pressed

DIM, CENTROIDS, ROUNDS, SCALE = 64, 40, 5, 256
#: Components in a block; two 32-bit integers are one 64-bit key.
WIDTH = 2
#: Vectors in a shard: a code fits 16 bits, and a task holds a shard's distances in some 30 MB.
SHARD = 1 << 16
#: Size from which on SCALE * x would overflow the long distances.
LIMIT = 2.0**19


def usable(vector: str, dim: int = DIM) -> F.Column:
    """Whether a vector has ``dim`` components, none of them null, non-finite or of ``LIMIT`` and more in size."""
    fits = F.forall(F.col(vector), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < LIMIT))
    return F.coalesce((F.size(vector) == dim) & fits, F.lit(False))


def quantised(values: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * values).astype(np.int64)


def encoded(rows: DataFrame, key: str, vector: str, dim: int, scale: int) -> DataFrame:
    """Shards, written: ids, the number of distinct subvectors of each block, the subvectors, and the codes by block."""

    def shard(ids: list, q: np.ndarray) -> pa.RecordBatch:
        cut = np.zeros((len(q), -(-dim // WIDTH) * WIDTH), np.int32)
        cut[:, :dim] = q
        found = [np.unique(block, return_inverse=True) for block in np.ascontiguousarray(cut.view(np.int64).T)]
        return pa.RecordBatch.from_pydict(
            {
                "ids": pa.array([ids], pa.list_(pa.int64())),
                "sizes": pa.array([[len(words) for words, _ in found]], pa.list_(pa.int32())),
                "words": pa.array([pressed(np.concatenate([words for words, _ in found]))], pa.binary()),
                "codes": pa.array([pressed(np.stack([code for _, code in found]).astype(np.uint16))], pa.binary()),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n = [], [], 0
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                one = batch.slice(lo, SHARD - n)
                lo += one.num_rows
                ids += one.column(0).to_pylist()
                parts.append(quantised(one.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale))
                n += one.num_rows
                if n == SHARD:
                    yield shard(ids, np.concatenate(parts))
                    ids, parts, n = [], [], 0
        if n:
            yield shard(ids, np.concatenate(parts))

    kept = rows.filter(usable(vector, dim)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return written(kept.mapInArrow(run, "ids array<long>, sizes array<int>, words binary, codes binary"), "codes")


def nearest(words: list[np.ndarray], codes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid (ties: smaller number) and squared distance, by sums of its subvectors' distances."""
    most = max(int(np.abs(x).max()) for x in [*words, centroids])
    kind = np.int32 if centroids.shape[1] * (2 * most) ** 2 < 2**31 else np.int64
    total = np.zeros((codes.shape[1], len(centroids)), kind)
    for b, (held, code) in enumerate(zip(words, codes, strict=True)):
        apart = held[:, None, :] - centroids[None, :, WIDTH * b : WIDTH * (b + 1)]
        total += np.take((apart * apart).sum(axis=2).astype(kind), code, axis=0)
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(cluster)), cluster].astype(np.int64)


def sums(words: list[np.ndarray], codes: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """Sums of each cluster's vectors (exact: under 2**53 for a shard), from how often it holds each code."""
    out = []
    for held, code in zip(words, codes, strict=True):
        often = np.bincount(cluster * len(held) + code, minlength=k * len(held)).reshape(k, -1)
        out.append((often.astype(float) @ held.astype(float)).astype(np.int64))
    return np.concatenate(out, axis=1)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray], np.ndarray]]:
    for batch in batches:
        for k in range(batch.num_rows):
            ids, sizes, words, codes = (batch.column(i)[k] for i in range(4))
            cuts = np.cumsum(sizes.values.to_numpy())
            held = opened(words.as_py(), np.int32).reshape(-1, WIDTH).astype(np.int64)
            yield ids.values, np.split(held, cuts[:-1]), opened(codes.as_py(), np.uint16).reshape(len(cuts), -1)


def _padded(centroids: np.ndarray) -> np.ndarray:
    return np.pad(centroids, ((0, 0), (0, -centroids.shape[1] % WIDTH)))


def start(rows: DataFrame, key: str, vector: str, k: int, dim: int, scale: int, seed: int) -> np.ndarray:
    """The k usable vectors of least sha256 of ``seed:id``; rows that repeat an id follow each other by components."""
    named = rows.filter(usable(vector, dim) & F.col(key).isNotNull())
    first = named.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("long").cast("string")), 256).alias("h"), F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    found = first.orderBy("h", "id", "v").limit(k).collect()
    return quantised(np.array([r["v"] for r in found], float).reshape(-1, dim), scale)


def moved(codes: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor(sum / count) of each cluster's vectors; empty ones stay."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, code in _shards(batches):
            cluster, _ = nearest(words, code, _padded(centroids))
            n = np.bincount(cluster, minlength=k)
            total = sums(words, code, cluster, k)[:, :dim]
            full = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(full, pa.int32()), "n": pa.array(n[full], pa.int64()), "total": pa.array(total[full].tolist(), pa.list_(pa.int64()))})

    parts = codes.mapInArrow(run, "cluster int, n long, total array<long>")
    after = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(dim))).collect():  # k rows at most
        after[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
    return after


def clusters(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = 2) -> tuple[DataFrame, np.ndarray]:
    """key, cluster, distance of each usable row, a written table, and the final centroids.

    Left out: null vectors, those of another length than ``dim``, and those with a
    null, non-finite or (as the long distance could overflow) huge component.
    Rows without key are clustered, but start no centroid; rows that repeat a key
    are vectors of their own.  With fewer than k vectors there are as many
    centroids; with none, none, and no rows.  Other columns, of clashing names
    too, are neither read nor returned.
    """
    centroids = start(rows, key, vector, k, dim, scale, seed)
    codes = encoded(rows, key, vector, dim, scale)
    if not len(centroids):  # no row has a key, so nothing starts
        codes = codes.limit(0)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(codes, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, code in _shards(batches):
            cluster, distance = nearest(words, code, _padded(centroids))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["id", "cluster", "distance"])

    found = codes.mapInArrow(run, "id long, cluster int, distance long")
    return written(found.withColumnRenamed("id", key), "clusters"), centroids


def described(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``clusters()`` with cluster_inertia, inertia and centroid_sha256; one row a centroid is broadcast."""
    spark = found.sparkSession
    held = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows at most
    whole = sum(r["cluster_inertia"] for r in held)
    rows = [(r["cluster"], r["cluster_inertia"], whole, ",".join(map(str, centroids[r["cluster"]].tolist()))) for r in held]
    of = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, components string")
    return found.join(F.broadcast(of.select("cluster", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256"))), "cluster")


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    found = described(*clusters(load(spark, sf_dir, "embeddings")))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    near = "SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.r, k.c, list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - k.q[i]) * (v.q[i] - k.q[i])))::BIGINT AS d FROM vecs v, {k} k) GROUP BY r"
    mean = "list_transform(range(1, 65), lambda i: ((s[i] - ((s[i] % n) + n) % n) // n)::BIGINT)"
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id, embedding) AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= 524288)) = 0)",
        "vecs AS MATERIALIZED (SELECT * FROM kept)",
        "k0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, r) - 1)::INT AS c, q FROM (SELECT sha256('2:' || vec_id) AS h, r, q FROM kept WHERE vec_id IS NOT NULL ORDER BY h, r LIMIT 40))",
    ]
    for i in range(ROUNDS):
        steps += [
            f"a{i} AS MATERIALIZED ({near.format(k=f'k{i}')})",
            f"s{i} AS MATERIALIZED (SELECT c, list(s ORDER BY i) AS s, max(n) AS n FROM (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, unnest(range(1, 65)) AS i FROM a{i} JOIN vecs USING (r)) GROUP BY c, i) GROUP BY c)",
            f"k{i + 1} AS MATERIALIZED (SELECT k.c, CASE WHEN s.c IS NULL THEN k.q ELSE {mean} END AS q FROM k{i} k LEFT JOIN s{i} s USING (c))",
        ]
    steps.append(f"told AS MATERIALIZED ({near.format(k=f'k{ROUNDS}')})")
    return (
        "WITH "
        + ",\n".join(steps)
        + f" SELECT vec_id, told.c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY told.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(k.q, ',')) AS centroid_sha256 FROM told JOIN vecs USING (r) JOIN k{ROUNDS} k ON k.c = told.c"
    )


OP12_SQL = _sql()
