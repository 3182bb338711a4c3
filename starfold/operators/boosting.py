"""Gradient-boosted trees of several classes: histogram splits on softmax gradients.

Each round grows one tree per class, level by level.  For a level every task
sums the gradients of its rows by node, feature and bin; one shuffle by feature
adds the tasks' sums, and what comes back is the best split of each node and
feature.  Gradients are summed as whole numbers, so trees don't depend on the
partitioning.  Rows carry binned features; margins are written anew every few
rounds, and trees since then are applied on the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.functions.columns import finite
from starfold.operators.learn import balanced, medians
from starfold.sources.tables import saved

#: Bins of a feature, and rounds whose trees are applied on the way before margins are written.
BINS, KEPT = 32, 20
#: Gradients are whole numbers of this part of 1.
UNIT = 1 << 24


@dataclass
class Trees:
    """Per class a list of trees; a tree is its splits (feature, bin) and leaves in heap order: node i has 2 i + 1 and 2 i + 2 below it."""

    columns: list[str]
    classes: int
    fill: dict[str, float]
    edges: np.ndarray
    depth: int
    feature: list[np.ndarray] = field(default_factory=list)
    bin: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bins of rows of plain features, missing and infinite ones filled."""
        x = np.where(np.isfinite(x), x, np.array([self.fill[c] for c in self.columns]))
        return np.stack([np.searchsorted(e, v, "left") for e, v in zip(self.edges, x.T, strict=True)], axis=1).astype(np.uint8)

    def margins(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        """Sums of the leaves of each class's trees from round ``first`` on."""
        out = np.zeros((len(bins), self.classes))
        for f, b, v in zip(self.feature[first:], self.bin[first:], self.value[first:], strict=True):
            for c in range(self.classes):
                out[:, c] += v[c][place(bins, f[c], b[c], self.depth)]
        return out

    def proba(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.margins(self.binned(x)))

    def applied(self, rows: DataFrame) -> DataFrame:
        """``rows`` with proba, an array of class probabilities."""
        model, names = self, rows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(batch.schema.get_field_index("_x")).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                p = model.proba(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * model.classes, pa.int32()), pa.array(p.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), lists], names=[*names, "proba"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", proba array<double>"
        return rows.withColumn("_x", vector(self.columns)).mapInArrow(run, schema)

    def save(self, spark: SparkSession, path: str) -> None:
        nodes = [(r, c, self.feature[r][c].tolist(), self.bin[r][c].tolist(), self.value[r][c].tolist()) for r in range(len(self.feature)) for c in range(self.classes)]
        spark.createDataFrame(nodes, "round int, class int, feature array<int>, bin array<int>, value array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        head = [(self.columns, self.classes, [self.fill[c] for c in self.columns], self.edges.tolist(), self.depth)]
        spark.createDataFrame(head, "columns array<string>, classes int, fill array<double>, edges array<array<double>>, depth int").coalesce(1).write.mode("overwrite").parquet(f"{path}/head")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Trees:
        h = spark.read.parquet(f"{path}/head").first()
        out = Trees(list(h["columns"]), h["classes"], dict(zip(h["columns"], h["fill"], strict=True)), np.array(h["edges"]), h["depth"])
        held: dict[int, dict[int, object]] = {}
        for r in spark.read.parquet(f"{path}/trees").collect():  # rounds times classes rows
            held.setdefault(r["round"], {})[r["class"]] = r
        for k in sorted(held):
            rows = [held[k][c] for c in range(out.classes)]
            out.feature.append(np.array([r["feature"] for r in rows], np.int32))
            out.bin.append(np.array([r["bin"] for r in rows], np.int32))
            out.value.append(np.array([r["value"] for r in rows]))
        return out


def vector(columns: list[str]) -> F.Column:
    return F.array(*(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in columns))


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def place(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int, level: int | None = None) -> np.ndarray:
    """The node of each row after ``level`` splits (all by default); a node without split keeps its rows to the left down to a leaf."""
    node = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    for _ in range(depth if level is None else level):
        f = feature[node]
        node = 2 * node + 1 + ((f >= 0) & (bins[rows, np.maximum(f, 0)] > cut[node]))
    return node


def hashed(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number from 0 to 1 for each id and seed."""
    x = (ids.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return (x * np.uint64(0xA3B195354A39B70D) >> np.uint64(11)) / 2.0**53


def gradients(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted first and second derivatives of the softmax loss, as whole numbers of 1 / UNIT."""
    p = softmax(margins)
    g = p - (y[:, None] == np.arange(p.shape[1]))
    return tuple(np.rint(v * weight[:, None] * UNIT).astype(np.int64) for v in (g, np.maximum(p * (1 - p), 1e-6)))


def histograms(bins: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    """Sums of g and h by feature, node and bin: (features, 2, width, BINS)."""
    out = np.empty((bins.shape[1], 2, width, BINS), np.int64)
    for f in range(bins.shape[1]):
        cell = node * BINS + bins[:, f]
        for k, v in enumerate((g, h)):  # halves of 32 bits are exact in the doubles of bincount
            high = np.bincount(cell, (v >> 20).astype(float), width * BINS)
            low = np.bincount(cell, (v & 0xFFFFF).astype(float), width * BINS)
            out[f, k] = ((high.astype(np.int64) << 20) + low.astype(np.int64)).reshape(width, BINS)
    return out


def best_splits(sums: np.ndarray, ridge: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of (2, nodes, BINS) sums the gain and bin of each node's best cut; -1 where none gains."""
    g, h = sums[0] / UNIT, sums[1] / UNIT
    gl, hl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    gt, ht = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
    gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
    gain = np.where((hl >= least) & (ht - hl >= least), gain, -np.inf)
    cut = gain.argmax(axis=1)
    top = gain[np.arange(len(cut)), cut]
    return np.where(top > 1e-9, top, -1.0), np.where(top > 1e-9, cut, -1)


def fit(
    rows: DataFrame, columns: list[str], label: str = "y", key: str = "tic_id", classes: int = 4, rounds: int = 400, depth: int = 4, rate: float = 0.05, ridge: float = 2.0, least: float = 1.0, subsample: float = 0.85, features: float = 0.85, seed: int = 42
) -> Trees:
    """Trees on plain feature rows with balanced classes; missing features count as their medians.

    Each tree sees a share of the rows and of the features, drawn by hashes.
    """
    fill = medians(rows, columns)
    quantiles = [k / BINS for k in range(1, BINS)]
    cuts = rows.select(*(F.percentile_approx(F.coalesce(finite(F.col(f"`{c}`").cast("double")), F.lit(fill[c])), quantiles, 10_000).alias(f"e{i}") for i, c in enumerate(columns))).first()
    edges = np.array([cuts[i] if cuts[i] is not None else [0.0] * (BINS - 1) for i in range(len(columns))], float)
    model = Trees(columns, classes, fill, edges, depth)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            b = model.binned(x)
            zeros = np.zeros(classes).tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in b], pa.binary()), pa.array([zeros] * len(b), pa.binary())], names=["id", "y", "weight", "bins", "margins"])

    held = "id long, y double, weight double, bins binary, margins binary"
    data = balanced(rows.filter(F.col(label).isNotNull()), label).select(F.xxhash64(key).alias("id"), F.col(label).cast("double").alias("y"), F.col("weight").cast("double").alias("weight"), vector(columns).alias("x"))
    table, written = saved(data.mapInArrow(start, held), "boosting"), 0

    def opened(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        n = batch.num_rows
        bins = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, -1)
        margins = np.frombuffer(b"".join(batch.column(4).to_pylist())).reshape(n, -1)
        return batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), bins, margins + model.margins(bins, written)

    def level_sums(level: int, f: np.ndarray, b: np.ndarray, turn: int) -> DataFrame:
        """feature, sums of each task for all classes and nodes of a level."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                ids, y, weight, bins, margins = opened(batch)
                keep = hashed(ids, seed + turn) < subsample
                g, h = gradients(margins[keep], y[keep], weight[keep])
                one = np.stack([histograms(bins[keep], place(bins[keep], f[c], b[c], depth, level) - (2**level - 1), g[:, c], h[:, c], 2**level) for c in range(classes)], axis=1)
                total = one if total is None else total + one
            if total is not None:
                yield pa.RecordBatch.from_pydict({"feature": pa.array(np.arange(len(total)), pa.int32()), "sums": pa.array([x.tobytes() for x in total], pa.binary())})

        return table.mapInArrow(run, "feature int, sums binary")

    def summed(t: pa.Table, level: int) -> np.ndarray:
        total = np.zeros((classes, 2, 2**level, BINS), np.int64)
        for x in t.column("sums").to_pylist():
            total += np.frombuffer(x, np.int64).reshape(total.shape)
        return total

    def splitting(level: int, last: bool):
        def best(t: pa.Table) -> pa.Table:
            total, k = summed(t, level), t.column("feature")[0].as_py()
            g, h = total[:, 0].sum(axis=2) / UNIT, total[:, 1].sum(axis=2) / UNIT
            gain, cut = (np.zeros(g.shape), np.zeros(g.shape, int)) if last else map(np.stack, zip(*(best_splits(x, ridge, least) for x in total), strict=True))
            return pa.table({"feature": pa.array([k], pa.int32()), "gain": pa.array([gain.reshape(-1).tolist()]), "cut": pa.array([cut.reshape(-1).tolist()], pa.list_(pa.int32())), "value": pa.array([(-rate * g / (h + ridge)).reshape(-1).tolist()])})

        return best

    for turn in range(rounds):
        nodes = 2 ** (depth + 1) - 1
        f, b, v = np.full((classes, nodes), -1, np.int32), np.zeros((classes, nodes), np.int32), np.zeros((classes, nodes))
        allowed = np.array([np.argsort(np.random.default_rng((seed, turn, c)).random(len(columns)))[: max(1, round(features * len(columns)))] for c in range(classes)])
        for level in range(depth + 1):
            last = level == depth

            sums = level_sums(level, f, b, turn)
            sums = sums.filter("feature = 0") if last else sums  # leaves need the sums of nodes alone
            found = sorted(sums.groupBy("feature").applyInArrow(splitting(level, last), "feature int, gain array<double>, cut array<int>, value array<double>").collect(), key=lambda r: r["feature"])  # a row a feature
            lo = 2**level - 1
            if not found:
                break
            if last:
                v[:, lo:] = np.array(found[0]["value"]).reshape(classes, -1)
                break
            gain, cut = np.array([r["gain"] for r in found]).reshape(len(found), classes, -1), np.array([r["cut"] for r in found]).reshape(len(found), classes, -1)
            for c in range(classes):
                own = np.full(gain[:, c].shape, -1.0)
                own[allowed[c]] = gain[allowed[c], c]
                top = own.argmax(axis=0)  # of equal gains the first feature
                good = own[top, np.arange(own.shape[1])] > 0
                f[c, lo : lo + len(top)] = np.where(good, top, -1)
                b[c, lo : lo + len(top)] = np.where(good, cut[top, c, np.arange(own.shape[1])], 0)
        model.feature.append(f)
        model.bin.append(b)
        model.value.append(v)
        if len(model.feature) - written >= KEPT and turn + 1 < rounds:

            def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    margins = opened(batch)[-1]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([r.tobytes() for r in margins], pa.binary())], names=["id", "y", "weight", "bins", "margins"])

            table, written = saved(table.mapInArrow(again, held), "boosting"), len(model.feature)
    return model


def out_of_fold(rows: DataFrame, columns: list[str], key: str, label: str = "y", classes: int = 4, folds: int = 3, **settings) -> DataFrame:
    """proba of each row from trees that never saw its group; null where there was nothing to learn from."""
    from starfold.operators.learn import fold_of

    data = saved(rows.withColumn("fold", fold_of(key, folds)), "folds")
    out = None
    for k in range(folds):
        train, test = data.filter(F.col("fold") != k), data.filter(F.col("fold") == k)
        part = test.withColumn("proba", F.lit(None).cast("array<double>")) if train.isEmpty() else fit(train, columns, label, key, classes, **settings).applied(test)
        out = part if out is None else out.unionByName(part)
    return out
