"""Quality classifier: random Fourier features of document statistics, ridge scores from
partition-summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfold.llm.common import load, written
from starfold.llm.quality import base_counts, histograms, per_row
from starfold.llm.words import ANY, bounds, slices, spread

FEATURES, WIDTH, RIDGE, SEED = 192, 2.0, 1e-3, 11
#: Labelled rows that the fit takes at most, about: beyond that, a hash of doc_id picks them.
MAX_ROWS = 200_000
#: Fits and calibration never see the same rows, nor those held out.
PARTS = 16


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Per row: sizes, shares of character classes, repetition, common words, line shapes.  Finite for empty texts."""
    words = bounds(data, offs, ANY)
    base = base_counts(data, offs, words)
    chars, common = histograms(data, offs, words)
    lines = per_row(data == 0x0A, offs) + 1
    n_chars, n_words = np.maximum(chars.sum(axis=1), 1), np.maximum(base["n_words"], 1)
    lengths = np.minimum(words[1] - words[0], 40).astype(float)
    of = spread(np.diff(words[2]))
    mean = np.bincount(of, lengths, minlength=len(offs) - 1) / n_words
    square = np.bincount(of, lengths**2, minlength=len(offs) - 1) / n_words
    return np.column_stack((
        np.log1p(base["n_words"]), np.log1p(n_chars), mean, np.sqrt(np.maximum(square - mean**2, 0)), chars / n_chars[:, None], 1 - common[:, -1] / n_words,
        base["n_symbols"] / n_words, base["n_dup_lines"] / lines, base["n_repeat_words"] / n_words, np.log1p(n_words / lines),
    )).astype(np.float32)


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in slices(batch, text):
                x = statistics(data, offs)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(key)), lists], names=["id", "x"])

    return docs.select(key, text).mapInArrow(run, "id long, x array<float>")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turns: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features: their products approximate a Gaussian kernel of the standardised statistics."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack((np.sqrt(2 / FEATURES) * np.cos(z @ self.turns + self.shift), np.ones(len(z))))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lifted(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels)


def matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(name))
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: centers of the blocks and their rising means."""
    blocks: list[list[float]] = []
    for a, b, c in sorted(zip(x.tolist(), y.tolist(), w.tolist(), strict=True)):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _sums(rows: DataFrame, work) -> np.ndarray:
    """The sum over all partitions of the vectors that ``work`` makes of batches; few partitions, so few vectors reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                now = work(batch)
                total = now if total is None else total + now
        if total is not None:
            yield pa.record_batch({"v": pa.array([total.astype("<f8").tobytes()], pa.binary())})

    found = rows.coalesce(PARTS).mapInArrow(run, "v binary").collect()
    return sum((np.frombuffer(r["v"]) for r in found), 0.0)


def fit(known: DataFrame, seed: int = SEED, max_rows: int = MAX_ROWS) -> Model:
    """From (id, x, y): y is 0 or 1.  A quarter of the ids, by hash, calibrates only.

    Without rows, or with one class, every score is the mean label, 0.5 if there is none.
    """
    n = known.count()
    if n > max_rows:
        known = known.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int(max_rows / n * (1 << 20)))
    known = written(known.withColumn("calibrates", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(4)) == 0), "labelled")
    dims = statistics(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
    rng = np.random.default_rng(seed)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch)
        return np.concatenate(([len(x)], x.sum(axis=0), (x**2).sum(axis=0)))

    m = _sums(known, moments)
    m = m if np.ndim(m) else np.zeros(2 * dims + 1)
    mean = m[1 : dims + 1] / max(m[0], 1)
    scale = np.sqrt(np.maximum(m[dims + 1 :] / max(m[0], 1) - mean**2, 0))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(0, 1 / (WIDTH * np.sqrt(dims)), (dims, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5))

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        z = model.lifted(matrix(batch))
        y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
        return np.concatenate(((z.T @ z).reshape(-1), z.T @ y, [len(y)]))

    e = _sums(known.filter("not calibrates"), equations)
    if not np.ndim(e):
        return model
    d = FEATURES + 1
    penalty = RIDGE * e[-1] * np.eye(d) / FEATURES
    penalty[-1, -1] = 0
    model.weights[:] = np.linalg.lstsq(e[: d * d].reshape(d, d) + penalty, e[d * d : d * d + d], rcond=None)[0]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"bin": pa.array(np.clip(np.floor(model.raw(matrix(batch)) * 512), -512, 1024).astype(np.int32)), "y": batch.column("y").cast(pa.float64())})

    bins = known.filter("calibrates").mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("w")).collect()
    if not bins:
        return model
    knots, levels = isotonic(np.array([(r["bin"] + 0.5) / 512 for r in bins]), np.array([r["y"] for r in bins]), np.array([float(r["w"]) for r in bins]))
    return Model(model.mean, model.scale, model.turns, model.shift, model.weights, knots, np.clip(levels, 0, 1))


def score(found: DataFrame, model: Model) -> DataFrame:
    """id, score of (id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(matrix(batch)) if batch.num_rows else np.zeros(0))], names=["id", "score"])

    return found.mapInArrow(run, "id long, score double")


def remainder(key: Column, of: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(of)), F.lit(0))


def judge(docs: DataFrame, labels: DataFrame, held_out: int = 2, folds: int = 4, limit: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Labels of rows whose crc32(doc_id) modulo ``folds`` is ``held_out`` are never
    read.  A doc_id of several labels counts with their mean rounded up; null
    labels do not count.  Null doc_ids are scored, are not held out and have no
    label.  Empty texts are scored like others, and very long ones as a whole.
    Rows that repeat a doc_id train once, with the least of their statistics, and
    are scored each by its own text.  Columns of other names are not read; an
    empty table gives none, and without labels all scores are 0.5.
    """
    found = written(features(docs), "statistics")
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y")).filter(remainder(F.col("id"), folds) != held_out)
    model = fit(found.join(known, "id").groupBy("id", "y").agg(F.min("x").alias("x")))
    return score(found, model).select(F.col("id").alias("doc_id"), (remainder(F.col("id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def op8_classifier(spark, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
