"""Embedding near-dedup: an exact metric range join on the unit sphere.

Cosine of at least c is distance of at most r = sqrt(2 - 2 c) between unit
vectors.  Each vector belongs to the cell of its nearest pivot.  A vector is
sent on to another cell only if the triangle inequality leaves room for a
partner there: it must lie within r of the cell's ball and, which says more,
within r of the plane between the two pivots.  Cells then join independently,
and a cell of many vectors is dealt out in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.llm.common import load, written
from starfold.llm.near_dedup import components, forest, joined
from starfold.llm.words import U64, mix

COSINE = 0.95
#: Vectors that a cell is meant to have, and those that one task holds while others stream by.
CELL, BLOCK = 1 << 15, 1 << 15
#: Pivots: as many as cells of ``CELL`` need, within these limits; larger cells are dealt out in blocks.
FEWEST, MOST = 12, 2048
#: Vectors that stream by at a time, and distances from pivots that a task holds at once.
STRIP, HELD = 512, 1 << 20
#: Single precision decides a cosine that is farther than this from the limit; double precision decides the others.
NEAR = 1e-5
_SLACK = 1e-9


def usable(vector: str) -> F.Column:
    """Whether a vector is neither null nor empty or zero, nor has null or non-finite components."""
    fits = F.forall(F.col(vector), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(fits & F.exists(F.col(vector), lambda x: x != 0), F.lit(False))


def kind_of(df: DataFrame, vector: str) -> type:
    return np.float32 if df.schema[vector].dataType.elementType.simpleString() == "float" else np.float64


def packed(x: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    x = np.ascontiguousarray(x)
    step = x.itemsize * x.shape[1]
    return pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int64) * step), pa.py_buffer(x)]).cast(pa.binary())


def unpacked(col: pa.Array, kind: type, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``dim`` doubles, zeros behind shorter ones, and how many components each has."""
    n = pc.binary_length(col).to_numpy(zero_copy_only=False) // np.dtype(kind).itemsize
    out = np.zeros((len(n), dim))
    out[np.arange(dim) < n[:, None]] = np.frombuffer(b"".join(col.to_pylist()), kind)
    return out, n


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fingerprints(x: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each row's components; 0.0 and -0.0 are alike."""
    bits = np.ascontiguousarray(x + 0.0).view(U64)
    place = mix(np.arange(1, x.shape[1] + 1, dtype=U64)) | U64(1)
    return [mix((mix(bits ^ U64(k)) * place).sum(axis=1, dtype=U64) ^ U64(x.shape[1])).view(np.int64) for k in (0x51ED270B, 0xA24BAED4963EE407)]


def prints(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v (the components' bytes) and two hashes of each usable row; written."""
    kind = kind_of(rows, vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pc.list_value_length(batch.column(1)).to_numpy()
            for size in np.unique(n).tolist():
                part = batch.filter(pa.array(n == size))
                x = part.column(1).flatten().to_numpy().reshape(-1, size).astype(kind)
                yield pa.RecordBatch.from_arrays([part.column(0), packed(x), *map(pa.array, fingerprints(x.astype(float)))], names=["id", "v", "sa", "sb"])

    given = rows.filter(usable(vector)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>" if kind is np.float32 else "array<double>").alias("v"))
    return written(given.mapInArrow(run, "id long, v binary, sa long, sb long"), "prints")


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))


def pivots_of(classes: DataFrame, kind: type, dim: int, radius: float) -> np.ndarray:
    """Unit vectors of the classes of least hash, none within ``radius`` of another: about one for ``CELL`` classes."""
    k = int(np.clip(-(-classes.count() // CELL), FEWEST, MOST))
    held = classes.select("c", "v").orderBy(F.xxhash64("c"), "c").limit(k).collect()
    found = np.zeros((0, dim))
    for u in unit(unpacked(pa.array([r["v"] for r in held], pa.binary()), kind, dim)[0]):
        if not len(found) or distances(u[None], found).min() > radius:
            found = np.vstack((found, u))
    return found


def pieces(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their rows' distances from ``k`` pivots are ``HELD`` at most."""
    step = max(1, HELD // k)
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            yield batch.slice(lo, step)


def homes(classes: DataFrame, kind: type, pivots: np.ndarray) -> DataFrame:
    """c, copies, v, cell (the nearest pivot) and away (its distance) of each class; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, len(pivots)):
            away = distances(unit(unpacked(batch.column(2), kind, pivots.shape[1])[0]), pivots)
            cell = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(away[np.arange(len(cell)), cell])], names=["c", "copies", "v", "cell", "away"])

    return written(classes.select("c", "copies", "v").mapInArrow(run, "c long, copies long, v binary, cell int, away double"), "homes")


def _counted(n: np.ndarray) -> np.ndarray:
    """0, 1, ..., n - 1 for each of ``n``."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def routed(placed: DataFrame, kind: type, pivots: np.ndarray, radius: float) -> tuple[DataFrame, int]:
    """(block, home, c, copies, v): the block that holds each class, and those it is compared with besides; and the number of blocks.

    Of two cells, vectors of the smaller one are sent to the larger; within a
    cell, to the blocks behind their own.
    """
    k, dim = pivots.shape
    size, ball = np.zeros(k, np.int64), np.full(k, -np.inf)
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("ball")).collect():  # one row a pivot
        size[r["cell"]], ball[r["cell"]] = r["n"], r["ball"]
    blocks = np.maximum(1, -(-size // BLOCK))
    rank = np.empty(k, np.int64)
    rank[np.lexsort((np.arange(k), size))] = np.arange(k)
    between, first = distances(pivots, pivots), np.concatenate(([0], np.cumsum(blocks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, k):
            c, home = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            away = distances(unit(unpacked(batch.column(2), kind, dim)[0]), pivots)
            own = away[np.arange(len(c)), home][:, None]
            go = (rank[None, :] > rank[home][:, None]) & (away <= ball[None, :] + radius + _SLACK)
            go &= away * away - own * own <= 2 * radius * between[home] + _SLACK
            mine = first[home] + (mix(c.view(U64)) % blocks[home].astype(U64)).astype(np.int64)
            row, cell = np.nonzero(go)
            later = first[home + 1] - 1 - mine
            at = np.concatenate((mine, np.repeat(first[cell], blocks[cell]) + _counted(blocks[cell]), np.repeat(mine + 1, later) + _counted(later)))
            who = np.concatenate((np.arange(len(c)), np.repeat(row, blocks[cell]), np.repeat(np.arange(len(c)), later)))
            held = np.arange(len(at)) < len(c)
            for lo in range(0, len(who), 1 << 14):
                w = slice(lo, lo + (1 << 14))
                yield pa.RecordBatch.from_arrays([pa.array(at[w]), pa.array(held[w]), *(batch.column(i).take(pa.array(who[w])) for i in range(3))], names=["block", "home", "c", "copies", "v"])

    return placed.select("c", "copies", "v", "cell").mapInArrow(run, "block long, home boolean, c long, copies long, v binary"), int(first[-1])


class Block:
    """The vectors that a block holds, and what is known of them: links so far, and components among them."""

    def __init__(self, number: int, kind: type, dim: int, least: float):
        self.number, self.kind, self.dim, self.least, self.parts, self.whole = number, kind, dim, least, [], False

    def read(self, part: pa.RecordBatch) -> list[np.ndarray]:
        x, n = unpacked(part.column(4), self.kind, self.dim)
        u = unit(x)
        return [part.column(2).to_numpy(), part.column(3).to_numpy().astype(float), n, u, u.astype(np.float32)]

    def hold(self, part: pa.RecordBatch) -> None:
        self.parts.append(self.read(part))

    def settle(self) -> None:
        """All are held: they are compared with each other."""
        if not self.whole:
            self.whole = True
            self.c, self.copies, self.n, self.u, self.f = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            self.parts, self.label, self.links = [], np.arange(len(self.c)), np.zeros(len(self.c))
            for lo in range(0, len(self.c), STRIP):
                one = [x[lo : lo + STRIP] for x in (self.c, self.copies, self.n, self.u, self.f)]
                self.links[lo : lo + STRIP] += self.strip(one, lo)[0]

    def strip(self, one: list[np.ndarray], own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Links of each row of ``one`` to those held, and the label of one it is linked with, or -1.

        own: where ``one`` itself lies among those held, if it does; then each pair is met once.
        """
        _, copies, n, u, f = one
        links, label = np.zeros(len(n)), np.full(len(n), -1)
        for lo in range(0 if own is None else own, len(self.c), 8192):
            alike = f @ self.f[lo : lo + 8192].T
            row, at = np.nonzero(alike >= self.least - NEAR)
            if not len(row):
                continue
            near = alike[row, at] < self.least + NEAR
            at += lo
            good = self.n[at] == n[row]
            if own is not None:
                good &= at > row + own
            unsure = np.flatnonzero(near & good)
            good[unsure] = (u[row[unsure]] * self.u[at[unsure]]).sum(axis=1) >= self.least
            row, at = row[good], at[good]
            if not len(row):
                continue
            links += np.bincount(row, self.copies[at], len(n))
            self.links += np.bincount(at, copies[row], len(self.c))
            if own is None:
                start = np.flatnonzero(np.diff(row, prepend=-1))
                least = np.minimum.reduceat(self.label[at], start)
                before = label[row[start]]
                label[row[start]] = np.where(before < 0, least, np.minimum(before, least))
                a, b = np.concatenate((np.repeat(least, np.diff(np.append(start, len(row)))), least)), np.concatenate((self.label[at], np.where(before < 0, least, before)))
            else:
                a, b = self.label[row + own], self.label[at]
            new = a != b
            if new.any():
                a, b = np.unique(np.stack((a[new], b[new])), axis=1)
                self.label = forest(len(self.c), a, b)[self.label]
        return links, label

    def meet(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        self.settle()
        held = self.read(part)
        for lo in range(0, len(held[0]), STRIP):
            one = [x[lo : lo + STRIP] for x in held]
            links, label = self.strip(one)
            at = np.flatnonzero(links)
            if len(at):
                yield _told(one[0][at], links[at], self.c[label[at]])

    def done(self) -> pa.RecordBatch:
        self.settle()
        at = np.flatnonzero(self.links)
        return _told(self.c[at], self.links[at], self.c[self.label[at]])


def _told(c: np.ndarray, links: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"c": pa.array(c, pa.int64()), "links": pa.array(links.astype(np.int64)), "other": pa.array(other, pa.int64())})


def met(sent: DataFrame, n: int, kind: type, dim: int, least: float) -> DataFrame:
    """(c, links, other), written: links of class c within one block, weighted by copies, and a class of the block's component.

    A row for each class and block it has links in: never one for each pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            number, home = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(2 * number + home)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(number)], strict=True):
                if now is None or now.number != number[lo]:
                    if now is not None:
                        yield now.done()
                    now = Block(int(number[lo]), kind, dim, least)
                part = batch.slice(lo, hi - lo)
                if home[lo]:
                    now.hold(part)
                else:
                    yield from now.meet(part)
        if now is not None:
            yield now.done()

    dealt = sent.repartitionById(n, F.col("block").cast("int")).sortWithinPartitions("block", F.col("home").desc())
    return written(dealt.mapInArrow(run, "c long, links long, other long"), "met")


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = COSINE) -> DataFrame:
    """key, n_links, component_id, kept: one row per row of ``rows``.

    Rows of equal components are one class, compared once and counted as often as
    they are; copies are linked with each other.  Null, empty and zero vectors and
    those with null or non-finite components are linked with nothing, and vectors
    of different lengths never with each other.  Rows without key are no part of
    the graph: n_links 0, component_id null, kept true.  Rows that repeat a key
    are vectors of their own, but share their component.  A component is named
    by its least key.  An empty table gives none; columns of other names,
    clashing ones too, are neither read nor returned.
    """
    id_of, ok = F.col(key).cast("long"), usable(vector) & F.col(key).isNotNull()
    kind, radius = kind_of(rows, vector), float(np.sqrt(2 - 2 * least))
    known = prints(rows.filter(ok), key, vector)
    classes = known.groupBy("sa", "sb").agg(F.min(F.struct("id", "v")).alias("x"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes.select("sa", "sb", F.col("x.id").alias("c"), "x.v", "copies"), "classes")
    named = written(joined(known.select("id", "sa", "sb"), classes.select("sa", "sb", "c", "copies"), ["sa", "sb"]).select("id", "c", "copies"), "rows")
    dim = (classes.agg(F.max(F.length("v"))).first()[0] or 0) // np.dtype(kind).itemsize
    loose = rows.filter(~ok).select(id_of.alias("id"), F.lit(0).cast("long").alias("n_links"))
    nodes = named.select("id", "c").unionByName(loose.filter("id is not null").select("id", F.col("id").alias("c")))
    keys = written(nodes.groupBy("id").agg(F.min("c").alias("c"), F.max("c").alias("last")), "keys")
    edges = keys.filter("c <> last").select(F.col("id").alias("a"), F.col("c").alias("b"))
    if not edges.isEmpty():  # a repeated key joins all its vectors' classes
        edges = joined(nodes, edges.select(F.col("a").alias("id")), "id").select(F.col("id").alias("a"), F.col("c").alias("b"))
    links = None
    if dim:
        pivots = pivots_of(classes, kind, dim, radius)
        sent, n = routed(homes(classes, kind, pivots), kind, pivots, radius)
        found = met(sent, n, kind, dim, least)
        links = found.groupBy("c").agg(F.sum("links").alias("links"))
        edges = edges.unionByName(found.select(F.col("c").alias("a"), F.col("other").alias("b")))
        links = written(links, "links_of")
        told = joined(named, links, "c", "left").select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        loose = told.unionByName(loose)
    grouped = joined(keys.select("id", "c"), components(edges), "c", "left").select("id", F.coalesce("component", "c").alias("component_id"))
    out = joined(loose, written(grouped, "grouped"), "id", "left").select(F.col("id").alias(key), "n_links", "component_id")
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def op13_range_join(spark, sf_dir: str) -> DataFrame:
    return near_vectors(load(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


OP13_SQL = """
WITH RECURSIVE vecs AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM vecs a JOIN vecs b ON len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM vecs UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
told AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id IS NULL OR vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN told USING (vec_id) LEFT JOIN counts USING (vec_id)
"""
