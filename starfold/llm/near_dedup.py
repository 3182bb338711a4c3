"""MinHash near-dedup: one-permutation hashing with optimal densification, banded
buckets, star-shaped candidate edges, and links confirmed on the full sets.

Stars only say which documents may be linked.  All that one center's stars hold
are compared with each other, so no link is lost when the center is similar to
neither of two documents that are similar to each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.llm.common import load, shuffle_parts, written
from starfold.llm.words import ANY, U64, bounds, grams, hashes, mix, slices, spread

SHINGLE, PERCENT = 5, 75
#: A pair at the limit shares no band with a chance of (1 - 0.75**ROWS)**BANDS, under 1e-6.
BANDS, ROWS = 40, 4
BINS = BANDS * ROWS
#: Classes and shingles that are compared with each other in one task, about; larger clusters meet block by block.
BLOCK, SHINGLES = 512, 1 << 19
#: Rows of a group up to which a shingle's pairs are counted one by one.
FEW = 16
_RANDOM = np.random.default_rng(7)
#: For each bin, in which order the others lend it their value if it is empty.
_LENDERS = np.array([_RANDOM.permutation(BINS) for _ in range(BINS)])
_ROW = mix(np.arange(1, ROWS + 1, dtype=U64)) | U64(1)
_BAND = mix(np.arange(1000, 1000 + BANDS, dtype=U64))


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row in ascending order, and the n + 1 offsets of the rows in them."""
    starts, ends, woff = bounds(data, offs, ANY)
    h = hashes(data, starts, ends, True)
    g = grams(h, SHINGLE)
    sets = []
    for a, b in zip(woff[:-1].tolist(), woff[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            sets.append(np.unique(g[a : b - SHINGLE + 1]))
        elif b > a:
            sets.append(grams(h[a:b], b - a) + U64(b - a))
        else:
            sets.append(h[:0])
    return np.concatenate(sets) if sets else h[:0], np.cumsum([0, *map(len, sets)])


def bins(sets: np.ndarray, soff: np.ndarray) -> np.ndarray:
    """The mixed values of each row's bins (rows without shingles: of no use).

    One permutation: the value of a bin is the least hash whose leading part
    falls there.  An empty bin takes that of another, in an order that depends
    on the bin alone.
    """
    n = len(soff) - 1
    row = np.repeat(np.arange(n), np.diff(soff))
    cell = row * BINS + ((sets >> U64(32)) * U64(BINS) >> U64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    values, full = np.zeros(n * BINS, U64), np.zeros(n * BINS, bool)
    values[cell[first]], full[cell[first]] = sets[first], True
    own = full.reshape(n, BINS).copy()
    values = values.reshape(n, BINS)
    empty = np.argwhere(~own & (np.diff(soff) > 0)[:, None])
    for k in range(BINS):
        if not len(empty):
            break
        lender = _LENDERS[empty[:, 1], k]
        good = own[empty[:, 0], lender]
        at = empty[good]
        values[at[:, 0], at[:, 1]] = values[at[:, 0], lender[good]]
        empty = empty[~good]
    return mix(values)


def bands(sets: np.ndarray, soff: np.ndarray) -> np.ndarray:
    """Band keys of each row (rows without shingles: of no use)."""
    mixed = bins(sets, soff).reshape(-1, BANDS, ROWS)
    return mix((mixed * _ROW).sum(axis=2, dtype=U64) ^ _BAND)


def set_sums(sets: np.ndarray, soff: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each row's set."""
    sums = (np.concatenate(([U64(0)], np.cumsum(mix(sets ^ U64(k)), dtype=U64))) for k in (0x51ED270B, 0xA24BAED4963EE407))
    return [(x[soff[1:]] - x[soff[:-1]]).view(np.int64) for x in sums]


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, n_shingles, two hashes of the set, and its band keys (null without shingles)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in slices(batch, text):
                sets, soff = shingle_sets(data, offs)
                sizes, keys = np.diff(soff), bands(sets, soff)
                none = pa.array(sizes == 0)
                held = [pa.array(x) for x in set_sums(sets, soff)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(sizes) + 1) * BANDS, BANDS), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(key)), pa.array(sizes), *(pc.if_else(none, None, x) for x in held), pc.if_else(none, None, lists)], names=["id", "n_shingles", "sa", "sb", "bands"])

    return docs.select(key, text).mapInArrow(sketch, "id long, n_shingles long, sa long, sb long, bands array<long>")


def joined(a: DataFrame, b: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by shuffle at every size: nothing that grows with the corpus is broadcast."""
    return a.join(b.hint("merge"), on, how)


def forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least row of each row's component, with links x - y among n rows."""
    least = np.arange(n)
    while True:
        before = least.copy()
        both = np.minimum(least[x], least[y])
        np.minimum.at(least, x, both)
        np.minimum.at(least, y, both)
        least = least[least]
        if (before == least).all():
            return least


def similar(group: np.ndarray, ok: Callable[[np.ndarray, np.ndarray], np.ndarray], sets: np.ndarray, soff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows x < y of one group that ``ok`` lets meet and whose full sets are similar enough.

    Rows of a group lie together.  What two sets have in common is counted
    exactly: a shingle of a few rows by its pairs, one of many as a column of
    the group's incidence matrix, multiplied with itself.
    """
    n, size = len(group), np.diff(soff)
    row = np.repeat(np.arange(n), size)
    first = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
    ends = np.append(first[1:], n)
    place = np.repeat(np.arange(len(first)), ends - first)
    value = mix(sets ^ (place.astype(U64) * U64(0x9E3779B97F4A7C15))[row])
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    start = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(value)))
    rank = np.arange(len(value)) - np.repeat(start, length)
    of = np.repeat(length, length)
    pairs = []
    for d in range(1, FEW):
        at = np.flatnonzero((of <= FEW) & (rank + d < of))
        if not len(at):
            break
        x, y = row[at], row[at + d]
        good = ok(x, y)
        pairs.append(x[good] * n + y[good])
    codes, common = np.unique(np.concatenate(pairs) if pairs else np.zeros(0, np.int64), return_counts=True)
    found = []
    many = np.flatnonzero(length > FEW)
    dense = place[row[start[many]]]
    whole = np.zeros(len(first), bool)
    whole[dense] = True
    for g in np.unique(dense).tolist():
        lo, hi = first[g], ends[g]
        m = int(hi - lo)
        both = np.zeros((m, m), np.float32)
        runs = many[dense == g]
        for k in range(0, len(runs), 4096):
            part = runs[k : k + 4096]
            held = np.zeros((m, len(part)), np.float32)
            at = spread(length[part])
            held[row[np.repeat(start[part] - np.cumsum(length[part]) + length[part], length[part]) + np.arange(len(at))] - lo, at] = 1
            both += held @ held.T
        mine = slice(*np.searchsorted(codes, (lo * n, hi * n)))
        both[codes[mine] // n - lo, codes[mine] % n - lo] += common[mine]
        x, y = np.nonzero(np.triu((100 + PERCENT) * both >= PERCENT * (size[lo:hi, None] + size[None, lo:hi]), 1))
        good = (both[x, y] > 0) & ok(x + lo, y + lo)
        found.append(np.stack((x[good] + lo, y[good] + lo)))
    x, y = codes // max(n, 1), codes % max(n, 1)
    good = ~whole[place[x]] & ((100 + PERCENT) * common >= PERCENT * (size[x] + size[y]))
    return tuple(np.concatenate([np.stack((x[good], y[good])), *found], axis=1))


def links(rows: DataFrame) -> DataFrame:
    """(a, b): links that join the ids of each group as all of its similar pairs do.

    rows has (g, c, component, side, text): a group, an id with its component and
    one of its texts.  Only texts of different components meet, and of different
    sides unless the side is 0.
    """
    met = rows.repartition(shuffle_parts(rows.sparkSession), "g").sortWithinPartitions("g")

    def solve(held: list[np.ndarray]) -> pa.RecordBatch:
        g, c, component, side, size, sets = held
        order = np.lexsort((c, g))  # a group's least id is its first row
        start = (np.cumsum(size) - size)[order]
        g, c, component, side, size = (x[order] for x in (g, c, component, side, size))
        soff = np.concatenate(([0], np.cumsum(size)))
        sets = sets[np.repeat(start - soff[:-1], size) + np.arange(soff[-1])]

        def ok(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            alike = 100 * np.minimum(size[x], size[y]) >= PERCENT * np.maximum(size[x], size[y])
            return alike & (component[x] != component[y]) & ((side[x] != side[y]) | (side[x] == 0))

        least = forest(len(c), *similar(g, ok, sets, soff))
        new = np.flatnonzero(c[least] != c)
        return pa.RecordBatch.from_pydict({"a": pa.array(c[new], pa.int64()), "b": pa.array(c[least[new]], pa.int64())})

    def part_of(one: list[np.ndarray], keep: np.ndarray) -> list[np.ndarray]:
        return [*(x[keep] for x in one[:5]), one[5][np.repeat(keep, one[4])]]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for part, data, offs in slices(batch, "text"):
                sets, soff = shingle_sets(data, offs)
                held.append([*(part.column(part.schema.get_field_index(x)).to_numpy() for x in ("g", "c", "component", "side")), np.diff(soff), sets])
                total += len(sets)
                if total >= SHINGLES:
                    one = [np.concatenate(x) for x in zip(*held, strict=True)]
                    last = one[0] == one[0][-1]  # a group that may go on
                    if not last.all():
                        yield solve(part_of(one, ~last))
                        one = part_of(one, last)
                    held, total = [one], len(one[5])
        if held:
            yield solve([np.concatenate(x) for x in zip(*held, strict=True)])

    return met.mapInArrow(compare, "a long, b long")


def meet(rows: DataFrame, pool: DataFrame) -> DataFrame:
    """links() between a unit's first and second side, block by block.

    rows has (unit, c, component, side, ka, kb), with ka and kb blocks on the
    sides; pool (c, h, text).  A text goes to one block of its own side, and
    with that to each block of the other.
    """
    own = lambda k: F.pmod(F.xxhash64("c", "h"), F.col(k)).cast("int")
    held = joined(rows, pool, "c").withColumn("x", F.when(F.col("side") == 1, own("ka"))).withColumn("y", F.when(F.col("side") == 2, own("kb")))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 1, F.col("kb")).otherwise(F.col("ka")) - 1)))
    return links(held.select(F.xxhash64("unit", F.coalesce("x", "other"), F.coalesce("y", "other")).alias("g"), "c", "component", "side", "text"))


def components(edges: DataFrame) -> DataFrame:
    """c, component (its least c) of all that edges (a, b) join.

    Large stars (each neighbour above u goes to u's least one) and small stars
    (u and those below it go to the least of them) in turn, until a large star
    changes nothing and no u has two neighbours below it.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m"), F.sum((F.col("v") < F.col("u")).cast("long")).alias("below")), "least")
        large = joined(both.filter("v > u"), least.select("u", F.least("u", "m").alias("m")), "u")
        large = written(large.select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") < F.col("u")).alias("moved")), "large")
        if least.filter("below > 1").isEmpty() and large.filter("moved").isEmpty():
            break
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = joined(large, low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = written(small.distinct(), "links")
    return edges.select(F.col("u").alias("c"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("c"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id, kept: one row per row of ``docs``.

    Rows of equal sets are one class, compared under its least key.  Stars of
    each bucket of each band say which classes may be linked, and the full sets
    of all in a unit of stars are compared with each other (see ``linked``).
    Null and empty texts have no shingles and are linked with nothing.  Rows
    without key are no part of the graph: component_id null, kept true.  Rows
    that repeat a key share its component, which all their texts' links reach.
    Ties: a component is named by its least key.  An empty table gives none; a
    very long text is one set like any other; columns of other names, clashing
    ones too, are neither read nor returned.
    """
    known = written(sketches(docs, key, text), "sketches")
    whole = known.filter("id is not null and sa is not null")
    classes = whole.groupBy("sa", "sb").agg(F.min(F.struct("id", "bands", "n_shingles")).alias("x"))
    classes = written(classes.select("sa", "sb", F.col("x.id").alias("c"), "x.bands", F.col("x.n_shingles").alias("n")), "classes")
    named = written(joined(known.select("id", "n_shingles", "sa", "sb"), classes.select("sa", "sb", "c"), ["sa", "sb"], "left").select("id", "n_shingles", "c"), "rows")
    keys = written(named.filter("c is not null").groupBy("id").agg(F.min("c").alias("a"), F.max("c").alias("last")), "keys")
    found = linked(classes, docs.select(F.col(key).alias("c"), F.col(text).alias("text")))
    repeated = keys.filter("a <> last")
    if not repeated.isEmpty():
        again = joined(named.filter("c is not null"), repeated.select("id", "a"), "id").select("a", F.col("c").alias("b"))
        found = components(again.unionByName(found.select(F.col("c").alias("a"), F.col("component").alias("b"))))
    told = joined(keys.select("id", F.col("a").alias("c")), found, "c", "left").select("id", F.coalesce("component", "c").alias("component_id"))
    out = joined(named.select("id", "n_shingles"), told, "id", "left").select(F.col("id").alias(key), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def linked(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """c, component of all ids that are linked with another.

    classes has (c, bands, n), texts (c, text).  A bucket's star goes from its
    least id, and stars of one center are a unit, so two ids that share a bucket
    share a unit.  All texts of a unit that fits a task are compared there.  In
    a larger one each id first meets the center it shares most buckets with;
    then, if several components are left, all outside the largest meet all
    others, block by block.
    """
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / SHINGLES)).cast("int")
    dealt = classes.select("c", "n", F.explode("bands").alias("bucket"))
    heads = dealt.groupBy("bucket").agg(F.min("c").alias("unit"), F.max("c").alias("last")).filter("unit <> last").select("bucket", "unit")
    units = written(joined(dealt, heads, "bucket").groupBy("unit", "c").agg(F.count(F.lit(1)).alias("shared"), F.max("n").alias("n")), "units")
    units = written(joined(units, units.groupBy("unit").agg(blocks.alias("k")), "unit"), "units")
    large = F.col("k") > 1
    members = units.groupBy("c").agg(F.collect_list(F.when(~large, F.col("unit"))).alias("small"), F.max(F.when(large, F.struct("shared", (-F.col("unit")).alias("unit"), "k"))).alias("best"))
    members = written(members, "members")  # a class has a unit for each band at most
    live = joined(texts, members.select("c", "small"), "c").withColumn("h", F.xxhash64("text")).dropDuplicates(["c", "h"])
    live = written(live, "live")
    found = written(links(live.select(F.explode("small").alias("g"), "c", F.col("c").alias("component"), F.lit(0).alias("side"), "text")), "links")
    far = units.filter(large)
    if far.isEmpty():
        return components(found)
    pool = joined(live.select("c", "h", "text"), members.filter("best is not null").select("c"), "c")
    leaves = members.filter("best is not null").select((-F.col("best.unit")).alias("unit"), "c", F.col("c").alias("component"), F.lit(2).alias("side"), F.lit(1).alias("ka"), F.col("best.k").alias("kb"))
    centers = far.filter("unit = c").select("unit", "c", F.col("c").alias("component"), F.lit(1).alias("side"), F.lit(1).alias("ka"), F.col("k").alias("kb"))
    found = components(found.unionByName(written(meet(centers.unionByName(leaves), pool), "links")))
    rows = joined(far.select("unit", "c", "n"), found, "c", "left").withColumn("component", F.coalesce("component", "c"))
    rows = written(rows, "unsettled")
    parts = rows.groupBy("unit", "component").agg(F.count(F.lit(1)).alias("ids"), F.sum("n").alias("n"))
    sides = parts.groupBy("unit").agg(F.max(F.struct("ids", "n", "component")).alias("most"), F.sum("ids").alias("ids"), F.sum("n").alias("n")).filter("ids > most.ids")
    count = lambda ids, n: F.greatest(F.ceil(ids / BLOCK), F.ceil(n / SHINGLES)).cast("int")
    sides = sides.select("unit", F.col("most.component").alias("most"), count(F.col("ids") - F.col("most.ids"), F.col("n") - F.col("most.n")).alias("ka"), count(F.col("ids"), F.col("n")).alias("kb"))
    rows = written(joined(rows, sides, "unit").select("unit", "c", "component", F.explode(F.when(F.col("component") == F.col("most"), F.array(F.lit(2))).otherwise(F.array(F.lit(1), F.lit(2)))).alias("side"), "ka", "kb"), "sides")
    more = written(meet(rows, pool), "links")
    if more.isEmpty():
        return found
    return components(more.unionByName(found.select(F.col("c").alias("a"), F.col("component").alias("b"))))


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))
