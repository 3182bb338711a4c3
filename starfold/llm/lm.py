"""LM scoring: hashed-context bit predictors in a logistic mix, and a smoothed unigram base.

A text is coded as its bytes and an end symbol, each a path of bits in a Huffman
tree of the training bytes.  Every context predicts each bit from counts under a
hash of context and tree node.  A predictor's weight is gated by how often the
slot was seen; the mix is refined online in each document, block by block, from
the bits before.  All that is learned from the training documents has a fixed
size, so it can be sent to every task; only sums over the corpus feed it.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.llm.classifier import remainder
from starfold.llm.common import load
from starfold.llm.shards import answered, body, chunks, exchanged, joined, n_buckets, opened, pressed, send, shards, total_of
from starfold.llm.words import ANY, U64, _BYTE_LOWER, _powers, bounds, hashes

END = 256
#: Slots of each predictor, as powers of two: two bytes before, four bytes before, the word so far.
SLOTS = (18, 19, 20)
STARTS = np.concatenate(([0], np.cumsum([1 << b for b in SLOTS])))
#: Gates: how often a slot was seen, by powers of two.
GATES = 10
#: What part each predictor's fitted chances have in the mix before a document refines it.
SHARES = (0.3, 0.6, 0.5)
#: A document's own weights are refined after its first 64 bits, then as often as its bits have doubled, then after each so many; and how strongly.
FIRST, BLOCK, RATE = 64, 1024, 4e-3
TABLE_BLOCKS = 64
U32 = np.uint32


@dataclass(frozen=True)
class Code:
    """Paths of the 257 symbols: nodes[at[s]:at[s + 1]] and their bits."""

    at: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray


def huffman(counts: np.ndarray) -> Code:
    heap = [(int(n) + 1, s, s) for s, n in enumerate(counts)]
    heapq.heapify(heap)
    parent, node = {}, 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        name = ("n", node)
        parent[a[2]], parent[b[2]] = (node, 0, name), (node, 1, name)
        heapq.heappush(heap, (a[0] + b[0], 1000 + node, name))
        node += 1
    paths = []
    for s in range(len(counts)):
        path, here = [], s
        while here in parent:
            n, bit, here = parent[here]
            path.append((n, bit))
        paths.append(path[::-1])
    return Code(np.cumsum([0, *map(len, paths)]), np.array([n for p in paths for n, _ in p], U32), np.array([b for p in paths for _, b in p], np.uint8))


def symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the rows with an end symbol after each, and the rows' offsets."""
    ends = offs[1:] + np.arange(len(offs) - 1)
    out = np.full(len(data) + len(ends), END, np.int32)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = data
    return out, np.concatenate(([0], ends + 1))


def contexts(s: np.ndarray) -> list[np.ndarray]:
    """A 32-bit hash of each predictor's context at every symbol.  Nothing before a text's start counts."""
    n = len(s)
    padded = np.concatenate((np.full(4, END, np.int32), s)).astype(U32)
    b = [padded[4 - k : 4 - k + n] for k in range(5)]
    for k in range(2, 5):  # what lies before an end belongs to another text
        b[k] = np.where(b[k - 1] == END, U32(END), b[k])
    two = b[1] * U32(0x2F0B4C47) + b[2] * U32(0x1B873593)
    four = two + b[3] * U32(0x9E3779B1) + b[4] * U32(0x85EBCA77)
    inside = (s < END) & ANY[np.minimum(s, 255)]
    up, down = _powers(max(21, int(n).bit_length()))
    sums = np.zeros(n + 1, U64)
    np.cumsum(np.where(inside, _BYTE_LOWER[np.minimum(s, 255)], U64(0)) * up[:n], out=sums[1:])
    start = np.maximum.accumulate(np.concatenate(([0], np.where(inside, 0, np.arange(1, n + 1))))[:n])
    word = (sums[:n] - sums[start]) * down[start]
    return [two * U32(0xCC9E2D51), four ^ (four >> U32(15)), ((word ^ (word >> U64(29))) >> U64(3)).astype(U32) * U32(0xC2B2AE35) + U32(77)]


def kinds(s: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each predictor the distinct (context, symbol) of a chunk, and how often each occurs."""
    out = []
    for context in contexts(s):
        both = np.sort(context.astype(U64) << U64(9) | s.astype(U64))
        first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, np.int64)
        out.append(((both[first] >> U64(9)).astype(U32), (both[first] & U64(511)).astype(np.int32), np.diff(np.append(first, len(both)))))
    return out


def spots(s: np.ndarray, code: Code) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Slots of every bit in each predictor's table, the bits, and how many each symbol has."""
    n_bits = np.diff(code.at)[s]
    at = bit_places(s, n_bits, code)
    salt = (code.nodes * U32(0x9E3779B1))[at]
    return [slots(context, n_bits, salt, width) for context, width in zip(contexts(s), SLOTS, strict=True)], code.bits[at], n_bits


def bit_places(s: np.ndarray, n_bits: np.ndarray, code: Code) -> np.ndarray:
    """Where the bits of the symbols stand in ``code``."""
    at = np.repeat(code.at[s] - (np.cumsum(n_bits) - n_bits), n_bits)
    at += np.arange(len(at))
    return at


def slots(context: np.ndarray, n_bits: np.ndarray, salt: np.ndarray, width: int) -> np.ndarray:
    x = np.repeat((context ^ (context >> U32(16))) * U32(0x85EBCA6B), n_bits)
    x ^= salt
    x *= U32(0xC2B2AE35)
    x >>= U32(32 - width)
    return x


def stretched(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + 0.2) / (n0 + 0.2))


def gate(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(n + 1), GATES - 1).astype(np.int64)


def squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def block_edges(n: int) -> np.ndarray:
    """Bits of a document of n after which its weights are refined, from 0 on, the last at n or beyond."""
    doubled = FIRST << np.arange((BLOCK // FIRST).bit_length())
    return np.concatenate(([0], doubled, np.arange(2 * BLOCK, n + BLOCK, BLOCK)))


def gated_weights(counts: np.ndarray, rounds: int = 8) -> np.ndarray:
    """For each predictor and gate the weight under which its chances fit best, over all training bits.

    A slot's counts say how often either bit came in it, so sums over slots are
    sums over bits; each bit is left out of the counts that predict it.
    """
    out = np.full((len(SLOTS), GATES), 1.0)
    for k in range(len(SLOTS)):
        n = counts[STARTS[k] : STARTS[k + 1]].astype(float)
        n = n[n.sum(axis=1) > 0]
        g = gate(n.sum(axis=1) - 1)
        for _ in range(rounds):
            slope, bend = np.zeros(GATES), np.full(GATES, 1e-3)
            for bit in (0, 1):
                x = np.log((np.maximum(n[:, bit] - 1, 0) + 0.2) / (n[:, 1 - bit] + 0.2))
                p = squash(out[k][g] * x)
                slope += np.bincount(g, n[:, bit] * (1 - p) * x, GATES)
                bend += np.bincount(g, n[:, bit] * p * (1 - p) * x * x, GATES)
            out[k] = np.clip(out[k] + np.clip(slope / bend, -0.5, 0.5), 0, 2)
    return out


@dataclass(frozen=True)
class Mixer:
    """tables: for every slot of all predictors, its gated weight times its stretched probability."""

    code: Code
    tables: np.ndarray

    def parts(self, s: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        at, bits, n_bits = spots(s, self.code)
        return [self.tables[STARTS[k] : STARTS[k + 1]][x] for k, x in enumerate(at)], bits, n_bits

    def log10(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Of each row, the log10 probability of its bytes and its end.

        A document starts with the corpus' weights.  After every block each
        predictor's weight takes a step of its own along the block's gradient,
        so each bit's probability depends on what was read before it alone.
        The documents' blocks of one rank go together.
        """
        s, soff = symbols(data, offs)
        t, bits, n_bits = self.parts(s)
        boff = np.concatenate(([0], np.cumsum(n_bits)))[soff]
        sign = 1 - 2 * bits.astype(np.float32)
        x = [v * sign for v in t]  # stretched probabilities of what did not happen
        lengths = np.diff(boff)
        edges = block_edges(int(lengths.max(initial=0)))
        n_blocks = np.searchsorted(edges, lengths)
        order = np.argsort(-n_blocks, kind="stable")
        falling = -n_blocks[order]
        own = np.ones((len(x), len(order)), np.float32)
        out = np.zeros(len(order))
        for k in range(int(n_blocks.max(initial=0))):
            docs = order[: np.searchsorted(falling, -k)]
            starts = boff[docs] + edges[k]
            sizes = np.minimum(boff[docs + 1] - starts, edges[k + 1] - edges[k])
            first = np.cumsum(sizes) - sizes
            at = np.repeat(starts - first, sizes)
            at += np.arange(len(at))
            now = [v[at] for v in x]
            z = sum(v * np.repeat(w[docs], sizes) for v, w in zip(now, own, strict=True))
            odds = np.exp(np.minimum(z, 20, out=z), out=z)
            out[docs] -= np.add.reduceat(np.log1p(odds), first, dtype=float)
            odds /= 1 + odds
            for v, w in zip(now, own, strict=True):
                w[docs] = np.clip(w[docs] - RATE * np.add.reduceat(v * odds, first, dtype=float), 0.5, 1.5)
        return out / np.log(10)


def _summed(rows: DataFrame, parts: int) -> DataFrame:
    """Rows (part, block, v) of equal-length int64 vectors, added up by block, 64 parts at a time."""

    def add(table: pa.Table) -> pa.Table:
        total = None
        for v in table.column("v"):
            now = opened(v.as_py(), np.int64)
            total = now.copy() if total is None else total + now
        return pa.table({"part": table.column("part")[:1], "block": table.column("block")[:1], "v": pa.array([pressed(total)], pa.binary())})

    while True:
        rows = rows.withColumn("part", F.floor(F.col("part") / 64)).groupBy("part", "block").applyInArrow(add, "part long, block int, v binary")
        parts = -(-parts // 64)
        if parts <= 1:
            return rows


def _train_rows(ids: list, of: int, out: int) -> np.ndarray:
    return np.array([i is None or zlib.crc32(str(i).encode()) % of != out for i in ids], bool)


def train(table: DataFrame, of: int, out: int) -> Mixer:
    """Counts of all training bits in the tables, and the gates' weights, which follow from the counts."""
    spark = table.sparkSession
    parts = table.agg(F.coalesce(F.max("shard"), F.lit(0))).first()[0] // (1 << 24) + 1

    def per_task(work, size: int, n_blocks: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size, np.int64)
            for batch in batches:
                for row in batch.to_pylist():
                    data, offs = body(row)
                    known = _train_rows(row["ids"], of, out)
                    for lo, hi, part, at in chunks(data, offs, 1 << 19):
                        keep = known[lo:hi]
                        if not keep.all():
                            part = part[np.repeat(keep, np.diff(at))]
                            at = np.concatenate(([0], np.cumsum(np.diff(at)[keep])))
                        if len(at) > 1:
                            work(total, part, at)
            step = -(-size // n_blocks)
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()] * n_blocks, pa.int64()), "block": pa.array(range(n_blocks), pa.int32()), "v": pa.array([pressed(total[b * step : (b + 1) * step]) for b in range(n_blocks)], pa.binary())})

        rows = _summed(table.mapInArrow(run, "part long, block int, v binary"), max(parts, 1 << 18 if parts > 4096 else 4096)).orderBy("block").collect()
        return np.concatenate([opened(r["v"], np.int64) for r in rows]) if rows else np.zeros(size, np.int64)

    def tally(total, part, at):
        total += np.bincount(symbols(part, at)[0], minlength=257)

    code = huffman(per_task(tally, 257, 1))
    size = int(STARTS[-1])

    def count(total, part, at):
        for k, (context, symbol, often) in enumerate(kinds(symbols(part, at)[0])):
            n_bits = np.diff(code.at)[symbol]
            places = bit_places(symbol, n_bits, code)
            x = slots(context, n_bits, (code.nodes * U32(0x9E3779B1))[places], SLOTS[k])
            a, n = 2 * STARTS[k], 2 << SLOTS[k]
            total[a : a + n] += np.bincount(x.astype(np.int64) * 2 + code.bits[places], np.repeat(often, n_bits), n).astype(np.int64)

    counts = per_task(count, 2 * size, TABLE_BLOCKS).reshape(size, 2)
    weights = gated_weights(counts)
    tables = np.zeros(size, np.float32)
    for k in range(len(SLOTS)):
        n = counts[STARTS[k] : STARTS[k + 1]]
        tables[STARTS[k] : STARTS[k + 1]] = SHARES[k] * weights[k][gate(n.sum(axis=1))] * stretched(n[:, 0], n[:, 1])
    return Mixer(code, tables)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", of: int = 5, out: int = 1) -> DataFrame:
    """One row of ``SCORES`` per document.

    Learns from documents whose crc32(doc_id) modulo ``of`` is not ``out``; null
    ids train.  Null and empty texts are an end alone.  Counts of tokens go by
    shard through hash buckets: each shard sends its distinct words once, and
    gets back the corpus' counts of just these.  With no training documents the
    base and the mix know nothing, and score so.  Rows that repeat a doc_id are
    scored, and train, each by its own text; a very long text is scored whole;
    columns of other names are neither read nor returned; an empty table gives none.
    """
    spark = docs.sparkSession
    table = shards(docs, key, text)
    n = n_buckets(table)

    def words_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
        data, offs = body(row)
        found, places = [], [np.zeros(1, np.int64)]
        for _, _, part, at in chunks(data, offs, 1 << 21):
            starts, ends, woff = bounds(part, at, ANY)
            found.append(hashes(part, starts, ends, True))
            places.append(woff[1:] + places[-1][-1])
        return (np.concatenate(found) if found else np.zeros(0, U64)), np.concatenate(places)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, woff = words_of(row)
                keys, back = np.unique(h, return_inverse=True)
                known = np.repeat(_train_rows(row["ids"], of, out), np.diff(woff))
                yield send(row["shard"], keys, np.bincount(back, known, minlength=len(keys)).astype(np.int32), n)

    def merge(lists: list[np.ndarray], extras: list[bytes]) -> tuple[list[np.ndarray], list[int]]:
        keys, sums = total_of(lists, [opened(e, np.int32) for e in extras])
        return [sums[np.searchsorted(keys, k)] for k in lists], [int((sums > 0).sum()), int(sums.sum())]

    answers = exchanged(table.mapInArrow(tell, "bucket int, shard long, keys binary, extra binary"), merge)
    told = answers.filter("shard is null").agg(F.coalesce(F.sum(F.col("told")[0]), F.lit(0)), F.coalesce(F.sum(F.col("told")[1]), F.lit(0))).first()
    ends = docs.select(key).filter(remainder(F.col(key), of) != out if out else F.col(key).isNull() | (remainder(F.col(key), of) != out)).count()
    v, total = told[0] + (ends > 0), told[1] + ends
    mixer = spark.sparkContext.broadcast(train(table, of, out))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, woff = words_of(row)
                counts = joined(row["answers"], np.int64)[np.unique(h, return_inverse=True)[1]] if len(h) else np.zeros(0, np.int64)
                low = np.log10(total + 0.5 * (v + 1))
                sums = np.concatenate(([0.0], np.cumsum(np.log10(counts + 0.5) - low)))
                seen = np.concatenate(([0], np.cumsum(counts > 0)))
                data, offs = body(row)
                bits = np.concatenate([mixer.value.log10(part, at) for _, _, part, at in chunks(data, offs, 1 << 18)]) if row["ids"] else np.zeros(0)
                n_tokens = np.diff(woff) + 1
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array(~_train_rows(row["ids"], of, out)), "n_tokens": pa.array(n_tokens), "n_known": pa.array(seen[woff[1:]] - seen[woff[:-1]] + (ends > 0)),
                    "train_tokens": pa.array([total] * len(n_tokens), pa.int64()), "base_score": pa.array(sums[woff[1:]] - sums[woff[:-1]] + np.log10(ends + 0.5) - low), "score": pa.array(bits),
                    "bits_per_byte": pa.array(-bits * np.log2(10) / np.maximum(np.diff(offs), 1)),
                })

    return answered(table, answers).mapInArrow(rate, SCORES)


def op9_lm(spark, sf_dir: str) -> DataFrame:
    return score(load(spark, sf_dir, "documents"))
