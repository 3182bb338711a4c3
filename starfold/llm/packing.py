"""Token-ID output: exact BPE ids, best-fit-decreasing packing with a segment tree over
capacities, and packed id matrices with cumulative lengths and position resets."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.llm.common import load
from starfold.llm.words import hashes, slices

#: Where the tokenizer's file lies on every machine, how it splits text, and its free id.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published split pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_ID = 50256
LENGTH, SHARD_TOKENS, MATRIX_ROWS = 2048, 1 << 22, 128


@lru_cache(maxsize=2)
def encoder(path: str = RANKS, pattern: str = PATTERN) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: First bytes of characters that may be white space beyond ASCII.
_MAYBE = np.zeros(256, bool)
_MAYBE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def piece_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where texts can be cut so that their parts have the ids of the whole.

    The split pattern never lets a token run across a single blank or newline
    between two characters that are no white space: a blank begins the next
    token, a newline is a token.  Characters that may be other white space count
    as such.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        before, at, after = data[:-2], data[1:-1], data[2:]
        wide = before >= 0x80
        wide[1:] &= data[: n - 3] != 0xC3
        alone = (at == 0x20) | (at == 0x0A)
        alone &= ~(_SPACE[before] | wide | _SPACE[after] | _MAYBE[after])
        spot = np.flatnonzero(alone) + 1
        cut[spot] = True
        cut[spot[data[spot] == 0x0A] + 1] = True
    cut[offs] = True
    return np.flatnonzero(cut[:n])


def ragged(flat: np.ndarray, offs: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``which`` of a ragged array, one after another, and their offsets."""
    sizes = np.diff(offs)[which]
    out = np.concatenate(([0], np.cumsum(sizes)))
    return flat[np.arange(out[-1]) + np.repeat(offs[which] - out[:-1], sizes)], out


def token_ids(data: np.ndarray, offs: np.ndarray, enc: tiktoken.Encoding) -> tuple[np.ndarray, np.ndarray]:
    """ids of all rows and their n + 1 offsets.  Pieces that repeat are encoded once."""
    starts = piece_starts(data, offs)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
    ends = np.append(starts[1:], len(data))
    _, first, back = np.unique(hashes(data, starts, ends, False), return_index=True, return_inverse=True)
    raw = data.tobytes()
    pieces = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    sizes = np.array([len(p) for p in pieces])
    again, _ = ragged(np.frombuffer(b"".join(pieces), np.uint8), np.concatenate(([0], np.cumsum(sizes))), back)
    if not np.array_equal(again, data):  # two pieces of one hash
        pieces, back = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.arange(len(starts))
    made = [enc.encode_ordinary(p.decode()) for p in pieces]
    sizes = np.array([len(x) for x in made])
    flat = np.fromiter((i for x in made for i in x), np.int32, int(sizes.sum()))
    ids, at = ragged(flat, np.concatenate(([0], np.cumsum(sizes))), back)
    return ids, at[np.searchsorted(starts, offs)]


class Capacities:
    """A segment tree over remaining capacities: the open bins of each, and the least one that fits."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: dict[int, list[int]] = {}

    def add(self, capacity: int, item: int) -> None:
        self.bins.setdefault(capacity, []).append(item)
        at = capacity + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The bin of the least capacity of ``least`` at least, and that capacity; it is taken out."""
        at = least + self.leaves
        while not self.count[at]:
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
            if at & (at - 1) == 0:
                return None
        while at < self.leaves:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        while at:
            self.count[at] -= 1
            at >>= 1
        return self.bins[capacity].pop(), capacity


def best_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Bins of item numbers, none over ``length``; equal sizes go in their order."""
    tree, bins = Capacities(length), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = tree.take(size)
        if found is None:
            bins.append([i])
            tree.add(length - size, len(bins) - 1)
        else:
            bins[found[0]].append(i)
            tree.add(found[1] - size, found[0])
    return bins


SCHEMA = "shard long, matrix int, n_rows int, length int, ids binary, n_tokens array<int>, cu_lengths array<array<int>>, position_resets array<array<int>>, doc_ids array<array<long>>, chunks array<array<int>>"


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, ranks: str = RANKS, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Packed matrices of little-endian uint16 ids, ``n_rows`` by ``length``, filled up with ``end_id``.

    Each document is its ids and one ``end_id``, so empty and null texts are one
    id long.  Those over ``length`` are cut into chunks of it, without loss.
    Per row of a matrix: tokens in use, cumulative lengths of its segments,
    where positions start again at 0, and each segment's document and chunk.
    Documents are packed in shards of about ``shard_tokens`` as they lie in the
    input's partitions: no shuffle, bounded memory, and a lost task is made
    again from its part alone.  Null and repeated keys are carried as they are.
    """

    def write(shard: int, ids: np.ndarray, offs: np.ndarray, keys: list) -> Iterator[pa.RecordBatch]:
        n = np.diff(offs)
        per = -(-n // length)
        doc = np.repeat(np.arange(len(n)), per)
        chunk = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        at = offs[doc] + chunk * length
        size = np.minimum(length, offs[doc + 1] - at)
        bins = best_fit_decreasing(size, length)
        for m in range(0, len(bins), MATRIX_ROWS):
            rows = bins[m : m + MATRIX_ROWS]
            out = np.full((len(rows), length), end_id, "<u2")
            sums = []
            for r, items in enumerate(rows):
                ends = np.cumsum(size[items]).tolist()
                sums.append([0, *ends])
                for i, end in zip(items, ends, strict=True):
                    out[r, end - size[i] : end] = ids[at[i] : at[i] + size[i]]
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int64()), "matrix": pa.array([m // MATRIX_ROWS], pa.int32()), "n_rows": pa.array([len(rows)], pa.int32()), "length": pa.array([length], pa.int32()),
                "ids": pa.array([out.tobytes()], pa.binary()), "n_tokens": pa.array([[s[-1] for s in sums]], pa.list_(pa.int32())), "cu_lengths": pa.array([sums], pa.list_(pa.list_(pa.int32()))),
                "position_resets": pa.array([[s[:-1] for s in sums]], pa.list_(pa.list_(pa.int32()))), "doc_ids": pa.array([[[keys[doc[i]] for i in items] for items in rows]], pa.list_(pa.list_(pa.int64()))),
                "chunks": pa.array([[chunk[items].tolist() for items in rows]], pa.list_(pa.list_(pa.int32()))),
            })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        shard, held, keys, total = TaskContext.get().partitionId() << 24, [], [], 0
        for batch in batches:
            for part, data, offs in slices(batch, text, 1 << 20):
                ids, at = token_ids(data, offs, enc)
                n = np.diff(at) + 1
                whole = np.full(int(n.sum()), end_id, "<u2")
                stops = np.cumsum(n)
                inner = np.ones(len(whole), bool)
                inner[stops - 1] = False
                whole[inner] = ids
                held.append((whole, n))
                keys += part.column(part.schema.get_field_index(key)).to_pylist()
                total += len(whole)
                if total >= shard_tokens:
                    yield from write(shard, np.concatenate([x for x, _ in held]), np.concatenate(([0], np.cumsum(np.concatenate([x for _, x in held])))), keys)
                    shard, held, keys, total = shard + 1, [], [], 0
        if keys:
            yield from write(shard, np.concatenate([x for x, _ in held]), np.concatenate(([0], np.cumsum(np.concatenate([x for _, x in held])))), keys)

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, SCHEMA)


def unpack(packed: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, text: the documents of ``pack``, of distinct ids, read back."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], "<u2").reshape(r["n_rows"], r["length"])
                rows = [(d, c, ids[k, a:b].tobytes()) for k in range(r["n_rows"]) for d, c, a, b in zip(r["doc_ids"][k], r["chunks"][k], r["cu_lengths"][k][:-1], r["cu_lengths"][k][1:], strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([x[0] for x in rows], pa.int64()), "chunk": pa.array([x[1] for x in rows], pa.int32()), "ids": pa.array([x[2] for x in rows], pa.binary())})

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for batch in batches:
            out = [enc.decode(np.frombuffer(b"".join(x["ids"] for x in r), "<u2")[:-1].tolist()) for r in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(out, pa.string())})

    found = packed.mapInArrow(segments, "doc_id long, chunk int, ids binary")
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts")).mapInArrow(texts, "doc_id long, text string")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))
