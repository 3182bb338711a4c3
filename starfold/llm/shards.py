"""Documents in compressed shards, and sorted key lists that shards exchange through buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.llm.common import written
from starfold.llm.words import U64, slices

#: Bytes of text of a shard (a longer text is a shard alone), and of text behind one bucket.
SHARD_BYTES, BUCKET_BYTES = 1 << 23, 1 << 22


def pressed(a: np.ndarray | bytes) -> bytes:
    raw = a if isinstance(a, bytes) else a.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def opened(blob: bytes, kind: str | type = np.uint8) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True), kind)


def pressed_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys by planes of bytes: the upper ones hardly change."""
    return pressed(np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8).T))


def opened_keys(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(opened(blob).reshape(8, -1).T).view(U64).reshape(-1)


def shards(docs: DataFrame, key: str, text: str, most: int = SHARD_BYTES) -> DataFrame:
    """shard, ids, offsets, body: a written table, so that shard numbers hold for all later passes.

    ids keep their order, nulls and repetitions; null texts are empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, parts, offs, size = TaskContext.get().partitionId() << 24, [], [], [np.zeros(1, np.int64)], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "n_bytes": pa.array([size], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "offsets": pa.array([pressed(np.concatenate(offs))], pa.binary()), "body": pa.array([pressed(b"".join(parts))], pa.binary())})

        for batch in batches:
            for part, data, at in slices(batch, text):
                if size and size + len(data) > most:
                    yield out()
                    shard, ids, parts, offs, size = shard + 1, [], [], [np.zeros(1, np.int64)], 0
                ids += part.column(part.schema.get_field_index(key)).to_pylist()
                parts.append(data.tobytes())
                offs.append(at[1:] + size)
                size += len(data)
        if ids:
            yield out()

    return written(docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, "shard long, n_bytes long, ids array<long>, offsets binary, body binary"), "shards")


def body(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return opened(row["body"]), opened(row["offsets"], np.int64)


def chunks(data: np.ndarray, offs: np.ndarray, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of about ``most`` bytes: from, to, their bytes and offsets."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def n_buckets(table: DataFrame) -> int:
    """Buckets follow the bytes of text, so one holds a bounded share of it at any size."""
    total = table.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    return max(8, -(-total // BUCKET_BYTES))


def cuts(keys: np.ndarray, n: int) -> np.ndarray:
    """Where the buckets of sorted hashes begin and end: bucket b has keys[cuts[b]:cuts[b + 1]]."""
    edges = (np.arange(1, n, dtype=object) * (1 << 32) + n - 1) // n
    return np.concatenate(([0], np.searchsorted(keys >> U64(32), np.array(edges, U64)), [len(keys)])).astype(np.int64)


SENT = "bucket int, shard long, keys binary, extra binary"
ANSWER = "shard long, bucket int, answer binary, told array<long>"


def send(shard: int, keys: np.ndarray, extra: np.ndarray, n: int) -> pa.RecordBatch | None:
    """Rows of ``SENT``: each bucket's part of the sorted ``keys`` and of what goes with each."""
    at = cuts(keys, n)
    full = np.flatnonzero(np.diff(at))
    return pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "shard": pa.array([shard] * len(full), pa.int64()), "keys": pa.array([pressed_keys(keys[at[b] : at[b + 1]]) for b in full], pa.binary()), "extra": pa.array([pressed(extra[at[b] : at[b + 1]]) for b in full], pa.binary())})


def exchanged(sent: DataFrame, merge: Callable[[list[np.ndarray], list[bytes]], tuple[list[np.ndarray], list[int]]]) -> DataFrame:
    """Per shard and bucket, what ``merge`` answers to each of a bucket's sorted lists;
    a row of shard null has what it tells of the whole bucket."""

    def run(table: pa.Table) -> pa.Table:
        keys = [opened_keys(x) for x in table.column("keys").to_pylist()]
        answers, told = merge(keys, table.column("extra").to_pylist())
        bucket = table.column("bucket")[0].as_py()
        n = len(keys)
        return pa.table({"shard": pa.array([*table.column("shard").to_pylist(), None], pa.int64()), "bucket": pa.array([bucket] * (n + 1), pa.int32()), "answer": pa.array([*(pressed(a) for a in answers), None], pa.binary()), "told": pa.array([*[None] * n, told], pa.list_(pa.int64()))})

    return written(sent.groupBy("bucket").applyInArrow(run, ANSWER), "answers")


def answered(table: DataFrame, answers: DataFrame) -> DataFrame:
    """The shards with their answers, as (bucket, answer) in order of buckets."""
    own = answers.filter("shard is not null").groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("bucket", "answer"))).alias("answers"))
    return table.join(own, "shard", "left")


def joined(answers: list | None, kind: str | type) -> np.ndarray:
    """The answers to a shard's keys, in the order of its sorted keys."""
    return np.concatenate([opened(a["answer"], kind) for a in answers]) if answers else np.zeros(0, kind)


def total_of(lists: list[np.ndarray], extras: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of several sorted lists, and the sums of what goes with them."""
    keys = np.unique(np.concatenate(lists))
    sums = np.zeros(len(keys), np.int64)
    for k, e in zip(lists, extras, strict=True):
        sums[np.searchsorted(keys, k)] += e
    return keys, sums
