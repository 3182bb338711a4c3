"""Suffix-array dedup: bytes covered by 50-byte strings that start in an earlier document too.

Shipping every suffix would cost many times the corpus, so two sorted lists go
round.  First, each window of 50 bytes is owned by the least of the 24-byte
grams in it, which its bytes alone decide; shards send their sorted distinct
owners, and buckets merge these lists by binary search: only owners in two
documents or more can own repeated windows.  Then the windows of those owners,
as runs of bytes, meet in their owner's bucket, where a suffix array and its
common prefixes give the classes of equal windows and each class's least
document.  An owner of very many different runs is not kept together: its
windows go by their own hashes.  All steps are exact for every window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.llm.common import load
from starfold.llm.shards import answered, body, chunks, cuts, exchanged, joined, n_buckets, opened, pressed, pressed_keys, send, shards
from starfold.llm.words import U64, hashes, mix

LENGTH, GRAM = 50, 24
OWNERS = LENGTH - GRAM + 1
#: Different runs of an owner above which its windows go by their own hashes.
MANY = 4096
#: Bytes that one suffix array is made of, about.
ARRAY_BYTES = 1 << 20
LAST = np.iinfo(np.int64).max
_KEY = U64(0xFFFFFFFFFFFF0000)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Larsson-Sadakane: ranks by 8 bytes, then only groups that are not settled are
    sorted again, by the rank of what follows, over twice the length each time."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    key = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(U64)
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    new = np.ones(n + 1, bool)
    new[1:n] = ordered[1:] != ordered[:-1]
    rank = np.zeros(n + 1, np.int64)  # a suffix's rank is where its group begins, from 1 on; beyond the end it is 0
    rank[sa] = np.maximum.accumulate(np.where(new[:n], np.arange(1, n + 1), 0))
    # padding with zeros can tie a short suffix with one that goes on in zeros: the end's rank 0 parts them later
    h = 8
    open_ = np.flatnonzero(~(new[:n] & new[1:]))
    while len(open_):
        at = sa[open_]
        k = (rank[at].astype(U64) << U64(32)) | rank[np.minimum(at + h, n)].astype(U64)
        order = np.argsort(k, kind="stable")
        k = k[order]
        sa[open_] = at[order]
        first = np.ones(len(k), bool)
        first[1:] = k[1:] != k[:-1]
        new[open_[first]] = True
        rank[sa[open_]] = np.maximum.accumulate(np.where(first, open_ + 1, 0))
        open_ = open_[~(new[open_] & new[open_ + 1])]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int = 64, lanes: int = 4096) -> np.ndarray:
    """Kasai: for each place but the first in ``sa``, what its suffix shares with the one
    before, up to ``most``.  The text is walked in many lanes at once; in each, a
    suffix shares at least one byte less than the one that starts before it."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(most + 8, np.uint8)))
    eight = np.ndarray((n + most,), "<u8", padded, strides=(1,))
    rank = np.empty(n, np.int64)
    rank[sa] = np.arange(n)
    out = np.zeros(n, np.int32)
    step = -(-n // lanes)
    start = np.arange(0, n, step)
    h = np.zeros(len(start), np.int64)
    for i in range(step):
        p = start[: len(h)] + i
        p = p[p < n]
        h = h[: len(p)]
        if not len(p):
            break
        r = rank[p]
        q = sa[np.maximum(r - 1, 0)]
        h = np.maximum(h - 1, 0)
        going = np.flatnonzero(r > 0)
        h[r == 0] = 0
        while len(going):
            a, b, d = p[going], q[going], h[going]
            x = eight[a + d] ^ eight[b + d]
            low = x & (~x + U64(1))
            same = np.where(x == 0, 8, np.log2(np.maximum(low, U64(1)).astype(float)).astype(np.int64) >> 3)
            d = np.minimum(np.minimum(d + same, most), n - np.maximum(a, b))
            h[going] = d
            going = going[(x == 0) & (d < most) & (d < n - np.maximum(a, b))]
        out[r] = h
    return out


@dataclass
class Runs:
    """Runs of windows of one owner: owner's hash, first and last window start, row."""

    owner: np.ndarray
    low: np.ndarray
    high: np.ndarray
    row: np.ndarray


def owned(data: np.ndarray, offs: np.ndarray) -> Runs:
    """All windows of the rows, in runs by owner: the least gram, the leftmost of equals."""
    n = len(data) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return Runs(none.view(U64), none, none, none)
    at = np.arange(n + OWNERS - 1)
    grams = hashes(data, at, at + GRAM, False)
    bits = max(21, int(len(at)).bit_length())
    low = U64((1 << bits) - 1)
    key = (grams & ~low) | at.astype(U64)
    wide = 1
    while 2 * wide <= OWNERS:
        key = np.minimum(key[:-wide], key[wide:])
        wide *= 2
    if wide < OWNERS:
        key = np.minimum(key[: n], key[OWNERS - wide :][: n])
    best = (key[:n] & low).astype(np.int64)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:n]
    inside = np.arange(n) + LENGTH <= offs[row + 1]
    edge = np.ones(n, bool)
    edge[1:] = (best[1:] != best[:-1]) | (row[1:] != row[:-1])
    edge |= ~inside
    first = np.flatnonzero(edge & inside)
    after = np.flatnonzero(edge)
    last = np.append(after, n)[np.searchsorted(after, first, "right")] - 1
    return Runs(grams[best[first]], first, last, row[first])


def _ids(row: dict) -> np.ndarray:
    """Documents without id come after all others."""
    return np.array([LAST if i is None else i for i in row["ids"]], np.int64)


def shard_runs(row: dict) -> tuple[np.ndarray, np.ndarray, Runs, np.ndarray, np.ndarray]:
    """data, offsets, runs of the whole shard, and hashes of the runs' bytes together with their owner.

    Owners are least hashes, and so small numbers: they are mixed again, that buckets get equal shares.
    """
    data, offs = body(row)
    found, prints = [], []
    for lo, _, part, at in chunks(data, offs, 1 << 20):
        r = owned(part, at)
        prints.append(mix(hashes(part, r.low, r.high + LENGTH, False) ^ r.owner))
        found.append(Runs(mix(r.owner) & _KEY, r.low + offs[lo], r.high + offs[lo], r.row + lo))
    if not found:
        found, prints = [owned(data, offs)], [np.zeros(0, U64)]
    runs = Runs(*(np.concatenate([getattr(r, k) for r in found]) for k in ("owner", "low", "high", "row")))
    return data, offs, runs, np.concatenate(prints), _ids(row)


def owner_table(runs: Runs, prints: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct owners, and for each twice its different runs, plus 1 if several documents have it."""
    keys, back = np.unique(runs.owner, return_inverse=True)
    doc = ids[runs.row]
    low, high = np.full(len(keys), LAST), np.full(len(keys), -LAST)
    np.minimum.at(low, back, doc)
    np.maximum.at(high, back, doc)
    _, first = np.unique(prints, return_index=True)
    return keys, (np.minimum(np.bincount(back[first], minlength=len(keys)), 1 << 20) * 2 + (low != high)).astype(np.int32)


def merge_owners(lists: list[np.ndarray], extras: list[bytes]) -> tuple[list[np.ndarray], list[int]]:
    """For each shard's owners: 0 if one document has it, 1 if several have, 2 if its runs are very many."""
    extra = [opened(e, np.int32) for e in extras]
    keys = np.unique(np.concatenate(lists))
    shards_, runs, several = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    for k, e in zip(lists, extra, strict=True):
        at = np.searchsorted(keys, k)
        shards_[at] += 1
        runs[at] += e >> 1
        several[at] |= (e & 1) == 1
    kind = np.where((shards_ > 1) | several, np.where(runs > MANY, 2, 1), 0).astype(np.uint8)
    return [kind[np.searchsorted(keys, k)] for k in lists], []


@dataclass
class Pieces:
    """Different byte runs of a shard that may repeat, by (key, print): key decides the bucket.

    of: for each run of windows under ``low`` to ``high``, its piece.
    """

    key: np.ndarray
    low: np.ndarray
    high: np.ndarray
    doc: np.ndarray
    of: np.ndarray
    runs_low: np.ndarray
    runs_high: np.ndarray
    runs_doc: np.ndarray


def pieces(data: np.ndarray, runs: Runs, prints: np.ndarray, ids: np.ndarray, kind: np.ndarray) -> Pieces:
    own = kind[np.unique(runs.owner, return_inverse=True)[1]] if len(runs.owner) else np.zeros(0, np.uint8)
    a, b = np.flatnonzero(own == 1), np.flatnonzero(own == 2)
    sizes = runs.high[b] - runs.low[b] + 1
    start = np.repeat(runs.low[b], sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    single = mix(_prints(data, start)) if len(start) else np.zeros(0, U64)
    key = np.concatenate((runs.owner[a], single & _KEY))
    full = np.concatenate((prints[a], single))
    low, high = np.concatenate((runs.low[a], start)), np.concatenate((runs.high[a], start))
    doc = ids[np.concatenate((runs.row[a], np.repeat(runs.row[b], sizes)))]
    first, of = alike(key, full, doc, data, low, high + LENGTH - low)
    return Pieces(key[first], low[first], high[first], doc[first], of, low, high, doc)


def _prints(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hashes of the windows at ``start``, from their bytes alone."""
    out = np.zeros(len(start), U64)
    for k in range(0, LENGTH, 8):
        width = min(8, LENGTH - k)
        word = np.zeros(len(start), U64)
        for j in range(width):
            word |= data[start + k + j].astype(U64) << U64(8 * j)
        out = mix(out + word)
    return out


def gather(data: np.ndarray, low: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    stops = np.cumsum(sizes)
    return data[np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(low - (stops - sizes), sizes)]


def alike(key: np.ndarray, full: np.ndarray, doc: np.ndarray, text: np.ndarray, low: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First piece, by least document, of each class of equal bytes under one key, and each piece's class.

    Classes are found by hashes and then compared byte by byte; where two
    different pieces share a hash, another one takes its place.
    """
    n = len(key)
    for seed in range(1, 256):
        order = np.lexsort((doc, full, key))
        new = np.ones(n, bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (full[order][1:] != full[order][:-1])
        of = np.empty(n, np.int64)
        of[order] = np.cumsum(new) - 1
        first = order[new]
        again = first[of]
        if np.array_equal(sizes[again], sizes) and all(np.array_equal(gather(text, low[k : k + 65536], sizes[k : k + 65536]), gather(text, low[again[k : k + 65536]], sizes[k : k + 65536])) for k in range(0, n, 65536)):
            return first, of
        full = hashes(text ^ np.uint8(seed), low, low + sizes, False) ^ sizes.astype(U64)
    raise AssertionError("pieces that 255 hashes do not part")


def settle(keys: np.ndarray, sizes: np.ndarray, text: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each piece, sorted by key, a mask of its windows that start in an earlier document's piece too."""
    out = np.zeros(len(keys), np.uint32)
    stops = np.cumsum(sizes)
    lo = 0
    while lo < len(keys):
        hi = int(np.searchsorted(stops, (stops[lo] - sizes[lo]) + ARRAY_BYTES, "right"))
        hi = max(lo + 1, hi)
        if hi < len(keys):  # the pieces of a key stay together
            hi = max(int(np.searchsorted(keys, keys[hi - 1], "left")) if keys[hi - 1] == keys[hi] else hi, lo)
            if hi <= lo:
                hi = int(np.searchsorted(keys, keys[lo], "right"))
        part = text[stops[lo] - sizes[lo] : stops[hi - 1]]
        n, d = sizes[lo:hi], doc[lo:hi]
        start = np.cumsum(n) - n
        piece = np.repeat(np.arange(hi - lo), n)
        offset = np.arange(len(part)) - start[piece]
        valid = offset + LENGTH <= n[piece]
        sa = suffix_array(part)
        first = np.flatnonzero(common_prefixes(part, sa) < LENGTH)
        least = np.minimum.reduceat(np.where(valid[sa], d[piece[sa]], LAST), first)
        of = np.empty(len(part), np.int64)
        of[sa] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(part))))
        again = valid & (least[of] < d[piece])
        bit = np.where(again, np.int64(1) << np.minimum(offset, 31), 0)
        out[lo:hi] = np.add.reduceat(bit, start)
        lo = hi
    return out


def merge_pieces(lists: list[np.ndarray], extras: list[bytes]) -> tuple[list[np.ndarray], list[int]]:
    parts = [_unpacked(e) for e in extras]
    key = np.concatenate(lists)
    sizes, doc = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    text = np.concatenate([p[2] for p in parts])
    low = np.cumsum(sizes) - sizes
    full = hashes(text, low, low + sizes, False)
    # equal pieces of different shards are one, of their least document
    first, of = alike(key, full, doc, text, low, sizes)
    # a key of one piece has nothing else to meet
    alone = np.ones(len(first), bool)
    alone[1:] &= key[first][1:] != key[first][:-1]
    alone[:-1] &= key[first][1:] != key[first][:-1]
    rest = first[~alone]
    mask = np.zeros(len(first), np.uint32)
    mask[~alone] = settle(key[rest], sizes[rest], gather(text, low[rest], sizes[rest]), doc[rest])
    least = doc[first]
    answer = np.where(doc > least[of], np.uint32(0xFFFFFFFF), mask[of])
    return np.split(answer, np.cumsum([len(k) for k in lists])[:-1]), []


def _packed(data: np.ndarray, p: Pieces, a: int, b: int) -> bytes:
    sizes = (p.high[a:b] - p.low[a:b] + LENGTH).astype(np.uint8)
    return pressed(np.array([b - a], "<i8").tobytes() + sizes.tobytes() + p.doc[a:b].astype("<i8").tobytes() + gather(data, p.low[a:b], sizes.astype(np.int64)).tobytes())


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = opened(blob).tobytes()
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, np.uint8, n, 8).astype(np.int64)
    return sizes, np.frombuffer(raw, "<i8", n, 8 + n), np.frombuffer(raw, np.uint8, -1, 8 + 9 * n)


FIELDS = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, stop: long>>, kept_sha256 string"


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``FIELDS`` per document: the maximal runs of bytes to remove, and a hash of those that stay.

    Null texts are empty; texts under 50 bytes lose nothing.  Rows that share a
    doc_id do not count as earlier than each other; rows without one come after
    all others.  An empty table gives an empty one; a very long text is a shard
    alone; columns of other names are neither read nor returned.
    """
    table = shards(docs, key, text)
    n = n_buckets(table)

    def owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, _, runs, prints, ids = shard_runs(row)
                yield send(row["shard"], *owner_table(runs, prints, ids), n)

    sent = "bucket int, shard long, keys binary, extra binary"
    kinds = exchanged(table.mapInArrow(owners, sent), merge_owners)

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, _, runs, prints, ids = shard_runs(row)
                p = pieces(data, runs, prints, ids, joined(row["answers"], np.uint8))
                at = cuts(p.key, n)
                full = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "shard": pa.array([row["shard"]] * len(full), pa.int64()), "keys": pa.array([pressed_keys(p.key[at[b] : at[b + 1]]) for b in full], pa.binary()), "extra": pa.array([_packed(data, p, at[b], at[b + 1]) for b in full], pa.binary())})

    masks = exchanged(answered(table, kinds).mapInArrow(contents, sent), merge_pieces)
    both = answered(table, kinds).withColumnRenamed("answers", "kinds").join(masks.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("bucket", "answer"))).alias("masks")), "shard", "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, offs, runs, prints, ids = shard_runs(row)
                p = pieces(data, runs, prints, ids, joined(row["kinds"], np.uint8))
                gone = removed(data, p, joined(row["masks"], np.uint32))
                yield digests(row["ids"], data, offs, gone)

    return both.mapInArrow(remove, FIELDS)


def removed(data: np.ndarray, p: Pieces, masks: np.ndarray) -> np.ndarray:
    """Which bytes of the shard lie in a window that starts in an earlier document too."""
    change = np.zeros(len(data) + 1, np.int32)
    own = masks[p.of] if len(p.of) else np.zeros(0, np.uint32)
    # runs of documents later than the piece's first: all their windows repeat that document's
    whole = (p.runs_doc > p.doc[p.of]) if len(p.of) else np.zeros(0, bool)
    np.add.at(change, p.runs_low[whole], 1)
    np.add.at(change, p.runs_high[whole] + LENGTH, -1)
    some = np.flatnonzero(~whole & (own != 0))
    for k in range(OWNERS):
        at = some[((own[some] >> np.uint32(k)) & np.uint32(1)).astype(bool) & (p.runs_low[some] + k <= p.runs_high[some])]
        np.add.at(change, p.runs_low[at] + k, 1)
        np.add.at(change, p.runs_low[at] + k + LENGTH, -1)
    return np.cumsum(change[:-1], dtype=np.int32) > 0


def digests(ids: list, data: np.ndarray, offs: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    raw, spans, n_removed, shas = data.tobytes(), [], [], []
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = gone[1:] != gone[:-1]
    edge[offs] = True
    marks = np.flatnonzero(edge[: len(data)]) if len(data) else np.zeros(0, np.int64)
    stops = np.append(marks[1:], len(data))
    cut = gone[marks] if len(data) else np.zeros(0, bool)
    at = np.searchsorted(marks, offs)
    for i in range(len(ids)):
        a, b = at[i], at[i + 1]
        own = [(int(x), int(y)) for x, y, c in zip(marks[a:b], stops[a:b], cut[a:b], strict=True) if c]
        sha = hashlib.sha256()
        for x, y, c in zip(marks[a:b].tolist(), stops[a:b].tolist(), cut[a:b].tolist(), strict=True):
            if not c:
                sha.update(raw[x:y])
        spans.append([{"start": x - int(offs[i]), "stop": y - int(offs[i])} for x, y in own])
        n_removed.append(sum(y - x for x, y in own))
        shas.append(sha.hexdigest())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(np.diff(offs)), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array([len(s) for s in spans], pa.int64()), "spans": pa.array(spans, kind), "kept_sha256": pa.array(shas, pa.string())})


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(load(spark, sf_dir, "documents")).drop("spans")
