"""Benchmark decontamination: a generalised suffix automaton of the items' words, streamed over documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starfold.llm.common import free, load
from starfold.llm.words import ALNUM, LOWER, U64, bounds, grams, hashes, slices, spread

WINDOW = 10
_INSIDE = ALNUM[LOWER]


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, offsets of the rows and hashes of the normalised words."""
    starts, ends, woff = bounds(data, offs, _INSIDE)
    return starts, ends, woff, hashes(data, starts, ends, True)


class Automaton:
    """Suffix automaton of several word sequences, with the items behind each state.

    ``steps``: from state and word, as one number, to the next state.
    ``ten[v]``: the state of the last ``window`` words of what v ends with.
    ``items[v]``: places of the items that hold the strings of v, of such states only.
    ``short[v]``: (length, item) of items under ``window`` words that end there, where there are any.

    Only these are kept: states have no tables of their own, and most no items.
    """

    def __init__(self, sequences: list[list[int]], window: int = WINDOW) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = []
        for sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
            ends.append(last)
        order = sorted(range(1, len(self.link)), key=lambda v: -self.length[v])
        self.ten = [0] * len(self.link)
        self.short: dict[int, tuple[tuple[int, int], ...]] = {}
        own: dict[int, list[tuple[int, int]]] = {}
        for place, (sequence, v) in enumerate(zip(sequences, ends, strict=True)):
            if 0 < len(sequence) < window:
                while self.length[self.link[v]] >= len(sequence):
                    v = self.link[v]
                own.setdefault(v, []).append((len(sequence), place))
        for v in reversed(order):
            above = self.link[v]
            self.ten[v] = self.ten[above] if self.length[above] >= window else v
            if short := (*own.get(v, ()), *self.short.get(above, ())):
                self.short[v] = short
        self.steps = {v << 32 | word: q for v, after in enumerate(self.next) for word, q in after.items()}
        del self.next
        # an item holds the windows that its own words pass, so one more walk finds them all
        found: dict[int, set[int]] = {}
        for place, sequence in enumerate(sequences):
            v = 0
            for k, word in enumerate(sequence):
                v = self.steps[v << 32 | word]
                if k + 1 >= window:
                    found.setdefault(self.ten[v], set()).add(place)
        self.items = {v: tuple(sorted(x)) for v, x in found.items()}

    def _new(self, length: int, link: int, after: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(after)
        return len(self.length) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """The state of the strings of q that p reaches by ``word``, apart from the longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        part = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = part
            p = self.link[p]
        self.link[q] = part
        return part

    def _extend(self, last: int, word: int) -> int:
        if (q := self.next[last].get(word)) is not None:
            return self._split(last, q, word)
        state, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, self.next[p][word], word)
        return state

    def stream(self, words: list[int], hit: np.ndarray, at: int, found: set[int]) -> None:
        """Follows the longest match that ends at each word; flags in ``hit``, from ``at`` on, the words of windows."""
        v = length = 0
        for i, word in enumerate(words):
            while v and v << 32 | word not in self.steps:
                v = self.link[v]
                length = self.length[v]
            v = self.steps.get(v << 32 | word, 0)
            length = length + 1 if v else 0
            if length >= self.window:
                hit[at + i - self.window + 1 : at + i + 1] = True
                found.update(self.items[self.ten[v]])
            for n, item in self.short.get(v, ()):
                if n <= length:
                    hit[at + i - n + 1 : at + i + 1] = True
                    found.add(item)


class Items:
    """Benchmark items, ready to be sent to tasks."""

    def __init__(self, ids: list[str], texts: list[str], window: int = WINDOW) -> None:
        raw = [t.encode() for t in texts]
        data, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        _, _, woff, h = words_of(data, offs)
        self.ids, row = ids, spread(np.diff(woff))
        self.vocabulary, codes = np.unique(h, return_inverse=True)
        sequences = [codes[a:b].tolist() for a, b in zip(woff[:-1], woff[1:], strict=True)]
        self.automaton = Automaton(sequences, window)
        self.least = min((min(len(s), window) for s in sequences if s), default=window)
        pairs = grams(h, 2)
        self.pairs = np.unique(pairs[row[:-1] == row[1:]]) if len(pairs) else pairs

    def hits(self, h: np.ndarray, woff: np.ndarray) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Which words are hit, and by row the items found.

        Only runs in which each two neighbours are neighbours in some item, long
        enough for the shortest window, are streamed: no window lies elsewhere.
        """
        hit, found = np.zeros(len(h), bool), {}
        if not len(self.vocabulary) or len(h) < self.least:
            return hit, found
        row = spread(np.diff(woff))
        if self.least == 1:
            linked = _member(h, self.vocabulary)
            linked = linked[:-1] & linked[1:] & (row[:-1] == row[1:])
        else:
            linked = _member(grams(h, 2), self.pairs) & (row[:-1] == row[1:])
        edge = np.diff(np.concatenate(([0], linked.astype(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        if self.least == 1:
            alone = np.setdiff1d(np.flatnonzero(_member(h, self.vocabulary)), np.concatenate([np.arange(a, b) for a, b in zip(starts, ends, strict=True)] or [np.zeros(0, int)]))
            starts, ends = np.concatenate((starts, alone)), np.concatenate((ends, alone + 1))
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a >= self.least:
                self.automaton.stream(np.searchsorted(self.vocabulary, h[a:b]).tolist(), hit, a, now := set())
                if now:
                    found.setdefault(int(row[a]), set()).update(now)
        return hit, found


def _member(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    low = np.zeros(1 << 20, bool)
    low[(known & U64(0xFFFFF)).astype(np.int64)] = True
    out = low[(h & U64(0xFFFFF)).astype(np.int64)]
    at = np.flatnonzero(out)
    place = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
    out[at] = known[place] == h[at]
    return out


def blocks(items: DataFrame, most_bytes: int = 4 << 20) -> Iterator[Items]:
    """The benchmark in blocks of bounded size; each is one pass over the documents."""
    ids, texts, n = [], [], 0
    for r in items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).toLocalIterator():
        if ids and n + len(r["text"]) > most_bytes:
            yield Items(ids, texts)
            ids, texts, n = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        n += len(r["text"])
    yield Items(ids, texts)


def spans(hit: np.ndarray, starts: np.ndarray, ends: np.ndarray, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """Maximal runs of hit words among words lo to hi: bytes from and to, words."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit[lo:hi].astype(np.int8), [0]))))
    return [(int(starts[lo + a]), int(ends[lo + b - 1]), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


FIELDS = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, stop: long, words: long>>"


def find(docs: DataFrame, items: DataFrame, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words, n_hit, items (ids whose windows occur, sorted) and
    spans (maximal runs of hit words, in bytes of the text).

    columns: those of ``docs`` to carry, all by default; results replace columns
    of their names.  Null and empty texts have no words, and so no hits; items
    without words, and an empty benchmark, hit nothing.  Items of the same id
    are one in ``items``.  A benchmark over one block's size is taken in blocks,
    and what each pass adds is carried on in the rows.
    """
    carried = [c for c in columns or docs.columns if c not in ("n_words", "n_hit", "items", "spans")]
    known = F.lit(None).cast("array<struct<start: long, stop: long, words: long>>")
    out = docs.select(*dict.fromkeys([*carried, text])).withColumns({"items": F.array().cast("array<string>"), "spans": known})
    base = [f for f in docs.select(*dict.fromkeys([*carried, text])).schema]
    schema = StructType([*base, *StructType.fromDDL(FIELDS)])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("words", pa.int64())]))
    for block in blocks(items):
        sent = docs.sparkSession.sparkContext.broadcast(block)  # one copy for all tasks of a worker; at most a block's size

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for batch in batches:
                for part, data, offs in slices(batch, text):
                    starts, ends, woff, h = words_of(data, offs)
                    hit, found = block.hits(h, woff)
                    before, ids = part.column("spans").to_pylist(), part.column("items").to_pylist()
                    for i, old in enumerate(before):
                        for s in old or ():
                            a, b = np.searchsorted(starts, [offs[i] + s["start"], offs[i] + s["stop"]])
                            hit[a:b] = True
                    told = [sorted({*old, *(block.ids[x] for x in found.get(i, ()))}) for i, old in enumerate(ids)]
                    runs = [spans(hit, starts - offs[i], ends - offs[i], woff[i], woff[i + 1]) if hit[woff[i] : woff[i + 1]].any() else [] for i in range(part.num_rows)]
                    given = [part.column(part.schema.get_field_index(f.name)) for f in base]
                    n_hit = np.diff(np.concatenate(([0], np.cumsum(hit)))[woff])
                    new = [pa.array(np.diff(woff)), pa.array(n_hit), pa.array(told, pa.list_(pa.string())), pa.array([[{"start": a, "stop": b, "words": n} for a, b, n in r] for r in runs], kind)]
                    yield pa.RecordBatch.from_arrays([*given, *new], names=[*(f.name for f in base), "n_words", "n_hit", "items", "spans"])

        out = out.drop("n_words", "n_hit").mapInArrow(scan, schema)
    return out.select(*carried, "n_words", "n_hit", "items", "spans")


def strip(docs: DataFrame, items: DataFrame, text: str = "text", least_words: int = 1, most_coverage: float = 0.5) -> DataFrame:
    """``docs`` without the spans of ``least_words`` hit words or more, and without
    documents of whose words over ``most_coverage`` are hit.  All other columns stay as
    they are, of whatever names: they are carried in a struct.  Null and empty texts
    stay, repeated rows lose the same, and a very long text is scanned like any other."""
    others = [c for c in docs.columns if c != text]
    row = free("row", [text])
    held = docs.select(F.struct(F.lit(0).alias("0"), *(F.col(f"`{c}`") for c in others)).alias(row), text)
    found = find(held, items, text)
    raw = F.col(text).cast("binary")
    gone = F.filter("spans", lambda s: s["words"] >= least_words)
    left = F.aggregate(gone, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts")), lambda acc, s: F.struct(s["stop"].alias("at"), F.array_append(acc["parts"], F.substring(raw, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")).cast("string")).alias("parts")))
    cut = F.concat(F.array_join(left["parts"], ""), F.substring(raw, left["at"].cast("int") + 1, F.octet_length(raw)).cast("string"))
    kept = found.filter(F.col("n_hit") <= F.col("n_words") * most_coverage)
    told = kept.withColumn(text, F.when(F.size(gone) > 0, cut).otherwise(F.col(text)))
    return told.select(*(F.col(c) if c == text else F.col(row).getField(c).alias(c) for c in docs.columns))


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), columns=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN win USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT wpos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS wpos FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS sha FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""
