"""Filter interaction audit: what each order of five filters keeps and removes.

Words are dictionary-encoded over the whole corpus, and documents become the
rows of a sparse document-term matrix in compressed row shards.  Each shard
sends its distinct words, in order of their hashes, to buckets that number them;
words themselves are compared there, never hashes alone.  A row's sum is the
number of words, its nonzero count that of distinct words; they decide two
filters.  Flags of the others come with the shards, and one row of counts per
part and set of failed filters is all that the orders are computed from.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.llm.common import load, written
from starfold.llm.near_dedup import joined
from starfold.llm.shards import cuts, opened, pressed
from starfold.llm.words import ANY, bounds, hashes, slices, spread

LETTERS = "ABCDE"
MASKS = 1 << len(LETTERS)
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 200, 50, 2
MARKS = b"#$%&*|"
#: Bytes of text in a shard of the matrix, a longer text alone.
SHARD_BYTES = 1 << 22
#: Distinct words of shards that one bucket numbers, about.
BUCKET_WORDS = 1 << 20
_UPPER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_MARK[list(MARKS)] = True
SHARDS = "shard long, ids array<long>, parts array<string>, chars array<long>, upper array<long>, marked array<boolean>, digests array<binary>, indptr binary, indices binary, counts binary, n_terms long, lengths binary, words binary"


def per_row(hits: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many of each row's bytes are hits."""
    at = np.flatnonzero(hits)
    return np.diff(np.searchsorted(at, offs))


def strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive words of these lengths."""
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words end to end, and their lengths."""
    offs = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
    return np.frombuffer(words.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]], np.diff(offs)


def word_hashes(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return hashes(data, ends - lengths, ends, False)


def row_counts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """indptr, indices, counts of the rows' words, and the words themselves in order of their hashes: indices are into them."""
    starts, ends, woff = bounds(data, offs, ANY)
    coded = pc.dictionary_encode(strings(data[ANY[data]], ends - starts))
    n = max(1, len(coded.dictionary))
    order = np.argsort(word_hashes(*flat(coded.dictionary)), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    cells, often = np.unique(spread(np.diff(woff)) * n + place[coded.indices.to_numpy()], return_counts=True)
    rows = len(offs) - 1
    return np.searchsorted(cells, np.arange(rows + 1) * n), (cells % n).astype(np.uint32), often.astype(np.uint32), coded.dictionary.take(pa.array(order))


def counted(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """``SHARDS``: rows of documents with their counts over the shard's own words, and what else the filters ask of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            data, offs = np.concatenate([d for _, d, _ in held]), np.concatenate([[0], *(np.diff(o) for _, _, o in held)]).cumsum()
            indptr, indices, counts, words = row_counts(data, offs)
            raw, (letters, lengths) = memoryview(data), flat(words)
            given = [pa.chunked_array([p.column(i) for p, _, _ in held]) for i in (0, 2)]
            cells = {
                "shard": shard, "ids": given[0].to_pylist(), "parts": given[1].to_pylist(), "chars": per_row((data & 0xC0) != 0x80, offs).tolist(), "upper": per_row(_UPPER[data], offs).tolist(), "marked": (per_row(_MARK[data], offs) > 0).tolist(),
                "digests": [hashlib.sha256(raw[a:b]).digest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)],
                "indptr": pressed(indptr.astype(np.int64)), "indices": pressed(indices), "counts": pressed(counts), "n_terms": len(words), "lengths": pressed(lengths.astype(np.uint32)), "words": pressed(letters),
            }
            return pa.RecordBatch.from_pylist([cells], pa.schema([("shard", pa.int64()), ("ids", pa.list_(pa.int64())), ("parts", pa.list_(pa.string())), ("chars", pa.list_(pa.int64())), ("upper", pa.list_(pa.int64())), ("marked", pa.list_(pa.bool_())), ("digests", pa.list_(pa.binary())), ("indptr", pa.binary()), ("indices", pa.binary()), ("counts", pa.binary()), ("n_terms", pa.int64()), ("lengths", pa.binary()), ("words", pa.binary())]))

        for batch in batches:
            for one in slices(batch, "text", SHARD_BYTES >> 2):
                if held and size + len(one[1]) > SHARD_BYTES:
                    yield out()
                    shard, held, size = shard + 1, [], 0
                held.append(one)
                size += len(one[1])
        if held:
            yield out()

    given = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    return written(given.mapInArrow(run, SHARDS), "counted")


def numbered(counted: DataFrame) -> DataFrame:
    """bucket, shard, codes, lengths, words, written: what each bucket calls each shard's words.

    A row of shard null has the bucket's distinct words: word i of it is term
    bucket * 2**32 + i.  There are at most as many rows as words sent; a shard
    sends each of its words once.
    """
    total = counted.agg(F.coalesce(F.sum("n_terms"), F.lit(0))).first()[0]
    n = max(8, -(-total // BUCKET_WORDS))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                letters, lengths = opened(row["words"]), opened(row["lengths"], np.uint32).astype(np.int64)
                ends = np.concatenate(([0], np.cumsum(lengths)))
                at = cuts(word_hashes(letters, lengths), n)
                full = np.flatnonzero(np.diff(at))
                spans = [(at[b], at[b + 1]) for b in full.tolist()]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "shard": pa.array([row["shard"]] * len(full), pa.int64()), "lengths": pa.array([pressed(lengths[a:b].astype(np.uint32)) for a, b in spans], pa.binary()), "words": pa.array([pressed(letters[ends[a] : ends[b]]) for a, b in spans], pa.binary())})

    def number(table: pa.Table) -> pa.Table:
        lengths = [opened(x, np.uint32) for x in table.column("lengths").to_pylist()]
        coded = pc.dictionary_encode(strings(np.concatenate([opened(x) for x in table.column("words").to_pylist()]), np.concatenate(lengths).astype(np.int64)))
        codes = np.split(coded.indices.to_numpy().astype(np.uint32), np.cumsum([len(x) for x in lengths])[:-1])
        letters, sizes = flat(coded.dictionary)
        none = [None] * len(codes)
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()] * (len(codes) + 1), pa.int32()), "shard": pa.array([*table.column("shard").to_pylist(), None], pa.int64()), "codes": pa.array([*map(pressed, codes), None], pa.binary()), "lengths": pa.array([*none, pressed(sizes.astype(np.uint32))], pa.binary()), "words": pa.array([*none, pressed(letters)], pa.binary())})

    sent = counted.select("shard", "lengths", "words").mapInArrow(send, "bucket int, shard long, lengths binary, words binary")
    return written(sent.groupBy("bucket").applyInArrow(number, "bucket int, shard long, codes binary, lengths binary, words binary"), "numbered")


def dictionary(numbered: DataFrame) -> DataFrame:
    """term, word (bytes) of all distinct words of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = strings(opened(row["words"]), opened(row["lengths"], np.uint32).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array((row["bucket"] << 32) + np.arange(len(words))), words.cast(pa.binary())], names=["term", "word"])

    return numbered.filter("shard is null").select("bucket", "lengths", "words").mapInArrow(run, "term long, word binary")


def term_matrix(counted: DataFrame, numbered: DataFrame) -> DataFrame:
    """The document-term matrix in shards of compressed rows over the corpus's terms.

    indptr (int64), indices (int64, terms) and counts (uint32) are as
    ``shards.pressed`` packs them; the other columns of ``counted`` stay but words.
    """
    coded = numbered.filter("shard is not null").groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("bucket", "codes"))).alias("coded"))
    table = joined(counted.drop("n_terms", "lengths", "words"), coded, "shard", "left")
    names = [c for c in table.columns if c != "coded"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.select(*names).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                coded = one.column(one.schema.get_field_index("coded"))[0].as_py() or []
                terms = np.concatenate([np.zeros(0, np.int64), *(opened(x["codes"], np.uint32).astype(np.int64) + (x["bucket"] << 32) for x in coded)])
                indices = terms[opened(one.column(one.schema.get_field_index("indices"))[0].as_py(), np.uint32)]
                yield pa.RecordBatch.from_arrays([pa.array([pressed(indices)], pa.binary()) if c == "indices" else one.column(one.schema.get_field_index(c)) for c in names], names=names)

    return table.mapInArrow(run, schema)


FLAGS = "id long, part string, n_words long, n_distinct long, fails int, digest binary"


def judged(matrix: DataFrame) -> DataFrame:
    """``FLAGS`` per document: row sums and nonzero counts of the matrix decide A and B, the shard's columns C and D."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                indptr, counts = opened(row["indptr"], np.int64), opened(row["counts"], np.uint32)
                upto = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
                n, distinct = np.diff(upto[indptr]), np.diff(indptr)
                upper, chars = np.array(row["upper"], np.int64), np.array(row["chars"], np.int64)
                bad = [n < MIN_WORDS, 100 * distinct < MIN_DISTINCT * n, 100 * upper > MAX_UPPER * chars, np.array(row["marked"], bool)]
                fails = sum(x.astype(np.int32) << i for i, x in enumerate(bad))
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["parts"], pa.string()), pa.array(n), pa.array(distinct), pa.array(fails, pa.int32()), pa.array(row["digests"], pa.binary())], names=[c.split()[0] for c in FLAGS.split(", ")])

    return matrix.mapInArrow(run, FLAGS)


def flagged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """id, part, n_words, n_distinct, fails, good, toxic: one row per row of ``docs``.

    fails has a bit for each of A to E.  Null texts are empty, null parts the
    empty string.  E asks for a smaller id, so rows of one id and text do not
    fail each other, and rows without id neither fail E nor make another fail.
    Labels that repeat an id count as one, good or toxic if any is.  A very long
    text is a shard alone.  Extra columns are neither read nor returned.
    """
    held = counted(docs, key, text, part)
    rows = written(judged(term_matrix(held, numbered(held))), "flags")
    first = rows.filter("id is not null").groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    first = written(first.select("digest", "first"), "first")  # its join below can split a hot digest
    known = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    told = joined(joined(rows, first, "digest", "left"), written(known, "labels"), "id", "left")
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False)).cast("int")
    return told.select("id", "part", "n_words", "n_distinct", (F.col("fails") + 16 * copy).alias("fails"), (F.coalesce("good", F.lit(0)) == 1).alias("good"), (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"))


def audit(flags: DataFrame) -> DataFrame:
    """One row per part, filter_order and step, zeros included; ``flags`` has part, fails, good, toxic.  None for no rows."""
    spark = flags.sparkSession
    of = lambda ok: [F.sum(F.when((F.col("fails") == m) & ok, 1).otherwise(0)) for m in range(MASKS)]
    counts = flags.groupBy("part").agg(F.array(*of(F.lit(True))).alias("n"), F.array(*of(F.col("good"))).alias("ng"), F.array(*of(F.col("toxic"))).alias("nt"))
    steps = []
    for order in permutations(range(len(LETTERS))):
        for i, f in enumerate(order):
            before = sum(1 << x for x in order[:i])
            fail = [m for m in range(MASKS) if m >> f & 1]
            steps.append((len(steps), "".join(LETTERS[x] for x in order), i + 1, 1 << f, [m for m in range(MASKS) if not m & (before | 1 << f)], [m for m in fail if not m & before], [m for m in fail if m & before], fail))
    table = spark.createDataFrame(steps, "x int, filter_order string, step int, own int, left array<int>, here array<int>, again array<int>, fail array<int>")
    total = lambda masks, n: F.aggregate(masks, F.lit(0).cast("long"), lambda s, m: s + F.col(n)[m])
    #: Of all orders, a filter comes first among the k that a document fails in one of k.
    orders = len(list(permutations(LETTERS)))
    share = F.aggregate("fail", F.lit(0).cast("long"), lambda s, m: s + F.col("n")[m] * (F.lit(orders) / F.bit_count(m)).cast("long"))
    every = counts.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1)))).join(F.broadcast(table), "x")  # one row an order and step
    return every.select(
        "part", "filter_order", "step", total("left", "n").alias("kept"), total("here", "n").alias("removed"), total("again", "n").alias("redundant"), F.col("n")[F.col("own")].alias("unique_fails"), total("here", "ng").alias("good_lost"), total("here", "nt").alias("toxic_lost"), share.alias("shapley")
    )


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(flagged(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")))


OP11_SQL = r"""
WITH letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, s AS step, list_sum(list_transform(string_split(filter_order[:s - 1], ''), lambda x: CASE WHEN x = '' THEN 0 ELSE 1 << (ascii(x) - 65) END))::INT AS before, 1 << (ascii(filter_order[s]) - 65) AS own FROM orders, (SELECT unnest(range(1, 6)) AS s)),
words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
docs AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS fails
  FROM words LEFT JOIN known USING (doc_id)),
sets AS (SELECT part, fails, count(*) AS n, sum(good) AS g, sum(toxic) AS x FROM docs GROUP BY part, fails),
told AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN fails & (before | own) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fails & before = 0 AND fails & own > 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN fails & before > 0 AND fails & own > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN fails & before = 0 AND fails & own > 0 THEN g ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fails & before = 0 AND fails & own > 0 THEN x ELSE 0 END)::BIGINT AS toxic_lost
  FROM sets, steps GROUP BY ALL)
SELECT * EXCLUDE (own, step), step::INT AS step, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM told
"""
