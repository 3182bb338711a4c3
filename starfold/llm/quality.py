"""Quality rules: counting rules, then Jensen-Shannon distances of character-class
and common-word histograms from references of the document's language.

The word histogram is over common words alone, so that a text in another
language stands far off; how many of a text's words are common is judged apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.llm.common import load
from starfold.llm.words import ANY, U64, bounds, grams, hash_of, hashes, mix, slices, spread

#: Common words of each language that has a word reference.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to in is was that for with as by are at an on be this from or".split(),
    "es": "de la que el en y los del se las por un para con no una su al lo como".split(),
    "fr": "de la le et les des en un une du que pour dans qui par sur au est pas avec".split(),
}
WORDS = sorted({w for ws in COMMON.values() for w in ws})
SYMBOLS = b"#*$%&|<>"
#: Character classes: lower, upper, digit, white space, symbol, other printable ASCII, control, beyond ASCII.
CLASSES = 8
_CLASS = np.full(256, 7, np.uint8)
_CLASS[:0x80] = 6
_CLASS[0x21:0x7F] = 5
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 0, 1, 2
_CLASS[[0x20, *range(0x09, 0x0E)]] = 3
_CLASS[list(SYMBOLS)] = 4
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True
_KEYS = np.array([hash_of(w.encode()) for w in WORDS], U64)
_ORDER = np.argsort(_KEYS)
_SORTED = _KEYS[_ORDER]

MIN_WORDS, MAX_REPEAT = 50, 50
#: A reference of fewer words judges nothing.
MIN_REFERENCE = 1000
#: Largest distances, of 0 to 1, that are kept; the words' counts from so many common words on.
MAX_CLASS, MAX_COMMON, MIN_COMMON = 0.3, 0.9, 20
#: Least share of common words among all, in hundredths.
MIN_SHARE = 3


def per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many of each row's items are flagged."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]


def histograms(data: np.ndarray, offs: np.ndarray, words: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: characters by class, words by place in ``WORDS`` with all others last."""
    starts, ends, woff = words
    n = len(offs) - 1
    first = ~_CONTINUES[data]
    chars = np.bincount(spread(np.diff(offs))[first] * CLASSES + _CLASS[data][first], minlength=n * CLASSES).reshape(n, CLASSES)
    h = hashes(data, starts, ends, True)
    at = np.minimum(np.searchsorted(_SORTED, h), len(_SORTED) - 1)
    which = np.where(_SORTED[at] == h, _ORDER[at], len(WORDS))
    common = np.bincount(spread(np.diff(woff)) * (len(WORDS) + 1) + which, minlength=n * (len(WORDS) + 1)).reshape(n, -1)
    return chars, common


def repeats(data: np.ndarray, offs: np.ndarray, words: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Words of each row in 3-word windows that the row has twice or more."""
    starts, ends, woff = words
    g, row = grams(hashes(data, starts, ends, False), 3), spread(np.diff(woff))
    whole = row[: len(g)] == row[2:] if len(g) else np.zeros(0, bool)
    _, back, often = np.unique(mix(g[whole] ^ mix(row[: len(g)][whole].astype(U64) + U64(1))), return_inverse=True, return_counts=True)
    twice = np.zeros(len(row) + 2, bool)
    at = np.flatnonzero(whole)[often[back] > 1]
    for k in range(3):
        twice[at + k] = True
    return per_row(twice[: len(row)], woff)


def failed(n_words: np.ndarray, n_repeat: np.ndarray) -> np.ndarray:
    """Whether the base rules reject a row."""
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT * n_words)


def base_counts(data: np.ndarray, offs: np.ndarray, words: tuple[np.ndarray, np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    starts, ends, woff = words
    inside = ANY[data]
    n_words = np.diff(woff)
    lines = bounds(data, offs, np.arange(256) != 0x0A)
    seen = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=seen[1:])
    full = seen[lines[1]] > seen[lines[0]]
    of = spread(np.diff(lines[2]))[full]
    keys = mix(hashes(data, lines[0], lines[1], False)[full] ^ mix(of.astype(U64) + U64(1)))
    new = np.unique(keys, return_index=True)[1]
    n = len(offs) - 1
    return {
        "n_words": n_words, "word_chars": per_row(inside & ~_CONTINUES[data], offs),
        "n_symbols": per_row(_CLASS[data] == 4, offs), "n_dup_lines": np.bincount(of, minlength=n) - np.bincount(of[new], minlength=n),
        "n_repeat_words": repeats(data, offs, words),
    }


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances, to base 2, of rows of counts from rows of the reference; 0 where either is empty."""
    total, known = counts.sum(axis=1, keepdims=True), reference.sum(axis=1, keepdims=True)
    p, q = counts / np.maximum(total, 1), reference / np.maximum(known, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.where((total > 0) & (known > 0), np.sqrt(np.maximum(parts.sum(axis=1, keepdims=True) / 2, 0)), 0)[:, 0]


def _langs(batch: pa.RecordBatch, lang: str) -> np.ndarray:
    """Places in the sorted languages of ``COMMON``; all others and nulls come last, as one."""
    place = {name: i for i, name in enumerate(sorted(COMMON))}
    return np.array([place.get(x, len(place)) for x in batch.column(batch.schema.get_field_index(lang)).to_pylist()], int)


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> np.ndarray:
    """Summed histograms over all documents of each known language that pass the base rules, and of all other languages together.

    That is a fixed small number of counts.  Each task sums its own rows first.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(COMMON) + 1, CLASSES + len(WORDS) + 1), np.int64)
        for batch in batches:
            for part, data, offs in slices(batch, text):
                words = bounds(data, offs, ANY)
                good = ~failed(np.diff(words[2]), repeats(data, offs, words))
                np.add.at(out, _langs(part, lang)[good], np.hstack(histograms(data, offs, words))[good])
        at = np.nonzero(out)
        yield pa.record_batch({"row": pa.array(at[0], pa.int32()), "col": pa.array(at[1], pa.int32()), "n": pa.array(out[at], pa.int64())})

    found = docs.select(text, lang).mapInArrow(sums, "row int, col int, n long").groupBy("row", "col").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((len(COMMON) + 1, CLASSES + len(WORDS) + 1))
    for r in found:
        out[r["row"], r["col"]] = r["n"]
    return out


FIELDS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "class_distance": "double", "common_distance": "double", "n_common": "long", "kept": "boolean"}


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", columns: list[str] | None = None, filtering: bool = False) -> DataFrame:
    """``docs`` with the counts, the two distances and kept, or only rows that are kept, unchanged, if ``filtering``.

    columns: those of ``docs`` to carry, all by default; results replace columns
    of their names.  Null or empty texts have no words, so the base rules reject
    them.  A document is rejected by the method if a histogram's distance from
    its language's reference is over its limit, or if too small a share of its
    words are common; other languages share a character reference and have none
    of words.  Nothing is judged against a reference of under ``MIN_REFERENCE``
    words, and word distances not of under ``MIN_COMMON`` common words.  Repeated
    rows are judged alike, and very long texts as one.  Empty tables give none.
    """
    known = references(docs, text, lang)
    ready = known[:, CLASSES:].sum(axis=1) >= MIN_REFERENCE
    columns = columns or docs.columns
    carried = [c for c in columns if filtering or c not in FIELDS]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carried).schema] + ([] if filtering else [f"{k} {v}" for k, v in FIELDS.items()]))
    needed = list(dict.fromkeys([*carried, text, lang]))

    def rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in slices(batch, text):
                words = bounds(data, offs, ANY)
                out = base_counts(data, offs, words)
                chars, common = histograms(data, offs, words)
                of = _langs(part, lang)
                out["base_failed"] = failed(out["n_words"], out["n_repeat_words"])
                out["class_distance"] = np.where(ready[of], distance(chars, known[of, :CLASSES]), 0.0)
                own = common[:, :-1].sum(axis=1)
                worded = ready[of] & (of < len(COMMON))
                out["n_common"] = own
                out["common_distance"] = np.where(worded & (own >= MIN_COMMON), distance(common[:, :-1], known[of, CLASSES:-1]), 0.0)
                few = worded & (100 * own < MIN_SHARE * out["n_words"])
                out["kept"] = ~out["base_failed"] & (out["class_distance"] <= MAX_CLASS) & (out["common_distance"] <= MAX_COMMON) & ~few
                given = part.select(carried)
                if filtering:
                    yield given.filter(pa.array(out["kept"]))
                else:
                    yield pa.RecordBatch.from_arrays([*given.columns, *(pa.array(out[k]) for k in FIELDS)], names=[*carried, *FIELDS])

    return docs.select(*needed).mapInArrow(rules, schema)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "documents"), columns=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _class_sql(name: str, pattern: str) -> str:
    return f"(length(t) - length(regexp_replace(t, '{pattern}', '', 'g')))::DOUBLE AS {name}"


_DISTANCE_SQL = "sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: CASE WHEN {p}[i] > 0 THEN {p}[i] / {n} * log2({p}[i] / {n} / (({p}[i] / {n} + {q}[i] / {m}) / 2)) ELSE 0 END + CASE WHEN {q}[i] > 0 THEN {q}[i] / {m} * log2({q}[i] / {m} / (({p}[i] / {n} + {q}[i] / {m}) / 2)) ELSE 0 END)) / 2, 0))"
#: CTEs that end with ``judged``: the rows of {docs} with the counts and kept.
QUALITY_SQL = (
    r"""
q_words AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, CASE WHEN lang IN ('de', 'en', 'es', 'fr') THEN lang ELSE '' END AS known FROM {docs}),
q_grams AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS often FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM q_words)),
q_twice AS (SELECT rid, count(DISTINCT wpos) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS wpos FROM q_grams WHERE often > 1) GROUP BY rid),
q_lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM q_words) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
q_common AS (SELECT rid, list_transform(LIST, lambda w: len(list_filter(low, lambda x: x = w))::DOUBLE) AS cw, len(low)::DOUBLE AS nw
  FROM (SELECT rid, list_transform(ws, lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS low FROM q_words)),
""".replace("LIST", "[" + ", ".join(f"'{w}'" for w in WORDS) + "]")
    + "q_chars AS (SELECT rid, known, length(t)::DOUBLE AS nc, "
    + ", ".join(_class_sql(f"c{i}", p) for i, p in enumerate(("[a-z]", "[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", "[#*$%&|<>]", r"[!\x22\x27-\x29+-/:;=?@\x5B-\x60{{}}~]", r"[\x00-\x08\x0E-\x1F\x7F]", r"[^\x00-\x7F]")))
    + " FROM q_words),\n"
    + "q_ok AS (SELECT rid FROM q_words LEFT JOIN q_twice USING (rid) WHERE len(ws) >= 50 AND 100 * coalesce(n_repeat_words, 0) <= 50 * len(ws)),\n"
    + "q_all AS (SELECT c.*, [c0, c1, c2, c3, c4, c5, c6, c7] AS cc, cw, coalesce(list_sum(cw), 0) AS nk, nw FROM q_chars c JOIN q_common USING (rid)),\n"
    + "q_ref AS (SELECT known, ["
    + ", ".join(f"sum(c{i})" for i in range(CLASSES))
    + "] AS rc, sum(nc) AS rn, ["
    + ", ".join(f"sum(cw[{i + 1}])" for i in range(len(WORDS)))
    + "] AS rw, sum(nk) AS rk, sum(nw) AS rwn FROM q_all SEMI JOIN q_ok USING (rid) GROUP BY known),\n"
    + "q_far AS (SELECT rid, CASE WHEN rwn >= 1000 AND nc > 0 THEN "
    + _DISTANCE_SQL.format(p="cc", n="nc", q="rc", m="rn")
    + " ELSE 0 END AS dc, CASE WHEN rwn >= 1000 AND nk >= 20 AND rk > 0 AND q_all.known <> '' THEN "
    + _DISTANCE_SQL.format(p="cw", n="nk", q="rw", m="rk")
    + " ELSE 0 END AS dw, coalesce(rwn >= 1000 AND q_all.known <> '' AND 100 * nk < 3 * nw, false) AS few FROM q_all LEFT JOIN q_ref USING (known)),\n"
    + r"""judged AS (SELECT *, NOT base_failed AND dc <= 0.3 AND dw <= 0.9 AND NOT few AS kept FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (
  SELECT w.* EXCLUDE (t, ws, known), len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, dc, dw, few
  FROM q_words w LEFT JOIN q_twice USING (rid) LEFT JOIN q_lines USING (rid) JOIN q_far USING (rid))))
"""
)
OP10_SQL = "WITH " + QUALITY_SQL.format(docs="documents") + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"
