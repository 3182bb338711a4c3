"""URL filters: host and path rules, then exact block-list membership by a Bloom filter cascade."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfold.llm.common import free, load, written
from starfold.llm.words import U64, mix

#: The rules of the query, as (host and path, verdict).
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: A host is on the block list if its pages have over so many links in a thousand characters of html.
MAX_LINKS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null urls and those without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


@dataclass(frozen=True)
class Cascade:
    """levels: (number of bits, number of hashes, packed bits)."""

    levels: tuple[tuple[int, int, np.ndarray], ...]

    @staticmethod
    def spots(a: np.ndarray, b: np.ndarray, level: int, bits: int, k: int) -> np.ndarray:
        a, b = mix(a + U64(level * 2 + 1)), mix(b ^ U64(level * 2 + 1)) | U64(1)
        return (a[:, None] + b[:, None] * np.arange(k, dtype=U64)) % U64(bits)

    def within(self, a: np.ndarray, b: np.ndarray, upto: int | None = None) -> np.ndarray:
        """Of keys of the universe: whether they are listed."""
        out, alive = np.zeros(len(a), bool), np.arange(len(a))
        for i, (bits, k, packed) in enumerate(self.levels[:upto]):
            at = self.spots(a[alive], b[alive], i, bits, k)
            hit = ((packed[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1).all(axis=1)
            out[alive[~hit]] = i % 2 == 1
            alive = alive[hit]
        out[alive] = len(self.levels[:upto]) % 2 == 1
        return out


def _pair(key: str) -> list[Column]:
    return [F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b")]


def _member(cascades: list, a: str = "a", b: str = "b") -> Column:
    """Whether keys are listed; each is judged by its part's cascade.  ``cascades`` are cascades or broadcasts of them."""

    @F.pandas_udf("boolean")
    def member(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            x, y = x.to_numpy().view(U64), y.to_numpy().view(U64)
            out, of = np.zeros(len(x), bool), _part(x, len(cascades))
            for k in np.unique(of).tolist():
                mine = of == k
                c = cascades[k]
                out[mine] = (c if isinstance(c, Cascade) else c.value).within(x[mine], y[mine])
            yield pd.Series(out)

    return member(F.col(a), F.col(b))


def _part(a: np.ndarray, n: int) -> np.ndarray:
    """The part of the universe that a key belongs to."""
    return (mix(a) % U64(n)).astype(np.int64)


def _parts(n: int) -> Column:
    @F.pandas_udf("int")
    def parts(a: pd.Series) -> pd.Series:
        return pd.Series(_part(a.to_numpy().view(U64), n).astype(np.int32))

    return parts(F.col("a"))


def _spots(level: int, bits: int, k: int) -> Column:
    @F.pandas_udf("array<long>")
    def spots(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(list(Cascade.spots(a.to_numpy().view(U64), b.to_numpy().view(U64), level, bits, k).astype(np.int64)))

    return spots(F.col("a"), F.col("b"))


def build_cascade(keys: DataFrame, n_in: int, n_out: int, max_bits: int) -> Cascade | None:
    """From (a, b, listed) of distinct keys: a cascade that is right for each of them, or None if it takes over ``max_bits``.

    Level 1 holds the listed keys; each further level holds those keys of the
    other kind that all levels before took in, until there are none.  Only packed
    words of bits reach the driver.
    """
    levels: list[tuple[int, int, np.ndarray]] = []
    left, count = keys.filter("listed"), n_in
    while count:
        p = min(0.5, max(1e-6, math.sqrt(0.5) * n_in / max(1, n_out))) if not levels else 0.5
        bits, k = max(64, math.ceil(-count * math.log(p) / math.log(2) ** 2 / 64) * 64), max(1, round(-math.log2(p)))
        if bits + sum(x[0] for x in levels) > max_bits or len(levels) > 60:
            return None
        i = len(levels)

        words = left.select(F.explode(_spots(i, bits, k)).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("ones"))
        packed = np.zeros(bits // 64, "<u8")
        for row in words.toLocalIterator():
            packed[row["word"]] = row["ones"] & 0xFFFFFFFFFFFFFFFF
        levels.append((bits, k, packed.view(np.uint8)))
        whole = Cascade(tuple(levels))
        # keys of the other kind that all levels so far take in
        odd = len(levels) % 2 == 1
        left = keys.filter(F.col("listed") != F.lit(odd)).filter(_member([whole]) == F.lit(odd))
        count = left.count()
    return Cascade(tuple(levels))


def build_cascades(universe: DataFrame, max_bits: int = 1 << 28) -> list[Cascade]:
    """From distinct (key, listed): a cascade for each part of the universe, none over ``max_bits``.

    Parts are by hash, as many as it takes: what a task needs at once is bounded
    at any number of keys.
    """
    if max_bits < 1 << 12:
        raise ValueError("max_bits: 4,096 at least")
    keys = written(universe.select(*_pair("key"), "listed"), "cascade")
    n = 1
    while True:
        parts = written(keys.withColumn("part", _parts(n)), "cascade") if n > 1 else keys.withColumn("part", F.lit(0))
        sizes = {r["part"]: (r["n_in"], r["n_out"]) for r in parts.groupBy("part").agg(F.count(F.when(F.col("listed"), 1)).alias("n_in"), F.count(F.when(~F.col("listed"), 1)).alias("n_out")).collect()}
        out = []
        for k in range(n):
            made = build_cascade(parts.filter(F.col("part") == k), *sizes.get(k, (0, 0)), max_bits)
            if made is None:
                break
            out.append(made)
        if len(out) == n:
            return out
        n *= 2


def link_dense(pages: DataFrame, most: int = MAX_LINKS) -> DataFrame:
    """Distinct (key, listed) of the hosts of ``pages`` (host, html): whether all their pages together have over ``most`` links in a thousand characters."""
    text = F.coalesce("html", F.lit(""))
    links = F.length(text) - F.length(F.replace(text, F.lit("<a "), F.lit("a ")))
    g = pages.groupBy("host").agg(F.sum(links).alias("links"), F.sum(F.length(text).cast("long")).alias("n"))
    return g.select(F.col("host").alias("key"), (F.col("links") * 1000 > most * F.col("n")).alias("listed"))


def judge(pages: DataFrame, listed_host: Column | None = None, rules=RULES, max_bits: int = 1 << 28) -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of these names are replaced.

    Urls that no rule fits are blocked if their host is listed: ``listed_host``
    says so of a column ``key`` of hosts, by default ``link_dense`` of the pages'
    html.  The key universe is all hosts of ``pages``, so the answer of the
    cascades is exact.  Null urls and those without host are allowed, and repeated
    ones judged alike; very long urls are like any other.  An empty table gives none.
    """
    host, path = host_path(F.col("url"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    read = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    if listed_host is None:
        universe = link_dense(read)
    else:
        universe = read.select(F.col("host").alias("key")).distinct().withColumn("listed", F.coalesce(listed_host, F.lit(False)))
    universe = universe.withColumn("listed", F.col("listed") & (F.col("key") != ""))
    cascades = build_cascades(universe, max_bits)
    a, b, bad = (free(x, read.columns) for x in ("_a", "_b", "_bad"))
    seen = read.withColumns(dict(zip((a, b), _pair("host"), strict=True)))
    if len(cascades) > 1:
        cascades = [pages.sparkSession.sparkContext.broadcast(c) for c in cascades]
    seen = seen.withColumn(bad, _member(cascades, a, b)).drop(a, b)
    return seen.withColumns({"rule": rule, "verdict": F.coalesce(says, F.when(F.col(bad), "block").otherwise("allow"))}).drop(bad)


def op6_urls(spark, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH rest AS (SELECT page_id, length(coalesce(html, '')) AS n, (length(coalesce(html, '')) - length(replace(coalesce(html, ''), '<a ', 'a '))) AS links, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, n, links, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
dense AS (SELECT host, host <> '' AND sum(links) * 1000 > 3 * sum(n) AS listed FROM parts GROUP BY host),
ruled AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM parts JOIN dense USING (host))
SELECT page_id, host, path, rule, CASE rule
  WHEN 'www.example.com/en/' THEN 'allow' WHEN 'com/' THEN 'allow' WHEN 'example.com/en/' THEN 'block' WHEN 'net/es/' THEN 'block' WHEN 'net/fr/' THEN 'block'
  ELSE CASE WHEN listed THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled
"""
