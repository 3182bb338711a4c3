"""Mixing sources to target weights: token totals per source, repetition rates,
and per document floor(rate) copies plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starfold.llm.common import free

WORD = r"[^\x20\x09-\x0D]+"
#: The weights dealt to the sources in code point order, again and again.
WEIGHTS = (3, 1, 2)


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, target from rows of (source, size).

    The targets share ``share`` of all sizes by weight.  None is over ``most``
    times its source's size: the excess goes to the others by weight until none
    is above.  That level is found in one pass over the sources in order of
    limit per weight, where those at their limit come first.  A source without
    words has target 0.  The windows run over one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = totals.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_code) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    limit = F.col("source_size") * F.lit(float(most))
    levels = weighed.select(
        "source", "source_size", "w", limit.alias("limit"), F.row_number().over(order).alias("rn"),
        ((F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))).alias("level"),
    )
    free = levels.withColumn("free_rn", F.min(F.when(F.col("level") * F.col("w") < F.col("limit"), F.col("rn"))).over(everything))
    first = free.withColumn("common", F.max(F.when(F.col("rn") == F.col("free_rn"), F.col("level"))).over(everything))
    return first.select("source", "source_size", F.when(F.col("rn") < F.coalesce("free_rn", F.lit(1 << 30)), F.col("limit")).otherwise(F.col("common") * F.col("w")).alias("target"))


def chance(key: Column, seed: str) -> Column:
    """A number in [0, 1) that only key and seed decide; null keys share one."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: str = "mix-0") -> DataFrame:
    """``docs`` with size, source_size, target and copies; columns of these names are replaced.

    Null texts have size 0, null sources are one source (last), repeated rows
    are documents of their own that share a chance where they share a doc_id.
    An empty table gives an empty one.  Copies are a function of the row and
    its source's rate alone, so reruns agree, however rows are partitioned.
    """
    sized = docs.drop("source_size", "target", "copies").withColumn("size", word_count())
    own = free("_source", docs.columns)
    goals = source_targets(sized.select("source", "size"), weights, share, most).withColumnRenamed("source", own)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # One row per source: small enough to broadcast, or else AQE splits the hot source of the sort-merge join.
    return (
        sized.join(goals, F.col("source").eqNullSafe(F.col(own)), "left").drop(own)
        .withColumn("copies", (F.floor(rate) + (chance(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")).cast("long"))
    )


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each document as often as the mix takes it; ``columns`` of it, of whatever names."""
    times = F.sequence(F.lit(1), F.col("copies").cast("int"))
    return mixed.filter(F.col("copies") > 0).withColumn(free("_copy", mixed.columns), F.explode(times)).select(*(F.col(f"`{c}`") for c in columns))


def mixed_rows(docs: DataFrame, **settings) -> DataFrame:
    """Whole rows of ``docs``, each as often as the mix takes it: columns named like the mix's own are carried unchanged."""
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text", "source")
    return emit(mix(held, **settings), ["row"]).select("row.*")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    from starfold.llm.common import load

    return mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


MIX_SQL = r"""
sized AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {docs}),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, ([3, 1, 2])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM totals),
levels AS (SELECT *, source_size * 2.0::DOUBLE AS lim, row_number() OVER o AS rn,
    (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed WINDOW o AS (ORDER BY source_size / w, source ASC NULLS LAST)),
free AS (SELECT *, min(CASE WHEN level * w < lim THEN rn END) OVER () AS free_rn FROM levels),
common AS (SELECT *, max(CASE WHEN rn = free_rn THEN level END) OVER () AS lvl FROM free),
goals AS (SELECT source, source_size, CASE WHEN rn < coalesce(free_rn, 1073741824) THEN lim ELSE lvl * w END AS target FROM common),
rated AS (SELECT s.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS rate
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
mixed AS (SELECT *, (floor(rate) + CASE WHEN ('0x' || substr(md5('mix-0:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM rated)
"""
OP4_SQL = "WITH " + MIX_SQL.format(docs="documents") + "SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken FROM mixed"
