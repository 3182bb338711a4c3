"""Cleaning and time-domain operators on long light curves (tic_id, us, time, f, ...).

All windows of one call share the partitioning by star, so each costs one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from starfold.functions.columns import MAD_SCALE



def star() -> WindowSpec:
    return Window.partitionBy("tic_id")


def by_time() -> WindowSpec:
    return star().orderBy("us")


def normalized(lc: DataFrame) -> DataFrame:
    """flux: f over its star's median, unless that is 1 already, or not positive."""
    med = F.median("f").over(star())
    return lc.withColumn("med", med).withColumn("flux", F.when((F.abs(F.col("med") - 1) <= 0.01 + 1e-5) | (F.col("med") <= 0), F.col("f").cast("double")).otherwise(F.col("f") / F.col("med")))


def good_quality(lc: DataFrame, bits: int | None = None) -> DataFrame:
    """Rows without any of ``bits``; without any bit at all if it is None."""
    return lc.filter((F.col("quality") == 0) if bits is None else (F.col("quality").bitwiseAND(F.lit(bits)) == 0))


def robust_scale(lc: DataFrame) -> DataFrame:
    """Per star: median, median absolute deviation, and the scale it stands for."""
    dev = lc.select("tic_id", "f", F.median("f").over(star()).alias("med"))
    return dev.groupBy("tic_id").agg(F.max("med").alias("med"), F.median(F.abs(F.col("f") - F.col("med"))).alias("mad")).withColumn("scale", F.col("mad") * MAD_SCALE)


def sigma_clipped(lc: DataFrame, upper: float = 5.0, lower: float = 3.0, rounds: int = 5) -> DataFrame:
    """``lc`` with keep: what is left after up to ``rounds`` of clipping around the median of what was kept.

    A round with under 3 points, or without scatter, keeps what there was.
    """
    out = lc.withColumn("keep", F.lit(True))
    for _ in range(rounds):
        kept = F.when(F.col("keep"), F.col("f"))
        out = out.withColumns({"_m": F.median(kept).over(star()), "_n": F.count(kept).over(star())})
        out = out.withColumn("_s", F.median(F.when(F.col("keep"), F.abs(F.col("f") - F.col("_m")))).over(star()) * MAD_SCALE)
        fits = (F.col("f") - F.col("_m") <= F.col("_s") * upper) & (F.col("f") - F.col("_m") >= F.col("_s") * -lower)
        out = out.withColumn("keep", F.when((F.col("_n") < 3) | (F.col("_s") == 0), F.col("keep")).otherwise(F.col("keep") & fits)).drop("_m", "_n", "_s")
    return out


def outlier_mask(lc: DataFrame, upper: float = 3.0, lower: float = 20.0) -> DataFrame:
    """keep: residuals from 1 within the scaled deviation around zero, not around their median."""
    r = normalized(lc).withColumn("resid", F.col("flux") - 1)
    s = F.median(F.abs(F.col("resid") - F.col("_rm"))).over(star()) * MAD_SCALE
    r = r.withColumn("_rm", F.median("resid").over(star())).withColumn("_s", s)
    return r.withColumn("keep", (F.col("_s") == 0) | ((F.col("resid") <= F.col("_s") * upper) & (F.col("resid") >= F.col("_s") * -lower))).drop("_rm", "_s")


def finite_points(lc: DataFrame, time: str = "time", flux: str = "f") -> DataFrame:
    """The rows whose time and flux are finite numbers."""
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    return lc.filter(good(time) & good(flux))


def inverse_variance(lc: DataFrame, error: str = "flux_err") -> DataFrame:
    """weight: 1 over the squared error, adding up to 1 by star.

    Errors that are missing or not above 0 count as the star's median error;
    without any error all points weigh alike.
    """
    good = F.when((F.col(error) > 0) & ~F.isnan(F.col(error).cast("double")), F.col(error).cast("double"))
    used = F.coalesce(good, F.median(good).over(star()), F.lit(1.0))
    raw = lc.withColumn("_w", 1 / (used * used))
    return raw.withColumn("weight", F.col("_w") / F.sum("_w").over(star())).drop("_w")


#: What the weights of a star add up to, as integers: sums of them don't depend on the order.
UNITS = 1_000_000_000


def weight_units(lc: DataFrame, error: str = "flux_err") -> DataFrame:
    """weight: that of ``inverse_variance`` in ``UNITS``, as a whole number."""
    return inverse_variance(lc, error).withColumn("weight", F.round(F.col("weight") * UNITS).cast("long"))


def time_binned(lc: DataFrame, bins: int = 20) -> DataFrame:
    """Equal widths over each star's span; mean and standard error, null in bins without rows."""
    w = lc.select("tic_id", "time", "f", F.min("time").over(star()).alias("lo"), F.max("time").over(star()).alias("hi"))
    spot = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("time") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))).otherwise(F.lit(0))
    g = w.withColumn("bin", spot.cast("int")).groupBy("tic_id", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("s"), F.sum(F.col("f") * F.col("f")).alias("ss"))
    mean = F.col("s") / F.col("n")
    grid = lc.select("tic_id").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(g, ["tic_id", "bin"], "left").select("tic_id", "bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"), mean.alias("mean"), (F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))) / F.sqrt(F.col("n").cast("double"))).alias("err"))


def stitched(lc: DataFrame, sector: str = "kind") -> DataFrame:
    """Each sector over its own median, then one curve with the sector's place as segment."""
    own = Window.partitionBy("tic_id", sector)
    n = lc.withColumn("flux", F.col("f") / F.median("f").over(own))
    return n.withColumn("segment", F.dense_rank().over(star().orderBy(sector)))


def gap_segments(lc: DataFrame, tolerance_us: int = 43200000000) -> DataFrame:
    """segment: grows where two neighbours are further apart than the tolerance."""
    far = (F.col("us") - F.lag("us").over(by_time())) > tolerance_us
    return lc.withColumn("far", F.coalesce(far.cast("int"), F.lit(0))).withColumn("segment", F.sum("far").over(by_time())).drop("far")


def middle(a: Column) -> Column:
    """Median of an array of numbers without nulls."""
    s, n = F.array_sort(a), F.size(a)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor((n + 2) / 2).cast("int"))) / 2


def running_median(lc: DataFrame, width: int = 5) -> DataFrame:
    """med: median of ``width`` points around each, the ends mirrored without repeating the edge.

    One array per star: it is one curve, of bounded length.
    """
    half = width // 2
    one = lc.groupBy("tic_id").agg(F.array_sort(F.collect_list(F.struct("us", "f"))).alias("p")).filter(F.size("p") > half)
    f = F.transform("p", lambda x: x["f"])
    padded = F.concat(F.reverse(F.slice(f, 2, half)), f, F.reverse(F.slice(f, F.size(f) - half, F.lit(half))))
    return one.withColumn("q", padded).select("tic_id", F.posexplode("p").alias("i", "x"), "q").select("tic_id", F.col("x.us").alias("us"), middle(F.slice("q", F.col("i") + 1, F.lit(width))).alias("med"))


def cadence(lc: DataFrame) -> DataFrame:
    """Median step between neighbours, in microseconds."""
    return lc.withColumn("step", F.col("us") - F.lag("us").over(by_time())).groupBy("tic_id").agg(F.median("step").alias("cadence_us"))


def local_peaks(rows: DataFrame, value: str = "f") -> DataFrame:
    """Rows strictly above both neighbours in time."""
    before, after = F.lag(value).over(by_time()), F.lead(value).over(by_time())
    return rows.withColumn("peak", (F.col(value) > before) & (F.col(value) > after)).filter("peak").drop("peak")


def content_hash(lc: DataFrame) -> DataFrame:
    """A digest of each curve's points in time order."""
    points = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("us", "f"))), lambda x: F.concat_ws(":", x["us"].cast("string"), x["f"].cast("string"))), ",")
    return lc.groupBy("tic_id").agg(F.sha2(points.cast("binary"), 256).alias("digest"))
