"""Period search as relations: grids, folded histograms, box search, Lomb-Scargle, autocorrelation."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starfold.operators.clean import star


def spans(lc: DataFrame) -> DataFrame:
    return lc.groupBy("tic_id").agg((F.max("time") - F.min("time")).alias("baseline"), F.min("time").alias("start"))


def period_grid(baselines: DataFrame, low: float = 1.0, high: float | None = None, width: float = 0.3, oversample: float = 40.0, most: int = 2000000) -> DataFrame:
    """Uniform in frequency, step oversample * width / baseline², at least 16 of them; ascending periods from 0 on.

    A larger ``oversample`` makes a coarser grid: that is how it is defined.
    """
    top = F.lit(high) if high else F.col("baseline") / 2
    g = baselines.withColumns({"fmin": 1 / top, "df": F.lit(oversample * width) / (F.col("baseline") * F.col("baseline"))})
    n = F.greatest(F.least(F.ceil((F.lit(1 / low) - F.col("fmin")) / F.col("df")) + 1, F.lit(most)), F.lit(16)).cast("int")
    g = g.filter((F.col("baseline") > 0) & (top > low)).withColumn("n", n)
    return g.select("tic_id", "n", F.posexplode(F.transform(F.sequence(F.col("n") - 1, F.lit(0), F.lit(-1)), lambda i: 1 / (F.col("fmin") + F.col("df") * i))).alias("period_idx", "period"))


class GridRows:
    """The rows of ``period_grid`` for one star, one after the other: a long grid never is one array."""

    def eval(self, baseline: float | None, low: float, high: float | None, width: float, oversample: float, most: int) -> Iterator[tuple[int, int, float]]:
        top = high or (baseline or 0.0) / 2
        if baseline and baseline > 0 and top > low:
            first, step = 1 / top, oversample * width / (baseline * baseline)
            n = max(min(math.ceil((1 / low - first) / step) + 1, most), 16)
            for i in range(n):
                yield n, i, 1 / (first + step * (n - 1 - i))


def period_grid_rows(baselines: DataFrame, low: float = 1.0, high: float | None = None, width: float = 0.3, oversample: float = 40.0, most: int = 2000000) -> DataFrame:
    """``period_grid`` by a table function joined laterally."""
    grid = F.udtf(GridRows, returnType="n int, period_idx int, period double")
    rows = grid(F.col("baseline").outer(), F.lit(low), F.lit(high).cast("double"), F.lit(width), F.lit(oversample), F.lit(most))
    return baselines.lateralJoin(rows).select("tic_id", "n", "period_idx", "period")


def period_grid_cached(baselines: DataFrame, low: float = 1.0, oversample: float = 1.0) -> DataFrame:
    """The other grid: step 1 / (oversample * baseline), longest period the baseline itself."""
    g = baselines.filter(F.col("baseline") > low).withColumn("df", 1 / (F.lit(oversample) * F.col("baseline")))
    n = (F.floor((F.lit(1 / low) - 1 / F.col("baseline")) / F.col("df")) + 1).cast("int")
    return g.select("tic_id", F.posexplode(F.transform(F.sequence(n - 1, F.lit(0), F.lit(-1)), lambda i: 1 / (1 / F.col("baseline") + F.col("df") * i))).alias("period_idx", "period"))


def fixed_periods(n: int, low: float = 1.0, step: float = 0.5) -> Column:
    """An array of (period_idx, period); it is a literal, so the product with it is no join."""
    return F.array(*(F.struct(F.lit(i).alias("period_idx"), F.lit(low + step * i).alias("period")) for i in range(n)))


#: Points of a partition of ``by_star``, on average: each becomes a row a period, and all bins and boxes of its stars are held at once.
POINTS = 1 << 15


def by_star(lc: DataFrame, points: int = POINTS) -> DataFrame:
    """``lc`` by star in as many partitions as keep each at some ``points``, so that a task's memory does not grow with the table.

    Their number is given, so partitions are not joined by their size before the
    periods multiply them.  Counts the rows: of a table of files, by the files' footers.
    """
    spark = lc.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return lc.repartition(max(least, math.ceil(lc.count() / points)), "tic_id")


def histogram(lc: DataFrame, periods: Column, bins: int, weight: str | None = None) -> DataFrame:
    """Counts and sums of flux by star, period and phase bin from the star's first time; rows that come from ``by_star`` are not shuffled again.

    With ``weight``, a column of whole numbers (``clean.weight_units``), n and s
    are sums of it and of flux times it, and all that follows is weighted.
    """
    w = F.col(weight) if weight else F.lit(1).cast("long")
    x = lc.select("tic_id", "f", w.alias("w"), (F.col("time") - F.min("time").over(star())).alias("dt")).select("tic_id", "f", "w", "dt", F.inline(periods))
    turn = F.col("dt") / F.col("period")
    b = F.least(F.floor((turn - F.floor(turn)) * bins), F.lit(bins - 1)).cast("int")
    n, s = (F.sum("w"), F.sum(F.col("w") * F.col("f"))) if weight else (F.count(F.lit(1)), F.sum("f"))
    return x.withColumn("bin", b).groupBy("tic_id", "period_idx", "period", "bin").agg(n.alias("n"), s.alias("s"))


def box_power(hist: DataFrame, bins: int, durations: tuple[float, ...]) -> DataFrame:
    """Signal residue of each box: (tic_id, period_idx, period, dur_idx, start, power, depth).

    Boxes run around the end of the phase range.  Widths are rounded half to even,
    one bin at least; those of half the period or more are left out.
    """
    keys = ["tic_id", "period_idx", "period"]
    one = hist.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("n", "s")))).alias("m"), F.sum("n").alias("tn"), F.sum("s").alias("ts"))
    ring = F.transform(F.sequence(F.lit(0), F.lit(2 * bins - 1)), lambda b: F.struct(b.alias("start"), F.coalesce(F.col("m")[b % bins]["n"], F.lit(0).cast("long")).alias("n"), F.coalesce(F.col("m")[b % bins]["s"], F.lit(0).cast("long")).alias("s")))
    dense = one.select(*keys, "tn", "ts", F.inline(ring))
    # a box is a difference of two running sums, both in the one array of its period: no join, and no further shuffle
    run = Window.partitionBy("tic_id", "period_idx").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    sums = dense.withColumns({"cn": F.sum("n").over(run), "cs": F.sum("s").over(run)})
    whole = sums.groupBy("tic_id", "period_idx").agg(F.first("period").alias("period"), F.first("tn").alias("tn"), F.first("ts").alias("ts"), F.array_sort(F.collect_list(F.struct("start", "cn", "cs", "n", "s"))).alias("sums"))
    lengths = F.array(*(F.struct(F.lit(d).alias("dur_idx"), F.lit(length).alias("length")) for d, length in enumerate(durations)))
    width = F.greatest(F.rint(F.col("length") / F.col("period") * bins), F.lit(1.0)).cast("int")
    wide = whole.select("*", F.inline(lengths)).withColumn("width", width).filter((F.col("width") < bins) & (F.col("length") / F.col("period") < 0.5))
    at = lambda i: F.get("sums", i)
    box = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda j: F.struct(j.alias("start"), (at(j + F.col("width") - 1)["cn"] - at(j)["cn"] + at(j)["n"]).alias("n"), (at(j + F.col("width") - 1)["cs"] - at(j)["cs"] + at(j)["s"]).alias("s")))
    out = wide.select(*keys, "tn", "ts", "dur_idx", F.inline(box)).filter("n > 0 and n < tn")
    diff = F.col("s") - F.col("n").cast("double") / F.col("tn") * F.col("ts")
    return out.select(*keys, "dur_idx", "start", (diff * diff / (F.col("n").cast("double") * (F.col("tn") - F.col("n")) / F.col("tn"))).alias("power"), (F.col("ts") / F.col("tn") - F.col("s") / F.col("n")).alias("depth"))


def spectrum(boxes: DataFrame) -> DataFrame:
    """The best box of each period; ties go to the earlier duration, then the earlier start."""
    best = boxes.groupBy("tic_id", "period_idx", "period").agg(F.max(F.struct("power", (-F.col("dur_idx")).alias("d"), (-F.col("start")).alias("s"), "depth")).alias("b"))
    return best.select("tic_id", "period_idx", "period", F.col("b.power").alias("power"), (-F.col("b.d")).alias("dur_idx"), (-F.col("b.s")).alias("start"), F.col("b.depth").alias("depth"))


def best_period(power: DataFrame) -> DataFrame:
    """Ties go to the earlier period.  With twice and thrice the period, and half of it."""
    b = power.groupBy("tic_id").agg(F.max(F.struct("power", (-F.col("period_idx")).alias("i"), "period", "dur_idx", "start", "depth")).alias("b"))
    return b.select("tic_id", F.col("b.period").alias("period"), F.col("b.power").alias("power"), F.col("b.dur_idx").alias("dur_idx"), F.col("b.start").alias("start"), F.col("b.depth").alias("depth"))


def harmonics(period: Column) -> Column:
    return F.array(period / 2, period * 2, period * 3)


def detection_efficiency(power: DataFrame) -> DataFrame:
    """The two definitions: peak over the median, and over the mean, in population deviations."""
    g = power.groupBy("tic_id").agg(F.max("power").alias("top"), F.median("power").alias("mid"), F.avg("power").alias("mean"), F.stddev_pop("power").alias("sd"))
    return g.select("tic_id", F.when(F.col("sd") > 0, (F.col("top") - F.col("mid")) / F.col("sd")).alias("sde_median"), F.when(F.col("sd") > 0, (F.col("top") - F.col("mean")) / F.col("sd")).alias("sde_mean"))


def lomb_scargle(lc: DataFrame, periods: Column) -> DataFrame:
    """Power over the variance, with the usual offset in time: two passes of sums by star and period."""
    c = lc.select("tic_id", "time", (F.col("f") - F.sum("f").over(star()) / F.count(F.lit(1)).over(star())).alias("y"))
    x = c.select("tic_id", "time", "y", F.inline(periods)).withColumn("w", F.lit(2 * math.pi) / F.col("period"))
    tau = x.groupBy("tic_id", "period_idx", "period", "w").agg(F.sum(F.sin(2 * F.col("w") * F.col("time"))).alias("s2"), F.sum(F.cos(2 * F.col("w") * F.col("time"))).alias("c2"))
    tau = tau.select("tic_id", "period_idx", (F.atan2("s2", "c2") / (2 * F.col("w"))).alias("tau"))
    y = x.join(tau, ["tic_id", "period_idx"])
    co, si = F.cos(F.col("w") * (F.col("time") - F.col("tau"))), F.sin(F.col("w") * (F.col("time") - F.col("tau")))
    g = y.groupBy("tic_id", "period_idx", "period").agg(F.sum(F.col("y") * co).alias("yc"), F.sum(F.col("y") * si).alias("ys"), F.sum(co * co).alias("cc"), F.sum(si * si).alias("ss"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.count(F.lit(1)).alias("n"))
    return g.select("tic_id", "period_idx", "period", F.when(F.col("yy") > 0, 0.5 * (F.col("yc") * F.col("yc") / F.col("cc") + F.col("ys") * F.col("ys") / F.col("ss")) / (F.col("yy") / F.col("n"))).alias("power"))


def autocorrelation(lc: DataFrame, lags: int = 8) -> DataFrame:
    """Products of each point with those some places later in time, over the variance."""
    order = star().orderBy("us")
    x = lc.select("tic_id", "us", (F.col("f") * F.count(F.lit(1)).over(star()) - F.sum("f").over(star())).cast("double").alias("y"))
    pairs = [F.sum(F.col("y") * F.col(f"y{k}")).alias(f"a{k}") for k in range(1, lags + 1)]
    g = x.withColumns({f"y{k}": F.lead("y", k).over(order) for k in range(1, lags + 1)}).groupBy("tic_id").agg(F.sum(F.col("y") * F.col("y")).alias("a0"), *pairs)
    return g.select("tic_id", F.posexplode(F.array(*(F.try_divide(F.col(f"a{k}"), F.col("a0")) for k in range(1, lags + 1)))).alias("i", "acf")).select("tic_id", (F.col("i") + 1).alias("lag"), "acf")
