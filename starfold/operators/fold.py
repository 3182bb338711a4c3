"""Operators in folded time; lc carries period, t0 and duration of its star's ephemeris."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starfold.functions.columns import cycle, cycle_even, phase, wrapped
from starfold.operators.clean import star
from starfold.operators.search import by_star

def folded(lc: DataFrame) -> DataFrame:
    """phase, its distance from transit in days, and the two cycle numbers."""
    out = lc.withColumns({"phase": phase(F.col("time"), F.col("period"), F.col("t0")), "cycle": cycle(F.col("time"), F.col("period"), F.col("t0")), "cycle_even": cycle_even(F.col("time"), F.col("period"), F.col("t0"))})
    return out.withColumn("dt", F.col("phase") * F.col("period"))


def phase_bins(lc: DataFrame, bins: int = 20) -> DataFrame:
    """Mean and median by phase over the whole turn; bins without rows do not appear."""
    b = F.least(F.floor((F.col("phase") + 0.5) * bins), F.lit(bins - 1)).cast("int")
    g = folded(lc).withColumn("bin", b).groupBy("tic_id", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("s"), F.median("f").alias("median"))
    return g.select("tic_id", "bin", "n", (F.col("s") / F.col("n")).alias("mean"), "median")


def filled_view(bins: DataFrame, n: int = 20, value: str = "median", stars: DataFrame | None = None) -> DataFrame:
    """Every bin: empty ones by straight lines between their neighbours, ends by the nearest; stars without any bin are all 0.

    A star's known bins are one array, and each is spread over the places up to the next: work grows with ``n``, not with its square.
    """
    c = F.col
    good = bins.filter(c(value).isNotNull() & c("bin").between(0, n - 1)).groupBy("tic_id").agg(F.array_sort(F.collect_list(F.struct("bin", c(value).cast("double").alias("v")))).alias("known"))
    rows = (bins if stars is None else stars).select("tic_id").distinct().join(good, "tic_id", "left")
    at = lambda i: F.get("known", i)
    last = F.size("known") - 1
    stretch = lambda x, i: F.struct(x["bin"].alias("lb"), x["v"].alias("lv"), at(i + 1)["bin"].alias("rb"), at(i + 1)["v"].alias("rv"), F.when(i == 0, 0).otherwise(x["bin"]).alias("low"), F.when(i == last, n - 1).otherwise(at(i + 1)["bin"] - 1).alias("high"))
    none, nowhere = F.lit(0.0), F.lit(None).cast("int")
    empty = F.array(F.struct(nowhere.alias("lb"), none.alias("lv"), nowhere.alias("rb"), none.alias("rv"), F.lit(0).alias("low"), F.lit(n - 1).alias("high")))
    parts = rows.select("tic_id", F.inline(F.coalesce(F.transform("known", stretch), empty)))
    every = parts.select("tic_id", "lb", "lv", "rb", "rv", F.explode(F.sequence("low", "high")).alias("bin"))
    line = c("lv") + (c("rv") - c("lv")) * (c("bin") - c("lb")) / (c("rb") - c("lb"))
    return every.select("tic_id", "bin", F.when(c("bin") > c("lb"), F.coalesce(line, "lv")).otherwise(c("lv")).alias("value"))


def normal_view(view: DataFrame) -> DataFrame:
    """Less its median, then over the depth of its lowest point where there is one."""
    v = view.withColumn("value", F.col("value") - F.median("value").over(star())).withColumn("low", F.min("value").over(star()))
    return v.select("tic_id", "bin", F.when(F.col("low") < -1e-12, F.col("value") / F.abs("low")).otherwise(F.col("value")).alias("value"))


#: Views of a folded curve and how many bins each has.
VIEWS = {"global": 2001, "local": 201, "secondary": 201, "odd": 201, "even": 201}


def view_bins(lc: DataFrame, kind: str, bins: int) -> DataFrame:
    """Medians by phase in a view's window: the whole turn, or three durations around mid-transit or half a turn from it."""
    x = folded(lc)
    half = F.greatest(F.least(F.lit(0.49), F.lit(3.0) * F.col("duration") / F.col("period")), F.lit(1.0 / bins))
    if kind == "global":
        half = F.lit(0.5)
    if kind == "secondary":
        u = (F.col("time") - F.col("t0")) / F.col("period")
        x = x.withColumn("phase", u - F.floor(u) - 0.5)
    if kind in ("odd", "even"):
        x = x.filter((F.pmod(F.col("cycle"), F.lit(2)) != 0) == F.lit(kind == "odd"))
    inside = x.withColumn("half", half).filter(F.abs("phase") <= F.col("half"))
    b = F.least(F.floor((F.col("phase") + F.col("half")) / (2 * F.col("half")) * bins), F.lit(bins - 1)).cast("int")
    return inside.withColumn("bin", b).groupBy("tic_id", "bin").agg(F.median("f").alias("median"))


def view(lc: DataFrame, kind: str, bins: int | None = None) -> DataFrame:
    """(tic_id, bin, value): one of ``VIEWS``, filled and normal.

    Points are dealt by star first, since partitions joined by their few bytes would hold too many bins.
    """
    bins, lc = bins or VIEWS[kind], by_star(lc)
    return normal_view(filled_view(view_bins(lc, kind, bins), bins, stars=lc))


def panel_bins(x: DataFrame, bins: int, at: str = "phase") -> DataFrame:
    """Means of f in equal bins over each star's own range of ``at``: (tic_id, bin, center, n, mean) of the bins that have rows."""
    w = x.select("tic_id", "f", F.col(at).alias("x"), F.min(at).over(star()).alias("lo"), F.max(at).over(star()).alias("hi")).filter("hi > lo")
    b = F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int")
    g = w.withColumn("bin", b).groupBy("tic_id", "bin").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.sum("f").alias("s"), F.count(F.lit(1)).alias("n"))
    return g.select("tic_id", "bin", (F.col("lo") + (F.col("bin") + 0.5) * ((F.col("hi") - F.col("lo")) / bins)).alias("center"), "n", (F.col("s") / F.col("n")).alias("mean"))


def panel_phase(lc: DataFrame, zoom: bool = False) -> DataFrame:
    """The phase-fold panel: 80 bins of the whole turn, or 50 of which those within 2.5 durations are shown."""
    x = folded(lc)
    if not zoom:
        return panel_bins(x, 80)
    width = lc.groupBy("tic_id").agg((F.lit(2.5) * F.max("duration") / F.max("period")).alias("half"))
    return panel_bins(x, 50).join(width, "tic_id").filter(F.abs("center") <= F.col("half")).drop("half")


def panel_odd_even(lc: DataFrame) -> DataFrame:
    """40 bins of the odd and of the even transits, each over its own range of phase."""
    x = folded(lc).withColumn("odd", F.pmod(F.col("cycle"), F.lit(2)) != 0)
    side = lambda odd: panel_bins(x.filter(F.col("odd") == F.lit(odd)), 40).withColumn("side", F.lit("odd" if odd else "even"))
    return side(True).unionByName(side(False))


def panel_secondary(lc: DataFrame, window: float = 0.15) -> DataFrame:
    """25 bins around half a turn from mid-transit."""
    x = folded(lc)
    p = F.col("phase") - F.floor("phase")
    return panel_bins(x.withColumn("phase", p).filter(F.abs(F.col("phase") - 0.5) < window), 25)


def window_depths(lc: DataFrame) -> DataFrame:
    """Per star, for all, odd and even transits: median of the surroundings less the mean inside, and counts.

    Inside: half a duration around mid-transit; surroundings: 0.75 to 2.5 durations.
    """
    g = folded(lc).groupBy("tic_id").agg(*depth_sums())
    return g.select("tic_id", *depths_of_sums(), "all_in", "odd_in", "even_in", "all_out")


def depth_sums() -> list[Column]:
    """What ``window_depths`` gathers of a star's folded points."""
    near = F.abs(F.col("dt"))
    inside, around, odd = near <= F.col("duration") / 2, (near >= F.col("duration") * 0.75) & (near <= F.col("duration") * 2.5), F.pmod(F.col("cycle"), F.lit(2)) != 0
    aggs = []
    for name, which in (("all", F.lit(True)), ("odd", odd), ("even", ~odd)):
        aggs += [F.median(F.when(around & which, F.col("f"))).alias(f"{name}_base"), F.sum(F.when(inside & which, F.col("f"))).alias(f"{name}_sum"), F.count(F.when(inside & which, 1)).alias(f"{name}_in"), F.count(F.when(around & which, 1)).alias(f"{name}_out")]
    return aggs


def depths_of_sums() -> list[Column]:
    depth = lambda n: F.when((F.col(f"{n}_in") >= 1) & (F.col(f"{n}_out") >= 3), F.col(f"{n}_base") - F.try_divide(F.col(f"{n}_sum"), F.col(f"{n}_in"))).alias(f"{n}_depth")
    return [depth(n) for n in ("all", "odd", "even")]


def folded_depth(lc: DataFrame) -> DataFrame:
    """Median outside less median inside: 0.8 half-durations in, half to three half-durations out; null if too few points."""
    half, near = F.col("duration") / 2, F.abs(F.col("dt"))
    g = folded(lc).groupBy("tic_id").agg(F.median(F.when((near > half) & (near <= half * 3), F.col("f"))).alias("o"), F.median(F.when(near <= half * 0.8, F.col("f"))).alias("i"), F.count(F.lit(1)).alias("n"), F.count(F.when(near <= half * 0.8, 1)).alias("ni"), F.count(F.when((near > half) & (near <= half * 3), 1)).alias("no"))
    return g.select("tic_id", F.when((F.col("n") >= 10) & (F.col("ni") >= 1) & (F.col("no") >= 3), F.col("o") - F.col("i")).alias("depth"))


def transit_counts(lc: DataFrame) -> DataFrame:
    """Distinct transits with a point inside half a duration, by either rounding of cycles."""
    x = folded(lc)
    even_dt = F.abs(F.col("time") - F.col("t0") - F.col("cycle_even") * F.col("period"))
    return x.groupBy("tic_id").agg(F.count_distinct(F.when(F.abs("dt") <= F.col("duration") / 2, F.col("cycle"))).alias("n_floor"), F.count_distinct(F.when(even_dt <= F.col("duration") / 2, F.col("cycle_even"))).alias("n_even"))


def noise(lc: DataFrame) -> DataFrame:
    """1.4826 deviations of all points; spread of those out of transit, if over three."""
    x = folded(lc).withColumn("med", F.median("f").over(star()))
    out = F.when(F.abs("dt") > F.col("duration") / 2, F.col("f"))
    g = x.groupBy("tic_id").agg(F.median(F.abs(F.col("f") - F.col("med"))).alias("mad"), F.count(out).alias("n"), F.sum(out).alias("s"), F.sum(out * out).alias("ss"))
    mean = F.try_divide(F.col("s"), F.col("n"))
    return g.select("tic_id", (F.col("mad") * 1.4826).alias("flux_mad"), F.when(F.col("n") > 3, F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0)))).alias("oot_rms"))


def secondary_scan(lc: DataFrame, steps: int = 100) -> DataFrame:
    """The deepest dip away from the primary over a grid of phases; ties go to the smallest phase.

    A point is spread only over the places within half a duration of its own
    phase, whose first and last follow by arithmetic; the exact test is repeated
    on those.
    """
    x = folded(lc).withColumn("med", F.median("f").over(star())).withColumn("h", F.col("duration") / F.col("period") / 2)
    first, last = F.floor((F.col("phase") - F.col("h")) * steps).cast("int"), F.ceil((F.col("phase") + F.col("h")) * steps).cast("int")
    places = F.sequence(first, F.least(last, first + steps))
    whole = F.transform(places, lambda g: F.pmod(g + steps // 2, F.lit(steps)) - steps // 2)
    ends = F.when(F.array_contains(whole, -(steps // 2)), F.array(F.lit(steps // 2))).otherwise(F.array().cast("array<int>"))  # both ends of the turn are one place
    x = x.withColumn("g", F.explode(F.array_distinct(F.concat(whole, ends))))
    at = F.col("g") / F.lit(float(steps))
    near = x.filter((F.abs(at) >= F.col("h") * 2) & (wrapped(F.col("phase"), at) <= F.col("h")))
    d = near.groupBy("tic_id", "g").agg(F.max("med").alias("med"), F.sum("f").alias("s"), F.count(F.lit(1)).alias("n")).filter("n >= 3")
    d = d.withColumn("depth", F.col("med") - F.col("s") / F.col("n"))
    best = d.groupBy("tic_id").agg(F.max(F.struct("depth", (-F.col("g")).alias("g"), "n")).alias("b"))
    return best.select("tic_id", F.col("b.depth").alias("secondary_depth"), (-F.col("b.g") / F.lit(float(steps))).alias("secondary_phase"), F.col("b.n").alias("n"))


def river(lc: DataFrame, bins: int = 60, most: int | None = 200) -> DataFrame:
    """Mean flux by transit, from the first on, and phase bin; stars of 2 to ``most`` transits, or all of 2 or more if it is None."""
    b = F.least(F.floor((F.col("phase") + 0.5) * bins), F.lit(bins - 1)).cast("int")
    x = folded(lc).withColumns({"bin": b, "row": F.col("cycle") - F.min("cycle").over(star()), "rows": F.max("cycle").over(star()) - F.min("cycle").over(star()) + 1})
    some = F.col("rows") >= 2 if most is None else F.col("rows").between(2, most)
    return x.filter(some).groupBy("tic_id", "row", "bin").agg(F.sum("f").alias("s"), F.count(F.lit(1)).alias("n")).select("tic_id", "row", "bin", (F.col("s") / F.col("n")).alias("mean"))


def river_range(grid: DataFrame) -> DataFrame:
    """The range of color of each star's river: percentiles 3 and 97 of its cells."""
    return grid.groupBy("tic_id").agg(F.percentile("mean", F.lit(0.03)).alias("low"), F.percentile("mean", F.lit(0.97)).alias("high"))


def epochs(lc: DataFrame, most: int | None = 400) -> DataFrame:
    """Times of mid-transit inside each star's span; of stars with up to ``most``, or of all if it is None."""
    g = lc.groupBy("tic_id").agg(F.min("time").alias("lo"), F.max("time").alias("hi"), F.first("period").alias("period"), F.first("t0").alias("t0"))
    n = g.withColumns({"a": F.ceil((F.col("lo") - F.col("t0")) / F.col("period")), "b": F.floor((F.col("hi") - F.col("t0")) / F.col("period"))}).filter("b >= a")
    n = n if most is None else n.filter(F.col("b") - F.col("a") < most)
    return n.select("tic_id", F.explode(F.sequence("a", "b")).alias("epoch"), "t0", "period").select("tic_id", "epoch", (F.col("t0") + F.col("epoch") * F.col("period")).alias("time"))
