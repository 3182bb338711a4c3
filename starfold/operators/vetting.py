"""Per-star significance and physics tests, as expressions over aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfold.functions import columns as X
from starfold.operators import clean, fold

#: Limits of the flags.
SIGMA_ODD_EVEN, FRACTION_ODD_EVEN, SNR_SECONDARY, RATIO_LOW, RATIO_HIGH = 5.0, 0.10, 5.0, 0.15, 0.95
V_SHAPE, CROWDING, SWEET, LOW_SNR, BIG_RADIUS, DENSITY_LOW, DENSITY_HIGH, PRIMARY_OK = 0.35, 0.9, 0.5, 7.1, 2.0, 0.2, 5.0, 10.0
FLAGS = ("eb_odd_even", "eb_secondary", "eb_vshape", "blend_contamination", "other_variability", "low_snr", "implied_radius_too_big", "density_inconsistent")


def rounded(c: Column, places: int = 6) -> Column:
    return F.round(c, places)


def transit_snr(lc: DataFrame) -> DataFrame:
    """Folded depth over the scatter out of transit, by the points a transit holds times the transits seen."""
    x = fold.folded(lc)
    out = F.when(F.abs("dt") > F.col("duration") / 2, F.col("f"))
    x = x.withColumn("om", F.median(out).over(clean.star()))
    s = x.groupBy("tic_id").agg((F.median(F.when(F.abs("dt") > F.col("duration") / 2, F.abs(F.col("f") - F.col("om")))) * X.MAD_SCALE).alias("sigma"), F.count(F.lit(1)).alias("n"), F.max("duration").alias("duration"), F.max("period").alias("period"))
    j = s.join(fold.folded_depth(lc), "tic_id").join(fold.transit_counts(lc), "tic_id").join(clean.cadence(lc), "tic_id")
    j = j.withColumn("points", points_in_transits())
    return j.select("tic_id", "period", "duration", F.when((F.col("n") >= 5) & (F.col("sigma") > 0), X.ratio(F.col("depth"), F.col("sigma") / F.sqrt("points"))).alias("snr"))


def points_in_transits() -> Column:
    return F.greatest(X.ratio(F.col("duration"), F.col("cadence_us") / 86400000000.0) * F.col("n_even"), F.lit(1.0))


def multiple_event(depth: Column, cdpp_ppm: Column, n: Column) -> Column:
    return depth / (cdpp_ppm * 1e-6) * F.sqrt(F.greatest(n, F.lit(1)).cast("double"))


def relative_depth(lc: DataFrame) -> DataFrame:
    """depth: that of all transits over the star's median flux."""
    med = lc.groupBy("tic_id").agg(F.median("f").alias("med"))
    return fold.window_depths(lc).join(med, "tic_id").select("tic_id", X.ratio(F.col("all_depth"), F.col("med")).alias("depth"))


def sweet(lc: DataFrame) -> DataFrame:
    """Share of variance that a sine and cosine of the period take: a 3 by 3 least squares from nine sums."""
    w = F.lit(2 * math.pi) * F.col("time") / F.col("period")
    x = lc.select("tic_id", (F.col("f") - F.sum("f").over(clean.star()) / F.count(F.lit(1)).over(clean.star())).alias("y"), F.sin(w).alias("s"), F.cos(w).alias("c"))
    su = lambda e, n: F.sum(e).alias(n)
    c = F.col
    g = x.groupBy("tic_id").agg(F.count(F.lit(1)).alias("n"), su(c("s"), "S"), su(c("c"), "C"), su(c("s") * c("s"), "SS"), su(c("c") * c("c"), "CC"), su(c("s") * c("c"), "SC"), su(c("y") * c("s"), "YS"), su(c("y") * c("c"), "YC"), su(c("y") * c("y"), "YY"))
    return g.select("tic_id", explained_share().alias("sweet_metric"))


def explained_share() -> Column:
    """The share from the nine sums: they are centred, as the mean of y is zero, so the constant drops out."""
    c = F.col
    a, b, d = c("SS") - c("S") * c("S") / c("n"), c("CC") - c("C") * c("C") / c("n"), c("SC") - c("S") * c("C") / c("n")
    explained = X.ratio(c("YS") * c("YS") * b - 2 * c("YS") * c("YC") * d + c("YC") * c("YC") * a, a * b - d * d)
    return F.when((c("n") >= 8) & (c("YY") > 0), X.clip(explained / c("YY"), 0.0, 1.0))


def gathered(lc: DataFrame) -> DataFrame:
    """All sums, medians and counts that vetting asks of a star's points: one shuffle by star, one aggregation."""
    c = F.col
    x = fold.folded(lc).withColumns({"med": F.median("f").over(clean.star()), "out": F.median(F.when(F.abs("dt") > c("duration") / 2, c("f"))).over(clean.star()), "mean": F.sum("f").over(clean.star()) / F.count(F.lit(1)).over(clean.star()), "step": c("us") - F.lag("us").over(clean.by_time())})
    near, half = F.abs("dt"), c("duration") / 2
    w = F.lit(2 * math.pi) * c("time") / c("period")
    x = x.withColumns({"y": c("f") - c("mean"), "sn": F.sin(w), "cs": F.cos(w), "even_dt": F.abs(c("time") - c("t0") - c("cycle_even") * c("period"))})
    sums = {"S": c("sn"), "C": c("cs"), "SS": c("sn") * c("sn"), "CC": c("cs") * c("cs"), "SC": c("sn") * c("cs"), "YS": c("y") * c("sn"), "YC": c("y") * c("cs"), "YY": c("y") * c("y")}
    distinct = lambda which, cycle: F.size(F.collect_set(F.when(which <= half, c(cycle))))
    g = x.groupBy("tic_id").agg(
        *fold.depth_sums(), F.max("med").alias("med"), (F.median(F.abs(c("f") - c("med"))) * X.MAD_SCALE).alias("scale"), F.count(F.lit(1)).alias("n"), F.max("duration").alias("duration"), F.max("period").alias("period"),
        (F.median(F.when(near > half, F.abs(c("f") - c("out")))) * X.MAD_SCALE).alias("sigma"), F.median("step").alias("cadence_us"), distinct(near, "cycle").alias("n_floor"), distinct(c("even_dt"), "cycle_even").alias("n_even"),
        F.median(F.when((near > half) & (near <= half * 3), c("f"))).alias("fo"), F.median(F.when(near <= half * 0.8, c("f"))).alias("fi"), F.count(F.when(near <= half * 0.8, 1)).alias("ni"), F.count(F.when((near > half) & (near <= half * 3), 1)).alias("no"),
        *(F.sum(v).alias(k) for k, v in sums.items()),
    )
    deep = F.when((c("n") >= 10) & (c("ni") >= 1) & (c("no") >= 3), c("fo") - c("fi"))
    g = g.withColumns({"deep": deep, "points": points_in_transits()})
    snr = F.when((c("n") >= 5) & (c("sigma") > 0), X.ratio(c("deep"), c("sigma") / F.sqrt("points")))
    return g.select("tic_id", "med", "scale", "period", "duration", "all_in", "odd_in", "even_in", "n_floor", *fold.depths_of_sums(), snr.alias("snr"), explained_share().alias("sweet_metric"))


def metrics(lc: DataFrame, stars: DataFrame) -> DataFrame:
    """The metrics of a star under its ephemeris, depths relative to its median flux; one row each, none for points without a star."""
    lc = lc.filter("tic_id is not null")
    j = gathered(lc).join(fold.secondary_scan(lc).withColumnRenamed("n", "n_secondary"), "tic_id", "left").join(stars, "tic_id", "left")
    c = F.col
    rel = lambda n: X.ratio(c(n), c("med"))
    j = j.withColumns({"err": rel("scale"), "rel_depth": rel("all_depth"), "rel_odd": rel("odd_depth"), "rel_even": rel("even_depth"), "rel_second": rel("secondary_depth")})
    depth, err, second, apart = c("rel_depth"), c("err"), c("rel_second"), F.abs(c("rel_odd") - c("rel_even"))
    sigma = X.ratio(apart, err * F.sqrt(F.try_divide(F.lit(1.0), c("odd_in")) + F.try_divide(F.lit(1.0), c("even_in"))))
    radius = F.when(depth > 0, F.sqrt(depth) * c("radius") * X.RSUN_RJUP)
    k = F.when(depth > 0, F.sqrt(F.least(depth, F.lit(1.0))))
    j = j.withColumns({"second_snr": X.ratio(second, err / F.sqrt(c("n_secondary").cast("double"))), "density": X.density_of(c("period"), X.a_of_duration(c("period"), c("duration"), k, F.lit(0.3)))})
    ratio = X.ratio(c("density"), X.ratio(c("mass"), c("radius") * c("radius") * c("radius")) * X.RHO_SUN)
    # no point inside: no depth either, so what the noise would be there does not matter
    primary = X.ratio(F.abs(depth), F.try_divide(err, F.sqrt(c("all_in").cast("double"))))
    return j.select(
        "tic_id", "crowdsap", "radius", "mass", "tmag", rounded(depth).alias("depth"), rounded(c("rel_odd")).alias("odd_depth"), rounded(c("rel_even")).alias("even_depth"), rounded(sigma).alias("odd_even_depth_sigma"),
        rounded(F.try_divide(apart, F.abs(depth))).alias("odd_even_frac_diff"), rounded(second).alias("secondary_depth"), rounded(c("second_snr")).alias("secondary_snr"), rounded(c("secondary_phase")).alias("secondary_phase"),
        rounded(F.try_divide(second, F.when(depth > 0, depth))).alias("secondary_to_primary"), rounded(c("sweet_metric")).alias("sweet_metric"), c("n_floor").cast("double").alias("n_transits"), rounded(radius).alias("implied_rp_rjup"), rounded(ratio).alias("stellar_density_ratio"),
        rounded(c("snr")).alias("transit_snr"), rounded(F.try_divide(F.greatest(c("second_snr"), F.lit(0.0)), F.when(c("snr") > 0, c("snr")))).alias("uniqueness"),
        rounded(primary).alias("primary_significance"), rounded(err).alias("flux_mad"),
    )


def flags(m: DataFrame) -> DataFrame:
    """Eight booleans; a test without its numbers does not fire."""
    c = F.col
    ok = c("primary_significance").isNull() | (c("primary_significance") >= PRIMARY_OK)
    tests = {
        "eb_odd_even": (c("odd_even_depth_sigma") > SIGMA_ODD_EVEN) & (c("odd_even_frac_diff") > FRACTION_ODD_EVEN) & ok,
        "eb_secondary": (c("secondary_snr") > SNR_SECONDARY) & (c("secondary_to_primary") > RATIO_LOW) & (c("secondary_to_primary") < RATIO_HIGH) & ok,
        "eb_vshape": (c("v_shape_metric") > V_SHAPE) if "v_shape_metric" in m.columns else F.lit(False),
        "blend_contamination": c("crowdsap") < CROWDING,
        "other_variability": c("sweet_metric") > SWEET,
        "low_snr": c("transit_snr") < LOW_SNR,
        "implied_radius_too_big": c("implied_rp_rjup") > BIG_RADIUS,
        "density_inconsistent": (c("stellar_density_ratio") < DENSITY_LOW) | (c("stellar_density_ratio") > DENSITY_HIGH),
    }
    return m.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in tests.items()})
