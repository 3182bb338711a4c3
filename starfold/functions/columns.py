"""Column expressions for folded time, robust scale and transit geometry.

Times and periods are days, fluxes relative, depths positive for a dip.  Missing
numbers are null inside the engine.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAD_SCALE = 1.4826
#: Solar radius over Jupiter's and Earth's, gravity in SI units, seconds in a day, solar density in kg per cubic metre.
RSUN_RJUP, RSUN_REARTH = 9.731158773665, 109.0763707
GRAVITY, DAY, RHO_SUN = 6.674e-11, 86400.0, 1408.0


def finite(c: Column) -> Column:
    """Null where a number is NaN or infinite."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c)


def first_finite(columns: list[str], names: tuple[str, ...], prefixes: tuple[str, ...] = ("",)) -> Column:
    """The first finite number among prefix + name of the ``columns`` that exist: all names of a prefix before the next prefix; booleans count 1 or 0."""
    there = [f"{p}{n}" for p in prefixes for n in names if f"{p}{n}" in columns]
    return F.coalesce(*(finite(F.col(f"`{c}`").cast("double")) for c in there), F.lit(None).cast("double"))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def ratio(a: Column, b: Column) -> Column:
    """a / b of doubles as SQL's doubles have it: over zero an infinity, or NaN for zero itself, never an error.

    Both stand in the expression once, so that long chains of ratios stay short.
    """
    def one(x: Column) -> Column:
        over_zero = F.when(F.isnan(x["a"]) | (x["a"] == 0), float("nan")).when(x["a"] > 0, float("inf")).when(x["a"] < 0, float("-inf"))
        return F.when(x["b"] == 0, over_zero).otherwise(x["a"] / x["b"])

    return F.get(F.transform(F.array(F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))), one), F.lit(0))


def printed(c: Column, form: str) -> Column:
    """A double by one of printf's forms as C has it, which Java's differ from: rounded by its exact value; inf, -inf or nan."""
    @F.pandas_udf("string")
    def shown(v: pd.Series) -> pd.Series:
        return v.map(lambda x: form % x).astype(object)

    return F.when(c.isNotNull(), shown(c))


def turn(t: Column, period: Column, t0: Column) -> Column:
    return (t - t0) / period + 0.5


def phase(t: Column, period: Column, t0: Column) -> Column:
    """In [-0.5, 0.5), by floors, so times before t0 fold the same way."""
    x = turn(t, period, t0)
    return x - F.floor(x) - 0.5


def cycle(t: Column, period: Column, t0: Column) -> Column:
    """Number of the nearest transit; halves go up."""
    return F.floor(turn(t, period, t0)).cast("long")


def cycle_even(t: Column, period: Column, t0: Column) -> Column:
    """Number of the nearest transit; halves go to the even one."""
    return F.rint((t - t0) / period).cast("long")


def wrapped(a: Column, b: Column) -> Column:
    """Distance of two phases around the circle."""
    x = a - b + 0.5
    return F.abs(x - F.floor(x) - 0.5)


def logistic(x: Column, middle: float, scale: float) -> Column:
    z = (x - middle) / scale
    return F.when(z.isNull() | F.isnan(z), 0.5).otherwise(1 / (1 + F.exp(-z)))


def trapezoid(dt: Column, depth: Column, duration: Column, ingress: Column) -> Column:
    """Flux of a flat-bottomed dip; ``ingress`` is a share of the duration, clipped to [0, 0.5]."""
    half = duration / 2
    flat = half - clip(ingress, 0.0, 0.5) * duration
    x = F.abs(dt)
    return F.when(x <= flat, 1 - depth).when(x < half, 1 - depth * (half - x) / (half - flat)).otherwise(F.lit(1.0))


def occulted(z: Column, p: Column) -> Column:
    """Share of a uniform disc that a disc of radius p at separation z covers."""
    one = clip((z * z + p * p - 1) / F.greatest(2 * z * p, F.lit(1e-12)), -1.0, 1.0)
    two = clip((z * z + 1 - p * p) / F.greatest(2 * z, F.lit(1e-12)), -1.0, 1.0)
    root = F.sqrt(F.greatest((1 + p - z) * (z + p - 1) * (z + 1 - p) * (1 + p + z), F.lit(0.0)))
    return F.when(z >= 1 + p, 0.0).when(z <= F.abs(1 - p), F.least(p * p, F.lit(1.0))).otherwise((p * p * F.acos(one) + F.acos(two) - root / 2) / math.pi)


def transit_flux(ph: Column, k: Column, a: Column, inclination: Column, u1: Column, u2: Column) -> Column:
    """Quadratically limb-darkened dip at orbital phase ``ph`` (turns), near side only; inclination in degrees."""
    angle, tilt = ph * 2 * math.pi, F.cos(F.radians(inclination))
    z = a * F.sqrt(F.sin(angle) * F.sin(angle) + F.cos(angle) * tilt * F.cos(angle) * tilt)
    mu = F.sqrt(F.greatest(1 - F.least(z * z, F.lit(1.0)), F.lit(0.0)))
    light = (1 - u1 * (1 - mu) - u2 * (1 - mu) * (1 - mu)) / (1 - u1 / 3 - u2 / 6)
    return F.when(F.cos(angle) > 0, 1 - occulted(z, k) * light).otherwise(F.lit(1.0))


def duration_of(period: Column, a: Column, k: Column, b: Column, inclination: Column) -> Column:
    chord = F.sqrt(F.greatest((1 + k) * (1 + k) - b * b, F.lit(0.0)))
    return period / math.pi * F.asin(clip(chord / (a * F.sin(F.radians(inclination))), -1.0, 1.0))


def a_of_duration(period: Column, duration: Column, k: Column, b: Column) -> Column:
    return ratio(F.sqrt(F.greatest((1 + k) * (1 + k) - b * b, F.lit(0.0))), F.sin(F.lit(math.pi) * duration / period))


def impact_of(a: Column, inclination: Column) -> Column:
    return a * F.cos(F.radians(inclination))


def inclination_of(a: Column, b: Column) -> Column:
    return F.when(a <= 0, 90.0).otherwise(F.degrees(F.acos(clip(b / a, -1.0, 1.0))))


def density_of(period: Column, a: Column) -> Column:
    seconds = period * DAY
    return 3 * math.pi / (GRAVITY * seconds * seconds) * a * a * a


def a_of_density(period: Column, rho: Column) -> Column:
    seconds = period * DAY
    return F.cbrt(rho * GRAVITY * seconds * seconds / (3 * math.pi))


def limb_q(u1: Column, u2: Column) -> tuple[Column, Column]:
    total = u1 + u2
    return total * total, u1 / (2 * total)


def limb_u(q1: Column, q2: Column) -> tuple[Column, Column]:
    return 2 * F.sqrt(q1) * q2, F.sqrt(q1) * (1 - 2 * q2)
