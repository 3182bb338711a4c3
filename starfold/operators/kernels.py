"""Per-star numerics that are iterative, as small numpy functions on one curve's arrays.

Spark deals the stars out; a curve is bounded by its cadence and sector, so a
group fits a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from starfold.operators import gp

MAD_SCALE = 1.4826


def dealt(lc: DataFrame) -> DataFrame:
    """``lc`` by star over all cores: a curve takes long and holds few bytes, so partitions must not be joined by size."""
    spark = lc.sparkSession
    return lc.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), "tic_id")


def over_median(pdf: pd.DataFrame, scaled: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Flux, and its errors if there is a column err, over the median flux where that is positive."""
    f = pdf["f"].to_numpy(float)
    med = np.median(f) if scaled else 1.0
    med = med if med > 0 else 1.0
    return f / med, pdf["err"].to_numpy(float) / med if "err" in pdf else None


def per_star(lc: DataFrame, work: Callable[[np.ndarray, np.ndarray, dict], dict[str, object]], schema: str, columns: tuple[str, ...] = ("period", "t0", "duration"), scaled: bool = True) -> DataFrame:
    """One row or more per star from its time-ordered time and flux, over the median if ``scaled``; ``columns`` come as a dict.

    The dict also has tic_id, and the flux errors as ``errors``: None without a
    column err.  A curve that a kernel can't handle gives a row with its error,
    not a failed job.
    """
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time", kind="stable")
        f, errors = over_median(pdf, scaled)
        try:
            out = work(pdf["time"].to_numpy(float), f, {c: float(pdf[c].iloc[0]) for c in columns} | {"tic_id": int(pdf["tic_id"].iloc[0]), "errors": errors})
            frame = pd.DataFrame({k: np.atleast_1d(v) if not isinstance(v, list) else v for k, v in out.items()})
            frame["error"] = None
        except Exception as e:  # noqa: BLE001
            frame = pd.DataFrame({n: [None] for n in names} | {"error": [f"{type(e).__name__}: {e}"]}, dtype=object)
        frame["tic_id"] = pdf["tic_id"].iloc[0]
        return frame.reindex(columns=["tic_id", *names, "error"])

    return dealt(lc.select("tic_id", "time", "f", *(c for c in ("err",) if c in lc.columns), *columns)).groupBy("tic_id").applyInPandas(run, f"tic_id long, {schema}, error string")


#: Points of a bundle of stars at most, short ones filled up to the longest; a star with more is a bundle of its own.
BUNDLE = 1 << 12


def per_stars(lc: DataFrame, work: Callable[[list[tuple[np.ndarray, np.ndarray, dict]]], list[dict[str, object]]], schema: str, columns: tuple[str, ...] = ("period", "t0", "duration"), scaled: bool = True, most: int = 64) -> DataFrame:
    """``per_star`` for kernels that take up to ``most`` short curves in one call: ``work`` gets a list of them and gives a dict for each.

    Where a bundle fails, its stars are done one by one, so only those that
    can't be handled have an error.
    """
    names = [f.strip().split()[0] for f in schema.split(",")]
    rows = dealt(lc.select("tic_id", "time", "f", *(c for c in ("err",) if c in lc.columns), *columns))
    out_schema = f"tic_id long, {schema}, error string"
    kinds = to_arrow_schema(rows.sparkSession.createDataFrame([], out_schema).schema)

    def one(part: pa.Table) -> tuple[int | None, tuple]:
        pdf = part.drop_columns("tic_id").to_pandas().sort_values("time", kind="stable")
        f, errors = over_median(pdf, scaled)
        star = part["tic_id"][0].as_py()
        return star, (pdf["time"].to_numpy(float), f, {c: float(pdf[c].iloc[0]) for c in columns} | {"tic_id": star, "errors": errors})

    def told(bundle: list[tuple]) -> pa.RecordBatch:
        try:
            found = work([curve for _, curve in bundle])
        except Exception:  # noqa: BLE001
            found = []
            for _, curve in bundle:
                try:
                    found.append(work([curve])[0])
                except Exception as e:  # noqa: BLE001
                    found.append({"error": f"{type(e).__name__}: {e}"})
        held = {c.name: [] for c in kinds}
        for (star, _), out in zip(bundle, found, strict=True):
            n = max((len(v) for v in out.values() if isinstance(v, list | np.ndarray)), default=1)
            for c in held:
                v = star if c == "tic_id" else out.get(c)
                held[c].extend(v if isinstance(v, list | np.ndarray) else [v] * n)
        return pa.RecordBatch.from_arrays([pa.array(held[c.name], c.type, from_pandas=True) for c in kinds], schema=kinds)

    def curves(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        open_ = []
        for batch in batches:
            ids = pc.fill_null(batch["tic_id"], -(1 << 63)).to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(np.diff(ids)) + 1, [len(ids)])).tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(a, b - a)
                if open_ and part["tic_id"][0] != open_[0]["tic_id"][0]:
                    yield one(pa.Table.from_batches(open_))
                    open_ = []
                open_.append(part)
        if open_:
            yield one(pa.Table.from_batches(open_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, longest = [], 0
        for star, curve in curves(batches):
            size = max(longest, len(curve[0]))
            if bundle and (len(bundle) >= most or size * (len(bundle) + 1) > BUNDLE):
                yield told(bundle)
                bundle, size = [], len(curve[0])
            bundle.append((star, curve))
            longest = size
        if bundle:
            yield told(bundle)

    return rows.sortWithinPartitions("tic_id").mapInArrow(run, out_schema)


def filled(curves: list[np.ndarray], value: float) -> np.ndarray:
    """Arrays as rows of one, short ones filled up with ``value``."""
    out = np.full((len(curves), max(map(len, curves))), value)
    for row, c in zip(out, curves, strict=True):
        row[: len(c)] = c
    return out


def robust(x: np.ndarray) -> float:
    return MAD_SCALE * float(np.median(np.abs(x - np.median(x)))) if len(x) else float("nan")


def segments(t: np.ndarray, tolerance: float = 0.5) -> list[slice]:
    """Stretches between gaps."""
    at = np.flatnonzero(np.diff(t) > tolerance) + 1 if tolerance > 0 else np.zeros(0, int)
    edges = [0, *at.tolist(), len(t)]
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def middle(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Medians of rows of sorted values, of which the first ``size`` count."""
    rows = np.arange(len(v))
    return (v[rows, (size - 1) // 2] + v[rows, size // 2]) / 2


def biweights(v: np.ndarray, size: np.ndarray, tuning: float = 5.0, rounds: int = 3) -> np.ndarray:
    """Tukey's location of each row: from the median, points pulled in by how far they lie in deviations.

    The first ``size`` values of a row count, the others are infinite.  Rows of
    under three values, or without spread, stay at their median.
    """
    v = np.sort(v, axis=1)
    c = middle(v, size)
    live = size >= 3
    inside = np.isfinite(v)
    v = np.where(inside, v, 0.0)
    for _ in range(rounds):
        r = np.where(inside, v - c[:, None], np.inf)
        mad = middle(np.sort(np.abs(r), axis=1), size)
        live = live & (mad > 0)
        if not live.any():
            break
        r = np.where(inside, r, 0.0)
        u = r / (tuning * np.where(live, mad, 1.0))[:, None]
        w = np.where(inside & (np.abs(u) < 1), (1 - u * u) ** 2, 0.0)
        total = w.sum(axis=1)
        live = live & (total > 0)
        c = c + np.where(live, (w * r).sum(axis=1) / np.where(live, total, 1.0), 0.0)
    return c


def biweight_trend(t: np.ndarray, f: np.ndarray, window: float) -> np.ndarray:
    lo, hi = np.searchsorted(t, t - window / 2, "left"), np.searchsorted(t, t + window / 2, "right")
    size = hi - lo
    out = np.empty(len(t))
    step = max(1, (1 << 18) // int(size.max(initial=1)))
    for k in range(0, len(t), step):
        n = size[k : k + step]
        at = np.arange(n.max())
        out[k : k + step] = biweights(np.where(at < n[:, None], f[np.minimum(lo[k : k + step, None] + at, len(f) - 1)], np.inf), n)
    return out


def mirrored(f: np.ndarray, half: int) -> np.ndarray:
    return np.pad(f, min(half, len(f) - 1), mode="reflect") if len(f) > 1 else f


def median_trend(t: np.ndarray, f: np.ndarray, window: float) -> np.ndarray:
    n = points(t, window)
    if len(f) <= n // 2:
        return np.full(len(f), np.median(f))
    return np.median(np.lib.stride_tricks.sliding_window_view(mirrored(f, n // 2), n), axis=1)


def points(t: np.ndarray, window: float) -> int:
    """Points in a window, odd, three at least."""
    step = float(np.median(np.diff(t))) if len(t) > 1 else 1.0
    n = max(3, round(window / max(step, 1e-9)))
    return n + 1 - n % 2


def savgol(f: np.ndarray, width: int, order: int = 2) -> np.ndarray:
    """Sliding polynomials of equal steps; the ends follow the first and last polynomial."""
    width = min(width, len(f) - 1 + len(f) % 2)
    if width <= order:
        return np.full(len(f), f.mean())
    half = width // 2
    x = np.arange(-half, half + 1)
    basis = np.vander(x, order + 1, increasing=True)
    solve = np.linalg.pinv(basis)
    out = np.convolve(f, solve[0][::-1], "same")
    out[:half] = np.vander(x[:half], order + 1, increasing=True) @ (solve @ f[:width])
    out[-half:] = np.vander(x[-half:], order + 1, increasing=True) @ (solve @ f[-width:])
    return out


def savgol_trend(t: np.ndarray, f: np.ndarray, window: float, order: int = 2) -> np.ndarray:
    """Three rounds at most; outliers are replaced by the trend before the next."""
    g, width = f.copy(), points(t, window)
    width = width if width > order + 1 else order + 3 + order % 2  # odd, as points are
    for _ in range(3):
        trend = savgol(g, width, order)
        r = f - trend
        s = robust(r)
        bad = (r > 3 * s) | (r < -6 * s)
        if s == 0 or not bad.any():
            break
        g = np.where(bad, trend, f)
    return trend


def spline_basis(x: np.ndarray, knots: np.ndarray, degree: int = 3) -> np.ndarray:
    """B-splines by their recursion, over knots whose ends repeat."""
    k = np.concatenate(([knots[0]] * degree, knots, [knots[-1]] * degree))
    b = ((x[:, None] >= k[:-1]) & (x[:, None] < k[1:])).astype(float)
    last = np.flatnonzero(k[:-1] < k[1:])[-1]
    b[x == knots[-1], last] = 1.0
    for d in range(1, degree + 1):
        left, right = k[d:-1] - k[: -d - 1], k[d + 1 :] - k[1:-d]
        with np.errstate(divide="ignore", invalid="ignore"):
            a = np.where(left > 0, (x[:, None] - k[: -d - 1]) / left, 0.0)
            c = np.where(right > 0, (k[d + 1 :] - x[:, None]) / right, 0.0)
        b = a * b[:, :-1] + c * b[:, 1:]
    return b


def spline_trend(t: np.ndarray, f: np.ndarray, window: float) -> np.ndarray:
    """Least squares on a knot per window, five rounds of clipping at most."""
    if len(t) < 8:
        return np.full(len(t), np.median(f))
    basis = spline_basis(t, np.linspace(t[0], t[-1], max(2, int((t[-1] - t[0]) / window) + 1)))
    keep = np.ones(len(t), bool)
    for _ in range(5):
        trend = basis @ np.linalg.lstsq(basis[keep], f[keep], rcond=None)[0]
        r = f - trend
        s = robust(r[keep])
        now = (r <= 2 * s) & (r >= -6 * s)
        if s == 0 or now.sum() < basis.shape[1] + 1 or (now == keep).all():
            break
        keep = now
    return trend


def gp_trend(t: np.ndarray, f: np.ndarray, window: float, error: np.ndarray | None = None, scales: tuple[float, ...] = (1.0,)) -> np.ndarray:
    """The Gaussian process of ``gp``; stretches of under 8 points, and those it can't solve, take the biweight."""
    if len(t) >= 8:
        try:
            return gp.trend(t, f, window, error, robust(f), scales)
        except ArithmeticError:
            pass
    return biweight_trend(t, f, window)


TRENDS = {"biweight": biweight_trend, "median": median_trend, "savgol": savgol_trend, "spline": spline_trend, "gp": gp_trend}
#: A method whose library is absent takes its stand-in.
TRENDS |= {"wotan": biweight_trend}


def trended(t: np.ndarray, f: np.ndarray, method: str, window: float, tolerance: float, error: np.ndarray | None = None) -> np.ndarray:
    """The trend by segment; only the Gaussian process asks for errors."""
    if method == "gp":
        return np.concatenate([gp_trend(t[s], f[s], window, None if error is None else error[s]) for s in segments(t, tolerance)])
    return np.concatenate([TRENDS[method](t[s], f[s], window) for s in segments(t, tolerance)])


def detrend(t: np.ndarray, f: np.ndarray, method: str = "biweight", window: float = 0.9, tolerance: float = 0.5, upper: float = 3.0, lower: float = 20.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Time, flat flux and trend of the points that are left, see ``detrend_errors``."""
    return detrend_errors(t, f, None, method, window, tolerance, upper, lower)[:3]


def detrend_errors(
    t: np.ndarray, f: np.ndarray, error: np.ndarray | None, method: str = "biweight", window: float = 0.9, tolerance: float = 0.5, upper: float = 3.0, lower: float = 20.0
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Time, flat flux, trend and errors of the points that are left.

    Flux over its trend by segment, over its median, less outliers; single
    precision, as stored.  Errors are divided by what the flux is divided by.
    """
    if not len(t):
        return t, f, f, error
    trend = trended(t, f, method, window, tolerance, error)
    good = np.isfinite(trend) & (trend > 0)
    t, flat, trend, error = t[good], f[good] / trend[good], trend[good], None if error is None else error[good] / trend[good]
    if len(flat):
        middle = np.median(flat)
        flat, error = flat / middle, None if error is None else error / middle
        s = robust(flat - 1)
        keep = (flat - 1 <= upper * s) & (flat - 1 >= -lower * s) if len(flat) >= 3 and s > 0 else np.ones(len(flat), bool)
        t, flat, trend, error = t[keep], flat[keep], trend[keep], None if error is None else error[keep]
    return t, flat.astype(np.float32).astype(float), trend, error


def frequencies(baseline: float, low: float, high: float, width: float, oversample: float) -> np.ndarray:
    """Ascending periods, uniform in frequency; 16 at least."""
    df = oversample * width / baseline**2
    n = int(np.clip(np.ceil((1 / low - 1 / high) / df) + 1, 16, 2_000_000))
    return np.sort(1 / (1 / high + df * np.arange(n)))


#: The durations of a box, in days.
DURATIONS = np.array([0.04, 0.06, 0.08, 0.12, 0.16, 0.22, 0.30])


def fold_bins(dt: np.ndarray, base: float, periods: np.ndarray, bins: int) -> np.ndarray:
    """The phase bin of each time since the start under each period, a row each.

    Turns are fixed-point: what a product of 64 bits drops is whole turns.  Both
    factors are rounded up, so a point on an edge is in the bin behind it; a phase
    is off by some 1e-8 turns at most.
    """
    x = np.ceil(dt / max(base, 1e-9) * 2.0**38).astype(np.uint64)
    rate = np.ceil(base / periods * 2.0**26).astype(np.uint64)
    place = x[None, :] * rate[:, None]
    place += np.uint64(1 << 32)  # the next shift rounds down; the last 2**-32 of a turn is the start of the next
    place >>= np.uint64(32)
    place *= np.uint64(bins)
    place >>= np.uint64(32)
    return place


def fold_places(dt: np.ndarray, base: float, periods: np.ndarray, bins: int) -> np.ndarray:
    """``fold_bins`` row by row on from ``bins`` times the row."""
    place = fold_bins(dt, base, periods, bins)
    place += (np.arange(len(periods), dtype=np.uint64) * np.uint64(bins))[:, None]
    return place.view(np.int64)


def folded_sums(dt: np.ndarray, base: float, periods: np.ndarray, bins: int, weight: np.ndarray | None, centred: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights (or counts) and sums of ``centred`` by period and phase bin; a few periods at a time, so that places stay in the cache."""
    m, n = len(periods), len(dt)
    held, sums = np.empty((m, bins)), np.empty((m, bins))
    few = max(1, (1 << 16) // n)
    many, weights = np.tile(centred, few), None if weight is None else np.tile(weight, few)
    for x in range(0, m, few):
        place = fold_places(dt, base, periods[x : x + few], bins)
        k, flat = len(place), place.reshape(-1)
        held[x : x + k] = np.bincount(flat, None if weights is None else weights[: len(flat)], k * bins).reshape(k, bins)
        sums[x : x + k] = np.bincount(flat, many[: len(flat)], k * bins).reshape(k, bins)
    return held, sums


def point_weights(error: np.ndarray | None) -> np.ndarray | None:
    """Inverse squared errors, one on average; unusable errors count as the median of the usable, and without any there are no weights."""
    if error is None:
        return None
    good = np.isfinite(error) & (error > 0)
    if not good.any():
        return None
    weight = 1 / np.where(good, error, np.median(error[good])) ** 2
    return weight * (len(error) / weight.sum())


def usable_errors(f: np.ndarray, error: np.ndarray | None) -> np.ndarray:
    """Errors above 0, and the robust scatter, or else the plain one, in the place of the others."""
    scatter = robust(f) or float(f.std()) or 1e-3
    return np.full(len(f), scatter) if error is None else np.where(np.isfinite(error) & (error > 0), error, scatter)


#: Points at most of a curve whose boxes are screened: squares of counts are exact in single precision up to here.
SHORT = 2047


def evenly(periods: np.ndarray, durations: np.ndarray, bins: int, most: int) -> bool:
    """Whether widths change seldom: where one does, ``box_search_short`` evaluates both for all its ``most`` periods."""
    widths = np.rint(durations[:, None] / periods * bins)
    return np.count_nonzero(np.diff(widths, axis=1)) * most <= 2.5 * widths.size


def box_search_short(t: np.ndarray, f: np.ndarray, periods: np.ndarray, durations: np.ndarray, bins: int, step: int = 1440, most: int = 360) -> dict[str, np.ndarray]:
    """What ``box_search`` finds without errors, to the last digit, where boxes outnumber points.

    All boxes are evaluated in single precision; those within its error of their
    period's best are then told apart in double.  Bins are rows and ``step`` periods
    columns, so that a pass over the boxes of up to ``most`` of them is one over
    contiguous numbers that stay in the cache.  Periods too far apart to share
    widths are searched in double at once.
    """
    if not evenly(periods, durations, bins, most):
        return box_search_long(t, f, periods, durations, bins, None)
    n, start, base = len(t), t[0], float(t[-1] - t[0])
    centred = f - float(f.mean())
    total = float(np.abs(centred).sum())
    best = {k: np.zeros(len(periods)) for k in ("power", "duration", "t0", "depth")}
    if not total > 0:
        return best
    counts = np.arange(n + 1)
    scale = 1 / np.sqrt(np.maximum(counts * (n - counts), 1).astype(float)) * ((counts > 0) & (counts < n))
    # r (n - r) is (n / 2)**2 - (r - n / 2)**2, here with some 2**-11 of itself added, which keeps it off 0;
    # running sums are within [-1, 1] of the total: a box's sum is off by 2**-22 at most, by its root 64 times as much where r is 0 or n
    half, square = np.float32(n / 2), np.float32(n * n / 4 + n * 2.0**-11)
    share, slack = np.float32(1 - 2.0**-9), np.float32(2.0**-15 / np.sqrt(n - 1))
    few = max(1, (1 << 13) // n)
    many = np.tile(centred, few)
    kinds = len(durations)
    step, most = min(step, len(periods)), min(most, len(periods))
    raw, run = np.empty((bins, step)), np.zeros((2 * bins + 1, step))
    count, held = np.empty((bins, step), np.float32), np.zeros((2 * bins + 1, step), np.float32)
    runs, helds, raws, counted = list(run), list(held), [*raw, *raw], [*count, *count]
    rooms = np.empty((3, (2 * bins + 1) * most), np.float32)
    room, kept_rooms = np.empty(bins * most, np.float32), []
    for lo in range(0, len(periods), step):
        p = periods[lo : lo + step]
        m = len(p)
        widths = np.maximum(np.rint(durations[:, None] / p * bins), 1).astype(np.int64)
        use = (durations[:, None] / p < 0.5) & (widths < bins)
        use[1:] &= widths[1:] != widths[:-1]  # of equal widths the first duration wins
        if not use.any():
            continue
        ring = bins + int(widths[use].max())
        for x in range(0, m, few):
            place = fold_bins(t - start, base, p[x : x + few], bins).view(np.int64)
            k = len(place)
            place *= k
            place += np.arange(k)[:, None]
            flat = place.reshape(-1)
            count[:, x : x + k] = np.bincount(flat, minlength=k * bins).reshape(bins, k)
            raw[:, x : x + k] = np.bincount(flat, many[: len(flat)], k * bins).reshape(bins, k)
        for i in range(ring):
            np.add(runs[i], raws[i], runs[i + 1])
            np.add(helds[i], counted[i], helds[i + 1])
        near = []
        for x in range(0, m, most):
            y = min(x + most, m)
            own, used = widths[:, x:y], use[:, x:y]
            counts_, below, sums = (v[: (ring + 1) * (y - x)].reshape(ring + 1, y - x) for v in rooms)
            r = room[: bins * (y - x)].reshape(bins, y - x)
            np.copyto(counts_, held[: ring + 1, x:y])
            np.subtract(counts_, half, out=below)
            np.multiply(run[: ring + 1, x:y], 1 / total, out=sums, casting="same_kind")
            seen, reach = [], []
            for i, (low, high) in enumerate(zip(own.min(axis=1).tolist(), own.max(axis=1).tolist(), strict=True)):
                for k in range(low, high + 1):
                    ours = used[i] if low == high else used[i] & (own[i] == k)
                    if not ours.any():
                        continue
                    if len(seen) == len(kept_rooms):
                        kept_rooms.append(np.empty(bins * most, np.float32))
                    q = kept_rooms[len(seen)][: bins * (y - x)].reshape(bins, y - x)
                    np.subtract(below[k : k + bins], counts_[:bins], out=r)
                    np.multiply(r, r, out=r)
                    np.subtract(square, r, out=r)
                    np.sqrt(r, out=r)
                    np.subtract(sums[:bins], sums[k : k + bins], out=q)
                    np.divide(q, r, out=q)
                    rows, highest = bins, q
                    while rows % 2 == 0 and rows > 16:  # of each column, by halves
                        rows //= 2
                        highest = np.maximum(highest[:rows], highest[rows : 2 * rows], out=r[:rows])
                    highest = highest.max(axis=0)
                    seen.append((i, k, q))
                    reach.append(highest if low == high and ours.all() else np.where(ours, highest, np.float32(-1)))
            if not seen:
                continue
            reach = np.array(reach)
            limit = reach.max(axis=0) * share - slack
            for (i, k, q), good in zip(seen, reach >= limit, strict=True):
                at = np.flatnonzero(good)
                if len(at):
                    found = np.flatnonzero(np.take(q, at, axis=1) >= limit[at])
                    near.append((found, at, x, k, i))
        sizes = [len(v[0]) for v in near]
        j, column = (np.concatenate(v) for v in zip(*((found // len(at), at[found % len(at)] + x) for found, at, x, _, _ in near), strict=True))
        k, d = np.repeat([v[3] for v in near], sizes), np.repeat([v[4] for v in near], sizes)
        q = run[j + k, column] - run[j, column]
        r = (held[j + k, column] - held[j, column]).astype(np.int64)
        ratio = scale[r] * q
        group = column * kinds + d
        order = np.lexsort((ratio, group))  # of a width the deepest, and the earliest start wins ties
        first = order[np.flatnonzero(np.diff(group[order], prepend=-1))]
        found = np.where(q[first] < -1e-9 * total, ratio[first], 0.0) ** 2 * n
        order = np.lexsort((-found, column[first]))
        won = order[np.flatnonzero(np.diff(column[first[order]], prepend=-1))]
        won = won[found[won] > 0]
        box = first[won]
        at = lo + column[box]
        best["power"][at], best["duration"][at], best["depth"][at] = found[won], durations[d[box]], -q[box] / r[box]
        best["t0"][at] = start + ((j[box] + k[box] / 2) / bins % 1.0) * periods[at]
    return best


def box_search(t: np.ndarray, f: np.ndarray, periods: np.ndarray, durations: np.ndarray = DURATIONS, bins: int = 200, error: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """For each period the best box over a folded histogram: power, duration, mid-transit and depth.

    With errors points weigh by ``point_weights``, without they weigh alike.
    Periods go in blocks: one count for all their histograms, then each width's
    boxes as differences of running sums.  Short curves without errors find the
    same by ``box_search_short``.
    """
    weight = point_weights(error)
    if weight is None and 2 <= len(t) <= SHORT:
        return box_search_short(t, f, periods, durations, bins)
    return box_search_long(t, f, periods, durations, bins, weight)


def box_search_long(t: np.ndarray, f: np.ndarray, periods: np.ndarray, durations: np.ndarray, bins: int, weight: np.ndarray | None) -> dict[str, np.ndarray]:
    """``box_search`` in double throughout, of points with ``weight`` or alike."""
    n = len(t)
    start, base, mean = t[0], float(t[-1] - t[0]), float(f.mean() if weight is None else (weight * f).sum() / weight.sum())
    centred = f - mean if weight is None else weight * (f - mean)
    noise = 1e-9 * float(np.abs(centred).sum())
    best = {k: np.zeros(len(periods)) for k in ("power", "duration", "t0", "depth")}
    step = max(1, (1 << 18) // (4 * bins))
    room, other = np.empty((step, bins)), np.empty((step, bins))
    counts = np.arange(n + 1)
    scale = 1 / np.sqrt(np.maximum(counts * (n - counts), 1).astype(float)) * ((counts > 0) & (counts < n))
    for lo in range(0, len(periods), step):
        p = periods[lo : lo + step, None]
        m = len(p)
        w, s = folded_sums(t - start, base, p[:, 0], bins, weight, centred)
        w = w.astype(np.int64) if weight is None else w
        cw, cs = (np.concatenate((np.zeros((m, 1), x.dtype), np.cumsum(np.concatenate((x, x), axis=1), axis=1)), axis=1) for x in (w, s))
        top = np.zeros(m)
        before = np.zeros(m, np.int64)
        for d in durations:
            width = np.maximum(np.rint(d / p[:, 0] * bins), 1).astype(np.int64)
            use = (d / p[:, 0] < 0.5) & (width < bins) & (width != before)  # of equal widths the first duration wins
            before = width
            ends = np.append(np.flatnonzero((np.diff(width) != 0) | (np.diff(use.astype(np.int8)) != 0)) + 1, m)
            for x, y in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):  # neighbours mostly share a width
                if not use[x]:
                    continue
                k = int(width[x])
                # a dip's power is the square of its sum over the root of r (n - r): the least of these ratios is the deepest
                q = np.subtract(cs[x:y, k : k + bins], cs[x:y, :bins], out=room[: y - x])
                r = cw[x:y, k : k + bins] - cw[x:y, :bins]
                ratio = other[: y - x]
                if weight is None:
                    np.take(scale, r, out=ratio, mode="clip")
                    ratio *= q
                else:
                    np.divide(q, np.sqrt(np.maximum(r * (n - r), 1e-9)), out=ratio)
                j = np.argmin(ratio, axis=1)  # the earliest start wins ties
                rows = np.arange(y - x)
                deep = q[rows, j]
                found = np.where(deep < -noise, ratio[rows, j], 0.0) ** 2 * n
                better = np.flatnonzero(found > top[x:y])
                if len(better):
                    at, j = x + better, j[better]
                    top[at] = found[better]
                    best["power"][lo + at], best["duration"][lo + at] = found[better], d
                    best["depth"][lo + at] = -deep[better] / r[better, j]
                    best["t0"][lo + at] = start + ((j + k / 2) / bins % 1.0) * p[at, 0]
    return best


def sde(power: np.ndarray) -> float:
    p = power[np.isfinite(power)]
    return float((p.max() - np.median(p)) / p.std()) if len(p) and p.std() > 0 else float("nan")


def folded_depth(t: np.ndarray, f: np.ndarray, period: float, t0: float, duration: float) -> float:
    d = np.abs(((t - t0) / period + 0.5) % 1.0 - 0.5) * period
    inside, around = d <= 0.4 * duration, (d > 0.5 * duration) & (d <= 1.5 * duration)
    return float(np.median(f[around]) - np.median(f[inside])) if len(t) >= 10 and inside.any() and around.sum() >= 3 else float("nan")


def finalised(t: np.ndarray, f: np.ndarray, found: dict[str, object]) -> dict[str, object]:
    """``found`` with the depth measured again under its ephemeris, where it can be, and its signal to noise."""
    period, t0, duration, depth = (float(found[k]) for k in ("period", "t0", "duration", "depth"))
    exact = folded_depth(t, f, period, t0, duration) if duration > 0 else float("nan")
    depth = exact if np.isfinite(exact) and exact > 0 else depth
    d = np.abs(((t - t0) / period + 0.5) % 1.0 - 0.5) * period
    sigma, step = robust(f[d > duration / 2]), float(np.median(np.diff(t)))
    cycles = np.unique(np.rint((t[d <= duration / 2] - t0) / period))
    snr = depth / (sigma / np.sqrt(max(duration / step * len(cycles), 1.0))) if sigma > 0 else float("nan")
    return found | {"depth": depth, "snr": snr}


def best_box(grid: np.ndarray, found: dict[str, np.ndarray]) -> dict[str, object]:
    i = int(np.argmax(found["power"]))
    return {"period": float(grid[i]), **{k: float(found[k][i]) for k in ("t0", "duration", "depth", "power")}}


def two_stage(t: np.ndarray, f: np.ndarray, low: float = 0.5, high: float | None = None, coarse: float = 2.0, fine: float = 5.0, window: float = 0.05, error: np.ndarray | None = None) -> dict[str, object]:
    """A coarse search, then another within five hundredths of its period; efficiency is the coarse one's."""
    base = float(t[-1] - t[0])
    high = min(high or base / 2, base)
    grid = frequencies(base, low, max(high, low * 1.1), float(DURATIONS[0]), coarse)
    first = box_search(t, f, grid, error=error)
    triage = best_box(grid, first)
    near = frequencies(base, triage["period"] * (1 - window), triage["period"] * (1 + window), float(DURATIONS[0]), fine)
    second = best_box(near, box_search(t, f, near, error=error))
    return finalised(t, f, second if second["power"] > 0 else triage) | {"sde": sde(first["power"]), "n_periods": len(grid), "method": "bls+bls"}


def lomb_scargle(t: np.ndarray, f: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """Normalised power at each frequency, with the time shift that parts sine from cosine."""
    y = f - f.mean()
    out = np.empty(len(freq))
    step = max(1, (1 << 18) // max(len(t), 1))
    for k in range(0, len(freq), step):
        w = 2 * np.pi * freq[k : k + step, None]
        tau = np.arctan2(np.sin(2 * w * t).sum(axis=1), np.cos(2 * w * t).sum(axis=1))[:, None] / (2 * w)
        c, s = np.cos(w * (t - tau)), np.sin(w * (t - tau))
        with np.errstate(divide="ignore", invalid="ignore"):
            out[k : k + step] = 0.5 * ((c @ y) ** 2 / (c * c).sum(axis=1) + (s @ y) ** 2 / (s * s).sum(axis=1))
    variance = y.var()
    return out / variance if variance > 0 else out


METHODS = ("bls", "tls", "ls", "acf")


def search(t: np.ndarray, f: np.ndarray, method: str = "bls", low: float = 0.5, high: float | None = None, oversample: float = 3.0, durations: np.ndarray | None = None, error: np.ndarray | None = None, radius: float = 1.0, mass: float = 1.0) -> dict[str, object]:
    """The best detection by one method, with its spectrum as periods and power.

    Under ten points give a row of nulls.  ``tls`` takes the star's radius and
    mass, the sun's where they are not known; where it fails, the box search
    takes its place, and ``tls_fallback`` says so.
    """
    method = method.lower()
    if method not in METHODS:
        raise ValueError(f"unknown search method {method!r}; one of {', '.join(METHODS)}")
    none = float("nan")
    out: dict[str, object] = {"period": none, "t0": none, "duration": none, "depth": none, "sde": none, "snr": none, "method": method, "tls_fallback": None, "periods": [], "power": []}
    if len(t) < 10:
        return out
    base = float(t[-1] - t[0])
    high = high or base / 2
    if method == "acf":
        return out | acf_spectrum(t, f, low, high)
    if method == "ls":
        n = int(np.clip((1 / low - 1 / high) * base * max(oversample * 3, 5), 64, 200_000))
        freq = np.linspace(1 / high, 1 / low, n)
        power = lomb_scargle(t, f, freq)
        return out | {"period": float(1 / freq[int(np.argmax(power))]), "sde": sde(power), "periods": (1 / freq)[::-1].tolist(), "power": power[::-1].tolist()}
    if method == "tls":
        from starfold.operators import tls

        known = lambda v: float(v) if v is not None and np.isfinite(v) and v > 0 else 1.0
        try:
            found = tls.search(t, f, low, high, oversample, known(radius), known(mass), error)
            return out | finalised(t, f, found) | {"periods": found["periods"].tolist(), "power": found["power"].tolist()}
        except ArithmeticError:
            out |= {"method": "bls", "tls_fallback": "bls"}
    widths = DURATIONS if durations is None else np.atleast_1d(np.asarray(durations, float))
    widths = widths[widths < 0.5 * high]
    widths = widths if len(widths) else np.array([min(float(DURATIONS[0]), 0.1 * high)])
    grid = frequencies(base, low, high, float(widths.min()), oversample)
    found = box_search(t, f, grid, widths, error=error)
    best = finalised(t, f, best_box(grid, found))
    del best["power"]
    return out | best | {"sde": sde(found["power"]), "periods": grid.tolist(), "power": found["power"].tolist()}


def acf_spectrum(t: np.ndarray, f: np.ndarray, low: float = 0.5, high: float | None = None) -> dict[str, object]:
    """The highest peak of the autocorrelation on an even grid between the two periods, with all lags between them."""
    step = float(np.median(np.diff(t)))
    grid = np.arange(t[0], t[-1], step)
    y = np.interp(grid, t, f)
    y = y - y.mean()
    n = 1 << (2 * len(y) - 1).bit_length()
    a = np.fft.irfft(np.abs(np.fft.rfft(y, n)) ** 2, n)[: len(y)]
    a = a / a[0] if a[0] > 0 else a
    lag = np.arange(len(a)) * step
    inside = (lag >= low) & (lag <= (high or (t[-1] - t[0]) / 2))
    peak = np.zeros(len(a), bool)
    peak[1:-1] = (a[1:-1] > a[:-2]) & (a[1:-1] > a[2:])
    pool = np.flatnonzero(inside & peak) if (inside & peak).any() else np.flatnonzero(inside)
    i = int(pool[np.argmax(a[pool])])
    return {"period": float(lag[i]), "sde": sde(a[inside]), "peak": float(a[i]), "periods": lag[inside].tolist(), "power": a[inside].tolist()}


def acf_period(t: np.ndarray, f: np.ndarray, low: float = 0.5, high: float | None = None) -> dict[str, float]:
    found = acf_spectrum(t, f, low, high)
    return {"period": found["period"], "power": found["peak"]}


def cdpp(t: np.ndarray, f: np.ndarray, hours: float = 2.0) -> float:
    """Scatter of flattened flux in bins of consecutive points, in millionths."""
    n = max(1, round(hours / 24 / float(np.median(np.diff(t)))))
    flat = f / savgol(f, min(6 * n + 1, len(f) - 1 + len(f) % 2), 2)
    usable = len(flat) // n * n
    return robust(flat[:usable].reshape(-1, n).mean(axis=1)) * 1e6


def false_alarm(t: np.ndarray, f: np.ndarray, periods: np.ndarray, trials: int = 50, seed: int = 0) -> float:
    """Share of shuffled curves whose best box is as strong: (exceeding + 1) / (done + 1)."""
    rng = np.random.default_rng(seed)
    top = sde(box_search(t, f, periods)["power"])
    few, exceeding = max(1, (1 << 20) // len(t)), 0
    for a in range(0, trials, few):
        shuffled = np.array([rng.permutation(f) for _ in range(min(few, trials - a))])
        exceeding += int((sdes(box_powers(t, shuffled, periods)) >= top).sum())
    return (exceeding + 1) / (trials + 1)


def sdes(power: np.ndarray) -> np.ndarray:
    """``sde`` of each row."""
    if not np.isfinite(power).all():
        return np.array([sde(row) for row in power])
    spread = power.std(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(spread > 0, (power.max(axis=1) - np.median(power, axis=1)) / spread, np.nan)


def box_powers(t: np.ndarray, fluxes: np.ndarray, periods: np.ndarray, durations: np.ndarray = DURATIONS, bins: int = 200) -> np.ndarray:
    """The power of ``box_search`` at each period for each row of ``fluxes`` over the same times, to the last digit.

    Points fold once for all rows.  Running sums change at bins with points only,
    and a box holds other points than the one before only where a point leaves or
    enters: those bins are rows, those boxes are taken, and the curves are columns.
    """
    m, n = fluxes.shape
    block = max(1, (1 << 20) // max(n, 2 * bins))
    if len(periods) > block:
        return np.concatenate([box_powers(t, fluxes, periods[x : x + block], durations, bins) for x in range(0, len(periods), block)], axis=1)
    start, base = t[0], float(t[-1] - t[0])
    centred = fluxes - fluxes.mean(axis=1)[:, None]
    noise = 1e-9 * np.abs(centred).sum(axis=1)
    counts = np.arange(n + 1)
    scale = 1 / np.sqrt(np.maximum(counts * (n - counts), 1).astype(float)) * ((counts > 0) & (counts < n))
    limit = -noise * scale.max()
    many, every = len(periods), np.arange(bins)
    places = fold_places(t - start, base, periods, bins)
    ring = np.tile(np.bincount(places.reshape(-1), minlength=many * bins).reshape(many, bins), 2)
    held = ring > 0
    cw, row = np.zeros((2, many, 2 * bins + 1), np.int64)  # points, and the row of ``sums``, before each bin
    np.cumsum(ring, axis=1, out=cw[:, 1:])
    np.cumsum(held, axis=1, out=row[:, 1:])
    leaves = np.concatenate((np.ones((many, 1), bool), held[:, : bins - 1]), axis=1)
    at = np.arange(many)[:, None]
    before, boxes = np.zeros(many, np.int64), []
    for d in durations:
        width = np.maximum(np.rint(d / periods * bins), 1).astype(np.int64)
        use, before = (d / periods < 0.5) & (width < bins) & (width != before), width
        width = np.minimum(width, bins)
        x, j = np.nonzero((leaves | held[at, every + width[:, None] - 1]) & use[:, None])
        k = j + width[x]
        boxes.append((np.searchsorted(x, np.arange(many + 1)).tolist(), row[x, j], row[x, k], scale[cw[x, k] - cw[x, j]][:, None]))
    flat, columns, out = np.ascontiguousarray(centred.T).reshape(-1), np.arange(m), np.zeros((m, many))
    sums, heads, tails, low = np.zeros((2 * min(n, bins) + 1, m)), np.empty((bins, m)), np.empty((bins, m)), np.empty(m)
    runs, place = list(sums), np.take_along_axis(row, places - at * bins, axis=1)
    for x in range(many):
        size = int(row[x, bins])
        s = list(np.bincount((place[x, :, None] * m + columns).reshape(-1), flat, size * m).reshape(size, m))
        for i, v in enumerate(s + s):
            np.add(runs[i], v, out=runs[i + 1])
        least, own = np.zeros(m), [(head[c[x] : c[x + 1]], tail[c[x] : c[x + 1]], by[c[x] : c[x + 1]]) for c, head, tail, by in boxes if c[x] < c[x + 1]]
        for head, tail, by in own:
            q, other = tails[: len(head)], heads[: len(head)]
            np.take(sums, tail, axis=0, out=q, mode="clip")
            np.take(sums, head, axis=0, out=other, mode="clip")
            np.subtract(q, other, out=q)
            np.multiply(q, by, out=q)
            np.minimum(least, np.minimum.reduce(q, axis=0, out=low), out=least)
        unsure = np.flatnonzero(~(least < limit))
        if len(unsure):  # all others are dips beyond the noise
            least[unsure] = 0.0
            few = sums[:, unsure]
            for head, tail, by in own:
                q = few[tail] - few[head]
                deepest = np.argmin(by * q, axis=0)[None]
                deep, ratio = (np.take_along_axis(v, deepest, axis=0)[0] for v in (q, by * q))
                least[unsure] = np.minimum(least[unsure], np.where(deep < -noise[unsure], ratio, 0.0))
        out[:, x] = least**2 * n
    return out


def trapezoid(dt: np.ndarray, depth: float, duration: float, ingress: float) -> np.ndarray:
    """Parameters may be columns, one row each."""
    half = duration / 2
    flat = half - np.clip(ingress, 0.0, 0.5) * duration
    x = np.abs(dt)
    return np.where(x <= flat, 1 - depth, np.where(x < half, 1 - depth * (half - x) / np.maximum(half - flat, 1e-9), 1.0))


def least_squares(model: Callable[[np.ndarray, np.ndarray], np.ndarray], y: np.ndarray, live: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Damped steps inside a box for each row of ``y``, of which the points ``live`` count; parameters and their covariance over the noise variance.

    ``model`` takes row numbers and their parameters.  A row that is done rests while others go on.
    """
    x = np.clip(start, low, high).astype(float)
    m, dims = x.shape
    miss = lambda rows, at: np.where(live[rows], y[rows] - model(rows, at), 0.0)
    rows = np.arange(m)
    cost, damp = (miss(rows, x) ** 2).sum(axis=1), np.full(m, 1e-2)
    normal = np.zeros((m, dims, dims))
    for _ in range(rounds):
        at = x[rows]
        r = miss(rows, at)
        jac = np.empty((len(rows), dims, y.shape[1]))
        for k in range(dims):
            h = 1e-4 * np.maximum(high[rows, k] - low[rows, k], 1e-9)
            up, down = at.copy(), at.copy()
            up[:, k], down[:, k] = np.minimum(at[:, k] + h, high[rows, k]), np.maximum(at[:, k] - h, low[rows, k])
            jac[:, k] = np.where(live[rows], (model(rows, up) - model(rows, down)) / np.maximum(up[:, k] - down[:, k], 1e-15)[:, None], 0.0)
        a, g = jac @ jac.transpose(0, 2, 1), (jac @ r[:, :, None])
        normal[rows] = a
        own = np.einsum("ijj->ij", a)
        damped = a + np.eye(dims) * (damp[rows, None] * (own + 1e-12))[:, None, :]
        new = np.clip(at + (np.linalg.pinv(damped, rcond=dims * np.finfo(float).eps) @ g)[:, :, 0], low[rows], high[rows])
        now = (miss(rows, new) ** 2).sum(axis=1)
        better = now < cost[rows]
        done = better & (cost[rows] - now < 1e-10 * np.maximum(cost[rows], 1e-30))
        won = rows[better]
        x[won], cost[won], damp[won] = new[better], now[better], damp[won] / 3
        damp[rows[~better]] *= 4
        rows = rows[~(done | (~better & (damp[rows] > 1e8)))]
        if not len(rows):
            break
    return x, np.linalg.pinv(normal)


def fit_trapezoids(curves: list[tuple[np.ndarray, np.ndarray]], period: np.ndarray, t0: np.ndarray, duration: np.ndarray, depth: list[float | None]) -> list[dict[str, float]]:
    """``fit_trapezoid`` of several curves at once: each step of all of them is one pass over their points."""
    n = np.array([len(t) for t, _ in curves])
    live = np.arange(n.max()) < n[:, None]
    t, f = filled([t for t, _ in curves], 0.0), filled([f for _, f in curves], 1.0)
    seen = [d if d and d > 0 else folded_depth(*c, *at) for d, c, *at in zip(depth, curves, period, t0, duration, strict=True)]
    first = np.array([d if given and given > 0 else max(d, 1e-5) if np.isfinite(d) else 1e-5 for d, given in zip(seen, depth, strict=True)])
    rest, turn = t - t0[:, None], period[:, None]

    def model(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        near = (((rest[rows] - x[:, :1]) / turn[rows] + 0.5) % 1.0 - 0.5) * turn[rows]
        return trapezoid(near, x[:, 1:2], x[:, 2:3], x[:, 3:4])

    none = np.zeros(len(n))
    low, high = np.column_stack((-duration / 2, none, duration * 0.3, none + 0.01)), np.column_stack((duration / 2, np.minimum(5 * first, 1.0), np.minimum(duration * 2.5, period * 0.5), none + 0.5))
    x, cov = least_squares(model, f, live, np.column_stack((none, first, duration, none + 0.2)), low, high)
    fit, out = model(np.arange(len(n)), x), []
    for i, (_, own) in enumerate(curves):
        left = own - fit[i, : n[i]]
        sigma = robust(left) or 1e-9
        chi2, flat = float(((left / sigma) ** 2).sum()), float((((own - 1) / sigma) ** 2).sum())
        error = np.sqrt(np.maximum(np.diag(cov[i]), 0)) * sigma
        bic = 4 * np.log(max(n[i], 1)) + chi2
        out.append({"t0": t0[i] + x[i, 0], "depth": x[i, 1], "duration": x[i, 2], "ingress": x[i, 3], "t0_err": error[0], "depth_err": error[1], "duration_err": error[2], "bic_transit": bic, "bic_flat": flat, "delta_bic": flat - bic, "v_shape_metric": min(x[i, 3] / 0.5, 1.0), "trapezoid_chi2": chi2})
    return out


def fit_trapezoid(t: np.ndarray, f: np.ndarray, period: float, t0: float, duration: float, depth: float | None = None) -> dict[str, float]:
    """Depth, duration, mid-transit and ingress with errors; Bayes criteria of the dip and of a flat line."""
    return fit_trapezoids([(t, f)], *(np.array([v], float) for v in (period, t0, duration)), [depth])[0]


def occulted(z: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Share of a uniform disc that a disc of radius k hides at distance z."""
    z2, k2 = z * z, k * k
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.arccos(np.clip((z2 + k2 - 1) / np.maximum(2 * z * k, 1e-12), -1, 1))
        y = np.arccos(np.clip((z2 + 1 - k2) / np.maximum(2 * z, 1e-12), -1, 1))
        part = (k2 * x + y - 0.5 * np.sqrt(np.maximum((1 + k - z) * (z + k - 1) * (z + 1 - k) * (z + k + 1), 0))) / np.pi
    return np.where(z >= 1 + k, 0.0, np.where(z <= np.abs(1 - k), np.minimum(k2, 1.0), part))


def transit_flux(t: np.ndarray, period, t0, k, a, b, u1, u2, samples: int = 1, exposure: float = 0.0) -> np.ndarray:
    """Flux of a planet in front of a disc that darkens quadratically; parameters may be columns, one row each.

    With ``samples`` over 1 it is the mean over that many instants of an exposure.
    """
    if samples > 1 and exposure > 0:
        shifts = (np.arange(samples) + 0.5) / samples - 0.5
        return sum(transit_flux(t + x * exposure, period, t0, k, a, b, u1, u2) for x in shifts) / samples
    angle = 2 * np.pi * (((t - t0) / period + 0.5) % 1.0 - 0.5)
    tilt = np.clip(b / a, 0, 1)
    z = a * np.sqrt(np.sin(angle) ** 2 + (np.cos(angle) * tilt) ** 2)
    mu = 1 - np.sqrt(np.maximum(1 - np.minimum(z * z, 1.0), 0.0))
    dark = (1 - u1 * mu - u2 * mu * mu) / (1 - u1 / 3 - u2 / 6)
    return np.where(np.cos(angle) > 0, 1 - occulted(z, k) * dark, 1.0)


def transit_misfits(t: np.ndarray, f: np.ndarray, err: np.ndarray, level: np.ndarray, whole: np.ndarray, own: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Chi squared of each row of x (period, t0, k, a, b, u1, u2) over the curve ``own`` of the rows of t, f, err.

    ``level`` is ((f - 1) / err)², ``whole`` its sum by curve; points that fill a
    curve up have an infinite time.  Only points inside the transit are evaluated, all others lie on 1.
    """
    period, t0, k, a, b = (v[:, None] for v in x.T[:5])
    with np.errstate(divide="ignore", invalid="ignore"):
        turn = (t[own] if len(t) > 1 else t) - t0
        turn /= period
        turn -= np.rint(turn)
        np.abs(turn, out=turn)
        tilt = np.minimum(b, a)
        widest = np.sqrt(np.clip(((1 + k) ** 2 - tilt * tilt) / np.maximum(a * a - tilt * tilt, 1e-300), 0, 1))
        row, at = np.divmod(np.flatnonzero(turn <= np.minimum(np.arcsin(widest) / (2 * np.pi) + 1e-9, 0.25)), t.shape[1])
    p, place = x[row], own[row] * t.shape[1] + at
    time, flux, sigma, line = (v.reshape(-1)[place] for v in (t, f, err, level))
    gain = ((flux - transit_flux(time, p[:, 0], p[:, 1], p[:, 2], p[:, 3], p[:, 4], p[:, 5], p[:, 6])) / sigma) ** 2 - line
    return whole[own] + np.bincount(row, gain, len(x))


def transit_misfit(t: np.ndarray, f: np.ndarray, err: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``transit_misfits`` of one curve."""
    level = ((f - 1) / err) ** 2
    return transit_misfits(t[None], f[None], err[None], level[None], np.array([level.sum()]), np.zeros(len(x), int), x)


def a_of_duration(period: float, duration: float, k: float, b: float) -> float:
    s = np.sin(np.pi * duration / period)
    return float(np.sqrt(max((1 + k) ** 2 - b * b, 0.0)) / s) if s > 0 else float("nan")


def correlation_time(chain: np.ndarray, window: float = 5.0) -> np.ndarray:
    """Integrated autocorrelation time of each parameter of (steps, walkers, parameters), by a window that grows with it."""
    steps = len(chain)
    n = 1 << (2 * steps - 1).bit_length()
    y = chain - chain.mean(axis=0)
    a = np.fft.irfft(np.abs(np.fft.rfft(y, n, axis=0)) ** 2, n, axis=0)[:steps]
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.nanmean(a / a[0], axis=1)
    total = 2 * np.cumsum(a, axis=0) - 1
    out = np.empty(a.shape[1])
    for k in range(a.shape[1]):
        good = np.flatnonzero(np.arange(steps) >= window * total[:, k])
        out[k] = total[good[0] if len(good) else -1, k]
    return out


def sample(log_density: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, steps: int, seeds: list[int]) -> list[tuple[np.ndarray, float]]:
    """Affine-invariant stretch moves of two halves of walkers in turn, from ``start`` (curves, walkers, parameters).

    Returns for each curve the samples after three correlation times, thinned by
    half of the least one, and the share of moves taken.  ``log_density`` takes
    rows and the curve of each.  A curve has random numbers of its own, so it
    does not matter which are sampled together.
    """
    draws = [np.random.default_rng(seed) for seed in seeds]
    x = start.copy()
    m, walkers, dims = x.shape
    density = lambda rows: log_density(rows.reshape(-1, dims), np.repeat(np.arange(m), rows.shape[1])).reshape(m, -1)
    logp = density(x)
    chain, taken = np.empty((m, steps, walkers, dims)), np.zeros(m, int)
    halves = [slice(half, walkers, 2) for half in (0, 1)]
    many = [len(range(walkers)[half]) for half in halves]
    curve = np.arange(m)[:, None]
    for step in range(steps):
        if step % DRAWN == 0:
            lots = moves(draws, min(DRAWN, steps - step), many, dims)
        for half in (0, 1):
            mine, other = x[:, halves[half]], x[:, halves[1 - half]]
            stretch, mates, edge = (v[step % DRAWN] for v in lots[half])
            mate, old = other[curve, mates], logp[:, halves[half]]
            trial = mate + stretch[:, :, None] * (mine - mate)
            new = density(trial)
            with np.errstate(invalid="ignore"):  # a walker outside the priors stays until it moves inside
                take = (edge[0] < edge[1] + new - old) | (np.isfinite(new) & ~np.isfinite(old))
            np.copyto(mine, trial, where=take[:, :, None])
            np.copyto(old, new, where=take)
            taken += take.sum(axis=1)
        chain[:, step] = x
    return [(settled(c), n / (steps * walkers)) for c, n in zip(chain, taken.tolist(), strict=True)]


#: Steps whose random numbers are drawn at once.
DRAWN = 256


def moves(draws: list[np.random.Generator], steps: int, many: list[int], dims: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each half of the walkers and by step and curve: stretches, mates, and the logarithms that decide (of luck, of the stretch's volume).

    Generators are asked step by step, or for all bits at once where halves are
    alike and of a power of two: then a mate is the first bits of a half word, and
    the numbers are the same.
    """
    k = many[0]
    if many[1] == k and k > 1 and k & (k - 1) == 0:
        raw = np.stack([rng.bit_generator.random_raw(steps * 5 * k).reshape(steps, 2, -1) for rng in draws], axis=2)
        doubles = lambda v: (v >> np.uint64(11)) * 2.0**-53
        words = np.ascontiguousarray(raw[..., k : k + k // 2]).astype("<u8").view("<u4")
        lots = [(doubles(raw[:, h, :, :k]), (words[:, h] >> np.uint32(33 - k.bit_length())).astype(np.int64), doubles(raw[:, h, :, k + k // 2 :])) for h in (0, 1)]
    else:
        lots = [tuple(np.empty((steps, len(draws), n), kind) for kind in (float, int, float)) for n in many]
        for i, rng in enumerate(draws):
            for step in range(steps):
                for half, (z, mates, luck) in enumerate(lots):
                    rng.random(out=z[step, i])
                    mates[step, i] = rng.integers(0, many[1 - half], many[half])
                    rng.random(out=luck[step, i])
    out = []
    for z, mates, luck in lots:
        stretch = (1 + z) ** 2 / 2
        with np.errstate(divide="ignore"):
            out.append((stretch, mates, np.stack((np.log(luck), (dims - 1) * np.log(stretch)), axis=1)))
    return out


def settled(chain: np.ndarray) -> np.ndarray:
    """The rows of a chain after three correlation times, thinned by half of the least one."""
    steps, _, dims = chain.shape
    tau = correlation_time(chain)
    burn = int(np.clip(np.nanmax(tau) * 3 if np.isfinite(tau).all() else steps // 3, 1, max(1, steps - 2)))
    thin = max(1, int(np.nanmin(tau) * 0.5)) if np.isfinite(tau).all() else 1
    kept = chain[burn::thin].reshape(-1, dims)
    return kept if len(kept) >= 8 else chain[steps // 2 :].reshape(-1, dims)


#: Limb darkening that fits start from.
LIMB = (0.4, 0.3)
PARAMETERS = ("period", "t0", "depth", "duration", "rp_rs", "a_rs", "b", "inclination", "u1", "u2")
FIT = ", ".join(f"{p} double, {p}_err_lo double, {p}_err_hi double" for p in PARAMETERS) + ", bic_transit double, bic_flat double, delta_bic double, snr double, v_shape_metric double, trapezoid_chi2 double, acceptance double, n_samples long, fit_method string, warning string"


def triples(values: dict[str, tuple[float, float, float]]) -> dict[str, float]:
    return {name: v for p, x in values.items() for name, v in zip((p, f"{p}_err_lo", f"{p}_err_hi"), x, strict=True)}


def fit_snr(f: np.ndarray, error: np.ndarray, model: np.ndarray, depth: float) -> float:
    """Depth over the median error, by the points where the model dips by over a tenth of it."""
    inside = int((model < 1 - 0.1 * depth).sum())
    if not np.isfinite(depth) or depth <= 0 or not inside:
        return float("nan")
    sigma = float(np.nanmedian(error))
    return depth / (sigma if np.isfinite(sigma) and sigma > 0 else robust(f) or 1e-3) * float(np.sqrt(inside))


def seed_only(period: float, t0: float, duration: float, depth: float, snr: float, warning: str) -> dict[str, object]:
    """The detection itself as a fit, without errors."""
    none = float("nan")
    k = float(np.sqrt(depth)) if np.isfinite(depth) and depth > 0 else none
    known = {"period": period, "t0": t0, "depth": depth, "duration": duration, "rp_rs": k}
    return triples({p: (known.get(p, none), none, none) for p in PARAMETERS}) | {"bic_transit": none, "bic_flat": none, "delta_bic": none, "snr": snr, "v_shape_metric": none, "trapezoid_chi2": none, "acceptance": none, "n_samples": 0, "fit_method": "seed_only", "warning": warning}


#: How far the walkers start from the trapezoid, by parameter; the period's and the time's are shares of their own ranges.
STARTS = (0.002, 0.1, 0.01, 0.5, 0.05, 0.05, 0.05)


def posterior_samples(curves: list[tuple[np.ndarray, np.ndarray, np.ndarray]], fits: list[dict[str, float]], steps: int, walkers: int, seeds: list[int]) -> list[tuple[dict[str, np.ndarray], float]]:
    """For each curve (time, flux, error) samples of ``PARAMETERS`` under uniform priors around its trapezoid, and the share of moves taken.

    Fixed values: priors reach 2 % of the period to either side, two durations (half
    a per cent of the period at least) of mid-transit, a fifth to five times the
    radius ratio, and 0.3 to 3 times the distance.
    """
    period, t0, width, k, a, b = (np.array([fit[name] for fit in fits], float) for name in ("period", "t0", "duration", "rp_rs", "a_rs", "b"))
    near = np.where(width > 0, np.maximum(2 * width, 0.005 * period), 0.02 * period)
    k0, none = np.clip(k, 1e-3, 0.49), np.zeros(len(k))
    low = np.column_stack((0.98 * period, t0 - near, np.maximum(1e-3, 0.2 * k0), np.maximum(1.5, 0.3 * a), none, none, none))
    high = np.column_stack((1.02 * period, t0 + near, np.minimum(0.5, 5 * k0), np.minimum(50.0, 3 * a), none + 1, none + 1, none + 1))
    q1, q2 = sum(LIMB) ** 2, LIMB[0] / (2 * sum(LIMB))
    t, f, err = filled([c[0] for c in curves], np.inf), filled([c[1] for c in curves], 1.0), filled([c[2] for c in curves], 1.0)
    level = ((f - 1) / err) ** 2
    whole = np.array([level[i, : len(c[0])].sum() for i, c in enumerate(curves)])
    bound = [0, 1, 2, 3, 5, 6]
    least, most = low[:, bound], high[:, bound]

    def density(x: np.ndarray, own: np.ndarray) -> np.ndarray:
        inner = x[:, bound]
        good = ((inner > least[own]) & (inner < most[own])).all(axis=1) & (x[:, 4] >= 0) & (x[:, 4] < 1 + x[:, 2])
        logp = np.full(len(x), -np.inf)
        if good.any():
            y = x[good]
            root = np.sqrt(y[:, 5])
            logp[good] = -0.5 * transit_misfits(t, f, err, level, whole, own[good], np.column_stack((y[:, :5], 2 * root * y[:, 6], root * (1 - 2 * y[:, 6]))))
        return logp

    walkers = max(walkers, 14)
    start = np.array([
        np.clip(np.array([p, at, kk, aa, bb, q1, q2]) + np.array(STARTS) * [p, reach, 1, 1, 1, 1, 1] * np.random.default_rng(seed).normal(size=(walkers, 7)), lo + 1e-6, hi - 1e-6)
        for p, at, kk, aa, bb, reach, lo, hi, seed in zip(period, t0, k0, a, b, near, low, high, seeds, strict=True)
    ])
    return [(told(s), taken) for s, taken in sample(density, start, steps, seeds)]


def told(s: np.ndarray) -> dict[str, np.ndarray]:
    """Samples as ``PARAMETERS``."""
    inc = np.degrees(np.arccos(np.clip(s[:, 4] / s[:, 3], 0, 1)))
    with np.errstate(invalid="ignore", divide="ignore"):
        wide = s[:, 0] / np.pi * np.arcsin(np.clip(np.sqrt(np.maximum((1 + s[:, 2]) ** 2 - s[:, 4] ** 2, 0)) / (s[:, 3] * np.sin(np.radians(inc))), -1, 1))
    return {"period": s[:, 0], "t0": s[:, 1], "depth": s[:, 2] ** 2, "duration": wide, "rp_rs": s[:, 2], "a_rs": s[:, 3], "b": s[:, 4], "inclination": inc, "u1": 2 * np.sqrt(s[:, 5]) * s[:, 6], "u2": np.sqrt(s[:, 5]) * (1 - 2 * s[:, 6])}


def fit_transit(t: np.ndarray, f: np.ndarray, period: float, t0: float, duration: float, depth: float | None = None, snr: float = float("nan"), error: np.ndarray | None = None, posterior: bool = True, steps: int = 1500, walkers: int = 32, seed: int = 42) -> dict[str, object]:
    """Ten parameters with errors: a least-squares trapezoid, then, if ``posterior``, samples of the transit itself.

    The posterior is over period, mid-transit, radius ratio, scaled distance,
    impact and limb darkening (as q1, q2), under uniform priors around the
    trapezoid.  A detection without period, or under 8 points, comes back as it is.
    """
    return fit_transits([(t, f, {"period": period, "t0": t0, "duration": duration, "depth": depth, "snr": snr, "errors": error})], posterior, steps, walkers, [seed])[0]


def fit_transits(curves: list[tuple[np.ndarray, np.ndarray, dict]], posterior: bool = True, steps: int = 1500, walkers: int = 32, seeds: list[int] | None = None) -> list[dict[str, object]]:
    """``fit_transit`` of several curves at once; each has a dict of period, t0, duration, and depth, snr, errors where known."""
    none = float("nan")
    out, rows = [], []
    for i, (t, _, e) in enumerate(curves):
        why = "no period" if not (np.isfinite(e["period"]) and e["period"] > 0) else "under 8 points" if len(t) < 8 else None
        out.append(seed_only(e["period"], e["t0"], e["duration"], e.get("depth") or none, e.get("snr", none), why))
        if why is None:
            rows.append(i)
    if not rows:
        return out
    pairs = [curves[i][:2] for i in rows]
    start = [e["t0"] if np.isfinite(e["t0"]) else float(t[0]) for t, _, e in (curves[i] for i in rows)]
    traps = fit_trapezoids(pairs, np.array([curves[i][2]["period"] for i in rows], float), np.array(start, float), np.array([curves[i][2]["duration"] for i in rows], float), [curves[i][2].get("depth") for i in rows])
    errs = [usable_errors(f, curves[i][2].get("errors")) for i, (_, f) in zip(rows, pairs, strict=True)]
    fits = [_of_trapezoid(t, f, err, curves[i][2]["period"], trap) for i, (t, f), err, trap in zip(rows, pairs, errs, traps, strict=True)]
    if posterior:
        drawn = posterior_samples([(t, f, err) for (t, f), err in zip(pairs, errs, strict=True)], fits, steps, walkers, [seeds[i] for i in rows])
        fits = [_of_samples(t, f, err, fit, *d) for (t, f), err, fit, d in zip(pairs, errs, fits, drawn, strict=True)]
    for i, fit in zip(rows, fits, strict=True):
        fit["snr"] = fit["snr"] if np.isfinite(fit["snr"]) else curves[i][2].get("snr", none)
        out[i] = fit | {"delta_bic": fit["bic_flat"] - fit["bic_transit"]}
    return out


def _chi2(f: np.ndarray, model: np.ndarray | float, err: np.ndarray) -> float:
    return float((((f - model) / err) ** 2).sum())


def _of_trapezoid(t: np.ndarray, f: np.ndarray, err: np.ndarray, period: float, trap: dict[str, float]) -> dict[str, object]:
    none = float("nan")
    height, width, at = float(np.clip(trap["depth"], 1e-6, 0.95)), trap["duration"], trap["t0"]
    k, b = float(np.sqrt(height)), 0.3
    a = a_of_duration(period, width, k, b)
    a = float(np.clip(a, 1.5, 49.0)) if np.isfinite(a) and a > 1.5 else 10.0
    model = trapezoid((((t - at) / period + 0.5) % 1.0 - 0.5) * period, height, width, trap["ingress"])
    own = _chi2(f, model, err)
    values = {"period": (period, none, none), "t0": (at, trap["t0_err"], trap["t0_err"]), "depth": (height, trap["depth_err"], trap["depth_err"]), "duration": (width, trap["duration_err"], trap["duration_err"]), "rp_rs": (k, 0.5 * trap["depth_err"] / max(k, 1e-6), 0.5 * trap["depth_err"] / max(k, 1e-6)), "a_rs": (a, none, none), "b": (b, none, none), "inclination": (float(np.degrees(np.arccos(min(b / a, 1.0)))), none, none), "u1": (LIMB[0], none, none), "u2": (LIMB[1], none, none)}
    return triples(values) | {"bic_transit": 4 * np.log(max(len(f), 1)) + own, "bic_flat": _chi2(f, 1.0, err), "snr": fit_snr(f, err, model, height), "v_shape_metric": trap["v_shape_metric"], "trapezoid_chi2": own, "acceptance": none, "n_samples": 0, "fit_method": "trapezoid", "warning": None}


def _of_samples(t: np.ndarray, f: np.ndarray, err: np.ndarray, fit: dict[str, object], drawn: dict[str, np.ndarray], taken: float) -> dict[str, object]:
    """``fit`` with the posterior's numbers in place of the trapezoid's."""
    none, values = float("nan"), {}
    for p, v in drawn.items():
        lo, mid, hi = np.percentile(v[np.isfinite(v)], (16, 50, 84)) if np.isfinite(v).any() else (none, none, none)
        values[p] = (float(mid), float(mid - lo), float(hi - mid))
    model = transit_flux(t, *(values[p][0] for p in ("period", "t0", "rp_rs", "a_rs", "b", "u1", "u2")))
    return fit | triples(values) | {"bic_transit": 7 * np.log(max(len(f), 1)) + _chi2(f, model, err), "snr": fit_snr(f, err, model, values["depth"][0]), "acceptance": taken, "n_samples": len(drawn["period"]), "fit_method": "posterior"}


def drawn_rows(t: np.ndarray, f: np.ndarray, period: float, t0: float, duration: float, steps: int = 1500, walkers: int = 32, seed: int = 42) -> dict[str, list]:
    """The posterior's samples as rows of (parameter, value), from the least-squares trapezoid on."""
    return drawn_rows_of([(t, f, {"period": period, "t0": t0, "duration": duration})], steps, walkers, [seed])[0]


def drawn_rows_of(curves: list[tuple[np.ndarray, np.ndarray, dict]], steps: int, walkers: int, seeds: list[int]) -> list[dict[str, list]]:
    """``drawn_rows`` of several curves at once."""
    fast = fit_transits([(t, f, {c: e[c] for c in ("period", "t0", "duration")}) for t, f, e in curves], posterior=False)
    for fit in fast:
        if fit["fit_method"] == "seed_only":
            raise ValueError(fit["warning"])
    drawn = posterior_samples([(t, f, usable_errors(f, None)) for t, f, _ in curves], fast, steps, walkers, seeds)
    return [{"parameter": [p for p in PARAMETERS for _ in d[p]], "value": np.concatenate([d[p] for p in PARAMETERS]).tolist()} for d, _ in drawn]


def model_grid(fit: dict[str, float], points: int = 1000) -> dict[str, list[float]]:
    """The fitted transit over one period around its middle, for a panel."""
    if not (np.isfinite(fit["period"]) and fit["period"] > 0):
        return {"time": [], "flux": []}
    value = lambda n, default: fit[n] if fit.get(n) is not None and np.isfinite(fit[n]) else default
    x = fit["t0"] + np.linspace(-0.5, 0.5, points) * fit["period"]
    flux = transit_flux(x, fit["period"], fit["t0"], value("rp_rs", 0.1), value("a_rs", 10.0), value("b", 0.3), value("u1", LIMB[0]), value("u2", LIMB[1]))
    return {"time": x.tolist(), "flux": flux.tolist()}


def detrended(lc: DataFrame, method: str, window: float = 3.0) -> DataFrame:
    """tic_id, time, flux, trend: the points that detrending leaves, by star."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time", kind="stable")
        f = pdf["f"].to_numpy(float)
        t, flat, trend = detrend(pdf["time"].to_numpy(float), f / max(np.median(f), 1e-9), method, window, tolerance=2.0)
        return pd.DataFrame({"tic_id": pdf["tic_id"].iloc[0], "time": t, "flux": flat, "trend": trend})

    return dealt(lc.select("tic_id", "time", "f")).groupBy("tic_id").applyInPandas(run, "tic_id long, time double, flux double, trend double")
