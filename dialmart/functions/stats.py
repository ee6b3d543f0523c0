"""Statistics over groups: intervals, differences, correlation, trend, agreement and drift.

Sums are taken by Spark; only critical values, which depend on a few numbers a group, come from a
small vectorised function.  NaN and infinite values count as missing everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranges import running_totals
from ..sources import scratch


def finite(value: str | Column) -> Column:
    """The value as a double, null if it is not a finite number."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def z_crit(level: float) -> float:
    return NormalDist().inv_cdf(0.5 + level / 2)


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)


def t_quantile(df: float, level: float) -> float:
    """The two-sided critical value of Student's t.

    With t = sqrt(df) tan(a) the share within t is an integral of a power of the cosine from 0 to a, which a quadrature
    with 64 nodes gives to the last digits; Newton steps from the normal value find the angle.
    """
    if not df > 0:
        return math.nan
    if df > 1e6:
        return z_crit(level)
    scale = 2 * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    angle = math.atan(z_crit(level) / math.sqrt(df))
    for _ in range(100):
        inside = scale * angle / 2 * float(_WEIGHTS @ np.cos(angle / 2 * (_NODES + 1)) ** (df - 1))
        step = (level - inside) / (scale * math.cos(angle) ** (df - 1))
        # never past the right angle
        angle, last = min(max(angle + step, angle / 2), (angle + math.pi / 2) / 2), angle
        if abs(angle - last) <= 1e-15 * angle:
            break
    return math.sqrt(df) * math.tan(angle)


def t_crit(df: Column, level: float) -> Column:
    """t_quantile of a column; each batch works out its distinct values once."""

    @F.pandas_udf("double")
    def crit(values):
        known = {v: t_quantile(v, level) for v in values.dropna().unique()}
        return values.map(known)

    return crit(df.cast("double"))


def wilson(k: Column, n: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Ends of Wilson's interval of a share, 0 and 1 exactly at no and at all successes."""
    z = z_crit(level)
    return _wilson(k / n, n, F.lit(z), k == 0, k == n)


def wilson_z(p: Column, n: Column, z: float = 2.576) -> tuple[Column, Column]:
    """The same from a share and a given z, without the exact ends."""
    return _wilson(p, n, F.lit(z), F.lit(False), F.lit(False))


def _wilson(p: Column, n: Column, z: Column, none: Column, all_: Column) -> tuple[Column, Column]:
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    low = F.when(none, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), centre - half))
    high = F.when(all_, F.lit(1.0)).otherwise(F.least(F.lit(1.0), centre + half))
    return F.when(n > 0, low), F.when(n > 0, high)


def mean_ci(rows: DataFrame, keys: Sequence[str], value: str, level: float = 0.95) -> DataFrame:
    """keys, n, mean, sd, low and high; one value has no interval."""
    v = finite(value)
    m = rows.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
    half = t_crit(F.when(F.col("n") > 1, F.col("n") - 1), level) * F.col("sd") / F.sqrt("n")
    return m.withColumn("_half", half).select(
        *keys, "n", "mean", "sd", (F.col("mean") - F.col("_half")).alias("low"), (F.col("mean") + F.col("_half")).alias("high")
    )


def group_against_rest(rows: DataFrame, key: str, value: str, level: float = 0.99, least: int = 8, points: float = 3.0) -> DataFrame:
    """Each group's mean against all other rows: Welch's difference, its interval and a flag.

    The rest is the total less the group, by sums, so the rows are read once.  flag: few below
    `least` rows, none without a significant difference of `points`, else ok or bad.
    """
    v = finite(value)
    g = rows.where(v.isNotNull()).groupBy(key).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias("var")
    )
    g = scratch.written(g, "groups")  # a row a group, read three times
    mean_all = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    t = g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("_n"), mean_all.alias("_mean"))))  # one row, as the next
    spread = (F.col("n") - 1) * F.col("var") + F.col("n") * F.pow(F.col("mean") - F.col("_mean"), F.lit(2))
    t = t.crossJoin(F.broadcast(t.agg(F.sum(spread).alias("_ss"))))
    n2 = F.col("_n") - F.col("n")
    mean2 = (F.col("_n") * F.col("_mean") - F.col("n") * F.col("mean")) / n2
    ss2 = (
        F.col("_ss")
        - (F.col("n") - 1) * F.col("var")
        - F.col("n") * F.pow(F.col("mean") - F.col("_mean"), F.lit(2))
        - n2 * F.pow(mean2 - F.col("_mean"), F.lit(2))
    )
    t = t.select(
        key, "n", "mean", "var", n2.alias("rest_n"), mean2.alias("rest_mean"), (F.greatest(ss2, F.lit(0.0)) / (n2 - 1)).alias("rest_var")
    )
    t = welch(t, "n", "mean", "var", "rest_n", "rest_mean", "rest_var", level)
    clear = (F.col("low") > 0) | (F.col("high") < 0)
    flag = (
        F.when(F.col("n") < least, "few")
        .when(~F.coalesce(clear, F.lit(False)) | (F.abs("diff") < points), "none")
        .when(F.col("diff") > 0, "ok")
        .otherwise("bad")
    )
    return t.withColumn("flag", flag)


def welch(rows: DataFrame, n1: str, m1: str, v1: str, n2: str, m2: str, v2: str, level: float) -> DataFrame:
    """rows with diff, df, low and high of the difference of two means; equal ends if neither varies."""
    a, b = F.col(v1) / F.col(n1), F.col(v2) / F.col(n2)
    se2 = a + b
    df = F.when(se2 > 0, se2 * se2 / (a * a / (F.col(n1) - 1) + b * b / (F.col(n2) - 1)))
    df = F.when((F.col(n1) > 1) & (F.col(n2) > 1), df)
    out = rows.withColumn("diff", F.col(m1) - F.col(m2)).withColumn("df", df)
    half = F.when((se2 == 0) & (F.col(n1) > 1) & (F.col(n2) > 1), F.lit(0.0)).otherwise(t_crit(F.col("df"), level) * F.sqrt(se2))
    return out.withColumn("_half", half).withColumns(
        {"low": F.col("diff") - F.col("_half"), "high": F.col("diff") + F.col("_half")}
    ).drop("_half")


def period_changes(rows: DataFrame, period: str, value: str, level: float = 0.95, least: int = 8) -> DataFrame:
    """period, n, mean, change from the period before with its interval (Welch), and last; change is null below `least` values on either side.

    The window is over a row for each period.
    """
    v = finite(value)
    by = rows.where(v.isNotNull()).groupBy(period).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias("var"))
    line = Window.orderBy(period)
    by = by.withColumns({f"_{c}": F.lag(c).over(line) for c in ("n", "mean", "var")} | {"last": F.lead(period).over(line).isNull()})
    enough = (F.col("n") >= least) & (F.col("_n") >= least)
    found = welch(by, "n", "mean", "var", "_n", "_mean", "_var", level)
    return found.select(period, "n", "mean", *[F.when(enough, F.col(c)).alias(a) for c, a in (("diff", "change"), ("low", "low"), ("high", "high"))], "last")


def spearman(rows: DataFrame, keys: Sequence[str], x: str, y: str, level: float = 0.95) -> DataFrame:
    """keys, n, rho, low and high by ranks and Fisher's z with the Bonett-Wright error; n of 4 at least."""
    full = rows.where(finite(x).isNotNull() & finite(y).isNotNull())
    # the rows are read once: all that follows works on counts of equal pairs
    cells = scratch.written(full.groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_m")), "cells")

    def ranks(value: str, name: str) -> DataFrame:
        counts = cells.groupBy(*keys, value).agg(F.sum("_m").alias("_c"))
        placed = running_totals(counts, keys, [value], F.col("_c"))
        return placed.select(*[F.col(k).alias(f"{name}{i}") for i, k in enumerate(keys)], F.col(value).alias(f"{name}v"), (F.col("before") + (F.col("_c") + 1) / 2).alias(name))

    def same(name: str, value: str | None) -> Column:
        met = F.col(f"{name}v") == F.col(value) if value else F.lit(True)
        for i, k in enumerate(keys):
            met = met & F.col(f"{name}{i}").eqNullSafe(F.col(k))
        return met

    totals = cells.groupBy(*keys).agg(F.sum("_m").alias("_all")).select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)], "_all")
    ranked = cells.join(ranks("_x", "_rx"), same("_rx", "_x")).join(ranks("_y", "_ry"), same("_ry", "_y"))
    ranked = ranked.join(totals, same("_t", None)) if keys else ranked.crossJoin(F.broadcast(totals))  # one row
    # deviations from the middle rank, which is known, so that no large squares are taken from each other
    dx, dy = (F.col(c) - (F.col("_all") + 1) / 2 for c in ("_rx", "_ry"))
    total = lambda v: F.sum(F.col("_m") * v)
    c = ranked.groupBy(*keys).agg(F.sum("_m").alias("n"), total(dx * dx).alias("_xx"), total(dy * dy).alias("_yy"), total(dx * dy).alias("_xy"))
    c = c.withColumn("rho", F.when((F.col("_xx") > 0) & (F.col("_yy") > 0), F.col("_xy") / F.sqrt(F.col("_xx") * F.col("_yy"))))
    rho = F.when(F.col("n") >= 4, F.col("rho"))
    se = F.sqrt((1 + rho * rho / 2) / (F.col("n") - 3))
    z = z_crit(level)
    inside = F.abs(rho) < 1
    return c.select(
        *keys,
        "n",
        rho.alias("rho"),
        F.when(inside, F.tanh(F.atanh(rho) - z * se)).otherwise(rho).alias("low"),
        F.when(inside, F.tanh(F.atanh(rho) + z * se)).otherwise(rho).alias("high"),
    )


def linear_trend(rows: DataFrame, keys: Sequence[str], day: str, value: str, level: float = 0.95, per: float = 30.0) -> DataFrame:
    """keys, n, slope per `per` days, low and high of the least-squares line; n of 3 at least."""
    full = rows.where(finite(value).isNotNull() & finite(day).isNotNull())
    s = full.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.regr_sxx(value, day).alias("sxx"),
        F.regr_syy(value, day).alias("syy"),
        F.regr_sxy(value, day).alias("sxy"),
    ).where("n >= 3 and sxx > 0")
    left = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    s = s.withColumn("slope", F.col("sxy") / F.col("sxx")).withColumn("_se", F.sqrt(left / (F.col("n") - 2) / F.col("sxx")))
    s = s.withColumn("_half", t_crit(F.col("n") - 2, level) * F.col("_se"))
    return s.select(
        *keys,
        "n",
        (F.col("slope") * per).alias("slope"),
        ((F.col("slope") - F.col("_half")) * per).alias("low"),
        ((F.col("slope") + F.col("_half")) * per).alias("high"),
    )


def histogram_bin(value: str, edges: Sequence[float]) -> Column:
    """The bin from 0 of a value; the last is closed above, and values outside have none."""
    v, out = finite(value), F.lit(None).cast("int")
    for i, (lo, hi) in reversed(list(enumerate(zip(edges, edges[1:], strict=False)))):
        top = v <= hi if i == len(edges) - 2 else v < hi
        out = F.when((v >= lo) & top, F.lit(i)).otherwise(out)
    return out


def clamped_bin(value: str, lo: float, hi: float, bins: int) -> Column:
    """The bin from 0 of a value, with those outside in the first and the last."""
    at = F.floor((finite(value) - lo) / ((hi - lo) / bins))
    return F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).cast("int")


def psi(base: DataFrame, now: DataFrame, keys: Sequence[str], bin_: str, count: str, floor: float = 1e-4) -> DataFrame:
    """keys and the population stability index of two tables of counts by bin."""
    w = Window.partitionBy(*keys)
    both = base.select(*keys, bin_, F.col(count).alias("_a")).join(now.select(*keys, bin_, F.col(count).alias("_b")), [*keys, bin_], "full")
    share = lambda c: F.greatest(F.coalesce(c, F.lit(0)) / F.sum(F.coalesce(c, F.lit(0))).over(w), F.lit(floor))
    p = both.select(*keys, share(F.col("_a")).alias("_p"), share(F.col("_b")).alias("_q"))
    return p.groupBy(*keys).agg(F.sum((F.col("_q") - F.col("_p")) * F.log(F.col("_q") / F.col("_p"))).alias("psi"))


def control_limits(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, centre, low and high: median and 3 scaled median deviations.

    Where these are zero though the values differ, the population's standard deviation stands in.
    """
    v = finite(value)
    m = rows.groupBy(*keys).agg(F.median(v).alias("centre"), F.stddev_pop(v).alias("_sd"), F.countDistinct(v).alias("_k"))
    away = rows.join(m, list(keys)) if keys else rows.crossJoin(F.broadcast(m))  # one row
    d = away.groupBy(*keys, "centre", "_sd", "_k").agg(F.median(F.abs(v - F.col("centre"))).alias("_mad"))
    width = F.when((F.col("_mad") == 0) & (F.col("_k") > 1), F.col("_sd")).otherwise(1.4826 * F.col("_mad")) * 3
    return d.select(*keys, "centre", (F.col("centre") - width).alias("low"), (F.col("centre") + width).alias("high"))


def weighted_kappa(pairs: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """keys, n and the quadratic-weighted kappa of two ratings; null below two pairs or if a side is constant.

    The expected disagreement needs only means and variances of both sides.
    """
    full = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    s = full.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(F.pow(F.col(a) - F.col(b), F.lit(2))).alias("_o"),
        F.var_pop(a).alias("_va"),
        F.var_pop(b).alias("_vb"),
        F.avg(a).alias("_ma"),
        F.avg(b).alias("_mb"),
    )
    expected = F.col("_va") + F.col("_vb") + F.pow(F.col("_ma") - F.col("_mb"), F.lit(2))
    ok = (F.col("n") >= 2) & (F.col("_va") > 0) & (F.col("_vb") > 0)
    return s.select(*keys, "n", F.when(ok, 1 - F.col("_o") / expected).alias("kappa"))


def cohen_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, accuracy and kappa of two labellings, from the table of counts."""
    c = pairs.groupBy(a, b).agg(F.count("*").alias("c"))
    n, hit = F.sum("c"), F.sum(F.when(F.col(a) == F.col(b), F.col("c")).otherwise(0))
    total = c.agg(n.alias("n"), (hit / n).alias("accuracy"))
    rows = c.groupBy(F.col(a).alias("label")).agg(F.sum("c").alias("ra"))
    cols = c.groupBy(F.col(b).alias("label")).agg(F.sum("c").alias("rb"))
    chance = rows.join(cols, "label").agg(F.coalesce(F.sum(F.col("ra").cast("double") * F.col("rb")), F.lit(0.0)).alias("both"))
    e = F.col("both") / (F.col("n") * F.col("n"))
    return total.crossJoin(chance).select("n", "accuracy", F.when(e < 1, (F.col("accuracy") - e) / (1 - e)).alias("kappa"))


def macro_f1(pairs: DataFrame, truth: str, given: str) -> DataFrame:
    """The mean F1 of the labels that occur on either side."""
    c = pairs.groupBy(truth, given).agg(F.count("*").alias("c"))
    hit = F.when(F.col(truth) == F.col(given), F.col("c")).otherwise(0)
    by_truth = c.groupBy(F.col(truth).alias("label")).agg(F.sum(hit).alias("tp"), F.sum("c").alias("t"))
    by_given = c.groupBy(F.col(given).alias("label")).agg(F.sum("c").alias("g"))
    f1 = 2 * F.coalesce("tp", F.lit(0)) / (F.coalesce("t", F.lit(0)) + F.coalesce("g", F.lit(0)))
    return by_truth.join(by_given, "label", "full").agg(F.avg(f1).alias("macro_f1"))


#: A prime just below 2^31: draws are of whole numbers below it, so that any engine can make them.
DRAWS = 2_147_483_647


def poisson_steps(most: int = 12) -> list[float]:
    """The probabilities that a Poisson number of mean one is at most 0, 1, ..."""
    steps, p, total = [], math.exp(-1.0), 0.0
    for i in range(most):
        total += p
        steps.append(total)
        p /= i + 1
    return steps


def resampled_sums(clusters: DataFrame, key: str, values: Sequence[str], reps: int, seed: int = 7) -> DataFrame:
    """rep (from 1) and the sum of each of the values in that repetition of a bootstrap by clusters.

    Every cluster counts a Poisson number of times in each repetition, drawn from a hash of its key, so a resample needs
    neither all clusters in one place nor an order.  A task adds up all repetitions of its clusters as arrays and passes one row on.
    key tells the clusters apart, so that equal ones draw on their own.
    """
    steps = np.array(poisson_steps())
    rep = np.arange(1, reps + 1, dtype=np.int64)

    def run(batches):
        total = np.zeros((len(values), reps))
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]])
            for at in range(0, len(own), 1024):
                x = (own[at : at + 1024, None] * 48271 + rep * 69621 + seed) % DRAWS
                x = (x * x + 16807 * rep) % DRAWS
                x = (x * 48271 + own[at : at + 1024, None]) % DRAWS
                times = (x[:, :, None] / DRAWS > steps).sum(2)
                total += rows[:, at : at + 1024] @ times
        yield pa.RecordBatch.from_arrays([pa.array([t.tolist()], pa.list_(pa.float64())) for t in total], [f"s{i}" for i in range(len(values))])

    number = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 7), 16, 10).cast("long")
    parts = clusters.select(number.alias("_key"), *[F.col(v).cast("double") for v in values])
    sums = parts.mapInArrow(run, ", ".join(f"s{i} array<double>" for i in range(len(values))))
    each = sums.select(F.posexplode(F.arrays_zip(*sums.columns)).alias("pos", "s"))
    return each.groupBy((F.col("pos") + 1).alias("rep")).agg(*[F.sum(f"s.s{i}").alias(v) for i, v in enumerate(values)])


def cluster_share(clusters: DataFrame, key: str, k: str, n: str, reps: int = 2000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """share, clusters, low and high of a share whose cases come in clusters; fewer than five clusters have no interval."""
    sums = resampled_sums(clusters, key, [k, n], reps, seed)
    ends = F.percentile(F.col(k) / F.col(n), F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    shares = sums.where(F.col(n) > 0).agg(ends.alias("ends"))
    point = clusters.agg((F.sum(k) / F.sum(n)).alias("share"), F.count("*").alias("clusters"))
    ok = F.col("clusters") >= 5
    return point.crossJoin(F.broadcast(shares)).select(  # one row each
        "share", "clusters", F.when(ok, F.col("ends")[0]).alias("low"), F.when(ok, F.col("ends")[1]).alias("high")
    )


def mcnemar(b: Column, c: Column) -> Column:
    """The exact two-sided p of b against c discordant pairs."""

    @F.pandas_udf("double")
    def exact(x, y):
        def p(i, j):
            n, k = int(i + j), int(min(i, j))
            if n <= 200:  # whole numbers, as only few pairs have figures that end at a rounding's edge
                return min(1.0, 2 * sum(math.comb(n, m) for m in range(k + 1)) / 2**n)
            term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2))
            tail = 0.0
            # terms fall from k down, so once one is too small to change the sum all others are
            while k >= 0 and tail + term != tail:
                tail += term
                term *= k / (n - k + 1)
                k -= 1
            return min(1.0, 2 * tail)

        return x.combine(y, p)

    return exact(b, c)


def word_error(reference: Column, given: Column) -> Column:
    """Edits between two texts in words, by the length of the first in words.

    Each distinct word becomes one character of a private plane, so the built-in edit distance
    counts words.
    """
    words = lambda t: F.filter(F.split(F.lower(F.trim(t)), r"\s+"), lambda w: w != "")
    a, b = words(reference), words(given)
    known = F.array_distinct(F.concat(a, b))
    sign = lambda w: F.decode(F.unhex(F.hex(F.array_position(known, w) + 0x4E00)), "UTF-16BE")
    signs = lambda t: F.array_join(F.transform(t, sign), "")
    return F.levenshtein(signs(a), signs(b)) / F.greatest(F.size(a), F.lit(1))


def char_error(reference: Column, given: Column) -> Column:
    """Edits between two texts without white space, by the length of the first."""
    bare = lambda t: F.regexp_replace(F.lower(t), r"\s+", "")
    return F.levenshtein(bare(reference), bare(given)) / F.greatest(F.length(bare(reference)), F.lit(1))


def drift_verdict(n: Column, value: Column, low: Column, high: Column, least: int = 5) -> Column:
    """skip below `least` samples, flag outside the limits, else ok."""
    eps = 1e-9
    return F.when(n < least, "skip").when((value < low - eps) | (value > high + eps), "flag").otherwise("ok")


def half_up(value: Column) -> Column:
    """The nearest whole number, halves up."""
    return F.floor(value + 0.5).cast("int")


def calibration(pairs: DataFrame, dim: str, system: str, human: str, least: int = 20, worst: float = 0.4, mae: float = 1.0) -> DataFrame:
    """dim, n, mean absolute error, kappa and flagged, of system scores against human ones.

    A kappa that is not defined is flagged too where there are errors and pairs enough.
    """
    k = weighted_kappa(pairs, [dim], system, human).select(F.col(dim).alias("_d"), "kappa")
    e = pairs.where(F.col(system).isNotNull() & F.col(human).isNotNull()).groupBy(dim).agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col(system) - F.col(human))).alias("mae")
    )
    joined = e.join(k, F.col(dim).eqNullSafe(F.col("_d")), "left")
    low = F.when(F.col("kappa").isNull(), (F.col("mae") > 0) & (F.col("n") >= least)).otherwise(F.col("kappa") < worst)
    return joined.select(dim, "n", "mae", "kappa", (low | (F.col("mae") > mae)).alias("flagged"))


def span_scores(gold: DataFrame, found: DataFrame, keys: Sequence[str], lo: str, hi: str) -> DataFrame:
    """precision, recall and f1 of found spans against gold ones; a span counts if it overlaps one of the other side."""
    def hit(a: DataFrame, b: DataFrame) -> DataFrame:
        other = b.select(*keys, F.col(lo).alias("_lo"), F.col(hi).alias("_hi"))
        cond = [a[k] == other[k] for k in keys] + [a[lo] < other["_hi"], other["_lo"] < a[hi]]
        met = cond[0]
        for c in cond[1:]:
            met = met & c
        return a.join(other, met, "left_semi").agg(F.count("*").alias("h"))

    p = hit(found, gold).select(F.col("h").alias("hp")).crossJoin(found.agg(F.count("*").alias("np")))
    r = hit(gold, found).select(F.col("h").alias("hr")).crossJoin(gold.agg(F.count("*").alias("nr")))
    both = p.crossJoin(r)  # one row each
    precision, recall = F.col("hp") / F.col("np"), F.col("hr") / F.col("nr")
    return both.select(
        precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / (precision + recall)).alias("f1")
    )


def regression_gates(now: DataFrame, base: DataFrame, key: str, value: str, tolerance: float = 0.02) -> DataFrame:
    """key, both values and worse: below the baseline by more than the tolerance, or missing now."""
    b = base.select(key, F.col(value).alias("baseline"))
    joined = b.join(now.select(key, F.col(value).alias("now")), key, "left")
    return joined.withColumn("worse", F.col("now").isNull() | (F.col("now") < F.col("baseline") - tolerance))
