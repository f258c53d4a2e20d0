"""Receiver calibration from probe-to-probe distances, and the leave-one-out self-test."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEFAULTS, Settings
from ..functions import scalars as f
from ..sources.files import WorkTables
from .solver import solve
from .zones import small


# Samples.
def rolling_window(samples: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` samples of each directed pair (tx, rx), by seq."""
    newest = F.row_number().over(Window.partitionBy("tx", "rx").orderBy(F.desc("seq")))
    return samples.withColumn("__n", newest).filter(F.col("__n") <= keep).drop("__n")


def restore(samples: DataFrame, now: Column, s: Settings = DEFAULTS) -> DataFrame:
    """Persisted samples (with saved_at) that are young enough and numeric."""
    return samples.filter((now - F.col("saved_at") <= s.state_max_age_s) & F.col("distance_m").isNotNull() & ~F.isnan("distance_m"))


def ingest_dump(adverts: DataFrame, matches: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Samples of scanner dumps: adverts (dump, address, scanner_address, stamp, distance), matches (address, slug).

    Fresh against the newest stamp of the same dump, positive, both ends matched and different.
    """
    newest = F.max("stamp").over(Window.partitionBy("dump"))
    fresh = adverts.withColumn("__newest", newest).filter((F.col("__newest") - F.col("stamp") <= s.sample_fresh_s) & (F.col("distance") > 0) & ~F.isnan("distance"))
    m = small(matches)
    tx = m.select(F.col("address").alias("__a"), F.col("slug").alias("tx"))
    rx = m.select(F.col("address").alias("__b"), F.col("slug").alias("rx"))
    joined = fresh.join(tx, F.lower("address") == F.col("__a")).join(rx, F.lower("scanner_address") == F.col("__b"))
    return joined.filter("tx <> rx").select("dump", "tx", "rx", F.col("stamp"), F.col("distance").alias("distance_m"))


def match_scanners(placed: DataFrame, scanners: DataFrame) -> DataFrame:
    """slug, address, tier: by name, else by a hardware token that points at one free scanner only.

    placed (slug, uid), scanners (address, name). Candidates come from equi-joins on name tokens and on the
    four address tails that a token fits. Tier two peels them in rounds: every slug with one candidate
    left takes it, of several that want the same the least, and what is taken goes from all others, which
    can leave another slug with one. It ends when no slug has just one; nothing passes through the driver.
    """
    s = scanners.select(F.lower("address").alias("address"), f.slugify(F.col("name")).alias("name"))
    named = placed.join(s, placed["slug"] == s["name"]).select("slug", "address", F.lit(1).alias("tier"))
    free = s.join(named.select("address"), "address", "left_anti").join(placed.select(F.col("slug").alias("name")), "name", "left_anti")
    waiting = placed.join(named.select("slug"), "slug", "left_anti").withColumn("token", F.coalesce("uid", f.scanner_token(F.col("slug")))).filter("token is not null")
    by_name = waiting.join(free.withColumn("token", f.scanner_token(F.col("name"))), "token").select("slug", "address")
    by_address = waiting.withColumn("tail", F.explode(f.token_tails(F.col("token")))).join(free.withColumn("tail", f.address_tail(F.col("address"))), "tail").select("slug", "address")
    work = WorkTables()
    pairs = work.keep(by_name.unionByName(by_address).distinct(), "scanner-pairs")
    more = None
    while not pairs.isEmpty():
        lone = pairs.groupBy("slug").agg(F.min("address").alias("address"), F.count("*").alias("n")).filter("n = 1")
        taken = work.keep(lone.groupBy("address").agg(F.min("slug").alias("slug")), "scanner-taken")
        if taken.isEmpty():
            break
        # A slug whose one candidate went to another has no pair left, and goes too.
        after = work.keep(pairs.join(taken.select("address"), "address", "left_anti").join(taken.select("slug"), "slug", "left_anti"), "scanner-pairs")
        work.drop(pairs)
        pairs, more = after, taken if more is None else more.unionByName(taken)
    work.drop(pairs)
    return named if more is None else named.unionByName(more.select("slug", "address", F.lit(2).alias("tier")))


# Pairs and fit.
def true_distances(receivers: DataFrame) -> DataFrame:
    """Directed pairs of a floor: tx, rx, floor, true_m; three-dimensional only where both heights are known."""
    a = receivers.select(F.col("scanner").alias("tx"), "floor", "scale", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("height").alias("ah"))
    b = receivers.select(F.col("scanner").alias("rx"), F.col("floor").alias("__floor"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("height").alias("bh"))
    j = a.join(b, (f.normalized(F.col("floor")) == f.normalized(F.col("__floor"))) & (F.col("tx") != F.col("rx")))
    dx, dy = (F.col("ax") - F.col("bx")) / F.col("scale"), (F.col("ay") - F.col("by")) / F.col("scale")
    dh = F.coalesce(F.col("ah") - F.col("bh"), F.lit(0.0))
    return j.select("floor", "tx", "rx", F.sqrt(dx * dx + dy * dy + dh * dh).alias("true_m"))


def usable_pairs(samples: DataFrame, receivers: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """floor, tx, rx, true_m, measured_m (median), samples: pairs with enough samples and distance."""
    m = samples.groupBy("tx", "rx").agg(F.percentile("distance_m", F.lit(0.5)).alias("measured_m"), F.count(F.lit(1)).alias("samples"))
    m = m.filter((F.col("samples") >= s.least_samples) & (F.col("measured_m") > 0))
    d = small(true_distances(receivers))
    return m.join(d, ["tx", "rx"]).filter(F.col("true_m") >= s.least_true_m).select("floor", "tx", "rx", "true_m", "measured_m", "samples")


def both_ways(pairs: DataFrame) -> DataFrame:
    """Pairs measured in both directions, once each."""
    back = pairs.select("floor", F.col("tx").alias("rx"), F.col("rx").alias("tx"), F.col("measured_m").alias("back_m"))
    return pairs.join(back, ["floor", "tx", "rx"]).filter("tx < rx").select("floor", F.col("tx").alias("a"), F.col("rx").alias("b"), "true_m", F.col("measured_m").alias("ab_m"), "back_m")


def log_ratios(pairs: DataFrame) -> DataFrame:
    return pairs.select("floor", "tx", "rx", F.log10(F.col("measured_m") / F.col("true_m")).alias("y"), (1 / (1 + F.col("true_m"))).alias("weight"))


class BiasFit:
    """The fit of one floor: residuals, gradient and normal equations in receive and send biases (log10).

    Equations: each pair (long readings are cheap, short ones dear), differences of the two
    directions of a pair, and a gauge that keeps the mean send bias at zero. An equation touches two
    unknowns, or four, so each adds to that many cells squared of the normal equations and no matrix has a row
    for each pair: n receivers take 4 n**2 cells, whatever the number of pairs.
    """

    def __init__(self, tx: np.ndarray, rx: np.ndarray, y: np.ndarray, weight: np.ndarray, n: int, s: Settings = DEFAULTS):
        self.tx, self.rx, self.y, self.weight, self.n, self.s = tx + n, rx, y, weight, n, s
        key, back = tx.astype(np.int64) * n + rx, rx.astype(np.int64) * n + tx
        order = np.argsort(key)
        at = np.searchsorted(key[order], back)
        at[at == len(key)] = 0
        both = np.flatnonzero((key[order][at] == back) & (tx < rx))
        ab, ba = both, order[at[both]]
        #: Unknowns of each difference, and the sign of each.
        self.ends, self.signs = np.stack([self.rx[ab], self.tx[ab], self.rx[ba], self.tx[ba]]), np.array([1.0, 1.0, -1.0, -1.0])
        self.wanted = y[ab] - y[ba]
        self.gauge = s.gauge_weight / n
        fixed = np.zeros((2 * n, 2 * n))
        for i in range(4):
            for j in range(4):
                self._add(fixed, self.ends[i], self.ends[j], np.full(len(ab), s.diff_weight**2 * self.signs[i] * self.signs[j]))
        fixed[n:, n:] += self.gauge**2
        self.fixed = fixed

    @staticmethod
    def _add(h: np.ndarray, i: np.ndarray, j: np.ndarray, values: np.ndarray) -> None:
        np.add.at(h.reshape(-1), i.astype(np.int64) * len(h) + j, values)

    def _pairs(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residual of each pair, and the size of its slope in either bias."""
        s, e = self.s, self.y - v[self.rx] - v[self.tx]
        up, down = np.maximum(e, 0), np.maximum(-e, 0)
        res = (s.positive_scale * np.log1p(up / s.positive_scale) - s.negative_slope * s.negative_scale * np.log1p(down / s.negative_scale)) * self.weight
        return res, np.where(e >= 0, 1 / (1 + up / s.positive_scale), s.negative_slope / (1 + down / s.negative_scale)) * self.weight

    def _differences(self, v: np.ndarray) -> np.ndarray:
        return self.s.diff_weight * (self.signs @ v[self.ends] - self.wanted)

    def cost(self, v: np.ndarray) -> float:
        res, rest = self._pairs(v)[0], self._differences(v)
        return float(res @ res + rest @ rest + (self.gauge * v[self.n :].sum()) ** 2)

    def gradient(self, v: np.ndarray) -> np.ndarray:
        """Half the gradient of the cost."""
        res, slope = self._pairs(v)
        rest, sizes = self.s.diff_weight * self._differences(v), 2 * self.n
        out = -np.bincount(self.rx, slope * res, sizes) - np.bincount(self.tx, slope * res, sizes)
        for ends, sign in zip(self.ends, self.signs, strict=True):
            out += np.bincount(ends, sign * rest, sizes)
        out[self.n :] += self.gauge**2 * v[self.n :].sum()
        return out

    def normal(self, v: np.ndarray) -> np.ndarray:
        slope = self._pairs(v)[1] ** 2
        h = self.fixed.copy()
        for i, j in ((self.rx, self.rx), (self.tx, self.tx), (self.rx, self.tx), (self.tx, self.rx)):
            self._add(h, i, j, slope)
        return h

    def solve(self, steps: int = 400) -> np.ndarray:
        """Projected damped Gauss-Newton within [-1, 1]."""
        v, damping = np.zeros(2 * self.n), 1e-3
        now, grad, h = self.cost(v), self.gradient(v), self.normal(v)
        inner = lambda v, grad: np.flatnonzero(~(((v <= -1) & (grad > 0)) | ((v >= 1) & (grad < 0))))
        steepest = lambda v, grad: np.abs(grad[inner(v, grad)]).max(initial=0.0)
        for _ in range(steps):
            free = inner(v, grad)
            if steepest(v, grad) < 1e-12:
                break
            part = h[np.ix_(free, free)]
            part[np.diag_indices_from(part)] += damping * (part.diagonal() + 1e-9)
            step = np.zeros(2 * self.n)
            step[free] = np.linalg.solve(part, -grad[free])
            trial = np.clip(v + step, -1, 1)
            then = self.cost(trial)
            slope = self.gradient(trial)
            # Where the cost no longer tells steps apart, as it is rounded, the gradient does.
            if then < now - 1e-12 * now or (then <= now + 1e-12 * now and steepest(trial, slope) < steepest(v, grad)):
                small_step = np.abs(trial - v).max() < 1e-15
                v, now, grad, damping = trial, then, slope, max(damping / 4, 1e-12)
                if small_step:
                    break
                h = self.normal(v)
            else:
                damping *= 5
                if damping > 1e10:
                    break
        return v


def fit_biases(tx: np.ndarray, rx: np.ndarray, y: np.ndarray, weight: np.ndarray, n: int, s: Settings = DEFAULTS) -> tuple[np.ndarray, np.ndarray]:
    """Receive and send biases (log10) of ``n`` receivers from pairs of their numbers."""
    v = BiasFit(tx, rx, y, weight, n, s).solve()
    return v[:n], v[n:]


def _fit(s: Settings):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["tx", "rx"])
        names = sorted({*group.tx, *group.rx})
        if len(group) < s.least_pairs:
            return pd.DataFrame({"floor": [], "scanner": [], "rx_log": [], "tx_log": []})
        index = {k: i for i, k in enumerate(names)}
        tx, rx = group.tx.map(index).to_numpy(), group.rx.map(index).to_numpy()
        y = np.log10(group.measured_m.to_numpy() / group.true_m.to_numpy())
        receive, send = fit_biases(tx, rx, y, 1 / (1 + group.true_m.to_numpy()), len(names), s)
        return pd.DataFrame({"floor": group.floor.iloc[0], "scanner": names, "rx_log": receive, "tx_log": send})

    return run


def calibrate(pairs: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """floor, scanner, rx_log, tx_log: one fit a floor, of its pairs' medians (receivers squared at most, never its samples)."""
    return pairs.select("floor", "tx", "rx", "true_m", "measured_m").groupBy("floor").applyInPandas(_fit(s), "floor string, scanner string, rx_log double, tx_log double")


def settled(biases: DataFrame, pairs: DataFrame, s: Settings = DEFAULTS, near: float = 1e-9) -> DataFrame:
    """floor, scanner, rx_settled, tx_settled: whether the cost's gradient is zero in a bias, or points out of the bound that the bias is at.

    Written as joins and sums over pairs, apart from the fit itself.
    """
    rx = small(biases.select("floor", F.col("scanner").alias("rx"), F.col("rx_log").alias("__r")))
    tx = small(biases.select("floor", F.col("scanner").alias("tx"), F.col("tx_log").alias("__t")))
    p = log_ratios(pairs).join(rx, ["floor", "rx"]).join(tx, ["floor", "tx"]).withColumn("e", F.col("y") - F.col("__r") - F.col("__t"))
    up, down = F.greatest("e", F.lit(0.0)), F.greatest(-F.col("e"), F.lit(0.0))
    res = (s.positive_scale * F.log1p(up / s.positive_scale) - s.negative_slope * s.negative_scale * F.log1p(down / s.negative_scale)) * F.col("weight")
    slope = F.when(F.col("e") >= 0, 1 / (1 + up / s.positive_scale)).otherwise(s.negative_slope / (1 + down / s.negative_scale)) * F.col("weight")
    back = p.select("floor", F.col("tx").alias("rx"), F.col("rx").alias("tx"), F.col("e").alias("__e"))
    # The difference of the two directions counts once for a pair, with either sign in its ends.
    p = p.withColumn("g", -slope * res).join(back, ["floor", "tx", "rx"], "left").withColumn("g", F.col("g") - s.diff_weight**2 * F.coalesce(F.col("e") - F.col("__e"), F.lit(0.0)))
    share = p.select("floor", "g", F.inline(F.array(F.struct(F.col("rx").alias("scanner"), F.lit("rx").alias("side")), F.struct(F.col("tx").alias("scanner"), F.lit("tx").alias("side")))))
    grad = share.groupBy("floor", "scanner").pivot("side", ["rx", "tx"]).agg(F.sum("g"))
    whole = Window.partitionBy("floor")
    j = biases.join(grad, ["floor", "scanner"], "left").withColumn("__mean", F.avg("tx_log").over(whole)).withColumn("__n", F.count("*").over(whole))
    gauge = s.gauge_weight**2 * F.col("__mean") / F.col("__n")

    def rests(bias: str, g) -> F.Column:
        return (F.abs(g) < near) | ((F.col(bias) <= -1) & (g > 0)) | ((F.col(bias) >= 1) & (g < 0))

    return j.select("floor", "scanner", rests("rx_log", F.coalesce("rx", F.lit(0.0))).alias("rx_settled"), rests("tx_log", F.coalesce("tx", F.lit(0.0)) + gauge).alias("tx_settled"))


def corrections(biases: DataFrame, pairs: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """floor, scanner, correction (geometric mean 1 before clamping), db, pairs, low_confidence."""
    mean = F.avg(-F.col("rx_log")).over(Window.partitionBy("floor"))
    c = biases.withColumn("raw", F.pow(F.lit(10.0), -F.col("rx_log") - mean)).withColumn("correction", f.correction_factor(F.col("raw"), s))
    ends = pairs.select("floor", F.explode(F.array("tx", "rx")).alias("scanner")).groupBy("floor", "scanner").agg(F.count(F.lit(1)).alias("pairs"))
    j = c.join(ends, ["floor", "scanner"], "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))
    return j.select("floor", "scanner", "correction", f.bias_db(F.col("correction")).alias("db"), "pairs", (~F.col("correction").between(0.5, 2.0) | (F.col("pairs") < 3)).alias("low_confidence"))


def matrix(pairs: DataFrame, corr: DataFrame) -> DataFrame:
    c = small(corr.select(F.col("floor"), F.col("scanner").alias("rx"), "correction"))
    return pairs.join(c, ["floor", "rx"]).select(
        "floor", "tx", "rx", F.round("true_m", 2).alias("true_m"), F.round("measured_m", 2).alias("measured_m"),
        F.round(F.col("measured_m") * F.col("correction"), 2).alias("corrected_m"), F.round((F.col("measured_m") / F.col("true_m") - 1) * 100, 1).alias("error_pct"), "samples",
    )


def error_factors(pairs: DataFrame, biases: DataFrame) -> DataFrame:
    """Typical multiplicative error of a floor before and after the fit."""
    y = F.log10(F.col("measured_m") / F.col("true_m"))
    rx = small(biases.select("floor", F.col("scanner").alias("rx"), "rx_log"))
    tx = small(biases.select("floor", F.col("scanner").alias("tx"), "tx_log"))
    j = pairs.join(rx, ["floor", "rx"]).join(tx, ["floor", "tx"])
    typical = lambda c: F.round(F.pow(F.lit(10.0), F.percentile(F.abs(c), F.lit(0.5))), 3)
    return j.groupBy("floor").agg(F.count(F.lit(1)).alias("pairs_used"), typical(y).alias("error_factor_before"), typical(y - F.col("rx_log") - F.col("tx_log")).alias("error_factor_after"))


def missing_receivers(receivers: DataFrame, pairs: DataFrame, matched: DataFrame, now: Column, s: Settings = DEFAULTS) -> DataFrame:
    """Placed receivers without a pair: floor, scanner, cause. matched: slug, matched_at."""
    used = pairs.select(F.explode(F.array("tx", "rx")).alias("scanner")).distinct()
    fresh = matched.filter(now - F.col("matched_at") <= s.state_max_age_s).select(F.col("slug").alias("scanner"), F.lit(True).alias("__matched")).distinct()
    out = receivers.join(used, "scanner", "left_anti").join(fresh, "scanner", "left")
    return out.select("floor", "scanner", F.when(F.col("__matched"), "no_data").otherwise("unmatched").alias("cause"))


def apply_corrections(receivers: DataFrame, corr: DataFrame, floor: Column | None = None) -> DataFrame:
    """Receivers with the fitted corrections in place, and whether each changed."""
    c = small(corr.select(F.col("scanner"), F.col("correction").alias("__new")))
    j = receivers.join(c, "scanner", "left")
    use = F.col("__new").isNotNull() if floor is None else F.col("__new").isNotNull() & (f.normalized(F.col("floor")) == f.normalized(floor))
    new = F.when(use, F.col("__new")).otherwise(F.col("correction"))
    return j.withColumn("changed", use & ~F.col("correction").eqNullSafe(F.col("__new"))).withColumn("correction", new).drop("__new")


def reset_corrections(receivers: DataFrame) -> DataFrame:
    return receivers.withColumn("changed", F.col("correction").isNotNull()).withColumn("correction", F.lit(None).cast("double"))


def worth_writing(new: DataFrame, old: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Floors whose corrections changed by a share of ``write_epsilon`` or more, or that are new."""
    j = new.select("floor", "scanner", "correction").join(old.select("floor", "scanner", F.col("correction").alias("__old")), ["floor", "scanner"], "left")
    change = F.max(F.coalesce(F.abs(F.col("correction") / F.col("__old") - 1), F.lit(float("inf"))))
    return j.groupBy("floor").agg(change.alias("change")).filter(F.col("change") >= s.write_epsilon)


# Self-test.
def selftest_bounds(receivers: DataFrame, zones: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Bounds per floor from all placed receivers and all vertices of any zone."""
    v = receivers.select("floor_seq", "x", "y").unionByName(zones.select("floor_seq", F.inline("ring")))
    b = v.groupBy("floor_seq").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    m = s.bounds_margin * F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1.0))
    return b.select("floor_seq", (F.col("x0") - m).alias("minx"), (F.col("y0") - m).alias("miny"), (F.col("x1") + m).alias("maxx"), (F.col("y1") + m).alias("maxy"))


def selftest_points(samples: DataFrame, receivers: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """target, floor_seq, rx, x, y, r: what each receiver would be located by, from the others that heard it."""
    m = samples.filter(F.col("distance_m") > 0).groupBy("tx", "rx").agg(F.percentile("distance_m", F.lit(0.5)).alias("m"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= s.selftest_samples)
    t = small(receivers.select(F.col("scanner").alias("tx"), F.col("floor_seq").alias("__f"), F.col("height").alias("th"), "scale"))
    o = small(receivers.select(F.col("scanner").alias("rx"), "floor_seq", "x", "y", F.col("height").alias("oh"), "correction"))
    j = m.join(t, "tx").join(o, "rx").filter("floor_seq = __f and tx <> rx")
    d = F.col("m") * F.coalesce(F.col("correction"), F.lit(1.0))
    dz = F.col("oh") - F.col("th")
    flat = F.when(dz.isNull(), d).otherwise(F.sqrt(F.greatest(d * d - dz * dz, F.lit(0.0))))
    return j.select(F.col("tx").alias("target"), "floor_seq", "rx", "x", "y", (flat * F.col("scale")).alias("r"))


def selftest(samples: DataFrame, receivers: DataFrame, zones: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """A row for each placed receiver: heard_by, est_x, est_y, error_m (null where fewer than three heard it)."""
    points = selftest_points(samples, receivers, s).groupBy("target").agg(F.sort_array(F.collect_list(F.struct("rx", "x", "y", "r", F.lit(1.0).alias("w")))).alias("points"))
    placed = receivers.select(F.col("scanner").alias("target"), "floor_seq", "floor", F.col("x").alias("known_x"), F.col("y").alias("known_y"), "scale")
    j = placed.join(points, "target", "left").join(small(selftest_bounds(receivers, zones, s)), "floor_seq", "left")
    j = j.withColumn("points", F.coalesce("points", F.expr("filter(points, p -> false)"))).withColumn("heard_by", F.coalesce(F.size("points"), F.lit(0)))
    solved = solve(j.withColumn("min_radius", f.min_weight_radius(F.col("scale"), s)))
    error = F.sqrt(F.pow(F.col("fx") - F.col("known_x"), 2) + F.pow(F.col("fy") - F.col("known_y"), 2)) / F.col("scale")
    return solved.select("floor_seq", "floor", F.col("target").alias("scanner"), F.greatest("heard_by", F.lit(0)).alias("heard_by"), F.round("fx", 1).alias("est_x"), F.round("fy", 1).alias("est_y"), F.round(error, 3).alias("error_m"))


def selftest_summary(errors: DataFrame) -> DataFrame:
    """One row in total and one a floor (floor null: total): placed, solved, percentiles, mean, maximum, worst."""
    p = lambda q: F.round(F.percentile("error_m", F.lit(q)), 3)
    grouped = errors.groupingSets([["floor"], []], "floor")
    worst = F.max_by("scanner", F.struct(F.coalesce("error_m", F.lit(-1.0)), -F.col("place")))
    return grouped.agg(
        F.count(F.lit(1)).alias("placed"), F.count("error_m").alias("solved"), p(0.5).alias("cep50_m"), p(0.95).alias("cep95_m"),
        F.round(F.avg("error_m"), 3).alias("mean_m"), F.round(F.max("error_m"), 3).alias("max_m"), worst.alias("worst"),
    )
