"""Posture and balance geometry of point clouds, circular statistics, equivalence tests, windows and descriptors: aggregates, finished by closed forms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..model import along, pearson, ratio


#: Chebyshev coefficients of the complementary error function (fractional error below 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_tail(z: Column) -> Column:
    """The chance that a standard normal value is above z."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    poly = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        poly = poly * t + c
    half = t * F.exp(poly - x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def path_length(df: DataFrame, fs: float) -> DataFrame:
    """Summed steps and path per second of the rows without gaps."""
    d = df.where("x is not null and y is not null")
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(along()), 2) + F.pow(F.col("y") - F.lag("y").over(along()), 2))
    d = d.withColumn("_d", step)
    return d.groupBy("id").agg(F.coalesce(F.sum("_d"), F.lit(0.0)).alias("path"), ratio(F.coalesce(F.sum("_d"), F.lit(0.0)) * fs, F.count("*")).alias("path_rate"))


def _moments() -> dict[str, Column]:
    return {"n": F.count("*"), "a": F.var_samp("x"), "c": F.var_samp("y"), "b": F.covar_samp("x", "y")}


def confidence_ellipse_area(df: DataFrame, conf: float = 0.95) -> DataFrame:
    """pi * chi2 * sqrt(det cov); null below three rows."""
    m = df.where("x is not null and y is not null").groupBy("id").agg(*[v.alias(k) for k, v in _moments().items()])
    area = math.pi * -2 * math.log(1 - conf) * F.sqrt(F.greatest(F.col("a") * F.col("c") - F.col("b") * F.col("b"), F.lit(0.0)))
    return m.select("id", F.when(F.col("n") >= 3, area).alias("area"))


def sway_geometry(df: DataFrame) -> DataFrame:
    """Principal axes of each cloud: eigenvalues, both anisotropies, axis in degrees, radius and ranges along the axes."""
    w = Window.partitionBy("id")
    d = df.where("x is not null and y is not null").select("id", "x", "y", F.avg("x").over(w).alias("mx"), F.avg("y").over(w).alias("my"), F.var_samp("x").over(w).alias("a"), F.var_samp("y").over(w).alias("c"), F.covar_samp("x", "y").over(w).alias("b"))
    mid, r = (F.col("a") + F.col("c")) / 2, F.sqrt(F.pow((F.col("a") - F.col("c")) / 2, 2) + F.col("b") * F.col("b"))
    d = d.withColumns({"l1": mid + r, "l2": F.greatest(mid - r, F.lit(0.0)), "angle": F.atan2(2 * F.col("b"), F.col("a") - F.col("c")) / 2})
    u = (F.col("x") - F.col("mx")) * F.cos("angle") + (F.col("y") - F.col("my")) * F.sin("angle")
    v = (F.col("y") - F.col("my")) * F.cos("angle") - (F.col("x") - F.col("mx")) * F.sin("angle")
    d = d.withColumns({"u": u, "v": v})
    return d.groupBy("id").agg(
        F.count("*").alias("n"), (1 - ratio(F.max("l2"), F.max("l1"))).alias("anisotropy"), F.sqrt(ratio(F.max("l1"), F.max("l2"))).alias("axis_ratio"),
        F.pmod(F.degrees(F.max("angle")), F.lit(180.0)).alias("axis_deg"), F.sqrt(F.max("l1")).alias("sd_major"), F.sqrt(F.max("l2")).alias("sd_minor"),
        F.sqrt(F.avg(F.col("u") * F.col("u") + F.col("v") * F.col("v"))).alias("rms_radius"), (F.max("u") - F.min("u")).alias("range_major"), (F.max("v") - F.min("v")).alias("range_minor"),
    )


def principal_axis_projection(df: DataFrame) -> DataFrame:
    """Each row's place along the first axis; the axis points to rising x."""
    w = Window.partitionBy("id")
    a, c, b = F.var_samp("x").over(w), F.var_samp("y").over(w), F.covar_samp("x", "y").over(w)
    angle = F.atan2(2 * b, a - c) / 2
    d = df.withColumns({"_g": angle, "_x": F.col("x") - F.avg("x").over(w), "_y": F.col("y") - F.avg("y").over(w)})
    return d.withColumn("proj", F.col("_x") * F.cos("_g") + F.col("_y") * F.sin("_g")).drop("_g", "_x", "_y")


def dispersion_radius(df: DataFrame, quantile: float = 0.95) -> DataFrame:
    w = Window.partitionBy("id")
    d = df.where("x is not null and y is not null").withColumn("_r", F.sqrt(F.pow(F.col("x") - F.avg("x").over(w), 2) + F.pow(F.col("y") - F.avg("y").over(w), 2)))
    return d.groupBy("id").agg(F.percentile("_r", F.lit(quantile)).alias("radius"))


def sway_orientation(df: DataFrame) -> DataFrame:
    """angle_deg (0 to 180) of the first axis and anisotropy (ratio of the axes' deviations); null below three rows or where the rows lie on a line."""
    g = sway_geometry(df)
    good = (F.col("n") >= 3) & (F.col("sd_minor") > 0)
    return g.select("id", F.when(good, F.col("axis_deg")).alias("angle_deg"), F.when(good, F.col("axis_ratio")).alias("anisotropy"))


def _scatter(cols: list[str]) -> Column:
    return F.sqrt(sum((F.var_pop(c) for c in cols[1:]), F.var_pop(cols[0])))


def spatial_extent(df: DataFrame, window: int, conf: float = 0.95, axes: tuple[str, ...] = ("x", "y", "z"), vertical: str | None = None) -> DataFrame:
    """Dispersion over two or three axes, ellipsoid volume (or area) and its root, mean dispersion within full windows, and drift ratio.

    With a vertical axis, the drift of the others and of that axis too. No row below max(window, axes + 2) rows without gaps.
    """
    if len(axes) not in (2, 3):
        raise ValueError("two or three axes are needed")
    d = df.where(" and ".join(f"{c} is not null" for c in axes))
    groups = {"": list(axes)}
    if vertical is not None:
        groups |= {"_horizontal": [c for c in axes if c != vertical], "_vertical": [vertical]}
    pairs = [(a, b) for k, a in enumerate(axes) for b in axes[k:]]
    m = d.groupBy("id").agg(F.count("*").alias("n"), *[_scatter(g).alias(f"dispersion{k}") for k, g in groups.items()], *[F.covar_samp(a, b).alias(a + b) for a, b in pairs])

    def cov(a: str, b: str) -> Column:
        return F.col(a + b if (a, b) in pairs else b + a)

    if len(axes) == 2:
        (a, b), unit = axes, math.pi * stats.chi2_ppf(conf, 2)
        det = cov(a, a) * cov(b, b) - cov(a, b) * cov(a, b)
    else:
        (a, b, c), unit = axes, 4 / 3 * math.pi * stats.chi2_ppf(conf, 3) ** 1.5
        det = cov(a, a) * (cov(b, b) * cov(c, c) - cov(b, c) * cov(b, c)) - cov(a, b) * (cov(a, b) * cov(c, c) - cov(b, c) * cov(a, c)) + cov(a, c) * (cov(a, b) * cov(b, c) - cov(b, b) * cov(a, c))
    volume = unit * F.sqrt(F.greatest(det, F.lit(0.0)))
    inside = d.withColumn("_k", F.row_number().over(along()) - 1).groupBy("id", F.floor(F.col("_k") / window).alias("w")).agg(F.count("*").alias("n"), *[_scatter(g).alias(f"d{k}") for k, g in groups.items()])
    inside = inside.where(F.col("n") == window).groupBy("id").agg(*[F.avg(f"d{k}").alias(f"within{k}") for k in groups])
    out = m.where(F.col("n") >= max(window, len(axes) + 2)).withColumn("volume", volume).join(inside, "id")
    drift = [ratio(F.col(f"dispersion{k}"), F.col(f"within{k}")).alias("drift_ratio" if not k else f"drift{k}") for k in groups]
    return out.select("id", "dispersion", "volume", F.pow("volume", F.lit(1 / len(axes))).alias("extent"), "within", *drift)


def sway_texture(df: DataFrame, fs: float, frozen: float = 2.0) -> DataFrame:
    """Share of samples under the threshold, and upward crossings a minute."""
    d = df.where("v is not null").withColumn("_p", F.lag("v").over(along()))
    return d.groupBy("id").agg(F.avg(F.when(F.col("v") < frozen, 1.0).otherwise(0.0)).alias("frozen_fraction"), (F.count_if((F.col("_p") < frozen) & (F.col("v") >= frozen)) * F.lit(60.0 * fs) / F.count("*")).alias("crossings_per_min"))


# Directions: id, angle (radians).


def circ_mean(df: DataFrame, weight: str | None = None) -> DataFrame:
    """n, mean direction and resultant length; weight: a column that counts each direction."""
    w = F.col(weight) if weight else F.lit(1.0)
    s, c = (ratio(F.sum(w * f("angle")), F.sum(F.when(F.col("angle").isNotNull(), w))) for f in (F.sin, F.cos))
    return df.groupBy("id").agg(F.count("angle").alias("n"), F.atan2(s, c).alias("mean"), F.hypot(s, c).alias("r"))


def circular_sd(r: Column) -> Column:
    return F.when(r <= 0, None).when(r > 1, 0.0).otherwise(F.sqrt(-2 * F.log(r)))


def rayleigh_p(r: Column, n: Column) -> Column:
    inner = F.sqrt(1 + 4 * n + 4 * (n * n - F.pow(n * r, 2)))
    return F.least(F.lit(1.0), F.exp(inner - (1 + 2 * n)))


def rayleigh(df: DataFrame, axial: bool = False, least: int = 3) -> DataFrame:
    """R, z and p against uniform directions; axial: of doubled angles, with the mean axis."""
    k = 2 if axial else 1
    d = circ_mean(df.withColumn("angle", F.col("angle") * k))
    good = F.col("n") >= least
    return d.select("id", "n", F.when(good, F.col("r")).alias("r"), F.when(good, F.col("n") * F.col("r") * F.col("r")).alias("z"), F.when(good, rayleigh_p(F.col("r"), F.col("n"))).alias("p"), (F.col("mean") / k).alias("mean"))


def axial_dispersion(df: DataFrame) -> DataFrame:
    d = circ_mean(df.withColumn("angle", F.col("angle") * 2))
    return d.select("id", (F.sqrt(-2 * F.log(F.greatest("r", F.lit(1e-12)))) / 2).alias("dispersion"))


def axial_rayleigh(df: DataFrame) -> DataFrame:
    """`rayleigh` of axes in degrees: R, p and the mean axis (0 to 180); null below two axes (p below three)."""
    d = circ_mean(df.where("angle is not null").withColumn("angle", F.radians(F.col("angle")) * 2))
    good = F.col("n") >= 2
    return d.select("id", "n", F.when(good, F.col("r")).alias("r"), F.when(F.col("n") >= 3, rayleigh_p(F.col("r"), F.col("n"))).alias("p"), F.when(good, F.pmod(F.degrees(F.col("mean") / 2), F.lit(180.0))).alias("mean_axis_deg"))


def vtest(df: DataFrame, mu: float) -> DataFrame:
    """v, u and p of a preferred direction mu; null below three directions."""
    d = circ_mean(df).withColumn("v", F.when(F.col("n") >= 3, F.col("r") * F.cos(F.col("mean") - mu))).withColumn("u", F.col("v") * F.sqrt(2 * F.col("n")))
    return d.select("id", "n", "v", "u", normal_tail(F.col("u")).alias("p"))


def circ_corr(df: DataFrame) -> DataFrame:
    """Correlation of two directions a and b, its z and two-sided p."""
    w = Window.partitionBy("id")

    def mean(c: str) -> Column:
        return F.atan2(F.sum(F.sin(c)).over(w), F.sum(F.cos(c)).over(w))

    d = df.where("a is not null and b is not null").withColumns({"_a": mean("a"), "_b": mean("b")})
    d = d.withColumns({"_a": F.sin(F.col("a") - F.col("_a")), "_b": F.sin(F.col("b") - F.col("_b"))})
    m = d.groupBy("id").agg(F.count("*").alias("n"), F.avg(F.col("_a") * F.col("_b")).alias("ab"), F.avg(F.col("_a") * F.col("_a")).alias("aa"), F.avg(F.col("_b") * F.col("_b")).alias("bb"), F.avg(F.pow(F.col("_a") * F.col("_b"), 2)).alias("aabb"))
    r = ratio(F.col("ab"), F.sqrt(F.col("aa") * F.col("bb")))
    z = F.sqrt(ratio(F.col("n") * F.col("aa") * F.col("bb"), F.col("aabb"))) * r
    return m.select("id", "n", r.alias("r"), z.alias("z"), (2 * normal_tail(F.abs(z))).alias("p"))


def circ_corr_linear(df: DataFrame) -> DataFrame:
    """Correlation of a direction with v: r squared from three Pearson coefficients, and p."""
    d = df.where("angle is not null and v is not null").withColumns({"_c": F.cos("angle"), "_s": F.sin("angle")})
    m = d.groupBy("id").agg(F.count("*").alias("n"), pearson("_c", "v").alias("xc"), pearson("_s", "v").alias("xs"), pearson("_c", "_s").alias("cs"))
    r2 = ratio(F.pow("xc", F.lit(2)) + F.pow("xs", F.lit(2)) - 2 * F.col("xc") * F.col("xs") * F.col("cs"), 1 - F.pow("cs", F.lit(2)))
    r2 = F.least(F.lit(1.0), F.greatest(F.lit(0.0), r2))
    return m.select("id", "n", F.sqrt(r2).alias("r"), F.exp(-F.col("n") * r2 / 2).alias("p"))


# Equivalence: statistics are aggregates; tails are finished on the one row that is left.


def verdict(p_tost: float, p_nhst: float, alpha: float = 0.05) -> str:
    return {(False, True): "effect", (True, False): "equivalent", (True, True): "trivial", (False, False): "inconclusive"}[(p_tost < alpha, p_nhst < alpha)]


def tost_independent_stats(df: DataFrame, bound: float) -> DataFrame:
    """Welch statistics of v between arm a and arm b: n, difference, standard error, degrees of freedom, both t."""
    m = df.where("v is not null").groupBy().agg(*[f(F.when(F.col("arm") == k, F.col("v"))).alias(f"{n}_{k}") for k in "ab" for n, f in (("n", F.count), ("m", F.avg), ("s", F.var_samp))])
    va, vb = F.col("s_a") / F.col("n_a"), F.col("s_b") / F.col("n_b")
    diff, se = F.col("m_a") - F.col("m_b"), F.sqrt(va + vb)
    df_ = ratio(F.pow(va + vb, 2), va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1))
    return m.select(F.col("n_a"), F.col("n_b"), diff.alias("diff"), se.alias("se"), df_.alias("df"), ratio(diff + bound, se).alias("t_lo"), ratio(diff - bound, se).alias("t_hi"), ratio(diff, se).alias("t"))


def tost_paired_stats(df: DataFrame, bound: float) -> DataFrame:
    d = df.where("a is not null and b is not null").select((F.col("a") - F.col("b")).alias("d"))
    m = d.groupBy().agg(F.count("*").alias("n"), F.avg("d").alias("diff"), (F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("se"))
    return m.select("n", "diff", "se", (F.col("n") - 1).cast("double").alias("df"), ratio(F.col("diff") + bound, F.col("se")).alias("t_lo"), ratio(F.col("diff") - bound, F.col("se")).alias("t_hi"), ratio(F.col("diff"), F.col("se")).alias("t"))


def tost(stats_row: dict, alpha: float = 0.05, bound: float | None = None) -> dict:
    """p values, interval and verdict of a statistics row; raises below three observations an arm, or for a bound that is not positive. Without any spread the difference is taken as exact."""
    counts = [stats_row[k] for k in ("n", "n_a", "n_b") if k in stats_row]
    if min(counts) < 3:
        raise ValueError("each arm needs three observations")
    if bound is not None and bound <= 0:
        raise ValueError("the bound must be positive")
    df, diff, se = stats_row["df"], stats_row["diff"], stats_row["se"]
    if not se:
        at = [math.copysign(math.inf, x) if x else 0.0 for x in (diff + (bound or 0.0), diff - (bound or 0.0), diff)]
        below = [1.0 if t > 0 else 0.0 if t < 0 else 0.5 for t in at]
        p, p0, half = max(1 - below[0], below[1]), 0.0 if diff else 1.0, 0.0
    else:
        p = max(1 - stats.t_cdf(stats_row["t_lo"], df), stats.t_cdf(stats_row["t_hi"], df))
        p0, half = 2 * (1 - stats.t_cdf(abs(stats_row["t"]), df)), stats.t_ppf(1 - alpha, df) * se
    return {"p_tost": p, "p_nhst": p0, "ci": (diff - half, diff + half), "verdict": verdict(p, p0, alpha), "bound": bound}


def interpret(result: dict) -> str:
    """A sentence for a result, which names the bound."""
    (lo, hi), b = result["ci"], f"±{result['bound']:g}" if result.get("bound") is not None else "the bound"
    span = f"[{lo:.3g}, {hi:.3g}]"
    return {
        "equivalent": f"equivalent within {b}: the interval {span} lies inside (p = {result['p_tost']:.3g})",
        "effect": f"an effect beyond {b} can't be ruled out: interval {span} (p = {result['p_nhst']:.3g})",
        "trivial": f"there is an effect, but within {b}: interval {span}",
        "inconclusive": f"undecided at {b}: the interval {span} allows for none and for one that matters",
    }[result["verdict"]]


def equivalence_correlation(r: float, n: int, bound: float, alpha: float = 0.05) -> dict:
    if not (abs(r) < 1 and n >= 4 and 0 < bound < 1):
        raise ValueError("needs |r| < 1, n >= 4 and a bound between 0 and 1")
    se, z, zb = 1 / math.sqrt(n - 3), math.atanh(r), math.atanh(bound)
    p = max(1 - stats.normal_cdf((z + zb) / se), stats.normal_cdf((z - zb) / se))
    p0 = 2 * (1 - stats.normal_cdf(abs(z) / se))
    half = stats.normal_ppf(1 - alpha) * se
    return {"p_tost": p, "p_nhst": p0, "ci": (math.tanh(z - half), math.tanh(z + half)), "verdict": verdict(p, p0, alpha), "bound": bound}


# Windows: grp, condition, onset_s, offset_s.


def durations(df: DataFrame) -> Column:
    """offset - onset; an error where a window does not end after it starts."""
    d = F.col("offset_s") - F.col("onset_s")
    return F.when(d > 0, d).otherwise(F.raise_error(F.lit("every window must end after it starts")).cast("double"))


def window_balance(df: DataFrame, tol: float = 0.05) -> DataFrame:
    """Durations per group and condition, with the group's ratio of largest to smallest median (1 for one condition)."""
    per = df.withColumn("_d", durations(df)).groupBy("grp", "condition").agg(F.count("*").alias("n"), F.median("_d").alias("median_s"), F.min("_d").alias("min_s"), F.max("_d").alias("max_s"))
    w = Window.partitionBy("grp")
    r = F.when(F.count("*").over(w) > 1, ratio(F.max("median_s").over(w), F.min("median_s").over(w))).otherwise(1.0)
    return per.withColumns({"ratio": r, "balanced": r <= 1 + tol})


def worst_group(balance: DataFrame) -> DataFrame:
    """The group whose conditions differ most, its ratio, and whether all groups are balanced: one row."""
    return balance.agg(F.max_by("grp", "ratio").alias("grp"), F.max("ratio").alias("ratio"), F.min("balanced").alias("balanced"))


def equalise_windows(df: DataFrame, cap_s: float | None = None) -> DataFrame:
    """Offsets cut so that all durations of a group are at most the cap, or its shortest duration."""
    if cap_s is not None and cap_s <= 0:
        raise ValueError("the cap must be positive")
    d = durations(df)
    cap = F.lit(cap_s) if cap_s is not None else F.min(d).over(Window.partitionBy("grp"))
    return df.withColumn("new_offset_s", F.col("onset_s") + F.least(d, cap))


def average_rank(df: DataFrame, v: str, by: str) -> DataFrame:
    """Rank of v within `by`, ties sharing their mean rank."""
    w = Window.partitionBy(by).orderBy(v)
    return df.withColumn("rank", F.rank().over(w) + (F.count("*").over(Window.partitionBy(by, v)) - 1) / F.lit(2.0))


def group_moments(df: DataFrame) -> DataFrame:
    """n, mean and sum of squares of v per grp: all that a random-intercept model needs."""
    return df.where("v is not null").groupBy("grp").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("*")).alias("ssw"))


def icc(df: DataFrame, log: bool | None = None) -> dict:
    """The share of a measure's variance that lies between groups (grp, v), with both parts, counts, and whether the fit ended at 0.

    log: on logarithms; if it is left open, where all values are positive. One row per group comes to the driver.
    """
    d = df.where("v is not null and grp is not null")
    few = d.agg(F.count("*").alias("n"), F.countDistinct("grp").alias("g"), F.min("v").alias("least")).first()
    if few["n"] < 3 or few["g"] < 2:
        raise ValueError("two groups and three values are needed")
    log = few["least"] > 0 if log is None else log
    rows = group_moments(d.withColumn("v", F.log("v")) if log else d).collect()
    return intraclass_correlation([(r["n"], r["mean"], r["ssw"]) for r in rows]) | {"n": few["n"], "n_groups": few["g"], "log": bool(log)}


def intraclass_correlation(moments: list[tuple[int, float, float]]) -> dict:
    """Random-intercept REML from (n, mean, ssw) per group: a one-dimensional profile on the driver, as long as there are groups."""
    total = sum(n for n, _, _ in moments)
    ssw = sum(s for _, _, s in moments)

    def profile(theta: float):
        w = [n / (1 + theta * n) for n, _, _ in moments]
        mu = sum(a * m for a, (_, m, _) in zip(w, moments)) / sum(w)
        q = ssw + sum(a * (m - mu) ** 2 for a, (_, m, _) in zip(w, moments))
        s2 = q / (total - 1)
        return (total - 1) * math.log(s2) + sum(math.log1p(theta * n) for n, _, _ in moments) + math.log(sum(w)), s2

    grid = [0.0] + [10 ** (k / 20) for k in range(-180, 121)]
    k = min(range(len(grid)), key=lambda j: profile(grid[j])[0])
    lo, hi = grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)]
    for _ in range(100):
        a, b = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        lo, hi = (lo, b) if profile(a)[0] <= profile(b)[0] else (a, hi)
    theta = (lo + hi) / 2
    s2 = profile(theta)[1]
    return {"icc": theta / (1 + theta), "between": theta * s2, "within": s2, "boundary": theta <= 1e-9}
