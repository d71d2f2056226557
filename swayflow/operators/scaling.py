"""Scaling and event statistics as joins and aggregates: displacement curves, fluctuation analysis, mutual information, group coincidence."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import along, ratio


def log_lags(lo: float, hi: float, n: int) -> list[int]:
    """Distinct rounded values on a logarithmic scale."""
    return sorted({int(np.round(x)) for x in np.geomspace(lo, hi, n)})


def leads(df: DataFrame, lags: list[int], cols: list[str]) -> DataFrame:
    """id, i, the columns, and for each lag an array element in `later`: the row that is lag rows later in i, null if there is none. One shuffle and one sort, whatever the number of lags."""
    at = [F.struct(F.lit(k).alias("lag"), F.lead("i", k).over(along()).alias("i"), *[F.lead(c, k).over(along()).alias(c) for c in cols]) for k in lags]
    return df.select("id", "i", *cols, F.array(*at).alias("later"))


def msd(df: DataFrame, lags: list[int]) -> DataFrame:
    """Mean squared displacement per lag (rows without holes in i): id, lag, msd, n. Lags are looked up in one sorted window and averaged with partial sums."""
    d = leads(df, lags, ["x", "y"]).select("id", "x", "y", F.explode("later").alias("b"))
    step = F.pow(F.col("b.x") - F.col("x"), 2) + F.pow(F.col("b.y") - F.col("y"), 2)
    return d.where("b.i is not null").groupBy("id", F.col("b.lag").alias("lag")).agg(F.avg(step).alias("msd"), F.count(step).alias("n"))


def sda(df: DataFrame, fs: float = 25.0, maxlag_s: float = 10.0, nlags: int = 60) -> DataFrame:
    """id and the two-region fit of each path's displacement curve: exponents, diffusion, and where the regions meet."""
    from .kernels import apply

    lags = log_lags(1, max(1, int(maxlag_s * fs)), nlags)
    sized = df.withColumn("_n", F.count("*").over(Window.partitionBy("id")))
    curve = msd(sized, lags).join(sized.groupBy("id").agg(F.count("*").alias("_n")), "id").where((F.col("lag") <= F.least(F.lit(int(maxlag_s * fs)), F.col("_n") - 5)) & (F.col("msd") > 0))
    packed = curve.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("lag", "msd"))).alias("c")).select("id", F.transform("c", lambda e: e["lag"] / F.lit(float(fs))).alias("dt"), F.transform("c", lambda e: e["msd"]).alias("msd"))
    return apply(packed, two_regions, ["dt", "msd"], "h_short double, h_long double, d_short double, d_long double, dt_c double, msd_c double, index int")


def stabilogram(curve: DataFrame, fs: float, short_max_s: float, long_min_s: float) -> DataFrame:
    """Hurst exponents of the short and the long region, from log-log slopes of an msd curve."""
    t, x, y = F.col("lag") / F.lit(fs), F.log(F.col("lag") / F.lit(fs)), F.log("msd")
    return curve.where("msd > 0").groupBy("id").agg(*[(F.regr_slope(F.when(c, y), F.when(c, x)) / 2).alias(n) for n, c in (("h_short", t < short_max_s), ("h_long", t > long_min_s))])


def two_regions(dt: np.ndarray, curve: np.ndarray) -> dict:
    """Two log-log lines that share a point, by smallest squared error, at least five points each: exponents, diffusion coefficients, and where the lines meet. Empty for fewer than nine points."""
    x, y = np.log10(np.asarray(dt, float)), np.log10(np.asarray(curve, float))

    def fitted(part: slice) -> tuple[float, np.ndarray]:
        line = np.polyfit(x[part], y[part], 1)
        return float(((np.polyval(line, x[part]) - y[part]) ** 2).sum()), line

    found = [(fitted(slice(None, k + 1)), fitted(slice(k, None)), k) for k in range(4, len(x) - 4)]
    if not found:
        return {}
    (_, a), (_, b), k = min(found, key=lambda f: (f[0][0] + f[1][0], f[2]))
    meet = (b[1] - a[1]) / (a[0] - b[0]) if a[0] != b[0] else math.nan
    return {"h_short": a[0] / 2, "h_long": b[0] / 2, "d_short": 10 ** a[1] / 2, "d_long": 10 ** b[1] / 2, "dt_c": 10**meet, "msd_c": 10 ** np.polyval(a, meet), "index": k}


def profile(df: DataFrame) -> DataFrame:
    """Running sum of v less its mean, with k from 0."""
    w = along()
    d = df.where("v is not null").withColumn("_c", F.col("v") - F.avg("v").over(Window.partitionBy("id")))
    return d.select("id", (F.row_number().over(w) - 1).alias("k"), F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("p"), F.count("*").over(Window.partitionBy("id")).alias("n"))


def fluctuations(df: DataFrame, scales: list[int]) -> DataFrame:
    """Mean squared residual of the profile about a line in each full segment: id, scale, seg, f2. Closed form from segment sums."""
    d = profile(df).withColumn("scale", F.explode(F.array(*map(F.lit, scales)))).where(F.col("k") < F.floor(F.col("n") / F.col("scale")) * F.col("scale"))
    u = F.pmod("k", "scale") - (F.col("scale") - 1) / 2.0
    d = d.groupBy("id", "scale", F.floor(F.col("k") / F.col("scale")).alias("seg")).agg((F.var_pop("p") * F.count("*")).alias("syy"), F.sum(u * F.col("p")).alias("suy"))
    s = F.col("scale")
    suu = s * (s * s - 1) / 12.0
    return d.select("id", "scale", "seg", ((F.col("syy") - F.col("suy") * F.col("suy") / suu) / s).alias("f2"))


def dfa_scales(n: int, fs: float | None = None, min_scale_s: float | None = None, smin: int | None = None, smax: int | None = None, number: int = 18) -> list[int]:
    """Scales of a fluctuation analysis of n samples: from 8 samples, or from a time, to a quarter of the series; none below 100 samples."""
    if min_scale_s is not None:
        if fs is None or smin is not None:
            raise ValueError("a scale in seconds needs a rate, and is given once")
        smin = max(8, round(min_scale_s * fs))
    smin, smax = smin or 8, smax or n // 4
    return log_lags(smin, smax, number) if n >= 100 and smax > smin else []


def dfa(df: DataFrame, scales: list[int]) -> DataFrame:
    """Slope of log F over log scale, of scales with at least 4 segments; null below 5 of them."""
    f = fluctuations(df, scales).groupBy("id", "scale").agg(F.sqrt(F.avg("f2")).alias("f"), F.count("*").alias("m")).where("m >= 4 and f > 0")
    return f.groupBy("id").agg(F.when(F.count("*") >= 5, F.regr_slope(F.log("f"), F.log("scale"))).alias("alpha"), F.count("*").alias("n_scales"))


def mfdfa(df: DataFrame, scales: list[int], qs: list[float]) -> DataFrame:
    """id, q, h, tau, alpha, f, and of each id h2 and width: generalised exponents and the singularity spectrum.

    Scales need 4 segments that vary, exponents 5 scales; alpha is the slope of tau over the neighbouring q.
    """
    f = fluctuations(df, scales).where("f2 > 0").withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    zero = F.abs(F.col("q")) < 1e-12
    m = f.groupBy("id", "scale", "q").agg(F.avg(F.pow("f2", F.col("q") / 2)).alias("m"), F.avg(F.log("f2")).alias("l"), F.count("*").alias("n")).where("n >= 4")
    fq = F.when(zero, F.exp(F.col("l") / 2)).otherwise(F.pow("m", 1 / F.when(zero, 1.0).otherwise(F.col("q"))))
    h = m.withColumn("fq", fq).groupBy("id", "q").agg(F.when(F.count("*") >= 5, F.regr_slope(F.log("fq"), F.log("scale"))).alias("h")).where("h is not null").withColumn("tau", F.col("q") * F.col("h") - 1)
    w = Window.partitionBy("id").orderBy("q")
    (q0, t0), (q1, t1) = ((f("q").over(w), f("tau").over(w)) for f in (F.lag, F.lead))
    left, right = ratio(F.col("tau") - t0, F.col("q") - q0), ratio(t1 - F.col("tau"), q1 - F.col("q"))
    a, b = F.col("q") - q0, q1 - F.col("q")
    # Between neighbours at unequal steps the slopes count the more the nearer they are.
    inner = (left * b + right * a) / (a + b)
    h = h.withColumn("alpha", F.coalesce(inner, left, right)).withColumn("f", F.col("q") * F.col("alpha") - F.col("tau"))
    whole = Window.partitionBy("id")
    below, above = F.max(F.when(F.col("q") <= 2, F.struct("q", "h"))).over(whole), F.min(F.when(F.col("q") >= 2, F.struct("q", "h"))).over(whole)
    h2 = F.when(above["q"] == below["q"], below["h"]).otherwise(below["h"] + (above["h"] - below["h"]) * (2 - below["q"]) / (above["q"] - below["q"]))
    return h.withColumns({"h2": F.coalesce(h2, below["h"], above["h"]), "width": F.max("alpha").over(whole) - F.min("alpha").over(whole), "_n": F.count("*").over(whole)}).where("_n >= 5").drop("_n")


def trev(df: DataFrame, tau: int = 1) -> DataFrame:
    d = df.withColumn("_d", F.col("v") - F.lag("v", tau).over(along()))
    return d.groupBy("id").agg(ratio(F.avg(F.pow("_d", 3)), F.pow(F.avg(F.pow("_d", 2)), 1.5)).alias("trev"))


def embed(df: DataFrame, dim: int, tau: int) -> DataFrame:
    """Delay vectors: e0 to e<dim-1>, rows without all of them left out."""
    out = df.withColumns({f"e{k}": F.lead("v", k * tau).over(along()) if k else F.col("v") for k in range(dim)})
    return out.where(F.col(f"e{dim - 1}").isNotNull()).select("id", "i", *[f"e{k}" for k in range(dim)])


def mutual_information(df: DataFrame, lags: list[int], bins: int = 32) -> DataFrame:
    """Average mutual information (nats) between v and v later (rows without holes in i), from a two-dimensional histogram per lag."""
    d = leads(df, lags, ["v"]).select("id", "v", F.explode("later").alias("b")).where("b.i is not null").select("id", "v", F.col("b.lag").alias("lag"), F.col("b.v").alias("u"))
    limits = d.groupBy("id", "lag").agg(F.min("v").alias("v0"), F.max("v").alias("v1"), F.min("u").alias("u0"), F.max("u").alias("u1"))

    def cell(c: str):
        lo, hi = F.col(f"{c}0"), F.col(f"{c}1")
        return F.least(F.floor(F.coalesce(ratio((F.col(c) - lo) * bins, hi - lo), F.lit(0.0))), F.lit(bins - 1))

    n2 = d.join(limits, ["id", "lag"]).groupBy("id", "lag", cell("v").alias("_x"), cell("u").alias("_y")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("id", "lag")
    n2 = n2.withColumns({"nx": F.sum("n").over(Window.partitionBy("id", "lag", "_x")), "ny": F.sum("n").over(Window.partitionBy("id", "lag", "_y")), "all": F.sum("n").over(w)})
    return n2.groupBy("id", "lag").agg(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("nx") * F.col("ny")))).alias("ami"))


def dcca(df: DataFrame, scales: list[int]) -> DataFrame:
    """Detrended cross-correlation of a and b per scale."""
    w = along()
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = df.where("a is not null and b is not null").withColumns({c: F.col(c) - F.avg(c).over(Window.partitionBy("id")) for c in "ab"})
    d = d.select("id", (F.row_number().over(w) - 1).alias("k"), F.sum("a").over(run).alias("pa"), F.sum("b").over(run).alias("pb"), F.count("*").over(Window.partitionBy("id")).alias("n"))
    d = d.withColumn("scale", F.explode(F.array(*map(F.lit, scales)))).where(F.col("k") < F.floor(F.col("n") / F.col("scale")) * F.col("scale"))
    u = F.pmod("k", "scale") - (F.col("scale") - 1) / 2.0
    n = F.count("*")
    m = d.groupBy("id", "scale", F.floor(F.col("k") / F.col("scale")).alias("seg")).agg((F.covar_pop("pa", "pb") * n).alias("ab"), (F.var_pop("pa") * n).alias("aa"), (F.var_pop("pb") * n).alias("bb"), F.sum(u * F.col("pa")).alias("ua"), F.sum(u * F.col("pb")).alias("ub"))
    s = F.col("scale")
    suu = s * (s * s - 1) / 12.0
    m = m.groupBy("id", "scale").agg(F.sum(F.col("ab") - F.col("ua") * F.col("ub") / suu).alias("ab"), F.sum(F.col("aa") - F.col("ua") * F.col("ua") / suu).alias("aa"), F.sum(F.col("bb") - F.col("ub") * F.col("ub") / suu).alias("bb"))
    return m.select("id", "scale", ratio(F.col("ab"), F.sqrt(F.col("aa") * F.col("bb"))).alias("rho"))


def participation(df: DataFrame, events: DataFrame, fs: float, pre=(-3.0, -2.0), post=(0.0, 1.0)) -> DataFrame:
    """Per event time, the share of people whose mean after is below their mean before (ties left out): a join by sample, not a range join. Windows begin and end at the half-even rounded samples of their times."""
    lo, hi = int(math.floor(min(pre[0], post[0]) * fs)) - 1, int(math.ceil(max(pre[1], post[1]) * fs)) + 1
    ends = [F.bround((F.col("event_s") + t) * F.lit(float(fs)), 0).cast("long").alias(n) for n, t in (("a0", pre[0]), ("a1", pre[1]), ("b0", post[0]), ("b1", post[1]))]
    e = events.select("event_s", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("o"), *ends).withColumn("i", F.floor(F.col("event_s") * F.lit(float(fs))) + F.col("o"))
    d = df.join(e, "i")

    def mean(a: str, b: str):
        return F.avg(F.when((F.col("i") >= F.col(a)) & (F.col("i") < F.col(b)), F.col("v")))

    per = d.groupBy("event_s", "id").agg(mean("a0", "a1").alias("before"), mean("b0", "b1").alias("after"))
    return per.where("before <> after").groupBy("event_s").agg(F.avg(F.when(F.col("after") < F.col("before"), 1.0).otherwise(0.0)).alias("share"), F.count("*").alias("n"))


def sliding_null(df: DataFrame, fs: float, n: int, step_s: float = 0.1, pre=(-3.0, -2.0), post=(0.0, 1.0)) -> DataFrame:
    """`participation` at every step of a recording of n samples: what to hold events against. Both windows lie within the recording."""
    first, last = -pre[0], n / fs - post[1]
    steps = max(0, math.ceil((last - first) / step_s - 1e-9))
    times = df.sparkSession.range(steps).select((F.lit(float(first)) + F.col("id") * F.lit(float(step_s))).alias("event_s"))
    return participation(df, times, fs, pre, post)


#: Shift of a person's events in a draw: multipliers of person and draw, and the prime they are taken by.
SHIFT = (7_368_787, 9_576_803, 2_147_483_647)


def shifted_by(person, draw, span: int, seed: int = 0):
    """A whole number from -span to span; arithmetic only, so that any engine can draw the same."""
    a, b, prime = SHIFT
    x = F.pmod((F.pmod(person.cast("long"), F.lit(prime)) + 1) * a + (draw.cast("long") + seed) * b, F.lit(prime))
    x = F.pmod(x * 48_271 + 11, F.lit(prime))
    return F.when(draw == 0, F.lit(0)).otherwise(F.pmod(x, F.lit(2 * span + 1)) - span)


def coincidence(trains: DataFrame, n: int, fs: float, surrogates: int = 1000, shift_s: float = 30.0, frame_s: float = 1.0, seed: int = 0) -> DataFrame:
    """i, observed, null_mean, null_sd, p, surprise of every sample of a clock of n samples; trains: id (number), i, event (0 or 1) of people.

    The draw is a data dimension: each person's events (not samples) are shifted around the clock by
    an amount of its own per draw, counted per draw and frame, and summed per sample.
    """
    frame = max(1, round(frame_s * fs))
    span = round(shift_s * fs)
    ones = trains.where("event = 1").select("id", "i")
    draws = ones.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(surrogates))))
    at = draws.select("draw", F.pmod(F.col("i") + shifted_by(F.col("id"), F.col("draw"), span, seed), F.lit(n)).alias("c")).groupBy("draw", "c").agg(F.count("*").alias("k"))
    # A sample's frame begins half a frame before it.
    around = at.withColumn("i", F.explode(F.sequence(F.col("c") - (frame - frame // 2 - 1), F.col("c") + frame // 2))).where((F.col("i") >= 0) & (F.col("i") < n))
    counts = around.groupBy("draw", "i").agg(F.sum("k").alias("c"))
    clock = trains.sparkSession.range(n).withColumnRenamed("id", "i")
    seen = clock.join(counts.where("draw = 0").select("i", F.col("c").alias("obs")), "i", "left").select("i", F.coalesce("obs", F.lit(0)).alias("observed"))
    drawn = counts.where("draw > 0").join(seen, "i").groupBy("i").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"), F.count("*").alias("m"), F.count_if(F.col("c") >= F.col("observed")).alias("above"))
    d = seen.join(drawn, "i", "left").na.fill(0, ["s", "q", "m", "above"])
    total = F.lit(float(surrogates))
    # Draws without an event near a sample count 0 there, which reaches what was observed only if that is 0.
    above = F.col("above") + F.when(F.col("observed") <= 0, F.lit(surrogates) - F.col("m")).otherwise(F.lit(0))
    p = (above + 1) / (total + 1)
    most = math.log10(surrogates + 1)
    mean = F.col("s") / total
    surprise = F.when(p >= 1, F.lit(-most)).otherwise(F.greatest(F.lit(-most), F.least(F.lit(most), F.log10((1 - p) / p))))
    return d.select("i", "observed", mean.alias("null_mean"), F.sqrt(F.greatest(F.col("q") / total - mean * mean, F.lit(0.0))).alias("null_sd"), p.alias("p"), surprise.alias("surprise"))


def coincidence_summary(moments: DataFrame, surrogates: int = 1000) -> DataFrame:
    """Of `coincidence`: score (mean of -log10 p), and the share of samples with p below 0.01, which is what to read."""
    return moments.agg(F.avg(-F.log10(F.col("p") + F.lit(1 / (surrogates + 1)))).alias("score"), F.avg(F.when(F.col("p") < 0.01, 1.0).otherwise(0.0)).alias("frac_significant"), F.count("*").alias("n"))


def grid_motion(pixels: DataFrame, rows: int, cols: int, height: int, width: int, threshold: float = 8.0, region=(0.0, 1.0, 0.0, 1.0)) -> DataFrame:
    """frame, row, col, motion: mean absolute frame difference (small ones count as 0) per cell of a grid over a region (x0, x1, y0, y1, as parts of the frame)."""
    d = pixels.withColumn("_d", F.abs(F.col("v") - F.lag("v").over(Window.partitionBy("r", "c").orderBy("frame")))).where("_d is not null")
    d = d.withColumn("_d", F.when(F.col("_d") < threshold, 0.0).otherwise(F.col("_d")))
    x0, x1, y0, y1 = region
    edges = [[int(x) for x in np.linspace(int(a * size), int(b * size), n + 1)] for a, b, size, n in ((y0, y1, height, rows), (x0, x1, width, cols))]

    def cell(c: str, e: list[int]):
        return sum((F.when(F.col(c) >= x, 1).otherwise(0) for x in e[1:-1]), F.lit(0))

    for c, e in zip("rc", edges):
        d = d.where((F.col(c) >= e[0]) & (F.col(c) < e[-1]))
    return d.groupBy("frame", cell("r", edges[0]).alias("row"), cell("c", edges[1]).alias("col")).agg(F.avg("_d").alias("motion"))


def grid_heat(motion: DataFrame) -> DataFrame:
    """row, col, heat: the mean of each cell over time."""
    return motion.groupBy("row", "col").agg(F.avg("motion").alias("heat"))


def standardised(df: DataFrame, descriptors: list[str], rank: bool = True, by: str | None = None) -> DataFrame:
    """The descriptors as z-scores (of their ranks, ties sharing the mean) within each group; null where they are, or where a group does not vary."""
    from .geometry import average_rank

    group = [by] if by else []
    out = df
    for c in descriptors:
        v = c
        if rank:
            out = average_rank(out.withColumn("_g", F.concat_ws("/", *[F.col(g).cast("string") for g in group], F.col(c).isNull().cast("string"))), c, "_g").withColumn(c, F.when(F.col(c).isNotNull(), F.col("rank").cast("double"))).drop("rank", "_g")
        w = Window.partitionBy(*(group or [F.lit(0)]))
        out = out.withColumn(c, ratio(F.col(v) - F.avg(v).over(w), F.stddev_samp(v).over(w)))
    return out


def descriptor_correlations(df: DataFrame, descriptors: list[str], rank: bool = True, by: str | None = None) -> DataFrame:
    """a, b, r, n of each pair of descriptors that vary, over the rows that have all of those: one row of moments, as wide as there are pairs."""
    z = standardised(df, descriptors, rank, by)
    have = z.agg(*[F.count(c).alias(c) for c in descriptors]).first()
    used = [c for c in descriptors if have[c]]
    z = z.where(" and ".join(f"`{c}` is not null" for c in used) or "false")
    spread = z.agg(*[F.stddev_samp(c).alias(c) for c in used]).first() if used else {}
    used = [c for c in used if spread[c]]
    pairs = [(a, b) for k, a in enumerate(used) for b in used[k:]]
    if len(used) < 2:
        raise ValueError("two descriptors that vary are needed")
    one = z.agg(F.count("*").alias("n"), *[ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"_{k}") for k, (a, b) in enumerate(pairs)])
    every = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{k}").alias("r")) for k, (a, b) in enumerate(pairs)])).alias("e")
    return one.select("n", every).select("e.a", "e.b", "e.r", "n")


def effective_dimensionality(df: DataFrame, descriptors: list[str], rank: bool = True, by: str | None = None) -> dict:
    """How many independent dimensions the descriptors span: shares of the components, how many make 80 and 90 %, and the participation ratio.

    The correlations are a Spark job; their eigenvalues, as many as there are descriptors, are taken on the driver.
    """
    rows = descriptor_correlations(df, descriptors, rank, by).collect()
    names = sorted({r["a"] for r in rows} | {r["b"] for r in rows})
    m = np.eye(len(names))
    for r in rows:
        m[names.index(r["a"]), names.index(r["b"])] = m[names.index(r["b"]), names.index(r["a"])] = r["r"]
    return spectrum_of(m) | {"n_observations": rows[0]["n"], "n_descriptors": len(names), "n_dropped": len(descriptors) - len(names)}


def spectrum_of(correlations: np.ndarray) -> dict:
    """Shares of the eigenvalues of a correlation matrix, counts for 80 and 90 %, and the participation ratio."""
    lam = np.sort(np.linalg.eigvalsh(correlations))[::-1].clip(0)
    share = lam / lam.sum()
    upto = np.cumsum(share)
    return {"variance_fraction": share.tolist(), "n_for_80": int(np.searchsorted(upto, 0.8) + 1), "n_for_90": int(np.searchsorted(upto, 0.9) + 1), "participation_ratio": float(lam.sum() ** 2 / (lam**2).sum())}


def normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))
