"""Clocks, gaps, bins and events of series; all relational, no Python in the path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import along, pearson, ratio, runs, wholly


def measured_rate(df: DataFrame) -> DataFrame:
    """(n - 1) / (last - first time) of each id; null below two samples or without progress."""
    span = F.max_by("t", "i") - F.min_by("t", "i")
    return df.groupBy("id").agg(F.when(span > 0, ratio(F.count("*") - 1, span)).alias("rate_hz"), F.count("*").alias("n"))


def rate_quality(df: DataFrame) -> DataFrame:
    """Rate, jitter, gaps and coverage of each clock; sums and counts only, no series is gathered."""
    d = df.withColumn("dt", F.col("t") - F.lag("t").over(along()))
    span = F.max_by("t", "i") - F.min_by("t", "i")
    out = d.groupBy("id").agg(
        ratio(F.count("*") - 1, span).alias("measured_rate_hz"), F.count("*").alias("n_samples"), span.alias("duration_s"), ratio(F.stddev_pop("dt"), F.avg("dt")).alias("jitter_cv"),
        F.max("dt").alias("max_gap_s"), F.count_if(F.col("dt") == 0).alias("n_duplicate_t"), F.count_if(F.col("dt") < 0).alias("n_backward_t"),
    )
    near = d.join(out.select("id", "measured_rate_hz"), "id").groupBy("id").agg(F.coalesce(F.sum(F.when(F.col("dt") <= F.try_divide(F.lit(5.0), F.col("measured_rate_hz")), F.col("dt"))), F.lit(0.0)).alias("_near"))
    return out.join(near, "id").withColumns({"gap_ratio": F.col("max_gap_s") * F.col("measured_rate_hz"), "coverage": ratio(F.col("_near"), F.col("duration_s"))}).drop("_near")


def regularize(df: DataFrame, fs: float, max_gap_s: float | None = None) -> DataFrame:
    """id, k, t, v on a uniform grid from the first time, end excluded; linear between samples, null strictly inside gaps over max_gap_s.

    Each interval between samples makes its own grid points, so nothing is joined.
    """
    first = Window.partitionBy("id", "t").orderBy("i")
    d = df.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    w = along("t")
    d = d.withColumns({"t1": F.lead("t").over(w), "v1": F.lead("v").over(w), "t0": F.min("t").over(Window.partitionBy("id")), "tn": F.max("t").over(Window.partitionBy("id"))}).where("t1 is not null")
    n = F.ceil((F.col("tn") - F.col("t0")) * fs)
    lo = F.ceil((F.col("t") - F.col("t0")) * fs)
    hi = F.least(F.ceil((F.col("t1") - F.col("t0")) * fs), n) - 1
    d = d.withColumn("k", F.explode(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))))
    at = F.col("t0") + F.col("k") / F.lit(float(fs))
    v = F.col("v") + (F.col("v1") - F.col("v")) * (at - F.col("t")) / (F.col("t1") - F.col("t"))
    if max_gap_s is not None:
        v = F.when((F.col("t1") - F.col("t") > max_gap_s) & (at > F.col("t")) & (at < F.col("t1")), None).otherwise(v)
    return d.select("id", "k", at.alias("t"), v.alias("v"))


def interpolate_gaps(df: DataFrame, max_gap: int = 200) -> DataFrame:
    """Fills runs of at most max_gap nulls that have values on both sides, linearly in i.

    The value after a gap is found as the one before it, in falling order: frames that grow from
    the start cost one pass, frames that shrink to the end would cost the square of the rows.
    """
    up = along().rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("id").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    k = F.row_number().over(along())
    some = F.when(F.col("v").isNotNull(), F.struct("i", "v", F.col("_k").alias("k")))
    d = df.withColumn("_k", k).withColumn("_a", F.last(some, True).over(up)).withColumn("_b", F.last(some, True).over(down))
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("i") - F.col("_a.i")) / (F.col("_b.i") - F.col("_a.i"))
    fits = F.col("v").isNull() & (F.col("_b.k") - F.col("_a.k") - 1 <= max_gap)
    return d.withColumn("v", F.when(fits, line).otherwise(F.col("v"))).drop("_k", "_a", "_b")


def gap_report(df: DataFrame, fs: float) -> DataFrame:
    d = runs(df, F.col("v").isNull())
    per = d.groupBy("id", "run", "run_flag").agg(F.count("*").alias("n"))
    gap = F.when(F.col("run_flag"), F.col("n"))
    return per.groupBy("id").agg(ratio(F.coalesce(F.sum(gap), F.lit(0)), F.sum("n")).alias("missing_frac"), F.count(gap).alias("n_gaps"), (F.coalesce(F.max(gap), F.lit(0)) / F.lit(fs)).alias("longest_gap_s"), (F.median(gap) / F.lit(fs)).alias("median_gap_s"))


def longest_finite_span(df: DataFrame) -> DataFrame:
    """start and length of the first longest run of values."""
    per = runs(df, F.col("v").isNull()).where("not run_flag").groupBy("id", "run").agg(F.min("i").alias("start"), F.count("*").alias("length"))
    return per.groupBy("id").agg(F.max_by(F.struct("start", "length"), F.struct("length", -F.col("start"))).alias("s")).select("id", "s.start", "s.length")


def segments(df: DataFrame, gap_s: float = 1.0) -> DataFrame:
    """Parts of a clock without a step over gap_s: id, segment, n, t0, t1."""
    jump = F.when(F.col("t") - F.lag("t").over(along()) > gap_s, 1).otherwise(0)
    d = df.withColumn("_j", jump).withColumn("segment", F.sum("_j").over(along().rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy("id", "segment").agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))


def bin_series(df: DataFrame, fs: float, bin_s: float = 1.0) -> DataFrame:
    """Means of full bins of max(1, round(fs * bin_s)) samples; fewer than two bins give none."""
    step = max(1, round(fs * bin_s))
    per = df.groupBy("id", F.floor(F.col("i") / step).alias("bin")).agg(F.avg("v").alias("mean"), F.count("*").alias("n")).where(F.col("n") == step)
    return per.withColumn("_k", F.count("*").over(Window.partitionBy("id"))).where("_k >= 2").select("id", "bin", "mean")


def binned(df: DataFrame, fs: float, bin_s: float = 5.0, edge_samples: int = 0) -> DataFrame:
    """Mean and count per bin of time, marked where a bin is partial or within the filter's transient."""
    n_edge = max(1, -(-edge_samples // max(1, int(bin_s * fs))))
    per = df.groupBy("id", F.floor(F.col("i") / F.lit(fs) / F.lit(bin_s)).alias("bin")).agg(F.avg("v").alias("mean"), F.count("*").alias("n"))
    up, down = along("bin"), Window.partitionBy("id").orderBy(F.desc("bin"))
    edge = F.when(F.col("n") < round(bin_s * fs), "partial").when((F.row_number().over(up) <= n_edge) | (F.row_number().over(down) <= n_edge), "filter_transient").otherwise("ok")
    return per.withColumns({"edge": edge, "time_s": F.col("bin") * F.lit(float(bin_s))})


def derivative(df: DataFrame, fs: float) -> DataFrame:
    """Five-point central difference of v; the two rows at each end repeat the nearest, short series use two points."""
    w = along()

    inner = (F.lag("v", 2).over(w) - 8 * F.lag("v", 1).over(w) + 8 * F.lead("v", 1).over(w) - F.lead("v", 2).over(w)) * fs / 12
    short = F.when(F.lag("i").over(w).isNull(), (F.lead("v").over(w) - F.col("v")) * fs).when(F.lead("i").over(w).isNull(), (F.col("v") - F.lag("v").over(w)) * fs).otherwise((F.lead("v").over(w) - F.lag("v").over(w)) * fs / 2)
    d = df.withColumns({"_n": F.count("*").over(Window.partitionBy("id")), "_k": F.row_number().over(w), "_d": inner, "_s": short})
    edge = F.when(F.col("_k") <= 2, F.max(F.when(F.col("_k") == 3, F.col("_d"))).over(Window.partitionBy("id"))).when(F.col("_k") > F.col("_n") - 2, F.max(F.when(F.col("_k") == F.col("_n") - 2, F.col("_d"))).over(Window.partitionBy("id"))).otherwise(F.col("_d"))
    return d.withColumn("dv", F.when(F.col("_n") < 5, F.col("_s")).otherwise(edge)).drop("_n", "_k", "_d", "_s")


def event_train(df: DataFrame, fs: float, frame_s: float = 1.0, threshold: float | None = None, kind: str = "increase") -> DataFrame:
    """event = 1 where v rises (kind decrease: falls) by the threshold (else the standard deviation of all rises) over a frame, ends held."""
    if kind not in ("increase", "decrease"):
        raise ValueError("kind is increase or decrease")
    h = max(1, round(frame_s * fs / 2))
    w, all_ = along(), wholly()
    d = df.withColumn("_d", F.coalesce(F.lead("v", h).over(w), F.last("v").over(all_)) - F.coalesce(F.lag("v", h).over(w), F.first("v").over(all_)))
    bound = F.lit(threshold) if threshold is not None else F.stddev_pop("_d").over(Window.partitionBy("id"))
    return d.withColumn("event", F.when(F.col("_d") * (1 if kind == "increase" else -1) >= bound, 1).otherwise(0)).drop("_d")


def sequential_stability(df: DataFrame) -> DataFrame:
    return df.where("v is not null").withColumn("_d", F.abs(F.col("v") - F.lag("v").over(along()))).groupBy("id").agg(F.median("_d").alias("stability"))


def channel_rate(df: DataFrame) -> DataFrame:
    """(1 + changes of value) / duration: the rate of a channel whose values are held."""
    d = df.withColumn("_c", F.when(F.col("v") != F.lag("v").over(along()), 1).otherwise(0))
    return d.groupBy("id").agg(ratio(1 + F.sum("_c"), F.max_by("t", "i") - F.min_by("t", "i")).alias("channel_rate_hz"))


def binned_correlation(a: DataFrame, b: DataFrame, step_a: int, step_b: int) -> DataFrame:
    """Pearson r of two series averaged per second (`step` samples); null below three common seconds."""

    def per(df, step, name):
        return df.groupBy("id", F.floor(F.col("i") / step).alias("s")).agg(F.avg("v").alias(name), F.count("*").alias("_n")).where(F.col("_n") == step).drop("_n")

    both = per(a, step_a, "a").join(per(b, step_b, "b"), ["id", "s"])
    return both.groupBy("id").agg(F.when(F.count("*") >= 3, pearson("a", "b")).alias("r"), F.count("*").alias("n"))


def apply_lag(df: DataFrame, lag_s: float) -> DataFrame:
    """The clock moved by a lag."""
    return df.withColumn("t", F.col("t") + F.lit(float(lag_s)))


def lag_products(a: DataFrame, b: DataFrame, max_lag: int) -> DataFrame:
    """Cross-correlation of two z-scored, differenced series (as in `kernels.xcorr_lag`); positive lag: b is later.

    The series meet once, by row; the lags are looked up in one sorted window, so rows are not multiplied by lags before a shuffle.
    """

    def scored(df, z, n):
        d = df.withColumn("_d", F.col("v") - F.lag("v").over(along())).where("_d is not null")
        w = Window.partitionBy("id")
        return d.select("id", "i", ((F.col("_d") - F.avg("_d").over(w)) / (F.stddev_pop("_d").over(w) + 1e-12)).alias(z), F.count("*").over(w).alias(n))

    both = scored(a, "za", "na").join(scored(b, "zb", "nb"), ["id", "i"], "full")
    w = along()
    # The rows of both clocks are numbered alike and without holes, so a lag of rows is a lag of i.
    products = both.select("id", "na", "nb", *[(F.col("za") * (F.lead("zb", k) if k >= 0 else F.lag("zb", -k)).over(w)).alias(f"_{k + max_lag}") for k in range(-max_lag, max_lag + 1)])
    sums = products.groupBy("id").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), *[F.sum(f"_{k}").alias(f"_{k}") for k in range(2 * max_lag + 1)])
    every = F.explode(F.array(*[F.struct(F.lit(k - max_lag).alias("lag"), F.col(f"_{k}").alias("s")) for k in range(2 * max_lag + 1)])).alias("e")
    return sums.select("id", "na", "nb", every).where("e.s is not null").select("id", F.col("e.lag").alias("lag"), (F.col("e.s") / F.least("na", "nb")).alias("r"))
