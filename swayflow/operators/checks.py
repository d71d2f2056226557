"""Validation: each check gives finding rows (id, check, severity, message); relational only."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import HUMAN_FLOOR_MM_S, along, ratio, runs
from . import kernels

FINDING = "id, check, severity, message"


def finding(df: DataFrame, when: Column, check: str, severity: str | Column, message: Column) -> DataFrame:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return df.where(when).select(F.col("id").cast("string").alias("id"), F.lit(check).alias("check"), sev.alias("severity"), message.alias("message"))


def three_places(x: Column) -> Column:
    """As C's %.3f writes it, by the exact binary value; format_string rounds the shortest decimal half up, so 0.0625 would become 0.063."""
    return F.call_function("format_number", x, F.lit("0.000"))


def zero_triplets(df: DataFrame, max_fraction: float = 0.0) -> DataFrame:
    """Rows at exactly 0, 0, 0 are gaps in disguise."""
    zero = F.coalesce((F.col("x") == 0) & (F.col("y") == 0) & (F.col("z") == 0), F.lit(False))
    d = runs(df, zero).groupBy("id", "run", "run_flag").agg(F.count("*").alias("n"))
    hit = F.when(F.col("run_flag"), F.col("n"))
    m = d.groupBy("id").agg(F.coalesce(F.sum(hit), F.lit(0)).alias("zeros"), F.sum("n").alias("n"), F.coalesce(F.max(hit), F.lit(0)).alias("longest"))
    return finding(m, F.col("zeros") > F.col("n") * max_fraction, "zero_triplets", "error", F.format_string("%d of %d rows are zero in all axes, at most %d in a row", "zeros", "n", "longest"))


def finite_fraction(df: DataFrame, least: float = 0.8) -> DataFrame:
    m = df.groupBy("id").agg(F.avg(F.when(F.col("v").isNotNull(), 1.0).otherwise(0.0)).alias("f"))
    return finding(m, F.col("f") < least, "finite_fraction", F.when(F.col("f") == 0, "error").otherwise("warning"), F.format_string("%s of the samples are there", three_places(F.col("f"))))


def findings(df: DataFrame, cases: list[tuple[Column, str, str | Column, Column]]) -> DataFrame:
    """A finding row for each case (when, check, severity, message) that holds of a row; one pass over df."""
    made = [F.when(when, F.struct(F.lit(check).alias("check"), (F.lit(sev) if isinstance(sev, str) else sev).alias("severity"), message.alias("message"))) for when, check, sev, message in cases]
    return df.select(F.col("id").cast("string").alias("id"), F.explode(F.array_compact(F.array(*made))).alias("f")).select("id", "f.check", "f.severity", "f.message")


def timestamps(df: DataFrame) -> DataFrame:
    d = df.withColumn("dt", F.col("t") - F.lag("t").over(along()))
    m = d.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("dt") < 0).alias("back"), F.count_if(F.col("dt") == 0).alias("same"), F.max("dt").alias("gap"), F.median(F.when(F.col("dt") > 0, F.col("dt"))).alias("mid"))
    return findings(m, [
        (F.col("n") < 2, "timestamps", "error", F.lit("fewer than two stamps")),
        (F.col("back") > 0, "timestamps", "error", F.format_string("%d stamps go back", "back")),
        (F.col("same") > 0, "timestamps", "warning", F.format_string("%d stamps repeat", "same")),
        (F.col("gap") > 20 * F.col("mid"), "timestamps", "warning", F.lit("a gap is over 20 times the usual step")),
    ])


def rate_agreement(df: DataFrame, documented_hz: float, tolerance: float = 0.02) -> DataFrame:
    m = df.groupBy("id").agg(ratio(F.count("*") - 1, F.max_by("t", "i") - F.min_by("t", "i")).alias("fs"))
    return finding(m, F.abs(F.col("fs") - documented_hz) > tolerance * documented_hz, "rate_agreement", "error", F.format_string("measured %s Hz", three_places(F.col("fs"))))


def held_runs(df: DataFrame) -> DataFrame:
    """Longest run of equal values of each id."""
    d = df.where("v is not null")
    return runs(d, F.col("v")).groupBy("id", "run").agg(F.count("*").alias("n")).groupBy("id").agg(F.max("n").alias("longest"))


def held_samples(df: DataFrame, max_run: int = 50) -> DataFrame:
    return finding(held_runs(df), F.col("longest") > max_run, "held_samples", "warning", F.format_string("a value is held for %d samples", "longest"))


def frame_count(df: DataFrame) -> DataFrame:
    m = df.groupBy("id").agg(F.count("*").alias("n"))
    return finding(m, F.col("n").isin(65535, 65536), "frame_count", "error", F.format_string("%d frames: the file may be cut off", "n"))


def implausible_position(df: DataFrame, low: float = 0.3, high: float = 2.5, least: float = 500.0) -> DataFrame:
    mid = df.where("v is not null").groupBy("id").agg(F.median("v").alias("mid"), F.count("*").alias("n"))
    d = df.join(mid.where((F.col("n") >= 100) & (F.col("mid") >= least)), "id")
    m = d.groupBy("id").agg(F.count_if((F.col("v") < low * F.col("mid")) | (F.col("v") > high * F.col("mid"))).alias("out"))
    return finding(m, F.col("out") > 0, "implausible_position", "error", F.format_string("%d samples are far from the median", "out"))


def marker_average(df: DataFrame, max_gap: float = 0.5) -> DataFrame:
    """id, marker, v: markers without data bias an average; markers with many gaps are told."""
    m = df.groupBy("id", "marker").agg(F.count("v").alias("have"), F.count("*").alias("n"))
    dead = m.groupBy("id").agg(F.count_if(F.col("have") == 0).alias("dead"), F.count("*").alias("all"))
    a = finding(dead, F.col("dead") > 0, "marker_average", "error", F.format_string("%d of %d markers are dead: an average is low by the factor %s", "dead", "all", three_places((F.col("all") - F.col("dead")) / F.col("all"))))
    b = finding(m, (F.col("have") > 0) & (F.col("n") - F.col("have") > max_gap * F.col("n")), "marker_average", "warning", F.format_string("marker %s is mostly gaps", "marker"))
    return a.unionByName(b)


def edge_levels(df: DataFrame, fs: float, edge_s: float = 10.0, baseline_s: tuple[float, float] = (60.0, 300.0)) -> DataFrame:
    """Median speed of the first and last seconds and of the baseline."""
    t = F.col("i") / F.lit(fs)
    last = F.max("i").over(Window.partitionBy("id"))
    d = df.withColumns({"_t": t, "_e": (last - F.col("i")) / F.lit(fs)})
    return d.groupBy("id").agg(*[F.median(F.when(c, F.col("v"))).alias(n) for n, c in (("head", F.col("_t") < edge_s), ("tail", F.col("_e") < edge_s), ("base", (F.col("_t") >= baseline_s[0]) & (F.col("_t") < baseline_s[1])))])


def edge_motion(df: DataFrame, fs: float, factor: float = 2.0, **kw) -> DataFrame:
    m = edge_levels(df, fs, **kw)
    return findings(m, [(F.col(e) > factor * F.col("base"), "edge_motion", "warning", F.lit(f"the {e} moves more than the baseline")) for e in ("head", "tail")])


def settling_time(df: DataFrame, fs: float, baseline_s=(60.0, 300.0), factor=1.5, window_s=5.0, max_s=120.0) -> DataFrame:
    """Seconds at each end until a window's median is at most factor times the baseline's; max_s if none is."""
    w = max(1, round(fs * window_s))
    base = edge_levels(df, fs, baseline_s=baseline_s).select("id", "base")
    n = F.max("i").over(Window.partitionBy("id"))
    out = None
    for side, k in (("head_s", F.col("i")), ("tail_s", n - F.col("i"))):
        d = df.withColumn("_k", F.floor(k / w)).groupBy("id", "_k").agg(F.median("v").alias("m"), F.count("*").alias("c")).where((F.col("c") == w) & (F.col("_k") < max_s * fs / w))
        d = d.join(base, "id").groupBy("id").agg(F.coalesce(F.min(F.when(F.col("m") <= factor * F.col("base"), F.col("_k"))) * w / F.lit(fs), F.lit(max_s)).alias(side))
        out = d if out is None else out.join(d, "id")
    return out


def duplicate_contents(files: DataFrame) -> DataFrame:
    """path, content (binaryFile): groups of equal files, by hash, counted with partial sums."""
    d = files.select("path", F.sha2("content", 256).alias("sha"))
    many = d.groupBy("sha").agg(F.count("*").alias("n"), F.min("path").alias("id")).where("n > 1")
    return finding(many, F.lit(True), "duplicate_files", "error", F.format_string("%d files have the same content", "n"))


def marker_noise(series: DataFrame, fs: float, max_ratio: float = 5.0) -> DataFrame:
    """Markers whose raw path is far longer than their motion within the band (an error), or whose gaps leave nothing to check (a warning). series: id, x, y, z in mm."""
    kernel = _position_kernel(lambda p: kernels.marker_noise(p, fs, max_ratio))
    m = kernels.apply(series, kernel, ["x", "y", "z"], "ratio double, noisy boolean, unchecked boolean, n_used long")
    return findings(m, [
        (F.col("noisy"), "marker_noise", "error", F.format_string("the raw path is %.1f times the motion within the band, over %d samples", "ratio", "n_used")),
        (F.col("unchecked"), "marker_noise", "warning", F.lit("gaps leave no run of 50 samples: the marker is unchecked")),
    ])


def too_still(series: DataFrame, fs: float, floor: float = HUMAN_FLOOR_MM_S) -> DataFrame:
    """Markers that move less than a body does: equipment. series: id, x, y, z in mm."""

    def still(p):
        p = p[np.isfinite(p).all(1)]
        return {"speed": kernels.qom(p, fs, kind="position")["median"]} if len(p) >= 50 else {}

    m = kernels.apply(series, _position_kernel(still), ["x", "y", "z"], "speed double")
    return findings(m, [(F.col("speed") < floor, "too_still", "error", F.format_string("the median speed of %.3f mm/s is no body's", "speed"))])


def _position_kernel(f):
    return lambda x, y, z: f(np.column_stack([x, y, z]))


def validate_series(df: DataFrame, documented_hz: float | None = None, least: float = 0.8, expect_positions: bool = True) -> DataFrame:
    """All checks of a table id, i, v (and t: the clock; x, y, z: positions); those are left out whose columns it lacks."""
    parts = [frame_count(df), finite_fraction(df, least), held_samples(df)]
    if expect_positions and {"x", "y", "z"} <= set(df.columns):
        parts.append(zero_triplets(df))
    if "t" in df.columns:
        parts.append(timestamps(df))
        if documented_hz:
            parts.append(rate_agreement(df, documented_hz))
    return reduce(DataFrame.unionByName, parts)


def errors(findings: DataFrame) -> DataFrame:
    return findings.where("severity = 'error'")


def raise_on_error(findings: DataFrame) -> None:
    """One ValueError that lists all errors; they are read in parts, so the message is all that the driver holds."""
    lines = [f"[{r['severity']}] {r['id']}: {r['check']} — {r['message']}" for r in errors(findings).orderBy("id", "check", "message").toLocalIterator()]
    if lines:
        raise ValueError(f"{len(lines)} errors:\n" + "\n".join(lines))
