"""Units, steps and envelopes of channels; all relational."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import G, along, norm, pearson, ratio, wholly

#: Units of acceleration by the size of gravity in them, in the order they are tried.
GRAVITY = {"g": 1.0, "mg": 1000.0, "m/s^2": G}


def _real(v: str) -> Column:
    """The value, null where it is not a finite number."""
    c = F.col(v).cast("double")
    return F.when(F.isnotnull(c) & ~F.isnan(c) & (F.abs(c) != float("inf")), c)


def acceleration_unit(df: DataFrame, tol: float = 0.25, strict: bool = False) -> DataFrame:
    """id, median norm and the unit in which that norm is near gravity; null (strict: an error) where it is near none.

    df: id, x, y, z. Rows with a null or non-finite axis are left out of the median.
    """
    d = df.select("id", *[_real(c).alias(c) for c in "xyz"])
    out = d.groupBy("id").agg(F.median(norm("x", "y", "z")).alias("norm"))
    near = [F.when(F.abs(F.col("norm") - size) <= tol * size, F.lit(unit)) for unit, size in GRAVITY.items()]
    unit = F.coalesce(*near)
    if strict:
        unit = F.coalesce(unit, F.raise_error(F.concat(F.lit("no unit fits the median norm "), F.coalesce(F.col("norm").cast("string"), F.lit("null")))).cast("string"))
    return out.withColumn("unit", unit)


def channel_resolution(df: DataFrame, need: float | None = None) -> DataFrame:
    """id, levels, span, step and ratio (need / step) of each channel.

    The step is the median of the gaps between neighbouring distinct values that lie in the
    fullest of 4 to 64 bins (as many as gaps) of equal width, both ends included; of equally
    full bins the lowest. One level only: step 0; no finite value: no row. df: id, v.
    """
    levels = df.select("id", _real("v").alias("v")).where("v is not null").distinct()
    gaps = levels.withColumn("d", F.col("v") - F.lag("v").over(along("v")))
    whole = gaps.groupBy("id").agg(F.count("*").alias("levels"), (F.max("v") - F.min("v")).alias("span"), F.min("d").alias("least"), F.max("d").alias("most"))
    bins = F.greatest(F.lit(4), F.least(F.lit(64), F.col("levels") - 1))
    width = (F.col("most") - F.col("least")) / F.col("_bins")
    # One shuffle by id serves the window above and everything below it: the limits are taken over the id, not joined.
    over = wholly("v")
    g = gaps.withColumns({"levels": F.count("*").over(over), "least": F.min("d").over(over), "most": F.max("d").over(over)}).where("d is not null")
    g = g.withColumn("_bins", bins).withColumn("_bin", F.when(F.col("most") > F.col("least"), F.least(F.floor((F.col("d") - F.col("least")) / width), F.col("_bins") - 1)).otherwise(F.lit(0)).cast("long"))
    full = g.groupBy("id", "_bin", "least", "most", "_bins").agg(F.count("*").alias("_n"))
    modal = full.groupBy("id").agg(F.max_by(F.struct("_bin", "least", "most", "_bins"), F.struct("_n", -F.col("_bin"))).alias("_m")).select("id", "_m._bin", "_m.least", "_m.most", "_m._bins")
    low = F.col("least") + F.col("_bin") * width
    high = F.when(F.col("_bin") == F.col("_bins") - 1, F.col("most")).otherwise(F.col("least") + (F.col("_bin") + 1) * width)
    edges = modal.select("id", low.alias("_lo"), F.when(F.col("most") > F.col("least"), high).otherwise(F.col("most")).alias("_hi"))
    step = g.select("id", "d").join(edges, "id").where((F.col("d") >= F.col("_lo")) & (F.col("d") <= F.col("_hi"))).groupBy("id").agg(F.median("d").alias("step"))
    out = whole.join(step, "id", "left").select("id", "levels", "span", F.coalesce("step", F.lit(0.0)).alias("step"))
    if need is None:
        return out.withColumn("ratio", F.lit(None).cast("double"))
    return out.withColumn("ratio", F.coalesce(ratio(F.lit(float(need)), F.col("step")), F.lit(float("inf"))))


def compare_envelopes(a: DataFrame, b: DataFrame, fs_a: float, fs_b: float) -> DataFrame:
    """id, n, r: Pearson correlation of two envelopes averaged per whole second.

    A second holds round(fs) samples; samples that are null or not finite are left out of its
    mean, seconds without any are left out of the comparison. Below three common seconds, or
    where a side does not vary, r is null. a, b: id, i, v.
    """

    def seconds(df: DataFrame, fs: float, name: str) -> DataFrame:
        step = max(1, round(fs))
        # The samples of a channel are numbered from 0, so its last number tells how many whole seconds there are.
        d = df.select("id", F.floor(F.col("i") / step).alias("s"), "i", _real("v").alias("v"))
        each = d.groupBy("id", "s").agg(F.avg("v").alias(name), F.max("i").alias("_i"))
        last = each.groupBy("id").agg(F.floor((F.max("_i") + 1) / F.lit(float(fs))).alias("_whole"))
        return each.join(last, "id").where((F.col("s") < F.col("_whole")) & F.col(name).isNotNull()).select("id", "s", name)

    both = seconds(a, fs_a, "a").join(seconds(b, fs_b, "b"), ["id", "s"])
    return both.groupBy("id").agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, pearson("a", "b")).alias("r"))
