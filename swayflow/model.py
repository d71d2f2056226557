"""Constants and table shapes.

samples: id, i, t, x, y, z   (one row per frame of a marker; gaps are null)
channels: id, i, t, v        (one row per sample of a channel)
series: id, x (array<double>)  (kernel form)
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bands in Hz, acceleration of gravity, millimetres of a metre, rates, floors.
BANDS = {"standing": (0.2, 5.0), "wideband": (0.2, 10.0), "noresp": (0.45, 5.0), "optical_legacy": (None, 10.0)}
G, MM_PER_M, COMMON_RATE, HARMONISED_RATE = 9.80665, 1000.0, 20.0, 100.0
CARDIAC_BAND, RESPIRATORY_BAND, TOTAL_BAND = (0.7, 2.2), (0.1, 0.5), (0.1, 8.0)
EDGE_FACTORS = (0.7, 0.85, 1.0, 1.15, 1.3)
HUMAN_FLOOR_MM_S, BOARD_MM, Y_UP = 1.0, (433.0, 238.0), "Y"


def along(*order: str) -> Window:
    return Window.partitionBy("id").orderBy(*(order or ("i",)))


def wholly(*order: str) -> Window:
    return along(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def norm(*cols: str) -> Column:
    return F.sqrt(sum((F.col(c) * F.col(c) for c in cols[1:]), F.col(cols[0]) * F.col(cols[0])))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 (ANSI mode raises otherwise)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def pearson(a: str, b: str) -> Column:
    """Correlation of two columns, null where one does not vary (`corr` raises there in ANSI mode)."""
    return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def runs(df: DataFrame, flag: Column, name: str = "run") -> DataFrame:
    """Numbers the runs of equal flags along i within each id (gaps and islands)."""
    df = df.withColumn("_f", flag)
    change = F.when(F.equal_null("_f", F.lag("_f").over(along())), 0).otherwise(1)
    df = df.withColumn("_c", change)
    return df.withColumn(name, F.sum("_c").over(along().rowsBetween(Window.unboundedPreceding, 0))).withColumnRenamed("_f", f"{name}_flag").drop("_c")


def to_series(df: DataFrame, *cols: str) -> DataFrame:
    """One row per id with an array per column, in the order of i: the form kernels take. The only shuffle a kernel query needs. A series must fit into a row (2 GB) and into the memory of the task that holds it; what is longer has the relational operators."""
    packed = df.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", *cols))).alias("_s"))
    return packed.select("id", *[F.transform(F.col("_s"), _field(c)).alias(c) for c in cols])


def _field(c: str):
    def pick(e: Column) -> Column:
        return e[c]

    return pick


@dataclass
class Recording:
    """One recording as an array of samples x channels, for kernels; `frame` gives it as rows."""

    data: np.ndarray = field(repr=False)
    fs: float
    channels: list[str]
    kind: str = "position"
    unit: str = "mm"
    vertical: str = "Z"
    t: np.ndarray | None = field(default=None, repr=False)
    t0: object | None = None
    source: str = ""
    meta: dict = field(default_factory=dict)

    def __post_init__(self):
        self.data = np.asarray(self.data, float)
        if self.data.ndim == 1:
            self.data = self.data.reshape(-1, 1)
        if self.data.shape[1] != len(self.channels):
            raise ValueError(f"{self.data.shape[1]} columns, but {len(self.channels)} channel names: {self.source}")

    @property
    def n_samples(self) -> int:
        return len(self.data)

    @property
    def duration_s(self) -> float:
        return self.n_samples / self.fs

    @property
    def markers(self) -> list[str]:
        """The channels' names without their axis, in order."""
        return list(dict.fromkeys(c.rpartition(" ")[0] or c for c in self.channels))

    def marker(self, name: str) -> np.ndarray:
        """The columns of one marker, found by name."""
        mine = [(c.rpartition(" ")[0] or c) == name for c in self.channels]
        if not any(mine):
            raise KeyError(f"no marker {name!r} among {self.markers}: {self.source}")
        return self.data[:, mine]

    def missing_fraction(self) -> float:
        return float(np.isnan(self.data).mean())

    def qom(self, **options) -> dict:
        from .operators.kernels import qom

        return qom(self.data, self.fs, **{"kind": self.kind, "unit": self.unit, **options})

    def frame(self, spark) -> DataFrame:
        """id (the source), channel, i, t, v: one row per sample of a channel, gaps null."""
        t = np.arange(self.n_samples) / self.fs if self.t is None else np.asarray(self.t, float)
        rows = [(self.source, c, k, float(t[k]), None if np.isnan(v) else float(v)) for c, column in zip(self.channels, self.data.T) for k, v in enumerate(column)]
        return spark.createDataFrame(rows, "id string, channel string, i long, t double, v double")
