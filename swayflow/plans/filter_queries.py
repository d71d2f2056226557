"""Zero-phase filters and the speeds made with them on the driver's tables.

The SQL runs each filter as it is defined: the series is extended at both ends by its odd mirror
image, every section is a recursion over the samples, forwards and then backwards, begun in the
steady state of its first value. Only the sections' coefficients are taken from the design, which
tests hold against published gains.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import signal
from ..model import to_series
from ..operators import kernels
from .queries import P, V, points, query, rounded, signals

FS = 32.0


def passes(name: str, source: str, stages: list[tuple], pad: int) -> str:
    """CTEs that filter `source` (id, i, v) by stages (b, a) into `name`."""
    out = [f"""{name}_n AS (SELECT id, max(i) + 1 AS n, arg_min(v, i) AS v0, arg_max(v, i) AS v1 FROM {source} GROUP BY id)""",
           f"""{name}_0 AS (SELECT id, i + {pad} AS k, v FROM {source} UNION ALL SELECT id, {pad} - i, 2 * v0 - v FROM {source} JOIN {name}_n USING (id) WHERE i BETWEEN 1 AND {pad} UNION ALL SELECT id, {pad} + 2 * (n - 1) - i, 2 * v1 - v FROM {source} JOIN {name}_n USING (id) WHERE i BETWEEN n - 1 - {pad} AND n - 2)"""]
    last = f"{name}_0"
    for way in range(2):
        gain, begin = 1.0, last
        for k, (b, a) in enumerate(stages):
            b, a = ([x / a[0] for x in c] for c in (b, a))
            n = len(a) - 1
            z = [repr(float(x * gain)) for x in signal.steady(np.array(b), np.array(a))]
            now = f"{name}_{way}{k}"

            def states(y: str, before: list[str], b=b, a=a, n=n) -> str:
                """What is kept of a sample: the next sample's sums."""
                return ", ".join(f"{float(b[j])!r} * v - {float(a[j])!r} * ({y})" + (f" + {before[j]}" if j < n else "") for j in range(1, n + 1))

            first, later = f"{float(b[0])!r} * v + {z[0]} * lvl", f"{float(b[0])!r} * v + s1"
            names = ", ".join(f"s{j}" for j in range(1, n + 1))
            out.append(f"""{now}r(id, k, y, {names}) AS (SELECT id, k, {first}, {states(first, [f"{x} * lvl" for x in z])} FROM {last} JOIN (SELECT id, v AS lvl FROM {begin} WHERE k = 0) USING (id) WHERE k = 0
 UNION ALL SELECT x.id, x.k, {later}, {states(later, [f"s{j}" for j in range(1, n + 1)])} FROM {now}r r JOIN {last} x ON x.id = r.id AND x.k = r.k + 1)""")
            out.append(f"{now} AS (SELECT id, k, y AS v FROM {now}r)")
            last, gain = now, gain * sum(b) / sum(a)
        out.append(f"{name}_b{way} AS (SELECT id, n + {2 * pad - 1} - k AS k, v FROM {last} JOIN {name}_n USING (id))")
        last = f"{name}_b{way}"
    out.append(f"{name} AS (SELECT id, k - {pad} AS i, v FROM {last} JOIN {name}_n USING (id) WHERE k BETWEEN {pad} AND n + {pad - 1})")
    return ", ".join(out)


def sos(name: str, source: str, sections: tuple) -> str:
    # As many samples as three times the order of the whole filter, less the taps at its end that are zero.
    pad = 3 * (2 * len(sections) + 1 - min(sum(abs(b[2]) < 1e-14 for b, _ in sections), sum(abs(a[2]) < 1e-14 for _, a in sections)))
    return passes(name, source, list(sections), pad)


def filtered(spark, d, f):
    got = kernels.apply(signals(spark, d), lambda x: {"y": f(x)}, ["x"], "y array<double>")
    return rounded(got.select("id", F.posexplode("y").alias("i", "v")).select("id", F.col("i").cast("long").alias("i"), "v"))


S = "WITH RECURSIVE " + V.removeprefix("WITH ")
VALUES = " SELECT id, i::BIGINT AS i, round(v, 6) AS v FROM y"


@query(S + ", " + sos("y", "s", signal.sections(4, 0.5, 5.0, FS)) + VALUES)
def q_bandpass(spark, d):
    return filtered(spark, d, lambda x: signal.bandpass(x, FS, 0.5, 5.0))


@query(S + ", " + sos("y", "s", signal.sections(4, None, 5.0, FS)) + VALUES)
def q_lowpass(spark, d):
    return filtered(spark, d, lambda x: signal.lowpass(x, FS, 5.0))


@query(S + ", " + sos("y", "s", signal.sections(4, 1.0, None, FS)) + VALUES)
def q_highpass(spark, d):
    return filtered(spark, d, lambda x: signal.highpass(x, FS, 1.0))


def notch_stage(fs: float, f0: float, q: float) -> tuple:
    """Zeros on the unit circle at f0, poles behind them, gain 1 far from it."""
    w = 2 * np.pi * f0 / fs
    g = 1 / (1 + np.tan(w / q / 2))
    return (g, -2 * g * np.cos(w), g), (1.0, -2 * g * np.cos(w), 2 * g - 1)


@query(S + ", " + passes("y", "s", [notch_stage(FS, 4.0, 6.0)], 9) + VALUES)
def q_notch(spark, d):
    return filtered(spark, d, lambda x: signal.notch(x, FS, 4.0))


BAND = signal.sections(4, 0.2, 4.95, 10.0)


def velocity(axis: str) -> str:
    """CTEs from p to `d2<axis>`: band-limited, five-point differences, band-limited again."""
    return f"""s{axis} AS (SELECT id, i, {axis}::DOUBLE AS v FROM p), {sos(f"f{axis}", f"s{axis}", BAND)},
w{axis} AS (SELECT id, i, (lag(v, 2) OVER o - 8 * lag(v) OVER o + 8 * lead(v) OVER o - lead(v, 2) OVER o) * 10 / 12 AS v, count(*) OVER (PARTITION BY id) AS n FROM f{axis} WINDOW o AS (PARTITION BY id ORDER BY i)),
d{axis} AS (SELECT a.id, a.i, b.v FROM w{axis} a JOIN w{axis} b ON a.id = b.id AND b.i = least(greatest(a.i, 2), a.n - 3)), {sos(f"d2{axis}", f"d{axis}", BAND)}"""


SPEED = "WITH RECURSIVE " + P.removeprefix("WITH ") + ", " + ", ".join(velocity(a) for a in "xyz") + """, v AS (SELECT id, i, sqrt(x.v ** 2 + y.v ** 2 + z.v ** 2) AS v FROM d2x x JOIN d2y y USING (id, i) JOIN d2z z USING (id, i))"""


@query(SPEED + """ SELECT id, round(avg(v), 4) AS mean, round(median(v), 4) AS median, count(*) AS n_samples, 400::BIGINT AS edge_samples FROM v GROUP BY id""")
def q_qom_position(spark, d):
    """Flagship: quantity of motion of each supplier's points as one series."""

    def kernel(x, y, z):
        got = kernels.qom(np.column_stack([x, y, z]), 10.0, kind="position")
        return {k: got[k] for k in ("mean", "median", "n_samples", "edge_samples")}

    got = kernels.apply(to_series(points(spark, d), "x", "y", "z"), kernel, ["x", "y", "z"], "mean double, median double, n_samples long, edge_samples long")
    return rounded(got.drop("warnings"), 4)


@query(S + ", " + sos("y", "s", signal.sections(4, 1.0, 6.0, FS)) + " SELECT id, round(sqrt(avg(v * v)), 6) AS rms FROM y GROUP BY id")
def q_band_rms(spark, d):
    return rounded(kernels.apply(signals(spark, d), lambda x: {"rms": kernels.band_rms(x, FS, (1.0, 6.0))}, ["x"], "rms double").drop("warnings"))


@query(S + ", " + sos("a", "s", signal.sections(4, 0.5, 5.0, FS)) + ", c AS (SELECT id, i, sum(v) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) / 32 AS v FROM a), " + sos("y", "c", signal.sections(4, 0.5, 5.0, FS)) + " SELECT id, i::BIGINT AS i, round(abs(v) * 1000, 4) AS v FROM y")
def q_speed_from_acceleration(spark, d):
    got = kernels.apply(signals(spark, d), lambda x: {"y": kernels.norm(kernels.velocity_from_acceleration(x, FS, lo=0.5, hi=5.0))}, ["x"], "y array<double>")
    return rounded(got.select("id", F.posexplode("y").alias("i", "v")).select("id", F.col("i").cast("long").alias("i"), "v"), 4)


@query(S + ", " + passes("y", "s", [signal.polynomial(2, 0.5, 6.0, FS)], 15) + ", v AS (SELECT id, abs(v - lag(v) OVER (PARTITION BY id ORDER BY i)) * 32 AS v FROM y) SELECT id, round(avg(v), 5) AS mean, count(v) AS n FROM v GROUP BY id")
def q_older_speed(spark, d):
    def kernel(x):
        speed, _ = kernels.band_limited_qom(x[:, None], FS, 0.5, 6.0, 2)
        return {"mean": speed.mean(), "n": len(speed)}

    return rounded(kernels.apply(signals(spark, d), kernel, ["x"], "mean double, n long").drop("warnings"), 5)


@query(S + ", " + passes("a", "s", [signal.polynomial(2, 1.0, None, FS)], 9) + ", c AS (SELECT id, i, sum(v) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) / 32 AS v FROM a), " + passes("y", "c", [signal.polynomial(2, 1.0, None, FS)], 9) + " SELECT id, round(avg(abs(v)), 6) AS mean FROM y GROUP BY id")
def q_accel_to_speed(spark, d):
    return rounded(kernels.apply(signals(spark, d), lambda x: {"mean": kernels.accel_to_speed(x[:, None], FS, 1.0).mean()}, ["x"], "mean double").drop("warnings"))
