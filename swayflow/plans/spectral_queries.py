"""Spectral operators on the driver's tables: each embedding is a signal of 64 samples at 32 Hz, its spectrum one segment; SQL takes the Fourier sums by a join."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signal
from ..model import to_series
from ..operators import kernels
from .queries import V, points, query, rounded, signals

FS = 32.0
LINES = """, l AS (SELECT id, regr_slope(v, i) AS b, regr_intercept(v, i) AS a FROM s GROUP BY id), d AS (SELECT s.id, i, v - a - b * i AS v FROM s JOIN l USING (id))"""
MEANS = """, d AS (SELECT id, i, v - avg(v) OVER (PARTITION BY id) AS v FROM s)"""
POWER = """, c AS (SELECT id, k, sum(v * (0.5 - 0.5 * cos(2 * pi() * i / 64)) * cos(2 * pi() * k * i / 64)) ** 2 + sum(v * (0.5 - 0.5 * cos(2 * pi() * i / 64)) * sin(2 * pi() * k * i / 64)) ** 2 AS e FROM d, (SELECT unnest(range(0, 33)) AS k) GROUP BY id, k),
w AS (SELECT id, k / 2.0 AS f, e / (32 * 24.0) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS p FROM c)"""
SPECTRUM, PLAIN = V + LINES + POWER, V + MEANS + POWER



def of(spark, d, kernel, schema):
    return kernels.apply(signals(spark, d), kernel, ["x"], schema).drop("warnings")


TRAPEZOIDS = """, t AS (SELECT id, band, sum((p + q) / 2 * (g - f)) AS a FROM (SELECT w.id, band, f, p, lead(f) OVER z AS g, lead(p) OVER z AS q FROM w JOIN (VALUES {bands}) b(band, lo, hi, closed) ON f >= lo AND (f < hi OR (closed AND f = hi)) WINDOW z AS (PARTITION BY w.id, band ORDER BY f)) WHERE g IS NOT NULL GROUP BY id, band)"""


@query(SPECTRUM + TRAPEZOIDS.format(bands="('a', 2, 9, true)") + " SELECT id, round(a, 6) AS power FROM t")
def q_band_power(spark, d):
    return rounded(of(spark, d, lambda x: {"power": kernels.band_power(x, FS, (2.0, 9.0))}, "power double"))


@query(SPECTRUM + """ SELECT id, round(sum(f * p) / sum(p), 6) AS mean_hz FROM w WHERE f BETWEEN 1 AND 12 GROUP BY id""")
def q_mean_frequency(spark, d):
    return rounded(of(spark, d, lambda x: {"mean_hz": kernels.mean_frequency(x, FS, (1.0, 12.0))}, "mean_hz double"))


@query(SPECTRUM + TRAPEZOIDS.format(bands="('nc', 2, 6, true), ('dc', 1, 12, true), ('nh', 2, 6, false), ('dh', 1, 12, false)") + """,
u AS (SELECT id, sum(p) FILTER (f >= 2 AND f <= 6) / sum(p) FILTER (f >= 1 AND f <= 12) AS sum_closed, sum(p) FILTER (f >= 2 AND f < 6) / sum(p) FILTER (f >= 1 AND f < 12) AS sum_half_open FROM w GROUP BY id)
SELECT id, round(max(a) FILTER (band = 'nc') / max(a) FILTER (band = 'dc'), 6) AS trapezoid_closed, round(max(a) FILTER (band = 'nh') / max(a) FILTER (band = 'dh'), 6) AS trapezoid_half_open, round(max(sum_closed), 6) AS sum_closed, round(max(sum_half_open), 6) AS sum_half_open FROM t JOIN u USING (id) GROUP BY id""")
def q_band_share(spark, d):
    ways = [(r, i) for r in kernels.RULES for i in kernels.INTERVALS]

    def kernel(x):
        return {f"{r}_{i}": kernels.band_share(x, FS, (2.0, 6.0), (1.0, 12.0), integrate=r, interval=i) for r, i in ways}

    return rounded(of(spark, d, kernel, ", ".join(f"{r}_{i} double" for r, i in ways)))


@query(SPECTRUM + TRAPEZOIDS.format(bands="('slow', 1, 4, true), ('fast', 4, 12, true), ('all', 0, 16, true)") + """ SELECT id, round(max(a) FILTER (band = 'slow') / max(a) FILTER (band = 'all'), 6) AS slow, round(max(a) FILTER (band = 'fast') / max(a) FILTER (band = 'all'), 6) AS fast FROM t GROUP BY id""")
def q_band_power_fraction(spark, d):
    return rounded(of(spark, d, lambda x: kernels.band_power_fraction(x, FS, {"slow": (1.0, 4.0), "fast": (4.0, 12.0)}), "slow double, fast double"))


@query(PLAIN + """ SELECT id, round(sum(p) FILTER (f >= 1 AND f < 4) / sum(p) FILTER (f >= 0.5 AND f < 12), 6) AS slow, round(sum(p) FILTER (f >= 4 AND f < 12) / sum(p) FILTER (f >= 0.5 AND f < 12), 6) AS fast FROM w GROUP BY id""")
def q_spectral_fractions(spark, d):
    return rounded(of(spark, d, lambda x: kernels.spectral_band_fractions(x, FS, {"slow": (1.0, 4.0), "fast": (4.0, 12.0)}, (0.5, 12.0)), "slow double, fast double"))


@query(PLAIN + """ SELECT id, arg_max(f, p) AS dominant_hz FROM w WHERE f BETWEEN 0.5 AND 10 GROUP BY id""")
def q_dominant_frequency(spark, d):
    return of(spark, d, lambda x: {"dominant_hz": kernels.dominant_frequency(x, FS, (0.5, 10.0))}, "dominant_hz double")


@query(SPECTRUM + """, c2 AS (SELECT id, f, sum(p) OVER (PARTITION BY id ORDER BY f) / sum(p) OVER (PARTITION BY id) AS c FROM w), g AS (SELECT id, f, c, lag(f) OVER z AS f0, lag(c) OVER z AS c0 FROM c2 WINDOW z AS (PARTITION BY id ORDER BY f)),
h AS (SELECT id, e, min_by(CASE WHEN f0 IS NULL THEN f ELSE f0 + (f - f0) * (e - c0) / (c - c0) END, f) AS x FROM g, (VALUES (0.5), (0.95)) t(e) WHERE c >= e GROUP BY id, e)
SELECT id, round(max(x) FILTER (e = 0.5), 6) AS median_hz, round(max(x) FILTER (e = 0.95), 6) AS edge_hz FROM h GROUP BY id""")
def q_spectral_edges(spark, d):
    return rounded(of(spark, d, lambda x: dict(zip(("median_hz", "edge_hz"), kernels.spectral_edges(x, FS))), "median_hz double, edge_hz double"))


@query(SPECTRUM + """, b AS (SELECT id, f, p, lag(p) OVER z AS p0, lead(p) OVER z AS p1 FROM w WHERE f BETWEEN 1 AND 12 WINDOW z AS (PARTITION BY id ORDER BY f)),
r AS (SELECT id, regr_slope(ln(p), ln(f)) AS s, regr_intercept(ln(p), ln(f)) AS a, median(p) AS mid, max(p) AS top FROM b GROUP BY id)
SELECT id, f AS freq, round(p, 6) AS power, round(p / mid, 4) AS snr, round(p / exp(a + s * ln(f)), 4) AS excess, coalesce(p > p0 AND p > p1 AND p / exp(a + s * ln(f)) >= 2, false) AS is_peak FROM b JOIN r USING (id) WHERE p = top""")
def q_spectral_peak(spark, d):
    got = of(spark, d, lambda x: kernels.peak_from_spectrum(*kernels.spectrum(x, FS), (1.0, 12.0), require_peak=False), "freq double, power double, snr double, excess double, is_peak boolean")
    return got.select("id", "freq", F.round("power", 6).alias("power"), F.round("snr", 4).alias("snr"), F.round("excess", 4).alias("excess"), "is_peak")


PAIRS = V + """, t AS (SELECT id, 0.2 * stddev_pop(v) AS r FROM s GROUP BY id), x2 AS (SELECT a.id, a.i, a.v AS v0, b.v AS v1, c.v AS v2 FROM s a LEFT JOIN s b ON a.id = b.id AND b.i = a.i + 1 LEFT JOIN s c ON a.id = c.id AND c.i = a.i + 2),
p AS (SELECT a.id, a.i, b.i AS j, abs(a.v0 - b.v0) <= r AND abs(a.v1 - b.v1) <= r AS m2, abs(a.v0 - b.v0) <= r AND abs(a.v1 - b.v1) <= r AND abs(a.v2 - b.v2) <= r AS m3 FROM x2 a JOIN x2 b ON a.id = b.id JOIN t ON t.id = a.id)"""


@query(PAIRS + """, n AS (SELECT id, count(*) FILTER (m2 AND i < 62 AND j < 62 AND i <> j) AS b, count(*) FILTER (m3 AND i < 62 AND j < 62 AND i <> j) AS a FROM p GROUP BY id),
c AS (SELECT id, i, count(*) FILTER (m2 AND j < 63) / 63.0 AS c2, count(*) FILTER (m3 AND j < 62) / 62.0 AS c3 FROM p GROUP BY id, i),
h AS (SELECT id, avg(ln(c2)) FILTER (i < 63) - avg(ln(nullif(c3, 0))) FILTER (i < 62) AS apen FROM c GROUP BY id)
SELECT id, CASE WHEN a > 0 AND b > 0 THEN round(-ln(a / b), 5) END AS sampen, round(apen, 5) AS apen FROM n JOIN h USING (id)""")
def q_entropy(spark, d):
    return rounded(of(spark, d, lambda x: {"sampen": kernels.sampen(x), "apen": kernels.apen(x)}, "sampen double, apen double"), 5)


@query(V + """, e AS (SELECT a.id, a.i, a.v AS x, b.v AS y, c.v AS z FROM s a JOIN s b ON a.id = b.id AND b.i = a.i + 2 JOIN s c ON a.id = c.id AND c.i = a.i + 4),
p AS (SELECT a.id, a.i, b.i - a.i AS k, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM e a JOIN e b ON a.id = b.id AND b.i > a.i),
q AS (SELECT id, quantile_cont(d, 0.05) AS eps, count(*) AS n FROM p GROUP BY id), h AS (SELECT p.id, k, i, i - row_number() OVER (PARTITION BY p.id, k ORDER BY i) AS g FROM p JOIN q USING (id) WHERE d <= eps),
l AS (SELECT id, k, g, count(*) AS m FROM h GROUP BY ALL), t AS (SELECT id, m, count(*) AS c FROM l WHERE m >= 2 GROUP BY ALL), u AS (SELECT *, c / sum(c) OVER (PARTITION BY id) AS w FROM t),
v AS (SELECT id, sum(m * c) AS inside, max(m) AS lmax, sum(m * w) AS lmean, -sum(w * ln(w)) AS entr FROM u GROUP BY id), hits AS (SELECT id, count(*) AS hits FROM h GROUP BY id)
SELECT id, round(hits / n, 6) AS rr, round(coalesce(inside, 0) / hits, 5) AS det, coalesce(lmax, 0) AS lmax, round(coalesce(lmean, 0), 5) AS lmean, round(coalesce(entr, 0), 5) + 0 AS entr FROM q JOIN hits USING (id) LEFT JOIN v USING (id)""")
def q_recurrence(spark, d):
    got = of(spark, d, lambda x: {k.lower(): v for k, v in kernels.rqa(x, tau=2).items()}, "rr double, det double, lmax long, lmean double, entr double")
    return rounded(got, 5).drop("rr").join(got.select("id", F.round("rr", 6).alias("rr")), "id")


SWAY = """WITH p AS (SELECT l_suppkey AS id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount) - 1 AS i, l_quantity::DOUBLE AS x, (l_extendedprice / 1000)::DOUBLE AS y FROM lineitem), n AS (SELECT id, count(*) AS n FROM p GROUP BY id)"""


@query(SWAY + """, s AS (SELECT id, sum(sqrt((x - x0) ** 2 + (y - y0) ** 2)) AS path FROM (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM p WINDOW w AS (PARTITION BY id ORDER BY i)) GROUP BY id),
g AS (SELECT p.id, p.x, p.y FROM p),
a AS (SELECT id, count(*) AS n, pi() * -2 * ln(0.05) * sqrt(greatest(var_samp(x) * var_samp(y) - covar_samp(x, y) ** 2, 0)) AS area95, max(x) - min(x) AS ml_range, max(y) - min(y) AS ap_range, stddev_samp(x) AS ml_sd, stddev_samp(y) AS ap_sd FROM g GROUP BY id),
t AS (SELECT n.id, k, k / 128.0 AS t, count(*) OVER (PARTITION BY n.id) AS m FROM n, LATERAL (SELECT unnest(range(0, (2 * (n.n - 1))::BIGINT)) AS k)),
u AS (SELECT t.id, k, m, a.x + (b.x - a.x) * (k % 2) / 2.0 AS x, a.y + (b.y - a.y) * (k % 2) / 2.0 AS y FROM t JOIN p a ON a.id = t.id AND a.i = k // 2 JOIN p b ON b.id = t.id AND b.i = k // 2 + 1),
l AS (SELECT id, m, k, x - (regr_slope(x, k) OVER z * k + regr_intercept(x, k) OVER z) AS x, y - (regr_slope(y, k) OVER z * k + regr_intercept(y, k) OVER z) AS y FROM u WINDOW z AS (PARTITION BY id)),
h AS (SELECT id, m, k, x * (0.5 - 0.5 * cos(2 * pi() * k / m)) AS x, y * (0.5 - 0.5 * cos(2 * pi() * k / m)) AS y FROM l),
f AS (SELECT id, m, j, j * 128.0 / m AS f, sum(x * cos(2 * pi() * j * k / m)) ** 2 + sum(x * sin(2 * pi() * j * k / m)) ** 2 AS px, sum(y * cos(2 * pi() * j * k / m)) ** 2 + sum(y * sin(2 * pi() * j * k / m)) ** 2 AS py FROM h, LATERAL (SELECT unnest(range(0, 5 * m // 128 + 2)) AS j) GROUP BY id, m, j),
q AS (SELECT id, sum(f * px) / sum(px) AS mf_ml, sum(f * py) / sum(py) AS mf_ap FROM f WHERE f BETWEEN 0.1 AND 5 GROUP BY id)
SELECT id, n, round((n - 1) / 64.0, 4) AS dur, 64.0::DOUBLE AS fs_mean, round(path, 3) AS path_len, round(path * 64 / (n - 1), 3) AS path_rate, round(area95, 3) AS area95, round(ml_range, 4) AS ml_range, round(ap_range, 4) AS ap_range, round(ml_sd, 4) AS ml_sd, round(ap_sd, 4) AS ap_sd,
 round(ap_range / ml_range, 4) AS ap_ml_range_ratio, round(ap_sd / ml_sd, 4) AS ap_ml_sd_ratio, round(mf_ml, 4) AS mf_ml, round(mf_ap, 4) AS mf_ap, round((mf_ml + mf_ap) / 2, 4) AS mf_mean FROM a JOIN s USING (id) JOIN q USING (id)""")
def q_cop_sway(spark, d):
    """The fifteen figures of each supplier's points as a path at 64 Hz."""
    names = ["dur", "fs_mean", "path_len", "path_rate", "area95", "ml_range", "ap_range", "ml_sd", "ap_sd", "ap_ml_range_ratio", "ap_ml_sd_ratio", "mf_ml", "mf_ap", "mf_mean"]
    got = kernels.apply(to_series(points(spark, d), "x", "y"), lambda x, y: kernels.cop_sway_metrics(x, y, fs=64.0, resample_fs=128.0), ["x", "y"], "n long, " + ", ".join(f"{n} double" for n in names)).drop("warnings")
    return got.select("id", "n", *[F.round(n, 3 if n in ("path_len", "path_rate", "area95") else 4).alias(n) for n in names])


WELCH = V + """, g AS (SELECT id, j, i - 16 * j AS u, v - avg(v) OVER (PARTITION BY id, j) AS v FROM s, (SELECT unnest(range(0, 3)) AS j) WHERE i >= 16 * j AND i < 16 * j + 32),
h AS (SELECT id, j, u, v * (0.5 - 0.5 * cos(2 * pi() * u / 32)) AS v FROM g),
c AS (SELECT id, j, k, sum(v * cos(2 * pi() * k * u / 32)) ** 2 + sum(v * sin(2 * pi() * k * u / 32)) ** 2 AS e FROM h, (SELECT unnest(range(0, 17)) AS k) GROUP BY id, j, k),
w AS (SELECT id, k::DOUBLE AS f, avg(e) / (32 * 12.0) * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END AS p FROM c GROUP BY id, k)"""


@query(WELCH + " SELECT id, f, round(p, 6) AS p FROM w")
def q_welch_spectrum(spark, d):
    got = of(spark, d, lambda x: dict(zip("fp", signal.welch(x, FS, 32))), "f array<double>, p array<double>")
    return rounded(got.select("id", F.explode(F.arrays_zip("f", "p")).alias("e")).select("id", "e.f", "e.p"))


@query(V + """, x AS (SELECT id, list(v ORDER BY i) AS v FROM s GROUP BY id), l AS (SELECT a.id, k, list_transform(range(greatest(0, k), least(64, 64 + k)), lambda j: a.v[j + 1]) AS p, list_transform(range(greatest(0, -k), least(64, 64 - k)), lambda j: list_reverse(a.v)[j + 1]) AS q FROM x a, (SELECT unnest(range(-8, 9)) AS k)),
r AS (SELECT id, k, len(p) AS n, (list_inner_product(p, q) / len(p) - list_avg(p) * list_avg(q)) / (list_stddev_pop(p) * list_stddev_pop(q)) AS r FROM l)
SELECT id, arg_max(-k, r)::DOUBLE AS lag_s, round(max(r), 6) AS r, arg_max(n, r) AS n_overlap, max(r) >= 0.5 AS confident FROM r GROUP BY id""")
def q_search_lag(spark, d):
    """The shift of each signal against itself read backwards: no lag is built in, and a mistake of sign shows."""
    import numpy as np

    def kernel(x):
        t = np.arange(len(x) + 1.0)
        return kernels.search_lag(t, np.r_[x, x[-1]], t, np.r_[x[::-1], x[0]], 8.0, 1.0, 50.0)

    return rounded(of(spark, d, kernel, "lag_s double, r double, n_overlap long, confident boolean"))


@query(V + """, x AS (SELECT id, i, v - lag(v) OVER (PARTITION BY id ORDER BY i) AS d, v * v - lag(v * v) OVER (PARTITION BY id ORDER BY i) AS e FROM s),
z AS (SELECT id, i, (d - avg(d) OVER w) / stddev_pop(d) OVER w AS a, (e - avg(e) OVER w) / stddev_pop(e) OVER w AS b, count(*) OVER w AS n FROM x WHERE d IS NOT NULL WINDOW w AS (PARTITION BY id)),
r AS (SELECT a.id, l.lag, sum(a.a * b.b) / max(a.n) AS r FROM z a, (SELECT unnest(range(-6, 7)) AS lag) l JOIN z b ON a.id = b.id AND b.i = a.i + l.lag GROUP BY a.id, l.lag)
SELECT id, arg_max(lag, r)::DOUBLE AS lag_s, round(max(r), 6) AS r, max(r) >= 0.5 AS reliable FROM r GROUP BY id""")
def q_xcorr_lag(spark, d):
    return rounded(of(spark, d, lambda x: kernels.xcorr_lag(x, x * x, 1.0, 6.0), "lag_s double, r double, reliable boolean"))


@query(V + """, c AS (SELECT id, i, v - avg(v) OVER w AS a, v * v - avg(v * v) OVER w AS b FROM s WINDOW w AS (PARTITION BY id)),
f AS (SELECT id, k, sum(a * cos(2 * pi() * k * i / 64)) AS ac, sum(a * sin(2 * pi() * k * i / 64)) AS sa, sum(b * cos(2 * pi() * k * i / 64)) AS bc, sum(b * sin(2 * pi() * k * i / 64)) AS sb FROM c, (SELECT unnest(range(1, 32)) AS k) GROUP BY id, k),
h AS (SELECT f.id, i, sum(ac * sin(2 * pi() * k * i / 64) - sa * cos(2 * pi() * k * i / 64)) / 32 AS ai, sum(bc * sin(2 * pi() * k * i / 64) - sb * cos(2 * pi() * k * i / 64)) / 32 AS bi FROM f, (SELECT unnest(range(0, 64)) AS i) GROUP BY f.id, i),
p AS (SELECT id, atan2(ai, a) - atan2(bi, b) AS d FROM h JOIN c USING (id, i))
SELECT id, round(sqrt(avg(cos(d)) ** 2 + avg(sin(d)) ** 2), 5) AS plv, round(atan2(avg(sin(d)), avg(cos(d))), 4) + 0 AS phase FROM p GROUP BY id""")
def q_phase_locking(spark, d):
    got = of(spark, d, lambda x: kernels.plv(x, x * x), "plv double, phase double")
    return got.select("id", F.round("plv", 5).alias("plv"), (F.round("phase", 4) + 0.0).alias("phase"))
