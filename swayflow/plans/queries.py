"""The operators on the driver's tables: events as irregular series, lineitem as point clouds, orders as daily and directional series, embeddings as uniform signals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import signal
from ..model import to_series
from ..operators import channels, geometry, kernels, scaling, timing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*[(F.round(c, places) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def events(spark: SparkSession, d: str) -> DataFrame:
    """id, i, t (seconds), v of each user's events in the order of time."""
    e = spark.read.parquet(f"{d}/events.parquet")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("id"), (F.row_number().over(w) - 1).cast("long").alias("i"), t.alias("t"), F.col("value").alias("v"))


def points(spark: SparkSession, d: str) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    return li.select(F.col("l_suppkey").alias("id"), (F.row_number().over(w) - 1).cast("long").alias("i"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"))


def signals(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    return signals(spark, d).select("id", F.posexplode("x").alias("i", "v")).withColumn("i", F.col("i").cast("long"))


SCALES = [4, 5, 6, 8, 10, 12]
E = """WITH e AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, epoch_us(ts) / 1e6 AS t, value AS v FROM events)"""
P = """WITH p AS (SELECT l_suppkey AS id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount) - 1 AS i, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z FROM lineitem)"""
V = """WITH s AS (SELECT vec_id AS id, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"""


@query(E + " SELECT id, round((count(*) - 1) / nullif(max(t) - min(t), 0), 6) AS rate_hz, count(*) AS n FROM e GROUP BY id")
def q_measured_rate(spark, d):
    return rounded(timing.measured_rate(events(spark, d)))


@query(E + """, x AS (SELECT *, t - lag(t) OVER (PARTITION BY id ORDER BY i) AS dt FROM e),
m AS (SELECT id, (count(*) - 1) / (max(t) - min(t)) AS fs, count(*) AS n, max(t) - min(t) AS dur, stddev_pop(dt) / avg(dt) AS cv, max(dt) AS gap, count(*) FILTER (dt = 0) AS dup, count(*) FILTER (dt < 0) AS back FROM x GROUP BY id)
SELECT m.id, round(fs, 6) AS measured_rate_hz, n AS n_samples, round(dur, 6) AS duration_s, round(cv, 6) AS jitter_cv, round(gap, 6) AS max_gap_s, round(gap * fs, 6) AS gap_ratio, dup AS n_duplicate_t, back AS n_backward_t,
 round((SELECT coalesce(sum(dt), 0) FROM x WHERE x.id = m.id AND dt <= 5 / fs) / dur, 6) AS coverage FROM m""")
def q_rate_quality(spark, d):
    return rounded(timing.rate_quality(events(spark, d)))


@query(E + """, x AS (SELECT *, lead(t) OVER w AS t1, lead(v) OVER w AS v1, min(t) OVER (PARTITION BY id) AS t0, max(t) OVER (PARTITION BY id) AS tn FROM e WINDOW w AS (PARTITION BY id ORDER BY i)),
g AS (SELECT *, unnest(range(ceil((t - t0) / 3600)::BIGINT, least(ceil((t1 - t0) / 3600), ceil((tn - t0) / 3600))::BIGINT)) AS k FROM x WHERE t1 IS NOT NULL)
SELECT id, k, round(t0 + k * 3600, 4) AS t, CASE WHEN t1 - t > 86400 AND t0 + k * 3600 > t AND t0 + k * 3600 < t1 THEN NULL ELSE round(v + (v1 - v) * (t0 + k * 3600 - t) / (t1 - t), 4) END AS v FROM g""")
def q_regularize(spark, d):
    return rounded(timing.regularize(events(spark, d), 1 / 3600, 86400.0), 4)


@query(E + """, x AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY id ORDER BY i) > 86400 THEN 1 ELSE 0 END AS j FROM e), y AS (SELECT *, sum(j) OVER (PARTITION BY id ORDER BY i) AS s FROM x)
SELECT id, s::BIGINT AS segment, count(*) AS n, round(min(t), 4) AS t0, round(max(t), 4) AS t1 FROM y GROUP BY id, s""")
def q_segments(spark, d):
    return rounded(timing.segments(events(spark, d), 86400.0), 4)


def gappy(spark, d):
    return events(spark, d).withColumn("v", F.when(F.col("i") % 7 < 2, None).otherwise(F.col("v")))


@query(E + """, g AS (SELECT id, i, CASE WHEN i % 7 < 2 THEN NULL ELSE v END AS v FROM e),
h AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ia, last_value(v IGNORE NULLS) OVER b AS va, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ib, first_value(v IGNORE NULLS) OVER a AS vb FROM g
 WINDOW b AS (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT id, i, round(CASE WHEN v IS NOT NULL THEN v WHEN ia IS NULL OR ib IS NULL THEN NULL ELSE va + (vb - va) * (i - ia) / (ib - ia) END, 6) AS v FROM h""")
def q_interpolate_gaps(spark, d):
    return rounded(timing.interpolate_gaps(gappy(spark, d), 5).select("id", "i", "v"))


@query(E + """, g AS (SELECT id, i, i % 7 < 2 AS f FROM e), r AS (SELECT *, i - row_number() OVER (PARTITION BY id, f ORDER BY i) AS grp FROM g), n AS (SELECT id, f, grp, count(*) AS n FROM r GROUP BY ALL)
SELECT id, round(coalesce(sum(n) FILTER (f), 0) / sum(n), 6) AS missing_frac, count(*) FILTER (f) AS n_gaps, round(coalesce(max(n) FILTER (f), 0)::DOUBLE, 6) AS longest_gap_s, round(median(n) FILTER (f), 6) AS median_gap_s FROM n GROUP BY id""")
def q_gap_report(spark, d):
    return rounded(timing.gap_report(gappy(spark, d), 1.0))


@query(E + """, r AS (SELECT id, i, i - row_number() OVER (PARTITION BY id ORDER BY i) AS grp FROM e WHERE i % 7 >= 2), n AS (SELECT id, min(i) AS start, count(*) AS length FROM r GROUP BY id, grp)
SELECT id, start, length FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length DESC, start) AS k FROM n) WHERE k = 1""")
def q_longest_span(spark, d):
    return timing.longest_finite_span(gappy(spark, d))


@query(V + """, b AS (SELECT id, i // 8 AS bin, avg(v) AS mean, count(*) AS n FROM s GROUP BY ALL) SELECT id, bin::BIGINT AS bin, round(mean, 6) AS mean FROM b WHERE n = 8""")
def q_bin_series(spark, d):
    return rounded(timing.bin_series(samples(spark, d), 32.0, 0.25))


@query(V + """, b AS (SELECT id, floor(i / 32.0 / 0.3)::BIGINT AS bin, avg(v) AS mean, count(*) AS n FROM s GROUP BY ALL)
SELECT id, bin, round(mean, 6) AS mean, n, CASE WHEN n < 10 THEN 'partial' WHEN row_number() OVER (PARTITION BY id ORDER BY bin) <= 2 OR row_number() OVER (PARTITION BY id ORDER BY bin DESC) <= 2 THEN 'filter_transient' ELSE 'ok' END AS edge, round(bin * 0.3, 6) AS time_s FROM b""")
def q_binned(spark, d):
    return rounded(timing.binned(samples(spark, d), 32.0, 0.3, 18))


@query(V + """, w AS (SELECT *, (lag(v, 2) OVER w - 8 * lag(v) OVER w + 8 * lead(v) OVER w - lead(v, 2) OVER w) * 32 / 12 AS d FROM s WINDOW w AS (PARTITION BY id ORDER BY i))
SELECT a.id, a.i, round(b.d, 6) AS dv FROM w a JOIN w b ON a.id = b.id AND b.i = least(greatest(a.i, 2), 61)""")
def q_derivative(spark, d):
    return rounded(timing.derivative(samples(spark, d), 32.0).select("id", "i", "dv"))


@query(V + """, x AS (SELECT id, i, coalesce(lead(v, 2) OVER w, last_value(v) OVER f) - coalesce(lag(v, 2) OVER w, first_value(v) OVER f) AS d FROM s
 WINDOW w AS (PARTITION BY id ORDER BY i), f AS (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT id, sum(CASE WHEN d >= sd THEN 1 ELSE 0 END)::BIGINT AS n_events FROM (SELECT *, stddev_pop(d) OVER (PARTITION BY id) AS sd FROM x) GROUP BY id""")
def q_event_train(spark, d):
    return timing.event_train(samples(spark, d), 4.0).groupBy("id").agg(F.sum("event").cast("long").alias("n_events"))


@query(E + " SELECT id, round(median(d), 6) AS stability FROM (SELECT id, abs(v - lag(v) OVER (PARTITION BY id ORDER BY i)) AS d FROM e WHERE v IS NOT NULL) GROUP BY id")
def q_sequential_stability(spark, d):
    return rounded(timing.sequential_stability(events(spark, d)))


@query(E + """, x AS (SELECT *, CASE WHEN v <> lag(v) OVER (PARTITION BY id ORDER BY i) THEN 1 ELSE 0 END AS c FROM e) SELECT id, round((1 + sum(c)) / nullif(max(t) - min(t), 0), 9) AS channel_rate_hz FROM x GROUP BY id""")
def q_channel_rate(spark, d):
    return rounded(timing.channel_rate(events(spark, d)), 9)


@query("""WITH q AS (SELECT DISTINCT l_orderkey AS id, l_quantity::DOUBLE AS x, (l_extendedprice / 1000)::DOUBLE AS y FROM lineitem),
e AS (SELECT a.id, a.x AS ax, a.y AS ay, b.x AS qx, b.y AS qy FROM q a JOIN q b ON a.id = b.id AND (a.x, a.y) <> (b.x, b.y)),
t AS (SELECT e.id, ax, ay, qx, qy, (qx - ax) * (c.y - ay) - (qy - ay) * (c.x - ax) AS turn, (c.x - ax) * (c.x - qx) + (c.y - ay) * (c.y - qy) AS inside FROM e JOIN q c ON c.id = e.id),
h AS (SELECT id, ax * qy - qx * ay AS a, max(turn) AS most FROM t GROUP BY id, ax, ay, qx, qy HAVING bool_and(turn > 1e-9 OR (abs(turn) <= 1e-9 AND inside <= 1e-9)))
SELECT id, round(sum(a) / 2, 6) AS area FROM h GROUP BY id HAVING max(most) > 1e-9""")
def q_convex_hull(spark, d):
    """The hull of the lines of each order."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("i"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") / 1000).cast("double").alias("y"))
    got = kernels.apply(to_series(li, "x", "y"), lambda x, y: {"area": kernels.convex_hull_area(zip(x, y))}, ["x", "y"], "area double")
    return rounded(got.where("area > 1e-9").select("id", "area"))


@query(V + """, w AS (SELECT a.id, a.i, sum(b.v * (177 - 15 * (b.i - a.i) ** 2) / 693.0) AS y FROM s a JOIN s b ON a.id = b.id AND abs(b.i - a.i) <= 4 WHERE a.i BETWEEN 4 AND 59 GROUP BY a.id, a.i) SELECT id, i::BIGINT AS i, round(y, 6) AS y FROM w""")
def q_envelope(spark, d):
    """The inner samples of the smoothed signals; the ends are the polynomials of the outermost windows, which tests hold."""
    got = kernels.apply(signals(spark, d), lambda x: {"y": kernels.envelope(x, 32.0, 0.25, False)}, ["x"], "y array<double>")
    return rounded(got.select("id", F.posexplode("y").alias("i", "y")).where("i BETWEEN 4 AND 59").select("id", F.col("i").cast("long").alias("i"), "y"))


@query(P + """, s AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM p WINDOW w AS (PARTITION BY id ORDER BY i)) SELECT id, round(coalesce(sum(d), 0), 4) AS path, round(coalesce(sum(d), 0) * 10 / count(*), 4) AS path_rate FROM s GROUP BY id""")
def q_path_length(spark, d):
    return rounded(geometry.path_length(points(spark, d), 10.0), 4)


@query(P + """ SELECT id, CASE WHEN count(*) >= 3 THEN round(pi() * -2 * ln(0.05) * sqrt(greatest(var_samp(x) * var_samp(y) - covar_samp(x, y) ** 2, 0)), 4) END AS area FROM p GROUP BY id""")
def q_ellipse95(spark, d):
    return rounded(geometry.confidence_ellipse_area(points(spark, d)), 4)


@query(P + """, m AS (SELECT id, count(*) AS n, var_samp(x) AS a, var_samp(y) AS c, covar_samp(x, y) AS b, avg(x) AS mx, avg(y) AS my FROM p GROUP BY id),
l AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l1, greatest((a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b), 0) AS l2, atan2(2 * b, a - c) / 2 AS g FROM m),
r AS (SELECT id, (x - mx) * cos(g) + (y - my) * sin(g) AS u, (y - my) * cos(g) - (x - mx) * sin(g) AS v FROM p JOIN l USING (id)),
q AS (SELECT id, sqrt(avg(u * u + v * v)) AS rr, max(u) - min(u) AS ru, max(v) - min(v) AS rv FROM r GROUP BY id)
SELECT id, n, round(1 - l2 / nullif(l1, 0), 4) AS anisotropy, round(sqrt(l1 / nullif(l2, 0)), 4) AS axis_ratio, round(((degrees(g) % 180) + 180) % 180, 4) AS axis_deg, round(sqrt(l1), 4) AS sd_major, round(sqrt(l2), 4) AS sd_minor, round(rr, 4) AS rms_radius, round(ru, 4) AS range_major, round(rv, 4) AS range_minor FROM l JOIN q USING (id)""")
def q_sway_geometry(spark, d):
    return rounded(geometry.sway_geometry(points(spark, d)), 4)


@query(P + """, m AS (SELECT id, avg(x) AS mx, avg(y) AS my FROM p GROUP BY id) SELECT id, round(quantile_cont(sqrt((x - mx) ** 2 + (y - my) ** 2), 0.95), 4) AS radius FROM p JOIN m USING (id) GROUP BY id""")
def q_dispersion_radius(spark, d):
    return rounded(geometry.dispersion_radius(points(spark, d)), 4)


@query(P + """, m AS (SELECT id, count(*) AS n, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS dispersion, var_samp(x) AS xx, var_samp(y) AS yy, var_samp(z) AS zz, covar_samp(x, y) AS xy, covar_samp(x, z) AS xz, covar_samp(y, z) AS yz FROM p GROUP BY id),
w AS (SELECT id, avg(d) AS within FROM (SELECT id, i // 50 AS k, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS d, count(*) AS n FROM p GROUP BY ALL) WHERE n = 50 GROUP BY id),
v AS (SELECT *, 4.0 / 3 * pi() * power(7.814727903251179, 1.5) * sqrt(greatest(xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz), 0)) AS vol FROM m WHERE n >= 50)
SELECT id, round(dispersion, 3) AS dispersion, round(vol, 3) AS volume, round(power(vol, 1.0 / 3), 3) AS extent, round(within, 3) AS within, round(dispersion / within, 3) AS drift_ratio FROM v JOIN w USING (id)""")
def q_spatial_extent(spark, d):
    return rounded(geometry.spatial_extent(points(spark, d), 50), 3)


@query(P + """, x2 AS (SELECT *, lag(x) OVER (PARTITION BY id ORDER BY i) AS q FROM p) SELECT id, round(avg(CASE WHEN x < 25 THEN 1.0 ELSE 0 END), 6) AS frozen_fraction, round(count(*) FILTER (q < 25 AND x >= 25) * 600.0 / count(*), 6) AS crossings_per_min FROM x2 GROUP BY id""")
def q_sway_texture(spark, d):
    return rounded(geometry.sway_texture(points(spark, d).withColumn("v", F.col("x")), 10.0, 25.0))


def directions(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderpriority").alias("id"), (2 * F.pi() * F.dayofyear(F.col("o_orderdate").cast("date")) / 365.25).alias("angle"), F.col("o_totalprice").alias("v"))


D = """WITH o AS (SELECT o_orderpriority AS id, 2 * pi() * dayofyear(o_orderdate) / 365.25 AS angle, o_totalprice AS v FROM orders)"""


@query(D + " SELECT id, count(*) AS n, round(atan2(avg(sin(angle)), avg(cos(angle))), 6) AS mean, round(sqrt(avg(sin(angle)) ** 2 + avg(cos(angle)) ** 2), 6) AS r FROM o GROUP BY id")
def q_circ_mean(spark, d):
    return rounded(geometry.circ_mean(directions(spark, d)))


@query(D + """, m AS (SELECT id, count(*) AS n, sqrt(avg(sin(2 * angle)) ** 2 + avg(cos(2 * angle)) ** 2) AS r, atan2(avg(sin(2 * angle)), avg(cos(2 * angle))) / 2 AS mean FROM o GROUP BY id)
SELECT id, n, round(r, 6) AS r, round(n * r * r, 6) AS z, round(least(1, exp(sqrt(1 + 4 * n + 4 * (n * n - (n * r) ** 2)) - (1 + 2 * n))), 6) AS p, round(mean, 6) AS mean FROM m""")
def q_rayleigh_axial(spark, d):
    return rounded(geometry.rayleigh(directions(spark, d), True))


@query(D + """, m AS (SELECT id, count(*) AS n, sqrt(avg(sin(angle)) ** 2 + avg(cos(angle)) ** 2) AS r, atan2(avg(sin(angle)), avg(cos(angle))) AS mean FROM o GROUP BY id)
SELECT id, n, round(r, 6) AS r, round(n * r * r, 6) AS z, round(least(1, exp(sqrt(1 + 4 * n + 4 * (n * n - (n * r) ** 2)) - (1 + 2 * n))), 6) AS p, round(mean, 6) AS mean FROM m""")
def q_rayleigh(spark, d):
    return rounded(geometry.rayleigh(directions(spark, d)))


@query(D + """, m AS (SELECT id, count(*) AS n, sqrt(avg(sin(angle)) ** 2 + avg(cos(angle)) ** 2) * cos(atan2(avg(sin(angle)), avg(cos(angle))) - 1) AS v FROM o GROUP BY id) SELECT id, n, round(v, 6) AS v, round(v * sqrt(2 * n), 6) AS u FROM m""")
def q_vtest(spark, d):
    return rounded(geometry.vtest(directions(spark, d), 1.0).select("id", "n", "v", "u"))


@query(D + """, w AS (SELECT id, count(*) AS n, sum(v * sin(angle)) / sum(v) AS s, sum(v * cos(angle)) / sum(v) AS c FROM o GROUP BY id) SELECT id, n, round(atan2(s, c), 6) AS mean, round(sqrt(s * s + c * c), 6) AS r FROM w""")
def q_circ_mean_weighted(spark, d):
    return rounded(geometry.circ_mean(directions(spark, d), "v"))


@query(D + """, m AS (SELECT id, count(*) AS n, avg(sin(2 * angle)) AS s, avg(cos(2 * angle)) AS c FROM o GROUP BY id), r AS (SELECT *, sqrt(s * s + c * c) AS r FROM m)
SELECT id, n, round(r, 6) AS r, round(least(1, exp(sqrt(1 + 4 * n + 4 * (n * n - (n * r) ** 2)) - (1 + 2 * n))), 6) AS p, round(((degrees(atan2(s, c) / 2) % 180) + 180) % 180, 4) AS mean_axis_deg FROM r""")
def q_axial_rayleigh(spark, d):
    got = geometry.axial_rayleigh(directions(spark, d).withColumn("angle", F.degrees("angle")))
    return got.select("id", "n", F.round("r", 6).alias("r"), F.round("p", 6).alias("p"), F.round("mean_axis_deg", 4).alias("mean_axis_deg"))


@query(D + """ SELECT id, round(sqrt(-2 * ln(sqrt(avg(sin(2 * angle)) ** 2 + avg(cos(2 * angle)) ** 2))) / 2, 6) AS dispersion FROM o GROUP BY id""")
def q_axial_dispersion(spark, d):
    return rounded(geometry.axial_dispersion(directions(spark, d)))


@query(D + """, t AS (SELECT id, angle AS a, 2 * angle + v / 100000 AS b FROM o), m AS (SELECT id, atan2(sum(sin(a)), sum(cos(a))) AS ma, atan2(sum(sin(b)), sum(cos(b))) AS mb FROM t GROUP BY id),
c AS (SELECT id, sin(a - ma) AS x, sin(b - mb) AS y FROM t JOIN m USING (id)), r AS (SELECT id, count(*) AS n, sum(x * y) / sqrt(sum(x * x) * sum(y * y)) AS r, avg(x * x) AS xx, avg(y * y) AS yy, avg(x * x * y * y) AS xy FROM c GROUP BY id)
SELECT id, n, round(r, 6) AS r, round(sqrt(n * xx * yy / xy) * r, 6) AS z FROM r""")
def q_circ_corr(spark, d):
    t = directions(spark, d).select("id", F.col("angle").alias("a"), (2 * F.col("angle") + F.col("v") / 100000).alias("b"))
    return rounded(geometry.circ_corr(t).select("id", "n", "r", "z"))


@query(P + """, m AS (SELECT id, avg(x) AS mx, avg(y) AS my, atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)) / 2 AS g FROM p GROUP BY id) SELECT id, i, round((x - mx) * cos(g) + (y - my) * sin(g), 4) + 0 AS proj FROM p JOIN m USING (id)""")
def q_principal_axis(spark, d):
    return rounded(geometry.principal_axis_projection(points(spark, d)).select("id", "i", "proj"), 4)


@query(P + """, m AS (SELECT id, count(*) AS n, var_samp(x) AS a, var_samp(y) AS c, covar_samp(x, y) AS b FROM p GROUP BY id), l AS (SELECT id, (a + c) / 2 AS h, sqrt(((a - c) / 2) ** 2 + b * b) AS r, atan2(2 * b, a - c) / 2 AS g FROM m WHERE n >= 3)
SELECT id, round(((degrees(g) % 180) + 180) % 180, 4) AS angle_deg, round(sqrt((h + r) / (h - r)), 4) AS anisotropy FROM l WHERE h > r""")
def q_sway_orientation(spark, d):
    return rounded(geometry.sway_orientation(points(spark, d)).where("anisotropy is not null"), 4)


@query(P + """, m AS (SELECT id, sqrt(var_pop(x) + var_pop(y)) AS dispersion, sqrt(var_pop(x)) AS dh, sqrt(var_pop(y)) AS dv, pi() * -2 * ln(0.05) * sqrt(greatest(var_samp(x) * var_samp(y) - covar_samp(x, y) ** 2, 0)) AS vol FROM p GROUP BY id HAVING count(*) >= 40),
w AS (SELECT id, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM (SELECT id, sqrt(var_pop(x) + var_pop(y)) AS a, sqrt(var_pop(x)) AS b, sqrt(var_pop(y)) AS c, count(*) AS n FROM p GROUP BY id, i // 40) WHERE n = 40 GROUP BY id)
SELECT id, round(dispersion, 4) AS dispersion, round(vol, 3) AS volume, round(sqrt(vol), 4) AS extent, round(a, 4) AS within, round(dispersion / a, 4) AS drift_ratio, round(dh / b, 4) AS drift_horizontal, round(dv / c, 4) AS drift_vertical FROM m JOIN w USING (id)""")
def q_spatial_extent_flat(spark, d):
    got = geometry.spatial_extent(points(spark, d), 40, axes=("x", "y"), vertical="y")
    return rounded(got.drop("volume"), 4).join(got.select("id", F.round("volume", 3).alias("volume")), "id")


@query(V + """ SELECT a.id, a.i, a.v AS e0, b.v AS e1, c.v AS e2 FROM s a JOIN s b ON a.id = b.id AND b.i = a.i + 3 JOIN s c ON a.id = c.id AND c.i = a.i + 6""")
def q_embed(spark, d):
    return scaling.embed(samples(spark, d), 3, 3)


@query(V + """, p AS (SELECT id AS frame, i // 8 AS r, i % 8 AS c, v FROM s), d AS (SELECT frame, r, c, abs(v - lag(v) OVER (PARTITION BY r, c ORDER BY frame)) AS d FROM p)
SELECT frame, (r // 4)::INTEGER AS row, CASE WHEN c < 4 THEN 0 ELSE 1 END::INTEGER AS col, round(avg(CASE WHEN d < 0.1 THEN 0 ELSE d END), 6) AS motion FROM d WHERE d IS NOT NULL AND c >= 2 AND c < 6 GROUP BY ALL""")
def q_grid_motion(spark, d):
    pixels = samples(spark, d).select(F.col("id").alias("frame"), F.floor(F.col("i") / 8).alias("r"), (F.col("i") % 8).alias("c"), "v")
    return rounded(scaling.grid_motion(pixels, 2, 2, 8, 8, 0.1, (0.25, 0.75, 0.0, 1.0)))


DESCRIPTORS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("""WITH r AS (SELECT l_returnflag AS g, """ + ", ".join(f"rank() OVER (PARTITION BY l_returnflag ORDER BY {c}) + (count(*) OVER (PARTITION BY l_returnflag, {c}) - 1) / 2.0 AS {c}" for c in DESCRIPTORS) + """ FROM lineitem),
z AS (SELECT """ + ", ".join(f"({c} - avg({c}) OVER (PARTITION BY g)) / stddev_samp({c}) OVER (PARTITION BY g) AS {c}" for c in DESCRIPTORS) + """ FROM r)
""" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, count(*) AS n FROM z" for k, a in enumerate(DESCRIPTORS) for b in DESCRIPTORS[k:]))
def q_descriptor_correlations(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", *[F.col(c).cast("double").alias(c) for c in DESCRIPTORS])
    return rounded(scaling.descriptor_correlations(li, DESCRIPTORS, True, "l_returnflag"))


@query(V + """, x AS (SELECT id, i, v - lag(v) OVER (PARTITION BY id ORDER BY i) AS d, v * v - lag(v * v) OVER (PARTITION BY id ORDER BY i) AS e FROM s),
z AS (SELECT id, i, (d - avg(d) OVER w) / stddev_pop(d) OVER w AS a, (e - avg(e) OVER w) / stddev_pop(e) OVER w AS b, count(*) OVER w AS n FROM x WHERE d IS NOT NULL WINDOW w AS (PARTITION BY id))
SELECT a.id, l.lag::INTEGER AS lag, round(sum(a.a * b.b) / max(a.n), 6) AS r FROM z a, (SELECT unnest(range(-5, 6)) AS lag) l JOIN z b ON a.id = b.id AND b.i = a.i + l.lag GROUP BY a.id, l.lag""")
def q_lag_products(spark, d):
    s = samples(spark, d)
    return rounded(timing.lag_products(s, s.withColumn("v", F.col("v") * F.col("v")), 5))


SEGMENTS = V + f""", c AS (SELECT id, i, v - avg(v) OVER (PARTITION BY id) AS a, v * v - avg(v * v) OVER (PARTITION BY id) AS b FROM s),
f AS (SELECT id, i, sum(a) OVER w AS p, sum(b) OVER w AS q FROM c WINDOW w AS (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING)),
g AS (SELECT id, l.scale, i // l.scale AS seg, p, q, i % l.scale - (l.scale - 1) / 2.0 AS u, l.scale * (l.scale * l.scale - 1) / 12.0 AS uu FROM f, (SELECT unnest({SCALES}) AS scale) l WHERE i < 64 // l.scale * l.scale)"""


@query(SEGMENTS + """, r AS (SELECT id, scale, covar_pop(p, q) * count(*) - sum(u * p) * sum(u * q) / max(uu) AS ab, var_pop(p) * count(*) - sum(u * p) ** 2 / max(uu) AS aa, var_pop(q) * count(*) - sum(u * q) ** 2 / max(uu) AS bb FROM g GROUP BY id, scale, seg)
SELECT id, scale, round(sum(ab) / sqrt(sum(aa) * sum(bb)), 4) AS rho FROM r GROUP BY id, scale""")
def q_dcca(spark, d):
    return rounded(scaling.dcca(samples(spark, d).select("id", "i", F.col("v").alias("a"), (F.col("v") * F.col("v")).alias("b")), SCALES), 4)


QS = [-2.0, -1.0, 0.0, 1.0, 2.0, 3.0]


@query(SEGMENTS + f""", r AS (SELECT id, scale, (var_pop(p) * count(*) - sum(u * p) ** 2 / max(uu)) / scale AS f2 FROM g GROUP BY id, scale, seg),
m AS (SELECT id, scale, q, CASE WHEN q = 0 THEN exp(avg(ln(f2)) / 2) ELSE power(avg(power(f2, q / 2)), 1 / nullif(q, 0)) END AS fq FROM r, (SELECT unnest({QS})::DOUBLE AS q) WHERE f2 > 0 GROUP BY id, scale, q HAVING count(*) >= 4),
h AS (SELECT id, q, regr_slope(ln(fq), ln(scale)) AS h FROM m GROUP BY id, q HAVING count(*) >= 5), t AS (SELECT *, q * h - 1 AS tau FROM h),
a AS (SELECT *, CASE WHEN lag(q) OVER w IS NULL THEN lead(tau) OVER w - tau WHEN lead(q) OVER w IS NULL THEN tau - lag(tau) OVER w ELSE (lead(tau) OVER w - lag(tau) OVER w) / 2 END AS alpha FROM t WINDOW w AS (PARTITION BY id ORDER BY q))
SELECT id, q, round(h, 3) + 0 AS h, round(tau, 3) + 0 AS tau, round(alpha, 3) + 0 AS alpha, round(q * alpha - tau, 3) + 0 AS f, round(max(h) FILTER (q = 2) OVER (PARTITION BY id), 3) AS h2, round(max(alpha) OVER (PARTITION BY id) - min(alpha) OVER (PARTITION BY id), 3) AS width FROM a""")
def q_mfdfa(spark, d):
    return rounded(scaling.mfdfa(samples(spark, d), SCALES, QS), 3)


@query(D + """, m AS (SELECT id, count(*) AS n, corr(cos(angle), v) AS a, corr(sin(angle), v) AS b, corr(cos(angle), sin(angle)) AS c FROM o GROUP BY id), r AS (SELECT id, n, least(1, greatest(0, (a * a + b * b - 2 * a * b * c) / (1 - c * c))) AS r2 FROM m) SELECT id, n, round(sqrt(r2), 6) AS r, round(exp(-n * r2 / 2), 6) AS p FROM r""")
def q_circ_corr_linear(spark, d):
    return rounded(geometry.circ_corr_linear(directions(spark, d)))


def arms(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select(F.when(F.col("c_mktsegment") == "BUILDING", "a").when(F.col("c_mktsegment") == "MACHINERY", "b").alias("arm"), F.col("c_acctbal").alias("v")).where("arm is not null")


@query("""WITH m AS (SELECT count(*) FILTER (c_mktsegment = 'BUILDING') AS na, count(*) FILTER (c_mktsegment = 'MACHINERY') AS nb, avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS ma, avg(c_acctbal) FILTER (c_mktsegment = 'MACHINERY') AS mb, var_samp(c_acctbal) FILTER (c_mktsegment = 'BUILDING') / count(*) FILTER (c_mktsegment = 'BUILDING') AS va, var_samp(c_acctbal) FILTER (c_mktsegment = 'MACHINERY') / count(*) FILTER (c_mktsegment = 'MACHINERY') AS vb FROM customer)
SELECT na AS n_a, nb AS n_b, round(ma - mb, 4) AS diff, round(sqrt(va + vb), 4) AS se, round((va + vb) ** 2 / (va * va / (na - 1) + vb * vb / (nb - 1)), 4) AS df, round((ma - mb + 500) / sqrt(va + vb), 4) AS t_lo, round((ma - mb - 500) / sqrt(va + vb), 4) AS t_hi, round((ma - mb) / sqrt(va + vb), 4) AS t FROM m""")
def q_tost_segments(spark, d):
    return rounded(geometry.tost_independent_stats(arms(spark, d), 500.0), 4)


def spans(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select(F.col("l_linestatus").alias("grp"), F.col("l_returnflag").alias("condition"), F.col("l_orderkey").cast("double").alias("onset_s"), (F.col("l_orderkey") + F.col("l_quantity")).alias("offset_s"), "l_orderkey", "l_linenumber")


@query("""WITH b AS (SELECT l_linestatus AS grp, l_returnflag AS condition, count(*) AS n, median(l_quantity) AS median_s, min(l_quantity) AS min_s, max(l_quantity) AS max_s FROM lineitem GROUP BY ALL) SELECT *, round(max(median_s) OVER (PARTITION BY grp) / min(median_s) OVER (PARTITION BY grp), 6) AS ratio, max(median_s) OVER (PARTITION BY grp) / min(median_s) OVER (PARTITION BY grp) <= 1.05 AS balanced FROM b""")
def q_window_balance(spark, d):
    return rounded(geometry.window_balance(spans(spark, d)))


@query("""SELECT l_linestatus AS grp, sum(l_orderkey + least(l_quantity, min_q)) AS total FROM (SELECT *, min(l_quantity) OVER (PARTITION BY l_linestatus) AS min_q FROM lineitem) GROUP BY 1""")
def q_window_equalise(spark, d):
    return geometry.equalise_windows(spans(spark, d)).groupBy("grp").agg(F.sum("new_offset_s").alias("total"))


@query("SELECT c_nationkey AS grp, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(var_pop(c_acctbal) * count(*), 2) AS ssw FROM customer GROUP BY 1")
def q_icc_moments(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_nationkey").alias("grp"), F.col("c_acctbal").alias("v"))
    return geometry.group_moments(c).select("grp", "n", F.round("mean", 4).alias("mean"), F.round("ssw", 2).alias("ssw"))


@query(V + """, g AS (SELECT id, v + (id % 7) / 10.0 AS v FROM s), m AS (SELECT id, count(*) AS n, avg(v) AS mean, var_pop(v) * count(*) AS ssw FROM g GROUP BY id), t AS (SELECT max(n) AS k, var_samp(mean) * max(n) AS msb, sum(ssw) / (sum(n) - count(*)) AS msw, count(*) AS groups, sum(n)::BIGINT AS n FROM m)
SELECT groups AS n_groups, n, round((msb - msw) / (msb + (k - 1) * msw), 4) AS icc, round((msb - msw) / k, 4) AS between, round(msw, 4) AS within FROM t""")
def q_icc(spark, d):
    """Groups of equal size, where the restricted maximum likelihood is the analysis of variance."""
    g = samples(spark, d).select(F.col("id").alias("grp"), (F.col("v") + F.col("id") % 7 / F.lit(10.0)).alias("v"))
    got = geometry.icc(g, False)
    return rounded(spark.range(1).select(*[F.lit(got[k]).cast("long").alias(k) for k in ("n_groups", "n")], *[F.lit(got[k]).alias(k) for k in ("icc", "between", "within")]), 4)


@query("SELECT c_custkey AS k, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_nationkey, c_acctbal) - 1) / 2.0 AS rank FROM customer")
def q_average_rank(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k"), "c_nationkey", F.col("c_acctbal").alias("v"))
    return geometry.average_rank(c, "v", "c_nationkey").select("k", "rank")


LAGS = scaling.log_lags(1, 16, 8)


@query(P + f""" SELECT a.id, l.lag, round(avg((b.x - a.x) ** 2 + (b.y - a.y) ** 2), 4) AS msd, count(*) AS n FROM p a, (SELECT unnest({LAGS}) AS lag) l JOIN p b ON b.id = a.id AND b.i = a.i + l.lag GROUP BY a.id, l.lag""")
def q_msd_curve(spark, d):
    return rounded(scaling.msd(points(spark, d), LAGS), 4)


MSD = P + f""", c AS (SELECT a.id, l.lag, avg((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS msd FROM p a, (SELECT unnest({scaling.log_lags(1, 150, 40)}) AS lag) l JOIN p b ON b.id = a.id AND b.i = a.i + l.lag GROUP BY a.id, l.lag)"""


@query(MSD + """ SELECT id, round(regr_slope(ln(msd), ln(lag / 10.0)) FILTER (lag / 10.0 < 1.0) / 2, 4) + 0 AS h_short, round(regr_slope(ln(msd), ln(lag / 10.0)) FILTER (lag / 10.0 > 1.5) / 2, 4) + 0 AS h_long FROM c WHERE msd > 0 GROUP BY id""")
def q_stabilogram(spark, d):
    return rounded(scaling.stabilogram(scaling.msd(points(spark, d), scaling.log_lags(1, 150, 40)), 10.0, 1.0, 1.5), 4)


@query(MSD + """, m AS (SELECT id, list(ln(lag / 10.0) / ln(10) ORDER BY lag) AS x, list(ln(msd) / ln(10) ORDER BY lag) AS y, count(*) AS n FROM c JOIN (SELECT id, count(*) AS rows FROM p GROUP BY id) USING (id) WHERE msd > 0 AND lag <= least(150, rows - 5) GROUP BY id),
k AS (SELECT id, x, y, unnest(range(4, n - 4)) AS k FROM m),
u AS (SELECT id, k, 0 AS s, unnest(x[1:k + 1]) AS x, unnest(y[1:k + 1]) AS y FROM k UNION ALL SELECT id, k, 1, unnest(x[k + 1:]), unnest(y[k + 1:]) FROM k),
f AS (SELECT id, k, s, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x) AS r FROM u GROUP BY id, k, s),
b AS (SELECT f.id, f.k, f.b AS b0, f.a AS a0, g.b AS b1, g.a AS a1, row_number() OVER (PARTITION BY f.id ORDER BY f.r + g.r, f.k) AS o FROM f JOIN f g ON f.id = g.id AND f.k = g.k AND f.s = 0 AND g.s = 1)
SELECT id, round(b0 / 2, 3) + 0 AS h_short, round(b1 / 2, 3) + 0 AS h_long, round(ln(power(10, a0) / 2), 3) + 0 AS d_short, round(ln(power(10, a1) / 2), 3) + 0 AS d_long, k::INTEGER AS index FROM b WHERE o = 1""")
def q_two_regions(spark, d):
    got = scaling.sda(points(spark, d), 10.0, 15.0, 40).where("index is not null")
    return rounded(got.select("id", "h_short", "h_long", F.log("d_short").alias("d_short"), F.log("d_long").alias("d_long"), "index"), 3)




@query(V + f""", c AS (SELECT *, v - avg(v) OVER (PARTITION BY id) AS q FROM s), f AS (SELECT id, i, sum(q) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS p FROM c),
g AS (SELECT id, l.scale, i // l.scale AS seg, p, i % l.scale - (l.scale - 1) / 2.0 AS u FROM f, (SELECT unnest({SCALES}) AS scale) l WHERE i < 64 // l.scale * l.scale),
r AS (SELECT id, scale, (var_pop(p) * count(*) - sum(u * p) ** 2 / (scale * (scale * scale - 1) / 12.0)) / scale AS f2 FROM g GROUP BY id, scale, seg),
h AS (SELECT id, scale, sqrt(avg(f2)) AS f FROM r GROUP BY id, scale HAVING count(*) >= 4) SELECT id, round(regr_slope(ln(f), ln(scale)), 4) AS alpha, count(*) AS n_scales FROM h GROUP BY id""")
def q_dfa_alpha(spark, d):
    return rounded(scaling.dfa(samples(spark, d), SCALES), 4)


@query(V + """, x AS (SELECT id, v - lag(v) OVER (PARTITION BY id ORDER BY i) AS d FROM s) SELECT id, round(avg(d ** 3) / power(avg(d ** 2), 1.5), 4) AS trev FROM x GROUP BY id""")
def q_trev(spark, d):
    return rounded(scaling.trev(samples(spark, d)), 4)


@query(V + """, d AS (SELECT a.id, l.lag, a.v, b.v AS u FROM s a, (VALUES (1), (2), (4)) l(lag) JOIN s b ON b.id = a.id AND b.i = a.i + l.lag),
c AS (SELECT id, lag, least(floor((v - min(v) OVER w) * 8 / (max(v) OVER w - min(v) OVER w)), 7) AS x, least(floor((u - min(u) OVER w) * 8 / (max(u) OVER w - min(u) OVER w)), 7) AS y FROM d WINDOW w AS (PARTITION BY id, lag)),
n AS (SELECT id, lag, x, y, count(*) AS n FROM c GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY id, lag, x) AS nx, sum(n) OVER (PARTITION BY id, lag, y) AS ny, sum(n) OVER (PARTITION BY id, lag) AS t FROM n)
SELECT id, lag, round(sum(n / t * ln(n * t / (nx * ny))), 4) AS ami FROM m GROUP BY id, lag""")
def q_mutual_information(spark, d):
    return rounded(scaling.mutual_information(samples(spark, d), [1, 2, 4], 8), 4)


SHIFTED = V + f""", e AS (SELECT id, i FROM s WHERE v > 0.2),
d AS (SELECT id, i, draw, CASE WHEN draw = 0 THEN 0 ELSE ((((id % {scaling.SHIFT[2]} + 1) * {scaling.SHIFT[0]} + draw * {scaling.SHIFT[1]}) % {scaling.SHIFT[2]}) * 48271 + 11) % {scaling.SHIFT[2]} % 33 - 16 END AS shift FROM e, (SELECT unnest(range(0, 1001)) AS draw)),
a AS (SELECT draw, (i + shift + 64) % 64 AS c, count(*) AS k FROM d GROUP BY ALL),
f AS (SELECT draw, c + o AS i, sum(k) AS c FROM a, (VALUES (-1), (0), (1), (2)) w(o) WHERE c + o BETWEEN 0 AND 63 GROUP BY ALL),
g AS (SELECT t.draw, x.i, coalesce(f.c, 0) AS c FROM (SELECT unnest(range(0, 1001)) AS draw) t CROSS JOIN (SELECT unnest(range(0, 64)) AS i) x LEFT JOIN f ON f.draw = t.draw AND f.i = x.i),
o AS (SELECT i, c AS observed FROM g WHERE draw = 0),
p AS (SELECT i, observed, avg(c) AS m, stddev_pop(c) AS s, (count(*) FILTER (c >= observed) + 1) / 1001.0 AS p FROM g JOIN o USING (i) WHERE draw > 0 GROUP BY i, observed)"""


@query(SHIFTED + """ SELECT i, observed::BIGINT AS observed, round(m, 4) AS null_mean, round(s, 4) AS null_sd, round(p, 6) AS p, round(CASE WHEN p >= 1 THEN -log10(1001) ELSE greatest(-log10(1001), least(log10(1001), log10((1 - p) / p))) END, 4) AS surprise FROM p""")
def q_coincidence(spark, d):
    got = coincidences(spark, d)
    return rounded(got.drop("p"), 4).join(got.select("i", "p"), "i")


def coincidences(spark, d):
    t = samples(spark, d).withColumn("event", F.when(F.col("v") > 0.2, 1).otherwise(0))
    return scaling.coincidence(t, 64, 4.0, 1000, 4.0).withColumn("p", F.round("p", 6))


@query(SHIFTED + """ SELECT round(avg(-log10(round(p, 6) + 1 / 1001.0)), 4) AS score, round(avg(CASE WHEN p < 0.01 THEN 1.0 ELSE 0 END), 4) AS frac_significant, count(*) AS n FROM p""")
def q_coincidence_summary(spark, d):
    return rounded(scaling.coincidence_summary(coincidences(spark, d)), 4)


@query(V + """, t AS (SELECT 3 + unnest(range(0, 60)) AS e), w AS (SELECT e::DOUBLE AS event_s, id, avg(v) FILTER (i >= e - 3 AND i < e - 2) AS a, avg(v) FILTER (i >= e AND i < e + 1) AS b FROM s, t GROUP BY e, id)
SELECT event_s, round(avg(CASE WHEN b < a THEN 1.0 ELSE 0 END), 6) AS share, count(*) AS n FROM w WHERE a <> b GROUP BY event_s""")
def q_sliding_null(spark, d):
    return rounded(scaling.sliding_null(samples(spark, d), 1.0, 64, 1.0))


@query("""WITH s AS (SELECT vec_id AS id, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), w AS (SELECT e AS event_s, id, avg(v) FILTER (i >= e - 3 AND i < e - 2) AS a, avg(v) FILTER (i >= e AND i < e + 1) AS b FROM s, (VALUES (10.0), (20.0), (40.0)) t(e) GROUP BY e, id)
SELECT event_s::DOUBLE AS event_s, round(avg(CASE WHEN b < a THEN 1.0 ELSE 0 END), 6) AS share, count(*) AS n FROM w WHERE a <> b GROUP BY event_s""")
def q_participation(spark, d):
    e = spark.createDataFrame([(10.0,), (20.0,), (40.0,)], "event_s double")
    return rounded(scaling.participation(samples(spark, d), e, 1.0))


@query(P + """ SELECT id, round(n, 6) AS norm, CASE WHEN abs(n - 1) <= 0.25 THEN 'g' WHEN abs(n - 1000) <= 250 THEN 'mg' WHEN abs(n - 9.80665) <= 0.25 * 9.80665 THEN 'm/s^2' END AS unit
FROM (SELECT id, median(sqrt((x / 5) * (x / 5) + (y / 5) * (y / 5) + (z / 5) * (z / 5))) AS n FROM p GROUP BY id)""")
def q_acceleration_unit(spark, d):
    return rounded(channels.acceleration_unit(points(spark, d).select("id", *[(F.col(c) / 5).alias(c) for c in "xyz"])))


@query(P + """, u AS (SELECT DISTINCT id, x::DOUBLE AS v FROM p WHERE x IS NOT NULL), d AS (SELECT id, v, v - lag(v) OVER (PARTITION BY id ORDER BY v) AS d FROM u),
m AS (SELECT id, count(*) AS levels, max(v) - min(v) AS span, min(d) AS lo, max(d) AS hi, greatest(4, least(64, count(*) - 1)) AS k FROM d GROUP BY id),
b AS (SELECT id, d, lo, hi, k, CASE WHEN hi > lo THEN least(floor((d - lo) / ((hi - lo) / k)), k - 1) ELSE 0 END AS b FROM d JOIN m USING (id) WHERE d IS NOT NULL),
f AS (SELECT id, b AS fb, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, b) AS r FROM b GROUP BY id, b),
s AS (SELECT id, median(d) AS step FROM b JOIN f USING (id) WHERE r = 1 AND d >= lo + fb * ((hi - lo) / k) AND d <= CASE WHEN hi = lo OR fb = k - 1 THEN hi ELSE lo + (fb + 1) * ((hi - lo) / k) END GROUP BY id)
SELECT id, levels, round(span, 6) AS span, round(coalesce(step, 0), 6) AS step, CASE WHEN step > 0 THEN round(5 / step, 6) ELSE 'inf'::DOUBLE END AS ratio FROM m LEFT JOIN s USING (id)""")
def q_channel_resolution(spark, d):
    return rounded(channels.channel_resolution(points(spark, d).select("id", F.col("x").cast("double").alias("v")), 5.0))


@query(V + """, a AS (SELECT id, i // 4 AS s, avg(v) AS a FROM s WHERE i // 4 < 16 GROUP BY ALL), b AS (SELECT id, i // 2 AS s, avg(v * v) AS b FROM s WHERE i // 2 < 32 GROUP BY ALL)
SELECT id, count(*) AS n, round(corr(a, b), 6) AS r FROM a JOIN b USING (id, s) GROUP BY id""")
def q_compare_envelopes(spark, d):
    s = samples(spark, d)
    return rounded(channels.compare_envelopes(s, s.withColumn("v", F.col("v") * F.col("v")), 4.0, 2.0))


WELCH = """WITH s AS (SELECT vec_id AS id, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
g AS (SELECT id, j, i - 16 * j AS u, v - avg(v) OVER (PARTITION BY id, j) AS v FROM s, (SELECT unnest(range(0, 3)) AS j) WHERE i >= 16 * j AND i < 16 * j + 32),
h AS (SELECT id, j, u, v * (0.5 - 0.5 * cos(2 * pi() * u / 32)) AS v FROM g),
c AS (SELECT id, j, k, sum(v * cos(2 * pi() * k * u / 32)) ** 2 + sum(v * sin(2 * pi() * k * u / 32)) ** 2 AS e FROM h, (SELECT unnest(range(0, 17)) AS k) GROUP BY id, j, k),
w AS (SELECT id, k::DOUBLE AS f, avg(e) / (32 * 12.0) * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END AS p FROM c GROUP BY id, k)"""


def welch_kernel(x):
    f, p = signal.welch(x, 32.0, 32)
    return {"f": f, "p": p}


def spectra(spark, d):
    got = kernels.apply(signals(spark, d), welch_kernel, ["x"], "f array<double>, p array<double>")
    return got.select("id", F.explode(F.arrays_zip("f", "p")).alias("e")).select("id", "e.f", "e.p")


@query(WELCH + " SELECT id, f, round(p, 6) AS p FROM w")
def q_welch_spectrum(spark, d):
    return rounded(spectra(spark, d))


# Queries of the other modules register themselves.
from . import check_queries, filter_queries, live_queries, spectral_queries  # noqa: E402,F401
