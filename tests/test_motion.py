"""Motion operators on signals with known answers."""

import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from swayflow.functions import signal as S
from swayflow.model import Recording
from swayflow.operators import checks, geometry, kernels, scaling, timing
from swayflow.sources import readers
from swayflow.streaming import live

FS = 100.0


def body(n=15_000, drift=0.0, seed=0):
    """Two minutes and a half of sway in three axes, in mm, with an optional straight drift."""
    t = np.arange(n) / FS
    r = np.random.default_rng(seed).normal(0, 0.02, (n, 3))
    return r + np.column_stack([3 * np.sin(2 * np.pi * 0.4 * t) + drift * t, np.cos(2 * np.pi * 0.4 * t), 0.5 * np.sin(2 * np.pi * 0.9 * t)])


def series(spark, rows):
    """id, x, y, z as arrays."""
    return spark.createDataFrame([(k, *[[None if math.isnan(v) else float(v) for v in c] for c in p.T]) for k, p in rows.items()], "id long, x array<double>, y array<double>, z array<double>")


def test_geometry_of_features_ignores_drift():
    still, drifting = (kernels.feature_vector(body(drift=d), FS, "position", "mm") for d in (0.0, 0.1))
    for name in ("extent", "area", "vert", "anis"):
        assert abs(drifting[name] / still[name] - 1) < 0.1
    assert abs(still["anis"] - 3) < 0.2 and abs(still["area"] - math.pi * 3 / 2) < 0.3 and abs(still["vert"] - 0.5 / math.sqrt(2)) < 0.05
    metres = kernels.feature_vector(body() / 1000, FS, "position", "m")
    assert all(abs(metres[k] - still[k]) < 1e-6 * abs(still[k]) for k in kernels.FEATURES)
    assert math.isnan(kernels.feature_vector(body(), FS, "acceleration", "m/s^2")["area"])
    assert math.isnan(kernels.feature_vector(body(), FS, "position", "mm", sensor_fs=15)["jerk"]) and kernels.feature_vector(body()[:1000], FS, "position", "mm") is None
    with pytest.raises(ValueError):
        kernels.feature_vector(body(), FS, "speed", "mm")


def test_recurrence_of_noise_is_low_at_its_own_delay():
    white = np.random.default_rng(0).normal(size=1200)
    assert kernels.rqa(white, tau=1)["DET"] > 0.5 and kernels.rqa(white)["DET"] < 0.2
    assert abs(kernels.rqa(white)["RR"] - 0.05) < 1e-3 and abs(kernels.rqa(5 * white)["DET"] - kernels.rqa(white)["DET"]) < 1e-12
    sine = np.sin(2 * np.pi * np.arange(1200) / 80)
    assert 15 <= kernels.embedding_delay(sine) <= 25 and kernels.rqa(sine)["DET"] > 0.95
    falling = np.linspace(1, 0, 50)
    assert not len(kernels.ami_minima(falling)) and kernels.first_ami_minimum(falling) == int(np.argmin(kernels.smoothed_ami(falling)))


def test_quantile_of_all_pairs_without_holding_them():
    e = np.random.default_rng(1).normal(size=(300, 2))
    d = np.concatenate([kernels._gaps(e, k) for k in range(1, 300)])
    for share in (0.0, 0.03, 0.5, 1.0):
        assert abs(kernels.pair_quantile(e, share, held=50) - np.quantile(d, share)) < 1e-12
    assert kernels.pair_quantile(np.zeros((50, 2)), 0.1, held=5) == 0


def test_tilt_starts_from_the_measured_direction():
    a = np.tile([0.0, 0.0, 9.81], (500, 1))
    assert np.abs(kernels.remove_tilt(a, np.zeros_like(a), FS)).max() < 1e-9
    spun = np.zeros_like(a)
    spun[0] = 50.0  # what the gyroscope says of the first sample turns nothing
    assert np.abs(kernels.remove_tilt(a, spun, FS)).max() < 1e-9
    with pytest.raises(ValueError):
        kernels.remove_tilt(a, np.zeros((10, 3)), FS)


def test_two_regions_meet_where_they_were_made_to():
    dt = np.geomspace(0.04, 10, 60)
    curve = np.where(dt < 1, dt**1.4, dt**0.4)
    got = scaling.two_regions(dt, curve)
    assert abs(got["h_short"] - 0.7) < 0.01 and abs(got["h_long"] - 0.2) < 0.01 and abs(got["dt_c"] - 1) < 0.05 and abs(got["d_long"] - 0.5) < 0.02
    assert scaling.two_regions(dt[:8], curve[:8]) == {} and 4 <= scaling.two_regions(dt[:9], curve[:9])["index"] <= 4


def test_shares_refuse_what_is_no_share():
    x = np.sin(2 * np.pi * 1.0 * np.arange(6000) / FS) + 0.5 * np.sin(2 * np.pi * 3.0 * np.arange(6000) / FS)
    assert abs(kernels.band_share(x, FS, (0.5, 2.0), (0.5, 5.0)) - 0.8) < 0.01
    for bad in ({"num": (0.1, 2), "den": (0.5, 5)}, {"num": (2, 1), "den": (0.5, 5)}, {"num": (1, 2), "den": (0.5, 5), "integrate": "simpson"}, {"num": (1, 2), "den": (0.5, 5), "interval": "open"}):
        with pytest.raises(ValueError):
            kernels.band_share(x, FS, **bad)
    with pytest.warns(RuntimeWarning, match="carries"):
        kernels.band_share(x, FS, (1, 2), (0.5, 80))
    with pytest.warns(RuntimeWarning, match="not finite"):
        assert math.isnan(kernels.band_share(np.r_[x, np.nan], FS, (1, 2), (0.5, 5)))
    parts = kernels.band_power_fraction(x, FS, {"low": (0.0, 2.0), "high": (2.0, 50.0)})
    assert abs(sum(parts.values()) - 1) < 0.01 and abs(parts["low"] - 0.8) < 0.01


def test_bare_peaks_tell_where_there_is_none():
    rng = np.random.default_rng(2)
    beat = np.sin(2 * np.pi * 1.2 * np.arange(12_000) / FS) + rng.normal(size=12_000)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert abs(kernels.cardiac_peak(beat, FS) - 1.2) < 0.02
    with pytest.warns(RuntimeWarning, match="no peak"):
        kernels.cardiac_peak(np.cumsum(rng.normal(size=12_000)), FS)


def test_an_estimate_that_is_the_edge_follows_it(spark):
    rng, t = np.random.default_rng(9), np.arange(0, 300, 0.1)
    tones = {k: np.sin(2 * np.pi * f * t) + 0.5 * rng.normal(size=len(t)) for k, f in enumerate((0.85, 0.9, 0.95, 1.0))}
    red = {k: np.cumsum(rng.normal(size=len(t))) for k in range(4)}
    for rows, follows in ((tones, False), (red, True)):
        s = spark.createDataFrame([(k, [float(v) for v in x], 0.85 + 0.05 * k) for k, x in rows.items()], "id long, x array<double>, reference double")
        got = kernels.edge_sweep(s, 10.0, (0.5, 2.0)).orderBy("edge").collect()
        assert len(got) == 5 and {r["follows"] for r in got} == {follows}
        if not follows:
            assert all(abs(r["freq"] - 0.925) < 0.02 and r["r"] > 0.99 for r in got)
    with pytest.raises(ValueError):
        kernels.edge_sweep(s, 10.0, (0.5, 2.0), edges=[0.5, 0.4, 0.6])


def test_claps_at_the_ends():
    x = np.random.default_rng(10).normal(0, 0.01, 6000)
    x[[300, 3000, 5700]] += 5
    assert [round(v, -1) for v in kernels.find_transient(x, FS)] == [300, 3000, 5700] and [round(v, -1) for v in kernels.find_transient(x, FS, search_s=10)] == [300, 5700]


def test_filters_tell_what_they_were_given():
    assert S.effective_band(100.0) == (0.2, 5.0) and S.effective_band(10.0) == (0.2, 4.95)
    with pytest.warns(RuntimeWarning, match="held"):
        S.bandpass(np.zeros(500), 8.0)
    with pytest.warns(RuntimeWarning, match="not finite"):
        S.lowpass(np.r_[np.zeros(500), np.nan], FS)
    with pytest.raises(ValueError):
        S.bandpass(np.zeros(500), 0.3)


def test_breaths_by_adaptive_rises():
    t = np.arange(0, 180, 1 / 25)
    assert abs(kernels.detect_breaths_adaptive(np.sin(2 * np.pi * 0.25 * t), 25)["rate"] - 15) < 0.3
    assert kernels.detect_breaths_adaptive(np.zeros(len(t)), 25)["n_breaths"] == 0


def test_older_speeds():
    t = np.arange(20_000) / FS
    acc = np.column_stack([np.zeros_like(t), np.zeros_like(t), 9.81 + 0.1 * np.sin(2 * np.pi * t)])
    v = kernels.accel_to_speed(acc, FS)[3000:-3000]
    assert abs(v.max() - 0.1 / (2 * np.pi)) < 2e-4
    scaled = kernels.accel_to_speed(acc * 37, FS, normalize_gravity=True)[3000:-3000]
    assert abs(scaled.max() / v.max() - 1) < 0.01
    pose = np.stack([body(3000)[:, :2]] * 4, 1)
    hidden = pose.copy()
    hidden[1000:2000, 1] = np.nan
    seen, worn = (kernels.group_qom(hidden, 30, normalize=n) for n in ("visible", "worn"))
    assert abs(seen["qom"] / kernels.group_qom(pose, 30)["qom"] - 1) < 0.05 and worn["qom"] < 0.95 * seen["qom"] and seen["fs"] == 30
    assert math.isnan(kernels.group_qom(np.full((50, 2, 2), np.nan), 30)["qom"])
    with pytest.raises(ValueError):
        kernels.group_qom(pose, 30, normalize="all")
    assert abs(kernels.pose_qom(pose, 30)["qom"] - kernels.pose_qom(pose[:, 0], 30)["qom"]) < 1e-9


def test_sway_path_figures():
    n = 3000
    t = np.arange(n) / 50
    got = kernels.cop_sway_metrics(5 * np.sin(2 * np.pi * 0.5 * t), 2 * np.sin(2 * np.pi * 1.5 * t), fs=50)
    assert len(got) == 15 and abs(got["mf_ml"] - 0.5) < 0.02 and abs(got["mf_ap"] - 1.5) < 0.02 and abs(got["mf_mean"] - 1.0) < 0.02
    assert abs(got["ap_ml_range_ratio"] - 0.4) < 1e-3 and got["n"] == n and abs(got["fs_mean"] - 50) < 1e-9
    again = kernels.cop_sway_metrics(5 * np.sin(2 * np.pi * 0.5 * t), 2 * np.sin(2 * np.pi * 1.5 * t), t=t + 7)
    assert abs(again["path_rate"] - got["path_rate"]) < 1e-9
    with pytest.raises(ValueError):
        kernels.cop_sway_metrics(t, t[:5])


def test_noisy_and_still_markers(spark):
    rng = np.random.default_rng(3)
    clean, jitter = body(), body() + rng.normal(0, 1.0, (15_000, 3))
    gappy, holes = jitter.copy(), clean.copy()
    gappy[200:210] = np.nan
    holes[::20] = np.nan
    rows = {0: clean, 1: jitter, 2: gappy, 3: holes, 4: np.tile([1.0, 2.0, 3.0], (500, 1)) + rng.normal(0, 1e-4, (500, 3)), 5: clean[:20]}
    got = {(r["id"], r["severity"]) for r in checks.marker_noise(series(spark, rows), FS).collect()}
    assert {("1", "error"), ("2", "error"), ("3", "warning")} <= got and not {("0", "error"), ("5", "error")} & got
    assert {r["id"] for r in checks.too_still(series(spark, {k: v for k, v in rows.items() if k != 3}), FS).collect()} == {"4"}


def test_printed_fractions_round_by_their_binary_value(spark):
    """Halves that binary holds exactly go to the even digit and others by what they hold, as C prints them."""
    df = spark.range(1, 81).withColumnRenamed("id", "n").selectExpr("n", "explode(sequence(0, n)) AS k").selectExpr("n * 100 + k AS id", "explode(sequence(1, n)) AS i", "k").selectExpr("id", "CASE WHEN i <= k THEN 1.0D END AS v")
    got = {int(r["id"]): r["message"].split()[0] for r in checks.finite_fraction(df, 2.0).collect()}
    assert got == {n * 100 + k: f"{k / n:.3f}" for n in range(1, 81) for k in range(n + 1)} and got[1601] == "0.062"
    rates = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 16.0)], "id string, i long, t double")
    assert [r["message"] for r in checks.rate_agreement(rates, 1.0).collect()] == ["measured 0.062 Hz"]
    dead = spark.range(16).selectExpr("1 AS id", "id AS marker", "CASE WHEN id < 1 THEN 1.0D END AS v")
    assert [r["message"] for r in checks.marker_average(dead).collect()] == ["15 of 16 markers are dead: an average is low by the factor 0.062"]


def test_finite_fraction_of_events_without_values(spark, tmp_path):
    from swayflow.plans.check_queries import q_finite_fraction

    spark.sql("SELECT id AS event_id, timestamp_seconds(id) AS ts, 3L AS user_id, CAST(NULL AS double) AS value FROM range(40)").write.parquet(f"{tmp_path}/events.parquet")
    assert q_finite_fraction(spark, str(tmp_path)).count() == 0  # four of five are there, by its SQL


def test_a_kernel_that_fails_gives_its_reason(spark):
    def kernel(x):
        if len(x) == 1:
            raise IndexError("one")
        return {"v": 1.0 / x[0], "n": len(x)}

    s = spark.createDataFrame([(1, [1.0]), (2, [4.0, None]), (3, []), (4, None), (5, [0.0, 1.0])], "id long, x array<double>")
    got = {r["id"]: r for r in kernels.apply(s, kernel, ["x"], "v double, n long").collect()}
    assert got[2]["v"] == 0.25 and got[2]["warnings"] == [] and got[1]["v"] is None and got[1]["warnings"] == ["IndexError: one"]
    assert got[3]["v"] is None and got[4]["warnings"] and got[5]["v"] is None
    told = kernels.apply(s.where("id = 2").select("id", F.expr("transform(sequence(1, 200), i -> CAST(i AS DOUBLE)) AS x")), lambda x: {"v": float(S.bandpass(x, 8.0).mean())}, ["x"], "v double").first()
    assert any("held" in w for w in told["warnings"])


def test_gaps_of_long_series_are_filled_in_one_pass(spark):
    n = 400_000
    d = spark.range(n).select(F.lit(1).alias("id"), F.col("id").alias("i"), F.when((F.col("id") % 10 < 3) | F.col("id").between(1000, 1500), None).otherwise(F.col("id") * 2.0).alias("v"))
    got = timing.interpolate_gaps(d).agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("gaps"), F.max(F.abs(F.col("v") - 2 * F.col("i"))).alias("off")).first()
    assert got["n"] == n and got["gaps"] == 3 + 503 and got["off"] < 1e-6  # the first three rows, and a run of over 200


def test_surrogates_are_rows(spark):
    x = [float(v) for v in np.random.default_rng(4).normal(size=256)]
    logistic = [0.4]
    for _ in range(255):
        logistic.append(3.9 * logistic[-1] * (1 - logistic[-1]))
    s = spark.createDataFrame([(1, x), (2, logistic)], "id long, x array<double>")

    def asymmetry(v):
        step = np.diff(v)
        return float((step**3).mean() / (step**2).mean() ** 1.5)

    got = {r["id"]: r for r in kernels.surrogate_tests(s, asymmetry, 39).collect()}
    assert got[2]["p"] <= 0.05 < got[1]["p"]
    want = kernels.surrogate_test(np.array(logistic), asymmetry, 39)
    assert abs(got[2]["z"] - want["z"]) < 1e-6 and abs(got[2]["p"] - want["p"]) < 1e-12


def test_dimensions_of_descriptors(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=300), rng.normal(size=300)
    rows = [(float(x), float(x) ** 3, float(y), 1.0, k % 3) for k, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, a3 double, b double, c double, g long")
    got = scaling.effective_dimensionality(df, ["a", "a3", "b", "c"])
    assert got["n_descriptors"] == 3 and got["n_dropped"] == 1 and abs(got["participation_ratio"] - 1.8) < 0.1 and got["n_for_90"] == 2
    shifted = df.withColumns({x: F.col(x) + 50 * F.col("g") for x in ("a", "b")})
    assert scaling.effective_dimensionality(shifted, ["a", "b"])["participation_ratio"] < 1.5 < scaling.effective_dimensionality(shifted, ["a", "b"], by="g")["participation_ratio"]
    with pytest.raises(ValueError):
        scaling.effective_dimensionality(df, ["a", "c"])


def test_equivalence_and_windows(spark):
    rng = np.random.default_rng(6)
    pairs = spark.createDataFrame([(float(x), float(x + e)) for x, e in zip(rng.normal(size=50), rng.normal(0, 0.1, 50))], "a double, b double")
    got = geometry.tost(geometry.tost_paired_stats(pairs, 0.5).first().asDict(), bound=0.5)
    assert got["verdict"] == "equivalent" and "±0.5" in geometry.interpret(got)
    same = geometry.tost(geometry.tost_paired_stats(pairs.withColumn("b", F.col("a")), 0.5).first().asDict(), bound=0.5)
    assert same["verdict"] == "equivalent" and same["ci"] == (0.0, 0.0)
    with pytest.raises(ValueError):
        geometry.tost(geometry.tost_paired_stats(pairs.limit(2), 0.5).first().asDict())
    w = spark.createDataFrame([("g", "a", 0.0, 10.0), ("g", "b", 0.0, 30.0), ("h", "a", 0.0, 5.0)], "grp string, condition string, onset_s double, offset_s double")
    worst = geometry.worst_group(geometry.window_balance(w)).first()
    assert (worst["grp"], worst["ratio"], worst["balanced"]) == ("g", 3.0, False)
    with pytest.raises(ValueError):
        geometry.equalise_windows(w, 0.0)
    with pytest.raises(Exception, match="end after"):
        geometry.window_balance(w.withColumn("offset_s", F.col("onset_s"))).collect()


def test_directions(spark):
    rng = np.random.default_rng(7)
    a = rng.vonmises(1.0, 4.0, 200)
    d = spark.createDataFrame([(1, float(x)) for x in a] + [(2, 0.1), (2, 0.2)], "id long, angle double")
    got = {r["id"]: r for r in geometry.vtest(d, 1.0).collect()}
    assert got[1]["p"] < 1e-10 and got[2]["v"] is None
    away = {r["id"]: r for r in geometry.vtest(d, 1.0 + math.pi).collect()}
    assert away[1]["p"] > 0.999
    z = spark.createDataFrame([(x,) for x in (-3.0, -1.0, 0.0, 0.5, 1.96, 5.0)], "z double").select("z", geometry.normal_tail(F.col("z")).alias("p")).collect()
    assert all(abs(r["p"] - math.erfc(r["z"] / math.sqrt(2)) / 2) < 1.3e-7 * r["p"] * 2 for r in z)
    both = spark.createDataFrame([(1, float(x), float(x + e)) for x, e in zip(a, rng.normal(0, 0.1, 200))], "id long, a double, b double")
    r = geometry.circ_corr(both).first()
    assert r["r"] > 0.9 and r["p"] < 1e-6
    axes = spark.createDataFrame([(1, float(x)) for x in (88.0, 91.0, -89.0, 269.0)], "id long, angle double")
    assert abs(geometry.axial_rayleigh(axes).first()["mean_axis_deg"] - 89.75) < 0.3


def test_icc_of_logarithms(spark):
    rng = np.random.default_rng(8)
    rows = [(g, float(np.exp(m + rng.normal()))) for g, m in enumerate(rng.normal(0, 2, 30)) for _ in range(10)]
    got = geometry.icc(spark.createDataFrame(rows, "grp long, v double"))
    assert got["log"] and (got["n"], got["n_groups"]) == (300, 30) and 0.6 < got["icc"] < 0.95 and not got["boundary"]
    flat = geometry.icc(spark.createDataFrame([(k % 5, float(k // 5 % 4) - 2) for k in range(200)], "grp long, v double"))
    assert flat["boundary"] and not flat["log"]
    with pytest.raises(ValueError):
        geometry.icc(spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0)], "grp long, v double"))


def test_errors_are_all_listed(spark):
    f = spark.createDataFrame([(str(k), "x", "error", "m") for k in range(250)] + [("w", "x", "warning", "m")], "id string, check string, severity string, message string")
    with pytest.raises(ValueError) as e:
        checks.raise_on_error(f)
    assert str(e.value).count("[error]") == 250 and "[warning]" not in str(e.value)
    checks.raise_on_error(f.where("severity = 'warning'"))


def test_recordings(spark, tmp_path):
    r = readers.standstill_record(dur_s=30.0)
    assert (r.n_samples, r.duration_s, r.markers) == (3000, 30.0, ["head"]) and r.marker("head").shape == (3000, 3)
    assert r.qom()["n_samples"] == 3000 and r.missing_fraction() == 0
    with pytest.raises(KeyError):
        r.marker("foot")
    with pytest.raises(ValueError):
        Recording(np.zeros((5, 2)), 1.0, ["one"])
    one = Recording([1.0, math.nan], 2.0, ["x"], source="s")
    assert [tuple(x) for x in one.frame(spark).collect()] == [("s", "x", 0, 0.0, 1.0), ("s", "x", 1, 0.5, None)]


def test_layouts(spark, tmp_path):
    names = {
        "old.tsv": ["NO_OF_FRAMES\t2", "FREQUENCY\t100", "MARKER_NAMES\tA", "frame\ttime\tA X\tA Y\tA Z", "1\t0.00\t1\t2\t3", "2\t0.01\t4\t5\t6"],
        "sverm.txt": ["Time\tA_X\tA_Y\tA_Z", "0.00\t1\t2\t3", "0.01\t1\t2\t4"],
        "ax3.tsv": ["ts\tx\ty\tz", "2020-01-01T00:00:00\t0\t0\t1", "2020-01-01T00:00:01\t0\t0.5\t1"],
        "breath.csv": ["DateTime,Breathing", "2020-01-01T00:00:00,5", "2020-01-01T00:00:01,6"],
        "board.txt": ["0 1 1 1 1 4 0.4 0.6", "10 1 1 1 1 4 0.5 0.5"],
        "nirs.tsv": ["ACC_X\tACC_Y\tACC_Z\tGYR_X\tGYR_Y\tGYR_Z", "0\t0\t1000\t1\t2\t3"],
    }
    for name, lines in names.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    got = {}
    for layout, name, options in (("qualisys", "old.tsv", {}), ("sverm", "sverm.txt", {}), ("ax3", "ax3.tsv", {}), ("equivital", "breath.csv", {}), ("balance", "board.txt", {"in_mm": True}), ("fnirs", "nirs.tsv", {"legend": "sample rate: 50 Hz"})):
        got[layout] = readers.read(spark, str(tmp_path / name), layout, **options).collect()
    assert [(r["channel"], r["t"], r["v"]) for r in got["qualisys"] if r["i"] == 1] == [("A X", 0.01, 4.0), ("A Y", 0.01, 5.0), ("A Z", 0.01, 6.0)]
    assert {r["channel"] for r in got["sverm"]} == {"A X", "A Y", "A Z"} and {r["kind"] for r in got["equivital"]} == {"respiration"}
    assert [r["v"] for r in got["ax3"] if r["channel"] == "y"] == [0.0, 0.5]
    assert sorted((r["channel"], r["v"]) for r in got["balance"] if r["i"] == 0) == [("cop x", 0.4 * 433.0), ("cop y", 0.6 * 238.0)] and all(r["v"] is None for r in got["balance"] if r["i"] == 1)
    assert {r["fs"] for r in got["fnirs"]} == {50.0} and [r["v"] for r in got["fnirs"]][:3] == [0.0, 0.0, 1.0]
    about = readers.recordings(spark, str(tmp_path / "old.tsv")).first()
    assert (about["layout"], about["n_samples"], about["channels"]) == ("qualisys", 2, ["A X", "A Y", "A Z"]) and about["meta"]["n_markers"] == "1" and about["meta"]["header_marker_names"] == "A"
    gone = readers.read_qualisys(["NO_OF_FRAMES\t3", "FREQUENCY\t100", "MARKER_NAMES\tA", "1\t2\t3", "0\t0\t0", "4\t5\t6"], drop_gaps=True)
    assert gone["x"].tolist() == [[1, 2, 3], [4, 5, 6]] and gone["t"].tolist() == [0.0, 0.02] and gone["fs"] == 100
    phone = readers.read_phone(["time\tgFx\tgFy\tgFz\tax"] + [f"{k / 100 + (5 if k > 60 else 0)}\t{k // 2}\t1\t1\t0" for k in range(100)])
    assert phone["meta"]["gaps"] == [(0.6, 5.61)] and phone["meta"]["segments"] == [(0, 61), (61, 100)] and abs(phone["fs"] - 100) < 1e-6 and abs(phone["meta"]["longest_continuous_s"] - 0.6) < 1e-9 and abs(phone["meta"]["channel_rates"]["accel"] - 50 / 5.99) < 0.1
    readers.write_channels(readers.read(spark, str(tmp_path / "sverm.txt"), "sverm"), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).where("layout = 'sverm'")
    assert back.count() == 6 and "PartitionFilters: [isnotnull(layout" in back._jdf.queryExecution().explainString(back.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_live_forms(spark, tmp_path):
    rows = [(k % 2, f"2020-01-01 00:0{k // 60}:{k % 60:02d}", float(k)) for k in range(300)]
    spark.createDataFrame(rows + rows[:5], "id long, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, ts timestamp, v double").parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    once = run(live.without_repeats(stream), "once", "append")
    assert len(once) == 300 and len({(r["id"], r["ts"]) for r in once}) == 300
    bins = run(live.live_bins(stream, width="1 minute"), "bins", "complete")
    assert len(bins) == 10 and sum(r["n"] for r in bins) == 305
    parts = run(live.live_segments(stream, gap="3 seconds"), "parts", "complete")
    assert {r["id"] for r in parts} == {0, 1} and sum(r["n"] for r in parts) == 305


def test_fluctuation_scales():
    assert scaling.dfa_scales(99) == [] and scaling.dfa_scales(400, fs=50, min_scale_s=0.3)[0] == 15 and scaling.dfa_scales(400)[-1] == 100
    with pytest.raises(ValueError):
        scaling.dfa_scales(400, min_scale_s=0.3)
