import math

import numpy as np
import pytest

from swayflow.functions import signal as S
from swayflow.functions import stats as T
from swayflow.operators import channels, geometry, kernels
from swayflow.sources import readers


@pytest.mark.parametrize(("hz", "gain"), [(2.5, 0.997), (4, 0.773), (5, 0.25)])
def test_two_passes_have_the_closed_form_gain(hz, gain):
    x = np.sin(2 * np.pi * hz * np.arange(24000) / 200)
    y = S.bandpass(S.bandpass(x, 200), 200)[8000:16000]
    assert abs(np.abs(y).max() - gain) < 0.004


def test_block_filter_equals_the_recurrence():
    x = np.random.default_rng(0).normal(size=(600, 2))
    b, a = S.polynomial(2, 0.1, 0.6, 25.0)
    y = np.zeros_like(x)
    for n in range(len(x)):
        y[n] = sum(b[k] * x[n - k] for k in range(len(b)) if n >= k) - sum(a[k] * y[n - k] for k in range(1, len(a)) if n >= k)
    assert np.abs(S.lfilter(b, a, x) - y).max() < 1e-7


@pytest.mark.parametrize("hz", [0.5, 1, 2, 3])
def test_speed_of_a_tone(hz):
    fs, t = 200, np.arange(24000) / 200
    pos = np.column_stack([3 * np.sin(2 * np.pi * hz * t)])
    acc = np.column_stack([-3e-3 * (2 * np.pi * hz) ** 2 * np.sin(2 * np.pi * hz * t)])
    want = 3 * 2 * np.pi * hz * 2 / np.pi
    for data, kind in ((pos, "position"), (acc, "acceleration")):
        s = kernels.qom(data, fs, kind=kind)["speed"][4000:-4000]
        assert abs(s.mean() / want - 1) < 0.02


def test_two_routes_agree_on_a_standing_body():
    x = readers.standstill()
    a = kernels.qom(x, 100, kind="position")["median"]
    b = kernels.qom(readers.worn_acceleration(x, 100), 100)["median"]
    assert abs(a - 2.29) < 0.1 and 0.95 < b / a < 1.05


def test_distributions():
    assert abs(T.t_ppf(0.975, 10) - 2.228139) < 1e-5
    assert abs(T.chi2_ppf(0.95, 3) - 7.814728) < 1e-5
    assert abs(T.t_cdf(2.0, 5) - 0.949030) < 1e-5


def test_complexity_of_known_processes():
    rng = np.random.default_rng(1)
    white, line = rng.normal(size=600), np.sin(np.arange(600) / 5)
    assert kernels.sampen(line) < kernels.sampen(white)
    assert kernels.rqa(line, tau=8)["DET"] > 0.9 > kernels.rqa(white, tau=8)["DET"]
    for s in kernels.iaaft(white, rng, 3):
        assert np.allclose(np.sort(s), np.sort(white)) and np.corrcoef(s, white)[0, 1] < 0.5
    for s in kernels.phase_surrogate(line + 3, rng, 3):
        assert np.allclose(np.abs(np.fft.rfft(s)), np.abs(np.fft.rfft(line + 3))) and abs(s.mean() - (line + 3).mean()) < 1e-9
    for s in kernels.circular_shift_surrogate(line, rng, 3):
        assert np.allclose(np.sort(s), np.sort(line))


def test_lag_hull_and_breaths():
    x = np.cumsum(np.random.default_rng(2).normal(size=500))
    assert kernels.xcorr_lag(x[20:], x[:-20])["lag_s"] == 20
    assert abs(kernels.convex_hull_area([(0, 0), (2, 0), (2, 1), (0, 1), (1, 0.5)]) - 2) < 1e-12
    assert math.isnan(kernels.convex_hull_area([(0, 0), (1, 1), (2, 2)]))
    assert abs(kernels.detect_breaths(np.sin(2 * np.pi * 0.25 * np.arange(3000) / 25), 25)["rate"] - 15) < 0.2


def test_icc_and_verdicts():
    rng = np.random.default_rng(3)
    groups = [rng.normal(m, 1, 20) for m in rng.normal(0, 2, 12)]
    got = geometry.intraclass_correlation([(len(g), g.mean(), ((g - g.mean()) ** 2).sum()) for g in groups])
    assert 0.5 < got["icc"] < 0.95
    assert geometry.equivalence_correlation(0.0, 400, 0.2)["verdict"] == "equivalent"


def test_readers(tmp_path, spark):
    (tmp_path / "a.tsv").write_text("NO_OF_FRAMES\t3\nFREQUENCY\t200\nMARKER_NAMES\tHF\tHL\n" + "".join(f"{k}\t1\t2\t0\t0\t0\n" for k in (1, 2, 3)))
    rows = readers.read(spark, str(tmp_path / "a.tsv")).collect()
    assert {r["layout"] for r in rows} == {"qualisys"} and {r["channel"] for r in rows} == {f"{m} {a}" for m in ("HF", "HL") for a in "XYZ"}
    assert all((r["v"] is None) == r["channel"].startswith("HL") for r in rows) and rows[0]["fs"] == 200
    assert readers.sniff(["ts\tx\ty\tz"]) == "ax3" and readers.sniff(["1 2 3 4 5 6 7 8"]) == "balance"
    phone = ["time;gFx;gFy;gFz", "0,00;0,1;−0,2;1", "0,01;0,1;0;1", "0,02;0;0;0"]
    got = readers.read_phone(phone)
    assert abs(got["x"][0, 1] + 0.2 * 9.80665) < 1e-9 and np.isnan(got["x"][2]).all() and abs(got["fs"] - 100) < 1e-6


def test_search_lag_carries_the_clocks_origins():
    t = np.arange(0, 900, 0.5)
    x = np.cumsum(np.random.default_rng(4).normal(size=len(t)))
    got = kernels.search_lag(t, x, t + 1037, x)
    assert got["lag_s"] == 1037 and got["r"] > 0.99 and got["confident"]
    assert math.isnan(kernels.search_lag(t[:50], x[:50], t[:50], x[:50])["lag_s"])


def test_phases_of_a_steady_breath():
    fs = 25
    x = np.sin(2 * np.pi * 0.25 * np.arange(120 * fs) / fs)
    got = kernels.respiratory_phases(x, fs)
    assert 27 <= got["n_breaths"] <= 30 and set(np.diff(got["onsets"])) <= {99, 100, 101}
    assert not (got["inspiration_v"] & ~got["inspiration"]).any() and not (got["post_expiration"] & ~got["expiration"]).any()
    inner = slice(10 * fs, 110 * fs)
    assert got["velocity"][inner][got["inspiration"][inner]].min() > 0 and got["velocity"][inner][got["expiration_v"][inner]].max() < 0
    assert 0.2 < got["inspiration_high"].sum() / got["inspiration"].sum() < 0.4
    with pytest.raises(ValueError):
        kernels.respiratory_phases(np.full(100, np.nan), fs)


def test_pose_speed_in_torso_lengths():
    rng, t = np.random.default_rng(5), np.arange(3000) / 30
    pose = rng.normal(size=(1, 25, 2)) + np.sin(2 * np.pi * t)[:, None, None] * 0.1
    one, two = kernels.normalized_qom(pose, 30), kernels.normalized_qom(3 * pose, 30)
    assert abs(one["qom"] - two["qom"]) < 1e-9 and one["qom"] > 0
    assert math.isnan(kernels.normalized_qom(pose, 30, scale=0.0)["qom"])


def test_channels(spark):
    inf, nan = math.inf, math.nan
    rows = [(1, k, float(v)) for k, v in enumerate([0.0, 0.5, 1.0, 1.5, 9.0, 0.5, nan, inf])] + [(2, 0, 4.0), (2, 1, 4.0), (3, 0, None)]
    got = {r["id"]: r for r in channels.channel_resolution(spark.createDataFrame(rows, "id long, i long, v double"), 1.0).collect()}
    assert (got[1]["levels"], got[1]["span"], got[1]["step"], got[1]["ratio"]) == (5, 9.0, 0.5, 2.0)
    assert (got[2]["levels"], got[2]["step"], got[2]["ratio"]) == (1, 0.0, inf) and 3 not in got
    acc = spark.createDataFrame([(1, 0.0, 0.0, 1.1), (1, None, 0.0, 99.0), (2, 0.0, 9.8, 0.5), (3, 0.0, 0.0, 990.0), (4, 5.0, 0.0, 0.0)], "id long, x double, y double, z double")
    assert {r["id"]: r["unit"] for r in channels.acceleration_unit(acc).collect()} == {1: "g", 2: "m/s^2", 3: "mg", 4: None}
    with pytest.raises(Exception, match="no unit fits"):
        channels.acceleration_unit(acc, strict=True).collect()
    wave = [(1, k, math.sin(k / 7)) for k in range(95)] + [(2, k, 1.0) for k in range(95)] + [(3, k, 1.0) for k in range(20)]
    w = spark.createDataFrame(wave, "id long, i long, v double")
    got = {r["id"]: (r["n"], r["r"]) for r in channels.compare_envelopes(w, w.withColumn("v", -w["v"]), 10.0, 10.0).collect()}
    assert got[1][0] == 9 and abs(got[1][1] + 1) < 1e-9 and got[2] == (9, None) and got[3] == (2, None)
