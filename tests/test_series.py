"""Series operators against NumPy and closed forms."""

import numpy as np
import pytest

from stridelake.operators import dataset as D
from stridelake.operators import kernels as KR
from stridelake.operators import pose as P
from stridelake.operators import series as S
from stridelake.plans.sql import apply

SRC = "SELECT * FROM {t}"


def frame(spark, *columns, names=("v",), clip=0):
    rows = [(clip, i, *map(float, r)) for i, r in enumerate(zip(*columns))]
    return spark.createDataFrame(rows, "clip long, frame long, " + ", ".join(f"{n} double" for n in names))


def column(df, name, order="frame"):
    return np.array([r[0] if r[0] is not None else np.nan for r in df.orderBy(order).select(name).collect()], float)


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(0).normal(size=37).cumsum()


def test_central_differences(spark, noise):
    df = frame(spark, noise)
    d1 = np.gradient(noise, 0.1)
    assert np.allclose(column(apply(df, S.differences(SRC, {"d": "v"}, "0.1")), "d"), d1)
    d2 = np.gradient(d1, 0.1)
    assert np.allclose(column(apply(df, S.differences(SRC, {"d": "v"}, "0.1", 2)), "d"), d2)
    assert np.allclose(column(apply(df, S.differences(SRC, {"d": "v"}, "0.1", 2, pad="none")), "d"), d2[2:-2])


def test_forward_differences(spark, noise):
    df = frame(spark, noise)
    late = np.diff(noise, 2)
    got = column(apply(df, S.differences(SRC, {"d": "v"}, "1.0", 2, "forward")), "d")
    assert np.allclose(got, [*late, late[-1], late[-1]])
    got = column(apply(df, S.differences(SRC, {"d": "v"}, "1.0", 2, "forward", rungs="early")), "d")
    one = np.diff(noise)
    one = np.append(one, one[-1])
    two = np.diff(one)
    assert np.allclose(got, [*two, two[-1]])
    assert np.allclose(column(apply(df, S.differences(SRC, {"d": "v"}, "1.0", 2, "forward", "none")), "d"), late)
    with pytest.raises(ValueError):
        S.differences(SRC, {"d": "v"}, "1.0", stencil="backward")
    assert S.least_frames(2, "central", "none") == 5 and S.least_frames(2, "forward", "edge") == 3


@pytest.mark.parametrize("window", [1, 2, 4, 5, 9])
def test_box_filter(spark, noise, window):
    lo, hi = (window - 1) // 2, window // 2
    padded = np.concatenate([np.full(lo, noise[0]), noise, np.full(hi, noise[-1])])
    want = np.convolve(padded, np.ones(window) / window, "valid")
    assert np.allclose(column(apply(frame(spark, noise), S.box_filter(SRC, "v", window)), "smooth"), want)


def test_spectrum_and_stats(spark):
    t = np.arange(200) / 100
    v = 3 + np.sin(2 * np.pi * 5 * t)
    df = frame(spark, v)
    assert apply(df, S.dominant_frequency(SRC, "v", 100.0)).first().dominant == pytest.approx(5)
    m = column(apply(df, S.spectrum(SRC, "v", 100.0)), "magnitude", "k")
    assert np.allclose(m, np.abs(np.fft.rfft(v)), atol=1e-8)
    a = column(apply(df, S.spectrum(SRC, "v", 100.0, "amplitude")), "magnitude", "k")
    assert a[0] == pytest.approx(3) and a[10] == pytest.approx(1)
    k = KR.smoothed_spectrum(df, 100.0)
    assert np.allclose(column(k, "magnitude", "k"), m, atol=1e-8)
    s = apply(frame(spark, [1, 2, 3, 4, 5]), S.temporal_stats(SRC, "v")).first()
    assert s.mean == 3 and s["skew"] == pytest.approx(0) and s.kurt == pytest.approx(-1.3)
    flat = apply(frame(spark, [2.0] * 6), S.temporal_stats(SRC, "v")).first()
    assert flat["skew"] is None and flat.kurt is None


def test_spectral_arc_length_forms_agree(spark, noise):
    df = frame(spark, np.abs(noise))
    want = KR.spectral_arc_length(np.abs(noise), 20.0)
    assert KR.sparc(df, 20.0).first().sparc == pytest.approx(want)
    assert apply(df, S.smoothness(SRC, "v", 20.0, "sparc")).first().sparc == pytest.approx(want, rel=1e-6)
    with pytest.raises(ValueError):
        S.smoothness(SRC, "v", 20.0, "calm")


def test_jerk_measures(spark, noise):
    v, fs = np.abs(noise), 20.0
    j = np.diff(v, 2) * fs**2
    df = frame(spark, v)
    d = len(v) / fs
    dlj = -(d**3) / v.max() ** 2 * (j**2).sum() / fs
    assert apply(df, S.dimensionless_jerk(SRC, "v", fs)).first().dlj == pytest.approx(dlj)
    assert apply(df, S.dimensionless_jerk(SRC, "v", fs, log=True)).first().ldlj == pytest.approx(-np.log(-dlj))
    assert apply(df, S.squared_jerk(SRC, "v", fs, "mean")).first()[1] == pytest.approx((j**2).mean())
    assert apply(frame(spark, [0.0] * 5), S.dimensionless_jerk(SRC, "v", fs)).first().dlj is None
    assert apply(frame(spark, [1.0, 2.0, 3.0]), S.dimensionless_jerk(SRC, "v", fs, log=True)).first().ldlj == float("inf")


def test_counts(spark):
    df = frame(spark, [1, -1, 0, -2, 3, 3, 1, 4, 2])
    assert apply(df, S.zero_crossings(SRC, "v")).first().crossings == 2
    assert apply(df, S.number_of_peaks(SRC, "v")).first().peaks == 2
    assert apply(df, S.number_of_peaks(SRC, "v", 3.5)).first().peaks == 1
    assert apply(df, S.active_duration(SRC, "v", 2.5, 2.0)).first().duration == pytest.approx(1.5)


def test_circle_and_helix(spark):
    t = np.linspace(0, 4 * np.pi, 400)
    dt = str(t[1] - t[0])
    xyz = (2 * np.cos(t), 2 * np.sin(t), 0.5 * t)
    df = frame(spark, *xyz, names="xyz")
    k, tau = 2 / (4 + 0.25), 0.5 / (4 + 0.25)
    assert np.allclose(column(apply(df, S.curvature(SRC, dt)), "curvature")[5:-5], k, rtol=1e-3)
    assert np.allclose(column(apply(df, S.torsion(SRC, dt)), "torsion")[8:-8], tau, rtol=1e-3)
    assert len(column(apply(df, S.torsion(SRC, dt, "none")), "torsion")) == 394
    still = frame(spark, [1.0] * 6, [1.0] * 6, [1.0] * 6, names="xyz")
    assert np.isnan(column(apply(still, S.curvature(SRC, dt)), "curvature")).all()
    assert apply(still, S.directness(SRC)).first().directness is None


def test_square_path(spark):
    x, z = [0, 1, 1, 0], [0, 0, 1, 1]
    r = apply(frame(spark, x, [5, 6, 7, 8], z, names="xyz"), S.ground_path(SRC)).first()
    assert r.ground_length == pytest.approx(3) and r.ground_area == pytest.approx(1)


def runs_of(mask):
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(int), [0]])))
    return list(zip(edge[::2], edge[1::2]))


@pytest.mark.parametrize("seed", range(4))
def test_runs(spark, seed):
    rng = np.random.default_rng(seed)
    v = rng.uniform(0, 1, 60).round(2)
    df = frame(spark, v)
    flag = "SELECT *, v < 0.6 AS f FROM {t}"
    mask = v < 0.6
    assert sorted((r.first, r.past) for r in apply(df, S.runs(flag, "f")).collect()) == runs_of(mask)
    want = mask.copy()
    for a, b in runs_of(mask):
        if b - a < 3 and a > 0 and b < len(v):
            want[a:b] = False
    assert (column(apply(df, S.drop_short_runs(flag, "f", 3)), "filtered") == want).all()
    want = mask.copy()
    for a, b in runs_of(~mask):
        if b - a < 3 and a > 0 and b < len(v):
            want[a:b] = True
    assert (column(apply(df, S.drop_short_runs(flag, "f", 3, False)), "filtered") == want).all()
    want = np.zeros(len(v), bool)
    for a, b in runs_of(v < 0.7):
        want[a:b] = (v[a:b] < 0.2).any()
    assert (column(apply(df, S.hysteresis(SRC, "v", "0.2", "0.7")), "held") == want).all()


def test_quaternion_and_angle_unwrap(spark):
    rng = np.random.default_rng(0)
    q = rng.normal(size=(20, 4)).cumsum(0)
    df = frame(spark, *q.T, names=[f"e{i}" for i in range(4)])
    got = np.array([list(r) for r in apply(df, S.unwrap_quaternions(SRC, tuple(f"e{i}" for i in range(4)))).orderBy("frame").select("u0", "u1", "u2", "u3").collect()])
    assert ((got[1:] * got[:-1]).sum(1) >= 0).all() and np.allclose(np.abs(got), np.abs(q))
    a = np.linspace(0, 20, 80)
    wrapped = (a + np.pi) % (2 * np.pi) - np.pi
    assert np.allclose(column(apply(frame(spark, wrapped), S.unwrap_angles(SRC, "v")), "unwrapped"), np.unwrap(wrapped))


def cube(spark):
    pts = [(0, 0, n, float(n & 1), float(n >> 1 & 1), float(n >> 2)) for n in range(8)]
    return spark.createDataFrame(pts, "clip long, frame long, node int, x double, y double, z double")


def test_unit_cube(spark):
    df = cube(spark)
    assert apply(df, P.bounding_box(SRC)).first().volume == 1
    s = apply(df, P.bounding_sphere(SRC)).first()
    assert s.radius == pytest.approx(np.sqrt(3) / 2) and s.cx == pytest.approx(0.5)
    e = KR.bounding_ellipsoid(df).first()
    assert e.r0 == pytest.approx(np.sqrt(3) / 2) and e.cx == pytest.approx(0.5)
    assert apply(df, P.verticality(SRC)).first().verticality == pytest.approx(1 / np.sqrt(2))
    assert apply(df, P.center_of_mass(SRC, "0.0")).first().x is None


def test_mean_rotation_and_simplify(spark):
    from tests.test_rotations import matrix

    rows = [matrix([a, 0, 0], "ZYX").ravel() for a in (0.1, 0.3)]
    df = spark.createDataFrame([(0, *map(float, r)) for r in rows], "clip long, " + ", ".join(f"m{i} double" for i in range(9)))
    got = np.array(list(KR.mean_rotation(df).first())[1:]).reshape(3, 3)
    assert np.allclose(got, matrix([0.2, 0, 0], "ZYX"))
    line = frame(spark, [0, 1, 2, 3, 4], [0, 0.01, 0, 2, 0], names="xy")
    assert [r.place for r in KR.ramer_douglas_peucker(line, 0.1).orderBy("place").collect()] == [0, 2, 3, 4]
    assert list(KR.simplify(np.array([[0.0, 0], [1, 0], [2, 0]]), 0.1)) == [0, 2]


def test_otsu():
    rng = np.random.default_rng(0)
    two = np.concatenate([rng.normal(0, 0.1, 200), rng.normal(5, 0.1, 200)])
    assert 0.5 < KR.otsu(two) < 4.5
    assert np.isnan(KR.otsu(rng.normal(size=400))) and np.isnan(KR.otsu(np.ones(20))) and np.isnan(KR.otsu(two[:5]))


def test_covariance(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 2, 3))
    df = spark.createDataFrame([(0, f, n, *map(float, x[f, n])) for f in range(30) for n in range(2)], "clip long, frame long, node int, x double, y double, z double")
    flat = x.reshape(30, 6)
    got = {(r.a, r.b): r.cov for r in apply(df, P.covariance(SRC)).collect()}
    want = np.cov(flat.T, bias=True)
    assert np.allclose([[got[i, j] for j in range(6)] for i in range(6)], want)
    d = flat - flat.mean(0)
    lag = d[2:].T @ d[:-2] / 28
    got = {(r.a, r.b): r.cov for r in apply(df, P.covariance(SRC, 2)).collect()}
    assert np.allclose([[got[i, j] for j in range(6)] for i in range(6)], lag)


@pytest.mark.parametrize("start,stop,step", [(None, None, 1), (2, 9, 3), (-5, None, 1), (None, -2, 2), (None, None, -1), (8, 2, -2), (3, 3, 1)])
def test_slices(spark, start, stop, step):
    v = np.arange(12.0)
    got = apply(frame(spark, v), D.slice_frames(SRC, start, stop, step)).orderBy("new_frame").collect()
    assert [r.v for r in got] == list(v[slice(start, stop, step)]) and [r.new_frame for r in got] == list(range(len(got)))


@pytest.mark.parametrize("fps,n", [(10.0, 11), (20.0, 21), (3.0, 4), (7.0, 8)])
def test_resample(spark, fps, n):
    v = np.arange(11) ** 2.0
    got = column(apply(frame(spark, v), D.resample(SRC, 0.1, fps, ("v",))), "r_v")
    t = np.arange(0, 1.0 + 1e-12, 1 / fps)
    assert len(got) == len(t) == n
    assert np.allclose(got, np.interp(t, np.arange(11) / 10, v))


def test_dropped_frames_and_noise_do_not_depend_on_partitions(spark):
    df = frame(spark, np.arange(200.0))
    one = apply(df.coalesce(1), D.drop_frames(SRC, 0.3, ("v",))).orderBy("frame").collect()
    two = apply(df.repartition(7), D.drop_frames(SRC, 0.3, ("v",))).orderBy("frame").collect()
    assert [(r.dropped, r.filled_v) for r in one] == [(r.dropped, r.filled_v) for r in two]
    assert 30 < sum(r.dropped for r in one) < 90 and np.allclose([r.filled_v for r in one], np.arange(200.0))
    ang = frame(spark, np.linspace(0, 2, 200), np.linspace(0, 2, 200), names=("a", "b"))
    half = apply(ang, D.drop_frames("SELECT clip, frame, cos(a) AS q0, sin(a) AS q1, 0.0 AS q2, 0.0 AS q3 FROM {t}", 0.4, (), (("q0", "q1", "q2", "q3"),))).orderBy("frame").collect()
    assert np.allclose([r.filled_q0 for r in half], np.cos(np.linspace(0, 2, 200))) and any(r.dropped for r in half)
    wrapped = apply(df, D.noise(SRC, ("v",), 2.0, wrap=True)).collect()
    assert all(-np.pi <= r.noisy_v < np.pi for r in wrapped)
    n = apply(df, D.noise(SRC, ("v",), 2.0)).orderBy("frame").collect()
    e = np.array([r.noisy_v - r.v for r in n])
    assert abs(e.mean()) < 0.6 and 1.5 < e.std() < 2.5


def test_padding_and_layout(spark):
    a, b = frame(spark, [1, 2, 3]), frame(spark, [4], clip=1)
    r = apply(a.unionByName(b), D.pad(SRC, "v", -1.0)).orderBy("clip", "frame").collect()
    assert [(x.clip, x.frame, x.v, x.real) for x in r[3:]] == [(1, 0, 4.0, True), (1, 1, -1.0, False), (1, 2, -1.0, False)]
    assert D.feature_layout(4, 2, "6d", True, True, True) == {"root_pos": (0, 3), "rotations": (3, 27), "velocities": (27, 39), "foot_contacts": (39, 41)}
    with pytest.raises(ValueError):
        D.feature_layout(4, representation="matrix")
