"""Rotation expressions against NumPy."""

import itertools

import numpy as np
import pytest

from stridelake.functions import rotations as R
from stridelake.functions import vectors as V
from stridelake.plans.sql import spark_text, stages

ORDERS = ["XYZ", "XZY", "YXZ", "YZX", "ZXY", "ZYX", "ZXZ", "XYX", "YZY"]


def elementary(axis, a):
    c, s = np.cos(a), np.sin(a)
    return {"X": np.array([[1, 0, 0], [0, c, -s], [0, s, c]]), "Y": np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]]), "Z": np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])}[axis]


def matrix(angles, order):
    return elementary(order[0], angles[0]) @ elementary(order[1], angles[1]) @ elementary(order[2], angles[2])


def run(spark, rows, steps, out, n):
    cols = [f"e{i}" for i in range(len(rows[0]))]
    values = ", ".join("(" + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in map(float, r)) + f", {i})" for i, r in enumerate(rows))
    src = f"SELECT * FROM (VALUES {values}) AS t({', '.join(cols)}, id)"
    sql = f"SELECT id, {', '.join(f'{out}{i}' for i in range(n))} FROM ({stages(src, *steps)}) ORDER BY id"
    return np.array([[x for x in r][1:] for r in spark.sql(spark_text(sql)).collect()], float)


@pytest.fixture(scope="module")
def angles():
    rng = np.random.default_rng(5)
    special = list(itertools.product((0.0, np.pi / 2, -np.pi / 2, np.pi), repeat=3))[:30]
    return np.array([*rng.uniform(-3, 3, (25, 3)).tolist(), *special])


@pytest.mark.parametrize("order", ORDERS)
def test_euler_round_trip(spark, angles, order):
    e = R.names("e", 3)
    m = run(spark, angles, R.euler_to_matrix(e, order, "m"), "m", 9).reshape(-1, 3, 3)
    want = np.array([matrix(a, order) for a in angles])
    assert np.allclose(m, want, atol=1e-12)
    back = run(spark, angles, [*R.euler_to_matrix(e, order, "m"), *R.matrix_to_euler(R.names("m", 9), order, "a")], "a", 3)
    assert np.allclose([matrix(a, order) for a in back], want, atol=1e-6)  # also where the first angle is hidden


@pytest.mark.parametrize("have,n", [("quat", 4), ("6d", 6), ("axisangle", 3)])
@pytest.mark.parametrize("want,k", [("quat", 4), ("6d", 6), ("axisangle", 3), ("rotmat", 9)])
def test_every_form_to_every_other(spark, angles, have, n, want, k):
    e = R.names("e", 3)
    base = R.euler_to_matrix(e, "ZYX", "m")
    direct = run(spark, angles, base, "m", 9)
    there = [*base, *R.convert(R.names("m", 9), "rotmat", have, "h")]
    over = [*there, *R.convert(R.names("h", n), have, want, "w")]
    again = [*over, *R.convert(R.names("w", k), want, "rotmat", "z")]
    assert np.allclose(run(spark, angles, again, "z", 9), direct, atol=1e-7)


def test_quaternions(spark):
    rng = np.random.default_rng(1)
    q = rng.normal(size=(40, 8))
    p = R.quat_multiply(R.names("e", 4), ("e4", "e5", "e6", "e7"))
    got = run(spark, q, [{f"r{i}": c for i, c in enumerate(p)}], "r", 4)
    a, b = q[:, :4], q[:, 4:]
    w = a[:, 0] * b[:, 0] - (a[:, 1:] * b[:, 1:]).sum(1)
    v = a[:, :1] * b[:, 1:] + b[:, :1] * a[:, 1:] + np.cross(a[:, 1:], b[:, 1:])
    assert np.allclose(got, np.column_stack([w, v]))
    unit = [*R.unit_quat(R.names("e", 4), "p"), *R.unit_quat(("e4", "e5", "e6", "e7"), "q")]
    for t in ("0.0", "1.0"):
        end = run(spark, q, [*unit, *R.slerp(R.names("p", 4), R.names("q", 4), t, "s")], "s", 4)
        ref = run(spark, q, unit, "p" if t == "0.0" else "q", 4)
        assert np.allclose(np.abs((end * ref).sum(1)), 1)


def test_rigid_transforms(spark):
    rng = np.random.default_rng(2)
    t = np.array([*rng.normal(size=(30, 6)).tolist(), [0, 0, 0, 1, 2, 3], [1e-5, 0, 0, 1, 2, 3], [5e-4, 2e-4, 0, 1, -2, 3]])
    exp = R.se3_exp(R.names("e", 6), "r")
    back = run(spark, t, [*exp, *R.se3_log(R.names("rR", 9), R.names("rd", 3), "l")], "l", 6)
    small = np.linalg.norm(t[:, :3], axis=1) < np.pi
    assert np.allclose(back[small], t[small], atol=1e-6)
    # against the series of the matrix exponential
    d = run(spark, t, exp, "rd", 3)
    for row, got in zip(t, d):
        w = np.array([[0, -row[2], row[1]], [row[2], 0, -row[0]], [-row[1], row[0], 0]])
        m = np.zeros((4, 4))
        m[:3, :3], m[:3, 3] = w, row[3:]
        total, term = np.eye(4), np.eye(4)
        for k in range(1, 60):
            term = term @ m / k
            total = total + term
        assert np.allclose(total[:3, 3], got, atol=1e-7)


def test_screw_ends_and_geodesic(spark):
    rng = np.random.default_rng(3)
    t = rng.normal(size=(20, 12)) * 0.7
    base = [*R.vector_to_matrix(R.names("e", 3), "a"), *R.vector_to_matrix(("e3", "e4", "e5"), "b")]
    for at, m, d in (("0.0", "a", 6), ("1.0", "b", 9)):
        steps = [*base, *R.screw_interpolate(R.names("a", 9), ("e6", "e7", "e8"), R.names("b", 9), ("e9", "e10", "e11"), at, "r")]
        assert np.allclose(run(spark, t, steps, "rR", 9), run(spark, t, base, m, 9), atol=1e-7)
        assert np.allclose(run(spark, t, steps, "rd", 3), t[:, d : d + 3], atol=1e-6)
    g = run(spark, t, [*base, *R.geodesic(R.names("a", 9), R.names("b", 9), "g"), {"z0": "g"}], "z", 1)[:, 0]
    a, b = (run(spark, t, base, x, 9).reshape(-1, 3, 3) for x in "ab")
    trace = np.einsum("nij,nij->n", a, b)
    assert np.allclose(g, np.arccos(np.clip((trace - 1) / 2, -1, 1)), atol=1e-6)


def test_segment_frame(spark):
    rows = [[0, 0, 0, 1, 2, 3], [0, 0, 0, 0, 2, 0], [1, 1, 1, 1, 1, 4], [1, 1, 1, 1, 1, 1]]
    m = run(spark, rows, R.segment_frame(R.names("e", 3), ("e3", "e4", "e5"), "r"), "r", 9)
    for row, x in zip(rows[:3], m[:3].reshape(-1, 3, 3)):
        d = np.array(row[3:]) - row[:3]
        assert np.allclose(x[:, 0], d / np.linalg.norm(d)) and np.allclose(x.T @ x, np.eye(3)) and np.linalg.det(x) > 0
    assert np.isnan(m[3]).all()


def test_arguments():
    for bad in ("XX", "XXY", "XYYZ", "ABC"):
        with pytest.raises(ValueError):
            R.check_order(bad)
    with pytest.raises(ValueError):
        R.convert(("a",) * 3, "euler", "quat", "q")
    with pytest.raises(ValueError):
        R.convert(("a",) * 3, "matrix", "quat", "q")


def test_geometry(spark):
    a, b, c = ("0.0", "0.0", "0.0"), ("3.0", "4.0", "0.0"), ("0.0", "0.0", "12.0")
    row = lambda *e: list(spark.sql(spark_text("SELECT " + ", ".join(f"{x} AS c{i}" for i, x in enumerate(e)))).first())
    assert np.allclose(row(V.norm(V.sub(a, b)), V.norm(V.sub(a, c)), V.norm(V.sub(b, c))), [5, 12, 13])
    assert np.allclose(row(V.joint_angle(b, a, c), V.joint_angle(b, a, c, True), V.triangle_area(a, b, c)), [np.pi / 2, 90, 30])
    assert np.allclose(row(V.plane_distance(c, a, ("0.0", "0.0", "-2.0")), V.plane_distance(c, a, ("0.0", "0.0", "-2.0"), False)), [-12, 12])
    assert np.allclose(row(V.segment_distance(c, a, b), V.segment_distance(("9.0", "12.0", "0.0"), a, b), V.segment_distance(c, a, a)), [12, 10, 12])
    assert row(V.argmax_axis(("0.1", "-2.0", "1.0")), V.argmax_axis(("0.0", "0.0", "0.0"))) == ["-y", None]
    assert np.allclose(row(V.signed_angle(("1.0", "0.0", "0.0"), ("0.0", "0.0", "1.0"), ("0.0", "1.0", "0.0"))), [-90])
