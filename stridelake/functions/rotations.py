"""Rotations as SQL expressions: matrices, quaternions, Euler angles, six values, rotation vectors.

A matrix is nine expressions by rows, a quaternion (w, x, y, z) with w >= 0 where it is a result,
Euler angles are intrinsic, R = R1 R2 R3. ``STEPS`` functions return the named stages of a
conversion, so that long expressions are computed once; give them to ``plans.sql.stages``.
"""

from __future__ import annotations

from itertools import product

from stridelake.functions.vectors import clamp, cross, dot, norm, scale, sub

Steps = list[dict[str, str]]
_AXES = {"X": 0, "Y": 1, "Z": 2}


def check_order(order: str) -> str:
    order = order.upper()
    if len(order) != 3 or set(order) - set("XYZ") or order[0] == order[1] or order[1] == order[2]:
        raise ValueError(f"{order!r} is no order of three axes without repeats in a row")
    return order


def matmul(a: tuple, b: tuple) -> tuple:
    return tuple("(" + " + ".join(f"{a[3 * i + k]} * {b[3 * k + j]}" for k in range(3) if a[3 * i + k] != "0.0" and b[3 * k + j] != "0.0") + ")" if any(a[3 * i + k] != "0.0" and b[3 * k + j] != "0.0" for k in range(3)) else "0.0" for i, j in product(range(3), repeat=2))


def transpose(a: tuple) -> tuple:
    return tuple(a[3 * j + i] for i, j in product(range(3), repeat=2))


def apply(a: tuple, v: tuple) -> tuple:
    return tuple("(" + " + ".join(f"{a[3 * i + k]} * {v[k]}" for k in range(3)) + ")" for i in range(3))


def elementary(axis: str, c: str, s: str) -> tuple:
    return {
        "X": ("1.0", "0.0", "0.0", "0.0", c, f"(-{s})", "0.0", s, c),
        "Y": (c, "0.0", s, "0.0", "1.0", "0.0", f"(-{s})", "0.0", c),
        "Z": (c, f"(-{s})", "0.0", s, c, "0.0", "0.0", "0.0", "1.0"),
    }[axis]


def names(prefix: str, n: int) -> tuple:
    return tuple(f"{prefix}{i}" for i in range(n))


def euler_to_matrix(angles: tuple, order: str, out: str, degrees: bool = False) -> Steps:
    order = check_order(order)
    angles = tuple(f"radians({a})" for a in angles) if degrees else angles
    trig = {f"{out}_{f[0]}{i}": f"{f}({a})" for i, a in enumerate(angles) for f in ("cos", "sin")}
    m = [elementary(x, f"{out}_c{i}", f"{out}_s{i}") for i, x in enumerate(order)]
    return [trig, dict(zip(names(out, 9), matmul(matmul(m[0], m[1]), m[2])))]


def matrix_to_euler(m: tuple, order: str, out: str, degrees: bool = False) -> Steps:
    """Angles of an order; where the middle angle hides the first axis, the first angle is 0."""
    order = check_order(order)
    i, j, k = (_AXES[x] for x in order)
    at = lambda r, c: m[3 * r + c]
    if i == k:  # proper
        k = 3 - i - j
        s = 1 if (j - i) % 3 == 2 else -1
        mid = f"acos({clamp(at(i, i), '-1.0', '1.0')})"
        first = f"atan2({at(j, i)}, {s}.0 * {at(k, i)})"
        third = f"atan2({at(i, j)}, {-s}.0 * {at(i, k)})"
        hidden = f"atan2({s}.0 * {at(j, k)}, {at(j, j)})"
        open_ = f"abs(sin({out}_m)) > 1e-7"
    else:
        s = 1 if (j - i) % 3 == 1 else -1
        mid = f"asin({clamp(f'({s}.0 * {at(i, k)})', '-1.0', '1.0')})"
        first = f"atan2({-s}.0 * {at(j, k)}, {at(k, k)})"
        third = f"atan2({-s}.0 * {at(i, j)}, {at(i, i)})"
        hidden = f"atan2({s}.0 * {at(j, i)}, {at(j, j)})"
        open_ = f"abs(cos({out}_m)) > 1e-7"
    a = {f"{out}0": f"CASE WHEN {open_} THEN {first} ELSE 0.0 END", f"{out}1": f"{out}_m", f"{out}2": f"CASE WHEN {open_} THEN {third} ELSE {hidden} END"}
    return [{f"{out}_m": mid}, {n: f"degrees({e})" for n, e in a.items()} if degrees else a]


def matrix_to_quat(m: tuple, out: str) -> Steps:
    """The branch with the largest divisor, normalised, w >= 0."""
    t = f"({m[0]} + {m[4]} + {m[8]})"
    case = f"CASE WHEN {t} > 0 THEN 0 WHEN {m[0]} > {m[4]} AND {m[0]} > {m[8]} THEN 1 WHEN {m[4]} > {m[8]} THEN 2 ELSE 3 END"
    # four times the square of the part that the branch takes as known
    r = [f"1.0 + {t}", f"1.0 + {m[0]} - {m[4]} - {m[8]}", f"1.0 + {m[4]} - {m[0]} - {m[8]}", f"1.0 + {m[8]} - {m[0]} - {m[4]}"]
    root = f"2.0 * sqrt(greatest(CASE {out}_b " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(r)) + " END, 1e-30))"
    d = [f"({m[7]} - {m[5]})", f"({m[2]} - {m[6]})", f"({m[3]} - {m[1]})"]
    p = {(0, 1): f"({m[1]} + {m[3]})", (0, 2): f"({m[2]} + {m[6]})", (1, 2): f"({m[5]} + {m[7]})"}
    own, div = f"{out}_r / 4.0", lambda e: f"{e} / {out}_r"
    table = [
        [own, div(d[0]), div(d[1]), div(d[2])],
        [div(d[0]), own, div(p[0, 1]), div(p[0, 2])],
        [div(d[1]), div(p[0, 1]), own, div(p[1, 2])],
        [div(d[2]), div(p[0, 2]), div(p[1, 2]), own],
    ]
    raw = {f"{out}_{i}": f"CASE {out}_b " + " ".join(f"WHEN {b} THEN {table[b][i]}" for b in range(4)) + " END" for i in range(4)}
    return [{f"{out}_b": case}, {f"{out}_r": root}, raw, *unit_quat(tuple(f"{out}_{i}" for i in range(4)), out)]


def unit_quat(q: tuple, out: str, canonical: bool = True) -> Steps:
    size = "sqrt(" + " + ".join(f"{c} * {c}" for c in q) + ")"
    sign = f"CASE WHEN {q[0]} < 0 THEN -1.0 ELSE 1.0 END" if canonical else "1.0"
    return [{f"{out}_n": f"({sign}) / greatest({size}, 1e-30)"}, {f"{out}{i}": f"{c} * {out}_n" for i, c in enumerate(q)}]


def quat_to_matrix(q: tuple, out: str) -> Steps:
    """Normalises first. A zero quaternion gives a null matrix; ``assert_quat`` raises instead."""
    w, x, y, z = names(f"{out}_u", 4)
    size = "sqrt(" + " + ".join(f"{c} * {c}" for c in q) + ")"
    u = {f"{out}_u{i}": f"CASE WHEN {size} > 1e-12 THEN {c} / (CASE WHEN {size} > 1e-12 THEN {size} ELSE 1.0 END) END" for i, c in enumerate(q)}
    m = (
        f"1.0 - 2.0 * ({y} * {y} + {z} * {z})", f"2.0 * ({x} * {y} - {w} * {z})", f"2.0 * ({x} * {z} + {w} * {y})",
        f"2.0 * ({x} * {y} + {w} * {z})", f"1.0 - 2.0 * ({x} * {x} + {z} * {z})", f"2.0 * ({y} * {z} - {w} * {x})",
        f"2.0 * ({x} * {z} - {w} * {y})", f"2.0 * ({y} * {z} + {w} * {x})", f"1.0 - 2.0 * ({x} * {x} + {y} * {y})",
    )
    return [u, dict(zip(names(out, 9), m))]


def quat_multiply(p: tuple, q: tuple) -> tuple:
    a, b, c, d = p
    e, f, g, h = q
    return (
        f"({a} * {e} - {b} * {f} - {c} * {g} - {d} * {h})",
        f"({a} * {f} + {b} * {e} + {c} * {h} - {d} * {g})",
        f"({a} * {g} - {b} * {h} + {c} * {e} + {d} * {f})",
        f"({a} * {h} + {b} * {g} - {c} * {f} + {d} * {e})",
    )


def quat_conjugate(q: tuple) -> tuple:
    return (q[0], *(f"(-{c})" for c in q[1:]))


def quat_to_vector(q: tuple, out: str) -> Steps:
    """The rotation vector of a unit quaternion, angle in [0, pi]."""
    v = f"sqrt({q[1]} * {q[1]} + {q[2]} * {q[2]} + {q[3]} * {q[3]})"
    turn = f"CASE WHEN {out}_v > 1e-12 THEN 2.0 * atan2({out}_v, abs({q[0]})) / (CASE WHEN {out}_v > 1e-12 THEN {out}_v ELSE 1.0 END) ELSE 2.0 END * CASE WHEN {q[0]} < 0 THEN -1.0 ELSE 1.0 END"
    return [{f"{out}_v": v}, {f"{out}_k": turn}, {f"{out}{i}": f"{c} * {out}_k" for i, c in enumerate(q[1:])}]


def matrix_to_vector(m: tuple, out: str) -> Steps:
    return [*matrix_to_quat(m, f"{out}q"), *quat_to_vector(names(f"{out}q", 4), out)]


def vector_to_matrix(v: tuple, out: str) -> Steps:
    """Rodrigues' formula; no angle, no turn."""
    a = f"sqrt({v[0]} * {v[0]} + {v[1]} * {v[1]} + {v[2]} * {v[2]})"
    unit = {f"{out}_k{i}": f"CASE WHEN {out}_a > 1e-12 THEN {c} / (CASE WHEN {out}_a > 1e-12 THEN {out}_a ELSE 1.0 END) ELSE 0.0 END" for i, c in enumerate(v)}
    trig = {f"{out}_s": f"sin({out}_a)", f"{out}_c": f"1.0 - cos({out}_a)"}
    x, y, z = names(f"{out}_k", 3)
    s, c = f"{out}_s", f"{out}_c"
    m = (
        f"1.0 - {c} * ({y} * {y} + {z} * {z})", f"{c} * {x} * {y} - {s} * {z}", f"{c} * {x} * {z} + {s} * {y}",
        f"{c} * {x} * {y} + {s} * {z}", f"1.0 - {c} * ({x} * {x} + {z} * {z})", f"{c} * {y} * {z} - {s} * {x}",
        f"{c} * {x} * {z} - {s} * {y}", f"{c} * {y} * {z} + {s} * {x}", f"1.0 - {c} * ({x} * {x} + {y} * {y})",
    )
    return [{f"{out}_a": a}, unit | trig, dict(zip(names(out, 9), m))]


def matrix_to_six(m: tuple) -> tuple:
    """The first two columns."""
    return m[0], m[3], m[6], m[1], m[4], m[7]


def six_to_matrix(d: tuple, out: str) -> Steps:
    """Gram-Schmidt on two columns; the third is their cross product. Norms have a floor of 1e-12."""
    a, b = d[:3], d[3:]
    one = names(f"{out}_p", 3)
    two = names(f"{out}_o", 3)
    three = names(f"{out}_q", 3)
    floor = lambda v: f"greatest({norm(v)}, 1e-12)"
    steps = [
        {f"{out}_f": floor(a)},
        {n: f"{c} / {out}_f" for n, c in zip(one, a)},
        dict(zip(two, sub(b, scale(one, dot(one, b))))),
        {f"{out}_g": floor(two)},
        {n: f"{c} / {out}_g" for n, c in zip(three, two)},
    ]
    third = cross(one, three)
    m = [c for row in zip(one, three, third) for c in row]
    return [*steps, dict(zip(names(out, 9), m))]


def slerp(p: tuple, q: tuple, t: str, out: str, shortest: bool = True) -> Steps:
    """Along the shorter arc; nearly equal rotations are mixed linearly; the result is normalised."""
    d = "(" + " + ".join(f"{a} * {b}" for a, b in zip(p, q)) + ")"
    flip = f"CASE WHEN {d} < 0 THEN -1.0 ELSE 1.0 END" if shortest else "1.0"
    angle = f"acos({clamp(f'{out}_f * {d}', '-1.0', '1.0')})"
    near = f"sin({out}_h) < 1e-7"
    safe = f"(CASE WHEN {near} THEN 1.0 ELSE sin({out}_h) END)"
    parts = {f"{out}_a": f"CASE WHEN {near} THEN 1.0 - {t} ELSE sin((1.0 - {t}) * {out}_h) / {safe} END", f"{out}_b": f"(CASE WHEN {near} THEN {t} ELSE sin({t} * {out}_h) / {safe} END) * {out}_f"}
    raw = {f"{out}_{i}": f"{out}_a * {a} + {out}_b * {b}" for i, (a, b) in enumerate(zip(p, q))}
    return [{f"{out}_f": flip}, {f"{out}_h": angle}, parts, raw, *unit_quat(names(f"{out}_", 4), out, canonical=False)]


def skew(w: tuple) -> tuple:
    return "0.0", f"(-{w[2]})", w[1], w[2], "0.0", f"(-{w[0]})", f"(-{w[1]})", w[0], "0.0"


def se3_exp(twist: tuple, out: str) -> Steps:
    """Rotation {out}R0..8 and displacement {out}d0..2 of a twist (w, v)."""
    w, v = twist[:3], twist[3:]
    th = f"{out}_t"
    small = f"{th} < 1e-3"
    b = f"CASE WHEN {small} THEN 0.5 - {th} * {th} / 24.0 ELSE (1.0 - cos({th})) / (CASE WHEN {small} THEN 1.0 ELSE {th} * {th} END) END"
    c = f"CASE WHEN {small} THEN 1.0 / 6.0 - {th} * {th} / 120.0 ELSE ({th} - sin({th})) / (CASE WHEN {small} THEN 1.0 ELSE {th} * {th} * {th} END) END"
    wv = cross(w, v)
    wwv = cross(w, names(f"{out}_x", 3))
    return [
        *vector_to_matrix(w, f"{out}R"),
        {th: norm(w)},
        {f"{out}_b": b, f"{out}_g": c, **dict(zip(names(f"{out}_x", 3), wv))},
        {f"{out}d{i}": f"{v[i]} + {out}_b * {out}_x{i} + {out}_g * {wwv[i]}" for i in range(3)},
    ]


def se3_log(m: tuple, d: tuple, out: str) -> Steps:
    """The twist {out}0..5 of a rotation and displacement."""
    w = names(f"{out}_w", 3)
    th = f"{out}_t"
    small = f"{th} < 1e-3"
    k = f"CASE WHEN {small} THEN 1.0 / 12.0 + {th} * {th} / 720.0 ELSE (1.0 - 0.5 * {th} * sin({th}) / (CASE WHEN 1.0 - cos({th}) > 1e-12 THEN 1.0 - cos({th}) ELSE 1.0 END)) / (CASE WHEN {small} THEN 1.0 ELSE {th} * {th} END) END"
    wd = names(f"{out}_x", 3)
    wwd = cross(w, wd)
    return [
        *matrix_to_vector(m, f"{out}_w"),
        {th: norm(w), **dict(zip(wd, cross(w, d)))},
        {f"{out}_k": k},
        {f"{out}{i}": w[i] for i in range(3)} | {f"{out}{i + 3}": f"{d[i]} - 0.5 * {wd[i]} + {out}_k * {wwd[i]}" for i in range(3)},
    ]


def se3_inverse(m: tuple, d: tuple) -> tuple[tuple, tuple]:
    t = transpose(m)
    return t, tuple(f"(-{c})" for c in apply(t, d))


def screw_interpolate(m0: tuple, d0: tuple, m1: tuple, d1: tuple, t: str, out: str) -> Steps:
    """{out}R and {out}d at t along the screw from one transform to another."""
    inv, back = se3_inverse(m0, d0)
    rel = names(f"{out}_rel", 9)
    off = names(f"{out}_off", 3)
    moved = apply(inv, d1)
    twist = names(f"{out}_tw", 6)
    eR, ed = names(f"{out}_eR", 9), names(f"{out}_ed", 3)
    return [
        dict(zip(rel, matmul(inv, m1))) | {off[i]: f"{moved[i]} + {back[i]}" for i in range(3)},
        *se3_log(rel, off, f"{out}_tw"),
        {f"{out}_s{i}": f"{c} * {t}" for i, c in enumerate(twist)},
        *se3_exp(names(f"{out}_s", 6), f"{out}_e"),
        dict(zip(names(f"{out}R", 9), matmul(m0, eR))) | {f"{out}d{i}": f"{a} + {b}" for i, (a, b) in enumerate(zip(apply(m0, ed), d0))},
    ]


def geodesic(a: tuple, b: tuple, out: str) -> Steps:
    """The angle between two rotations."""
    rel = names(f"{out}_rel", 9)
    return [dict(zip(rel, matmul(transpose(a), b))), *matrix_to_vector(rel, f"{out}_v"), {out: norm(names(f"{out}_v", 3))}]


def segment_frame(a: tuple, b: tuple, out: str) -> Steps:
    """A frame along a segment: x from a to b, y = +Y cross x (or the least aligned axis), z = x cross y. Null for no length."""
    s = sub(b, a)
    n = f"{out}_n"
    x = names(f"{out}_x", 3)
    flat = f"({x[0]} * {x[0]} + {x[2]} * {x[2]})"
    # where the segment is along Y, the reference is the axis with the smallest part, x before z
    ref = (f"CASE WHEN {flat} > 1e-12 THEN 0.0 WHEN abs({x[0]}) <= abs({x[2]}) THEN 1.0 ELSE 0.0 END", f"CASE WHEN {flat} > 1e-12 THEN 1.0 ELSE 0.0 END", f"CASE WHEN {flat} > 1e-12 THEN 0.0 WHEN abs({x[0]}) <= abs({x[2]}) THEN 0.0 ELSE 1.0 END")
    r, y, z = (names(f"{out}_{c}", 3) for c in "ryz")
    return [
        {n: norm(s)},
        {x[i]: f"CASE WHEN {n} > 1e-12 THEN {s[i]} / (CASE WHEN {n} > 1e-12 THEN {n} ELSE 1.0 END) END" for i in range(3)},
        dict(zip(r, ref)),
        {f"{out}_w{i}": c for i, c in enumerate(cross(r, x))},
        {f"{out}_m": norm(names(f"{out}_w", 3))},
        {y[i]: f"{out}_w{i} / {out}_m" for i in range(3)},
        dict(zip(z, cross(x, y))),
        dict(zip(names(out, 9), [c for row in zip(x, y, z) for c in row])),
    ]


def convert(source: tuple, have: str, want: str, out: str, order: str | None = None, degrees: bool = False) -> Steps:
    """Stages from any of euler, quat, rotmat, 6d, axisangle to any other; results are {out}0, {out}1, ..."""
    if "euler" in (have, want) and order is None:
        raise ValueError("euler needs an order")
    if have == want:
        return [{f"{out}{i}": c for i, c in enumerate(source)}]
    m = names(f"{out}_m", 9)
    into = {
        "euler": lambda: euler_to_matrix(source, order, f"{out}_m", degrees),
        "quat": lambda: quat_to_matrix(source, f"{out}_m"),
        "rotmat": lambda: [dict(zip(m, source))],
        "6d": lambda: six_to_matrix(source, f"{out}_m"),
        "axisangle": lambda: vector_to_matrix(source, f"{out}_m"),
    }
    onto = {
        "euler": lambda: matrix_to_euler(m, order, out, degrees),
        "quat": lambda: matrix_to_quat(m, out),
        "rotmat": lambda: [{f"{out}{i}": c for i, c in enumerate(m)}],
        "6d": lambda: [{f"{out}{i}": c for i, c in enumerate(matrix_to_six(m))}],
        "axisangle": lambda: matrix_to_vector(m, out),
    }
    if have not in into or want not in onto:
        raise ValueError(f"unknown form of rotation: {have!r} or {want!r}")
    return [*into[have](), *onto[want]()]
