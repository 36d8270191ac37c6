"""Vectors of three SQL expressions: products, angles, distances, planes and triangles."""

from __future__ import annotations

Vec = tuple[str, str, str]


def vec(prefix: str) -> Vec:
    return f"{prefix}_x", f"{prefix}_y", f"{prefix}_z"


def add(a: Vec, b: Vec) -> Vec:
    return tuple(f"({p} + {q})" for p, q in zip(a, b))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(f"({p} - {q})" for p, q in zip(a, b))


def scale(a: Vec, s: str) -> Vec:
    return tuple(f"({p} * {s})" for p in a)


def dot(a: Vec, b: Vec) -> str:
    return "(" + " + ".join(f"{p} * {q}" for p, q in zip(a, b)) + ")"


def cross(a: Vec, b: Vec) -> Vec:
    return tuple(f"({a[i]} * {b[j]} - {a[j]} * {b[i]})" for i, j in ((1, 2), (2, 0), (0, 1)))


def norm(a: Vec) -> str:
    return f"sqrt({dot(a, a)})"


def ratio(n: str, d: str, eps: str = "1e-12") -> str:
    """n / d where d is above eps, else null; the division itself never sees a zero."""
    return f"(CASE WHEN {d} > {eps} THEN {n} / (CASE WHEN {d} > {eps} THEN {d} ELSE 1.0 END) END)"


def clamp(x: str, lo: str, hi: str) -> str:
    return f"least(greatest({x}, {lo}), {hi})"


def angle(a: Vec, b: Vec) -> str:
    """The angle between two vectors, from the cross product, which is exact near 0 and pi."""
    return f"atan2({norm(cross(a, b))}, {dot(a, b)})"


def joint_angle(a: Vec, vertex: Vec, b: Vec, degrees: bool = False) -> str:
    x = angle(sub(a, vertex), sub(b, vertex))
    return f"degrees({x})" if degrees else x


def segment_axis_angle(segment: Vec, axis: Vec, degrees: bool = False) -> str:
    x = angle(segment, axis)
    return f"degrees({x})" if degrees else x


def triangle_area(a: Vec, b: Vec, c: Vec) -> str:
    return f"(0.5 * {norm(cross(sub(b, a), sub(c, a)))})"


def plane_distance(p: Vec, origin: Vec, normal: Vec, signed: bool = True) -> str:
    d = f"({dot(sub(p, origin), normal)} / {norm(normal)})"
    return d if signed else f"abs({d})"


def segment_distance(p: Vec, a: Vec, b: Vec) -> str:
    """Distance of a point from a segment; a segment without length is a point."""
    ab, ap = sub(b, a), sub(p, a)
    t = clamp(f"coalesce({ratio(dot(ap, ab), dot(ab, ab))}, 0.0)", "0.0", "1.0")
    return norm(sub(ap, scale(ab, t)))


def argmax_axis(v: Vec, tol: str = "1e-06") -> str:
    """'+x' to '-z' for the largest part of a vector, null where all are within tol; the first of equals."""
    x, y, z = (f"abs({c})" for c in v)
    sign = lambda c, n: f"CASE WHEN {c} >= 0 THEN '+{n}' ELSE '-{n}' END"
    return f"(CASE WHEN greatest({x}, {y}, {z}) <= {tol} THEN NULL WHEN {x} >= {y} AND {x} >= {z} THEN {sign(v[0], 'x')} WHEN {y} >= {z} THEN {sign(v[1], 'y')} ELSE {sign(v[2], 'z')} END)"


def axis_vector(name: str) -> Vec:
    """The unit vector of an axis column or literal such as '+y'."""
    s = f"(CASE WHEN substr({name}, 1, 1) = '-' THEN -1.0 ELSE 1.0 END)"
    return tuple(f"(CASE WHEN substr({name}, length({name}), 1) = '{c}' THEN {s} ELSE 0.0 END)" for c in "xyz")


def signed_angle(a: Vec, b: Vec, axis: Vec) -> str:
    """The angle in degrees that turns a into b about a unit axis."""
    return f"degrees(atan2({dot(cross(a, b), axis)}, {dot(a, b)}))"
