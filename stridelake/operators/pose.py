"""Operators over poses: relations (clip, frame, node, x, y, z)."""

from __future__ import annotations

from stridelake.functions.vectors import cross, dot, norm, ratio, sub
from stridelake.operators.series import derivative
from stridelake.plans.sql import over, stages

AT = "clip, frame"


def at_nodes(src: str, nodes: dict[str, int], keys: str = AT) -> str:
    """One row for each frame with {name}_x, {name}_y, {name}_z of chosen nodes: a filter and one aggregate, no self-join."""
    cols = ", ".join(f"max(CASE WHEN node = {n} THEN {c} END) AS {name}_{c}" for name, n in nodes.items() for c in "xyz")
    return f"SELECT {keys}, {cols} FROM (SELECT * FROM ({src}) WHERE node IN ({', '.join(map(str, sorted(set(nodes.values()))))})) GROUP BY {keys}"


def inter_joint_distance(src: str, pairs: list[tuple[int, int]]) -> str:
    """(clip, frame, d0, d1, ...): a distance for each pair of nodes."""
    nodes = {f"n{i}": i for p in pairs for i in p}
    d = ", ".join(f"{norm(sub(tuple(f'n{a}_{c}' for c in 'xyz'), tuple(f'n{b}_{c}' for c in 'xyz')))} AS d{k}" for k, (a, b) in enumerate(pairs))
    return f"SELECT {AT}, {d} FROM ({at_nodes(src, nodes)})"


def bounding_box(src: str, keys: str = AT) -> str:
    ends = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in "xyz")
    return stages(f"SELECT {keys}, {ends} FROM ({src}) GROUP BY {keys}", {"volume": " * ".join(f"(hi_{c} - lo_{c})" for c in "xyz")})


def bounding_sphere(src: str, keys: str = AT) -> str:
    """Two steps to the farthest point from node 0, the midpoint as the centre, the largest distance as the radius; ties take the first node."""
    far = lambda s, ref, tag: stages(
        stages(s, {f"d{tag}": norm(sub(("x", "y", "z"), ref))}),
        {f"r{tag}": f"row_number() OVER (PARTITION BY {keys} ORDER BY round(d{tag}, 9) DESC, node)"},
    )
    pick = lambda s, tag, cond: stages(s, {f"{tag}_{c}": f"max(CASE WHEN {cond} THEN {c} END) OVER (PARTITION BY {keys})" for c in "xyz"})
    s = pick(src, "s", f"node = {0}")
    s = pick(far(s, ("s_x", "s_y", "s_z"), "1"), "a", "r1 = 1")
    s = pick(far(s, ("a_x", "a_y", "a_z"), "2"), "b", "r2 = 1")
    s = stages(s, {f"c{c}": f"(a_{c} + b_{c}) / 2.0" for c in "xyz"})
    return f"SELECT {keys}, min(cx) AS cx, min(cy) AS cy, min(cz) AS cz, max({norm(sub(('x', 'y', 'z'), ('cx', 'cy', 'cz')))}) AS radius FROM ({s}) GROUP BY {keys}"


def center_of_mass(src: str, weight: str = "1.0", keys: str = AT) -> str:
    """Weighted mean; null where the weights do not sum to more than 0."""
    return f"SELECT {keys}, " + ", ".join(f"{ratio(f'sum({weight} * {c})', f'sum({weight})', '0')} AS {c}" for c in "xyz") + f" FROM ({src}) GROUP BY {keys}"


def com_displacement(src: str, weight: str = "1.0") -> str:
    """Distance of the centre of mass from where it was at the first frame."""
    s = center_of_mass(src, weight)
    first = tuple(f"first_value({c}) {over('clip', frame='ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')}" for c in "xyz")
    return stages(s, {"travel": norm(sub(("x", "y", "z"), first))})


def verticality(src: str, up: str = "y", keys: str = AT) -> str:
    a, b = (c for c in "xyz" if c != up)
    ext = lambda c: f"(max({c}) - min({c}))"
    return f"SELECT {keys}, {ratio(ext(up), f'sqrt({ext(a)} * {ext(a)} + {ext(b)} * {ext(b)})')} AS verticality FROM ({src}) GROUP BY {keys}"


def pose_distance(left: str, right: str, reduction: str = "frobenius", keys: str = AT) -> str:
    """Distance of two poses joined on keys and node: root of the sum of squares, or mean node distance (mpjpe)."""
    on = ", ".join([*(k.strip() for k in keys.split(",")), "node"])
    d = norm(sub(("a.x", "a.y", "a.z"), ("b.x", "b.y", "b.z")))
    joined = f"SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, {d} AS d FROM ({left}) a JOIN ({right}) b USING ({on})"
    if reduction not in ("frobenius", "mpjpe"):
        raise ValueError("reduction is frobenius or mpjpe")
    return f"SELECT {keys}, {'sqrt(sum(d * d))' if reduction == 'frobenius' else 'avg(d)'} AS distance FROM ({joined}) GROUP BY {keys}"


def mean_pose_subtract(src: str) -> str:
    return stages(src, {f"m{c}": f"{c} - avg({c}) OVER (PARTITION BY clip, node)" for c in "xyz"})


def relative_scale(src: str, centered: bool = False, keys: str = "clip") -> str:
    """The factor that brings target t to reference r best; rows hold r_x .. t_z of a node."""
    if centered:
        src = stages(src, {f"c{p}_{c}": f"{p}_{c} - avg({p}_{c}) OVER (PARTITION BY {keys})" for p in "rt" for c in "xyz"})
    r, t = (tuple(f"{'c' if centered else ''}{p}_{c}" for c in "xyz") for p in "rt")
    return f"SELECT {keys}, {ratio(f'sum{dot(r, t)}', f'sum{dot(t, t)}')} AS factor FROM ({src}) GROUP BY {keys}"


def kinetic_energy(src: str, dt: str, mass: str | None = None) -> str:
    """Sum over nodes of squared speed, or of half mass times squared speed."""
    s = stages(src, {f"v{c}": derivative(c, dt, "clip, node") for c in "xyz"})
    e = dot(("vx", "vy", "vz"), ("vx", "vy", "vz"))
    return f"SELECT {AT}, sum({e if mass is None else f'0.5 * ({mass}) * {e}'}) AS energy FROM ({s}) GROUP BY {AT}"


def channels(src: str, duck: bool = False) -> str:
    """(clip, frame, channel, v): three channels for each node."""
    if duck:
        return f"SELECT clip, frame, 3 * node + c.i AS channel, CASE c.i WHEN 0 THEN x WHEN 1 THEN y ELSE z END AS v FROM ({src}), (SELECT unnest([0, 1, 2]) AS i) c"
    return f"SELECT clip, frame, 3 * node + i AS channel, v FROM (SELECT clip, frame, node, stack(3, 0, x, 1, y, 2, z) AS (i, v) FROM ({src}))"


def covariance(src: str, lag: int = 0, duck: bool = False) -> str:
    """(clip, a, b, cov) of channels over frames: population covariance, or with a lag the mean product of
    deviations from the whole series' mean over the frames that have both ends."""
    c = stages(channels(src, duck), {"d": "v - avg(v) OVER (PARTITION BY clip, channel)"})
    return f"SELECT p.clip, p.channel AS a, q.channel AS b, avg(p.d * q.d) AS cov FROM ({c}) p JOIN ({c}) q ON p.clip = q.clip AND p.frame = q.frame + {lag} GROUP BY p.clip, p.channel, q.channel"


def facing(src: str, pairs: list[tuple[int, int]], up: tuple[str, str, str] = ("0.0", "1.0", "0.0"), fallback: tuple[str, str, str] = ("0.0", "0.0", "1.0")) -> str:
    """(clip, frame, forward, left, up, valid): forward is left cross up, where left is the mean of left minus right
    without its part along up; frames without such a direction face the fallback and are not valid."""
    cases = [f"WHEN node = {a} THEN 1.0 WHEN node = {b} THEN -1.0" for a, b in pairs]
    sign = "CASE " + " ".join(cases) + " ELSE 0.0 END"
    mean = f"SELECT {AT}, " + ", ".join(f"sum({sign} * {c}) / {float(len(pairs))} AS l{c}" for c in "xyz") + f" FROM ({src}) GROUP BY {AT}"
    flat = stages(mean, {"__u": dot(("lx", "ly", "lz"), up)})
    flat = stages(flat, {f"f{c}": f"l{c} - __u * {up[i]}" for i, c in enumerate("xyz")})
    flat = stages(flat, {"__n": norm(("fx", "fy", "fz"))})
    s = stages(flat, {"valid": "__n >= 1e-6"} | {f"w{c}": f"CASE WHEN __n >= 1e-6 THEN f{c} / (CASE WHEN __n >= 1e-6 THEN __n ELSE 1.0 END) END" for c in "xyz"})
    ahead = cross(("wx", "wy", "wz"), up)
    s = stages(s, {f"forward_{c}": f"CASE WHEN valid THEN {ahead[i]} ELSE {fallback[i]} END" for i, c in enumerate("xyz")})
    left = cross(up, ("forward_x", "forward_y", "forward_z"))
    return f"SELECT {AT}, valid, forward_x, forward_y, forward_z, {', '.join(f'{e} AS left_{c}' for c, e in zip('xyz', left))}, {', '.join(f'CAST({u} AS DOUBLE) AS up_{c}' for c, u in zip('xyz', up))} FROM ({s})"
