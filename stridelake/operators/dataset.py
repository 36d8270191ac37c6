"""Operators over sets of clips: slices, joins end to end, resampling, padding, mirroring, features."""

from __future__ import annotations

from stridelake.functions import rotations as R
from stridelake.plans.sql import first_known, last_known, numbers, over, stages


def slice_frames(src: str, start: int | None = None, stop: int | None = None, step: int = 1) -> str:
    """Frames of a half-open range with a step, renumbered from 0; negative ends count from the end, a negative step reverses.
    The time between frames grows with the size of the step."""
    if step == 0:
        raise ValueError("step is not 0")
    n = "(max(frame) OVER (PARTITION BY clip) + 1)"
    s = stages(src, {"__n": n})
    at = lambda v, default: default if v is None else str(v) if v >= 0 else f"(__n + {v})"
    if step > 0:
        lo, hi = f"greatest({at(start, '0')}, 0)", f"least({at(stop, '__n')}, __n)"
        s = stages(s, {"__lo": lo, "__hi": hi})
        keep = f"frame >= __lo AND frame < __hi AND (frame - __lo) - {step} * floor((frame - __lo) / {step}) = 0"
        new = f"CAST(floor((frame - __lo) / {step}) AS BIGINT)"
    else:
        lo, hi = f"least({at(start, '__n - 1')}, __n - 1)", f"greatest({at(stop, '-1') if stop is not None else '-1'}, -1)"
        s = stages(s, {"__lo": lo, "__hi": hi})
        k = -step
        keep = f"frame <= __lo AND frame > __hi AND (__lo - frame) - {k} * floor((__lo - frame) / {k}) = 0"
        new = f"CAST(floor((__lo - frame) / {k}) AS BIGINT)"
    return f"SELECT *, {new} AS new_frame FROM ({s}) WHERE {keep}"


def concat(left: str, right: str, columns: str) -> str:
    """Frames of clips on the right follow those of the same clip on the left."""
    ends = f"SELECT clip, max(frame) + 1 AS n FROM ({left}) GROUP BY clip"
    return f"SELECT clip, frame, {columns} FROM ({left}) UNION ALL SELECT r.clip, r.frame + coalesce(e.n, 0) AS frame, {columns} FROM ({right}) r LEFT JOIN ({ends}) e ON r.clip = e.clip"


def splice(src: str, patch: str, columns: str) -> str:
    """Rows of ``patch`` in place of those with the same clip and frame."""
    return f"SELECT a.clip, a.frame, {', '.join(f'a.{c.strip()}' for c in columns.split(','))} FROM ({src}) a LEFT ANTI JOIN ({patch}) p ON a.clip = p.clip AND a.frame = p.frame UNION ALL SELECT clip, frame, {columns} FROM ({patch})"


def splice_duck(src: str, patch: str, columns: str) -> str:
    return splice(src, patch, columns).replace("LEFT ANTI JOIN", "ANTI JOIN")


def _grid(src: str, dt: float, fps: float, duck: bool) -> str:
    """(clip, k, left frame, weight of the right one) at times k / fps up to the last frame's."""
    last = f"SELECT clip, max(frame) AS last FROM ({src}) GROUP BY clip"
    # the number of samples of a half-open range that ends a little after the last frame
    each = f"SELECT clip, last, {numbers('0', f'ceil((last * {dt} + 1e-12) * {fps}) - 1', 'k', duck)} FROM ({last})"
    at = stages(each, {"pos": f"least(k / {fps} / {dt}, last)"})
    return stages(at, {"lo": "CAST(least(floor(pos + 1e-9), greatest(last - 1, 0)) AS BIGINT)"})


def resample(src: str, dt: float, fps: float, linear: tuple[str, ...] = (), quat: tuple[tuple[str, ...], ...] = (), duck: bool = False) -> str:
    """(clip, frame, linear columns, q0_0 ..): frames at a new rate; columns are mixed linearly, quaternions along the arc.
    Each new frame meets its two neighbours in one equi-join on the left one."""
    w = over("clip")
    cols = [*linear, *(c for q in quat for c in q)]
    pairs = stages(src, {f"n_{c}": f"coalesce(lead({c}) {w}, {c})" for c in cols})
    met = f"SELECT g.clip, g.k AS frame, greatest(g.pos - g.lo, 0.0) AS t, {', '.join(f's.{c}, s.n_{c}' for c in cols)} FROM ({_grid(src, dt, fps, duck)}) g JOIN ({pairs}) s ON g.clip = s.clip AND g.lo = s.frame"
    steps = [{f"r_{c}": f"{c} + t * (n_{c} - {c})" for c in linear}] if linear else []
    for i, q in enumerate(quat):
        steps += R.slerp(q, tuple(f"n_{c}" for c in q), "t", f"r{i}_")
    return stages(met, *steps)


def pad(src: str, columns: str, value: float, duck: bool = False) -> str:
    """Every clip as long as the longest: missing frames hold a value, and ``real`` says which are there."""
    top = f"SELECT max(frame) AS top FROM ({src})"
    clips = f"SELECT DISTINCT clip FROM ({src})"
    grid = f"SELECT clip, {numbers('0', 'top', 'frame', duck)} FROM (SELECT clip, top FROM ({clips}) c CROSS JOIN ({top}) m)"
    cols = ", ".join(f"coalesce(s.{c.strip()}, {float(value)}) AS {c.strip()}" for c in columns.split(","))
    return f"SELECT g.clip, g.frame, {cols}, s.frame IS NOT NULL AS real FROM ({grid}) g LEFT JOIN ({src}) s ON g.clip = s.clip AND g.frame = s.frame"


def translate(src: str, offset: tuple[float, float, float]) -> str:
    return stages(src, {f"t{c}": f"{c} + {float(o)}" for c, o in zip("xyz", offset)})


def rotate_vertical(src: str, angle: str, up: str = "y", pivot: tuple[str, str] = ("0.0", "0.0")) -> str:
    """Points turned about the vertical through a pivot on the ground; ``angle`` in radians, signed by the up axis."""
    sign = "-1.0 * " if up.startswith("-") else ""
    u = up.strip("+-")
    a, b = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}[u]
    c, s = f"cos({sign}({angle}))", f"sin({sign}({angle}))"
    p, q = f"({a} - {pivot[0]})", f"({b} - {pivot[1]})"
    return stages(src, {f"t{a}": f"{pivot[0]} + {c} * {p} - {s} * {q}", f"t{b}": f"{pivot[1]} + {s} * {p} + {c} * {q}", f"t{u}": u})


def mirror(src: str, pairs: list[tuple[int, int]], lateral: str = "x") -> str:
    """Nodes change places with their partners and the lateral coordinate changes sign."""
    case = "CASE " + " ".join(f"WHEN node = {a} THEN {b} WHEN node = {b} THEN {a}" for a, b in pairs) + " ELSE node END"
    return f"SELECT clip, frame, {case} AS node, {', '.join(f'-{c} AS {c}' if c == lateral else c for c in 'xyz')} FROM ({src})"


def mirror_angles(angles: tuple[str, ...], order: str, lateral: str = "x") -> tuple[str, ...]:
    """Angles about axes other than the lateral one change sign."""
    return tuple(a if axis.lower() == lateral else f"(-{a})" for a, axis in zip(angles, R.check_order(order)))


def drop_frames(src: str, rate: float, columns: tuple[str, ...] = (), quats: tuple[tuple[str, ...], ...] = (), seed: int = 0) -> str:
    """Frames left out by a hash of (clip, frame, seed), ends spared, and filled in from their neighbours: columns in a
    straight line, quaternions along the arc. Frames that stay are as they were."""
    draw = f"pmod(xxhash64(clip, frame, {seed}), 1000000) / 1000000.0"
    s = stages(src, {"dropped": f"{draw} < {rate} AND frame > 0 AND frame < max(frame) OVER (PARTITION BY clip)"})
    back, ahead = over("clip", frame="ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"), over("clip", frame="ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING")
    ends = {}
    for c in ("frame", *columns, *(c for q in quats for c in q)):
        kept = f"CASE WHEN NOT dropped THEN {c} END"
        ends |= {f"__{c}0": last_known(kept, back, False), f"__{c}1": first_known(kept, ahead, False)}
    s = stages(s, ends)
    s = stages(s, {"__t": "CASE WHEN dropped THEN (frame - __frame0) / CAST(__frame1 - __frame0 AS DOUBLE) ELSE 0.0 END"})
    steps = [{f"filled_{c}": f"CASE WHEN dropped THEN __{c}0 + (__{c}1 - __{c}0) * __t ELSE {c} END" for c in columns}] if columns else []
    for i, q in enumerate(quats):
        steps += R.slerp(tuple(f"__{c}0" for c in q), tuple(f"__{c}1" for c in q), "__t", f"__r{i}_")
        steps.append({f"filled_{c}": f"CASE WHEN dropped THEN __r{i}_{k} ELSE {c} END" for k, c in enumerate(q)})
    return stages(s, *steps)


def noise(src: str, columns: tuple[str, ...], sigma: float, seed: int = 0, wrap: bool = False) -> str:
    """Normal noise from hashes of (clip, frame, seed), so that results do not depend on partitions (Box and Muller); wrap brings angles into [-pi, pi)."""
    u = lambda c, k: f"((pmod(xxhash64(clip, frame, '{c}', {seed}, {k}), 9007199254740992) + 0.5) / 9007199254740992.0)"
    s = stages(src, {f"noisy_{c}": f"{c} + {sigma} * sqrt(-2.0 * ln({u(c, 0)})) * cos(2.0 * pi() * {u(c, 1)})" for c in columns})
    if not wrap:
        return s
    kept = ", ".join(f"noisy_{c} - 2.0 * pi() * floor((noisy_{c} + pi()) / (2.0 * pi())) AS noisy_{c}" for c in columns)
    return f"SELECT * EXCEPT ({', '.join(f'noisy_{c}' for c in columns)}), {kept} FROM ({s})"


def harmonized(src: str, reference: str) -> str:
    """(clip, kept, reason): which clips have the reference's nodes, in (clip, node_idx, name, parent_idx, euler_order)."""
    joined = f"SELECT c.clip, coalesce(s.node_idx, r.node_idx) AS idx, coalesce(s.name = r.name AND s.parent_idx = r.parent_idx AND s.euler_order = r.euler_order, FALSE) AS same FROM (SELECT DISTINCT clip FROM ({src})) c CROSS JOIN ({reference}) r LEFT JOIN ({src}) s ON s.clip = c.clip AND s.node_idx = r.node_idx"
    counts = f"SELECT clip, count(*) AS n FROM ({src}) GROUP BY clip"
    size = f"SELECT count(*) AS m FROM ({reference})"
    bad = f"SELECT clip, min(CASE WHEN NOT same THEN idx END) AS first_bad FROM ({joined}) GROUP BY clip"
    return f"SELECT b.clip, first_bad IS NULL AND n = m AS kept, CASE WHEN first_bad IS NOT NULL THEN concat('node ', CAST(first_bad AS STRING)) WHEN n <> m THEN 'extra nodes' END AS reason FROM ({bad}) b JOIN ({counts}) c ON b.clip = c.clip CROSS JOIN ({size}) z"


def uniform(lo: float, hi: float, tag: str, seed: int = 0) -> str:
    """A draw for each clip, from a hash of (clip, tag, seed): the same on every run and partitioning."""
    return f"({float(lo)} + {float(hi) - float(lo)} * (pmod(xxhash64(clip, '{tag}', {seed}), 9007199254740992) / 9007199254740992.0))"


def random_translate(src: str, reach: float = 100.0, seed: int = 0) -> str:
    return stages(src, {f"t{c}": f"{c} + {uniform(-reach, reach, c, seed)}" for c in "xyz"})


def random_rotate_vertical(src: str, lo: float = -3.141592653589793, hi: float = 3.141592653589793, up: str = "y", seed: int = 0) -> str:
    return rotate_vertical(src, uniform(lo, hi, "turn", seed), up)


def random_perturb_speed(src: str, dt: float, columns: tuple[str, ...], lo: float = 0.8, hi: float = 1.2, seed: int = 0) -> str:
    """Each clip faster by a factor of its own; the time between frames stays."""
    return resample(src, dt, f"({1 / dt} / {uniform(lo, hi, 'speed', seed)})", columns)


def axis_rotation(have: str, want: str) -> tuple[str, ...]:
    """The signed permutation matrix, by rows, that turns one axis such as '+z' into another about the axis between them."""
    unit = lambda a: [(-1 if a[0] == "-" else 1) if c == a[-1] else 0 for c in "xyz"]
    a, b = unit(have), unit(want)
    if a == b:
        m = [[int(i == j) for j in range(3)] for i in range(3)]
    elif [-x for x in a] == b:  # half a turn about the next axis
        k = ("xyz".index(have[-1]) + 1) % 3
        m = [[(1 if i == k else -1) if i == j else 0 for j in range(3)] for i in range(3)]
    else:
        v = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
        k = [[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]]
        m = [[int(i == j) + k[i][j] + sum(k[i][n] * k[n][j] for n in range(3)) for j in range(3)] for i in range(3)]
    return tuple(f"({float(x)})" for row in m for x in row)


def similarity(angles: tuple[str, ...], order: str, left: tuple[str, ...] | None, right: tuple[str, ...] | None, out: str) -> list[dict[str, str]]:
    """Stages for the angles {out}0..2 of left R right, in the same order."""
    m = R.names(f"{out}_m", 9)
    turned = R.matmul(left, m) if left else m
    turned = R.matmul(turned, right) if right else turned
    return [*R.euler_to_matrix(angles, order, f"{out}_m"), dict(zip(R.names(f"{out}_t", 9), turned)), *R.matrix_to_euler(R.names(f"{out}_t", 9), order, out)]


def reorient(src: str, orders: list[str], m: tuple[str, ...], rest_only: bool) -> str:
    """root_* and a{joint}_* after a change of axes by the matrix m, as n_root_* and n{joint}_*.

    For a new world up everything turns: positions by m, joints to m R m'. For a new rest pose only the
    offsets turn (see ``Topology.turned``), and angles make up for it: the root to R m', others to m R m'.
    """
    back = R.transpose(m)
    steps = [dict(zip(("n_root_x", "n_root_y", "n_root_z"), ("root_x", "root_y", "root_z") if rest_only else R.apply(m, ("root_x", "root_y", "root_z"))))]
    for j, order in enumerate(orders):
        steps += similarity(tuple(f"a{j}_{k}" for k in range(3)), order, None if rest_only and j == 0 else m, back, f"n{j}_")
    return stages(src, *steps)


WIDTHS = {"euler": 3, "axisangle": 3, "quat": 4, "6d": 6, "rotmat": 9}


def feature_layout(joints: int, feet: int = 0, representation: str = "6d", root: bool = True, velocities: bool = False, contacts: bool = False) -> dict[str, tuple[int, int]]:
    """Where the parts of a feature row lie: name to (start, stop)."""
    if representation not in WIDTHS:
        raise ValueError(f"representation is one of {sorted(WIDTHS)}")
    out, at = {}, 0
    for name, size, wanted in (("root_pos", 3, root), ("rotations", joints * WIDTHS[representation], True), ("velocities", joints * 3, velocities), ("foot_contacts", feet, contacts)):
        if wanted:
            out[name] = (at, at + size)
            at += size
    return out


def features(src: str, orders: list[str], representation: str = "6d") -> str:
    """f0, f1, ...: the root's position and all joints' rotations, of root_x .. root_z and a{joint}_0 .. _2."""
    steps, cols = [], ["root_x", "root_y", "root_z"]
    for j, order in enumerate(orders):
        steps += R.convert(tuple(f"a{j}_{k}" for k in range(3)), "euler", representation, f"c{j}_", order) if representation != "euler" else [{f"c{j}_{k}": f"a{j}_{k}" for k in range(3)}]
        cols += [f"c{j}_{k}" for k in range(WIDTHS[representation])]
    return f"SELECT clip, frame, {', '.join(f'{c} AS f{i}' for i, c in enumerate(cols))} FROM ({stages(src, *steps)})"


def feature_rows(base: str, velocities: str | None = None, contacts: str | None = None, nodes: tuple[int, ...] = (), feet: tuple[int, ...] = ()) -> str:
    """``base`` joined with columns v{node}_x .. and contact_{node} of long relations; frames without a velocity go."""
    sql = base
    if velocities:
        cols = ", ".join(f"max(CASE WHEN node = {n} THEN d{c} END) AS v{n}_{c}" for n in nodes for c in "xyz")
        sql = f"SELECT a.*, {', '.join(f'b.v{n}_{c}' for n in nodes for c in 'xyz')} FROM ({sql}) a JOIN (SELECT clip, frame, {cols} FROM ({velocities}) GROUP BY clip, frame) b ON a.clip = b.clip AND a.frame = b.frame"
    if contacts:
        cols = ", ".join(f"CAST(max(CASE WHEN node = {n} AND contact THEN 1 ELSE 0 END) AS DOUBLE) AS contact_{n}" for n in feet)
        sql = f"SELECT a.*, {', '.join(f'b.contact_{n}' for n in feet)} FROM ({sql}) a JOIN (SELECT clip, frame, {cols} FROM ({contacts}) GROUP BY clip, frame) b ON a.clip = b.clip AND a.frame = b.frame"
    return sql


def snap_frame_time(expr: str) -> str:
    """The nearest whole rate's frame time where it is within 1e-4 of it, else as it is."""
    rate = f"round(1.0 / {expr})"
    near = f"(1.0 / (CASE WHEN {rate} > 0 THEN {rate} ELSE 1.0 END))"
    return f"(CASE WHEN {expr} > 0 AND {rate} > 0 AND abs({expr} - {near}) / {near} < 1e-4 THEN {near} ELSE {expr} END)"
