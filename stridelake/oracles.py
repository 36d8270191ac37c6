"""DuckDB SQL for queries of the catalogue, written from what the operators are to compute.

Nothing here uses the operators' own text. Where the catalogue uses windows, these use joins of a
frame with its neighbours, lists, or islands by differences of row numbers; rotations go through
quaternions where the catalogue goes through matrices, and the other way round.
"""

from __future__ import annotations

DT, FS = 0.04, 25.0

EVENTS = """
ev AS (SELECT user_id AS clip, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value AS v, value AS x,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, CAST(minute(ts) * 60 + second(ts) AS DOUBLE) / 60.0 AS z FROM events)"""
POSES = """
poses AS (SELECT clip, frame, CAST(n AS INT) AS node, e[3 * n + 1] * 10.0 AS x, e[3 * n + 2] * 10.0 AS y, e[3 * n + 3] * 10.0 AS z FROM
  (SELECT label AS clip, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), (SELECT unnest(range(21)) AS n))"""
WAVES = "wave AS (SELECT vec_id AS clip, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
#: The numbers of a row, e[1] and on, times five.
ROWS = "r AS (SELECT vec_id AS clip, list_transform(CAST(embedding AS DOUBLE[]), lambda t: t * 5.0) AS e FROM embeddings)"


def _r(e: str, name: str) -> str:
    return f"round({e}, 6) + 0.0 AS {name}"


def _slope(table: str, new: str, cols: str, keys: str = "clip") -> str:
    """A table with d{col} of each column: half the difference of the neighbours, or the one difference at an end."""
    on = lambda t: " AND ".join(f"{t}.{k.strip()} = a.{k.strip()}" for k in keys.split(","))
    span = f"nullif(({DT}::DOUBLE * ((n.frame IS NOT NULL)::INT + (p.frame IS NOT NULL)::INT)), 0)"
    d = ", ".join(f"(coalesce(n.{c}, a.{c}) - coalesce(p.{c}, a.{c})) / {span} AS d{c}" for c in cols.split())
    return f"{new} AS (SELECT a.*, {d} FROM {table} a LEFT JOIN {table} n ON {on('n')} AND n.frame = a.frame + 1 LEFT JOIN {table} p ON {on('p')} AND p.frame = a.frame - 1)"


_SQL: dict[str, str] = {}

# ---- derivatives
_three = f"WITH {EVENTS}, {_slope('ev', 'd1', 'v x y z')}, {_slope('d1', 'd2', 'dv dx dy dz')}, {_slope('d2', 'd3', 'ddv ddx ddy ddz')}"
_SQL["finite_difference_central"] = f"{_three} SELECT clip, frame, {_r('dv', 'd')} FROM d1"
_SQL["finite_difference_central_none"] = f"{_three} SELECT clip, frame, {_r('dv', 'd')} FROM d1 WHERE frame > 0 AND frame < (SELECT max(frame) FROM ev WHERE ev.clip = d1.clip)"
_SQL["velocity_ladder_order2"] = f"{_three} SELECT clip, frame, {_r('ddv', 'd')} FROM d2"
_SQL["velocity_ladder_order3"] = f"{_three} SELECT clip, frame, {_r('dddv', 'd')} FROM d3"
_SQL["finite_difference_forward_none"] = f"WITH {EVENTS} SELECT a.clip, a.frame, {_r(f'(n.v - a.v) / {DT}', 'd')} FROM ev a JOIN ev n ON n.clip = a.clip AND n.frame = a.frame + 1"
# the length of v x a by Lagrange's identity, the triple product as a determinant
_speed2, _acc2, _dot = "(dx * dx + dy * dy + dz * dz)", "(ddx * ddx + ddy * ddy + ddz * ddz)", "(dx * ddx + dy * ddy + dz * ddz)"
_swept = f"sqrt(greatest({_speed2} * {_acc2} - {_dot} * {_dot}, 0.0))"
_cross2 = "(power(dy * ddz - dz * ddy, 2) + power(dz * ddx - dx * ddz, 2) + power(dx * ddy - dy * ddx, 2))"
_triple = "(dx * (ddy * dddz - ddz * dddy) - dy * (ddx * dddz - ddz * dddx) + dz * (ddx * dddy - ddy * dddx))"
_SQL["torsion"] = f"{_three} SELECT clip, frame, {_r(f'CASE WHEN {_cross2} > 1e-12 THEN {_triple} / {_cross2} END', 'torsion')} FROM d3"
_SQL["speed_derivative"] = f"WITH {EVENTS}, {_slope('ev', 'd1', 'x y z')}, s AS (SELECT *, sqrt({_speed2}) AS s FROM d1), {_slope('s', 'f', 's')} SELECT clip, frame, {_r('s', 'speed')}, {_r('ds', 'accel')} FROM f"
_nodes = f"WITH {POSES}, {_slope('poses', 'd1', 'x y z', 'clip, node')}"
_SQL["node_velocities"] = f"{_nodes} SELECT clip, frame, node, {', '.join(_r(f'd{c}', f'v{c}') for c in 'xyz')} FROM d1"
_SQL["node_accelerations"] = f"{_nodes}, {_slope('d1', 'd2', 'dx dy dz', 'clip, node')} SELECT clip, frame, node, {', '.join(_r(f'dd{c}', f'a{c}') for c in 'xyz')} FROM d2"
_SQL["kinetic_energy"] = f"{_nodes} SELECT clip, frame, {_r(f'sum({_speed2})', 'energy')} FROM d1 GROUP BY clip, frame"


def _box(width: int) -> str:
    lo, hi = (width - 1) // 2, width // 2
    near = f"(SELECT unnest(generate_series(-{lo}, {hi})) AS k)"
    return f"WITH {EVENTS}, l AS (SELECT clip, list(v ORDER BY frame) AS vs FROM ev GROUP BY clip) SELECT clip, frame, {_r('avg(vs[greatest(least(frame + k, len(vs) - 1), 0) + 1])', 'smooth')} FROM ev JOIN l USING (clip), {near} GROUP BY clip, frame"


_SQL["box_filter_odd"], _SQL["box_filter_even"] = _box(5), _box(4)

# ---- one value for each series, by lists
_lists = f"WITH {EVENTS}, l AS (SELECT clip, list(v ORDER BY frame) AS vs FROM ev GROUP BY clip)"
_peaks = "len(list_filter(range(2, len(vs)), lambda i: vs[i] > vs[i - 1] AND vs[i] > vs[i + 1]{}))"
_SQL["number_of_peaks"] = f"{_lists} SELECT clip, {_peaks.format('')} AS peaks FROM l"
_SQL["number_of_peaks_above"] = f"{_lists} SELECT clip, {_peaks.format(' AND vs[i] >= 20')} AS peaks FROM l"
_SQL["zero_crossings"] = f"WITH {WAVES} SELECT clip, len(list_filter(range(2, len(v) + 1), lambda i: v[i] * v[i - 1] < 0)) AS crossings FROM wave"
_SQL["speed_metric"] = f"{_lists} SELECT clip, {_r('CASE WHEN list_max(list_transform(vs, lambda t: abs(t))) > 1e-12 THEN list_avg(list_transform(vs, lambda t: abs(t))) / list_max(list_transform(vs, lambda t: abs(t))) END', 'speed_metric')} FROM l"
_jerk = f"WITH {WAVES}, j AS (SELECT clip, v, len(v) AS n, list_sum(list_transform(range(2, len(v)), lambda i: power((v[i + 1] - 2 * v[i] + v[i - 1]) * {FS * FS}, 2))) AS j2, len(v) - 2 AS k FROM wave)"
_SQL["integrated_squared_jerk"] = f"{_jerk} SELECT clip, {_r(f'j2 / {FS}', 'integrated_squared_jerk')} FROM j"
_SQL["mean_squared_jerk"] = f"{_jerk} SELECT clip, {_r('j2 / k', 'mean_squared_jerk')} FROM j"
_SQL["rms_squared_jerk"] = f"{_jerk} SELECT clip, {_r('sqrt(j2 / k)', 'rms_squared_jerk')} FROM j"
_time = f"(n / {FS}::DOUBLE)"
_most, _mean = "list_max(list_transform(v, lambda t: abs(t)))", "list_avg(list_transform(v, lambda t: abs(t)))"
_dlj = lambda top, p: f"-(power({_time}, {p}) * (j2 / {FS})) / power({top}, 2)"
_SQL["dimensionless_jerk"] = f"{_jerk} SELECT clip, {_r(_dlj(_most, 3), 'dlj')} FROM j"
_SQL["dimensionless_jerk_mean"] = f"{_jerk} SELECT clip, {_r(_dlj(_mean, 3), 'dlj')} FROM j"
_SQL["dimensionless_jerk_amplitude"] = f"{_jerk} SELECT clip, {_r(_dlj('(list_max(v) - list_min(v))', 5), 'dlj')} FROM j"
_SQL["log_dimensionless_jerk"] = f"{_jerk} SELECT clip, {_r(f'-ln(abs({_dlj(_most, 3)}))', 'ldlj')} FROM j"
_steps = f"WITH {EVENTS}, s AS (SELECT a.clip, sqrt(power(n.x - a.x, 2) + power(n.y - a.y, 2) + power(n.z - a.z, 2)) AS d FROM ev a JOIN ev n ON n.clip = a.clip AND n.frame = a.frame + 1), p AS (SELECT clip, sum(d) AS d FROM s GROUP BY clip), e AS (SELECT clip, min(frame) AS f0, max(frame) AS f1 FROM ev GROUP BY clip)"
_SQL["path_length"] = f"{_steps} SELECT clip, {_r('coalesce(d, 0)', 'path_length')} FROM e LEFT JOIN p USING (clip)"
_net = "sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2) + power(b.z - a.z, 2))"
_SQL["directness"] = f"{_steps} SELECT e.clip, {_r(f'CASE WHEN p.d > 1e-12 THEN {_net} / p.d END', 'directness')} FROM e LEFT JOIN p ON p.clip = e.clip JOIN ev a ON a.clip = e.clip AND a.frame = f0 JOIN ev b ON b.clip = e.clip AND b.frame = f1"

# ---- runs: rows of one flag whose frame less their number among such rows is the same
_ON = f"WITH {EVENTS}, f AS (SELECT clip, frame, v, v > 20 AS on_ FROM ev), g AS (SELECT *, frame - row_number() OVER (PARTITION BY clip, on_ ORDER BY frame) AS g FROM f), h AS (SELECT clip, on_, g, min(frame) AS a, max(frame) AS b, count(*) AS n FROM g GROUP BY ALL), e AS (SELECT clip, max(frame) AS last FROM f GROUP BY clip)"
_SQL["runs"] = f'{_ON} SELECT clip, a AS first, b + 1 AS past FROM h WHERE on_'
_flip = "{_ON} SELECT f.clip, f.frame, CASE WHEN h.on_ = {want} AND h.n < {least} AND h.a > 0 AND h.b < e.last THEN NOT f.on_ ELSE f.on_ END AS filtered FROM f JOIN h ON h.clip = f.clip AND f.frame BETWEEN h.a AND h.b JOIN e ON e.clip = f.clip"
_SQL["filter_short_runs"] = _flip.format(_ON=_ON, want="TRUE", least=2)
_SQL["fill_short_gaps"] = _flip.format(_ON=_ON, want="FALSE", least=3)
_SQL["hysteresis_mask"] = (
    f"WITH {EVENTS}, f AS (SELECT clip, frame, v, v < 30 AS weak FROM ev), g AS (SELECT *, frame - row_number() OVER (PARTITION BY clip, weak ORDER BY frame) AS g FROM f), "
    "h AS (SELECT clip, g, bool_or(v < 10) AS deep FROM g WHERE weak GROUP BY clip, g) SELECT g.clip, g.frame, g.weak AND coalesce(h.deep, FALSE) AS held FROM g LEFT JOIN h ON g.weak AND h.clip = g.clip AND h.g = g.g"
)
_SQL["order_runs"] = (
    "WITH f AS (SELECT o_custkey AS clip, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS frame, o_totalprice > 150000 AS on_ FROM orders), "
    "g AS (SELECT *, frame - row_number() OVER (PARTITION BY clip, on_ ORDER BY frame) AS g FROM f) SELECT clip, min(frame) AS first, max(frame) + 1 AS past FROM g WHERE on_ GROUP BY clip, g"
)

# ---- contacts of the feet 3 and 5: limits of 60 a second and 1.04 above the floor, a quarter to either side of them
_part = "PARTITION BY clip, node"


def _mask(name: str, src: str, value: str, limit: str) -> str:
    """CTEs that end in {name}: ``src`` with a column {name} of one mask."""
    return f"""
{name}1 AS (SELECT *, {value} < {limit} * 1.25 AS weak FROM {src}),
{name}2 AS (SELECT *, frame - row_number() OVER ({_part}, weak ORDER BY frame) AS g FROM {name}1),
{name}3 AS (SELECT * EXCLUDE (g, weak), weak AND bool_or({value} < {limit} * 0.75) OVER ({_part}, weak, g) AS held FROM {name}2),
{name}4 AS (SELECT *, frame - row_number() OVER ({_part}, held ORDER BY frame) AS g FROM {name}3),
{name}5 AS (SELECT *, min(frame) OVER w AS a, max(frame) OVER w AS b, min(frame) FILTER ({value} < {limit}) OVER w AS ra, max(frame) FILTER ({value} < {limit}) OVER w AS rb FROM {name}4 WINDOW w AS ({_part}, held, g)),
{name} AS (SELECT * EXCLUDE (held, g, a, b, ra, rb), held AND coalesce((a > 0 OR frame >= ra) AND (b < last OR frame <= rb), FALSE) AS {name}_mask FROM {name}5)"""


def _contacts(method: str) -> str:
    combined = method == "combined"
    limit = "CASE WHEN low IS NOT NULL AND high > low + 2.08 THEN low + 1.04 ELSE 1.04::DOUBLE END" if combined else "1.04::DOUBLE"
    ctes, src, masks = "", "limited", []
    for kind, value, top in (("velocity", "speed", "60"), ("height", "clearance", "height_limit")):
        if method in (kind, "combined"):
            ctes, src = ctes + "," + _mask(kind, src, value, top), kind
            masks.append(f"{kind}_mask")
    return f"""
WITH {POSES},
feet AS (SELECT * FROM poses WHERE node IN (3, 5)),
moved AS (SELECT a.*, sqrt(power(a.x - p.x, 2) + power(a.y - p.y, 2) + power(a.z - p.z, 2)) / {DT} AS s FROM feet a LEFT JOIN feet p ON p.clip = a.clip AND p.node = a.node AND p.frame = a.frame - 1),
ground AS (SELECT clip, quantile_cont(h, 0.02) AS floor FROM (SELECT clip, frame, min(y) AS h FROM feet GROUP BY clip, frame) GROUP BY clip),
known AS (SELECT m.clip, m.frame, m.node, coalesce(m.s, n.s, 0) AS speed, m.y - ground.floor AS clearance, max(m.frame) OVER (PARTITION BY m.clip, m.node) AS last
  FROM moved m JOIN ground USING (clip) LEFT JOIN moved n ON m.frame = 0 AND n.clip = m.clip AND n.node = m.node AND n.frame = 1),
levels AS (SELECT clip, node, median(clearance) FILTER (speed < 60) AS low, quantile_cont(clearance, 0.9) AS high FROM known GROUP BY clip, node),
limited AS (SELECT known.*, {limit} AS height_limit FROM known JOIN levels USING (clip, node)){ctes},
both_ AS (SELECT clip, frame, node, speed, clearance, last, {' AND '.join(masks)} AS c FROM {src}),
o1 AS (SELECT *, frame - row_number() OVER ({_part}, c ORDER BY frame) AS g FROM both_),
o2 AS (SELECT *, count(*) OVER w AS n, min(frame) OVER w AS a, max(frame) OVER w AS b FROM o1 WINDOW w AS ({_part}, c, g)),
opened AS (SELECT * EXCLUDE (g, n, a, b, c), CASE WHEN c AND n < 2 AND a > 0 AND b < last THEN FALSE ELSE c END AS c FROM o2),
q1 AS (SELECT *, frame - row_number() OVER ({_part}, c ORDER BY frame) AS g FROM opened),
q2 AS (SELECT *, count(*) OVER w AS n, min(frame) OVER w AS a, max(frame) OVER w AS b FROM q1 WINDOW w AS ({_part}, c, g))
SELECT clip, frame, node, c OR (n < 2 AND a > 0 AND b < last) AS contact, {_r('speed', 'speed')}, {_r('clearance', 'clearance')} FROM q2"""


for _m in ("velocity", "height", "combined"):
    _SQL[f"contacts_{_m}"] = _contacts(_m)

# ---- rotations
_Q = tuple[str, str, str, str]


def _times(p: _Q, q: _Q) -> _Q:
    a, b, c, d = p
    e, f, g, h = q
    return (f"({a} * {e} - {b} * {f} - {c} * {g} - {d} * {h})", f"({a} * {f} + {b} * {e} + {c} * {h} - {d} * {g})", f"({a} * {g} + {c} * {e} + {d} * {f} - {b} * {h})", f"({a} * {h} + {d} * {e} + {b} * {g} - {c} * {f})")


def _turned(q: _Q, k: int) -> list[str]:
    """Unit axis k turned by a unit quaternion: v + 2 w (u x v) + 2 u x (u x v)."""
    w, u = q[0], q[1:]
    v = ["0.0", "0.0", "0.0"]
    v[k] = "1.0"
    i, j = (k + 1) % 3, (k + 2) % 3
    uv = {k: "0.0", i: u[j], j: f"(-{u[i]})"}  # u x e_k
    out = []
    for a in range(3):
        b, c = (a + 1) % 3, (a + 2) % 3
        out.append(f"({v[a]} + 2.0 * {w} * {uv[a]} + 2.0 * ({u[b]} * {uv[c]} - {u[c]} * {uv[b]}))")
    return out


def _as_matrix(q: _Q) -> list[str]:
    columns = [_turned(q, k) for k in range(3)]
    return [columns[k][a] for a in range(3) for k in range(3)]


def _values(exprs: list[str], prefix: str = "r") -> str:
    return ", ".join(_r(e, f"{prefix}{i}") for i, e in enumerate(exprs))


_norm = "sqrt(" + " + ".join(f"e[{i + 1}] * e[{i + 1}]" for i in range(4)) + ")"
_QUAT = f"WITH {ROWS}, u AS (SELECT clip, {', '.join(f'e[{i + 1}] / {_norm} AS q{i}' for i in range(4))} FROM r)"
_q = ("q0", "q1", "q2", "q3")
_SQL["quat_to_rotmat"] = f"{_QUAT} SELECT clip, {_values(_as_matrix(_q))} FROM u"
_angle = "sqrt(e[1] * e[1] + e[2] * e[2] + e[3] * e[3])"
_AXIS = f"WITH {ROWS}, u AS (SELECT clip, cos({_angle} / 2) AS q0, {', '.join(f'sin({_angle} / 2) * e[{i}] / {_angle} AS q{i}' for i in (1, 2, 3))} FROM r)"
_SQL["axisangle_to_rotmat"] = f"{_AXIS} SELECT clip, {_values(_as_matrix(_q))} FROM u"
_SQL["axisangle_to_quat"] = f"{_AXIS} SELECT clip, {_values([f'CASE WHEN q0 < 0 THEN -{c} ELSE {c} END' for c in _q])} FROM u"
_SQL["quat_to_axisangle"] = f"{_QUAT}, s AS (SELECT clip, {', '.join(f'CASE WHEN q0 < 0 THEN -{c} ELSE {c} END AS {c}' for c in _q)} FROM u) SELECT clip, {_values([f'{c} * 2.0 * acos(least(q0, 1.0)) / sqrt(greatest(1.0 - q0 * q0, 1e-300))' for c in _q[1:]])} FROM s"


def _about(axis: str, angle: str) -> _Q:
    return tuple([f"cos({angle} / 2.0)", *(f"sin({angle} / 2.0)" if c == axis else "0.0" for c in "XYZ")])


def _from_euler(order: str) -> str:
    h = [_about(c, f"e[{i + 1}]") for i, c in enumerate(order)]
    first = _times(h[0], h[1])
    third = h[2]
    names = ", ".join(f"{x} AS p{i}" for i, x in enumerate(first))
    both = _times(("p0", "p1", "p2", "p3"), third)
    return f"WITH {ROWS}, p AS (SELECT clip, e, {names} FROM r), u AS (SELECT clip, {', '.join(f'{x} AS q{i}' for i, x in enumerate(both))} FROM p)"


def _to_euler(order: str) -> list[str]:
    """Angles from half sums and half differences of the outer two, without a matrix."""
    i, j, k = (("XYZ".index(c)) for c in reversed(order))
    same = i == k
    if same:
        k = 3 - i - j
    sign = (i - j) * (j - k) * (k - i) // 2
    w, x, y, z = "q0", f"q{i + 1}", f"q{j + 1}", f"({sign}) * q{k + 1}"
    a, b, c, d = (w, x, y, z) if same else (f"({w} - {y})", f"({x} + {z})", f"({y} + {w})", f"({z} - {x})")
    plus, minus = f"atan2({b}, {a})", f"atan2({d}, {c})"
    middle = f"2.0 * atan2(sqrt({c} * {c} + {d} * {d}), sqrt({a} * {a} + {b} * {b}))"
    third, first = f"({plus} - {minus})", f"({plus} + {minus})"
    if not same:
        first, middle = f"({sign}) * {first}", f"{middle} - pi() / 2"
    wrap = lambda e: f"({e}) - 2 * pi() * round(({e}) / (2 * pi()))"
    return [wrap(first), middle, wrap(third)]


for _o in ("XYZ", "XZY", "YXZ", "YZX", "ZXY", "ZYX", "XYX", "XZX", "YXY", "YZY", "ZXZ", "ZYZ"):
    _SQL[f"euler_to_rotmat_{_o.lower()}"] = f"{_from_euler(_o)} SELECT clip, {_values(_as_matrix(_q))} FROM u"
    _SQL[f"rotmat_to_euler_{_o.lower()}"] = f"{_QUAT} SELECT clip, {_values(_to_euler(_o))} FROM u"
_SQL["euler_to_quat"] = f"{_from_euler('ZYX')} SELECT clip, {_values([f'CASE WHEN q0 < 0 THEN -{c} ELSE {c} END' for c in _q])} FROM u"
_SQL["axisangle_to_euler"] = f"{_AXIS} SELECT clip, {_values(_to_euler('ZYX'))} FROM u"


def _slerp() -> str:
    """p times a power of what turns p into q."""
    p, q = ("p0", "p1", "p2", "p3"), ("q0", "q1", "q2", "q3")
    size = lambda lo: "sqrt(" + " + ".join(f"e[{lo + i}] * e[{lo + i}]" for i in range(4)) + ")"
    units = ", ".join([f"CASE WHEN e[1] < 0 THEN -1 ELSE 1 END * e[{i + 1}] / {size(1)} AS p{i}" for i in range(4)] + [f"e[{i + 5}] / {size(5)} AS q{i}" for i in range(4)])
    back = (p[0], *(f"(-{c})" for c in p[1:]))
    rel = ", ".join(f"{x} AS d{i}" for i, x in enumerate(_times(back, q)))
    out = []
    for name, sign in (("r", "CASE WHEN d0 < 0 THEN -1 ELSE 1 END"), ("l", "1")):
        s = "sqrt(d1 * d1 + d2 * d2 + d3 * d3)"
        t = f"(0.3 * atan2({s}, ({sign}) * d0))"
        part = (f"cos{t}", *(f"({sign}) * d{i} / {s} * sin{t}" for i in (1, 2, 3)))
        out.append(", ".join(_r(x, f"{name}{i}") for i, x in enumerate(_times(p, tuple(f"({x})" for x in part)))))
    return f"WITH {ROWS}, u AS (SELECT clip, {units} FROM r), d AS (SELECT *, {rel} FROM u) SELECT clip, {out[0]}, {out[1]} FROM d"


_SQL["quat_slerp"] = _slerp()


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
