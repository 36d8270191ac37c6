"""Queries through the facade, and DuckDB SQL from the definitions of their operators.

Here the two sides share no code path that computes values: Spark runs Arrow kernels and windows over
arrays of whole frames, DuckDB runs projections of scalar columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.functions import rotations as R
from stridelake.functions import vectors as V
from stridelake.operators import kernels as KR
from stridelake.operators import pose as P
from stridelake.operators import series as S
from stridelake.operators import skeleton as K
from stridelake.plans import roles
from stridelake.plans.motion_set import MotionSet
from stridelake.plans.sql import apply, over, rounded, spark_text, stages

RIG = K.sample_rig()
ORDERS = [n.order for n in RIG if n.joint >= 0]
JOINTS = [i for i, n in enumerate(RIG) if n.joint >= 0]
DT, FPS = 0.04, 25.0
_MADE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
#: Both sides round to so many places, far above their rounding errors.
_PLACES = 5


def _columns(one: int) -> list[str]:
    e = lambda i: f"CAST(embedding[{i + one}] AS DOUBLE)"
    return [f"{e(i)} * 10.0 AS root_{c}" for i, c in enumerate("xyz")] + [f"{e(3 + 3 * j + k)} * 3.0 AS a{j}_{k}" for j in range(len(JOINTS)) for k in range(3)]


#: embeddings as motion, for DuckDB: clip is the label, frames in order of id.
MOTION = f"SELECT label AS clip, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, {', '.join(_columns(1))} FROM embeddings"


def motion(spark: SparkSession, sf_dir: str) -> MotionSet:
    """The same rows as a set: arrays of whole frames."""
    src = roles.numbered(f"SELECT label AS clip, vec_id, {', '.join(_columns(0))} FROM {{t}}", "vec_id", ", ".join(c.rpartition(" ")[2] for c in _columns(0)))
    rows = apply(roles.load(spark, sf_dir, {"embeddings"})["embeddings"], src)
    angles = ", ".join(f"a{j}_{k}" for j in range(len(JOINTS)) for k in range(3))
    return MotionSet(RIG, rows.selectExpr("clip", "frame", "array(root_x, root_y, root_z) AS root", f"array({angles}) AS angles"), DT)


def _long(src: str = MOTION, topology: K.Topology = RIG) -> str:
    """(clip, frame, node, x, y, z) for DuckDB."""
    at = K.fk_sql(src, topology)
    return " UNION ALL ".join(f"SELECT clip, frame, {i} AS node, p{i}_x AS x, p{i}_y AS y, p{i}_z AS z FROM ({at})" for i in range(len(topology)))


def _out(src: str, keys: str, *values: str) -> str:
    return f"SELECT {keys}, {', '.join(f'{_double(v)} AS {v}' for v in values)} FROM ({src})"


def _double(v: str) -> str:
    return rounded(f"CAST({v} AS DOUBLE)", _PLACES)


def _add(name: str, run: Callable[[MotionSet], DataFrame], keys: str, values: str, sql: str | None) -> None:
    """``run`` gives ``keys`` and ``values`` (or arrays named like value[n]) of a set; ``sql`` gives the same to DuckDB."""
    _from(name, lambda spark, sf_dir: run(motion(spark, sf_dir)), keys, values, sql)


def _from(name: str, run: Callable[[SparkSession, str], DataFrame], keys: str, values: str, sql: str | None) -> None:
    cols = values.split()

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(spark, sf_dir).selectExpr(*[k.strip() for k in keys.split(",")], *[spark_text(f"{_double(c)} AS {c}") for c in cols])

    query.__name__ = name
    _MADE[name] = (query, _out(sql, keys, *cols) if sql else None)


def _plain(name: str, run: Callable[[DataFrame], DataFrame], keys: str, values: str, sql: str) -> None:
    """A query over the signals of ``roles.wave``."""
    _from(name, lambda spark, sf_dir: run(apply(roles.load(spark, sf_dir, {"embeddings"})["embeddings"], roles.wave(False).replace("{embeddings}", "{t}"))), keys, values, sql)


def _add_frames(name: str, run: Callable[[DataFrame], DataFrame], keys: str, values: str, sql: str) -> None:
    """A query over the poses of ``roles.pose``, a row for each frame with all coordinates in one array."""
    src = roles.numbered("SELECT label AS clip, vec_id, embedding FROM {t}", "vec_id", "transform(slice(embedding, 1, 63), v -> CAST(v AS DOUBLE) * 10.0) AS pos")
    _from(name, lambda spark, sf_dir: run(apply(roles.load(spark, sf_dir, {"embeddings"})["embeddings"], src)), keys, values, sql)


def _numbered(prefix: str, n: int) -> str:
    return " ".join(f"{prefix}{i}" for i in range(n))


def _spread(df: DataFrame, column: str, prefix: str, n: int) -> DataFrame:
    return df.select("*", *[F.col(column)[i].alias(f"{prefix}{i}") for i in range(n)])


# ---- positions and what follows from them

_W = over("clip, node")


def _gradient(c: str) -> str:
    return f"(CASE WHEN lag({c}) {_W} IS NULL THEN (lead({c}) {_W} - {c}) / {DT} WHEN lead({c}) {_W} IS NULL THEN ({c} - lag({c}) {_W}) / {DT} ELSE (lead({c}) {_W} - lag({c}) {_W}) / {2 * DT} END)"


def _ladder(order: int) -> str:
    s = _long()
    for r in range(order):
        s = stages(s, {f"{'d' * (r + 1)}{c}": _gradient("d" * r + c) for c in "xyz"})
    last = "d" * order
    return f"SELECT clip, frame, node, {', '.join(f'{last}{c} AS o{c}' for c in 'xyz')} FROM ({s}) WHERE node IN ({', '.join(map(str, JOINTS))})"


_renamed = lambda df: df.selectExpr("clip", "frame", "node", "dx AS ox", "dy AS oy", "dz AS oz")
_add("set_positions", lambda s: s.positions(), "clip, frame, node", "x y z", _long())
for _n, _order in (("joint_velocities", 1), ("joint_accelerations", 2), ("joint_jerk", 3)):
    _add(f"set_{_n}", lambda s, n=_n: _renamed(getattr(s, n)()), "clip, frame, node", "ox oy oz", _ladder(_order))
_speeds = stages(stages(_long(), {f"d{c}": _gradient(c) for c in "xyz"}), {"speed": "sqrt(dx * dx + dy * dy + dz * dz)"})
_add("set_joint_speed_derivative", lambda s: s.joint_speed_derivative(), "clip, frame, node", "accel", f"SELECT * FROM ({stages(_speeds, {'accel': _gradient('speed')})}) WHERE node IN ({', '.join(map(str, JOINTS))})")

_P = K.fk_sql(MOTION, RIG)
_pt = lambda i: tuple(f"p{i}_{c}" for c in "xyz")
_law = lambda a, v, b: f"acos(greatest(least(({a} * {a} + {b} * {b} - {v} * {v}) / (2.0 * {a} * {b}), 1.0), -1.0))"
_sides = stages(_P, {"sa": V.norm(V.sub(_pt(3), _pt(0))), "sb": V.norm(V.sub(_pt(5), _pt(0))), "sc": V.norm(V.sub(_pt(3), _pt(5)))})
_add("set_joint_angle", lambda s: s.joint_angle("LeftLeg", "Hips", "RightLeg"), "clip, frame", "angle", stages(_sides, {"angle": _law("sa", "sc", "sb")}))
_half = "((sa + sb + sc) / 2.0)"
_add("set_triangle_area", lambda s: s.triangle_area("Hips", "LeftLeg", "RightLeg"), "clip, frame", "area", stages(_sides, {"area": f"sqrt(greatest({_half} * ({_half} - sa) * ({_half} - sb) * ({_half} - sc), 0.0))"}))
_add("set_inter_joint_distance", lambda s: s.inter_joint_distance([("Hips", "LeftLeg"), ("LeftLeg", "RightLeg")]), "clip, frame", "d0 d1", f"SELECT clip, frame, sa AS d0, sc AS d1 FROM ({_sides})")
_add("set_segment_axis_angle", lambda s: s.segment_axis_angle("Hips", "Spine"), "clip, frame", "angle", stages(_P, {"angle": f"acos((p1_y - p0_y) / {V.norm(V.sub(_pt(1), _pt(0)))})"}))
_com = stages(_P, {c: f"(2.0 * p1_{c} + p4_{c}) / 3.0" for c in "xyz"})
_weights = {"Spine": 2.0, "LeftFoot": 1.0}
_add("set_center_of_mass", lambda s: s.center_of_mass(_weights), "clip, frame", "x y z", _com)
_first = "OVER (PARTITION BY clip ORDER BY frame)"
_add("set_com_displacement", lambda s: s.com_displacement(_weights), "clip, frame", "travel", stages(_com, {"travel": "sqrt(" + " + ".join(f"power({c} - first_value({c}) {_first}, 2)" for c in "xyz") + ")"}))
_add("set_kinetic_energy", lambda s: s.kinetic_energy({"Spine": 4.0, "LeftLeg": 1.0}), "clip, frame", "energy", f"SELECT clip, frame, sum((CASE node WHEN 1 THEN 2.0 WHEN 3 THEN 0.5 ELSE 0.0 END) * speed * speed) AS energy FROM ({_speeds}) GROUP BY clip, frame")
_foot = f"SELECT * FROM ({_speeds}) WHERE node = 4"
_add("set_speed", lambda s: s.speed("LeftFoot"), "clip, frame", "v", f"SELECT *, speed AS v FROM ({_foot})")
_add("set_speed_metric", lambda s: s.smoothness("LeftFoot", "speed_metric"), "clip", "speed_metric", f"SELECT clip, avg(speed) / max(speed) AS speed_metric FROM ({_foot}) GROUP BY clip")
_step = stages(_foot, {"__d": f"(lead(speed) {over('clip')} - speed) / {DT}"})
_add(
    "set_velocity_reductions", lambda s: s.velocity_reductions("LeftFoot"), "clip", "peak mean peak_to_mean peak_accel peak_decel",
    f"SELECT clip, max(speed) AS peak, avg(speed) AS mean, max(speed) / avg(speed) AS peak_to_mean, greatest(coalesce(max(__d), 0.0), 0.0) AS peak_accel, greatest(coalesce(max(-__d), 0.0), 0.0) AS peak_decel FROM ({_step}) GROUP BY clip",
)
_ddx = stages(_foot, {f"d2{c}": _gradient(f"d{c}") for c in "xyz"})
_swept = " + ".join(f"power(d{a} * d2{b} - d{b} * d2{a}, 2)" for a, b in ("xy", "yz", "zx"))
_add("set_movement_phase", lambda s: s.movement_phase("LeftFoot"), "clip, frame", "movement_phase", f"SELECT *, sqrt({_swept}) / (speed * speed) AS movement_phase FROM ({_ddx})")
_add("set_range_of_motion", lambda s: s.range_of_motion("Spine"), "clip", "r0 r1 r2", f"SELECT clip, {', '.join(f'max(a1_{k}) - min(a1_{k}) AS r{k}' for k in range(3))} FROM ({MOTION}) GROUP BY clip")
_add("set_floor_height", lambda s: s.floor_height(), "clip", "floor", f"SELECT clip, quantile_cont(h, 0.02) AS floor FROM (SELECT clip, frame, min(y) AS h FROM ({_long()}) GROUP BY clip, frame) GROUP BY clip")

# ---- rotations

_turns = [x for j, o in enumerate(ORDERS) for x in R.euler_to_matrix(tuple(f"a{j}_{k}" for k in range(3)), o, f"m{j}_")]
_M = stages(MOTION, *_turns)


def _each(form: str, width: int, steps: Callable[[int], list[dict[str, str]]]) -> None:
    s = _M
    for j in range(len(JOINTS)):
        s = stages(s, *steps(j))
    names = [f"r{j * width + k}" for j in range(len(JOINTS)) for k in range(width)]
    run = lambda t: _spread(t.rotations(form), "rotations", "r", width * len(JOINTS))
    _add(f"set_to_{form}", run, "clip, frame", " ".join(names), s)
    # and back again, as matrices, which are the same for every choice of angles
    back = lambda t: _spread(t.with_rotations(t.rotations(form), form).rotations("rotmat"), "rotations", "r", 9 * len(JOINTS))
    flat = stages(_M, {f"r{9 * j + k}": f"m{j}_{k}" for j in range(len(JOINTS)) for k in range(9)})
    _add(f"set_from_{form}", back, "clip, frame", _numbered("r", 9 * len(JOINTS)), flat)


_each("rotmat", 9, lambda j: [{f"r{9 * j + k}": f"m{j}_{k}" for k in range(9)}])
_each("6d", 6, lambda j: [{f"r{6 * j + k}": f"m{j}_{3 * (k % 3) + k // 3}" for k in range(6)}])
_each("quat", 4, lambda j: R.matrix_to_quat(R.names(f"m{j}_", 9), f"q{j}_") + [{f"r{4 * j + k}": f"q{j}_{k}" for k in range(4)}])
_each("axisangle", 3, lambda j: R.matrix_to_vector(R.names(f"m{j}_", 9), f"v{j}_") + [{f"r{3 * j + k}": f"v{j}_{k}" for k in range(3)}])
_order = stages(_M, *[x for j in range(len(JOINTS)) for x in R.matrix_to_euler(R.names(f"m{j}_", 9), "XZY", f"n{j}_")], {f"r{3 * j + k}": f"n{j}_{k}" for j in range(len(JOINTS)) for k in range(3)})
_add("set_change_euler_order", lambda s: _spread(s.change_euler_order("XZY").frames, "angles", "r", 12), "clip, frame", _numbered("r", 12), _order)

_joint = " UNION ALL ".join(f"SELECT clip, frame, {j} AS joint, {', '.join(f'm{j}_{k} AS m{k}' for k in range(9))} FROM ({_M})" for j in range(len(JOINTS)))
_J = over("clip, joint")
_was = stages(_joint, {f"u{k}": f"coalesce(lag(m{k}) {_J}, m{k})" for k in range(9)} | {f"w_{k}": f"coalesce(lead(m{k}) {_J}, m{k})" for k in range(9)} | {"span": f"(CASE WHEN lag(m0) {_J} IS NULL OR lead(m0) {_J} IS NULL THEN 1.0 ELSE 2.0 END)"})
_rel = stages(_was, dict(zip(R.names("t", 9), R.matmul(R.transpose(R.names("u", 9)), R.names("w_", 9)))))
for _part in R.matrix_to_vector(R.names("t", 9), "v"):
    _rel = stages(_rel, _part)
_add("set_angular_velocities", lambda s: s.angular_velocities(), "clip, frame, joint", "w0 w1 w2", stages(_rel, {f"w{k}": f"v{k} / span / {DT}" for k in range(3)}))

# ---- turns of whole motions, by what they do to positions

_quarter = {"x": "x", "y": "-z", "z": "y"}  # +y to +z
_add("set_reorient_world_up", lambda s: s.reorient_world_up("+z").positions(), "clip, frame, node", "x y z", f"SELECT clip, frame, node, {', '.join(f'{e} AS {c}' for c, e in _quarter.items())} FROM ({_long()})")
_add("set_reorient_rest_up", lambda s: s.reorient_rest_up("+x").positions(), "clip, frame, node", "x y z", _long())
_add("set_reorient_rest_forward", lambda s: s.reorient_rest_forward("+x").positions(), "clip, frame, node", "x y z", _long())
_pivot = f"SELECT p.*, f.root_x AS fx, f.root_z AS fz FROM ({_long()}) p JOIN ({MOTION}) f ON p.clip = f.clip AND f.frame = 0"
_add("set_rotate_vertical", lambda s: s.rotate_vertical(0.7, "root").positions(), "clip, frame, node", "x y z", f"SELECT clip, frame, node, fx + cos(0.7) * (x - fx) + sin(0.7) * (z - fz) AS x, y, fz - sin(0.7) * (x - fx) + cos(0.7) * (z - fz) AS z FROM ({_pivot})")
_add("set_translate_root", lambda s: s.translate_root((1.0, 2.0, 3.0)).positions(), "clip, frame, node", "x y z", f"SELECT clip, frame, node, x + 1.0 AS x, y + 2.0 AS y, z + 3.0 AS z FROM ({_long()})")
_add("set_scale", lambda s: s.scale(2.0).positions(), "clip, frame, node", "x y z", f"SELECT clip, frame, node, 2.0 * x AS x, 2.0 * y AS y, 2.0 * z AS z FROM ({_long()})")
_even = K.Topology([K.Node(n.name, n.parent, n.joint, "ZXY" if n.joint >= 0 else "", n.offset) for n in RIG])
_swap = "CASE node WHEN 3 THEN 5 WHEN 5 THEN 3 WHEN 4 THEN 6 WHEN 6 THEN 4 ELSE node END"
_add("set_mirror", lambda s: s.with_topology(_even).mirror().positions(), "clip, frame, node", "x y z", f"SELECT clip, frame, {_swap} AS node, -x AS x, y, z FROM ({_long(MOTION, _even)})")
_tall = RIG.scale(3.0)
_add("set_retarget", lambda s: s.retarget(_tall).positions(), "clip, frame, node", "x y z", _long(MOTION, _tall))
_add("set_extract_joints", lambda s: s.extract_joints(["Hips", "LeftLeg"]).positions().where("node < 2"), "clip, frame, node", "x y z", f"SELECT clip, frame, CASE node WHEN 3 THEN 1 ELSE 0 END AS node, x, y, z FROM ({_long()}) WHERE node IN (0, 3)")

# ---- frames

_roots = lambda df: _spread(df, "root", "p", 3)
_last = f"SELECT *, max(frame) OVER (PARTITION BY clip) AS last FROM ({MOTION})"
_add("set_slice", lambda s: _roots(s[2:-1:3].frames), "clip, frame", "p0 p1 p2", f"SELECT clip, (frame - 2) // 3 AS frame, root_x AS p0, root_y AS p1, root_z AS p2 FROM ({_last}) WHERE frame >= 2 AND frame < last AND (frame - 2) % 3 = 0")
_add("set_reversed", lambda s: _roots(s[::-1].frames), "clip, frame", "p0 p1 p2", f"SELECT clip, last - frame AS frame, root_x AS p0, root_y AS p1, root_z AS p2 FROM ({_last})")
_add("set_concat", lambda s: _roots((s + s[:2]).frames), "clip, frame", "p0 p1 p2", f"SELECT clip, frame, root_x AS p0, root_y AS p1, root_z AS p2 FROM ({MOTION}) UNION ALL SELECT clip, last + 1 + frame, root_x, root_y, root_z FROM ({_last}) WHERE frame < 2")
_add("set_splice", lambda s: _roots(s.splice(s[:2], 1).frames), "clip, frame", "p0 p1 p2", f"SELECT a.clip, a.frame, {', '.join(f'coalesce(b.root_{c}, a.root_{c}) AS p{i}' for i, c in enumerate('xyz'))} FROM ({MOTION}) a LEFT JOIN ({MOTION}) b ON a.clip = b.clip AND b.frame = a.frame - 1 AND a.frame IN (1, 2)")
_grid = f"SELECT clip, unnest(range(CAST(2 * max(frame) + 1 AS BIGINT))) AS frame FROM ({MOTION}) GROUP BY clip"
_met = f"SELECT g.clip, g.frame, {', '.join(f'(a.root_{c} + coalesce(b.root_{c}, a.root_{c})) / 2.0 AS h{i}, a.root_{c} AS p_{i}' for i, c in enumerate('xyz'))} FROM ({_grid}) g JOIN ({MOTION}) a ON a.clip = g.clip AND a.frame = g.frame // 2 LEFT JOIN ({MOTION}) b ON b.clip = g.clip AND b.frame = g.frame // 2 + 1"
_add("set_resample", lambda s: _roots(s.resample(2 * FPS).frames), "clip, frame", "p0 p1 p2", f"SELECT clip, frame, {', '.join(f'CASE WHEN frame % 2 = 0 THEN p_{i} ELSE h{i} END AS p{i}' for i in range(3))} FROM ({_met})")
_feature = stages(_M, {f"f{i}": f"root_{c}" for i, c in enumerate("xyz")} | {f"f{3 + 6 * j + k}": f"m{j}_{3 * (k % 3) + k // 3}" for j in range(len(JOINTS)) for k in range(6)})
_add("set_feature_array", lambda s: _spread(s.feature_array("6d"), "features", "f", 27), "clip, frame", _numbered("f", 27), _feature)
_vel = f"SELECT clip, frame, {', '.join(f'max(CASE WHEN node = {n} THEN d{c} END) * {DT} AS f{15 + 3 * i + k}' for i, n in enumerate(JOINTS) for k, c in enumerate('xyz'))} FROM ({_speeds}) GROUP BY clip, frame"
_add("set_feature_velocities", lambda s: _spread(s.feature_array("euler", velocities=True), "features", "f", 27), "clip, frame", _numbered("f", 27), f"SELECT a.clip, a.frame, {', '.join(f'root_{c} AS f{i}' for i, c in enumerate('xyz'))}, {', '.join(f'a{j}_{k} AS f{3 + 3 * j + k}' for j in range(4) for k in range(3))}, v.* EXCLUDE (clip, frame) FROM ({MOTION}) a JOIN ({_vel}) v ON a.clip = v.clip AND a.frame = v.frame")
_ahead = f"SELECT *, -m0_2 AS ax, -m0_8 AS az FROM ({_M})"  # the rest pose faces -z
_add("set_root_trajectory", lambda s: s.root_trajectory(), "clip, frame", "ga gb sin_h cos_h", f"SELECT clip, frame, root_x AS ga, root_z AS gb, az / sqrt(ax * ax + az * az) AS sin_h, ax / sqrt(ax * ax + az * az) AS cos_h FROM ({_ahead})")
_add("set_frame_counts", lambda s: s.clips(), "clip", "frame_count fps", f"SELECT clip, count(*) AS frame_count, {FPS} AS fps FROM ({MOTION}) GROUP BY clip")
_pad = f"SELECT c.clip, unnest(range(CAST(t AS BIGINT) + 1)) AS frame FROM (SELECT DISTINCT clip FROM ({MOTION})) c, (SELECT max(frame) AS t FROM ({MOTION}))"
_add("set_padded", lambda s: _spread(s.padded("euler", value=-1.0), "features", "f", 3), "clip, frame, real", "f0 f1 f2", f"SELECT g.clip, g.frame, m.frame IS NOT NULL AS real, {', '.join(f'coalesce(m.root_{c}, -1.0) AS f{i}' for i, c in enumerate('xyz'))} FROM ({_pad}) g LEFT JOIN ({MOTION}) m ON m.clip = g.clip AND m.frame = g.frame")

# ---- transforms and covariances: kernels against sums over frequencies and self-joins

for _norm in ("backward", "ortho", "forward", "amplitude"):
    _plain(f"fft_magnitude_{_norm}", lambda w, n=_norm: KR.spectrum(w, FPS, n), "clip, k", "freq magnitude", S.spectrum(roles.wave(True), "v", FPS, _norm, duck=True))
_plain("dominant_frequency", lambda w: KR.dominant_frequency(w, FPS), "clip", "dominant", S.dominant_frequency(roles.wave(True), "v", FPS, duck=True))
_plain("spectral_arc_length", lambda w: KR.sparc(w.withColumn("v", F.abs("v")), FPS), "clip", "sparc", S.sparc_small(f"SELECT clip, frame, abs(v) AS v FROM ({roles.wave(True)})", "v", FPS, duck=True))
for _name, _lag in (("cov3dj", 0), ("lagged_covariance", 2)):
    _add_frames(_name, lambda p, n=_lag: KR.covariance(p, n), "clip, a, b", "cov", P.covariance(roles.pose(True), _lag, True))

# ---- kernels that have no SQL: rows only

_add("bounding_ellipsoid", lambda s: s.bounding_ellipsoid(), "clip, frame", "cx cy cz r0 r1 r2 volume", None)
_add("mean_rotation", lambda s: KR.mean_rotation(_spread(s.rotations("rotmat"), "rotations", "m", 9)), "clip", _numbered("m", 9), None)
_add("smoothness_sparc", lambda s: s.smoothness("LeftFoot"), "clip", "sparc", None)
_add("gait_parameters_adaptive", lambda s: s.gait_parameters(["LeftLeg", "RightLeg"]), "clip", "cadence pace", None)
_add("ramer_douglas_peucker", lambda s: KR.ramer_douglas_peucker(s.trajectory("Hips"), 5.0, ("x", "z")), "clip", "place x z", None)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _MADE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _MADE.items() if sql}
