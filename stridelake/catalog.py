"""Queries over the supplied tables and the DuckDB SQL that must agree with them.

A query is a function from ``duck`` to SQL text. For Spark the text names tables in braces, which
become DataFrames, so only the columns that a query uses are read; for DuckDB it names the views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stridelake import oracles, set_catalog
from stridelake.functions import rotations as R
from stridelake.functions import vectors as V
from stridelake.operators import contacts as C
from stridelake.operators import dataset as D
from stridelake.operators import pose as P
from stridelake.operators import series as S
from stridelake.operators import skeleton as K
from stridelake.plans import roles
from stridelake.plans.sql import names_of, over, rounded, spark_text, stages

Sql = Callable[[bool], str]
_SQL: dict[str, Sql] = {}
DT = "0.04"
FS = 25.0


def query(f: Sql) -> Sql:
    _SQL[f.__name__] = f
    return f


def out(src: str, keys: str, *values: str, **named: str) -> str:
    """Keys, and values rounded to six places."""
    cols = [*(f"{rounded(v)} AS {v}" for v in values), *(f"{rounded(e)} AS {n}" for n, e in named.items())]
    return f"SELECT {keys}, {', '.join(cols)} FROM ({src})"


def _register(name: str, f: Sql) -> None:
    _SQL[name] = f


# ---- series

@query
def velocity_summary(duck):
    """The first whole query: velocity of each clip's signal and statistics of it."""
    v = S.differences(roles.signal(duck), {"vel": "v"}, DT, duck=duck)
    return out(S.temporal_stats(v, "vel", duck=duck), "clip", "mean", "std", "least", "most", "skew", "kurt")


for _name, _order, _stencil, _pad, _rungs in (
    ("finite_difference_central", 1, "central", "edge", "late"),
    ("finite_difference_central_none", 1, "central", "none", "late"),
    ("finite_difference_forward", 1, "forward", "edge", "late"),
    ("finite_difference_forward_none", 1, "forward", "none", "late"),
    ("velocity_ladder_order2", 2, "central", "edge", "late"),
    ("velocity_ladder_order2_forward", 2, "forward", "edge", "late"),
    ("velocity_ladder_order2_forward_early", 2, "forward", "edge", "early"),
    ("velocity_ladder_order3", 3, "central", "edge", "late"),
    ("velocity_ladder_order3_none", 3, "central", "none", "late"),
):
    _register(_name, lambda duck, o=_order, s=_stencil, p=_pad, r=_rungs: out(S.differences(roles.signal(duck), {"d": "v"}, DT, o, s, p, duck, r), "clip, frame", "d"))


@query
def speed_derivative(duck):
    return out(S.speed_derivative(roles.trajectory(duck), ("x", "y", "z"), DT, duck=duck), "clip, frame", "speed", "accel")


@query
def speed_derivative_none(duck):
    return out(S.speed_derivative(roles.trajectory(duck), ("x", "y", "z"), DT, "none", duck), "clip, frame", "accel")


@query
def node_velocities(duck):
    return out(S.differences(roles.pose(duck), {"vx": "x", "vy": "y", "vz": "z"}, DT, duck=duck, keys="clip, node"), "clip, frame, node", "vx", "vy", "vz")


@query
def node_accelerations(duck):
    return out(S.differences(roles.pose(duck), {"ax": "x", "ay": "y", "az": "z"}, DT, 2, duck=duck, keys="clip, node"), "clip, frame, node", "ax", "ay", "az")


@query
def node_jerk(duck):
    return out(S.differences(roles.pose(duck), {"jx": "x", "jy": "y", "jz": "z"}, "1.0", 3, duck=duck, keys="clip, node"), "clip, frame, node", "jx", "jy", "jz")


@query
def joint_velocities(duck):
    joints = f"SELECT * FROM ({roles.pose(duck)}) WHERE node IN (0, 1, 3, 5)"
    return out(S.differences(joints, {"vx": "x", "vy": "y", "vz": "z"}, "1.0", duck=duck, keys="clip, node"), "clip, frame, node", "vx", "vy", "vz")


@query
def temporal_stats(duck):
    return out(S.temporal_stats(roles.signal(duck), "v", duck=duck), "clip", "mean", "std", "least", "most", "skew", "kurt")


@query
def box_filter_odd(duck):
    return out(S.box_filter(roles.signal(duck), "v", 5), "clip, frame", "smooth")


@query
def box_filter_even(duck):
    return out(S.box_filter(roles.signal(duck), "v", 4), "clip, frame", "smooth")


@query
def zero_crossings(duck):
    return S.zero_crossings(roles.wave(duck), "v")


@query
def number_of_peaks(duck):
    return S.number_of_peaks(roles.signal(duck), "v")


@query
def number_of_peaks_above(duck):
    return S.number_of_peaks(roles.signal(duck), "v", 20.0)


@query
def active_segments(duck):
    return f"SELECT clip, frame, active FROM ({S.active_segments(roles.signal(duck), 'v', 20.0)})"


@query
def active_duration(duck):
    return out(S.active_duration(roles.signal(duck), "v", 20.0, FS), "clip", "duration")


@query
def range_of_motion(duck):
    return out(S.range_of_motion(roles.signal(duck), "v"), "clip", "extent")


@query
def velocity_reductions(duck):
    return out(S.velocity_reductions(roles.signal(duck), "v", FS), "clip", "peak", "mean", "peak_to_mean", "peak_accel", "peak_decel")


@query
def speed_metric(duck):
    return out(S.speed_metric(roles.signal(duck), "v"), "clip", "speed_metric")


for _form, _alias in (("integrated", "integrated_squared_jerk"), ("mean", "mean_squared_jerk"), ("rms", "rms_squared_jerk")):
    _register(_alias, lambda duck, f=_form: out(S.squared_jerk(roles.wave(duck), "v", FS, f), "clip", f"{f}_squared_jerk"))


@query
def dimensionless_jerk(duck):
    return out(S.dimensionless_jerk(roles.wave(duck), "v", FS), "clip", "dlj")


@query
def dimensionless_jerk_mean(duck):
    return out(S.dimensionless_jerk(roles.wave(duck), "v", FS, "mean_speed"), "clip", "dlj")


@query
def dimensionless_jerk_amplitude(duck):
    return out(S.dimensionless_jerk(roles.wave(duck), "v", FS, "amplitude", "max(v) - min(v)"), "clip", "dlj")


@query
def log_dimensionless_jerk(duck):
    return out(S.dimensionless_jerk(roles.wave(duck), "v", FS, log=True), "clip", "ldlj")


# ---- trajectories

@query
def path_length(duck):
    return out(S.path_length(roles.trajectory(duck)), "clip", "path_length")


@query
def directness(duck):
    return out(S.directness(roles.trajectory(duck)), "clip", "directness")


@query
def curvature(duck):
    return out(S.curvature(roles.trajectory(duck), DT), "clip, frame", "curvature")


@query
def curvature_none(duck):
    return out(S.curvature(roles.trajectory(duck), DT, "none"), "clip, frame", "curvature")


@query
def torsion(duck):
    return out(S.torsion(roles.trajectory(duck), DT), "clip, frame", "torsion")


@query
def movement_phase(duck):
    return out(S.movement_phase(roles.trajectory(duck), DT), "clip, frame", "movement_phase")


@query
def ground_path(duck):
    return out(S.ground_path(roles.trajectory(duck)), "clip", "ground_length", "ground_area")


@query
def unwrap_angles(duck):
    s = f"SELECT clip, frame, v - 6.283185307179586 * floor(v / 6.283185307179586) AS a FROM ({roles.signal(duck)})"
    return out(S.unwrap_angles(s, "a"), "clip, frame", "unwrapped")


# ---- runs

def _active(duck):
    return f"SELECT clip, frame, v, v > 20.0 AS on_ FROM ({roles.signal(duck)})"


@query
def runs(duck):
    return S.runs(_active(duck), "on_")


@query
def filter_short_runs(duck):
    return f"SELECT clip, frame, filtered FROM ({S.drop_short_runs(_active(duck), 'on_', 2)})"


@query
def fill_short_gaps(duck):
    return f"SELECT clip, frame, filtered FROM ({S.drop_short_runs(_active(duck), 'on_', 3, value=False)})"


@query
def hysteresis_mask(duck):
    return f"SELECT clip, frame, held FROM ({S.hysteresis(roles.signal(duck), 'v', '10.0', '30.0')})"


@query
def release_open_runs(duck):
    s = S.release_open_runs(f"SELECT clip, frame, v, v < 30.0 AS weak, v < 15.0 AS raw FROM ({roles.signal(duck)})", "weak", "raw")
    return f"SELECT clip, frame, released FROM ({s})"


# ---- poses

@query
def inter_joint_distance(duck):
    return out(P.inter_joint_distance(roles.pose(duck), [(0, 1), (2, 5), (3, 20)]), "clip, frame", "d0", "d1", "d2")


def _nodes(duck, **names):
    return P.at_nodes(roles.pose(duck), names)


@query
def joint_angle(duck):
    a, b, c = V.vec("a"), V.vec("b"), V.vec("c")
    return out(_nodes(duck, a=0, b=1, c=2), "clip, frame", angle=V.joint_angle(a, b, c), degrees_=V.joint_angle(a, b, c, True))


@query
def segment_axis_angle(duck):
    seg = V.sub(V.vec("b"), V.vec("a"))
    return out(_nodes(duck, a=0, b=1), "clip, frame", angle=V.segment_axis_angle(seg, ("0.0", "1.0", "0.0")))


@query
def triangle_area(duck):
    return out(_nodes(duck, a=0, b=1, c=2), "clip, frame", area=V.triangle_area(V.vec("a"), V.vec("b"), V.vec("c")))


@query
def point_to_plane(duck):
    return out(_nodes(duck, a=0, b=1, c=2), "clip, frame", signed=V.plane_distance(V.vec("a"), V.vec("b"), V.vec("c")), unsigned_=V.plane_distance(V.vec("a"), V.vec("b"), V.vec("c"), False))


@query
def point_to_segment(duck):
    return out(_nodes(duck, a=0, b=1, c=2), "clip, frame", distance=V.segment_distance(V.vec("a"), V.vec("b"), V.vec("c")))


@query
def main_direction(duck):
    s = stages(_nodes(duck, a=0), {"axis": V.argmax_axis(V.vec("a"), "0.1")})
    x, y, z = V.axis_vector("axis")
    return f"SELECT clip, frame, axis, CAST({x} AS DOUBLE) AS ax, CAST({y} AS DOUBLE) AS ay, CAST({z} AS DOUBLE) AS az FROM ({s})"


@query
def signed_rotation_about_axis(duck):
    return out(_nodes(duck, a=0, b=1), "clip, frame", turn=V.signed_angle(V.vec("a"), V.vec("b"), ("0.0", "1.0", "0.0")))


@query
def bounding_box(duck):
    return out(P.bounding_box(roles.pose(duck)), "clip, frame", "lo_x", "hi_x", "lo_y", "hi_y", "lo_z", "hi_z", "volume")


@query
def bounding_sphere(duck):
    return out(P.bounding_sphere(roles.pose(duck)), "clip, frame", "cx", "cy", "cz", "radius")


@query
def center_of_mass(duck):
    return out(P.center_of_mass(roles.pose(duck), "(1.0 + node)"), "clip, frame", "x", "y", "z")


@query
def com_displacement(duck):
    return out(P.com_displacement(roles.pose(duck)), "clip, frame", "travel")


@query
def verticality(duck):
    return out(P.verticality(roles.pose(duck)), "clip, frame", "verticality")


def _other(duck):
    return f"SELECT clip, frame - 1 AS frame, node, x, y, z FROM ({roles.pose(duck)}) WHERE frame > 0"


@query
def pose_distance_frobenius(duck):
    return out(P.pose_distance(roles.pose(duck), _other(duck)), "clip, frame", "distance")


@query
def pose_distance_mpjpe(duck):
    return out(P.pose_distance(roles.pose(duck), _other(duck), "mpjpe"), "clip, frame", "distance")


@query
def mean_pose_subtract(duck):
    return out(P.mean_pose_subtract(roles.pose(duck)), "clip, frame, node", "mx", "my", "mz")


@query
def relative_scale_factor(duck):
    pair = P.at_nodes(roles.pose(duck), {"r": 0, "t": 1}, "clip, frame")
    return out(P.relative_scale(pair), "clip", "factor")


@query
def relative_scale_factor_centered(duck):
    pair = P.at_nodes(roles.pose(duck), {"r": 0, "t": 1}, "clip, frame")
    return out(P.relative_scale(pair, True), "clip", "factor")


@query
def kinetic_energy(duck):
    return out(P.kinetic_energy(roles.pose(duck), DT), "clip, frame", "energy")


@query
def kinetic_energy_masses(duck):
    return out(P.kinetic_energy(roles.pose(duck), DT, "1.0 + 0.5 * node"), "clip, frame", "energy")


@query
def facing_frame(duck):
    return out(P.facing(roles.pose(duck), [(3, 5), (4, 6)]), "clip, frame, valid", *(f"{d}_{c}" for d in ("forward", "left", "up") for c in "xyz"))


@query
def forward_at(duck):
    s = P.facing(roles.pose(duck), [(3, 5), (4, 6)])
    ahead, left = (tuple(f"{d}_{c}" for c in "xyz") for d in ("forward", "left"))
    return f"SELECT clip, frame, {V.argmax_axis(ahead)} AS forward_axis, {V.argmax_axis(left)} AS left_axis FROM ({s})"


# ---- rotations

def _e(n, lo=0):
    return tuple(f"e{i}" for i in range(lo, lo + n))


def _conversion(have, n, want, m, order=None, lo=0):
    def sql(duck):
        src = roles.rows(duck)
        return out(stages(src, *R.convert(_e(n, lo), have, want, "r", order)), "clip", *(f"r{i}" for i in range(m)))

    return sql


for _o in ("XYZ", "XZY", "YXZ", "YZX", "ZXY", "ZYX", "XYX", "XZX", "YXY", "YZY", "ZXZ", "ZYZ"):
    _register(f"euler_to_rotmat_{_o.lower()}", _conversion("euler", 3, "rotmat", 9, _o))
    _register(f"rotmat_to_euler_{_o.lower()}", _conversion("quat", 4, "euler", 3, _o))
for _name, _args in {
    "quat_to_rotmat": ("quat", 4, "rotmat", 9),
    "rotmat_to_quat": ("6d", 6, "quat", 4),
    "rot6d_to_rotmat": ("6d", 6, "rotmat", 9),
    "rotmat_to_rot6d": ("quat", 4, "6d", 6),
    "quat_to_axisangle": ("quat", 4, "axisangle", 3),
    "axisangle_to_rotmat": ("axisangle", 3, "rotmat", 9),
    "axisangle_roundtrip": ("axisangle", 3, "axisangle", 3),
    "axisangle_to_quat": ("axisangle", 3, "quat", 4),
}.items():
    _register(_name, _conversion(*_args))
_register("euler_to_quat", _conversion("euler", 3, "quat", 4, "ZYX"))
_register("euler_to_rot6d", _conversion("euler", 3, "6d", 6, "ZYX"))
_register("euler_to_axisangle", _conversion("euler", 3, "axisangle", 3, "ZYX"))
_register("rot6d_to_euler", _conversion("6d", 6, "euler", 3, "ZYX"))
_register("axisangle_to_euler", _conversion("axisangle", 3, "euler", 3, "ZYX"))


@query
def quat_multiply(duck):
    p = R.quat_multiply(_e(4), _e(4, 4))
    return out(roles.rows(duck), "clip", **{f"r{i}": c for i, c in enumerate(p)})


def _units(duck):
    return stages(roles.rows(duck), *R.unit_quat(_e(4), "p"), *R.unit_quat(_e(4, 4), "q", canonical=False))


@query
def quat_slerp(duck):
    p, q = R.names("p", 4), R.names("q", 4)
    return out(stages(_units(duck), *R.slerp(p, q, "0.3", "r"), *R.slerp(p, q, "0.3", "l", shortest=False)), "clip", *R.names("r", 4), *R.names("l", 4))


@query
def quat_unwrap(duck):
    return out(S.unwrap_quaternions(roles.turning(duck), _e(4)), "clip, frame", "u0", "u1", "u2", "u3")


@query
def se3_exp(duck):
    return out(stages(roles.rows(duck), *R.se3_exp(_e(6), "r")), "clip", *R.names("rR", 9), *R.names("rd", 3))


def _transforms(duck):
    return stages(roles.rows(duck), *R.vector_to_matrix(_e(3), "a"), *R.vector_to_matrix(_e(3, 3), "b"))


@query
def se3_log(duck):
    return out(stages(_transforms(duck), *R.se3_log(R.names("a", 9), _e(3, 6), "r")), "clip", *R.names("r", 6))


@query
def se3_inverse(duck):
    m, d = R.se3_inverse(R.names("a", 9), _e(3, 6))
    return out(_transforms(duck), "clip", **{f"m{i}": c for i, c in enumerate(m)}, **{f"d{i}": c for i, c in enumerate(d)})


@query
def screw_interpolate(duck):
    s = R.screw_interpolate(R.names("a", 9), _e(3, 6), R.names("b", 9), _e(3, 9), "0.25", "r")
    return out(stages(_transforms(duck), *s), "clip", *R.names("rR", 9), *R.names("rd", 3))


@query
def rotation_geodesic(duck):
    return out(stages(_transforms(duck), *R.geodesic(R.names("a", 9), R.names("b", 9), "r")), "clip", "r")


@query
def segment_frame(duck):
    return out(stages(roles.rows(duck), *R.segment_frame(_e(3), _e(3, 3), "r")), "clip", *R.names("r", 9))


@query
def relative_transform(duck):
    """The frame of one segment seen from that of another."""
    s = stages(roles.rows(duck), *R.segment_frame(_e(3), _e(3, 3), "m"), *R.segment_frame(_e(3, 6), _e(3, 9), "n"))
    inv, back = R.se3_inverse(R.names("m", 9), _e(3))
    rot, moved = R.matmul(inv, R.names("n", 9)), R.apply(inv, _e(3, 6))
    return out(s, "clip", **{f"r{i}": c for i, c in enumerate(rot)}, **{f"d{i}": f"{a} + {b}" for i, (a, b) in enumerate(zip(moved, back))})


@query
def angular_velocities(duck):
    """Rotation vectors from the frame before to the frame after, halved; one step at the ends."""
    u = stages(roles.turning(duck), *R.unit_quat(_e(4), "q"))
    w = over("clip")
    ends = {f"a{i}": f"coalesce(lag(q{i}) {w}, q{i})" for i in range(4)} | {f"b{i}": f"coalesce(lead(q{i}) {w}, q{i})" for i in range(4)} | {"inner_": f"lag(q0) {w} IS NOT NULL AND lead(q0) {w} IS NOT NULL"}
    turn = R.quat_multiply(R.quat_conjugate(R.names("a", 4)), R.names("b", 4))
    s = stages(u, ends, {f"d{i}": c for i, c in enumerate(turn)}, *R.quat_to_vector(R.names("d", 4), "v"))
    return out(s, "clip, frame", **{f"w{i}": f"v{i} / (CASE WHEN inner_ THEN 2.0 ELSE 1.0 END) / {DT}" for i in range(3)})


@query
def root_trajectory(duck):
    """Ground position, sine and cosine of the heading, and the heading's rate after unwrapping."""
    s = stages(roles.turning(duck), *R.quat_to_matrix(_e(4), "m"), {"heading": "atan2(m8, m2)"})
    s = S.differences(S.unwrap_angles(s, "heading", "whole"), {"rate": "whole"}, DT, duck=duck)
    return out(s, "clip, frame", ga="e1", gb="e2", sin_h="sin(heading)", cos_h="cos(heading)", rate="rate")


# ---- contacts and gait: nodes 3 and 5 of the poses as feet

def _feet(duck):
    return f"SELECT * FROM ({roles.pose(duck)}) WHERE node IN (3, 5)"


def _contacts(duck, **options):
    return C.contacts(_feet(duck), 0.04, scale=80.0, duck=duck, **options)


def _placed(duck, **options):
    return f"SELECT c.*, p.x, p.y, p.z FROM ({_contacts(duck, **options)}) c JOIN ({_feet(duck)}) p ON c.clip = p.clip AND c.frame = p.frame AND c.node = p.node"


@query
def foot_speed(duck):
    return out(C.foot_speed(_feet(duck), 0.04), "clip, frame, node", "speed")


@query
def foot_speed_smoothed(duck):
    return out(C.foot_speed(_feet(duck), 0.04, 0.17), "clip, frame, node", "speed")


@query
def floor_height(duck):
    return out(C.floor_height(roles.pose(duck), duck=duck), "clip", floor_="floor")


for _m in ("velocity", "height", "combined"):
    _register(f"contacts_{_m}", lambda duck, m=_m: out(_contacts(duck, method=m, vel_threshold=60.0, min_contact=0.08, min_gap=0.08), "clip, frame, node, contact", "speed", "clearance"))


@query
def ground_contacts(duck):
    return out(_contacts(duck, method="height", height_reference="floor", height_threshold=1.5), "clip, frame, node, contact", "clearance")


@query
def contacts_without_band(duck):
    return out(_contacts(duck, vel_threshold=60.0, band=0.0), "clip, frame, node, contact", "speed")


@query
def informed_height(duck):
    s = C.clearance(C.foot_speed(_feet(duck), 0.04), duck=duck)
    return out(C.informed_height(s, 60.0, 0.1, duck), "clip, node", "height_limit")


@query
def contact_events(duck):
    return C.events(_contacts(duck, method="height", height_threshold=1.5, min_contact=0.08, min_gap=0.08))


@query
def contact_diagnostics(duck):
    return out(C.diagnostics(_placed(duck, method="height", height_threshold=1.5), 80.0), "clip, node", "mean_skate", "max_skate", "contact_height", "airborne")


@query
def contact_confidence(duck):
    return out(C.confidence(_contacts(duck, vel_threshold=60.0, details=True)), "clip, node", "confidence")


@query
def contact_confidence_height(duck):
    return out(C.confidence(_contacts(duck, method="height", height_threshold=1.5, details=True), "height"), "clip, node", "confidence")


@query
def cadence(duck):
    return out(C.cadence(_contacts(duck, method="height", height_threshold=1.5), 0.04), "clip", "cadence")


@query
def stride_length(duck):
    return out(C.stride_length(_placed(duck, method="height", height_threshold=1.5)), "clip", "stride_length")


def _root(duck):
    return f"SELECT clip, frame, x, y, z FROM ({roles.pose(duck)}) WHERE node = 0"


@query
def walking_pace(duck):
    return out(C.walking_pace(_root(duck), 0.04), "clip", "pace")


@query
def gait_parameters(duck):
    g = C.gait(_placed(duck, method="height", height_threshold=1.5), _root(duck), 0.04, 3, 5, duck=duck)
    return out(g, "clip", "cadence", "stride_length", "stride_cv", "step_length", "stance_fraction", "double_support", "pace", "asymmetry")


# ---- skeletons: the sample rig, moved by the embeddings

RIG = K.sample_rig()


def _motion(duck):
    e = lambda i: f"CAST(embedding[{i + (1 if duck else 0)}] AS DOUBLE)"
    cols = [f"{e(i)} * 10.0 AS root_{c}" for i, c in enumerate("xyz")] + [f"{e(3 + 3 * j + k)} * 3.0 AS a{j}_{k}" for j in range(4) for k in range(3)]
    src = f"SELECT label AS clip, vec_id, {', '.join(cols)} FROM {'embeddings' if duck else '{embeddings}'}"
    return roles.numbered(src, "vec_id", ", ".join(c.rpartition(" ")[2] for c in cols))


def _places(prefix="p"):
    return [f"{prefix}{i}_{c}" for i in range(len(RIG)) for c in "xyz"]


@query
def fk_positions(duck):
    return out(K.fk_sql(_motion(duck), RIG), "clip, frame", *_places())


@query
def fk_root_centered(duck):
    return out(K.fk_sql(_motion(duck), RIG, "skeleton"), "clip, frame", *_places("q"))


@query
def fk_first_centered(duck):
    return out(K.fk_sql(_motion(duck), RIG, "first"), "clip, frame", *_places("q"))


@query
def rest_pose(duck):
    return out(K.rest_pose_sql(RIG.values()), "CAST(node_idx AS BIGINT) AS node, depth", "x", "y", "z")


@query
def topology_valid(duck):
    return f"SELECT {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in ('extra_roots', 'late_parents', 'root_sites', 'orphans', 'site_children', 'joint_gaps', 'bad_orders'))} FROM ({K.validate_sql(RIG.values())})"


@query
def topology_match(duck):
    taller = RIG.scale(1.1).values()
    return f"SELECT 'same' AS pair, matches, CAST(first_difference AS BIGINT) AS first_difference FROM ({K.matches_sql(RIG.values(), RIG.values())}) UNION ALL SELECT 'taller', matches, CAST(first_difference AS BIGINT) FROM ({K.matches_sql(RIG.values(), taller)})"


@query
def skeleton_edges(duck):
    return f"SELECT CAST(child AS BIGINT) AS child, CAST(parent AS BIGINT) AS parent FROM ({K.edges_sql(RIG.values())})"


@query
def joint_tips(duck):
    return f"SELECT CAST(joint AS BIGINT) AS joint, CAST(tip AS BIGINT) AS tip FROM ({K.tips_sql(RIG.values())})"


@query
def child_lists(duck):
    return f"SELECT CAST(node_idx AS BIGINT) AS node, name, children FROM ({K.hierarchy_text_sql(RIG.values(), duck)})"


@query
def retarget(duck):
    return out(K.retarget_sql(RIG.values(), RIG.scale(1.5).values()), "CAST(node_idx AS BIGINT) AS node, name", "off_x", "off_y", "off_z")


@query
def skeleton_size(duck):
    return out(K.size_sql(RIG.values(), [4, 6]), "1 AS one", size_="size")


@query
def l_r_name_pairs(duck):
    words = ("rig:LeftLeg", "rig:RightLeg", "arm_l.001", "arm_r.001", "arm_r", "LHand", "RHand", "Spine", "eye.Left", "eye.Right", "upperleftlip", "upperrightlip", "LEFTTOE", "Left", "tail_L")
    return K.lr_pairs_sql(" UNION ALL ".join(f"SELECT '{w}' AS name" for w in words))


@query
def natural_sort_key(duck):
    return f"SELECT p_partkey AS part, {K.natural_key_sql('p_name', duck)} AS sort_key FROM {'part' if duck else '{part}'}"


@query
def joint_speed_from_fk(duck):
    """Forward kinematics and then the speed of one node: Catalyst keeps only that node's chain."""
    s = f"SELECT clip, frame, p4_x AS x, p4_y AS y, p4_z AS z FROM ({K.fk_sql(_motion(duck), RIG)})"
    s = S.differences(s, {"vx": "x", "vy": "y", "vz": "z"}, DT, duck=duck)
    return out(s, "clip, frame", speed=V.norm(("vx", "vy", "vz")))


@query
def change_euler_order(duck):
    s = stages(_motion(duck), *R.euler_to_matrix(("a0_0", "a0_1", "a0_2"), "ZYX", "m"), *R.matrix_to_euler(R.names("m", 9), "XYZ", "n"))
    return out(s, "clip, frame", "n0", "n1", "n2")


ORDERS = [x.order for x in RIG if x.joint >= 0]


def _reoriented(duck, rest_only):
    s = D.reorient(_motion(duck), ORDERS, D.axis_rotation("+y", "+z"), rest_only)
    return out(s, "clip, frame", "n_root_x", "n_root_y", "n_root_z", *(f"n{j}_{k}" for j in range(len(ORDERS)) for k in range(3)))


@query
def reorient_world_up(duck):
    return _reoriented(duck, False)


@query
def reorient_rest_up(duck):
    return _reoriented(duck, True)


@query
def feature_array_full(duck):
    """Rotations with velocities per frame and contacts of the feet."""
    positions = K.fk_sql(_motion(duck), RIG)
    long = " UNION ALL ".join(f"SELECT clip, frame, {i} AS node, p{i}_x AS x, p{i}_y AS y, p{i}_z AS z FROM ({positions})" for i in (4, 6))
    v = S.differences(long, {"dx": "x", "dy": "y", "dz": "z"}, "1.0", pad="none", duck=duck, keys="clip, node")
    c = C.contacts(long, 0.04, method="height", height_threshold=5.0, duck=duck)
    rows = D.feature_rows(D.features(_motion(duck), ORDERS, "euler"), v, c, (4, 6), (4, 6))
    return out(rows, "clip, frame", *(f"f{i}" for i in range(15)), *(f"v{n}_{x}" for n in (4, 6) for x in "xyz"), "contact_4", "contact_6")


@query
def feature_array_6d(duck):
    n = 3 + 4 * 6
    return out(D.features(_motion(duck), [x.order for x in RIG if x.joint >= 0]), "clip, frame", *(f"f{i}" for i in range(n)))


@query
def feature_array_quat(duck):
    n = 3 + 4 * 4
    return out(D.features(_motion(duck), [x.order for x in RIG if x.joint >= 0], "quat"), "clip, frame", *(f"f{i}" for i in range(n)))


# ---- sets of clips

@query
def slice_step(duck):
    return out(D.slice_frames(roles.signal(duck), 5, -3, 4), "clip, new_frame AS frame", "v")


@query
def slice_reversed(duck):
    return out(D.slice_frames(roles.signal(duck), None, None, -2), "clip, new_frame AS frame", "v")


@query
def concat_clips(duck):
    s = roles.signal(duck)
    return out(D.concat(s, f"SELECT * FROM ({s}) WHERE frame < 10", "v"), "clip, frame", "v")


@query
def splice_frames(duck):
    s = roles.signal(duck)
    patch = f"SELECT clip, frame, -v AS v FROM ({s}) WHERE frame >= 3 AND frame < 7"
    return out((D.splice_duck if duck else D.splice)(s, patch, "v"), "clip, frame", "v")


@query
def resample_linear(duck):
    return out(D.resample(roles.trajectory(duck), 0.04, 40.0, ("x", "y", "z"), duck=duck), "clip, frame", "r_x", "r_y", "r_z")


@query
def resample_rotations(duck):
    u = stages(roles.turning(duck), *R.unit_quat(_e(4), "q"))
    return out(D.resample(u, 0.04, 16.0, (), (R.names("q", 4),), duck), "clip, frame", "r0_0", "r0_1", "r0_2", "r0_3")


@query
def perturb_speed(duck):
    """A tenth faster: sampled at the rate over the factor, the time between frames kept."""
    return out(D.resample(roles.signal(duck), 0.04, 25.0 / 1.1, ("v",), duck=duck), "clip, frame", "r_v")


@query
def pad_batch(duck):
    return out(D.pad(roles.signal(duck), "v", 0.0, duck), "clip, frame, real", "v")


@query
def translate_root(duck):
    return out(D.translate(roles.trajectory(duck), (1.0, -2.0, 0.5)), "clip, frame", "tx", "ty", "tz")


@query
def rotate_vertical(duck):
    return out(D.rotate_vertical(roles.trajectory(duck), "0.7", "y", ("1.0", "2.0")), "clip, frame", "tx", "ty", "tz")


@query
def mirror_pairs(duck):
    return out(D.mirror(roles.pose(duck), [(3, 5), (4, 6)]), "clip, frame, CAST(node AS INT) AS node", "x", "y", "z")


@query
def mirror_angles(duck):
    m = D.mirror_angles(("a0_0", "a0_1", "a0_2"), "ZYX")
    return out(_motion(duck), "clip, frame", **{f"m{i}": c for i, c in enumerate(m)})


@query
def drop_duplicate_pairs(duck):
    n = "nation" if duck else "{nation}"
    return f"SELECT DISTINCT least(a.n_nationkey, b.n_nationkey) AS first_key, greatest(a.n_nationkey, b.n_nationkey) AS second_key FROM {n} a JOIN {n} b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey <> b.n_nationkey"


@query
def snap_frame_time(duck):
    s = f"SELECT user_id AS clip, CAST(count(*) AS DOUBLE) AS n FROM {'events' if duck else '{events}'} GROUP BY user_id"
    s = stages(s, {"ft": "1.0 / n + 0.000001 * (n - 60.0)"})
    return out(s, "clip", frame_time=D.snap_frame_time("ft"))


@query
def harmonize_gate(duck):
    rows = " UNION ALL ".join(f"SELECT {c} AS clip, node_idx, name, parent_idx, euler_order FROM ({t.values()})" for c, t in ((1, RIG), (2, K.Topology(RIG[:5])), (3, RIG.scale(2.0))))
    sql = D.harmonized(rows, RIG.values())
    return sql.replace("AS STRING", "AS VARCHAR") if duck else sql


@query
def large_signal_stats(duck):
    """The line items of each supplier as a signal: the same operator over the largest table."""
    t = "lineitem" if duck else "{lineitem}"
    s = f"SELECT l_suppkey AS clip, l_quantity AS v FROM {t}"
    return out(S.temporal_stats(s, "v", duck=duck), "clip", "mean", "std", "least", "most", "skew", "kurt")


@query
def large_signal_velocity(duck):
    t = "lineitem" if duck else "{lineitem}"
    s = roles.numbered(f"SELECT l_suppkey AS clip, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM {t}", "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice", "l_extendedprice / 1000.0 AS v")
    return out(S.velocity_reductions(s, "v", 1.0), "clip", "peak", "mean", "peak_to_mean", "peak_accel", "peak_decel")


@query
def order_runs(duck):
    """Runs of dear orders of each customer."""
    t = "orders" if duck else "{orders}"
    s = roles.numbered(f"SELECT o_custkey AS clip, o_orderdate, o_orderkey, o_totalprice FROM {t}", "o_orderdate, o_orderkey", "o_totalprice > 150000 AS on_")
    return S.runs(s, "on_")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(f: Sql) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            text = spark_text(f(False))
            return spark.sql(text, **roles.load(spark, sf_dir, names_of(text)))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        return run

    return {name: bind(f) for name, f in _SQL.items()} | set_catalog.queries()


def oracle_sql() -> dict[str, str]:
    """SQL written apart from the operators where there is such, else the operators' text for DuckDB."""
    return {name: f(True) for name, f in _SQL.items()} | set_catalog.oracle_sql() | oracles.oracle_sql()
