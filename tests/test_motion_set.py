"""The facade: sets of clips with proportions and rates of their own, held against loops over arrays."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridelake.operators import frames as FR
from stridelake.operators import kernels as KR
from stridelake.operators import orientation as O
from stridelake.operators import skeleton as K
from stridelake.plans import motion_set as MS
from stridelake.plans.motion_set import MotionSet
from stridelake.sources import motion_text as M

N = K.Node
RIG = K.sample_rig()
ORDERS = [n.order for n in RIG if n.joint >= 0]
#: A walker with feet, so that contacts and gait have something to go by.
WALKER = K.Topology(
    [N("Hips", -1, 0, "ZYX", (0, 0, 0)), N("Head", 0, 1, "ZXY", (0, 5, 0)), N("End", 1, -1, "", (0, 1, 0)), N("LeftFoot", 0, 2, "XYZ", (-1, -8, 0)), N("LEnd", 3, -1, "", (0, 0, 2)), N("RightFoot", 0, 3, "YXZ", (1, -8, 0)), N("REnd", 5, -1, "", (0, 0, 2))]
)


def motion(f, seed, joints=4):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(f, 3)).cumsum(0) * 3, rng.uniform(-1, 1, (f, joints, 3))


@pytest.fixture(scope="module")
def clip():
    return motion(12, 3)


@pytest.fixture(scope="module")
def one(spark, clip):
    root, angles = clip
    rows = [(0, i, root[i].tolist(), angles[i].ravel().tolist()) for i in range(len(root))]
    return MotionSet(RIG, spark.createDataFrame(rows, "clip long, frame long, root array<double>, angles array<double>").cache(), 0.1)


def at(df, *cols):
    """(F, ..., len(cols)) values in order of frame and node or joint."""
    by = [c for c in ("frame", "node", "joint") if c in df.columns]
    return np.array([list(r) for r in df.orderBy(*by).select(*cols).collect()], float)


def placed(s):
    """(F, N, 3) positions of a set of one clip."""
    return at(s.positions(), "x", "y", "z").reshape(-1, len(s.topology), 3)


def test_differences_of_joints(one, clip):
    p = K.pose_arrays(RIG, *clip)
    joints = [i for i, n in enumerate(RIG) if n.joint >= 0]
    d = p
    for order, got in ((1, one.joint_velocities()), (2, one.joint_accelerations()), (3, one.joint_jerk())):
        d = np.gradient(d, 0.1, axis=0)
        assert np.allclose(at(got, "dx", "dy", "dz").reshape(12, 4, 3), d[:, joints]), order
    v = np.linalg.norm(np.gradient(p, 0.1, axis=0), axis=-1)
    assert np.allclose(at(one.joint_speed_derivative(), "accel").reshape(12, 4), np.gradient(v, 0.1, axis=0)[:, joints])
    assert at(one.velocities(in_frames=True, stencil="forward", pad="none"), "dx").shape == (11 * 7, 1)


def test_rotations_round_trip(one, clip):
    m = FR.matrices_of(clip[1], "euler", ORDERS)
    for form, width in (("rotmat", 9), ("6d", 6), ("quat", 4), ("axisangle", 3), ("euler", 3)):
        rows = one.rotations(form)
        got = np.array([r.rotations for r in rows.orderBy("frame").collect()]).reshape(12, 4, width)
        assert np.allclose(FR.matrices_of(got, form, ORDERS), m)
        back = one.with_rotations(rows, form)
        assert np.allclose(placed(back), K.pose_arrays(RIG, *clip), atol=1e-7)
    q = FR.rotations_of(m, "quat", ORDERS)
    assert np.allclose(np.linalg.norm(q, axis=-1), 1) and (q[..., 0] >= 0).all()
    for j, o in enumerate(ORDERS):
        for k in range(3):
            assert np.allclose(m[k, j], np.linalg.multi_dot([KR_matrix(clip[1][k, j, i], c) for i, c in enumerate(o)]))
    with pytest.raises(ValueError):
        one.rotations("spin")
    with pytest.raises(Exception, match="numbers a frame"):
        one.with_rotations(one.rotations("quat"), "6d").frames.collect()
    turned = one.change_euler_order("xzy")
    assert turned.euler_orders == ["XZY"] * 4 and np.allclose(placed(turned), K.pose_arrays(RIG, *clip), atol=1e-7)
    assert one.change_euler_order("XZY", "Spine").euler_orders == [ORDERS[0], "XZY", *ORDERS[2:]]
    half = np.array([[[0.0, 0, 1, 0]]])
    assert np.allclose(FR.rotations_of(FR.matrices_of(half, "quat", ["XYZ"]), "axisangle", ["XYZ"]), [[[0, np.pi, 0]]])
    assert np.allclose(FR.matrices_of(np.zeros((1, 1, 3)), "axisangle", ["XYZ"]), np.eye(3))


def KR_matrix(a, axis):
    c, s = np.cos(a), np.sin(a)
    return np.array({"X": [[1, 0, 0], [0, c, -s], [0, s, c]], "Y": [[c, 0, s], [0, 1, 0], [-s, 0, c]], "Z": [[c, -s, 0], [s, c, 0], [0, 0, 1]]}[axis])


def log(m):
    w = np.array([m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1]]) / 2
    s = np.linalg.norm(w)
    return w * (np.arctan2(s, (np.trace(m) - 1) / 2) / s if s > 1e-12 else 1)


def test_angular_velocities(one, clip):
    m = FR.matrices_of(clip[1], "euler", ORDERS)
    step = lambda a, b: np.array([log(m[a, j].T @ m[b, j]) for j in range(4)])
    inner = [step(i - 1, i + 1) / 2 for i in range(1, 11)]
    for stencil, pad, want in (("central", "edge", [step(0, 1), *inner, step(10, 11)]), ("central", "none", inner), ("forward", "none", [step(i, i + 1) for i in range(11)]), ("forward", "edge", [step(min(i, 10), min(i, 10) + 1) for i in range(12)])):
        got = at(one.angular_velocities(stencil, pad), "w0", "w1", "w2").reshape(-1, 4, 3)
        assert np.allclose(got, np.array(want) / 0.1, atol=1e-6), (stencil, pad)
    assert np.allclose(at(one.angular_velocities(degrees=True, in_frames=True), "w0").reshape(-1, 4)[0], np.degrees(step(0, 1)[:, 0]))


def test_root_trajectory(one, clip):
    ahead = O.vector_of(one.rest_forward)
    f = FR.matrices_of(clip[1], "euler", ORDERS)[:, 0] @ ahead
    h = np.arctan2(f[:, 2], f[:, 0])
    got = at(one.root_trajectory(velocities=True), "ga", "gb", "sin_h", "cos_h", "va", "vb", "rate")
    g = clip[0][:, [0, 2]]
    assert np.allclose(got, np.column_stack([g, np.sin(h), np.cos(h), np.gradient(g, 0.1, axis=0), np.gradient(np.unwrap(h), 0.1)]))
    assert one.root_trajectory().columns == ["clip", "frame", "ga", "gb", "sin_h", "cos_h"] and one.root_trajectory(up="z").count() == 12


def test_descriptors(one, clip):
    p = K.pose_arrays(RIG, *clip)
    assert np.allclose(at(one.inter_joint_distance([("Spine", "LeftLeg")]), "d0")[:, 0], np.linalg.norm(p[:, 1] - p[:, 3], axis=1))
    a, b = p[:, 3] - p[:, 0], p[:, 5] - p[:, 0]
    angle = np.arctan2(np.linalg.norm(np.cross(a, b), axis=1), (a * b).sum(1))
    assert np.allclose(at(one.joint_angle("LeftLeg", "Hips", "RightLeg", degrees=True), "angle")[:, 0], np.degrees(angle))
    assert np.allclose(at(one.triangle_area("Hips", "LeftLeg", "RightLeg"), "area")[:, 0], np.linalg.norm(np.cross(a, b), axis=1) / 2)
    assert np.allclose(np.cos(at(one.segment_axis_angle("Hips", "Spine"), "angle")[:, 0]), (p[:, 1] - p[:, 0])[:, 1] / np.linalg.norm(p[:, 1] - p[:, 0], axis=1))
    w = {"Spine": 2.0, "LeftFoot": 1.0}
    com = (2 * p[:, 1] + p[:, 4]) / 3
    assert np.allclose(at(one.center_of_mass(w), "x", "y", "z"), com) and np.allclose(at(one.com_displacement(w), "travel")[:, 0], np.linalg.norm(com - com[0], axis=1))
    v = np.gradient(p, 0.1, axis=0)
    assert np.allclose(at(one.kinetic_energy({"Spine": 4.0}), "energy")[:, 0], 2 * (v[:, 1] ** 2).sum(1))
    assert np.allclose(at(one.range_of_motion("Spine"), "r0", "r1", "r2")[0], np.ptp(clip[1][:, 1], axis=0)) if "frame" in one.range_of_motion("Spine").columns else np.allclose(list(one.range_of_motion("Spine").first())[1:], np.ptp(clip[1][:, 1], axis=0))
    for r in one.bounding_ellipsoid().collect():
        assert r.volume == pytest.approx(KR.ellipsoid(p[r.frame])["volume"])
    speed = np.linalg.norm(v[:, 4], axis=1)
    assert one.smoothness("LeftFoot").first().sparc == pytest.approx(KR.spectral_arc_length(speed, 10.0))
    assert one.smoothness("LeftFoot", "speed_metric").first().speed_metric == pytest.approx(speed.mean() / speed.max())
    assert one.velocity_reductions("LeftFoot").first().peak == pytest.approx(speed.max())
    cross = np.cross(np.gradient(p[:, 4], 0.1, axis=0), np.gradient(np.gradient(p[:, 4], 0.1, axis=0), 0.1, axis=0))
    assert np.allclose(at(one.movement_phase("LeftFoot"), "movement_phase")[:, 0], np.linalg.norm(cross, axis=1) / speed**2)
    with pytest.raises(KeyError):
        one.center_of_mass({"Wing": 1.0})
    with pytest.raises(TypeError):
        one.curvature(3)


def test_turns_keep_or_move_the_poses(one, clip):
    p = K.pose_arrays(RIG, *clip)
    r = KR_matrix(0.7, "Y")
    for pivot, point in (("origin", np.zeros(3)), ("root", clip[0][0] * [1, 0, 1]), ((1.0, 9.0, 2.0), np.array([1.0, 0, 2.0]))):
        assert np.allclose(placed(one.rotate_vertical(0.7, pivot)), (p - point) @ r.T + point, atol=1e-6)
    assert np.allclose(placed(one.with_up("-y").rotate_vertical(40.0, degrees=True)), p @ KR_matrix(-np.radians(40), "Y").T, atol=1e-6)
    assert np.allclose(placed(one.translate_root((1, 2, 3))), p + [1, 2, 3])
    turned = one.reorient_world_up("+z")
    assert turned.up == "+z" and np.allclose(placed(turned), p[..., [0, 2, 1]] * [1, -1, 1], atol=1e-6) and one.reorient_world_up("+y") is one
    rest = one.reorient_rest_up("+z")
    assert rest.rest_up == "+z" and rest.up == "+y" and np.allclose(placed(rest), p, atol=1e-6)
    faced = one.reorient_rest_forward("+x")
    assert faced.rest_forward == "+x" and np.allclose(placed(faced), p, atol=1e-6)
    with pytest.raises(ValueError):
        one.reorient_rest_forward("+y")
    even = dataclasses.replace(one, topology=K.Topology([dataclasses.replace(n, order="ZXY") if n.joint >= 0 else n for n in RIG]))
    q = placed(even)
    mirrored = q * [-1, 1, 1]
    mirrored[:, [3, 4, 5, 6]] = mirrored[:, [5, 6, 3, 4]]
    assert np.allclose(placed(even.mirror()), mirrored, atol=1e-6) and np.allclose(placed(even.mirror().mirror()), q, atol=1e-6)
    with pytest.raises(ValueError):
        one.mirror({"Spine": "Wing"})
    assert np.allclose(placed(one.scale(2.0)), 2 * p)
    small = one.extract_joints(["Hips", "LeftLeg"])
    assert small.joint_names == ["Hips", "LeftLeg"] and np.allclose(placed(small)[:, :2], p[:, [0, 3]])


def test_noise_and_chance_repeat(one, clip):
    for make in (lambda s: s.add_rotation_noise(0.1, 5), lambda s: s.add_position_noise(0.1, 5), lambda s: s.random_translate_root(seed=5), lambda s: s.random_rotate_vertical(seed=5), lambda s: s.drop_frames(0.5, 5), lambda s: s.random_perturb_speed(seed=5)):
        a = make(one).frames.orderBy("frame").collect()
        b = make(dataclasses.replace(one, frames=one.frames.repartition(5))).frames.orderBy("frame").collect()
        assert a == b and a != one.frames.orderBy("frame").collect()
    kept = one.drop_frames(0.5, 5).frames.join(one.frames, ["clip", "frame", "root", "angles"]).count()
    assert 2 <= kept < 12
    assert one.add_rotation_noise(0.1, wrap=True, degrees=True).frames.count() == 12
    with pytest.raises(ValueError):
        one.drop_frames(1.0)


def test_frames_of_a_set(one, clip):
    numbers = list(range(12))
    for key in (slice(2, 9, 3), slice(None, None, -1), slice(-4, None), 5, -1):
        got = one[key]
        want = [numbers[key]] if isinstance(key, int) else numbers[key]
        assert np.allclose([r.root for r in got.frames.orderBy("frame").collect()], clip[0][want])
    assert one[::3].frame_time == pytest.approx(0.3) and len(one) == 12 and one.frame_counts().first().frame_count == 12
    both = (one + one).frames.orderBy("frame").collect()
    assert len(both) == 24 and both[12].root == clip[0][0].tolist()
    patched = one.splice(one[:3], 4).frames.orderBy("frame").collect()
    assert [r.root for r in patched[4:7]] == clip[0][:3].tolist() and patched[7].root == clip[0][7].tolist()
    assert one.copy_skeleton().frames.count() == 0 and one.with_fps(20).frame_time == 0.05
    faster = one.perturb_speed(2.0)
    assert faster.frame_time == 0.1 and faster.frames.count() == 6 and np.allclose(faster.frames.orderBy("frame").collect()[1].root, clip[0][2])
    moved = one.with_motion(one.frames.select("clip", "frame", F.transform("root", lambda x: x + 1).alias("root")))
    assert np.allclose(placed(moved), K.pose_arrays(RIG, *clip) + 1)


def test_what_a_set_says(one):
    assert one.euler_columns[:3] == ["Hips_X_pos", "Hips_Y_pos", "Hips_Z_pos"] and len(one.euler_columns) == 15
    assert one.joint_index == {"Hips": 0, "Spine": 1, "LeftLeg": 2, "RightLeg": 3} and one.index("RightLeg", "joint") == 3 and one.node_index["RightFoot"] == 6
    assert one.side_names == {"LeftLeg": "RightLeg"} and one.side_joints == [(2, 3)] and one.side_nodes == [(3, 5), (4, 6)] and one.has_side_geometry
    assert one.up_axis[:2] == (1, 1) and one.rest_up_axis[0] == 1 and one.forward_axis[0] == 2 and "4 joints" in repr(one)
    assert one.edges == [(1, 0), (2, 0), (3, 0)] and (6, 5) in one.node_edges and one.rest_angles().shape == (4, 3)
    for bad in ({"Spine": "Spine"}, {"Spine": "Wing"}, {"Spine": "LeftLeg", "Hips": "Spine"}):
        with pytest.raises(ValueError):
            one.with_sides(bad)
    assert one.with_sides({"LeftLeg": "RightLeg"}).side_joints == [(2, 3)]
    top = K.Topology.from_dict(one.hierarchy_dict())
    assert top == RIG and K.Topology.from_dict({k: {a: b for a, b in v.items() if a not in ("rot_channels", "children")} for k, v in one.hierarchy_dict().items()}, one.euler_columns) == RIG
    for bad in ({"a": {"offset": [0, 0, 0]}}, {"a": {"offset": [0, 0, 0], "parent": "b"}}, {"a": {"offset": [0, 0, 0], "parent": None, "children": ["c"]}}):
        with pytest.raises(ValueError):
            K.Topology.from_dict(bad)
    p = placed(one)[0]
    assert one.forward_at(0).first().forward == O.forward_at(RIG, p, "+y") and one.left_at(0).first().left == O.left_at(RIG, p, "+y")
    got = one.world_up_inferred().first()
    assert got.world_up == O.world_up(RIG, p) and not got.guessed


def test_up_of_hanging_rigs():
    down = K.Topology([N("a", -1, 0, "XYZ", (0, 0, 0)), N("b", 0, 1, "XYZ", (0, -5, 0)), N("e", 1, -1, "", (0, -2, 0))])
    assert O.rest_up(down) == "-y" and O.world_up(down) == "-y"
    twice = K.Topology([N("a", -1, 0, "XYZ", (0, 0, 0)), N("Head", 0, 1, "XYZ", (0, 0, 4)), N("head", 0, 2, "XYZ", (0, 0, 0))])
    assert O.rest_up(twice) == "+z"


def walk(f=200, dt=0.04):
    """Feet that rest in turns, half a second each."""
    t = np.arange(f)
    angles = np.zeros((f, 4, 3))
    angles[:, 2, 0] = 0.4 * np.sin(t * dt * 2 * np.pi)
    root = np.stack([0 * t, 8 + 0 * t, t * dt * 3], 1).astype(float)
    return root, angles


def test_feet_and_gait(spark):
    root, angles = walk()
    frames = spark.createDataFrame([(0, i, root[i].tolist(), angles[i].ravel().tolist()) for i in range(200)], "clip long, frame long, root array<double>, angles array<double>")
    s = MotionSet(WALKER, frames, 0.04)
    assert s.feet() == ["LeftFoot", "RightFoot"] and s.skeleton_size() == pytest.approx(np.sqrt(65))
    assert s.floor_height().first().floor == pytest.approx(0, abs=1e-6) and s.with_up("-y").floor_height().first().floor == pytest.approx(0, abs=1e-6)
    marks = spark.createDataFrame([(0, i, n, (i // 25 + k) % 2 == 0) for i in range(200) for k, n in enumerate((3, 5))], "clip long, frame long, node int, contact boolean")
    got = s.gait_parameters(contacts=marks).first()
    assert got.pace == pytest.approx(3) and got.stride_length == pytest.approx(6) and got.cadence == pytest.approx(7 / (199 * 0.04)) and got.stance_fraction == pytest.approx(0.5)
    assert s.cadence(contacts=marks).first().cadence == pytest.approx(got.cadence) and s.stride_length(contacts=marks).first().stride_length == pytest.approx(6)
    assert s.walking_pace().first().pace == pytest.approx(3)
    assert s.ground_contacts(["LeftFoot"], method="height").count() == 200 and s.gait_parameters().count() == 1
    layout = s.feature_layout("quat", velocities=True, contacts=True)
    rows = s.feature_array("quat", velocities=True, contacts=True, pad="none").orderBy("frame").collect()
    assert len(rows) == 198 and len(rows[0].features) == layout["foot_contacts"][1] and rows[0].features[2] == pytest.approx(root[1, 2])
    assert np.allclose(rows[0].features[slice(*layout["velocities"])][:3], (root[2] - root[0]) / 2)
    first = s.feature_array("euler", centered="first").orderBy("frame").first().features
    assert first[:3] == [0.0, 8.0, 0.0]


def write(folder, name, top, f, dt, seed, up=None):
    root, angles = motion(f, seed, len(top.joint_names))
    text = M.render(M.Clip(top, dt, root, angles * 0.1))
    (folder / name).write_text(text)
    c = M.parse(text)
    return K.pose_arrays(c.topology, c.root, c.angles)


def test_folders_of_unlike_clips(spark, tmp_path):
    tall = K.Topology([dataclasses.replace(n, offset=tuple(2 * x for x in n.offset)) for n in RIG])
    want = {"clip1.bvh": (write(tmp_path, "clip1.bvh", RIG, 5, 0.04, 1), 0.04), "clip10.bvh": (write(tmp_path, "clip10.bvh", tall, 7, 0.01, 2), 0.01)}
    write(tmp_path, "clip2.bvh", WALKER, 4, 0.04, 3)
    (tmp_path / "broken.bvh").write_text("HIERARCHY\nnothing")
    s = MotionSet.read(spark, str(tmp_path))
    files = M.read_files(spark, str(tmp_path)).where("error is null").select(F.xxhash64("source_path").alias("clip"), "source_path")
    names = {r.clip: r.source_path.rsplit("/", 1)[1] for r in files.collect()}
    assert {names[r.clip] for r in s.frames.select("clip").distinct().collect()} == set(want)
    speeds = s.velocities().join(files, "clip")
    for name, (p, dt) in want.items():
        rows = s.positions().join(files.where(F.col("source_path").endswith("/" + name)), "clip").orderBy("frame", "node").collect()
        assert np.allclose([[r.x, r.y, r.z] for r in rows], p.reshape(-1, 3), atol=1e-4)
        v = speeds.where(F.col("source_path").endswith("/" + name)).orderBy("frame", "node").collect()
        assert np.allclose([[r.dx, r.dy, r.dz] for r in v], np.gradient(p, dt, axis=0).reshape(-1, 3), atol=1e-2)
    gone = {r.source_path.rsplit("/", 1)[1]: r.reason for r in s.rejected.collect()}
    assert set(gone) == {"broken.bvh", "clip2.bvh"} and "MOTION" in gone["broken.bvh"] and gone["clip2.bvh"] == "another hierarchy from node 1"
    assert {r.fps for r in s.clips().collect()} == {25.0, 100.0} and [x.frame_time for x in s.by_rate()] == [0.01, 0.04]
    with pytest.raises(ValueError):
        s.foot_contacts(["LeftLeg"])
    with pytest.raises(ValueError):
        MotionSet.read(spark, str(tmp_path), skip_errors=False)
    first = MotionSet.read(spark, str(tmp_path), pattern="clip[0-9]*.bvh", order="natural", world_up="+z")
    assert first.frame_time == 0.04 and first.up == "+z"
    sets = MotionSet.read_all(spark, str(tmp_path))
    assert [len(x.topology) for x in sets] == [7, 7] and sum(x.frame_counts().count() for x in sets) == 3
    # one rate and one skeleton for all that have the hierarchy
    same, report = MS.harmonize(sets, sets[0], fps=50.0, euler_order="XYZ", world_up="+z", rest_forward="+x")
    assert len(same) == 1 and report[0]["done"].keys() == {"retarget", "resample", "world_up", "rest_forward", "euler_order"} and not report[1]["kept"]
    assert same[0].rest_forward == "+x" and same[0].up == "+z" and same[0].euler_orders == ["XYZ"] * 4 and "Spine" in report[1]["reason"] and "1 of 2" in MS.summary(report) and MS.summary(report[:1]) == ""
    assert {tuple(np.round(r.offsets, 6)) for r in same[0].frames.select("offsets").distinct().collect()} == {tuple(np.round([x for n in same[0].topology for x in n.offset], 6))}
    assert {r.fps for r in same[0].clips().collect()} == {50.0}
    with pytest.raises(ValueError):
        MS.harmonize(sets, sets[0], on_incompatible="raise")
    arrays = s.to_numpy("6d")
    assert sorted(a.shape for a in arrays) == [(5, 27), (7, 27)] and s.to_numpy("quat", pad=True, value=-1.0).shape == (2, 7, 19)
    padded = s.padded("euler", value=-1.0)
    assert padded.count() == 14 and padded.where("not real").count() == 2 and set(padded.where("not real").first().features) == {-1.0}
    paths = [r.path for r in s.write(str(tmp_path / "out")).collect()]
    again = MotionSet.read(spark, str(tmp_path / "out"))
    assert len(paths) == 2 and sorted(again.clips().select("frame_count", "fps").collect()) == sorted(s.clips().select("frame_count", "fps").collect())
    with pytest.raises(Exception, match="FileExistsError"):
        s.write(str(tmp_path / "out"), overwrite=False).collect()
    wide = s.to_wide()
    back = MotionSet.from_wide(wide, s.hierarchy_dict(), "clip")
    assert back.topology == s.topology and sorted(back.clips().select("frame_count", "fps").collect()) == sorted(s.clips().select("frame_count", "fps").collect())


def test_transforms_move_own_offsets_too(spark, tmp_path):
    tall = K.Topology([dataclasses.replace(n, offset=tuple(2 * x for x in n.offset)) for n in RIG])
    write(tmp_path, "a.bvh", RIG, 4, 0.04, 1)
    write(tmp_path, "b.bvh", tall, 4, 0.04, 2)
    s = MotionSet.read(spark, str(tmp_path), world_up="+y")
    order = lambda x: np.array([[r.x, r.y, r.z] for r in x.positions().orderBy("clip", "frame", "node").collect()]).reshape(2, 4, 7, 3)
    p = order(s)
    assert np.allclose(order(s.reorient_world_up("+z")), p[..., [0, 2, 1]] * [1, -1, 1], atol=1e-5) and np.allclose(order(s.reorient_rest_up("+x")), p, atol=1e-5) and np.allclose(order(s.scale(3)), 3 * p, atol=1e-5)
    m = p * [-1, 1, 1]
    m[:, :, [3, 4, 5, 6]] = m[:, :, [5, 6, 3, 4]]
    assert np.allclose(order(s.change_euler_order("ZXY").mirror()), m, atol=1e-5)
    assert np.allclose(order(s.retarget(s.topology)), order(s.with_topology(s.topology)), atol=1e-6)
    assert sorted(r.frame_count for r in s.resample(50.0).frame_counts().collect()) == [7, 7]


def plain_otsu(v, nbins=64):
    """The split of a histogram with the largest variance between classes, its middle if several are equal."""
    h, e = np.histogram(v, nbins)
    c = (e[1:] + e[:-1]) / 2
    score = []
    for k in range(nbins):
        lo, hi = h[: k + 1], h[k + 1 :]
        if lo.sum() == 0 or hi.sum() == 0:
            score.append(0.0)
            continue
        a, b = (lo * c[: k + 1]).sum() / lo.sum(), (hi * c[k + 1 :]).sum() / hi.sum()
        score.append(lo.sum() / len(v) * hi.sum() / len(v) * (a - b) ** 2)
    best = [k for k, x in enumerate(score) if x >= max(score) - 1e-12]
    return c[best[len(best) // 2]]


def test_threshold_between_two_classes():
    rng = np.random.default_rng(0)
    for lo, hi, n in ((0.1, 5.0, 200), (1.0, 3.0, 500), (0.5, 9.0, 40)):
        v = np.concatenate([rng.normal(lo, 0.1, n), rng.normal(hi, 0.3, 2 * n)])
        assert KR.otsu(v) == pytest.approx(plain_otsu(v))
    assert np.isnan(KR.otsu(rng.normal(size=400))) and np.isnan(KR.otsu(np.ones(50))) and np.isnan(KR.otsu(np.array([1.0, 2, 3])))
    assert np.isnan(KR.otsu(1.0 + np.arange(20) % 2 * 2.3e-16)) and np.isnan(KR.otsu(np.concatenate([rng.normal(0, 0.1, 400), rng.normal(5, 0.1, 10)])))
