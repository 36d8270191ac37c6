"""Skeletons, motion files, contacts, streams and the facade."""

import numpy as np
import pytest

from stridelake.operators import contacts as C
from stridelake.operators import skeleton as K
from stridelake.plans.motion_set import MotionSet
from stridelake.plans.sql import apply, spark_text
from stridelake.sources import motion_text as M

RIG = K.sample_rig()


def motion(f=6, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(f, 3)) * 10, rng.uniform(-2, 2, (f, 4, 3))


def arrays(spark, root, angles, clip=0):
    return spark.createDataFrame([(clip, i, root[i].tolist(), angles[i].ravel().tolist()) for i in range(len(root))], "clip long, frame long, root array<double>, angles array<double>")


def test_kinematics_forms_agree(spark):
    root, angles = motion()
    want = K.pose_arrays(RIG, root, angles)
    got = K.fk_kernel(arrays(spark, root, angles), RIG).orderBy("frame").collect()
    assert np.allclose([r.pos for r in got], want.reshape(6, -1))
    cols = ", ".join([f"root[{i}] AS root_{c}" for i, c in enumerate("xyz")] + [f"angles[{3 * j + k}] AS a{j}_{k}" for j in range(4) for k in range(3)])
    for centered, prefix, shift in (("world", "p", 0 * root), ("skeleton", "q", root), ("first", "q", np.tile(root[0] * [1, 0, 1], (6, 1)))):
        df = apply(arrays(spark, root, angles), K.fk_sql(f"SELECT clip, frame, {cols} FROM {{t}}", RIG, centered)).orderBy("frame")
        names = [f"{prefix}{i}_{c}" for i in range(7) for c in "xyz"]
        assert np.allclose([list(r) for r in df.select(*names).collect()], (want - shift[:, None]).reshape(6, -1))


def test_rest_pose_and_zero_angles_agree(spark):
    flat = K.pose_arrays(RIG, np.zeros((1, 3)), np.zeros((1, 4, 3)))[0]
    assert np.allclose(flat, RIG.rest_positions())
    rows = spark.sql(spark_text(K.rest_pose_sql(RIG.values()))).orderBy("node_idx").collect()
    assert np.allclose([[r.x, r.y, r.z] for r in rows], flat)


def test_topology_rules(spark):
    N = K.Node
    for nodes in (
        [],
        [N("a", -1, 0, "XYZ", (0, 0, 0)), N("b", -1, 1, "XYZ", (0, 0, 0))],
        [N("a", -1, -1, "", (0, 0, 0))],
        [N("a", -1, 0, "XYZ", (0, 0, 0)), N("b", 2, 1, "XYZ", (0, 0, 0)), N("c", 0, 2, "XYZ", (0, 0, 0))],
        [N("a", -1, 0, "XYZ", (0, 0, 0)), N("e", 0, -1, "", (0, 0, 0)), N("b", 1, 1, "XYZ", (0, 0, 0))],
        [N("a", -1, 0, "XYX", (0, 0, 0))],
        [N("a", -1, 0, "XYZ", (0, 0, 0)), N("b", 0, 2, "XYZ", (0, 0, 0))],
    ):
        with pytest.raises(ValueError):
            K.Topology(nodes)
    bad = "SELECT * FROM (VALUES (0, 'a', -1, 0, 'XYX', 0.0, 0.0, 0.0), (1, 'e', 0, -1, '', 0.0, 0.0, 0.0), (2, 'b', 1, 1, 'XYZ', 0.0, 0.0, 0.0), (3, 'c', 9, 3, 'ZYX', 0.0, 0.0, 0.0)) AS n(node_idx, name, parent_idx, joint_idx, euler_order, off_x, off_y, off_z)"
    r = spark.sql(spark_text(K.validate_sql(bad))).first()
    assert (r.extra_roots, r.late_parents, r.orphans, r.site_children, r.joint_gaps, r.bad_orders) == (0, 1, 1, 1, 1, 1)


def test_topology_operations():
    assert RIG.edges == [(1, 0), (2, 0), (3, 0)] and RIG.joint_tips == [None, 2, 4, 6]
    small = RIG.extract(["Hips", "LeftLeg"])
    assert [n.name for n in small] == ["Hips", "LeftLeg", "LeftLeg_end"] and small.rest_positions()[2].tolist() == [-3, -10, 0]
    only = RIG.extract(["Hips"])
    assert len(only) == 2 and only[1].is_end_site
    with pytest.raises(ValueError):
        RIG.extract(["Spine"])
    with pytest.raises(KeyError):
        RIG.extract(["Hips", "Tail"])
    m = RIG.mirrored({"LeftLeg": "RightLeg"}, 0)
    assert m.matches(RIG) and RIG.scale(2).matches(RIG, offsets=False) and not RIG.scale(2).matches(RIG)
    assert RIG.retarget(RIG.scale(2))[1].offset == (0.0, 20.0, 0.0)
    with pytest.raises(KeyError):
        RIG.retarget(K.Topology(RIG[:3]), strict=True)


TEXT = """HIERARCHY
ROOT Hips
{
  OFFSET 0 0 0
  CHANNELS 6 Zrotation Xposition Yposition Zposition Yrotation Xrotation
  JOINT Left Leg
  {
    CHANNELS 3 Xrotation Zrotation Yrotation
    OFFSET 1 -2 0.5
    End Site
    {
      OFFSET 0 -3 0
    }
  }
}
MOTION
Frames: 2
Frame Time: 0.033333
90 1 2 3 10 20 30 40 50
-90 4 5 6 0 0 0 0 0
"""


def test_motion_text_round_trip():
    c = M.parse(TEXT)
    assert c.frame_time == 1 / 30 and [n.order for n in c.topology] == ["ZYX", "XZY", ""]
    assert c.topology[1].name == "Left Leg" and c.root.tolist() == [[1, 2, 3], [4, 5, 6]]
    assert np.allclose(np.degrees(c.angles[0]), [[90, 10, 20], [30, 40, 50]])
    again = M.parse(M.render(c))
    assert again.topology.matches(c.topology, atol=1e-6) and np.allclose(again.angles, c.angles, atol=1e-7) and again.frame_time == c.frame_time
    assert M.snap(0.0417083750417) == 0.0417083750417 and M.snap(0.008333) == 1 / 120 and M.snap(0.0) == 0.0


@pytest.mark.parametrize(
    "change",
    [("MOTION", "NOTHING"), ("Frames: 2", "Frames: 3"), ("OFFSET 1 -2 0.5", ""), ("CHANNELS 3 Xrotation Zrotation Yrotation", "CHANNELS 2 Xrotation Zrotation"), ("Xrotation Zrotation Yrotation", "Xrotation Xrotation Yrotation"), ("      OFFSET 0 -3 0\n    }", "      OFFSET 0 -3 0"), ("HIERARCHY", "TREE"), ("Frame Time: 0.033333", "")],
)
def test_broken_motion_text(change):
    with pytest.raises(ValueError):
        M.parse(TEXT.replace(*change))


def test_folder_of_motion_files(spark, tmp_path):
    for name in ("b.bvh", "a.bvh"):
        (tmp_path / name).write_text(TEXT)
    (tmp_path / "broken.bvh").write_text("HIERARCHY")
    (tmp_path / "other.txt").write_text("x")
    files = M.read_files(spark, str(tmp_path)).cache()
    assert files.count() == 3 and files.where("error is not null").count() == 1
    assert M.clips(files).count() == 2 and M.nodes(files).count() == 6
    assert M.frames(files).where("frame = 1").first().root == [4.0, 5.0, 6.0]
    texts = M.write_texts(files).collect()
    assert len(texts) == 2 and M.parse(texts[0].value).root.shape == (2, 3)
    s = MotionSet.read(spark, str(tmp_path))
    assert s.fps == pytest.approx(30) and s.positions().count() == 2 * 2 * 3
    p = {(r.frame, r.node): (r.x, r.y, r.z) for r in s.positions().collect()}
    c = M.parse(TEXT)
    assert np.allclose([p[1, n] for n in range(3)], K.pose_arrays(c.topology, c.root, c.angles)[1])
    assert s.positions("first").where("frame = 0 and node = 0").first().y == 2
    assert s.path_length("Hips").first().path_length == pytest.approx(np.sqrt(27))
    with pytest.raises(KeyError):
        s.index("Nobody")
    wide = s.to_wide()
    back, step = M.from_wide(wide.where(f"clip = {s.frames.first().clip}"), s.topology)
    assert step == pytest.approx(1 / 30) and np.allclose(back.orderBy("frame").first().angles, c.angles[0].ravel())
    with pytest.raises(KeyError):
        M.from_wide(wide.drop("time"), s.topology)


def feet(spark, f=100):
    """Two nodes that rest and move in turns: one second each at 25 frames a second."""
    rows = []
    for t in range(f):
        for n, phase in ((3, 0), (5, 25)):
            down = (t + phase) // 25 % 2 == 0
            k = (t + phase) // 25 // 2
            x = k * 2.0 if down else k * 2.0 + (t + phase) % 25 / 12.5
            rows.append((0, t, n, x, 0.0 if down else 1.0, 0.1 * n))
    return spark.createDataFrame(rows, "clip long, frame long, node int, x double, y double, z double")


def test_contacts_of_a_walk(spark):
    df = feet(spark).cache()
    sql = C.contacts("SELECT * FROM {t}", 0.04, vel_threshold=0.5, height_threshold=0.2)
    got = apply(df, sql).orderBy("node", "frame").collect()
    want = [(t + phase) // 25 % 2 == 0 for phase in (0, 25) for t in range(100)]
    assert np.mean([r.contact == w for r, w in zip(got, want)]) > 0.97
    low = apply(df, C.contacts("SELECT * FROM {t}", 0.04, method="height", height_threshold=0.2)).orderBy("node", "frame").collect()
    assert [r.contact for r in low] == want
    ev = apply(df, C.events(C.contacts("SELECT * FROM {t}", 0.04, method="height", height_threshold=0.2))).collect()
    assert sorted((r.node, r.frame, r.kind) for r in ev) == [(3, 25, "offset"), (3, 50, "onset"), (3, 75, "offset"), (5, 25, "onset"), (5, 50, "offset"), (5, 75, "onset")]
    assert apply(df, C.cadence(C.contacts("SELECT * FROM {t}", 0.04, method="height", height_threshold=0.2), 0.04)).first().cadence == pytest.approx(3 / (99 * 0.04))
    with pytest.raises(ValueError):
        C.contacts("x", 0.04, method="guess")


def test_streams(spark, tmp_path):
    import datetime as dt

    from stridelake.streaming import causal

    start = dt.datetime(2024, 1, 1)
    rows = [(1, start + dt.timedelta(seconds=i), float(i * i)) for i in range(6)]
    schema = "k long, ts timestamp, v double"
    for i in range(2):
        spark.createDataFrame(rows[3 * i : 3 * i + 3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = causal.stream_velocity(stream, "k", "ts", "v").writeStream.format("memory").queryName("speeds").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [r.velocity for r in spark.table("speeds").orderBy("time").collect()]
    assert got[0] is None and [g for g in got if g is not None] == [1, 3, 5, 7, 9][: len([g for g in got if g is not None])]
    w = causal.windowed_stats(spark.createDataFrame(rows, schema), "k", "ts", "v", "3 seconds").orderBy("start").collect()
    assert [(r.n, r.most) for r in w] == [(3, 4.0), (3, 25.0)]
    assert causal.sessions(spark.createDataFrame(rows, schema), "k", "ts", "2 seconds").first().n == 6


def test_reorientation_keeps_the_motion(spark):
    from stridelake.operators import dataset as D

    root, angles = motion(5, 3)
    cols = ", ".join([f"root[{i}] AS root_{c}" for i, c in enumerate("xyz")] + [f"angles[{3 * j + k}] AS a{j}_{k}" for j in range(4) for k in range(3)])
    orders = [n.order for n in RIG if n.joint >= 0]
    want = K.pose_arrays(RIG, root, angles)
    for have, new in (("+y", "+z"), ("+y", "-y"), ("+y", "-x"), ("+y", "+y")):
        m = D.axis_rotation(have, new)
        r = np.array([float(x.strip("()")) for x in m]).reshape(3, 3)
        axis = lambda a: np.eye(3)["xyz".index(a[1])] * (-1 if a[0] == "-" else 1)
        assert np.allclose(r @ axis(have), axis(new)) and np.linalg.det(r) == pytest.approx(1)
        for rest_only in (False, True):
            df = apply(arrays(spark, root, angles), D.reorient(f"SELECT clip, frame, {cols} FROM {{t}}", orders, m, rest_only)).orderBy("frame").collect()
            new_root = np.array([[x.n_root_x, x.n_root_y, x.n_root_z] for x in df])
            new_angles = np.array([[[x[f"n{j}_{k}"] for k in range(3)] for j in range(4)] for x in df])
            got = K.pose_arrays(RIG.turned(m), new_root, new_angles)
            assert np.allclose(got, want if rest_only else want @ r.T, atol=1e-6)


def test_set_operations(spark):
    from stridelake.operators import dataset as D
    from stridelake.operators import kernels as KR

    root, angles = motion(9, 4)
    s = MotionSet(RIG, arrays(spark, root, angles), 0.1)
    same = s.resample(10.0)
    assert same.equals(s) or np.allclose([K.pose_arrays(RIG, np.array([r.root]), np.array(r.angles).reshape(1, 4, 3)) for r in same.frames.orderBy("frame").collect()], K.pose_arrays(RIG, root, angles)[:, None], atol=1e-6)
    assert s.harmonize(20.0).frames.count() == 17 and s.harmonize(10.0) is s and s.concat(s).frames.agg({"frame": "max"}).first()[0] == 17
    assert s.equals(s) and not s.equals(s.scale(2.0))
    q = KR._quaternions(np.array([np.eye(3), np.diag([1.0, -1, -1])]))
    assert np.allclose(np.abs(q), [[1, 0, 0, 0], [0, 1, 0, 0]])
    mid, turned = KR.resample_motion(np.zeros((2, 3)), np.array([[[0.0, 0, 0]], [[1.0, 0, 0]]]), ["ZYX"], 1.0, 2.0)
    assert np.allclose(turned[1, 0], [0.5, 0, 0]) and len(mid) == 3
    assert s.foot_contacts(["LeftFoot", "RightFoot"], adaptive=True).count() == 18 and s.foot_contacts(["LeftFoot", "RightFoot"]).columns[-1] == "contact"
    t = s.trajectory("Hips")
    for sql in (D.random_translate("SELECT * FROM {t}"), D.random_rotate_vertical("SELECT * FROM {t}"), D.random_perturb_speed("SELECT * FROM {t}", 0.1, ("x", "y", "z"))):
        a, b = apply(t, sql).orderBy("frame").collect(), apply(t.repartition(3), sql).orderBy("frame").collect()
        assert a == b and len(a) >= 7


def plain_gait(mask, pos, dt, way):
    """The measures of one clip by loops: mask (F, 2), ground positions (F, 2, 2)."""
    f = len(mask)
    on = [[t for t in range(1, f) if mask[t, k] and not mask[t - 1, k]] for k in range(2)]
    off = [[t for t in range(1, f) if not mask[t, k] and mask[t - 1, k]] for k in range(2)]
    strides = [[np.linalg.norm(pos[b, k] - pos[a, k]) for a, b in zip(on[k], on[k][1:])] for k in range(2)]
    pooled = np.concatenate(strides)
    resid = np.concatenate([np.array(s) - np.mean(s) for s in strides if len(s) >= 2])
    order = sorted((t, k) for k in range(2) for t in on[k])
    pts = np.array([pos[t, k] for t, k in order])
    cycles = [(next(o for o in off[k] if a < o <= b) - a) / (b - a) for k in range(2) for a, b in zip(on[k], on[k][1:])]
    m = [np.mean(s) for s in strides]
    return {
        "cadence": len(order) / ((f - 1) * dt), "stride_length": pooled.mean(), "stride_cv": resid.std() / pooled.mean(), "step_length": np.abs(np.diff(pts, axis=0) @ (way / np.linalg.norm(way))).mean(),
        "stance_fraction": np.mean(cycles), "double_support": np.mean(mask.sum(1) >= 2), "asymmetry": abs(m[0] - m[1]) / np.mean(m),
    }


def test_gait_matches_loops(spark):
    rng = np.random.default_rng(7)
    mask = np.stack([((np.arange(300) + 17 * k) // rng.integers(9, 14)) % 2 == 0 for k in range(2)], 1)
    pos = rng.normal(size=(300, 2, 2)).cumsum(0)
    df = spark.createDataFrame([(0, t, (3, 5)[k], float(pos[t, k, 0]), 0.0, float(pos[t, k, 1]), bool(mask[t, k])) for t in range(300) for k in range(2)], "clip long, frame long, node int, x double, y double, z double, contact boolean")
    root = spark.createDataFrame([(0, t, float(t), 1.0, 0.5 * t) for t in range(300)], "clip long, frame long, x double, y double, z double")
    got = apply(df, C.gait("SELECT * FROM {t}", "SELECT * FROM {r}", 0.04, 3, 5), r=root).first()
    for name, value in plain_gait(mask, pos, 0.04, np.array([299.0, 149.5])).items():
        assert got[name] == pytest.approx(value), name
    assert got.pace == pytest.approx(np.hypot(1, 0.5) / 0.04)


def test_smoothed_speed_repeats_the_ends(spark):
    rng = np.random.default_rng(8)
    p = rng.normal(size=(20, 3)).cumsum(0)
    df = spark.createDataFrame([(0, t, 3, *map(float, p[t])) for t in range(20)], "clip long, frame long, node int, x double, y double, z double")
    d = np.diff(p, axis=0)
    for smooth, n in ((0.04, 1), (0.17, 4), (0.2, 5)):
        lo, hi = (n - 1) // 2, n // 2
        padded = np.concatenate([np.repeat(d[:1], lo, 0), d, np.repeat(d[-1:], hi, 0)])
        mean = np.stack([np.convolve(padded[:, c], np.ones(n) / n, "valid") for c in range(3)], 1)
        v = np.linalg.norm(mean, axis=1) / 0.04
        got = [r.speed for r in apply(df, C.foot_speed("SELECT * FROM {t}", 0.04, smooth)).orderBy("frame").collect()]
        assert np.allclose(got, [v[0], *v])


def test_names_of_sides(spark):
    pairs = {"mix:LeftArm": "mix:RightArm", "arm.L": "arm.R", "arm_l.001": "arm_r.001", "eyeleft": "eyeright", "LHand": "RHand", "a_Left": "a_Right"}
    alone = ["Spine", "foot_l", "Lower", "other:RightArm", "left", "mix:LeftLeg"]
    names = [*pairs, *pairs.values(), *alone]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r.left_name: r.right_name for r in apply(df, K.lr_pairs_sql("SELECT * FROM {t}")).collect()} == pairs


def test_feet():
    N = K.Node
    leg = [N("Hips", -1, 0, "XYZ", (0, 0, 0)), N("LeftFoot", 0, 1, "XYZ", (0, -2, 0)), N("LeftToe", 1, 2, "XYZ", (0, -1, 0)), N("e", 2, -1, "", (0, 0, 1)), N("RightFoot", 0, 3, "XYZ", (0, -2, 0)), N("e", 4, -1, "", (0, 0, 1)), N("FootGear", 0, 4, "XYZ", (0, 1, 0))]
    assert K.Topology(leg).feet() == [2, 4]
    assert K.Topology([leg[0], N("FootGear", 0, 1, "XYZ", (0, 1, 0))]).feet() == [1] and RIG.feet() == []


def test_orientation(spark):
    from stridelake.operators import orientation as O

    assert O.name_pairs(RIG) == {"LeftLeg": "RightLeg"} and O.joint_pairs(RIG) == [(3, 5)]
    assert O.node_pairs(RIG) == ([(3, 5), (4, 6)], []) and O.node_pairs(K.Topology(RIG[:6])) == ([(3, 5)], [(3, 5)])
    with pytest.raises(ValueError):
        O.joint_pairs(RIG, {"LeftLeg": "Wing"}, strict=True)
    assert O.rest_up(RIG) == "+y" and O.rest_left(RIG) == "-x" and O.facing_is_measured(RIG, "+y") and not O.facing_is_measured(RIG, "+x")
    assert O.rest_forward(RIG, "+y") == "-z" and O.left_at(RIG, RIG.rest_positions(), "+y") == "-x"
    lone = K.Topology(RIG[:3])
    assert O.rest_forward(lone, "+y") == "+z" and not O.facing_is_measured(lone, "+y")
    up_z = RIG.rest_positions()[:, [0, 2, 1]]
    assert O.world_up(RIG, up_z) == "+z" and O.world_up(RIG) == "+y" and O.world_up(RIG, np.ones((7, 3))) == "+y"
    assert O.check_axis("-Z") == "-z" and O.check_axis("y", unsigned=True) == "+y"
    with pytest.raises(ValueError):
        O.check_axis("y")
    root, angles = motion(4, 9)
    s = MotionSet(RIG, arrays(spark, root, angles), 0.1)
    want = K.pose_arrays(RIG, root, angles)
    for r in s.facing().collect():
        f, left = np.array([r.forward_x, r.forward_y, r.forward_z]), np.array([r.left_x, r.left_y, r.left_z])
        d = (want[r.frame, 3] - want[r.frame, 5]) * [1, 0, 1]
        assert r.valid and np.allclose(left, d / np.linalg.norm(d)) and np.allclose(np.cross(f, left), [0, 1, 0])
    row = s.to_wide("coordinates").orderBy("frame").first()
    assert np.allclose([row.LeftFoot_X, row.LeftFoot_Y, row.LeftFoot_Z], want[0, 4])


def test_unions_that_meet_their_own_sums(spark):
    """Rows must not double where clips of a union are joined with an aggregate of it."""
    from pyspark.sql import functions as F

    from stridelake.plans.session import settle

    rows = settle(spark).range(2000).select((F.col("id") % 10).alias("clip"), F.col("id").alias("frame"), F.rand(1).alias("y"))
    half = apply(rows, "SELECT clip, frame, y, row_number() OVER (PARTITION BY clip ORDER BY frame) AS r FROM {t}")
    both = half.withColumn("node", F.lit(1)).unionByName(half.withColumn("node", F.lit(2)))
    assert both.join(both.groupBy("clip").agg(F.min("y").alias("low")), "clip").count() == 4000
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"
