"""A facade over clips, nodes and frames: one hierarchy, many recordings, each with its own proportions and rate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.functions import rotations as R
from stridelake.functions import vectors as V
from stridelake.operators import contacts as C
from stridelake.operators import dataset as D
from stridelake.operators import frames as FR
from stridelake.operators import kernels as KR
from stridelake.operators import orientation as O
from stridelake.operators import pose as P
from stridelake.operators import series as S
from stridelake.operators import skeleton as K
from stridelake.plans.session import settle
from stridelake.plans.sql import apply
from stridelake.sources import motion_text

_T = "SELECT * FROM {t}"
_CORE = ("clip", "frame", "root", "angles")
#: Columns that clips may have of their own: offsets of all nodes, seconds between frames.
_OWN = ("offsets", "dt")


@dataclass(frozen=True, eq=False)
class MotionSet:
    """``frames`` has (clip, frame, root array, angles array), and may have ``offsets`` and ``dt`` of each clip, which
    then stand for the topology's and for ``frame_time``. Every method returns a DataFrame or a new set; nothing is
    computed before an action. ``up`` is a signed axis; ``sides`` names right joints by left ones, by default by name.
    ``rejected`` holds (source_path, reason) of files that were read but are not in the set."""

    topology: K.Topology
    frames: DataFrame
    frame_time: float
    up: str = "+y"
    sides: Mapping[str, str] | None = None
    rejected: DataFrame | None = None
    position_order: str = "XYZ"

    def __post_init__(self):
        object.__setattr__(self, "up", O.check_axis(self.up, unsigned=True))
        if self.frame_time < 0:
            raise ValueError("the frame time is not negative")
        if self.sides is not None:
            O.check_sides(self.topology, self.sides)

    # ---- sources and sinks

    @classmethod
    def read(cls, spark: SparkSession, path: str, pattern: str = "*.bvh", world_up: str = "auto", sides: Mapping[str, str] | None = None, skip_errors: bool = True, order: str = "path") -> MotionSet:
        """The files of a folder that share the hierarchy and up axis of the first good one, by path or, with ``order``
        natural, by numbers in names. Each clip keeps its own offsets and rate. Other files are in ``rejected`` with the
        reason. A file that cannot be parsed is an error without ``skip_errors``."""
        files = motion_text.read_files(settle(spark), path, pattern)
        if not skip_errors:
            bad = files.where("error is not null").limit(1).collect()
            if bad:
                raise ValueError(f"{bad[0].source_path}: {bad[0].error}")
        by = F.expr(K.natural_key_sql("source_path")) if order == "natural" else F.col("source_path")
        one = files.where("error is null").select(*_SHAPE, "offsets", "frame_time").orderBy(by, "source_path").limit(1).collect()
        if not one:
            raise ValueError(f"no readable file in {path}")
        return cls._of(files, one[0], world_up, sides)

    @classmethod
    def read_all(cls, spark: SparkSession, path: str, pattern: str = "*.bvh", world_up: str = "auto", sides: Mapping[str, str] | None = None) -> list[MotionSet]:
        """One set for each hierarchy and up axis among the files of a folder, those of the first paths first. A row for
        each hierarchy comes to the driver, not for each file. Files that cannot be parsed are in ``rejected`` of each."""
        files = motion_text.read_files(settle(spark), path, pattern)
        kinds = files.where("error is null").groupBy(*_SHAPE).agg(F.min_by(F.struct("offsets", "frame_time"), "source_path").alias("o"), F.min("source_path").alias("p"))
        return [cls._of(files, r, world_up, sides) for r in kinds.select(*_SHAPE, "o.offsets", "o.frame_time", "p").orderBy("p").collect()]

    @classmethod
    def _of(cls, files: DataFrame, r, world_up: str, sides) -> MotionSet:
        off = np.array(r.offsets).reshape(-1, 3)
        top = K.Topology([K.Node(n, p, j, o, tuple(x)) for n, p, j, o, x in zip(r.names, r.parents, r.joints, r.orders, off.tolist())])
        same = F.lit(True)
        for c in ("names", "parents", "orders"):
            same = same & (F.col(c) == F.array(*map(F.lit, r[c])))
        mine = F.col("error").isNull() & same & (F.lit(True) if world_up != "auto" else F.col("world_up") == r.world_up)
        i = F.expr(f"filter(sequence(0, greatest(size(names), {len(r.names)}) - 1), i -> coalesce(get(names, i) != get(_n, i) or get(parents, i) != get(_p, i) or get(orders, i) != get(_o, i), true))[0]")
        have = files.withColumns({"_n": F.array(*map(F.lit, r.names)), "_p": F.array(*map(F.lit, r.parents)), "_o": F.array(*map(F.lit, r.orders))})
        reason = F.when(F.col("error").isNotNull(), F.col("error")).when(~same, F.concat(F.lit("another hierarchy from node "), i.cast("string"))).otherwise(F.concat(F.lit("another up axis: "), "world_up"))
        rejected = have.where(~F.coalesce(mine, F.lit(False))).select("source_path", reason.alias("reason"))
        up = r.world_up if world_up == "auto" else world_up
        return cls(top, motion_text.frames(files.where(mine)), r.frame_time, up, dict(sides) if sides else None, rejected, r.position_order)

    @classmethod
    def from_wide(cls, df: DataFrame, hierarchy: K.Topology | Mapping[str, Mapping], clip: str | None = None) -> MotionSet:
        """A set of a wide DataFrame; ``hierarchy`` is a topology or a dictionary as from ``hierarchy_dict``, whose missing
        channels come from the order of the columns. ``clip`` names a column that tells clips apart."""
        top = hierarchy if isinstance(hierarchy, K.Topology) else K.Topology.from_dict(hierarchy, df.columns)
        rows, step = motion_text.from_wide(df, top, clip)
        return cls(top, rows, step, O.world_up(top))

    def write(self, folder: str, overwrite: bool = True) -> DataFrame:
        """One motion text file for each clip, {clip}.bvh, written by the tasks; returns (clip, path)."""
        return motion_text.write_clips(self.frames, self.topology, self.frame_time, folder, self.position_order, overwrite)

    def to_wide(self, mode: str = "euler", centered: str = "world") -> DataFrame:
        """One row for each frame: time and angles in degrees, or time and the coordinates of every node by its place and name."""
        if mode == "euler":
            return motion_text.to_wide(self.frames, self.topology, self._dt)
        if mode != "coordinates":
            raise ValueError("mode is euler or coordinates")
        cols = [F.col("pos")[3 * i + k].alias(f"{n.name}_{c}") for i, n in enumerate(self.topology) for k, c in enumerate("XYZ")]
        time = (F.col("frame") * F.expr(self._dt)).alias("time")
        return self._poses(centered).select("clip", "frame", time, *cols)

    @property
    def euler_columns(self) -> list[str]:
        """The names of the wide form's motion columns."""
        top = self.topology
        return [f"{top[0].name}_{c}_pos" for c in self.position_order] + [f"{n.name}_{c}_rot" for n in top if n.joint >= 0 for c in n.order]

    def hierarchy_dict(self) -> dict[str, dict]:
        return self.topology.to_dict(self.position_order)

    # ---- what the set is

    def __repr__(self) -> str:
        return f"MotionSet({len(self.joint_names)} joints, {len(self.topology)} nodes, root {self.topology[0].name!r}, frame_time={self.frame_time:.6g}, up={self.up!r})"

    def __len__(self) -> int:
        """Frames of all clips; a job."""
        return self.frames.count()

    def frame_counts(self) -> DataFrame:
        """(clip, frame_count)."""
        return self.frames.groupBy("clip").agg(F.count("*").alias("frame_count"))

    def clips(self) -> DataFrame:
        """(clip, frame_count, frame_time, fps); a frame time of 0 has rate 0."""
        dt = F.first(F.expr(self._dt)).alias("frame_time")
        return self.frames.groupBy("clip").agg(F.count("*").alias("frame_count"), dt).withColumn("fps", F.expr("CASE WHEN frame_time > 0 THEN 1 / frame_time ELSE 0D END"))

    @property
    def fps(self) -> float:
        return 1 / self.frame_time if self.frame_time else 0.0

    @property
    def _dt(self) -> str:
        """SQL of the seconds between frames."""
        return "dt" if "dt" in self.frames.columns else repr(float(self.frame_time))

    def _one_rate(self) -> float:
        """The rate of all clips; an error where they differ, as ``resample`` and ``by_rate`` mend."""
        if "dt" in self.frames.columns:
            lo, hi = self.frames.agg(F.min("dt"), F.max("dt")).first()
            if lo is not None and hi != lo:
                raise ValueError("clips have different rates: resample them, or take by_rate()")
            if lo is not None and lo != self.frame_time:
                raise ValueError("frame_time is not that of the clips")
        return self.frame_time

    def by_rate(self) -> list[MotionSet]:
        """One set for each rate among the clips; a row for each rate comes to the driver."""
        if "dt" not in self.frames.columns:
            return [self]
        found = [r.dt for r in self.frames.select("dt").distinct().orderBy("dt").collect()]
        return [replace(self, frames=self.frames.where(F.col("dt") == t), frame_time=t) for t in found]

    def with_frame_time(self, seconds: float) -> MotionSet:
        """All clips at a rate, their frames as they are."""
        return replace(self, frames=self.frames.drop("dt"), frame_time=seconds)

    def with_fps(self, fps: float) -> MotionSet:
        if fps <= 0:
            raise ValueError("the rate is positive")
        return self.with_frame_time(1 / fps)

    def with_up(self, axis: str) -> MotionSet:
        return replace(self, up=O.check_axis(axis))

    def with_sides(self, sides: Mapping[str, str] | None) -> MotionSet:
        """Left joint names with their right ones: known joints, none of them twice. None: by name."""
        return replace(self, sides=dict(sides) if sides is not None else None)

    def with_topology(self, topology: K.Topology) -> MotionSet:
        """The same motion on another skeleton with as many joints; its offsets stand for those of all clips."""
        if len(topology.joint_names) != len(self.joint_names):
            raise ValueError("the skeletons have different numbers of joints")
        return replace(self, topology=topology, frames=self.frames.drop("offsets"))

    def with_motion(self, rows: DataFrame) -> MotionSet:
        """``root`` and ``angles``, either or both, from rows of (clip, frame, ...) for every frame."""
        new = [c for c in ("root", "angles") if c in rows.columns]
        kept = self.frames.drop(*new)
        return replace(self, frames=kept.join(rows.select("clip", "frame", *new), ["clip", "frame"]).select(*self.frames.columns))

    def copy_skeleton(self) -> MotionSet:
        """The same set without frames."""
        return replace(self, frames=self.frames.limit(0))

    @property
    def joint_names(self) -> list[str]:
        return self.topology.joint_names

    @property
    def joint_count(self) -> int:
        return len(self.joint_names)

    @property
    def euler_orders(self) -> list[str]:
        return [n.order for n in self.topology if n.joint >= 0]

    @property
    def node_index(self) -> dict[str, int]:
        """Node numbers by name; of repeated names the last."""
        return {n.name: i for i, n in enumerate(self.topology)}

    @property
    def joint_index(self) -> dict[str, int]:
        return {n.name: n.joint for n in self.topology if n.joint >= 0}

    def index(self, name: str, space: str = "node") -> int:
        """The node or joint of a name; of repeated names the last."""
        if space not in ("node", "joint"):
            raise ValueError("space is node or joint")
        if not isinstance(name, str):
            raise TypeError("joints are named")
        return (self.node_index if space == "node" else self.joint_index)[name]

    @property
    def edges(self) -> list[tuple[int, int]]:
        return self.topology.edges

    @property
    def node_edges(self) -> list[tuple[int, int]]:
        return [(i, n.parent) for i, n in enumerate(self.topology) if n.parent >= 0]

    # ---- orientation

    @property
    def up_axis(self) -> tuple[int, int, np.ndarray]:
        """(number, sign, vector) of the up axis."""
        return O.parsed(self.up)

    @property
    def rest_up(self) -> str | None:
        return O.rest_up(self.topology)

    @property
    def rest_up_axis(self) -> tuple[int, int, np.ndarray] | None:
        return O.parsed(self.rest_up) if self.rest_up else None

    @property
    def rest_forward(self) -> str:
        return O.rest_forward(self.topology, self.up, self.sides)

    @property
    def forward_axis(self) -> tuple[int, int, np.ndarray]:
        return O.parsed(self.rest_forward)

    @property
    def side_names(self) -> dict[str, str]:
        """Left joint names with their right ones, as given or by name."""
        return dict(self.sides) if self.sides is not None else O.name_pairs(self.topology)

    @property
    def side_joints(self) -> list[tuple[int, int]]:
        return [(self.topology[a].joint, self.topology[b].joint) for a, b in O.joint_pairs(self.topology, self.sides)]

    @property
    def side_nodes(self) -> list[tuple[int, int]]:
        return O.node_pairs(self.topology, self.sides)[0]

    @property
    def has_side_geometry(self) -> bool:
        """Whether the rest pose says which way the skeleton faces."""
        return O.facing_is_measured(self.topology, self.up, self.sides)

    def world_up_inferred(self) -> DataFrame:
        """(clip, world_up, guessed) from each clip's first frame, whatever ``up`` says; guessed where neither it nor the rest pose tells."""
        return O.inferred_up(self._poses().where("frame = 0"), self.topology)

    def facing(self, pairs: Mapping[str, str] | None = None) -> DataFrame:
        """(clip, frame, valid, forward, left, up) from left and right joints, which names tell unless given."""
        pairs = pairs if pairs is not None else self.sides
        joints = O.joint_pairs(self.topology, pairs, strict=pairs is not None)
        if not joints:
            raise ValueError("no left and right joints: name them")
        text = lambda axis: tuple(str(float(x)) for x in O.vector_of(axis))
        return apply(self.positions(), P.facing(_T, joints, text(self.up), text(O.rest_forward(self.topology, self.up, pairs))))

    def forward_at(self, frame: int = 0) -> DataFrame:
        """(clip, forward): the axis that a frame's pose faces."""
        return O.axes_at(self._poses().where(F.col("frame") == frame), self.topology, self.up, self.sides).select("clip", "forward")

    def left_at(self, frame: int = 0) -> DataFrame:
        return O.axes_at(self._poses().where(F.col("frame") == frame), self.topology, self.up, self.sides).select("clip", "left")

    # ---- positions

    def _poses(self, centered: str = "world") -> DataFrame:
        frames = self.frames
        if centered == "first":
            frames = frames.join(frames.where("frame = 0").select("clip", F.col("root").alias("root0")), "clip")
        return K.fk_kernel(frames, self.topology, centered, self.up_axis[0])

    def positions(self, centered: str = "world") -> DataFrame:
        """(clip, frame, node, x, y, z) of every node; with clips of several rates also dt."""
        each = self._poses(centered).withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(len(self.topology) - 1))))
        own = ["dt"] if "dt" in self.frames.columns else []
        return each.select("clip", "frame", "node", *own, *[F.col("pos")[F.col("node") * 3 + i].alias(c) for i, c in enumerate("xyz")])

    def _joints(self, df: DataFrame) -> DataFrame:
        return df.where(F.col("node").isin([i for i, n in enumerate(self.topology) if n.joint >= 0]))

    def joint_positions(self, centered: str = "world") -> DataFrame:
        return self._joints(self.positions(centered))

    def rest_positions(self) -> np.ndarray:
        """(N, 3) positions at zero angles with the root at the origin."""
        return self.topology.rest_positions()

    def rest_angles(self) -> np.ndarray:
        return np.zeros((self.joint_count, 3))

    def trajectory(self, name: str) -> DataFrame:
        return self.positions().where(F.col("node") == self.index(name))

    # ---- velocities

    def differences(self, order: int, stencil: str = "central", pad: str = "edge", in_frames: bool = False, centered: str = "world") -> DataFrame:
        """(clip, frame, node, dx, dy, dz): derivatives of positions of an order."""
        sql = S.differences(_T, {f"d{c}": c for c in "xyz"}, "1.0" if in_frames else self._dt, order, stencil, pad, keys="clip, node")
        return apply(self.positions(centered), sql).select("clip", "frame", "node", "dx", "dy", "dz")

    def velocities(self, order: int = 1, stencil: str = "central", pad: str = "edge", in_frames: bool = False, centered: str = "world") -> DataFrame:
        return self.differences(order, stencil, pad, in_frames, centered)

    def accelerations(self, **options) -> DataFrame:
        return self.differences(2, **options)

    def jerk(self, **options) -> DataFrame:
        return self.differences(3, **options)

    def joint_velocities(self, **options) -> DataFrame:
        return self._joints(self.differences(1, **options))

    def joint_accelerations(self, **options) -> DataFrame:
        return self._joints(self.differences(2, **options))

    def joint_jerk(self, **options) -> DataFrame:
        return self._joints(self.differences(3, **options))

    def speed_derivative(self, pad: str = "edge", in_frames: bool = False, centered: str = "world") -> DataFrame:
        """(clip, frame, node, accel): the change of each node's speed."""
        sql = S.speed_derivative(_T, ("x", "y", "z"), "1.0" if in_frames else self._dt, pad, keys="clip, node")
        return apply(self.positions(centered), sql).select("clip", "frame", "node", "accel")

    def joint_speed_derivative(self, **options) -> DataFrame:
        return self._joints(self.speed_derivative(**options))

    def angular_velocities(self, stencil: str = "central", pad: str = "edge", in_frames: bool = False, degrees: bool = False) -> DataFrame:
        """(clip, frame, joint, w0, w1, w2): rotation vectors between frames of each joint's own rotation."""
        q = self.rotations("quat")
        own = ["dt"] if "dt" in q.columns else []
        each = q.select("clip", "frame", *own, F.posexplode(F.expr("transform(sequence(0, size(rotations) - 1, 4), i -> slice(rotations, i + 1, 4))")).alias("joint", "q"))
        each = each.select("clip", "frame", "joint", *own, *[F.col("q")[i].alias(f"q{i}") for i in range(4)])
        return apply(each, S.angular_velocity(_T, R.names("q", 4), "1.0" if in_frames else self._dt, stencil, pad, degrees, "clip, joint")).select("clip", "frame", "joint", "w0", "w1", "w2")

    def root_trajectory(self, up: str | None = None, velocities: bool = False, stencil: str = "central", pad: str = "edge", degrees: bool = False) -> DataFrame:
        """(clip, frame, ga, gb, sin_h, cos_h[, va, vb, rate]): the root on the ground, its heading, and how they change."""
        up = O.check_axis(up or self.up, unsigned=True)
        a, b = (i for i in range(3) if "xyz"[i] != up[1])
        ahead = O.vector_of(O.rest_forward(self.topology, up, self.sides))
        m = self.rotations("rotmat")
        to = lambda i: " + ".join(f"{ahead[k]!r} * rotations[{3 * i + k}]" for k in range(3) if ahead[k]).replace("np.float64(", "(")
        rows = m.selectExpr("*", f"root[{a}] AS ga", f"root[{b}] AS gb", f"atan2({to(b)}, {to(a)}) AS heading")
        sql = f"SELECT *, sin(heading) AS sin_h, cos(heading) AS cos_h FROM ({_T})"
        names = ["ga", "gb", "sin_h", "cos_h"]
        if velocities:
            turns = S.unwrap_angles(sql, "heading", "whole")
            sql = S.differences(turns, {"va": "ga", "vb": "gb", "rate": "whole"}, self._dt, 1, stencil, pad)
            if degrees:
                sql = f"SELECT * EXCEPT (rate), degrees(rate) AS rate FROM ({sql})"
            names += ["va", "vb", "rate"]
        return apply(rows, sql).select("clip", "frame", *names)

    # ---- descriptors of one joint

    def curvature(self, name: str, pad: str = "edge") -> DataFrame:
        return apply(self.trajectory(name), S.curvature(_T, self._dt, pad)).select("clip", "frame", "curvature")

    def torsion(self, name: str, pad: str = "edge") -> DataFrame:
        return apply(self.trajectory(name), S.torsion(_T, self._dt, pad)).select("clip", "frame", "torsion")

    def movement_phase(self, name: str, pad: str = "edge") -> DataFrame:
        return apply(self.trajectory(name), S.movement_phase(_T, self._dt, pad)).select("clip", "frame", "movement_phase")

    def path_length(self, name: str) -> DataFrame:
        return apply(self.trajectory(name), S.path_length(_T))

    def directness(self, name: str) -> DataFrame:
        return apply(self.trajectory(name), S.directness(_T))

    def ground_path(self, name: str) -> DataFrame:
        return apply(self.trajectory(name), S.ground_path(_T, self.up))

    def speed(self, name: str) -> DataFrame:
        """(clip, frame, v): the length of a joint's velocity."""
        d = self.differences(1).where(F.col("node") == self.index(name))
        return d.select("clip", "frame", F.expr(V.norm(("dx", "dy", "dz"))).alias("v"))

    def smoothness(self, name: str, metric: str = "sparc", **options) -> DataFrame:
        """One measure for each clip of how smooth a joint's speed is; spectral arc length by fast transforms."""
        fs = 1 / self._one_rate()
        if metric == "sparc":
            return KR.sparc(self.speed(name), fs, **options)
        return apply(self.speed(name), S.smoothness(_T, "v", fs, metric, **options))

    def velocity_reductions(self, name: str) -> DataFrame:
        return apply(self.speed(name), S.velocity_reductions(_T, "v", 1 / self._one_rate()))

    def range_of_motion(self, name: str) -> DataFrame:
        """(clip, r0, r1, r2): the span of each of a joint's angles."""
        j = self.index(name, "joint")
        spans = [(F.max(F.col("angles")[3 * j + k]) - F.min(F.col("angles")[3 * j + k])).alias(f"r{k}") for k in range(3)]
        return self.frames.groupBy("clip").agg(*spans)

    # ---- descriptors of poses

    def _at(self, **nodes: str) -> DataFrame:
        return apply(self.positions(), P.at_nodes(_T, {k: self.index(n) for k, n in nodes.items()}))

    def inter_joint_distance(self, pairs: Sequence[tuple[str, str]]) -> DataFrame:
        """(clip, frame, d0, d1, ...)."""
        return apply(self.positions(), P.inter_joint_distance(_T, [(self.index(a), self.index(b)) for a, b in pairs]))

    def joint_angle(self, a: str, vertex: str, b: str, degrees: bool = False) -> DataFrame:
        return self._at(a=a, v=vertex, b=b).selectExpr("clip", "frame", f"{V.joint_angle(V.vec('a'), V.vec('v'), V.vec('b'), degrees)} AS angle")

    def triangle_area(self, a: str, b: str, c: str) -> DataFrame:
        return self._at(a=a, b=b, c=c).selectExpr("clip", "frame", f"{V.triangle_area(V.vec('a'), V.vec('b'), V.vec('c'))} AS area")

    def segment_axis_angle(self, a: str, b: str, degrees: bool = False) -> DataFrame:
        """The angle between the segment from a to b and the up axis."""
        up = tuple(f"{float(x)}D" for x in self.up_axis[2])
        return self._at(a=a, b=b).selectExpr("clip", "frame", f"{V.segment_axis_angle(V.sub(V.vec('b'), V.vec('a')), up, degrees)} AS angle")

    def bounding_box(self) -> DataFrame:
        return apply(self.positions(), P.bounding_box(_T))

    def bounding_sphere(self) -> DataFrame:
        return apply(self.positions(), P.bounding_sphere(_T))

    def bounding_ellipsoid(self) -> DataFrame:
        return KR.bounding_ellipsoid(self.positions())

    def _weighted(self, df: DataFrame, weights: Mapping[str, float] | Sequence[float] | None, name: str) -> tuple[DataFrame, str]:
        """Rows with a column of each node's weight; by name (others 0) or in node order."""
        if weights is None:
            return df, "1.0"
        by = [float(weights.get(n.name, 0.0)) for n in self.topology] if isinstance(weights, Mapping) else [float(w) for w in weights]
        if isinstance(weights, Mapping) and set(weights) - set(self.node_index):
            raise KeyError(f"unknown joints {sorted(set(weights) - set(self.node_index))}")
        if len(by) != len(self.topology) or min(by) < 0:
            raise ValueError("a weight for each node, none negative")
        return df.withColumn(name, F.get(F.array(*map(F.lit, by)), F.col("node"))), name

    def center_of_mass(self, weights: Mapping[str, float] | Sequence[float] | None = None) -> DataFrame:
        df, w = self._weighted(self.positions(), weights, "weight")
        return apply(df, P.center_of_mass(_T, w))

    def com_displacement(self, weights: Mapping[str, float] | Sequence[float] | None = None) -> DataFrame:
        df, w = self._weighted(self.positions(), weights, "weight")
        return apply(df, P.com_displacement(_T, w)).select("clip", "frame", "travel")

    def verticality(self) -> DataFrame:
        return apply(self.positions(), P.verticality(_T, self.up[1]))

    def kinetic_energy(self, masses: Mapping[str, float] | Sequence[float] | None = None, centered: str = "world") -> DataFrame:
        df, m = self._weighted(self.joint_positions(centered), masses, "mass")
        return apply(df, P.kinetic_energy(_T, self._dt, None if masses is None else m))

    def covariance(self, lag: int = 0, centered: str = "world") -> DataFrame:
        """(clip, a, b, cov) of all nodes' coordinates over frames."""
        return KR.covariance(self._poses(centered), lag)

    # ---- contacts and gait

    def feet(self) -> list[str]:
        """Joints that are feet by name, the most distal of each chain."""
        return [self.topology[i].name for i in self.topology.feet(self.up_axis[0])]

    def _feet(self, feet: Sequence[str] | None) -> list[int]:
        nodes = [self.index(f) for f in feet] if feet else self.topology.feet(self.up_axis[0])
        if not nodes:
            raise ValueError("no feet found: name them")
        return nodes

    def floor_height(self) -> DataFrame:
        """(clip, floor): a low percentile of the feet's heights, of all nodes where no feet are known, in coordinates of the up axis."""
        nodes = self.topology.feet(self.up_axis[0]) or list(range(len(self.topology)))
        low = apply(self.positions().where(F.col("node").isin(nodes)), C.floor_height(_T, self.up))
        return low.select("clip", (F.col("floor") * self.up_axis[1]).alias("floor"))

    def skeleton_size(self, feet: Sequence[str] | None = None) -> float:
        """The mean distance at rest of the feet from the root; 1 where it is 0."""
        rest, nodes = self.topology.rest_positions(), self._feet(feet)
        return sum(float((rest[i] ** 2).sum() ** 0.5) for i in nodes) / len(nodes) or 1.0

    def foot_contacts(self, feet: Sequence[str] | None = None, adaptive: bool = False, **options) -> DataFrame:
        """(clip, frame, node, speed, clearance, contact[, details]); ``adaptive`` gives each foot a limit from its own speeds."""
        nodes, scale, dt = self._feet(feet), self.skeleton_size(feet), self._one_rate()
        feet_only = self.positions().where(F.col("node").isin(nodes))
        if adaptive:
            speeds = apply(feet_only, C.foot_speed(_T, dt))
            limits = KR.adaptive_threshold(speeds, 0.12 * scale).withColumnRenamed("threshold", "vel_limit")
            feet_only, options = feet_only.join(limits, ["clip", "node"]), options | {"vel_threshold": "vel_limit"}
        return apply(feet_only, C.contacts(_T, dt, up=self.up, scale=scale, **options))

    def ground_contacts(self, joints: Sequence[str], **options) -> DataFrame:
        """Contacts of any joints, by default against heights above the floor."""
        return self.foot_contacts(joints, **({"height_reference": "floor"} | options))

    def _stepping(self, feet: Sequence[str] | None, contacts: DataFrame | None) -> DataFrame:
        """(clip, frame, node, x, y, z, contact) of the feet; contacts found with adaptive limits unless given."""
        found = contacts if contacts is not None else self.foot_contacts(feet, adaptive=True)
        places = self.positions().where(F.col("node").isin(self._feet(feet))).select("clip", "frame", "node", "x", "y", "z")
        return places.join(found.select("clip", "frame", "node", "contact"), ["clip", "frame", "node"])

    def cadence(self, feet: Sequence[str] | None = None, contacts: DataFrame | None = None) -> DataFrame:
        return apply(self._stepping(feet, contacts), C.cadence(_T, self._one_rate()))

    def stride_length(self, feet: Sequence[str] | None = None, contacts: DataFrame | None = None) -> DataFrame:
        return apply(self._stepping(feet, contacts), C.stride_length(_T, self.up))

    def _roots(self) -> DataFrame:
        return self.frames.select("clip", "frame", *[F.col("root")[i].alias(c) for i, c in enumerate("xyz")])

    def walking_pace(self) -> DataFrame:
        return apply(self._roots(), C.walking_pace(_T, self._one_rate(), self.up))

    def gait_parameters(self, feet: Sequence[str] | None = None, contacts: DataFrame | None = None) -> DataFrame:
        """One row for each clip; asymmetry compares the first two feet."""
        nodes = self._feet(feet)
        left, right = (nodes * 2)[:2]
        return apply(self._stepping(feet, contacts), C.gait(_T, "SELECT * FROM {r}", self._one_rate(), left, right, self.up), r=self._roots())

    # ---- rotations

    def rotations(self, form: str = "rotmat") -> DataFrame:
        """(clip, frame, root, rotations[, dt, offsets]): all joints' rotations as euler, rotmat, 6d, quat or axisangle, a flat array a frame."""
        return FR.converted(self.frames, "euler", form, self.euler_orders)

    def with_rotations(self, rows: DataFrame, form: str) -> MotionSet:
        """The set with motion from (clip, frame, root, rotations) in a form; a row's rotations must be as many as the joints."""
        width = D.WIDTHS[form] * self.joint_count
        checked = rows.select("clip", "frame", "root", F.expr(f"CASE WHEN size(rotations) = {width} THEN rotations ELSE raise_error('{width} numbers a frame are needed') END AS rotations"))
        own = self.frames.select("clip", *[c for c in _OWN if c in self.frames.columns]).distinct() if any(c in self.frames.columns for c in _OWN) else None
        new = FR.converted(checked, form, "euler", self.euler_orders, column="rotations", out="angles")
        return replace(self, frames=new if own is None else new.join(own, "clip"))

    def change_euler_order(self, order: str, joint: str | None = None) -> MotionSet:
        """The same rotations in another order of axes, of all joints or one."""
        R.check_order(order)
        chosen = None if joint is None else self.index(joint, "joint")
        new = [order.upper() if chosen in (None, j) else o for j, o in enumerate(self.euler_orders)]
        top = K.Topology([replace(n, order=new[n.joint]) if n.joint >= 0 else n for n in self.topology])
        return replace(self, topology=top, frames=FR.converted(self.frames, "euler", "euler", self.euler_orders, new, out="angles"))

    # ---- frames

    def __getitem__(self, key: int | slice) -> MotionSet:
        """Frames of every clip by the rules of Python's slices, numbered from 0; a step makes the time between frames longer."""
        if isinstance(key, int):
            key = slice(key, key + 1 or None)
        step = 1 if key.step is None else key.step
        own = [c for c in _OWN if c in self.frames.columns]
        cut = apply(self.frames, D.slice_frames(_T, key.start, key.stop, step))
        dt = [F.col(c) * abs(step) if c == "dt" else F.col(c) for c in own]
        cut = cut.select("clip", F.col("new_frame").alias("frame"), "root", "angles", *[d.alias(c) for d, c in zip(dt, own)])
        return replace(self, frames=cut, frame_time=self.frame_time * abs(step))

    def _check_same(self, other: MotionSet) -> None:
        if [(n.name, n.order) for n in self.topology] != [(n.name, n.order) for n in other.topology]:
            raise ValueError("the skeletons have different names or orders")

    def concat(self, other: MotionSet) -> MotionSet:
        """Frames of clips of ``other`` after those of the same clip here; names and orders must agree. The rate and offsets here stay."""
        self._check_same(other)
        ends = self.frames.groupBy("clip").agg((F.max("frame") + 1).alias("n"), *[F.first(c).alias(c) for c in _OWN if c in self.frames.columns])
        met = other.frames.select(*_CORE).join(ends, "clip", "left")
        kept = [c for c in _OWN if c in self.frames.columns]
        moved = met.select("clip", (F.col("frame") + F.coalesce("n", F.lit(0))).alias("frame"), "root", "angles", *kept)
        return replace(self, frames=self.frames.select(*_CORE, *kept).unionByName(moved))

    __add__ = concat

    def splice(self, patch: MotionSet, start: int = 0) -> MotionSet:
        """Frames of ``patch`` in place of those from ``start`` on in the clips of the same name; the rates must agree."""
        self._check_same(patch)
        if abs(patch.frame_time - self.frame_time) > 0:
            raise ValueError("the frame times differ")
        new = patch.frames.select("clip", (F.col("frame") + start).alias("frame"), F.col("root").alias("r2"), F.col("angles").alias("a2"))
        met = self.frames.join(new, ["clip", "frame"], "left")
        return replace(self, frames=met.withColumns({"root": F.coalesce("r2", "root"), "angles": F.coalesce("a2", "angles")}).select(*self.frames.columns))

    def resample(self, fps: float) -> MotionSet:
        if fps <= 0:
            raise ValueError("the rate is positive")
        per_clip = "dt" in self.frames.columns
        new = KR.resample_frames(self.frames, self.euler_orders, None if per_clip else self.frame_time, fps)
        return replace(self, frames=new.drop("dt"), frame_time=1 / fps)

    def perturb_speed(self, factor: float) -> MotionSet:
        """The motion ``factor`` times as fast at the same rate."""
        if factor <= 0:
            raise ValueError("the factor is positive")
        dt = self._one_rate()
        return replace(self.resample(1 / dt / factor), frame_time=dt)

    def drop_frames(self, rate: float, seed: int = 0) -> MotionSet:
        """Frames left out by a hash of (clip, frame, seed), ends spared, and filled in from their neighbours."""
        if not 0 <= rate < 1:
            raise ValueError("the rate is in [0, 1)")
        q = self.rotations("quat")
        j = self.joint_count
        wide = q.selectExpr("clip", "frame", *[c for c in _OWN if c in q.columns], *[f"root[{i}] AS p{i}" for i in range(3)], *[f"rotations[{i}] AS q{i}" for i in range(4 * j)])
        quats = tuple(tuple(f"q{4 * k + i}" for i in range(4)) for k in range(j))
        filled = apply(wide, D.drop_frames(_T, rate, tuple(f"p{i}" for i in range(3)), quats, seed))
        rows = filled.selectExpr("clip", "frame", "dropped", f"array({', '.join(f'filled_p{i}' for i in range(3))}) AS root", f"array({', '.join(f'filled_q{i}' for i in range(4 * j))}) AS rotations")
        new = FR.converted(rows.where("dropped").drop("dropped"), "quat", "euler", self.euler_orders, column="rotations", out="a2").withColumnRenamed("root", "r2")
        met = self.frames.join(new, ["clip", "frame"], "left")
        return replace(self, frames=met.withColumns({"root": F.coalesce("r2", "root"), "angles": F.coalesce("a2", "angles")}).select(*self.frames.columns))

    def add_rotation_noise(self, sigma: float, seed: int = 0, wrap: bool = False, degrees: bool = False) -> MotionSet:
        """Normal noise on every angle, from hashes of (clip, frame, angle, seed); wrap brings angles into [-pi, pi)."""
        return self._noisy("angles", 3 * self.joint_count, np.radians(sigma) if degrees else sigma, seed, wrap)

    def add_position_noise(self, sigma: float, seed: int = 0) -> MotionSet:
        return self._noisy("root", 3, sigma, seed, False)

    def _noisy(self, column: str, width: int, sigma: float, seed: int, wrap: bool) -> MotionSet:
        if sigma < 0:
            raise ValueError("sigma is not negative")
        u = lambda k: f"((pmod(xxhash64(clip, frame, '{column}', i, {seed}, {k}), 9007199254740992) + 0.5D) / 9007199254740992D)"
        noisy = f"{column}[i] + {float(sigma)}D * sqrt(-2D * ln({u(0)})) * cos(2D * pi() * {u(1)})"
        if wrap:
            noisy = f"({noisy}) - 2D * pi() * floor((({noisy}) + pi()) / (2D * pi()))"
        return replace(self, frames=self.frames.withColumn(column, F.expr(f"transform(sequence(0, {width - 1}), i -> {noisy})")))

    # ---- transforms

    def translate_root(self, offset: Sequence[float]) -> MotionSet:
        x, y, z = map(float, offset)
        return replace(self, frames=self.frames.withColumn("root", F.expr(f"array(root[0] + {x}D, root[1] + {y}D, root[2] + {z}D)")))

    def random_translate_root(self, lo: float = -100.0, hi: float = 100.0, seed: int = 0) -> MotionSet:
        moved = ", ".join(f"root[{i}] + {D.uniform(lo, hi, c, seed)}" for i, c in enumerate("xyz"))
        return replace(self, frames=self.frames.withColumn("root", F.expr(f"array({moved})")))

    def rotate_vertical(self, angle: float | str, pivot: str | Sequence[float] = "origin", degrees: bool = False, up: str | None = None) -> MotionSet:
        """The whole motion turned about the up axis through the origin, the clip's first root position, or a point."""
        axis = O.check_axis(up or self.up, unsigned=True)
        i, sign, _ = O.parsed(axis)
        turn = f"{sign} * ({f'radians({angle})' if degrees else angle})"
        frames = self.frames
        if isinstance(pivot, str):
            if pivot not in ("origin", "root"):
                raise ValueError("pivot is origin, root or a point")
            point = (0.0, 0.0, 0.0) if pivot == "origin" else None
        else:
            point = tuple(map(float, pivot))
            if len(point) != 3:
                raise ValueError("a pivot has three coordinates")
        if point is None:
            frames = frames.join(frames.where("frame = 0").select("clip", F.col("root").alias("root0")), "clip")
        new = FR.turned_about(frames, self.topology[0].order, i, turn, point)
        return replace(self, frames=new.drop("root0"))

    def random_rotate_vertical(self, lo: float = -np.pi, hi: float = np.pi, pivot: str | Sequence[float] = "origin", seed: int = 0) -> MotionSet:
        return self.rotate_vertical(D.uniform(lo, hi, "turn", seed), pivot)

    def random_perturb_speed(self, lo: float = 0.8, hi: float = 1.2, seed: int = 0) -> MotionSet:
        """Each clip faster by a factor of its own, at the same rate."""
        if not 0 < lo <= hi:
            raise ValueError("factors are positive")
        dt = self._one_rate()
        faster = self.frames.drop("dt").withColumn("dt", F.expr(f"{dt}D / {D.uniform(lo, hi, 'speed', seed)}"))
        new = KR.resample_frames(faster, self.euler_orders, None, 1 / dt)
        return replace(self, frames=new.drop("dt"))

    def mirror(self, sides: Mapping[str, str] | None = None, lateral: str | None = None) -> MotionSet:
        """Left and right change places: angles, root positions and offsets across the lateral axis."""
        pairs = dict(sides) if sides is not None else self.side_names
        if not pairs:
            raise ValueError("no left and right joints: name them")
        joints = O.joint_pairs(self.topology, pairs, strict=sides is not None)
        nodes, unlike = O.node_pairs(self.topology, pairs)
        if unlike:
            a, b = (self.topology[i].name for i in unlike[0])
            raise ValueError(f"{a} and {b} have different numbers of end sites")
        side = O.rest_left(self.topology, pairs) if lateral is None else O.check_axis(lateral, unsigned=True)
        if side is None:
            raise ValueError("the rest pose does not tell left from right: name the lateral axis")
        axis = "xyz".index(side[1])
        place = list(range(len(self.topology)))
        for a, b in nodes:
            place[a], place[b] = place[b], place[a]
        flip = lambda o: tuple(-x if k == axis else x for k, x in enumerate(o))
        top = K.Topology([replace(n, offset=flip(self.topology[place[i]].offset)) for i, n in enumerate(self.topology)])
        new = FR.mirrored(self.frames, self.euler_orders, [(self.topology[a].joint, self.topology[b].joint) for a, b in joints], axis)
        if "offsets" in new.columns:
            own = [f"{'-' if k == axis else ''}offsets[{3 * place[i] + k}]" for i in range(len(place)) for k in range(3)]
            new = new.withColumn("offsets", F.expr(f"array({', '.join(own)})"))
        return replace(self, topology=top, frames=new)

    def _turned(self, have: str, want: str, rest_only: bool) -> MotionSet:
        m = np.array([float(x.strip("()")) for x in D.axis_rotation(have, want)]).reshape(3, 3)
        new = FR.turned(self.frames, self.euler_orders, m, rest_only)
        if "offsets" in new.columns:
            own = [" + ".join(f"({m[k, c]}D) * offsets[{3 * i + c}]" for c in range(3) if m[k, c]) for i in range(len(self.topology)) for k in range(3)]
            new = new.withColumn("offsets", F.expr(f"array({', '.join(own)})"))
        return replace(self, topology=self.topology.turned(m.ravel()), frames=new)

    def reorient_world_up(self, new_up: str) -> MotionSet:
        """Everything in coordinates whose up axis is another one."""
        new_up = O.check_axis(new_up)
        return self if new_up == self.up else replace(self._turned(self.up, new_up, False), up=new_up)

    def reorient_rest_up(self, new_up: str) -> MotionSet:
        """Another up axis of the rest pose; the poses stay where they are."""
        new_up, old = O.check_axis(new_up), self.rest_up
        if old is None:
            raise ValueError("the rest pose has no up axis")
        return self if new_up == old else self._turned(old, new_up, True)

    def reorient_rest_forward(self, new_forward: str) -> MotionSet:
        """The rest pose turned about the up axis to face another way; the poses stay where they are."""
        new_forward = O.check_axis(new_forward)
        if new_forward[1] == self.up[1]:
            raise ValueError("forward is not along the up axis")
        old = self.rest_forward
        return self if new_forward == old else self._turned(old, new_forward, True)

    def retarget(self, other: K.Topology | MotionSet, names: Mapping[str, str] | None = None, strict: bool = False) -> MotionSet:
        """Offsets of ``other`` for nodes whose (mapped) name it has, in all clips; the others keep their own."""
        goal = other.topology if isinstance(other, MotionSet) else other
        top = self.topology.retarget(goal, dict(names) if names else None, strict)
        frames = self.frames
        if "offsets" in frames.columns:
            known = {n.name for n in goal}
            own = [f"{top[i].offset[k]!r}D" if (names or {}).get(n.name, n.name) in known else f"offsets[{3 * i + k}]" for i, n in enumerate(self.topology) for k in range(3)]
            frames = frames.withColumn("offsets", F.expr(f"array({', '.join(own)})"))
        return replace(self, topology=top, frames=frames)

    def scale(self, factor: float) -> MotionSet:
        frames = self.frames.withColumn("root", F.transform("root", lambda x: x * float(factor)))
        if "offsets" in frames.columns:
            frames = frames.withColumn("offsets", F.transform("offsets", lambda x: x * float(factor)))
        return replace(self, topology=self.topology.scale(factor), frames=frames)

    def extract_joints(self, names: Sequence[str]) -> MotionSet:
        """Only the named joints, with the root; rotations of joints that go are lost, their offsets are not."""
        top = self.topology.extract(names)
        place = {n.name: n.joint for n in self.topology if n.joint >= 0}
        kept = ", ".join(f"angles[{3 * place[n.name] + k}]" for n in top if n.joint >= 0 for k in range(3))
        return replace(self, topology=top, sides=None, frames=self.frames.drop("offsets").withColumn("angles", F.expr(f"array({kept})")))

    # ---- sets of clips

    def matches(self, other: MotionSet, offsets: bool = True, atol: float = 1e-6) -> bool:
        return self.topology.matches(other.topology, offsets, atol)

    def matches_channels(self, other: MotionSet) -> bool:
        return self.position_order == other.position_order and self.topology.matches_channels(other.topology)

    def matches_topology(self, other: MotionSet) -> bool:
        return self.matches(other) and self.matches_channels(other)

    def equals(self, other: MotionSet) -> bool:
        """Same skeleton, rate and frames, exactly."""
        if self.topology != other.topology or self.frame_time != other.frame_time:
            return False
        a, b = (s.frames.select(*_CORE) for s in (self, other))
        return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()

    def harmonize(
        self, fps: float | None = None, skeleton: K.Topology | MotionSet | None = None, world_up: str | None = None, rest_up: str | None = None, rest_forward: str | None = None, euler_order: str | None = None
    ) -> MotionSet:
        """One skeleton's offsets, one rate where it differs by more than 0.01, one up axis, rest pose and order, in this turn."""
        return self.harmonized(fps, skeleton, world_up, rest_up, rest_forward, euler_order)[0]

    def harmonized(self, fps=None, skeleton=None, world_up=None, rest_up=None, rest_forward=None, euler_order=None) -> tuple[MotionSet, dict[str, str]]:
        """The harmonised set and what was done: stage to change."""
        s, done = self, {}
        if skeleton is not None:
            goal = skeleton.topology if isinstance(skeleton, MotionSet) else skeleton
            if not goal.matches(s.topology, offsets=False):
                raise ValueError("another hierarchy than the skeleton's")
            s, done["retarget"] = s.retarget(goal), "applied"
        if fps and ("dt" in s.frames.columns or abs(fps - s.fps) > 0.01):
            done["resample"] = f"{s.fps:.4g}->{fps:.4g}"
            s = s.resample(fps)
        if world_up and s.up != world_up:
            done["world_up"] = f"{s.up}->{world_up}"
            s = s.reorient_world_up(world_up)
        if rest_up and s.rest_up != rest_up:
            done["rest_up"] = f"{s.rest_up}->{rest_up}"
            s = s.reorient_rest_up(rest_up)
        if rest_forward and s.rest_forward != rest_forward:
            done["rest_forward"] = f"{s.rest_forward}->{rest_forward}"
            s = s.reorient_rest_forward(rest_forward)
        if euler_order and any(o != euler_order for o in s.euler_orders):
            done["euler_order"] = f"->{euler_order}"
            s = s.change_euler_order(euler_order)
        return s, done

    # ---- arrays

    def feature_layout(self, representation: str = "6d", root: bool = True, velocities: bool = False, contacts: bool = False, feet: Sequence[str] | None = None) -> dict[str, tuple[int, int]]:
        return D.feature_layout(self.joint_count, len(self._feet(feet)) if contacts else 0, representation, root, velocities, contacts)

    def feature_array(self, representation: str = "6d", root: bool = True, velocities: bool = False, contacts: bool = False, centered: str = "world", feet: Sequence[str] | None = None, stencil: str = "central", pad: str = "edge") -> DataFrame:
        """(clip, frame, features): root position, rotations, joint velocities per frame and contacts in one array, as ``feature_layout`` says.
        Frames without a velocity go."""
        if centered not in ("world", "skeleton", "first"):
            raise ValueError("centered is world, skeleton or first")
        rows, parts = self.rotations(representation), ["rotations"]
        if root:
            place = "root" if centered == "world" else "array(0D, 0D, 0D)"
            if centered == "first":
                rows = rows.join(self.frames.where("frame = 0").select("clip", F.col("root").alias("root0")), "clip")
                place = "array(" + ", ".join(f"root[{i}]" if i == self.up_axis[0] else f"root[{i}] - root0[{i}]" for i in range(3)) + ")"
            parts = [place, "rotations"]
        packed = lambda df, values, name: df.groupBy("clip", "frame").agg(F.expr(f"flatten(transform(sort_array(collect_list(struct(node, array({values}) AS v))), x -> x.v)) AS {name}"))
        if velocities:
            moves = self.joint_velocities(stencil=stencil, pad=pad, in_frames=True, centered=centered)
            rows, parts = rows.join(packed(moves, "dx, dy, dz", "moves"), ["clip", "frame"]), [*parts, "moves"]
        if contacts:
            down = self.foot_contacts(feet)
            order = {n: i for i, n in enumerate(self._feet(feet))}
            down = down.withColumn("node", F.expr("CASE " + " ".join(f"WHEN node = {n} THEN {i}" for n, i in order.items()) + " END"))
            rows, parts = rows.join(packed(down, "CAST(contact AS double)", "down"), ["clip", "frame"]), [*parts, "down"]
        return rows.selectExpr("clip", "frame", f"concat({', '.join(parts)}) AS features")

    def padded(self, representation: str = "euler", root: bool = True, value: float = 0.0) -> DataFrame:
        """(clip, frame, features, real): every clip as long as the longest, missing frames filled with a value."""
        rows = self.feature_array(representation, root)
        width = self.feature_layout(representation, root)["rotations"][1]
        last = rows.agg(F.max("frame")).first()[0]
        if last is None:
            return rows.withColumn("real", F.lit(True))
        grid = rows.select("clip").distinct().select("clip", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("frame"))
        met = grid.join(rows, ["clip", "frame"], "left")
        return met.select("clip", "frame", F.coalesce("features", F.array_repeat(F.lit(float(value)), width)).alias("features"), F.col("features").isNotNull().alias("real"))

    def to_numpy(self, representation: str = "euler", root: bool = True, pad: bool = False, value: float = 0.0, clips: Sequence | None = None) -> np.ndarray | list[np.ndarray]:
        """Arrays of the clips, in order of clip, on the driver: (F, D) each, or one of (clips, longest, D). Meant for a batch:
        ``clips`` chooses which."""
        s = self if clips is None else replace(self, frames=self.frames.where(F.col("clip").isin(list(clips))))
        rows = s.feature_array(representation, root).orderBy("clip", "frame").toArrow()
        which = rows.column("clip").to_pylist()
        x = np.array(rows.column("features").to_pylist(), float)
        at = [i for i in range(len(which)) if i == 0 or which[i] != which[i - 1]]
        parts = [x[a:b] for a, b in zip(at, [*at[1:], len(which)])]
        if not pad:
            return parts
        out = np.full((len(parts), max(map(len, parts), default=0), x.shape[1] if x.size else 0), float(value))
        for i, p in enumerate(parts):
            out[i, : len(p)] = p
        return out


_SHAPE = ("names", "parents", "joints", "orders", "world_up", "position_order")


def harmonize(sets: Sequence[MotionSet], reference: MotionSet | None = None, on_incompatible: str = "drop", **targets) -> tuple[list[MotionSet], list[dict]]:
    """The sets that have the reference's hierarchy, harmonised with it and ``targets``, and a report of one entry for each
    set: kept, the reason if not, and what was done."""
    if on_incompatible not in ("drop", "raise"):
        raise ValueError("on_incompatible is drop or raise")
    out, report = [], []
    for i, s in enumerate(sets):
        differs = reference is not None and reference.topology.first_difference(s.topology)
        if differs:
            if on_incompatible == "raise":
                raise ValueError(f"set {i}: {differs}")
            report.append({"set": i, "kept": False, "reason": differs, "done": {}})
            continue
        new, done = s.harmonized(skeleton=reference, **targets)
        out.append(new)
        report.append({"set": i, "kept": True, "reason": None, "done": done})
    return out, report


def summary(report: Sequence[dict], show: int = 5) -> str:
    """One line on what ``harmonize`` left out; empty where that is nothing."""
    gone = [r for r in report if not r["kept"]]
    if not gone:
        return ""
    named = ", ".join(f"set {r['set']} ({r['reason']})" for r in gone[:show])
    return f"{len(gone)} of {len(report)} sets left out: {named}" + (f" and {len(gone) - show} more" if len(gone) > show else "")
