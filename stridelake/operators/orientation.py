"""Which way a skeleton stands and faces: up, left and forward axes from its rest pose and its poses."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stridelake.operators.skeleton import _SIDES, Topology

#: Forward where nothing can be measured, by the letter of the up axis; the body parts that tell where up is,
#: in turn; how much longer than others the first pose's way to them must be along one axis, and the least length.
FALLBACK = {"y": "+z", "z": "+x", "x": "+y"}
UPPER = ("head", "neck", "chest", "spine")
CLEAR, LEAST = 2.0, 1e-6


def axis_of(v: np.ndarray, tol: float = 1e-6) -> str | None:
    """'+x' to '-z' of the largest part, the first of equals; None where all are within tol."""
    k = int(np.abs(v).argmax())
    return None if abs(v[k]) <= tol else ("-" if v[k] < 0 else "+") + "xyz"[k]


def vector_of(axis: str) -> np.ndarray:
    return np.eye(3)["xyz".index(axis[-1])] * (-1 if axis[0] == "-" else 1)


def check_axis(axis: str, unsigned: bool = False) -> str:
    a = axis.strip().lower()
    if unsigned and a in ("x", "y", "z"):
        a = "+" + a
    if not re.fullmatch("[+-][xyz]", a):
        raise ValueError(f"{axis!r} is no axis such as +y")
    return a


def right_name(name: str, known: set[str]) -> str | None:
    """The right-hand partner of a left-hand name, if it is known: by ending, by the word left, by an L before a capital."""
    pre, _, rest = name.rpartition(":")
    pre = f"{pre}:" if pre or ":" in name else ""
    num = re.search(r"[.][0-9]+$", rest)
    num = num[0] if num else ""
    base = rest[: len(rest) - len(num)]
    tries = [base[: -len(a)] + b for a, b in _SIDES if base.endswith(a)]
    if "left" in base.lower():
        tries.append(base.replace("Left", "Right").replace("left", "right").replace("LEFT", "RIGHT"))
    if len(base) >= 2 and base[0] == "L" and base[1].isupper():
        tries.append("R" + base[1:])
    return next((pre + t + num for t in tries if pre + t + num in known and pre + t + num != name), None)


def name_pairs(topology: Topology) -> dict[str, str]:
    """Left joint name to right joint name, in joint order."""
    known = set(topology.joint_names)
    found = {n: right_name(n, known) for n in topology.joint_names}
    return {a: b for a, b in found.items() if b}


def joint_pairs(topology: Topology, pairs: dict[str, str] | None = None, strict: bool = False) -> list[tuple[int, int]]:
    """Node numbers of left and right joints; strict: unknown names are an error."""
    place = {n.name: i for i, n in enumerate(topology) if n.joint >= 0}
    pairs = name_pairs(topology) if pairs is None else pairs
    missing = sorted({n for p in pairs.items() for n in p if n not in place})
    if strict and missing:
        raise ValueError(f"unknown joints {missing}")
    seen: set[frozenset[str]] = set()
    out = []
    for p in pairs.items():
        if not set(p) & set(missing) and frozenset(p) not in seen:
            seen.add(frozenset(p))
            out.append((place[p[0]], place[p[1]]))
    return out


def node_pairs(topology: Topology, pairs: dict[str, str] | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Pairs of joints with those of their end sites in order, and the joint pairs whose numbers of end sites differ."""
    joints = joint_pairs(topology, pairs)
    sites = lambda i: [k for k, n in enumerate(topology) if n.parent == i and n.joint < 0]
    ends = [(x, y) for a, b in joints if len(sites(a)) == len(sites(b)) for x, y in zip(sites(a), sites(b))]
    return joints + ends, [(a, b) for a, b in joints if len(sites(a)) != len(sites(b))]


def parsed(axis: str) -> tuple[int, int, np.ndarray]:
    """(number, sign, vector) of an axis."""
    return "xyz".index(axis[1]), -1 if axis[0] == "-" else 1, vector_of(axis)


def check_sides(topology: Topology, sides: Mapping[str, str]) -> None:
    """Left joint names with right ones: known joints, none its own partner, none in two pairs."""
    known = set(topology.joint_names)
    both = [n for p in sides.items() for n in p]
    if set(both) - known:
        raise ValueError(f"unknown joints {sorted(set(both) - known)}")
    if any(a == b for a, b in sides.items()):
        raise ValueError("a joint is not its own partner")
    pairs = {frozenset(p) for p in sides.items()}
    if sum(map(len, pairs)) != len(set(both)):
        raise ValueError("a joint is in two pairs")


def rest_up(topology: Topology) -> str | None:
    """From the root to a head, neck, chest or spine; else the axis of the widest spread, towards the mean; None for a point."""
    rest = topology.rest_positions()
    for name in UPPER:
        for i, n in enumerate(topology):
            found = axis_of(rest[i] - rest[0]) if n.name.lower() == name else None
            if found:
                return found
    spread = rest.max(0) - rest.min(0)
    if len(topology) < 2 or spread.max() < LEAST:
        return None
    k = int(spread.argmax())
    return ("+" if rest[:, k].mean() - rest[0, k] >= 0 else "-") + "xyz"[k]


def pose_up(topology: Topology, first: np.ndarray | None) -> str | None:
    """The axis from the root to the head (or neck, chest, spine) of a pose (N, 3), where it is clearly along one."""
    place = {n.name.lower(): i for i, n in enumerate(topology)}
    head = next((place[n] for n in UPPER if n in place), 0)
    if first is None or not head:
        return None
    d = first[head] - first[0]
    a = np.sort(np.abs(d))
    return axis_of(d) if a[-1] >= CLEAR * a[-2] and a[-1] >= LEAST else None


def world_up(topology: Topology, first: np.ndarray | None = None) -> str:
    """From the first pose (N, 3) if it tells, else from the rest pose, else +y."""
    return pose_up(topology, first) or rest_up(topology) or "+y"


def _by_pose(poses: DataFrame, topology: Topology, names: Sequence[str], f: Callable[[np.ndarray], tuple], kinds: str) -> DataFrame:
    """(clip, names) of (clip, pos) rows: ``f`` of each pose (N, 3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [f(np.array(p).reshape(-1, 3)) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[i] for x in found], pa.bool_() if k == "boolean" else pa.string()) for i, k in enumerate(kinds.split()))], ["clip", *names])

    clip = dict(poses.dtypes)["clip"]
    return poses.select("clip", "pos").mapInArrow(run, ", ".join([f"clip {clip}", *(f"{n} {k}" for n, k in zip(names, kinds.split()))]))


def inferred_up(poses: DataFrame, topology: Topology) -> DataFrame:
    """(clip, world_up, disagrees, guessed) of first poses: disagrees where the rest pose says another axis, guessed where neither tells."""
    rest = rest_up(topology)

    def f(p: np.ndarray) -> tuple:
        found = pose_up(topology, p)
        return found or rest or "+y", bool(found and rest and found[1] != rest[1]), not (found or rest)

    return _by_pose(poses, topology, ("world_up", "disagrees", "guessed"), f, "string boolean boolean")


def axes_at(poses: DataFrame, topology: Topology, up: str, pairs: Mapping[str, str] | None = None) -> DataFrame:
    """(clip, forward, left): the axes that poses face and have on their left."""
    return _by_pose(poses, topology, ("forward", "left"), lambda p: (forward_at(topology, p, up, pairs), left_at(topology, p, up, pairs)), "string string")


def _leftward(points: np.ndarray, pairs: list[tuple[int, int]], up: np.ndarray) -> np.ndarray | None:
    if not pairs:
        return None
    d = np.mean([points[a] - points[b] for a, b in pairs], axis=0)
    d = d - (d @ up) * up
    n = np.linalg.norm(d)
    return d / n if n >= 1e-6 else None


def rest_left(topology: Topology, pairs: dict[str, str] | None = None) -> str | None:
    """The axis from right to left joints at rest, without its part along the rest pose's up."""
    up = rest_up(topology)
    joints = joint_pairs(topology, pairs)
    if up is None or not joints:
        return None
    rest = topology.rest_positions()
    d = np.mean([rest[a] - rest[b] for a, b in joints], axis=0)
    d["xyz".index(up[1])] = 0.0
    return axis_of(d)


def forward_at(topology: Topology, points: np.ndarray, up: str, pairs: dict[str, str] | None = None) -> str:
    """The axis that a pose (N, 3) faces: left cross up; else that of the rest pose; else the fallback."""
    u = vector_of(up)
    left = _leftward(points, joint_pairs(topology, pairs), u)
    found = axis_of(np.cross(left, u)) if left is not None else None
    if found:
        return found
    left_axis = rest_left(topology, pairs)
    d = np.cross(vector_of(left_axis), u) if left_axis else np.zeros(3)
    return axis_of(d) or FALLBACK[up[1]]


def rest_forward(topology: Topology, up: str, pairs: dict[str, str] | None = None) -> str:
    return forward_at(topology, topology.rest_positions(), up, pairs)


def left_at(topology: Topology, points: np.ndarray, up: str, pairs: dict[str, str] | None = None) -> str:
    """Up cross forward, as an axis."""
    return axis_of(np.cross(vector_of(up), vector_of(forward_at(topology, points, up, pairs)))) or "+x"


def facing_is_measured(topology: Topology, up: str, pairs: dict[str, str] | None = None) -> bool:
    """Whether the rest pose says which way the skeleton faces."""
    if _leftward(topology.rest_positions(), joint_pairs(topology, pairs), vector_of(up)) is not None:
        return True
    left = rest_left(topology, pairs)
    return left is not None and left[1] != up[1]
