"""Skeletons as rows: nodes(node_idx, name, parent_idx, joint_idx, euler_order, off_x, off_y, off_z).

Forward kinematics has two forms. ``fk_kernel`` is a ``mapInArrow`` over frames with a topology that
travels with the task, for whole poses. ``fk_sql`` is a chain of projections for one literal skeleton,
for few nodes or where everything must stay in the engine; Catalyst drops nodes nobody asks for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stridelake.functions import rotations as R
from stridelake.functions.vectors import norm
from stridelake.plans.sql import joined_text, stages


@dataclass(frozen=True)
class Node:
    name: str
    parent: int
    joint: int
    order: str
    offset: tuple[float, float, float]

    @property
    def is_end_site(self) -> bool:
        return self.joint < 0


class Topology(tuple):
    """Validated nodes, parents before children: what forward kinematics needs, without motion."""

    def __new__(cls, nodes: Sequence[Node]) -> Topology:
        self = super().__new__(cls, nodes)
        errors = self.errors()
        if errors:
            raise ValueError("; ".join(errors))
        return self

    def errors(self) -> list[str]:
        out = []
        if not self:
            return ["a skeleton has a node at least"]
        if [i for i, n in enumerate(self) if n.parent < 0] != [0]:
            out.append("exactly the first node is a root")
        if self[0].joint < 0:
            out.append("the root is a joint")
        for i, n in enumerate(self):
            if i and not 0 <= n.parent < i:
                out.append(f"node {i}: its parent must come before it")
            elif i and self[n.parent].joint < 0:
                out.append(f"node {i}: an end site has no children")
            if n.joint >= 0 and sorted(n.order) != ["X", "Y", "Z"]:
                out.append(f"node {i}: its order must name each axis once")
        if [n.joint for n in self if n.joint >= 0] != list(range(sum(n.joint >= 0 for n in self))):
            out.append("joints are numbered from 0 in node order")
        return out

    @property
    def joint_names(self) -> list[str]:
        return [n.name for n in self if n.joint >= 0]

    @property
    def edges(self) -> list[tuple[int, int]]:
        """(child, parent) in joint numbers."""
        return [(n.joint, self[n.parent].joint) for n in self if n.joint > 0]

    @property
    def joint_tips(self) -> list[int | None]:
        """For each joint the first end site right below it."""
        return [next((k for k, c in enumerate(self) if c.joint < 0 and c.parent == i), None) for i, n in enumerate(self) if n.joint >= 0]

    def rest_positions(self) -> np.ndarray:
        out = np.zeros((len(self), 3))
        for i, n in enumerate(self):
            if i:
                out[i] = out[n.parent] + n.offset
        return out

    def depth_of(self, i: int) -> int:
        d = 0
        while self[i].parent >= 0:
            i, d = self[i].parent, d + 1
        return d

    def feet(self, up: int = 1) -> list[int]:
        """Nodes named like feet or toes with an end site or toe below (any, where none has one), the most distal of a chain, by rest height and name."""
        like = [i for i, n in enumerate(self) if n.joint >= 0 and any(w in n.name.lower() for w in ("foot", "toe"))]
        tipped = [i for i in like if any(c.parent == i and (c.joint < 0 or "toe" in c.name.lower()) for c in self)] or like
        above = set()
        for i in tipped:
            p = self[i].parent
            while p >= 0:
                above.add(p)
                p = self[p].parent
        rest = self.rest_positions()
        return sorted((i for i in tipped if i not in above), key=lambda i: (rest[i, up], self[i].name))

    def retarget(self, other: Topology, names: dict[str, str] | None = None, strict: bool = False) -> Topology:
        """Offsets of ``other`` for nodes whose (mapped) name it has."""
        offsets = {n.name: n.offset for n in other}
        asked = {n.name: (names or {}).get(n.name, n.name) for n in self}
        missing = sorted(n for n, m in asked.items() if m not in offsets)
        if strict and missing:
            raise KeyError(f"no counterpart for {missing}")
        return Topology([Node(n.name, n.parent, n.joint, n.order, offsets.get(asked[n.name], n.offset)) for n in self])

    def scale(self, factor: float) -> Topology:
        return Topology([Node(n.name, n.parent, n.joint, n.order, tuple(factor * c for c in n.offset)) for n in self])

    def extract(self, names: Sequence[str]) -> Topology:
        """Only the named joints, which include the root. Offsets of what goes are summed into what stays; a joint left
        without children gets an end site at the nearest one below it."""
        keep = [i for i, n in enumerate(self) if n.joint >= 0 and n.name in set(names)]
        if 0 not in keep:
            raise ValueError("the root must stay")
        if set(names) - {self[i].name for i in keep}:
            raise KeyError(f"unknown joints {sorted(set(names) - {self[i].name for i in keep})}")
        rest, place, out = self.rest_positions(), {}, []
        kept_parent = {}
        for i in keep:
            p = self[i].parent
            while p >= 0 and p not in keep:
                p = self[p].parent
            kept_parent[i] = p

        def add(i: int) -> None:
            n, p = self[i], kept_parent[i]
            place[i] = len(out)
            base = rest[p] if p >= 0 else rest[i] - np.array(n.offset)
            out.append(Node(n.name, place[p] if p >= 0 else -1, sum(x.joint >= 0 for x in out), n.order, tuple(rest[i] - base)))
            below = [k for k in keep if kept_parent[k] == i]
            for k in below:
                add(k)
            sites = [k for k, c in enumerate(self) if c.joint < 0 and c.parent == i]
            if sites or not below:
                at = rest[sites[0]] if sites else rest[self._tip_below(i)]
                out.append(Node(f"{n.name}_end", place[i], -1, "", tuple(at - rest[i])))

        add(keep[0])
        return Topology(out)

    def _tip_below(self, i: int) -> int:
        level = [i]
        while level:
            tip = next((k for k in level if self[k].joint < 0), None)
            if tip is not None:
                return tip
            level = [k for k, c in enumerate(self) if c.parent in level]
        return i

    def turned(self, m: Sequence[str | float]) -> Topology:
        """All offsets turned by a matrix of nine values."""
        r = np.array([float(str(x).strip("()")) for x in m]).reshape(3, 3)
        return Topology([Node(n.name, n.parent, n.joint, n.order, tuple(r @ np.array(n.offset))) for n in self])

    def mirrored(self, pairs: dict[str, str], lateral: int) -> Topology:
        """Offsets mirrored across the lateral axis and swapped between the named partners."""
        partner = pairs | {b: a for a, b in pairs.items()}
        by_name = {n.name: n for n in self}
        flip = lambda o: tuple(-c if k == lateral else c for k, c in enumerate(o))
        return Topology([Node(n.name, n.parent, n.joint, n.order, flip(by_name.get(partner.get(n.name, n.name), n).offset)) for n in self])

    def matches(self, other: Topology, offsets: bool = True, atol: float = 1e-6) -> bool:
        same = len(self) == len(other) and all(a.name == b.name and a.parent == b.parent and a.is_end_site == b.is_end_site for a, b in zip(self, other))
        return same and (not offsets or all(np.allclose(a.offset, b.offset, atol=atol) for a, b in zip(self, other)))

    def first_difference(self, other: Topology) -> str | None:
        """Where the hierarchies part, as text; None where names, parents and end sites are the same."""
        for i, (a, b) in enumerate(zip(self, other)):
            if a.name != b.name:
                return f"node {i} is {b.name!r}, not {a.name!r}"
            if a.parent != b.parent:
                return f"node {i} ({a.name!r}) hangs from node {b.parent}, not {a.parent}"
            if a.is_end_site != b.is_end_site:
                return f"node {i} ({a.name!r}) is {'an end site' if b.is_end_site else 'a joint'}"
        return None if len(self) == len(other) else f"{len(other)} nodes, not {len(self)}"

    def to_dict(self, position_order: str = "XYZ") -> dict[str, dict]:
        """Name to offset, parent and, for joints, rotation channels and children; the root has position channels too."""
        out: dict[str, dict] = {}
        for i, n in enumerate(self):
            entry: dict = {"offset": list(n.offset), "parent": self[n.parent].name if n.parent >= 0 else None}
            if i == 0:
                entry["pos_channels"] = list(position_order)
            if n.joint >= 0:
                entry |= {"rot_channels": list(n.order), "children": [c.name for c in self if c.parent == i]}
            out[n.name] = entry
        return out

    @classmethod
    def from_dict(cls, hierarchy: Mapping[str, Mapping], columns: Sequence[str] = ()) -> Topology:
        """Of such a dictionary. Entries need offset and parent; missing rotation channels follow the order of wide
        columns such as Hips_Z_rot; entries without children and columns are end sites."""
        for name, e in hierarchy.items():
            if "offset" not in e or "parent" not in e:
                raise ValueError(f"{name!r} needs an offset and a parent")
            for other in (*e.get("children", ()), *([e["parent"]] if e["parent"] not in (None, "None") else [])):
                if other not in hierarchy:
                    raise ValueError(f"{name!r} names {other!r}, which is not there")
        roots = [n for n, e in hierarchy.items() if e["parent"] in (None, "None")]
        if len(roots) != 1:
            raise ValueError("exactly one entry has no parent")
        below: dict[str, list[str]] = {n: list(e.get("children", ())) for n, e in hierarchy.items()}
        for n, e in hierarchy.items():
            if e["parent"] in below and n not in below[e["parent"]]:
                below[e["parent"]].append(n)
        turns: dict[str, str] = {}
        for c in columns:
            m = re.fullmatch(r"(.+)_([XYZ])_rot", c)
            if m:
                turns[m[1]] = turns.get(m[1], "") + m[2]
        nodes: list[Node] = []
        todo = [(roots[0], -1)]
        while todo:
            name, parent = todo.pop()
            e = hierarchy[name]
            order = "".join(e.get("rot_channels") or turns.get(name, ""))
            site = not order and not below[name]
            if not site and len(order) != 3:
                raise ValueError(f"{name!r} needs three rotation channels")
            nodes.append(Node(name, parent, -1 if site else sum(x.joint >= 0 for x in nodes), "" if site else order, tuple(map(float, e["offset"]))))
            todo += [(c, len(nodes) - 1) for c in reversed(below[name])]
        if len(nodes) != len(hierarchy):
            raise ValueError("entries do not hang together")
        return cls(nodes)

    def matches_channels(self, other: Topology) -> bool:
        return [n.order for n in self if n.joint >= 0] == [n.order for n in other if n.joint >= 0]

    def values(self) -> str:
        """The nodes as SQL rows."""
        rows = ", ".join(f"({i}, '{n.name}', {n.parent}, {n.joint}, '{n.order}', CAST({n.offset[0]} AS DOUBLE), CAST({n.offset[1]} AS DOUBLE), CAST({n.offset[2]} AS DOUBLE))" for i, n in enumerate(self))
        return f"SELECT * FROM (VALUES {rows}) AS n(node_idx, name, parent_idx, joint_idx, euler_order, off_x, off_y, off_z)"


def sample_rig() -> Topology:
    """A small upright figure: a root, a spine, two legs, each with its end site."""
    return Topology(
        [
            Node("Hips", -1, 0, "ZYX", (0.0, 0.0, 0.0)),
            Node("Spine", 0, 1, "ZYX", (0.0, 10.0, 0.0)),
            Node("Head", 1, -1, "", (0.0, 5.0, 0.0)),
            Node("LeftLeg", 0, 2, "ZXY", (-3.0, -5.0, 0.0)),
            Node("LeftFoot", 3, -1, "", (0.0, -5.0, 0.0)),
            Node("RightLeg", 0, 3, "XYZ", (3.0, -5.0, 0.0)),
            Node("RightFoot", 5, -1, "", (0.0, -5.0, 0.0)),
        ]
    )


def _matrices(angles: np.ndarray, order: str) -> np.ndarray:
    """(F, 3) radians to (F, 3, 3)."""
    out = None
    for k, axis in enumerate(order):
        c, s = np.cos(angles[:, k]), np.sin(angles[:, k])
        i, j = {"X": (1, 2), "Y": (2, 0), "Z": (0, 1)}[axis]
        m = np.zeros((len(angles), 3, 3))
        m[:, 3 - i - j, 3 - i - j] = 1
        m[:, i, i] = m[:, j, j] = c
        m[:, i, j], m[:, j, i] = -s, s
        out = m if out is None else out @ m
    return out


def pose_arrays(topology: Topology, root: np.ndarray, angles: np.ndarray, offsets: np.ndarray | None = None) -> np.ndarray:
    """(F, N, 3) positions of (F, 3) root positions and (F, J, 3) angles; the root's own offset plays no part.
    ``offsets`` (F, N, 3) stand for the topology's."""
    f = len(root)
    pos, turn = np.empty((f, len(topology), 3)), [None] * len(topology)
    for i, n in enumerate(topology):
        own = _matrices(angles[:, n.joint], n.order) if n.joint >= 0 else None
        if i == 0:
            pos[:, 0], turn[0] = root, own
            continue
        above = turn[n.parent]
        pos[:, i] = pos[:, n.parent] + (above @ np.array(n.offset) if offsets is None else np.einsum("fij,fj->fi", above, offsets[:, i]))
        turn[i] = above @ own if own is not None else above
    return pos


def fk_kernel(frames: DataFrame, topology: Topology, centered: str = "world", up: int = 1) -> DataFrame:
    """(clip, frame, pos array<double>) of (clip, frame, root array<double>, angles array<double>): no shuffle.

    centered is world, skeleton (the root at the origin), or first (needs root0: the clip's first root position).
    A column ``offsets`` holds a clip's own offsets of all nodes; a column ``dt`` passes through.
    """
    if centered not in ("world", "skeleton", "first"):
        raise ValueError("centered is world, skeleton or first")
    joints = len(topology.joint_names)
    nodes = tuple(topology)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = Topology(nodes)
        for b in batches:
            flat = lambda name: b.column(name).flatten().to_numpy(zero_copy_only=False)
            root, angles = flat("root").reshape(-1, 3), flat("angles").reshape(-1, joints, 3)
            shift = np.zeros_like(root)
            if centered == "skeleton":
                shift = root
            elif centered == "first":
                shift = flat("root0").reshape(-1, 3).copy()
                shift[:, up] = 0
            own = flat("offsets").reshape(-1, len(top), 3) if "offsets" in extra else None
            pos = (pose_arrays(top, root, angles, own) - shift[:, None, :]).reshape(-1)
            width = 3 * len(top)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(pos) + 1, width), pa.int32()), pa.array(pos))
            kept = ["clip", "frame", *(["dt"] if "dt" in extra else [])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), lists], [*kept, "pos"])

    kinds = dict(frames.dtypes)
    extra = (["root0"] if centered == "first" else []) + [c for c in ("offsets", "dt") if c in kinds]
    dt = ", dt double" if "dt" in extra else ""
    return frames.select("clip", "frame", "root", "angles", *extra).mapInArrow(run, f"clip {kinds['clip']}, frame {kinds['frame']}{dt}, pos array<double>")


def fk_sql(src: str, topology: Topology, centered: str = "world", up: str = "y") -> str:
    """p{node}_x, _y, _z for every node, from root_x .. root_z and a{joint}_0 .. _2 (radians)."""
    steps = []
    for i, n in enumerate(topology):
        if n.joint >= 0:
            steps += R.euler_to_matrix(tuple(f"a{n.joint}_{k}" for k in range(3)), n.order, f"l{i}_")
        if i == 0:
            steps.append({f"g0_{k}": f"l0_{k}" for k in range(9)} | {f"p0_{c}": f"root_{c}" for c in "xyz"})
            continue
        above = tuple(f"g{n.parent}_{k}" for k in range(9))
        moved = R.apply(above, tuple(f"({o})" for o in map(float, n.offset)))
        step = {f"p{i}_{c}": f"p{n.parent}_{c} + {moved[k]}" for k, c in enumerate("xyz")}
        if n.joint >= 0:
            step |= {f"g{i}_{k}": e for k, e in enumerate(R.matmul(above, tuple(f"l{i}_{k}" for k in range(9))))}
        steps.append(step)
    sql = stages(src, *steps)
    if centered == "world":
        return sql
    first = "OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    shift = {c: f"root_{c}" if centered == "skeleton" else "0.0" if c == up else f"first_value(root_{c}) {first}" for c in "xyz"}
    return stages(sql, {f"q{i}_{c}": f"p{i}_{c} - {shift[c]}" for i in range(len(topology)) for c in "xyz"})


def rest_pose_sql(nodes: str) -> str:
    """Rest positions: offsets summed along each path to the root, whose own offset counts as 0."""
    return (
        "WITH RECURSIVE tree AS (SELECT node_idx, CAST(0.0 AS DOUBLE) AS x, CAST(0.0 AS DOUBLE) AS y, CAST(0.0 AS DOUBLE) AS z, CAST(0 AS BIGINT) AS depth FROM ("
        f"{nodes}) r WHERE parent_idx < 0 UNION ALL SELECT c.node_idx, t.x + c.off_x, t.y + c.off_y, t.z + c.off_z, t.depth + 1 FROM tree t JOIN ({nodes}) c ON c.parent_idx = t.node_idx) SELECT * FROM tree"
    )


def validate_sql(nodes: str) -> str:
    """One row of counts of broken rules; all are 0 for a sound skeleton."""
    j = f"SELECT c.*, p.node_idx AS p_idx, p.joint_idx AS p_joint FROM ({nodes}) c LEFT JOIN ({nodes}) p ON c.parent_idx = p.node_idx"
    n = lambda cond: f"CAST(count(CASE WHEN {cond} THEN 1 END) AS BIGINT)"
    return (
        f"SELECT {n('parent_idx < 0')} - 1 AS extra_roots, {n('parent_idx >= node_idx')} AS late_parents, {n('parent_idx < 0 AND joint_idx < 0')} AS root_sites, "
        f"{n('parent_idx >= 0 AND p_idx IS NULL')} AS orphans, {n('p_joint < 0')} AS site_children, max(joint_idx) + 1 - {n('joint_idx >= 0')} AS joint_gaps, "
        f"{n('joint_idx >= 0 AND NOT (length(euler_order) = 3 AND euler_order LIKE ' + chr(39) + '%X%' + chr(39) + ' AND euler_order LIKE ' + chr(39) + '%Y%' + chr(39) + ' AND euler_order LIKE ' + chr(39) + '%Z%' + chr(39) + ')')} AS bad_orders FROM ({j})"
    )


def matches_sql(left: str, right: str, atol: float = 1e-6) -> str:
    """matches, and the first node that differs (null if none): names, parents and offsets in order."""
    near = " AND ".join(f"abs(a.off_{c} - b.off_{c}) <= {atol} + 1e-5 * abs(b.off_{c})" for c in "xyz")
    same = f"coalesce(a.name = b.name AND a.parent_idx = b.parent_idx AND {near}, FALSE)"
    return f"SELECT count(CASE WHEN NOT same THEN 1 END) = 0 AS matches, min(CASE WHEN NOT same THEN idx END) AS first_difference FROM (SELECT coalesce(a.node_idx, b.node_idx) AS idx, {same} AS same FROM ({left}) a FULL OUTER JOIN ({right}) b ON a.node_idx = b.node_idx)"


def edges_sql(nodes: str) -> str:
    return f"SELECT c.joint_idx AS child, p.joint_idx AS parent FROM ({nodes}) c JOIN ({nodes}) p ON c.parent_idx = p.node_idx WHERE c.joint_idx >= 0"


def tips_sql(nodes: str) -> str:
    """For each joint its first end site, null without one."""
    return f"SELECT j.joint_idx AS joint, min(e.node_idx) AS tip FROM ({nodes}) j LEFT JOIN (SELECT * FROM ({nodes}) WHERE joint_idx < 0) e ON e.parent_idx = j.node_idx WHERE j.joint_idx >= 0 GROUP BY j.joint_idx"


def retarget_sql(nodes: str, other: str) -> str:
    cols = ", ".join(f"coalesce(b.off_{c}, a.off_{c}) AS off_{c}" for c in "xyz")
    named = f"SELECT name, max(node_idx) AS last FROM ({other}) GROUP BY name"  # of repeated names the last counts
    return f"SELECT a.node_idx, a.name, a.parent_idx, a.joint_idx, a.euler_order, {cols} FROM ({nodes}) a LEFT JOIN ({named}) k ON a.name = k.name LEFT JOIN ({other}) b ON b.node_idx = k.last"


#: Endings that mark sides, the longer ones first.
_SIDES = ((".Left", ".Right"), ("_Left", "_Right"), (".left", ".right"), ("_left", "_right"), (".L", ".R"), ("_L", "_R"), (".l", ".r"), ("_l", "_r"))


def lr_pairs_sql(names: str) -> str:
    """(left_name, right_name) among rows of name, where both exist.

    Tried in turn: an ending such as .L or _left, the word left anywhere, an L before a capital. A
    namespace before a colon and a number such as .001 at the end are looked past, and must agree.
    """
    parts = stages(f"SELECT DISTINCT name FROM ({names})", {"pre": "regexp_extract(name, '^.*:', 0)", "num": "regexp_extract(name, '[.][0-9]+$', 0)"})
    parts = stages(parts, {"base": "substr(name, length(pre) + 1, length(name) - length(pre) - length(num))"})
    ends = [f"SELECT name, {i} AS rule, pre || substr(base, 1, length(base) - {len(a)}) || '{b}' || num AS wanted FROM ({parts}) WHERE base LIKE '%{a.replace('_', '!_')}' ESCAPE '!'" for i, (a, b) in enumerate(_SIDES)]
    word = f"SELECT name, 20 AS rule, pre || replace(replace(replace(base, 'Left', 'Right'), 'left', 'right'), 'LEFT', 'RIGHT') || num AS wanted FROM ({parts}) WHERE lower(base) LIKE '%left%'"
    capital = f"SELECT name, 21 AS rule, pre || 'R' || substr(base, 2) || num AS wanted FROM ({parts}) WHERE base LIKE 'L%' AND substr(base, 2, 1) BETWEEN 'A' AND 'Z'"
    tried = " UNION ALL ".join([*ends, word, capital])
    met = f"SELECT t.name AS left_name, t.wanted AS right_name, row_number() OVER (PARTITION BY t.name ORDER BY t.rule) AS r FROM ({tried}) t JOIN (SELECT DISTINCT name FROM ({names})) n ON n.name = t.wanted WHERE t.wanted <> t.name"
    return f"SELECT left_name, right_name FROM ({met}) WHERE r = 1"


def natural_key_sql(text: str, duck: bool = False) -> str:
    """A key that orders digit runs by value: text in lower case, runs of up to 12 digits padded on the left."""
    all_, one = (", 'g'", "\\1") if duck else ("", "$1")
    wide = f"regexp_replace(lower({text}), '([0-9]+)', '{'0' * 12}{one}'{all_})"
    return f"regexp_replace({wide}, '0*({'[0-9]' * 12})', '{one}'{all_})"


def size_sql(nodes: str, feet: Sequence[int]) -> str:
    """Mean distance of the chosen nodes from the root at rest."""
    return f"SELECT avg({norm(('x', 'y', 'z'))}) AS size FROM ({rest_pose_sql(nodes)}) WHERE node_idx IN ({', '.join(map(str, feet))})"


def hierarchy_text_sql(nodes: str, duck: bool = False) -> str:
    """Child lists by parent name, in node order."""
    return f"SELECT p.node_idx AS node_idx, p.name AS name, {joined_text('c.name', 'c.node_idx', duck)} AS children FROM ({nodes}) p JOIN ({nodes}) c ON c.parent_idx = p.node_idx GROUP BY p.node_idx, p.name"
