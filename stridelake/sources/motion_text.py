"""Motion text files (.bvh): a HIERARCHY of nodes with OFFSET and CHANNELS, then MOTION rows in degrees.

Reading gives clips, nodes and frames as DataFrames; angles are radians, positions as they stand.
Writing gives one text for each clip. Both run per file in Python workers, files in parallel.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.operators.orientation import world_up
from stridelake.operators.skeleton import Node, Topology, pose_arrays


@dataclass(frozen=True)
class Clip:
    topology: Topology
    frame_time: float
    root: np.ndarray  # (F, 3)
    angles: np.ndarray  # (F, J, 3) radians, in channel order
    position_order: str = "XYZ"


def snap(frame_time: float) -> float:
    """The frame time of the nearest whole rate where it is that within 1e-4, else as given."""
    if frame_time <= 0:
        return frame_time
    rate = round(1 / frame_time)
    return 1 / rate if rate > 0 and abs(frame_time * rate - 1) < 1e-4 else frame_time


def parse(text: str) -> Clip:
    """One file's clip; ValueError names what is wrong with it."""
    head, found, body = text.partition("MOTION")
    if not found:
        raise ValueError("no MOTION part")
    tokens = head.split()
    if not tokens or tokens[0] != "HIERARCHY":
        raise ValueError("no HIERARCHY part")
    nodes: list[dict] = []
    stack: list[int] = []
    columns: list[tuple[int, str]] = []
    i = 1
    while i < len(tokens):
        t = tokens[i]
        if t in ("ROOT", "JOINT") or t == "End":
            if t == "ROOT" and nodes:
                raise ValueError("more than one ROOT")
            if t != "ROOT" and not stack:
                raise ValueError(f"{t} outside the root")
            brace = tokens.index("{", i) if "{" in tokens[i:] else -1
            if brace < 0:
                raise ValueError(f"{t} without a block")
            name = " ".join(tokens[i + 1 : brace])
            parent = stack[-1] if stack else -1
            site = t == "End"
            nodes.append({"name": "End Site of " + nodes[parent]["name"] if site else name, "parent": parent, "site": site, "offset": None, "order": "", "pos": ""})
            stack.append(len(nodes) - 1)
            i = brace + 1
        elif t == "}":
            if not stack:
                raise ValueError("a closing brace too many")
            n = nodes[stack.pop()]
            if n["offset"] is None:
                raise ValueError(f"{n['name']}: no OFFSET")
            if not n["site"] and len(n["order"]) != 3:
                raise ValueError(f"{n['name']}: three rotation channels are needed")
            i += 1
        elif t == "OFFSET":
            nodes[stack[-1]]["offset"] = tuple(float(x) for x in tokens[i + 1 : i + 4])
            i += 4
        elif t == "CHANNELS":
            n = nodes[stack[-1]]
            count = int(tokens[i + 1])
            names = tokens[i + 2 : i + 2 + count]
            if n["site"]:
                raise ValueError("an end site has no channels")
            for c in names:
                m = re.fullmatch(r"([XYZ])(position|rotation)", c)
                if not m:
                    raise ValueError(f"unknown channel {c}")
                n["pos" if m[2] == "position" else "order"] += m[1]
                columns.append((stack[-1], c))
            wanted = 3 if stack[-1] == 0 else 0
            if len(n["pos"]) != wanted or len(n["order"]) != 3 or len(set(n["order"])) != 3:
                raise ValueError(f"{n['name']}: {wanted} positions and 3 rotations are needed")
            i += 2 + count
        else:
            raise ValueError(f"unexpected {t!r} in the hierarchy")
    if stack:
        raise ValueError("a block is not closed")
    if not nodes:
        raise ValueError("no ROOT")
    m = re.match(r"\s*Frames:\s*(\d+)\s+Frame Time:\s*([0-9.eE+-]+)\s*", body)
    if not m:
        raise ValueError("no frame count and frame time")
    count, data = int(m[1]), np.array(body[m.end() :].split(), float)
    if data.size != count * len(columns):
        raise ValueError(f"{count} frames of {len(columns)} values expected, {data.size} values found")
    data = data.reshape(count, len(columns))
    joints = [k for k, n in enumerate(nodes) if not n["site"]]
    number = {k: j for j, k in enumerate(joints)}
    root, angles = np.zeros((count, 3)), np.zeros((count, len(joints), 3))
    for c, (k, name) in enumerate(columns):
        if name.endswith("position"):
            root[:, "XYZ".index(name[0])] = data[:, c]
        else:
            angles[:, number[k], nodes[k]["order"].index(name[0])] = np.radians(data[:, c])
    top = Topology([Node(n["name"], n["parent"], number.get(k, -1), n["order"], n["offset"]) for k, n in enumerate(nodes)])
    return Clip(top, snap(float(m[2])), root, angles, nodes[0]["pos"])


def render(clip: Clip) -> str:
    """The text of a clip: six decimals, positions first, ten digits of frame time."""
    top, out, open_ = clip.topology, ["HIERARCHY"], []
    for i, n in enumerate(top):
        while open_ and open_[-1] != n.parent:
            open_.pop()
            out.append("  " * len(open_) + "}")
        pad = "  " * len(open_)
        out += [pad + ("End Site" if n.joint < 0 else f"{'JOINT' if i else 'ROOT'} {n.name}"), pad + "{", pad + "  OFFSET " + " ".join(f"{c:.6f}" for c in n.offset)]
        if n.joint >= 0:
            turns = " ".join(f"{c}rotation" for c in n.order)
            out.append(pad + (f"  CHANNELS 3 {turns}" if i else f"  CHANNELS 6 {' '.join(f'{c}position' for c in clip.position_order)} {turns}"))
        open_.append(i)
    while open_:
        open_.pop()
        out.append("  " * len(open_) + "}")
    out += ["MOTION", f"Frames: {len(clip.root)}", f"Frame Time: {clip.frame_time:.10g}"]
    place = ["XYZ".index(c) for c in clip.position_order]
    degrees = np.degrees(clip.angles)
    for f in range(len(clip.root)):
        row = np.concatenate([clip.root[f, place], degrees[f].ravel()])
        out.append(" ".join(f"{x:.6f}" for x in row))
    return "\n".join(out) + "\n"


_FILES = "source_path string, error string, frame_time double, names array<string>, parents array<int>, joints array<int>, orders array<string>, offsets array<double>, root array<double>, angles array<double>, world_up string, position_order string"


def read_files(spark: SparkSession, path: str, pattern: str = "*.bvh", recursive: bool = False) -> DataFrame:
    """One row for each file: its skeleton and motion as flat arrays, its up axis from the first pose, or an error and nulls."""
    raw = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).text(path, wholetext=True).select(F.input_file_name().alias("source_path"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    c = parse(text)
                    t = c.topology
                    row = [source, None, c.frame_time, [n.name for n in t], [n.parent for n in t], [n.joint for n in t], [n.order for n in t], [x for n in t for x in n.offset], c.root.ravel(), c.angles.ravel()]
                    first = pose_arrays(t, c.root[:1], c.angles[:1])[0] if len(c.root) else None
                    row += [world_up(t, first), c.position_order]
                except (ValueError, IndexError) as e:
                    row = [source, str(e)] + [None] * 10
                kinds = [pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), *[pa.list_(pa.float64())] * 3, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], [f.split()[0] for f in _FILES.split(", ")])

    return raw.mapInArrow(run, _FILES)


def clips(files: DataFrame) -> DataFrame:
    """(clip, source_path, frame_time, frame_count) of files without error; clip is a hash of the path."""
    return files.where("error is null").select(F.xxhash64("source_path").alias("clip"), "source_path", "frame_time", (F.size("root") / 3).cast("int").alias("frame_count"))


def nodes(files: DataFrame) -> DataFrame:
    n = files.where("error is null").select(F.xxhash64("source_path").alias("clip"), F.posexplode(F.arrays_zip("names", "parents", "joints", "orders")).alias("node_idx", "n"), "offsets")
    off = [F.get("offsets", F.col("node_idx") * 3 + i).alias(f"off_{c}") for i, c in enumerate("xyz")]
    return n.select("clip", "node_idx", F.col("n.names").alias("name"), F.col("n.parents").alias("parent_idx"), F.col("n.joints").alias("joint_idx"), F.col("n.orders").alias("euler_order"), *off)


def frames(files: DataFrame) -> DataFrame:
    """(clip, frame, root array, angles array, offsets array, dt): what the forward kinematics kernel takes, with each clip's own offsets and rate."""
    n = F.size("root") / 3
    width = (F.size("angles") / n).cast("int")
    f = files.where("error is null and size(root) > 0").select(F.xxhash64("source_path").alias("clip"), F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("frame"), "root", "angles", width.alias("w"), "offsets", F.col("frame_time").alias("dt"))
    return f.select("clip", F.col("frame").cast("long").alias("frame"), F.slice("root", F.col("frame") * 3 + 1, F.lit(3)).alias("root"), F.slice("angles", F.col("frame") * F.col("w") + 1, F.col("w")).alias("angles"), "offsets", "dt")


def write_texts(files: DataFrame) -> DataFrame:
    """(source_path, value): the text of each row of ``read_files``, ready for ``df.write.text`` or a per-file writer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                if r["error"] is not None:
                    continue
                off = np.array(r["offsets"]).reshape(-1, 3)
                top = Topology([Node(*x, tuple(o)) for *x, o in zip(r["names"], r["parents"], r["joints"], r["orders"], off)])
                joints = len(top.joint_names)
                text = render(Clip(top, r["frame_time"], np.array(r["root"]).reshape(-1, 3), np.array(r["angles"]).reshape(-1, joints, 3), r.get("position_order") or "XYZ"))
                yield pa.RecordBatch.from_arrays([pa.array([r["source_path"]]), pa.array([text])], ["source_path", "value"])

    return files.mapInArrow(run, "source_path string, value string")


def write_clips(frames_: DataFrame, topology: Topology, frame_time: float, folder: str, position_order: str = "XYZ", overwrite: bool = True) -> DataFrame:
    """(clip, path): a file {clip}.bvh for each clip of (clip, frame, root, angles[, offsets, dt]) in a folder that all tasks share.

    A task holds one clip, writes under a name of its own and renames, so a task that runs twice leaves one whole file.
    """
    joints, kinds = len(topology.joint_names), dict(frames_.dtypes)
    own = [c for c in ("offsets", "dt") if c in kinds]
    nodes_ = tuple(topology)

    def run(batch: pa.Table) -> pa.Table:
        b = batch.combine_chunks().sort_by("frame")
        flat = lambda c: b.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        top, step = Topology(nodes_), frame_time
        if "offsets" in own:
            off = np.array(b.column("offsets")[0].as_py()).reshape(-1, 3)
            top = Topology([Node(n.name, n.parent, n.joint, n.order, tuple(o)) for n, o in zip(top, off)])
        if "dt" in own:
            step = b.column("dt")[0].as_py()
        name = b.column("clip")[0].as_py()
        place, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        place.create_dir(base, recursive=True)
        path, own_name = f"{base}/{name}.bvh", f"{base}/.{uuid.uuid4().hex}"
        if not overwrite and place.get_file_info(path).type != fs.FileType.NotFound:
            raise FileExistsError(path)
        text = render(Clip(top, step, flat("root").reshape(-1, 3), flat("angles").reshape(-1, joints, 3), position_order))
        with place.open_output_stream(own_name) as f:
            f.write(text.encode())
        place.move(own_name, path)
        return pa.table({"clip": pa.array([name], b.column("clip").type), "path": pa.array([path])})

    return frames_.select("clip", "frame", "root", "angles", *own).groupBy("clip").applyInArrow(run, f"clip {kinds['clip']}, path string")


def wide(clip: Clip) -> dict[str, np.ndarray]:
    """Columns time, {root}_{axis}_pos and {joint}_{axis}_rot in degrees, by their place."""
    out = {"time": np.arange(len(clip.root)) * clip.frame_time}
    name = clip.topology[0].name
    out |= {f"{name}_{c}_pos": clip.root[:, i] for i, c in enumerate("XYZ")}
    for n in clip.topology:
        if n.joint >= 0:
            out |= {f"{n.name}_{c}_rot": np.degrees(clip.angles[:, n.joint, k]) for k, c in enumerate(n.order)}
    return out


def from_wide(df: DataFrame, topology: Topology, clip: str | None = None) -> tuple[DataFrame, float]:
    """(clip, frame, root, angles[, dt]) of a wide DataFrame, and the frame time of the first clip; columns may come in any
    order, a missing one is an error. Without a ``clip`` column all rows are clip 0; with one, clips have times of their own."""
    name = topology[0].name
    need = ["time", *(f"{name}_{c}_pos" for c in "XYZ"), *(f"{n.name}_{c}_rot" for n in topology if n.joint >= 0 for c in n.order)]
    missing = [c for c in [*need, *([clip] if clip else [])] if c not in df.columns]
    if missing:
        raise KeyError(f"columns are missing: {missing}")
    key = F.col(f"`{clip}`") if clip else F.lit(0).cast("long")
    rows = df.withColumn("__clip", key)
    spans = rows.groupBy("__clip").agg(F.count("*").alias("__n"), F.min("time").alias("__t0"), F.max("time").alias("__t1"))
    least = spans.agg(F.min("__n")).first()[0]
    if least is None or least < 2:
        raise ValueError("two rows of a clip at least are needed")
    raw = "(__t1 - __t0) / (__n - 1)"
    near = f"abs({raw} * round(1 / ({raw})) - 1) < 1e-4D AND round(1 / ({raw})) > 0"
    spans = spans.select("__clip", "__t0", F.expr(f"CASE WHEN {near} THEN 1 / round(1 / ({raw})) ELSE {raw} END").alias("__dt"))
    step = spans.agg(F.min_by("__dt", "__clip")).first()[0]
    turns = F.array(*[F.radians(F.col(f"`{n.name}_{c}_rot`")) for n in topology if n.joint >= 0 for c in n.order])
    met = rows.join(spans, "__clip")
    out = [F.col("__clip").alias("clip"), F.round((F.col("time") - F.col("__t0")) / F.col("__dt")).cast("long").alias("frame"), F.array(*[F.col(f"`{name}_{c}_pos`") for c in "XYZ"]).alias("root"), turns.alias("angles")]
    return met.select(*out, *([F.col("__dt").alias("dt")] if clip else [])), step


def to_wide(frames_: DataFrame, topology: Topology, frame_time: float | str) -> DataFrame:
    """One row for each frame with the columns of ``wide``: projections only, as a frame's arrays are already one row. The frame time may be a column."""
    name = topology[0].name
    cols = [(F.col("frame") * F.expr(str(frame_time))).alias("time"), *[F.col("root")[i].alias(f"{name}_{c}_pos") for i, c in enumerate("XYZ")]]
    cols += [F.degrees(F.col("angles")[3 * n.joint + k]).alias(f"{n.name}_{c}_rot") for n in topology if n.joint >= 0 for k, c in enumerate(n.order)]
    return frames_.select("clip", "frame", *cols)
