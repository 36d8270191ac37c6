"""Whole frames in Arrow batches: rotations of all joints from one form to another and turns of a motion.

A frame holds ``root`` (three coordinates) and ``angles`` (three Euler angles a joint, radians). The
kernels work on the rows of a batch at once and shuffle nothing; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from stridelake.operators.dataset import WIDTHS
from stridelake.operators.kernels import _angles, _quaternions
from stridelake.operators.skeleton import _matrices


def matrices_of(x: np.ndarray, form: str, orders: Sequence[str]) -> np.ndarray:
    """(F, J, 3, 3) of (F, J, width) rotations. Quaternions are normalised; of six values two columns are made orthonormal."""
    f, joints = x.shape[:2]
    if form == "euler":
        return np.stack([_matrices(x[:, j], order) for j, order in enumerate(orders)], 1)
    if form == "rotmat":
        return x.reshape(f, joints, 3, 3)
    if form == "6d":
        a, b = x[..., :3], x[..., 3:]
        a = a / np.maximum(np.linalg.norm(a, axis=-1, keepdims=True), 1e-12)
        b = b - (a * b).sum(-1, keepdims=True) * a
        b = b / np.maximum(np.linalg.norm(b, axis=-1, keepdims=True), 1e-12)
        return np.stack([a, b, np.cross(a, b)], -1)
    if form == "axisangle":
        size = np.linalg.norm(x, axis=-1, keepdims=True)
        scale = np.where(size > 1e-12, np.sin(size / 2) / np.where(size > 1e-12, size, 1.0), 0.5)
        x = np.concatenate([np.cos(size / 2), scale * x], -1)
    elif form != "quat":
        raise ValueError(f"the form of rotations is one of {sorted(WIDTHS)}")
    w, i, j, k = np.moveaxis(x / np.linalg.norm(x, axis=-1, keepdims=True), -1, 0)
    rows = [1 - 2 * (j * j + k * k), 2 * (i * j - w * k), 2 * (i * k + w * j), 2 * (i * j + w * k), 1 - 2 * (i * i + k * k), 2 * (j * k - w * i), 2 * (i * k - w * j), 2 * (j * k + w * i), 1 - 2 * (i * i + j * j)]
    return np.stack(rows, -1).reshape(f, joints, 3, 3)


def rotations_of(m: np.ndarray, form: str, orders: Sequence[str]) -> np.ndarray:
    """(F, J, width) of (F, J, 3, 3) matrices: quaternions have w >= 0, rotation vectors a length in [0, pi]."""
    if form == "rotmat":
        return m.reshape(*m.shape[:2], 9)
    if form == "6d":
        return np.concatenate([m[..., 0], m[..., 1]], -1)
    q = _quaternions(m)
    if form == "quat":
        return q
    if form == "axisangle":
        size = np.linalg.norm(q[..., 1:], axis=-1, keepdims=True)
        angle = 2 * np.arctan2(size, q[..., :1])
        return q[..., 1:] * np.where(size > 1e-12, angle / np.where(size > 1e-12, size, 1.0), 2.0)
    if form != "euler":
        raise ValueError(f"the form of rotations is one of {sorted(WIDTHS)}")
    return np.stack([_angles(q[:, j], order) for j, order in enumerate(orders)], 1)


def mapped(frames: DataFrame, f: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], width: int, have: str = "angles", want: str = "angles") -> DataFrame:
    """``frames`` with ``root`` and ``have``, a row of ``width`` numbers a joint, as ``f`` returns them; ``have`` becomes ``want``."""
    names = frames.columns
    numbers = ArrayType(DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat = lambda c: b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            root, turned = f(flat("root"), flat(have).reshape(b.num_rows, -1, width))
            new = {"root": root, have: turned.reshape(b.num_rows, -1)}
            yield pa.RecordBatch.from_arrays([pa.array(list(new[c]), pa.list_(pa.float64())) if c in new else b.column(c) for c in names], [want if c == have else c for c in names])

    fields = [StructField(want, numbers) if x.name == have else StructField("root", numbers) if x.name == "root" else x for x in frames.schema.fields]
    return frames.mapInArrow(run, StructType(fields))


def converted(frames: DataFrame, have: str, want: str, orders: Sequence[str], new_orders: Sequence[str] | None = None, column: str = "angles", out: str = "rotations") -> DataFrame:
    """``frames`` with rotations of all joints in another form, or in the same one with ``new_orders``."""
    now, then = list(orders), list(new_orders or orders)
    if have not in WIDTHS or want not in WIDTHS:
        raise ValueError(f"the form of rotations is one of {sorted(WIDTHS)}")

    def f(root: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return root, x if have == want and now == then else rotations_of(matrices_of(x, have, now), want, then)

    return mapped(frames, f, WIDTHS[have], column, out)


def turned(frames: DataFrame, orders: Sequence[str], m: np.ndarray, rest_only: bool) -> DataFrame:
    """Frames after a change of axes by the matrix m, whose skeleton's offsets turn by it too. With ``rest_only``
    the poses stay where they are: the root's rotation takes the turn back."""
    orders = list(orders)

    def f(root: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = matrices_of(x, "euler", orders)
        new = m @ r @ m.T
        if rest_only:
            new[:, 0] = r[:, 0] @ m.T
        return (root if rest_only else root @ m.T), rotations_of(new, "euler", orders)

    return mapped(frames, f, 3)


def turned_about(frames: DataFrame, order: str, axis: int, angle: str, pivot: tuple[float, float, float] | None = None) -> DataFrame:
    """Root positions and the root's rotation turned about a world axis by ``angle`` (SQL, radians) through ``pivot``,
    or through the first root position of ``root0`` where that is None. The coordinate along the axis stays as it is."""
    place = [i for i in range(3) if i != axis]

    def f(root: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # the last numbers of a row are the angle and the pivot
        own, turn, at = root[:, :3], root[:, 3], root[:, 4:7]
        m = _matrices(turn[:, None], "XYZ"[axis])
        at = at.copy()
        at[:, axis] = 0.0
        moved = np.einsum("fij,fj->fi", m, own - at) + at
        moved[:, axis] = own[:, axis]
        new = x.copy()
        first = m @ _matrices(x[:, 0], order)
        new[:, 0] = rotations_of(first[:, None], "euler", [order])[:, 0]
        return moved, new

    assert len(place) == 2
    extra = f"array({', '.join(map(str, map(float, pivot)))})" if pivot is not None else "root0"
    rows = frames.selectExpr(*[f"concat(root, array(CAST({angle} AS double)), {extra}) AS root" if c == "root" else c for c in frames.columns])
    return mapped(rows, f, 3)


def mirrored(frames: DataFrame, orders: Sequence[str], pairs: Sequence[tuple[int, int]], lateral: int) -> DataFrame:
    """Root positions and angles as in a mirror across the lateral axis, the joints of a pair changing places."""
    sign = np.array([[1.0 if c == "XYZ"[lateral] else -1.0 for c in order] for order in orders])
    place = np.arange(len(sign))
    for a, b in pairs:
        place[[a, b]] = place[[b, a]]

    def f(root: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = root.copy()
        new[:, lateral] *= -1
        return new, (x * sign)[:, place]

    return mapped(frames, f, 3)
