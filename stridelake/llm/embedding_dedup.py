"""Near-duplicate vectors by PCA-ordered tiled comparison.

1. Equal vectors form a class; all later work is on one row for each class.
2. Unit vectors are turned into the principal axes of all classes, largest variance first, so the
   leading coordinates carry most of every product.
3. Space is parted into cells by a tree over the leading coordinates. A pair with cosine c lies
   sqrt(2 - 2c) apart at most, so a vector visits just the cells within that distance that come after
   its own: each pair meets once, in the later of its two cells, however the tree was chosen (it
   comes from a bounded sample). The meeting counts for both.
4. In a cell, tiles of own vectors meet tiles of own and visiting ones. A tile adds up products of
   leading coordinates, a group of axes at a time, and bounds the rest by the product of the suffix
   norms; pairs that cannot reach the threshold are dropped, and a tile with none left stops. What
   remains is confirmed on the unit vectors in the original axes, in double precision.

Crowded cells are dealt out by hash, so a task holds ``cell_rows`` own vectors; visitors stream past.
The bounds decide how many cells a vector visits: few where the leading axes hold most of the
variance, half of all where no axis does. Then the work is that of all pairs of tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import small, written
from stridelake.llm.graph import components
from stridelake.llm.minhash_dedup import _Forest


def _clean(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v array<double> or null): null where a vector is null, empty, zero or has null or non-finite parts."""
    v = F.transform(F.col("e"), lambda x: x.cast("double") + F.lit(0.0))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("e")).select("vec_id", v.alias("v"))
    return rows.select("vec_id", F.when(F.coalesce(F.col("v").isNotNull() & (F.size("v") > 0) & ~bad, F.lit(False)) & F.col("vec_id").isNotNull(), F.col("v")).alias("v"))


def _unit(column: pa.ListArray) -> np.ndarray:
    """Rows of unit length; scaled by the largest part first, so that squares neither overflow nor vanish."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _axes(classes: DataFrame, dim: int) -> np.ndarray:
    """Principal axes as columns, from the second moments of all classes: one dim x dim matrix for each task, summed by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        mean = np.zeros(dim)
        n = 0
        for b in batches:
            x = _unit(b.column(0))
            if len(x):
                total += x.T @ x
                mean += x.sum(0)
                n += len(x)
        if n:
            i = np.arange(dim * dim + dim + 1)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(np.concatenate([total.ravel(), mean, [float(n)]]))], ["i", "x"])

    rows = classes.select("v").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toArrow()
    x = rows.column("x").to_numpy()
    n = x[-1]
    mean = x[dim * dim : -1] / n
    value, vector = np.linalg.eigh(x[: dim * dim].reshape(dim, dim) / n - np.outer(mean, mean))
    return vector[:, np.argsort(-value)]


def _tree(points: np.ndarray, least: int) -> list:
    """Nested (axis, cut, below, above), cut at medians of the widest axis; leaves are numbers."""
    count = [0]

    def grow(p: np.ndarray):
        spread = p.max(0) - p.min(0) if len(p) else np.zeros(1)
        axis = int(spread.argmax())
        if len(p) < 2 * least or spread[axis] < 0.05:
            count[0] += 1
            return count[0] - 1
        cut = float(np.median(p[:, axis]))
        below = p[:, axis] < cut
        if not below.any() or below.all():
            count[0] += 1
            return count[0] - 1
        return axis, cut, grow(p[below]), grow(p[~below])

    return grow(points)


def _visits(tree, lead: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home) for every cell whose part of space lies within radius of a row."""
    rows, cells, homes = [], [], []

    def walk(node, at: np.ndarray, gap: np.ndarray, home: np.ndarray) -> None:
        """gap: squared distances to the part of space, one for each axis."""
        if not len(at):
            return
        if not isinstance(node, tuple):
            rows.append(at)
            cells.append(np.full(len(at), node))
            homes.append(home)
            return
        axis, cut, below, above = node
        d = lead[at, axis] - cut
        for child, inside in ((below, d < 0), (above, d >= 0)):
            far = gap.copy()
            far[:, axis] = np.where(inside, far[:, axis], np.maximum(far[:, axis], d * d))
            near = far.sum(1) <= radius * radius
            walk(child, at[near], far[near], (home & inside)[near])

    n = len(lead)
    walk(tree, np.arange(n), np.zeros((n, lead.shape[1])), np.ones(n, bool))
    return np.concatenate(rows), np.concatenate(cells), np.concatenate(homes)


class _Tile:
    """Own vectors of a cell, in original and principal axes, with suffix norms after each group of axes."""

    def __init__(self, ids: np.ndarray, weight: np.ndarray, unit: np.ndarray, axes: np.ndarray, steps: list[int]):
        self.ids, self.weight, self.unit = ids, weight, unit
        self.turned = unit @ axes
        rest = np.cumsum((self.turned**2)[:, ::-1], axis=1)[:, ::-1]
        self.suffix = {s: np.sqrt(np.maximum(rest[:, s], 0)) for s in steps if s < unit.shape[1]}


def compare(own: _Tile, other: _Tile, steps: list[int], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (own, other) of the pairs that reach the threshold."""
    slack = 1e-9  # covers the rounding of the turned products; what passes is confirmed below
    sums = None
    at = 0
    for s in steps:
        part = own.turned[:, at:s] @ other.turned[:, at:s].T
        sums = part if sums is None else sums + part
        at = s
        if s == own.turned.shape[1]:
            break
        open_ = sums + own.suffix[s][:, None] * other.suffix[s][None, :] >= threshold - slack
        left = int(open_.sum())
        if not left:
            return np.empty(0, int), np.empty(0, int)
        if left * 20 < open_.size:  # few pairs: finish them one by one
            i, j = np.nonzero(open_)
            return _confirm(own, other, i, j, threshold)
    i, j = np.nonzero(sums >= threshold - slack)
    return _confirm(own, other, i, j, threshold)


def _confirm(own: _Tile, other: _Tile, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    good = np.empty(len(i), bool)
    for lo in range(0, len(i), 65536):
        a, b = i[lo : lo + 65536], j[lo : lo + 65536]
        good[lo : lo + 65536] = np.einsum("ij,ij->i", own.unit[a], other.unit[b]) >= threshold
    return i[good], j[good]


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding", cell_rows: int = 4096, lead: int = 8, group: int = 16, sample: int = 20_000) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each input row.

    n_links counts other rows linked directly, equal vectors included; component_id is the smallest
    id reachable; kept means that it is the row's own. A vector that is null, empty or zero, or has a
    null or non-finite part, links with nothing, nor does a row without an id (kept, its component
    null). Vectors of different lengths never link. Rows that repeat an id and vector count as links
    of each other. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    base = written(_clean(vectors, vec_id, embedding))
    found = None
    classes = written(base.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("rows")))
    # an id may come with several vectors: classes have numbers of their own
    classes = written(classes.withColumn("k", F.monotonically_increasing_id()))
    dims = [r[0] for r in classes.select(F.size("v")).distinct().collect()]
    for dim in dims:
        one = _linked(classes.where(F.size("v") == dim), dim, threshold, cell_rows, min(lead, dim), group, sample)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = written(found)
    near = components(found.where("b is not null"), "k", "b").withColumnRenamed("node", "k")
    sums = found.where("b is null").groupBy("k").agg(F.sum("n").alias("n"))
    placed = classes.join(near, "k", "left").withColumn("component", F.coalesce("component", "k"))
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    ends = placed.join(least, "component").join(sums, "k", "left").select("v", "component_id", (F.coalesce("n", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    out = base.join(ends, "v", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _linked(classes: DataFrame, dim: int, threshold: float, cell_rows: int, lead: int, group: int, sample: int) -> DataFrame:
    """(k, b, n): with b null, rows that class k links with besides its own, in parts; else a link of a spanning forest."""
    axes = _axes(classes, dim)
    radius = math.sqrt(max(0.0, 2 - 2 * threshold)) * (1 + 1e-9)
    steps = sorted({*range(group, dim, group), dim})
    some = classes.select("v").orderBy(F.xxhash64("k"), "k").limit(sample).toArrow()
    total = classes.count()
    tree = _tree((_unit(some.column("v").combine_chunks()) @ axes[:, :lead]), max(32, min(cell_rows, cell_rows * len(some) // max(1, total))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                unit = _unit(part.column(2))
                row, cell, home = _visits(tree, unit @ axes[:, :lead], radius)
                own = np.empty(len(unit), np.int64)
                own[row[home]] = cell[home]
                once = cell >= own[row]
                row, cell, home = row[once], cell[once], home[once]
                some = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(home), some.column(0), some.column(1), pa.array([x.tobytes() for x in unit[row]], pa.binary())], ["cell", "home", "k", "rows", "unit"])

    dealt = written(classes.select("k", "rows", "v").mapInArrow(deal, "cell long, home boolean, k long, rows long, unit binary"))
    crowd = dealt.where("home").groupBy("cell").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("decks"))
    # a row for each leaf of the tree, whose number the sample bounds
    placed = dealt.join(small(written(crowd), 500_000), "cell")
    mine = F.pmod(F.xxhash64("k"), F.col("decks")).cast("int")
    # a cell's own rows are held in one deck (turn 0) and pass the others (1), as visitors pass all (2)
    turn = F.when(~F.col("home"), 2).when(F.col("deck") == mine, 0).otherwise(1)
    seen = placed.withColumn("deck", F.explode(F.sequence(F.lit(0), F.col("decks") - 1))).withColumn("turn", turn)
    rows = seen.select("cell", "deck", "turn", "k", "rows", "unit").repartition("cell", "deck").sortWithinPartitions("cell", "deck", "turn", "k")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, at, counts, forest, links, hold, place = None, None, None, None, [], [], {}

        def out(k, b, n):
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["k", "b", "n"])

        def against(ids, weight, unit, both: bool):
            """Counts links of the tile's rows with other ones, and of those too if they meet nowhere else."""
            i, j = compare(tile, _Tile(ids, weight, unit, axes, steps), steps, threshold)
            other = tile.ids[i] != ids[j]
            i, j = i[other], j[other]
            np.add.at(counts, i, weight[j])
            # one link of each visitor to each component of own rows is enough
            told = set()
            for x, y in zip(i.tolist(), ids[j].tolist()):
                mate = place.get(y)
                if mate is not None:
                    if forest.join(x, mate):
                        links.append((int(tile.ids[x]), y))
                elif (c := (y, forest.find(x))) not in told:
                    told.add(c)
                    links.append((int(tile.ids[x]), y))
            if both and len(j):
                theirs = np.bincount(j, tile.weight[i], len(ids)).astype(np.int64)
                some = np.flatnonzero(theirs)
                yield out(ids[some], [None] * len(some), theirs[some])

        def start():
            """The rows held so far become the tile and are compared with each other."""
            nonlocal tile, counts, forest, place, hold
            ids, weight, unit = (np.concatenate(x) for x in zip(*hold))
            tile, hold = _Tile(ids, weight, unit, axes, steps), []
            counts, forest = np.zeros(len(ids), np.int64), _Forest(len(ids))
            place = {k: i for i, k in enumerate(ids.tolist())}
            for lo in range(0, len(ids), 1024):
                yield from against(ids[lo : lo + 1024], weight[lo : lo + 1024], unit[lo : lo + 1024], False)

        def done():
            if hold:
                yield from start()
            if tile is not None:
                yield out(tile.ids, [None] * len(tile.ids), counts)
                yield out([x for x, _ in links], [y for _, y in links], [0] * len(links))

        for b in batches:
            key = np.stack([b.column(i).to_numpy() for i in range(3)])
            edge = np.flatnonzero((np.diff(key, axis=1) != 0).any(0)) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), b.num_rows]):
                for s in range(lo, hi, 1024):
                    part = b.slice(s, min(1024, hi - s))
                    cell, turn = (int(key[0, s]), int(key[1, s])), key[2, s]
                    unit = np.frombuffer(b"".join(part.column(5).to_pylist()), np.float64).reshape(-1, dim)
                    ids, weight = part.column(3).to_numpy(), part.column(4).to_numpy()
                    if cell != at:
                        yield from done()
                        tile, at, links, hold = None, cell, [], []
                    if turn == 0:
                        hold.append((ids, weight, unit))
                        continue
                    if tile is None:
                        if not hold:
                            continue
                        yield from start()
                    yield from against(ids, weight, unit, turn == 2)
        yield from done()

    return rows.mapInArrow(meet, "k long, b long, n long")
