"""Embedding near-duplicates by an epsilon grid order join.

Vectors of cosine at least t, scaled to length one, lie within eps = sqrt(2 - 2t). Distinct vectors are turned to their principal
axes and sorted by the cells of an eps-grid on the leading ones (lexicographically), then along the first axis. The sorted sequence is
cut into intervals, which form a tree of FAN children a node. Pairs of intervals are found by going down that tree from the root: a pair
of nodes whose bounding boxes on BOX_AXES axes are further apart than eps is left out with all below it. The pairs of intervals that
remain are joined in tasks by halving them recursively in the same way, and comparing what remains in double precision.

An interval is shipped once to each interval it may meet; there are INTERVALS of them until one would be larger than INTERVAL_BYTES, so
up to then what is shipped grows as the rows do. No pair is returned: a task gives each vector's number of links and a forest over what it
joined, so that rows stay proportional to vectors whatever the size of a group. Equal vectors are one vector with a count.

Cases: vectors that are null, zero, empty or hold null or non-finite components, and rows with a null id, link with
nothing; vectors of different lengths link with nothing of another length; equal rows count one by one; rows of one id and
different vectors are different vectors, each with its own links; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import connected_components, materialize, numbered

#: Leading principal axes with a grid, axes of the bounding boxes, vectors compared at once.
GRID_AXES = 8
BOX_AXES = 16
LEAF = 128
#: Intervals of the sorted sequence, and the most bytes of one in double precision (there are more intervals beyond that): a task that joins two holds them and as
#: many turned to the axes. Vectors in a packed row.
INTERVALS = 16
INTERVAL_BYTES = 32 << 20
CHUNK = 1024
#: Children of a node in the tree of intervals.
FAN = 8
#: Room for rounding where boxes are compared.
SLACK = 1e-6


def _unpacked(raw: bytes, n: int, dim: int) -> np.ndarray:
    """n packed vectors of single or double precision, in double."""
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * n * dim else np.float64).astype(np.float64).reshape(n, dim)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, or of packed binaries, in double precision."""
    if pa.types.is_binary(column.type):
        return _unpacked(b"".join(column.to_pylist()), len(column), dim)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Columns: the principal axes of all vectors scaled to length one, by falling variance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim))
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            total += np.vstack([x.T @ x, x.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["i", "x"])

    sums = vectors.select("vec").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    total = np.zeros((dim + 1) * dim)
    for s in sums:  # (dim + 1) * dim numbers
        total[s.i] = s.x
    total, n = total.reshape(dim + 1, dim), max(1, vectors.count())
    mean = total[dim] / n
    values, axes = np.linalg.eigh(total[:dim] / n - np.outer(mean, mean))
    return axes[:, np.argsort(values)[::-1]]


def _distance(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> float:
    return float(np.linalg.norm(np.maximum(0, np.maximum(lo - hi2, lo2 - hi))))


class Joiner:
    """Joins pairs of blocks; keeps the weighted numbers of links, and a forest over all it joined."""

    def __init__(self, threshold: float, eps: float, axes: np.ndarray):
        self.threshold, self.eps, self.axes = threshold, eps, axes
        self.links: dict[int, int] = {}
        self.parent: dict[int, int] = {}
        self.forest: list[tuple[int, int]] = []

    def _root(self, x: int) -> int:
        up = self.parent
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(p, p)
        return x

    def _unite(self, a: int, b: int) -> None:
        x, y = self._root(a), self._root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.forest.append((a, b))

    def join(self, left: tuple, right: tuple, same: bool) -> None:
        """left, right: (nodes, counts, vectors) in the sequence's order."""
        turned = [x[2] / np.linalg.norm(x[2], axis=1, keepdims=True) @ self.axes for x in (left, right)]
        norms = [np.linalg.norm(x[2], axis=1) for x in (left, right)]
        found = [np.zeros(len(left[0]), np.int64), np.zeros(len(right[0]), np.int64)]

        def boxes(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return t.min(axis=0), t.max(axis=0)

        def visit(i0: int, i1: int, j0: int, j1: int) -> None:
            if same and j1 <= i0:
                return
            if _distance(*boxes(turned[0][i0:i1]), *boxes(turned[1][j0:j1])) > self.eps + SLACK:
                return
            if max(i1 - i0, j1 - j0) <= LEAF:
                self._compare(left, right, norms, found, (i0, i1, j0, j1), same)
                return
            if i1 - i0 >= j1 - j0:
                mid = (i0 + i1) // 2
                visit(i0, mid, j0, j1)
                visit(mid, i1, j0, j1)
            else:
                mid = (j0 + j1) // 2
                visit(i0, i1, j0, mid)
                visit(i0, i1, mid, j1)

        visit(0, len(left[0]), 0, len(right[0]))
        for ids, counts in zip((left[0], right[0]), found):
            for at in np.flatnonzero(counts):
                key = int(ids[at])
                self.links[key] = self.links.get(key, 0) + int(counts[at])

    def _compare(self, left, right, norms, found, part, same) -> None:
        i0, i1, j0, j1 = part
        near = left[2][i0:i1] @ right[2][j0:j1].T / (norms[0][i0:i1, None] * norms[1][None, j0:j1]) >= self.threshold
        if same:  # each pair of a block's vectors once
            near &= np.arange(i0, i1)[:, None] < np.arange(j0, j1)[None, :]
        if not near.any():
            return
        found[0][i0:i1] += near @ right[1][j0:j1]
        found[1][j0:j1] += left[1][i0:i1] @ near
        label = np.arange(i1 - i0 + j1 - j0)  # rows of the left, then of the right
        for i in np.flatnonzero(near.any(axis=1)):
            hits = np.flatnonzero(near[i]) + (i1 - i0)
            others, first = np.unique(label[hits], return_index=True)
            for other, j in zip(others, hits[first]):
                if other != label[i]:
                    label[label == other] = label[i]
                    self._unite(int(left[0][i0 + i]), int(right[0][j0 + j - (i1 - i0)]))


def _intervals(vectors: DataFrame, dim: int, axes: np.ndarray, eps: float) -> tuple[DataFrame, int]:
    """(interval, box columns lo0.. and hi0.., and the packed nodes, counts and vectors of at most CHUNK vectors), and the number of intervals."""
    lead, boxes = axes[:, :GRID_AXES], axes[:, :BOX_AXES]
    n = vectors.count()
    size = max(1, min(INTERVAL_BYTES // (8 * dim), -(-n // INTERVALS)))
    kind = np.float32 if dict(vectors.dtypes)["vec"] == "array<float>" else np.float64

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            place = x / np.linalg.norm(x, axis=1, keepdims=True) @ lead
            cells = np.floor(place / eps).astype(np.int32)
            packed = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), packed, pa.array(list(cells), pa.list_(pa.int32())), pa.array(place[:, 0])], names=["node", "n", "vec", "cell", "along"])

    placed = vectors.select("vec", "node", "n").mapInArrow(project, "node long, n long, vec binary, cell array<int>, along double")
    ordered = numbered(materialize(placed, "vectors-placed"), F.col("cell"), F.col("along"), F.col("node"))
    sides = range(boxes.shape[1])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            for at, end in zip(cuts, np.r_[cuts[1:], len(of)]):
                for low in range(at, end, CHUNK):
                    part = batch.slice(low, min(CHUNK, end - low))
                    x = _matrix(part.column(3), dim)
                    box = x / np.linalg.norm(x, axis=1, keepdims=True) @ boxes
                    payload = [part.column(k).to_numpy().astype("<i8").tobytes() for k in (1, 2)] + [b"".join(part.column(3).to_pylist())]
                    row = [int(of[low]), int(low), *box.min(axis=0).tolist(), *box.max(axis=0).tolist(), *payload]
                    types = [pa.int64(), pa.int64(), *[pa.float64()] * (2 * len(sides)), *[pa.binary()] * 3]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

    names = ["interval", "part", *[f"lo{k}" for k in sides], *[f"hi{k}" for k in sides], "nodes", "counts", "vecs"]
    schema = "interval long, part long, " + ", ".join(f"{c} double" for c in names[2:-3]) + ", nodes binary, counts binary, vecs binary"
    rows = ordered.select(F.floor(F.col("place") / size).cast("long").alias("interval"), "place", "node", "n", "vec")
    rows = rows.repartition("interval").sortWithinPartitions("interval", "place").drop("place")
    return materialize(rows.mapInArrow(pack, schema), "vectors-intervals"), -(-n // size)


def _near_intervals(intervals: DataFrame, count: int, eps: float) -> DataFrame:
    """(l, r), l <= r: intervals whose boxes are within eps, found from the root of the tree down."""
    sides = [c[2:] for c in intervals.columns if c.startswith("lo")]
    box = lambda: [*[F.min(f"lo{k}").alias(f"lo{k}") for k in sides], *[F.max(f"hi{k}").alias(f"hi{k}") for k in sides]]
    levels = [materialize(intervals.groupBy(F.col("interval").alias("id")).agg(*box()), "vectors-boxes")]
    while count > 1:
        count = -(-count // FAN)
        levels.append(levels[-1].groupBy(F.floor(F.col("id") / FAN).cast("long").alias("id")).agg(*box()))
    renamed = lambda df, x: df.select(F.col("id").alias(x), F.floor(F.col("id") / FAN).cast("long").alias(f"{x}_up"), *[F.col(c).alias(f"{x}_{c}") for c in df.columns[1:]])
    gap = lambda k: F.greatest(F.lit(0.0), F.col(f"l_lo{k}") - F.col(f"r_hi{k}"), F.col(f"r_lo{k}") - F.col(f"l_hi{k}"))
    within = sum((gap(k) * gap(k) for k in sides), F.lit(0.0)) <= (eps + SLACK) ** 2
    pairs = levels[-1].select(F.col("id").alias("l_up"), F.col("id").alias("r_up"))
    for level in reversed(levels[:-1]):
        near = pairs.join(renamed(level, "l"), "l_up").join(renamed(level, "r"), "r_up").filter(F.col("l") <= F.col("r")).filter(within)
        pairs = materialize(near.select(F.col("l").alias("l_up"), F.col("r").alias("r_up")), "vectors-pairs")
    return pairs.toDF("l", "r")


def _links(intervals: DataFrame, pairs: DataFrame, dim: int, axes: np.ndarray, threshold: float, eps: float) -> DataFrame:
    """(id, n, other): numbers of links (other null), and links of forests (n null)."""
    payload = ["part", "nodes", "counts", "vecs"]
    one = pairs.select("l", "r", F.col("l").alias("interval"), F.lit(0).alias("side"))
    two = pairs.filter("l <> r").select("l", "r", F.col("r").alias("interval"), F.lit(1).alias("side"))
    work = one.union(two).join(intervals.select("interval", *payload), "interval").select("l", "r", "side", *payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(joiner: Joiner):
            ids, ns, others = list(joiner.links), list(joiner.links.values()), [None] * len(joiner.links)
            for a, b in joiner.forest:
                ids.append(a)
                ns.append(None)
                others.append(b)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, ns, others)], names=["id", "n", "other"])

        def joined(chunks: list[tuple]) -> None:
            sides = []
            for side in (0, 1):
                parts = [c for c in chunks if c[0] == side]
                if parts:
                    vectors = np.concatenate([_unpacked(c[3], len(c[1]) // 8, dim) for c in parts])
                    sides.append((np.concatenate([np.frombuffer(c[1], "<i8") for c in parts]), np.concatenate([np.frombuffer(c[2], "<i8") for c in parts]), vectors))
            joiner.join(sides[0], sides[-1], same=len(sides) == 1)

        joiner, pair, chunks = Joiner(threshold, eps, axes), None, []
        for batch in batches:
            for at in range(batch.num_rows):
                l, r, side, _, *packed = (batch.column(k)[at].as_py() for k in range(7))
                if (l, r) != pair:
                    if chunks:
                        joined(chunks)
                    pair, chunks = (l, r), []
                    if len(joiner.parent) > 1_000_000 or len(joiner.links) > 1_000_000:
                        yield out(joiner)
                        joiner = Joiner(threshold, eps, axes)
                chunks.append((side, *packed))
        if chunks:
            joined(chunks)
        yield out(joiner)

    dealt = work.repartition("l", "r").sortWithinPartitions("l", "r", "side", "part")
    return dealt.mapInArrow(run, "id long, n long, other long")


def near_vectors(rows: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row: links to other vectors of cosine at least threshold."""
    spark, eps = rows.sparkSession, math.sqrt(2 - 2 * threshold)
    all_rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    sound = F.coalesce(F.col("vec_id").isNotNull() & (F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    good = all_rows.filter(sound)
    distinct = good.groupBy("vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    distinct = materialize(distinct.select("vec", "least", "n", F.size("vec").alias("dim"), F.monotonically_increasing_id().alias("node")), "vectors-distinct")

    found = None
    for (dim,) in distinct.select("dim").distinct().collect():
        vectors = distinct.filter(F.col("dim") == dim)
        axes = principal_axes(vectors, dim)
        intervals, count = _intervals(vectors, dim, axes, eps)
        part = _links(intervals, _near_intervals(intervals, count, eps), dim, axes, threshold, eps)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "id long, n long, other long")
    found = materialize(found, "vectors-links")
    counts = found.filter("n IS NOT NULL").groupBy(F.col("id").alias("node")).agg(F.sum("n").alias("links"))
    roots = connected_components(found.filter("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))).toDF("node", "root")
    known = distinct.join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = materialize(known.select("vec", "least", "root", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")), "vectors-known")
    component = known.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = good.join(known.join(component, "root").drop("root", "least"), "vec").select("vec_id", F.col("links").alias("n_links"), "component_id")
    alone = all_rows.filter(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op7_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
