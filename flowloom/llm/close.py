"""All pairs of vectors above a cosine, without loss: a distance join in the leading axes of the vectors' own spread.

Unit vectors of cosine c are sqrt(2 - 2c) apart, and no projection on orthonormal axes takes them further apart. So a
vector is cut down to its sketch: its coordinates on the `axes` directions in which a sample spreads most, and the norm of
the rest as one more. The sample chooses axes and cells only; whatever it holds, no pair within the radius is lost.

Cells are the leaves of a tree of median planes. A sketch is indexed in its own cell and sent to the other cells whose box
is within the radius, of two cells one way only, so a pair meets once. In a cell the indexed sketches get a finer tree of the same kind; every leaf is
compared with the sketches that the planes leave within the radius of it, by a matrix product over the first axes, and what is left by all
axes. Survivors get the exact cosine.

Work is quadratic where vectors have no structure: among isotropic vectors planes leave out little within the radius, and
a fixed share of the pairs of sketches is compared, at a few nanoseconds or less each.

The vectors stay where they are: sketches cross the network in blocks (some 60 bytes a vector and cell), and in a second
reading only the vectors of classes that are in a pair. Exact copies are one class before anything is compared; copies
always have the same cell, which sees their number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowloom.llm.overlap import _batch, _bits, bitmap_of, class_ids, has, matrix
from flowloom.session import checkpointed

CLASS = ["h1", "h2"]
#: Sketches are sent as float16, which is off by 2^-11 of the unit norm at each end.
SLACK = 0.0012


def radius(min_cosine: float) -> float:
    return math.sqrt(max(0.0, 2.0 - 2.0 * (min_cosine - 1e-9))) + SLACK


def cleaned(column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a vector of the right length that is not zero, and those as float64; other than finite entries are 0."""
    ok, x = matrix(column, size)
    x[np.isnan(x)] = 0.0
    some = x.any(1)
    at = np.flatnonzero(ok)[some]
    return at, x[some]


def unit(x: np.ndarray) -> np.ndarray:
    # by the largest entry first, so that no square overflows or vanishes
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]).astype(np.float32)


def axes_of(x: np.ndarray, axes: int) -> np.ndarray:
    """Orthonormal columns, widest first."""
    y = x - x.mean(0)
    return np.ascontiguousarray(np.linalg.eigh((y.T @ y).astype(np.float64))[1][:, ::-1][:, :axes].astype(np.float32))


def sketch(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    z = x @ basis
    rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", z, z)))
    return np.concatenate([z, rest[:, None]], 1).astype(np.float16)


class Planes:
    """A tree of median planes over the rows of z: planes[i] = (axis, value), children 2i + 1 and 2i + 2, `depth` levels."""

    def __init__(self, z: np.ndarray, depth: int, most: int = 4096):
        self.depth = depth
        self.axis, self.value = np.zeros((1 << depth) - 1, dtype=int), np.zeros((1 << depth) - 1, dtype=np.float32)
        leaves: list[np.ndarray] = []
        self._split(z, np.arange(len(z)), 0, 0, most, leaves)
        self.order = np.concatenate(leaves)
        self.start = np.append(0, np.cumsum([len(v) for v in leaves]))

    def _split(self, z, rows, node, level, most, leaves) -> None:
        if level == self.depth:
            leaves.append(rows)
            return
        a, at = 0, 0.0
        if len(rows):
            a = int(z[rows[:: max(1, len(rows) // most)]].std(0).argmax())
            at = np.partition(z[rows, a], len(rows) // 2)[len(rows) // 2]
        self.axis[node], self.value[node] = a, at
        right = z[rows, a] >= at
        self._split(z, rows[~right], 2 * node + 1, level + 1, most, leaves)
        self._split(z, rows[right], 2 * node + 2, level + 1, most, leaves)

    def leaf(self, z: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node = np.zeros(len(z), dtype=int)
        for _ in range(self.depth):
            node = 2 * node + 1 + (z[np.arange(len(z)), self.axis[node]] >= self.value[node])
        return node - ((1 << self.depth) - 1)

    def near(self, z: np.ndarray, r: float, until: np.ndarray):
        """(leaf, rows of z within r of its box), leaf by leaf. until: the last leaf in which each row is wanted."""
        box = np.array([[-np.inf, np.inf]] * z.shape[1], dtype=np.float32)
        yield from self._near(np.ascontiguousarray(z.T), np.float32(r * r), 0, 0, np.arange(len(z)), np.zeros(len(z), np.float32), box, until)

    def _near(self, columns, r2, node, level, rows, gone, box, until):
        if not len(rows):
            return
        if level == self.depth:
            yield node - ((1 << level) - 1), rows
            return
        a, at = self.axis[node], self.value[node]
        v = columns[a].take(rows)
        # the square of the way to the box so far, without this axis, and the way along it
        was = np.maximum(np.maximum(box[a, 0] - v, v - box[a, 1]), 0)
        gone = gone - was * was
        for side in (0, 1):
            child = 2 * node + 1 + side
            way = np.maximum(v - at if side == 0 else at - v, was)
            total = gone + way * way
            leaf = (child - ((2 << level) - 1)) << (self.depth - level - 1)
            keep = np.flatnonzero((total <= r2) & (until.take(rows) >= leaf)) if leaf else np.flatnonzero(total <= r2)
            inner = box.copy()
            inner[a, 1 - side] = at
            yield from self._near(columns, r2, child, level + 1, rows.take(keep), total.take(keep), inner, until)


class Close:
    """Rows within r of those of home; home is indexed once, all sketches are float16 or float32."""

    def __init__(self, home: np.ndarray, r: float, leaf: int = 256, first: int = 18):
        self.r, self.first = r, first
        home = home.astype(np.float32)
        self.tree = Planes(home, max(0, round(math.log2(max(1, len(home)) / leaf))))
        self.home = home[self.tree.order]
        # dot products of these are (r^2 - distance^2) / 2 over the first axes
        half = self._half(self.home)
        self.right = np.ascontiguousarray(np.concatenate([self.home[:, :first], np.ones_like(half), -half], 1))

    def _half(self, z: np.ndarray) -> np.ndarray:
        z = z[:, : self.first]
        return (np.einsum("ij,ij->i", z, z) / 2)[:, None]

    def within(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of home rows, each once."""
        start = self.tree.start
        # the leaves up to its own
        i, j = self._search(self.home, np.repeat(np.arange(len(start) - 1), np.diff(start)))
        return self.tree.order[i[i > j]], self.tree.order[j[i > j]]

    def visited(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a row of z and one of home."""
        i, j = self._search(z.astype(np.float32), np.full(len(z), len(self.tree.start)))
        return i, self.tree.order[j]

    def _search(self, z: np.ndarray, until: np.ndarray, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        half = self._half(z)
        left = np.ascontiguousarray(np.concatenate([z[:, : self.first], np.float32(self.r**2 / 2) - half, np.ones_like(half)], 1))
        start, found = self.tree.start, [np.zeros((2, 0), int)]
        for at, rows in self.tree.near(z, self.r, until):
            lo, hi = start[at], start[at + 1]
            for k in range(0, len(rows) if hi > lo else 0, block):
                part = rows[k : k + block]
                i, j = np.divmod(np.flatnonzero(left.take(part, axis=0) @ self.right[lo:hi].T >= 0), hi - lo)
                i, j = part[i], j + lo
                d = z.take(i, axis=0) - self.home.take(j, axis=0)
                ok = np.einsum("ij,ij->i", d, d) <= self.r**2
                found.append(np.stack([i[ok], j[ok]]))
        i, j = np.concatenate(found, 1)
        return i, j


def crowd(z: np.ndarray, r: float, n: int) -> float:
    """From the sketches of a sample: about how many others of n vectors a sketch has within r."""
    z = np.unique(z, axis=0)
    return 2.0 * len(Close(z, r).within()[0]) / max(1, len(z)) * (n / max(1, len(z)))


def close_pairs(df: DataFrame, key: str, vector: str, min_cosine: float, size: int = 78, axes: int = 24, sample: int = 8192, cell_rows: int = 320_000, most: float = 24.0) -> tuple[DataFrame, DataFrame] | None:
    """Pairs of classes (h1, h2, g1, g2, cosine), both ways and of a class with its own copies, and the membership (id, h1, h2) of these classes.

    Cosines are exact, to nine decimals. None if the vectors are crowded: with more than about `most` pairs a vector the
    pairs are not the way to the nearest ones.
    """
    sc = df.sparkSession.sparkContext
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("x"))
    n, r = rows.count(), radius(min_cosine)
    some = rows.select("x") if n <= sample else rows.select("x").sample(min(1.0, 1.2 * sample / n), 3)
    x = unit(cleaned(some.toArrow().column("x"), size)[1])
    if not len(x):
        x = np.eye(1, size, dtype=np.float32)
    basis = axes_of(x, min(axes, size))
    z = sketch(x, basis)
    if crowd(z, r, n) > most:
        return None
    # fewer cells, fewer copies of sketches; eight at least, to share the work
    cells = Planes(z.astype(np.float32), 0 if n <= sample else max(3, math.ceil(math.log2(n / cell_rows))))
    count, width = 1 << cells.depth, z.shape[1]
    shared = sc.broadcast((basis, cells))

    def send(batches):
        for batch in batches:
            x = cleaned(batch.column(0), size)[1]
            if not len(x):
                continue
            basis, cells = shared.value
            h, at, n = np.unique(class_ids(x)[:, 0], return_index=True, return_counts=True)
            z = sketch(unit(x[at]), basis)
            wide = z.astype(np.float32)
            own = cells.leaf(wide)
            out = []
            for cell, near in cells.near(wide, r, np.full(len(z), count)):
                # of two cells one is visited, half of the others by each
                ahead = (own[near] - cell) % count
                for home, rows in ((True, near[ahead == 0]), (False, near[(ahead > 0) & ((2 * ahead < count) | ((2 * ahead == count) & (own[near] < cell)))])):
                    if len(rows):
                        out.append((cell, home, h[rows].tobytes(), z[rows].tobytes(), n[rows].tobytes() if home else b""))
            cell, home, h, z, n = zip(*out, strict=True)
            yield _batch(cell=np.array(cell, np.int32), home=np.array(home), h=list(h), z=list(z), n=list(n))

    def pairs(batches):
        blobs: dict[tuple[int, bool], list] = {}
        for b in batches:
            for cell, home, *parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                blobs.setdefault((cell, home), []).append(parts)
        for cell in {c for c, _ in blobs}:
            joined = {}
            for home in (True, False):
                parts = blobs.pop((cell, home), [])
                h = np.frombuffer(b"".join(p[0] for p in parts), np.int64)
                z = np.frombuffer(b"".join(p[1] for p in parts), np.float16).reshape(len(h), width)
                kept, at, of = np.unique(h, return_index=True, return_inverse=True)
                joined[home] = kept, z[at]
                if home:
                    times = np.bincount(of, np.frombuffer(b"".join(p[2] for p in parts), np.int64), len(kept))
            (h, z), (g, y) = joined[True], joined[False]
            if not len(h):
                continue
            # a class with copies is a pair with itself
            yield _batch(h1=h[times > 1], g1=h[times > 1])
            index = Close(z, r)
            i, j = index.within()
            yield _batch(h1=h[i], g1=h[j])
            for lo in range(0, len(g), 250_000):
                i, j = index.visited(y[lo : lo + 250_000])
                yield _batch(h1=g[lo + i], g1=h[j])

    sent = rows.select("x").mapInArrow(send, "cell int, home boolean, h binary, z binary, n binary")
    # one cell a task
    met = checkpointed(sent.repartitionById(count, F.col("cell")).mapInArrow(pairs, "h1 long, g1 long"))
    bits = _bits(2 * met.count())
    wanted = sc.broadcast(bitmap_of(met.select(F.explode(F.array("h1", "g1")).alias("h")), bits))

    def choose(batches):
        for batch in batches:
            at, x = cleaned(batch.column(1), size)
            ids = class_ids(x)
            keep = has(wanted.value, bits, np.ascontiguousarray(ids[:, 0]))
            if keep.any():
                at, ids = at[keep], ids[keep]
                kept = batch.take(pa.array(at))
                # one vector of a class in the batch will do
                again = np.ones(len(ids), dtype=bool)
                again[np.unique(ids, axis=0, return_index=True)[1]] = False
                once = kept.column(1).take(pa.array(np.arange(len(ids)), mask=again))
                yield pa.RecordBatch.from_arrays([kept.column(0), once, pa.array(ids[:, 0]), pa.array(ids[:, 1])], names=["id", "x", *CLASS])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "x")]
    chosen = checkpointed(rows.mapInArrow(choose, StructType.fromDDL(f"id {kinds[0]}, x {kinds[1]}, h1 long, h2 long")))

    def verify(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.nan_to_num(matrix(b.column(c), size)[1], copy=False) for c in (4, 5))
                dot, xx, yy = (np.einsum("ij,ij->i", p, q) for p, q in ((x, y), (x, x), (y, y)))
                cosine = np.round(np.minimum(dot / (np.sqrt(xx) * np.sqrt(yy)), 1.0), 9)
                at = np.flatnonzero(cosine >= min_cosine)
                ids = b.select(["h1", "h2", "g1", "g2"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(cosine[at])], names=[*ids.schema.names, "cosine"])

    one = chosen.where("x is not null").select(*CLASS, "x").repartition("h1").dropDuplicates(CLASS)
    both = met.where("h1 <> g1").join(one, "h1").join(one.toDF("g1", "g2", "y"), "g1").select("h1", "h2", "g1", "g2", "x", "y")
    exact = both.mapInArrow(verify, "h1 long, h2 long, g1 long, g2 long, cosine double")
    exact = exact.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("turned"))
    turn = [F.when(F.col("turned"), F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("h1", "g1"), ("h2", "g2"), ("g1", "h1"), ("g2", "h2"))]
    members = chosen.select("id", *CLASS)
    own = members.groupBy(*CLASS).count().where("count > 1").select(*CLASS, F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.lit(1.0).alias("cosine"))
    return exact.select(*turn, "cosine").unionByName(own), members
