"""Same or near-same records across splits, as a weighted cosine join over inverted lists.

A record becomes a sparse vector of terms: its positions are dealt into blocks, and the quantised values of one block
are one term. Rare terms weigh more, w = 1 / (1 + ln df), and every train vector is brought to unit length, so its
squared weights u^2 sum to 1. A held-out record matches a term of a train vector if each of its values lies within the
tolerance of the term's cells; its projection on the train vector's terms has the cosine sqrt(sum of matched u^2). Two
records that differ in at most `max_diff` positions miss at most `max_diff` terms, so that cosine is at least
theta = sqrt(1 - the `max_diff` largest u^2). That bound prunes twice:

* maximum weight: only the heaviest terms of a train vector are indexed, as many as are needed so that the rest, of
  residual norm r, cannot reach theta alone;
* residual norm: a pair goes on only if its partial dot product over the lists plus r^2 reaches theta^2.

Pairs that are left get the exact dot product over all terms, then the exact count of differing positions. Nothing is
lost: the probing side (val, test) looks up every cell its tolerance touches. Copies have one class id, so a hot group
of copies is one list entry and is expanded at the end.

What crosses the network is little beside the vectors, which are read several times instead: terms and ids are computed
in numpy where the rows lie. Bitmaps of hashed terms (bounded in size) say on either side which terms can meet one of
the other side, so only those become rows; vectors are sent only of classes that are in a pair left by the bounds. A
bitmap only drops what cannot meet; one too full drops less. List entries and probes carry a sketch, one hashed bit of the
cell of each of the first 64 positions, and probes a mask of the positions whose tolerance stays in one cell: a bit that
differs there is a position that differs, so pairs with more than `max_diff` of them go at the join. A pair meets in
`extra` + 1 lists at least, so a probing record leaves out the `extra` blocks in which it has the most probes. df counts train rows
by the leading bits of the term (bounded, too): a larger df than the true one changes the order of the terms, not the
pairs. Weights in the lists are rounded to 1/65,536 so that the bounds stay bounds.

Defined results: null, NaN and infinite entries are one kind of value that differs from everything, also from itself;
null vectors or vectors of another length match nothing; empty input gives no rows; each record pair comes once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowloom.session import checkpointed

CLASS = ["h1", "h2"]
HELD = ["g1", "g2"]
DF_BITS = 22
PAGE_BITS = 15
UNIT = 1 << 16


def _mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def _salts(n: int, tag: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(tag << 32))


def matrix(column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a vector of the right length, and those as float64; entries that are not finite are NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ok = pc.fill_null(pc.equal(pc.list_value_length(column), size), False)
    x = column.filter(ok).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    # zero has one sign
    x += 0.0
    x[~np.isfinite(x)] = np.nan
    return ok.to_numpy(zero_copy_only=False), x


def class_ids(x: np.ndarray) -> np.ndarray:
    """Rows x 2 of int64: a 128-bit id of the values."""
    v = _mix(x.view(np.uint64) + _salts(x.shape[1], 1))
    return np.stack([v.sum(1), _mix(v + _salts(x.shape[1], 2)).sum(1)], 1).view(np.int64)


@dataclass(frozen=True)
class Terms:
    size: int
    max_diff: int
    tolerance: float
    blocks: int
    cell: float
    extra: int

    def positions(self, b: int) -> np.ndarray:
        return np.arange(b, self.size, self.blocks)

    def cells(self, x: np.ndarray, by: float) -> np.ndarray:
        """The cell of every value moved by `by`. Zero lies in the middle of its cell."""
        return np.floor((x + by) / self.cell + 0.5) + 0.0

    def hashed(self, cells: np.ndarray) -> np.ndarray:
        return _mix(cells.view(np.uint64) + _salts(self.size, 3))

    def packed(self, flags: np.ndarray) -> np.ndarray:
        """The first 64 flags of each row as one int64."""
        wide = np.zeros((len(flags), 64), dtype=np.uint8)
        wide[:, : min(64, self.size)] = flags[:, :64]
        return np.packbits(wide, axis=1, bitorder="little").view(np.int64)[:, 0]

    def sketch(self, hashed: np.ndarray) -> np.ndarray:
        return self.packed(hashed & np.uint64(1))

    def finish(self, sums: np.ndarray, b) -> np.ndarray:
        return _mix(sums + _salts(self.blocks, 4)[b])

    def finite(self, x: np.ndarray) -> np.ndarray:
        """Rows x blocks: a block with a value that is not finite has no term."""
        return np.stack([~np.isnan(x[:, self.positions(b)]).any(1) for b in range(self.blocks)], 1)

    def of(self, x: np.ndarray) -> np.ndarray:
        """Rows x blocks of uint64."""
        m = self.hashed(self.cells(x, 0.0))
        return self.finish(np.stack([m[:, self.positions(b)].sum(1) for b in range(self.blocks)], 1), np.arange(self.blocks))

    def probed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, block, term) of all terms of all blocks that the values' tolerance intervals touch; per row the sketch and its mask."""
        lo, hi = self.cells(x, -self.tolerance), self.cells(x, self.tolerance)
        fork, valid = lo != hi, self.finite(x)
        m = self.hashed(lo)
        step = self.hashed(hi) - m
        out_r, out_b, out_t = [], [], []
        for b in range(self.blocks):
            rows = np.flatnonzero(valid[:, b])
            sums = m[:, self.positions(b)].sum(1)[rows]
            for p in self.positions(b):
                at = np.flatnonzero(fork[rows, p])
                rows, sums = np.concatenate([rows, rows[at]]), np.concatenate([sums, sums[at] + step[rows[at], p]])
            out_r.append(rows)
            out_b.append(np.full(len(rows), b))
            out_t.append(self.finish(sums, b))
        return np.concatenate(out_r), np.concatenate(out_b), np.concatenate(out_t), self.sketch(m), self.packed(~fork)

    def asked(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which probes to send: not those of a row's `extra` blocks with the most of them.

        A list has max_diff + 1 + extra blocks less those not finite, so a pair still meets in one.
        """
        n = np.zeros((rows.max(initial=-1) + 1, self.blocks), dtype=int)
        np.add.at(n, (rows, at), 1)
        keep = np.ones(n.shape, dtype=bool)
        np.put_along_axis(keep, np.argsort(-n, axis=1, kind="stable")[:, : self.extra], False, 1)
        return keep[rows, at]

    def weights(self, x: np.ndarray, terms: np.ndarray, df: np.ndarray) -> np.ndarray:
        """Rows x blocks: the squared weights of unit vectors; 0 where there is no term."""
        w2 = np.where(self.finite(x), (1.0 + np.log(np.maximum(df[terms >> np.uint64(64 - DF_BITS)], 1))) ** -2.0, 0.0)
        return w2 / np.maximum(w2.sum(1, keepdims=True), 1e-300)

    def room(self, x: np.ndarray) -> np.ndarray:
        """How many positions may still differ; vectors with less than none are left out."""
        return self.max_diff - np.isnan(x).sum(1)

    def theta2(self, u2: np.ndarray, room: np.ndarray) -> np.ndarray:
        """The square of the least cosine."""
        total = np.concatenate([np.zeros((len(u2), 1)), np.cumsum(-np.sort(-u2, axis=1), axis=1)], 1)
        return 1.0 - np.take_along_axis(total, np.clip(room, 0, self.blocks)[:, None], 1)[:, 0]

    def lists(self, x: np.ndarray, df: np.ndarray) -> dict[str, np.ndarray]:
        """The entries of the pruned inverted lists: row, term, sketch, u2 rounded up and least dot product rounded down.

        That is theta^2 without the square of the residual norm and without the heaviest terms of blocks that are not asked for.
        """
        terms, room = self.of(x), self.room(x)
        u2 = self.weights(x, terms, df)
        order = np.argsort(-u2, axis=1, kind="stable")
        heavy = np.take_along_axis(u2, order, 1)
        kept = (np.arange(self.blocks) < (room + 1 + self.extra)[:, None]) & (heavy > 0) & (room >= 0)[:, None]
        rest, theta2 = 1.0 - np.where(kept, heavy, 0.0).sum(1), self.theta2(u2, room)
        rows, cols = np.nonzero(kept)
        u, least = np.ceil(heavy * UNIT).astype(np.int32), (np.floor((theta2 - rest - np.where(kept, heavy, 0.0)[:, : self.extra].sum(1)) * UNIT) - 1).astype(np.int32)
        return {"row": rows, "term": terms[rows, order[rows, cols]], "sketch": self.sketch(self.hashed(self.cells(x, 0.0)))[rows], "u": u[rows, cols], "least": least[rows]}

    def compared(self, x: np.ndarray, y: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per pair: the dot product of the unit vector with its projection on the held-out record, theta2, differing positions."""
        u2, c = self.weights(x, self.of(x), df), self.cells(x, 0.0)
        met = (c == self.cells(y, -self.tolerance)) | (c == self.cells(y, self.tolerance))
        dot = sum(np.where(met[:, self.positions(b)].all(1), u2[:, b], 0.0) for b in range(self.blocks))
        return dot, self.theta2(u2, self.room(x)), (~(np.abs(x - y) <= self.tolerance)).sum(1)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row of each class in the batch, with the ids."""
    ids = class_ids(x)
    _, at = np.unique(ids[:, 0] ^ (ids[:, 1] << 1), return_index=True) if len(ids) else (None, np.zeros(0, int))
    # equal in the short key but not in the id: all are kept
    return (x[at], ids[at]) if len(at) == len(np.unique(ids, axis=0)) else (x, ids)


def _vectors(batches, size: int):
    for batch in batches:
        x = matrix(batch.column(0), size)[1]
        if len(x):
            yield _distinct(x)


def has(bitmap: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    at = hashes.view(np.uint64) >> np.uint64(64 - bits)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _bits(n: float) -> int:
    """Leading bits for a bitmap of n hashes: about sixteen bits a hash, 128 MB at most."""
    return int(np.clip(np.round(np.log2(16.0 * max(1.0, n))), 20, 30))


def bitmap_of(hashes: DataFrame, bits: int) -> np.ndarray:
    """The bits of the leading `bits` of all hashes (one long column): each task sends its set bits by page, pages are united."""

    def pages(batches):
        found = [np.unique(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)) for b in batches if b.num_rows]
        if found:
            at = np.unique(np.concatenate(found))
            page, start = np.unique(at >> np.uint64(PAGE_BITS), return_index=True)
            parts = np.split((at & np.uint64((1 << PAGE_BITS) - 1)).astype(np.uint16), start[1:])
            for lo in range(0, len(page), 1000):
                yield _batch(page=page[lo : lo + 1000].astype(np.int32), at=[p.tobytes() for p in parts[lo : lo + 1000]])

    def united(batches):
        out: dict[int, np.ndarray] = {}
        for b in batches:
            for page, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out.setdefault(page, np.zeros(1 << PAGE_BITS, dtype=bool))[np.frombuffer(at, np.uint16)] = True
        for page, flags in out.items():
            yield _batch(page=np.array([page], np.int32), at=[np.packbits(flags, bitorder="little").tobytes()])

    bitmap = np.zeros((1 << bits) // 8, dtype=np.uint8)
    kind = "page int, at binary"
    for page, at in zip(*(c.to_pylist() for c in hashes.mapInArrow(pages, kind).repartition("page").mapInArrow(united, kind).toArrow().columns), strict=True):
        bitmap[page << (PAGE_BITS - 3) : (page + 1) << (PAGE_BITS - 3)] = np.frombuffer(at, np.uint8)
    return bitmap


def frequencies(train: DataFrame, terms: Terms) -> np.ndarray:
    """Train vectors by the leading bits of their terms."""

    def count(batches):
        n = np.zeros(1 << DF_BITS, dtype=np.int32)
        for x, _ in _vectors(batches, terms.size):
            x = x[terms.room(x) >= 0]
            n += np.bincount((terms.of(x)[terms.finite(x)] >> np.uint64(64 - DF_BITS)).astype(np.int64), minlength=len(n)).astype(np.int32)
        at = np.flatnonzero(n)
        for lo in range(0, len(at), 100_000):
            yield _batch(at=at[lo : lo + 100_000].astype(np.int32), n=n[at[lo : lo + 100_000]])

    df = np.zeros(1 << DF_BITS, dtype=np.int32)
    t = train.mapInArrow(count, "at int, n int").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    df[t["at"].to_numpy()] = t["n"].to_numpy()
    return df


def overlap_classes(
    df: DataFrame,
    key: str,
    vector: str,
    split: str,
    train: str = "train",
    held_out: tuple[str, ...] = ("val", "test"),
    size: int = 78,
    max_diff: int = 4,
    tolerance: float = 0.075,
    blocks: int = 12,
    cell: float = 0.6,
    extra: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes (h1, h2 in train; g1, g2 held out; cosine, n_diff) and the membership (key, split, h1, h2).

    The membership covers the classes of the pairs, and few besides.
    """
    if max_diff + 1 + extra > blocks:
        raise ValueError("blocks must exceed max_diff + extra")
    if cell <= 2 * tolerance:
        raise ValueError("a tolerance interval must touch at most two cells")
    terms = Terms(size, max_diff, tolerance + 1e-6, blocks, cell, extra)
    sc = df.sparkSession.sparkContext
    rows = df.select(key, split, vector).where((F.size(vector) == size) & F.col(split).isin(train, *held_out))
    left, right = (rows.where(c).select(vector) for c in (F.col(split) == train, F.col(split).isin(*held_out)))
    counted = frequencies(left, terms)
    bits = _bits(counted.sum(dtype=np.int64) * (max_diff + 1 + extra) / blocks)
    counted = sc.broadcast(counted)

    def entries(only):
        def run(batches):
            for x, ids in _vectors(batches, size):
                e = terms.lists(x, counted.value)
                if only is None:
                    yield _batch(term=e["term"].view(np.int64))
                    continue
                at = has(only.value, bits, e["term"])
                r, t, sketch, u, least = (v[at] for v in e.values())
                yield _batch(term=t.view(np.int64), h1=ids[r, 0], sketch=sketch, u=u, least=least)

        return run

    indexed = sc.broadcast(bitmap_of(left.mapInArrow(entries(None), "term long"), bits))

    def probes(batches):
        for x, ids in _vectors(batches, size):
            r, b, t, sketch, mask = terms.probed(x)
            at = has(indexed.value, bits, t)
            r, b, t = r[at], b[at], t[at]
            at = terms.asked(r, b)
            r, t = r[at], t[at]
            yield _batch(term=t.view(np.int64), g1=ids[r, 0], other=sketch[r], mask=mask[r])

    probed = right.mapInArrow(probes, "term long, g1 long, other long, mask long")
    asked = sc.broadcast(bitmap_of(probed.select("term"), bits))
    lists = left.mapInArrow(entries(asked), "term long, h1 long, sketch long, u int, least int")
    # half an id does here: classes that share it have entries of their own, and their sums and least bounds only let more pass
    met = probed.repartition("term").distinct().join(lists.repartition("term").distinct(), "term").where(F.bit_count(F.expr("(sketch ^ other) & mask")) <= max_diff)
    partial = met.groupBy("h1", "g1").agg(F.sum("u").alias("dot"), F.min("least").alias("least"))
    survivors = checkpointed(partial.where("dot >= least").select("h1", "g1"))
    indexed.destroy()
    asked.destroy()
    few = _bits(2 * survivors.count())
    wanted = sc.broadcast(bitmap_of(survivors.select(F.explode(F.array("h1", "g1")).alias("h")), few))

    def choose(batches):
        for batch in batches:
            ok, x = matrix(batch.column(2), size)
            ids = class_ids(x)
            at = has(wanted.value, few, np.ascontiguousarray(ids[:, 0]))
            if at.any():
                kept = batch.take(pa.array(np.flatnonzero(ok)[at]))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(ids[at, 0]), pa.array(ids[at, 1])], names=["key", "split", "x", *CLASS])

    kinds = [rows.schema[c].dataType.simpleString() for c in (key, split, vector)]
    chosen = rows.mapInArrow(choose, StructType.fromDDL(f"key {kinds[0]}, split {kinds[1]}, x {kinds[2]}, h1 long, h2 long"))
    chosen = checkpointed(chosen)

    def verify(batches):
        for b in batches:
            if b.num_rows:
                dot, theta2, n = terms.compared(matrix(b.column(4), size)[1], matrix(b.column(5), size)[1], counted.value)
                at = np.flatnonzero((dot >= theta2 - 1e-9) & (n <= max_diff))
                ids = b.select([*CLASS, *HELD]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(np.sqrt(dot[at])), pa.array(n[at].astype(np.int32))], names=[*ids.schema.names, "cosine", "n_diff"])

    # laid out for the joins at once, so that vectors are sent once
    first = chosen.where(F.col("split") == train).select(*CLASS, "x").repartition("h1").dropDuplicates(CLASS)
    second = chosen.where(F.col("split").isin(*held_out)).toDF("key", "split", "y", *HELD).select(*HELD, "y").repartition("g1").dropDuplicates(HELD)
    both = survivors.join(first, "h1").join(second, "g1").select(*CLASS, *HELD, "x", "y")
    pairs = both.mapInArrow(verify, "h1 long, h2 long, g1 long, g2 long, cosine double, n_diff int")
    return pairs, chosen.select(F.col("key").alias(key), F.col("split").alias(split), *CLASS)


def overlap_pairs(df: DataFrame, key: str, vector: str, split: str, **kw) -> DataFrame:
    """(train_key, other_key, other_split, cosine, n_diff): every pair of one train and one held-out record."""
    pairs, members = overlap_classes(df, key, vector, split, **kw)
    a = members.where(F.col(split) == kw.get("train", "train")).select(F.col(key).alias("train_key"), *CLASS)
    b = members.where(F.col(split).isin(*kw.get("held_out", ("val", "test")))).select(F.col(key).alias("other_key"), F.col(split).alias("other_split"), F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    return pairs.join(a, CLASS).join(b, HELD).select("train_key", "other_key", "other_split", "cosine", "n_diff")


def overlap_report(df: DataFrame, key: str, vector: str, split: str, source: str, **kw) -> DataFrame:
    """Per split and source: records, records with an overlap in train, and those within the tolerance everywhere."""
    held_out = kw.get("held_out", ("val", "test"))
    pairs, members = overlap_classes(df, key, vector, split, **kw)
    hit = pairs.groupBy(*HELD).agg(F.min("n_diff").alias("best")).withColumnsRenamed({"g1": "h1", "g2": "h2"})
    # records whose vector is null or of another length are counted, too
    all_ = df.where(F.col(split).isin(*held_out)).select(F.col(key), F.col(split), F.col(source))
    best = members.where(F.col(split).isin(*held_out)).join(hit, CLASS).select(F.col(key), "best")
    j = all_.join(best, key, "left")
    return j.groupBy(split, source).agg(F.count("*").alias("records"), F.count("best").alias("overlapping"), F.count_if(F.col("best") == 0).alias("within_tolerance"))
