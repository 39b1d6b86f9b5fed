"""Most similar vectors for every vector: a hierarchical navigable small-world graph per shard.

Routing: a coarse k-means over a bounded sample gives about one cell per shard_rows distinct vectors. A vector is indexed
once, in its nearest cell; a cell that outgrows twice the size is dealt by hash into several shards. A query goes to its
nearest cell and to those of the next ones whose centroid is at most `margin` (in cosine) further, `probes` in all. So both
the index and the queries cross the network a bounded number of times, and work grows with the number of vectors times the
logarithmic length of a search, not with vectors x shards. probes=None visits every shard; exact=True visits every shard
and takes matrix products instead of graphs: the exact way, quadratic by nature.

A shard's graph is built in layers and kept as flat neighbour arrays (one int32 matrix a layer); it travels with its unit
vectors as one binary row. Every block of queries is searched by a beam search that advances all queries of the block in
lockstep, so the inner loop is a handful of numpy calls. The shards' results are merged by the best, a few more than k, and
the cosines of those are computed exactly. Exact copies are one vertex with a multiplicity, so a group of copies with a
third of all rows neither floods the graph nor a result list.

Defined results: null, NaN and infinite entries count as 0; a zero vector is similar (0.0) to nothing; equal cosines
are ordered by the smaller id; null vectors and vectors of another length are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.close import close_pairs
from flowloom.session import checkpointed

CLASS = ["h1", "h2"]


def _top(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, best first."""
    if ids.shape[1] > k:
        part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        ids, sims = np.take_along_axis(ids, part, 1), np.take_along_axis(sims, part, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def beam_search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query row the ef best vertices found (ids, similarities), best first; -1 where there are fewer.

    graph: vertices x degree of vertex ids, -1 for none. entry: queries x any number of start vertices.
    """
    n_q, n = len(q), len(x)
    seen = np.zeros(n_q * n, dtype=bool)
    ids = np.full((n_q, ef), -1, dtype=np.int32)
    sims = np.full((n_q, ef), -np.inf, dtype=np.float32)
    open_ = np.zeros((n_q, ef), dtype=bool)
    active = np.arange(n_q)
    new = entry.astype(np.int32)
    while True:
        at = (active[:, None] * n + new).ravel()
        fresh = new.ravel() >= 0
        fresh &= ~seen.take(at, mode="clip")
        where = np.flatnonzero(fresh)
        seen[at.take(where)] = True
        s = np.full(new.size, -np.inf, dtype=np.float32)
        left, right = x.take(new.ravel().take(where), axis=0), q.take(active.take(where // new.shape[1]), axis=0)
        s[where] = np.einsum("ij,ij->i", left, right)
        s = s.reshape(new.shape)
        cand = np.where(np.isfinite(s), new, -1)
        # duplicates within one expansion get a similarity only once, as seen[] is set for all of them together
        if new.shape[1] > 1:
            order = np.argsort(cand, axis=1, kind="stable")
            sorted_ = np.take_along_axis(cand, order, 1)
            dup = np.zeros_like(sorted_, dtype=bool)
            dup[:, 1:] = (sorted_[:, 1:] == sorted_[:, :-1]) & (sorted_[:, 1:] >= 0)
            if dup.any():
                back = np.zeros_like(dup)
                np.put_along_axis(back, order, dup, 1)
                s[back] = -np.inf
                cand[back] = -1
        all_ids = np.concatenate([ids[active], cand], 1)
        all_sims = np.concatenate([sims[active], s], 1)
        all_open = np.concatenate([open_[active], np.isfinite(s)], 1)
        part = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
        ids[active], sims[active] = np.take_along_axis(all_ids, part, 1), np.take_along_axis(all_sims, part, 1)
        open_[active] = np.take_along_axis(all_open, part, 1)
        best = np.where(open_[active], sims[active], -np.inf)
        pick = best.argmax(1)
        go = np.isfinite(best[np.arange(len(active)), pick])
        if not go.any():
            break
        active, pick = active[go], pick[go]
        open_[active, pick] = False
        new = graph[ids[active, pick]]
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Of each row's candidates (best first) the neighbours to keep: those nearer to the vertex than to any kept one."""
    n, c = ids.shape
    v = x[np.maximum(ids, 0)]
    among = np.matmul(v, v.transpose(0, 2, 1))
    kept = np.zeros((n, c), dtype=bool)
    valid = np.isfinite(sims) & (ids >= 0)
    count = np.zeros(n, dtype=int)
    for j in range(c):
        blocked = ((among[:, j, :] > sims[:, j : j + 1]) & kept).any(1)
        take = valid[:, j] & ~blocked & (count < m)
        kept[:, j] = take
        count += take
    # fill up with the best of the rest
    rank = np.where(kept, 0, np.where(valid, 1, 2)) * c + np.arange(c)
    order = np.argsort(rank, axis=1)[:, :m]
    out = np.take_along_axis(np.where(valid, ids, -1), order, 1)
    if out.shape[1] < m:
        out = np.concatenate([out, np.full((n, m - out.shape[1]), -1, dtype=out.dtype)], 1)
    return out.astype(np.int32)


def _link_back(x: np.ndarray, graph: np.ndarray, sources: np.ndarray, m: int) -> None:
    """Adds the reverse of the sources' links; a full list keeps its best and most diverse."""
    targets = graph[sources]
    rows, cols = np.nonzero(targets >= 0)
    a, b = targets[rows, cols], sources[rows]
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    uniq, start, count = np.unique(a, return_index=True, return_counts=True)
    for lo in range(0, len(uniq), 2048):
        u, st, ct = uniq[lo : lo + 2048], start[lo : lo + 2048], np.minimum(count[lo : lo + 2048], m)
        extra = np.full((len(u), ct.max()), -1, dtype=np.int32)
        for j in range(extra.shape[1]):
            has = ct > j
            extra[has, j] = b[st[has] + j]
        cand = np.concatenate([graph[u], extra], 1)
        cand.sort(axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        sims = np.matmul(x[np.maximum(cand, 0)], x[u][:, :, None])[:, :, 0]
        sims[cand < 0] = -np.inf
        ids, sims = _top(cand, sims, min(cand.shape[1], m + m // 2))
        graph[u] = _diverse(x, ids, sims, m)


def build(x: np.ndarray, m: int = 16, ef: int = 56, seed: int = 3, batch: int = 2048) -> list[np.ndarray]:
    """The layers' flat neighbour arrays, bottom first: layer l covers the first len(layer) vertices.

    Vertices are expected in random order, so a prefix is a random sample: layer l holds n / m^l of them.
    """
    n = len(x)
    sizes = [n]
    while sizes[-1] > 4 * m:
        sizes.append(max(1, sizes[-1] // m))
    layers: list[np.ndarray] = []
    for level in range(len(sizes) - 1, -1, -1):
        size, degree = sizes[level], m if level else 2 * m
        graph = np.full((size, degree), -1, dtype=np.int32)
        # the vertices of the layer above must all be linked here before searches start from them
        first = min(size, max(1024, len(layers[0]) if layers else 0))
        k = min(ef, max(1, first - 1))
        if first > 1:
            for lo in range(0, first, 512):
                s = x[lo : min(lo + 512, first)] @ x[:first].T
                s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
                ids, sims = _top(np.broadcast_to(np.arange(first, dtype=np.int32), s.shape), s, k)
                graph[lo : lo + len(s)] = _diverse(x, ids, sims, degree)
            _link_back(x, graph, np.arange(first), degree)
        done = first
        while done < size:
            hi = min(size, done + min(batch, done))
            q = x[done:hi]
            entry = descend(x, layers, q)
            ids, sims = beam_search(x[:done], graph[:done], q, entry, ef)
            among = q @ q.T
            np.fill_diagonal(among, -np.inf)
            own, own_s = _top(np.broadcast_to(np.arange(done, hi, dtype=np.int32), among.shape), among, min(8, hi - done))
            ids, sims = _top(np.concatenate([ids, own], 1), np.concatenate([sims, own_s], 1), ef)
            graph[done:hi] = _diverse(x, ids, sims, degree)
            _link_back(x, graph, np.arange(done, hi), degree)
            done = hi
        layers.insert(0, graph)
    return layers


def descend(x: np.ndarray, upper: list[np.ndarray], q: np.ndarray) -> np.ndarray:
    """Start vertices for the layer below `upper` (bottom first), from the single vertex 0 at the top."""
    entry = np.zeros((len(q), 1), dtype=np.int32)
    for graph in reversed(upper):
        ids, _ = beam_search(x[: len(graph)], graph, q, entry, 4)
        entry = ids[:, :4]
    return entry


def search(x: np.ndarray, layers: list[np.ndarray], q: np.ndarray, k: int, ef: int, batch: int = 512) -> tuple[np.ndarray, np.ndarray]:
    out_i, out_s = [], []
    for lo in range(0, len(q), batch):
        part = q[lo : lo + batch]
        ids, sims = beam_search(x, layers[0], part, descend(x, layers[1:], part), max(ef, k))
        out_i.append(ids[:, :k])
        out_s.append(sims[:, :k])
    return (np.concatenate(out_i), np.concatenate(out_s)) if out_i else (np.zeros((0, k), np.int32), np.zeros((0, k), np.float32))


def search_exactly(x: np.ndarray, q: np.ndarray, k: int, batch: int = 512) -> tuple[np.ndarray, np.ndarray]:
    out_i, out_s = [], []
    for lo in range(0, len(q), batch):
        s = q[lo : lo + batch] @ x.T
        ids, sims = _top(np.broadcast_to(np.arange(len(x), dtype=np.int32), s.shape), s, min(k, len(x)))
        out_i.append(ids)
        out_s.append(sims)
    return (np.concatenate(out_i), np.concatenate(out_s)) if out_i else (np.zeros((0, k), np.int32), np.zeros((0, k), np.float32))


def cleaned(c, size: int):
    """array<float>: null, NaN and infinite entries as 0."""
    return F.transform(c, lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(0.0)).otherwise(v).cast("float"))


GRAPH = "shard int, n long, dim int, keys1 binary, keys2 binary, vectors binary, layers array<binary>, sizes array<int>"


def graphs(dealt: DataFrame, shards: int, m: int, ef: int, exact: bool = False) -> DataFrame:
    """One row a shard: keys, unit vectors and the layers' neighbour arrays as flat bytes (no layers if exact)."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        # by hash, so that every prefix is a random sample
        pdf = pdf.sort_values(["h1", "h2"])
        x = unit(pdf["x"])
        layers = [] if exact else build(x, m, ef)
        row = (int(pdf["shard"].iloc[0]), len(x), x.shape[1], pdf["h1"].to_numpy(np.int64).tobytes(), pdf["h2"].to_numpy(np.int64).tobytes(), x.tobytes(), [g.tobytes() for g in layers], [len(g) for g in layers])
        return pd.DataFrame([row], columns=["shard", "n", "dim", "keys1", "keys2", "vectors", "layers", "sizes"])

    # one shard a task
    return dealt.repartitionById(shards, F.col("shard")).groupBy("shard").applyInPandas(make, GRAPH)


def unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(reps: DataFrame, n: int, cells: int, most: int = 200_000, rounds: int = 15, seed: int = 3) -> np.ndarray:
    """Spherical k-means on the driver over a random sample: 64 vectors a cell, 20,000 at least and `most` at most."""
    want = min(most, max(20_000, 64 * cells))
    sample = reps.select("x") if n <= want else reps.select("x").sample(min(1.0, want / n), seed)
    x = unit(sample.toPandas()["x"])
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        at = nearest_cells(x, c, 1, 0.0)[:, 0]
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        empty = np.bincount(at, minlength=len(c)) == 0
        total[empty] = x[r.choice(len(x), int(empty.sum()))]
        c = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return c


def nearest_cells(x: np.ndarray, c: np.ndarray, probes: int, margin: float, batch: int = 4096) -> np.ndarray:
    """Per row the nearest cells, nearest first; -1 for those beyond the margin."""
    k = min(probes, len(c))
    out = np.empty((len(x), k), dtype=np.int32)
    for lo in range(0, len(x), batch):
        s = x[lo : lo + batch] @ c.T
        ids, sims = _top(np.broadcast_to(np.arange(len(c), dtype=np.int32), s.shape), s, k)
        out[lo : lo + len(s)] = np.where(sims >= sims[:, :1] - margin, ids, -1)
    return out


def routed(reps: DataFrame, c: np.ndarray, probes: int, margin: float) -> DataFrame:
    """(h1, h2, x, cell, visits): the cell of every vector and the cells its query goes to."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                near = nearest_cells(unit(pdf["x"]), c, probes, margin)
                yield pdf.assign(cell=near[:, 0], visits=[v[v >= 0] for v in near])

    return reps.select(*CLASS, "x").mapInPandas(run, "h1 long, h2 long, x array<float>, cell int, visits array<int>")


def nearest_classes(
    reps: DataFrame, n: int, k: int, shard_rows: int, min_shards: int, probes: int | None = 4, margin: float = 0.15, exact: bool = False, m: int = 16, ef_build: int = 56, ef: int = 72, block_queries: int = 16_384
) -> DataFrame:
    """(h1, h2, g1, g2, sim): for each distinct vector its k best others as found; sim is the float32 estimate.

    reps: h1, h2, x, without zero vectors, n rows.
    """
    c = centroids(reps, n, max(min_shards, math.ceil(n / shard_rows))) if n else np.zeros((1, 1), np.float32)
    everywhere = exact or probes is None
    way = routed(reps, c, len(c) if everywhere else probes, math.inf if everywhere else margin)
    # one row a cell
    sizes = {r["v"]: (r["own"], r["visits"]) for r in way.select("cell", F.explode("visits").alias("v")).groupBy("v").agg(F.count_if(F.col("v") == F.col("cell")).alias("own"), F.count("*").alias("visits")).collect()}
    parts, offset = np.ones(len(c), dtype=int), np.zeros(len(c) + 1, dtype=int)
    for v, (own, _) in sizes.items():
        parts[v] = max(1, math.ceil(own / (2 * shard_rows)))
    offset[1:] = np.cumsum(parts)
    shards = int(offset[-1])
    blocks = np.ones(shards, dtype=int)
    for v, (_, visits) in sizes.items():
        blocks[offset[v] : offset[v + 1]] = max(1, math.ceil(visits / block_queries))

    def deal(batches):
        for pdf in batches:
            cell = pdf["cell"].to_numpy()
            pdf["shard"] = (offset[cell] + pdf["h2"].to_numpy(np.int64) % parts[cell]).astype("int32")
            yield pdf[["h1", "h2", "x", "shard"]]

    def send(batches):
        for pdf in batches:
            h, rows, shard = pdf["h1"].to_numpy(np.int64), [], []
            for i, vs in enumerate(pdf["visits"]):
                for v in vs:
                    own = range(offset[v], offset[v + 1])
                    rows += [i] * len(own)
                    shard += own
            at, shard = np.array(rows, dtype=int), np.array(shard, dtype=int)
            out = pdf[["h1", "h2", "x"]].iloc[at].reset_index(drop=True)
            yield out.assign(shard=shard.astype("int32"), block=(h[at] % blocks[shard]).astype("int32"))

    def copies(batches):
        for pdf in batches:
            pdf["block"] = [list(range(blocks[s])) for s in pdf["shard"]]
            yield pdf

    def run(graph: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        cols = ["h1", "h2", "g1", "g2", "sim"]
        if not len(graph) or not len(q):
            return pd.DataFrame({c: pd.Series(dtype="float32" if c == "sim" else "int64") for c in cols})
        r = graph.iloc[0]
        x = np.frombuffer(r["vectors"], np.float32).reshape(int(r["n"]), int(r["dim"]))
        layers = [np.frombuffer(b, np.int32).reshape(s, -1) for b, s in zip(r["layers"], r["sizes"], strict=True)]
        k1, k2 = np.frombuffer(r["keys1"], np.int64), np.frombuffer(r["keys2"], np.int64)
        y = unit(q["x"])
        ids, sims = search_exactly(x, y, k + 1) if exact else search(x, layers, y, k + 1, ef)
        rows, col = np.nonzero(np.isfinite(sims) & (ids >= 0))
        hit = ids[rows, col]
        h1, h2 = q["h1"].to_numpy(np.int64)[rows], q["h2"].to_numpy(np.int64)[rows]
        other = (k1[hit] != h1) | (k2[hit] != h2)
        return pd.DataFrame({"h1": h1[other], "h2": h2[other], "g1": k1[hit][other], "g2": k2[hit][other], "sim": sims[rows, col][other]})

    index = graphs(way.mapInPandas(deal, "h1 long, h2 long, x array<float>, shard int"), shards, m, ef_build, exact)
    index = index.mapInPandas(copies, GRAPH + ", block array<int>").withColumn("block", F.explode("block"))
    queries = way.mapInPandas(send, "h1 long, h2 long, x array<float>, shard int, block int")
    # few heavy groups: more partitions than groups, and a given number, which AQE does not coalesce
    groups = int(blocks.sum())
    keys = (8 if groups < 500 else 2) * groups, "shard", "block"
    found = index.repartition(*keys).groupBy("shard", "block").cogroup(queries.repartition(*keys).groupBy("shard", "block")).applyInPandas(run, "h1 long, h2 long, g1 long, g2 long, sim float")
    best = Window.partitionBy(*CLASS).orderBy(F.desc("sim"), "g1", "g2")
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def similar_pairs(df: DataFrame, key: str, vector: str, k: int = 5, min_cosine: float | None = None, size: int = 78, shard_rows: int = 25_000, min_shards: int = 4, spare: int = 3, **kw) -> DataFrame:
    """(key, neighbour, cosine): the k most similar others of every record, exact cosines, ties by the smaller id.

    With min_cosine, neighbours below it are left out; unless vectors are crowded or an option of the search is given, all
    pairs above it are found without loss (close.py). Else `spare` more candidates than k are compared exactly, as the
    search orders by float32. Further options as in nearest_classes.
    """
    pairs = close_pairs(df, key, vector, min_cosine, size) if min_cosine is not None and not kw else None
    if pairs is not None:
        return _nearest(*pairs, key, k)
    rows = df.where(F.size(vector) == size).select(F.col(key).alias("id"), cleaned(F.col(vector), size).alias("x"))
    rows = rows.withColumn("h1", F.xxhash64("x")).withColumn("h2", F.xxhash64(F.lit(7), F.col("x")))
    # of a class of copies only the k + 1 smallest ids can be among anyone's k nearest
    reps = rows.groupBy(*CLASS).agg(F.first("x").alias("x"), F.count("*").alias("n"))
    reps = checkpointed(reps.withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))).where("norm > 0"))
    n = reps.count()
    near = nearest_classes(reps.select(*CLASS, "x"), n, k + spare, shard_rows, min_shards, **kw)
    if min_cosine is not None:
        # float32 estimates are off by less than a thousandth
        near = near.where(F.col("sim") >= min_cosine - 1e-3)
    vec = reps.select(*CLASS, "x", "norm")
    other = vec.toDF("g1", "g2", "y", "norm_y")
    exact = near.join(vec, CLASS).join(other, ["g1", "g2"])
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    exact = exact.select(*CLASS, "g1", "g2", (dot / (F.col("norm") * F.col("norm_y"))).alias("cosine"))
    own = reps.where("n > 1").select(*CLASS, F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.lit(1.0).alias("cosine"))
    links = exact.unionByName(own)
    if min_cosine is not None:
        links = links.where(F.col("cosine") >= min_cosine)
    return _nearest(links, rows.select("id", *CLASS), key, k)


def _nearest(links: DataFrame, ids: DataFrame, key: str, k: int) -> DataFrame:
    """(key, neighbour, cosine): the k best others of every member (id, h1, h2), of linked classes (h1, h2, g1, g2, cosine)."""
    lowest = _lowest(ids, k + 1)
    lists = links.join(lowest.toDF("g1", "g2", "ids"), ["g1", "g2"])
    # the candidates of a class, shared by all its members
    merged = lists.select(*CLASS, F.explode("ids").alias("neighbour"), "cosine").groupBy(*CLASS).agg(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("d"), "neighbour"))).alias("c"))
    per = ids.join(merged, CLASS)
    top = F.expr(f"slice(filter(c, e -> e.neighbour <> id), 1, {k})")
    return per.select(F.col("id").alias(key), F.explode(top).alias("e")).select(key, F.col("e.neighbour").alias("neighbour"), (-F.col("e.d")).alias("cosine"))


def _lowest(ids: DataFrame, n: int) -> DataFrame:
    """The n smallest ids of each class; first per salt, so that a hot class is never collected whole."""
    w1 = Window.partitionBy(*CLASS, F.pmod("id", F.lit(64))).orderBy("id")
    first = ids.withColumn("r", F.row_number().over(w1)).where(F.col("r") <= n).drop("r")
    return first.groupBy(*CLASS).agg(F.slice(F.sort_array(F.collect_list("id")), 1, n).alias("ids"))
