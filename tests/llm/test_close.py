import numpy as np
import pytest

from flowloom.llm import close, hnsw


def planted(n, seed, least=0.97):
    """Vectors in loose clusters, a third of them partners of others at cosines around `least`."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(6, 78))[r.integers(6, size=n)] * 0.4 + r.normal(size=(n, 78))
    m = n // 3
    noise = r.normal(size=(m, 78))
    noise -= x[:m] * ((noise * x[:m]).sum(1) / (x[:m] ** 2).sum(1))[:, None]
    c = least + r.uniform(-0.004, 0.004, m) * r.choice([1, 0.01], m)
    x[m : 2 * m] = c[:, None] * x[:m] + np.sqrt(1 - c**2)[:, None] * noise * (np.linalg.norm(x[:m], axis=1) / np.linalg.norm(noise, axis=1))[:, None]
    return x[r.permutation(n)].astype(np.float32)


def pairs_of(x, least):
    x = x.astype(float)
    n = np.linalg.norm(x, axis=1)
    a, b = np.nonzero(np.triu((x @ x.T / (n[:, None] * n[None, :])).round(9) >= least, 1))
    return set(zip(a.tolist(), b.tolist(), strict=True))


@pytest.mark.parametrize("least", [0.97, 0.9])
def test_no_pair_is_lost_by_sketches_planes_and_leaves(least):
    x = planted(3000, 1, least)
    want = pairs_of(x, least)
    r = close.radius(least)
    z = close.sketch(close.unit(x), close.axes_of(close.unit(x[:200]), 24))
    i, j = close.Close(z, r, leaf=20).within()
    got = set(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist(), strict=True))
    assert len(got) == len(i) and want <= got and len(got) < (1010 if least == 0.97 else 20_000)
    # a part visits the other
    i, j = close.Close(z[:1000], r, leaf=20).visited(z[1000:])
    assert {(b, a + 1000) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == {p for p in got if p[0] < 1000 <= p[1]}
    # an axis that gets several planes
    thin = np.repeat(np.linspace(0, 1, 2000, dtype=np.float32)[:, None], 2, 1) * np.array([1, 0.001], np.float32)
    i, j = close.Close(thin, 0.0101, leaf=8).within()
    assert len(i) == sum(int((np.abs(thin[k + 1 :, 0] - thin[k, 0]) <= 0.0101).sum()) for k in range(2000))


def test_every_pair_above_the_cosine_over_cells(spark):
    x = planted(2400, 2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, features array<float>")
    links, members = close.close_pairs(df, "node_id", "features", 0.97, sample=300, cell_rows=150)
    ids = {(r["h1"], r["h2"]): r["id"] for r in members.collect()}
    got = [(ids[r["h1"], r["h2"]], ids[r["g1"], r["g2"]]) for r in links.collect()]
    want = pairs_of(x, 0.97)
    assert len(want) > 300 and sorted(got) == sorted([*want, *((b, a) for a, b in want)])


def test_equal_cosines_of_multiples_are_ordered_by_id(spark):
    """To nine decimals, as in the SQL: copies are no nearer than multiples with a smaller id."""
    x = np.random.default_rng(3).normal(size=78).round(2)
    rows = [(100, x), (60, x), (70, x), (50, x * 3), (40, x * 7), (30, x * 1.1)]
    rows += [(200 + i, v) for i, v in enumerate(planted(40, 4))]
    df = spark.createDataFrame([(i, [float(e) for e in v]) for i, v in rows], "node_id long, features array<float>")
    got = {}
    for r in hnsw.similar_pairs(df, "node_id", "features", 2, 0.97).collect():
        got.setdefault(r["node_id"], set()).add(r["neighbour"])
    assert got[100] == got[60] == got[70] == got[50] == {30, 40} and got[30] == {40, 50}


def test_crowded_vectors_go_to_the_graphs(spark):
    r = np.random.default_rng(5)
    x = (r.normal(size=78) + r.normal(scale=0.05, size=(300, 78))).round(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, features array<float>")
    assert close.close_pairs(df, "node_id", "features", 0.97) is None
    assert hnsw.similar_pairs(df, "node_id", "features", 5, 0.97).count() == 1500
    assert close.close_pairs(df.limit(0), "node_id", "features", 0.97)[0].count() == 0
