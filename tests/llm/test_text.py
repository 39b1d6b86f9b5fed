import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowloom.llm import mixing, packing, quota, truncation
from flowloom.llm.tokens import TOKENIZER

needs_tokenizer = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary file")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 100), st.integers(0, 100)), max_size=60))
def test_pack_block(items):
    d = np.array([(t, 1, min(t, x)) for t, x in items], dtype=float).reshape(-1, 3)
    limit = np.array([100, 8, 90.0])
    bins = packing.pack_block(d, limit)
    assert sorted(i for b in bins for i in b) == list(range(len(d)))
    assert all((d[b].sum(0) <= limit + 1e-6).all() or len(b) == 1 for b in bins)


def test_packed(spark):
    items = spark.createDataFrame([(i, t, 0) for i, t in enumerate([2500, 1024, 0, 0, 300, 300, 424, 1025] + [100] * 50)], "doc_id long, tokens int, loss_tokens int")
    got = packing.packed(items, 58, block_items=20)
    r = got.collect()
    assert sum(x["tokens"] for x in r) == sum(x["tokens"] for x in items.collect())
    assert {x["doc_id"] for x in r if x["pieces"] > 1} == {0, 7}
    assert sorted((x["first_token"], x["tokens"]) for x in r if x["doc_id"] == 0) == [(0, 1024), (1024, 1024), (2048, 452)]
    per = {}
    for x in r:
        per[x["container"]] = per.get(x["container"], 0) + x["tokens"]
    assert max(per.values()) <= 1024
    assert packing.packed(items.limit(0), 0).count() == 0
    rep = packing.packing_report(got).first()
    assert rep["tokens"] == sum(per.values()) and rep["split_documents"] == 2


@needs_tokenizer
def test_measured(spark):
    df = spark.createDataFrame([(1, None, "hello world"), (2, 1, "> hello world\nyes"), (3, 1, None), (4, 1, ""), (5, 1, "word " * 3000)], "doc_id long, parent_id long, text string")
    m = {r["doc_id"]: (r["tokens"], r["loss_tokens"]) for r in packing.measured(df).collect()}
    assert m[1] == (2, 0) and m[3] == m[4] == (0, 0) and m[2][0] > m[2][1] > 0 and m[5][0] == m[5][1] >= 3000


def docs(spark, n=400):
    return spark.createDataFrame([(i, ["a", "a", "a", "b", "c"][i % 5], 10 + i % 90) for i in range(n)] + [(9999, None, 50)], "doc_id long, source string, tokens int")


def test_mixture(spark):
    t = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.2, 1), ("none", 0.1, 5)], "source string, target_weight double, max_repeats int")
    d = docs(spark)
    s, plan = mixing.mixture(d, t, block_tokens=256)
    rep = {r["source"]: r for r in mixing.mixture_report(s, plan).collect()}
    total = sum(r["tokens"] for r in d.collect())
    have = {k: sum(r["tokens"] for r in d.collect() if r["source"] == k) for k in "abc"}
    assert [rep[k]["met"] for k in ("a", "b", "c", "none")] == [have["a"] >= 0.3 * total, 3 * have["b"] >= 0.4 * total, have["c"] >= 0.2 * total, False]
    uses = {}
    for r in s.collect():
        assert r["slot"] is not None
        uses[(r["source"], r["doc_id"])] = uses.get((r["source"], r["doc_id"]), 0) + 1
    limit = {"a": 1, "b": 3, "c": 1}
    assert all(n <= limit[k[0]] for k, n in uses.items())
    assert abs(rep["b"]["scheduled_tokens"] - 0.4 * total) <= 100
    # even at every prefix
    half = {}
    top = sorted({r["slot"] for r in s.collect()})
    for r in s.collect():
        if r["slot"] <= top[len(top) // 2]:
            half[r["source"]] = half.get(r["source"], 0) + r["tokens"]
    assert abs(half["b"] / sum(half.values()) - rep["b"]["actual_share"]) < 0.08


def test_mixture_empty(spark):
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_weight double, max_repeats int")
    s, plan = mixing.mixture(docs(spark).limit(0), t)
    assert s.count() == 0 and mixing.mixture_report(s, plan).first()["scheduled_tokens"] == 0


def test_wanted_rounds_half_up():
    assert quota.wanted(0.125, 100, 0) == 13 and quota.wanted(0.01, 50, 4) == 4 and quota.wanted(0.055, 5000, 5) == 275


def test_swap_repair_two_columns():
    have = {("x", "p"): 500, ("x", "q"): 20, ("y", "p"): 30, ("y", "q"): 400, ("z", "p"): 3}
    t = [{"x": (0.5, 1), "y": (0.45, 1), "z": (0.05, 10)}, {"p": (0.5, 1), "q": (0.5, 1)}]
    take = quota.swap_repair(have, t, 200)
    assert sum(take.values()) == 200 and all(0 <= take[s] <= have[s] for s in have)
    assert take[("z", "p")] == 3
    for i, v, n in ((0, "x", 100), (0, "y", 90), (1, "p", 100)):
        assert abs(sum(k for s, k in take.items() if s[i] == v) - n) <= 8


def test_quota_sample(spark):
    data = [(i, "big" if i % 3 else "mid", "u") for i in range(900)] + [(1000 + i, "rare", "u") for i in range(5)] + [(2000, None, "u")]
    df = spark.createDataFrame(data, "node_id long, class string, n string")
    t = {"big": (0.5, 1), "mid": (0.4, 1), "rare": (0.1, 3), "absent": (0.0, 2)}
    s, rep = quota.quota_sample(df, "node_id", ["class"], [t], size=100)
    got = {r["class"]: r["count"] for r in s.groupBy("class").count().collect()}
    assert sum(got.values()) == 100 and got["rare"] == 5 and None not in got and s.distinct().count() == 100 and s.columns == df.columns
    assert {r["category"]: r["met"] for r in rep.collect()} == {"big": True, "mid": True, "rare": False, "absent": False}
    r = {x["category"]: x["drawn"] for x in rep.collect()}
    assert r["rare"] == 5 and r["absent"] == 0
    s, rep = quota.quota_sample(df.limit(0), "node_id", ["class"], [t])
    assert s.count() == 0 and not any(r["met"] for r in rep.collect() if r["wanted"])


def test_met_is_what_was_drawn(spark):
    """Floors above the shares: with a fixed size a large class falls short and is reported, without it gets its rows."""
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(300)], "node_id long, class string")
    t = {"a": (0.8, 15), "b": (0.1, 15), "c": (0.1, 15)}
    for fill, drawn in ((True, {"a": 15, "b": 15, "c": 15}), (False, {"a": 32, "b": 15, "c": 15})):
        _, rep = quota.quota_sample(df, "node_id", ["class"], [t], size=45 if fill else 40, fill=fill)
        r = {x["category"]: x for x in rep.collect()}
        assert {k: v["drawn"] for k, v in r.items()} == drawn and r["a"]["met"] == (not fill)


def test_random_start_keeps_floors_and_size():
    have, code = np.array([500, 3, 40, 7]), np.array([[0, 0], [1, 0], [0, 1], [2, 1]])
    starts = [quota.random_start(have, code, [np.array([1, 5, 2]), np.array([10, 12])], 60, seed) for seed in range(5)]
    for s in starts:
        assert s.sum() == 60 and (s <= have).all() and s[1] == 3 and s[3] >= 2 and s[0] + s[1] >= 10 and s[2] + s[3] >= 12
    assert len({tuple(s) for s in starts}) > 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.tuples(st.sampled_from("abc"), st.sampled_from("xy")), st.integers(0, 30), max_size=6), st.lists(st.integers(1, 9), min_size=5, max_size=5), st.integers(0, 60), st.booleans())
def test_no_exchange_improves(have, w, size, fill):
    t = [{v: (k / sum(w[:3]), k % 4) for v, k in zip("abc", w[:3], strict=True)}, {v: (k / sum(w[3:]), k % 3) for v, k in zip("xy", w[3:], strict=True)}]
    take = quota.swap_repair(have, t, size, fill=fill)
    assert all(0 <= take[s] <= have[s] for s in have)
    if fill:
        assert sum(take.values()) == min(size, sum(have.values()))

    def cost(q):
        total, n = 0, min(size, sum(have.values()))
        for i in (0, 1):
            for v, (share, floor) in t[i].items():
                c = sum(k for s, k in q.items() if s[i] == v)
                total += abs(c - quota.wanted(share, n, floor)) + (4 * n + 4) * max(0, floor - c)
        return total

    now = cost(take)
    for a in have:
        for b in have:
            if a != b and take[a] > 0 and take[b] < have[b]:
                assert cost(take | {a: take[a] - 1, b: take[b] + 1}) >= now


def test_many_signatures_are_quick():
    import time

    have = {(f"a{i}", f"b{j}"): 1 + (i * 31 + j * 17) % 900 for i in range(45) for j in range(45)}
    began = time.time()
    take = quota.swap_repair(have, [{f"a{i}": (1 / 45, 3) for i in range(45)}, {f"b{j}": ((j + 1) / 1035, 2) for j in range(45)}], 200_000)
    assert sum(take.values()) == 200_000 and time.time() - began < 10


def test_truncation(spark):
    names = ["router", "switch", "firewall", "sensor", "parser", "exporter"]
    whole = [f"The {a} drops packets when the {b} is busy. Nobody knows why the {a} stopped." for a in names for b in names]
    casual = [f"The {a} drops packets when the {b} is busy" for a in names for b in names if a != b]
    thanks = [f"Nobody knows why the {a} stopped. thanks" for a in names] * 2
    cut = ["The router drops packets when the fire", "Nobody knows why", "The sensor drops packets when the sen…", "The parser drops packets when th�", "The parser drops packets when the <a href=\"http", "The parser &am"]
    quote = ["> The router drops pack [...]\nNobody knows why the sensor stopped."]
    texts = whole + casual + thanks + quote + cut + [None, "", "   ", "word", "z" * 200_000]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_in int")
    got = {r["id"] for r in truncation.judged_texts(df).where("cut is not null").collect()}
    first = len(whole + casual + thanks + quote)
    assert got == set(range(first, first + len(cut)))
    rep = truncation.truncation_report(truncation.judged_texts(df)).first()
    assert rep["texts"] == len(texts) and rep["cut_texts"] == len(cut)
    assert truncation.judged_texts(df.limit(0)).count() == 0


def test_slots_give_every_block_once(spark):
    blocks = {"a": 700, "b": 1, "c": 299, "none": 0}
    r = mixing.slots(spark.createDataFrame(list(blocks.items()), "source string, blocks long"), chunk=64).orderBy("slot").collect()
    assert [x["slot"] for x in r] == list(range(1000))
    for k, n in blocks.items():
        own = [x["block"] for x in r if x["source"] == k]
        assert own == list(range(n))
    # even at every prefix: never more than a few slots from the share
    seen = 0
    for i, x in enumerate(r, 1):
        seen += x["source"] == "a"
        assert abs(seen - 0.7 * i) < 4


def test_met_is_read_off_the_schedule(spark):
    t = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.2, 1)], "source string, target_weight double, max_repeats int")
    s, plan = mixing.mixture(docs(spark), t, block_tokens=256)
    rep = {r["source"]: r for r in mixing.mixture_report(s, plan).collect()}
    longest = max(r["tokens"] for r in docs(spark).collect())
    for r in plan.collect():
        got = rep[r["source"]]["scheduled_tokens"]
        assert rep[r["source"]]["met"] == (got >= r["target_tokens"]) == (r["available"] >= r["target_tokens"])
        assert r["take"] <= got < r["take"] + longest
    # a schedule that loses a source shows in the report
    lost = {r["source"]: r["met"] for r in mixing.mixture_report(s.where("source <> 'a'"), plan).collect()}
    assert rep["a"]["met"] and not lost["a"]


def test_long_words_inside_texts(spark):
    """A word of 200,000 letters in the middle of texts, in a context in which others end: no list of its beginnings is made."""
    import time

    long = "q" * 200_000
    texts = [f"The router sends {long} packets to the firewall. It stopped." for _ in range(6)] + ["The router sends packets. Then it"] * 2 + ["The router sends qq"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    began = time.time()
    got = {r["id"]: r["cut"] for r in truncation.judged_texts(df).collect()}
    assert time.time() - began < 60 and got[8] == "word" and not any(got[i] for i in range(6))


def test_all_three_limits_bind(spark):
    def packed(items):
        d = packing.packed(items, 3000, block_items=1000)
        return d.groupBy("container").agg({"tokens": "sum", "loss_tokens": "sum", "*": "count"}).select(F.col("sum(tokens)").alias("tokens"), F.col("sum(loss_tokens)").alias("loss"), F.col("count(1)").alias("n")).collect()

    replies = packed(spark.range(3000).selectExpr("id as doc_id", "cast(150 + id % 200 as int) as tokens", "cast(if(id % 4 = 0, 0, 150 + id % 200) as int) as loss_tokens"))
    assert max(r["tokens"] for r in replies) <= 1024 and max(r["loss"] for r in replies) <= 768 and sum(r["loss"] > 700 for r in replies) > len(replies) / 4
    short = packed(spark.range(3000).selectExpr("id as doc_id", "cast(3 as int) as tokens", "cast(0 as int) as loss_tokens"))
    assert max(r["n"] for r in short) == 32 and len(short) <= 3000 // 32 + 4
