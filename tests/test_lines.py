import itertools

from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowloom.operators import badrows, drift
from flowloom.sources import delimited

LINES = "line_id long, file_id long, line_no int, line_text string, label string"


def lines(spark, files):
    out, i = [], 0
    for fid, texts in files.items():
        for no, t in enumerate(texts, 1):
            i += 1
            out.append((i, fid, no, t, "clash"))
    return spark.createDataFrame(out, LINES)


def files(spark, n):
    return spark.createDataFrame([(i, 1, i) for i in range(1, n + 1)], "file_id long, feed_id long, file_seq int")


def body(name_row, n=12, f=lambda i: f"{i},{i}.5,benign"):
    return [name_row, *[f(i) for i in range(n)]]


def test_headers_and_cells(spark):
    df = lines(spark, {1: ['" Flow  Duration";"Label (x)"', '"a;""b""";1', "x;y"], 2: ["A|b", "1|2"], 3: [None, "1,2"]})
    h = delimited.headers(df)
    assert rows(h, "file_id", "delim", "width") == [(1, ";", 2), (2, "|", 2)]
    assert h.where("file_id = 1").first()["names"] == ["flow_duration", "label_x"]
    j = delimited.with_header(df.where("file_id = 1"), h).withColumn("c", F.transform(delimited.cells_of(F.col("line_text"), F.col("delim")), delimited.unquoted))
    assert sorted(map(tuple, (r["c"] for r in j.collect()))) == [('a;"b"', "1"), ("x", "y")]


def test_quoting(spark):
    cases = {'a,"b"': False, '"a,b",c': False, '"a""b",c': False, '"a,b': True, 'a"b,c': True, '"a"x,c': True, '"a" ,c': True, '"",': False, "": False, '"': True, 'x,"a,"b",c': True}
    df = spark.createDataFrame([(t, ",") for t in cases], "t string, d string")
    got = {r["t"]: r["b"] for r in df.select("t", delimited.quoting_broken(F.col("t"), F.col("d")).alias("b")).collect()}
    assert got == cases


def naive_broken(t):
    """Character by character."""
    i, n = 0, len(t)
    while True:
        if i < n and t[i] == '"':
            i += 1
            while True:
                if i >= n:
                    return True
                if t[i] == '"':
                    if i + 1 < n and t[i + 1] == '"':
                        i += 2
                        continue
                    i += 1
                    break
                i += 1
            if i < n and t[i] != ",":
                return True
        else:
            while i < n and t[i] != ",":
                if t[i] == '"':
                    return True
                i += 1
        if i >= n:
            return False
        i += 1


def test_quoting_against_scanner(spark):
    texts = ["".join(p) for k in range(0, 7) for p in itertools.product('",a', repeat=k)]
    df = spark.createDataFrame([(t, ",") for t in texts], "t string, d string")
    got = {r["t"]: r["b"] for r in df.select("t", delimited.quoting_broken(F.col("t"), F.col("d")).alias("b")).collect()}
    assert {t: naive_broken(t) for t in texts} == got


def test_changes(spark):
    df = lines(
        spark,
        {
            1: body("Idle Max,Flow Rate,Label", f=lambda i: f"{i * 10},{i}.5,benign"),
            2: body("FLOW_RATE;idle max;Class;vlan id", f=lambda i: f"{i}.5;{i * 10};DDoS;{i % 3}"),  # rename, order, delimiter, addition
            3: body("flow rate,rest_max,class", f=lambda i: f"{i}.5 us,{i * 10},bot"),  # rename, removal, type
        },
    )
    got = rows(drift.schema_changes(df, files(spark, 3)))
    assert got == sorted(
        [(2, "added", "", "vlan_id"), (2, "renamed", "label", "class"), (3, "renamed", "idle_max", "rest_max"), (3, "removed", "vlan_id", ""), (3, "retyped", "flow_rate", "flow_rate")],
        key=str,
    )


def test_changes_without_values_or_files(spark):
    df = lines(spark, {1: ["a,b"], 2: ["a,b", "1,x"], 3: ["", ""], 4: [None]})
    assert "retyped" not in {r[1] for r in rows(drift.schema_changes(df, files(spark, 4)))}
    assert drift.schema_changes(df.limit(0), files(spark, 4)).count() == 0
    assert drift.schema_changes(df, files(spark, 4).where("file_id > 9")).count() == 0


def test_unified(spark):
    df = lines(spark, {1: body("Idle Max,Flow Rate,Label", f=lambda i: f"{i * 10},{i}.5,benign"), 2: body("idle max,flow rate,class", f=lambda i: f"{i * 10},{i}.5,bot")})
    f = files(spark, 2)
    u = drift.unified_lines(df, f, drift.schema_changes(df, f))
    assert u.count() == 24 and {tuple(sorted(r["flow"])) for r in u.collect()} in ({("class", "flow_rate", "idle_max")}, {("flow_rate", "idle_max", "label")})


def test_unified_over_feeds(spark):
    when = lambda i: f"2025-03-05 06:07:{i:02d}"
    df = lines(
        spark,
        {
            1: body("Seen,Idle Max,Flow Rate,Label", f=lambda i: f"{when(i)},{i * 10},{i}.5,benign"),
            2: body("seen,rest_max,flow rate,class", f=lambda i: f"{when(i)},{i * 10} us,{i}.5,DoS Hulk"),  # retyped
            3: body("When;idle max;flow_rate;Class", f=lambda i: f"{when(i)};{i * 10};{i};1"),  # another feed, label by id
            4: body("flow_rte,target", f=lambda i: f"{i}.5,{i * 1000}"),  # a variant that no feed renames; its target is no label
        },
    )
    f = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 2, 1), (4, 3, 1)], "file_id long, feed_id long, file_seq int")
    u = drift.unified_table(df, f)
    assert {c.name: c.dataType.simpleString() for c in u.schema["flow"].dataType} == {"label": "string", "timestamp": "string", "flow_rate": "double", "idle_max": "bigint", "target": "bigint"}
    got = {(r["file_id"], r["flow"]["flow_rate"]): (r["flow"]["label"], r["flow"]["timestamp"], r["flow"]["idle_max"], r["flow"]["target"], r["rest"]) for r in u.collect()}
    assert u.count() == 48 and len(got) == 48
    assert got[1, 3.5] == ("benign", when(3), 30, None, {}) and got[2, 3.5] == ("dos_hulk", when(3), 30, None, {})
    assert got[3, 3.0] == ("ddos", when(3), 30, None, {}) and got[4, 3.5] == (None, None, None, 3000, {})


def test_name_that_comes_back_beside_its_rename():
    v = [{"name": n, "files": k, "n": 20 * k, "n_num": 20 * k, "n_time": 0, "n_class": 0, "n_id": 0, "mean": 3.0, "sd": 1.0, "zero": 0.0} for n, k in (("proto", 30), ("f_proto", 16), ("fwd_max", 40), ("bwd_max", 40))]
    both = {("f_proto", "proto"): 6, ("bwd_max", "fwd_max"): 38}
    got = drift.canonical_names(v, [("proto", "f_proto", 1), ("fwd_max", "bwd_max", 1)], both)
    assert got == {"proto": "proto", "f_proto": "proto", "fwd_max": "fwd_max", "bwd_max": "bwd_max"}


def test_numbers_of_retyped_cells(spark):
    cases = {"12": 12.0, "-1.5": -1.5, "0x10a8": 4264.0, "n32": 32.0, "9.2k": 9200.0, "593 us": 593.0, "10x": None, "1f": None, "": None, "Idle Max": None}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r["t"]: r["v"] for r in df.select("t", drift.number_of(F.col("t")).alias("v")).collect()} == cases


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=3, max_size=3), min_size=1, max_size=4))
def test_matching_is_maximal(w):
    weight = [[x / 10 for x in r] for r in w]
    n, m = len(weight), 3
    best = max(sum(weight[i][p[i]] for i in range(n) if p[i] < m) for p in itertools.permutations(range(max(n, m)), n))
    assert abs(sum(weight[i][j] for i, j in drift.best_matching(weight)) - best) < 1e-9


def test_line_errors(spark):
    texts = body("a,b,Label", 20) + ["1,2", '1,"2.0,benign', "x,1.0,benign", "1,1.0,nonsense", "1,1.0, DoS Hulk ", ",,", "7,1.5,3", "7,1.5,99", "a,b,Label", None, "", "1,2.0,benign" + "z" * 100_000 + '"']
    df = lines(spark, {1: texts})
    got = {r["line_id"]: r["reason"] for r in badrows.line_errors(df).collect()}
    assert got == {22: "column_count", 23: "quoting", 24: "bad_value", 25: "bad_value", 29: "bad_value", 30: "bad_value", 32: "column_count", 33: "quoting"}
    clean = badrows.clean_lines(df, badrows.line_errors(df))
    assert clean.count() == 20 + 3
    assert badrows.line_errors(df.limit(0)).count() == 0


def test_vector_errors(spark):
    v = lambda *x: "[" + ",".join(x) + "]"
    cases = {
        1: v("1.0", " -2", "NaN"), 2: v("1", "null", "-Infinity"), 3: ' {"type":1,"values":[1,2,3]}', 4: "[1,2", 5: "1,2,3]", 6: '[1,"2",3]', 7: "[1,2]", 8: "[]",
        9: v("1", "--2", "3"), 10: v("1", "", "3"), 11: v("1", "1e", "3"), 12: v("1", "1e5", ".5"), 13: '{"type":1,"values":[1,2,3}', 14: None, 15: "", 16: v("1", "2", "9" * 50_000),
    }
    df = spark.createDataFrame([(k, t, "x") for k, t in cases.items()] + [(4, "[1,2", "again")], "node_id long, features string, reason string")
    got = {r["node_id"]: r["reason"] for r in badrows.vector_errors(df, "node_id", "features", 3).collect()}
    assert got == {4: "quoting", 5: "quoting", 6: "quoting", 7: "column_count", 8: "column_count", 9: "bad_value", 10: "bad_value", 11: "bad_value", 13: "quoting", 15: "quoting"}
    ok = badrows.parsed_vectors(df, "node_id", "features", 3)
    assert sorted(r["node_id"] for r in ok.collect()) == [1, 2, 3, 12, 16]
    assert badrows.vector_errors(df.limit(0), "node_id", "features", 3).count() == 0


def test_damaged_repeat_of_a_node(spark):
    df = spark.createDataFrame([(1, "[1,2"), (1, "[1,2,3]"), (1, None), (2, "[1,2,x]"), (2, "[1,2]")], "node_id long, features string")
    assert [(r["node_id"], r["vector"]) for r in badrows.parsed_vectors(df, "node_id", "features", 3).collect()] == [(1, [1.0, 2.0, 3.0])]


def test_text_field_renamed_to_another_name(spark):
    """The same texts under a name that is nothing like the old one are a rename; other texts are not."""
    protocols = ["tcp", "udp", "icmp", "gre", "esp"]
    lines = []
    for f, (name, values) in enumerate([("proto", protocols), ("zzz", protocols), ("qqq", ["alpha", "beta", "gamma", "delta", "omega"])], 1):
        lines += [(100 * f, f, 1, f"dur,{name}")] + [(100 * f + i, f, i + 1, f"{i * 7},{values[i % 5]}") for i in range(1, 30)]
    raw = spark.createDataFrame(lines, "line_id long, file_id long, line_no int, line_text string")
    files = spark.createDataFrame([(1, 7, 1), (2, 7, 2), (3, 7, 3)], "file_id long, feed_id long, file_seq int")
    got = {tuple(r) for r in drift.schema_changes(raw, files).collect()}
    assert got == {(2, "renamed", "proto", "zzz"), (3, "removed", "zzz", ""), (3, "added", "", "qqq")}


def test_repeated_header_names(spark):
    """A header that holds a name twice and the name its repeat would get: every cell keeps a key of its own."""
    lines = [(10, 1, 1, "a,a,a_1,Label"), (11, 1, 2, "1,2,3,benign"), (12, 1, 3, "4,5,6,bot")]
    raw = spark.createDataFrame(lines, "line_id long, file_id long, line_no int, line_text string")
    files = spark.createDataFrame([(1, 7, 1)], "file_id long, feed_id long, file_seq int")
    got = {r["line_id"]: r["flow"].asDict() for r in drift.unified_table(raw, files).collect()}
    assert sorted(v for k, v in got[11].items() if k != "label") == [1, 2, 3] and got[12]["label"] == "bot"
