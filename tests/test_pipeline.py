import json

from flowloom.plans import pipeline
from flowloom.sources.files import RunLog


def test_chain(spark, tmp_path):
    labels = ["BENIGN", "DoS Hulk", "PortScan", "Web Attack – XSS", "odd"]
    text = " Flow ID,Timestamp, Dst Port,Rate/s,Label\n" + "".join(f"f{i},7/3/2017 8:{i % 60:02d},{i % 9},{'Infinity' if i == 5 else i * 0.5},{labels[i % 5]}\n" for i in range(300))
    (tmp_path / "raw.csv").write_text(text, encoding="utf-8")
    at = lambda n: str(tmp_path / n)
    run = lambda *a: pipeline.main(list(a), spark)
    run("prepare", "--input", at("raw.csv"), "--output", at("p"), "--replication-factor", "2")
    p = spark.read.parquet(at("p"))
    assert p.count() == 600 and p.select("node_id").distinct().count() == 600 and p.where("event_time is null").count() == 0
    run("features", "--input", at("p"), "--output", at("f"), "--scale")
    f = spark.read.parquet(at("f"))
    assert f.count() == 600 and {len(r["features"]) for r in f.select("features").collect()} == {2}
    run("sample", "--input", at("f"), "--output", at("s"), "--metrics-output", at("m.json"))
    assert json.load(open(at("m.json")))["rows"] == 480
    run("temporal", "--input", at("s"), "--output", at("t"), "--bucket-seconds", "60")
    run("similarity", "--input", at("s"), "--output", at("sim"))
    run("fuse", "--input", at("t"), "--second", at("sim"), "--output", at("g"))
    run("export", "--input", at("s"), "--second", at("g"), "--output", at("x"), "--max-nodes", "100")
    n = spark.read.parquet(at("x") + "/nodes")
    top = n.agg({"node_idx": "max", "*": "count"}).first()
    assert 95 <= n.count() <= 105 and top["max(node_idx)"] == n.count() - 1
    assert spark.read.parquet(at("x") + "/edges").where(f"src_idx >= {n.count()} or dst_idx >= {n.count()}").count() == 0
    log = RunLog(at("log"), {"a": 1})
    log.log(1, {"f1": 0.5})
    assert json.loads(open(at("log") + "/metrics.jsonl").read())["f1"] == 0.5
