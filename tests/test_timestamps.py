from datetime import UTC, datetime

import __spark_entry__ as entry
from flowloom.operators.timestamps import normalise_timestamps

CAT = [("ny", "America/New_York", "mdy"), ("be", "Europe/Berlin", "dmy"), ("free", "UTC", None)]


def us(*a, micro=0):
    return int(datetime(*a, tzinfo=UTC).timestamp()) * 1_000_000 + micro


def norm(spark, values):
    df = spark.createDataFrame([(i, t, s, "kept") for i, (t, s) in enumerate(values)], "id long, ts string, src string, prior string")
    cat = spark.createDataFrame(CAT, "sensor string, tz_name string, date_order string")
    out = normalise_timestamps(df, "ts", "src", cat).orderBy("id").collect()
    return [(r["instant_us"], r["instant_status"]) for r in out]


def test_spellings(spark):
    cases = [
        ("2025-03-05T06:07:08.123456789Z", "ny", us(2025, 3, 5, 6, 7, 8, micro=123456)),
        (" 2025-03-05 06:07:08.5+0530  ", None, us(2025, 3, 5, 0, 37, 8, micro=500000)),
        ("2025-03-05 06:07:08-05:00[America/New_York]", None, us(2025, 3, 5, 11, 7, 8)),
        ("2025-03-05 06:07:08 Asia/Kolkata", "ny", us(2025, 3, 5, 0, 37, 8)),
        ("20250305T060708Z", None, us(2025, 3, 5, 6, 7, 8)),
        ("1741154828", None, us(2025, 3, 5, 6, 7, 8)),
        ("1741154828123", None, us(2025, 3, 5, 6, 7, 8, micro=123000)),
        ("1741154828123456", None, us(2025, 3, 5, 6, 7, 8, micro=123456)),
        ("Wed, 05 Mar 2025 06:07:08 -0330", None, us(2025, 3, 5, 9, 37, 8)),
        ("05-Mar-2025 06:07:08 CEST", "ny", us(2025, 3, 5, 4, 7, 8)),
        ("5 Mar 2025, 06:07", "be", us(2025, 3, 5, 5, 7)),
        ("3/5/2025 1:07:08 PM", "ny", us(2025, 3, 5, 18, 7, 8)),
        ("3/5/2025 12:07:08 AM", "ny", us(2025, 3, 5, 5, 7, 8)),
        ("05/03/2025 06:07", "be", us(2025, 3, 5, 5, 7)),
    ]
    assert [x[0] for x in norm(spark, [c[:2] for c in cases])] == [c[2] for c in cases]


def test_daylight_saving(spark):
    got = norm(spark, [("2025-11-02 01:30:00", "ny"), ("2025-03-09 02:30:00", "ny"), ("2025-10-26 02:30:00", "be")])
    assert [g[0] for g in got] == [us(2025, 11, 2, 5, 30), us(2025, 3, 9, 7, 30), us(2025, 10, 26, 0, 30)]


def test_no_instant(spark):
    bad = [None, "", "n/a", "2025-02-30 10:00:00", "31/06/2025 25:10", "2025-07-", "tomorrow 10:00", "1970", "2025-13-05T08:15:00Z", "x" * 100_000]
    assert all(g == (None, "none") for g in norm(spark, [(b, "be") for b in bad]))
    assert norm(spark, [("2025-03-05 06:07:08", None)]) == [(None, "no_zone")]
    # an unknown zone is no zone
    assert norm(spark, [("2025-03-05 06:07:08 Mars/Base", "ny")])[0][0] is None


def test_em_decides_by_the_source(spark):
    # many dates that only exist day first: the open ones of the source follow
    values = [(f"{d}/3/2025 10:00", "free") for d in range(13, 29)] * 4 + [("4/3/2025 10:00", "free")]
    assert norm(spark, values)[-1] == (us(2025, 3, 4, 10), "ok")
    assert norm(spark, [("4/3/2025 10:00", "free")]) == [(None, "ambiguous")]


def test_catalogue_is_a_prior(spark):
    # a day-first text of a month-first source is given up, not turned round; what nine tenths of a source say outweighs its entry
    assert norm(spark, [("25/03/2025 10:00", "ny")] * 3 + [("3/5/2025 10:00", "ny")]) == [(None, "none")] * 3 + [(us(2025, 3, 5, 15), "ok")]
    df = spark.range(60_000).selectExpr("id", "if(id % 10 = 0, '3/5/2025 10:00', concat(13 + id % 15, '/5/2025 10:00')) as ts", "'ny' as src")
    cat = spark.createDataFrame(CAT, "sensor string, tz_name string, date_order string")
    out = normalise_timestamps(df, "ts", "src", cat).groupBy("instant_status", "instant_reading").count().collect()
    assert {(r[0], r[1]) for r in out if r[1]} == {("ok", "dmy")} and all(r[0] == "ambiguous" for r in out if r[1] is None)


def test_units_of_numbers(spark):
    got = norm(spark, [("-5", "ny"), ("0", "ny"), ("123456789012345678", "ny"), ("99999999999999999999", "ny"), ("1741154828", "other"), ("+1741154828", None), ("400000000", "ny")])
    assert got == [(None, "none")] * 4 + [(us(2025, 3, 5, 6, 7, 8), "ok")] * 2 + [(400_000_000_000_000, "ok")]
    # with a wider span of plausible times a number has several readings; the source's other numbers decide
    df = spark.createDataFrame([(i, t, "a") for i, t in enumerate(["1741154828123456"] * 200 + ["86400000"])] + [(999, "86400000", "b")], "id long, ts string, src string")
    cat = spark.createDataFrame(CAT, "sensor string, tz_name string, date_order string")
    r = {x["id"]: (x["instant_us"], x["instant_status"]) for x in normalise_timestamps(df, "ts", "src", cat, plausible=("1970-01-01", "2100-01-01")).collect()}
    assert r[0] == (1741154828123456, "ok") and r[200] == (86_400_000, "ok") and r[999] == (None, "ambiguous")


def test_lines_of_files(spark, tmp_path):
    texts = {
        1: ["Seen,a,Label", "05/03/2025 06:07,1,benign", '"2025-03-05T06:07:08Z",2,bot', "05/03/2025 06:07,3", "n/a,4,bot"],  # one line is damaged
        2: ["a;When", "1;03/05/2025 1:07:08 PM", "2;1741154828"],
        3: ["a,Seen", "1,2025-03-05 06:07:08"],  # no sensor
        4: ["a,b", "1,2"],  # no time field
    }
    lines = [(10 * f + n, f, n, t) for f, ts in texts.items() for n, t in enumerate(ts, 1)]
    d = str(tmp_path)
    spark.createDataFrame(lines, "line_id long, file_id long, line_no int, line_text string").write.parquet(f"{d}/raw_flows.parquet")
    spark.createDataFrame([(1, "be"), (2, "ny"), (3, None), (4, "be")], "file_id long, sensor string").write.parquet(f"{d}/capture_files.parquet")
    spark.createDataFrame(CAT, "sensor string, tz_name string, date_order string").write.parquet(f"{d}/sensors.parquet")
    got = {r["line_id"]: (r["instant_us"], r["instant_status"]) for r in entry.queries()["p6_lines"](spark, d).collect()}
    assert got == {
        12: (us(2025, 3, 5, 5, 7), "ok"), 13: (us(2025, 3, 5, 6, 7, 8), "ok"), 15: (None, "none"),
        22: (us(2025, 3, 5, 18, 7, 8), "ok"), 23: (us(2025, 3, 5, 6, 7, 8), "ok"), 32: (None, "no_zone"),
    }


def test_empty(spark):
    assert norm(spark, [("x", "ny")])[:0] == []
