import pytest

from biblion.operators.timestamps import normalise_timestamps, timestamp_findings

CASES = [
    ("2024-05-01", "UTC", None, "2024-05-01"), (" 2024-05-25 ", "UTC", None, "2024-05-25"), ("2020 Jan", "UTC", None, "2020-01"), ("2019", None, None, "2019"),
    ("03/04/21", "UTC", "DMY", "2021-04-03"), ("03/04/21", "UTC", "MDY", "2021-03-04"), ("03/04/21", "UTC", None, None), ("13/04/2021", "UTC", "MDY", None),
    ("2020-13-15", "UTC", None, None), ("2023-02-30", "UTC", None, None), ("in press", "UTC", None, None), ("", "UTC", None, None), (None, "UTC", None, None),
    ("2018-11-28 03:36:10.692", "UTC", None, "2018-11-28T03:36:10.692000Z"), ("2020-08-01T22:48:42.197712067Z", None, None, "2020-08-01T22:48:42.197712Z"),
    ("16 May 2024 6:27 AM", "Europe/Berlin", None, "2024-05-16T04:27:00.000000Z"), ("19 Dec 2017 12:11 AM", "UTC", None, "2017-12-19T00:11:00.000000Z"),
    ("Thu, 27 Oct 2022 12:06:32 +0900", None, None, "2022-10-27T03:06:32.000000Z"), ("2019-03-10 01:56:16 PST", None, None, "2019-03-10T09:56:16.000000Z"),
    ("2021-11-07 01:30:00", "America/New_York", None, "2021-11-07T05:30:00.000000Z"),  # doubled hour: the earlier instant
    ("2024-03-10T02:00:16[America/New_York]", None, None, "2024-03-10T07:00:16.000000Z"),  # skipped hour: the offset before
    ("2018-03-11 03:27:17 America/New_York", None, None, "2018-03-11T07:27:17.000000Z"), ("2024-01-01 10:00:00", None, None, None), ("2024-01-01 10:00:00", "Mars/Base", None, None),
    ("1583648781482", None, None, "2020-03-08T06:26:21.482000Z"), ("20210114T100856Z", None, None, "2021-01-14T10:08:56.000000Z"), ("2024년 8월 13일", None, None, "2024-08-13"),
    ("25-AUG-22", None, None, "2022-08-25"), ("12.08.2024 14:25", "UTC", None, "2024-08-12T14:25:00.000000Z"), ("2024-01-01 24:00:00", "UTC", None, None),
]


def test_normal_forms(spark):
    rows = [(i, *c[:3], "kept") for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, v string, z string, o string, norm_value string")
    got = {r.i: r.norm_value for r in normalise_timestamps(df, "v", "z", "o").collect()}
    assert [(c[0], got[i]) for i, c in enumerate(CASES)] == [(c[0], c[3]) for c in CASES]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Seoul"])
def test_session_zone_does_not_matter(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([("1583648781", "UTC"), ("2021-11-07 01:30:00", "America/New_York")], "v string, z string")
        assert [r.norm_value for r in normalise_timestamps(df, "v", "z").collect()] == ["2020-03-08T06:26:21.000000Z", "2021-11-07T05:30:00.000000Z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_findings_edge_cases(spark):
    a = spark.createDataFrame([("x:1", "2024/01/02", 1), ("x:1", "2024/01/02", 2), (None, "2024/01/02", 3), ("x:2", "2024-01-02", 4), ("y:3", "1/2/2024", 5)], "uid string, pub_date string, norm_value int")
    w = spark.createDataFrame([], "id long, last_gathered_at string, writer_zone string")
    z = spark.createDataFrame([("x", "UTC", "MDY"), ("x", "UTC", "MDY")], "source string, zone string, date_order string")
    assert [tuple(r) for r in timestamp_findings(a, w, z).collect()] == [("haie_rev", "x:1", "2024-01-02")]
