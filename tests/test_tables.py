from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandline.functions import columns as C
from strandline.functions import geo
from strandline.functions.durations import parse
from strandline.operators.concat import concat
from strandline.operators.group_dynamic import group_dynamic
from strandline.operators.index import with_row_index
from strandline.operators.sql import InvalidQuery, sql
from strandline.operators.tree import partition_split, tree_map, unnest
from strandline.operators.waypoints import with_waypoints


def test_durations():
    assert parse("1h30m").steps("us") == 5_400_000_000
    assert parse("6i").steps("i") == 6 == parse(6).steps("i")
    assert parse(timedelta(milliseconds=20)) == parse("20ms")
    assert parse("2mo").months == 2 and parse("1w").nanos == 7 * parse("1d").nanos
    for bad in ("", "5", "3x", "1h2i"):
        with pytest.raises(ValueError):
            parse(bad)
    for text, unit in (("1mo", "us"), ("1s", "i"), ("2i", "us"), ("1ns", "us")):
        with pytest.raises(ValueError):
            parse(text).steps(unit)


def windows(spark, keys, every, **kw):
    df = spark.createDataFrame([("a", k, float(k)) for k in keys], "input_id string, k long, v double")
    return sorted(r["k"] for r in group_dynamic(df, "k", every, group_by=kw.pop("group_by", ["input_id"]), **kw).collect())


def test_gaps_make_no_empty_window(spark):
    assert windows(spark, [10, 11, 15, 16, 17, 30, 31], "6i") == [[10, 11, 15], [16, 17], [30, 31]]
    assert windows(spark, [], "6i") == []


@pytest.mark.parametrize("closed", ["left", "right", "both", "none"])
@pytest.mark.parametrize(("every", "period"), [(2, 6), (6, 2), (3, 3)])
def test_windows_against_a_plain_count(spark, closed, every, period):
    keys = [3, 4, 5, 9, 10, 17, 18, 30]
    low = (lambda a, s: a >= s) if closed in ("left", "both") else (lambda a, s: a > s)
    high = (lambda a, e: a <= e) if closed in ("right", "both") else (lambda a, e: a < e)
    want = [[k for k in keys if low(k, s) and high(k, s + period)] for s in range(3, 40, every)]
    assert windows(spark, keys, every, period=period, closed=closed) == sorted(w for w in want if w)


def test_without_keys_and_from_the_epoch(spark):
    df = spark.createDataFrame([(7,), (8,), (13,)], "k long")
    assert sorted(r["k"] for r in group_dynamic(df, "k", 5).collect()) == [[7, 8], [13]]
    assert sorted(r["k"] for r in group_dynamic(df, "k", 5, start_by="window").collect()) == [[7, 8], [13]]
    t = spark.createDataFrame([(datetime(2024, 5, 1, 12),), (datetime(2024, 5, 6),)], "t timestamp_ntz")
    assert sorted(len(r["t"]) for r in group_dynamic(t, "t", "1w", start_by="monday").collect()) == [1, 1]
    assert len(group_dynamic(t, "t", "1w").collect()) == 1


@pytest.mark.parametrize("closed", ["left", "right", "both", "none"])
@pytest.mark.parametrize(("every", "period", "start"), [("1mo", None, "datapoint"), ("1q", "1mo", "window"), ("2mo", "3mo", "datapoint"), ("1mo", "1mo15d", "window"), ("1y", "40d", "datapoint")])
def test_calendar_windows_against_a_plain_count(spark, closed, every, period, start):
    months = {"1mo": 1, "1q": 3, "2mo": 2, "1y": 12}[every]
    more, days_more = {None: (months, 0), "1mo": (1, 0), "3mo": (3, 0), "1mo15d": (1, 15), "40d": (0, 40)}[period]
    rng = random.Random(months)
    days = sorted({datetime(2023, 1, 31) + timedelta(days=rng.randrange(800), hours=rng.choice([0, 0, 7])) for _ in range(60)} | {datetime(2024, 2, 29), datetime(2023, 1, 31)})
    first = pd.Timestamp(days[0]) if start == "datapoint" else pd.Timestamp("1970-01-01")
    want = []
    for i in range(900):
        a = first + pd.DateOffset(months=months * i)
        b = first + pd.DateOffset(months=months * i + more) + pd.DateOffset(days=days_more)
        held = [d for d in days if (a <= d if closed in ("left", "both") else a < d) and (d <= b if closed in ("right", "both") else d < b)]
        if held:
            want.append(held)
    df = spark.createDataFrame([("a", d) for d in days], "input_id string, k timestamp_ntz")
    assert sorted(r["k"] for r in group_dynamic(df, "k", every, period, ["input_id"], closed, start_by=start).collect()) == sorted(want)


def test_calendar_windows_need_times(spark):
    df = spark.createDataFrame([("a", 1)], "input_id string, k long")
    for kw in ({"every": "1mo"}, {"every": 5, "period": "1mo"}):
        with pytest.raises(ValueError):
            group_dynamic(df, "k", group_by=["input_id"], **kw)
    dates = spark.createDataFrame([("a", date(2024, 1, 31)), ("a", date(2024, 2, 29)), ("a", date(2024, 3, 30))], "input_id string, k date")
    assert sorted(len(r["k"]) for r in group_dynamic(dates, "k", "1mo", group_by=["input_id"]).collect()) == [1, 2]


def test_lists_keep_nulls_and_thinned_columns_come_last(spark):
    df = spark.createDataFrame([("a", i, None if i == 1 else i) for i in range(5)], "input_id string, k long, v long")
    out = group_dynamic(df, "k", 5, group_by=["input_id"], gather_every={"k": 2})
    assert out.columns == ["input_id", "v", "k"]
    assert tuple(out.first()) == ("a", [0, None, 2, 3, 4], [0, 2, 4])
    assert tuple(group_dynamic(df, "k", 5, group_by=["input_id"], gather_every=3).first()) == ("a", [0, 3], [0, 3])
    for bad in ({"closed": "ajar"}, {"start_by": "noon"}, {"label": "top"}, {"period": 0}):
        with pytest.raises(ValueError):
            group_dynamic(df, "k", 5, **bad)


def test_row_index_and_tree(spark):
    df = spark.createDataFrame([("a", 5), ("a", 3), ("b", 1)], "input_id string, seq long")
    out = with_row_index({"x": df}, offset=10, dtype="int")["x"]
    assert out.columns[0] == "_idx_" and out.schema["_idx_"].dataType.simpleString() == "int"
    assert sorted(map(tuple, out.collect())) == [(10, "a", 3), (10, "b", 1), (11, "a", 5)]
    assert tree_map(lambda a, b: a + b, {"p": {"q": 1}, "r": 2}, {"p": 10, "r": 20}) == {"p": {"q": 11}, "r": 22}
    parts = partition_split(df, "input_id")
    assert list(parts) == ["a", "b"] and parts["a"].columns == ["seq"]


def test_waypoints_repeat_the_last_point(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(5)], "input_id string, seq long, p double")
    out = with_waypoints(df, "p", "w", 3)
    assert out.columns[0] == "w"
    assert [r["w"] for r in out.orderBy("seq").collect()] == [[0, 1, 2], [1, 2, 3], [2, 3, 4], [3, 4, 4], [4, 4, 4]]
    assert [r["w"] for r in with_waypoints(df, "p", "w", 1).orderBy("seq").collect()] == [[0], [1], [2], [3], [4]]


def test_concat(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2, "y")], "i int, s string")
    assert sorted(map(tuple, concat([a, b], ["k1", "k2"], "key").collect())) == [(1, "x", "k1"), (2, "y", "k2")]
    assert concat([a, b.select(F.col("i").cast("long"), "s")], how="vertical_relaxed").schema["i"].dataType.simpleString() == "bigint"
    assert sorted(map(tuple, concat([a, b.select("i")], how="diagonal").collect())) == [(1, "x"), (2, None)]
    assert concat([a, b.select("i", F.lit(1).alias("z"))], how="align_inner").count() == 0
    for args in (([a, b], ["k"], None), ([a, b], ["k"], "key"), ([a, b.select("i")],), ([],)):
        with pytest.raises(ValueError):
            concat(*args)


def test_sql(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, float("nan"))], "i int, v double")
    assert sorted(r[0] for r in sql(spark, "SELECT i FROM self WHERE COLUMNS(*) IS NOT NULL", self=df).collect()) == [2, 3]
    assert sql(spark, 'WITH t AS (SELECT "i" AS "a b" FROM x) SELECT "a b" FROM t WHERE "a b" > $n', x=df, n=2).collect()[0][0] == 3
    assert sql(spark, "SELECT $d AS d, $e AS e", d=timedelta(hours=1), e=None).first() == (timedelta(hours=1), None)
    for bad in ("CREATE TABLE t AS SELECT 1", "SELECT 1; SELECT 2", "SHOW TABLES", "INSERT INTO t SELECT 1", "nonsense"):
        with pytest.raises(InvalidQuery):
            sql(spark, bad)
    with pytest.raises(TypeError):
        sql(spark, "SELECT $x", x=object())


def test_columns(spark):
    df = spark.createDataFrame([([[1, 2], [3, 4]],), (None,)], "a array<array<int>>")
    fixed = df.select(C.fixed_array(F.col("a"), "float", 2, 2).alias("a"))
    assert [r[0] for r in fixed.collect()] == [[[1.0, 2.0], [3.0, 4.0]], None]
    with pytest.raises(PySparkException):
        df.select(C.fixed_array(F.col("a"), "float", 2, 3)).collect()
    with pytest.raises(PySparkException):
        spark.createDataFrame([("z",)], "s string").select(C.category(F.col("s"), ["a"])).collect()
    t = spark.createDataFrame([("2024-01-02T03:04:05.123456789Z",)], "s string").select(C.nanos_from_text(F.col("s")).alias("n"))
    assert t.first()[0] == 1_704_164_645_123_456_789
    assert t.select(C.datetime_from_nanos(F.col("n")).cast("string")).first()[0] == "2024-01-02 03:04:05.123457"
    nested = spark.createDataFrame([(1, (2, 3))], "i int, s struct<a: int, b: int>")
    assert unnest(nested, "s", ".").columns == ["i", "s.a", "s.b"]


def test_geometry(spark):
    assert geo.wkb_decode(geo.wkb_encode((1.5, -2.0))) == (1.5, -2.0)
    assert geo.wkb_decode(geo.wkb_encode([(1.0, 2.0), (3.0, 4.0)])) == [(1.0, 2.0), (3.0, 4.0)]
    df = spark.createDataFrame([(13.4, 52.5)], "x double, y double").select(geo.point(F.col("x"), F.col("y")).alias("p"))
    east, north = df.select(geo.utm(F.col("p")).alias("u")).select("u.*").first()
    assert abs(east - 798609.5209110928) < 1e-6 and abs(north - 5825756.242018063) < 1e-6
    turned = df.select(geo.rotate(F.array(geo.point(F.lit(1), F.lit(0))), F.radians(F.lit(90)))[0].alias("r")).select("r.*").first()
    assert abs(turned[0]) < 1e-12 and abs(turned[1] - 1) < 1e-12
    box = lambda *p: df.select(geo.contains(-1, -1, 1, 1, F.array(*(geo.point(F.lit(x), F.lit(y)) for x, y in p)))).first()[0]
    assert box((0, 0), (1, 1)) and not box((1, 1)) and not box((0, 0), (2, 0))
    back = df.select(geo.point_from_wkb(geo.point_to_wkb(F.col("p"))).alias("p")).select("p.*").first()
    assert tuple(back) == (13.4, 52.5)
