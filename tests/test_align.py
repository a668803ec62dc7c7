from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strandline.operators.align import AsOf, Field, Interp, align

L = "input_id string, k long, id long"
R = "input_id string, k long, seq long, v double"


def aligned(spark, left, right, how, column="v", bucket=None):
    out = align(
        {"l": spark.createDataFrame([(*r, 0) for r in left], L + ", seq long"), "r": spark.createDataFrame(right, R)},
        {"l": Field("k"), "r": Field("k", {column: how})}, order="seq", bucket=bucket,
    )
    return {r["l/id"]: r[f"r/{column}"] for r in out.collect()}


TIES = [("a", 5, 0, 1.0), ("a", 15, 1, 2.0), ("a", 15, 2, 3.0), ("a", 25, 3, 4.0), ("a", 25, 4, 5.0)]
LEFT = [("a", 10, 0), ("a", 20, 1), ("a", 25, 2), ("b", 10, 3), ("a", None, 4)]


@pytest.mark.parametrize(
    ("how", "want"),
    [
        (AsOf(), {0: 1.0, 1: 3.0, 2: 5.0, 3: None, 4: None}),
        (AsOf("forward"), {0: 2.0, 1: 4.0, 2: 4.0, 3: None, 4: None}),
        (AsOf("nearest"), {0: 3.0, 1: 5.0, 2: 5.0, 3: None, 4: None}),
        (AsOf("nearest", 5), {0: 3.0, 1: 5.0, 2: 5.0, 3: None, 4: None}),
        (AsOf("nearest", 4), {0: None, 1: None, 2: 5.0, 3: None, 4: None}),
    ],
)
def test_ties_and_tolerance(spark, how, want):
    assert aligned(spark, LEFT, TIES, how) == want


def test_asof_keeps_a_null_value_and_interp_skips_it(spark):
    right = [("a", 0, 0, 0.0), ("a", 10, 1, None), ("a", 20, 2, 20.0)]
    assert aligned(spark, [("a", 12, 0)], right, AsOf()) == {0: None}
    assert aligned(spark, [("a", 12, 0), ("a", -1, 1), ("a", 21, 2), ("a", 20, 3), ("a", 10, 4)], right, Interp()) == {0: 12.0, 1: None, 2: None, 3: 20.0, 4: 10.0}


def test_the_key_cannot_be_interpolated_and_strategies_are_checked(spark):
    with pytest.raises(ValueError, match="cannot interpolate key"):
        aligned(spark, LEFT, TIES, Interp(), "k")
    with pytest.raises(ValueError):
        AsOf("sideways")


def test_nanoseconds_do_not_collapse(spark):
    left = spark.createDataFrame([("a", 1_700_000_000_000_000_001, 0)], L)
    right = spark.createDataFrame([("a", 1_700_000_000_000_000_000, 0, 1.0), ("a", 1_700_000_000_000_000_002, 1, 2.0)], R)
    out = align({"l": left, "r": right}, {"l": Field("k", unit="ns"), "r": Field("k", {"v": AsOf("backward", "1ns")})})
    assert out.collect()[0]["r/v"] == 1.0


def test_leaves_without_columns_and_nested_names(spark):
    t = spark.createDataFrame([("a", 1, 0, 1.0)], R)
    out = align({"m": {"x": t, "y.z": t}, "e": t}, {"m": {"x": Field("k"), "y.z": Field("k", {"k": AsOf(), "v": AsOf()})}, "e": Field("k")}, order="seq")
    assert out.columns == ["input_id", "m/x/k", "m/x/seq", "m/x/v", "m/y.z/k", "m/y.z/v"]


KEYS = st.lists(st.integers(0, 30), max_size=12)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(KEYS, st.lists(st.tuples(st.integers(0, 30), st.one_of(st.none(), st.floats(-9, 9, width=32))), max_size=12), st.sampled_from([None, 0, 3]))
def test_against_a_plain_search(spark, left, right, tolerance):
    rows = [("a", k, i, v) for i, (k, v) in enumerate(right)]
    ids = [("a", k, i) for i, k in enumerate(left)]
    if not ids:
        return

    def near(k, how):
        before = [r for r in rows if r[1] <= k]
        after = [r for r in rows if r[1] >= k]
        b = max(before, key=lambda r: (r[1], r[2]), default=None)
        f = min(after, key=lambda r: (r[1], r[2]), default=None)
        n = min(after, key=lambda r: (r[1], -r[2]), default=None)
        hit = b if how == "backward" else f if how == "forward" else n if b is None or (n and n[1] - k <= k - b[1]) else b
        return None if hit is None or tolerance is not None and abs(hit[1] - k) > tolerance else hit[3]

    for how in ("backward", "forward", "nearest"):
        assert aligned(spark, ids, rows, AsOf(how, tolerance)) == {i: near(k, how) for _, k, i in ids}
        assert aligned(spark, ids, rows, AsOf(how, tolerance), bucket=7) == {i: near(k, how) for _, k, i in ids}


@pytest.mark.parametrize("how", [AsOf(), AsOf("forward"), AsOf("nearest"), AsOf("nearest", 9), Interp()])
@pytest.mark.parametrize("bucket", [1, 10, 1000])
def test_buckets_change_nothing(spark, how, bucket):
    right = [("a" if i % 3 else "b", (i * 37) % 90 - 30, i, float(i) if i % 4 else None) for i in range(60)]
    left = [("a" if i % 2 else "b", (i * 53) % 200 - 60, i) for i in range(60)] + [("a", None, 99), ("c", 5, 98)]
    assert aligned(spark, left, right, how, bucket=bucket) == aligned(spark, left, right, how)
