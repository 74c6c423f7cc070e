"""Values that the fixtures fix: filters, aggregates, buckets, windows, limits."""

from datetime import datetime, timedelta

import pytest

from tidemark.errors import InvalidQuery, UnknownMeasurement
from tidemark.model import And, Frame, Measurement, Not, Or, QueryBuilder, Tag, WindowCall
from tidemark.operators.filters import from_request, to_column
from tidemark.plans.engine import Engine

EPOCH = datetime(1970, 1, 1)
CPU = Measurement("cpu", "time", ("host", "region"), ("value",), ())


def at(us):
    return EPOCH + timedelta(microseconds=us)


def cpu(spark, rows):
    e = Engine(spark)
    e.register(CPU, spark.createDataFrame([(at(t), h, r, v) for t, h, r, v in rows], "time timestamp_ntz, host string, region string, value double"))
    return e


@pytest.fixture
def three(spark):
    return cpu(spark, [(1000, "s1", "us", 1.0), (1000, "s2", "eu", 2.0), (1000, "s3", None, 3.0)])


def hosts(e, f):
    return sorted(r["host"] for r in e.query(QueryBuilder("cpu").where(f).build()).collect())


def test_filters(three):
    assert hosts(three, Tag("host", "in", ("s1", "s3"))) == ["s1", "s3"]
    assert hosts(three, And((Tag("host", "not_in", ("s2",)), Tag("region", "exists")))) == ["s1"]
    assert hosts(three, Tag("host", "regex", "^s[12]$")) == ["s1", "s2"]
    assert hosts(three, Tag("host", "regex", "[")) == []
    assert hosts(three, Not(Tag("region", "regex", "["))) == ["s1", "s2", "s3"]


def test_missing_tag_is_unequal(three):
    assert hosts(three, Tag("region", "ne", "us")) == ["s2", "s3"]
    assert hosts(three, Tag("region", "not_in", ("us", "eu"))) == ["s3"]
    assert hosts(three, Not(Tag("region", "ne", "us"))) == ["s1"]
    assert hosts(three, Not(Tag("region", "eq", "us"))) == ["s2", "s3"]


def test_boolean_trees(three):
    one, three_ = Tag("host", "eq", "s1"), Tag("host", "eq", "s3")
    assert hosts(three, Or((one, three_))) == ["s1", "s3"]
    assert hosts(three, And((Or((one, three_)), Tag("region", "eq", "us")))) == ["s1"]
    assert hosts(three, And(())) == ["s1", "s2", "s3"]
    assert to_column(Or(())) is None
    assert hosts(three, Not(And(()))) == []


def test_request_filters(three):
    f = from_request({"or": [{"tag": "host", "op": "equals", "value": "s1"}, {"not": {"tag": "region", "op": "exists"}}]})
    assert hosts(three, f) == ["s1", "s3"]
    for bad in ({"tag": "host", "op": "like", "value": "x"}, {"tag": "host", "op": "in", "value": "x"}, {"op": "eq"}, 3):
        with pytest.raises(InvalidQuery):
            from_request(bad)


def test_out_of_order_and_limits(spark):
    e = cpu(spark, [(t, "s1", None, float(t)) for t in (3000, 1000, 2000)])
    assert [r["value"] for r in e.query(QueryBuilder("cpu").order_by("time").build()).collect()] == [1000, 2000, 3000]
    rows = [(t, "s1", None, float(t)) for t in range(0, 10000, 1000)] + [(t, "s2", None, float(t)) for t in range(10000, 20000, 1000)]
    e = cpu(spark, rows)
    assert [r["value"] for r in e.query(QueryBuilder("cpu").limit(5, 3).build()).collect()] == [3000, 4000, 5000, 6000, 7000]
    assert [r["value"] for r in e.query(QueryBuilder("cpu").order_by("time", False).limit(5, 3).build()).collect()] == [16000, 15000, 14000, 13000, 12000]


def test_many_series_top_k_is_exact(spark):
    e = cpu(spark, [(i, f"h{i:04}", None, float(i)) for i in range(900)])
    assert [r["host"] for r in e.query(QueryBuilder("cpu").order_by("time", False).limit(3).build()).collect()] == ["h0899", "h0898", "h0897"]


def test_bucket_counts(spark):
    e = cpu(spark, [(t, "s1", None, 1.0) for t in range(0, 100, 10)])
    got = e.query(QueryBuilder("cpu").between(at(0), at(100)).count("*", "n").every("50us").build()).collect()
    assert sorted((r["time"], r["n"]) for r in got) == [(at(0), 5), (at(50), 5)]


def test_bucket_means_and_gap_fill(spark):
    rows = [(5000, "a", None, 10.0), (15000, "a", None, 20.0), (16000, "a", None, 30.0), (45000, "a", None, 40.0)]
    e = cpu(spark, rows)
    q = QueryBuilder("cpu").between(at(0), at(60000)).mean("value", "v").count("*", "n").every("10ms", fill=True).build()
    got = sorted((r["time"], r["v"], r["n"]) for r in e.query(q).collect())
    assert [(v, n) for _, v, n in got] == [(10.0, 1), (25.0, 2), (None, 0), (None, 0), (40.0, 1), (None, 0)]
    assert got[0][0] == at(0)


def test_gap_fill_keeps_null_groups(spark):
    e = cpu(spark, [(0, "a", None, 1.0), (0, "b", "us", 1.0)])
    q = QueryBuilder("cpu").between(at(0), at(20)).count("*", "n").group_by("region").every("10us", fill=True).build()
    assert sorted(((r["region"] or ""), r["n"]) for r in e.query(q).collect()) == [("", 0), ("", 1), ("us", 0), ("us", 1)]


def test_negative_times(spark):
    e = cpu(spark, [(t, "a", None, 1.0) for t in (-10000, -5001, -5000, 0, 5000)])
    q = QueryBuilder("cpu").between(at(-10000), at(10000)).count("*", "n").every("5ms").build()
    assert sorted((r["time"], r["n"]) for r in e.query(q).collect()) == [(at(-10000), 2), (at(-5000), 1), (at(0), 1), (at(5000), 1)]


def one(e, function, field="value"):
    return e.query(QueryBuilder("cpu").aggregate(function, field, "v").build()).collect()[0]["v"]


def test_aggregates(spark):
    e = cpu(spark, [(i, "a", None, v) for i, v in enumerate([2.0, 4.0, 4.0, 4.0, 5.0, 5.0, 7.0, 9.0])])
    assert (one(e, "sum"), one(e, "mean"), one(e, "min"), one(e, "max"), one(e, "first"), one(e, "last")) == (40, 5, 2, 9, 2, 9)
    assert one(e, "stddev") == pytest.approx(2.138, abs=1e-3)
    assert one(e, "variance") == pytest.approx(4.571, abs=1e-3)
    e = cpu(spark, [(i, "a", None, float(i)) for i in range(101)])
    assert (one(e, "p50"), one(e, "percentile_90"), one(e, "p0"), one(e, "p100")) == (50, 90, 0, 100)


def test_nan_null_single_and_empty(spark):
    nan = float("nan")
    e = cpu(spark, [(0, "a", None, nan), (1, "a", None, 3.0), (2, "a", None, None), (3, "b", None, None)])
    assert (one(e, "count"), one(e, "count", "*"), one(e, "sum"), one(e, "max"), one(e, "first"), one(e, "last")) == (1, 4, 3, 3, 3, 3)
    assert (one(e, "stddev"), one(e, "variance")) == (0.0, 0.0)
    empty = cpu(spark, [])
    assert (one(empty, "count"), one(empty, "count", "*"), one(empty, "sum"), one(empty, "p50"), one(empty, "stddev")) == (0, 0, None, None, None)
    grouped = e.query(QueryBuilder("cpu").aggregate("sum", "value", "v").group_by("host").build()).collect()
    assert sorted((r["host"], r["v"]) for r in grouped) == [("a", 3.0), ("b", None)]


def test_duplicate_times_are_kept(spark):
    e = cpu(spark, [(5, "a", None, 1.0), (5, "a", None, 1.0)])
    assert e.query(QueryBuilder("cpu").build()).count() == 2


def windowed(e, call):
    return [r[call.name] for r in sorted(e.query(QueryBuilder("cpu").over(call).build()).collect(), key=lambda r: (r["host"], r["time"], r["value"]))]


def test_windows(spark):
    e = cpu(spark, [(t, "a", None, v) for t, v in ((1, 10.0), (2, 20.0), (3, 30.0), (4, 40.0), (5, 50.0))])
    assert windowed(e, WindowCall("lag", "value")) == [None, 10, 20, 30, 40]
    assert windowed(e, WindowCall("lead", "value", default=0.0)) == [20, 30, 40, 50, 0]
    assert windowed(e, WindowCall("sum", "value", frame=Frame("rows", None, 0))) == [10, 30, 60, 100, 150]
    assert windowed(e, WindowCall("avg", "value", frame=Frame("rows", -2, 0))) == [10, 15, 20, 30, 40]
    assert windowed(e, WindowCall("sum", "value", frame=Frame("rows", -3, -1))) == [None, 10, 30, 60, 90]
    assert windowed(e, WindowCall("sum", "value")) == [150] * 5
    assert windowed(e, WindowCall("p50", "value")) == [30] * 5


def test_ranking_with_ties(spark):
    e = cpu(spark, [(1, "a", None, 1.0), (1, "a", None, 2.0), (2, "a", None, 3.0)])
    assert windowed(e, WindowCall("rank")) == [1, 1, 3]
    assert windowed(e, WindowCall("dense_rank")) == [1, 1, 2]
    e = cpu(spark, [(1, "a", None, 1.0), (2, "a", None, 2.0), (1, "b", None, 1.0), (2, "b", None, 2.0), (3, "b", None, 3.0)])
    assert windowed(e, WindowCall("row_number", partition_by=("host",))) == [1, 2, 1, 2, 3]


def test_unknown_names(three):
    with pytest.raises(UnknownMeasurement):
        three.query(QueryBuilder("nothing").build())
    with pytest.raises(InvalidQuery):
        three.query(QueryBuilder("cpu").select("nothing").build())
    with pytest.raises(InvalidQuery):
        three.query({"measurement": "cpu", "where": 1})


def test_projection_keeps_time_and_tags(three):
    assert three.query(QueryBuilder("cpu").select("value").build()).columns == ["time", "host", "region", "value"]


def test_pushdown(spark, tmp_path):
    df = spark.range(100).selectExpr("cast(timestamp_micros(id) as timestamp_ntz) time", "cast(id % 3 as string) host", "cast(null as string) region", "double(id) value", "id other")
    df.write.parquet(str(tmp_path / "t"))
    e = Engine(spark)
    e.register(CPU, spark.read.parquet(str(tmp_path / "t")))
    plan = e.explain(QueryBuilder("cpu").between(at(5), at(50)).where_eq("host", "1").mean("value").build())
    assert "PushedFilters: [" in plan and "EqualTo(host,1)" in plan.replace("EqualNullSafe", "EqualTo") and "other" not in plan.split("ReadSchema")[1].split("\n")[0]
