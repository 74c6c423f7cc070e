from datetime import date, datetime
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.errors import ConflictingTypes
from tidemark.model import Measurement, QueryBuilder
from tidemark.plans.engine import Engine
from tidemark.sources import generators, line_protocol, parquet, tables


def parsed(spark, *lines):
    return line_protocol.parse(spark.createDataFrame([(x,) for x in lines], "value string")).collect()


def one(spark, line):
    (row,) = parsed(spark, line)
    return row


def test_a_line(spark):
    r = one(spark, "cpu,host=server01 value=64.5 1609459200000000000")
    assert (r["measurement"], r["tags"], r["time_ns"], r["error"]) == ("cpu", {"host": "server01"}, 1609459200000000000, None)
    assert r["fields"]["value"]["kind"] == "float" and r["fields"]["value"]["f"] == 64.5


@pytest.mark.parametrize(
    "text,kind,slot,value",
    [("1", "float", "f", 1.0), ("-15.5", "float", "f", -15.5), ("1.5e-10", "float", "f", 1.5e-10), ("8i", "integer", "i", 8), ("-8i", "integer", "i", -8), ("18446744073709551615u", "unsigned", "u", Decimal(2**64 - 1)),
     ('"Hello, World!"', "string", "s", "Hello, World!"), (r'"Line1\nLine2"', "string", "s", "Line1\nLine2"), (r'"a\"b\\n"', "string", "s", 'a"b\\n'), ('""', "string", "s", "")]
    + [(x, "boolean", "b", True) for x in ("t", "T", "true", "True", "TRUE")] + [(x, "boolean", "b", False) for x in ("f", "F", "false", "False", "FALSE")],
)
def test_values(spark, text, kind, slot, value):
    got = one(spark, f"m v={text} 1")["fields"]["v"]
    assert (got["kind"], got[slot]) == (kind, value)


def test_escapes(spark):
    r = one(spark, r"my\ m\,x,host=server\ 01,a\=b=c\,d f\ 1=1,g=2i 5")
    assert (r["measurement"], r["tags"], sorted(r["fields"])) == ("my m,x", {"host": "server 01", "a=b": "c,d"}, ["f 1", "g"])


@pytest.mark.parametrize("line", ["cpu", "cpu,host=a", ",host=a v=1", "cpu v=abc", "cpu v=1 soon", "cpu,host v=1", "cpu v=1 1 2", "cpu v=", "cpu =1", "cpu v=99999999999999999999i", "cpu,host= v=1", "cpu,a=1,a=2 v=1", "cpu v=1,v=2"])
def test_errors(spark, line):
    assert one(spark, line)["error"] is not None


def test_partial_success(spark):
    got = parsed(spark, "cpu v=1 1", "# comment", "", "   ", "broken", "cpu v=2")
    assert sorted(r["error"] is None for r in got) == [False, True, True]
    assert all(r["time_ns"] > 10**18 for r in got if r["line"] == "cpu v=2")


def test_measurement_and_conflicts(spark):
    df = line_protocol.parse(spark.createDataFrame([("a,h=1 x=1,y=2i 1500",), ("a z=t -1",), ("b x=1i 1",)], "value string"))
    m, rows = line_protocol.measurement(df, "a")
    assert (m.tags, m.fields) == (("h",), ("x", "y", "z"))
    got = {r["time_ns"]: r for r in rows.collect()}
    assert got[1500]["y"] == 2 and got[1500]["time"] == datetime(1970, 1, 1, 0, 0, 0, 1) and got[-1]["z"] is True
    assert got[-1]["time"] == datetime(1969, 12, 31, 23, 59, 59, 999999)
    bad = line_protocol.parse(spark.createDataFrame([("a x=1 1",), ("a x=1i 2",)], "value string"))
    with pytest.raises(ConflictingTypes):
        line_protocol.measurement(bad, "a")


plain = st.text(st.characters(min_codepoint=32, max_codepoint=0x2FF, exclude_characters="\x7f\x85\xa0"), min_size=1, max_size=8).filter(lambda s: s.strip(" ") == s)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(plain, st.text(max_size=8).filter(lambda s: "\x00" not in s and "\x01" not in s and s.isprintable()), st.floats(allow_nan=False, allow_infinity=False)), min_size=1, max_size=8))
def test_round_trip(spark, rows):
    data = [(datetime(2024, 1, 1, 0, 0, 0, i), t, s, f) for i, (t, s, f) in enumerate(rows)]
    df = spark.createDataFrame(data, "time timestamp_ntz, tag string, s string, f double")
    m = Measurement("m x", "time", ("tag",), ("f", "s"))
    back = line_protocol.measurement(line_protocol.parse(line_protocol.export(df, m)), "m x")[1]
    assert sorted(tuple(r) for r in back.select("time", "tag", "s", "f").collect()) == sorted(data)


def test_export_skips_what_is_missing(spark):
    df = spark.createDataFrame([(datetime(1970, 1, 1), None, 1.5, None), (datetime(1970, 1, 1), "a", None, None)], "time timestamp_ntz, t string, f double, s string")
    got = [r[0] for r in line_protocol.export(df, Measurement("m", "time", ("t",), ("f", "s"))).collect()]
    assert got == ["m f=1.5 0"]


def test_engine_write(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    bad = e.write(["cpu,host=a usage=1 1609459200000000000", "cpu,host=b usage=3,n=4i 1609545600000000000", "oops", "mem free=5u 1609459200000000000"])
    assert [r["line"] for r in bad.collect()] == ["oops"]
    assert e.sql("SELECT SUM(usage) FROM cpu").collect()[0][0] == 4.0
    e.write(["cpu,host=a usage=10 1609459200000000000"])
    assert e.query(QueryBuilder("cpu").aggregate("sum", "usage", "v").between("2021-01-01", "2021-01-02").build()).collect()[0]["v"] == 11.0
    plan = e.explain(QueryBuilder("cpu").aggregate("sum", "usage", "v").between("2021-01-01", "2021-01-02").build())
    assert "PartitionFilters: [isnotnull(date" in plan


def test_parquet_import(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame(
        [(1_500_000, "a", 1, 2.5, True, "x", [1], date(2024, 1, 1)), (-1, "b", None, None, None, None, None, None)], "ts long, host string, i int, f float, b boolean, s string, skip array<int>, d date"
    ).write.parquet(path)
    m, df = parquet.import_parquet(spark, path, "t", ["host", "absent"], unit="ms")
    assert (m.tags, m.fields) == (("host",), ("i", "f", "b", "s"))
    assert [tuple(r) for r in df.collect()] == [(datetime(1970, 1, 1, 0, 25), "a", 1, 2.5, True, "x")]
    assert ("skip", "array<int>") in [tuple(r) for r in parquet.inspect(spark, path).collect()]


def test_import_dedup_keeps_null_keys_and_inner_duplicates(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c")], "k int, v string")
    old = spark.createDataFrame([(1,), (None,)], "k int")
    assert sorted(r["v"] for r in tables.without_existing(new, old, ["k"]).collect()) == ["b", "b", "c"]


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    m = Measurement("t", "time", ("host",), ("v",))
    df = spark.createDataFrame([(datetime(2024, 1, d), "a", float(d)) for d in (1, 2, 3)], "time timestamp_ntz, host string, v double")
    tables.append(df, m, path, bloom=["host"])
    tables.append(df.limit(1), m, path)
    assert tables.partitions(spark, path) == ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert tables.open_table(spark, m, path)[1].count() == 4
    assert tables.drop_before(spark, path, datetime(2024, 1, 3)) == ["2024-01-01", "2024-01-02"]
    assert tables.open_table(spark, m, path)[1].count() == 1
    assert tables.partitions(spark, str(tmp_path / "none")) == []


def test_generators_are_deterministic(spark):
    for make in (generators.device_metrics, generators.network_health):
        m, a = make(spark, 6, 5)
        _, b = make(spark, 6, 5)
        assert a.count() == 30 and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        assert set(a.columns) == {m.time, *m.tags, *m.fields}
