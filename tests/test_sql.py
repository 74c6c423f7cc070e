from datetime import datetime

import pytest

from tidemark.errors import InvalidQuery
from tidemark.model import Measurement
from tidemark.plans.dialect import to_spark_sql
from tidemark.plans.engine import Engine


@pytest.fixture(scope="module")
def e(spark):
    engine = Engine(spark)
    rows = [(datetime(2024, 1, 1, 0, i), "s1" if i % 2 else "s2", float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, host string, usage double")
    engine.register(Measurement("cpu", "time", ("host",), ("usage",)), df)
    engine.register(Measurement("my-cpu", "time", ("host",), ("usage",)), df)
    return engine


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_rewrites():
    assert to_spark_sql("SELECT 'first(x) LIMIT 1, 2' FROM t -- last(x)") == "SELECT 'first(x) LIMIT 1, 2' FROM t -- last(x)"
    assert to_spark_sql("SELECT a FROM t ORDER BY a LIMIT 2, 5") == "SELECT a FROM t ORDER BY a LIMIT 5 OFFSET 2"
    assert to_spark_sql('SELECT "a b" FROM public.t;') == "SELECT `a b` FROM t"
    assert "ORDER BY time DESC" in to_spark_sql("SELECT a FROM t LIMIT 3")
    assert "ORDER BY" not in to_spark_sql("SELECT count(*) FROM t LIMIT 3")
    assert "TIMESTAMP '2024-01-01'" in to_spark_sql("SELECT a FROM t WHERE timestamp > TIMESTAMP '2024-01-01'")
    assert "WHERE time >" in to_spark_sql("SELECT a FROM t WHERE timestamp > TIMESTAMP '2024-01-01'")


@pytest.mark.parametrize("bad", ["", ";", "SELECT 1; SELECT 2", "SELECT time_bucket('x', time) FROM cpu", "SELECT percentile_101(usage) FROM cpu"])
def test_rejected(e, bad):
    with pytest.raises(InvalidQuery):
        e.sql(bad)


@pytest.mark.parametrize("bad", ["INSERT INTO cpu VALUES (1)", "DROP TABLE cpu", "EXPLAIN ANALYZE SELECT 1"])
def test_unsupported(e, bad):
    with pytest.raises(InvalidQuery):
        e.sql(bad)


def test_aggregates(e):
    assert rows(e.sql("SELECT FIRST(usage), LAST(usage), AVERAGE(usage), PERCENTILE_50(usage) FROM cpu")) == [(0.0, 11.0, 5.5, 5.5)]
    assert rows(e.sql("SELECT STDDEV(usage) AS s FROM cpu WHERE usage = 3")) == [(0.0,)]
    assert rows(e.sql("SELECT host, MAX(usage) AS m FROM cpu GROUP BY host HAVING m > 10")) == [("s1", 11.0)]
    assert rows(e.sql("SELECT COUNT(DISTINCT host) FROM cpu")) == [(2,)]


def test_time_bucket(e):
    got = rows(e.sql("SELECT time_bucket('5 minutes', time) AS bucket, COUNT(*) AS n FROM cpu GROUP BY bucket ORDER BY bucket"))
    assert got == [(datetime(2024, 1, 1), 5), (datetime(2024, 1, 1, 0, 5), 5), (datetime(2024, 1, 1, 0, 10), 2)]
    got = rows(e.sql("SELECT time_bucket(INTERVAL '5 minutes', time, TIMESTAMP '2024-01-01 00:02:00') AS b, COUNT(*) FROM cpu GROUP BY 1 ORDER BY 1"))
    assert [n for _, n in got] == [2, 5, 5]
    assert rows(e.sql("SELECT COUNT(*) AS n FROM cpu GROUP BY time_bucket('6m', time) ORDER BY n")) == [(6,), (6,)]


def test_windows_and_order(e):
    assert rows(e.sql("SELECT usage FROM cpu LIMIT 2")) == [(11.0,), (10.0,)]
    assert rows(e.sql("SELECT LAST(usage) OVER (PARTITION BY host ORDER BY time ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS x FROM cpu ORDER BY x LIMIT 1")) == [(2.0,)]
    assert rows(e.sql("SELECT STDDEV(usage) OVER (ORDER BY time ROWS BETWEEN CURRENT ROW AND CURRENT ROW) AS x FROM cpu LIMIT 1")) == [(0.0,)]


def test_quoted_measurement(e):
    assert rows(e.sql('SELECT COUNT(*) FROM "my-cpu"')) == [(12,)]


def test_commands(e):
    assert rows(e.sql("SHOW TABLES")) == [("cpu",), ("my-cpu",)]
    assert rows(e.sql("SHOW server_version"))[0][0]
    assert rows(e.sql("SET x = 1")) == []
    assert "PushedFilters" in "\n".join(r[0] for r in rows(e.sql("EXPLAIN SELECT 1"))) or rows(e.sql("EXPLAIN SELECT 1"))
    assert "tidemark" in rows(e.sql("SELECT version()"))[0][0]
    assert rows(e.sql("SELECT current_database(), 1 AS one")) == [("tidemark", 1)]


def test_catalog_tables(e):
    got = rows(e.sql("SELECT table_name FROM information_schema.tables ORDER BY 1"))
    assert got == [("cpu",), ("my-cpu",)]
    got = rows(e.sql("SELECT column_name, data_type FROM information_schema.columns WHERE table_name = 'cpu' ORDER BY ordinal_position"))
    assert got == [("time", "timestamp without time zone"), ("host", "text"), ("usage", "double precision")]
    assert rows(e.sql("SELECT relname FROM pg_catalog.pg_class ORDER BY 1")) == [("cpu",), ("my-cpu",)]
    assert rows(e.sql("SELECT * FROM information_schema.views")) == []
    assert rows(e.sql("SELECT count(*) FROM pg_attribute")) == [(6,)]


def test_joins_and_ctes_come_free(e):
    assert rows(e.sql("WITH a AS (SELECT host, MAX(usage) AS m FROM cpu GROUP BY host) SELECT c.usage FROM cpu c JOIN a ON a.host = c.host AND a.m = c.usage ORDER BY 1")) == [(10.0,), (11.0,)]


def test_now_and_intervals(e):
    assert rows(e.sql("SELECT COUNT(*) FROM cpu WHERE time > now() - INTERVAL '5 minutes'")) == [(0,)]
    assert rows(e.sql("SELECT COUNT(*) FROM cpu WHERE time >= TIMESTAMP_NTZ '2024-01-01 00:10:00' - INTERVAL '2 minutes'")) == [(4,)]


def test_total_rows_and_functions(e):
    from tidemark.model import QueryBuilder

    assert e.total_rows(QueryBuilder("cpu").where_eq("host", "s1").limit(2).build()) == 6
    assert e.total_rows({"measurement": "cpu", "limit": 1}) == 12
    e.define("half", "x DOUBLE", "x / 2")
    assert rows(e.sql("SELECT MAX(half(usage)) FROM cpu")) == [(5.5,)]


def test_system_calls_only_as_calls(spark):
    from tidemark.plans.engine import Engine

    assert Engine(spark).sql("SELECT 'version()' AS a, /* version() */ version ( ) AS b").collect()[0].asDict() == {"a": "version()", "b": "tidemark on Apache Spark"}


def test_gap_fill_with_long_gaps_and_null_keys(spark):
    from datetime import datetime, timedelta

    from tidemark.functions.buckets import PIECE, gap_fill

    start, n = datetime(2024, 1, 1), 2 * PIECE + 10
    times = [start + timedelta(seconds=s) for s in (5, PIECE, PIECE + 1, n - 1)]
    df = spark.createDataFrame([(t, k, 1) for t in times for k in ("a", None)], "time timestamp_ntz, k string, n long")
    got = gap_fill(df, "time", "1s", start, start + timedelta(seconds=n), ["k"], ["n"]).collect()
    assert len(got) == 2 * n and sum(r["n"] for r in got) == 8 and len({(r["time"], r["k"]) for r in got}) == 2 * n
    one = gap_fill(df.filter("k = 'a'").drop("k"), "time", "1s", start, start + timedelta(seconds=n), [], ["n"]).collect()
    assert sorted(r["time"] for r in one) == [start + timedelta(seconds=i) for i in range(n)] and sum(r["n"] for r in one) == 4
    none = gap_fill(df.filter("false").drop("k"), "time", "1s", start, start + timedelta(seconds=n), [], ["n"]).collect()
    assert len(none) == n and all(r["n"] == 0 for r in none)
