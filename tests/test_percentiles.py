import random

from pyspark.sql import functions as F

from tidemark.model import Measurement, QueryBuilder
from tidemark.operators.percentiles import exact_percentiles
from tidemark.plans.engine import Engine

FRACTIONS = {"least": 0.0, "p1": 0.01, "half": 0.5, "p95": 0.95, "most": 1.0}


def rows():
    r = random.Random(6)
    out = [("ties", float(r.randrange(3))) for _ in range(2000)]
    out += [("signs", r.choice([-1, 1]) * 10 ** r.uniform(-300, 300)) for _ in range(700)]
    out += [("near", 1.0 + r.random() * 1e-9) for _ in range(500)] + [(None, r.gauss(0, 1)) for _ in range(301)]
    out += [("ends", x) for x in (float("inf"), float("-inf"), 0.0, -0.0, 5e-324, -5e-324, 1.7e308)]
    return out + [("one", 7.0), ("two", 1.0), ("two", 2.0), ("none", None), ("ties", None)]


def test_agrees_with_gathered(spark):
    df = spark.createDataFrame(rows(), "key string, x double").repartition(5)
    for keys in (["key"], []):
        got = {r[0] if keys else 0: tuple(r[len(keys) :]) for r in exact_percentiles(df, keys, F.col("x"), FRACTIONS).collect()}
        plain = df.groupBy(*keys).agg(*[F.percentile("x", p).alias(n) for n, p in FRACTIONS.items()]).filter("half IS NOT NULL")
        want = {r[0] if keys else 0: tuple(r[len(keys) :]) for r in plain.collect()}
        assert {k: (got.get(k), v) for k, v in want.items() if got.get(k) != v} == {} and len(got) == (7 if keys else 1)


def test_no_values(spark):
    df = spark.createDataFrame([("a", None)], "key string, x double")
    assert exact_percentiles(df, ["key"], F.col("x"), FRACTIONS).collect() == [] and exact_percentiles(df, [], F.col("x"), FRACTIONS).collect() == []


def test_in_queries(spark):
    """Beside other aggregates, over two fields, for groups without values, and for an empty table."""
    df = spark.createDataFrame(
        [(i, k, x, float(i)) for i, (k, x) in enumerate(rows())] + [(9999, "none", float("nan"), None)], "at long, key string, x double, y double"
    ).withColumn("at", F.timestamp_seconds("at"))
    for table in (df, df.limit(0)):
        e = Engine(spark)
        e.register(Measurement("m", "at", ("key",), ("x", "y")), table)
        ask = QueryBuilder("m").aggregate("p50", "x", "a").aggregate("count", "*", "n").aggregate("p95", "y", "b").aggregate("p1", "x", "c")
        x = F.when(~F.isnan("x"), F.col("x"))
        plain = [F.percentile(x, 0.5).alias("a"), F.count("*").alias("n"), F.percentile("y", 0.95).alias("b"), F.percentile(x, 0.01).alias("c")]
        for got, want in ((e.query(ask.group_by("key").build()), table.groupBy("key").agg(*plain)), (e.query(QueryBuilder("m").aggregate("p50", "x", "a").build()), table.agg(plain[0]))):
            assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
