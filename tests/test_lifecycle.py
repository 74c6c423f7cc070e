from datetime import datetime, timedelta

import pytest

from tidemark.errors import InvalidQuery
from tidemark.model import Measurement
from tidemark.sources import tables
from tidemark.streaming import continuous
from tidemark.streaming.downsample import Rollup
from tidemark.streaming.retention import Policy, Tiers, enforce, move, policy_for
from tidemark.streaming.sharding import acknowledgements, repartition_by_shard

CPU = Measurement("cpu", "time", ("host",), ("usage",))
ROLL = Rollup.of("cpu", "cpu_1h", "1h", ("host",)).add("usage", "mean").add("usage", "max").add("usage", "p50")
NOON = datetime(2024, 1, 1, 12)


def cpu(spark, n=10, step=20):
    return spark.createDataFrame([(datetime(2024, 1, 1) + timedelta(minutes=step * i), f"h{i % 2}", float(i)) for i in range(n)], "time timestamp_ntz, host string, usage double")


def test_rollup_names_and_duplicates():
    assert [o.name for o in ROLL.outputs] == ["usage", "usage_max", "usage_p50"]
    with pytest.raises(InvalidQuery):
        ROLL.add("usage", "max")
    with pytest.raises(InvalidQuery):
        Rollup.of("a", "b", "1h").apply(None, CPU)


def test_batch_rollup(spark):
    got = sorted(tuple(r) for r in ROLL.apply(cpu(spark, 4), CPU).collect())
    assert got == [(datetime(2024, 1, 1), "h0", 1.0, 2.0, 1.0), (datetime(2024, 1, 1), "h1", 1.0, 1.0, 1.0), (datetime(2024, 1, 1, 1), "h1", 3.0, 3.0, 3.0)]


def test_registry(spark):
    r = continuous.Registry()
    r.register(continuous.Continuous("c", ROLL))
    with pytest.raises(InvalidQuery):
        r.register(continuous.Continuous("c", ROLL))
    assert [c.name for c in r.pending(NOON)] == ["c"]
    first = r.increment("c", cpu(spark), CPU, datetime(2024, 1, 1, 1, 30))
    assert {x["time"] for x in first.collect()} == {datetime(2024, 1, 1)}
    assert r.get("c").processed == datetime(2024, 1, 1, 1)
    assert r.pending(datetime(2024, 1, 1, 1, 59)) == [] and r.pending(NOON)
    r.enable("c", False)
    assert r.pending(NOON) == []
    r.unregister("c")
    assert r.list() == []


def test_increments_equal_the_whole(spark):
    r, df = continuous.Registry(), cpu(spark, 30)
    r.register(continuous.Continuous("c", ROLL))
    a = r.increment("c", df, CPU, datetime(2024, 1, 1, 4, 10)).unionByName(r.increment("c", df, CPU, datetime(2024, 1, 2)))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, ROLL.apply(df, CPU).collect()))


def test_stream_with_late_rows(spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    df = cpu(spark, 12)
    df.filter("usage <> 3").coalesce(1).write.parquet(source)
    schema = df.schema

    def run():
        continuous.start(ROLL, spark.readStream.schema(schema).parquet(source), CPU, sink, state, late="1 day").awaitTermination()
        return sorted(map(tuple, continuous.latest(spark, ROLL, sink).collect()))

    assert run() == sorted(map(tuple, ROLL.apply(df.filter("usage <> 3"), CPU).collect()))
    df.filter("usage = 3").write.mode("append").parquet(source)
    assert run() == sorted(map(tuple, ROLL.apply(df, CPU).collect()))


def test_table_as_stream(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.append(cpu(spark), CPU, path)
    q = tables.changes(spark, CPU, path, 1).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("changes").count() == 10


def test_policies():
    ps = [Policy.of("a", "*", "1d"), Policy.of("b", "cpu*", "2d"), Policy.of("c", "cpu_?", "3d"), Policy.of("d", "mem", "4d")]
    assert [policy_for(ps, x).name for x in ("cpu", "cpu_1", "mem", "disk")] == ["b", "c", "d", "a"]
    assert policy_for(ps[1:], "disk") is None
    assert policy_for([Policy.of("x", "none", "1d", default=True)], "disk").name == "x"


def test_enforce_only_what_matches(spark, tmp_path):
    for name in ("cpu", "mem"):
        tables.append(cpu(spark), CPU, tables.path_of(str(tmp_path), name))
    gone = enforce(spark, str(tmp_path), ["cpu", "mem"], [Policy.of("p", "cpu", "1d")], datetime(2024, 2, 1))
    assert gone == {"cpu": ["2024-01-01"]}
    assert tables.partitions(spark, tables.path_of(str(tmp_path), "mem")) == ["2024-01-01"]


@pytest.mark.parametrize("days,tier", [(0, "hot"), (6, "hot"), (7, "warm"), (20, "warm"), (30, "cold"), (365, "cold")])
def test_tiers(days, tier):
    assert Tiers().of(timedelta(days=days)) == tier


def test_move(spark, tmp_path):
    source = str(tmp_path / "hot")
    tables.append(cpu(spark, 3, 15 * 24 * 60), CPU, source)
    moved = move(spark, source, {"warm": str(tmp_path / "warm"), "cold": str(tmp_path / "cold")}, Tiers(), datetime(2024, 2, 5))
    assert moved == {"2024-01-01": "cold", "2024-01-16": "warm"}
    assert tables.partitions(spark, source) == ["2024-01-31"] and spark.read.parquet(str(tmp_path / "cold")).count() == 1


def test_shards(spark):
    df = cpu(spark, 20)
    for how in ("measurement", "series", "time", "composite"):
        out = repartition_by_shard(df, CPU, how, 4)
        assert out.filter("shard < 0 or shard >= 4").count() == 0 and out.count() == 20
        if how == "series":
            assert out.select("host", "shard").distinct().count() == 2


def test_acknowledgements():
    assert [acknowledgements(m, n) for m, n in (("sync", 3), ("quorum", 3), ("quorum", 5), ("async", 3))] == [3, 2, 3, 0]


def test_sessions(spark):
    rows = [(datetime(2024, 1, 1, 0, m), "a", 1.0) for m in (0, 5, 40, 44)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, host string, usage double")
    got = sorted((r["points"], r["total"]) for r in continuous.sessions(df, CPU, "10m", "usage").collect())
    assert got == [(2, 2.0), (2, 2.0)]


def _tiers(tmp_path):
    return str(tmp_path / "hot"), {"warm": str(tmp_path / "warm"), "cold": str(tmp_path / "cold")}


def test_move_keeps_what_the_tier_has(spark, tmp_path):
    source, targets = _tiers(tmp_path)
    now = datetime(2024, 3, 5)
    for n in (1, 2):
        tables.append(cpu(spark, n), CPU, source)
        assert move(spark, source, targets, Tiers(), now) == {"2024-01-01": "cold"}
    assert sorted(r["usage"] for r in spark.read.parquet(targets["cold"]).collect()) == [0.0, 0.0, 1.0]


@pytest.mark.parametrize("stop", ["before the source is hidden", "hidden, not yet visible", "visible, not yet deleted"])
def test_move_stopped_half_way(spark, tmp_path, monkeypatch, stop):
    from tidemark.streaming import retention

    source, targets = _tiers(tmp_path)
    now = datetime(2024, 3, 5)
    tables.append(cpu(spark, 3), CPU, source)
    with monkeypatch.context() as m:
        if stop == "before the source is hidden":
            rewrite = retention._rewrite
            m.setattr(retention, "_rewrite", lambda *a: (rewrite(*a), 1 / 0))
        elif stop == "hidden, not yet visible":
            m.setattr(retention, "_finish", lambda *a: 1 / 0)
        else:
            finish = retention._finish

            def finish_but_leave_the_source(spark, source, *rest):
                kept = tmp_path / "kept"
                hidden = next((tmp_path / "hot").glob("_moving.*"))
                import shutil

                shutil.copytree(hidden, kept)
                finish(spark, source, *rest)
                shutil.copytree(kept, hidden)
                raise ZeroDivisionError

            m.setattr(retention, "_finish", finish_but_leave_the_source)
        with pytest.raises(ZeroDivisionError):
            move(spark, source, targets, Tiers(), now)
    move(spark, source, targets, Tiers(), now)
    assert tables.partitions(spark, source) == []
    assert sorted(r["usage"] for r in spark.read.parquet(targets["cold"]).collect()) == [0.0, 1.0, 2.0]


def test_append_refuses_another_type(spark, tmp_path):
    from tidemark.errors import ConflictingTypes

    path = str(tmp_path / "t")
    tables.append(cpu(spark), CPU, path)
    with pytest.raises(ConflictingTypes):
        tables.append(cpu(spark).selectExpr("time", "host", "CAST(usage AS STRING) AS usage"), CPU, path)
    assert tables.open_table(spark, CPU, path)[1].count() == 10


def test_no_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from tidemark.scratch import work_root

    session = lambda master, named: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: named), sparkContext=SimpleNamespace(master=master))
    assert work_root(session("local[8]", None)) == "/tmp/checkpoints" and work_root(session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(RuntimeError):
        work_root(session("yarn", None))
