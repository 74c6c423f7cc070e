"""More queries with the SQL that must agree: ingest, tables on disk, the SQL front end's statements, and the generated workloads."""

from __future__ import annotations

import re
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import InvalidQuery
from .model import Frame, Measurement, WindowCall
from .operators.windows import apply_window
from .plans.engine import Engine
from .queries import _BETWEEN, _E, _OVER, _STD, _TIME, _USER, _VAR, END, EVENTS, START, engine, events
from .scratch import materialize, new_path
from .sources import line_protocol, parquet, tables, workloads
from .streaming import continuous
from .streaming.downsample import Rollup
from .streaming.retention import Policy, Tiers, enforce, move
from .streaming.sharding import acknowledgements, shard_column

QUERIES = {}
ORACLE_SQL = {}


def _add(name: str, sql: str):
    """Register a function of (session, folder) under ``name``."""

    def register(build):
        QUERIES[name] = build
        ORACLE_SQL[name] = sql
        return build

    return register


def _on_events(name: str, sql: str, build) -> None:
    _add(name, sql)(lambda spark, sf_dir: build(engine(spark, sf_dir, (EVENTS,))))


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- line protocol

# Lines of the format's own examples, and what each says.
_LINES = [
    ("cpu,host=server01 value=64.5 1609459200000000000", "cpu", "host=server01", "value=float:64.5", "1609459200000000000", ""),
    ("cpu,host=server01,region=us-west value=64.5,count=10i 1609459200000000000", "cpu", "host=server01,region=us-west", "count=integer:10,value=float:64.5", "1609459200000000000", ""),
    ("cpu value=1 5", "cpu", "", "value=float:1.0", "5", ""),
    ("m a=t,b=F,c=true,d=False 5", "m", "", "a=boolean:true,b=boolean:false,c=boolean:true,d=boolean:false", "5", ""),
    ('m s="hello, world",u=42u 5', "m", "", "s=string:hello, world,u=unsigned:42", "5", ""),
    (r"my\ cpu,my\ tag=a\,b\=c my\ field=-1.5e-3 -7", "my cpu", "my tag=a,b=c", "my field=float:-0.0015", "-7", ""),
    (r'm s="a \"quoted\" \\ text" 5', "m", "", r's=string:a "quoted" \ text', "5", ""),
    (r"m,t=a\\,u=b v=1 1", "m", "t=a\\,u=b", "v=float:1.0", "1", ""),
    ('m s="x\u0001y" 1', "m", "", "s=string:x\u0001y", "1", ""),
    ("# a comment", None, None, None, None, None), ("", None, None, None, None, None),
    ("cpu", "", "", "", "", "no fields"), (",host=a v=1", "", "", "", "", "empty measurement"), ("cpu,host v=1", "", "", "", "", "invalid tag"), ("cpu,host= v=1", "", "", "", "", "invalid tag"),
    ("cpu,a=1,a=2 v=1", "", "", "", "", "repeated tag"), ("cpu v", "", "", "", "", "invalid field"), ('cpu v="open', "", "", "", "", "invalid field"), ("cpu v=1,v=2", "", "", "", "", "repeated field"),
    ("cpu v=abc", "", "", "", "", "invalid value"), ("cpu v=99999999999999999999i", "", "", "", "", "invalid value"), ("cpu v=1 soon", "", "", "", "", "invalid timestamp"), ("cpu v=1 1 2", "", "", "", "", "more than three parts"),
]


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


@_add("line_protocol_parse", f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_quoted, r)) + ')' for r in _LINES if r[5] is not None)}) AS t(line, measurement, tags, fields, time_ns, error)")
def _parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = line_protocol.parse(_rows(spark, [(r[0],) for r in _LINES], "value string"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    tags = F.array_join(F.array_sort(F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    value = lambda v: F.coalesce(v["f"].cast("string"), v["i"].cast("string"), v["u"].cast("string"), v["s"], v["b"].cast("string"))
    fields = F.array_join(F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["kind"], F.lit(":"), value(e["value"])))), ",")
    return parsed.select("line", text(F.col("measurement")).alias("measurement"), text(tags).alias("tags"), text(fields).alias("fields"), text(F.col("time_ns")).alias("time_ns"), text(F.col("error")).alias("error"))


@_add("line_protocol_no_timestamp", "SELECT true AS recent, 1.0::DOUBLE AS v")
def _stamped_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = line_protocol.parse(_rows(spark, [("m v=1",)], "value string"))
    off = F.abs(F.col("time_ns") / 1e9 - F.unix_timestamp())
    return parsed.select((off < 3600).alias("recent"), F.col("fields")["v"]["f"].alias("v"))


@_add("line_protocol_export", f"SELECT concat('events,event_type=', event_type, ',user_id=', user_id, ' event_id=', event_id, 'i ', epoch_us(time) * 1000) AS value FROM ({_E})")
def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, df = engine(spark, sf_dir, (EVENTS,)).catalog.get("events")
    return line_protocol.export(df, Measurement(m.name, "time", m.tags, ("event_id",)))


def _lines_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, df = engine(spark, sf_dir, (EVENTS,)).catalog.get("events")
    return line_protocol.export(df, Measurement(m.name, "time", m.tags, ("value", "event_id")))


@_add("engine_write", "SELECT event_type, count(*) AS n, round(sum(value), 6) AS s, min(ts) AS first FROM events GROUP BY 1 UNION ALL SELECT 'rejected', 1, NULL, NULL")
def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, new_path(spark, "engine"))
    bad = e.write(_lines_of_events(spark, sf_dir).unionByName(_rows(spark, [("not a line",)], "value string")))
    good = e.sql("SELECT event_type, COUNT(*) AS n, round(SUM(value), 6) AS s, MIN(time) AS first FROM events GROUP BY event_type")
    return good.unionByName(bad.select(F.lit("rejected").alias("event_type"), F.lit(1).cast("bigint").alias("n"), F.lit(None).cast("double").alias("s"), F.lit(None).cast("timestamp_ntz").alias("first")))


# --- Parquet import

_UNIT_SQL = "SELECT '{u}' AS unit, event_id, make_timestamp(epoch_us(ts) // {k} * {k}) AS time, user_id::VARCHAR AS user_id, value FROM events"


@_add("parquet_import_units", " UNION ALL ".join(_UNIT_SQL.format(u=u, k=k) for u, k in (("s", 1_000_000), ("ms", 1000), ("us", 1), ("ns", 1))))
def _imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    df = engine(spark, sf_dir, (EVENTS,)).catalog.get("events")[1]
    micros = F.unix_micros(F.col("time").cast("timestamp"))
    for unit, ticks in (("s", F.floor(micros / 1_000_000).cast("bigint")), ("ms", F.floor(micros / 1000).cast("bigint")), ("us", micros), ("ns", micros * 1000)):
        _, path = materialize(df.select("event_id", ticks.alias("ts"), "user_id", "value"), "foreign")
        _, rows = parquet.import_parquet(spark, path, "events", ["user_id"], unit=unit)
        rows = rows.select(F.lit(unit).alias("unit"), "event_id", "time", "user_id", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


@_add("parquet_import_types", "SELECT event_id, ts AS time, (event_id % 100)::BIGINT AS small, (event_id / 2.0)::DOUBLE AS half, event_id % 2 = 0 AS even, event_type AS name FROM events")
def _coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = engine(spark, sf_dir, (EVENTS,)).catalog.get("events")[1]
    foreign = df.select(
        "event_id", "time", (F.col("event_id") % 100).cast("smallint").alias("small"), (F.col("event_id") / 2).cast("float").alias("half"), (F.col("event_id") % 2 == 0).alias("even"),
        F.col("event_type").alias("name"), F.array("event_id").alias("skipped"), F.current_date().alias("dropped"),
    )
    _, path = materialize(foreign, "foreign")
    return parquet.import_parquet(spark, path, "foreign")[1]


@_add("parquet_inspect", "SELECT unnest(['event_id', 'time', 'event_type', 'user_id', 'value', 'props']) AS \"column\", unnest(['bigint', 'timestamp_ntz', 'string', 'string', 'double', 'string']) AS type")
def _inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = engine(spark, sf_dir, (EVENTS,)).catalog.get("events")[1].select("event_id", "time", "event_type", "user_id", "value", "props")
    return parquet.inspect(spark, materialize(df.withColumn("event_id", F.col("event_id").cast("bigint")), "inspected")[1])


# --- tables on disk


def _table(spark: SparkSession, sf_dir: str, **how) -> tuple[Measurement, str]:
    """The events in two appends, the second with a column more."""
    _, df = engine(spark, sf_dir, (EVENTS,)).catalog.get("events")
    m, path = replace(EVENTS, time="time"), new_path(spark, "table")
    tables.append(df.filter("event_id % 2 = 0").drop("props"), m, path, **how)
    tables.append(df.filter("event_id % 2 = 1"), m, path, **how)
    return m, path


@_add("table_append", f"SELECT event_id, time, event_type, user_id, value, CASE WHEN event_id % 2 = 1 THEN props END AS props FROM ({_E})")
def _appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, path = _table(spark, sf_dir)
    return tables.open_table(spark, m, path)[1].select("event_id", "time", "event_type", "user_id", "value", "props")


@_add("table_partitions", "SELECT DISTINCT ts::DATE::VARCHAR AS date FROM events")
def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(d,) for d in tables.partitions(spark, _table(spark, sf_dir)[1])], "date string")


@_add("table_bloom_filter", f"SELECT time, value FROM ({_E}) WHERE user_id = '7'")
def _bloomed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, path = _table(spark, sf_dir, bloom=("user_id",))
    return tables.open_table(spark, m, path)[1].filter("user_id = '7'").select("time", "value")


@_add("table_pruned_by_date", f"SELECT count(*) AS n, true AS pruned FROM events WHERE {_BETWEEN}")
def _pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, path = _table(spark, sf_dir)
    e = Engine(spark)
    e.register(*tables.open_table(spark, m, path))
    q = events().between(START, END).count("*", "n").build()
    return e.query(q).withColumn("pruned", F.lit(bool(re.search(r"PartitionFilters: \[[^\]]*date", e.explain(q)))))


@_add("table_drop_before", "SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def _dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, path = _table(spark, sf_dir)
    tables.drop_before(spark, path, datetime(2024, 1, 20))
    return tables.open_table(spark, m, path)[1].select("event_id", "value")


@_add("retention_enforce", "SELECT event_id, value FROM events WHERE ts::DATE >= (TIMESTAMP '2024-02-01' - INTERVAL '14 days')::DATE")
def _enforced(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, df = engine(spark, sf_dir, (EVENTS,)).catalog.get("events")
    root = new_path(spark, "root")
    path = tables.path_of(root, "events")
    tables.append(df, m, path)
    enforce(spark, root, ["events"], [Policy.of("all", "*", "60d"), Policy.of("one", "event?", "14d"), Policy.of("other", "ev", "1d")], datetime(2024, 2, 1))
    return tables.open_table(spark, m, path)[1].select("event_id", "value")


_AGE = "date_diff('day', ts::DATE, DATE '2024-02-01') - 1"


@_add("tier_move", f"SELECT event_id, value, CASE WHEN {_AGE} >= 30 THEN 'cold' WHEN {_AGE} >= 7 THEN 'warm' ELSE 'hot' END AS tier FROM events")
def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two moves: the second finds rows that came late for dates that are in their tier already."""
    m, df = engine(spark, sf_dir, (EVENTS,)).catalog.get("events")
    root = new_path(spark, "tiers")
    now = datetime(2024, 2, 1)
    for part in ("event_id % 3 = 0", "event_id % 3 <> 0"):
        tables.append(df.filter(part), m, f"{root}/hot")
        move(spark, f"{root}/hot", {"warm": f"{root}/warm", "cold": f"{root}/cold"}, Tiers(), now)
    # Every date of the sample is before the hot tier's week, or isn't: an empty folder has no schema of its own.
    out, schema = None, df.schema
    for tier in ("hot", "warm", "cold"):
        folders = tables.partitions(spark, f"{root}/{tier}")
        rows = spark.read.schema(schema).parquet(f"{root}/{tier}") if folders else spark.createDataFrame([], schema)
        rows = rows.select("event_id", "value", F.lit(tier).alias("tier"))
        out = rows if out is None else out.unionByName(rows)
    return out


@_add("table_change_stream", f"SELECT event_id, event_type, value FROM ({_E})")
def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of a table's appends, run twice: the second run resumes after what the first has seen."""
    m, df = engine(spark, sf_dir, (EVENTS,)).catalog.get("events")
    path, out = new_path(spark, "table"), new_path(spark, "changes")
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        tables.append(df.filter(part), m, path)
        stream = tables.changes(spark, m, path, per_trigger=4).select("event_id", "event_type", "value")
        stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")


_ROLLUP = Rollup.of("events", "events_1d", "1d", ("event_type",)).add("value", "max").add("value", "count")


@_add("continuous_aggregate_late", "SELECT date_trunc('day', ts) AS time, event_type, max(value) AS value_max, count(value) AS value_count FROM events GROUP BY 1, 2")
def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several micro-batches, a restart between two runs, and rows of the second run that are late for the first's buckets."""
    m, df = engine(spark, sf_dir, (EVENTS,)).catalog.get("events")
    root = new_path(spark, "late")
    for part in ("event_id % 4 <> 1", "event_id % 4 = 1"):
        df.filter(part).repartition(3).write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
        continuous.start(_ROLLUP, source, m, f"{root}/sink", f"{root}/state", late="400 days").awaitTermination()
    return continuous.latest(spark, _ROLLUP, f"{root}/sink")


# --- default names, requests, windows

_NAMES = [("count", "*"), ("count", "value"), ("sum", "value"), ("avg", "value"), ("min", "value"), ("max", "value"), ("first", "value"), ("last", "value"), ("std_dev", "value"), ("var", "value"), ("p50", "value")]
_NAMED = (
    "count(*) AS count_count, count(value) AS value_count, round(sum(value), 6) AS value_sum, round(avg(value), 8) AS value_mean, min(value) AS value_min, max(value) AS value_max, "
    f"arg_min(value, (ts, event_id)) AS value_first, arg_max(value, (ts, event_id)) AS value_last, round({_STD}, 6) AS value_stddev, round({_VAR}, 6) AS value_variance, round(quantile_cont(value, 0.5), 6) AS \"value_percentile(50)\""
)


def _by_default(e: Engine) -> DataFrame:
    q = events().group_by("event_type")
    for function, field in _NAMES:
        q = q.aggregate(function, field)
    out = e.query(q.build())
    return out.select("event_type", *[F.round(F.col(f"`{c}`"), 8 if c == "value_mean" else 6).alias(c) if c.split("_")[1].split("(")[0] in ("sum", "mean", "stddev", "variance", "percentile") else F.col(c) for c in out.columns[1:]])


_on_events("aggregate_default_names", f"SELECT event_type, {_NAMED} FROM events GROUP BY 1", _by_default)
for _text, _interval in (("1h", "1 hour"), ("1d", "1 day"), ("30 minutes", "30 minutes"), ("2 weeks", "14 days")):
    _on_events(
        f"json_group_by_time_{_text.replace(' ', '_')}",
        f"SELECT time_bucket(INTERVAL '{_interval}', ts, TIMESTAMP '{START}') AS time, event_type, round(avg(value), 8) AS v FROM events WHERE {_BETWEEN} GROUP BY 1, 2",
        lambda e, t=_text: e.query({"measurement": "events", "time_range": {"start": START, "end": END}, "aggregate": {"field": "value", "function": "mean", "alias": "v"}, "group_by": ["event_type"], "group_by_time": t}).withColumn("v", F.round("v", 8)),
    )
_on_events(
    "bucket_every_second", f"SELECT count(*) AS buckets, sum(n)::BIGINT AS rows FROM (SELECT g.time, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}' - INTERVAL '1 second', INTERVAL '1 second')) AS time) g "
    f"LEFT JOIN (SELECT date_trunc('second', ts) AS time, count(*) AS n FROM events WHERE {_BETWEEN} GROUP BY 1) x USING (time))",
    lambda e: e.query(events().between(START, END).count("*", "n").every("1s", fill=True).build()).agg(F.count("*").alias("buckets"), F.sum("n").alias("rows")),
)
_on_events(
    "bucket_gapfill_two_tags",
    f"SELECT g.time, t.event_type, t.user_id::VARCHAR AS user_id, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}' - INTERVAL '1 minute', INTERVAL '1 day')) AS time) g CROSS JOIN (SELECT DISTINCT event_type, user_id FROM events WHERE {_BETWEEN}) t "
    f"LEFT JOIN (SELECT date_trunc('day', ts) AS time, event_type, user_id, count(*) AS n FROM events WHERE {_BETWEEN} GROUP BY 1, 2, 3) x ON x.time = g.time AND x.event_type = t.event_type AND x.user_id = t.user_id",
    lambda e: e.query(events().between(START, END).count("*", "n").group_by("event_type", "user_id").every("1d", fill=True).build()),
)
_on_events("total_rows", "SELECT count(*) AS total FROM events WHERE event_type = 'view'", lambda e: _rows(e.spark, [(e.total_rows(events().where_eq("event_type", "view").limit(5, 2).build()),)], "total bigint"))


def _window(name: str, sql: str, call: WindowCall, digits: int | None = None) -> None:
    def build(e: Engine) -> DataFrame:
        out = apply_window(e.catalog.get("events")[1], call).select("event_id", call.name)
        return out if digits is None else out.withColumn(call.name, F.round(call.name, digits))

    _on_events(name, f"SELECT event_id, {sql} AS {call.name} FROM events", build)


_window("window_min", f"min(value) OVER ({_OVER} ROWS 4 PRECEDING)", WindowCall("min", "value", _USER, _TIME, Frame("rows", -4, 0), alias="v"))
_window("window_default_alias", f"max(value) OVER ({_OVER} ROWS 1 PRECEDING)", WindowCall("max", "value", _USER, _TIME, Frame("rows", -1, 0)))
_window("window_variance", f"round(CASE WHEN count(value) OVER ({_OVER} ROWS 5 PRECEDING) = 1 THEN 0.0 ELSE var_samp(value) OVER ({_OVER} ROWS 5 PRECEDING) END, 6)", WindowCall("variance", "value", _USER, _TIME, Frame("rows", -5, 0), alias="v"), 6)

# --- statements of the SQL front end

_STATEMENTS = {
    "sql_now": ("SELECT COUNT(*) AS n FROM events WHERE time < now() AND time > now() - INTERVAL '36500 days'", "SELECT count(*) AS n FROM events"),
    "sql_version": (
        "SELECT version() AS v, current_database() AS d, current_schema ( ) AS s, 'version()' AS t, pg_backend_pid() AS p",
        "SELECT 'tidemark on Apache Spark' AS v, 'tidemark' AS d, 'public' AS s, 'version()' AS t, 1 AS p",
    ),
    "sql_set": ("SET search_path TO public", "SELECT '' AS result WHERE false"),
    "sql_show_setting": ("SHOW server_version", "SELECT '16.0' AS server_version"),
    "sql_show_setting_unknown": ("SHOW no_such_thing", "SELECT '' AS no_such_thing"),
    "sql_pg_class": (
        "SELECT c.relname, n.nspname, c.relkind FROM pg_catalog.pg_class c JOIN pg_catalog.pg_namespace n ON c.relnamespace = n.oid", "SELECT 'events' AS relname, 'public' AS nspname, 'r' AS relkind"
    ),
    "sql_pg_attribute": (
        "SELECT a.attname, t.typname FROM pg_attribute a JOIN pg_catalog.pg_type t ON a.atttypid = t.oid JOIN pg_class c ON c.oid = a.attrelid WHERE c.relname = 'events' AND a.attname IN ('time', 'value', 'event_type')",
        "SELECT unnest(['time', 'value', 'event_type']) AS attname, unnest(['timestamp without time zone', 'double precision', 'text']) AS typname",
    ),
    "sql_pg_settings": ("SELECT setting FROM pg_catalog.pg_settings WHERE name = 'TimeZone'", "SELECT 'UTC' AS setting"),
    "sql_information_schema_tables": ("SELECT table_schema, table_name, table_type FROM information_schema.tables", "SELECT 'public' AS table_schema, 'events' AS table_name, 'BASE TABLE' AS table_type"),
    "sql_semicolon": ("SELECT COUNT(*) AS n FROM events ; ", "SELECT count(*) AS n FROM events"),
    "sql_bucket_alias": ("SELECT time_bucket('1 day', time) AS day, COUNT(*) AS n FROM public.events GROUP BY day ORDER BY day", "SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1"),
    "sql_default_names": ("SELECT event_type, COUNT(*) AS \"count(*)\", MAX(value) AS \"max(value)\" FROM events GROUP BY event_type", "SELECT event_type, count(*) AS \"count(*)\", max(value) AS \"max(value)\" FROM events GROUP BY 1"),
    "sql_raw_nanoseconds": (
        "SELECT COUNT(*) AS n FROM events WHERE time >= timestamp_micros(1704844800000000000 DIV 1000)", "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10'"
    ),
}
for _name, (_ours, _theirs) in _STATEMENTS.items():
    _on_events(_name, _theirs, lambda e, q=_ours: e.sql(q))


def _refused(e: Engine) -> DataFrame:
    """Statements that must be errors, and whether each is."""
    out = []
    for text in ("SELECT 1; SELECT 2", "", "DROP TABLE events", "EXPLAIN ANALYZE SELECT 1", "INSERT INTO events VALUES (1)", "SELECT percentile_101(value) FROM events"):
        try:
            e.sql(text)
            out.append((text, False))
        except InvalidQuery:
            out.append((text, True))
    return _rows(e.spark, out, "statement string, refused boolean")


_on_events("sql_refused", "SELECT unnest(['SELECT 1; SELECT 2', '', 'DROP TABLE events', 'EXPLAIN ANALYZE SELECT 1', 'INSERT INTO events VALUES (1)', 'SELECT percentile_101(value) FROM events']) AS statement, true AS refused", _refused)


def _explained(e: Engine) -> DataFrame:
    plan = e.sql("EXPLAIN SELECT event_type, SUM(value) AS s FROM events WHERE value > 5 GROUP BY event_type")
    has = lambda text: F.max(F.col("plan").contains(text))
    return plan.agg(has("PushedFilters: [IsNotNull(value), GreaterThan(value,5.0)]").alias("pushed"), has("ReadSchema: struct<event_type:string,value:double>").alias("pruned"), has("HashAggregate").alias("aggregated"))


_on_events("explain_properties", "SELECT true AS pushed, true AS pruned, true AS aggregated", _explained)


def _defined(e: Engine) -> DataFrame:
    e.define("tidemark_ratio", "a DOUBLE, b DOUBLE", "a / nullif(b, 0)")
    return e.sql("SELECT event_type, tidemark_ratio(SUM(value), COUNT(*)) AS r FROM events GROUP BY event_type").withColumn("r", F.round("r", 8))


_on_events("sql_function_hook", "SELECT event_type, round(sum(value) / count(*), 8) AS r FROM events GROUP BY 1", _defined)


# A pattern that isn't one matches nothing.
_on_events("tag_regex_invalid", "SELECT count(*) AS n FROM events WHERE false", lambda e: e.query(events().where_regex("event_type", "([").count("*", "n").build()))
_on_events(
    "filter_precedence", f"SELECT time, event_type, user_id, value, props FROM ({_E}) WHERE (event_type = 'error' OR event_type = 'click') AND user_id <> '3' AND event_type <> 'click'",
    lambda e: e.query({"measurement": "events", "filter": {"and": [{"or": [{"tag": "event_type", "op": "eq", "value": "error"}, {"tag": "event_type", "op": "eq", "value": "click"}]}, {"tag": "user_id", "op": "neq", "value": "3"}, {"not": {"tag": "event_type", "op": "eq", "value": "click"}}]}}),
)

# --- shards

_HEX = "('0x' || substr(md5({}), 1, 13))::BIGINT % 8"
_SERIES = "'events,event_type=' || event_type || ',user_id=' || user_id"
for _how, _key in (("series", _SERIES), ("composite", f"{_SERIES} || '@' || floor(epoch_us(ts) / 86400000000)::BIGINT"), ("measurement", "'events'")):
    _on_events(f"shard_by_{_how}", f"SELECT {_HEX.format(_key)} AS shard, count(*) AS n FROM events GROUP BY 1", lambda e, h=_how: e.catalog.get("events")[1].groupBy(shard_column(EVENTS, h, 8).alias("shard")).agg(F.count("*").alias("n")))


@_add("quorum", "SELECT * FROM (VALUES ('sync', 3, 3), ('quorum', 3, 2), ('quorum', 4, 3), ('quorum', 5, 3), ('async', 3, 0)) AS t(mode, replicas, needed)")
def _quorum(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [("sync", 3), ("quorum", 3), ("quorum", 4), ("quorum", 5), ("async", 3)]
    return _rows(spark, [(m, n, acknowledgements(m, n)) for m, n in cases], "mode string, replicas int, needed int")


# --- generated workloads


def _workload(name: str, w: workloads.Workload, ours: str, theirs: str | None = None) -> None:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark)
        e.register(w.measurement, w.rows(spark))
        return e.sql(ours)

    _add(name, f"WITH {w.name} AS ({w.duckdb()}) {theirs or ours}")(build)


_SINCE = "time >= '2025-12-24 06:13:48' AND time <= '2025-12-24 08:13:48'"
_HOURS = "time >= '2025-12-23 08:13:48' AND time <= '2025-12-24 08:13:48'"
_ONE = "devicesysid_k = 'dev-3'"
for _name, _w, _sql in (
    ("em_page_file_usage", workloads.DEVICES, f"SELECT time, em_page_file_usage FROM em_device_metrics WHERE {_SINCE} AND {_ONE} AND em_page_file_usage >= 0 AND type_k = 'device' ORDER BY time DESC"),
    ("em_wifi_rssi", workloads.DEVICES, f"SELECT time, em_wifi_rssi FROM em_device_metrics WHERE {_SINCE} AND {_ONE} AND type_k = 'device' ORDER BY time DESC"),
    ("em_active_devices", workloads.DEVICES, f"SELECT time, COUNT(DISTINCT devicesysid_k) AS n FROM em_device_metrics WHERE em_device_cpu_usage >= 0 AND {_HOURS} AND type_k = 'device' GROUP BY time ORDER BY time DESC"),
    ("em_device_energy", workloads.DEVICES, f"SELECT time, {', '.join(f.name for f in workloads.DEVICES.fields if 'energy' in f.name)} FROM em_device_metrics WHERE {_ONE} AND type_k = 'device' AND {_SINCE}"),
    ("em_device_raw", workloads.DEVICES, f"SELECT time, {', '.join(f.name for f in workloads.DEVICES.fields)} FROM em_device_metrics WHERE {_ONE} AND type_k = 'device' AND {_SINCE}"),
    ("em_device_hourly", workloads.DEVICES, f"SELECT time, round(AVG(em_device_cpu_usage), 8) AS cpu_avg, round(AVG(em_disk_time), 8) AS disk_avg, round(AVG(em_energy_consumption_total), 8) AS energy_avg, SUM(em_device_uptime)::BIGINT AS uptime_sum, SUM(em_device_crashes)::BIGINT AS crashes_sum FROM em_device_metrics WHERE {_ONE} AND type_k = 'device' AND {_HOURS} GROUP BY time ORDER BY time DESC LIMIT 100"),
    ("em_app_memory_raw", workloads.INSTALLED_APPS, f"SELECT time, em_installed_app_memory_usage FROM em_installed_app_metrics WHERE {_SINCE} AND appsysid_k = 'app-2' AND em_installed_app_memory_usage > 0 AND type_k = 'installed_app'"),
    ("em_top_memory", workloads.INSTALLED_APPS, f"SELECT round(AVG(em_installed_app_memory_usage), 8) AS maxvalue, appname_t, appversion_t FROM em_installed_app_metrics WHERE {_HOURS} AND type_k = 'installed_app' AND em_installed_app_memory_usage >= 0 GROUP BY appname_t, appversion_t ORDER BY maxvalue DESC LIMIT 10"),
    ("em_app_usage", workloads.INSTALLED_APPS, f"SELECT appsysid_k, appversion_t, round(SUM(em_installed_app_usage), 4) AS s, MAX(em_installed_app_last_access_time) AS last FROM em_installed_app_metrics WHERE appsysid_k IN ('app-1', 'app-2', 'app-3') AND em_installed_app_usage >= 0 AND {_SINCE} GROUP BY appsysid_k, appversion_t"),
    ("em_app_hourly", workloads.INSTALLED_APPS, f"SELECT time, round(AVG(em_installed_app_cpu_usage), 8) AS cpu_avg, round(SUM(em_installed_app_usage), 4) AS usage_sum, SUM(em_installed_app_crashes)::BIGINT AS crashes_sum, SUM(em_freezes)::BIGINT AS freezes_sum FROM em_installed_app_metrics WHERE appsysid_k = 'app-2' AND {_HOURS} GROUP BY time ORDER BY time DESC LIMIT 100"),
    ("em_web_app_usage", workloads.WEB_APPS, f"SELECT appsysid_k, round(SUM(em_web_app_usage), 4) AS s FROM em_web_app_metrics WHERE appsysid_k IN ('app-0', 'app-2', 'app-5') AND em_web_app_usage >= 0 AND {_SINCE} GROUP BY appsysid_k"),
    ("em_web_app_raw", workloads.WEB_APPS, f"SELECT time, em_availability, em_response_time, em_pageload_time, em_dns_lookup_time, em_session_length, em_session_count, em_page_view, em_web_app_usage, em_successful_web_requests, em_failed_web_requests, em_web_app_last_access_time FROM em_web_app_metrics WHERE {_ONE} AND type_k = 'web_app' AND {_SINCE}"),
    ("em_web_app_daily", workloads.WEB_APPS, "SELECT time, round(AVG(em_availability), 8) AS avail_avg, round(AVG(em_response_time), 8) AS resp_avg, SUM(em_failed_web_requests)::BIGINT AS failed_sum FROM em_web_app_metrics WHERE appsysid_k = 'app-2' AND time >= '2025-11-24 08:13:48' GROUP BY time ORDER BY time DESC LIMIT 100"),
    ("em_packet_loss", workloads.NETWORK, f"SELECT time, em_packet_loss, em_network_latency, em_jitter FROM em_network_monitoring_metrics WHERE {_SINCE} AND {_ONE} AND em_packet_loss >= 0 AND type_k = 'web_app'"),
    ("em_battery", workloads.BATTERIES, f"SELECT time, round(AVG(em_battery_charge_level), 8) AS level, batteryid_k FROM em_device_metrics_battery WHERE {_SINCE} AND type_k = 'device' AND em_battery_charge_level >= 0 GROUP BY batteryid_k, time ORDER BY time DESC"),
):
    _workload(_name, _w, _sql)

_TRIP = [
    "SELECT COUNT(*) AS n FROM trips", "SELECT COUNT(*) AS n FROM trips WHERE trip_miles > 0", "SELECT round(SUM(trip_miles), 2) AS s FROM trips", "SELECT round(AVG(base_passenger_fare), 8) AS a FROM trips",
    "SELECT COUNT(DISTINCT hvfhs_license_num) AS n FROM trips", "SELECT COUNT(DISTINCT PULocationID) AS n FROM trips", "SELECT MIN(trip_miles) AS lo, MAX(trip_miles) AS hi FROM trips",
    "SELECT COUNT(*) AS n FROM trips WHERE trip_miles >= 1 AND trip_miles <= 10", "SELECT COUNT(*) AS n FROM trips WHERE hvfhs_license_num = 'HV0003'", "SELECT COUNT(*) AS n FROM trips WHERE trip_miles > 5 AND base_passenger_fare > 20",
    "SELECT hvfhs_license_num, COUNT(*) AS n FROM trips GROUP BY hvfhs_license_num", "SELECT hvfhs_license_num, round(SUM(trip_miles), 2) AS s FROM trips GROUP BY hvfhs_license_num",
    "SELECT PULocationID AS p, round(AVG(base_passenger_fare), 8) AS a FROM trips GROUP BY PULocationID", "SELECT PULocationID AS p, COUNT(*) AS n FROM trips GROUP BY PULocationID ORDER BY COUNT(*) DESC, p LIMIT 10",
    "SELECT PULocationID AS p, round(SUM(trip_miles), 2) AS s FROM trips GROUP BY PULocationID ORDER BY SUM(trip_miles) DESC LIMIT 10",
    "SELECT COUNT(*) AS n, round(SUM(trip_miles), 2) AS s, round(AVG(base_passenger_fare), 8) AS a, MIN(tips) AS lo, MAX(driver_pay) AS hi FROM trips",
    "SELECT hvfhs_license_num, COUNT(*) AS n, round(SUM(trip_miles), 2) AS s, round(AVG(base_passenger_fare), 8) AS a FROM trips GROUP BY hvfhs_license_num",
    "SELECT PULocationID AS p, round(SUM(base_passenger_fare), 2) AS s FROM trips WHERE trip_miles > 0 GROUP BY PULocationID ORDER BY SUM(base_passenger_fare) DESC LIMIT 10",
    "SELECT DOLocationID AS d, COUNT(*) AS n FROM trips WHERE trip_time > 600 GROUP BY DOLocationID ORDER BY COUNT(*) DESC, d LIMIT 10", "SELECT hvfhs_license_num, PULocationID AS p, COUNT(*) AS n FROM trips GROUP BY hvfhs_license_num, PULocationID",
    "SELECT hvfhs_license_num, PULocationID AS p, COUNT(*) AS n FROM trips WHERE trip_miles > 5 GROUP BY hvfhs_license_num, PULocationID ORDER BY COUNT(*) DESC, p, hvfhs_license_num LIMIT 20",
    "SELECT round(SUM(base_passenger_fare), 2) AS s FROM trips WHERE hvfhs_license_num = 'HV0003' AND trip_miles > 2", "SELECT round(AVG(base_passenger_fare), 8) AS a, round(AVG(trip_miles), 8) AS m FROM trips WHERE trip_miles > 0",
    "SELECT COUNT(*) AS n FROM trips WHERE shared_request_flag = 'Y'", "SELECT COUNT(*) AS n FROM trips WHERE wav_match_flag = 'Y'", "SELECT dispatching_base_num AS b, COUNT(*) AS n FROM trips GROUP BY dispatching_base_num ORDER BY COUNT(*) DESC, b LIMIT 10",
    "SELECT PULocationID AS p, DOLocationID AS d, COUNT(*) AS n FROM trips GROUP BY PULocationID, DOLocationID ORDER BY COUNT(*) DESC, p, d LIMIT 20",
    "SELECT hvfhs_license_num, round(SUM(base_passenger_fare), 2) AS f, round(SUM(tips), 2) AS t, round(SUM(driver_pay), 2) AS y FROM trips WHERE trip_miles > 1 GROUP BY hvfhs_license_num",
    "SELECT COUNT(*) AS n, round(AVG(trip_miles), 8) AS m, round(AVG(trip_time), 8) AS t, round(AVG(base_passenger_fare), 8) AS f FROM trips WHERE trip_miles > 20",
    "SELECT COUNT(*) AS n, round(AVG(trip_miles), 8) AS m, round(AVG(trip_time), 8) AS t, round(AVG(base_passenger_fare), 8) AS f FROM trips WHERE trip_miles < 2",
    "SELECT COUNT(*) AS n, round(SUM(airport_fee), 2) AS s, round(AVG(airport_fee), 8) AS a FROM trips WHERE airport_fee > 0", "SELECT COUNT(*) AS n, round(SUM(congestion_surcharge), 2) AS s, round(AVG(congestion_surcharge), 8) AS a FROM trips WHERE congestion_surcharge > 0",
    "SELECT COUNT(*) AS n, round(SUM(tolls), 2) AS s, round(AVG(tolls), 8) AS a FROM trips WHERE tolls > 0", "SELECT hvfhs_license_num, round(SUM(tips), 2) AS s, round(AVG(tips), 8) AS a, COUNT(*) AS n FROM trips WHERE tips > 0 GROUP BY hvfhs_license_num",
    "SELECT MIN(driver_pay) AS lo, MAX(driver_pay) AS hi, round(AVG(driver_pay), 8) AS a, round(SUM(driver_pay), 2) AS s FROM trips", "SELECT round(SUM(bcf), 2) AS s, round(AVG(bcf), 8) AS a FROM trips WHERE bcf > 0", "SELECT round(SUM(sales_tax), 2) AS s, round(AVG(sales_tax), 8) AS a FROM trips WHERE sales_tax > 0",
    "SELECT PULocationID AS p, DOLocationID AS d, round(SUM(base_passenger_fare), 2) AS s, round(AVG(trip_miles), 8) AS m FROM trips GROUP BY PULocationID, DOLocationID ORDER BY SUM(base_passenger_fare) DESC, p, d LIMIT 20",
    "SELECT hvfhs_license_num, round(AVG(base_passenger_fare), 8) AS f, round(AVG(trip_time), 8) AS t FROM trips WHERE trip_time > 0 GROUP BY hvfhs_license_num", "SELECT COUNT(*) AS n, round(AVG(trip_miles), 8) AS m, round(AVG(base_passenger_fare), 8) AS f FROM trips WHERE access_a_ride_flag = 'Y'",
    "SELECT shared_match_flag, COUNT(*) AS n, round(AVG(trip_miles), 8) AS m, round(AVG(base_passenger_fare), 8) AS f FROM trips GROUP BY shared_match_flag", "SELECT time, trip_miles, tips FROM trips ORDER BY time DESC, trip_miles, tips LIMIT 10",
]
for _i, _sql in enumerate(_TRIP):
    _workload(f"trips_{_i:02}", workloads.TRIPS, _sql)
