"""Queries over the sample tables, one per operator, each with the SQL that must agree.

Averages, deviations and percentiles are rounded on both sides, as engines add in other orders.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import And, Frame, Measurement, Not, Or, QueryBuilder, Tag, WindowCall
from .operators import series as series_ops
from .operators.windows import apply_window
from .plans.engine import Engine
from .scratch import new_path
from .sources import line_protocol
from .sources.tables import without_existing
from .streaming import continuous
from .streaming.downsample import Rollup
from .streaming.retention import Policy, Tiers, policy_for, retained
from .streaming.sharding import shard_column

EVENTS = Measurement("events", "ts", ("event_type", "user_id"), ("value", "props"), ("event_id",))
ORDERS = Measurement("orders", "o_orderdate", ("o_orderstatus", "o_orderpriority"), ("o_totalprice",), ("o_orderkey",))
LINES = Measurement("lineitem", "l_shipdate", ("l_returnflag", "l_linestatus"), ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey"))
START, END = "2024-01-05", "2024-01-12"
NOW = datetime(2024, 2, 1)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str, measurements: tuple[Measurement, ...] = (EVENTS, ORDERS, LINES)) -> Engine:
    e = Engine(spark)
    for m in measurements:
        e.register(m, spark.read.parquet(f"{sf_dir}/{m.name}.parquet"))
    return e


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _add(name: str, sql: str | None, build: Callable[[Engine], DataFrame]) -> None:
    # Only the tables that the query names are opened.
    needed = tuple(m for m in (EVENTS, ORDERS, LINES) if m.name in (sql or EVENTS.name))
    QUERIES[name] = lambda spark, sf_dir: build(engine(spark, sf_dir, needed))
    if sql:
        ORACLE_SQL[name] = sql


def _built(name: str, sql: str, q: QueryBuilder, digits: int | None = None, *names: str) -> None:
    _add(name, sql, lambda e: e.query(q.build()) if digits is None else _rounded(e.query(q.build()), digits, *names))


def events() -> QueryBuilder:
    return QueryBuilder("events")


_E = "SELECT ts AS time, event_type, user_id::VARCHAR AS user_id, value, event_id, props FROM events"
_COLS = "time, event_type, user_id, value, props"
_HOUR = "time_bucket(INTERVAL '1 hour', ts)"
_BETWEEN = f"ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}'"

# --- scans and projections
_built("scan_all", f"SELECT {_COLS} FROM ({_E})", events())
_built("select_fields", f"SELECT time, event_type, user_id, value FROM ({_E})", events().select("value"))
_built("time_range", f"SELECT {_COLS} FROM ({_E}) WHERE time >= TIMESTAMP '{START}' AND time < TIMESTAMP '{END}'", events().between(START, END))

# --- filters
for _name, _filter, _where in (
    ("tag_eq", Tag("event_type", "eq", "click"), "event_type = 'click'"),
    ("tag_neq", Tag("event_type", "ne", "click"), "event_type IS DISTINCT FROM 'click'"),
    ("tag_in", Tag("event_type", "in", ("click", "view")), "event_type IN ('click', 'view')"),
    ("tag_not_in", Tag("event_type", "not_in", ("click", "view")), "event_type IS NULL OR event_type NOT IN ('click', 'view')"),
    ("tag_regex", Tag("event_type", "regex", "^(cl|er)"), "regexp_matches(event_type, '^(cl|er)')"),
    ("tag_exists", Tag("event_type", "exists"), "event_type IS NOT NULL"),
    ("filter_and_or", And((Or((Tag("event_type", "eq", "click"), Tag("event_type", "eq", "error"))), Tag("user_id", "in", ("1", "2", "3")))), "(event_type = 'click' OR event_type = 'error') AND user_id IN ('1', '2', '3')"),
    ("filter_not", Not(Tag("event_type", "in", ("click", "view"))), "NOT coalesce(event_type IN ('click', 'view'), FALSE)"),
):
    _built(_name, f"SELECT {_COLS} FROM ({_E}) WHERE {_where}", events().where(_filter))
_add("json_filter", f"SELECT {_COLS} FROM ({_E}) WHERE time >= TIMESTAMP '{START}' AND (event_type = 'error' OR user_id <> '7') AND NOT regexp_matches(event_type, 'sign')", lambda e: e.query({
    "measurement": "events", "time_range": {"start": START}, "filter": {"and": [{"or": [{"tag": "event_type", "op": "eq", "value": "error"}, {"tag": "user_id", "op": "neq", "value": "7"}]}, {"not": {"tag": "event_type", "op": "regex", "value": "sign"}}]},
}))
_add("field_predicate", f"SELECT time, value FROM ({_E}) WHERE value BETWEEN 2 AND 5 AND props LIKE '%1%' AND event_type = 'view'", lambda e: e.sql("SELECT time, value FROM events WHERE value BETWEEN 2 AND 5 AND props LIKE '%1%' AND event_type = 'view'"))

# --- aggregates
_STD = "CASE WHEN count(value) = 1 THEN 0.0 ELSE stddev_samp(value) END"
_VAR = "CASE WHEN count(value) = 1 THEN 0.0 ELSE var_samp(value) END"
_AGGREGATES = (
    ("count_star", "count", "*", "count(*)", None), ("count_field", "count", "value", "count(value)", None), ("sum", "sum", "value", "sum(value)", 6), ("mean", "mean", "value", "avg(value)", 8),
    ("min", "min", "value", "min(value)", None), ("max", "max", "value", "max(value)", None), ("first", "first", "value", "arg_min(value, (ts, event_id))", None),
    ("last", "last", "value", "arg_max(value, (ts, event_id))", None), ("stddev", "stddev", "value", _STD, 6), ("variance", "variance", "value", _VAR, 7),
    ("percentile_50", "p50", "value", "quantile_cont(value, 0.5)", 6), ("percentile_95", "percentile_95", "value", "quantile_cont(value, 0.95)", 6),
)
for _name, _function, _field, _sql, _digits in _AGGREGATES:
    _expr = _sql if _digits is None else f"round({_sql}, {_digits})"
    _one = lambda f=_function, c=_field: events().aggregate(f, c, "v")
    _built(_name, f"SELECT {_expr} AS v FROM events", _one(), _digits, "v")
    _built(f"{_name}_by_tag", f"SELECT event_type, {_expr} AS v FROM events GROUP BY 1", _one().group_by("event_type"), _digits, "v")
    _built(
        f"{_name}_by_bucket", f"SELECT {_HOUR} AS time, {_expr} AS v FROM events WHERE {_BETWEEN} GROUP BY 1", _one().between(START, END).every("1h"), _digits, "v"
    )
    _built(
        f"{_name}_by_bucket_tag", f"SELECT time_bucket(INTERVAL '1 day', ts) AS time, user_id::VARCHAR AS user_id, {_expr} AS v FROM events WHERE {_BETWEEN} GROUP BY 1, 2",
        _one().between(START, END).every("1d").group_by("user_id"), _digits, "v",
    )
_built("group_by_two_tags", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 8) AS q FROM lineitem GROUP BY 1, 2", QueryBuilder("lineitem").count("*", "n").mean("l_quantity", "q").group_by("l_returnflag", "l_linestatus"), 8, "q")
ORACLE_SQL["multi_agg_group"] = f"SELECT event_type, count(*) AS n, round(sum(value), 6) AS s, round(avg(value), 8) AS a, min(value) AS lo, max(value) AS hi, round({_STD}, 6) AS sd FROM events GROUP BY 1"
QUERIES["multi_agg_group"] = lambda spark, sf_dir: _rounded(_rounded(engine(spark, sf_dir, (EVENTS,)).query(
    events().count("*", "n").aggregate("sum", "value", "s").mean("value", "a").aggregate("min", "value", "lo").aggregate("max", "value", "hi").aggregate("stddev", "value", "sd").group_by("event_type").build()
), 6, "s", "sd"), 8, "a")
_SQLS = {
    "having": ("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING n > 60", "SELECT user_id::VARCHAR AS user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 60"),
    "count_distinct": ("SELECT event_type, COUNT(DISTINCT user_id) AS n FROM events GROUP BY event_type", "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1"),
    "select_distinct": ("SELECT DISTINCT event_type, user_id FROM events", "SELECT DISTINCT event_type, user_id::VARCHAR AS user_id FROM events"),
}
for _name, (_ours, _theirs) in _SQLS.items():
    _add(_name, _theirs, lambda e, q=_ours: e.sql(q))

# --- buckets
_built("bucket_hour_avg", f"SELECT {_HOUR} AS time, round(avg(value), 8) AS v, count(*) AS n FROM events GROUP BY 1", events().mean("value", "v").count("*", "n").every("1h"), 8, "v")
_built(
    "bucket_by_tag", f"SELECT {_HOUR} AS time, event_type, round(avg(value), 8) AS v, count(*) AS n FROM events WHERE {_BETWEEN} AND event_type IN ('click', 'view') GROUP BY 1, 2",
    events().between(START, END).where_in("event_type", ["click", "view"]).mean("value", "v").count("*", "n").every("1h").group_by("event_type"), 8, "v",
)
_built("bucket_week_origin", "SELECT time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS time, count(*) AS n FROM events GROUP BY 1", events().count("*", "n").every("1w"))
_built(
    "bucket_range_anchored", "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2024-01-05 00:17:00') AS time, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:17:00' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1",
    events().between("2024-01-05 00:17:00", END).count("*", "n").every("1h"),
)
_GRID = f"SELECT unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}' - INTERVAL '1 minute', INTERVAL '10 minutes')) AS time"
_built(
    "bucket_count_gapfill", f"SELECT g.time, coalesce(n, 0) AS n FROM ({_GRID}) g LEFT JOIN (SELECT time_bucket(INTERVAL '10 minutes', ts) AS time, count(*) AS n FROM events WHERE {_BETWEEN} AND event_type = 'error' GROUP BY 1) x USING (time)",
    events().between(START, END).where_eq("event_type", "error").count("*", "n").every("10m", fill=True),
)
_built(
    "bucket_gapfill_by_tag", f"SELECT g.time, t.event_type, coalesce(n, 0) AS n, round(a, 8) AS a FROM ({_GRID}) g CROSS JOIN (SELECT DISTINCT event_type FROM events WHERE {_BETWEEN}) t LEFT JOIN "
    f"(SELECT time_bucket(INTERVAL '10 minutes', ts) AS time, event_type, count(*) AS n, avg(value) AS a FROM events WHERE {_BETWEEN} GROUP BY 1, 2) x ON x.time = g.time AND x.event_type = t.event_type",
    events().between(START, END).count("*", "n").mean("value", "a").group_by("event_type").every("10m", fill=True), 8, "a",
)
_built(
    "bucket_first_last", "SELECT time_bucket(INTERVAL '1 day', ts) AS time, event_type, arg_min(value, (ts, event_id)) AS f, arg_max(value, (ts, event_id)) AS l FROM events GROUP BY 1, 2",
    events().aggregate("first", "value", "f").aggregate("last", "value", "l").every("1d").group_by("event_type"),
)

# --- windows
_USER, _TIME, _TYPE = ("user_id",), (("time", True), ("event_id", True)), ("event_type",)
_OVER = "PARTITION BY user_id ORDER BY ts, event_id"


def _window(name: str, sql: str, call: WindowCall, digits: int | None = None) -> None:
    def build(e: Engine) -> DataFrame:
        m, df = e.catalog.get("events")
        out = apply_window(df, call).select("event_id", call.name)
        return out if digits is None else _rounded(out, digits, call.name)

    _add(name, f"SELECT event_id, {sql} AS v FROM events", build)


_window("row_number", f"row_number() OVER ({_OVER})", WindowCall("row_number", partition_by=_USER, order_by=_TIME, alias="v"))
_window("dense_rank", "dense_rank() OVER (PARTITION BY event_type ORDER BY user_id::VARCHAR)", WindowCall("dense_rank", partition_by=_TYPE, order_by=(("user_id", True),), alias="v"))
_window("lag_default", f"lag(value, 2, -1.0) OVER ({_OVER})", WindowCall("lag", "value", _USER, _TIME, offset=2, default=-1.0, alias="v"))
_window("lead", f"lead(value) OVER ({_OVER})", WindowCall("lead", "value", _USER, _TIME, alias="v"))
_window("running_sum", f"round(sum(value) OVER ({_OVER} ROWS UNBOUNDED PRECEDING), 6)", WindowCall("sum", "value", _USER, _TIME, Frame("rows", None, 0), alias="v"), 6)
_window("moving_avg_3", f"round(avg(value) OVER ({_OVER} ROWS 2 PRECEDING), 8)", WindowCall("avg", "value", _USER, _TIME, Frame("rows", -2, 0), alias="v"), 8)
_window("frame_following", f"round(sum(value) OVER ({_OVER} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 6)", WindowCall("sum", "value", _USER, _TIME, Frame("rows", 1, 3), alias="v"), 6)
_window("frame_empty_count", f"count(value) OVER ({_OVER} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)", WindowCall("count", "value", _USER, _TIME, Frame("rows", -3, -1), alias="v"))
_window("partition_total", "round(sum(value) OVER (PARTITION BY event_type), 6)", WindowCall("sum", "value", _TYPE, alias="v"), 6)
_window("range_frame", "count(*) OVER (PARTITION BY event_type ORDER BY event_id RANGE BETWEEN 10 PRECEDING AND CURRENT ROW)", WindowCall("count", "*", _TYPE, (("event_id", True),), Frame("range", -10, 0), alias="v"))
_window("window_percentile", "round(quantile_cont(value, 0.5) OVER (PARTITION BY event_type), 6)", WindowCall("p50", "value", _TYPE, alias="v"), 6)
_window("window_first", f"first_value(value) OVER ({_OVER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)", WindowCall("first", "value", _USER, _TIME, Frame("rows", -2, 0), alias="v"))
_window("window_last", f"last_value(value) OVER ({_OVER} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)", WindowCall("last", "value", _USER, _TIME, Frame("rows", 0, 2), alias="v"))
_window("window_max", f"max(value) OVER ({_OVER} ROWS 4 PRECEDING)", WindowCall("max", "value", _USER, _TIME, Frame("rows", -4, 0), alias="v"))
_window("window_stddev", "round(CASE WHEN count(value) OVER w = 1 THEN 0.0 ELSE stddev_samp(value) OVER w END, 6)", WindowCall("stddev", "value", _USER, _TIME, Frame("rows", -2, 0), alias="v"), 6)
ORACLE_SQL["window_stddev"] += f" WINDOW w AS ({_OVER} ROWS 2 PRECEDING)"


def _rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = engine(spark, sf_dir, (EVENTS,)).catalog.get("events")[1].withColumn("floor_value", F.floor("value"))
    return apply_window(df, WindowCall("rank", partition_by=_TYPE, order_by=(("floor_value", True),), alias="v")).select("event_id", "v")


QUERIES["rank"] = _rank
ORACLE_SQL["rank"] = "SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY floor(value)) AS v FROM events"
_add(
    "window_sql", "SELECT event_id, round(sum(value) OVER w, 6) AS s, first_value(value) OVER w AS f, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)",
    lambda e: e.sql(
        "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY time, event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 6) AS s, "
        "first(value) OVER (PARTITION BY user_id ORDER BY time, event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS f, CAST(row_number() OVER (PARTITION BY user_id ORDER BY time, event_id) AS BIGINT) AS r FROM events"
    ),
)

# --- order and limit
_built("topk_time_desc", f"SELECT {_COLS} FROM ({_E}) ORDER BY time DESC, event_id LIMIT 100", events().order_by("time", False).limit(100))
_built("topk_time_asc", f"SELECT {_COLS} FROM ({_E}) WHERE event_type = 'view' ORDER BY time, event_id LIMIT 100", events().where_eq("event_type", "view").limit(100))
_built("order_by_field", f"SELECT {_COLS} FROM ({_E}) ORDER BY value DESC, event_id LIMIT 50", events().order_by("value", False).limit(50))
_built("limit_offset", f"SELECT {_COLS} FROM ({_E}) ORDER BY time, event_id LIMIT 20 OFFSET 30", events().order_by("time").limit(20, 30))
_built("grouped_topk", "SELECT user_id::VARCHAR AS user_id, round(sum(value), 6) AS s FROM events GROUP BY 1 ORDER BY sum(value) DESC LIMIT 10", events().aggregate("sum", "value", "s").group_by("user_id").order_by("s", False).limit(10), 6, "s")

# --- metadata
_add("tag_keys", "SELECT unnest(['event_type', 'user_id']) AS tag, unnest([count(event_type), count(user_id)]) AS rows FROM events", lambda e: e.tag_keys("events"))
_add("tag_values", "SELECT user_id::VARCHAR AS value, count(*) AS rows FROM events WHERE user_id IS NOT NULL GROUP BY 1", lambda e: e.tag_values("events", "user_id"))
_add("series_cardinality", "SELECT count(*) AS series_count FROM (SELECT DISTINCT event_type, user_id FROM events)", lambda e: series_ops.series_cardinality(e.catalog.get("events")[1], EVENTS))
_add("series_first_last_seen", "SELECT event_type, user_id::VARCHAR AS user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS points FROM events GROUP BY 1, 2", lambda e: e.series("events").drop("series_id"))
for _how, _where in (("all", "event_type = 'click' AND user_id = 3"), ("any", "event_type = 'click' OR user_id = 3"), ("none", "NOT (event_type = 'click' OR user_id = 3)")):
    _add(f"find_series_{_how}", f"SELECT DISTINCT event_type, user_id::VARCHAR AS user_id FROM events WHERE {_where}", lambda e, h=_how: series_ops.find_series(e.catalog.get("events")[1], EVENTS, [("event_type", "click"), ("user_id", "3")], h))
_add("show_tables", "SELECT unnest(['events', 'lineitem', 'orders']) AS name", lambda e: e.sql("SHOW TABLES"))
_add("information_schema_columns", "SELECT unnest(['time', 'o_orderstatus', 'o_orderpriority', 'o_totalprice', 'o_orderkey']) AS column_name", lambda e: e.sql("SELECT column_name FROM information_schema.columns WHERE table_name = 'orders'"))
_add("stats", "SELECT 'events' AS measurement, count(*) AS rows, count(DISTINCT (event_type, user_id)) AS series, min(ts) AS first, max(ts) AS last FROM events", lambda e: e.stats().filter("measurement = 'events'"))

# --- ingest


def _dedup(e: Engine) -> DataFrame:
    df = e.catalog.get("orders")[1]
    return without_existing(df, df.filter("o_orderstatus = 'F'"), ["o_orderkey"]).select("o_orderkey", "o_totalprice")


def _roundtrip(e: Engine) -> DataFrame:
    m, df = e.catalog.get("events")
    parsed = line_protocol.parse(line_protocol.export(df, Measurement(m.name, "time", m.tags, ("value", "props", "event_id"))))
    return line_protocol.measurement(parsed, "events")[1].select("time", "event_type", "user_id", "value", "props", "event_id")


_add("import_dedup_left_anti", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F'", _dedup)
_add("line_protocol_roundtrip", f"SELECT time, event_type, user_id, value, props, event_id FROM ({_E})", _roundtrip)

# --- lifecycle
_ROLLUP = Rollup.of("events", "events_1h", "1h", ("event_type",)).add("value", "mean").add("value", "min").add("value", "max").add("value", "count")
_ROLL_SQL = f"SELECT {_HOUR} AS time, event_type, round(avg(value), 8) AS value, min(value) AS value_min, max(value) AS value_max, count(value) AS value_count FROM events"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup as a stream of the table's files, run to the end, read back from the newest revisions."""
    source = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "*.parquet").parquet(_folder(spark, sf_dir))
    root = new_path(spark, "stream")
    q = continuous.start(_ROLLUP, EVENTS.mark(source), EVENTS, f"{root}/sink", f"{root}/state")
    q.awaitTermination()
    return _rounded(continuous.latest(spark, _ROLLUP, f"{root}/sink"), 8, "value")


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """A stream reads folders: the table's own, or a link-free copy where the table is one file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return f"{sf_dir}/events.parquet" if fs.getFileStatus(path).isDirectory() else f"{sf_dir}/event[s].parquet"


_add("downsample_hourly", f"{_ROLL_SQL} GROUP BY 1, 2", lambda e: _rounded(_ROLLUP.apply(e.catalog.get("events")[1], EVENTS), 8, "value"))


def _increments(e: Engine) -> DataFrame:
    registry = continuous.Registry()
    registry.register(continuous.Continuous("hourly", _ROLLUP))
    df = e.catalog.get("events")[1]
    parts = [registry.increment("hourly", df, EVENTS, now) for now in (datetime(2024, 1, 10, 5, 30), datetime(2024, 1, 20), NOW)]
    return _rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), 8, "value")


_add("continuous_aggregate_batch", f"{_ROLL_SQL} WHERE ts < TIMESTAMP '2024-02-01' GROUP BY 1, 2", _increments)
QUERIES["continuous_aggregate_stream"] = _stream
ORACLE_SQL["continuous_aggregate_stream"] = f"{_ROLL_SQL} GROUP BY 1, 2"
_POLICIES = [Policy.of("all", "*", "60d"), Policy.of("events", "ev*", "20d"), Policy.of("long", "event*", "14d")]
_add("retention_cutoff", "SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL '14 days'", lambda e: retained(e.catalog.get("events")[1], policy_for(_POLICIES, "events"), NOW).select("event_id", "value"))
_add(
    "tier_assignment", "SELECT CASE WHEN ts <= TIMESTAMP '2024-02-01' - INTERVAL '30 days' THEN 'cold' WHEN ts <= TIMESTAMP '2024-02-01' - INTERVAL '7 days' THEN 'warm' ELSE 'hot' END AS tier, count(*) AS n FROM events GROUP BY 1",
    lambda e: e.catalog.get("events")[1].groupBy(Tiers().column(F.col("time"), NOW).alias("tier")).agg(F.count("*").alias("n")),
)
_add("shard_by_time", "SELECT (floor(epoch_us(ts) / 86400000000)::BIGINT % 8) AS shard, count(*) AS n FROM events GROUP BY 1", lambda e: e.catalog.get("events")[1].groupBy(shard_column(EVENTS, "time", 8).alias("shard")).agg(F.count("*").alias("n")))
_add(
    "session_windows",
    "WITH x AS (SELECT ts, event_type, user_id, value, CASE WHEN ts >= lag(ts) OVER w + INTERVAL '12 hours' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts)), "
    "y AS (SELECT *, sum(new) OVER (PARTITION BY event_type, user_id ORDER BY ts) AS s FROM x) "
    "SELECT min(ts) AS time, max(ts) + INTERVAL '12 hours' AS \"end\", event_type, user_id::VARCHAR AS user_id, count(*) AS points, round(sum(value), 6) AS total FROM y GROUP BY event_type, y.user_id, s",
    lambda e: _rounded(continuous.sessions(e.catalog.get("events")[1], EVENTS, "12h", "value"), 6, "total"),
)

# --- the SQL front end: dashboards, alerts, histories, and analytic templates
_RECENT = "time > TIMESTAMP_NTZ '2024-01-20' - INTERVAL '5 days'"
_RECENT_SQL = "ts > TIMESTAMP '2024-01-20' - INTERVAL '5 days'"
_TEMPLATES = {
    "sql_dashboard_top": (f"SELECT user_id, MAX(value) AS top FROM events WHERE {_RECENT} GROUP BY user_id ORDER BY top DESC, user_id LIMIT 10", f"SELECT user_id::VARCHAR AS user_id, max(value) AS top FROM events WHERE {_RECENT_SQL} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    "sql_dashboard_summary": (f"SELECT event_type, round(AVERAGE(value), 8) AS a, COUNT(*) AS n FROM events WHERE {_RECENT} GROUP BY event_type", f"SELECT event_type, round(avg(value), 8) AS a, count(*) AS n FROM events WHERE {_RECENT_SQL} GROUP BY 1"),
    "sql_alert": (f"SELECT user_id, AVG(value) > 0 AS alarm, MIN(value) AS low FROM events WHERE {_RECENT} GROUP BY user_id HAVING low < 1", f"SELECT user_id::VARCHAR AS user_id, avg(value) > 0 AS alarm, min(value) AS low FROM events WHERE {_RECENT_SQL} GROUP BY 1 HAVING min(value) < 1"),
    "sql_history": ("SELECT time, value FROM public.events WHERE user_id = '7' AND _time > '2024-01-10' ORDER BY time", "SELECT ts AS time, value FROM events WHERE user_id = 7 AND ts > TIMESTAMP '2024-01-10'"),
    "sql_time_bucket": ("SELECT time_bucket('90 minutes', time) AS bucket, event_type, COUNT(*) AS n FROM events GROUP BY bucket, event_type", "SELECT time_bucket(INTERVAL '90 minutes', ts, TIMESTAMP '1970-01-01') AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "sql_first_last_percentile": ("SELECT event_type, FIRST(value) AS f, LAST(value) AS l, round(PERCENTILE_95(value), 6) AS p, round(STDDEV(value), 6) AS sd FROM events GROUP BY 1", "SELECT event_type, arg_min(value, ts) AS f, arg_max(value, ts) AS l, round(quantile_cont(value, 0.95), 6) AS p, round(stddev_samp(value), 6) AS sd FROM events GROUP BY 1"),
    "sql_limit_comma": ("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 5, 15", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 15 OFFSET 5"),
    "sql_default_order": ("SELECT event_id, time FROM events LIMIT 25", "SELECT event_id, ts AS time FROM events ORDER BY ts DESC LIMIT 25"),
    "sql_multi_agg": ("SELECT COUNT(*) AS n, round(SUM(l_extendedprice), 2) AS s, round(AVG(l_quantity), 8) AS a, MIN(l_discount) AS lo, MAX(l_tax) AS hi FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 30", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS s, round(avg(l_quantity), 8) AS a, min(l_discount) AS lo, max(l_tax) AS hi FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 30"),
    "sql_group_count_top": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus ORDER BY COUNT(*) DESC LIMIT 10", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2"),
    "sql_count_distinct": ("SELECT COUNT(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_returnflag = 'R'", "SELECT count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_returnflag = 'R'"),
    "sql_monthly_revenue": ("SELECT time_bucket('30d', time) AS bucket, l_linestatus, round(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY 1, 2", "SELECT time_bucket(INTERVAL '30 days', l_shipdate, TIMESTAMP '1970-01-01') AS bucket, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY 1, 2"),
    "sql_case_predicates": ("SELECT CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'small' END AS size, COUNT(*) AS n FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderstatus IN ('F', 'P') GROUP BY 1", "SELECT CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'small' END AS size, count(*) AS n FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderstatus IN ('F', 'P') GROUP BY 1"),
    "sql_subquery": ("WITH d AS (SELECT time_bucket('1d', time) AS day, COUNT(DISTINCT user_id) AS users FROM events GROUP BY 1) SELECT MAX(users) AS most, MIN(users) AS least FROM d", "WITH d AS (SELECT date_trunc('day', ts) AS day, count(DISTINCT user_id) AS users FROM events GROUP BY 1) SELECT max(users) AS most, min(users) AS least FROM d"),
}
for _name, (_ours, _theirs) in _TEMPLATES.items():
    _add(_name, _theirs, lambda e, q=_ours: e.sql(q))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly mean and count by event type over a week."""
    return QUERIES["bucket_by_tag"](spark, sf_dir)
