"""The engine: measurements in, SQL, requests or queries out as DataFrames."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidQuery
from ..model import Measurement, Query
from ..operators import series as series_ops
from ..scratch import delete, materialize
from .catalog import Catalog
from .compiler import compile_query
from .dialect import one_statement, to_spark_sql
from .requests import query_from_request

# Answers to what clients ask on connecting.
_SYSTEM = {"version": "'tidemark on Apache Spark'", "current_schema": "'public'", "current_user": "'tidemark'", "session_user": "'tidemark'", "pg_backend_pid": "1", "inet_server_addr": "'127.0.0.1'", "inet_server_port": "5432"}


class Engine:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.catalog = Catalog(spark)
        self.root = root

    def register(self, m: Measurement, df: DataFrame) -> DataFrame:
        return self.catalog.register(m, df)

    # --- queries

    def query(self, request: Query | dict) -> DataFrame:
        q = request if isinstance(request, Query) else query_from_request(request)
        m, df = self.catalog.get(q.measurement)
        return compile_query(q, m, df)

    def total_rows(self, request: Query | dict) -> int:
        """Rows of the query without its LIMIT and OFFSET; counted only when asked for."""
        q = request if isinstance(request, Query) else query_from_request(request)
        return self.query(replace(q, limit=None, offset=0, order_by=())).count()

    def define(self, name: str, parameters: str, body: str, returns: str = "DOUBLE") -> None:
        """A SQL function for queries, which Catalyst inlines: ``define("ratio", "a DOUBLE, b DOUBLE", "a / nullif(b, 0)")``."""
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")

    def sql(self, text: str) -> DataFrame:
        """One statement: SELECT, SHOW TABLES, SHOW <setting>, SET, EXPLAIN SELECT."""
        words = [t for t in one_statement(text) if t.kind != "space"]
        first = words[0].text.lower()
        if first == "show":
            rest = " ".join(t.text for t in words[1:])
            if rest.lower() == "tables":
                return self.catalog.show_tables()
            return self.spark.createDataFrame([(self.catalog.setting(rest),)], f"`{rest.lower()}` string")
        if first == "set":
            return self.spark.createDataFrame([], "result string")
        if first == "explain":
            if words[1].word("analyze"):
                raise InvalidQuery("EXPLAIN ANALYZE isn't supported: it would run the query")
            plan = self.explain(re.sub(r"(?is)^\s*explain\s+", "", text))
            return self.spark.createDataFrame([(line,) for line in plan.splitlines()], "plan string")
        if first not in ("select", "with", "values", "("):
            raise InvalidQuery(f"{first.upper()} isn't supported")
        low = text.lower()
        if "information_schema" in low or "pg_" in low:
            self.catalog.publish()
        return self.spark.sql(to_spark_sql(text, {**_SYSTEM, "current_database": f"'{self.catalog.database}'"}))

    def explain(self, request: Query | dict | str, mode: str = "formatted") -> str:
        df = self.sql(request) if isinstance(request, str) else self.query(request)
        jvm = self.spark._jvm
        return df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    # --- writing

    def write(self, lines: DataFrame | list[str]) -> DataFrame:
        """Ingest line protocol: good lines are appended under the engine's root, bad ones returned with their error."""
        from ..sources import line_protocol, tables

        if self.root is None:
            raise InvalidQuery("writing needs an engine with a root folder")
        df = self.spark.createDataFrame([(x,) for x in lines], "value string") if isinstance(lines, list) else lines
        # Parsed once; a folder for each measurement, so that each is read by itself.
        parsed, folder = materialize(line_protocol.parse(df), "parsed-lines", "measurement")
        known = line_protocol.keys_of(parsed)
        for name, keys in sorted(known.items()):
            m, points = line_protocol.measurement(parsed, name, keys)
            path = tables.path_of(self.root, name)
            tables.append(points, m, path)
            self.register(*tables.open_table(self.spark, m, path))
        bad = parsed.filter("error IS NOT NULL").select("line", "error")
        bad, _ = materialize(bad, "rejected-lines")
        delete(self.spark, folder)
        return bad

    # --- what there is

    def stats(self) -> DataFrame:
        """Rows, series and time span of every measurement; one aggregation each."""
        out = None
        for name in self.catalog.names():
            m, df = self.catalog.get(name)
            key = F.struct(*m.tags) if m.tags else F.lit(1)
            one = df.agg(F.lit(name).alias("measurement"), F.count("*").alias("rows"), F.countDistinct(key).alias("series"), F.min("time").alias("first"), F.max("time").alias("last"))
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], "measurement string, rows bigint, series bigint, first timestamp_ntz, last timestamp_ntz")

    def tag_keys(self, name: str) -> DataFrame:
        m, df = self.catalog.get(name)
        return series_ops.tag_keys(df, m)

    def tag_values(self, name: str, tag: str) -> DataFrame:
        return series_ops.tag_values(self.catalog.get(name)[1], tag)

    def series(self, name: str) -> DataFrame:
        m, df = self.catalog.get(name)
        return series_ops.series(df, m)
