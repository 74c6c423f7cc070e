"""Workloads for tests and benchmarks: rows from hashes of row numbers, so always the same."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durations import micros
from ..model import Measurement


def _unit(*parts) -> Column:
    """A number in [0, 1) from the parts."""
    return (F.shiftrightunsigned(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), 11)).cast("double") / F.lit(float(2**53))


def _grid(spark: SparkSession, devices: int, steps: int, interval_s: int, end: datetime) -> DataFrame:
    first = micros(end) - (steps - 1) * interval_s * 1_000_000
    rows = spark.range(devices * steps)
    step = F.expr(f"id DIV {devices}")
    return rows.select(F.pmod("id", F.lit(devices)).alias("device"), step.alias("step"), F.timestamp_micros(F.lit(first) + step * interval_s * 1_000_000).cast("timestamp_ntz").alias("time"))


def device_metrics(spark: SparkSession, devices: int = 100, steps: int = 100, interval_s: int = 300, end: datetime = datetime(2025, 12, 24, 8, 13, 48)) -> tuple[Measurement, DataFrame]:
    """Endpoint metrics of devices: usage that swings by the hour, counters, and a field that only laptops have."""
    g = _grid(spark, devices, steps, interval_s, end)
    hour = F.hour(F.col("time"))
    kind = F.when(F.pmod("device", F.lit(3)) == 0, "desktop").when(F.pmod("device", F.lit(3)) == 1, "laptop").otherwise("virtual")
    noise = lambda salt: _unit(salt, F.col("device"), F.col("step"))
    rows = g.select(
        "time", F.md5(F.col("device").cast("string")).alias("devicesysid_k"), kind.alias("type_k"),
        F.round(30 + 20 * F.sin(hour / 24.0 * 6.283185307) + 40 * noise("cpu"), 2).alias("em_device_cpu_usage"), F.round(20 + 70 * noise("mem"), 2).alias("em_page_file_usage"),
        (F.col("step") * interval_s).cast("bigint").alias("em_device_uptime"), F.when(noise("crash") < 0.01, 1).otherwise(0).cast("bigint").alias("em_device_crashes"),
        F.when(kind == "laptop", F.round(100 * noise("battery"), 1)).alias("battery_pct"),
    )
    fields = ("em_device_cpu_usage", "em_page_file_usage", "em_device_uptime", "em_device_crashes", "battery_pct")
    return Measurement("em_device_metrics", "time", ("devicesysid_k", "type_k"), fields), rows


def network_health(spark: SparkSession, devices: int = 100, steps: int = 100, interval_s: int = 60, end: datetime = datetime(2025, 12, 24, 8, 13, 48)) -> tuple[Measurement, DataFrame]:
    g = _grid(spark, devices, steps, interval_s, end)
    noise = lambda salt: _unit(salt, F.col("device"), F.col("step"))
    kind = F.element_at(F.array(F.lit("wifi"), F.lit("ethernet"), F.lit("vpn")), (F.pmod("device", F.lit(3)) + 1).cast("int"))
    rows = g.select(
        "time", F.format_string("dev-%05d", "device").alias("device_id"), kind.alias("connection_type"), F.round(5 - 60 * F.log(1 - noise("latency")), 2).alias("latency_ms"),
        F.round(3 * F.pow(noise("loss"), F.lit(4.0)), 3).alias("packet_loss_pct"), F.when(kind == "wifi", (-90 + 60 * noise("signal")).cast("bigint")).alias("wifi_signal_dbm"),
    )
    return Measurement("network_health", "time", ("device_id", "connection_type"), ("latency_ms", "packet_loss_pct", "wifi_signal_dbm")), rows


APPS = ("mail", "browser", "editor", "chat", "calendar")
SITES = ("north", "south", "east", "west")


def app_performance(spark: SparkSession, devices: int = 100, steps: int = 100, interval_s: int = 60, end: datetime = datetime(2025, 12, 24, 8, 13, 48)) -> tuple[Measurement, DataFrame]:
    """One row per device, step and application; crashes are rare."""
    g = _grid(spark, devices, steps, interval_s, end).select("*", F.explode(F.array(*map(F.lit, APPS))).alias("application_name"))
    noise = lambda salt: _unit(salt, F.col("device"), F.col("step"), F.col("application_name"))
    rows = g.select(
        "time", F.format_string("dev-%05d", "device").alias("device_id"), "application_name", F.round(-200 * F.log(1 - noise("response")), 1).alias("response_time_ms"),
        F.round(100 - 5 * F.pow(noise("available"), F.lit(8.0)), 2).alias("availability_pct"), F.floor(3 * F.pow(noise("errors"), F.lit(6.0)) + 0.1).alias("error_count"),
        F.when(noise("crash") < 0.005, 1).otherwise(0).cast("bigint").alias("crash_count"),
    )
    return Measurement("app_performance", "time", ("device_id", "application_name"), ("response_time_ms", "availability_pct", "error_count", "crash_count")), rows


def experience_score(spark: SparkSession, devices: int = 100, steps: int = 100, interval_s: int = 300, end: datetime = datetime(2025, 12, 24, 8, 13, 48)) -> tuple[Measurement, DataFrame]:
    g = _grid(spark, devices, steps, interval_s, end)
    score = lambda salt: F.round(100 - 60 * F.pow(_unit(salt, F.col("device"), F.col("step")), F.lit(3.0)), 1)
    site = F.element_at(F.array(*map(F.lit, SITES)), (F.pmod("device", F.lit(len(SITES))) + 1).cast("int"))
    rows = g.select("time", F.format_string("dev-%05d", "device").alias("device_id"), site.alias("location"), score("device").alias("device_score"), score("app").alias("app_score"), score("network").alias("network_score"))
    rows = rows.withColumn("overall_score", F.round((F.col("device_score") + F.col("app_score") + F.col("network_score")) / 3, 2))
    return Measurement("experience_score", "time", ("device_id", "location"), ("overall_score", "device_score", "app_score", "network_score")), rows


def battery(spark: SparkSession, devices: int = 100, steps: int = 100, interval_s: int = 300, end: datetime = datetime(2025, 12, 24, 8, 13, 48)) -> tuple[Measurement, DataFrame]:
    """Charge falls over the day and comes back; only every third device has a battery."""
    g = _grid(spark, devices, steps, interval_s, end).filter(F.pmod("device", F.lit(3)) == 1)
    noise = _unit("battery", F.col("device"), F.col("step"))
    charge = F.round(100 - 100 * F.pmod((F.col("step") * interval_s + F.col("device") * 977).cast("double"), F.lit(36_000.0)) / 36_000, 1)
    rows = g.select(
        "time", F.md5(F.col("device").cast("string")).alias("devicesysid_k"), F.lit("0").alias("batteryid_k"), charge.alias("charge_level"), F.round(25 + 15 * noise, 1).alias("temperature"),
        (F.lit(100) + F.expr("step DIV 100")).alias("cycle_count"),
    )
    return Measurement("em_device_metrics_battery", "time", ("devicesysid_k", "batteryid_k"), ("charge_level", "temperature", "cycle_count")), rows
