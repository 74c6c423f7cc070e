"""Workloads stated once, for Spark and for any engine with MD5: every value is a function of the row number.

A table is a list of columns; each column is drawn from the first 52 bits of an MD5 of its name
and the row number. ``rows`` gives the DataFrame, ``duckdb`` the same rows as SQL, so that
queries over them can be checked. Columns that a query doesn't name are never computed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidQuery
from ..model import Measurement

END = "2025-12-24 08:13:48"
_TWO52 = "4503599627370496E0"


@dataclass(frozen=True)
class Draw:
    """One column. ``kind``: decimal (hundredths between ``low`` and ``high``), whole, choice (of ``of``),
    or code (an identifier that starts with ``of[0]``, of ``high`` different ones). ``share``: of rows whose value isn't 0 or null."""

    name: str
    kind: str = "decimal"
    low: float = 0.0
    high: float = 100.0
    of: tuple[str, ...] = ()
    share: float = 1.0
    otherwise: str = "0"

    def sql(self, unit, row: str) -> str:
        u = unit(self.name, row)
        match self.kind:
            case "decimal":
                value = f"floor(({self.low!r}E0 + {self.high - self.low!r}E0 * {u}) * 100E0) / 100E0"
            case "whole":
                value = f"CAST(floor({self.low!r}E0 + {self.high - self.low + 1!r}E0 * {u}) AS BIGINT)"
            case "choice":
                value = f"split_part('{','.join(self.of)}', ',', CAST(floor({len(self.of)} * {u}) AS INT) + 1)"
            case "code":
                value = f"concat('{self.of[0]}', CAST(CAST(floor({self.high!r}E0 * {u}) AS BIGINT) AS VARCHAR(20)))"
            case _:
                raise InvalidQuery(f"unknown kind of column: {self.kind!r}")
        return value if self.share == 1.0 else f"CASE WHEN {unit(self.name + '?', row)} < {self.share!r}E0 THEN {value} ELSE {self.otherwise} END"


def _spark_unit(salt: str, row: str) -> str:
    return f"(CAST(conv(substring(md5(concat('{salt}:', CAST({row} AS STRING))), 1, 13), 16, 10) AS BIGINT) / {_TWO52})"


def _duckdb_unit(salt: str, row: str) -> str:
    return f"(('0x' || substr(md5('{salt}:' || CAST({row} AS VARCHAR)), 1, 13))::BIGINT / {_TWO52})"


@dataclass(frozen=True)
class Workload:
    """``tags`` are drawn by ``id % series``, ``fields`` by the row; every ``interval`` seconds each series has a row, the last at END."""

    name: str
    tags: tuple[Draw, ...]
    fields: tuple[Draw, ...]
    series: int = 40
    steps: int = 120
    interval: int = 300

    @property
    def measurement(self) -> Measurement:
        return Measurement(self.name, "time", tuple(t.name for t in self.tags), tuple(f.name for f in self.fields), ("row",))

    def _columns(self, unit) -> list[str]:
        member = f"(id % {self.series})"
        return [f"{t.sql(unit, member)} AS {t.name}" for t in self.tags] + [f"{f.sql(unit, 'id')} AS {f.name}" for f in self.fields]

    def rows(self, spark: SparkSession) -> DataFrame:
        back = f"make_dt_interval(0, 0, 0, CAST(({self.steps - 1} - id DIV {self.series}) * {self.interval} AS DECIMAL(18, 6)))"
        return spark.range(self.series * self.steps).selectExpr("id AS row", f"TIMESTAMP_NTZ'{END}' - {back} AS time", *self._columns(_spark_unit))

    def duckdb(self) -> str:
        time = f"TIMESTAMP '{END}' - to_seconds(({self.steps - 1} - id // {self.series}) * {self.interval})"
        return f"SELECT id AS row, {time} AS time, {', '.join(self._columns(_duckdb_unit))} FROM range({self.series * self.steps}) t(id)"


def _decimals(high: float, names: str) -> tuple[Draw, ...]:
    return tuple(Draw(n, high=high) for n in names.split())


def _wholes(high: int, names: str) -> tuple[Draw, ...]:
    return tuple(Draw(n, "whole", 0, high) for n in names.split())


_DEVICE = Draw("devicesysid_k", "code", high=20, of=("dev-",))
_APP = Draw("appsysid_k", "code", high=8, of=("app-",))
# Names of tables, tags and fields.
DEVICES = Workload(
    "em_device_metrics", (_DEVICE, Draw("type_k", "choice", of=("device", "device", "vm"))),
    _decimals(100, "em_device_cpu_usage em_device_memory_usage em_disk_usage em_disk_time em_cpu_user_time em_virtual_memory_usage em_page_file_usage em_wifi_signal_strength em_system_compliance_rating")
    + _decimals(5000, "em_total_page_file_size em_memory_pages_per_sec em_disk_reads_per_sec em_disk_writes_per_sec em_device_io_usage_read em_device_io_usage_write em_wifi_receive_rate em_wifi_transmit_rate")
    + _decimals(5, "em_avg_disk_sec_per_read em_avg_disk_sec_per_write em_avg_disk_sec_per_transfer em_avg_disk_queue_length")
    + _decimals(50, "em_power_consumption em_energy_consumption_total em_energy_consumption_loss em_energy_consumption_cpu em_energy_consumption_gpu em_energy_consumption_soc em_energy_consumption_disk "
                "em_energy_consumption_network em_energy_consumption_display em_energy_consumption_mbb em_energy_consumption_other em_energy_consumption_emi em_energy_consumption_ane")
    + (Draw("em_wifi_rssi", "whole", -90, -30), Draw("em_vpn_status", "whole", 0, 1), Draw("em_device_uptime", "whole", 0, 86400), Draw("em_device_crashes", "whole", 0, 1, share=0.1)),
)
INSTALLED_APPS = Workload(
    "em_installed_app_metrics", (_DEVICE, _APP, Draw("appname_t", "choice", of=("Mail", "Browser", "Editor", "Chat")), Draw("appversion_t", "choice", of=("1.0", "1.1", "2.0")), Draw("type_k", "choice", of=("installed_app",))),
    _decimals(40, "em_installed_app_cpu_usage em_installed_app_memory_usage") + _decimals(5000, "em_installed_app_io_usage_read em_installed_app_io_usage_write") + _decimals(1000, "em_installed_app_usage")
    + _wholes(86400, "em_installed_app_uptime em_installed_app_last_access_time") + _wholes(1, "em_is_running") + (Draw("em_installed_app_crashes", "whole", 0, 1, share=0.2), Draw("em_freezes", "whole", 0, 1, share=0.2)),
)
WEB_APPS = Workload(
    "em_web_app_metrics", (_DEVICE, _APP, Draw("type_k", "choice", of=("web_app",))),
    (Draw("em_availability", low=88.0),) + _decimals(5000, "em_response_time em_pageload_time em_session_length") + _decimals(200, "em_dns_lookup_time") + _decimals(500, "em_web_app_usage")
    + _wholes(50, "em_session_count em_page_view") + _wholes(200, "em_successful_web_requests") + _wholes(10, "em_failed_web_requests") + _wholes(86400, "em_web_app_last_access_time"),
)
NETWORK = Workload("em_network_monitoring_metrics", (_DEVICE, _APP, Draw("type_k", "choice", of=("web_app",))), _decimals(5, "em_packet_loss") + _decimals(200, "em_network_latency") + _decimals(30, "em_jitter"))
BATTERIES = Workload("em_device_metrics_battery", (_DEVICE, Draw("batteryid_k", "choice", of=("0", "1")), Draw("type_k", "choice", of=("device",))), _decimals(100, "em_battery_charge_level"))
_FLAG = ("Y", "N", "N", "N")
TRIPS = Workload(
    "trips",
    (Draw("hvfhs_license_num", "choice", of=("HV0003", "HV0003", "HV0005")), Draw("dispatching_base_num", "code", high=30, of=("B0",))),
    (
        Draw("PULocationID", "code", high=260, of=("",)), Draw("DOLocationID", "code", high=260, of=("",)), Draw("trip_miles", high=30.0), Draw("trip_time", "whole", 60, 3600),
        Draw("base_passenger_fare", low=3.0), Draw("tolls", high=20.0, share=0.1), Draw("bcf", high=3.0), Draw("sales_tax", high=9.0), Draw("congestion_surcharge", high=2.75, share=0.3),
        Draw("airport_fee", high=5.0, share=0.1), Draw("tips", high=20.0, share=0.2), Draw("driver_pay", low=2.0, high=80.0),
        Draw("shared_request_flag", "choice", of=_FLAG), Draw("shared_match_flag", "choice", of=_FLAG), Draw("access_a_ride_flag", "choice", of=_FLAG), Draw("wav_request_flag", "choice", of=_FLAG), Draw("wav_match_flag", "choice", of=_FLAG),
    ), series=60, steps=300, interval=120,
)
ALL: Sequence[Workload] = (DEVICES, INSTALLED_APPS, WEB_APPS, NETWORK, BATTERIES, TRIPS)
