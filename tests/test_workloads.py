"""Dashboard, alerting and history queries over generated fleets, answers checked in Python."""

from collections import defaultdict
from datetime import datetime, timedelta
from statistics import fmean

import pytest

from tidemark.plans.engine import Engine
from tidemark.sources import generators

END = datetime(2025, 12, 24, 8, 13, 48)


@pytest.fixture(scope="module")
def fleet(spark):
    e = Engine(spark)
    for make in (generators.device_metrics, generators.network_health, generators.app_performance, generators.experience_score, generators.battery):
        m, df = make(spark, 12, 30)
        e.register(m, df.cache())
    return e


def rows(df):
    return [tuple(r) for r in df.collect()]


def table(e, name):
    return [r.asDict() for r in e.catalog.get(name)[1].collect()]


def test_dashboard_top_devices(fleet):
    got = rows(fleet.sql("SELECT device_id, MAX(latency_ms) AS worst FROM network_health WHERE time > TIMESTAMP '2025-12-24 08:00:00' GROUP BY device_id ORDER BY worst DESC LIMIT 3"))
    best = defaultdict(float)
    for r in table(fleet, "network_health"):
        if r["time"] > datetime(2025, 12, 24, 8):
            best[r["device_id"]] = max(best[r["device_id"]], r["latency_ms"])
    assert got == sorted(best.items(), key=lambda x: -x[1])[:3]


def test_dashboard_averages(fleet):
    got = dict(rows(fleet.sql("SELECT location, AVG(overall_score) AS s FROM experience_score GROUP BY location")))
    by = defaultdict(list)
    for r in table(fleet, "experience_score"):
        by[r["location"]].append(r["overall_score"])
    assert got == {k: pytest.approx(fmean(v)) for k, v in by.items()}


def test_alert_having(fleet):
    got = set(rows(fleet.sql("SELECT device_id, application_name, SUM(error_count) AS errors FROM app_performance GROUP BY device_id, application_name HAVING errors > 3")))
    by = defaultdict(int)
    for r in table(fleet, "app_performance"):
        by[r["device_id"], r["application_name"]] += r["error_count"]
    assert got == {(*k, v) for k, v in by.items() if v > 3}


def test_history_of_one_device(fleet):
    device = table(fleet, "em_device_metrics")[0]["devicesysid_k"]
    got = rows(fleet.sql(f"SELECT time, em_page_file_usage FROM em_device_metrics WHERE devicesysid_k = '{device}' AND em_page_file_usage >= 50 AND time >= '2025-12-24 06:13:48' ORDER BY time DESC"))
    want = [(r["time"], r["em_page_file_usage"]) for r in table(fleet, "em_device_metrics") if r["devicesysid_k"] == device and r["em_page_file_usage"] >= 50 and r["time"] >= END - timedelta(hours=2)]
    assert got == sorted(want, reverse=True)


def test_active_devices_per_bucket(fleet):
    got = rows(fleet.sql("SELECT time_bucket('10 minutes', time) AS t, COUNT(DISTINCT devicesysid_k) AS n FROM em_device_metrics GROUP BY t ORDER BY t"))
    assert len(got) >= 14 and {n for _, n in got} == {12}


def test_missing_fields_are_null(fleet):
    got = dict(rows(fleet.sql("SELECT type_k, COUNT(battery_pct) AS n FROM em_device_metrics GROUP BY type_k")))
    assert got["laptop"] > 0 and got["desktop"] == got["virtual"] == 0
    assert {r[0] for r in rows(fleet.sql("SELECT DISTINCT connection_type FROM network_health WHERE wifi_signal_dbm IS NULL"))} == {"ethernet", "vpn"}


def test_percentiles_and_counters(fleet):
    ((p, last, n),) = rows(fleet.sql("SELECT PERCENTILE_95(response_time_ms), LAST(crash_count), COUNT(*) FROM app_performance"))
    assert n == 12 * 30 * 5 and last in (0, 1) and p > 100
    assert rows(fleet.sql("SELECT MIN(charge_level) >= 0 AND MAX(charge_level) <= 100 FROM em_device_metrics_battery")) == [(True,)]


def test_stats(fleet):
    got = {r["measurement"]: (r["rows"], r["series"]) for r in fleet.stats().collect()}
    assert got["app_performance"] == (1800, 60) and got["em_device_metrics_battery"] == (120, 4)
