"""Rates over samples that share their time, as in tables of several events a millisecond."""

import datetime
import random
from collections import defaultdict

import duckdb
import pytest

from logloom.operators import metrics
from logloom.plans import metric_plans
from logloom.plans.catalog import ORACLE_SQL, QUERIES

DAY = metric_plans.DAY


@pytest.fixture(scope="module")
def events():
    """(event_id, ts_ms, user_id, event_type, value): two days of five times each."""
    rng = random.Random(7)
    start = 1704067200000
    times = [start + day * DAY + i * 3_600_000 for day in range(2) for i in range(5)]
    rows = [(i, rng.choice(times), rng.randrange(12), rng.choice(["view", "click"]), rng.uniform(0, 50)) for i in range(2000)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def tied(spark, events, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tied"))
    at = lambda ms: datetime.datetime(1970, 1, 1) + datetime.timedelta(milliseconds=ms)
    rows = [(i, at(ms), user, kind, value, "{}") for i, ms, user, kind, value in events]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.fixture
def dealt_anew(monkeypatch):
    """Samples reach the operators in no order."""
    samples = metric_plans._samples
    monkeypatch.setattr(metric_plans, "_samples", lambda spark, d: samples(spark, d).repartition(5))


@pytest.fixture(scope="module")
def counted(events):
    """(topic, broker, window): growth and number of steps of the counter, counted one event after the other."""
    logs = defaultdict(list)
    for i, ms, user, kind, value in events:
        logs[kind, user % 3].append((ms, i, int(value)))
    found = {}
    for (kind, broker), log in logs.items():
        value = None
        for n, (ms, _, v) in enumerate(sorted(log)):
            key, before = (kind, broker, ms // DAY * DAY), value
            value = v if n % 40 == 0 else before + v
            if key not in found:
                found[key] = [0, 0]
                continue
            found[key][0] += value - before if value >= before else value
            found[key][1] += 1
    return found


def rows_of(df):
    *by, name = df.columns
    return {tuple(r[c] for c in by): r[name] for r in df.collect()}


def test_order_of_samples_at_one_time(spark):
    samples = spark.createDataFrame([("a", 0, 1, 5.0), ("a", 0, 3, 1.0), ("a", 0, 2, 9.0)], "s string, ts_ms long, n int, value double")
    assert metrics.increase(samples, ["s"], 1000).first()["increase"] == 4 + 4
    assert metrics.increase(samples, ["s"], 1000, ("ts_ms", "n")).first()["increase"] == 4 + 1


def test_increase_daily(spark, tied, dealt_anew, counted):
    assert rows_of(QUERIES["increase_daily"](spark, tied)) == {k: float(s) for k, (s, _) in counted.items()}


def test_rate_daily(spark, tied, dealt_anew, counted):
    assert rows_of(QUERIES["rate_daily"](spark, tied)) == {k: round(s / 86400, 9) for k, (s, _) in counted.items()}


def test_rate_by_label(spark, tied, dealt_anew, counted):
    rates = defaultdict(float)
    for (topic, _, window), (s, _) in counted.items():
        rates[topic, window] += s / 86400
    assert rows_of(QUERIES["rate_by_label"](spark, tied)) == {k: round(r, 9) for k, r in rates.items()}


def test_mean_is_rounded_once(spark):
    def counter(to):
        return spark.createDataFrame([("a", 0, 0.0), ("a", 1, to)], "topic string, ts_ms long, value double")

    assert metrics.mean_by_rates(counter(345.0), counter(3072.0), ["topic"], DAY).first()["mean"] == 345 / 3072


def test_mean_by_rates(spark, tied, dealt_anew, counted):
    assert rows_of(QUERIES["mean_by_rates"](spark, tied)) == {k: round(s / n, 9) if n else None for k, (s, n) in counted.items()}


def charted(events):
    """(topic, broker, ts_ms, value, mean) of the last 30 of each log, in the order of (ts, event_id)."""
    logs = defaultdict(list)
    for i, ts, ms, user, kind, value in events:
        logs[kind, user % 3].append((ts is None, ts or 0, i, ms, value))
    found = []
    for (kind, broker), log in logs.items():
        values = []
        for *_, ms, value in sorted(log):
            values.append(value)
            last = values[-30:]
            found.append((kind, broker, ms, value, round(sum(last) / len(last), 6)))
    return sorted(found, key=repr)


def test_rolling_chart(spark, tied, dealt_anew, events):
    got = [tuple(r) for r in QUERIES["rolling_chart"](spark, tied).collect()]
    assert sorted(got, key=repr) == charted((i, ms, ms, user, kind, value) for i, ms, user, kind, value in events)


def test_rolling_chart_by_microseconds_and_without_times(spark, tmp_path):
    rng = random.Random(11)
    start = datetime.datetime(2024, 1, 1)
    times = [None if i % 9 == 0 else start + datetime.timedelta(microseconds=rng.randrange(5000)) for i in range(400)]
    rows = [(i, t, i % 3, "view", round(rng.uniform(0, 50), 2), "{}") for i, t in enumerate(times)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    ms = lambda t: t and (t - datetime.datetime(1970, 1, 1)) // datetime.timedelta(milliseconds=1)
    got = [tuple(r) for r in QUERIES["rolling_chart"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == charted((i, t, ms(t), user, kind, value) for i, t, user, kind, value, _ in rows)


def test_rolling_of_samples_at_one_time(spark):
    samples = spark.createDataFrame([("a", 0, 2, 5.0), ("a", 0, 3, 1.0), ("a", 0, 1, 9.0)], "s string, ts_ms long, n int, value double")
    assert [r["mean"] for r in metrics.rolling(samples, ["s"], 2).orderBy("value").collect()] == [1.0, 3.0, 7.0]
    assert [r["mean"] for r in metrics.rolling(samples, ["s"], 2, ("ts_ms", "n")).orderBy("n").collect()] == [9.0, 7.0, 3.0]


@pytest.fixture(scope="module")
def closed(spark, tmp_path_factory):
    """Tables whose SQL leaves nothing open: every event twice, as it is; and one event without a time in each log, among falls and rises."""
    rng = random.Random(5)
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=7 * i), rng.randrange(12), rng.choice(["view", "click"]), rng.uniform(0, 50), "{}") for i in range(600)]
    timeless = [(600 + i, None, i % 3, ["view", "click"][i // 3], 20.0, "{}") for i in range(6)]
    signed = [(i, ts, user, kind, value * rng.choice([1, -1]), props) for i, ts, user, kind, value, props in rows]
    folders = []
    for name, table in (("repeated", rows + rows), ("timeless", signed + timeless)):
        folders.append(str(tmp_path_factory.mktemp(name)))
        spark.createDataFrame(table, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folders[-1]}/events.parquet")
    return folders


def assert_as_sql(spark, name, folders):
    for folder in folders:
        found = QUERIES[name](spark, folder)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS FROM '{folder}/events.parquet/*.parquet'")
        columns = ", ".join(f'"{c}"' for c in found.columns)
        want = con.execute(f"SELECT {columns} FROM ({ORACLE_SQL[name]})").fetchall()
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_increase_daily_of_events_repeated_or_without_a_time(spark, closed):
    assert_as_sql(spark, "increase_daily", closed)


def test_mean_by_rates_of_events_repeated_or_without_a_time(spark, closed):
    assert_as_sql(spark, "mean_by_rates", closed)


def test_rate_by_label_of_events_repeated_or_without_a_time(spark, closed):
    assert_as_sql(spark, "rate_by_label", closed)


def test_rate_daily_of_events_repeated_or_without_a_time(spark, closed):
    assert_as_sql(spark, "rate_daily", closed)
