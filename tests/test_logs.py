"""Cases that the given tables don't hold: compaction, retention, look-ups by time, replicas, states and codecs."""

import json
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from logloom.functions import codec
from logloom.operators import access, audit, groups, maintenance, metrics, offsets, replication, scan, schemas, tiering
from logloom.plans.catalog import ORACLE_SQL, QUERIES
from logloom.sources import sinks
from logloom.sources.writes import LogTable, hashed_partition, produce

RECORDS = "topic string, partition int, offset long, timestamp long, key string, value string, bytes long, segment long"


def records(spark, rows):
    """rows: (offset, timestamp, key, value, segment) of one log."""
    return spark.createDataFrame([("t", 0, o, ts, k, v, 32 + len(k or "") + len(v or ""), s) for o, ts, k, v, s in rows], RECORDS)


def offsets_of(df):
    return sorted(r["offset"] for r in df.collect())


def test_compaction_keeps_latest_and_active_segment(spark):
    rows = records(spark, [(0, 0, "a", "1", 0), (1, 1, "b", "1", 0), (2, 2, "a", "2", 0), (3, 3, "", "x", 0), (4, 4, "a", "3", 1), (5, 5, "a", "4", 1)])
    assert offsets_of(maintenance.compact(rows)) == [1, 2, 4, 5]
    assert offsets_of(maintenance.compact(rows, keep_keyless=True)) == [1, 2, 3, 4, 5]


def test_compaction_of_one_segment_is_no_op(spark):
    rows = records(spark, [(i, i, "k", "v", 0) for i in range(10)])
    assert offsets_of(maintenance.compact(rows)) == list(range(10))


def test_compaction_tombstones_and_age(spark):
    rows = records(spark, [(0, 0, "a", "1", 0), (1, 10, "a", "", 0), (2, 95, "b", "1", 0), (3, 96, "b", "2", 0), (4, 99, "z", "", 1)])
    assert offsets_of(maintenance.compact(rows)) == [1, 3, 4]
    assert offsets_of(maintenance.compact(rows, now_ms=100, tombstones_after_ms=50)) == [3, 4]
    assert offsets_of(maintenance.compact(rows, now_ms=100, min_age_ms=20)) == [1, 2, 3, 4]


def test_renumbering(spark):
    rows = records(spark, [(3, 0, "a", "1", 0), (5, 0, "b", "1", 0), (7, 0, "c", "1", 1), (20, 0, "d", "1", 2)])
    assert offsets_of(maintenance.renumber(rows)) == [3, 4, 5, 20]


def test_retention_by_size_deletes_three_of_five(spark):
    listed = spark.createDataFrame([("t", 0, s, s * 10, s * 10 + 10, 500, s) for s in range(5)], "topic string, partition int, segment long, base_offset long, next_offset long, bytes long, newest_ms long")
    deleted = lambda df: sorted(r["segment"] for r in df.where("deleted").collect())
    assert deleted(maintenance.retain_by_size(listed, 1024)) == [0, 1, 2]
    assert deleted(maintenance.retain_by_size(listed, 0)) == []
    assert deleted(maintenance.retain_by_size(listed, 1)) == [0, 1, 2, 3]
    assert deleted(maintenance.retain_by_age(listed, 100, 98)) == [0, 1]


def test_time_look_up(spark):
    rows = records(spark, [(i, 1000 * i, "k", "v", 0) for i in range(10)])
    wanted = spark.createDataFrame([("t", 0, t) for t in (0, 5000, 2500, -1000, 99999)], "topic string, partition int, wanted_ms long")
    found = {r["wanted_ms"]: r["offset"] for r in offsets.offset_for_timestamp(rows, wanted, offsets.high_water_marks(rows)).collect()}
    assert found == {0: 0, 5000: 5, 2500: 3, -1000: 0, 99999: 10}
    asof = {r["wanted_ms"]: r["offset"] for r in offsets.asof_forward(wanted, rows, 3000).collect()}
    assert asof == {0: 0, 5000: 5, 2500: 3, -1000: 0, 99999: None}


def test_time_look_up_with_times_out_of_order(spark):
    rows = records(spark, [(0, 100, "k", "v", 0), (1, 900, "k", "v", 0), (2, 200, "k", "v", 0), (3, 300, "k", "v", 0)])
    wanted = spark.createDataFrame([("t", 0, 150), ("t", 0, 250)], "topic string, partition int, wanted_ms long")
    assert {r["offset"] for r in offsets.asof_forward(wanted, rows, 100).collect()} == {1}


def test_range_read_stops_at_gap(spark):
    rows = records(spark, [(0, 0, "k", "v", 0), (1, 0, "k", "v", 0), (3, 0, "k", "v", 0)])
    assert offsets_of(scan.read_range(rows, "t", 0, 0, 10)) == [0, 1]
    assert offsets_of(scan.read_range(rows, "t", 0, 2, 10)) == []
    with pytest.raises(ValueError):
        scan.read_range(rows, "t", 0, 0, 0)


def test_lag_is_never_negative(spark):
    commits = spark.createDataFrame([("g", "t", 0, 12), ("g", "none", 0, 1)], "group_id string, topic string, partition int, offset long")
    marks = spark.createDataFrame([("t", 0, 10)], "topic string, partition int, hwm long")
    assert [r["lag"] for r in offsets.consumer_lag(commits, marks).collect()] == [0]


def test_reset_only_of_free_groups(spark):
    commits = spark.createDataFrame([("a", "t", 0, 3), ("b", "t", 0, 3)], "group_id string, topic string, partition int, offset long")
    states = spark.createDataFrame([("a", "Empty"), ("b", "Stable")], "group_id string, state string")
    marks = spark.createDataFrame([("t", 0, 10)], "topic string, partition int, hwm long")
    found = {r["group_id"]: (r["offset"], r["status"]) for r in offsets.reset_offsets(commits, states, marks, "earliest").collect()}
    assert found == {"a": (0, "reset"), "b": (3, "refused")}


def test_replica_assignment_and_isr(spark):
    got = spark.range(3).select(replication.assign_replicas(F.col("id").cast("int"), [1, 2, 3], 3).alias("r")).collect()
    assert [r["r"] for r in got] == [[1, 2, 3], [2, 3, 1], [3, 1, 2]]
    with pytest.raises(ValueError):
        replication.assign_replicas(F.lit(0), [1], 2)
    replicas = spark.createDataFrame([("t", 0, [1, 2, 3])], "topic string, partition int, replicas array<int>")
    state = spark.createDataFrame([("t", 0, 2, 100, 95000)], "topic string, partition int, broker int, leo long, last_fetch_ms long")
    marks = spark.createDataFrame([("t", 0, 101)], "topic string, partition int, hwm long")
    states = replication.replica_states(replicas, state, marks)
    assert replication.isr_by_distance(states, 100000).first()["isr"] == [1, 2]
    assert {r["broker"]: r["lag"] for r in replication.replica_lag(states, 100000).collect()} == {2: 1, 3: 101}


def test_segments_roll(spark):
    rows = records(spark, [(i, 0, "k", "v" * 9, 0) for i in range(7)]).drop("segment")  # 42 bytes each
    found = {r["offset"]: r["segment"] for r in maintenance.assign_segments(rows, 84).collect()}
    assert found == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3}


def test_audit_pages(spark):
    events = spark.range(10).withColumnRenamed("id", "seq")
    assert audit.page(events, 50, 3).count() == 0
    assert audit.page_compat(events, 50, 3).count() == 3
    assert [r["m"] for r in spark.createDataFrame([("test-key-12345",), ("abc",), ("",)], "k string").select(audit.mask_key(F.col("k")).alias("m")).collect()] == ["test****", "****", "****"]


def test_default_is_to_deny(spark):
    entries = spark.createDataFrame([("*", "*", 2, "ab", 4, 2, 3), ("eve", "*", 2, "abc", 3, 3, 2)], "principal string, host string, resource_type byte, resource_name string, pattern_type byte, operation byte, permission_type byte")
    asked = spark.createDataFrame([(1, "bob", "h", 2, "abc", 3), (2, "eve", "h", 2, "abc", 3), (3, "bob", "h", 2, "xyz", 3), (4, "eve", "h", 2, "abd", 4)], "request_id long, principal string, host string, resource_type byte, resource_name string, operation byte")
    assert {r["request_id"]: r["allowed"] for r in access.authorize(asked, entries).collect()} == {1: True, 2: False, 3: False, 4: True}


def test_schema_compatibility(spark):
    one, two = '{"type":"record","fields":[{"name":"id"}]}', '{"type":"record","fields":[{"name":"id"},{"name":"name","default":""}]}'
    rows = spark.createDataFrame([("s", 1, one), ("s", 2, two), ("s", 3, '{"type":"record","fields":[{"name":"name"}]}')], "subject string, version int, schema string")
    modes = lambda m: spark.createDataFrame([("s", m)], "subject string, mode string")
    ok = lambda m: [r["ok"] for r in schemas.compatibility(rows, modes(m)).orderBy("version").collect()]
    assert ok("BACKWARD") == [True, True, False]
    assert ok("FORWARD") == [True, True, True]
    assert ok("FORWARD_TRANSITIVE") == [True, True, False]
    assert ok("FULL") == [True, True, False]
    assert ok("NONE") == [True, True, True]


def test_histogram_and_rates(spark):
    inf = float("inf")
    buckets = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", inf, 4.0), ("b", 1.0, 0.0), ("b", inf, 5.0), ("c", 1.0, 0.0), ("c", inf, 0.0)], "s string, le double, value double")
    assert {r["s"]: r["quantile"] for r in metrics.histogram_quantile(buckets, ["s"], 0.75).collect()} == {"a": 1.5, "b": 1.0, "c": None}
    samples = spark.createDataFrame([("a", 0, 5.0), ("a", 10, 8.0), ("a", 20, 2.0), ("a", 30, 4.0)], "s string, ts_ms long, value double")
    assert metrics.increase(samples, ["s"], 1000).first()["increase"] == 3 + 2 + 2


def test_alert_needs_time(spark):
    samples = spark.createDataFrame([("a", 0, 1.0), ("a", 10, 1.0), ("a", 20, 0.0), ("a", 30, 1.0)], "s string, ts_ms long, value double")
    found = metrics.alert_for(samples, ["s"], F.col("value") > 0.5, 10).collect()
    assert [(r["from_ms"], r["to_ms"], r["n"]) for r in found] == [(0, 10, 2)]


def test_tiers_without_data_cost_nothing(spark):
    empty = spark.createDataFrame([], "path string, size long, policy string, is_archived boolean")
    assert tiering.costs(tiering.stats(empty)).first()["savings_percent"] is None


def test_group_state_machine(spark):
    log = [("g", 1, "join", "a"), ("g", 2, "join", "b"), ("g", 3, "sync", "a"), ("g", 4, "leave", "a"), ("h", 1, "join", "a"), ("h", 2, "kill", "a"), ("h", 3, "join", "b")]
    found = {r["group_id"]: (r["state"], r["generation"], r["members"]) for r in groups.group_states(spark.createDataFrame(log, "group_id string, seq int, action string, member_id string")).collect()}
    assert found == {"g": ("PreparingRebalance", 3, 1), "h": ("Dead", 1, 0)}


def test_no_common_protocol(spark):
    members = spark.createDataFrame([("g", "a", ["x"]), ("g", "b", ["y"])], "group_id string, member_id string, protocols array<string>")
    assert groups.protocol_vote(members).count() == 0


@pytest.mark.parametrize("name", ["none", "gzip", "zstd", "lz4", "snappy"])
def test_codecs(spark, name):
    rows = spark.createDataFrame([(b"",), (b"abc" * 100,), (None,)], "d binary")
    back = rows.select("d", codec.decompress(codec.compress(F.col("d"), name), name).alias("b")).collect()
    assert all(r["d"] == r["b"] for r in back)


def test_record_checksum(spark):
    row = spark.createDataFrame([(7, 99, b"k", b"v")], "o long, t long, k binary, v binary")
    assert row.select(codec.record_crc(*map(F.col, "otkv"))).first()[0] == zlib.crc32(b"799kv")


def test_frames_stop_at_damage():
    data = codec.frame(0, 1, b"k", b"v") + codec.frame(1, 2, b"", b"")
    assert list(codec.frames(data)) == [(0, 1, b"k", b"v"), (1, 2, b"", b"")]
    assert len(codec.frame(0, 1, b"k", b"v")) == 34
    assert list(codec.frames(data[:-1])) == [(0, 1, b"k", b"v")]


def test_log_folder(spark, tmp_path):
    (tmp_path / "clicks" / "partition-2").mkdir(parents=True)
    (tmp_path / "clicks" / "partition-2" / "00000000000000000005.log").write_bytes(codec.frame(5, 1, b"k", b"v"))
    row = sinks.read_log_folder(spark, str(tmp_path)).first()
    assert (row["topic"], row["partition"], row["base_offset"], row["offset"], bytes(row["value"])) == ("clicks", 2, 5, 5, b"v")


def test_jsonl_import_skips_bad_lines(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"offset":1,"timestamp":2,"key":"a","value":"b"}\nnot json\n{"offset":2,"timestamp":3,"key":5,"value":{"x":1}}\n')
    rows = {r["offset"]: (r["key"], r["value"]) for r in sinks.read_jsonl(spark, str(tmp_path / "in.json")).collect()}
    assert rows == {1: ("a", "b"), 2: ("", "")}


def test_appends_are_idempotent(spark, tmp_path):
    table = LogTable(spark, str(tmp_path / "log"))
    rows = spark.createDataFrame([("t", 0, "k", str(i), i) for i in range(5)], "topic string, partition int, key string, value string, seq int")
    table.append(0, rows, 1)
    table.append(1, rows, 2)
    table.append(1, rows, 2)
    assert offsets_of(table.read()) == list(range(10))


def test_produce_errors_are_per_row(spark):
    rows = spark.createDataFrame([(None, "k", "{}"), (1, "k", "{")], "partition int, key string, value string")
    assert [(r["partition"], r["error"]) for r in produce(rows).collect()] == [(0, None), (1, "bad value")]


def test_snapshots(spark, tmp_path):
    rows = records(spark, [(0, 0, "a", "1", 0), (1, 1, "b", "1", 1)])
    store = maintenance.Snapshots(spark, str(tmp_path))
    meta = store.create(rows, "s1", 5).first()
    assert (meta["base_offset"], meta["high_water_mark"], meta["num_segments"], meta["segment_offsets"]) == (0, 2, 2, [0, 1])
    assert store.restore("s1").count() == 2 and store.ids() == ["s1"]
    with pytest.raises(ValueError, match="exists"):
        store.create(rows, "s1", 6)
    store.create(rows, "s2", 6)
    assert [r["id"] for r in store.listed().orderBy("place").collect()] == ["s2", "s1"]
    assert store.delete("s1") and not store.delete("s1") and store.get("s1").count() == 0
    with pytest.raises(ValueError, match="not found"):
        store.restore("s1")
    assert store.size().first()["total_size"] == store.get("s2").first()["total_size"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bounds_reach_the_scan(spark, tiny):
    from logloom.plans import views

    rows = views.records(spark, tiny)
    plan = plan_of(rows.where("topic = 'view' and partition = 1 and offset >= 10 and offset < 20").select("offset", "key"))
    assert "GreaterThanOrEqual(offset,10)" in plan and "LessThan(offset,20)" in plan and "PartitionFilters: [isnotnull(topic" in plan
    assert "ReadSchema: struct<offset:bigint,key:string>" in plan
    assert "GreaterThan(timestamp,5)" in plan_of(rows.where("timestamp > 5"))


def test_compaction_is_a_hash_aggregation(spark, tiny):
    from logloom.plans import views

    plan = plan_of(maintenance.compact(views.segmented(views.records(spark, tiny))))
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_appends_keep_the_last_offsets(spark, tmp_path):
    from logloom.sources.writes import LogTable

    log = LogTable(spark, str(tmp_path / "log"))
    rows = spark.createDataFrame([("t", 0, "k", "v", i) for i in range(5)], "topic string, partition int, key string, value string, seq long")
    for b in (0, 1, 1):
        log.append(b, rows, 1)
    assert sorted(r["offset"] for r in log.read().collect()) == list(range(10))
    assert "batch=" not in plan_of(log._ends(2)).replace("log-ends/batch=", "")


def test_session_timeouts_stream(spark, tmp_path):
    from logloom.streaming.windows import session_timeouts

    schema = "member_id string, ts timestamp"
    for k, (member, at) in enumerate([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 01:00:00"), ("b", "2024-01-01 02:00:00")]):
        spark.createDataFrame([(member, at)], "member_id string, t string").select("member_id", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "1 minute")
    query = session_timeouts(stream, 600_000).writeStream.format("memory").queryName("beats").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    found = {(r["member_id"], r["state"]) for r in spark.table("beats").collect()}
    assert ("a", "expired") in found and ("b", "alive") in found


def test_windows_and_dedup_on_a_stream(spark, tmp_path):
    from logloom.streaming.windows import first_only, sessions, windowed

    rows = [("a", "2024-01-01 00:01:00", 1), ("a", "2024-01-01 00:02:00", 2), ("a", "2024-01-01 00:02:00", 2), ("b", "2024-01-01 00:31:00", 5), ("b", "2024-01-02 00:00:00", 7)]
    spark.createDataFrame(rows, "k string, t string, value int").select("k", F.col("t").cast("timestamp").alias("ts"), "value").coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(name, build):
        stream = spark.readStream.schema("k string, ts timestamp, value int").parquet(str(tmp_path / "in"))
        query = build(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        query.awaitTermination()
        return spark.table(name).collect()

    assert {(r["k"], r["n"], r["total"]) for r in run("tumbled", lambda s: windowed(s, ["k"], "10 minutes", delay="5 minutes"))} == {("a", 3, 5), ("b", 1, 5)}
    assert {(r["k"], r["n"]) for r in run("sessioned", lambda s: sessions(s, ["k"], "10 minutes", delay="5 minutes"))} == {("a", 3), ("b", 1)}
    assert len(run("deduped", lambda s: first_only(s, ["k", "ts", "value"]))) == 4


@pytest.mark.parametrize("stretch", [7, 40, 10_000])
def test_averages_by_stretches(spark, stretch):
    import math
    import random

    draw = random.Random(3)
    rows = [(s, t, float(draw.randrange(-50, 400) if s else draw.randrange(0, 9))) for s in range(3) for t in range(190 + s)] + [(9, 0, 12.0)]
    frame = spark.createDataFrame(rows, "s int, ts_ms long, value double")
    for truncated in (True, False):
        want = {}
        for s, _, x in rows:
            a = 0.2 * x + (1 - 0.2) * want.get(s, 0.0)
            want[s] = float(math.floor(a)) if truncated else a
        found = {r["s"]: r["ema"] for r in metrics.moving_average(frame, ["s"], truncated=truncated, stretch=stretch).collect()}
        assert found == (want if truncated else pytest.approx(want, rel=1e-12))


def test_average_of_nothing(spark):
    empty = spark.createDataFrame([], "s int, ts_ms long, value double")
    assert metrics.moving_average(empty, ["s"], truncated=True).count() == metrics.moving_average(empty, ["s"]).count() == 0


def test_rotated_files_hold_no_more_than_asked(spark, tmp_path):
    from logloom.sources.sinks import write_rotated

    rows = [(i, 1_000 * i, "x" * (i * 37 % 90)) for i in range(400)]
    events = spark.createDataFrame(rows, "seq long, ts_ms long, text string")
    placed = audit.rotate(events, 1_000, stretch=30)
    files = {r["file"]: r for r in audit.rotated_files(placed, 3, 400_000, 0).collect()}
    assert sum(f["n"] for f in files.values()) == 400 and all(f["bytes"] <= 1_000 for f in files.values())
    assert [f["kept"] for _, f in sorted(files.items())][-4:] == [True] * 4 and sum(f["kept"] for f in files.values()) == 4
    old = {r["file"]: r["kept"] for r in audit.rotated_files(placed, 0, 400_000, 20_000).collect()}
    assert all(kept == (files[k]["newest_ms"] >= 380_000) for k, kept in old.items())
    write_rotated(placed, str(tmp_path / "log"), compression="gzip")
    assert len(list((tmp_path / "log").glob("file=*/*.gz"))) == len(files)
    back = spark.read.text(str(tmp_path / "log")).select("value").collect()
    assert sorted(json.loads(r["value"])["seq"] for r in back) == list(range(400))
    assert audit.rotate(events.limit(0), 10).count() == 0


def test_longer_lines_than_a_file(spark):
    events = spark.createDataFrame([(i, 0, "y" * 50) for i in range(3)], "seq long, ts_ms long, text string")
    assert audit.rotate(events, 10).select("file").distinct().count() == 3


def test_pretty_json(spark):
    values = ['{"b":[1,{"c":null}],"a":"\u00e4"}', "plain", None, "", "[]"]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    shown = [r["p"] for r in frame.select("i", scan.pretty(F.col("v")).alias("p")).orderBy("i").collect()]
    assert shown == ['{\n  "b": [\n    1,\n    {\n      "c": null\n    }\n  ],\n  "a": "ä"\n}', "plain", None, "", "[]"]


def test_hashed_partitions(spark):
    found = spark.range(4000).select(hashed_partition(F.col("id").cast("string").cast("binary"), 4).alias("p"))
    counts = {r["p"]: r["count"] for r in found.groupBy("p").count().collect()}
    assert set(counts) == {0, 1, 2, 3} and min(counts.values()) > 800


def test_whole_messages_are_json(spark, tmp_path):
    texts = ["8294846167456848 Inly onhe", '{"a":1}xyz', '{"a":1}{"b":2}', "[1] ]", "1,", '"a":1', '{"a":[1,{"b":[]},],}', "[,]", "{,}", "[1,,2]", '{"a":1 "b":2}', "{1:2}"]
    texts += ["NaN", "[-inf]", "[ınf]", "Infinity", "infinit", "TRUE", "null", "nul", "01", "-0", "1.", ".5", "+1", "1e400", "1" * 1100, " \t\r\n1 \n", "1\x0b", "﻿1", "", " ", "'a'"]
    texts += ['"\\ud800"', '"\\ud83d\\ude00"', '"\\ud83dx"', '"\\u12"', '"a\tb"', '"a\\"', '" "', '{"a":1,"a":2}', "[" * 3000 + "]" * 3000, '{"a":' * 1100 + "1" + "}" * 1100, "[", "{]"]
    texts += ['{"' + "k" * 60000 + '":1}', "é\U0001f600" * 60, None]
    folder = str(tmp_path / "odd")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["message_preview"]).fetchall()
    assert sorted(map(tuple, QUERIES["message_preview"](spark, folder).collect())) == sorted(want)
