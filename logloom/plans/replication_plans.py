"""Queries on replicas."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators import replication as R
from logloom.plans import views as V
from logloom.plans.registry import query
from logloom.plans.views import FOLLOWERS, HWM, RECORDS, REPLICAS, with_views

NOW = 1706659200000
STATES = """states AS (
    SELECT e.topic, e."partition", e.position, e.broker, e.position = 0 AS is_leader, hwm AS leader_leo, f.leo, f.last_fetch_ms
    FROM (SELECT topic, "partition", unnest(replicas) AS broker, unnest([0, 1, 2]) AS position FROM replicas) e JOIN hwm USING (topic, "partition")
    LEFT JOIN follower_state f ON f.topic = e.topic AND f."partition" = e."partition" AND f.broker = e.broker)"""
ISR = f"""isr AS (SELECT topic, "partition", list(broker ORDER BY position) AS isr FROM states
    WHERE is_leader OR (leader_leo - leo <= 5 AND {NOW} - last_fetch_ms <= 14000) GROUP BY ALL)"""
MARK = """mark AS (SELECT topic, "partition", CAST(min(CASE WHEN is_leader THEN leader_leo ELSE coalesce(leo, 0) END) AS BIGINT) AS replicated_hwm
    FROM states JOIN isr USING (topic, "partition") WHERE list_contains(isr, broker) GROUP BY ALL)"""
ALL = with_views(RECORDS, HWM, REPLICAS, FOLLOWERS, STATES, ISR, MARK)


def _states(spark, d):
    marks = V.marks(spark, d)
    return R.replica_states(V.replicas(marks), V.follower_state(marks), marks)


def _isr(states):
    return R.isr_by_distance(states, NOW, max_behind=5, max_silent_ms=14_000)


@query(with_views(RECORDS, HWM, REPLICAS) + "SELECT topic, \"partition\", array_to_string(replicas, ',') AS replicas FROM replicas")
def replica_assignment(spark, d):
    return V.replicas(V.marks(spark, d)).select("topic", "partition", F.array_join(F.col("replicas").cast("array<string>"), ",").alias("replicas"))


@query(ALL + f'SELECT topic, "partition", broker, CAST(greatest(leader_leo - coalesce(leo, 0), 0) AS BIGINT) AS lag, CAST({NOW} - last_fetch_ms AS BIGINT) AS lag_ms FROM states WHERE NOT is_leader')
def replica_lag(spark, d):
    return R.replica_lag(_states(spark, d), NOW)


@query(ALL + "SELECT topic, \"partition\", array_to_string(isr, ',') AS isr FROM isr")
def isr_topic(spark, d):
    return _isr(_states(spark, d)).select("topic", "partition", F.array_join(F.col("isr").cast("array<string>"), ",").alias("isr"))


@query(ALL + 'SELECT * FROM mark')
def replicated_hwm(spark, d):
    states = _states(spark, d)
    return R.replicated_mark(states, _isr(states))


@query(
    ALL
    + f"""SELECT topic, "partition", array_to_string(list(broker ORDER BY position), ',') AS isr FROM states JOIN mark USING (topic, "partition")
    WHERE is_leader OR (leo >= replicated_hwm AND {NOW} - last_fetch_ms < 10000) GROUP BY ALL"""
)
def isr_replication(spark, d):
    states = _states(spark, d)
    found = R.isr_by_mark(states, R.replicated_mark(states, _isr(states)), NOW)
    return found.select("topic", "partition", F.array_join(F.col("isr").cast("array<string>"), ",").alias("isr"))


@query(ALL + 'SELECT topic, "partition", CAST(len(replicas) AS INTEGER) AS replicas, CAST(len(isr) AS INTEGER) AS in_sync FROM replicas JOIN isr USING (topic, "partition") WHERE len(isr) < len(replicas)')
def under_replicated(spark, d):
    states = _states(spark, d)
    return R.under_replicated(V.replicas(V.marks(spark, d)), _isr(states))


OBSERVED = """observed AS (SELECT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS "partition", event_id AS seq, CAST(1 + event_id * 7 % 3 AS INTEGER) AS size FROM events)"""


@query(
    with_views(OBSERVED)
    + """, c AS (SELECT *, lag(size) OVER (PARTITION BY topic, "partition" ORDER BY seq) AS before FROM observed)
    SELECT topic, "partition", seq, CASE WHEN size < before THEN 'shrink' ELSE 'expand' END AS change FROM c WHERE size <> before"""
)
def isr_changes(spark, d):
    e = V.table(spark, d, "events")
    observed = e.select(F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("seq"), (1 + F.col("event_id") * 7 % 3).cast("int").alias("size"))
    return R.isr_changes(observed)


@query(
    """WITH o AS (SELECT user_id AS node, event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'Leader' WHEN 1 THEN 'Follower' ELSE 'Candidate' END AS state FROM events),
    c AS (SELECT *, lag(state) OVER (PARTITION BY node ORDER BY seq) AS before FROM o)
    SELECT node, CAST(count(*) FILTER (WHERE before IS NOT NULL AND (state = 'Leader') <> (before = 'Leader')) AS BIGINT) AS changes FROM c GROUP BY node"""
)
def leader_changes(spark, d):
    e = V.table(spark, d, "events")
    state = F.element_at(F.array(F.lit("Leader"), F.lit("Follower"), F.lit("Candidate")), (F.col("event_id") % 3 + 1).cast("int"))
    return R.leader_changes(e.select(F.col("user_id").alias("node"), F.col("event_id").alias("seq"), state.alias("state")))


@query(ALL + """SELECT topic, "partition", CASE WHEN replicas[1] = 2 THEN 'leader' ELSE 'follower' END AS role FROM replicas WHERE list_contains(replicas, 2)""")
def led_and_followed(spark, d):
    return R.led_and_followed(V.replicas(V.marks(spark, d)), 2)


@query(
    """SELECT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS "partition", CAST(user_id % 3 AS INTEGER) AS broker, arg_max(event_id * 3, event_id) AS leo, arg_max(CAST(epoch_us(ts) // 1000 AS BIGINT), event_id) AS last_fetch_ms
    FROM events GROUP BY ALL"""
)
def latest_follower_state(spark, d):
    from logloom.model import epoch_ms

    e = V.table(spark, d, "events")
    updates = e.select(
        F.col("event_type").alias("topic"),
        (F.col("user_id") % 4).cast("int").alias("partition"),
        (F.col("user_id") % 3).cast("int").alias("broker"),
        (F.col("event_id") * 3).alias("leo"),
        epoch_ms(F.col("ts")).alias("last_fetch_ms"),
        F.col("event_id").alias("seq"),
    )
    return R.latest_follower_state(updates)


@query(
    ALL
    + """, produced AS (SELECT topic, "partition", CAST(hwm - k AS BIGINT) AS "offset", CAST(CASE WHEN k = 2 THEN 1 ELSE -1 END AS INTEGER) AS acks FROM hwm, (SELECT unnest([0, 1, 2, 4, 8]) AS k))
    SELECT p.*, p.acks <> -1 OR p."offset" < replicated_hwm AS acked FROM produced p JOIN mark USING (topic, "partition")"""
)
def acks_wait(spark, d):
    states = _states(spark, d)
    produced = V.marks(spark, d).withColumn("k", F.explode(F.array(*(F.lit(k) for k in (0, 1, 2, 4, 8)))))
    produced = produced.select("topic", "partition", (F.col("hwm") - F.col("k")).alias("offset"), F.when(F.col("k") == 2, 1).otherwise(-1).alias("acks"))
    return R.acknowledged(produced, R.replicated_mark(states, _isr(states)))


@query(with_views(RECORDS, HWM, REPLICAS) + """SELECT topic, "partition", array_to_string(replicas, ',') AS replicas FROM (SELECT topic, "partition", CASE WHEN "partition" = 2 THEN [replicas[1], replicas[1], replicas[3]] ELSE replicas END AS replicas FROM replicas) WHERE len(list_distinct(replicas)) <> len(replicas)""")
def invalid_assignments(spark, d):
    r = F.col("replicas")
    rows = V.replicas(V.marks(spark, d)).withColumn("replicas", F.when(F.col("partition") == 2, F.array(r[0], r[0], r[2])).otherwise(r))
    return R.invalid_assignments(rows).withColumn("replicas", F.array_join(F.col("replicas").cast("array<string>"), ","))
