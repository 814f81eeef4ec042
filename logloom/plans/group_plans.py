"""Queries on groups, producers and transactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.model import epoch_ms
from logloom.operators import groups as G
from logloom.plans import views as V
from logloom.plans.offset_plans import GROUPS_SQL, _groups
from logloom.plans.registry import query
from logloom.plans.views import COMMITS, HWM, RECORDS, with_views

MEMBERS = """members AS (SELECT 'group-' || (c_custkey % 4) AS group_id, c_custkey AS member_id, CASE c_custkey % 3 WHEN 0 THEN ['range', 'sticky', 'roundrobin'] WHEN 1 THEN ['sticky', 'range'] ELSE
    CASE WHEN c_custkey % 4 = 3 THEN ['cooperative'] ELSE ['range', 'sticky'] END END AS protocols, CAST(1000 + c_custkey * 37 % 5000 AS BIGINT) AS last_heartbeat_ms, CAST(3000 AS BIGINT) AS session_timeout_ms FROM customer)"""


def _members(spark, d):
    k = F.col("c_custkey")
    names = lambda *n: F.array(*(F.lit(x) for x in n))
    protocols = F.when(k % 3 == 0, names("range", "sticky", "roundrobin")).when(k % 3 == 1, names("sticky", "range")).when(k % 4 == 3, names("cooperative")).otherwise(names("range", "sticky"))
    return V.table(spark, d, "customer").select(
        F.concat(F.lit("group-"), k % 4).alias("group_id"), k.alias("member_id"), protocols.alias("protocols"), (1000 + k * 37 % 5000).alias("last_heartbeat_ms"), F.lit(3000).cast("long").alias("session_timeout_ms")
    )


@query(
    with_views(MEMBERS)
    + """, n AS (SELECT group_id, count(*) AS members FROM members GROUP BY group_id), e AS (SELECT group_id, member_id, unnest(protocols) AS protocol, unnest(range(len(protocols))) AS pos FROM members),
    v AS (SELECT group_id, protocol, count(*) AS n, count(*) FILTER (WHERE pos = 0) AS first FROM e GROUP BY ALL)
    SELECT group_id, protocol FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY first DESC, protocol) AS rn FROM v JOIN n USING (group_id) WHERE v.n = members) WHERE rn = 1"""
)
def protocol_vote(spark, d):
    return G.protocol_vote(_members(spark, d))


@query(
    with_views(RECORDS, HWM, COMMITS, GROUPS_SQL, MEMBERS)
    + """SELECT q.group_id, coalesce(g.state, 'Dead') AS state, CAST(CASE WHEN g.state IS NULL THEN 69 ELSE 0 END AS INTEGER) AS error,
    (SELECT count(*) FROM members m WHERE m.group_id = q.group_id) AS members, (SELECT count(*) FROM commits c WHERE c.group_id = q.group_id) AS commits
    FROM (VALUES ('group-0'), ('group-1'), ('group-9')) AS q(group_id) LEFT JOIN groups g USING (group_id)"""
)
def group_describe(spark, d):
    requested = spark.createDataFrame([("group-0",), ("group-1",), ("group-9",)], "group_id string")
    return G.describe(requested, _groups(spark), _members(spark, d), V.commits(V.marks(spark, d)))


@query(
    with_views(GROUPS_SQL, MEMBERS)
    + """, by_group AS (SELECT group_id, count(*) FILTER (WHERE 6500 - last_heartbeat_ms > session_timeout_ms) AS dead, count(*) FILTER (WHERE 6500 - last_heartbeat_ms <= session_timeout_ms) AS alive FROM members GROUP BY group_id)
    SELECT group_id, CASE WHEN dead > 0 AND alive = 0 THEN 'Empty' WHEN dead > 0 THEN 'PreparingRebalance' ELSE state END AS state, CAST(5 + CASE WHEN dead > 0 THEN 1 ELSE 0 END AS INTEGER) AS generation, coalesce(alive, 0) AS alive
    FROM groups LEFT JOIN by_group USING (group_id)"""
)
def dead_members(spark, d):
    return G.expire_members(_groups(spark).withColumn("generation", F.lit(5)), _members(spark, d), 6500)


@query(with_views(MEMBERS) + "SELECT group_id, member_id, 'stable' AS kind FROM members WHERE member_id % 5 <> 0 UNION ALL SELECT group_id, member_id, 'pending' FROM members WHERE member_id % 5 = 0")
def all_members(spark, d):
    m = _members(spark, d).select("group_id", "member_id")
    return G.all_members(m.where("member_id % 5 <> 0").withColumn("kind", F.lit("stable")), m.where("member_id % 5 = 0").withColumn("kind", F.lit("pending")))


ACTIONS = """actions AS (SELECT 'g' || user_id AS group_id, CASE event_id % 5 WHEN 1 THEN 'sync' WHEN 2 THEN 'heartbeat' WHEN 3 THEN 'leave' ELSE 'join' END AS action, 'm' || (event_id % 3) AS member_id,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)"""


@query(
    with_views(ACTIONS).replace("WITH ", "WITH RECURSIVE ", 1)
    + """, fold AS (
        SELECT DISTINCT group_id, CAST(0 AS BIGINT) AS n, 'Empty' AS state, 0 AS generation, CAST([] AS VARCHAR[]) AS members FROM actions
        UNION ALL
        SELECT f.group_id, a.n,
            CASE WHEN action = 'join' THEN 'PreparingRebalance' WHEN action = 'sync' AND state = 'PreparingRebalance' AND here THEN 'Stable' WHEN action = 'leave' AND here AND len(members) = 1 THEN 'Empty' WHEN action = 'leave' AND here THEN 'PreparingRebalance' ELSE state END,
            CASE WHEN action = 'join' OR (action = 'leave' AND here) THEN generation + 1 ELSE generation END,
            CASE WHEN action = 'join' AND NOT here THEN list_append(members, member_id) WHEN action = 'leave' THEN list_filter(members, lambda x: x <> member_id) ELSE members END
        FROM fold f JOIN actions a ON a.group_id = f.group_id AND a.n = f.n + 1, LATERAL (SELECT list_contains(members, member_id) AS here))
    SELECT group_id, arg_max(state, n) AS state, CAST(arg_max(generation, n) AS INTEGER) AS generation, CAST(arg_max(len(members), n) AS BIGINT) AS members FROM fold GROUP BY group_id"""
)
def group_state(spark, d):
    e = V.table(spark, d, "events")
    action = F.element_at(F.array(*(F.lit(a) for a in ("join", "sync", "heartbeat", "leave", "join"))), (F.col("event_id") % 5 + 1).cast("int"))
    return G.group_states(e.select(F.concat(F.lit("g"), F.col("user_id")).alias("group_id"), F.col("event_id").alias("seq"), action.alias("action"), F.concat(F.lit("m"), F.col("event_id") % 3).alias("member_id")))


@query("SELECT transactional_id, CAST(1000 + row_number() OVER (ORDER BY first) AS BIGINT) AS producer_id, n - 1 AS epoch FROM (SELECT user_id AS transactional_id, min(event_id) AS first, count(*) AS n FROM events GROUP BY user_id)")
def producer_epochs(spark, d):
    return G.producer_epochs(V.table(spark, d, "events").select(F.col("user_id").alias("transactional_id"), F.col("event_id").alias("seq")))


OPS = """ops AS (SELECT user_id AS transactional_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'init' WHEN 'click' THEN 'add' WHEN 'view' THEN 'add' WHEN 'purchase' THEN 'end' ELSE 'commit_offsets' END AS op,
    CAST(user_id + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS BIGINT) AS producer_id, CAST(event_id % 13 // 12 AS BIGINT) AS epoch,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)"""


@query(
    with_views(OPS).replace("WITH ", "WITH RECURSIVE ", 1)
    + """, fold AS (
        SELECT transactional_id, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS seq, 0 AS error, 'Empty' AS state, CAST(-1 AS BIGINT) AS producer, CAST(-1 AS BIGINT) AS epoch, CAST(0 AS BIGINT) AS parts FROM (SELECT DISTINCT transactional_id FROM ops)
        UNION ALL
        SELECT o.transactional_id, o.n, o.seq, e.error,
            CASE WHEN o.op = 'init' THEN 'Empty' WHEN e.error <> 0 THEN f.state WHEN o.op = 'end' THEN 'Complete' WHEN o.op = 'add' THEN 'Ongoing' ELSE f.state END,
            CASE WHEN o.op = 'init' THEN o.producer_id ELSE f.producer END, CASE WHEN o.op = 'init' THEN o.epoch ELSE f.epoch END,
            CASE WHEN o.op = 'init' THEN 0 WHEN e.error <> 0 THEN f.parts WHEN o.op = 'end' THEN 0 WHEN o.op = 'add' THEN f.parts + 1 ELSE f.parts END
        FROM fold f JOIN ops o ON o.transactional_id = f.transactional_id AND o.n = f.n + 1,
        LATERAL (SELECT CASE WHEN o.op = 'init' THEN 0 WHEN o.producer_id <> f.producer THEN 49 WHEN o.epoch <> f.epoch THEN 47 WHEN o.op IN ('end', 'commit_offsets') AND f.state <> 'Ongoing' THEN 48 ELSE 0 END AS error) e)
    SELECT transactional_id, seq, CAST(error AS INTEGER) AS error, state, parts AS partitions FROM fold WHERE n > 0"""
)
def txn_fold(spark, d):
    op = F.when(F.col("event_type") == "signup", "init").when(F.col("event_type").isin("click", "view"), "add").when(F.col("event_type") == "purchase", "end").otherwise("commit_offsets")
    producer = (F.col("user_id") + F.when(F.col("event_id") % 11 == 0, 1).otherwise(0)).cast("long")
    rows = V.table(spark, d, "events").select(F.col("user_id").alias("transactional_id"), F.col("event_id").alias("seq"), op.alias("op"), producer.alias("producer_id"), F.expr("event_id % 13 div 12").alias("epoch"))
    return G.transactions(rows)


@query("SELECT n_regionkey, count(*) AS components, CASE WHEN bool_or(n_nationkey % 7 = 6) THEN 'unhealthy' WHEN bool_or(n_nationkey % 3 = 1) THEN 'degraded' ELSE 'healthy' END AS status FROM nation GROUP BY n_regionkey")
def health_rollup(spark, d):
    k = F.col("n_nationkey")
    rows = V.table(spark, d, "nation").select("n_regionkey", F.when(k % 7 == 6, "unhealthy").when(k % 3 == 1, "degraded").otherwise("healthy").alias("status"))
    return G.health(rows, ["n_regionkey"])


@query(
    """WITH q AS (SELECT event_type || '-' || (event_id % 3) AS name FROM events), c AS (SELECT DISTINCT event_type || '-0' AS name FROM events)
    SELECT name, CASE WHEN count(*) > 1 THEN 'duplicate' WHEN name IN (SELECT name FROM c) THEN 'exists' END AS error FROM q GROUP BY name"""
)
def batch_create_check(spark, d):
    e = V.table(spark, d, "events")
    return G.batch_check(e.select(F.concat("event_type", F.lit("-"), F.col("event_id") % 3).alias("name")), e.select(F.concat("event_type", F.lit("-0")).alias("name")), True)


@query(
    with_views(RECORDS).replace("WITH ", "WITH RECURSIVE ", 1)
    + """, walk AS (SELECT topic, "partition", "offset", CAST(1 AS BIGINT) AS n, bytes AS held, CAST(0 AS BIGINT) AS batch FROM records WHERE "offset" = 0
        UNION ALL SELECT r.topic, r."partition", r."offset", CASE WHEN f.full THEN 1 ELSE w.n + 1 END, CASE WHEN f.full THEN r.bytes ELSE w.held + r.bytes END, w.batch + CASE WHEN f.full THEN 1 ELSE 0 END
        FROM walk w JOIN records r ON r.topic = w.topic AND r."partition" = w."partition" AND r."offset" = w."offset" + 1, LATERAL (SELECT w.n >= 40 OR w.held >= 1700 AS full) f)
    SELECT topic, "partition", "offset", batch FROM walk"""
)
def batch_flush(spark, d):
    return G.flush_batches(V.records(spark, d), 40, 1700)


@query("SELECT p_partkey, least(greatest(p_retailprice, 950.0), 1500.0) AS rate FROM part")
def throttle_clamp(spark, d):
    return V.table(spark, d, "part").select("p_partkey", G.throttle(F.col("p_retailprice"), 950.0, 1500.0).alias("rate"))


@query(
    """WITH u AS (SELECT user_id AS series, list(CAST(value AS DOUBLE) / 100 ORDER BY event_id) AS u FROM events GROUP BY user_id)
    SELECT series, round(list_reduce(list_prepend(10485760.0::DOUBLE, u), lambda a, x: CASE WHEN x > 0.8 THEN least(greatest(a * 1.1::DOUBLE, 1048576), 104857600) WHEN x < 0.4 THEN least(greatest(a * 0.9::DOUBLE, 1048576), 104857600) ELSE a END), 3) AS rate FROM u"""
)
def throttle_adapt(spark, d):
    u = V.table(spark, d, "events").select(F.col("user_id").alias("series"), F.col("event_id").alias("seq"), (F.col("value") / 100).alias("utilisation"))
    return G.adapt_rate(u, 10485760.0).withColumn("rate", F.round("rate", 3))


@query("SELECT user_id, CAST(epoch_us(max(ts)) // 1000 AS BIGINT) AS last_ms, 1706745600000 - epoch_us(max(ts)) // 1000 > 86400000 AS expired FROM events GROUP BY user_id")
def session_timeout_batch(spark, d):
    by = V.table(spark, d, "events").groupBy("user_id").agg(epoch_ms(F.max("ts")).alias("last_ms"))
    return by.withColumn("expired", F.lit(1706745600000) - F.col("last_ms") > 86_400_000)
