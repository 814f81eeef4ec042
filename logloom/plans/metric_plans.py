"""Metric queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.model import epoch_ms
from logloom.operators import metrics as M
from logloom.plans import views as V
from logloom.plans.registry import query
from logloom.plans.views import with_views

DAY = 86_400_000
# A counter for each event type and broker that is reset every 40 events, in units that floats hold exactly.
SAMPLES = """samples AS (SELECT topic, broker, ts_ms, n, CAST(sum(v) OVER (PARTITION BY topic, broker, n // 40 ORDER BY ts_ms, event_id) AS DOUBLE) AS value, gauge
    FROM (SELECT event_type AS topic, CAST(user_id % 3 AS INTEGER) AS broker, epoch_us(ts) // 1000 AS ts_ms, event_id, CAST(floor(value) AS BIGINT) AS v, value AS gauge,
        row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY ts, event_id) - 1 AS n FROM events))"""
INC = f"""inc AS (SELECT topic, broker, w AS "window", CASE WHEN before IS NULL THEN NULL WHEN value < before THEN value ELSE value - before END AS inc
    FROM (SELECT *, ts_ms // {DAY} * {DAY} AS w, lag(value) OVER (PARTITION BY topic, broker, ts_ms // {DAY} ORDER BY ts_ms) AS before FROM samples)),
    grown AS (SELECT topic, broker, CAST("window" AS BIGINT) AS "window", coalesce(sum(inc), 0.0) AS increase FROM inc GROUP BY ALL)"""
WITH = with_views(SAMPLES, INC)
SERIES = ("topic", "broker")
# The order in which the counter went up: SQL's ts_ms alone leaves samples of one millisecond open.
COUNTED = ("ts_ms", "run", "event_id")


def _last(*columns):
    """Ascending, nulls last as in SQL."""
    return [F.col(c).asc_nulls_last() for c in columns]


def _samples(spark, d):
    own = W.partitionBy("topic", "broker")
    e = V.table(spark, d, "events").select(F.col("event_type").alias("topic"), (F.col("user_id") % 3).cast("int").alias("broker"), epoch_ms(F.col("ts")).alias("ts_ms"), "ts", "event_id", F.floor("value").alias("v"), F.col("value").alias("gauge"))
    e = e.withColumn("n", F.row_number().over(own.orderBy(*_last("ts", "event_id"))) - 1).withColumn("run", F.expr("n div 40"))
    # Without a frame of rows, as in SQL: events of one time and id go up together.
    value = F.sum("v").over(W.partitionBy("topic", "broker", "run").orderBy(*_last("ts_ms", "event_id")))
    return e.select("topic", "broker", "ts_ms", "n", value.cast("double").alias("value"), "gauge", "run", "ts", "event_id")


def _gauge(spark, d):
    return _samples(spark, d).select("topic", "broker", "ts_ms", F.col("gauge").alias("value"))


@query(WITH + "SELECT * FROM grown")
def increase_daily(spark, d):
    return M.increase(_samples(spark, d), SERIES, DAY, COUNTED)


@query(WITH + 'SELECT topic, broker, "window", round(increase / 86400, 9) AS rate FROM grown')
def rate_daily(spark, d):
    return M.rate(_samples(spark, d), SERIES, DAY, COUNTED).withColumn("rate", F.round("rate", 9))


@query(WITH + 'SELECT topic, "window", round(sum(increase / 86400), 9) AS rate FROM grown GROUP BY ALL')
def rate_by_label(spark, d):
    return M.rate_by(_samples(spark, d), SERIES, ["topic"], DAY, COUNTED).withColumn("rate", F.round("rate", 9))


@query(
    WITH
    + f""", counted AS (SELECT topic, broker, CAST(ts_ms // {DAY} * {DAY} AS BIGINT) AS "window", CAST(max(n) - min(n) AS DOUBLE) AS c FROM samples GROUP BY ALL)
    SELECT topic, broker, "window", round(increase / nullif(c, 0), 9) AS mean FROM grown JOIN counted USING (topic, broker, "window")"""
)
def mean_by_rates(spark, d):
    s = _samples(spark, d)
    return M.mean_by_rates(s, s.withColumn("value", F.col("n").cast("double")), SERIES, DAY, COUNTED).withColumn("mean", F.round("mean", 9))


BOUNDS = (10.0, 25.0, 50.0, 100.0, 250.0)
BUCKETS = "buckets AS (SELECT event_type AS topic, le, CAST(count(*) FILTER (WHERE e.value <= le) AS DOUBLE) AS value FROM events e, (SELECT unnest([10.0, 25.0, 50.0, 100.0, 250.0, CAST('inf' AS DOUBLE)]::DOUBLE[]) AS le) GROUP BY ALL)"


def _buckets(spark, d):
    e = V.table(spark, d, "events")
    counts = e.groupBy(F.col("event_type").alias("topic")).agg(*(F.count_if(F.col("value") <= b).cast("double").alias(str(i)) for i, b in enumerate((*BOUNDS, float("inf")))))
    pairs = F.explode(F.array(*(F.struct(F.lit(b).alias("le"), F.col(str(i)).alias("value")) for i, b in enumerate((*BOUNDS, float("inf")))))).alias("p")
    return counts.select("topic", pairs).select("topic", "p.le", "p.value")


@query(
    with_views(BUCKETS)
    + """, r AS (SELECT *, lag(le, 1, 0.0) OVER o AS low, lag(value, 1, 0.0) OVER o AS below, max(value) OVER (PARTITION BY topic) * q AS rank FROM buckets, (SELECT unnest([0.5, 0.9, 0.999]) AS q) WINDOW o AS (PARTITION BY topic, q ORDER BY le))
    SELECT topic, CAST(q AS DOUBLE) AS q, round(arg_min(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (rank - below) / (value - below) END, le), 9) AS quantile FROM r WHERE value >= rank GROUP BY topic, q"""
)
def histogram_quantile(spark, d):
    buckets = _buckets(spark, d)
    parts = [M.histogram_quantile(buckets, ["topic"], q).withColumn("q", F.lit(q)) for q in (0.5, 0.9, 0.999)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("quantile", F.round("quantile", 9))


@query(
    WITH
    + """, m AS (SELECT *, gauge > 20 AS is_on, sum(CASE WHEN gauge > 20 THEN 0 ELSE 1 END) OVER (PARTITION BY topic, broker ORDER BY ts_ms) AS island FROM samples)
    SELECT topic, broker, min(ts_ms) AS from_ms, max(ts_ms) AS to_ms, count(*) AS n FROM m WHERE is_on GROUP BY topic, broker, island HAVING max(ts_ms) - min(ts_ms) >= 14400000"""
)
def alert_for(spark, d):
    return M.alert_for(_gauge(spark, d), SERIES, F.col("value") > 20, 4 * 3_600_000)


DAILY = f"""daily AS (SELECT topic, CAST(ts_ms // {DAY} * {DAY} AS BIGINT) AS "window", CAST(count(*) AS DOUBLE) AS value FROM samples GROUP BY ALL)"""


def _daily(spark, d):
    start = (F.floor(F.col("ts_ms") / F.lit(DAY)) * DAY).cast("long").alias("window")
    return _samples(spark, d).groupBy("topic", start).agg(F.count("*").cast("double").alias("value"))


@query(with_views(SAMPLES, DAILY) + """SELECT * FROM daily WHERE topic <> 'view' AND ("window") IN (SELECT "window" FROM daily WHERE topic = 'view' AND value >= 20)""")
def conditions_both(spark, d):
    daily = _daily(spark, d)
    return M.both(daily.where("topic <> 'view'"), daily.where("topic = 'view' and value >= 20"), ["window"])


@query(with_views(SAMPLES, DAILY) + f"""SELECT a.topic, a."window", round(a.value / b.value, 9) AS ratio FROM daily a JOIN daily b ON a.topic = b.topic AND a."window" = b."window" + {DAY}""")
def offset_ratio(spark, d):
    return M.against_offset(_daily(spark, d), ["topic"], DAY).withColumn("ratio", F.round("ratio", 9))


@query(with_views(SAMPLES) + f"""SELECT topic, broker, CAST(ts_ms // {DAY} * {DAY} AS BIGINT) AS "window", CASE WHEN count(*) > 1 THEN round(regr_slope(gauge, (ts_ms % {DAY}) / 1000.0), 7) END AS slope FROM samples GROUP BY ALL""")
def deriv(spark, d):
    return M.derivative(_gauge(spark, d), SERIES, DAY).withColumn("slope", F.round("slope", 7))


@query(with_views(SAMPLES) + "SELECT topic, max(gauge) AS most, round(avg(gauge), 6) AS mean, round(sum(gauge), 4) AS total FROM samples WHERE regexp_full_match(topic, 'c.*|view') GROUP BY topic")
def labelled_aggregates(spark, d):
    found = M.labelled(_gauge(spark, d), "topic", "c.*|view")
    return found.groupBy("topic").agg(F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.sum("value"), 4).alias("total"))


@query(with_views(SAMPLES, DAILY) + """SELECT a.topic, a."window", a.value FROM daily a JOIN daily b ON b.topic = 'view' AND a."window" = b."window" WHERE a.topic <> 'view' AND a.value < b.value""")
def vector_less_than(spark, d):
    daily = _daily(spark, d)
    topics = daily.select("topic").where("topic <> 'view'").distinct()
    view = daily.where("topic = 'view'").drop("topic")
    other = daily.where("topic <> 'view'").select("topic", "window").join(view, "window")
    return M.less_than(daily.join(topics, "topic", "left_semi"), other, ["topic", "window"])


@query(with_views(SAMPLES) + "SELECT sum(v) AS total FROM (SELECT arg_max(value, ts_ms) AS v FROM samples GROUP BY topic, broker)")
def counter_sum_compat(spark, d):
    return M.counter_sum_compat(_samples(spark, d), SERIES)


@query("SELECT event_type AS topic, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY ALL")
def latency_percentiles(spark, d):
    found = M.latency(V.table(spark, d, "events").withColumnRenamed("event_type", "topic"), ["topic"])
    return found.select("topic", *(F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99")))


@query("SELECT event_type AS topic, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY ALL")
def latency_approx(spark, d):
    return M.latency_approx(V.table(spark, d, "events").withColumnRenamed("event_type", "topic"), ["topic"], 1_000_000).withColumn("mean", F.round("mean", 6))


@query("SELECT event_type AS topic, round(avg(value) * 0.8, 6) AS p50, round(avg(value) * 1.5, 6) AS p95, round(avg(value) * 2, 6) AS p99 FROM events GROUP BY ALL")
def latency_compat(spark, d):
    found = M.latency_compat(V.table(spark, d, "events").withColumnRenamed("event_type", "topic"), ["topic"])
    return found.select("topic", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")))


@query("""WITH t AS (SELECT p_brand AS function, CAST(sum(l_quantity) AS DOUBLE) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
    SELECT function, total, round(total * 100.0 / (SELECT sum(total) FROM t), 9) AS percent FROM t ORDER BY total DESC, function LIMIT 10""")
def profile_top(spark, d):
    rows = V.table(spark, d, "lineitem").join(V.table(spark, d, "part"), F.expr("l_partkey = p_partkey")).select(F.col("p_brand").alias("function"), F.col("l_quantity").alias("value"))
    return M.profile_top(rows).withColumn("percent", F.round("percent", 9))


@query(
    """WITH v AS (SELECT user_id, list(CAST(floor(value) AS DOUBLE) ORDER BY event_id) AS v FROM events GROUP BY user_id)
    SELECT user_id, list_reduce(list_prepend(0.0::DOUBLE, v), lambda a, x: floor(0.2::DOUBLE * x + 0.8::DOUBLE * a)) AS ema FROM v"""
)
def ema_fold(spark, d):
    rows = V.table(spark, d, "events").select("user_id", F.col("event_id").alias("ts_ms"), F.floor("value").cast("double").alias("value"))
    return M.moving_average(rows, ["user_id"], truncated=True)


@query(with_views(SAMPLES) + "SELECT topic, broker, ts_ms, gauge AS value, round(avg(gauge) OVER (PARTITION BY topic, broker ORDER BY ts_ms ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS mean FROM samples")
def rolling_chart(spark, d):
    s = _samples(spark, d).drop("value").withColumnRenamed("gauge", "value")
    # As events occurred: SQL's ts_ms alone leaves samples of one millisecond open. Events without a time come last there.
    found = M.rolling(s, SERIES, order=_last("ts", "event_id"))
    return found.select("topic", "broker", "ts_ms", "value", F.round("mean", 6).alias("mean"))
