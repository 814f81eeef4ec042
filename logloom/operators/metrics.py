"""Metric queries: rates, quantiles, alert conditions and label algebra over samples (series, ts_ms, value).

Rates count resets of counters (a fall means that counting began anew) and divide by the window; they are not extrapolated to
the window's edges. Windows are ordered within a series only; samples of one time are taken in the order that `order` gives, by default the lower
value first, as no reset can be told from them. A series that is too long for one task can be cut by adding a
stretch of time to `series` together with the last sample of the stretch before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.model import dense_offsets, small

ORDER = ("ts_ms", "value")


def increases(samples: DataFrame, series: Sequence[str], order: Sequence[str] = ORDER) -> DataFrame:
    """Samples with `inc`: what the counter has grown since the sample before (its value after a reset); null for the first."""
    before = F.lag("value").over(W.partitionBy(*series).orderBy(*order))
    inc = F.when(F.col("_before").isNull(), F.lit(None)).when(F.col("value") < F.col("_before"), F.col("value")).otherwise(F.col("value") - F.col("_before"))
    return samples.withColumn("_before", before).withColumn("inc", inc).drop("_before")


def increase(samples: DataFrame, series: Sequence[str], window_ms: int, order: Sequence[str] = ORDER) -> DataFrame:
    """series, window (its start), increase: the growth within each tumbling window, from a window's samples only."""
    start = (F.floor(F.col("ts_ms") / F.lit(window_ms)) * window_ms).cast("long")
    inside = increases(samples.withColumn("window", start), [*series, "window"], order)
    return inside.groupBy(*series, "window").agg(F.coalesce(F.sum("inc"), F.lit(0.0)).alias("increase"))


def rate(samples: DataFrame, series: Sequence[str], window_ms: int, order: Sequence[str] = ORDER) -> DataFrame:
    """series, window, rate per second."""
    return increase(samples, series, window_ms, order).select(*series, "window", (F.col("increase") / (window_ms / 1000.0)).alias("rate"))


def rate_by(samples: DataFrame, series: Sequence[str], labels: Sequence[str], window_ms: int, order: Sequence[str] = ORDER) -> DataFrame:
    """labels, window, rate: rates of series summed by labels."""
    return rate(samples, series, window_ms, order).groupBy(*labels, "window").agg(F.sum("rate").alias("rate"))


def mean_by_rates(sums: DataFrame, counts: DataFrame, series: Sequence[str], window_ms: int, order: Sequence[str] = ORDER) -> DataFrame:
    """series, window, mean: the rate of a sum over the rate of its count; null where nothing was counted. `order` is that of the sums.

    Both rates are over the same seconds, which cancel: increases are divided, as a quotient of quotients would be rounded twice more.
    """
    a = increase(sums, series, window_ms, order).withColumnRenamed("increase", "s")
    b = increase(counts, series, window_ms).withColumnRenamed("increase", "c")
    return a.join(b, [*series, "window"]).select(*series, "window", (F.col("s") / F.nullif(F.col("c"), F.lit(0.0))).alias("mean"))


def histogram_quantile(buckets: DataFrame, by: Sequence[str], q: float) -> DataFrame:
    """by, quantile: from cumulative buckets (le, value; le infinite for all). Linear within the first bucket that reaches the rank; in
    the infinite bucket the highest finite bound; null without observations."""
    rows = buckets.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("le", "value"))).alias("b"))
    rank = F.element_at("b", -1)["value"] * q
    at = F.expr("size(filter(b, x -> x.value < _rank))")
    rows = rows.withColumn("_rank", rank).withColumn("_i", at)
    le, value = F.get("b", F.col("_i"))["le"], F.get("b", F.col("_i"))["value"]
    low = F.when(F.col("_i") == 0, 0.0).otherwise(F.get("b", F.col("_i") - 1)["le"])
    below = F.when(F.col("_i") == 0, 0.0).otherwise(F.get("b", F.col("_i") - 1)["value"])
    inside = low + (le - low) * (F.col("_rank") - below) / F.nullif(value - below, F.lit(0.0))
    quantile = F.when(F.element_at("b", -1)["value"] <= 0, F.lit(None)).when(le == float("inf"), low).otherwise(inside)
    return rows.select(*by, quantile.cast("double").alias("quantile"))


def alert_for(samples: DataFrame, series: Sequence[str], condition: Column, for_ms: int) -> DataFrame:
    """series, from_ms, to_ms, n: stretches over which a condition held at every sample for at least `for_ms`."""
    own = W.partitionBy(*series).orderBy("ts_ms")
    rows = samples.withColumn("_on", F.coalesce(condition, F.lit(False)))
    rows = rows.withColumn("_island", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(own)).where("_on")
    found = rows.groupBy(*series, "_island").agg(F.min("ts_ms").alias("from_ms"), F.max("ts_ms").alias("to_ms"), F.count("*").alias("n"))
    return found.where(F.col("to_ms") - F.col("from_ms") >= for_ms).drop("_island")


def both(left: DataFrame, right: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Rows of `left` whose labels occur in `right` too (the `and` of conditions)."""
    return left.join(right.select(*labels).distinct(), list(labels), "left_semi")


def against_offset(values: DataFrame, labels: Sequence[str], offset_ms: int) -> DataFrame:
    """labels, window, ratio: each window's value over the value one offset earlier; windows without one are left out."""
    earlier = values.select(*labels, (F.col("window") + offset_ms).alias("window"), F.col("value").alias("_before"))
    return values.join(earlier, [*labels, "window"]).select(*labels, "window", (F.col("value") / F.nullif(F.col("_before"), F.lit(0.0))).alias("ratio"))


def derivative(samples: DataFrame, series: Sequence[str], window_ms: int) -> DataFrame:
    """series, window, slope per second of a gauge in each window (least squares); null with fewer than two samples."""
    start = (F.floor(F.col("ts_ms") / F.lit(window_ms)) * window_ms).cast("long")
    seconds = (F.col("ts_ms") - F.col("window")) / 1000.0
    return samples.withColumn("window", start).groupBy(*series, "window").agg(F.regr_slope("value", seconds).alias("slope"))


def labelled(samples: DataFrame, label: str, pattern: str) -> DataFrame:
    """Samples whose label matches a pattern as a whole."""
    return samples.where(F.col(label).rlike(f"^(?:{pattern})$"))


def less_than(left: DataFrame, right: DataFrame, labels: Sequence[str]) -> DataFrame:
    """labels, value of `left` where it is below the value of `right` with the same labels."""
    return left.join(right.select(*labels, F.col("value").alias("_other")), list(labels)).where("value < _other").select(*labels, "value")


def counter_sum_compat(samples: DataFrame, series: Sequence[str]) -> DataFrame:
    """total: the last values of all counters summed, which some dashboards show as a rate."""
    return samples.groupBy(*series).agg(F.max_by("value", "ts_ms").alias("v")).agg(F.sum("v").alias("total"))


def latency(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, mean, p50, p95, p99: exact percentiles by interpolation.

    Equal values are counted first; percentiles are read off the running counts of a group's distinct values, a sort that spills, so no group is held
    in memory.
    """
    counted = values.where("value is not null").groupBy(*by, "value").agg(F.count("*").alias("n"))
    upto = W.partitionBy(*by).orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = counted.withColumn("upto", F.sum("n").over(upto))
    totals = values.groupBy(*by).agg(F.avg("value").alias("mean"), F.count("value").alias("total"))
    joined = ranked.join(small(totals), list(by))

    def at(place):
        return F.min(F.when(F.col("upto") > place, F.col("value")))

    def p(q: float):
        place = (F.col("total") - 1) * F.lit(q)
        low, high, part = at(F.floor(place)), at(F.ceil(place)), F.any_value(place - F.floor(place))
        return low + (high - low) * part

    return joined.groupBy(*by).agg(F.any_value("mean").alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


def latency_approx(values: DataFrame, by: Sequence[str], accuracy: int = 10_000) -> DataFrame:
    """`latency` with mergeable sketches, for groups too large to hold."""
    return values.groupBy(*by).agg(F.avg("value").alias("mean"), *(F.percentile_approx("value", q, accuracy).alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))))


def latency_compat(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, p50, p95, p99 as some consoles show them: 0.8, 1.5 and 2 times the mean."""
    return values.groupBy(*by).agg(*((F.avg("value") * f).alias(n) for n, f in (("p50", 0.8), ("p95", 1.5), ("p99", 2.0))))


def profile_top(samples: DataFrame, n: int = 10) -> DataFrame:
    """function, total, percent of the n functions with the most samples."""
    by = samples.groupBy("function").agg(F.sum("value").alias("total"))
    whole = by.agg(F.sum("total")).first()[0]
    return by.orderBy(F.desc("total"), "function").limit(n).select("function", "total", (F.col("total") * 100.0 / F.lit(whole or 1.0)).alias("percent"))


def moving_average(rows: DataFrame, series: Sequence[str], alpha: float = 0.2, truncated: bool = False, stretch: int = 10_000) -> DataFrame:
    """series, ema: an exponential average folded in order, from 0; `truncated` cuts every step to a whole number.

    Stretches of so many rows are folded side by side; a row for each stretch is left to be chained. A stretch is linear in the value that it starts
    from. A truncated one is not, but it never falls as that value grows: folding the least and the greatest value that the series allows leaves the few
    whole numbers (five at most after some hundred rows) that the next stretch can start from, and it is folded from each of these.
    """
    step = lambda a, x: (F.lit(alpha) * x.value + F.lit(1 - alpha) * a)
    fold = (lambda a, x: F.floor(step(a, x)).cast("double")) if truncated else step
    numbered = dense_offsets(rows.select(*series, "ts_ms", "value"), tuple(series), F.floor(F.col("ts_ms") / F.lit(3_600_000)), "ts_ms", "value")
    placed = numbered.select(*series, F.expr(f"offset div {stretch}").alias("_s"), F.struct("offset", "value").alias("_x"))
    held = placed.groupBy(*series, "_s").agg(F.array_sort(F.collect_list("_x")).alias("_v"))
    along = lambda *parts: F.array_sort(F.collect_list(F.struct("_s", *parts)))
    if not truncated:
        parts = held.select(*series, "_s", F.pow(F.lit(1 - alpha), F.size("_v")).alias("keeps"), F.aggregate("_v", F.lit(0.0), fold).alias("adds"))
        return parts.groupBy(*series).agg(along("keeps", "adds").alias("_p")).select(*series, F.aggregate("_p", F.lit(0.0), lambda a, p: a * p.keeps + p.adds).alias("ema"))
    least, greatest = F.floor(F.least(F.min("value"), F.lit(0.0))) - 1, F.ceil(F.greatest(F.max("value"), F.lit(0.0))) + 1
    bounds = rows.groupBy(*series).agg(least.cast("double").alias("_least"), greatest.cast("double").alias("_greatest"))
    ends = held.join(small(bounds), list(series)).select(*series, (F.col("_s") + 1).alias("_s"), *(F.aggregate("_v", F.col(c), fold).cast("long").alias(c) for c in ("_least", "_greatest")))
    met = held.join(ends, [*series, "_s"], "left")
    low = F.coalesce("_least", F.lit(0).cast("long"))
    starts = F.sequence(low, F.coalesce("_greatest", F.lit(0).cast("long")))
    parts = met.select(*series, "_s", low.alias("low"), F.transform(starts, lambda a: F.aggregate("_v", a.cast("double"), fold)).alias("ends"))
    chain = lambda a, p: F.get(p.ends, (a - p.low).cast("int"))
    return parts.groupBy(*series).agg(along("low", "ends").alias("_p")).select(*series, F.aggregate("_p", F.lit(0.0), chain).alias("ema"))


def rolling(samples: DataFrame, series: Sequence[str], n: int = 30, order: Sequence[str | Column] = ORDER) -> DataFrame:
    """Samples with `mean` over the last n of their series, in the order that `order` gives."""
    return samples.withColumn("mean", F.avg("value").over(W.partitionBy(*series).orderBy(*order).rowsBetween(-(n - 1), 0)))
