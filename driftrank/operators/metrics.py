"""Service metrics re-aimed as aggregates over event and result tables
(ME1 rate, ME7 bucket histogram, ME8 histogram quantile; the other
counters are plain group-bys next to the operators they count)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_rate(events: DataFrame, window: str = "1 minute", slide: str | None = None,
               ts: str = "timestamp") -> DataFrame:
    """ME1: events per type per (tumbling or sliding) window, and per second."""
    t = F.timestamp_seconds(F.col(ts))
    win = F.window(t, window, slide) if slide else F.window(t, window)
    seconds = F.unix_seconds(F.col("window.end")) - F.unix_seconds(F.col("window.start"))
    g = events.groupBy(win.alias("window"), "event_type").agg(F.count(F.lit(1)).alias("count"))
    return g.select(F.unix_seconds(F.col("window.start")).alias("window_start"), "event_type",
                    "count", (F.col("count") / seconds).alias("per_second"))


def bucket_histogram(df: DataFrame, col: str, bounds: Sequence[float]) -> DataFrame:
    """ME7: cumulative ``le`` buckets (plus +Inf) in one aggregation pass.

    Output (le string, ub double, ord int, count long), one row per bound.
    """
    aggs = [F.count(F.when(F.col(col) <= F.lit(float(b)), 1)).alias(f"b{i}")
            for i, b in enumerate(bounds)]
    aggs.append(F.count(F.col(col)).alias(f"b{len(bounds)}"))
    one = df.agg(*aggs)
    labels = [str(b) for b in bounds] + ["+Inf"]
    ubs = [float(b) for b in bounds] + [float("inf")]
    rows = F.array(*[F.struct(F.lit(lab).alias("le"), F.lit(ub).alias("ub"),
                              F.lit(i).alias("ord"), F.col(f"b{i}").alias("count"))
                     for i, (lab, ub) in enumerate(zip(labels, ubs))])
    return one.select(F.inline(rows))


def histogram_quantile(buckets: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """ME8: quantile from cumulative buckets, linear inside the first bucket
    whose cumulative count reaches q x total (lower bound 0 for the first
    bucket; the +Inf bucket answers with the largest finite bound).

    The bucket table has one row per bound, so it is packed into one sorted
    array and every quantile is read from it with array functions: one pass,
    no joins.
    """
    packed = buckets.agg(F.sort_array(F.collect_list(
        F.struct("ord", "le", "ub", F.col("count").cast("double").alias("count")))).alias("b"))
    b = F.col("b")
    total = F.element_at(b, -1)["count"]
    outs = []
    for q in quantiles:
        rank = F.lit(float(q)) * total
        hit = F.element_at(F.filter(b, lambda x: x["count"] >= rank), 1)
        prev = F.when(hit["ord"] > 0, F.element_at(b, hit["ord"]))
        lb = F.coalesce(prev["ub"], F.lit(0.0))
        pc = F.coalesce(prev["count"], F.lit(0.0))
        value = (F.when(total <= 0, F.lit(None).cast("double"))
                 .when(hit["le"] == "+Inf", lb)
                 .when(hit["count"] == pc, hit["ub"])
                 .otherwise(lb + (hit["ub"] - lb) * (rank - pc) / (hit["count"] - pc)))
        outs.append(F.struct(F.lit(float(q)).alias("quantile"), value.alias("value")))
    return packed.select(F.inline(F.array(*outs))).where(F.col("value").isNotNull())
