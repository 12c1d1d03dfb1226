"""Metering: roll-ups, rolling budgets, and gap-filled calendars. Unreported tokens stay null, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rolling windows of a budget, in seconds.
WINDOWS = {"hour": 3600, "day": 86_400, "week": 604_800, "month": 2_592_000}


def rollup(runs: DataFrame) -> DataFrame:
    """Calls and tokens by stage, by provider and in all, from one pass (grouping sets)."""
    return runs.groupingSets([["stage"], ["provider"], []], "stage", "provider").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def budget(runs: DataFrame, caps: DataFrame, now: Column) -> DataFrame:
    """Use of each cap (provider, scale, seconds, cap): used, remaining, resets_at, unmetered.

    Runs are summed once by provider with one conditional sum for each window; the caps join that small result.
    """
    inside = lambda s: F.col("created_at") >= now - F.make_dt_interval(secs=F.lit(s))
    tokens = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    rows = []
    sums = runs.groupBy("provider").agg(*[x for scale, s in WINDOWS.items() for x in (F.coalesce(F.sum(F.when(inside(s), tokens)), F.lit(0)).alias(f"used_{scale}"), F.min(F.when(inside(s) & (tokens > 0), F.col("created_at"))).alias(f"oldest_{scale}"), F.coalesce(F.bool_or(inside(s) & F.col("input_tokens").isNull()), F.lit(False)).alias(f"unmetered_{scale}"))])
    for scale, s in WINDOWS.items():
        rows.append(F.struct(F.lit(scale).alias("scale"), F.lit(s).alias("seconds"), F.col(f"used_{scale}").alias("used"), F.col(f"oldest_{scale}").alias("oldest"), F.col(f"unmetered_{scale}").alias("unmetered")))
    long = sums.select("provider", F.explode(F.array(*rows)).alias("w")).select("provider", "w.*")
    used = F.coalesce("used", F.lit(0))
    got = caps.join(long, ["provider", "scale"], "left")
    return got.select("provider", "scale", used.alias("used"), "cap", F.greatest(F.lit(0), F.col("cap") - used).alias("remaining"), (F.col("oldest") + F.make_dt_interval(secs=F.col("seconds"))).alias("resets_at"), F.coalesce("unmetered", F.lit(False)).alias("unmetered"))


def breach(report: DataFrame) -> DataFrame:
    """Per provider the first breached window, shortest first; an unmetered provider is blocked in any case."""
    order = F.when(F.col("unmetered"), 0)
    for i, scale in enumerate(WINDOWS, 1):
        order = order.when((F.col("scale") == scale) & (F.col("remaining") == 0), i)
    own = report.withColumn("_order", order).where("_order is not null")
    return own.groupBy("provider").agg(F.min_by(F.when(F.col("unmetered"), "unmetered").otherwise(F.col("scale")), "_order").alias("reason"))


def daily(rows: DataFrame, clock: str, values: list[Column], first: str, last: str) -> DataFrame:
    """One row for each day from ``first`` to ``last``; days without rows have nulls (counts: what ``values`` say)."""
    days = rows.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"))
    got = rows.groupBy(F.to_date(clock).alias("day")).agg(*values)
    return days.join(got, "day", "left")


def by_grain(days: DataFrame, grain: str, values: list[Column]) -> DataFrame:
    """Days rolled to weeks (from Monday) or months."""
    return days.groupBy(F.to_date(F.date_trunc(grain, F.col("day").cast("timestamp"))).alias("bucket")).agg(*values)


def mean_of_last(rows: DataFrame, key: list[str], order: str, value: str, last: int = 8, least: int = 3) -> DataFrame:
    """A rolling mean of the last ``last`` samples, null before there are ``least``."""
    from pyspark.sql import Window

    w = Window.partitionBy(*key).orderBy(order).rowsBetween(-(last - 1), 0)
    return rows.withColumn("mean", F.when(F.count(value).over(w) >= least, F.avg(value).over(w)))
