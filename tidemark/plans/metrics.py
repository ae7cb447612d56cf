"""Metrics of an event history: types, churn, spans, volatility and the grace curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.diff import classified

#: The grace periods that are reported, the days of the curve, and days of a short life.
GRACE_DAYS, EPHEMERAL_DAYS = 30, 7


def _of(kind: str) -> Column:
    return F.col("event_type") == kind


def date_range(events: DataFrame) -> DataFrame:
    return events.agg(F.min("measurement_date").alias("first_date"), F.max("measurement_date").alias("last_date"), F.countDistinct("measurement_date").alias("n_days"))


def event_types(events: DataFrame) -> DataFrame:
    counts = classified(events).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("event_type", "n", F.round(F.col("n") * F.lit(100.0) / F.sum("n").over(Window.partitionBy()), 2).alias("pct"))


def unique_domains(events: DataFrame) -> DataFrame:
    """By record type and, as (all), altogether; events need a registrable_domain."""
    counts = [F.countDistinct("domain").alias("domains"), F.countDistinct("registrable_domain").alias("registrable_domains")]
    return events.groupBy("query_type").agg(*counts).unionByName(events.agg(*counts).withColumn("query_type", F.lit("(all)")))


def types_by_record(events: DataFrame) -> DataFrame:
    kinds = {"appearances": "appearance", "disappearances": "disappearance", "changes": "change"}
    return classified(events).groupBy("query_type").agg(
        F.count(F.lit(1)).alias("total"), *(F.count_if(_of(v)).alias(k) for k, v in kinds.items()), F.countDistinct("domain").alias("domains")
    )


def per_day(events: DataFrame) -> DataFrame:
    return events.groupBy("measurement_date").agg(F.count(F.lit(1)).alias("n"))


def per_day_stats(events: DataFrame) -> DataFrame:
    """Least, most, mean and median events a day, cut to whole numbers, and days under 100."""
    whole = lambda c: F.floor(c).cast("long")
    return per_day(events).agg(
        F.min("n").alias("min_n"), F.max("n").alias("max_n"), whole(F.avg("n")).alias("avg_n"), whole(F.median("n")).alias("median_n"), F.count_if(F.col("n") < 100).alias("low_days")
    )


def _pairs(events: DataFrame, first: str, second: str) -> DataFrame:
    return classified(events).where(_of(first) & (F.col("next_type") == second)).withColumn("days", F.datediff("next_date", "measurement_date").cast("long"))


def gap_histogram(events: DataFrame) -> DataFrame:
    """Days between a disappearance and the next appearance."""
    return _pairs(events, "disappearance", "appearance").groupBy(F.col("days").alias("gap")).agg(F.count(F.lit(1)).alias("n"))


def span_histogram(events: DataFrame, most: int = 30) -> DataFrame:
    """Days between an appearance and the next disappearance, with the running share of all such pairs."""
    pairs = _pairs(events, "appearance", "disappearance")
    total = pairs.agg(F.count(F.lit(1)).alias("total"))
    counts = pairs.where(F.col("days") <= most).groupBy(F.col("days").alias("span")).agg(F.count(F.lit(1)).alias("n"))
    so_far = F.sum("n").over(Window.orderBy("span"))
    return counts.join(F.broadcast(total)).select("span", "n", F.round(so_far * F.lit(100.0) / F.col("total"), 2).alias("cum_pct"))


def ephemeral_pairs(events: DataFrame) -> DataFrame:
    short = F.col("days") < EPHEMERAL_DAYS
    return _pairs(events, "appearance", "disappearance").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(short).alias("ephemeral"), F.countDistinct(F.when(short, F.struct("domain", "query_type"))).alias("ephemeral_keys")
    )


def multi_churn(events: DataFrame) -> DataFrame:
    """How many keys disappeared how often."""
    by_key = classified(events).where(_of("disappearance")).groupBy("domain", "query_type").agg(F.count(F.lit(1)).alias("n_disappearances"))
    return by_key.groupBy("n_disappearances").agg(F.count(F.lit(1)).alias("n_keys"))


def top_volatile(events: DataFrame, top: int = 1000) -> DataFrame:
    kinds = {"changes": "change", "disappearances": "disappearance", "appearances": "appearance"}
    counts = classified(events).groupBy("domain", "query_type").agg(F.count(F.lit(1)).alias("total_events"), *(F.count_if(_of(v)).alias(k) for k, v in kinds.items()))
    return counts.orderBy(F.desc("total_events"), "domain", "query_type").limit(top)


def grace_curve(events: DataFrame, days: int = GRACE_DAYS) -> DataFrame:
    """By days of grace: what they would suppress, the gain of the day, its change, and shares.

    The curve has `days` rows, so its windows are small.
    """
    gaps = gap_histogram(events)
    churn = events.where("value IS NULL AND prev_value IS NOT NULL").agg(F.count(F.lit(1)).alias("disappearances"))
    every = events.sparkSession.range(1, days + 1).select(F.col("id").alias("grace"))
    day = Window.orderBy("grace")
    rows = every.join(gaps, every["grace"] == gaps["gap"], "left").select("grace", F.coalesce("n", F.lit(0)).cast("long").alias("marginal"))
    rows = rows.withColumn("suppressed", F.sum("marginal").over(day)).withColumn("second_diff", F.lead("marginal").over(day) - F.col("marginal"))
    return rows.join(F.broadcast(churn)).select("grace", "suppressed", "marginal", "second_diff", F.round(F.col("suppressed") * F.lit(100.0) / F.nullif("disappearances", F.lit(0)), 2).alias("pct"))


def grace_knee(events: DataFrame) -> DataFrame:
    """The day after the steepest fall of the gain, the first if several are."""
    curve = grace_curve(events)
    knee = curve.where("second_diff IS NOT NULL").agg(F.min_by(F.col("grace") + 1, F.struct("second_diff", "grace")).alias("knee_day"))
    return knee.join(F.broadcast(curve.select("grace", "suppressed")), F.col("knee_day") == F.col("grace")).select("knee_day", "suppressed")


def report(events: DataFrame) -> dict[str, DataFrame]:
    """All sections of the metrics report by name."""
    return {
        "date_range": date_range(events), "event_types": event_types(events), "unique_domains": unique_domains(events), "gaps": gap_histogram(events), "grace": grace_curve(events),
        "knee": grace_knee(events), "ephemeral": ephemeral_pairs(events), "spans": span_histogram(events), "by_record": types_by_record(events),
        "per_day": per_day_stats(events), "multi_churn": multi_churn(events), "volatile": top_volatile(events),
    }
