"""Checks of a history against the raw snapshots, and timings of pruned against full reads."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.history import value_as_of
from tidemark.operators.store import of_domain, of_suffix
from tidemark.sources.snapshots import sample_rows


def completeness(events: DataFrame, samples: DataFrame) -> DataFrame:
    """Raw answers (domain, query_type, day, raw_value) with outcome: pass, fail, or skip after a disappearance."""
    asked = samples.select("domain", "query_type", "day").distinct()
    rows = samples.join(value_as_of(events, asked), ["domain", "query_type", "day"])
    outcome = F.when(~F.col("found"), "fail").when(F.col("value").isNull(), "skip").when(F.array_contains("value", F.col("raw_value")), "pass").otherwise("fail")
    return rows.select("domain", "query_type", "day", "raw_value", outcome.alias("outcome"))


def correctness(events: DataFrame, snapshots: DataFrame, disappearances: bool = True) -> DataFrame:
    """Events against the snapshot of their day: pass, fail, or skip.

    An event with a value must equal what the day shows; a disappearance passes if
    the day shows nothing, and is skipped else. A day without any data is skipped unless
    one of its events is a disappearance.
    """
    chosen = events if disappearances else events.where("value IS NOT NULL")
    seen = snapshots.select("domain", "query_type", F.col("day").alias("measurement_date"), F.col("value").alias("shown"))
    days = snapshots.select(F.col("day").alias("measurement_date")).distinct().withColumn("measured", F.lit(True))
    gone = chosen.groupBy("measurement_date").agg(F.bool_or(F.col("value").isNull()).alias("any_gone"))
    rows = chosen.join(seen, ["domain", "query_type", "measurement_date"], "left").join(days, "measurement_date", "left").join(gone, "measurement_date")
    outcome = (
        F.when(F.col("measured").isNull() & ~F.col("any_gone"), "skip")
        .when(F.col("value").isNull(), F.when(F.col("shown").isNull(), "pass").otherwise("skip"))
        .when(F.col("value").eqNullSafe(F.col("shown")), "pass")
        .otherwise("fail")
    )
    return rows.select("domain", "query_type", "measurement_date", outcome.alias("outcome"))


def outcomes(checked: DataFrame) -> DataFrame:
    return checked.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def sampled_events(events: DataFrame, n: int, seed: int, disappearances: bool = False) -> DataFrame:
    kept = events if disappearances else events.where("value IS NOT NULL")
    return sample_rows(kept.select("domain", "query_type", "measurement_date", "value", "prev_value"), n, seed)


def timed(runs: dict[str, Callable[[], DataFrame]], warm: bool = True) -> list[tuple[str, float, int]]:
    """Name, seconds and rows of each run, after a warm one."""
    out = []
    for name, run in runs.items():
        if warm:
            run().count()
        began = time.perf_counter()
        rows = run().count()
        out.append((name, time.perf_counter() - began, rows))
    return out


def look_ups(events: DataFrame, raw: DataFrame, name: str) -> dict[str, Callable[[], DataFrame]]:
    """The four look-ups of a name that are compared: the host itself and all at or below it, in the store and in raw rows."""
    host = name.lower().strip().rstrip(".") + "."
    typed = raw.where(F.col("query_type").isin("MX", "TXT"))
    asked = F.lower("query_name")
    return {
        "store exact": lambda: of_domain(events, name), "store suffix": lambda: of_suffix(events, name),
        "raw exact": lambda: typed.where(asked == host), "raw suffix": lambda: typed.where((asked == host) | asked.endswith("." + host)),
    }


def look_up_counts(events: DataFrame, raw: DataFrame, names: list[str]) -> DataFrame:
    """name, look_up and the rows that each finds."""
    out = None
    for name in names:
        for kind, run in look_ups(events, raw, name).items():
            one = run().agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), F.lit(kind).alias("look_up"), "n_rows")
            out = one if out is None else out.unionByName(one)
    return out


def compared(events: DataFrame, raw: DataFrame, names: list[str], days: int, sources: int, all_days: int) -> Iterator[tuple[str, str, float, int, float]]:
    """name, look-up, seconds, rows, and for raw rows what all days of all sources would take; raw holds `days` of one source."""
    for name in names:
        for kind, seconds, rows in timed(look_ups(events, raw, name)):
            yield name, kind, seconds, rows, extrapolated(seconds, days, sources, all_days) if kind.startswith("raw") else seconds


def streamed_rows(df: DataFrame) -> int:
    """How many rows an unfiltered scan brings to the driver, one partition at a time."""
    return sum(1 for _ in df.toLocalIterator(prefetchPartitions=True))


def extrapolated(seconds: float, days: int, sources: int, all_days: int) -> float:
    """What a scan of some days would take for all days of all sources."""
    return seconds / max(days, 1) * all_days * sources
