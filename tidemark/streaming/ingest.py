"""Ingest of arriving snapshot rows, a micro-batch a time.

A micro-batch may hold any part of any days. Its rows wait in a table by day, and a day
is diffed as a whole once a row of a later day has come, or when the run ends. Rows of
a day that is done already are kept apart and can be looked at; they change nothing.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.diff import apply_actions, classify_day, day_events, with_keys
from tidemark.operators.store import append_events, remove, replace_table, write_log
from tidemark.sources.snapshots import daily_values, exists, last_date, listing

STATE = "domain string, query_type string, value array<string>, missing_since date"
FOUND = "query_name string, query_type string, val string, batch long, day date"


def ingest_days(spark: SparkSession, found: DataFrame, root: str, grace: int = 0) -> int:
    """Diff each day of answers (day, query_name, query_type, val) against the state; how many days were new.

    Days are whole. Those at or before the log's are done already, so a replay changes
    nothing but repeated rows of its last day, which readers drop.
    """
    log, place = f"{root}/ingest_log.json", f"{root}/state"
    done = last_date(spark, log)
    snapshots = daily_values(found, "day")
    days = sorted(r[0] for r in found.select("day").distinct().collect())  # bounded by the calendar
    fresh = [d for d in days if done is None or d > done]
    for day in fresh:
        state = spark.read.schema(STATE).parquet(place) if exists(spark, place) else spark.createDataFrame([], STATE)
        today = snapshots.where(snapshots["day"] == day)
        actions = classify_day(today, state, day, grace).cache()
        append_events(with_keys(day_events(actions, day, grace)), f"{root}/events")
        replace_table(apply_actions(state, actions, day, grace), place)
        write_log(spark, log, day)
        actions.unpersist()
    return len(fresh)


def _waiting(spark: SparkSession, root: str) -> dict[datetime.date, list[str]]:
    """The folders of rows that wait, by day."""
    out: dict[datetime.date, list[str]] = {}
    for batch, folder, _ in listing(spark, f"{root}/pending"):
        for name, inner, _ in listing(spark, f"{root}/pending/{batch}") if folder else []:
            if inner and name.startswith("day="):
                out.setdefault(datetime.date.fromisoformat(name[4:]), []).append(f"{root}/pending/{batch}/{name}")
    return out


def close_days(spark: SparkSession, root: str, grace: int = 0, last: bool = True) -> int:
    """Diff the days that wait, the last of them only if told so; how many were new."""
    waiting = _waiting(spark, root)
    days = sorted(waiting)[: None if last else -1]
    if not days:
        return 0
    rows = spark.read.schema(FOUND).option("basePath", f"{root}/pending").parquet(*[x for d in days for x in waiting[d]])
    new = ingest_days(spark, rows, root, grace)
    for d in days:
        for x in waiting[d]:
            remove(spark, x)
    return new


def take_batch(raw: DataFrame, batch: int, root: str, grace: int = 0) -> None:
    """Put a micro-batch's answers to those that wait, and diff the days that are whole now.

    What a batch wrote before a crash stays as it was when the batch is replayed.
    """
    spark, place = raw.sparkSession, f"{root}/pending/batch={batch}"
    if not exists(spark, f"{place}/_SUCCESS"):
        found, done = answers_by_day(raw), last_date(spark, f"{root}/ingest_log.json")
        if done is not None:
            late = found.where(F.col("day") <= F.lit(done))
            if not late.isEmpty():
                late.write.mode("overwrite").parquet(f"{root}/late/batch={batch}")
            found = found.where(F.col("day") > F.lit(done))
        found.write.mode("overwrite").partitionBy("day").parquet(place)
    close_days(spark, root, grace, last=False)
    for name, _, _ in listing(spark, f"{root}/pending"):
        if name != f"batch={batch}" and not any(n.startswith("day=") for n, _, _ in listing(spark, f"{root}/pending/{name}")):
            remove(spark, f"{root}/pending/{name}")


def late_rows(spark: SparkSession, root: str) -> DataFrame:
    """Rows that came after their day was done, with their batch."""
    schema = "day date, query_name string, query_type string, val string, batch long"
    return spark.read.schema(schema).parquet(f"{root}/late") if exists(spark, f"{root}/late") else spark.createDataFrame([], schema)


def ingest_stream(raw: DataFrame, root: str, checkpoint: str, grace: int = 0, close_last: bool = True) -> StreamingQuery:
    """Take all that is there of streaming raw rows that have a `day`; the query, which has ended.

    With close_last the last day counts as whole when the run ends; without, it waits
    for the next run's rows.
    """
    query = raw.writeStream.foreachBatch(lambda rows, batch: take_batch(rows, batch, root, grace)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if close_last:
        close_days(raw.sparkSession, root, grace)
    return query


def answers_by_day(raw: DataFrame) -> DataFrame:
    wanted = ((F.col("query_type") == "MX") & F.col("mx_address").isNotNull()) | ((F.col("query_type") == "TXT") & F.col("txt_text").isNotNull())
    return raw.where(wanted).select("day", "query_name", "query_type", F.coalesce("mx_address", "txt_text").alias("val"))
