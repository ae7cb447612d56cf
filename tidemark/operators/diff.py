"""From daily snapshots to change events, and the state that carries from day to day.

A history of many days is diffed in closed form: each key's days stand in a window
next to the days on which anything was measured, so no state is carried. A single new
day is diffed against the state by a full outer join. Both give the same events.

Semantics: a value that appears, changes or disappears makes an event. With a grace
of G days, a key that comes back with the same value after at most G days was never
gone; any other absence is dated to its first day. Days without any data are not
measured, and state is carried over them.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.names import bucket, registrable_domain, reversed_domain


def nothing() -> Column:
    return F.lit(None).cast("array<string>")


def _event(day: Column, value: Column, before: Column) -> Column:
    return F.struct(day.alias("measurement_date"), value.alias("value"), before.alias("prev_value"))


def history_diff(snapshots: DataFrame, grace: int = 0, measured: DataFrame | None = None) -> DataFrame:
    """snapshots (day, domain, query_type, value) to domain, query_type, measurement_date, value, prev_value.

    A key has one row a day at most, so no window partition is larger than the
    number of days. The table of days is bounded by the calendar. Pass the rows that
    snapshots were made from as `measured` to take the days from there, before any shuffle.
    """
    by_day = Window.orderBy("day")
    days = (snapshots if measured is None else measured).select("day").distinct().select(
        "day", F.row_number().over(by_day).alias("i"), F.lead("day").over(by_day).alias("next_day"), F.max("day").over(Window.partitionBy()).alias("last_day")
    )
    key = Window.partitionBy("domain", "query_type").orderBy("day")
    rows = snapshots.join(F.broadcast(days), "day").select(
        "*", F.lag("value").over(key).alias("pv"), F.lag("i").over(key).alias("pi"), F.lag("next_day").over(key).alias("gone"), F.lead("i").over(key).alias("li")
    )
    gap = F.col("i") > F.col("pi") + 1
    churn = (F.col("value") == F.col("pv")) & (F.datediff("day", "gone") <= grace)
    changed = (F.col("i") == F.col("pi") + 1) & ~F.col("value").eqNullSafe(F.col("pv"))
    left = F.col("li").isNull() & F.col("next_day").isNotNull()
    if grace:
        left = left & (F.datediff("last_day", "next_day") > grace)
    events = F.array(
        F.when(F.col("pi").isNull() | (gap & ~churn), _event(F.col("day"), F.col("value"), nothing())),
        F.when(changed, _event(F.col("day"), F.col("value"), F.col("pv"))),
        F.when(gap & ~churn, _event(F.col("gone"), nothing(), F.col("pv"))),
        F.when(left, _event(F.col("next_day"), nothing(), F.col("value"))),
    )
    return rows.select("domain", "query_type", F.explode(F.array_compact(events)).alias("e")).select("domain", "query_type", "e.*")


def with_keys(events: DataFrame) -> DataFrame:
    """Adds registrable_domain, domain_reversed and bucket."""
    named = events.withColumn("registrable_domain", registrable_domain(F.col("domain"))).withColumn("domain_reversed", reversed_domain(F.col("domain")))
    return named.withColumn("bucket", bucket(F.col("registrable_domain")))


def classify_day(today: DataFrame, state: DataFrame, day: datetime.date, grace: int = 0) -> DataFrame:
    """One row per key that needs action: today's and the state's value, missing_since and case_type."""
    t = today.select(F.col("domain").alias("t_domain"), F.col("query_type").alias("t_type"), F.col("value").alias("today_value"))
    s = state.select(F.col("domain").alias("s_domain"), F.col("query_type").alias("s_type"), F.col("value").alias("state_value"), "missing_since")
    both = t.join(s, (F.col("t_domain") == F.col("s_domain")) & (F.col("t_type") == F.col("s_type")), "full_outer")
    absent, missing = F.col("t_domain").isNull(), F.col("missing_since").isNotNull()
    away = F.datediff(F.lit(day), "missing_since")
    case = (
        F.when(absent & ~missing & F.col("state_value").isNotNull(), "new_disappearance")
        .when(absent & missing & (away > grace), "grace_expired")
        .when(absent, "in_grace")
        .when(missing & (F.col("today_value") == F.col("state_value")) & (away <= grace), "churn")
        .when(missing, "genuine_reappearance")
        .when(F.col("s_domain").isNull(), "new_domain")
        .when(~F.col("today_value").eqNullSafe(F.col("state_value")), "genuine_change")
        .otherwise("no_change")
    )
    return both.select(
        F.coalesce("t_domain", "s_domain").alias("domain"), F.coalesce("t_type", "s_type").alias("query_type"), "today_value", "state_value", "missing_since", case.alias("case_type")
    ).where(~F.col("case_type").isin("in_grace", "no_change"))


def day_events(actions: DataFrame, day: datetime.date, grace: int = 0) -> DataFrame:
    """Events of classified keys; a reappearance makes two, and an expired grace one that is dated back."""
    case, date = F.col("case_type"), F.lit(day)
    back = _event(F.col("missing_since"), nothing(), F.col("state_value"))
    events = F.array(
        F.when(case.isin("new_domain", "genuine_change"), _event(date, F.col("today_value"), F.col("state_value"))),
        F.when((case == "new_disappearance") & F.lit(grace == 0), _event(date, nothing(), F.col("state_value"))),
        F.when(case.isin("grace_expired", "genuine_reappearance"), back),
        F.when(case == "genuine_reappearance", _event(date, F.col("today_value"), nothing())),
    )
    return actions.select("domain", "query_type", F.explode(F.array_compact(events)).alias("e")).select("domain", "query_type", "e.*")


def apply_actions(state: DataFrame, actions: DataFrame, day: datetime.date, grace: int = 0) -> DataFrame:
    """The state after a day: keys with an action go, and come back with what the action says."""
    case = F.col("case_type")
    gone = (case == "grace_expired") | ((case == "new_disappearance") & F.lit(grace == 0))
    fresh = case.isin("new_domain", "genuine_change", "genuine_reappearance")
    new = actions.where(~gone).select(
        "domain", "query_type", F.when(fresh, F.col("today_value")).otherwise(F.col("state_value")).alias("value"),
        F.when(case == "new_disappearance", F.lit(day)).cast("date").alias("missing_since"),
    )
    kept = state.select("domain", "query_type", "value", "missing_since").join(actions.select("domain", "query_type"), ["domain", "query_type"], "left_anti")
    return kept.unionByName(new)


def state_from_events(events: DataFrame) -> DataFrame:
    """The live keys: the last event of each has a value. Keys that ended in a disappearance are not in it."""
    last = events.groupBy("domain", "query_type").agg(
        F.max_by(F.struct("value"), F.struct("measurement_date", F.col("value").isNotNull())).alias("last"), F.max("measurement_date").alias("last_date")
    )
    return last.where(F.col("last.value").isNotNull()).select("domain", "query_type", "last.value", F.lit(None).cast("date").alias("missing_since"), "last_date")


def classified(events: DataFrame) -> DataFrame:
    """Events with event_type, and type and date of the key's next event.

    Of two events of one day, the disappearance comes first.
    """
    kind = (
        F.when(F.col("prev_value").isNull() & F.col("value").isNotNull(), "appearance")
        .when(F.col("value").isNull() & F.col("prev_value").isNotNull(), "disappearance")
        .otherwise("change")
    )
    key = Window.partitionBy("domain", "query_type").orderBy("measurement_date", F.col("value").isNotNull())
    typed = events.withColumn("event_type", kind)
    return typed.select("*", F.lead("event_type").over(key).alias("next_type"), F.lead("measurement_date").over(key).alias("next_date"))
