import datetime
import random

import pytest

from tidemark.operators import diff

SNAP, EVENT = "day date, domain string, query_type string, value array<string>", "domain string, query_type string, measurement_date date, value array<string>, prev_value array<string>"


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(n - 1)


def snapshots(spark, rows):
    return spark.createDataFrame([(day(d), k, "MX", sorted(v)) for d, k, v in rows], SNAP)


def found(df):
    return sorted((r.domain, r.measurement_date, r.value is not None, tuple(r.prev_value or ()), tuple(r.value or ())) for r in df.collect())


def event(n, before, after, name="x"):
    return (name, day(n), after is not None, tuple(before or ()), tuple(after or ()))


MEASURED = [(d, "other", ["o"]) for d in range(1, 21)]
MICRO = {
    "new": ([(1, ["a"]), (2, ["a"])], {0: [event(1, None, ["a"])]}, 2),
    "change": ([(1, ["a"]), (2, ["b"])], {0: [event(1, None, ["a"]), event(2, ["a"], ["b"])], 7: [event(1, None, ["a"]), event(2, ["a"], ["b"])]}, 2),
    "reorder": ([(1, ["b", "a"]), (2, ["a", "b"])], {0: [event(1, None, ["a", "b"])]}, 2),
    "disappear": ([(1, ["a"])], {0: [event(1, None, ["a"]), event(2, ["a"], None)], 7: [event(1, None, ["a"]), event(2, ["a"], None)]}, 20),
    "pending": ([(1, ["a"])], {0: [event(1, None, ["a"]), event(2, ["a"], None)], 7: [event(1, None, ["a"])]}, 5),
    "churn": ([(1, ["a"]), (5, ["a"])], {0: [event(1, None, ["a"]), event(2, ["a"], None), event(5, None, ["a"])], 7: [event(1, None, ["a"])]}, 5),
    "churn to new": ([(1, ["a"]), (5, ["b"])], {g: [event(1, None, ["a"]), event(2, ["a"], None), event(5, None, ["b"])] for g in (0, 7)}, 5),
    "back in grace": ([(1, ["a"]), (9, ["a"])], {7: [event(1, None, ["a"])]}, 9),
    "back too late": ([(1, ["a"]), (10, ["a"])], {7: [event(1, None, ["a"]), event(2, ["a"], None), event(10, None, ["a"])]}, 10),
}


@pytest.mark.parametrize("case", MICRO)
def test_closed_form(spark, case):
    rows, expected, last = MICRO[case]
    df = snapshots(spark, [(d, "x", v) for d, v in rows] + [m for m in MEASURED if m[0] <= last])
    for grace, events in expected.items():
        assert found(diff.history_diff(df, grace).where("domain = 'x'")) == sorted(events), grace


def test_day_without_data(spark):
    df = snapshots(spark, [(d, "x", ["a"]) for d in (1, 2, 4, 5)])
    assert found(diff.history_diff(df)) == [event(1, None, ["a"])]


def test_empty(spark):
    assert diff.history_diff(spark.createDataFrame([], SNAP)).count() == 0
    assert diff.state_from_events(spark.createDataFrame([], EVENT)).count() == 0


@pytest.mark.parametrize("grace", [0, 3])
def test_incremental_equals_closed_form(spark, grace):
    """Day by day with a carried state, the same events as all at once."""
    r = random.Random(grace)
    days = [d for d in range(1, 13) if d not in (5, 6)]
    rows = [(d, f"k{k}", r.sample(["a", "b"], r.choice([1, 1, 2]))) for k in range(12) for d in days if r.random() < 0.6]
    df = snapshots(spark, rows)
    state = spark.createDataFrame([], "domain string, query_type string, value array<string>, missing_since date")
    events = []
    for d in days:
        today = df.where(df["day"] == day(d))
        if today.isEmpty():
            continue
        actions = spark.createDataFrame(diff.classify_day(today, state, day(d), grace).collect(), "domain string, query_type string, today_value array<string>, state_value array<string>, missing_since date, case_type string")
        events += found(diff.day_events(actions, day(d), grace))
        state = spark.createDataFrame(diff.apply_actions(state, actions, day(d), grace).collect(), state.schema)
    assert sorted(events) == found(diff.history_diff(df, grace))


def test_state_leaves_out_what_is_gone(spark):
    rows = [("x", "MX", day(1), ["a"], None), ("x", "MX", day(2), None, ["a"]), ("y", "MX", day(1), ["b"], None), ("z", "MX", day(3), None, ["q"]), ("z", "MX", day(3), ["r"], None)]
    state = diff.state_from_events(spark.createDataFrame(rows, EVENT))
    assert sorted((r.domain, r.value) for r in state.collect()) == [("y", ["b"]), ("z", ["r"])]


def test_classified_orders_one_day(spark):
    rows = [("z", "MX", day(3), ["r"], None), ("z", "MX", day(3), None, ["q"])]
    got = diff.classified(spark.createDataFrame(rows, EVENT)).where("next_type IS NOT NULL").collect()
    assert [(r.event_type, r.next_type) for r in got] == [("disappearance", "appearance")]
