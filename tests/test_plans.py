import datetime

from tidemark.operators import diff, history
from tidemark.plans import providers, text_reports, validation

SNAP = "day date, domain string, query_type string, value array<string>"
EVENT = "domain string, query_type string, measurement_date date, value array<string>, prev_value array<string>"


def day(n):
    return datetime.date(2024, 1, n)


def days(spark):
    return spark.createDataFrame([(day(d), k, "MX", [f"v{(d * i) % 3}"]) for i, k in enumerate(["a.nl.", "b.nl."]) for d in (1, 2, 3, 4)], SNAP)


def outcomes(df):
    return {r.outcome: r.n for r in validation.outcomes(df).collect()}


def test_checks_see_injected_errors(spark):
    """One right event and two wrong ones: one pass, two fails."""
    snap = days(spark)
    events = diff.history_diff(snap)
    assert set(outcomes(validation.correctness(events, snap))) == {"pass"}
    right = events.where("value IS NOT NULL").limit(1)
    wrong = spark.createDataFrame([("a.nl.", "MX", day(2), ["bad"], None), ("none.nl.", "MX", day(2), ["v0"], None)], EVENT)
    assert outcomes(validation.correctness(right.unionByName(wrong), snap)) == {"pass": 1, "fail": 2}
    gone = spark.createDataFrame([("a.nl.", "MX", day(2), None, ["v0"]), ("q.nl.", "MX", day(2), None, ["v0"])], EVENT)
    assert outcomes(validation.correctness(gone, snap)) == {"skip": 1, "pass": 1}
    samples = spark.createDataFrame([("a.nl.", "MX", day(3), "v0"), ("a.nl.", "MX", day(3), "bad"), ("none.nl.", "MX", day(3), "v0")], "domain string, query_type string, day date, raw_value string")
    assert outcomes(validation.completeness(events, samples)) == {"pass": 1, "fail": 2}
    assert len(validation.sampled_events(events, 2, 1).collect()) == 2


def test_as_of_after_a_disappearance(spark):
    events = spark.createDataFrame([("a", "MX", day(1), ["x"], None), ("a", "MX", day(3), None, ["x"])], EVENT)
    asked = spark.createDataFrame([("a", "MX", day(2)), ("a", "MX", day(3)), ("b", "MX", day(3))], "domain string, query_type string, day date")
    got = {(r.domain, r.day): (r.found, r.value) for r in history.value_as_of(events, asked).collect()}
    assert got == {("a", day(2)): (True, ["x"]), ("a", day(3)): (True, None), ("b", day(3)): (False, None)}


def test_self_hosted_and_providers(spark):
    events = spark.createDataFrame([("www.a.nl.", "MX", day(1), ["mx.a.nl.", "mx.p.com.", "mx2.p.com."], None), ("www.a.nl.", "MX", day(2), None, ["x"])], EVENT)
    names = spark.createDataFrame([("p.com", "P")], "reg_domain string, provider string")
    rows = history.mx_segments(events, names, day(9)).orderBy("start").collect()
    assert (rows[0].provider, rows[0].self_hosted, rows[0].mx_records) == ("a.nl / P", True, ["mx.a.nl", "mx.p.com", "mx2.p.com"])
    assert (rows[1].absent, rows[1].provider, rows[1].end) == (True, None, day(9))


def test_readable_names():
    assert [providers.readable(x) for x in ("_spf.b2b-mail.com", "mail.spf.x.nl", "..a.b.org", "plain")] == ["B2B Mail", "X", "A B", "Plain"]


def test_merge_keeps_existing(spark):
    old = spark.createDataFrame([("a", "A", 1)], "reg_domain string, provider string, confidence int")
    new = spark.createDataFrame([("a", "Z", 2), ("b", "B", 3)], old.schema)
    found = providers.merged(old, new, "reg_domain")
    assert providers.mapping_json(found, "reg_domain").count('"provider"') == 2
    assert {r.reg_domain: r.provider for r in found.collect()} == {"a": "A", "b": "B"}


def test_text_report(spark):
    text = text_reports.text_report({"top": spark.createDataFrame([("a", 1200, 1.5), (None, 2, None)], "name string, n long, pct double")})
    assert "1,200" in text and "1.50%" in text and "2 entries shown" in text


def test_timings(spark):
    (name, seconds, rows), = validation.timed({"all": lambda: days(spark)})
    assert name == "all" and rows == 8 and seconds >= 0
    assert validation.extrapolated(2.0, 4, 3, 8) == 12


def test_text_table_is_whole_and_formatted(spark):
    from pyspark.sql import functions as F

    from tidemark.plans.text_reports import text_report, text_table

    rows = spark.range(1500).select(F.col("id").alias("rank"), F.concat(F.lit("n"), "id").alias("name"), (F.col("id") * 1000).alias("domains"), F.lit(1.5).alias("pct"), F.lit(2.25).alias("weight"))
    text = text_report({"all": rows})
    assert "1,500 entries shown" in text and "n1499" in text and "1,499,000" in text and "1.50%" in text and "2.25%" not in text
    signed = spark.createDataFrame([(1, 5), (2, -5), (3, None)], "m int, yoy_change long")
    assert [x.split() for x in text_table(signed, ["m"]).split("\n")[2:]] == [["1", "+5"], ["2", "-5"], ["3"]]
    assert text_table(signed.limit(0)).startswith("m")


def test_every_mechanism_is_in_the_wide_data(spark):
    from tidemark.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    import os

    import pytest

    if not os.path.isdir(sf):
        pytest.skip("needs the driver's tables")
    import tidemark.catalog_wide  # noqa: F401

    types = {r.mtype for r in QUERIES["orders_spf_types"](spark, sf).collect()}
    assert types == {"include", "redirect", "ip4", "ip6", "a", "mx", "exists", "ptr", "all", "other"}
    assert {r.self_hosted for r in QUERIES["orders_mx_segments"](spark, sf).collect()} == {True, False}
    assert QUERIES["orders_spf_redirect"](spark, sf).count() > 5
    assert {r.outcome for r in QUERIES["correctness_check_faulty"](spark, sf).collect()} == {"pass", "fail"}
