import datetime

from pyspark.sql import functions as F

from tidemark.operators import diff, store
from tidemark.sources import snapshots

EVENT = "domain string, query_type string, measurement_date date, value array<string>, prev_value array<string>"
DAY = datetime.date(2024, 1, 1)


def events(spark):
    return diff.with_keys(spark.createDataFrame([(f"m{i}.d{i % 7}.nl.", "MX", DAY, [f"mx{i}"], None) for i in range(60)], EVENT))


def test_append_read_compact(spark, tmp_path):
    path = str(tmp_path / "events")
    store.append_events(events(spark), path)
    store.append_events(events(spark), path)  # a delta written twice
    assert store.read_events(spark, path).count() == 60
    sizes = store.delta_bytes(spark, path)
    assert sizes and store.buckets_over(sizes, 10**9) == []
    assert store.compact_over(spark, path, force=True) == 60
    assert sum(store.delta_bytes(spark, path).values()) == 0
    assert spark.read.parquet(path).count() == 60
    assert store.compact_over(spark, path) == 0  # nothing is over the threshold now
    assert not [n for n, _, _ in snapshots.listing(spark, str(tmp_path)) if "compact" in n]


def test_pruned_look_ups(spark, tmp_path):
    path = str(tmp_path / "events")
    store.append_events(events(spark), path)
    found = store.read_events(spark, path)
    one = store.of_domain(found, "M8.d1.NL")
    assert [r.domain for r in one.collect()] == ["m8.d1.nl."]
    assert [f for f in one.inputFiles() if "bucket=" in f]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    below = {r.domain for r in store.of_suffix(found, "d1.nl").collect()}
    assert below == {f"m{i}.d1.nl." for i in range(60) if i % 7 == 1}


def test_suffix_takes_no_wildcards(spark):
    rows = diff.with_keys(spark.createDataFrame([("_spf.x.nl.", "MX", DAY, ["a"], None), ("aspf.x.nl.", "MX", DAY, ["a"], None)], EVENT))
    assert [r.domain for r in store.of_suffix(rows, "_spf.x.nl").collect()] == ["_spf.x.nl."]


def test_replace_and_log(spark, tmp_path):
    at, log = str(tmp_path / "state"), str(tmp_path / "log.json")
    for n in (3, 5):
        store.replace_table(spark.range(n), at)
        assert spark.read.parquet(at).count() == n
    assert snapshots.last_date(spark, log) is None
    store.write_log(spark, log, DAY)
    store.write_log(spark, log, DAY + datetime.timedelta(1))
    assert snapshots.last_date(spark, log) == DAY + datetime.timedelta(1)
    assert snapshots.cutoff(spark, [log, str(tmp_path / "none")]) == DAY + datetime.timedelta(1)


def test_rows_of_a_group(spark, tmp_path):
    path = str(tmp_path / "events")
    store.append_events(events(spark), path, per_bucket=4)
    assert store.read_events(spark, path).select(F.countDistinct("domain")).first()[0] == 60


def test_public_suffix_is_in_all_buckets(spark, tmp_path):
    path = str(tmp_path / "events")
    store.append_events(events(spark), path)
    found = store.read_events(spark, path)
    assert store.of_suffix(found, "nl").count() == 60
    assert store.of_suffix(found, "NL.").count() == 60
    plan = store.of_suffix(found, "d1.nl")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
