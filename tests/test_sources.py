import datetime
import json

from tidemark.sources import snapshots
from tidemark.streaming.ingest import ingest_days, ingest_stream

RAW = "query_name string, query_type string, mx_address string, txt_text string"
DAY = datetime.date(2024, 1, 1)


def test_paths_and_coverage():
    assert snapshots.snapshot_path("r", "toplist", "tranco", DAY) == "r/source=tranco/date=2024-01-01"
    assert snapshots.snapshot_path("r", "zonefile", "nl", DAY) == "r/basis=zonefile/source=nl/year=2024/month=01/day=01"
    assert ("toplist", "alexa") not in snapshots.active_sources(snapshots.source_pairs(), DAY)
    assert ("toplist", "tranco") in snapshots.active_sources(snapshots.source_pairs("toplists"), DAY)
    assert ("x", "unknown") in snapshots.active_sources([("x", "unknown")], DAY)
    assert len(snapshots.source_pairs()) == 12


def test_read_day(spark, tmp_path):
    rows = [("A.nl.", "MX", "mx.b.", None), ("a.nl.", "MX", "mx.a.", None), ("a.nl.", "MX", "mx.a.", None), ("a.nl.", "TXT", None, "t"), ("a.nl.", "TXT", "x", None), ("a.nl.", "A", "x", "y")]
    spark.createDataFrame(rows, RAW).write.parquet(snapshots.snapshot_path(str(tmp_path), "toplist", "tranco", DAY))
    (tmp_path / "source=tranco/date=2024-01-01/base.parquet.tmp").write_text("left over")
    pairs = [("toplist", "tranco"), ("toplist", "radar")]
    found = snapshots.read_day(spark, str(tmp_path), pairs, DAY)
    got = sorted((r.domain, r.query_type, r.value) for r in snapshots.daily_values(found).collect())
    assert got == [("a.nl.", "MX", ["mx.a.", "mx.b."]), ("a.nl.", "TXT", ["t"])]
    assert snapshots.read_day(spark, str(tmp_path), pairs, DAY + datetime.timedelta(1)) is None
    pruned = snapshots.history_rows(spark, str(tmp_path), "toplist", DAY, names=["a.nl."])
    assert pruned.count() == 5
    assert snapshots.history_rows(spark, str(tmp_path), "toplist", DAY, suffix=".nl.").count() == 6


def test_small_files(spark, tmp_path):
    good, bad = tmp_path / "m.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"a.nl": {"provider": "A", "confidence": 3}}))
    bad.write_text("{")
    assert snapshots.read_mapping(spark, str(good)).collect()[0].provider == "A"
    assert snapshots.read_mapping(spark, str(bad), spf=True).count() == 0
    assert snapshots.read_mapping(spark, str(tmp_path / "none")).count() == 0
    bad.write_text("{}")
    assert snapshots.last_date(spark, str(bad)) is None
    (tmp_path / "x/events").mkdir(parents=True)
    (tmp_path / "mappings/events").mkdir(parents=True)
    assert list(snapshots.discover_datasets(spark, str(tmp_path))) == ["x"]


def test_report_counts():
    text = "TOP A\n=====\nrank name domains pct\n---- ----\n   1  a.nl   1,200   3.00%\n   2  b.nl   9   0.10%\n\n  2 entries shown\nTOP B\n 1 c.nl 4 1%\n"
    assert snapshots.report_counts(text, "TOP A") == {"a.nl": 1200, "b.nl": 9}
    assert snapshots.report_counts(text, "TOP C") == {}


def test_series_and_sample(spark):
    days = [r[0] for r in snapshots.month_series(spark, "2024-01-01", "2024-03-01", day=15).collect()]
    assert days == [datetime.date(2024, m, 15) for m in (1, 2, 3)]
    one, two = (sorted(r[0] for r in snapshots.sample_rows(spark.range(100), 10, 5).collect()) for _ in range(2))
    assert one == two and len(one) == 10


def test_ingest_stream(spark, tmp_path):
    """Days that arrive as files end up in the store as events; a replay adds nothing."""
    source = tmp_path / "in"
    rows = [(DAY, "a.nl.", "MX", "m1", None), (DAY + datetime.timedelta(1), "a.nl.", "MX", "m2", None), (DAY + datetime.timedelta(1), "b.nl.", "TXT", None, "t")]
    schema = f"day date, {RAW}"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source))
    query = ingest_stream(spark.readStream.schema(schema).parquet(str(source)), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    events = spark.read.parquet(str(tmp_path / "out/events")).collect()
    assert sorted((r.domain, str(r.measurement_date), r.value, r.prev_value) for r in events) == [
        ("a.nl.", "2024-01-01", ["m1"], None), ("a.nl.", "2024-01-02", ["m2"], ["m1"]), ("b.nl.", "2024-01-02", ["t"], None),
    ]
    found = spark.createDataFrame([(DAY, "a.nl.", "MX", "m1")], "day date, query_name string, query_type string, val string")
    assert ingest_days(spark, found, str(tmp_path / "out")) == 0
    assert spark.read.parquet(str(tmp_path / "out/state")).count() == 2


def test_stream_with_split_and_late_days(spark, tmp_path):
    """A day in two files gives the events of one; a row of a day that is done is kept apart."""
    from tidemark.streaming.ingest import late_rows

    def two(n):
        return DAY + datetime.timedelta(n)

    schema, source = f"day date, {RAW}", str(tmp_path / "in")
    files = [
        [(two(0), "a.nl.", "MX", "m1", None), (two(0), "b.nl.", "MX", "m1", None), (two(1), "b.nl.", "MX", "m1", None)],
        [(two(1), "a.nl.", "MX", "m2", None), (two(2), "a.nl.", "MX", "m2", None)],
        [(two(0), "c.nl.", "MX", "m9", None), (two(2), "b.nl.", "MX", "m1", None)],
    ]
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")
    ingest_stream(raw, out, str(tmp_path / "check"), close_last=False)
    expected = [("a.nl.", "2024-01-01", ["m1"], None), ("a.nl.", "2024-01-02", ["m2"], ["m1"]), ("b.nl.", "2024-01-01", ["m1"], None)]
    found = lambda: sorted((r.domain, str(r.measurement_date), r.value, r.prev_value) for r in spark.read.parquet(f"{out}/events").collect())
    assert found() == expected
    assert snapshots.last_date(spark, f"{out}/ingest_log.json") == two(1)  # the third day waits
    assert [(r.query_name, r.val) for r in late_rows(spark, out).collect()] == [("c.nl.", "m9")]
    spark.createDataFrame([(two(2), "c.nl.", "MX", "m3", None)], schema).coalesce(1).write.mode("append").parquet(source)
    ingest_stream(raw, out, str(tmp_path / "check"))
    assert found() == sorted([*expected, ("c.nl.", "2024-01-03", ["m3"], None)])


def test_a_batch_twice(spark, tmp_path):
    from tidemark.streaming.ingest import close_days, take_batch

    rows = spark.createDataFrame([(DAY, "a.nl.", "MX", "m1", None), (DAY + datetime.timedelta(1), "a.nl.", "MX", "m1", None)], f"day date, {RAW}")
    for _ in range(2):
        take_batch(rows, 0, str(tmp_path))
    assert close_days(spark, str(tmp_path)) == 1 and close_days(spark, str(tmp_path)) == 0
    assert spark.read.parquet(str(tmp_path / "events")).count() == 1
    assert not (tmp_path / "late").exists()


def test_credentials(spark):
    snapshots.credentials(spark, "some", "k", "s", "store.example")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    assert conf.get("fs.s3a.bucket.some.access.key") == "k" and conf.get("fs.s3a.bucket.some.endpoint") == "store.example"
