import datetime
import json

from tidemark.cli import main
from tidemark.sources import snapshots

RAW = "query_name string, query_type string, mx_address string, txt_text string"


def test_from_raw_days_to_reports(spark, tmp_path, capsys):
    data, raw = str(tmp_path / "data"), str(tmp_path / "raw")
    shown = {
        datetime.date(2024, 1, 14): [("a.nl.", "MX", "mx.p.com.", None), ("b.nl.", "MX", "10 mx.p.com.", None), ("a.nl.", "TXT", None, '"v=spf1 include:x.com -all"')],
        datetime.date(2024, 1, 15): [("a.nl.", "MX", "mx.q.com.", None), ("a.nl.", "TXT", None, '"v=spf1 include:x.com -all"')],
        datetime.date(2024, 1, 17): [("a.nl.", "MX", "mx.q.com.", None), ("b.nl.", "MX", "10 mx.p.com.", None)],
    }
    for day, rows in shown.items():
        spark.createDataFrame(rows, RAW).write.parquet(snapshots.snapshot_path(raw, "toplist", "tranco", day))
    common = ["--data", data, "--raw", raw, "--basis", "toplists", "--start", "2024-01-14", "--end", "2024-01-17"]
    run = lambda *args: (main([args[0], *args[1:], *common], spark), capsys.readouterr().out)
    run("ingest", "--name", "lists")
    events = spark.read.parquet(f"{data}/lists/events")
    assert events.count() == 7  # 3 new, 1 change, 2 gone, 1 back
    run("ingest", "--name", "lists")  # nothing new
    assert spark.read.parquet(f"{data}/lists/events").count() == 7
    code, out = run("compact", "--force")
    assert code == 0 and " 7" in out
    assert "mx.q.com" in run("report", "mx", "--min-count", "1")[1]
    run("report", "spf", "--min-count", "1", "--output", str(tmp_path / "r.txt"))
    assert "(no all)" in (tmp_path / "r.txt").read_text()
    assert "knee_day" in run("report", "metrics")[1]
    assert "p.com" in run("report", "share")[1]
    assert "mx.q.com" in run("report", "mx-historical", "--min-count", "1")[1]
    assert "spf_domains" in run("report", "adoption", "--output-dir", str(tmp_path / "tables"))[1]
    assert spark.read.parquet(str(tmp_path / "tables/overall")).count() == 0  # the record is gone before the month ends
    assert "mx.p.com" in run("look-up", "A.nl")[1]
    assert "b.nl" in run("look-up", "%b.nl")[1]
    for kind in ("completeness", "correctness"):
        code, out = run("validate", kind, "--include-disappearances")
        assert code == 0 and "fail" not in json.loads(out), kind
    assert "pruned a.nl" in run("validate", "performance", "--domains", "a.nl")[1]
    (tmp_path / "data/mappings").mkdir()
    (tmp_path / "data/mappings/mx_providers.json").write_text('{"p.com": {"provider": "P", "confidence": 9}}')
    (tmp_path / "h.txt").write_text("TOP MX PROVIDERS\n 1 p.com 500 5%\n 2 new-host.com 300 3%\n 3 rare.com 2 0%\n  3 entries shown\n")
    run("candidates", "--report", str(tmp_path / "h.txt"))
    found = json.loads((tmp_path / "data/mappings/mx_providers.json").read_text())
    assert {k: v["provider"] for k, v in found.items()} == {"p.com": "P", "new-host.com": "New Host"}
