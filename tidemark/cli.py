"""Command line: ingest, compact, report, look up, validate, and propose providers.

A data folder holds a folder for each dataset with `events`, `state` and
`ingest_log.json`, and `mappings` with mx_providers.json and spf_providers.json.
"""

from __future__ import annotations

import argparse
import contextlib
import datetime
import json
import sys
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import diff, history, store
from tidemark.plans import adoption, metrics, providers, state_reports, text_reports, validation
from tidemark.session import session
from tidemark.sources import snapshots
from tidemark.streaming.ingest import STATE, ingest_days


def _day(text: str) -> datetime.date:
    return datetime.date.fromisoformat(text)


def _events(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Events of the chosen datasets, with their `source`."""
    found = snapshots.discover_datasets(spark, a.data)
    out = None
    for name, path in found.items():
        if not a.source or name in a.source:
            rows = store.read_events(spark, path).withColumn("source", F.lit(name))
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        sys.exit(f"no events in {a.data}")
    return out


def _state(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    places = [f"{a.data}/{n}/state" for n in snapshots.discover_datasets(spark, a.data) if not a.source or n in a.source]
    places = [p for p in places if snapshots.exists(spark, p)]
    if not places:
        return diff.state_from_events(_events(spark, a)).select("domain", "query_type", "value")
    return spark.read.schema(STATE).parquet(*places).where("value IS NOT NULL").select("domain", "query_type", "value")


def _maps(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    at = f"{a.data}/mappings"
    return snapshots.read_mapping(spark, f"{at}/mx_providers.json"), snapshots.read_mapping(spark, f"{at}/spf_providers.json", spf=True)


def _print(lines: Iterable[str], output: str | None) -> None:
    """To the terminal and, if wanted, to a file, as the lines come."""
    with open(output, "w", encoding="utf-8") if output else contextlib.nullcontext() as f:
        for line in lines:
            print(line)
            if f:
                f.write(line + "\n")


def ingest(spark: SparkSession, a: argparse.Namespace) -> None:
    root, pairs = f"{a.data}/{a.name}", snapshots.source_pairs(a.basis)
    done = snapshots.last_date(spark, f"{root}/ingest_log.json")
    day = max(a.start, done + datetime.timedelta(1)) if done else a.start
    while day <= a.end:
        found = snapshots.read_day(spark, a.raw, snapshots.active_sources(pairs, day), day)
        if found is not None:  # a day without data leaves the state as it is
            ingest_days(spark, found.withColumn("day", F.lit(day)), root, a.grace)
            store.compact_over(spark, f"{root}/events", store.INLINE_BYTES, store.INLINE_BUCKETS)
        day += datetime.timedelta(1)
    store.compact_over(spark, f"{root}/events")


def compact(spark: SparkSession, a: argparse.Namespace) -> None:
    for path in snapshots.discover_datasets(spark, a.data).values():
        print(path, store.compact_over(spark, path, force=a.force))


def _sections(kind: str, state: DataFrame, a: argparse.Namespace) -> dict[str, DataFrame]:
    r = state_reports
    if kind == "mx":
        return {"top mx servers": r.top_mx_servers(state, a.top, a.min_count), "top mx providers": r.top_mx_providers(state, a.top, a.min_count)}
    return {
        "mechanism types": r.mechanism_types(state), "top include: targets": r.top_mechanism_values(state, "include", a.top, a.min_count),
        "top redirect= targets": r.top_mechanism_values(state, "redirect", a.top, a.min_count), "top ip4: ranges": r.top_mechanism_values(state, "ip4", a.top, a.min_count),
        "all qualifiers": r.all_qualifiers(state), "top spf records": r.top_spf_strings(state, a.top, a.min_count),
    }


def report(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.kind in ("mx", "spf"):
        sections = _sections(a.kind, _state(spark, a), a)
    elif a.kind in ("mx-historical", "spf-historical"):
        days = snapshots.month_series(spark, str(a.start.replace(day=1)), str(a.end), day=15)
        frames = []
        for (day,) in days.collect():  # a day each month
            for basis, source in snapshots.active_sources(snapshots.source_pairs(a.basis), day):
                path = snapshots.snapshot_path(a.raw, basis, source, day)
                if snapshots.exists(spark, path):
                    frames.append(spark.read.schema(snapshots.RAW).parquet(path).withColumn("day", F.lit(day)))
        if not frames:
            sys.exit("no raw data for the sampled days")
        raw = frames[0]
        for f in frames[1:]:
            raw = raw.unionByName(f)
        sections = _sections(a.kind.split("-")[0], state_reports.historical_state(raw, days), a)
    elif a.kind == "metrics":
        sections = metrics.report(_events(spark, a))
    elif a.kind == "share":
        mx, spf = _maps(spark, a)
        state = _state(spark, a)
        sections = {"mx providers": state_reports.mx_provider_distribution(state, mx), "spf tools": state_reports.spf_tool_distribution(state, spf)}
    else:
        _, spf = _maps(spark, a)
        logs = [f"{a.data}/{n}/ingest_log.json" for n in snapshots.discover_datasets(spark, a.data)]
        last = snapshots.cutoff(spark, logs, earliest=True) or a.end
        domains, totals, includes = adoption.monthly_counts(_events(spark, a), str(a.start.replace(day=1)), str(last.replace(day=1)), by_source=True)
        if a.output_dir:
            adoption.write_tables(a.output_dir, domains, totals, includes, spf, a.top_includes)
        sections = {
            "totals": adoption.yearly_change(domains, totals), "categories": adoption.category_peaks(includes, totals, spf),
            "top includes": adoption.ranked_includes(includes, totals, spf, a.top_includes),
        }
    _print(text_reports.report_lines(sections), a.output)


def look_up(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.name.startswith("%"):
        suffix = a.name.lstrip("%.")
        found = history.suffix_domains(store.of_suffix(_events(spark, a), suffix), suffix, a.limit)
        print(text_reports.text_table(history.containing(found, a.containing or "")))
        return
    rows = store.of_domain(_events(spark, a), a.name)
    logs = [f"{a.data}/{n}/ingest_log.json" for n in snapshots.discover_datasets(spark, a.data)]
    end = snapshots.cutoff(spark, logs) or datetime.date.today()
    mx, spf = _maps(spark, a)
    print(text_reports.text_report({"mx": history.mx_segments(rows, mx, end), "spf": history.spf_segments(rows, spf, end)}))


def validate(spark: SparkSession, a: argparse.Namespace) -> int:
    events = _events(spark, a)
    if a.kind == "performance":
        names = a.domains or [r[0].rstrip(".") for r in events.select("domain").limit(8).collect()]
        for n in names:
            for kind, run in (("pruned", lambda n=n: store.of_domain(events, n)), ("full", lambda n=n: events.where(F.col("domain") == n + "."))):
                (_, seconds, rows), = validation.timed({kind: run})
                print(f"{kind} {n:<52} {seconds:8.3f} s {rows:>8,} rows")
        pairs = snapshots.source_pairs(a.basis)
        days = [a.end - datetime.timedelta(i) for i in range(a.raw_days)]
        paths = [(d, snapshots.snapshot_path(a.raw, *p, d)) for d in days for p in snapshots.active_sources(pairs, d)]
        paths = [(d, x) for d, x in paths if snapshots.exists(spark, x)]
        if paths:
            raw = spark.read.schema(snapshots.RAW).option("pathGlobFilter", "*.parquet").parquet(*[x for _, x in paths])
            for n, kind, seconds, rows, whole in validation.compared(events, raw, names, len(paths), 1, sum(len(snapshots.active_sources(pairs, a.start + datetime.timedelta(i))) for i in range((a.end - a.start).days + 1))):
                print(f"{kind:<14} {n:<45} {seconds:8.3f} s {rows:>8,} rows {whole:12.1f} s for all days")
            if a.full_raw:
                print(f"raw, unfiltered: {validation.streamed_rows(raw):,} rows streamed")
        return 0
    days, pairs = [r[0] for r in events.select("measurement_date").distinct().orderBy(F.xxhash64("measurement_date", F.lit(a.seed))).limit(a.days).collect()], snapshots.source_pairs(a.basis)
    frames = [(d, snapshots.read_day(spark, a.raw, snapshots.active_sources(pairs, d), d)) for d in days]
    shown = None
    for d, f in frames:
        if f is not None:
            one = snapshots.daily_values(f).withColumn("day", F.lit(d))
            shown = one if shown is None else shown.unionByName(one)
    if shown is None:
        sys.exit("no raw data for the sampled days")
    if a.kind == "correctness":
        chosen = validation.sampled_events(events.where(F.col("measurement_date").isin(days)), a.n, a.seed, a.include_disappearances)
        checked = validation.correctness(chosen, shown, a.include_disappearances)
    else:
        samples = snapshots.sample_rows(shown.select("domain", "query_type", "day", F.explode("value").alias("raw_value")), a.n, a.seed)
        checked = validation.completeness(events, samples)
    counts = {r.outcome: r.n for r in validation.outcomes(checked).collect()}
    print(json.dumps(counts))
    return int(bool(counts.get("fail")))


def candidates(spark: SparkSession, a: argparse.Namespace) -> None:
    mx, spf = _maps(spark, a)
    for kind, existing, key, known in (("mx", mx, "reg_domain", a.known_mx), ("spf", spf, "inc_domain", a.known_spf)):
        text = Path(a.report).read_text()
        counts = snapshots.report_counts(text, "TOP MX PROVIDERS" if kind == "mx" else "TOP INCLUDE: TARGETS")
        frame = spark.createDataFrame(list(counts.items()), f"{key} string, count long")
        added = providers.candidates(frame, key, existing, snapshots.read_mapping(spark, known or "none", spf=kind == "spf"), spf=kind == "spf")
        print(text_reports.text_table(added.orderBy(F.desc("count"), key).limit(20)))
        if not a.dry_run:
            Path(f"{a.data}/mappings/{kind}_providers.json").write_text(providers.mapping_json(providers.merged(existing, added, key), key))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    sub = p.add_subparsers(required=True)

    def command(run, name: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        c.add_argument("--data", default="data")
        c.add_argument("--source", nargs="*")
        c.add_argument("--raw", default="raw")
        c.add_argument("--basis", choices=("toplists", "zonefiles", "both"), default="both")
        c.add_argument("--start", type=_day, default=_day("2016-01-22"))
        c.add_argument("--end", type=_day, default=datetime.date.today())
        return c

    c = command(ingest, "ingest")
    c.add_argument("--name", required=True)
    c.add_argument("--grace", type=int, default=0)
    c = command(compact, "compact")
    c.add_argument("--force", action="store_true")
    c = command(report, "report")
    c.add_argument("kind", choices=("mx", "spf", "mx-historical", "spf-historical", "metrics", "share", "adoption"))
    c.add_argument("--top", type=int, default=state_reports.TOP)
    c.add_argument("--min-count", type=int, default=state_reports.LEAST)
    c.add_argument("--top-includes", type=int, default=adoption.TOP_INCLUDES)
    c.add_argument("--output")
    c.add_argument("--output-dir")
    c = command(look_up, "look-up")
    c.add_argument("name", help="a host, or %%suffix")
    c.add_argument("--limit", type=int, default=300)
    c.add_argument("--containing", help="of the names below a suffix, those that hold this text")
    c = command(validate, "validate")
    c.add_argument("kind", choices=("completeness", "correctness", "performance"))
    c.add_argument("--n", type=int, default=500)
    c.add_argument("--days", type=int, default=30)
    c.add_argument("--seed", type=int, default=0)
    c.add_argument("--include-disappearances", action="store_true")
    c.add_argument("--domains", nargs="*")
    c.add_argument("--raw-days", type=int, default=365)
    c.add_argument("--full-raw", action="store_true")
    c = command(candidates, "candidates")
    c.add_argument("--report", required=True)
    c.add_argument("--known-mx")
    c.add_argument("--known-spf")
    c.add_argument("--dry-run", action="store_true")
    a = p.parse_args(args)
    return a.run(spark or session(), a) or 0


if __name__ == "__main__":
    sys.exit(main())
