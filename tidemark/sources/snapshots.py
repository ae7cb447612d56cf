"""Raw daily snapshots: where they are, how they are read and brought into shape."""

from __future__ import annotations

import datetime
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import MX_MAP, RAW, SPF_MAP

#: The sources by kind, and when each has data.
TOPLISTS = ("umbrella", "tranco", "radar", "alexa", "majestic")
ZONEFILES = ("ee", "fr", "gov", "li", "nu", "se", "sk")
COVERAGE = {
    ("toplist", "alexa"): ("2016-01-22", "2023-05-15"),
    ("toplist", "umbrella"): ("2019-01-14", None),
    ("toplist", "tranco"): ("2022-08-11", None),
    ("toplist", "radar"): ("2022-10-04", None),
    ("toplist", "majestic"): ("2025-03-17", None),
    ("zonefile", "gov"): ("2017-05-01", None),
    ("zonefile", "ee"): ("2019-07-29", None),
    ("zonefile", "li"): ("2020-05-19", None),
    ("zonefile", "nu"): ("2016-06-07", None),
    ("zonefile", "se"): ("2016-06-07", None),
    ("zonefile", "sk"): ("2022-05-11", None),
    ("zonefile", "fr"): ("2022-08-10", None),
}


def source_pairs(which: str = "both") -> list[tuple[str, str]]:
    """(basis, source) of toplists, zonefiles or both."""
    return [("toplist", s) for s in TOPLISTS if which in ("toplists", "both")] + [("zonefile", s) for s in ZONEFILES if which in ("zonefiles", "both")]


def active_sources(pairs: list[tuple[str, str]], day: datetime.date) -> list[tuple[str, str]]:
    """Those that have data on a day; sources of unknown coverage count."""
    text = day.isoformat()
    return [p for p in pairs if p not in COVERAGE or COVERAGE[p][0] <= text <= (COVERAGE[p][1] or text)]


def snapshot_path(root: str, basis: str, source: str, day: datetime.date) -> str:
    if basis == "toplist":
        return f"{root}/source={source}/date={day}"
    return f"{root}/basis=zonefile/source={source}/year={day.year}/month={day.month:02d}/day={day.day:02d}"


def credentials(spark: SparkSession, bucket: str, key: str, secret: str, endpoint: str) -> None:
    """Access to one bucket of an S3 store, for readers by s3a://."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    values = {"access.key": key, "secret.key": secret, "endpoint": endpoint, "path.style.access": "true", "connection.ssl.enabled": "true"}
    for name, value in values.items():
        conf.set(f"fs.s3a.bucket.{bucket}.{name}", value)


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def listing(spark: SparkSession, path: str) -> list[tuple[str, bool, int]]:
    """(name, is a folder, bytes) of what is in a folder; empty if there is none."""
    fs, at = _file_system(spark, path)
    return sorted((s.getPath().getName(), s.isDirectory(), s.getLen()) for s in fs.listStatus(at)) if fs.exists(at) else []


def discover_datasets(spark: SparkSession, data_dir: str) -> dict[str, str]:
    """Datasets by name: folders that hold a folder `events`."""
    names = [n for n, folder, _ in listing(spark, data_dir) if folder and n != "mappings"]
    return {n: f"{data_dir}/{n}/events" for n in names if exists(spark, f"{data_dir}/{n}/events")}


def answers(raw: DataFrame) -> DataFrame:
    """query_name, query_type and val of MX and TXT rows that have an answer."""
    wanted = ((F.col("query_type") == "MX") & F.col("mx_address").isNotNull()) | ((F.col("query_type") == "TXT") & F.col("txt_text").isNotNull())
    return raw.where(wanted).select("query_name", "query_type", F.coalesce("mx_address", "txt_text").alias("val"))


def read_day(spark: SparkSession, root: str, pairs: list[tuple[str, str]], day: datetime.date) -> DataFrame | None:
    """answers of all sources that have the day, in one plan; None if none has.

    Only a folder that is not there counts as no data; any other failure fails the day.
    """
    frames = []
    for basis, source in pairs:
        path = snapshot_path(root, basis, source, day)
        if exists(spark, path):
            frames.append(answers(spark.read.schema(RAW).option("pathGlobFilter", "*.parquet").parquet(path)).withColumn("source", F.lit(source)))
    out = None
    for frame in frames:
        out = frame if out is None else out.unionByName(frame)
    return out


def daily_values(found: DataFrame, *keys: str) -> DataFrame:
    """One row per name and type (and keys): the sorted different values. Names are lower-cased.

    Rows are dealt by name and type once; the aggregation here and the windows and
    joins by key that follow need no further shuffle.
    """
    rows = found.select(*keys, F.lower("query_name").alias("domain"), "query_type", "val").repartition("domain", "query_type")
    return rows.groupBy(*keys, "domain", "query_type").agg(F.array_sort(F.collect_set("val")).alias("value"))


def history_rows(spark: SparkSession, root: str, basis: str, since: datetime.date, names: list[str] | None = None, suffix: str | None = None) -> DataFrame:
    """Raw rows from a day on, by partition pruning on date, for exact names or a suffix."""
    rows = spark.read.option("pathGlobFilter", "*.parquet").parquet(root).where(F.col("date") >= F.lit(since))
    if names is not None:
        rows = rows.where(F.col("query_name").isin(*names))
    return rows.where(F.col("query_name").endswith(suffix)) if suffix else rows


def month_series(spark: SparkSession, first: str, last: str, day: int = 1) -> DataFrame:
    """A day of every month between two dates, as `day`."""
    whole = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month")))
    return spark.range(1).select(whole.alias("first")).select(F.date_add("first", day - 1).alias("day"))


def sample_rows(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows by chance, the same for the same seed and rows."""
    return df.orderBy(F.xxhash64(*[F.col(c) for c in df.columns], F.lit(seed))).limit(n)


def arbitrary_row(df: DataFrame) -> DataFrame:
    """One row, whichever comes first."""
    return df.limit(1)


def read_text(spark: SparkSession, path: str) -> str | None:
    if not exists(spark, path):
        return None
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def read_mapping(spark: SparkSession, path: str, spf: bool = False) -> DataFrame:
    """A provider mapping {key: {provider, confidence[, type]}}; empty where missing or broken."""
    try:
        found = json.loads(read_text(spark, path) or "{}")
    except json.JSONDecodeError:
        found = {}
    return mapping(spark, found, spf)


def mapping(spark: SparkSession, found: dict[str, dict], spf: bool = False) -> DataFrame:
    if spf:
        return spark.createDataFrame([(k, v.get("provider"), v.get("type", ""), v.get("confidence")) for k, v in found.items()], SPF_MAP)
    return spark.createDataFrame([(k, v.get("provider"), v.get("confidence")) for k, v in found.items()], MX_MAP)


def last_date(spark: SparkSession, log: str) -> datetime.date | None:
    """The day that an ingest log stands at; None on any defect."""
    try:
        return datetime.date.fromisoformat(json.loads(read_text(spark, log) or "{}")["last_date"])
    except (KeyError, TypeError, ValueError):
        return None


def cutoff(spark: SparkSession, logs: list[str], earliest: bool = False) -> datetime.date | None:
    """The latest day of the logs, or the earliest."""
    days = [d for d in (last_date(spark, x) for x in logs) if d]
    return (min if earliest else max)(days) if days else None


def report_counts(text: str, section: str) -> dict[str, int]:
    """Names and counts of a section of a text report: lines `rank name ... count pct`."""
    after = text.partition(section)[2]
    table = re.split(r"entries shown|Total time", after)[0]
    rows = re.findall(r"^\s*\d+\s+(\S+)(?:\s.*?)?\s([\d,]+)\s+\S+\s*$", table, re.M)
    return {name: int(count.replace(",", "")) for name, count in rows}
