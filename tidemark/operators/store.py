"""The event store: Parquet partitioned by bucket, with deltas, compaction and a log.

File operations go through Hadoop's FileSystem, so any store that Spark can write
will do. Nothing is overwritten in place: new files are written beside, counted, and
renamed.
"""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.names import bucket_number, fqdn, registrable_or_self, suffix_rules
from tidemark.schema import EVENT
from tidemark.sources.snapshots import _file_system, exists, listing

#: Sizes in bytes beyond which deltas are compacted after a day and after a run.
INLINE_BYTES, FINAL_BYTES, INLINE_BUCKETS = 500 << 20, 10 << 20, 16
ROW_GROUP_ROWS = 100_000
COLUMNS = [f.name for f in EVENT.fields if f.name != "bucket"]


def _write(events: DataFrame, path: str, mode: str, per_bucket: int) -> None:
    """Clustered by name within files; per_bucket files share a bucket's rows, by registrable domain."""
    part = F.pmod(F.xxhash64("registrable_domain"), F.lit(per_bucket))
    (
        events.select(*COLUMNS, "bucket").withColumn("_part", part).repartition("bucket", "_part").drop("_part")
        .sortWithinPartitions("bucket", "registrable_domain", "domain_reversed", "measurement_date")
        .write.mode(mode).option("compression", "zstd").option("parquet.block.row.count.limit", ROW_GROUP_ROWS).partitionBy("bucket").parquet(path)
    )


def append_events(events: DataFrame, path: str, per_bucket: int = 1) -> None:
    _write(events, path, "append", per_bucket)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """All events, each once: a crash between a delta and its log entry writes a delta twice."""
    rows = spark.read.schema(EVENT).option("pathGlobFilter", "*.parquet").parquet(path)
    return rows.dropDuplicates([*COLUMNS, "bucket"])


def bucket_of_name(name: str) -> int:
    plain = name.lower().strip().rstrip(".")
    return bucket_number(registrable_or_self(plain, suffix_rules()))


def of_domain(events: DataFrame, name: str) -> DataFrame:
    """A host's events; the condition on bucket prunes all but one partition."""
    return events.where((F.col("bucket") == bucket_of_name(name)) & (F.col("domain") == fqdn(F.lit(name))))


def of_suffix(events: DataFrame, suffix: str) -> DataFrame:
    """Events of a name and all below it, by a prefix of the reversed name that Parquet's statistics can prune by.

    Names below a registrable domain lie in its bucket; those below a public suffix
    lie in all, so there the prefix alone selects.
    """
    plain = suffix.lower().strip().rstrip(".")
    reversed_name = "." + ".".join(reversed(plain.split(".")))
    name = F.col("domain_reversed")
    found = (name == reversed_name) | name.startswith(reversed_name + ".")
    if suffix_rules().registrable(plain) is not None:
        found = (F.col("bucket") == bucket_of_name(plain)) & found
    return events.where(found)


def delta_bytes(spark: SparkSession, path: str) -> dict[int, int]:
    """Bytes of each bucket's deltas."""
    out = {}
    for name, folder, _ in listing(spark, path):
        if folder and name.startswith("bucket="):
            out[int(name[7:])] = sum(size for n, _, size in listing(spark, f"{path}/{name}") if n.endswith(".parquet") and not n.startswith("base-"))
    return out


def buckets_over(sizes: dict[int, int], threshold: int) -> list[int]:
    """The buckets whose deltas reach the threshold, largest first."""
    return [b for size, b in sorted(((s, b) for b, s in sizes.items() if s >= threshold and s), reverse=True)]


def compact(spark: SparkSession, path: str, buckets: list[int], per_bucket: int = 1) -> int:
    """Merge base and deltas of buckets into new base files, repeated rows once; how many rows there are.

    New files are written beside the store and counted before the old ones go.
    """
    buckets = [b for b in buckets if exists(spark, f"{path}/bucket={b}")]
    if not buckets:
        return 0
    old = {b: [n for n, folder, _ in listing(spark, f"{path}/bucket={b}") if not folder and n.endswith(".parquet")] for b in buckets}
    merged = read_events(spark, path).where(F.col("bucket").isin(*buckets))
    stage = f"{path.rstrip('/')}-compact-{uuid.uuid4().hex}"
    _write(merged, stage, "errorifexists", per_bucket)
    rows = spark.read.schema(EVENT).parquet(stage)
    count = rows.count()
    if count == 0 or count != merged.count():
        remove(spark, stage)
        return 0
    fs, _ = _file_system(spark, path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    mark = uuid.uuid4().hex[:8]
    for b in buckets:
        for n, _, _ in listing(spark, f"{stage}/bucket={b}"):
            if n.endswith(".parquet"):
                fs.rename(at(f"{stage}/bucket={b}/{n}"), at(f"{path}/bucket={b}/base-{mark}-{n}"))
        for n in old[b]:
            fs.delete(at(f"{path}/bucket={b}/{n}"), False)
    remove(spark, stage)
    return count


def compact_over(spark: SparkSession, path: str, threshold: int = FINAL_BYTES, most: int | None = None, force: bool = False) -> int:
    """Compact buckets at a threshold, or all, in one job; `most` is for the pass after each day."""
    chosen = buckets_over(delta_bytes(spark, path), 0 if force else threshold)
    return compact(spark, path, chosen[:most])


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def replace_table(df: DataFrame, path: str) -> None:
    """Write a table beside its place and move it there; a reader finds the old or the new one."""
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    new, old = f"{path}-new-{mark}", f"{path}-old-{mark}"
    df.write.option("compression", "zstd").parquet(new)
    fs, at = _file_system(spark, path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if fs.exists(at):
        fs.rename(at, place(old))
    fs.rename(place(new), at)
    remove(spark, old)


def write_log(spark: SparkSession, path: str, day: datetime.date) -> None:
    """Set the day that the store stands at; written last, and moved into place."""
    fs, at = _file_system(spark, path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    new = place(f"{path}.new")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps({"last_date": day.isoformat()}).encode()))
    out.close()
    fs.delete(at, False)
    fs.rename(new, at)
