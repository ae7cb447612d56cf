"""Questions about single names: sources, segments, values at a day, and totals."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.mail import spf_includes, spf_posture, spf_record
from tidemark.functions.names import plain_host, registrable_domain

KEY = ("domain", "query_type")


def sources_of(events: DataFrame, sources: list[str], domain: str) -> DataFrame:
    """source and found for each of the sources."""
    name = domain.lower().strip().rstrip(".") + "."
    hits = events.where((F.col("domain") == name) & F.col("query_type").isin("MX", "TXT")).groupBy("source").count()
    every = events.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    return every.join(hits, "source", "left").select("source", F.col("count").isNotNull().alias("found"))


def segments(events: DataFrame, value: Column, end: datetime.date) -> DataFrame:
    """Runs of equal value: start, end, and the value as `held`. Of two events of one day the disappearance is first.

    A run ends where the next begins, the last at `end`. Null is a value.
    """
    order = Window.partitionBy(*KEY).orderBy("measurement_date", F.col("value").isNotNull())
    rows = events.select(*KEY, "measurement_date", "value", value.alias("held"))
    first = F.row_number().over(order) == 1
    kept = rows.withColumn("keep", first | ~F.col("held").eqNullSafe(F.lag("held").over(order))).where("keep")
    return kept.select(*KEY, F.col("measurement_date").alias("start"), F.coalesce(F.lead("measurement_date").over(order), F.lit(end)).alias("end"), "held", F.row_number().over(order).alias("n"))


def mx_segments(events: DataFrame, providers: DataFrame, end: datetime.date) -> DataFrame:
    """MX runs with hosts, provider names in the order of the hosts, and whether a host is the domain's own.

    providers: reg_domain, provider. A host without one counts under its registrable domain.
    """
    runs = segments(events.where("query_type = 'MX'"), F.col("value"), end)
    hosts = runs.select(*KEY, "n", F.posexplode("held").alias("at", "host")).withColumn("host", F.rtrim("host", F.lit(".")))
    different = hosts.select("host").distinct().withColumn("reg", registrable_domain(F.col("host")))
    named = different.join(providers.select(F.col("reg_domain").alias("reg"), "provider"), "reg", "left").select("host", "reg", F.coalesce("provider", "reg").alias("who"))
    own = registrable_domain(plain_host(F.col("domain")))
    # the hosts of one value
    found = hosts.join(named, "host").groupBy(*KEY, "n").agg(F.array_sort(F.collect_list(F.struct("at", "host", "who", "reg"))).alias("h"))
    whole = runs.join(found, [*KEY, "n"], "left").withColumn("own", own)
    part = lambda name: F.transform("h", lambda x: x[name])
    return whole.select(
        "domain", "start", "end", F.col("held").isNull().alias("absent"), F.coalesce(part("host"), F.array().cast("array<string>")).alias("mx_records"),
        F.array_join(F.array_distinct(part("who")), " / ").alias("provider"), F.coalesce(F.array_contains(part("reg"), F.col("own")), F.lit(False)).alias("self_hosted"),
    )


def spf_segments(events: DataFrame, tools: DataFrame, end: datetime.date) -> DataFrame:
    """SPF runs with posture and includes; tools: inc_domain, provider, type, matched by case."""
    runs = segments(events.where("query_type = 'TXT'"), spf_record(F.col("value")), end)
    each = runs.select(*KEY, "n", F.posexplode(spf_includes(F.col("held"))).alias("at", "inc_domain"))
    named = each.join(tools.select("inc_domain", "provider", "type"), "inc_domain", "left")
    entry = F.struct("at", F.col("inc_domain").alias("domain"), F.coalesce("provider", "inc_domain").alias("provider"), F.coalesce("type", F.lit("")).alias("type"))
    # the includes of one record
    found = named.groupBy(*KEY, "n").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x.dropFields("at")).alias("includes"))
    return runs.join(found, [*KEY, "n"], "left").select(
        "domain", "start", "end", F.col("held").isNull().alias("absent"), F.col("held").alias("spf"), spf_posture(F.col("held")).alias("posture"),
        F.coalesce("includes", F.array().cast("array<struct<domain:string,provider:string,type:string>>")).alias("includes"),
    )


def suffix_domains(events: DataFrame, suffix: str, limit: int = 300) -> DataFrame:
    """Names at or below a suffix by their number of events."""
    reversed_name = "." + ".".join(reversed(suffix.lower().strip().rstrip(".").split(".")))
    name = F.col("domain_reversed")
    rows = events.where(((name == reversed_name) | name.startswith(reversed_name + ".")) & F.col("query_type").isin("MX", "TXT"))
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n_events")).orderBy(F.desc("n_events"), "domain").limit(limit).select(F.rtrim("domain", F.lit(".")).alias("domain"), "n_events")


def containing(found: DataFrame, part: str) -> DataFrame:
    """Of a list of names those that hold a text, in any case."""
    return found.where(F.contains(F.lower("domain"), F.lit(part.lower()))) if part else found


def value_as_of(events: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked (domain, query_type, day): whether an event precedes, and the value of the last one.

    Both sides meet in one window over the key, so no pairs are made.
    """
    nothing = F.lit(None)
    e = events.select(*KEY, F.col("measurement_date").alias("day"), F.struct("value").alias("v"), F.when(F.col("value").isNull(), 0).otherwise(1).alias("side"))
    a = asked.select(*KEY, "day", nothing.cast("struct<value:array<string>>").alias("v"), F.lit(2).alias("side"))
    order = Window.partitionBy(*KEY).orderBy("day", "side").rowsBetween(Window.unboundedPreceding, 0)
    found = e.unionByName(a).withColumn("last", F.last("v", ignorenulls=True).over(order)).where("side = 2")
    return found.select(*KEY, "day", F.col("last").isNotNull().alias("found"), F.col("last.value").alias("value"))


def totals(events: DataFrame) -> DataFrame:
    return events.agg(
        F.countDistinct("domain").alias("domain_count"), F.count(F.lit(1)).alias("event_count"), F.min("measurement_date").alias("min_date"), F.max("measurement_date").alias("max_date")
    )


def summary(mx: DataFrame, spf: DataFrame) -> DataFrame:
    """By domain: numbers of MX and SPF runs, first day, last day with a value, and the current runs' starts."""
    both = mx.select("domain", "start", "absent", F.lit("mx").alias("kind")).unionByName(spf.select("domain", "start", "absent", F.lit("spf").alias("kind")))
    of = lambda kind: F.col("kind") == kind
    return both.groupBy("domain").agg(
        F.count_if(of("mx")).alias("mx_changes"), F.count_if(of("spf")).alias("spf_changes"), F.min("start").alias("first_seen"),
        F.max(F.when(~F.col("absent"), F.col("start"))).alias("last_change"), F.max(F.when(of("mx"), F.col("start"))).alias("current_mx"), F.max(F.when(of("spf"), F.col("start"))).alias("current_spf"),
    )
