"""Monthly SPF adoption: events carried forward over months, counted once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.mail import unquoted

#: Fixed value: how many includes are reported.
TOP_INCLUDES = 75


def live_months(events: DataFrame, first: str, last: str, by: tuple[str, ...]) -> DataFrame:
    """Each live event with the months it covers: from its own to the one before the next event's.

    Months are generated from the bounds, so there is no join with a calendar.
    """
    key = Window.partitionBy(*by).orderBy("measurement_date", F.col("value").isNotNull())
    start = F.greatest(F.trunc("measurement_date", "MM"), F.lit(first).cast("date"))
    stop = F.least(F.add_months(F.trunc("next_date", "MM"), -1), F.lit(last).cast("date"))
    rows = events.withColumn("next_date", F.lead("measurement_date").over(key)).where("value IS NOT NULL")
    rows = rows.withColumn("start", start).withColumn("stop", stop).where("start <= stop")
    return rows.select("domain", "query_type", "value", F.explode(F.sequence("start", "stop", F.expr("interval 1 month"))).alias("month"))


def monthly_counts(events: DataFrame, first: str, last: str, by_source: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Domains by month (month, n), SPF domains by month, and domains by month and include.

    by_source keeps histories of two sources apart; events then need a `source`.
    """
    extra = ("source",) if by_source else ()
    every = live_months(events, first, last, (*extra, "domain", "query_type"))
    domains = every.groupBy("month").agg(F.countDistinct("domain").alias("n"))
    txt = live_months(events.where("query_type = 'TXT'"), first, last, (*extra, "domain"))
    entries = txt.select("month", "domain", F.explode("value").alias("v")).select("month", "domain", unquoted(F.col("v")).alias("entry"))
    spf = entries.where(F.col("entry").startswith("v=spf1")).distinct()
    totals = spf.groupBy("month").agg(F.countDistinct("domain").alias("n"))
    each = spf.select("month", "domain", F.explode(F.regexp_extract_all("entry", F.lit("include:([^ ]+)"), F.lit(1))).alias("i"))
    includes = each.select("month", "domain", F.lower(F.trim("i")).alias("inc_domain")).where("inc_domain <> ''")
    return domains, totals, includes.groupBy("month", "inc_domain").agg(F.countDistinct("domain").alias("n"))


def _pct(n: Column, total: Column, digits: int = 4) -> Column:
    return F.round(n * F.lit(100.0) / F.nullif(total, F.lit(0)), digits)


def _category(tools: DataFrame) -> DataFrame:
    return tools.select("inc_domain", "provider", F.col("type").alias("category"))


def kind() -> Column:
    return F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("unknown"))



def overall(domains: DataFrame, totals: DataFrame) -> DataFrame:
    rows = totals.withColumnRenamed("n", "spf_domains").join(domains.withColumnRenamed("n", "total_domains"), "month")
    return rows.select("month", "spf_domains", "total_domains", _pct(F.col("spf_domains"), F.col("total_domains")).alias("pct"))


def categories(includes: DataFrame, totals: DataFrame, tools: DataFrame) -> DataFrame:
    """Sums of the includes' domains: two includes of one category count twice, so pct may pass 100."""
    sums = includes.join(_category(tools), "inc_domain", "left").groupBy("month", kind().alias("category")).agg(F.sum("n").alias("domain_count"))
    rows = sums.join(totals.withColumnRenamed("n", "total_spf_domains"), "month")
    return rows.select("month", "category", "domain_count", "total_spf_domains", _pct(F.col("domain_count"), F.col("total_spf_domains")).alias("pct"))


def _leading(includes: DataFrame, top: int) -> DataFrame:
    return includes.groupBy("inc_domain").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "inc_domain").limit(top)


def top_includes(includes: DataFrame, totals: DataFrame, tools: DataFrame, top: int = TOP_INCLUDES) -> DataFrame:
    rows = includes.join(_leading(includes, top), "inc_domain", "left_semi").join(totals.withColumnRenamed("n", "total_spf_domains"), "month")
    rows = rows.join(_category(tools), "inc_domain", "left")
    return rows.select(
        "month", "inc_domain", F.coalesce("provider", "inc_domain").alias("provider"), kind().alias("category"), F.col("n").alias("domain_count"), "total_spf_domains",
        _pct(F.col("n"), F.col("total_spf_domains")).alias("pct"),
    )


def yearly_change(domains: DataFrame, totals: DataFrame) -> DataFrame:
    """overall with the difference from twelve rows before; one row a month."""
    rows = overall(domains, totals)
    before = F.lag("spf_domains", 12).over(Window.orderBy("month"))
    return rows.select("month", "spf_domains", "total_domains", F.round("pct", 2).alias("pct"), (F.col("spf_domains") - before).alias("yoy_change"))


def category_peaks(includes: DataFrame, totals: DataFrame, tools: DataFrame) -> DataFrame:
    """By category: the first month of the most domains, and the latest month's figures."""
    rows = categories(includes, totals, tools).withColumn("p", _pct(F.col("domain_count"), F.col("total_spf_domains"), 2))
    order = F.struct("domain_count", -F.datediff("month", F.lit("1970-01-01")))
    peak = rows.groupBy("category").agg(F.max("domain_count").alias("peak_domains"), F.max_by("month", order).alias("peak_month"), F.max_by("p", order).alias("peak_pct"))
    latest = totals.agg(F.max("month").alias("last"))
    now = rows.join(F.broadcast(latest), F.col("month") == F.col("last")).select("category", F.col("domain_count").alias("c"), F.col("p").alias("q"))
    return peak.join(now, "category", "left").select(
        "category", "peak_month", "peak_domains", "peak_pct", F.coalesce("c", F.lit(0)).alias("latest_domains"), F.coalesce("q", F.lit(0.0)).alias("latest_pct")
    )


def ranked_includes(includes: DataFrame, totals: DataFrame, tools: DataFrame, top: int = TOP_INCLUDES) -> DataFrame:
    """The leading includes with rank, domain-months and the latest month's figures."""
    latest = totals.orderBy(F.desc("month")).limit(1).select(F.col("month").alias("last"), F.col("n").alias("t"))
    now = includes.join(F.broadcast(latest), F.col("month") == F.col("last")).select("inc_domain", F.col("n").alias("c"), _pct(F.col("n"), F.col("t"), 2).alias("q"))
    rows = _leading(includes, top).join(now, "inc_domain", "left").join(_category(tools), "inc_domain", "left")
    place = F.row_number().over(Window.orderBy(F.desc("total"), "inc_domain")).cast("long")
    return rows.select(
        place.alias("rank"), "inc_domain", kind().alias("category"), F.col("total").alias("domain_months"), F.coalesce("c", F.lit(0)).alias("latest_domains"),
        F.coalesce("q", F.lit(0.0)).alias("latest_pct"),
    )


def latest_leaders(rows: DataFrame, top: int = 20) -> DataFrame:
    """All months of the includes that lead in the latest month; rows as of top_includes."""
    last = rows.agg(F.max("month").alias("last"))
    lead = rows.join(F.broadcast(last), F.col("month") == F.col("last")).orderBy(F.desc("pct"), "inc_domain").limit(top).select("inc_domain")
    return rows.join(lead, "inc_domain", "left_semi")


def category_order(rows: DataFrame) -> DataFrame:
    """Categories by their largest share."""
    return rows.groupBy("category").agg(F.max("pct").alias("max_pct"))


def write_tables(out: str, domains: DataFrame, totals: DataFrame, includes: DataFrame, tools: DataFrame, top: int = TOP_INCLUDES) -> None:
    """The three result tables as Parquet; each has a row a month and entry, so one file holds it."""
    made = {"overall": overall(domains, totals), "categories": categories(includes, totals, tools), "includes": top_includes(includes, totals, tools, top)}
    for name, df in made.items():
        df.coalesce(1).sortWithinPartitions("month").write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/{name}")
