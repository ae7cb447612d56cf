"""Reports over the current state, or over anything with domain, query_type and value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.mail import mechanism, mechanism_value, mx_server, unquoted
from tidemark.functions.names import approximate_registrable, registrable_domain

#: Defaults of the reports and the cap on whole records.
TOP, LEAST, WHOLE_RECORDS = 1000, 10, 50


def percent(n: Column, total: Column, digits: int = 2) -> Column:
    return F.round(n * F.lit(100.0) / F.nullif(total, F.lit(0)), digits)


def ranked(counts: DataFrame, name: str, total: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """rank, name, domains, pct of counts (name, domains); 0 for top means all. total: one row, `total`.

    Ranks follow the count, then the name.
    """
    rows = counts.where(F.col("domains") >= least).orderBy(F.desc("domains"), name)
    rows = rows.limit(top) if top > 0 else rows
    place = F.row_number().over(Window.orderBy(F.desc("domains"), name))
    return rows.join(F.broadcast(total)).select(place.cast("long").alias("rank"), name, "domains", percent(F.col("domains"), F.col("total")).alias("pct"))


def having(state: DataFrame, query_type: str) -> DataFrame:
    return state.where((F.col("query_type") == query_type) & F.col("value").isNotNull() & (F.size("value") > 0))


def mx_total(state: DataFrame) -> DataFrame:
    return having(state, "MX").agg(F.countDistinct("domain").alias("total"))


def mx_pairs(state: DataFrame) -> DataFrame:
    hosts = having(state, "MX").select("domain", F.explode("value").alias("v")).select("domain", mx_server(F.col("v")).alias("mx_server"))
    return hosts.where("mx_server <> ''").distinct()


def top_mx_servers(state: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    counts = mx_pairs(state).groupBy("mx_server").agg(F.count(F.lit(1)).alias("domains"))
    return ranked(counts, "mx_server", mx_total(state), top, least)


def top_mx_providers(state: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """By registrable domain of the host; the look-up runs once for each different host."""
    pairs = mx_pairs(state)
    names = pairs.select("mx_server").distinct().withColumn("provider", registrable_domain(F.col("mx_server")))
    counts = pairs.join(names, "mx_server").groupBy("provider").agg(F.countDistinct("domain").alias("domains"))
    return ranked(counts, "provider", mx_total(state), top, least)


def spf_entries(state: DataFrame) -> DataFrame:
    """domain and entry of TXT strings that begin with v=spf1, by case."""
    return having(state, "TXT").select("domain", F.explode("value").alias("v")).select("domain", unquoted(F.col("v")).alias("entry")).where(F.col("entry").startswith("v=spf1"))


def spf_total(state: DataFrame) -> DataFrame:
    return spf_entries(state).agg(F.countDistinct("domain").alias("total"))


def spf_tokens(state: DataFrame) -> DataFrame:
    """domain, token, mtype, mvalue."""
    tokens = spf_entries(state).select("domain", F.explode(F.split("entry", " ")).alias("t")).select("domain", F.lower(F.trim("t")).alias("token"))
    tokens = tokens.where("token <> '' AND token <> 'v=spf1'")
    return tokens.select("domain", "token", mechanism(F.col("token")).alias("mtype"), mechanism_value(F.col("token")).alias("mvalue"))


def mechanism_types(state: DataFrame) -> DataFrame:
    counts = spf_tokens(state).groupBy("mtype").agg(F.countDistinct("domain").alias("domains"))
    return counts.join(F.broadcast(spf_total(state))).select("mtype", "domains", percent(F.col("domains"), F.col("total")).alias("pct"))


def top_mechanism_values(state: DataFrame, mtype: str, top: int = TOP, least: int = LEAST) -> DataFrame:
    found = spf_tokens(state).where((F.col("mtype") == mtype) & (F.col("mvalue") != ""))
    return ranked(found.groupBy(F.col("mvalue").alias("name")).agg(F.countDistinct("domain").alias("domains")), "name", spf_total(state), top, least)


def all_qualifiers(state: DataFrame) -> DataFrame:
    """How many domains have each form of `all`, and how many have none."""
    tokens = spf_tokens(state)
    has = tokens.where("mtype = 'all'").select("domain", "token").distinct()
    without = tokens.select("domain").distinct().join(has.select("domain").distinct(), "domain", "left_anti")
    rows = has.groupBy(F.col("token").alias("qualifier")).agg(F.count(F.lit(1)).alias("domains")).unionByName(
        without.agg(F.count(F.lit(1)).alias("domains")).select(F.lit("(no all)").alias("qualifier"), "domains")
    )
    return rows.join(F.broadcast(spf_total(state))).select("qualifier", "domains", percent(F.col("domains"), F.col("total")).alias("pct"))


def top_spf_strings(state: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    counts = spf_entries(state).groupBy(F.col("entry").alias("spf_string")).agg(F.countDistinct("domain").alias("domains"))
    return ranked(counts, "spf_string", spf_total(state), min(top, WHOLE_RECORDS) if top > 0 else WHOLE_RECORDS, least)


def provider_share(counts: DataFrame, names: DataFrame, key: str, total: DataFrame, top: int, with_type: bool = False) -> DataFrame:
    """Counts (key, cnt) by provider; a domain with two keys of one provider counts twice, as the reports do."""
    extra = [F.coalesce(F.min_by("type", F.struct(-F.col("cnt"), F.col(key))), F.lit("")).alias("type")] if with_type else []
    named = counts.join(names, key, "left").withColumn("provider", F.coalesce("provider", key))
    rows = named.groupBy("provider").agg(F.sum("cnt").alias("domain_count"), *extra)
    share = F.coalesce(percent(F.col("domain_count"), F.col("total"), 1), F.lit(0.0)).alias("percentage")
    return rows.orderBy(F.desc("domain_count"), "provider").limit(top).join(F.broadcast(total)).select("provider", *(["type"] if with_type else []), "domain_count", share)


def mx_provider_distribution(state: DataFrame, providers: DataFrame, top: int = 15) -> DataFrame:
    hosts = state.where("query_type = 'MX' AND value IS NOT NULL")
    pairs = hosts.select("domain", F.explode("value").alias("h")).select("domain", approximate_registrable(F.col("h")).alias("reg_domain")).where("reg_domain <> ''")
    counts = pairs.groupBy("reg_domain").agg(F.countDistinct("domain").alias("cnt"))
    total = hosts.agg(F.countDistinct("domain").alias("total"))
    return provider_share(counts, providers.select("reg_domain", "provider"), "reg_domain", total, top)


def spf_tool_distribution(state: DataFrame, tools: DataFrame, top: int = 15) -> DataFrame:
    joined = F.array_join("value", " ")
    spf = state.where("query_type = 'TXT' AND value IS NOT NULL").select("domain", joined.alias("spf")).where(F.col("spf").ilike("%v=spf1%"))
    each = spf.select("domain", F.explode(F.regexp_extract_all("spf", F.lit("include:([^ ]+)"), F.lit(1))).alias("i")).where("i <> ''")
    counts = each.groupBy(F.lower("i").alias("inc_domain")).agg(F.countDistinct("domain").alias("cnt"))
    total = spf.agg(F.countDistinct("domain").alias("total"))
    return provider_share(counts, tools.select("inc_domain", "provider", "type"), "inc_domain", total, top, with_type=True)


def historical_state(raw: DataFrame, days: DataFrame) -> DataFrame:
    """Every different answer of the sampled days as a state: raw (day, query_name, query_type, mx_address, txt_text)."""
    answer = F.when(F.col("query_type") == "MX", F.col("mx_address")).when(F.col("query_type") == "TXT", F.col("txt_text"))
    sampled = raw.join(days.select("day").distinct(), "day", "left_semi")
    rows = sampled.select(F.lower("query_name").alias("domain"), "query_type", answer.alias("v")).where("v <> ''").distinct()
    return rows.select("domain", "query_type", F.array("v").alias("value"))
