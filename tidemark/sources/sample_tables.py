"""The driver's tables as raw snapshots.

`events`: users become hosts, the last number of props picks the answer, and event types
become record types; error events get a type that the scan must drop. `orders`: customers
become hosts over more than six years, with every SPF mechanism, hosts that serve
themselves, and more includes and months than any report shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Endings of hosts and of SPF records.
ENDINGS = ("com", "nl", "co.uk")
TAILS = (' -all"', ' ~all"', ' ?all"', ' +all"', '"')
#: What stands in the records of orders; # is a number that the order's key picks among so many.
MECHANISMS = (
    ("include:_spf#.net", 97), ("redirect=_r#.org", 30), ("ip4:192.0.2.#", 200), ("ip6:2001:db8::#", 50), ("a", 1), ("a:h#.net", 9), ("mx", 1), ("mx:m#.net", 9),
    ("exists:x#.net", 5), ("ptr", 1), ("ptr:p#.net", 3), ("+include:_q#.net", 7), ("?mx", 1), ("-ptr", 1),
)
ORDER_TAILS = ("-all", "~all", "?all", "+all", "all", "")


def _pick(options: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in options]), (at % len(options) + 1).cast("int"))


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, query_name, query_type, mx_address, txt_text and source."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k, user = F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("int"), F.col("user_id")
    kind = F.when(F.col("event_type").isin("view", "click"), "MX").when(F.col("event_type").isin("purchase", "signup"), "TXT").otherwise("A")
    name = F.concat(F.lit("m"), user, F.lit(".d"), user % 40, F.lit("."), _pick(ENDINGS, user), F.lit("."))
    spf = F.concat(F.lit('"v=spf1 include:_spf'), k % 3, F.lit(".example ip4:192.0.2."), k % 8, _pick(TAILS, k))
    txt = F.when(k % 4 == 3, F.concat(F.lit('"site-verification='), k, F.lit('"'))).otherwise(spf)
    return events.select(
        F.col("ts").cast("date").alias("day"), name.alias("query_name"), kind.alias("query_type"),
        F.when(kind == "MX", F.concat(F.lit("mx.p"), k % 3, F.lit(".net."))).alias("mx_address"), F.when(kind == "TXT", txt).alias("txt_text"),
        F.when(user % 2 == 0, "toplists").otherwise("zonefiles").alias("source"),
    )


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of raw_rows from `orders`; of thirteen orders one has no answer."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    zone = F.concat(F.lit("g"), c % 50, F.lit("."), _pick(ENDINGS, c), F.lit("."))
    mechanism = _pick(tuple(text for text, _ in MECHANISMS), k)
    number = (k % _pick(tuple(str(n) for _, n in MECHANISMS), k).cast("long")).cast("string")
    spf = F.concat_ws(" ", F.lit("v=spf1"), F.replace(mechanism, F.lit("#"), number), F.concat(F.lit("include:_spf"), k % 89, F.lit(".net")), _pick(ORDER_TAILS, k))
    own, shared = F.concat(F.lit("10 mail."), zone), F.concat(F.lit("20 mx.p"), k % 23, F.lit(".net."))
    kind = F.when(F.floor(k / 4) % 2 == 0, "TXT").otherwise("MX")
    answered = k % 13 != 0
    return orders.select(
        F.col("o_orderdate").cast("date").alias("day"), F.concat(F.lit("c"), c, F.lit("."), zone).alias("query_name"), kind.alias("query_type"),
        F.when(answered & (kind == "MX"), F.when(k % 5 == 4, own).otherwise(shared)).alias("mx_address"),
        F.when(answered & (kind == "TXT"), F.concat(F.lit('"'), F.rtrim(spf), F.lit('"'))).alias("txt_text"), F.when(c % 2 == 0, "toplists").otherwise("zonefiles").alias("source"),
    )


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order day of a host as a sighting of all it has; a day whose orders have no answer ends what was there."""
    val = F.coalesce("mx_address", "txt_text")
    seen = order_rows(spark, sf_dir).groupBy(F.lower("query_name").alias("domain"), "query_type", F.col("day").alias("measurement_date")).agg(F.array_sort(F.collect_set(val)).alias("all"))
    value = F.when(F.size("all") > 0, F.col("all"))
    key = Window.partitionBy("domain", "query_type").orderBy("measurement_date")
    rows = seen.withColumn("value", value).withColumn("prev_value", F.lag("value").over(key))
    return rows.where(~F.col("value").eqNullSafe(F.col("prev_value"))).select("domain", "query_type", "measurement_date", "value", "prev_value")
