"""The library's queries over the driver's tables, each with SQL for DuckDB where SQL can say it.

`events` stands in for daily snapshots (see sources.sample_tables). Adoption needs many
months, so there each day becomes three months of a stretched calendar.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.mail import raw_addresses, spf_includes, spf_posture, spf_record
from tidemark.functions.names import approximate_registrable, bucket, plain_host, registrable_domain, reversed_domain
from tidemark.operators import diff, history, store
from tidemark.plans import adoption, metrics, providers, state_reports, validation
from tidemark.session import shared_dir
from tidemark.sources import snapshots
from tidemark.sources.sample_tables import raw_rows

MX_NAMES = {"p0.net": {"provider": "P-Zero", "confidence": 90}, "p1.net": {"provider": "P-One", "confidence": 80}}
SPF_NAMES = {"_spf0.example": {"provider": "P-Zero", "type": "hosting", "confidence": 90}, "_spf1.example": {"provider": "P-One", "type": "email_provider", "confidence": 80}}
CUTOFF = datetime.date(2024, 2, 1)
MONTHS = ("2016-01-01", "2023-06-01")
SUFFIX, HOST = "d1.nl", "m1.d1.nl"


# ---------------------------------------------------------------- frames

def found_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, query_name, query_type, val."""
    raw = raw_rows(spark, sf_dir).withColumn("query_name", F.struct("day", "query_name"))
    return snapshots.answers(raw).select("query_name.day", "query_name.query_name", "query_type", "val")


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.daily_values(found_rows(spark, sf_dir), "day")


def events(spark: SparkSession, sf_dir: str, grace: int = 0) -> DataFrame:
    return diff.history_diff(snapshot(spark, sf_dir), grace, measured=found_rows(spark, sf_dir))


def named_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("registrable_domain", registrable_domain(F.col("domain"))).withColumn("domain_reversed", reversed_domain(F.col("domain")))


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.state_from_events(events(spark, sf_dir))


def sourced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.regexp_extract("domain", "^m([0-9]+)[.]", 1).cast("long")
    return events(spark, sf_dir).withColumn("source", F.when(user % 2 == 0, "toplists").otherwise("zonefiles"))


def stretched_counts(spark: SparkSession, sf_dir: str):
    far = F.add_months(F.lit("2016-01-01").cast("date"), F.datediff("day", F.lit("2024-01-01")) * 3)
    days, measured = (df(spark, sf_dir).withColumn("day", far) for df in (snapshot, found_rows))
    return adoption.monthly_counts(diff.history_diff(days, measured=measured), *MONTHS)


def mx_names(spark: SparkSession) -> DataFrame:
    return snapshots.mapping(spark, MX_NAMES)


def spf_names(spark: SparkSession) -> DataFrame:
    return snapshots.mapping(spark, SPF_NAMES, spf=True)


def _flat(df: DataFrame, *lists: str) -> DataFrame:
    """Lists as text, so that any reader compares them alike."""
    for c in lists:
        df = df.withColumn(c, F.array_join(c, "|"))
    return df


def _flat_events(df: DataFrame) -> DataFrame:
    return _flat(df, "value", "prev_value")


# ---------------------------------------------------------------- SQL

RAW = """raw AS (
  SELECT CAST(ts AS DATE) AS day, 'm' || user_id || '.d' || user_id % 40 || '.' || ['com', 'nl', 'co.uk'][user_id % 3 + 1] || '.' AS domain,
         CASE WHEN event_type IN ('view', 'click') THEN 'MX' WHEN event_type IN ('purchase', 'signup') THEN 'TXT' END AS query_type,
         CASE WHEN event_type IN ('view', 'click') THEN 'mx.p' || k % 3 || '.net.'
              WHEN k % 4 = 3 THEN '"site-verification=' || k || '"'
              ELSE '"v=spf1 include:_spf' || k % 3 || '.example ip4:192.0.2.' || k % 8 || [' -all"', ' ~all"', ' ?all"', ' +all"', '"'][k % 5 + 1] END AS val
  FROM (SELECT *, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INT) AS k FROM events)
  WHERE event_type IN ('view', 'click', 'purchase', 'signup'))"""
SNAP = RAW + """, snap AS (SELECT day, domain, query_type, list_sort(list(DISTINCT val)) AS value FROM raw GROUP BY day, domain, query_type)"""


def _diff_sql(grace: int = 0, snap: str = "snap") -> str:
    left = f" AND last_day - next_day > {grace}" if grace else ""
    return f""", days AS (
  SELECT day, row_number() OVER (ORDER BY day) AS i, lead(day) OVER (ORDER BY day) AS next_day, max(day) OVER () AS last_day FROM (SELECT DISTINCT day FROM {snap})),
w AS (SELECT s.*, i, next_day, last_day, lag(value) OVER k AS pv, lag(i) OVER k AS pi, lag(next_day) OVER k AS gone, lead(i) OVER k AS li
      FROM {snap} s JOIN days USING (day) WINDOW k AS (PARTITION BY domain, query_type ORDER BY day)),
g AS (SELECT *, i > pi + 1 AND NOT (value = pv AND day - gone <= {grace}) AS away FROM w),
ev AS (
  SELECT domain, query_type, day AS measurement_date, value, NULL AS prev_value FROM g WHERE pi IS NULL OR away
  UNION ALL SELECT domain, query_type, day, value, pv FROM g WHERE i = pi + 1 AND value IS DISTINCT FROM pv
  UNION ALL SELECT domain, query_type, gone, NULL, pv FROM g WHERE away
  UNION ALL SELECT domain, query_type, next_day, NULL, value FROM g WHERE li IS NULL AND next_day IS NOT NULL{left})"""


EV = SNAP + _diff_sql()
STATE_CTE = EV + """, last AS (
  SELECT *, row_number() OVER (PARTITION BY domain, query_type ORDER BY measurement_date DESC, value IS NOT NULL DESC) AS r FROM ev),
st AS (SELECT domain, query_type, value, measurement_date AS last_date FROM last WHERE r = 1 AND value IS NOT NULL)"""
TYPED = EV + """, ty AS (
  SELECT *, CASE WHEN prev_value IS NULL AND value IS NOT NULL THEN 'appearance' WHEN value IS NULL AND prev_value IS NOT NULL THEN 'disappearance' ELSE 'change' END AS event_type FROM ev),
cl AS (SELECT *, lead(event_type) OVER k AS next_type, lead(measurement_date) OVER k AS next_date FROM ty
       WINDOW k AS (PARTITION BY domain, query_type ORDER BY measurement_date, value IS NOT NULL))"""
REG = "regexp_extract(domain, '^m[0-9]+[.](.*)[.]$', 1)"
LISTS = "array_to_string(value, '|') AS value, array_to_string(prev_value, '|') AS prev_value"
MX_DIM = "mxd AS (SELECT * FROM (VALUES ('p0.net', 'P-Zero', 90), ('p1.net', 'P-One', 80)) t(reg_domain, provider, confidence))"
SPF_DIM = "spd AS (SELECT * FROM (VALUES ('_spf0.example', 'P-Zero', 'hosting', 90), ('_spf1.example', 'P-One', 'email_provider', 80)) t(inc_domain, provider, category, confidence))"
#: The mechanisms that open with a mark, and whether reports list what follows it; the bare words stand for themselves.
OPENINGS = "openings(kind, mark, listed) AS (VALUES ('include', 'include:', true), ('redirect', 'redirect=', true), ('ip4', 'ip4:', true), ('ip6', 'ip6:', true), ('a', 'a:', true), ('mx', 'mx:', true), ('exists', 'exists:', false), ('ptr', 'ptr:', false))"
SPF_ROWS = f""", strings AS (SELECT domain, unnest(value) AS quoted FROM st WHERE query_type = 'TXT'),
spf AS (SELECT domain, trim(quoted, '"') AS entry FROM strings WHERE starts_with(trim(quoted, '"'), 'v=spf1')),
total AS (SELECT count(DISTINCT domain) AS total FROM spf), {OPENINGS},
words AS (SELECT DISTINCT domain, lower(trim(w.word)) AS token FROM spf, unnest(string_split(entry, ' ')) AS w(word)),
tok AS (SELECT domain, token, coalesce(kind, nullif(regexp_extract(token, '^[-+~?]?(a|mx|ptr|all)$', 1), ''), 'other') AS mtype, CASE WHEN listed THEN substr(token, length(mark) + 1) END AS mvalue
        FROM words LEFT JOIN openings ON starts_with(token, mark) WHERE token NOT IN ('', 'v=spf1'))"""
MX_ROWS = """, hosts AS (SELECT DISTINCT domain, lower(rtrim(regexp_replace(h, '^[0-9]+\\s+', ''), '.')) AS mx_server FROM (SELECT domain, unnest(value) AS h FROM st WHERE query_type = 'MX')),
total AS (SELECT count(DISTINCT domain) AS total FROM st WHERE query_type = 'MX')"""


def _ranked_sql(counts: str, name: str, least: int, limit: int) -> str:
    return f"""SELECT row_number() OVER (ORDER BY domains DESC, {name}) AS rank, {name}, domains, round(domains * 100.0::DOUBLE / total, 2) AS pct
FROM ({counts}) JOIN total ON true WHERE domains >= {least} ORDER BY domains DESC, {name} LIMIT {limit}"""


STRETCH = SNAP + """, far AS (SELECT CAST(DATE '2016-01-01' + to_months(CAST((day - DATE '2024-01-01') * 3 AS INT)) AS DATE) AS day, domain, query_type, value FROM snap)""" + _diff_sql(0, "far")
def _monthly_sql(events: str, months: tuple[str, str]) -> str:
    return events + f""", ms AS (SELECT CAST(m AS DATE) AS month FROM generate_series(DATE '{months[0]}', DATE '{months[1]}', INTERVAL '1 month') t(m)),
ea AS (SELECT *, lead(measurement_date) OVER (PARTITION BY domain, query_type ORDER BY measurement_date, value IS NOT NULL) AS nd FROM ev),
et AS (SELECT *, lead(measurement_date) OVER (PARTITION BY domain ORDER BY measurement_date, value IS NOT NULL) AS nd FROM ev WHERE query_type = 'TXT'),
dom AS (SELECT month, count(DISTINCT domain) AS n FROM ea JOIN ms ON date_trunc('month', measurement_date) <= month AND (nd IS NULL OR date_trunc('month', nd) > month) WHERE value IS NOT NULL GROUP BY month),
act AS (SELECT month, domain, trim(v, '"') AS entry FROM (SELECT month, domain, unnest(value) AS v FROM et JOIN ms ON date_trunc('month', measurement_date) <= month AND (nd IS NULL OR date_trunc('month', nd) > month) WHERE value IS NOT NULL)),
sp AS (SELECT DISTINCT * FROM act WHERE entry LIKE 'v=spf1%'),
tot AS (SELECT month, count(DISTINCT domain) AS n FROM sp GROUP BY month),
inc AS (SELECT month, lower(trim(i)) AS inc_domain, count(DISTINCT domain) AS n FROM (SELECT month, domain, unnest(regexp_extract_all(entry, 'include:([^ ]+)', 1)) AS i FROM sp) WHERE trim(i) <> '' GROUP BY ALL), {SPF_DIM}"""


CATS_TAIL = """, cat AS (SELECT i.month, coalesce(nullif(category, ''), 'unknown') AS category, sum(i.n)::BIGINT AS domain_count, any_value(tot.n) AS total_spf_domains
  FROM inc i LEFT JOIN spd USING (inc_domain) JOIN tot ON tot.month = i.month GROUP BY 1, 2)"""
INCS_TAIL = """, lead_ AS (SELECT inc_domain, sum(n)::BIGINT AS total FROM inc GROUP BY 1 ORDER BY total DESC, inc_domain LIMIT 75),
rows_ AS (SELECT i.month, i.inc_domain, coalesce(provider, i.inc_domain) AS provider, coalesce(nullif(category, ''), 'unknown') AS category, i.n AS domain_count, tot.n AS total_spf_domains,
          round(i.n * 100.0::DOUBLE / tot.n, 4) AS pct
          FROM inc i JOIN lead_ USING (inc_domain) JOIN tot ON tot.month = i.month LEFT JOIN spd ON spd.inc_domain = i.inc_domain)"""
MONTHLY = _monthly_sql(STRETCH, MONTHS)
CATS, INCS = MONTHLY + CATS_TAIL, MONTHLY + INCS_TAIL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- snapshots and diff

@query(f"WITH {SNAP} SELECT day, domain, query_type, array_to_string(value, '|') AS value FROM snap")
def snapshot_aggregate(spark, sf_dir):
    return _flat(snapshot(spark, sf_dir), "value")


@query(f"WITH {EV} SELECT domain, query_type, measurement_date, {LISTS} FROM ev")
def diff_events_g0(spark, sf_dir):
    return _flat_events(events(spark, sf_dir))


@query(f"WITH {SNAP}{_diff_sql(7)} SELECT domain, query_type, measurement_date, {LISTS} FROM ev")
def diff_events_g7(spark, sf_dir):
    return _flat_events(events(spark, sf_dir, 7))


@query(f"WITH {TYPED} SELECT event_type, count(*) AS n FROM cl GROUP BY 1")
def diff_case_counts(spark, sf_dir):
    return diff.classified(events(spark, sf_dir)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {STATE_CTE} SELECT domain, query_type, array_to_string(value, '|') AS value, last_date FROM st")
def state_latest(spark, sf_dir):
    return _flat(state(spark, sf_dir).drop("missing_since"), "value")


LAST_DAY = datetime.date(2024, 1, 20)


@query(f"WITH {SNAP}{_diff_sql()} SELECT domain, query_type, measurement_date, {LISTS} FROM ev WHERE measurement_date = DATE '{LAST_DAY}'")
def diff_incremental_one_day(spark, sf_dir):
    """One day by full outer join against the state of the days before: what the closed form has for that day."""
    days = snapshot(spark, sf_dir)
    before = diff.state_from_events(diff.history_diff(days.where(F.col("day") < F.lit(LAST_DAY))))
    actions = diff.classify_day(days.where(F.col("day") == F.lit(LAST_DAY)), before, LAST_DAY)
    return _flat_events(diff.day_events(actions, LAST_DAY))


@query(
    f"WITH {SNAP}, old AS (SELECT * FROM snap WHERE day < DATE '{LAST_DAY}'), prev AS (SELECT max(day) AS day FROM old) "
    f"SELECT domain, query_type, array_to_string(value, '|') AS value FROM snap WHERE day = DATE '{LAST_DAY}'"
)
def state_after_one_day(spark, sf_dir):
    """State application without grace: what is alive after a day is what the day shows."""
    days = snapshot(spark, sf_dir)
    before = diff.state_from_events(diff.history_diff(days.where(F.col("day") < F.lit(LAST_DAY))))
    actions = diff.classify_day(days.where(F.col("day") == F.lit(LAST_DAY)), before, LAST_DAY)
    return _flat(diff.apply_actions(before, actions, LAST_DAY).drop("missing_since"), "value")


@query(f"WITH {EV} SELECT DISTINCT domain, query_type, measurement_date, {LISTS} FROM ev")
def compaction_dedupe(spark, sf_dir):
    once = events(spark, sf_dir)
    return _flat_events(once.unionByName(once).dropDuplicates())


# ---------------------------------------------------------------- names

@query(f"WITH {RAW} SELECT DISTINCT domain, array_to_string(list_reverse(string_split(lower(domain), '.')), '.') AS reversed FROM raw")
def domain_reverse(spark, sf_dir):
    return snapshot(spark, sf_dir).select("domain").distinct().select("domain", reversed_domain(F.col("domain")).alias("reversed"))


@query(f"WITH {RAW} SELECT DISTINCT domain, {REG} AS registrable FROM raw")
def registrable(spark, sf_dir):
    return snapshot(spark, sf_dir).select("domain").distinct().select("domain", registrable_domain(F.col("domain")).alias("registrable"))


@query(r"SELECT page_id, host, regexp_extract(host, '([^.]+[.][^.]+)$') AS approximate FROM (SELECT page_id, lower(regexp_extract(url, '://([^/]+)', 1)) AS host FROM pages)")
def page_hosts(spark, sf_dir):
    host = plain_host(F.regexp_extract("url", "://([^/]+)", 1))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", host.alias("host"), approximate_registrable(host).alias("approximate"))


@query()
def bucket_assignment(spark, sf_dir):
    """BLAKE2b has no SQL; tests hold it against hashlib."""
    return snapshot(spark, sf_dir).select("domain").distinct().select("domain", bucket(registrable_domain(F.col("domain"))).alias("bucket"))


# ---------------------------------------------------------------- metrics

@query(f"WITH {EV} SELECT min(measurement_date) AS first_date, max(measurement_date) AS last_date, count(DISTINCT measurement_date) AS n_days FROM ev")
def date_range(spark, sf_dir):
    return metrics.date_range(events(spark, sf_dir))


@query(f"WITH {TYPED} SELECT event_type, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS pct FROM cl GROUP BY 1")
def event_type_breakdown(spark, sf_dir):
    return metrics.event_types(events(spark, sf_dir))


@query(
    f"WITH {EV} SELECT query_type, count(DISTINCT domain) AS domains, count(DISTINCT {REG}) AS registrable_domains FROM ev GROUP BY 1 "
    f"UNION ALL SELECT '(all)', count(DISTINCT domain), count(DISTINCT {REG}) FROM ev"
)
def unique_domains_by_type(spark, sf_dir):
    return metrics.unique_domains(named_events(spark, sf_dir))


@query(
    f"WITH {TYPED} SELECT query_type, count(*) AS total, count(*) FILTER (event_type = 'appearance') AS appearances, count(*) FILTER (event_type = 'disappearance') AS disappearances, "
    "count(*) FILTER (event_type = 'change') AS changes, count(DISTINCT domain) AS domains FROM cl GROUP BY 1"
)
def types_by_record(spark, sf_dir):
    return metrics.types_by_record(events(spark, sf_dir))


@query(f"WITH {EV} SELECT measurement_date, count(*) AS n FROM ev GROUP BY 1")
def events_per_day(spark, sf_dir):
    return metrics.per_day(events(spark, sf_dir))


@query(
    f"WITH {EV}, d AS (SELECT measurement_date, count(*) AS n FROM ev GROUP BY 1) SELECT min(n) AS min_n, max(n) AS max_n, floor(avg(n))::BIGINT AS avg_n, "
    "floor(median(n))::BIGINT AS median_n, count(*) FILTER (n < 100) AS low_days FROM d"
)
def events_per_day_stats(spark, sf_dir):
    return metrics.per_day_stats(events(spark, sf_dir))


GAPS = TYPED + ", gp AS (SELECT next_date - measurement_date AS gap, count(*) AS n FROM cl WHERE event_type = 'disappearance' AND next_type = 'appearance' GROUP BY 1)"


@query(f"WITH {GAPS} SELECT gap::BIGINT AS gap, n FROM gp")
def churn_gap_histogram(spark, sf_dir):
    return metrics.gap_histogram(events(spark, sf_dir))


PAIRS = TYPED + ", pr AS (SELECT *, next_date - measurement_date AS days FROM cl WHERE event_type = 'appearance' AND next_type = 'disappearance')"


@query(f"WITH {PAIRS} SELECT count(*) AS pairs, count(*) FILTER (days < 7) AS ephemeral, count(DISTINCT domain || '|' || query_type) FILTER (days < 7) AS ephemeral_keys FROM pr")
def ephemeral_pairs(spark, sf_dir):
    return metrics.ephemeral_pairs(events(spark, sf_dir))


@query(
    f"WITH {PAIRS}, h AS (SELECT days::BIGINT AS span, count(*) AS n FROM pr WHERE days <= 30 GROUP BY 1) "
    "SELECT span, n, round(sum(n) OVER (ORDER BY span) * 100.0::DOUBLE / (SELECT count(*) FROM pr), 2) AS cum_pct FROM h"
)
def span_histogram(spark, sf_dir):
    return metrics.span_histogram(events(spark, sf_dir))


@query(f"WITH {TYPED}, k AS (SELECT count(*) AS n_disappearances FROM cl WHERE event_type = 'disappearance' GROUP BY domain, query_type) SELECT n_disappearances, count(*) AS n_keys FROM k GROUP BY 1")
def multi_churn_distribution(spark, sf_dir):
    return metrics.multi_churn(events(spark, sf_dir))


@query(
    f"WITH {TYPED} SELECT domain, query_type, count(*) AS total_events, count(*) FILTER (event_type = 'change') AS changes, count(*) FILTER (event_type = 'disappearance') AS disappearances, "
    "count(*) FILTER (event_type = 'appearance') AS appearances FROM cl GROUP BY 1, 2 ORDER BY total_events DESC, domain, query_type LIMIT 1000"
)
def top_volatile(spark, sf_dir):
    return metrics.top_volatile(events(spark, sf_dir))


CURVE = GAPS + """, c AS (SELECT grace, coalesce(n, 0)::BIGINT AS marginal FROM range(1, 31) r(grace) LEFT JOIN gp ON gap = grace),
cv AS (SELECT grace, sum(marginal) OVER (ORDER BY grace)::BIGINT AS suppressed, marginal, lead(marginal) OVER (ORDER BY grace) - marginal AS second_diff FROM c)"""


@query(f"WITH {CURVE} SELECT *, round(suppressed * 100.0::DOUBLE / (SELECT count(*) FROM cl WHERE event_type = 'disappearance'), 2) AS pct FROM cv")
def grace_suppression_curve(spark, sf_dir):
    return metrics.grace_curve(events(spark, sf_dir))


@query(f"WITH {CURVE}, kn AS (SELECT grace + 1 AS knee_day FROM cv WHERE second_diff IS NOT NULL ORDER BY second_diff, grace LIMIT 1) SELECT knee_day, suppressed FROM kn JOIN cv ON knee_day = grace")
def grace_knee(spark, sf_dir):
    return metrics.grace_knee(events(spark, sf_dir))


# ---------------------------------------------------------------- history

RUNS = """, ru AS (SELECT *, row_number() OVER k AS n_, lag(held) OVER k AS before FROM {rows} WINDOW k AS (PARTITION BY domain ORDER BY measurement_date, value IS NOT NULL)),
kept AS (SELECT * FROM ru WHERE n_ = 1 OR held IS DISTINCT FROM before),
sg AS (SELECT domain, measurement_date AS start, coalesce(lead(measurement_date) OVER (PARTITION BY domain ORDER BY measurement_date, value IS NOT NULL), DATE '2024-02-01') AS "end", held FROM kept)"""
MX_RUNS = EV + ", rw AS (SELECT *, value AS held FROM ev WHERE query_type = 'MX')" + RUNS.format(rows="rw")
SPF_RUNS = (
    EV
    + """, pl AS (SELECT *, list_transform(value, lambda v: trim(v, '"')) AS plain FROM ev WHERE query_type = 'TXT'),
rw AS (SELECT *, CASE WHEN lower(array_to_string(plain, ' ')) LIKE 'v=spf1%' THEN array_to_string(plain, ' ') ELSE list_filter(plain, lambda v: lower(v) LIKE 'v=spf1%')[1] END AS held FROM pl)"""
    + RUNS.format(rows="rw")
)
WHO = "CASE h WHEN 'mx.p0.net.' THEN 'P-Zero' WHEN 'mx.p1.net.' THEN 'P-One' ELSE 'p2.net' END"


@query(
    f"""WITH {MX_RUNS} SELECT domain, start, "end", held IS NULL AS absent, array_to_string(list_transform(coalesce(held, []), lambda h: rtrim(h, '.')), '|') AS mx_records,
array_to_string(list_transform(held, lambda h: {WHO}), ' / ') AS provider, false AS self_hosted FROM sg"""
)
def mx_segments(spark, sf_dir):
    return _flat(history.mx_segments(events(spark, sf_dir), mx_names(spark), CUTOFF), "mx_records")


POSTURE = "CASE WHEN held IS NULL OR held = '' THEN 'No SPF' WHEN NOT regexp_matches(lower(held), '[+~?-]?all(\\s|$)') THEN 'no ?all' ELSE coalesce(nullif(regexp_extract(lower(held), '([+~?-]?)all(?:\\s|$)', 1), ''), '+') || 'all' END"


@query(
    f"""WITH {SPF_RUNS} SELECT domain, start, "end", held IS NULL AS absent, held AS spf, {POSTURE} AS posture,
coalesce(array_to_string(list_transform(regexp_extract_all(held, 'include:(\\S+)', 1), lambda i: i || '=' || CASE i WHEN '_spf0.example' THEN 'P-Zero/hosting' WHEN '_spf1.example' THEN 'P-One/email_provider' ELSE i || '/' END), '|'), '') AS includes
FROM sg"""
)
def spf_segments(spark, sf_dir):
    found = history.spf_segments(events(spark, sf_dir), spf_names(spark), CUTOFF)
    one = F.transform("includes", lambda i: F.concat(i["domain"], F.lit("="), i["provider"], F.lit("/"), i["type"]))
    return _flat(found.withColumn("includes", one), "includes")


@query(
    f"""WITH {SNAP}, t AS (SELECT DISTINCT list_transform(value, lambda v: trim(v, '"')) AS plain FROM snap WHERE query_type = 'TXT'),
r AS (SELECT CASE WHEN lower(array_to_string(plain, ' ')) LIKE 'v=spf1%' THEN array_to_string(plain, ' ') ELSE list_filter(plain, lambda v: lower(v) LIKE 'v=spf1%')[1] END AS held FROM t)
SELECT DISTINCT held AS spf, {POSTURE} AS posture, coalesce(array_to_string(regexp_extract_all(held, 'include:(\\S+)', 1), '|'), '') AS includes,
coalesce(array_to_string(regexp_extract_all(held, 'ip[46]:(\\S+)', 1), '|'), '') AS addresses FROM r"""
)
def spf_records(spark, sf_dir):
    held = snapshot(spark, sf_dir).where("query_type = 'TXT'").select(spf_record(F.col("value")).alias("spf")).distinct()
    return _flat(held.select("spf", spf_posture(F.col("spf")).alias("posture"), spf_includes(F.col("spf")).alias("includes"), raw_addresses(F.col("spf")).alias("addresses")), "includes", "addresses")


@query(f"WITH {EV} SELECT rtrim(domain, '.') AS domain, count(*) AS n_events FROM ev WHERE domain = '{SUFFIX}.' OR domain LIKE '%.{SUFFIX}.' GROUP BY 1 ORDER BY n_events DESC, domain LIMIT 300")
def suffix_domains(spark, sf_dir):
    return history.suffix_domains(named_events(spark, sf_dir), SUFFIX)


@query(f"WITH {EV} SELECT 'toplists' AS source, false AS found UNION ALL SELECT 'zonefiles', count(*) > 0 FROM ev WHERE domain = '{HOST}.'")
def check_sources(spark, sf_dir):
    return history.sources_of(sourced_events(spark, sf_dir), ["toplists", "zonefiles"], HOST)


ASKED = ", asked AS (SELECT DISTINCT domain, query_type, DATE '2024-01-15' AS day FROM snap)"


@query(
    f"WITH {EV}{ASKED} SELECT a.domain, a.query_type, a.day, count(e.domain) > 0 AS found, array_to_string(arg_max({{'v': e.value}}, e.measurement_date * 2 + (e.value IS NOT NULL)::INT).v, '|') AS value "
    "FROM asked a LEFT JOIN (SELECT domain, query_type, value, (measurement_date - DATE '2000-01-01') AS measurement_date, measurement_date AS d FROM ev) e "
    "ON e.domain = a.domain AND e.query_type = a.query_type AND e.d <= a.day GROUP BY 1, 2, 3"
)
def asof_lookup(spark, sf_dir):
    asked = snapshot(spark, sf_dir).select("domain", "query_type").distinct().withColumn("day", F.lit("2024-01-15").cast("date"))
    return _flat(history.value_as_of(events(spark, sf_dir), asked), "value")


@query(f"WITH {EV} SELECT count(DISTINCT domain) AS domain_count, count(*) AS event_count, min(measurement_date) AS min_date, max(measurement_date) AS max_date FROM ev")
def dataset_metrics(spark, sf_dir):
    return history.totals(events(spark, sf_dir))


@query(
    f"""WITH {MX_RUNS.replace('rw AS', 'rwm AS').replace('FROM rw ', 'FROM rwm ').replace('ru AS', 'rum AS').replace('FROM ru ', 'FROM rum ').replace('kept AS', 'km AS').replace('FROM kept', 'FROM km').replace('sg AS', 'sm AS')}
{SPF_RUNS[len(EV):]}, b AS (SELECT domain, start, held IS NULL AS absent, 'mx' AS kind FROM sm UNION ALL SELECT domain, start, held IS NULL, 'spf' FROM sg)
SELECT domain, count(*) FILTER (kind = 'mx') AS mx_changes, count(*) FILTER (kind = 'spf') AS spf_changes, min(start) AS first_seen, max(start) FILTER (NOT absent) AS last_change,
max(start) FILTER (kind = 'mx') AS current_mx, max(start) FILTER (kind = 'spf') AS current_spf FROM b GROUP BY 1"""
)
def domain_summary(spark, sf_dir):
    found = events(spark, sf_dir)
    return history.summary(history.mx_segments(found, mx_names(spark), CUTOFF), history.spf_segments(found, spf_names(spark), CUTOFF))


# ---------------------------------------------------------------- state reports

@query(
    f"WITH {STATE_CTE}{MX_ROWS}, {MX_DIM}, c AS (SELECT regexp_extract(mx_server, '([^.]+[.][^.]+)$') AS reg_domain, count(DISTINCT domain) AS cnt FROM hosts GROUP BY 1) "
    "SELECT coalesce(provider, reg_domain) AS provider, sum(cnt)::BIGINT AS domain_count, round(sum(cnt) * 100.0::DOUBLE / any_value(total), 1) AS percentage "
    "FROM c LEFT JOIN mxd USING (reg_domain) JOIN total ON true GROUP BY 1 ORDER BY domain_count DESC, provider LIMIT 15"
)
def mx_provider_distribution(spark, sf_dir):
    return state_reports.mx_provider_distribution(state(spark, sf_dir), mx_names(spark))


@query(
    f"""WITH {STATE_CTE}, {SPF_DIM}, s AS (SELECT domain, array_to_string(value, ' ') AS spf FROM st WHERE query_type = 'TXT' AND array_to_string(value, ' ') ILIKE '%v=spf1%'),
i AS (SELECT lower(x) AS inc_domain, count(DISTINCT domain) AS cnt FROM (SELECT domain, unnest(regexp_extract_all(spf, 'include:([^ ]+)', 1)) AS x FROM s) GROUP BY 1)
SELECT coalesce(provider, inc_domain) AS provider, coalesce(any_value(category), '') AS type, sum(cnt)::BIGINT AS domain_count,
round(sum(cnt) * 100.0::DOUBLE / (SELECT count(DISTINCT domain) FROM s), 1) AS percentage FROM i LEFT JOIN spd USING (inc_domain) GROUP BY 1 ORDER BY domain_count DESC, provider LIMIT 15"""
)
def spf_tool_distribution(spark, sf_dir):
    return state_reports.spf_tool_distribution(state(spark, sf_dir), spf_names(spark))


@query(f"WITH {STATE_CTE}{MX_ROWS} SELECT total FROM total")
def mx_domain_count(spark, sf_dir):
    return state_reports.mx_total(state(spark, sf_dir))


@query(f"WITH {STATE_CTE}{MX_ROWS} " + _ranked_sql("SELECT mx_server, count(*) AS domains FROM hosts GROUP BY 1", "mx_server", 1, 1000))
def top_mx_servers(spark, sf_dir):
    return state_reports.top_mx_servers(state(spark, sf_dir), least=1)


@query(f"WITH {STATE_CTE}{MX_ROWS} " + _ranked_sql("SELECT regexp_extract(mx_server, '([^.]+[.][^.]+)$') AS provider, count(DISTINCT domain) AS domains FROM hosts GROUP BY 1", "provider", 1, 1000))
def top_mx_providers(spark, sf_dir):
    return state_reports.top_mx_providers(state(spark, sf_dir), least=1)


@query(f"WITH {STATE_CTE}{SPF_ROWS} SELECT total FROM total")
def spf_domain_count(spark, sf_dir):
    return state_reports.spf_total(state(spark, sf_dir))


@query(f"WITH {STATE_CTE}{SPF_ROWS} SELECT mtype, count(DISTINCT domain) AS domains, round(count(DISTINCT domain) * 100.0::DOUBLE / any_value(total), 2) AS pct FROM tok JOIN total ON true GROUP BY 1")
def spf_mechanism_types(spark, sf_dir):
    return state_reports.mechanism_types(state(spark, sf_dir))


def _mechanism(mtype: str):
    sql = f"WITH {STATE_CTE}{SPF_ROWS} " + _ranked_sql(f"SELECT mvalue AS name, count(DISTINCT domain) AS domains FROM tok WHERE mtype = '{mtype}' AND mvalue <> '' GROUP BY 1", "name", 1, 1000)

    def run(spark, sf_dir):
        return state_reports.top_mechanism_values(state(spark, sf_dir), mtype, least=1)

    run.__name__ = f"spf_top_{mtype}"
    query(sql)(run)


for _m in ("include", "redirect", "ip4"):
    _mechanism(_m)


@query(
    f"WITH {STATE_CTE}{SPF_ROWS}, a AS (SELECT DISTINCT domain, token FROM tok WHERE mtype = 'all'), q AS (SELECT token AS qualifier, count(*) AS domains FROM a GROUP BY 1 "
    "UNION ALL SELECT '(no all)', count(DISTINCT domain) FROM tok WHERE domain NOT IN (SELECT domain FROM a)) SELECT qualifier, domains, round(domains * 100.0::DOUBLE / total, 2) AS pct FROM q JOIN total ON true"
)
def spf_all_qualifiers(spark, sf_dir):
    return state_reports.all_qualifiers(state(spark, sf_dir))


@query(f"WITH {STATE_CTE}{SPF_ROWS} " + _ranked_sql("SELECT entry AS spf_string, count(DISTINCT domain) AS domains FROM spf GROUP BY 1", "spf_string", 1, 50))
def spf_top_strings(spark, sf_dir):
    return state_reports.top_spf_strings(state(spark, sf_dir), least=1)


SAMPLED = ", st AS (SELECT DISTINCT lower(domain) AS domain, query_type, [val] AS value FROM raw WHERE day = DATE '2024-01-15')"


def _historical(spark, sf_dir):
    return state_reports.historical_state(raw_rows(spark, sf_dir), snapshots.month_series(spark, "2016-01-01", "2024-06-01", day=15))


@query(f"WITH {RAW}{SAMPLED}{MX_ROWS} " + _ranked_sql("SELECT mx_server, count(*) AS domains FROM hosts GROUP BY 1", "mx_server", 1, 1000))
def historical_mx(spark, sf_dir):
    return state_reports.top_mx_servers(_historical(spark, sf_dir), least=1)


@query(f"WITH {RAW}{SAMPLED}{SPF_ROWS} " + _ranked_sql("SELECT entry AS spf_string, count(DISTINCT domain) AS domains FROM spf GROUP BY 1", "spf_string", 1, 50))
def historical_spf(spark, sf_dir):
    return state_reports.top_spf_strings(_historical(spark, sf_dir), least=1)


# ---------------------------------------------------------------- adoption

@query(f"WITH {MONTHLY} SELECT s.month, s.n AS spf_domains, d.n AS total_domains, round(s.n * 100.0::DOUBLE / d.n, 4) AS pct FROM tot s JOIN dom d USING (month)")
def adoption_overall(spark, sf_dir):
    domains, totals, _ = stretched_counts(spark, sf_dir)
    return adoption.overall(domains, totals)


@query(f"WITH {CATS} SELECT *, round(domain_count * 100.0::DOUBLE / total_spf_domains, 4) AS pct FROM cat")
def adoption_categories(spark, sf_dir):
    _, totals, includes = stretched_counts(spark, sf_dir)
    return adoption.categories(includes, totals, spf_names(spark))


@query(f"WITH {INCS} SELECT * FROM rows_")
def adoption_includes(spark, sf_dir):
    _, totals, includes = stretched_counts(spark, sf_dir)
    return adoption.top_includes(includes, totals, spf_names(spark))


@query(
    f"WITH {MONTHLY} SELECT s.month, s.n AS spf_domains, d.n AS total_domains, round(round(s.n * 100.0::DOUBLE / d.n, 4), 2) AS pct, s.n - lag(s.n, 12) OVER (ORDER BY s.month) AS yoy_change FROM tot s JOIN dom d USING (month)"
)
def adoption_yoy(spark, sf_dir):
    domains, totals, _ = stretched_counts(spark, sf_dir)
    return adoption.yearly_change(domains, totals)


@query(
    f"""WITH {CATS}, c2 AS (SELECT *, round(domain_count * 100.0::DOUBLE / total_spf_domains, 2) AS p, row_number() OVER (PARTITION BY category ORDER BY domain_count DESC, month) AS r FROM cat),
l AS (SELECT category, domain_count, p FROM c2 WHERE month = (SELECT max(month) FROM tot))
SELECT c2.category, c2.month AS peak_month, c2.domain_count AS peak_domains, c2.p AS peak_pct, coalesce(l.domain_count, 0) AS latest_domains, coalesce(l.p, 0) AS latest_pct FROM c2 LEFT JOIN l USING (category) WHERE r = 1"""
)
def adoption_peaks(spark, sf_dir):
    _, totals, includes = stretched_counts(spark, sf_dir)
    return adoption.category_peaks(includes, totals, spf_names(spark))


@query(
    f"""WITH {INCS}, l AS (SELECT inc_domain, inc.n, round(inc.n * 100.0::DOUBLE / tot.n, 2) AS p FROM inc JOIN tot USING (month) WHERE month = (SELECT max(month) FROM tot))
SELECT row_number() OVER (ORDER BY total DESC, inc_domain) AS rank, inc_domain, coalesce(nullif(category, ''), 'unknown') AS category, total AS domain_months, coalesce(n, 0) AS latest_domains, coalesce(p, 0) AS latest_pct
FROM lead_ LEFT JOIN l USING (inc_domain) LEFT JOIN spd USING (inc_domain)"""
)
def adoption_top_includes(spark, sf_dir):
    _, totals, includes = stretched_counts(spark, sf_dir)
    return adoption.ranked_includes(includes, totals, spf_names(spark))


@query(f"WITH {INCS}, l AS (SELECT inc_domain FROM rows_ WHERE month = (SELECT max(month) FROM rows_) ORDER BY pct DESC, inc_domain LIMIT 20) SELECT * FROM rows_ WHERE inc_domain IN (SELECT inc_domain FROM l)")
def adoption_top20_latest(spark, sf_dir):
    _, totals, includes = stretched_counts(spark, sf_dir)
    return adoption.latest_leaders(adoption.top_includes(includes, totals, spf_names(spark)))


@query(f"WITH {CATS} SELECT category, max(round(domain_count * 100.0::DOUBLE / total_spf_domains, 4)) AS max_pct FROM cat GROUP BY 1")
def adoption_category_order(spark, sf_dir):
    _, totals, includes = stretched_counts(spark, sf_dir)
    return adoption.category_order(adoption.categories(includes, totals, spf_names(spark)))


# ---------------------------------------------------------------- providers and checks

@query(
    f"WITH {STATE_CTE}{MX_ROWS}, {MX_DIM}, c AS (SELECT regexp_extract(mx_server, '([^.]+[.][^.]+)$') AS reg_domain, count(DISTINCT domain) AS count FROM hosts GROUP BY 1) "
    "SELECT reg_domain, count, CASE reg_domain WHEN 'p1.net' THEN 'P-One' ELSE 'P2' END AS provider, CASE reg_domain WHEN 'p1.net' THEN 80 ELSE 45 END AS confidence FROM c WHERE reg_domain <> 'p0.net' AND count >= 5"
)
def provider_candidates(spark, sf_dir):
    """p0 is mapped already, p1 is known, p2 is guessed."""
    top = state_reports.top_mx_providers(state(spark, sf_dir), top=0, least=1).select(F.col("provider").alias("reg_domain"), F.col("domains").alias("count"))
    names = mx_names(spark)
    return providers.candidates(top, "reg_domain", names.where("reg_domain = 'p0.net'"), names.where("reg_domain = 'p1.net'"), least=5)


@query(f"WITH {RAW} SELECT 'pass' AS outcome, count(*) AS n FROM (SELECT DISTINCT day, domain, query_type, val FROM raw)")
def completeness_check(spark, sf_dir):
    """Every raw answer is in the value that holds on its day."""
    raw = snapshot(spark, sf_dir).select("day", "domain", "query_type", F.explode("value").alias("raw_value"))
    return validation.outcomes(validation.completeness(events(spark, sf_dir), raw))


@query(f"WITH {EV} SELECT 'pass' AS outcome, count(*) AS n FROM ev")
def correctness_check(spark, sf_dir):
    return validation.outcomes(validation.correctness(events(spark, sf_dir), snapshot(spark, sf_dir)))


@query(f"WITH {EV} SELECT domain, query_type, measurement_date, {LISTS} FROM ev WHERE domain = '{HOST}.'")
def store_point_lookup(spark, sf_dir):
    """Events written to a store by bucket and read back for one host, from one bucket's folder."""
    path = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    store.append_events(diff.with_keys(events(spark, sf_dir)), path)
    return _flat_events(store.of_domain(store.read_events(spark, path), HOST)).select("domain", "query_type", "measurement_date", "value", "prev_value")
