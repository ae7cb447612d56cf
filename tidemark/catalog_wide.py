"""More queries with SQL: the reports over `orders`, and what only files can show.

`orders` gives histories of six years with every SPF mechanism, hosts that serve
themselves and long tails (see sources.sample_tables). Queries over sinks and sources
write below the shared folder, read back and give what they read.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.catalog import CATS_TAIL, EV, INCS_TAIL, LISTS, MX_DIM, MX_ROWS, RAW, RUNS, SNAP, SPF_ROWS, STATE_CTE, _diff_sql, _flat, _flat_events, _monthly_sql, _ranked_sql, query
from tidemark.functions.names import registrable_domain
from tidemark.operators import diff, history, store
from tidemark.plans import adoption, providers, state_reports, text_reports, validation
from tidemark.session import shared_dir
from tidemark.sources import snapshots
from tidemark.sources.sample_tables import order_events, order_rows, raw_rows
from tidemark.streaming import ingest

SPAN = ("1995-01-01", "2001-08-01")
CUTOFF = datetime.date(2001, 9, 1)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def order_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.state_from_events(order_events(spark, sf_dir))


# ---------------------------------------------------------------- SQL over orders

ZONE = "'g' || c % 50 || '.' || ['com', 'nl', 'co.uk'][c % 3 + 1] || '.'"
_TEXTS = "['include:_spf' || k % 97 || '.net', 'redirect=_r' || k % 30 || '.org', 'ip4:192.0.2.' || k % 200, 'ip6:2001:db8::' || k % 50, 'a', 'a:h' || k % 9 || '.net', 'mx', 'mx:m' || k % 9 || '.net', 'exists:x' || k % 5 || '.net', 'ptr', 'ptr:p' || k % 3 || '.net', '+include:_q' || k % 7 || '.net', '?mx', '-ptr']"
_ENDS = "['-all', '~all', '?all', '+all', 'all', '']"
ORDERED = f"""o AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS day FROM orders),
raw AS (SELECT day, 'c' || c || '.' || {ZONE} AS domain, CASE WHEN (k // 4) % 2 = 0 THEN 'TXT' ELSE 'MX' END AS query_type, c % 2 = 0 AS listed,
  CASE WHEN k % 13 = 0 THEN NULL WHEN (k // 4) % 2 = 0 THEN '"' || rtrim('v=spf1 ' || {_TEXTS}[k % 14 + 1] || ' include:_spf' || k % 89 || '.net ' || {_ENDS}[k % 6 + 1]) || '"'
       WHEN k % 5 = 4 THEN '10 mail.' || {ZONE} ELSE '20 mx.p' || k % 23 || '.net.' END AS val FROM o)"""
ORDER_EV = ORDERED + """, sight AS (SELECT domain, query_type, day AS measurement_date, list_sort(list(DISTINCT val) FILTER (val IS NOT NULL)) AS value FROM raw GROUP BY ALL),
steps AS (SELECT *, lag(value) OVER (PARTITION BY domain, query_type ORDER BY measurement_date) AS prev_value FROM sight),
ev AS (SELECT * FROM steps WHERE value IS DISTINCT FROM prev_value)"""
ORDER_STATE = ORDER_EV + STATE_CTE[len(EV):]
ORDER_MONTHS = _monthly_sql(ORDER_EV, SPAN)
ORDER_SAMPLE = ORDERED + ", st AS (SELECT DISTINCT domain, query_type, [val] AS value FROM raw WHERE val IS NOT NULL AND day(day) = 15)"
REGISTRABLE = "regexp_extract({}, '([^.]+[.](?:co[.]uk|[a-z]+))$', 1)"


def _rank(counts: str, name: str, limit: int = 1000) -> str:
    return _ranked_sql(counts, name, 1, limit)


TYPES_SQL = " SELECT mtype, count(DISTINCT domain) AS domains, round(count(DISTINCT domain) * 100.0::DOUBLE / any_value(total), 2) AS pct FROM tok JOIN total ON true GROUP BY 1"
QUALIFIERS_SQL = """, a AS (SELECT DISTINCT domain, token FROM tok WHERE mtype = 'all'), q AS (SELECT token AS qualifier, count(*) AS domains FROM a GROUP BY 1
UNION ALL SELECT '(no all)', count(DISTINCT domain) FROM tok WHERE domain NOT IN (SELECT domain FROM a)) SELECT qualifier, domains, round(domains * 100.0::DOUBLE / total, 2) AS pct FROM q JOIN total ON true"""
PROVIDERS_SQL = _rank(f"SELECT {REGISTRABLE.format('mx_server')} AS provider, count(DISTINCT domain) AS domains FROM hosts GROUP BY 1", "provider")


def _values_sql(mtype: str) -> str:
    return " " + _rank(f"SELECT mvalue AS name, count(DISTINCT domain) AS domains FROM tok WHERE mtype = '{mtype}' AND mvalue <> '' GROUP BY 1", "name")


def order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_reports.historical_state(order_rows(spark, sf_dir), snapshots.month_series(spark, *SPAN, day=15))


def _sections(prefix: str, sql: str, state) -> None:
    """The sections of the state reports over a state, each as a query."""
    parts = {
        "mx_servers": (sql + MX_ROWS + " " + _rank("SELECT mx_server, count(*) AS domains FROM hosts GROUP BY 1", "mx_server"), lambda s: state_reports.top_mx_servers(s, least=1)),
        "mx_providers": (sql + MX_ROWS + " " + PROVIDERS_SQL, lambda s: state_reports.top_mx_providers(s, least=1)),
        "spf_types": (sql + SPF_ROWS + TYPES_SQL, state_reports.mechanism_types),
        "spf_qualifiers": (sql + SPF_ROWS + QUALIFIERS_SQL, state_reports.all_qualifiers),
        "spf_strings": (sql + SPF_ROWS + " " + _rank("SELECT entry AS spf_string, count(DISTINCT domain) AS domains FROM spf GROUP BY 1", "spf_string", 50), lambda s: state_reports.top_spf_strings(s, least=1)),
    }
    for mtype in ("include", "redirect", "ip4"):
        parts[f"spf_{mtype}"] = (sql + SPF_ROWS + _values_sql(mtype), lambda s, m=mtype: state_reports.top_mechanism_values(s, m, least=1))
    for name, (text, report) in parts.items():

        def run(spark, sf_dir, report=report):
            return report(state(spark, sf_dir))

        run.__name__ = f"{prefix}_{name}"
        query("WITH " + text)(run)


_sections("orders", ORDER_STATE, order_state)
_sections("orders_historical", ORDER_SAMPLE, order_history)


@query(f"WITH {ORDER_EV} SELECT domain, query_type, measurement_date, {LISTS} FROM ev")
def orders_events(spark, sf_dir):
    return _flat_events(order_events(spark, sf_dir))


ORDER_RUNS = ORDER_EV + ", rw AS (SELECT *, value AS held FROM ev WHERE query_type = 'MX')" + RUNS.format(rows="rw").replace("2024-02-01", str(CUTOFF))


@query(
    f"""WITH {ORDER_RUNS}, p AS (SELECT domain, start, "end", held, list_transform(coalesce(held, []), lambda h: rtrim(h, '.')) AS hosts FROM sg)
SELECT domain, start, "end", held IS NULL AS absent, array_to_string(hosts, '|') AS mx_records,
array_to_string(list_transform(hosts, lambda h: CASE WHEN h LIKE '%mx.p0.net' THEN 'P-Zero' WHEN h LIKE '%mx.p1.net' THEN 'P-One' ELSE {REGISTRABLE.format("h")} END), ' / ') AS provider,
len(list_filter(hosts, lambda h: {REGISTRABLE.format("h")} = {REGISTRABLE.format("rtrim(domain, '.')")})) > 0 AS self_hosted FROM p"""
)
def orders_mx_segments(spark, sf_dir):
    """Hosts that serve their own mail are among them."""
    found = _flat(history.mx_segments(order_events(spark, sf_dir), catalog.mx_names(spark), CUTOFF), "mx_records")
    return found.withColumn("provider", F.coalesce("provider", F.lit("")))


ORDER_INCS = ORDER_MONTHS + INCS_TAIL


@query(f"WITH {ORDER_MONTHS} SELECT s.month, s.n AS spf_domains, d.n AS total_domains, round(s.n * 100.0::DOUBLE / d.n, 4) AS pct FROM tot s JOIN dom d USING (month)")
def orders_adoption_overall(spark, sf_dir):
    domains, totals, _ = adoption.monthly_counts(order_events(spark, sf_dir), *SPAN)
    return adoption.overall(domains, totals)


@query(f"WITH {ORDER_MONTHS}{CATS_TAIL} SELECT *, round(domain_count * 100.0::DOUBLE / total_spf_domains, 4) AS pct FROM cat")
def orders_adoption_categories(spark, sf_dir):
    _, totals, includes = adoption.monthly_counts(order_events(spark, sf_dir), *SPAN)
    return adoption.categories(includes, totals, catalog.spf_names(spark))


@query(f"WITH {ORDER_INCS} SELECT * FROM rows_")
def orders_adoption_includes(spark, sf_dir):
    """The limit of includes cuts here."""
    _, totals, includes = adoption.monthly_counts(order_events(spark, sf_dir), *SPAN)
    return adoption.top_includes(includes, totals, catalog.spf_names(spark))


@query(f"WITH {ORDER_INCS}, l AS (SELECT inc_domain FROM rows_ WHERE month = (SELECT max(month) FROM rows_) ORDER BY pct DESC, inc_domain LIMIT 20) SELECT * FROM rows_ WHERE inc_domain IN (SELECT inc_domain FROM l)")
def orders_adoption_top20(spark, sf_dir):
    """More includes are alive in the last month than are wanted."""
    _, totals, includes = adoption.monthly_counts(order_events(spark, sf_dir), *SPAN)
    return adoption.latest_leaders(adoption.top_includes(includes, totals, catalog.spf_names(spark)))


@query(f"WITH {ORDER_MONTHS} SELECT s.month, s.n AS spf_domains, d.n AS total_domains, round(round(s.n * 100.0::DOUBLE / d.n, 4), 2) AS pct, s.n - lag(s.n, 12) OVER (ORDER BY s.month) AS yoy_change FROM tot s JOIN dom d USING (month)")
def orders_adoption_yoy(spark, sf_dir):
    domains, totals, _ = adoption.monthly_counts(order_events(spark, sf_dir), *SPAN)
    return adoption.yearly_change(domains, totals)


@query(
    f"""WITH {ORDER_STATE}{SPF_ROWS}, c AS (SELECT mvalue AS inc_domain, count(DISTINCT domain) AS count FROM tok WHERE mtype = 'include' GROUP BY 1)
SELECT inc_domain, count, CASE inc_domain WHEN '_spf1.net' THEN 'P-One' WHEN '_spf2.net' THEN 'Net' ELSE 'Spf' || regexp_extract(inc_domain, '_spf([0-9]+)', 1) END AS provider,
CASE inc_domain WHEN '_spf1.net' THEN 'email_provider' ELSE 'hosting' END AS type, CASE inc_domain WHEN '_spf1.net' THEN 80 ELSE 45 END AS confidence FROM c WHERE inc_domain <> '_spf0.net' AND count >= 2"""
)
def spf_provider_candidates(spark, sf_dir):
    """_spf0 is mapped already, _spf1 is known, all others are guessed and count as hosting; `spf2.` is one of the beginnings that names lose."""
    top = state_reports.top_mechanism_values(order_state(spark, sf_dir), "include", top=0, least=1).select(F.col("name").alias("inc_domain"), F.col("domains").alias("count"))
    known = {"_spf0.net": {"provider": "P-Zero", "type": "hosting", "confidence": 90}, "_spf1.net": {"provider": "P-One", "type": "email_provider", "confidence": 80}}
    names = snapshots.mapping(spark, known, spf=True)
    return providers.candidates(top, "inc_domain", names.where("inc_domain = '_spf0.net'"), names.where("inc_domain = '_spf1.net'"), spf=True, least=2)


# ---------------------------------------------------------------- look-ups

@query(f"WITH {EV} SELECT rtrim(domain, '.') AS domain, count(*) AS n_events FROM ev WHERE domain LIKE '%.nl.' GROUP BY 1 ORDER BY n_events DESC, domain LIMIT 300")
def suffix_of_public_suffix(spark, sf_dir):
    """Names below a public suffix lie in all buckets of the store."""
    path = fresh_path(spark, "events")
    store.append_events(diff.with_keys(catalog.events(spark, sf_dir)), path)
    return history.suffix_domains(store.of_suffix(store.read_events(spark, path), "nl"), "nl")


@query(
    f"WITH {ORDER_EV}, f AS (SELECT rtrim(domain, '.') AS domain, count(*) AS n_events FROM ev WHERE domain LIKE '%.g1.nl.' GROUP BY 1 ORDER BY n_events DESC, domain LIMIT 300) SELECT * FROM f WHERE domain LIKE '%c1%'"
)
def suffix_domains_containing(spark, sf_dir):
    named = diff.with_keys(order_events(spark, sf_dir))
    return history.containing(history.suffix_domains(named, "g1.nl"), "C1")


@query(f"WITH {ORDERED}, d AS (SELECT DISTINCT domain FROM raw) SELECT domain, {REGISTRABLE.format(chr(39).join(['rtrim(domain, ', '.', ')']))} AS registrable FROM d")
def state_keys(spark, sf_dir):
    """Any one of the equal registrable names that a host's rows have."""
    rows = order_rows(spark, sf_dir).select(F.col("query_name").alias("domain")).withColumn("r", registrable_domain(F.col("domain")))
    return rows.groupBy("domain").agg(F.any_value("r").alias("registrable"))


@query("SELECT 1::BIGINT AS n_rows, true AS is_of_the_table")
def arbitrary_answer(spark, sf_dir):
    raw = snapshots.answers(raw_rows(spark, sf_dir))
    one = snapshots.arbitrary_row(raw)
    return one.join(raw.distinct(), one.columns, "left_semi").agg(F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) == 1).alias("is_of_the_table"))


# ---------------------------------------------------------------- sources

SCANNED = (datetime.date(2024, 1, 14), datetime.date(2024, 1, 15), datetime.date(2024, 1, 16))
PLACES = {"toplists": ("toplist", "tranco"), "zonefiles": ("zonefile", "se")}


def raw_layout(spark: SparkSession, sf_dir: str, days=SCANNED) -> str:
    """The raw rows of some days as files in the sources' layout."""
    root = fresh_path(spark, "raw")
    rows = raw_rows(spark, sf_dir)
    for day in days:
        for name, (basis, source) in PLACES.items():
            one = rows.where((F.col("day") == F.lit(day)) & (F.col("source") == name))
            one.select("query_name", "query_type", "mx_address", "txt_text").write.parquet(snapshots.snapshot_path(root, basis, source, day))
    return root


_DAYS = "day BETWEEN DATE '2024-01-14' AND DATE '2024-01-16'"
_KIND = "CASE WHEN CAST(regexp_extract(domain, '^m([0-9]+)', 1) AS BIGINT) % 2 = 0 THEN 'tranco' ELSE 'se' END"


@query(f"WITH {RAW} SELECT day, {_KIND} AS source, domain, query_type, array_to_string(list_sort(list(DISTINCT val)), '|') AS value FROM raw WHERE {_DAYS} GROUP BY ALL")
def raw_snapshot_scan(spark, sf_dir):
    """Days of several sources by their paths, one plan a day; a source without the day is left out."""
    root, out = raw_layout(spark, sf_dir), None
    for day in SCANNED:
        found = snapshots.read_day(spark, root, [*PLACES.values(), ("toplist", "radar")], day).withColumn("day", F.lit(day))
        out = found if out is None else out.unionByName(found)
    return _flat(snapshots.daily_values(out, "day", "source"), "value")


@query(f"""WITH {RAW} SELECT query_name, query_type, count(*) AS n FROM (SELECT day, domain AS query_name, query_type FROM raw) WHERE day BETWEEN DATE '2024-01-15' AND DATE '2024-01-16'
AND CAST(regexp_extract(query_name, '^m([0-9]+)', 1) AS BIGINT) % 2 = 0 AND query_name LIKE '%.d2.com.' GROUP BY ALL""")
def raw_history_scan(spark, sf_dir):
    """One source from a day on by the partition column, for a suffix."""
    rows = snapshots.history_rows(spark, f"{raw_layout(spark, sf_dir)}/source=tranco", "toplist", SCANNED[1], suffix=".d2.com.")
    return rows.where(F.col("query_type").isin("MX", "TXT")).groupBy("query_name", "query_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n_rows FROM events")
def raw_full_scan(spark, sf_dir):
    """An unfiltered scan, brought to the driver partition by partition."""
    return spark.createDataFrame([(validation.streamed_rows(raw_rows(spark, sf_dir)),)], "n_rows long")


@query(
    """WITH s(basis, source, first, last) AS (VALUES ('toplist', 'alexa', DATE '2016-01-22', DATE '2023-05-15'), ('toplist', 'umbrella', DATE '2019-01-14', NULL), ('toplist', 'tranco', DATE '2022-08-11', NULL),
('toplist', 'radar', DATE '2022-10-04', NULL), ('toplist', 'majestic', DATE '2025-03-17', NULL), ('zonefile', 'gov', DATE '2017-05-01', NULL), ('zonefile', 'ee', DATE '2019-07-29', NULL), ('zonefile', 'li', DATE '2020-05-19', NULL),
('zonefile', 'nu', DATE '2016-06-07', NULL), ('zonefile', 'se', DATE '2016-06-07', NULL), ('zonefile', 'sk', DATE '2022-05-11', NULL), ('zonefile', 'fr', DATE '2022-08-10', NULL)),
d AS (SELECT CAST(m AS DATE) + 14 AS day FROM generate_series(DATE '2016-01-01', DATE '2025-12-01', INTERVAL '1 month') t(m))
SELECT CASE basis WHEN 'toplist' THEN 'r/source=' || source || '/date=' || day ELSE 'r/basis=zonefile/source=' || source || strftime(day, '/year=%Y/month=%m/day=%d') END AS path
FROM s JOIN d ON day >= first AND day <= coalesce(last, day)"""
)
def snapshot_paths(spark, sf_dir):
    """Where the sampled days of all active sources are."""
    days = [r[0] for r in snapshots.month_series(spark, "2016-01-01", "2025-12-01", day=15).collect()]
    return spark.createDataFrame([(snapshots.snapshot_path("r", *p, d),) for d in days for p in snapshots.active_sources(snapshots.source_pairs(), d)], "path string")


@query("SELECT * FROM (VALUES ('lists', 3), ('zones', 3)) t(name, n_columns)")
def dataset_discovery(spark, sf_dir):
    """Folders with events are datasets, the mappings are none."""
    root = fresh_path(spark, "data")
    for name in ("lists/events", "zones/events", "mappings/events", "other/state"):
        spark.range(2).selectExpr("id", "id AS a", "id AS b").write.parquet(f"{root}/{name}")
    found = snapshots.discover_datasets(spark, root)
    return spark.createDataFrame([(n, len(spark.read.parquet(p).columns)) for n, p in found.items()], "name string, n_columns int")


# ---------------------------------------------------------------- sinks

@query(f"WITH {STATE_CTE} SELECT domain, query_type, array_to_string(value, '|') AS value FROM st")
def state_replaced(spark, sf_dir):
    """A state that took the place of another one."""
    path = fresh_path(spark, "state")
    state = catalog.state(spark, sf_dir).select("domain", "query_type", "value", "missing_since")
    for rows in (state.limit(3), state):
        store.replace_table(rows, path)
    return _flat(spark.read.schema(ingest.STATE).parquet(path).drop("missing_since"), "value")


@query(f"WITH {EV} SELECT domain, query_type, measurement_date, {LISTS} FROM ev")
def store_compacted(spark, sf_dir):
    """Deltas that were written twice, after compaction read without any removal of repeats."""
    path = fresh_path(spark, "events")
    events = diff.with_keys(catalog.events(spark, sf_dir))
    for _ in range(2):
        store.append_events(events, path)
    store.compact_over(spark, path, force=True)
    rows = spark.read.parquet(path)
    return _flat_events(rows.select("domain", "query_type", "measurement_date", "value", "prev_value"))


@query("SELECT 0::BIGINT AS over_most, true AS all_over_least, true AS largest_first")
def compaction_choice(spark, sf_dir):
    """Which buckets' deltas pass a threshold, largest first."""
    path = fresh_path(spark, "events")
    store.append_events(diff.with_keys(catalog.events(spark, sf_dir)), path)
    sizes = store.delta_bytes(spark, path)
    chosen = store.buckets_over(sizes, 1)
    order = [sizes[b] for b in chosen]
    row = (len(store.buckets_over(sizes, 1 << 50)), set(chosen) == {b for b, s in sizes.items() if s}, order == sorted(order, reverse=True))
    return spark.createDataFrame([row], "over_most long, all_over_least boolean, largest_first boolean")


@query(f"WITH {SNAP} SELECT max(day) AS last_date FROM snap")
def ingest_log(spark, sf_dir):
    """The log's day, written twice and read."""
    path = f"{fresh_path(spark, 'log')}.json"
    for day in (datetime.date(2024, 1, 2), catalog.snapshot(spark, sf_dir).agg(F.max("day")).first()[0]):
        store.write_log(spark, path, day)
    return spark.createDataFrame([(snapshots.last_date(spark, path),)], "last_date date")


@query(f"WITH {ORDER_INCS} SELECT * FROM rows_")
def adoption_tables(spark, sf_dir):
    """The includes table of the adoption report as its file has it."""
    path = fresh_path(spark, "adoption")
    adoption.write_tables(path, *adoption.monthly_counts(order_events(spark, sf_dir), *SPAN), catalog.spf_names(spark))
    return spark.read.parquet(f"{path}/includes")


@query(f"WITH {ORDER_STATE}{MX_ROWS} SELECT {REGISTRABLE.format('mx_server')} AS name, count(DISTINCT domain) AS domains FROM hosts GROUP BY 1")
def text_report_counts(spark, sf_dir):
    """All providers from the text of a report that has them all."""
    text = text_reports.text_report({"top mx providers": state_reports.top_mx_providers(order_state(spark, sf_dir), top=0, least=1)})
    return spark.createDataFrame(list(snapshots.report_counts(text, "TOP MX PROVIDERS").items()), "name string, domains long")


@query(f"""WITH {ORDER_STATE}{MX_ROWS}, {MX_DIM}, c AS (SELECT {REGISTRABLE.format('mx_server')} AS reg_domain FROM hosts GROUP BY 1 HAVING count(DISTINCT domain) >= 2)
SELECT reg_domain, provider, confidence FROM mxd UNION ALL
SELECT reg_domain, upper(reg_domain[1]) || regexp_extract(reg_domain, '^.([^.]*)', 1) || CASE WHEN reg_domain LIKE '%.co.uk' THEN ' Co Uk' ELSE '' END, 45 FROM c WHERE reg_domain NOT IN (SELECT reg_domain FROM mxd)""")
def mapping_file(spark, sf_dir):
    """A mapping with its candidates, written as JSON and read again; rows that were there stay as they were."""
    path = fresh_path(spark, "mapping")
    names = catalog.mx_names(spark)
    top = state_reports.top_mx_providers(order_state(spark, sf_dir), top=0, least=1).select(F.col("provider").alias("reg_domain"), F.col("domains").alias("count"))
    added = providers.candidates(top, "reg_domain", names, names.limit(0), least=2)
    text = providers.mapping_json(providers.merged(names, added, "reg_domain"), "reg_domain")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return snapshots.read_mapping(spark, path)


# ---------------------------------------------------------------- streaming

def _streamed(spark: SparkSession, sf_dir: str, grace: int) -> DataFrame:
    """Events of a stream of five files, one after another, whose borders cut days in two."""
    root = fresh_path(spark, "stream")
    rows = raw_rows(spark, sf_dir).select("day", "query_name", "query_type", "mx_address", "txt_text")
    half = F.datediff("day", F.lit("2024-01-01").cast("date")) * 2 + F.pmod(F.hash("query_name"), F.lit(2))
    for i in range(5):
        rows.where(F.floor(half / 13) == i).coalesce(1).write.mode("append").parquet(f"{root}/in")
    raw = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    ingest.ingest_stream(raw, f"{root}/out", f"{root}/check", grace)
    return store.read_events(spark, f"{root}/out/events")


@query(f"WITH {SNAP}{_diff_sql(7)} SELECT domain, query_type, measurement_date, {LISTS} FROM ev")
def diff_incremental_g7(spark, sf_dir):
    """All days one by one with a carried state and a grace, from a stream: what the closed form has."""
    return _flat_events(_streamed(spark, sf_dir, 7).select("domain", "query_type", "measurement_date", "value", "prev_value"))


# ---------------------------------------------------------------- checks

NAMES = ["m1.d1.nl", "d1.nl"]


@query(
    f"""WITH {EV}, n(name) AS (VALUES ('m1.d1.nl'), ('d1.nl')),
f AS (SELECT name, 'store' AS place, domain = name || '.' AS same, domain = name || '.' OR domain LIKE '%.' || name || '.' AS below FROM n, ev
      UNION ALL SELECT name, 'raw', domain = name || '.', domain = name || '.' OR domain LIKE '%.' || name || '.' FROM n, raw)
SELECT name, place || ' exact' AS look_up, count(*) FILTER (same) AS n_rows FROM f GROUP BY name, place UNION ALL SELECT name, place || ' suffix', count(*) FILTER (below) FROM f GROUP BY name, place"""
)
def look_up_counts(spark, sf_dir):
    """What the look-ups of the performance comparison find: store against raw rows, host against suffix."""
    path = fresh_path(spark, "events")
    store.append_events(diff.with_keys(catalog.events(spark, sf_dir)), path)
    return validation.look_up_counts(store.read_events(spark, path), raw_rows(spark, sf_dir), NAMES)


FAULTY = ", bad AS (SELECT *, CASE WHEN hosted % 3 = 0 AND value IS NOT NULL THEN list_append(value, 'zz') ELSE value END AS said FROM (SELECT *, CAST(regexp_extract(domain, '^m([0-9]+)', 1) AS BIGINT) AS hosted FROM ev))"


def faulty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a value too many for every third host."""
    third = (F.regexp_extract("domain", "^m([0-9]+)", 1).cast("long") % 3 == 0) & F.col("value").isNotNull()
    return catalog.events(spark, sf_dir).withColumn("value", F.when(third, F.array_append("value", F.lit("zz"))).otherwise(F.col("value")))


@query(f"WITH {EV}{FAULTY} SELECT CASE WHEN said IS NULL THEN 'pass' WHEN said = value THEN 'pass' ELSE 'fail' END AS outcome, count(*) AS n FROM bad GROUP BY 1")
def correctness_check_faulty(spark, sf_dir):
    return validation.outcomes(validation.correctness(faulty_events(spark, sf_dir), catalog.snapshot(spark, sf_dir)))


@query(
    f"""WITH {EV}, a AS (SELECT DISTINCT domain, query_type, day, val || CASE WHEN day > DATE '2024-01-20' THEN '?' ELSE '' END AS raw_value, day > DATE '2024-01-20' AS wrong FROM raw
WHERE CAST(regexp_extract(domain, '^m([0-9]+)', 1) AS BIGINT) % 2 = 0)
SELECT CASE WHEN wrong THEN 'fail' ELSE 'pass' END AS outcome, count(*) AS n FROM a GROUP BY 1
UNION ALL SELECT 'skip', count(*) FROM ev WHERE value IS NULL AND measurement_date = DATE '2024-01-10' HAVING count(*) > 0"""
)
def completeness_check_faulty(spark, sf_dir):
    """Answers with a wrong value fail, answers of keys that are gone that day are skipped."""
    events = catalog.events(spark, sf_dir)
    late, even = F.col("day") > F.lit("2024-01-20").cast("date"), F.regexp_extract("domain", "^m([0-9]+)", 1).cast("long") % 2 == 0
    shown = catalog.snapshot(spark, sf_dir).where(even).select("domain", "query_type", "day", F.explode("value").alias("v"))
    wrong = shown.select("domain", "query_type", "day", F.concat("v", F.when(late, "?").otherwise("")).alias("raw_value"))
    gone = events.where("value IS NULL AND measurement_date = DATE '2024-01-10'").select("domain", "query_type", F.col("measurement_date").alias("day"), F.lit("any").alias("raw_value"))
    return validation.outcomes(validation.completeness(events, wrong.unionByName(gone)))


@query(f"WITH {STATE_CTE}{MX_ROWS} " + _ranked_sql("SELECT mx_server, count(*) AS domains FROM hosts GROUP BY 1", "mx_server", 1, 2))
def top_two_servers(spark, sf_dir):
    """A limit that cuts."""
    return state_reports.top_mx_servers(catalog.state(spark, sf_dir), top=2, least=1)
