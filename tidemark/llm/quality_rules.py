"""Quality rules with verdicts by host.

Base rules look at a document alone. The method adds evidence of its host: the
rule failures of each host are counted, their rates are shrunk with a beta prior
that is fitted to all hosts by the method of moments, and a host whose shrunk rate
lies more than BAD_SIGMAS standard deviations of that prior above its mean gets a bad
verdict. Documents of a bad host must also pass the soft rules; a document that passes
every rule stays wherever it comes from. Where hosts do not differ beyond chance, the
prior is narrow, all rates are shrunk into it, and no host is bad.

A null text has no words and fails; a null host is a host of its own. Repeated
rows count each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import WORD, bounded_batches, packed, staged, table, unpacked

#: Characters that count as symbols, and the words of a window.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
WHITE_BYTES = b" \t\n\x0b\x0c\r"
MIN_WORDS = 20
#: Soft rules: symbols a word, repeated lines a line, and letters a word.
MAX_SYMBOLS, MAX_DUP_LINES, WORD_LENGTHS = 0.1, 0.3, (2.0, 12.0)
#: A host is bad when its shrunk failure rate is so many standard deviations of the prior above the prior's mean.
BAD_SIGMAS = 1.0
#: Of hosts that do not differ, the rates' variance has a relative standard error of sqrt(2 / (hosts - 1)); so many are left to chance.
CHANCE = 2.0

#: Of the polynomial hash of a window.
MULTIPLIER = 0xD6E8FEB86659FD93
#: Keys over which a host's rows are dealt.
SALTS = 16
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated_words(words: list[bytes]) -> int:
    """Words in WINDOW-word windows that the text has twice or more, the first included."""
    if len(words) <= WINDOW:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.uint64, count=len(words))
    if len(known) == len(words):
        return 0
    at = len(words) - WINDOW + 1
    mixed = ids * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    key = np.zeros(at, dtype=np.uint64)
    for j in range(WINDOW):
        key = key * np.uint64(MULTIPLIER) + mixed[j : j + at]
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if not len(same):
        return 0
    one, two = order[same], order[same + 1]
    if any((ids[one + j] != ids[two + j]).any() for j in range(WINDOW)):  # different words under one key
        windows = [tuple(ids[i : i + WINDOW]) for i in range(at)]
        often = Counter(windows)
        starts = np.array([i for i, w in enumerate(windows) if often[w] > 1], dtype=np.int64)
    else:
        starts = np.union1d(one, two)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def text_counts(text: bytes) -> tuple[int, ...]:
    """The COUNTS of a text in UTF-8."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words), len(text.translate(None, WHITE_BYTES).decode()), len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)), repeated_words(words), len(lines),
    )


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [text_counts(x or b"") for x in batch.column("_text").cast(pa.binary()).to_pylist()]
        found = list(zip(*rows, strict=True)) if rows else [()] * len(COUNTS)
        arrays = [batch.column("_row"), batch.column("_host"), *(pa.array(x, pa.int64()) for x in found)]
        yield pa.RecordBatch.from_arrays(arrays, names=["_row", "_host", *(f"_{c}" for c in COUNTS)])


def with_counts(docs: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None) -> DataFrame:
    """_row (the columns to keep), _host and the COUNTS of each whole text."""
    bounded_batches(docs.sparkSession)
    kept = docs.select(*[f"`{c}`" for c in docs.columns if keep is None or c in keep])
    rows = docs.select(packed(kept), F.col(f"`{host}`").alias("_host"), F.col(f"`{text}`").alias("_text"))
    added = [T.StructField(f"_{c}", T.LongType()) for c in COUNTS]
    return rows.mapInArrow(_count_batches, T.StructType([rows.schema["_row"], rows.schema["_host"], *added]))


def base_failed() -> Column:
    return (F.col("_n_words") < MIN_WORDS) | (100 * F.col("_n_repeat_words") > 30 * F.col("_n_words"))


def soft_failed() -> Column:
    return (
        (F.col("_n_symbols") > MAX_SYMBOLS * F.col("_n_words"))
        | (F.col("_n_dup_lines") > MAX_DUP_LINES * F.col("_n_lines"))
        | (F.col("_word_chars") < WORD_LENGTHS[0] * F.col("_n_words"))
        | (F.col("_word_chars") > WORD_LENGTHS[1] * F.col("_n_words"))
    )


def host_verdicts(counted: DataFrame) -> DataFrame:
    """_of_host, _host_rate (shrunk failure rate), _host_bad.

    The prior Beta(m*k, (1-m)*k) has the mean m of all documents, and k from the
    variance of the hosts' rates: k = m(1-m) / between - 1, where between is that
    variance without its binomial part and without what chance adds to that part, by
    CHANCE standard errors. Hosts that do not differ beyond chance get k = 1e6.
    """
    hosts = counted.groupBy("_host").agg(
        F.count(F.lit(1)).alias("_n"), F.sum((base_failed() | soft_failed()).cast("long")).alias("_bad")
    )
    total = hosts.agg(
        F.sum("_n").alias("_all"), (F.sum("_bad") / F.sum("_n")).alias("_m"), F.count(F.lit(1)).alias("_hosts"),
        F.sum(F.col("_bad") * F.col("_bad") / F.col("_n")).alias("_square"),
    )
    spread = F.col("_square") / F.col("_all") - F.col("_m") * F.col("_m")
    noise = F.col("_m") * (1 - F.col("_m")) * F.col("_hosts") / F.col("_all") * (1 + CHANCE * F.sqrt(2.0 / F.greatest(F.col("_hosts") - 1, F.lit(1))))
    between = F.greatest(spread - noise, F.lit(0.0))
    k = F.when(between > 0, F.greatest(F.col("_m") * (1 - F.col("_m")) / F.nullif(between, F.lit(0.0)) - 1, F.lit(1.0))).otherwise(1e6)
    prior = total.select("_m", F.least(k, F.lit(1e6)).alias("_k"))
    rate = (F.col("_bad") + F.col("_m") * F.col("_k")) / (F.col("_n") + F.col("_k"))
    limit = F.col("_m") + BAD_SIGMAS * F.sqrt(F.col("_m") * (1 - F.col("_m")) / (F.col("_k") + 1))
    # prior is one row, the result of a global aggregate
    return hosts.join(F.broadcast(prior)).select(F.col("_host").alias("_of_host"), rate.alias("_host_rate"), (rate > limit).alias("_host_bad"))


def judged(docs: DataFrame, host: str = "source", keep: list[str] | None = None) -> DataFrame:
    """_row (the columns to keep) with the COUNTS, _base_failed, _host_rate and _kept.

    Texts are counted once, and what is kept of the rows is written with the counts. The
    table of hosts is written, too; the join is broadcast only if its files are below
    Spark's own limit, and shuffled else with a host's rows dealt over SALTS keys.
    """
    counted = staged(with_counts(docs, host=host, keep=keep), "counted")
    verdicts = staged(host_verdicts(counted).withColumn("_salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "hosts")
    dealt = counted.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return (
        dealt.join(verdicts, F.col("_host").eqNullSafe(F.col("_of_host")) & (F.col("_salt") == F.col("_salt_of")), "left")
        .withColumn("_base_failed", base_failed())
        .withColumn("_kept", ~F.col("_base_failed") & ~(F.coalesce("_host_bad", F.lit(False)) & soft_failed()))
    )


def drop_low_quality(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of docs that the rules keep, all columns as they were."""
    return unpacked(judged(docs, host).where("_kept"))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(
        "_row.doc_id", *(F.col(f"_{c}").alias(c) for c in COUNTS[:5]), F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept")
    )


def host_rules_sections(spark, sf_dir: str) -> DataFrame:
    """The same rules where hosts differ: each source's texts with three symbols in a row as a section of their own, which gets a bad verdict."""
    docs = table(spark, sf_dir, "documents")
    section = F.concat(F.col("source"), F.when(F.col("text").rlike("[#*$%&]{3}"), "/marked").otherwise("/plain"))
    found = judged(docs.select("doc_id", "text", section.alias("section")), host="section", keep=["doc_id", "section"])
    return found.select(
        "_row.doc_id", F.col("_row.section").alias("section"), *(F.col(f"_{c}").alias(c) for c in COUNTS[:5]), F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept")
    )


def _sql(rows: str) -> str:
    """The rules over rows (doc_id, source, t)."""
    return f"""
WITH d AS ({rows}),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '{WORD}') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(ws, i, i + {WINDOW - 1})) AS c
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) > {WINDOW})),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win, range(0, {WINDOW}) r(k) WHERE c > 1 GROUP BY doc_id),
c AS (SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines
      FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             n_symbols > {MAX_SYMBOLS} * n_words OR n_dup_lines > {MAX_DUP_LINES} * n_lines
             OR word_chars < {WORD_LENGTHS[0]} * n_words OR word_chars > {WORD_LENGTHS[1]} * n_words AS soft FROM c),
h AS (SELECT source, count(*)::DOUBLE AS n, sum((base_failed OR soft)::INT)::DOUBLE AS bad FROM f GROUP BY source),
g AS (SELECT sum(n) AS total, sum(bad) / sum(n) AS m, count(*) AS hosts, sum(bad * bad / n) AS square FROM h),
b AS (SELECT m, greatest(square / total - m * m - m * (1 - m) * hosts / total * (1 + {CHANCE} * sqrt(2.0::DOUBLE / greatest(hosts - 1, 1))), 0) AS between_ FROM g),
k AS (SELECT m, least(CASE WHEN between_ > 0 THEN greatest(m * (1 - m) / between_ - 1, 1) ELSE 1e6 END, 1e6) AS k FROM b),
v AS (SELECT source, (bad + m * k) / (n + k) > m + {BAD_SIGMAS} * sqrt(m * (1 - m) / (k + 1)) AS host_bad FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (host_bad AND soft) AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""


OP4_SQL = _sql("SELECT doc_id, source, coalesce(text, '') AS t FROM documents")
SECTIONS_SQL = _sql(
    "SELECT doc_id, source || CASE WHEN regexp_matches(coalesce(text, ''), '[#*$%&]{3}') THEN '/marked' ELSE '/plain' END AS source, coalesce(text, '') AS t FROM documents"
).replace("SELECT doc_id, n_words, word_chars", "SELECT doc_id, f.source AS section, n_words, word_chars")
