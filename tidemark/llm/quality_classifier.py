"""A quality classifier with hierarchical empirical Bayes.

A logistic regression over counts of the text gives each document's own evidence.
Its probabilities are summed by host and by path within the host; labelled documents
of the learning folds count with their label instead. Rates of hosts are shrunk
toward the global rate, rates of paths toward their host's, with beta priors whose
strength is fitted to all hosts and paths by the method of moments, so sites with few
documents stay near what is known of the level above. A document's own
part is taken out of its site before that is combined with its own evidence:
logit(score) = logit(own) + logit(path without own) - logit(global).

The regression is fitted to at most ``max_labelled`` labelled rows of the folds that are
not held out; rows of one doc_id that differ in label count as good. A null or empty text is scored
like any other, from counts of 0; a null host or path is one of its own. Without
labels of both kinds the global rate stands for the regression. Repeated rows are
scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, fold, staged, table
from tidemark.llm.quality_rules import SALTS, text_counts

#: Bound of the rows that the regression is fitted to.
MAX_LABELLED = 20_000
#: Groups of ASCII characters whose shares are features.
GROUPS = (b"#*$%&|<>", b"!?", b".,;:", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"{}[]()=_\\/")
RIDGE, STEPS = 1.0, 25
#: Probabilities are kept this far from 0 and 1, and strengths of priors in this range.
EDGE, STRENGTHS = 1e-4, (1.0, 1e6)


def features(text: bytes) -> list[float]:
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat, n_lines = text_counts(text)
    words, chars = max(n_words, 1), max(word_chars, 1)
    shares = [math.sqrt((len(text) - len(text.translate(None, g))) / chars) for g in GROUPS]
    # of the vocabulary, a measure that hardly depends on length
    distinct = math.log1p(len(set(text.split()))) / math.log1p(words)
    return [
        1.0, math.log1p(n_words), min(word_chars / words, 40.0) / 10, min(n_symbols / words, 4.0), n_dup_lines / max(n_lines, 1), n_repeat / words,
        math.log1p(n_lines), distinct, *shares,
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights, by Newton steps with a ridge."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[0], scale[scale < 1e-9] = 0.0, 1.0
    z, w = (x - mean) / scale, np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (y - p) - RIDGE * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + RIDGE * np.eye(len(w)), gradient)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(x or b"") for x in batch.column("_text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_by"), batch.column("_label"), pa.array(rows, pa.list_(pa.float64()))], names=["_by", "_label", "_x"])


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").cast(pa.binary()).to_pylist()
            if isinstance(model, float):
                own = np.full(len(texts), model)
            elif texts:
                mean, scale, w = model
                own = 1 / (1 + np.exp(-np.clip((np.array([features(x or b"") for x in texts]) - mean) / scale @ w, -30, 30)))
            else:
                own = np.empty(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "_host", "_path")), pa.array(np.clip(own, EDGE, 1 - EDGE), pa.float64())], names=["_id", "_host", "_path", "_own"])

    return run


def learning_labels(labels: DataFrame) -> DataFrame:
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    return known.groupBy(F.col("doc_id").alias("_of")).agg(F.max("quality").cast("double").alias("_label"))


def fitted(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = 13):
    """The regression, or a rate where there is nothing to fit."""
    bounded_batches(docs.sparkSession)
    chosen = learning_labels(labels).orderBy(F.xxhash64("_of", F.lit(seed)), "_of").limit(max_labelled)
    # chosen has at most max_labelled rows of two numbers
    texts = docs.select(docs["doc_id"].alias("_id"), docs["text"].alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col("_of"))
    featured = texts.select(F.xxhash64("_of", "_text", F.lit(seed)).alias("_by"), "_text", "_label").mapInArrow(_featured, "_by long, _label double, _x array<double>")
    # rows that repeat an id share its label and may be many: the bound is of rows, and their order is fixed
    rows = featured.orderBy("_by", "_label", "_x").limit(max_labelled).select("_label", "_x").collect()
    y = np.array([r[0] for r in rows])
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    return fit_logistic(np.array([r[1] for r in rows]), y)


def prior_strength(sites: DataFrame, mean: Column) -> DataFrame:
    """_k of sites (_n, _good) around a mean, by moments: the variance of their rates less its binomial part."""
    rate = F.col("_good") / F.col("_n")
    within = F.sum(F.col("_n") * mean * (1 - mean))
    spread = F.sum(F.col("_n") * (rate - mean) * (rate - mean)) - F.sum(mean * (1 - mean))
    strength = F.when(spread > 0, within / F.nullif(spread, F.lit(0.0)) - 1).otherwise(STRENGTHS[1])
    return sites.agg(F.coalesce(F.least(F.greatest(strength, F.lit(STRENGTHS[0])), F.lit(STRENGTHS[1])), F.lit(STRENGTHS[1])).alias("_k"))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.log(p / (1 - p))


def classified(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """One row per input row: _id, _host, _path, _own, _host_rate, _path_rate, _score."""
    model = fitted(docs, labels)
    rows = docs.select(docs["doc_id"].cast("long").alias("_id"), docs[host].cast("string").alias("_host"), docs[path].cast("string").alias("_path"), docs["text"].alias("_text"))
    own = rows.mapInArrow(_scorer(model), "_id long, _host string, _path string, _own double")
    known = learning_labels(labels)
    evidence = F.coalesce("_label", "_own")
    scored = staged(own.join(known, F.col("_id") == F.col("_of"), "left").withColumn("_evidence", evidence).drop("_of", "_label"), "evidence")
    paths = staged(scored.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("_n"), F.sum("_evidence").alias("_good")), "paths")
    hosts = paths.groupBy("_host").agg(F.sum("_n").alias("_n"), F.sum("_good").alias("_good"))
    total = hosts.agg((F.sum("_good") / F.sum("_n")).alias("_m"))
    # one row each, results of global aggregates
    host_k = prior_strength(hosts.join(F.broadcast(total)), F.col("_m")).withColumnRenamed("_k", "_host_k")
    host_rates = (
        hosts.join(F.broadcast(total)).join(F.broadcast(host_k))
        .select(F.col("_host").alias("_h"), F.col("_n").alias("_host_n"), F.col("_good").alias("_host_good"), "_m", "_host_k", ((F.col("_good") + F.col("_m") * F.col("_host_k")) / (F.col("_n") + F.col("_host_k"))).alias("_host_rate"))
    )
    both = staged(paths.join(host_rates, F.col("_host").eqNullSafe(F.col("_h"))), "sites")
    path_k = prior_strength(both, F.col("_host_rate")).withColumnRenamed("_k", "_path_k")
    sites = staged(
        both.join(F.broadcast(path_k)).select(F.col("_host").alias("_h"), F.col("_path").alias("_p"), "_n", "_good", "_host_n", "_host_good", "_m", "_host_k", "_path_k"), "sites"
    )
    # a site may hold a third of all rows; they are dealt over SALTS keys where the sites are too many to be broadcast
    salted = sites.withColumn("_salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = scored.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    found = dealt.join(salted, F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_p")) & (F.col("_salt") == F.col("_salt_of")))
    host_rate = (F.col("_host_good") - F.col("_evidence") + F.col("_m") * F.col("_host_k")) / (F.col("_host_n") - 1 + F.col("_host_k"))
    path_rate = (F.col("_good") - F.col("_evidence") + F.col("_host_rate") * F.col("_path_k")) / (F.col("_n") - 1 + F.col("_path_k"))
    logit = _logit(F.col("_own")) + _logit(F.col("_path_rate")) - _logit(F.col("_m"))
    return found.withColumn("_host_rate", host_rate).withColumn("_path_rate", path_rate).select("_id", "_host", "_path", "_own", "_host_rate", "_path_rate", (1 / (1 + F.exp(-logit))).alias("_score"))


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    found = classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        F.col("_id").alias("doc_id"), (fold(F.col("_id")) == 0).alias("held_out"), F.col("_own").alias("own"), F.col("_host_rate").alias("host_rate"),
        F.col("_path_rate").alias("path_rate"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).alias("kept"),
    )
