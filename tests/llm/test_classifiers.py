import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import PROSE, frame, odd
from tidemark.llm import quality_classifier as qc
from tidemark.llm import toxicity as tox

LABELS = "doc_id long, quality int, toxic int"


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def toxic(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        words = [f"w{r.randint(0, 200)}" for _ in range(40)]
        bad = i % 6 == 0
        if bad:
            words[r.randint(0, 39)] = r.choice(["nastyone", "nastytwo", "vileness"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return frame(spark, rows), spark.createDataFrame(labels, LABELS)


def test_toxicity_on_held_out_rows(spark, toxic):
    docs, labels = toxic
    model = tox.fit(docs, labels)
    for r in tox.scored(docs, model, keep=["doc_id"]).collect():
        if held_out(r._row.doc_id):
            assert (r._score >= 0.5) == (r._row.doc_id % 6 == 0)
        assert 0 <= r._score <= 1
    assert all(not held_out(i) for i, _, _ in model.examples)


def test_neighbours_are_exact():
    """The block-max search against all cosines, which are computed apart."""
    r = np.random.default_rng(7)
    idf = r.uniform(1, 5, 40)
    rows = [(i, int(r.integers(2)), {int(t): float(r.uniform(1, 3)) for t in r.choice(40, r.integers(1, 6), replace=False)}) for i in range(500)]
    index = tox.BlockMaxIndex(rows, idf)
    norm = lambda v: math.sqrt(sum((x * idf[t]) ** 2 for t, x in v.items()))
    for _ in range(100):
        q = {int(t): float(r.uniform(1, 3)) for t in r.choice(40, r.integers(1, 6), replace=False)}
        cosines = {i: sum(x * q[t] * idf[t] ** 2 for t, x in v.items() if t in q) / norm(v) / norm(q) for i, _, v in rows}
        best = sorted((c for c in cosines.values() if c > 0), reverse=True)[: tox.NEIGHBOURS]
        got = index.nearest(q)
        assert [c for c, _ in got] == pytest.approx(best)
        assert all(cosines[int(index.ids[j])] == pytest.approx(c) for c, j in got)


def _plain_terms(text, names):
    """Counts of the vocabulary's terms in a text, by their description."""
    words = re.findall(r"[^\W_]+", text.lower())
    out = {}
    for name in names:
        if name[0] != "^":
            n = words.count(name)
        else:
            start, _, least = name[1:].partition("+")
            having = [w for w in words if w.startswith(start) and w != start]
            n = len(having) if len(set(having)) >= int(least or 1) else 0
        if n:
            out[name] = 1 + math.log(n)
    return out


def test_scores_against_plain_tfidf(spark):
    """Terms, document frequencies, cosines and votes again from the texts, without any of the operator's code but its vocabulary."""
    r = random.Random(9)
    rows, labels = [], []
    for i in range(300):
        words = ["".join(r.choice("abcdefg") for _ in range(r.randint(2, 8))) for _ in range(30)]
        if i % 5 == 0:
            words[r.randint(0, 29)] = r.choice(["nastyone", "vileness"])
        if i % 7 == 0:
            words[:3] = ["grr" + "".join(r.choice("hijk") for _ in range(4)) for _ in range(3)]
        elif i % 3 == 0:
            words[0] = "grr" + "".join(r.choice("hijk") for _ in range(4))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 5 == 0 or i % 7 == 0)))
    docs = frame(spark, rows)
    model = tox.fit(docs, spark.createDataFrame(labels, LABELS))
    assert any("+" in t for t in model.number) and "nastyone" in model.number
    vectors = {i: _plain_terms(t, model.number) for i, t in rows}
    idf = {t: math.log((1 + len(rows)) / (1 + sum(t in v for v in vectors.values()))) + 1 for t in model.number}
    norm = lambda v: math.sqrt(sum((x * idf[t]) ** 2 for t, x in v.items()))
    known = [(i, y) for i, _, y in labels if not held_out(i) and vectors[i]]
    none = [y for i, _, y in labels if not held_out(i) and not vectors[i]]
    base = (sum(none) + sum(y for i, _, y in labels if not held_out(i)) / sum(not held_out(i) for i, _, _ in labels)) / (len(none) + 1)
    for x in tox.scored(docs, model, keep=["doc_id"]).collect():
        v = vectors[x._row.doc_id]
        cosines = {i: sum(a * v[t] * idf[t] ** 2 for t, a in vectors[i].items() if t in v) / norm(vectors[i]) / norm(v) for i, _ in known} if v else {}
        best = sorted((c for c in cosines.values() if c > 0), reverse=True)[: tox.NEIGHBOURS]
        assert [n.cosine for n in x._near] == pytest.approx(best)
        assert all(cosines[n.doc_id] == pytest.approx(n.cosine) for n in x._near)
        votes, total = tox.SHRINK * base + sum(n.cosine * dict(known)[n.doc_id] for n in x._near), tox.SHRINK + sum(best)
        assert x._score == pytest.approx(votes / total if v else base)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the driver's tables")
def test_toxicity_on_driver_tables(spark):
    """Held-out rows of sf0.1, 97 of them toxic: nine of ten are caught, and scores are rates."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [(r._score, known[r._row.doc_id]) for r in tox.scored(docs, tox.fit(docs, labels), keep=["doc_id"]).collect() if r._row.doc_id in known and held_out(r._row.doc_id)]
    assert sum(s >= 0.5 for s, y in rows if y) >= 0.9 * sum(y for _, y in rows)
    assert sum(s >= 0.5 for s, y in rows if not y) <= 0.01 * len(rows)
    assert abs(sum(s for s, _ in rows) - sum(y for _, y in rows)) <= 0.02 * len(rows)


def test_toxicity_odd_rows(spark, toxic):
    _, labels = toxic
    df = odd(spark)
    none = spark.createDataFrame([], LABELS)
    rows = tox.scored(df, tox.fit(df, none), keep=["doc_id"]).collect()
    assert len(rows) == df.count() and all(r._score == 0 for r in rows)
    one = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (None, 1, 1), (6, None, None)], LABELS)
    assert tox.scored(df, tox.fit(df, one)).count() == df.count()
    empty = frame(spark, [])
    assert tox.scored(empty, tox.fit(empty, labels)).count() == 0


def test_quality_on_held_out_rows(spark):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        words = [f"word{r.randint(0, 500)}" for _ in range(50)]
        rows.append((i, " ".join(w + "###" if bad else w for w in words), f"s{i % 7}"))
        labels.append((i, int(not bad), 0))
    found = qc.classified(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len(found) == 400
    assert all((x._score >= 0.5) == (x._id % 5 != 0) for x in found if held_out(x._id))


def test_sites_shift_scores(spark):
    """Equal texts: those of a host with good labels score higher, those of a small host stay near the middle."""
    rows = [(i, PROSE, "good" if i < 100 else "bad" if i < 200 else "new") for i in range(203)]
    labels = [(i, int(i < 100), 0) for i in range(200)] + [(i, 1, 0) for i in range(300, 302)]
    rows += [(i, PROSE + " # # #", "good") for i in range(300, 302)]
    found = {x._id: x for x in qc.classified(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    pick = lambda a, b: next(i for i in range(a, b) if held_out(i))
    good, bad, new = found[pick(0, 100)], found[pick(100, 200)], found[202]
    assert good._score > new._score > bad._score and good._host_rate > 0.8 and bad._host_rate < 0.3
    logit = lambda p: math.log(p / (1 - p))
    assert new._host_rate == pytest.approx(new._path_rate, abs=0.2) and abs(logit(new._score) - logit(new._own)) < abs(logit(good._score) - logit(good._own))


def test_quality_odd_rows(spark):
    df = odd(spark)
    for labels in ([], [(1, 1, 0)], [(1, 1, 0), (6, 0, 0), (7, 1, 1), (None, 1, 1), (8, None, 0)]):
        found = qc.classified(df, spark.createDataFrame(labels, LABELS)).collect()
        assert len(found) == df.count() and all(0 <= x._score <= 1 for x in found)
    empty = frame(spark, [])
    assert qc.classified(empty, spark.createDataFrame([], LABELS)).count() == 0


def test_posteriors_against_plain_python(spark):
    """Rates of hosts and paths, strengths of the priors, and scores again from each document's own evidence, by loops."""
    r = random.Random(21)
    rows, labels = [], []
    for i in range(500):
        host = r.choice(["a", "a", "a", "b", "c", None, f"rare{i % 11}"])
        bad = r.random() < {"a": 0.1, "b": 0.6}.get(host, 0.3)
        words = [f"word{r.randint(0, 500)}" for _ in range(30)]
        rows.append((i, " ".join(w + "##" if bad and r.random() < 0.6 else w for w in words), host))
        if r.random() < 0.5:
            labels.append((i, int(not bad), 0))
    df = frame(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "x").when(F.col("doc_id") % 7 == 0, None).otherwise("y"))
    found = qc.classified(df, spark.createDataFrame(labels, LABELS)).collect()
    known = {i: q for i, q, _ in labels if not held_out(i)}
    evidence = {x._id: float(known.get(x._id, x._own)) for x in found}
    site = {x._id: (x._host, x._path) for x in found}
    m = sum(evidence.values()) / len(evidence)

    def strength(groups, means):
        """Of the prior around each group's mean, from the variance of the rates less its binomial part."""
        within = spread = 0.0
        for g, members in groups.items():
            rate = sum(evidence[i] for i in members) / len(members)
            within += len(members) * means[g] * (1 - means[g])
            spread += len(members) * (rate - means[g]) ** 2 - means[g] * (1 - means[g])
        return min(max(within / spread - 1, 1.0), 1e6) if spread > 0 else 1e6

    hosts, paths = {}, {}
    for i, s in site.items():
        hosts.setdefault(s[0], []).append(i)
        paths.setdefault(s, []).append(i)
    host_k = strength(hosts, dict.fromkeys(hosts, m))
    host_rate = {h: (sum(evidence[i] for i in ms) + m * host_k) / (len(ms) + host_k) for h, ms in hosts.items()}
    path_k = strength(paths, {s: host_rate[s[0]] for s in paths})
    logit = lambda p: math.log(min(max(p, qc.EDGE), 1 - qc.EDGE) / (1 - min(max(p, qc.EDGE), 1 - qc.EDGE)))
    for x in found:
        i, s = x._id, site[x._id]
        others = lambda ms: sum(evidence[j] for j in ms if j != i)  # noqa: B023, E731
        by_host = (others(hosts[s[0]]) + m * host_k) / (len(hosts[s[0]]) - 1 + host_k)
        by_path = (others(paths[s]) + by_host * path_k) / (len(paths[s]) - 1 + path_k)
        assert x._host_rate == pytest.approx(by_host) and x._path_rate == pytest.approx(by_path)
        assert x._score == pytest.approx(1 / (1 + math.exp(-(logit(x._own) + logit(by_path) - logit(m)))))
    assert host_k < 1e6 and len({round(x._host_rate, 3) for x in found}) > 5


def test_repeated_ids_do_not_pass_the_bound(spark, monkeypatch):
    """max_labelled bounds the rows that the regression is fitted to, where ids repeat, too; reruns agree."""
    ids = [i for i in range(40) if not held_out(i)][:12]
    rows = [(ids[i % 12], " ".join([PROSE] * (1 + i % 3)) if i % 12 % 2 else f"# * {i}") for i in range(240)]
    labels = spark.createDataFrame([(x, k % 2, 0) for k, x in enumerate(ids)], LABELS)
    seen, fit = [], qc.fit_logistic
    monkeypatch.setattr(qc, "fit_logistic", lambda x, y: seen.append(len(y)) or fit(x, y))
    one, two = (qc.fitted(frame(spark, rows).repartition(n), labels, max_labelled=50) for n in (2, 5))
    assert seen == [50, 50]
    assert all((a == b).all() for a, b in zip(one, two, strict=True))
