import math

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import PROSE, frame, odd
from tidemark.llm.mixing import SCHEDULES, due_time, mix, mixed_documents


def targets(sizes):
    """The contract's rounds: share by weight, stop at 3 times the size, share the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weights[s] for s in free) if free else 0
        over = [s for s in free if weights[s] * level > 3 * sizes[s]]
        if not over:
            return fixed | {s: weights[s] * level for s in free}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def docs(spark):
    rows, i = [], 0
    for s, (n, words) in {"a": (3, 7), "b": (400, 5), "c": (40, 30), "d": (2, 3), "é": (25, 11), None: (30, 9)}.items():
        for k in range(n):
            rows.append((i, " ".join(["w"] * (words + k % 3)), s))
            i += 1
    return frame(spark, rows)


def test_targets_and_takes(spark):
    df = docs(spark)
    found = mix(df, keep=["doc_id"], ranges=8).collect()
    sizes = {}
    for r in df.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    expected = targets(sizes)
    assert math.isclose(sum(expected.values()), sum(sizes.values()))
    for s, size in sizes.items():
        mine = [r for r in found if r._source == s]
        assert all(math.isclose(r._target, expected[s]) and r._source_size == size for r in mine), s
        assert sum(r._taken for r in mine) == round(expected[s]), s
        assert all(r._taken <= 3 * r._size and r._taken == sum(c.words for c in r._copies) for r in mine)
    assert sorted(map(str, found)) == sorted(map(str, mix(df.repartition(7), keep=["doc_id"], ranges=8).collect()))


@pytest.mark.parametrize("kind", range(len(SCHEDULES)))
def test_positions_invert_the_demand(spark, kind):
    def demand(t):
        total = 0.0
        for (t0, w0), (t1, w1) in zip(SCHEDULES[kind], SCHEDULES[kind][1:], strict=False):
            x = min(max(t - t0, 0), t1 - t0)
            total += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
        return total

    rows = spark.range(0, 101).select((F.col("id") / 100).alias("share"), due_time(F.col("id") / 100, F.lit(kind)).alias("t")).collect()
    assert all(abs(demand(r.t) / demand(1) - r.share) < 1e-9 for r in rows)
    assert [r.t for r in rows] == sorted(r.t for r in rows)


def test_documents_in_order(spark):
    df = docs(spark)
    out = mixed_documents(df)
    assert out.columns == df.columns
    words = sum(len(r.text.split()) for r in out.collect())
    assert words == sum(r._taken for r in mix(df).collect())


def test_odd_rows(spark):
    df = odd(spark)
    found = mix(df, keep=["doc_id"]).collect()
    assert len(found) == df.count()
    assert all(r._taken == 0 for r in found if r._row.doc_id in (2, 3, 4))
    assert mixed_documents(df).columns == df.columns
    assert mix(frame(spark, [])).count() == 0
    assert mix(frame(spark, [(1, None), (2, "")])).count() == 2
    assert mixed_documents(frame(spark, [(1, PROSE)])).collect()[0].text == PROSE


def test_rows_that_repeat_an_id(spark):
    """Other texts under one id, or under none, are taken alike in every run."""
    rows = [(i % 2 or None, " ".join(["w"] * (1 + i % 9) + [str(i)]), "abc"[i % 3]) for i in range(150)]
    df = frame(spark, rows)
    runs = [sorted((r._row.text, r._taken, str(r._copies)) for r in mix(df.repartition(n), keep=["text"], ranges=4).collect()) for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 150
    found = mix(df, keep=["doc_id"], ranges=4).groupBy("_source").agg(F.sum("_taken").alias("n"), F.first("_target").alias("t")).collect()
    assert all(r.n == round(r.t) for r in found)
