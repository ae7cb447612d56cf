import random

import numpy as np
import pytest

from tests.llm.helpers import PROSE, frame, odd
from tidemark.llm import near_dedup as nd


def jaccard(a, b):
    """Probability Jaccard by its definition."""
    x, y = (dict(zip(k.tolist(), w.tolist(), strict=True)) for k, w in (a, b))
    every = x.keys() | y.keys()
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in x.keys() & y.keys())


def test_similarity_and_estimate():
    r, errors = random.Random(5), []
    for _ in range(60):
        base = [str(r.randint(0, 40)) for _ in range(r.choice([5, 40, 300]))]
        other = [w if r.random() > 0.03 else "new" for w in base]
        a, b = nd.shingles(" ".join(base))[:2], nd.shingles(" ".join(other))[:2]
        true = jaccard(a, b)
        assert nd.similarity(a, b) == pytest.approx(true)
        errors.append((nd.signature(*a) == nd.signature(*b)).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_words():
    a = nd.word_hashes("  foo bar\n\x0bfoo é x".encode())
    assert len(a) == 4 and a[0] == a[2] and len(set(a.tolist())) == 3
    assert len(nd.word_hashes(b"")) == 0 and nd.shingles("A b")[2] == nd.shingles("a  B")[2]


def corpus(seed):
    """Groups around bases with all degrees of change, and a passage that many share."""
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 3000)}"
    passage = [word() for _ in range(40)]
    rows = []
    for g in range(12):
        base = [word() for _ in range(r.choice([12, 60, 150]))]
        for _ in range(r.choice([2, 5, 40])):
            rate = r.choice([0, 0.005, 0.02, 0.04, 0.06])
            rows.append([w if r.random() > rate else word() for w in base])
    rows += [passage + [word() for _ in range(40)] for _ in range(60)]
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 4)
    rows = corpus(seed)
    sets = [nd.shingles(t)[:2] for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if nd.similarity(sets[i], sets[j]) >= nd.SIMILAR:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    found = {r.doc_id: r.class_id for r in nd.near_classes(frame(spark, rows)).collect()}
    assert found == {i: find(i) for i in range(len(rows))}


def test_odd_rows(spark):
    df = odd(spark)
    found = nd.near_classes(df)
    assert found.count() == df.count()
    classes = {r.doc_id: r.class_id for r in found.collect()}
    assert classes[1] == 1 and classes[5] == 1 and classes[2] == 2 and classes[3] == 3 and classes[None] is None
    out = nd.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id or -1 for r in out.collect()) == [-1, -1, 1, 1, 2, 3, 4, 6, 7, 8]
    assert nd.near_classes(frame(spark, [])).count() == 0
    assert nd.near_classes(frame(spark, [(9, PROSE)])).collect()[0].class_id == 9


def _classes(rows, similar=nd.SIMILAR, width=nd.WORDS):
    sets, root = [nd.shingles(t, width)[:2] for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if nd.similarity(sets[i], sets[j]) >= similar:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in range(len(rows))}


def test_other_similarity_and_width(spark, monkeypatch):
    """Small blocks and copies of leaders' texts, another similarity and another width."""
    for name, value in (("LOOK", 5), ("BLOCK_BYTES", 900), ("FAN", 3)):
        monkeypatch.setattr(nd, name, value)
    assert [nd.rows_of_bands(x) for x in (0.5, 0.7, 0.8, 0.9)] == [2, 4, 6, 9]
    rows = corpus(4)[:150]
    found = {r.doc_id: r.class_id for r in nd.near_classes(frame(spark, rows), similar=0.6, width=3).collect()}
    assert found == _classes(rows, 0.6, 3)


def test_long_texts_in_one_band(spark):
    """Texts of a megabyte that share most of their words, some of them similar, some not."""
    r = random.Random(11)
    base = [f"w{r.randint(0, 30000)}" for _ in range(160_000)]
    rows = []
    for i in range(12):
        words = list(base)
        for k in r.sample(range(len(words)), int(len(words) * (0.01 if i < 6 else 0.06))):
            words[k] = f"x{i}y{k}"
        rows.append((i, " ".join(words)))
    assert len(rows[0][1]) > 900_000
    found = {x.doc_id: x.class_id for x in nd.near_classes(frame(spark, rows)).collect()}
    assert found == _classes(rows)


def test_one_id_with_two_texts(spark):
    """Each text is in its own class; the document stays, as one of its texts is the first."""
    other = " ".join(f"other{i}" for i in range(30))
    df = frame(spark, [(1, PROSE), (5, PROSE), (5, other), (7, other)])
    assert sorted((x.doc_id, x.class_id) for x in nd.near_classes(df).collect()) == [(1, 1), (5, 1), (5, 5), (7, 5)]
    assert sorted((x.doc_id, x.text == other) for x in nd.drop_near_duplicates(df).collect()) == [(1, False), (5, False), (5, True)]
