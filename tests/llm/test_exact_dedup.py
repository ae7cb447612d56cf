import hashlib

import pytest

from tests.llm.helpers import frame, odd
from tidemark.llm.exact_dedup import LOWER, UPPER, drop_exact_duplicates, exact_duplicates


def brute(rows):
    fold = lambda t: (t or "").translate(str.maketrans(UPPER, LOWER))
    groups = {}
    for i, t in rows:
        groups.setdefault(fold(t), []).append(i)
    return sorted((i, max(groups[fold(t)]), len(groups[fold(t)]), hashlib.sha256(fold(t).encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("chars", [64, 1])  # a digest of one character collides
def test_groups(spark, chars):
    rows = [(i, t) for i, t in enumerate(["A b", "a B", "c", None, "", "É", "é", *["hot text"] * 60, *[f"text {k % 30}" for k in range(90)]])]
    found = exact_duplicates(frame(spark, rows), salts=3, digest_chars=chars).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == brute(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in found)


def test_odd_rows(spark):
    df = odd(spark)
    found = exact_duplicates(df).collect()
    assert len(found) == df.count()
    assert sum(r.kept for r in found) == len({r.text_sha256 for r in found})
    kept = drop_exact_duplicates(df)
    assert kept.columns == df.columns
    assert kept.count() == len({r.text_sha256 for r in found})
    assert {r.doc_id for r in kept.collect() if not r.text} == {3}


def test_empty(spark):
    assert exact_duplicates(frame(spark, [])).count() == 0
    assert drop_exact_duplicates(frame(spark, [])).count() == 0


def test_heavy_and_light_texts_give_the_same(spark, monkeypatch):
    """Winners that are broadcast and those that are joined, with null ids and a text of a third of the rows."""
    from tests.llm.helpers import frame
    from tidemark.llm import exact_dedup as ed

    rows = [(i, "Hot" if i % 3 == 0 else f"text {i % 50}") for i in range(300)] + [(None, "Hot"), (None, "alone"), (None, None), (400, "")]
    df = frame(spark, rows)
    found = []
    for heavy in (1, 4, 10**6):
        monkeypatch.setattr(ed, "HEAVY", heavy)
        found.append(sorted(map(repr, ed.exact_duplicates(df).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)
    by_id = {r.doc_id: r for r in ed.exact_duplicates(df).where("doc_id IS NOT NULL").collect()}
    assert by_id[0].keep_id == 297 and by_id[0].group_size == 101 and by_id[297].kept and by_id[400].group_size == 2


@pytest.mark.parametrize("chars", [64, 1])
def test_rows_that_repeat_id_and_text(spark, monkeypatch, chars):
    """Also where they are written out in several parts and hold most of the rows; one of them is kept."""
    from tidemark.llm import exact_dedup as ed

    monkeypatch.setattr(ed, "PART", 7)
    rows = [(5, "Hot")] * 50 + [(5, "hot")] * 13 + [(4, "HOT")] * 14 + [(None, "hot")] * 8 + [(None, None)] * 15 + [(9, "other")] + [(9, "hot too")] * 7
    found = ed.exact_duplicates(frame(spark, rows), salts=3, digest_chars=chars).collect()
    assert len(found) == len(rows)
    hot = [r for r in found if r.text_sha256 == hashlib.sha256(b"hot").hexdigest()]
    assert len(hot) == 85 and {(r.keep_id, r.group_size) for r in hot} == {(5, 85)}
    assert [r.doc_id for r in hot if r.kept] == [5]
    assert sum(r.kept for r in found) == 4 and sum(r.doc_id is None for r in found) == 23
    assert sorted(repr(r.doc_id) for r in ed.drop_exact_duplicates(frame(spark, rows)).collect()) == ["5", "9", "9", "None"]
