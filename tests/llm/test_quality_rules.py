import random
import re

from tests.llm.helpers import PROSE, frame, odd
from tidemark.llm.quality_rules import COUNTS, drop_low_quality, judged, text_counts


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(lines))


def test_counts():
    r = random.Random(1)
    for _ in range(200):
        text = "".join(r.choice(["a", "b", "é ", " ", "\n", "#", " ", "\x1c", "x y z w u v s t ", "\t", "漢", "|"]) for _ in range(r.randint(0, 80)))
        assert text_counts(text.encode()) == brute(text), text


def test_odd_rows(spark):
    df = odd(spark)
    found = judged(df, keep=["doc_id"]).collect()
    assert len(found) == df.count()
    by_id = {r._row.doc_id: r for r in found}
    assert [by_id[3][f"_{c}"] for c in COUNTS] == [0] * len(COUNTS) and not by_id[3]._kept
    assert by_id[1]._kept
    assert drop_low_quality(df).columns == df.columns
    assert judged(frame(spark, [])).count() == 0


def test_host_verdict(spark):
    """On a bad host soft failures count; a clean document stays there, and a failing one elsewhere."""
    symbols = PROSE + " # * $ % & |"
    rows = [(i, symbols, "bad") for i in range(80)] + [(100 + i, PROSE + f" {i}", "good") for i in range(80)] + [(300, PROSE, "bad"), (301, symbols, "good"), (302, symbols, "once")]
    kept = {r._row.doc_id: r._kept for r in judged(frame(spark, rows), keep=["doc_id"]).collect()}
    assert not any(kept[i] for i in range(80)) and all(kept[100 + i] for i in range(80))
    assert kept[300] and kept[301]


def test_rate_far_below_a_half_can_be_bad(spark):
    """Many ordinary hosts and some that fail three times as often: the prior tells, not a fixed rate."""
    symbols = PROSE + " # * $ % & |"
    rows = [(h * 1000 + i, symbols if i < (30 if h < 3 else 5 + h % 4) else f"{PROSE} {h} {i}", f"h{h}") for h in range(20) for i in range(100)]
    kept = {r._row.doc_id: r._kept for r in judged(frame(spark, rows), keep=["doc_id"]).collect()}
    for h in range(20):
        assert [kept[h * 1000 + i] for i in range(30)] == ([False] * 30 if h < 3 else [True] * 30)
        assert all(kept[h * 1000 + i] for i in range(30, 100))


def test_repeats_are_exact_where_hashes_meet(monkeypatch):
    """With a multiplier of 0 only the last word of a window makes its key; the words still decide."""
    from tidemark.llm import quality_rules as q

    monkeypatch.setattr(q, "MULTIPLIER", 0)
    text = "a b c d e f g h i j a b c d e f g h k l m n o p q r s t j h"
    assert q.text_counts(text.encode()) == brute(text)
