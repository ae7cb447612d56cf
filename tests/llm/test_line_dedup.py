import itertools
import math
import random

import pytest

from tests.llm.helpers import PROSE, frame, odd
from tidemark.llm.line_dedup import drop_recurring_lines, without_recurring_lines


def test_templates(spark):
    license_line = "Released under the terms of the License version 2.0"
    rows = [
        (1, f"{PROSE}\n{license_line}\nUser logged in as alice from host mars today"),
        (2, f"some other text that stands alone here\n{license_line.replace('2.0', '3.1')}\nUser logged in as bob from host mars today"),
        (3, "User logged in but then went on to do very other things\nThis line is only here and nowhere else at all"),
        (4, "a b\nc d"), (5, "a b\nsix words that only this one has six words that only this one has"),
    ]
    found = {r._row.doc_id: r for r in without_recurring_lines(frame(spark, rows), keep=["doc_id"]).collect()}
    assert found[1]._kept == PROSE and found[1]._n_dropped == 2 and found[1]._n_lines == 3
    assert found[2]._kept == "some other text that stands alone here"
    assert found[3]._kept == rows[2][1] and found[3]._n_dropped == 0
    assert found[4]._kept == "a b\nc d"  # short lines stay
    assert found[5]._kept == rows[4][1]


def test_exact_recurrence_is_found_whole(spark):
    """Against a count of lines: every line of five tokens or more that two documents have goes."""
    rows = [(i, "\n".join(f"line number {chr(97 + (i * k) % 26)} {chr(97 + k)} of this set" for k in range(6))) for i in range(40)]
    docs = {}
    for i, t in rows:
        for line in t.split("\n"):
            docs.setdefault(line, set()).add(i)
    for r in without_recurring_lines(frame(spark, rows), keep=["doc_id"]).collect():
        assert all(len(docs[line]) == 1 for line in r._kept.split("\n") if line)


def test_odd_rows(spark):
    df = odd(spark)
    found = without_recurring_lines(df, keep=["doc_id", "text"]).collect()
    assert len(found) == df.count()
    by_id = {r._row.doc_id: r for r in found}
    assert by_id[2]._kept is None and by_id[2]._n_lines == 0 and by_id[3]._kept == "" and by_id[6]._n_dropped == 0
    assert by_id[1]._kept == "" and by_id[5]._kept == ""  # two documents have this line
    assert drop_recurring_lines(df).columns == df.columns
    assert without_recurring_lines(frame(spark, [])).count() == 0


def test_repeats_within_a_document_stay(spark):
    text = "this line stands here again and again\n" * 3
    found = without_recurring_lines(frame(spark, [(1, text), (1, text)]), keep=["doc_id"]).collect()
    assert [r._n_dropped for r in found] == [0, 0]


def test_template_is_found_among_other_lines(spark):
    """Fields at the first token behind the leaf and at the end, and lines of the same leaf that sort between."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    rows = [(i, f"job run for {word()} finished with exit status of {word()}") for i in range(50)]
    alone = [" ".join(["job", "run", "for", *(word() for _ in range(7))]) for _ in range(2000)]
    rows += [(100, "\n".join(alone[:1000])), (101, "\n".join(alone[1000:]))]
    found = {x._row.doc_id: x for x in without_recurring_lines(frame(spark, rows), keep=["doc_id"]).collect()}
    assert all(found[i]._kept == "" for i in range(50))
    assert found[100]._n_dropped == found[101]._n_dropped == 0


def test_large_leaf_keeps_its_templates(spark):
    """More lines in a leaf than were once dealt into parts; the templates' lines lie anywhere among them."""
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    alone = [f"job run for {letters(i)} {letters(i * 7 + 1)} {letters(i * 11 + 2)} {letters(i * 13 + 3)} {letters(i * 17 + 4)} {letters(i * 19 + 5)} {letters(i * 23 + 6)}" for i in range(70_000)]
    pairs = [[f"job run for user{w} task{w} host{w} ended in state {letters(x)}" for x in (i, i + 1000)] for i, w in enumerate(map(letters, range(20)))]
    rows = [(i, "\n".join(alone[i * 7000 : (i + 1) * 7000])) for i in range(10)] + [(100 + i, x) for pair in pairs for i, x in enumerate(pair)]
    found = without_recurring_lines(frame(spark, rows), keep=["doc_id"]).where("_row.doc_id >= 100").collect()
    assert len(found) == 40 and all(r._kept == "" for r in found)


def test_white_space_does_not_tell_lines_apart(spark):
    tabbed = "alpha\tbeta\tgamma\tdelta\tepsilon\tzeta"
    rows = [
        (1, f"only here stands this line of words\n{tabbed}"), (2, f"{tabbed}\nand this one has no equal in here"),
        (3, "    the same words stand in this line"), (4, "the same  words stand in this line"), (5, "the same words stand in this line\r"), (6, "\tthe same words\tstand in this line \x0b\x0c"),
    ]
    found = {r._row.doc_id: r._kept for r in without_recurring_lines(frame(spark, rows), keep=["doc_id"]).collect()}
    assert found == {1: "only here stands this line of words", 2: "and this one has no equal in here", 3: "", 4: "", 5: "", 6: ""}


def _brute_force(docs):
    """By the definitions: lines of each document that go, from sets and loops only."""
    import re

    lines = {}  # masked line -> documents
    for i, text in docs:
        for raw in text.split("\n"):
            tokens = tuple("<*>" if re.search("[0-9]", t) else t for t in raw.split())
            if len(tokens) >= 5:
                lines.setdefault(tokens, set()).add(i)
    leaf = lambda t: (len(t), t[:3])
    places = {}
    for t in lines:
        for at, x in enumerate(t):
            places[leaf(t), at, x] = places.get((leaf(t), at, x), 0) + 1
    templates = {}
    for t, who in lines.items():
        n, need = len(t), math.ceil(round(0.6 * len(t), 9))
        mine = {("line", t), ("support", tuple("<*>" if places[leaf(t), at, x] == 1 else x for at, x in enumerate(t)))}
        bounds = [i * (n - 3) // 6 for i in range(7)]
        blocks = [t[3 + bounds[i] : 3 + bounds[i + 1]] for i in range(6)]
        fields = [g for g in itertools.product([0, 1], repeat=6) if all(len(b) or not x for b, x in zip(blocks, g, strict=True)) and sum(len(b) for b, x in zip(blocks, g, strict=True) if x) <= n - need]
        widest = [g for g in fields if not any(h != g and all(x <= y for x, y in zip(g, h, strict=True)) for h in fields)]
        mine |= {("blocks", g, t[:3], n, tuple(None if x else b for b, x in zip(blocks, g, strict=True))) for g in widest}
        for m in mine:
            kept = m[1] if m[0] == "support" else [x for b in m[4] if b for x in b] + list(t[:3]) if m[0] == "blocks" else None
            if kept is None or sum(x != "<*>" for x in kept) >= need:
                templates.setdefault(m, set()).update(who)
                lines_of.setdefault(m, set()).add(t)
    gone = {t for m, who in templates.items() if len(who) > 1 for t in lines_of[m]}
    lines_of.clear()
    return gone


lines_of: dict = {}


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    """Random leaves: lines of a few templates with up to 40 % of fields anywhere behind the leading tokens, values that recur or not."""
    r = random.Random(seed)
    word = lambda k: "w" + "".join(r.choice("abcdefgh") for _ in range(k))
    patterns = []
    for _ in range(12):
        n = r.randint(5, 24)
        base = ["a", "b", r.choice(["c", "d"])] + [word(2) for _ in range(n - 3)]
        patterns.append((base, r.sample(range(3, n), min(n - 3, r.randint(0, int(0.4 * n) + 1)))))
    made = []
    for _ in range(300):
        base, fields = r.choice(patterns)
        line = list(base)
        for f in fields:
            line[f] = r.choice([word(6), word(1), "17"])
        made.append(" ".join(line))
    docs = [(i, "\n".join(r.sample(made, 6) + [f"a b c {word(5)} {word(5)} {word(5)} {word(5)}"])) for i in range(60)]
    gone = _brute_force(docs)
    found = {x._row.doc_id: x._kept for x in without_recurring_lines(frame(spark, docs), keep=["doc_id"]).collect()}
    import re

    for i, text in docs:
        stay = [x for x in text.split("\n") if tuple("<*>" if re.search("[0-9]", t) else t for t in x.split()) not in gone]
        assert found[i] == "\n".join(stay)
    assert gone


def test_fields_in_many_places(spark):
    """Four fields spread over a line, and one next to the leading tokens with one at the end, whatever stands in the leaf."""
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    far = [f"job run for {letters(i)}q host mars gave {letters(i)}r lines in {letters(i)}s shards and {letters(i)}t rows" for i in range(200)]
    ends = [f"user did act {letters(i)}u on the far side of the moon {letters(i)}v" for i in range(200)]
    rows = [(i, x) for i, x in enumerate(far + ends)]
    found = without_recurring_lines(frame(spark, rows), keep=["doc_id"]).collect()
    assert len(found) == 400 and all(x._kept == "" for x in found)


def test_short_lines_by_parameter(spark):
    rows = [(1, "Accept all\nalone here one"), (2, "Accept all\nother words two"), (3, "{\n{"), (4, "{")]
    found = {x._row.doc_id: x._kept for x in without_recurring_lines(frame(spark, rows), keep=["doc_id"], exact_tokens=2).collect()}
    assert found == {1: "alone here one", 2: "other words two", 3: "{\n{", 4: "{"}
