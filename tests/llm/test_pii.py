import datetime
import ipaddress
import random
import re

import pytest

from tests.llm.helpers import frame, odd
from tidemark.llm.pii import EXAMPLE_KEY, KINDS, MONTHS, Permuter, luhn_digit, permuter, personal_spans, pseudonymised, replaced, restored

STEP = permuter(EXAMPLE_KEY).permute


@pytest.mark.parametrize("n", [1, 2, 10, 97, 1000])
def test_permutation_and_its_inverse(n):
    p = Permuter(b"k")
    assert sorted(p.permute(i, n, "t") for i in range(n)) == list(range(n))
    assert all(p.undo(p.permute(i, n, "t"), n, "t") == i for i in range(n))
    if n > 90:
        assert [p.permute(i, n, "t") for i in range(n)] != [Permuter(b"l").permute(i, n, "t") for i in range(n)]


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("4704604897481321 and 4704 6048 9748 1321", ["card", "card"]), ("4704604897481322", []), ("no.4704604897481321-", ["card"]), ("ip.12.44.78.53.", ["ip"]), ("-123-45-6789-", ["ssn"]), ("1-123-45-6789", []), ("<a@b.org>,x", ["email"]), ("12.44.78.53", ["ip"]), ("12.44.78.530", []), ("123-45-6789", ["ssn"]), ("000-45-6789", []),
        ("GB82 WEST 1234 5698 7654 32", ["iban"]), ("GB83 WEST 1234 5698 7654 32", []), ("+1 (202) 555-8391", ["phone"]), ("+44 20 7946 0958", ["phone"]), ("2024-02-29", ["date"]),
        ("2023-02-29", []), ("31.12.1999", ["date"]), ("12/31/1999", ["date"]), ("29 February 2024", ["date"]), ("February 30, 2024", []), ("a.b+c@mail.example.com", ["email"]), ("no 1 here", []), ("", []),
    ],
)
def test_finds_and_keeps_the_format(text, kinds):
    spans = personal_spans(text, STEP)
    assert [s[2] for s in spans] == kinds
    new = replaced(text, spans)
    again = personal_spans(new, STEP)
    if kinds and "date" not in kinds:
        assert [s[2] for s in again] == kinds  # what is put in is valid, too
    if kinds and kinds[0] != "email" and "date" not in kinds and kinds != ["ip"]:
        assert [("9" if c.isdigit() else c) for c in new] == [("9" if c.isdigit() else c) for c in text] or kinds == ["iban"]


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("DE89370400440532013000 EUR 500", "DE89370400440532013000"), ("GB82 WEST 1234 5698 7654 32 BY FRIDAY", "GB82 WEST 1234 5698 7654 32"), ("DE89 3704 0044 0532 0130 00 BIC COBADEFF", "DE89 3704 0044 0532 0130 00"),
        ("4111 1111 1111 1111 12/26", "4111 1111 1111 1111"), ("4111111111111111 123", "4111111111111111"), ("22 4111111111111111", "4111111111111111"),
    ],
)
def test_what_follows_a_value_does_not_hide_it(text, value):
    assert [text[a:b] for a, b, _, _ in personal_spans(text, STEP)] == [value]


def test_equal_values_stay_linked():
    spans = personal_spans("4704604897481321 4704-6048-9748-1321 +1 (202) 555-8391 202-555-8391 2024-02-29 29.02.2024 February 29, 2024", STEP)
    digits = ["".join(c for c in s[3] if c.isdigit()) for s in spans]
    assert digits[0] == digits[1] and luhn_digit(digits[0][:-1]) == digits[0][-1]
    assert digits[2][1:] == digits[3]
    iso = datetime.date.fromisoformat(spans[4][3])
    assert spans[5][3] == iso.strftime("%d.%m.%Y") and str(iso.day) in spans[6][3] and str(iso.year) in spans[6][3]


def test_different_values_stay_apart():
    made = {personal_spans(f"10.0.{i // 256}.{i % 256}", STEP)[0][3] for i in range(2000)}
    assert len(made) == 2000


def test_odd_rows(spark):
    df = odd(spark).unionByName(frame(spark, [(50, "call +1 (202) 555-8391\nor a@b.org")]))
    rows = pseudonymised(df, EXAMPLE_KEY, keep=["doc_id", "text"]).collect()
    assert len(rows) == df.count()
    for r in rows:
        if r._row.doc_id != 50:
            assert r._new == r._row.text and r._found == []
        else:
            assert [f.kind for f in r._found] == ["phone", "email"] and r._new.endswith("@b.org") and "555-8391" not in r._new
    assert pseudonymised(frame(spark, []), EXAMPLE_KEY).count() == 0
    assert len(KINDS) == 7


LAYOUTS = {
    "iso": lambda d: d.isoformat(), "us": lambda d: f"{d.month:02d}/{d.day:02d}/{d.year}", "bare": lambda d: f"{d.day}/{d.month}/{d.year}", "dots": lambda d: f"{d.day:02d}.{d.month:02d}.{d.year}",
    "bare iso": lambda d: f"{d.year}-{d.month}-{d.day}", "name": lambda d: f"{d.day} {MONTHS[d.month - 1]} {d.year}", "name first": lambda d: f"{MONTHS[d.month - 1]} {d.day:02d}, {d.year}",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_dates_come_back_whole(layout):
    """Every 37th day of two centuries: widths and marks stay, the key brings it back, and the date is a date."""
    made = set()
    for i in range(0, 73_049, 37):
        old = "on " + LAYOUTS[layout](datetime.date(1900, 1, 1) + datetime.timedelta(i)) + ", say"
        new = replaced(old, personal_spans(old, STEP))
        shape = lambda x: re.sub("[A-Z][a-z]+", "M", re.sub("[0-9]", "9", x))
        assert shape(new) == shape(old) and restored(new, EXAMPLE_KEY) == old
        made.add(new)
    if layout != "us":  # where the order is a guess, two dates may be written alike
        assert len(made) == len(range(0, 73_049, 37))


def test_one_date_in_all_unambiguous_layouts():
    for i in range(0, 73_049, 997):
        d = datetime.date(1900, 1, 1) + datetime.timedelta(i)
        found = {datetime.date.fromisoformat(personal_spans(d.isoformat(), STEP)[0][3])}
        for layout in ("bare", "dots", "name", "name first"):
            text = personal_spans(LAYOUTS[layout](d), STEP)[0][3]
            for other in (x for x in LAYOUTS if x == layout):
                found |= {e for e in found if LAYOUTS[other](e) == text} or {None}
        assert len(found) == 1, d


def _brute_spans(text):
    """Whole values only, each token by itself, by checks that are written apart."""
    out = []
    for m in re.finditer(r"\S+", text):
        x = m[0]
        digits = [int(c) for c in x if c.isdigit()]
        luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
        moved = x[4:] + x[:4]
        if re.fullmatch(r"[2-6][0-9]{12,18}", x) and luhn:
            out.append((m.start(), m.end(), "card"))
        elif re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", x) and int("".join(c if c.isdigit() else str(ord(c) - 55) for c in moved)) % 97 == 1:
            out.append((m.start(), m.end(), "iban"))
        elif re.fullmatch(r"[0-9]{1,3}([.][0-9]{1,3}){3}", x) and all(int(p) < 256 and (p == "0" or p[0] != "0") for p in x.split(".")):
            out.append((m.start(), m.end(), "ip"))
        elif re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", x) and x[:3] not in ("000", "666") and x[0] != "9" and x[4:6] != "00" and x[7:] != "0000":
            out.append((m.start(), m.end(), "ssn"))
    return out


def test_finds_against_brute_force_and_inverts_whole_texts():
    r = random.Random(12)
    some = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def value():
        kind = r.randint(0, 6)
        if kind == 0:
            payload = r.choice("23456") + some(r.randint(11, 17))
            return payload + (luhn_digit(payload) if r.random() < 0.8 else some(1))
        if kind == 1:
            body = "".join(r.choice("ABC0123456789") for _ in range(r.randint(11, 20)))
            check = 98 - int("".join(str(int(c, 36)) for c in body + "XX00")) % 97
            return f"XX{check:02d}{body}" if r.random() < 0.8 else f"XX{some(2)}{body}"
        if kind == 2:
            return ".".join(str(r.randint(0, 300)) for _ in range(4))
        if kind == 3:
            return f"{some(3)}-{some(2)}-{some(4)}"
        return "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9)))

    for _ in range(300):
        text = " and ".join(value() for _ in range(40))  # digits on both sides of one space may be one value
        spans = personal_spans(text, STEP)
        assert [(a, b, k) for a, b, k, _ in spans] == _brute_spans(text)
        assert restored(replaced(text, spans), EXAMPLE_KEY) == text


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("gb82 west 1234 5698 7654 32", "iban"), ("+44 (0)20 7946 0958", "phone"), ("+44(0)20 7946 0958", "phone"), ("2001:db8::8a2e:370:7334", "ip"), ("2001:DB8:0:0:1:0:0:1", "ip"), ("fe80::1", "ip"), ("::1", "ip"),
    ],
)
def test_more_formats(text, kind):
    spans = personal_spans(f"x {text} y", STEP)
    assert [(s[2], s[1] - s[0]) for s in spans] == [(kind, len(text))]
    new = replaced(f"x {text} y", spans)
    back = restored(new, EXAMPLE_KEY)
    assert new != f"x {text} y" and (back == f"x {text} y" or kind == "ip" and ipaddress.ip_address(back[2:-2]) == ipaddress.ip_address(text))


def test_no_personal_data():
    for text in ("std::vector<int> a::b 12:30:45 10:20", "mod 2.0.1", "call 5551234567 now"):
        assert personal_spans(text, STEP) == []
