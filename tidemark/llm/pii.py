"""Personal data under format-preserving pseudonyms.

Numbers and dates are found, validated, and permuted by a keyed Feistel network
within the set of valid values of their format: a card number becomes another of
the same length with a right check digit, a date another date in the same layout.
The permutation depends on the key, the kind and the length alone, so equal values
get equal pseudonyms in all documents, whatever their separators, and different
values get different ones. Whoever has the key can undo it. The local part of an
email address is permuted within letters and digits; its domain stays.

Dates are permuted among those whose day is as long (1 to 9, 10 to 12, 13 on) and whose
month is as long: so a date keeps its widths, is read in the same order as before, and
is the same date in every layout. Where both orders make a date, the day is first.

Kinds: iban (mod 97, letters in either case), card (Luhn, 13 to 19 digits), ssn (area, group
and serial), phone (NANP with marks, or with +, a trunk zero in brackets allowed), ip (four
octets, or version 6, written in its shortest form), date (in the calendar, 1900 to 2099), email.
Digits without any mark are no phone: nothing would tell them from other numbers.
A finder takes as much as it can; where that fails validation, shorter ends at token
borders are tried (iban: the country's length first), then later starts within it.
Values that fail validation stay as they are. A null text stays null, an empty one
empty. Repeated rows are treated each alike; an empty table gives an empty result.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches, packed, table

#: The key of the registered query and of tests; it is public, so that production passes its own.
EXAMPLE_KEY = b"tidemark example key"
ROUNDS = 10
KINDS = ("iban", "card", "ssn", "phone", "ip", "date", "email")
#: The months' English names.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
LETTERS = "abcdefghijklmnopqrstuvwxyz"


class Permuter:
    """A keyed permutation of 0..n-1 for each n and tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.permute = lru_cache(maxsize=100_000)(self._permute)

    def _round(self, tweak: str, n: int, i: int, half: int, bits: int) -> int:
        said = f"{tweak}|{n}|{i}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(said, key=self.key, digest_size=32).digest(), "big") & ((1 << bits) - 1)

    def _walk(self, x: int, n: int, rounds: Callable[[int, int, int], tuple[int, int]], bits: int) -> int:
        while True:  # cycle walking: back into the range after at most four steps in the mean
            left, right = rounds(x >> bits, x & ((1 << bits) - 1), bits)
            x = left << bits | right
            if x < n:
                return x

    @staticmethod
    def _bits(n: int) -> int:
        return max(1, ((n - 1).bit_length() + 1) // 2)

    def _permute(self, x: int, n: int, tweak: str) -> int:
        def rounds(left, right, bits):
            for i in range(ROUNDS):
                left, right = right, left ^ self._round(tweak, n, i, right, bits)
            return left, right

        return self._walk(x, n, rounds, self._bits(n))

    def undo(self, x: int, n: int, tweak: str) -> int:
        def rounds(left, right, bits):
            for i in reversed(range(ROUNDS)):
                left, right = right ^ self._round(tweak, n, i, left, bits), left
            return left, right

        return self._walk(x, n, rounds, self._bits(n))


Step = Callable[[int, int, str], int]


def _laid_out(value: str, digits: str) -> str:
    """The digits in the place of those of value."""
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in value)


def luhn_digit(payload: str) -> str:
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(payload)))
    return str(-total % 10)


def _card(value: str, step: Step) -> str | None:
    digits = re.sub(r"\D", "", value)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or digits[0] not in "23456":
        return None
    rest = 10 ** (len(digits) - 2)  # the first digit names the network and stays
    payload = digits[0] + str(step(int(digits[1:-1]), rest, f"card{digits[0]}")).zfill(len(digits) - 2)
    return _laid_out(value, payload + luhn_digit(payload))


def _iban(value: str, step: Step) -> str | None:
    """Digits of the account are permuted, letters stay; the check digits follow."""
    plain = value.replace(" ", "")
    if not plain.isascii() or (plain != plain.upper() and plain != plain.lower()):
        return None
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    account = plain[4:]
    digits = "".join(c for c in account if c.isdigit())
    if not digits:
        return None
    account = _laid_out(account, str(step(int(digits), 10 ** len(digits), f"iban{plain[:2].upper()}")).zfill(len(digits)))
    check = 98 - number(account + plain[:2] + "00") % 97
    left = iter(f"{plain[:2]}{check:02d}{account}")
    return "".join(c if c == " " else next(left) for c in value)


def _ssn(value: str, step: Step) -> str | None:
    area, group, serial = map(int, value.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas = 898  # 1..899 without 666
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(step(x, areas * 99 * 9999, "ssn"), 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(value: str, step: Step) -> str | None:
    trunk = re.search(r"\(0\)", value)
    if trunk:  # stays where it is and does not count
        new = _phone(value[: trunk.start()] + value[trunk.end() :], step)
        return new and new[: trunk.start()] + "(0)" + new[trunk.start() :]
    digits = re.sub(r"\D", "", value)
    plus = value.startswith("+")
    national = digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
    if len(national) == 10 and (not plus or digits != national) and national[0] in "23456789" and national[3] in "23456789":
        x = ((int(national[:3]) - 200) * 800 + int(national[3:6]) - 200) * 10_000 + int(national[6:])
        x, line = divmod(step(x, 800 * 800 * 10_000, "nanp"), 10_000)
        area, office = divmod(x, 800)
        return _laid_out(value, digits[: len(digits) - 10] + f"{area + 200}{office + 200}{line:04d}")
    if plus and 8 <= len(digits) <= 15 and not (digits[0] == "1" and len(digits) == 11):
        rest = len(digits) - 3  # country codes have up to three digits; they stay
        return _laid_out(value, digits[:3] + str(step(int(digits[3:]), 10**rest, f"phone{digits[:3]}")).zfill(rest))
    return None


def _ip(value: str, step: Step) -> str | None:
    octets = value.split(".")
    if any(int(x) > 255 or str(int(x)) != x for x in octets):
        return None
    x = step(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, "ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ip6(value: str, step: Step) -> str | None:
    try:
        old = ipaddress.IPv6Address(value)
    except ValueError:
        return None
    new = str(ipaddress.IPv6Address(step(int(old), 1 << 128, "ip6")))
    return new.upper() if value != value.lower() else new


@lru_cache(maxsize=1)
def _date_classes() -> tuple[dict[datetime.date, tuple[int, int]], list[list[datetime.date]]]:
    """All dates by the widths of their numbers: the class and the place in it of each, and the dates of each class."""
    at, classes = {}, [[] for _ in range(6)]
    for i in range((LAST_DAY - FIRST_DAY).days + 1):
        date = FIRST_DAY + datetime.timedelta(i)
        kind = (0 if date.day < 10 else 1 if date.day <= 12 else 2) * 2 + (date.month > 9)
        at[date] = kind, len(classes[kind])
        classes[kind].append(date)
    return at, classes


def _moved(year: int, month: int, day: int, step: Step) -> datetime.date | None:
    at, classes = _date_classes()
    try:
        kind, place = at[datetime.date(year, month, day)]
    except (KeyError, ValueError):
        return None
    return classes[kind][step(place, len(classes[kind]), f"date{kind}")]


def _date(value: str, step: Step) -> str | None:
    """The other date's numbers in the places and widths of the old ones, and its month's name where a name was."""
    texts, name = re.findall(r"[0-9]+", value), re.search(r"[A-Z][a-z]+", value)
    numbers = list(map(int, texts))
    if name:
        new = _moved(numbers[1], MONTHS.index(name[0]) + 1, numbers[0], step)
        made = new and [new.day, new.year]
    else:
        if len(texts[0]) == 4:
            order = (0, 1, 2)
        else:  # day first, unless only month first is a date
            order = (2, 0, 1) if numbers[1] > 12 else (2, 1, 0)
        new = _moved(*(numbers[i] for i in order), step)
        made = new and [x for _, x in sorted(zip(order, (new.year, new.month, new.day), strict=True))]
    if new is None:
        return None
    left = iter([f"{x:0{len(t)}d}" for x, t in zip(made, texts, strict=True)])
    plain = re.sub(r"[0-9]+", lambda _: next(left), value)
    return plain.replace(name[0], MONTHS[new.month - 1]) if name else plain


def _email(value: str, step: Step) -> str | None:
    """Runs of letters are permuted within their length, digits too; marks, case and domain stay."""
    local, at, domain = value.partition("@")
    letters = [LETTERS.index(c.lower()) for c in local if c.isascii() and c.isalpha()]
    digits = "".join(c for c in local if c.isdigit() and c.isascii())
    if not letters and not digits:
        return None
    size = 26 ** len(letters) * 10 ** len(digits)
    x = 0
    for c in letters:
        x = x * 26 + c
    x = step(x * 10 ** len(digits) + int(digits or 0), size, f"email{len(letters)}.{len(digits)}")
    x, d = divmod(x, 10 ** len(digits))
    new_digits = iter(str(d).zfill(len(digits)) if digits else "")
    found = []
    for _ in letters:
        x, c = divmod(x, 26)
        found.append(LETTERS[c])
    new_letters = iter(reversed(found))

    def put(c: str) -> str:
        if c.isascii() and c.isalpha():
            new = next(new_letters)
            return new.upper() if c.isupper() else new
        return next(new_digits) if c.isascii() and c.isdigit() else c

    return "".join(map(put, local)) + at + domain


_NAMES = "|".join(MONTHS)
FINDERS: tuple[tuple[str, re.Pattern, Callable[[str, Step], str | None]], ...] = (
    ("iban", re.compile(r"(?<!\w)(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){3,8}|[a-z]{2}[0-9]{2}(?: ?[a-z0-9]{1,4}){3,8})(?!\w)"), _iban),
    ("card", re.compile(r"(?<!\w)(?<![0-9][.-])[2-6](?:[ -]?[0-9]){12,18}(?!\w|[.-][0-9])"), _card),
    ("ssn", re.compile(r"(?<!\w)(?<![0-9]-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?!\w|-[0-9])"), _ssn),
    ("phone", re.compile(r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-]?[0-9]{4}(?!\w|-[0-9])|(?<![\w+])\+[0-9]{1,3} ?\(0\)(?:[ .-]?[0-9]{2,4}){2,5}(?!\w|-[0-9])|(?<![\w+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?!\w|-[0-9])"), _phone),
    ("ip", re.compile(r"(?<!\w)(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])"), _ip),
    ("ip", re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)(?=[A-Fa-f:]*[0-9])[0-9A-Fa-f:]{2,39}(?![\w:]|\.[0-9])"), _ip6),
    (
        "date",
        re.compile(rf"(?<!\w)(?<![0-9][./-])(?:[0-9]{{4}}([-/.])[0-9]{{1,2}}\1[0-9]{{1,2}}|[0-9]{{1,2}}([-/.])[0-9]{{1,2}}\2[0-9]{{4}}|[0-9]{{1,2}} (?:{_NAMES}),? [0-9]{{4}}|(?:{_NAMES}) [0-9]{{1,2}},? [0-9]{{4}})(?!\w|[./-][0-9])"),
        _date,
    ),
    ("email", re.compile(r"(?<![\w.+%-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"), _email),
)
DIGIT = re.compile("[0-9]")
#: Kinds whose finders may take tokens that follow a value.
GREEDY = ("iban", "card", "phone")
BORDER = re.compile(r"(?<=\w)(?=[ .-])")
#: The length of an IBAN by country.
IBAN_LENGTHS = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 "
    "IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SD18 "
    "SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()}


def _candidates(kind: str, value: str) -> list[int]:
    """Where a value of this kind may end: at its end and at the token borders before, the longest first."""
    if kind not in GREEDY:
        return [len(value)]
    ends = [len(value), *(m.start() for m in reversed(list(BORDER.finditer(value))))]
    if kind == "iban":
        wanted = IBAN_LENGTHS.get(value[:2].upper())
        ends.sort(key=lambda e: len(value[:e].replace(" ", "")) != wanted)
    return ends


def _found(kind: str, pattern: re.Pattern, change: Callable[[str, Step], str | None], line: str, step: Step) -> Iterator[tuple[int, int, str]]:
    at = 0
    while m := pattern.search(line, at):
        at = m.start() + 1 if kind in GREEDY else m.end()
        for end in _candidates(kind, m[0]):
            if (new := change(m[0][:end], step)) is not None:
                yield m.start(), m.start() + end, new
                at = m.start() + end
                break


def personal_spans(text: str, step: Step) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of validated values, leftmost first; of those that overlap, the first and then the kind listed first."""
    found, at = [], 0
    for line in text.split("\n"):
        if "@" in line or DIGIT.search(line):
            for rank, (kind, pattern, change) in enumerate(FINDERS):
                if kind != "email" or "@" in line:
                    found += [(at + start, rank, at + end, kind, new) for start, end, new in _found(kind, pattern, change, line, step)]
        at += len(line) + 1
    out, end = [], 0
    for start, _, stop, kind, new in sorted(found):
        if start >= end:
            out.append((start, stop, kind, new))
            end = stop
    return out


def replaced(text: str, spans: list[tuple[int, int, str, str]]) -> str:
    parts, at = [], 0
    for start, end, _, new in spans:
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]])


def restored(text: str, key: bytes) -> str:
    """A text with its pseudonyms undone."""
    return replaced(text, personal_spans(text, permuter(key).undo))


@lru_cache(maxsize=4)
def permuter(key: bytes) -> Permuter:
    return Permuter(key)


FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("pseudonym", T.StringType())]))


def _changer(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = permuter(key).permute
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("pseudonym", pa.string())]))
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            spans = [personal_spans(x or "", step) for x in texts]
            new = [None if x is None else replaced(x, s) for x, s in zip(texts, spans, strict=True)]
            found = [[{"kind": k, "start": a, "end": b, "pseudonym": p} for a, b, k, p in s] for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(new, pa.string()), pa.array(found, kind)], names=["_row", "_new", "_found"])

    return run


def pseudonymised(docs: DataFrame, key: bytes, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns to keep as _row, the changed text as _new, and _found (kind, start, end, pseudonym). The key is secret and the caller's."""
    bounded_batches(docs.sparkSession)
    kept = docs.select(*[f"`{c}`" for c in docs.columns if keep is None or c in keep])
    rows = docs.select(packed(kept), docs[text].alias("_text"))
    schema = T.StructType([rows.schema["_row"], T.StructField("_new", T.StringType()), T.StructField("_found", FOUND)])
    return rows.mapInArrow(_changer(key), schema)


def _is(kind: str):
    return lambda x: F.when(x == kind, True)


def op10_pii(spark, sf_dir: str) -> DataFrame:
    found = pseudonymised(table(spark, sf_dir, "documents"), EXAMPLE_KEY, keep=["doc_id"])
    kinds = F.transform("_found", lambda x: x["kind"])
    counts = [F.size(F.array_compact(F.transform(kinds, _is(k)))).cast("long").alias(f"n_{k}") for k in KINDS]
    spans = F.array_join(F.transform("_found", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("_row.doc_id", *counts, spans.alias("spans"), F.col("_new").alias("text"))
