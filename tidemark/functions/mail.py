"""MX hosts and SPF records as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mechanisms that take a value, where the value begins (None: not reported), and words that stand alone.
PREFIXES = (("include", "include:", 9), ("redirect", "redirect=", 10), ("ip4", "ip4:", 5), ("ip6", "ip6:", 5), ("a", "a:", 3), ("mx", "mx:", 4), ("exists", "exists:", None), ("ptr", "ptr:", None))
ALONE = {"a": ("a", "+a", "-a", "~a", "?a"), "mx": ("mx", "+mx", "-mx", "~mx", "?mx"), "ptr": ("ptr", "+ptr", "-ptr", "~ptr", "?ptr"), "all": ("-all", "~all", "+all", "?all", "all")}
ORDER = ("include", "redirect", "ip4", "ip6", "a", "mx", "exists", "ptr", "all")


def mx_server(value: Column) -> Column:
    """Without the preference number and final dots, in lower case."""
    return F.lower(F.rtrim(F.regexp_replace(value, r"^[0-9]+\s+", ""), F.lit(".")))


def unquoted(value: Column) -> Column:
    return F.btrim(value, F.lit('"'))


def spf_record(values: Column) -> Column:
    """All TXT strings joined if they begin with v=spf1, else the first that does, else null.

    Strings that sort after the record are joined to it, as in the source data's own reports.
    """
    plain = F.transform(values, lambda v: unquoted(v))
    joined = F.array_join(plain, " ")
    first = F.get(F.filter(plain, lambda v: F.lower(v).startswith("v=spf1")), F.lit(0))
    return F.when(F.size(values) > 0, F.when(F.lower(joined).startswith("v=spf1"), joined).otherwise(first))


def spf_posture(spf: Column, whole_word: bool = False) -> Column:
    """The qualifier of the first `all`. By default any word that ends in `all` counts; whole_word wants the mechanism."""
    pattern = (r"(?:^|\s)" if whole_word else "") + r"([+\-~?]?)all(?:\s|$)"
    low = F.lower(spf)
    mark = F.regexp_extract(low, pattern, 1)
    return (
        F.when(spf.isNull() | (spf == ""), "No SPF")
        .when(~low.rlike(pattern), "no ?all")
        .when(mark == "", "+all")
        .otherwise(F.concat(mark, F.lit("all")))
    )


def spf_includes(spf: Column) -> Column:
    """Targets of include:, in order, with repeats."""
    return F.coalesce(F.regexp_extract_all(spf, F.lit(r"(?i)include:(\S+)"), F.lit(1)), F.array().cast("array<string>"))


def raw_addresses(spf: Column) -> Column:
    """Addresses that the record allows directly."""
    return F.coalesce(F.regexp_extract_all(spf, F.lit(r"(?i)ip[46]:([^\s]+)"), F.lit(1)), F.array().cast("array<string>"))


def mechanism(token: Column) -> Column:
    """The type of a lower-cased token; one with a qualifier before a value is `other`."""
    starts = {name: mark for name, mark, _ in PREFIXES}
    out = None
    for name in ORDER:
        hit = token.startswith(starts[name]) if name in starts else F.lit(False)
        hit = hit | token.isin(*ALONE[name]) if name in ALONE else hit
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def mechanism_value(token: Column) -> Column:
    out = None
    for _, mark, begin in PREFIXES:
        if begin:
            value = F.substring(token, begin, 1 << 30)
            out = F.when(token.startswith(mark), value) if out is None else out.when(token.startswith(mark), value)
    return out
