import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import names

RULES = names.SuffixRules(["com", "uk", "co.uk", "nl", "*.ck", "!www.ck", "// note", "===BEGIN PRIVATE DOMAINS===", "blogspot.com"])


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("mail.a.co.uk.", "a.co.uk"), ("a.com", "a.com"), ("com", None), ("x.y.ck", "x.y.ck"), ("a.x.y.ck", "x.y.ck"), ("y.ck", None), ("www.ck", "www.ck"), ("a.www.ck", "www.ck"),
        ("localhost.", None), ("", None), (None, None), ("UPPER.Nl.", "upper.nl"), ("a.blogspot.com", "blogspot.com"), ("co.uk", None),
    ],
)
def test_registrable(name, expected):
    assert RULES.registrable(name) == expected


def test_fallback_has_no_final_dot():
    assert names.registrable_or_self("Localhost.", RULES) == "localhost"
    assert names.registrable_or_self("", RULES) == ""
    assert names.registrable_or_self(None, RULES) is None


def test_columns(spark):
    df = spark.createDataFrame([("Mail.X.nl.",), ("a",), (None,), ("",)], "d string")
    rows = df.select(
        names.reversed_domain(F.col("d")), names.approximate_registrable(F.col("d")), names.plain_host(F.col("d")), names.registrable_domain(F.col("d")),
        names.bucket(names.registrable_domain(F.col("d"))),
    ).collect()
    expected = int.from_bytes(hashlib.blake2b(b"x.nl", digest_size=4).digest(), "big") % 256
    assert tuple(rows[0]) == (".nl.x.mail", "x.nl", "mail.x.nl", "x.nl", expected)
    assert tuple(rows[1])[:4] == ("a", "", "a", "a")
    assert rows[2][0] is None and rows[2][4] == names.bucket_number(None)
    assert rows[3][0] == ""
