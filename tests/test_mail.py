import pytest
from pyspark.sql import functions as F

from tidemark.functions import mail

CASES = [
    (['"v=spf1 -all"'], "v=spf1 -all", "-all"), (['"v=spf1 ~all"'], "v=spf1 ~all", "~all"), (["v=spf1 ?all"], "v=spf1 ?all", "?all"), (["V=SPF1 +all"], "V=SPF1 +all", "+all"),
    (["v=spf1 all"], "v=spf1 all", "+all"), (["v=spf1 mx"], "v=spf1 mx", "no ?all"), (["a", "v=spf1 -all"], "v=spf1 -all", "-all"), (["v=spf1 -all", "zz"], "v=spf1 -all zz", "-all"),
    (["other"], None, "No SPF"), ([], None, "No SPF"), (None, None, "No SPF"),
    # a word that ends in all counts as the mechanism unless whole_word is asked for
    (["v=spf1 include:firewall -all"], "v=spf1 include:firewall -all", "+all"),
]


def test_spf(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "v array<string>").withColumn("spf", mail.spf_record(F.col("v")))
    rows = df.select("spf", mail.spf_posture(F.col("spf")), mail.spf_posture(F.col("spf"), whole_word=True)).collect()
    assert [(r[0], r[1]) for r in rows] == [(c[1], c[2]) for c in CASES]
    assert rows[-1][2] == "-all"


def test_lists(spark):
    df = spark.createDataFrame([("v=spf1 Include:A.b include:c INCLUDE:c ip4:1.2.3.4 ip6:::1",), (None,)], "s string")
    rows = df.select(mail.spf_includes(F.col("s")), mail.raw_addresses(F.col("s"))).collect()
    assert rows[0][0] == ["A.b", "c", "c"] and rows[0][1] == ["1.2.3.4", "::1"]
    assert rows[1][0] == [] and rows[1][1] == []


@pytest.mark.parametrize(
    ("token", "kind", "value"),
    [
        ("include:x", "include", "x"), ("+include:x", "other", None), ("redirect=y", "redirect", "y"), ("ip4:1", "ip4", "1"), ("ip6:2", "ip6", "2"), ("a", "a", None), ("a:h", "a", "h"),
        ("~mx", "mx", None), ("mx:h", "mx", "h"), ("exists:z", "exists", None), ("ptr", "ptr", None), ("ptr:q", "ptr", None), ("-all", "all", None), ("foo", "other", None),
    ],
)
def test_mechanism(spark, token, kind, value):
    row = spark.createDataFrame([(token,)], "t string").select(mail.mechanism(F.col("t")), mail.mechanism_value(F.col("t"))).first()
    assert tuple(row) == (kind, value)


def test_mx_server(spark):
    df = spark.createDataFrame([("10 MX.a.nl.",), ("mx.b.",), ("20\t x",)], "v string")
    assert [r[0] for r in df.select(mail.mx_server(F.col("v"))).collect()] == ["mx.a.nl", "mx.b", "x"]
