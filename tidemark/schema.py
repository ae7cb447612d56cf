"""Schemas of snapshots, state, events and dimensions."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT, _TEXTS = T.StringType(), T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


RAW = _struct(query_name=_TEXT, query_type=_TEXT, mx_address=_TEXT, txt_text=_TEXT)
SNAPSHOT = _struct(day=T.DateType(), domain=_TEXT, query_type=_TEXT, value=_TEXTS)
STATE = _struct(domain=_TEXT, query_type=_TEXT, value=_TEXTS, missing_since=T.DateType(), registrable_domain=_TEXT, bucket=T.IntegerType())
EVENT = _struct(
    domain=_TEXT, registrable_domain=_TEXT, domain_reversed=_TEXT, query_type=_TEXT,
    measurement_date=T.DateType(), value=_TEXTS, prev_value=_TEXTS, bucket=T.IntegerType(),
)
MX_MAP = _struct(reg_domain=_TEXT, provider=_TEXT, confidence=T.IntegerType())
SPF_MAP = _struct(inc_domain=_TEXT, provider=_TEXT, type=_TEXT, confidence=T.IntegerType())
