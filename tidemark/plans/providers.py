"""Candidates for the provider mappings, from counts of the historical reports."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship_package

#: The least count, the confidence of a guess, and what is cut from names, the first match of each.
LEAST, GUESS = 100, 45
PREFIXES = ("spf.", "spf1.", "spf2.", "mail.spf.", "mail.", "smtp.", "relay.")
SUFFIXES = (
    ".com", ".net", ".org", ".io", ".co", ".eu", ".fr", ".de", ".nl", ".se", ".sk", ".cz", ".pl", ".ru", ".ua", ".br", ".jp",
    ".au", ".ca", ".it", ".es", ".be", ".ch", ".at", ".dk", ".no", ".fi", ".gr", ".bg", ".ro", ".hu", ".ee", ".lt",
)


def readable(name: str) -> str:
    """A readable provider name: known ends cut, marks to spaces, words capitalised."""
    plain = name.lstrip("_").lstrip(".")
    head = next((p for p in PREFIXES if plain.startswith(p)), "")
    plain = plain[len(head) :]
    tail = next((s for s in SUFFIXES if plain.endswith(s)), "")
    return plain[: len(plain) - len(tail)].translate(str.maketrans("-.", "  ")).title()


def readable_name(name: Column) -> Column:
    ship_package()

    @F.pandas_udf("string")
    def run(names: pd.Series) -> pd.Series:
        return names.map(readable, na_action="ignore")

    return run(name)


def candidates(counts: DataFrame, key: str, existing: DataFrame, known: DataFrame, spf: bool = False, least: int = LEAST) -> DataFrame:
    """New mapping rows for keys that are frequent and not mapped: what is known of them, else a guess.

    counts: key, count. existing and known: key, provider[, type], confidence.
    """
    fresh = counts.where(F.col("count") >= least).join(existing.select(key), key, "left_anti")
    rows = fresh.join(known, key, "left")
    kind = [F.when(F.col("provider").isNull(), "hosting").otherwise(F.col("type")).alias("type")] if spf else []
    guess = F.col("provider").isNull()
    return rows.select(
        key, "count", F.when(guess, readable_name(F.col(key))).otherwise(F.col("provider")).alias("provider"), *kind, F.when(guess, GUESS).otherwise(F.col("confidence")).alias("confidence")
    )


def merged(existing: DataFrame, added: DataFrame, key: str) -> DataFrame:
    """Both mappings; where both have a key, the existing row counts."""
    return existing.unionByName(added.select(*existing.columns).join(existing.select(key), key, "left_anti"))


def mapping_json(mapping: DataFrame, key: str) -> str:
    """A mapping as JSON; mappings are dimensions that fit the driver."""
    rows = [r.asDict() for r in mapping.orderBy(key).collect()]
    return json.dumps({r.pop(key): r for r in rows}, indent=2, ensure_ascii=False) + "\n"
