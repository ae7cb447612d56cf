"""Exact deduplication that no hot text can slow down.

Three stages, each comparing the full normalised content and not its digest:

1. local: each task combines its equal texts (the partial aggregation of stage 2);
2. salted: rows of one digest are dealt over ``salts`` groups by a hash of their
   id, so a text that a third of all rows share is merged by many tasks;
3. global: the at most ``salts`` winners of each text are combined.

A digest that belongs to a single content identifies it, so membership is joined
by digest alone; where two contents share a digest, it is joined by both. Texts that
more than one in HEAVY rows have are at most HEAVY, so their winners are broadcast, and
no key of the shuffled join has more than that share of the rows. Rows that repeat both
id and text are counted before they are shuffled, and written out by PART at a time.

Texts are equal when identical after lower-casing A-Z; a null text is an empty
one. The row with the largest doc_id stays; a null doc_id loses to any other. Of
rows that repeat both doc_id and text, one stays. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import packed, staged, table, text_or_empty, unpacked

#: The letters that are lower-cased.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A text that more than one in so many rows have is heavy.
HEAVY = 1000
#: Rows that repeat both id and text and are written out together.
PART = 1 << 16


def normalised(text: Column) -> Column:
    return F.translate(text_or_empty(text), UPPER, LOWER)


def _keyed(docs: DataFrame, digest_chars: int) -> DataFrame:
    content = normalised(F.col("text"))
    return docs.select(
        F.col("doc_id").alias("_id"), content.alias("_content"),
        F.substring(F.sha2(content, 256), 1, digest_chars).alias("_digest"),
    )


def content_classes(docs: DataFrame, salts: int = 16, digest_chars: int = 64) -> DataFrame:
    """One row per different content: _digest, _content, keep_id, group_size."""
    salted = (
        _keyed(docs, digest_chars)
        .groupBy("_digest", F.pmod(F.xxhash64("_id"), F.lit(salts)).alias("_salt"), "_content")
        .agg(F.max("_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    )
    return salted.groupBy("_digest", "_content").agg(F.max("_id").alias("keep_id"), F.sum("_n").alias("group_size"))


def _members(rows: DataFrame, winners: DataFrame) -> DataFrame:
    """rows with keep_id and group_size; winners has a row for each digest."""
    total = winners.agg(F.sum("group_size")).first()[0] or 0
    heavy = winners.where(F.col("group_size") > total / HEAVY).select(F.col("_digest").alias("_heavy"), F.col("keep_id").alias("_k"), F.col("group_size").alias("_n"))
    # fewer than HEAVY rows, as each stands for more than one in HEAVY of all
    known = rows.join(F.broadcast(heavy), F.col("_digest") == F.col("_heavy"), "left")
    # a row that is done needs no partner: a key that nothing has spreads it
    key = F.when(F.col("_heavy").isNull(), F.col("_digest")).otherwise(F.concat(F.lit("done "), F.xxhash64("_id", "_part").cast("string")))
    light = winners.where(F.col("group_size") <= total / HEAVY).withColumnRenamed("_digest", "_of")
    found = known.withColumn("_key", key).join(light, F.col("_key") == F.col("_of"), "left")
    return found.select(*rows.columns, F.coalesce("_k", "keep_id").alias("keep_id"), F.coalesce("_n", "group_size").alias("group_size"))


def _counted(rows: DataFrame, *more: str) -> DataFrame:
    """One row for each PART rows that repeat both id and text: _part counts these from 0, and _rows is how many rows it stands for."""
    repeats = rows.groupBy("_id", "text_sha256", *more).agg(F.count(F.lit(1)).alias("_all"))
    parts = repeats.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_all") - 1) / PART))))
    return parts.withColumn("_rows", F.least(F.lit(PART), F.col("_all") - F.col("_part") * PART).cast("int")).drop("_all")


def _placed(docs: DataFrame, salts: int, digest_chars: int) -> DataFrame:
    """_id, text_sha256, _part, _rows, keep_id and group_size."""
    classes = content_classes(docs, salts, digest_chars)
    by_digest = staged(classes.drop("_content"), "exact-classes")
    rows = _keyed(docs, digest_chars).withColumn("text_sha256", F.sha2("_content", 256))
    if by_digest.groupBy("_digest").count().where("count > 1").isEmpty():
        counted = _counted(rows).withColumn("_digest", F.substring("text_sha256", 1, digest_chars))
        return _members(counted, by_digest).drop("_digest")
    return _counted(rows.join(classes, ["_digest", "_content"]), "keep_id", "group_size")


def exact_duplicates(docs: DataFrame, salts: int = 16, digest_chars: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``digest_chars`` narrows the digest; tests use it to force collisions.
    """
    # rows that repeat id and text differ in nothing that is returned: they are counted, and written out again at the end
    found = _placed(docs, salts, digest_chars).select("*", F.posexplode(F.array_repeat(F.lit(True), F.col("_rows"))).alias("_repeat", "_row"))
    first = (F.col("_part") == 0) & (F.col("_repeat") == 0)
    return found.select(F.col("_id").alias("doc_id"), "keep_id", "group_size", (F.col("_id").eqNullSafe(F.col("keep_id")) & first).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, salts: int = 16) -> DataFrame:
    """docs with one whole row of each group of equal texts, all columns as they were."""
    winners = _placed(docs, salts, 64).where((F.col("_part") == 0) & F.col("_id").eqNullSafe(F.col("keep_id")))
    stay = winners.select(F.col("_id").alias("_stay_id"), F.col("text_sha256").alias("_stay_sha"))
    rows = docs.select(packed(docs), docs["doc_id"].alias("_id"), F.sha2(normalised(docs["text"]), 256).alias("_sha"))
    found = rows.join(stay, F.col("_id").eqNullSafe(F.col("_stay_id")) & (F.col("_sha") == F.col("_stay_sha")))
    first = F.row_number().over(Window.partitionBy("_stay_id", "_stay_sha").orderBy("_stay_sha"))
    return unpacked(found.withColumn("_first", first).where("_first = 1"))


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
