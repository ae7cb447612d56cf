"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share all
words. A source gives at most ``max_passes`` times its words; what it can't give
is shared by weight among the others. The fixed point has a closed form,
target = min(max_passes * size, weight * level), with the level found from prefix sums
over the sources in the order in which they meet their limits.

Curriculum: the weight of a source follows a schedule over the training time 0..1,
piecewise linear between knots. Its integral is the source's cumulative demand of
words. A source's documents, in an order by hash, pass by pass, lay their words
end to end on that demand; the middle of what is taken of each copy is inverted
to the time at which it is due, and documents are range-sorted by it.

Cumulative sizes are taken in ranges of the hash first and then within them, so a
hot source is not a single task's. The hash is of id and text, so rows that repeat an id
with other texts (a null id, too) lie apart and in the same order in every run; of rows
equal in both, any may be the one that is cut. Null texts have no words, and so no copies.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WHITE, WORD, packed, staged, table, text_or_empty, unpacked, word_count

#: The weights that the sources get in turn, and the passes that are allowed.
WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
#: For each weight, the schedule as (time, factor of the weight); in between it is linear.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.25), (0.7, 1.0), (1.0, 2.0)),
)
#: Ranges of the hash by which a source's documents are summed.
RANGES = 1024


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """sizes (_source, _source_size), a row for each source, with _class and _target.

    One row a source: the table is aggregated, and only its prefix sums are ordered.
    """
    place = Window.orderBy(F.col("_source").isNull(), "_source")
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("_class") + 1)
    ranked = sizes.withColumn("_class", ((F.row_number().over(place) - 1) % len(weights)).cast("int")).withColumn("_weight", weight)
    limit = (max_passes * F.col("_source_size")).cast("double")
    every = Window.partitionBy()
    before = Window.orderBy("_ratio", F.col("_source").isNull(), "_source").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("_source_size").over(every) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / (
        F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    )
    levels = ranked.withColumn("_limit", limit).withColumn("_ratio", F.col("_limit") / F.col("_weight")).withColumn("_level", level)
    free = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(every)["_level"]
    target = F.least(F.col("_limit"), F.coalesce(F.col("_weight") * free, F.col("_limit")))
    return levels.withColumn("_target", target).select("_source", "_source_size", "_class", "_target")


def due_time(share: Column, kind: Column, schedules=SCHEDULES) -> Column:
    """The time at which a share (0..1) of a source's whole demand has come up."""
    out = None
    for i, knots in enumerate(schedules):
        areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
        total, done, time = sum(areas), 0.0, None
        for area, ((t0, w0), (t1, w1)) in zip(areas, zip(knots, knots[1:], strict=False), strict=True):
            rest, slope = share * total - done, (w1 - w0) / (t1 - t0)
            # w0 x + slope x^2 / 2 = rest, in the form that holds for a slope of 0
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0)))
            x = F.when(w0 + root > 0, 2 * rest / F.nullif(w0 + root, F.lit(0.0))).otherwise(0.0)
            here = F.least(F.greatest(t0 + x, F.lit(t0)), F.lit(t1))
            time = here if time is None else F.when(share * total > done, here).otherwise(time)
            done += area
        out = F.when(kind == i, time) if out is None else out.when(kind == i, time)
    return out


def mix(
    docs: DataFrame, source: str = "source", seed: int = 7, weights=WEIGHTS, max_passes: int = MAX_PASSES, ranges: int = RANGES, keep: list[str] | None = None
) -> DataFrame:
    """One row per input row: _row (the columns to keep), _source, _size, _source_size, _target, _taken, _copies.

    _copies has a (words, position) for each pass that takes words of the document.
    The last copy of a source is cut where its demand ends.
    """
    kept = docs.select(*[f"`{c}`" for c in docs.columns if keep is None or c in keep])
    sized = docs.select(packed(kept), docs["doc_id"].alias("_id"), docs[source].alias("_source"), word_count(text_or_empty(docs["text"])).alias("_size"), F.xxhash64(docs["doc_id"], docs["text"], F.lit(seed)).alias("_hash"))
    hashed = sized.withColumn("_range", F.pmod(F.shiftright("_hash", 40), F.lit(ranges)))
    parts = hashed.groupBy("_source", "_range").agg(F.sum("_size").alias("_part"))
    parts = staged(parts, "mix-parts")
    targets = staged(source_targets(parts.groupBy("_source").agg(F.sum("_part").alias("_source_size")), weights, max_passes), "mix-targets")
    start = F.sum("_part").over(Window.partitionBy("_source").orderBy("_range")) - F.col("_part")
    starts = parts.withColumn("_start", start).join(targets.withColumnRenamed("_source", "_of"), F.col("_source").eqNullSafe(F.col("_of"))).select(
        F.col("_source").alias("_of"), F.col("_range").alias("_in"), "_start", "_source_size", "_class", "_target"
    )
    starts = staged(starts, "mix-starts")
    found = hashed.join(starts, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_in")))
    order = Window.partitionBy("_of", "_in").orderBy("_hash", "_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = found.withColumn("_begin", F.col("_start") + F.sum("_size").over(order) - F.col("_size"))
    demand = F.round("_target").cast("long")

    def copy(k: Column) -> Column:
        begin = F.col("_begin") + k * F.col("_source_size")
        words = F.least(F.greatest(demand - begin, F.lit(0)), F.col("_size"))
        middle = (begin + words / 2) / F.greatest(demand, F.lit(1))
        return F.struct(words.alias("words"), due_time(middle, F.col("_class")).alias("position"))

    copies = F.filter(F.array(*[copy(F.lit(k)) for k in range(max_passes)]), lambda c: c["words"] > 0)
    taken = F.aggregate("_copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    return placed.withColumn("_copies", copies).withColumn("_taken", taken).select("_row", "_source", "_size", "_source_size", "_target", "_taken", "_copies")


def first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word, white space as it was."""
    pieces = F.regexp_extract_all(text, F.lit(f"[{WHITE}]*{WORD}"), F.lit(0))
    return F.array_join(F.slice(pieces, 1, n.cast("int")), "")


def mixed_documents(docs: DataFrame, source: str = "source", seed: int = 7) -> DataFrame:
    """docs as the training order wants them: copies repeated, range-sorted by position.

    A document that the mix takes nothing of goes.
    """
    due = mix(docs, source, seed).withColumn("_copy", F.explode("_copies"))
    text = F.col("_row.text")
    cut = F.when(F.col("_copy.words") < F.col("_size"), first_words(text, F.col("_copy.words"))).otherwise(text)
    rows = due.select(F.col("_row").withField("text", cut).alias("_row"), F.col("_copy.position").alias("_position"))
    return unpacked(rows.repartitionByRange("_position", "_row.doc_id").sortWithinPartitions("_position", "_row.doc_id"))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    rows = found.select(
        "_row.doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        F.col("_taken").alias("taken"), F.get("_copies", F.lit(0))["position"].alias("position"),
    )
    # what is not taken has no position; the id spreads it over ranges
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
