"""Line deduplication by a log-template tree.

A line is cut into tokens at white space, and tokens with a digit become the wildcard.
The tree has a fixed depth: token count, then the LEADING first tokens. Leaves that
only one document reaches hold no recurring line and are left out by a cheap
aggregation. In each other leaf a line has templates of two kinds, each with LITERAL of
all tokens at least, wildcards not counted:

* by support: a token that no other line of the leaf has at its place is the value of a
  field and becomes the wildcard; so any number of fields is found, wherever they stand,
  as long as their values differ from those of all other lines.
* by blocks: the tokens behind the leading ones are cut into BLOCKS blocks, and what
  some of them hold are the fields, whether their values recur or not. A line has every
  template that leaves out as many blocks as LITERAL allows, so two lines that differ
  in two blocks (three, where their sizes allow it) share one.

Neither depends on what else the leaf holds or on how many lines. A template recurs when
two or more documents have it, as does a line that two or more documents have. Lines of
recurring templates are dropped from all their documents.

Lines of fewer than ``min_tokens`` tokens have no template; those of fewer than
``exact_tokens`` stay even where they recur exactly, as ends of verses or brackets do.
A null text stays null; a text that loses all lines becomes empty. Rows equal in doc_id
and text are one document; a null doc_id is an id like any other. An empty table gives
an empty result. All of it is DataFrame functions.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, packed, staged, table, unpacked

LEADING, MIN_TOKENS, LITERAL, SALTS = 3, 5, 0.6, 16
#: Blocks of a line, and the token count from which all lines leave out the same sets of them.
BLOCKS, MANY = 6, 64
WILD = "<*>"


def document_key(docs: DataFrame, seed: int = 0) -> Column:
    """Tells documents apart also where ids repeat or are null; two seeds make a name of 128 bits."""
    return F.xxhash64(F.lit(seed), docs["doc_id"], docs["text"])


def spaced(text: Column) -> Column:
    """The text with one space for each run of white space within a line."""
    odd = F.contains(text, F.lit("  "))
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains(text, F.lit(c))
    return F.when(odd, F.regexp_replace(text, "[\\x20\\x09\\x0B-\\x0D]+", " ")).otherwise(text)


def masked(line: Column) -> Column:
    """The wildcard for tokens with a digit; the pattern never goes back in the line."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", WILD)).otherwise(line)


def _lines(docs: DataFrame, least: int, with_text: bool) -> DataFrame:
    """_key of the document, _leaf and the 128-bit name (_line, _more) of each masked line; with it the line and its tokens (_text, _size), or its place (_other, _at)."""
    # the names of documents are made below the explosion, once for each
    keys = [document_key(docs).alias("_key"), *([] if with_text else [document_key(docs, 1).alias("_other")])]
    texts = docs.where(docs["text"].isNotNull()).select(*keys, spaced(docs["text"]).alias("_whole"))
    rows = texts.select(*[c for c in texts.columns if c != "_whole"], F.posexplode(F.split("_whole", "\n")).alias("_at", "_raw"))
    # masking keeps the tokens' number, so that it follows the filter, which looks at the first tokens only
    cut = rows.select("*", F.btrim("_raw").alias("_plain")).where("_plain <> ''")
    if least > 1:
        cut = cut.where(F.substring_index("_plain", " ", least - 1) != F.col("_plain"))
    cut = cut.select("*", masked(F.col("_plain")).alias("_text"), F.size(F.split("_plain", " ")).alias("_size"))
    leaf = F.xxhash64("_size", F.substring_index("_text", " ", LEADING))
    return cut.select("_key", leaf.alias("_leaf"), F.xxhash64("_text").alias("_line"), F.xxhash64(F.lit(1), "_text").alias("_more"), *(["_text", "_size"] if with_text else ["_other", "_at"]))


@lru_cache(maxsize=256)
def masks(n: int) -> list[int]:
    """Bit sets of the blocks that stay literal in the templates of lines of n tokens.

    They leave out each set of blocks that cannot be larger: LITERAL of the tokens must be left.
    """
    m, spare = n - LEADING, n - ceil(round(LITERAL * n, 9))
    sizes = [(i + 1) * m // BLOCKS - i * m // BLOCKS for i in range(BLOCKS)]
    full = sum(1 << i for i in range(BLOCKS) if sizes[i])
    gone = [x for x in range(1 << BLOCKS) if x & ~full == 0 and sum(sizes[i] for i in range(BLOCKS) if x >> i & 1) <= spare]
    return sorted(full & ~x for x in gone if not any(x != y and x & y == x for y in gone))


def _needed(size: Column) -> Column:
    return F.ceil(F.round(LITERAL * size, 9))


def _literals(tokens: Column) -> Column:
    return F.size(F.array_remove(tokens, WILD))


def _by_blocks(different: DataFrame) -> DataFrame:
    """_line, _more, _a, _b and _template: one row for each template of a different line that keeps a set of blocks."""
    tokens = F.split("_text", " ")
    size = F.size("_tokens")
    rows = different.select("_leaf", "_line", "_more", "_a", "_b", tokens.alias("_tokens"))
    bound = [F.floor(i * (size - LEADING) / BLOCKS).cast("int") for i in range(BLOCKS + 1)]
    blocks = [F.slice("_tokens", bound[i] + (LEADING + 1), bound[i + 1] - bound[i]) for i in range(BLOCKS)]
    tables = "array(" + ",".join(f"array({','.join(map(str, masks(n)))})" for n in range(MIN_TOKENS, MANY + 1)) + ")"
    wanted = F.get(F.expr(tables), F.least(size, F.lit(MANY)) - MIN_TOKENS)
    hashed = rows.select(
        "_leaf", "_line", "_more", "_a", "_b", *[F.xxhash64(x).alias(f"_h{i}") for i, x in enumerate(blocks)], *[_literals(x).alias(f"_c{i}") for i, x in enumerate(blocks)],
        (_needed(size) - _literals(F.slice("_tokens", 1, LEADING))).alias("_need"), wanted.alias("_masks"),
    )
    # exploded apart, or what stands beside explode is computed for each mask
    hashed = hashed.select("*", F.explode("_masks").alias("_mask"))
    within = [F.col("_mask").bitwiseAND(1 << i) > 0 for i in range(BLOCKS)]
    literal = sum((F.when(x, F.col(f"_c{i}")).otherwise(0) for i, x in enumerate(within)), F.lit(0))
    name = F.xxhash64("_leaf", "_mask", *[F.when(x, F.col(f"_h{i}")) for i, x in enumerate(within)])
    return hashed.where(literal >= F.col("_need")).select("_line", "_more", "_a", "_b", name.alias("_template"))


def _by_support(different: DataFrame) -> DataFrame:
    """_line, _more, _a, _b and _template: the template of a different line without the tokens that it alone has at their places."""
    tokens = different.select("_leaf", "_line", F.posexplode(F.split("_text", " ")).alias("_place", "_token")).where(F.col("_token") != WILD)
    # equal tokens of one place meet under one key; a common one is combined before the shuffle
    named = tokens.select(F.xxhash64("_leaf", "_place", "_token").alias("_named"), "_place", "_line")
    seen = named.groupBy("_named").agg(F.count(F.lit(1)).alias("_n"), F.min("_line").alias("_of"), F.min("_place").alias("_place"))
    fields = seen.where("_n = 1").groupBy("_of").agg(F.collect_list("_place").alias("_fields"))  # the places of one line
    found = different.hint("merge").join(fields, F.col("_line") == F.col("_of"), "left")
    split = F.split("_text", " ")
    left = F.when(F.col("_fields").isNull(), split).otherwise(F.transform(split, lambda x, i: F.when(F.array_contains(F.col("_fields"), i), WILD).otherwise(x)))
    kept = found.select("_leaf", "_line", "_more", "_a", "_b", left.alias("_tokens")).where(_literals(F.col("_tokens")) >= _needed(F.size("_tokens")))
    return kept.select("_line", "_more", "_a", "_b", F.xxhash64(F.lit(2), "_leaf", "_tokens").alias("_template"))


def recurring_lines(docs: DataFrame, lines: DataFrame, least: int, min_tokens: int) -> DataFrame:
    """_line, _more and _template of all lines that recur or whose template recurs across documents."""
    by_leaf = lines.groupBy("_leaf").agg(F.min("_key").alias("_a"), F.max("_key").alias("_b"), (F.min("_line") < F.max("_line")).alias("_many"))
    leaves = staged(by_leaf.where("_a <> _b").select(F.col("_leaf").alias("_in"), "_many"), "leaves")
    # a leaf may hold a third of all lines; its rows are dealt over SALTS keys
    salted = leaves.select("_in", "_many", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_deal"))
    dealt = _lines(docs, least, True).withColumn("_salt", F.pmod("_key", F.lit(SALTS)).cast("int"))
    within = dealt.hint("merge").join(salted, (F.col("_leaf") == F.col("_in")) & (F.col("_salt") == F.col("_deal")))
    first = [F.first(c).alias(c) for c in ("_text", "_size", "_many")]
    different = staged(within.groupBy("_leaf", "_line", "_more").agg(F.min("_key").alias("_a"), F.max("_key").alias("_b"), *first), "different-lines", "zstd")
    discard(leaves)
    # a line that is alone in its leaf has no other to share a template with
    wide = different.where(F.col("_many") & (F.col("_size") >= min_tokens))
    named = staged(_by_blocks(wide).union(_by_support(wide)), "line-templates")
    recurs = named.groupBy("_template").agg(F.min("_a").alias("_x"), F.max("_b").alias("_y")).where("_x <> _y").select(F.col("_template").alias("_of"))
    # what recurs exactly is a witness above and needs no template of its own
    general = named.where("_a = _b").join(recurs, F.col("_template") == F.col("_of")).select("_line", "_more", "_template")
    exact = different.where("_a <> _b").select("_line", "_more", F.col("_line").alias("_template"))
    return exact.union(general).groupBy("_line", "_more").agg(F.min("_template").alias("_template"))


def without_recurring_lines(docs: DataFrame, keep: list[str] | None = None, min_tokens: int = MIN_TOKENS, exact_tokens: int = MIN_TOKENS) -> DataFrame:
    """The columns to keep as _row, _n_lines, _n_dropped and _kept, the text of the lines that stay."""
    if min_tokens < MIN_TOKENS:
        raise ValueError(f"templates need {MIN_TOKENS} tokens at least")
    least = min(min_tokens, exact_tokens)
    lines = staged(_lines(docs, least, False), "lines")
    recurring = staged(recurring_lines(docs, lines, least, min_tokens).select(F.col("_line").alias("_bad"), F.col("_more").alias("_bad_more")), "recurring")
    hits = lines.join(recurring, (F.col("_line") == F.col("_bad")) & (F.col("_more") == F.col("_bad_more"))).select("_key", "_other", "_at")
    # a document's own line numbers only
    dropped = hits.groupBy(F.col("_key").alias("_of"), F.col("_other").alias("_of_other")).agg(F.collect_set("_at").alias("_dropped"))
    kept = docs.select(*[f"`{c}`" for c in docs.columns if keep is None or c in keep])
    rows = docs.select(packed(kept), document_key(docs).alias("_key"), document_key(docs, 1).alias("_other"), docs["text"].alias("_text"))
    found = rows.hint("merge").join(dropped, (F.col("_key") == F.col("_of")) & (F.col("_other") == F.col("_of_other")), "left")
    split = F.split("_text", "\n")
    left = F.array_join(F.filter(split, lambda _, i: ~F.array_contains(F.col("_dropped"), i)), "\n")
    return found.select(
        "_row", F.coalesce(F.size(split), F.lit(0)).cast("long").alias("_n_lines"), F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("_n_dropped"),
        F.when(F.col("_dropped").isNull(), F.col("_text")).otherwise(left).alias("_kept"),
    )


def drop_recurring_lines(docs: DataFrame, min_tokens: int = MIN_TOKENS, exact_tokens: int = MIN_TOKENS) -> DataFrame:
    """docs with recurring lines dropped from text, all other columns as they were."""
    found = without_recurring_lines(docs, min_tokens=min_tokens, exact_tokens=exact_tokens)
    return unpacked(found.select(F.col("_row").withField("text", F.col("_kept")).alias("_row")))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = without_recurring_lines(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("_row.doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.col("_kept").alias("text"))
