"""Near-duplicates by ProbMinHash over weighted word shingles.

A document is the set of its five-word shingles (lower-cased words; a shorter text
is one shingle), each weighing 1 + ln(count), so that a line repeated hundreds of
times does not outweigh all else. Similarity is the probability Jaccard of the weights, which
is the Jaccard similarity where no shingle repeats. Each shingle is a Poisson process
with its weight as rate; every arrival falls into one of REGISTERS registers, which
keep their first. Arrivals later than the last register's first can't matter, so a
text is done after about REGISTERS * ln(REGISTERS) arrivals, however long it is.

Texts with equal words are one node. Nodes that agree in a band of the signature
share a bucket; all are compared with the bucket's first node, by their full texts, and the
links make components. What is left are pairs of one bucket in different components.
These are looked at in two steps, each block against block without a row for each pair:
blocks of packed signatures (four bits of each register) tell which nodes have a likely
partner, and those are dealt into blocks that are bounded by nodes and by bytes and compared
by full texts. So every pair that shares a bucket ends up compared or connected; nothing is
capped. Bands have as many rows as leave a pair at the wanted similarity without a shared
bucket with a probability below MISS: at 0.8 it is (1 - 0.8^6)^24 < 0.001.

A bucket may hold a third of all nodes: what is joined by bucket is dealt over SALTS, texts
of leaders are copied once for each FAN of their partners, and blocks carry the work on.

Null and empty texts are linked to nothing. Rows of one doc_id are one document: where their
texts differ and none has a lower doc_id, they count as one text, and the document stays if
any of its texts comes first in its class. A null doc_id has no class and stays. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, discard, packed, staged, table, unpacked

#: Defaults: words of a shingle and the least similarity of near-duplicates.
WORDS, SIMILAR = 5, 0.8
REGISTERS = 144
#: Rows that a band may have, and the probability with which a pair at the wanted similarity may miss all bands.
ROWS, MISS = (2, 3, 4, 6, 8, 9, 12), 0.001
#: Pairs whose estimate is further below the wanted similarity than this many standard errors aren't compared by text.
SIGMAS = 4.5
#: Shingles whose registers are filled at once.
AT_ONCE = 1 << 16
#: Nodes of a block of signatures; nodes and bytes of a block of texts; bytes of shingles that a worker remembers.
LOOK, BLOCK, BLOCK_BYTES, KNOWN_BYTES = 256, 64, 4 << 20, 64 << 20
#: Keys over which rows of a bucket are dealt, and partners of a leader that share a copy of its text.
SALTS, FAN = 16, 256

_U = np.uint64
_ODD = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 300, dtype=np.uint64) * _U(2) + _U(1)
_BYTES, _PLACES, _BASE = _ODD[:256], _ODD[256:290], int(_ODD[290])
_UNBASE = pow(_BASE, -1, 1 << 64)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=4)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash for each word, from one prefix sum over the bytes."""
    a = np.frombuffer(text, dtype=np.uint8)
    edge = np.diff(~_WHITE[a], prepend=False, append=False)
    edges = np.flatnonzero(edge)
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    bits = max(16, len(a).bit_length())
    sums = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[a] * _powers(_BASE, bits)[: len(a)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _powers(_UNBASE, bits)[starts] + (ends - starts).astype(np.uint64))


def rows_of_bands(similar: float) -> int:
    """The most rows of a band with which pairs that are just similar miss all bands less often than MISS; 2 if none does."""
    return max([r for r in ROWS if (1 - similar**r) ** (REGISTERS // r) < MISS], default=ROWS[0])


def shingles(text: str, width: int = WORDS) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Keys and weights of the shingles of so many words (34 at most), and a digest of the words."""
    words = word_hashes(text.lower().encode())
    digest = hashlib.blake2b(words.tobytes(), digest_size=16).digest()
    if len(words) == 0:
        return words, words, digest
    n = max(1, len(words) - width + 1)
    keys = np.full(n, len(words) if len(words) < width else 0, dtype=np.uint64)
    for j in range(min(width, len(words))):
        keys += words[j : j + n] * _PLACES[j]
    keys, counts = np.unique(mixed(keys), return_counts=True)
    return keys, 1 + np.log(counts), digest


def _exponential(x: np.ndarray) -> np.ndarray:
    return -np.log(((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], m: int = REGISTERS) -> np.ndarray:
    """For each set of keys and weights, the shingle that comes first in each of m registers."""
    sizes = np.array([len(k) for k, _ in sets])
    x = np.concatenate([k for k, _ in sets])
    r = np.concatenate([w for _, w in sets]).astype(np.float64)
    d = np.repeat(np.arange(len(sets)), sizes)
    limit = m / np.bincount(d, r, minlength=len(sets)) * (math.log(m) + 2)
    s = mixed(x + _U(0x9E3779B97F4A7C15))
    t = _exponential(s) / r
    first, owner = np.full(len(sets) * m, np.inf), np.zeros(len(sets) * m, dtype=np.uint64)
    late: list[tuple[np.ndarray, ...]] = []
    while True:
        now = t < limit[d]
        if not now.all():
            late.append(tuple(c[~now] for c in (x, r, d, s, t)))
            x, r, d, s, t = (c[now] for c in (x, r, d, s, t))
        if len(x):
            s = mixed(s + _U(0x9E3779B97F4A7C15))
            register = d * m + ((s >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
            better = np.flatnonzero(t < first[register])
            better = better[np.argsort(-t[better], kind="stable")]  # the earliest is written last
            first[register[better]], owner[register[better]] = t[better], x[better]
            s = mixed(s + _U(0x632BE59BD9B4E019))
            t = t + _exponential(s) / r
            limit = np.minimum(limit, first.reshape(-1, m).max(axis=1))
            continue
        empty = ~np.isfinite(first.reshape(-1, m)).all(axis=1)
        if not empty.any():
            return owner.reshape(-1, m)
        limit[empty] *= 2
        x, r, d, s, t = (np.concatenate(c) for c in zip(*late, strict=True))
        again = empty[d]
        x, r, d, s, t = (c[again] for c in (x, r, d, s, t))
        late = []


def signature(keys: np.ndarray, weights: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    return signatures([(keys, weights)], m)[0]


def band_keys(owner: np.ndarray, rows: int) -> np.ndarray:
    parts = mixed(owner).reshape(-1, rows)
    out = np.arange(1, len(parts) + 1, dtype=np.uint64)
    for j in range(rows):
        out = mixed(out * _U(0x9E3779B97F4A7C15) + parts[:, j])
    return out.view(np.int64)


def packed_nibbles(owner: np.ndarray) -> np.ndarray:
    """Four bits of each register, sixteen registers to a 64-bit integer."""
    bits = (mixed(owner) >> _U(60)).reshape(-1, 16) << (_U(4) * np.arange(16, dtype=np.uint64))
    return np.bitwise_or.reduce(bits, axis=1).view(np.int64)


def least_agree(similar: float) -> int:
    """In how many registers four bits must agree for a pair to be as similar within SIGMAS standard errors."""
    agree = similar + (1 - similar) / 16
    return math.ceil(agree * REGISTERS - SIGMAS * math.sqrt(agree * (1 - agree) * REGISTERS))


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The registers in which packed signatures agree, each of x with each of y."""
    nibbles = np.bitwise_xor(x[:, None, :], y[None, :, :])
    nibbles |= (nibbles >> 1) & 0x7777777777777777
    nibbles |= (nibbles >> 2) & 0x3333333333333333
    return REGISTERS - np.bitwise_count(nibbles & 0x1111111111111111).sum(axis=2)


def first_met(x: np.ndarray, y: np.ndarray, band: int) -> np.ndarray:
    """Whether this is the first band that the two share, each of x with each of y."""
    same = x[:, None, :] == y[None, :, :]
    return np.where(same.any(axis=2), x[np.arange(len(x))[:, None], same.argmax(axis=2)], band - 1) == band


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard: the sum over common i of 1 / sum_j max(a_j / a_i, b_j / b_i)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = a[1][i].astype(np.float64), b[1][j].astype(np.float64)
    alone_x, alone_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    begin = np.searchsorted(ratio, ratio, side="left")  # from here on x_j / x_i is the larger
    sums_x, sums_y = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(y)])
    return float((1 / ((alone_x + sums_x[-1] - sums_x[begin]) / x + (alone_y + sums_y[begin]) / y)).sum())


def _sketches(width: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            sets = [shingles(text or "", width) for text in texts]
            digests = [x[2] if len(x[0]) else None for x in sets]
            bands, small = [None] * len(sets), [None] * len(sets)
            group, held = [], 0
            for i, x in enumerate([*sets, None]):
                if group and (x is None or held + len(x[0]) > AT_ONCE):
                    for k, owner in zip(group, signatures([sets[k][:2] for k in group]), strict=True):
                        bands[k] = band_keys(owner, rows)
                        small[k] = packed_nibbles(owner)
                    group, held = [], 0
                if x is not None and len(x[0]):
                    group.append(i)
                    held += len(x[0])
            columns = [batch.column("_id"), pa.array(digests, pa.binary()), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(small, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "_digest", "_size", "_bands", "_small"])

    return run


class Shingler:
    """Shingles of texts; remembers the last ones, KNOWN_BYTES at most."""

    def __init__(self, width: int):
        self.width, self.known, self.held = width, {}, 0

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found = self.known.get(text)
        if found is None:
            found = shingles(text, self.width)[:2]
            size = found[0].nbytes + found[1].nbytes + len(text)
            if self.held + size > KNOWN_BYTES:
                self.known, self.held = {}, 0
            self.known[text] = found
            self.held += size
        return found


def _compared(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(width)
        for batch in batches:
            texts = zip(batch.column("_text_a").to_pylist(), batch.column("_text_b").to_pylist(), strict=True)
            found = pa.array([similarity(of(a), of(b)) for a, b in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("_a"), batch.column("_b"), found], names=["_a", "_b", "_similarity"])

    return run


def _columns(side: list[dict]) -> tuple[np.ndarray, ...]:
    return tuple(np.array([m[c] for m in side]) for c in ("_node", "_root", "_bands", "_small"))


def _likely_nodes(least: int):
    """Of two blocks of signatures the nodes that have a likely partner in another component, which no earlier band has shown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands, nodes = [], []
            for band, xs, ys in zip(batch.column("_band").to_pylist(), batch.column("_xs").to_pylist(), batch.column("_ys").to_pylist(), strict=True):
                (x, x_root, x_bands, x_small), (y, y_root, y_bands, y_small) = _columns(xs), _columns(ys)
                likely = (agreeing(x_small, y_small) >= least) & (x_root[:, None] != y_root[None, :])
                if likely.any():
                    likely &= first_met(x_bands, y_bands, band)
                    found = {*x[likely.any(axis=1)].tolist(), *y[likely.any(axis=0)].tolist()}
                    nodes += found
                    bands += [band] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(bands, pa.int64()), pa.array(nodes, pa.int64())], names=["_band", "_node"])

    return run


def _block_links(least: int, similar: float, width: int):
    """Links between two blocks of a bucket, one for each node and component of the other.

    A pair that shares several buckets is compared in the first of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(width)
        for batch in batches:
            left, right = [], []
            for band, xs, ys in zip(batch.column("_band").to_pylist(), batch.column("_xs").to_pylist(), batch.column("_ys").to_pylist(), strict=True):
                (_, _, x_bands, x_small), (_, _, y_bands, y_small) = _columns(xs), _columns(ys)
                likely = (agreeing(x_small, y_small) >= least) & first_met(x_bands, y_bands, band)
                for i, x in enumerate(xs):
                    met = {x["_root"]}
                    for j in np.flatnonzero(likely[i]):
                        y = ys[j]
                        if y["_root"] not in met and similarity(of(x["_text"]), of(y["_text"])) >= similar:
                            met.add(y["_root"])
                            left.append(min(x["_node"], y["_node"]))
                            right.append(max(x["_node"], y["_node"]))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["_a", "_b"])

    return run


def salted_join(rows: DataFrame, small: DataFrame, by: list[str], deal: str, salts: int = SALTS) -> DataFrame:
    """rows with the columns of small, which has a row for each value of `by`: rows of a value are dealt over salts by a hash of `deal`.

    Shuffled at every size, as small grows with the input.
    """
    salt = F.pmod(F.xxhash64(deal, F.lit(3)), F.lit(salts)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", salt).join(copies.hint("merge"), [*by, "_salt"]).drop("_salt")


def _pairs_of_blocks(blocks: DataFrame) -> DataFrame:
    """_band, _xs and _ys: each block of the nodes outside a bucket's main component with each inside it, and with each outside once."""
    outside = blocks.where("_out").drop("_out")
    inside = blocks.where("NOT _out").select(F.col("_band").alias("_of"), F.col("_xs").alias("_ys"))
    second = outside.select(F.col("_band").alias("_of"), F.col("_block").alias("_other"), F.col("_xs").alias("_ys"))
    return outside.join(inside, F.col("_band") == F.col("_of")).select("_band", "_xs", "_ys").union(
        outside.join(second, (F.col("_band") == F.col("_of")) & (F.col("_block") <= F.col("_other"))).select("_band", "_xs", "_ys")
    )


def leftover_links(placed: DataFrame, nodes: DataFrame, texts: DataFrame, similar: float = SIMILAR, width: int = WORDS) -> DataFrame:
    """Links between nodes of one bucket that are still in different components.

    placed: _band, _node, _root. Pairs within a bucket's largest component need no look.
    """
    least = least_agree(similar)
    by_root = placed.groupBy("_band", "_root").agg(F.count(F.lit(1)).alias("_n"))
    torn = by_root.groupBy("_band").agg(F.max_by("_root", F.struct("_n", "_root")).alias("_main"), F.max("_n").alias("_in"), F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_roots"))
    torn = staged(torn.where("_roots > 1").select("_band", "_main", F.ceil(F.col("_in") / LOOK).alias("_ins"), F.ceil((F.col("_all") - F.col("_in")) / LOOK).alias("_outs")), "torn-buckets")
    rows = salted_join(placed, torn, ["_band"], "_node").withColumn("_out", F.col("_root") != F.col("_main"))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_node"), F.when(F.col("_out"), F.col("_outs")).otherwise(F.col("_ins"))))
    rows = rows.join(nodes.select(F.col("_node").alias("_n"), "_small", "_bands", "_size"), F.col("_node") == F.col("_n"))
    rows = staged(rows.select("_band", "_node", "_root", "_out", "_block", "_small", "_bands", "_size"), "torn")
    member = F.struct("_node", "_root", "_small", "_bands")
    # a block holds about LOOK signatures, however large the bucket
    looked = staged(rows.groupBy("_band", "_out", "_block").agg(F.collect_list(member).alias("_xs")), "looks")
    likely = _pairs_of_blocks(looked).mapInArrow(_likely_nodes(least), "_band long, _node long").distinct()
    members = staged(rows.drop("_block").join(likely, ["_band", "_node"]), "open")
    discard(rows, looked, torn)
    # blocks by nodes and by bytes
    sizes = members.groupBy("_band", "_out").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("_size") / BLOCK_BYTES)).alias("_blocks"))
    dealt = salted_join(members, staged(sizes, "open-buckets"), ["_band", "_out"], "_node").withColumn("_block", F.pmod(F.xxhash64("_node"), F.col("_blocks")))
    with_text = dealt.join(texts.toDF("_id", "_text"), F.col("_node") == F.col("_id"))
    blocks = staged(with_text.groupBy("_band", "_out", "_block").agg(F.collect_list(F.struct("_node", "_root", "_small", "_bands", "_text")).alias("_xs")), "blocks")
    return _pairs_of_blocks(blocks).mapInArrow(_block_links(least, similar, width), "_a long, _b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """_node and _root, the least node it is connected with; roots have no row. links: _a < _b.

    Alternating large and small stars; each round is written to the shared folder, and the one before goes.
    """
    edges = staged(links.select(F.col("_b").alias("_hi"), F.col("_a").alias("_lo")).distinct(), "edges")
    mark = None
    while True:
        both = edges.union(edges.select("_lo", "_hi")).toDF("_u", "_v")
        least = both.groupBy("_u").agg(F.min("_v").alias("_m")).select(F.col("_u").alias("_w"), F.least("_u", "_m").alias("_m"))
        large = both.where("_v > _u").join(least, F.col("_u") == F.col("_w")).select(F.col("_v").alias("_hi"), F.col("_m").alias("_lo")).distinct()
        least = large.groupBy("_hi").agg(F.min("_lo").alias("_m")).withColumnRenamed("_hi", "_w")
        near = large.join(least, F.col("_hi") == F.col("_w"))
        small = near.where("_lo <> _m").select("_lo", "_m").union(least.select("_w", "_m")).toDF("_hi", "_lo").distinct()
        before, edges = edges, staged(small, "edges")
        discard(before)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("_hi", "_lo").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("_hi").alias("_node"), F.col("_lo").alias("_root"))
        mark = now


def similar_links(pairs: DataFrame, texts: DataFrame, similar: float = SIMILAR, width: int = WORDS) -> DataFrame:
    """Of pairs (_a, _b, _salt) those whose texts are similar; a text _a is copied once for each of its salts."""
    copies = pairs.select("_a", "_salt").distinct().join(texts.toDF("_id_a", "_text_a"), F.col("_a") == F.col("_id_a")).drop("_id_a")
    right = texts.toDF("_id_b", "_text_b")
    with_texts = pairs.join(right, F.col("_b") == F.col("_id_b")).join(copies, ["_a", "_salt"])
    found = with_texts.select("_a", "_b", "_text_a", "_text_b").mapInArrow(_compared(width), "_a long, _b long, _similarity double")
    return found.where(F.col("_similarity") >= similar).select("_a", "_b")


def near_classes(docs: DataFrame, similar: float = SIMILAR, width: int = WORDS) -> DataFrame:
    """One row per input row: doc_id, class_id, the least doc_id it is connected with."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("_id"), docs["text"].alias("_text"))
    sketched = rows.where("_id IS NOT NULL").mapInArrow(_sketches(width, rows_of_bands(similar)), "_id long, _digest binary, _size long, _bands array<long>, _small array<long>")
    sketches = staged(sketched, "sketches")
    nodes = staged(
        sketches.where("_digest IS NOT NULL").groupBy("_digest").agg(F.min("_id").alias("_node"), F.first(F.struct("_size", "_bands", "_small")).alias("_s")).select("_digest", "_node", "_s.*"),
        "nodes",
    )
    in_bands = nodes.select("_node", F.explode("_bands").alias("_band"))
    leaders = in_bands.groupBy("_band").agg(F.min("_node").alias("_leader"), F.max("_node").alias("_last"), F.count(F.lit(1)).alias("_n")).where("_leader <> _last")
    shared = staged(in_bands.join(leaders, "_band").select("_band", "_node", "_leader", "_n"), "buckets")
    fan = F.pmod(F.xxhash64("_b"), F.ceil(F.max("_n") / FAN)).alias("_salt")
    stars = staged(shared.where("_node <> _leader").groupBy(F.col("_leader").alias("_a"), F.col("_node").alias("_b")).agg(fan), "stars")
    wanted = shared.select("_node").distinct().withColumnRenamed("_node", "_wanted")
    # shuffled at every size: what is wanted grows with the input
    texts = staged(rows.hint("merge").join(wanted, F.col("_id") == F.col("_wanted")).select("_id", "_text"), "texts")
    links = staged(similar_links(stars, texts, similar, width), "links")
    roots = components(links)
    discard(stars, links)

    placed = shared.join(roots, "_node", "left").select("_band", "_node", F.coalesce("_root", "_node").alias("_root"))
    more = staged(leftover_links(placed, nodes, texts, similar, width), "links")
    if not more.isEmpty():
        roots = components(roots.select(F.col("_root").alias("_a"), F.col("_node").alias("_b")).union(more))
    discard(shared, texts, more)

    classes = nodes.select(F.col("_digest").alias("_of"), "_node").join(roots, "_node", "left").select("_of", F.coalesce("_root", "_node").alias("_class"))
    found = sketches.select("_id", "_digest").join(classes, F.col("_digest") == F.col("_of"), "left").select(F.col("_id").alias("doc_id"), F.coalesce("_class", "_id").alias("class_id"))
    return found.union(docs.where("doc_id IS NULL").select(F.lit(None).cast("long"), F.lit(None).cast("long")))


def drop_near_duplicates(docs: DataFrame, similar: float = SIMILAR, width: int = WORDS) -> DataFrame:
    """docs with one document of each class, the one with the least doc_id, all columns as they were."""
    gone = near_classes(docs, similar, width).groupBy(F.col("doc_id").alias("_gone")).agg(F.max("class_id").alias("_class")).where("_class < _gone").select("_gone")
    rows = docs.select(packed(docs), docs["doc_id"].cast("long").alias("_id"))
    return unpacked(rows.hint("merge").join(gone, F.col("_id") == F.col("_gone"), "left_anti"))


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("class_id"))
