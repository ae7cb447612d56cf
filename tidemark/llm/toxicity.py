"""Toxicity from the nearest labelled examples.

Terms of a text are its lower-cased words, the beginnings of words (2 to 7 letters), and
the beginnings that 2 or 4 different words of the text share, since one such word says
less than several. Texts are TF-IDF vectors over all terms that labelled documents tie
to either label beyond chance: n * KL(rate, base) above the logarithm of the number of
terms tested, where n first counts documents and then different neighbourhoods (the
words before and after), so that copies and shared passages count once. Words that say
nothing about the label would only blur the cosine; there is no other bound on terms.
Document frequencies are counted in all documents. The k labelled examples of the
largest cosine are found exactly by an inverted index whose postings are cut into
blocks: a block's largest weights bound what any of its examples can reach, and blocks
below the k-th cosine found so far are skipped. Votes are weighted by cosine and
shrunk to the rate among examples without any term, which makes scores rates.

Labels are learnt from at most ``max_labelled`` labelled rows of the folds that are
not held out, and at most ``max_examples`` of each label become examples. Rows of one
doc_id that differ in label count as toxic. A null or empty text has no terms and
gets the base rate; without any labelled row that is 0. Repeated rows get equal
scores; an empty table gives an empty result. Of equal cosines, those of the block with the
larger bound come first, then the earlier example.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches, discard, fold, packed, staged, table

#: Bounds of what is learnt from; they bound what is broadcast, too.
MAX_LABELLED, MAX_EXAMPLES = 20_000, 2_048
NEIGHBOURS, BLOCK = 15, 64
KNOWN_WORDS, KNOWN_VECTORS = 400_000, 20_000
#: Weight of the base rate among the votes.
SHRINK = 0.25
#: Lengths of beginnings, and how many different words must share one to make a further term.
BEGINNINGS, SHARED = range(2, 8), (2, 4)

words_of = re.compile(r"[^\W_]+").findall


def beginnings(word: str) -> list[str]:
    return [f"^{word[:k]}" for k in BEGINNINGS if len(word) > k]


def terms_of(words: set[str]) -> dict[str, set[str]]:
    """The terms of a text's different words, each with the words that it stands for."""
    out: dict[str, set[str]] = {w: {w} for w in words}
    for w in words:
        for x in beginnings(w):
            out.setdefault(x, set()).add(w)
    more = {f"{x}+{n}": ws for x, ws in out.items() if x[0] == "^" for n in SHARED if len(ws) >= n}
    return out | more


def _label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of documents by term: all, toxic."""
    for batch in batches:
        every, toxic = Counter(), Counter()
        for text, label in zip(batch.column("_text").to_pylist(), batch.column("_label").to_pylist(), strict=True):
            found = terms_of(set(words_of((text or "").lower()))).keys()
            every.update(found)
            if label:
                toxic.update(found)
        names = list(every)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([every[x] for x in names], pa.int64()), pa.array([toxic[x] for x in names], pa.int64())], names=["term", "n", "n_toxic"]
        )


def _neighbourhoods(number: dict[str, int]):
    """A row for each place of a term: term, a hash of the words around it, label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, around, labels = [], [], []
            for text, label in zip(batch.column("_text").to_pylist(), batch.column("_label").to_pylist(), strict=True):
                words = ["", *words_of((text or "").lower()), ""]
                of: dict[str, list[int]] = {}
                for t, ws in terms_of(set(words[1:-1])).items():
                    if t in number:
                        for w in ws:
                            of.setdefault(w, []).append(number[t])
                for before, word, after in zip(words, words[1:], words[2:], strict=False):
                    if word in of:
                        place = zlib.crc32(f"{before} {after}".encode())
                        terms += of[word]
                        around += [place] * len(of[word])
                        labels += [label] * len(of[word])
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(around, pa.int64()), pa.array(labels, pa.int64())], names=["term", "around", "label"])

    return run


def _gain(n: Column, toxic: Column, base: float) -> Column:
    rate = toxic / n
    return n * (F.when(rate > 0, rate * F.log(rate / base)).otherwise(0.0) + F.when(rate < 1, (1 - rate) * F.log((1 - rate) / (1 - base))).otherwise(0.0))


class Terms:
    """Finds the vocabulary's terms in texts; remembers which words have any, KNOWN_WORDS at most."""

    def __init__(self, number: dict[str, int]):
        self.number, self.seen, self.having, self.of = number, set(), set(), {}
        self.shared: dict[str, list[tuple[int, int]]] = {}
        for t, i in number.items():
            if t[0] == "^" and "+" in t:
                start, _, n = t.rpartition("+")
                self.shared.setdefault(start, []).append((int(n), i))

    def found(self, words: set[str]) -> set[str]:
        """The words that have terms; self.of tells which, and which of their beginnings count when shared."""
        new = words - self.seen
        if len(new) + len(self.seen) > KNOWN_WORDS:
            self.seen, self.having, self.of, new = set(), set(), {}, words
        for word in new:
            starts = beginnings(word)
            numbers = [self.number[t] for t in (word, *starts) if t in self.number]
            counted = [x for x in starts if x in self.shared]
            if numbers or counted:
                self.of[word] = (numbers, counted)
                self.having.add(word)
        self.seen |= new
        return words & self.having

    def vector(self, text: str) -> dict[int, float]:
        """Term frequencies, damped, by the term's number."""
        words = words_of(text.lower())
        out: Counter = Counter()
        if few := self.found(set(words)):
            counts = Counter(w for w in words if w in few)
            starts: dict[str, list[str]] = {}
            for word, n in counts.items():
                numbers, counted = self.of[word]
                for i in numbers:
                    out[i] += n
                for x in counted:
                    starts.setdefault(x, []).append(word)
            for x, ws in starts.items():
                for n, i in self.shared[x]:
                    if len(ws) >= n:
                        out[i] = sum(counts[w] for w in ws)
        return {i: 1 + math.log(n) for i, n in sorted(out.items())}


def _frequency_counts(number: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows, terms = Counter(), 0, Terms(number)
        for batch in batches:
            for text in batch.column("_text").to_pylist():
                rows += 1
                counts.update(terms.vector(text or "").keys())
        counts[-1] = rows
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    return run


class BlockMaxIndex:
    """Postings by term, in blocks of BLOCK examples, each block with the largest weight in it."""

    def __init__(self, rows: list[tuple[int, int, dict[int, float]]], idf: np.ndarray):
        """rows: (doc_id, label, term frequencies)."""
        self.idf = idf
        rows = [(a, b, v) for a, b, v in rows if v]
        rows.sort(key=lambda r: (max(r[2], key=lambda i: (r[2][i] * idf[i], i)), r[0]))  # like examples share blocks
        self.ids = np.array([r[0] for r in rows], dtype=np.int64)
        self.labels = np.array([r[1] for r in rows], dtype=np.float64)
        self.blocks = max(1, -(-len(rows) // BLOCK))
        postings: dict[int, list[tuple[int, float]]] = {}
        for j, (_, _, v) in enumerate(rows):
            for i, x in self.unit(v).items():
                postings.setdefault(i, []).append((j, x))
        #: By term: the examples, their weights, where each block's postings begin, and the largest weight of each block.
        self.postings: dict[int, tuple[np.ndarray, np.ndarray, list[int], np.ndarray]] = {}
        for i, found in postings.items():
            at, weight = np.array([j for j, _ in found]), np.array([x for _, x in found])
            first = np.searchsorted(at, np.arange(self.blocks + 1) * BLOCK)
            largest = np.zeros(self.blocks)
            np.maximum.at(largest, at // BLOCK, weight)
            self.postings[i] = (at % BLOCK, weight, first.tolist(), largest)

    def unit(self, v: dict[int, float]) -> dict[int, float]:
        length = math.sqrt(sum((x * self.idf[i]) ** 2 for i, x in v.items()))
        return {i: x * self.idf[i] / length for i, x in v.items()}

    def nearest(self, v: dict[int, float], k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        """(cosine, example) of the k largest cosines over 0; of equal ones those of the block with the larger bound, then the earlier."""
        terms = [(x, *self.postings[i]) for i, x in self.unit(v).items() if i in self.postings]
        if not terms:
            return []
        bounds = np.round(sum(x * largest for x, _, _, _, largest in terms), 12)
        best, where, least = np.empty(0), np.empty(0, dtype=np.int64), 0.0
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] <= least:
                break
            cosines = np.zeros(BLOCK)
            for x, at, weight, first, _ in terms:
                begin, end = first[b], first[b + 1]
                if begin < end:
                    cosines[at[begin:end]] += x * weight[begin:end]
            cosines = np.round(cosines, 12)
            near = np.flatnonzero(cosines > least)
            best, where = np.concatenate([best, cosines[near]]), np.concatenate([where, b * BLOCK + near])
            top = np.argsort(-best, kind="stable")[:k]
            best, where = best[top], where[top]
            if len(best) == k:
                least = best[-1]
        return list(zip(best.tolist(), where.tolist(), strict=True))


class Model:
    """All that scoring needs; bounded by the labelled rows and examples that it was learnt from."""

    def __init__(self, number: dict[str, int], idf: list[float], examples: list[tuple[int, int, dict[int, float]]], weights: tuple[float, float], base: float):
        self.number, self.examples, self.weights, self.base, self.idf = number, examples, weights, base, idf
        self._index: BlockMaxIndex | None = None
        self._terms: Terms | None = None
        self._known: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"_index": None, "_terms": None, "_known": {}}

    def score(self, text: str) -> tuple[float, list[tuple[int, float, int]]]:
        """The score and the neighbours: doc_id, cosine, label."""
        if self._terms is None:
            self._terms = Terms(self.number)
        v = self._terms.vector(text) if self.number else {}
        if not v:
            return self.base, []
        if self._index is None:
            self._index = BlockMaxIndex(self.examples, np.array(self.idf))
        key = tuple(v.items())
        if key not in self._known:
            if len(self._known) >= KNOWN_VECTORS:
                self._known.clear()
            self._known[key] = self._vote(v)
        return self._known[key]

    def _vote(self, v: dict[int, float]) -> tuple[float, list[tuple[int, float, int]]]:
        index, votes, total, near = self._index, SHRINK * self.base, SHRINK, []
        for cosine, j in index.nearest(v):
            label = int(index.labels[j])
            votes += cosine * label * self.weights[label]
            total += cosine * self.weights[label]
            near.append((int(index.ids[j]), cosine, label))
        return votes / total, near


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_examples: int = MAX_EXAMPLES, seed: int = 11) -> Model:
    """A Model from labelled rows that are not held out, and the frequencies of all documents.

    docs is read twice: for the labelled texts, which are then staged, and for the frequencies.
    """
    bounded_batches(docs.sparkSession)
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
        .groupBy(F.col("doc_id").alias("_of")).agg(F.max("toxic").alias("_label"))
        .orderBy(F.xxhash64("_of", F.lit(seed)), "_of").limit(max_labelled)
    )
    texts = docs.select(docs["doc_id"].alias("_id"), docs["text"].alias("_text"))
    # chosen has at most max_labelled rows of two numbers; rows that repeat an id share its label
    sample = staged(texts.join(F.broadcast(chosen), F.col("_id") == F.col("_of")).select(F.col("_id").cast("long").alias("_id"), "_text", F.col("_label").cast("long").alias("_label")), "labelled")
    size = sample.agg(F.count(F.lit(1)), F.sum("_label")).first()
    n, toxic = size[0], size[1] or 0
    if not toxic or toxic == n:
        discard(sample)
        return Model({}, [], [], (1.0, 1.0), toxic / n if n else 0.0)
    base = toxic / n
    counted = staged(sample.mapInArrow(_label_counts, "term string, n long, n_toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic")), "terms")
    enough = math.log(max(counted.count(), 2))
    tells = _gain(F.col("n"), F.col("n_toxic"), base) > enough
    tried = sorted(r[0] for r in counted.where(tells).select("term").collect())
    places = sample.mapInArrow(_neighbourhoods({t: i for i, t in enumerate(tried)}), "term long, around long, label long")
    places = places.groupBy("term", "around").agg((F.avg("label") > 0.5).cast("long").alias("toxic")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("n_toxic"))
    terms = sorted(tried[r[0]] for r in places.where(tells).select("term").collect())
    number = {t: i for i, t in enumerate(terms)}
    found = texts.select("_text").mapInArrow(_frequency_counts(number), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    frequency = {r[0]: r[1] for r in found}
    idf = [math.log((1 + frequency[-1]) / (1 + frequency.get(i, 0))) + 1 for i in range(len(terms))]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Terms(number)
        for batch in batches:
            rows = [list(found.vector(x or "").items()) for x in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_label"), pa.array([[t for t, _ in r] for r in rows], pa.list_(pa.int64())), pa.array([[x for _, x in r] for r in rows], pa.list_(pa.float64()))],
                names=["id", "label", "terms", "values"],
            )

    kept = staged(sample.mapInArrow(vectors, "id long, label long, terms array<long>, values array<double>"), "vectors")
    empty = kept.where(F.size("terms") == 0).agg(F.count(F.lit(1)), F.sum("label")).first()
    examples, weights = [], [1.0, 1.0]
    for label in (0, 1):
        some = kept.where((F.col("label") == label) & (F.size("terms") > 0))
        held = some.count()
        rows = some.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max_examples).collect()
        weights[label] = max(1.0, held / max(len(rows), 1))
        examples += [(r["id"], label, dict(zip(r["terms"], r["values"], strict=True))) for r in rows]
    rest = ((empty[1] or 0) + base) / (empty[0] + 1)
    discard(sample, counted, kept)
    return Model(number, idf, examples, (weights[0], weights[1]), rest)


NEAR = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("label", T.IntegerType())]))


def scored(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns to keep as _row, _score and _near, the evidence: doc_id, cosine and label of the neighbours."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the labelled rows and examples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
        for batch in batches:
            found = [shared.value.score(x or "") for x in batch.column("_text").to_pylist()]
            near = [[{"doc_id": d, "cosine": c, "label": y} for d, c, y in x[1]] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array([x[0] for x in found], pa.float64()), pa.array(near, kind)], names=["_row", "_score", "_near"])

    kept = docs.select(*[f"`{c}`" for c in docs.columns if keep is None or c in keep])
    rows = docs.select(packed(kept), docs["text"].alias("_text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["_row"], T.StructField("_score", T.DoubleType()), T.StructField("_near", NEAR)]))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return found.select(
        "_row.doc_id", (fold(F.col("_row.doc_id")) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"),
        F.transform("_near", lambda x: x["doc_id"]).alias("evidence"),
    )
