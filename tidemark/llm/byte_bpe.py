"""Byte-level BPE encoding and decoding in linear time.

Bytes are mapped to Latin-1 characters, so an Aho-Corasick automaton over strings
finds every vocabulary entry in a piece in one pass. Encoding takes the longest
entry at each place and steps back to shorter ones where it does not fit. Whether
two entries may stand side by side is decided by undoing their merges, latest
first, and looking for a merge across the border that would have come earlier; the
answers are memoised. A sequence whose neighbours all fit is the one that the
merges give, and it is the only one, so a place that has failed once is never
tried again: the time is linear in the piece.

Texts are split by the pattern first, and each match is encoded by itself. A null
text is an empty one and has no ids. Any text round-trips. Repeated rows are encoded each;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches, packed, table, tokenizer_path

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern again, for texts of ASCII only, which `re` matches faster.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Entries that a worker remembers at most; beyond that it starts anew.
KNOWN_PIECES, KNOWN_PAIRS = 300_000, 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(piece: bytes, ranks: dict[bytes, int], parts: int = 1) -> list[bytes]:
    """The merges done one by one, in quadratic time, down to so many parts."""
    out = [piece[i : i + 1] for i in range(len(piece))]
    while len(out) > parts:
        best = min(range(len(out) - 1), key=lambda i: ranks.get(out[i] + out[i + 1], 1 << 30))
        if out[best] + out[best + 1] not in ranks:
            break
        out[best : best + 2] = [out[best] + out[best + 1]]
    return out


def _public_pattern() -> str | None:
    try:
        from public_tokenizers import PATTERN
    except ModuleNotFoundError:
        return None
    return PATTERN


class ByteBpe:
    """Encodes and decodes by a file of ranks and a pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.entries = [b""] * (max(ranks.values()) + 1)
        self.halves: dict[int, tuple[int, int]] = {}
        self.finder = ahocorasick.Automaton()
        for entry, rank in ranks.items():
            self.entries[rank] = entry
            if len(entry) > 1:
                halves = merged(entry, ranks, 2)
                if len(halves) > 2:
                    continue  # no merges make it
                self.halves[rank] = (ranks[halves[0]], ranks[halves[1]])
            self.finder.add_word(entry.decode("latin-1"), rank)
        self.finder.make_automaton()
        self.sizes = [len(x) for x in self.entries]
        self.split = regex.compile(pattern).findall
        # the ASCII form stands for the public pattern alone
        self.split_ascii = re.compile(ASCII_PATTERN, re.ASCII).findall if pattern == _public_pattern() else self.split
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two neighbours."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= KNOWN_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        before = 1 << 30  # a merge across counts if its rank is below this
        while True:
            if self.ranks.get(self.entries[left] + self.entries[right], before) < before:
                return False
            # Undo the later merge. Of equal ranks the left one is done first, so the right one is the later.
            undo = [x for x in (left, right) if x in self.halves]
            if not undo:
                return True
            if left in self.halves and (right not in self.halves or left > right):
                before, left = left, self.halves[left][1]
            else:
                before, right = right + 1, self.halves[right][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        sizes, end = self.sizes, len(piece)
        begun: list[list[int]] = [[] for _ in range(end + 1)]
        for last, entry in self.finder.iter(piece.decode("latin-1")):
            begun[last + 1 - sizes[entry]].append(entry)  # shortest first
        failed = bytearray(end + 1)
        out: list[int] = []
        at, untried = 0, [len(begun[0])]
        while at < end:
            k = untried[-1] - 1
            while k >= 0 and (failed[at + sizes[begun[at][k]]] or out and not self.fits(out[-1], begun[at][k])):
                k -= 1
            if k >= 0:
                untried[-1] = k
                out.append(begun[at][k])
                at += sizes[out[-1]]
                untried.append(len(begun[at]))
            else:
                failed[at] = 1
                untried.pop()
                at -= sizes[out.pop()]
        return out

    def _new_piece(self, piece: str) -> bytes:
        if len(self.pieces) >= KNOWN_PIECES:
            self.pieces.clear()
        ids = b"".join(x.to_bytes(4, "little") for x in self.encode_piece(piece.encode()))
        if len(piece) <= 64:
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        known, new = self.pieces.get, self._new_piece
        split = self.split_ascii if text.isascii() else self.split
        return b"".join([known(x) or new(x) for x in split(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.entries.__getitem__, memoryview(ids).cast("I").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    """One for each worker, made when first used."""
    return ByteBpe(read_ranks(path), pattern)


def _encoder(path: str, pattern: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            counts, first, second = [], [], []
            for text in batch.column("_text").to_pylist():
                ids = bpe.encode(text or "")
                counts.append(len(ids) // 4)
                first.append(hashlib.sha256(ids).hexdigest() if digests else memoryview(ids).cast("I").tolist())
                second.append(hashlib.sha256(bpe.decode(ids)).hexdigest() if digests else bpe.decode(ids).decode())
            kind = pa.string() if digests else pa.list_(pa.int32())
            arrays = [batch.column("_row"), pa.array(counts, pa.int64()), pa.array(first, kind), pa.array(second, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["_row", "_n", "_ids", "_decoded"])

    return run


def encoded(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, digests: bool = False, keep: list[str] | None = None) -> DataFrame:
    """The columns to keep as _row, _n, _ids and _decoded: ids and decoded text, or their SHA-256."""
    from public_tokenizers import PATTERN

    bounded_batches(docs.sparkSession)
    kept = docs.select(*[f"`{c}`" for c in docs.columns if keep is None or c in keep])
    rows = docs.select(packed(kept), docs["text"].alias("_text"))
    kind = T.StringType() if digests else T.ArrayType(T.IntegerType())
    schema = T.StructType([rows.schema["_row"], T.StructField("_n", T.LongType()), T.StructField("_ids", kind), T.StructField("_decoded", T.StringType())])
    return rows.mapInArrow(_encoder(vocabulary or tokenizer_path(VOCABULARY), pattern or PATTERN, digests), schema)


def encoded_documents(docs: DataFrame) -> DataFrame:
    """docs with n_tokens and token_ids in place of columns of these names."""
    old = [c for c in docs.columns if c not in ("n_tokens", "token_ids")]
    found = encoded(docs, keep=old)
    return found.select("_row.*", F.col("_n").alias("n_tokens"), F.col("_ids").alias("token_ids"))


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    found = encoded(table(spark, sf_dir, "documents"), digests=True, keep=["doc_id"])
    return found.select("_row.doc_id", F.col("_n").alias("n_tokens"), F.col("_ids").alias("ids_sha256"), F.col("_decoded").alias("decoded_sha256"))
