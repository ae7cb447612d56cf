import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tests.llm.helpers import frame, odd
from tidemark.llm.byte_bpe import VOCABULARY, codec, encoded, encoded_documents, merged

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def pair():
    ours = codec(public_tokenizers.path(VOCABULARY), PATTERN)
    return ours, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ours.ranks, special_tokens={})


def ids(ours, text):
    return memoryview(ours.encode(text)).cast("I").tolist()


def test_like_the_merges(pair):
    ours, theirs = pair
    r = random.Random(2)
    texts = ["", "a" * 5000, "=" * 3001, " \n\t " * 50, "ab" * 3000, "the theatre's don't I'LL <|endoftext|>"]
    texts += ["".join(r.choice("aaab cdetsr'\n\t .,!-=012éüß漢🙂\x00\x1c ") for _ in range(r.randint(0, 80))) for _ in range(3000)]
    texts += ["".join(chr(r.choice([r.randint(32, 126), r.randint(160, 0x2FF), r.randint(0x4E00, 0x4F00)])) for _ in range(40)) for _ in range(500)]
    for text in texts:
        assert ids(ours, text) == theirs.encode_ordinary(text), text
        assert ours.decode(ours.encode(text)).decode() == text


def test_a_piece_by_naive_merges(pair):
    ours, _ = pair
    r = random.Random(3)
    for _ in range(300):
        piece = bytes(r.choice(b"aeinorst") for _ in range(r.randint(1, 40)))
        assert ours.encode_piece(piece) == ([ours.ranks[piece]] if piece in ours.ranks else [ours.ranks[p] for p in merged(piece, ours.ranks)])


def test_caches_are_bounded(pair, monkeypatch):
    ours, theirs = pair
    monkeypatch.setattr("tidemark.llm.byte_bpe.KNOWN_PIECES", 3)
    monkeypatch.setattr("tidemark.llm.byte_bpe.KNOWN_PAIRS", 3)
    text = " ".join(f"wordlike{i}" for i in range(50))
    assert ids(ours, text) == theirs.encode_ordinary(text) and len(ours.pieces) <= 3


def test_another_pattern_holds_for_ascii_texts():
    from tidemark.llm.byte_bpe import ByteBpe

    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256}
    assert ByteBpe(ranks, r".").encode("ab") == b"a\0\0\0b\0\0\0"
    assert ByteBpe(ranks, public_tokenizers.PATTERN).encode("ab") == (256).to_bytes(4, "little")


def test_odd_rows(spark, pair):
    ours, _ = pair
    df = odd(spark)
    found = encoded(df, digests=True, keep=["doc_id", "text"]).collect()
    assert len(found) == df.count()
    for r in found:
        text = r._row.text or ""
        assert r._n == len(ids(ours, text)) and r._ids == hashlib.sha256(ours.encode(text)).hexdigest() and r._decoded == hashlib.sha256(text.encode()).hexdigest()
    assert encoded_documents(df).columns == [*df.columns, "n_tokens", "token_ids"]
    assert encoded(frame(spark, [])).count() == 0
