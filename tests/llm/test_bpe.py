import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from windrow.llm import bpe
from windrow.llm.queries import BYTE_RANKS, op12_byte_bpe

from .conftest import edge_rows

PATTERN = public_tokenizers.PATTERN
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def library(path):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.ranked_bpe(path, PATTERN).ranks, special_tokens={})


def merged(raw, ranks):
    """Plain merging: the lowest rank first, the leftmost of equal ones."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while len(parts) > 1:
        turns = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        if min(turns) == 1 << 60:
            break
        at = turns.index(min(turns))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
@pytest.mark.parametrize("path", [BYTE_RANKS, MULTI])
def test_any_text(path, text):
    codec = bpe.ranked_bpe(path, PATTERN)
    assert codec.encode(text) == library(path).encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text.encode()


@pytest.mark.parametrize("path", [BYTE_RANKS, MULTI])
def test_merges_of_bytes(path):
    """Pieces without a pattern, where tokens meet in every way."""
    codec, rng = bpe.ranked_bpe(path, PATTERN), random.Random(4)
    for alphabet in (b"ab", b"etaoins ", b"THEthe ", b" \n\t=-", bytes(range(256)), "éüñß中😀".encode()):
        for n in (1, 2, 3, 10, 60, 200):
            for _ in range(20):
                raw = bytes(rng.choice(alphabet) for _ in range(n))
                assert codec.encode_bytes(raw) == merged(raw, codec.ranks)


def test_made_up_vocabularies():
    """Merges at random on two letters, for much backtracking; every token is what merging its bytes gives."""
    rng = random.Random(9)
    for _ in range(60):
        ranks = {bytes([b]): b for b in range(256)}
        tokens = [b"a", b"b"]
        while len(ranks) < 256 + 20:
            new = rng.choice(tokens) + rng.choice(tokens)
            if new not in ranks and len(merged(new, ranks)) == 2:
                ranks[new] = len(ranks)
                tokens.append(new)
        codec = bpe.RankedBPE(ranks, PATTERN)
        for _ in range(60):
            raw = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40)))
            assert codec.encode_bytes(raw) == merged(raw, ranks)


def test_token_without_merges():
    codec = bpe.RankedBPE({bytes([b]): b for b in range(256)} | {b"abc": 256}, PATTERN)
    with pytest.raises(ValueError, match="does not make token 256"):
        codec.encode("xabcx")


def test_every_character():
    """The pattern cuts at the same characters as the library does."""
    codec, other = bpe.ranked_bpe(BYTE_RANKS, PATTERN), library(BYTE_RANKS)
    for first in range(0, 0x30000, 16):
        text = "".join(f"a{c}b {c} 1{c}2{c}" for c in map(chr, range(first, first + 16)) if not "\ud800" <= c < "")
        assert codec.encode(text) == other.encode_ordinary(text)


def test_long_pieces_and_texts(monkeypatch):
    codec, other, rng = bpe.ranked_bpe(BYTE_RANKS, PATTERN), library(BYTE_RANKS), random.Random(2)
    for text in ("a" * 100_000, "ab" * 50_000, " " * 30_000, "".join(rng.choice("etaoin") for _ in range(100_000))):
        assert codec.encode(text) == other.encode_ordinary(text)
    text = "".join(rng.choice(["a", " the", "  ", "\n", "1", "'s", "é"]) for _ in range(5_000))
    monkeypatch.setattr(bpe, "LONG_TEXT", 100)
    monkeypatch.setattr(bpe, "_STEP", 7)
    assert len(list(codec.encode_parts(text))) > 100
    assert codec.encode(text) == other.encode_ordinary(text)


def test_forgetting():
    """Answers are the same when little is remembered."""
    codec, other = bpe.RankedBPE(library(BYTE_RANKS)._mergeable_ranks, PATTERN), library(BYTE_RANKS)
    for remembered in (codec.pieces, codec.compatible, codec.halves, codec.edges, codec.shorter):
        remembered.most = 3
    for _, text, *_ in edge_rows()[:60]:
        assert codec.encode(text or "") == other.encode_ordinary(text or "")


def test_bytes_without_a_token():
    with pytest.raises(ValueError, match="no token for bytes"):
        bpe.RankedBPE({b"a": 0}, PATTERN)


def wanted(rows, path=BYTE_RANKS):
    other, out = library(path), Counter()
    for r in rows:
        ids = other.encode_ordinary(r[1] or "")
        digests = [hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), (r[1] or "").encode())]
        out[r[0], len(ids), *digests] += 1
    return out


def test_edge_rows(clashing_docs):
    assert Counter(map(tuple, bpe.digests(clashing_docs, BYTE_RANKS, PATTERN).collect())) == wanted(edge_rows())


def test_encode_and_decode(clashing_docs):
    ids = bpe.encode_texts(clashing_docs, BYTE_RANKS, PATTERN)
    back = Counter((r.doc_id, bytes(r.raw)) for r in bpe.decode_ids(ids, BYTE_RANKS, PATTERN).collect())
    assert back == Counter((r[0], (r[1] or "").encode()) for r in edge_rows())


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert Counter(map(tuple, op12_byte_bpe(spark, sf_dir).collect())) == wanted(rows)


def test_empty(no_docs):
    assert bpe.digests(no_docs, BYTE_RANKS, PATTERN).collect() == []
    assert bpe.encode_texts(no_docs, BYTE_RANKS, PATTERN).collect() == []
