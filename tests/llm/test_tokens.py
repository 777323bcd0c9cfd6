import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from windrow.llm import packing, simple8b, token_files
from windrow.llm.queries import BYTE_BPE, WORD_BPE
from windrow.llm.tokens import TextEncoder, text_slices

from .conftest import edge_rows

TOKENIZERS = [BYTE_BPE, WORD_BPE]
_BITS = ["Àé", "ñoß,", "ab.", "ŉ", "ǅ", *"ab Z'.,0 19é\u0301ß\u0000\n\t\r\u00a0\u2003\U0001f600<|>/", "'s", "  ", " \n", "İ", "the ", "Σ", "\u0345"]
texts = st.lists(st.sampled_from(_BITS), max_size=60).map("".join)


@pytest.fixture(scope="module")
def encoders():
    out = []
    for path, _ in TOKENIZERS:
        out.append((TextEncoder(path), Tokenizer.from_file(path)))
    return out


def test_fixed_examples(encoders):
    """Letters that fold to a letter and a mark, before everything; strings of special tokens, in both cases."""
    batch = [f"{head}{mark}{tail}" for head in ("İ", "xİ", "İİ", "é", "ǰ") for mark in ",.\n!?;:-'" for tail in ("", "y", " y", "\n")]
    batch += ["x<|endoftext|>y", "<|ENDOFTEXT|>.", "a <|startoftext|>, b", "<|endoftext|>\nİ."]
    for encoder, plain in encoders:
        want = [plain.encode(t, add_special_tokens=False).ids for t in batch]
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(batch)] == want
    assert np.frombuffer(encoders[1][0].encode(["İ."])[0], "<u4").tolist() == [328, 136, 229, 269]
    assert 50256 in np.frombuffer(encoders[0][0].encode(["x<|endoftext|>y"])[0], "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.lists(texts, max_size=6))
def test_pieces_give_the_ids_of_the_whole_text(encoders, batch):
    for encoder, plain in encoders:
        want = [plain.encode(t, add_special_tokens=False).ids for t in batch]
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(batch)] == want


def test_runs_of_marks_are_taken_off(encoders):
    """The library's whole pipeline sees each run of marks once, not each word with marks behind it."""
    marks = ["***", ",***", "###", "$$$", "!!", "&&&,", "...", ")?"]
    batch = [" ".join(f"xr{a}{b}{m}" for m in marks for a in "abcdeß" for b in "fgh") + m for m in ("", "%%%", "'", "'s.")]
    for _, plain in encoders:
        encoder, calls = TextEncoder(BYTE_BPE[0] if plain is encoders[0][1] else WORD_BPE[0]), []
        whole = encoder.whole
        encoder.whole = lambda text: calls.append(text) or whole(text)
        want = [plain.encode(t, add_special_tokens=False).ids for t in batch]
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(batch)] == want
        assert len(calls) <= 2 * len(marks) + 8


def test_different_words_are_looked_up_once(encoders):
    """Not once for each place in the texts, nor for each mark behind them."""
    rows = ["".join(f" w{a}b{m}" for a in "acdeß" for m in (",", ".", "!!", "")) * 20] * 50
    for _, plain in encoders:
        encoder, asked = TextEncoder(BYTE_BPE[0] if plain is encoders[0][1] else WORD_BPE[0]), []
        kind = type(encoder.pieces)
        counted = type("Counted", (kind,), {"__getitem__": lambda self, p: asked.append(p) or kind.__getitem__(self, p)})
        encoder.pieces = counted(encoder, " ")
        encoder.starts = encoder.pieces if encoder.folds else kind(encoder, "")
        want = plain.encode(rows[0], add_special_tokens=False).ids
        assert all(np.frombuffer(b, "<u4").tolist() == want for b in encoder.encode(rows))
        assert len(asked) <= 10


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_slices_of_a_batch(encoders, kind):
    """Arrays that begin inside others; texts that go through the library whole among others; no text at all."""
    batch = ["x", "", "two words.", "a  b", "İ. x!", "é, ünd ß", "x<|endoftext|>y", "", "words! words, ", "\u0000 |a|. b|", "long " * 90, "z"]
    arrays = [pa.array(range(-1, len(batch))).slice(1), pa.array(["cut off", *batch], kind).slice(1)]
    rows = pa.RecordBatch.from_arrays(arrays, ["doc_id", "text"])
    for size in (1, 20, 1 << 20):
        slices = list(text_slices(rows, size))
        assert [n for numbers, _ in slices for n in numbers] == list(range(len(batch))) and (len(slices) == 1) == (size > 1000)
        for encoder, plain in encoders:
            got = [np.frombuffer(b, "<u4").tolist() for _, part in slices for b in encoder.encode(part)]
            assert got == [plain.encode(t, add_special_tokens=False).ids for t in batch]
    assert list(text_slices(rows.slice(0, 0), 1)) == [] and encoders[0][0].encode([]) == []


def test_whole_texts_of_the_table(spark, sf_dir, encoders, monkeypatch):
    monkeypatch.setattr(TextEncoder, "MAX_PIECES", 500)
    batch = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    batch.append("<|endoftext|> <|startoftext|>")
    for encoder, plain in encoders:
        for i in range(0, len(batch), 50):
            for t, b in zip(batch[i : i + 50], encoder.encode(batch[i : i + 50])):
                assert np.frombuffer(b, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


ints = st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1), st.sampled_from([0, 2**60 - 2, 2**60 - 1, 2**60, 2**53]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(ints, st.integers(1, 400)), max_size=20))
def test_simple8b_round_trip(runs):
    values = np.concatenate([np.full(n, v, np.uint64) for v, n in runs] or [np.zeros(0, np.uint64)])
    words, offsets, escapes = simple8b.pack(values)
    assert np.array_equal(simple8b.unpack(words, offsets, escapes, len(values)), values)


def test_simple8b_is_small():
    values = np.random.default_rng(1).integers(0, 4096, 100_000)
    assert len(simple8b.pack(values)[0]) <= 100_000 / 5 * 1.01
    assert len(simple8b.pack(np.zeros(1024))[0]) == 5


def expected(path, end_id, rows):
    plain = Tokenizer.from_file(path)
    
    return [(r[0], [*plain.encode(r[1] or "", add_special_tokens=False).ids, end_id]) for r in rows]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("segment", [200, token_files.SEGMENT_IDS])
def test_files_against_plain_encoding(spark, clashing_docs, monkeypatch, segment):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", segment)
    path, end = BYTE_BPE
    got = sorted(token_files.encode_and_read(clashing_docs, path, end).collect(), key=lambda r: r.start)
    want = expected(path, end, edge_rows())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((i is None, i or 0, len(x), crc(x)) for i, x in want)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids) and [r.doc_id for r in got][len(ids) :] == [None] * 3


def test_files_of_few_segments(spark, edge_docs, monkeypatch, tmp_path):
    """Several files for one task; ``start`` goes on from file to file."""
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 50)
    monkeypatch.setattr(token_files, "FILE_SEGMENTS", 1)
    token_files.write_token_files(edge_docs, f"{tmp_path}/t", *BYTE_BPE, partitions=2)
    files = [f.name for f in (tmp_path / "t").iterdir() if f.name.startswith("part-")]
    assert len(files) > 12
    rows = token_files.token_index(spark, f"{tmp_path}/t").collect()
    want = {}
    for i, ids in expected(*BYTE_BPE, edge_rows()):
        want.setdefault(i, []).append((len(ids), crc(ids)))
    assert {i: sorted(v) for i, v in want.items()} == {i: sorted((r.n_tokens, r.ids_crc32) for r in rows if r.doc_id == i) for i in want}
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id is None for r in rows] == sorted(r.doc_id is None for r in rows)
    numbered = [r.doc_id for r in rows if r.doc_id is not None]
    assert numbered == sorted(numbered) and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))


def test_files_go_by_number(spark):
    names = [f"part-{t:05d}-a1-2b-c{f:03d}.txt" for t in (7, 9999, 99_999, 100_000, 100_010) for f in (0, 2, 999, 1000)]
    shuffled = spark.createDataFrame([(n,) for n in sorted(names)], "file string")
    assert [r.file for r in shuffled.orderBy(*token_files.file_order()).collect()] == names


def test_broken_segment_is_noticed():
    good = token_files.segment_bytes([1], [np.arange(9, dtype="<u4").tobytes()]) + b"\n"
    assert [d for d, _, _ in token_files.read_segments(good)] == [[1]]
    for bad in (b"x" + good[1:], good[:-1] + b"x"):
        with pytest.raises(ValueError):
            list(token_files.read_segments(bad))


def brute_best_fit(lengths, window):
    rooms, at = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in rooms if r >= lengths[i]]
        if fits:
            rooms.remove(min(fits))
        room = min(fits) if fits else window
        at[i] = room
        if room - lengths[i]:
            rooms.append(room - lengths[i])
    return at


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 37), max_size=80))
def test_best_fit_decreasing(lengths):
    number, offset = packing.best_fit_decreasing(np.array(lengths, np.int64), 37)
    assert {i: 37 - o for i, o in enumerate(offset.tolist())} == brute_best_fit(lengths, 37)
    for w in set(number.tolist()):
        spans = sorted((o, n) for k, o, n in zip(number, offset, lengths) if k == w)
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0 and sum(spans[-1]) <= 37


@pytest.mark.parametrize("shard", [7, packing.SHARD_PIECES])
def test_packed_documents(spark, clashing_docs, shard):
    path, end = WORD_BPE
    packed = packing.pack_documents(clashing_docs, path, end, window=64, shard_pieces=shard, with_ids=True).collect()
    rows = [tuple(r) for r in packed]
    want = sorted((i is None, i or 0, s, len(x[s : s + 64]), crc(x[s : s + 64]), len(x)) for i, x in expected(path, end, edge_rows()) for s in range(0, len(x), 64))
    assert sorted((r[0] is None, r[0] or 0, *r[1:5]) for r in rows) == want
    by = {}
    for r in packed:
        assert crc(r.ids) == r.ids_crc32
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 64


def test_sequences_are_padded_but_at_a_power_of_two(spark):
    packed = spark.createDataFrame([(1, 0, 3, [7, 8, 9], 0), (2, 0, 1, [5], 3), (3, 0, 5, [1] * 5, 0)], "doc_id long, offset0 long, length long, ids array<int>, offset long")
    packed = packed.selectExpr("case when doc_id = 3 then 11 else 10 end AS sequence_id", "offset", "length", "ids")
    got = {r.sequence_id: (r.used, r.ids, r.starts) for r in packing.sequences(packed, 8).collect()}
    assert got == {10: (4, [7, 8, 9, 5], [0, 3]), 11: (5, [1] * 5 + [0] * 3, [0])}
    assert packing.padded_length(4, 8) == 4 and packing.padded_length(5, 8) == 8


def test_little_padding(spark):
    path, end = WORD_BPE
    packed = packing.pack_documents(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), path, end)
    used = [r.n for r in packed.groupBy("sequence_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()]
    assert sum(map(packing.padded_length, used)) <= 1.01 * sum(used)


def test_empty(no_docs):
    assert token_files.encode_and_read(no_docs, *BYTE_BPE).count() == 0
    assert packing.pack_documents(no_docs, *WORD_BPE).count() == 0
