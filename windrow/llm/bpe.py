"""Byte-level BPE from a file of ranks, encoded by longest matches and backtracking, and decoded.

The bytes of the vocabulary are Latin-1 strings in an Aho-Corasick automaton, which finds every token at every place of a
piece in one pass. An encoding is then put together from the left: the longest token first, a shorter one if it is not
compatible with the token before it, and one token back if none is. Merging gives a row of tokens exactly when each two
neighbours are compatible, and every prefix of a piece has one such row only; so a place from which nothing went on is
never tried again, and the time is linear in the piece however long it is.

Two tokens are compatible if merging the bytes of both leaves the border between them. What touches the border at any time is
the right edge of the first token in one of its states, and the left edge of the second; they join if that merge has
its turn before either of them is merged away from the border. Answers are remembered per pair. That holds for ranks that
are an order of merges, as vocabularies have them; a token that merging its own bytes does not make is an error.

The text is first cut by a pattern and each match is encoded on its own, and a match that is a token as it is stays whole.
A null text is an empty one: no ids. Rows are independent: ties, repeated rows and null doc_ids need no rule. A very long text
is worked off a hundred thousand matches at a time.
"""

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import text_of

#: Texts above so many characters are cut by the pattern step by step.
LONG_TEXT = 1 << 20
_STEP = 100_000
#: Remembered pieces and pairs; beyond that those not asked for lately are forgotten and found anew.
MAX_PIECES, MAX_PAIRS = 400_000, 400_000
_NEVER = 1 << 62


class _Remembered(dict):
    """Answers of ``find`` by key: the last ``most`` asked for, and up to as many that were asked for before them."""

    def __init__(self, find, most: int):
        super().__init__()
        self.find, self.most, self.older = find, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.find(key)
        self[key] = value
        return value


class RankedBPE:
    """The tokens of one vocabulary, in the order of their merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no token for bytes {missing}")
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.digits_of = {i: str(i) for i in self.bytes_of}
        self.size_of = {i: len(b) for i, b in self.bytes_of.items()}
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for raw, i in ranks.items():
            self.automaton.add_word(raw.decode("latin-1"), i)
        self.automaton.make_automaton()
        every = len(ranks) + 1
        self.halves = _Remembered(self._halves, every)
        self.shorter = _Remembered(self._shorter, every)
        self.edges = _Remembered(self._edges, every)
        self.compatible = _Remembered(self._compatible, MAX_PAIRS)
        self.pieces = _Remembered(self._piece, MAX_PIECES)

    # ---- the vocabulary

    def _halves(self, token: int) -> tuple[int, int] | tuple[()]:
        """The two tokens whose merge makes ``token``; () for a byte."""
        raw = self.bytes_of[token]
        if len(raw) == 1:
            return ()
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 2:
            turns = [self.ranks.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
            first = min(turns)
            if first >= token:
                raise ValueError(f"merging the bytes of {raw!r} does not make token {token}")
            at = turns.index(first)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``; -1 if there is none."""
        raw = self.bytes_of[token]
        for n in range(len(raw) - 1, 0, -1):
            found = self.ranks.get(raw[:n])
            if found is not None:
                return found
        return -1

    def _edges(self, token: int) -> tuple[list, list]:
        """What lies at the left and at the right end of ``token`` while it is made: (bytes, from which turn, to which)."""
        out = []
        for side in (0, 1):
            spine, end, now = [], _NEVER, token
            while True:
                parts = self.halves[now]
                spine.append((self.bytes_of[now], now if parts else -1, end))
                if not parts:
                    break
                end, now = now, parts[side]
            out.append(spine)
        return out[0], out[1]

    def _compatible(self, pair: tuple[int, int]) -> bool:
        for x, x_from, x_to in self.edges[pair[0]][1]:
            for y, y_from, y_to in self.edges[pair[1]][0]:
                turn = self.ranks.get(x + y)
                # of equal merges the left one goes first: the first token's own comes before, the second's after
                if turn is not None and x_from < turn < x_to and y_from < turn <= y_to:
                    return False
        return True

    # ---- encoding

    def _piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        return (whole,) if whole is not None else tuple(self.encode_bytes(raw))

    def longest(self, raw: bytes) -> list[int]:
        """The longest token that starts at each place."""
        out, size_of = [0] * (len(raw) + 1), self.size_of
        for end, token in self.automaton.iter(raw.decode("latin-1")):
            # matches come by their ends, so a longer one from the same place comes later
            out[end + 1 - size_of[token]] = token
        return out

    def encode_bytes(self, raw: bytes) -> list[int]:
        """The ids that merging gives, without merging."""
        if not raw:
            return []
        starts, size_of, compatible = self.longest(raw), self.size_of, self.compatible
        dead: set[int] = set()
        token, last, at, n = starts[0], None, 0, len(raw)
        out: list[int] = []
        while True:
            end = at + size_of[token]
            if end not in dead and (last is None or compatible[last, token]):
                out.append(token)
                if end == n:
                    return out
                at, last, token = end, token, starts[end]
                continue
            token = self.shorter[token]
            while token < 0:
                # nothing goes on from here: one token back, and a shorter one in its place
                dead.add(at)
                token = out.pop()
                at -= size_of[token]
                token = self.shorter[token]
                last = out[-1] if out else None

    def encode_parts(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, in one list or, of a very long text, in several."""
        pieces = self.pieces
        if len(text) <= LONG_TEXT:
            yield [i for p in self.pattern.findall(text) for i in pieces[p]]
            return
        matches = self.pattern.finditer(text)
        while step := [m.group() for m in islice(matches, _STEP)]:
            yield [i for p in step for i in pieces[p]]

    def encode(self, text: str) -> list[int]:
        return [i for part in self.encode_parts(text) for i in part]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def ranked_bpe(path: str, pattern: str) -> RankedBPE:
    """One for each Python worker. The file has a line for each token: its bytes in base64, and its rank."""
    with open(path, "rb") as file:
        lines = [line.split() for line in file.read().splitlines() if line.strip()]
    return RankedBPE({base64.b64decode(raw): int(rank) for raw, rank in lines}, pattern)


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[list[list]]:
    for start in range(0, batch.num_rows, rows):
        yield [c.to_pylist() for c in batch.slice(start, rows).columns]


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids of every row. No shuffle."""

    def encoded(batches):
        for batch in batches:
            for doc_ids, texts in _slices(batch):
                codec = ranked_bpe(path, pattern)
                ids = pa.array([codec.encode(t) for t in texts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), ids], ["doc_id", "ids"])

    return _rows(docs).mapInArrow(encoded, "doc_id long, ids array<int>")


def decode_ids(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, raw (the bytes) of rows with ``ids``; null ids are none."""

    def decoded(batches):
        for batch in batches:
            for doc_ids, ids in _slices(batch):
                codec = ranked_bpe(path, pattern)
                raw = pa.array([codec.decode(i or []) for i in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), raw], ["doc_id", "raw"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(decoded, "doc_id long, raw binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Every text encoded and its ids decoded, as digests: doc_id, n_tokens, ids_sha256, decoded_sha256. No shuffle.

    The ids are hashed as decimal numbers joined by one space. They are handed over part by part and need no column of
    their own, so that a very long text takes no more room than itself.
    """

    def both(batches):
        for batch in batches:
            for doc_ids, texts in _slices(batch):
                codec = ranked_bpe(path, pattern)
                out = []
                for text in texts:
                    n, written, back = 0, hashlib.sha256(), hashlib.sha256()
                    for ids in codec.encode_parts(text):
                        if n and ids:
                            written.update(b" ")
                        n += len(ids)
                        written.update(" ".join(map(codec.digits_of.__getitem__, ids)).encode())
                        back.update(codec.decode(ids))
                    out.append((n, written.hexdigest(), back.hexdigest()))
                n, written, back = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(written), pa.array(back)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return _rows(docs).mapInArrow(both, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
