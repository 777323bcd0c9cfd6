"""Periodic runs of words: every maximal repetition of a text, from longest common extensions.

A run is a stretch of words with smallest period q, of max(``LEAST``, 2q) words at least, that neither neighbour extends.

*Extensions.* ``Extensions`` answers how many words two places have in common from there on. It sorts only the suffixes
that start in a difference cover: of any two places, both reach such a place after the same number of words, below ``COVER``.
So a question compares these few words, and the rest is a range minimum over the common lengths of neighbours in the
sorted sample, from a sparse table.

*Enumeration.* A run of period q holds two neighbours of the grid 0, q, 2q, ... in its first 2q words. So for each q the
pairs of neighbours with equal words are extended to both sides (backwards by the same structure over the reversed
words), n/q pairs for q, which is harmonic over all q. A stretch found with several periods has the least of them.

Texts are worked off together, with a separator of its own after each, about ``BATCH_WORDS`` words at a time; a longer text
is a batch of its own, and its grid is asked in steps. Nothing is shuffled; a text is worked off in one task, in memory
that is a fixed multiple of its size.

A null text has no words and no runs. Rows are independent: ties, repeated rows and null doc_ids need no rule.
"""

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import text_of

#: Words in the shortest run.
LEAST = 12
#: A perfect difference set: of any two residues, some shift below 13 moves both into it.
COVER, RESIDUES = 13, (0, 1, 3, 9)
BATCH_WORDS = 100_000
#: Pairs of the grid that are looked at together.
STEP = 500_000

_IN_COVER = np.isin(np.arange(COVER), RESIDUES)
#: Words after which both residues are in the cover.
_SHIFT = np.array([[next(d for d in range(COVER) if _IN_COVER[(a + d) % COVER] and _IN_COVER[(b + d) % COVER]) for b in range(COVER)] for a in range(COVER)])


def _ranks(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by several keys, the first one first, and dense ranks; equal rows share one."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


class Extensions:
    """Longest common extensions to the right in an array of non-negative numbers."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        # beyond the end every place differs from every other
        past = int(words.max(initial=0)) + 1
        self.words = np.concatenate([words.astype(np.int64), past + np.arange(2 * COVER)])
        self.table: list[np.ndarray] | None = None

    def _prepare(self) -> None:
        """Sort the sampled suffixes, and the range minima over the common lengths of neighbours."""
        places = np.flatnonzero(_IN_COVER[np.arange(self.n) % COVER])
        m = len(places)
        # the first COVER words of each, packed into as few numbers as they fit
        bits = int(self.words.max()).bit_length()
        per_key = max(1, 63 // bits)
        keys = []
        for start in range(0, COVER, per_key):
            key = np.zeros(m, np.int64)
            for d in range(start, min(start + per_key, COVER)):
                key = (key << bits) | self.words[places + d]
            keys.append(key)
        order, rank = _ranks(keys)
        # then double: COVER words later there is a sampled place again, len(RESIDUES) further on
        levels = [rank]
        reach = len(RESIDUES)
        while m and rank.max() < m - 1:
            after = np.full(m, -1, np.int64)
            after[: m - reach] = rank[reach:] if reach < m else []
            order, rank = _ranks([rank, after])
            levels.append(rank)
            reach *= 2
        # common length of neighbours: by equal ranks of halving lengths, then word by word
        x, y = order[:-1].copy(), order[1:].copy()
        for k in reversed(range(len(levels) - 1)):
            step = len(RESIDUES) << k
            inside = np.maximum(x, y) < m
            same = np.zeros(len(x), bool)
            same[inside] = levels[k][x[inside]] == levels[k][y[inside]]
            x[same] += step
            y[same] += step
        ends = np.append(places, self.n)
        base = places[order[:-1]]
        start_x, start_y = ends[np.minimum(x, m)], ends[np.minimum(y, m)]
        lengths = start_x - base + self._compared(start_x, start_y, np.full(len(base), COVER))
        self.index = np.full(self.n + COVER, -1, np.int64)
        place_rank = np.empty(m, np.int64)
        place_rank[order] = np.arange(m)
        self.index[places] = place_rank
        self.table = [lengths]
        width = 1
        while 2 * width <= len(lengths):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def _compared(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from places i and j on, ``most`` at most."""
        out = np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        for d in range(int(most.max(initial=0))):
            live = live[most[live] > d]
            live = live[(i[live] != j[live]) & (self.words[i[live] + d] == self.words[j[live] + d])]
            if not len(live):
                break
            out[live] += 1
        return out

    def lengths(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common extension of each pair of different places."""
        few = _SHIFT[i % COVER, j % COVER]
        # a place past the end has nothing in common with any
        out = self._compared(i, j, few)
        on = np.flatnonzero((out == few) & (np.maximum(i, j) + few < self.n))
        if not len(on):
            return out
        if self.table is None:
            self._prepare()
        a, b = self.index[i[on] + few[on]], self.index[j[on] + few[on]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = level == k
            out[on[at]] += np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << int(k))])
        return out


def _grid(starts: np.ndarray, counts: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Neighbours of every grid inside each text: places i, i + q, and q; about ``STEP`` pairs at a time."""
    by_size = np.argsort(-counts, kind="stable")
    starts, counts = starts[by_size], counts[by_size]
    found, held = [], 0
    for q in range(1, int(counts.max(initial=0)) // 2 + 1):
        # a run of period q has 2q and ``least`` words at least
        own = int(np.searchsorted(-counts, -max(2 * q, least), side="right"))
        if not own:
            break
        per_text = (counts[:own] - 1) // q
        total = int(per_text.sum())
        first = np.cumsum(per_text) - per_text
        i = np.repeat(starts[:own] - first * q, per_text) + np.arange(total) * q
        found.append((i, i + q, q))
        held += total
        if held >= STEP:
            yield _joined(found)
            found, held = [], 0
    if found:
        yield _joined(found)


def _joined(found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = [len(i) for i, _, _ in found]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), np.repeat([f[2] for f in found], sizes)


def runs_of(texts: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """All runs of each text of word numbers: rows of start, length, period, by start, then period."""
    counts = np.array([len(t) for t in texts], np.int64)
    # a separator of its own after each text, so that nothing extends over its end
    words = np.empty(int(counts.sum()) + len(texts), np.int64)
    starts = np.cumsum(counts + 1) - counts - 1
    top = max((int(t.max(initial=0)) for t in texts), default=0) + 1
    for k, (s, t) in enumerate(zip(starts.tolist(), texts)):
        words[s : s + len(t)] = t
        words[s + len(t)] = top + k
    forward, backward = Extensions(words), Extensions(words[::-1])
    last = len(words) - 1
    found = [np.zeros((0, 3), np.int64)]
    for i, j, q in _grid(starts, counts, least):
        same = words[i] == words[j]
        i, j, q = i[same], j[same], q[same]
        right = forward.lengths(i, j)
        left = backward.lengths(last - i, last - j)
        length = right + left - 1 + q
        long = length >= np.maximum(least, 2 * q)
        found.append(np.unique(np.stack([i[long] - left[long] + 1, length[long], q[long]], 1), axis=0))
    every = np.concatenate(found)
    # of one stretch the least period
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    new = np.ones(len(every), bool)
    new[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
    every = every[new]
    every = every[np.lexsort((every[:, 2], every[:, 0]))]
    text = np.searchsorted(starts, every[:, 0], side="right") - 1
    every[:, 0] -= starts[text]
    return np.split(every, np.searchsorted(text, np.arange(1, len(texts)))) if len(texts) else []


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay when every run keeps its first period only, unless another run drops that too."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:n]) == 0


def _batches(rows: Iterator[tuple], words: int = BATCH_WORDS) -> Iterator[list[tuple]]:
    held, size = [], 0
    for row in rows:
        if held and size + len(row[1]) > words:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row[1])
    if held:
        yield held


def repeated(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten with a periodic end, whose place and period follow from the doc_id."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times = -(-(n - a) // p)
    return words[:a] + (words[a : a + p] * times)[: n - a]


def _numbered(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers."""
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


_COLUMNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _found(batches, least, change, finish):
    """Rows of ``finish(doc_id, words, runs)`` for each row of Arrow batches of doc_id and text."""

    def rows():
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary())):
                    # bytes are split at the six blanks of the word pattern
                    words = text.as_buffer().to_pybytes().split()
                    yield doc_id, change(doc_id, words) if change else words

    for held in _batches(rows()):
        runs = runs_of([_numbered(w) for _, w in held], least)
        yield [finish(doc_id, words, own) for (doc_id, words), own in zip(held, runs)]


def word_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per run: doc_id, start, length, period, in words of the whole text. No shuffle."""

    def spread(batches):
        for rows in _found(batches, least, None, lambda doc_id, words, runs: (doc_id, runs)):
            ids = [doc_id for doc_id, runs in rows for _ in range(len(runs))]
            every = np.concatenate([runs for _, runs in rows])
            columns = [pa.array(ids, pa.int64()), *(pa.array(every[:, k]) for k in range(3))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "period"])

    return _rows(docs).mapInArrow(spread, "doc_id long, start long, length long, period long")


def collapse_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, text: the words joined by one space, without what any run repeats after its first period. No shuffle."""

    def collapsed(doc_id, words, runs):
        return doc_id, _collapsed(words, runs)

    def spread(batches):
        for rows in _found(batches, least, None, collapsed):
            ids, texts = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return _rows(docs).mapInArrow(spread, "doc_id long, text string")


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    if not len(runs):
        return b" ".join(words)
    return b" ".join([words[k] for k in np.flatnonzero(kept_words(len(words), runs)).tolist()])


def run_digests(docs: DataFrame, change=None, least: int = LEAST) -> DataFrame:
    """One row per document: the number of its runs, the longest one, and digests of all runs and of the collapsed text.

    Of runs of equal length the one with the least start counts, then the least period; without a run its columns are
    null. ``change(doc_id, words)`` may replace the words before. No shuffle.
    """

    def finish(doc_id, words, runs):
        best = [None] * 4
        if len(runs):
            start, length, period = runs[int(np.argmax(runs[:, 1]))].tolist()
            best = [start, length, period, 1000 * length // period]
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
        return doc_id, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(_collapsed(words, runs)).hexdigest()

    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    types = [pa.int64()] * 6 + [pa.string()] * 2

    def described(batches):
        for rows in _found(batches, least, change, finish):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return _rows(docs).mapInArrow(described, _COLUMNS)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
