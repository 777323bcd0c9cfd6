"""Toxicity: bags of subword embeddings, averaged, under a linear softmax.

A text is all character n-grams (3 to 6, with the borders of words) of its lower-cased words. Each n-gram has an embedding in a
hashed table; the average over the text goes through a linear layer with two outputs. Table and layer are trained jointly
in numpy, so a misspelling that was never seen shares most n-grams, and so its score, with the word it comes from.

The model is fitted on the driver on a bounded sample of labelled rows (``MAX_TOXIC``, ``MAX_CLEAN``, whole texts of up to
``MAX_TRAIN_CHARS``), weighted back to the shares of the classes. Every whole text is scored. As the layers are linear, the
score needs one number per n-gram, and that table of 1 MB is what goes to the executors.

Null texts are empty; a text without n-grams has the score of the bias. Labels other than 0 and 1, and null doc_ids, are
not learned from. A doc_id that repeats in ``labels`` counts by its greatest label. Without rows of both classes all
scores are the share of toxic rows.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import text_of

BUCKETS = 1 << 18
DIMENSIONS = 8
LENGTHS = (3, 4, 5, 6)
MAX_TOXIC, MAX_CLEAN = 1500, 3000
MAX_TRAIN_CHARS = 20_000
EPOCHS, BATCH, RATE = 10, 64, 0.6

U32 = np.uint32


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, blanks and ASCII marks as blanks, a blank around each; and where each text ends."""
    points = np.frombuffer("".join(f" {t.lower()} " for t in texts).encode("utf-32-le"), U32).copy()
    letter = (points >= 128) | ((points >= 48) & (points < 58)) | ((points >= 97) & (points < 123))
    points[~letter] = 32
    return points, np.cumsum([len(t.lower()) + 2 for t in texts])


def _ngrams(points: np.ndarray):
    """For each length: bucket of the n-gram at each place, and whether it lies within a word (and its borders)."""
    blank = points == 32
    blanks = np.concatenate([[0], np.cumsum(blank)])
    rolled = points * U32(0x01000193)
    for n in range(2, max(LENGTHS) + 1):
        if len(points) < n:
            return
        rolled = rolled[: len(points) - n + 1] * U32(0x85EBCA6B) + points[n - 1 :]
        if n in LENGTHS:
            inside = blanks[n - 1 : len(points)] == blanks[1 : len(points) - n + 2]
            h = rolled ^ (rolled >> U32(15))
            h = h * U32(0x2C1B3C6D)
            h ^= h >> U32(13)
            yield n, h & U32(BUCKETS - 1), inside


@dataclass
class Model:
    """One weight per bucket (embedding times layer) and the bias."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        points, ends = _characters(texts)
        starts = np.concatenate([[0], ends[:-1]])
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for n, bucket, inside in _ngrams(points):
            sums = np.concatenate([[0.0], np.cumsum(np.where(inside, self.weights[bucket], 0), dtype=np.float64)])
            counts = np.concatenate([[0], np.cumsum(inside)])
            # n-grams across two texts hold two blanks, so they are not inside
            last = np.maximum(np.minimum(ends - n + 1, len(bucket)), np.minimum(starts, len(bucket)))
            first = np.minimum(starts, len(bucket))
            total += sums[last] - sums[first]
            count += counts[last] - counts[first]
        logits = np.clip(total / np.maximum(count, 1) + self.bias, -30, 30)
        return 1 / (1 + np.exp(-logits))


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    points, _ = _characters([text])
    found = [bucket[inside] for _, bucket, inside in _ngrams(points)]
    ids, counts = np.unique(np.concatenate(found or [np.zeros(0, U32)]), return_counts=True)
    return ids.astype(np.int32), (counts / max(counts.sum(), 1)).astype(np.float32)


def train(texts: list[str], labels: list[int], weights: list[float], seed: int = 1) -> Model:
    """Embeddings and layer by Adagrad on the weighted cross entropy."""
    rng = np.random.default_rng(seed)
    bags = [_bag(t) for t in texts]
    y, weight = np.array(labels, np.float32), np.array(weights, np.float32)
    table = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    layer = rng.normal(0, 1, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen = [np.full(a.shape, 1e-6, np.float32) for a in (table, layer, bias)]

    def step(array, memory, at, gradient):
        memory[at] += gradient * gradient
        array[at] -= RATE * gradient / np.sqrt(memory[at])

    full = [i for i, (ids, _) in enumerate(bags) if len(ids)]
    for _ in range(EPOCHS):
        rng.shuffle(full)
        for k in range(0, len(full), BATCH):
            own = full[k : k + BATCH]
            ids = np.concatenate([bags[i][0] for i in own])
            share = np.concatenate([bags[i][1] for i in own])
            starts = np.cumsum([0, *[len(bags[i][0]) for i in own[:-1]]])
            hidden = np.add.reduceat(table[ids] * share[:, None], starts)
            out = hidden @ layer + bias
            out = np.exp(out - out.max(axis=1, keepdims=True))
            error = out / out.sum(axis=1, keepdims=True)
            error[np.arange(len(own)), y[own].astype(int)] -= 1
            error *= weight[own][:, None] / len(own)
            back = np.repeat(error @ layer.T, [len(bags[i][0]) for i in own], axis=0) * share[:, None]
            at, inverse = np.unique(ids, return_inverse=True)
            gradient = np.stack([np.bincount(inverse, back[:, d], len(at)) for d in range(DIMENSIONS)], axis=1)
            step(table, seen[0], at, gradient.astype(np.float32))
            step(layer, seen[1], slice(None), hidden.T @ error)
            step(bias, seen[2], slice(None), error.sum(axis=0))
    difference = layer[:, 1] - layer[:, 0]
    return Model((table @ difference).astype(np.float32), float(bias[1] - bias[0]))


def held_out():
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled rows that are not held out. The sample is bounded; its rows are collected."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(~held_out())
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # twice as many ids as rows wanted, as some have no text or one that is too long
    most = {1: MAX_TOXIC, 0: MAX_CLEAN}
    ids = [known.filter(F.col("toxic") == c).orderBy(*order).limit(2 * n) for c, n in most.items()]
    picked = F.broadcast(ids[0].unionByName(ids[1]))
    rows = docs.select("doc_id", "text").filter(F.length("text").between(1, MAX_TRAIN_CHARS)).join(picked, "doc_id")
    texts, classes = [], []
    for c, n in most.items():
        found = rows.filter(F.col("toxic") == c).orderBy(*order, F.xxhash64("text")).limit(n).collect()
        texts += [r.text for r in found]
        classes += [c] * len(found)
    taken = {c: classes.count(c) for c in most}
    if not all(taken.values()):
        share = sizes.get(1, 0) / max(sum(sizes.values()), 1)
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    each = {c: sizes[c] / taken[c] for c in most}
    scale = len(classes) / sum(sizes.values())
    return train(texts, classes, [each[c] * scale for c in classes])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                ids, texts = (batch.column(i).slice(start, 128) for i in range(2))
                yield pa.RecordBatch.from_arrays([ids, pa.array(shared.value.scores(texts.to_pylist()), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(score, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    out = scored(docs, fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` below 0.5, with all their columns, in one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                scores = shared.value.scores([t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array(scores < 0.5))

    return docs.mapInArrow(keep, docs.schema)
