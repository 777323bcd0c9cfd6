"""Document fingerprints: one-permutation MinHash, densified, a few bits of each bin.

Every shingle is hashed once; its high bits name one of ``BINS`` bins, which keeps its least hash. An empty bin takes
the value of a full one: it asks bins in an order hashed from its own number and the attempt until one is full (optimal
densification), so equal sets fill it alike. ``BITS`` low bits of each bin are stored. Two fingerprints agree by
chance in 2^-BITS of the bins; the likeness takes that out.

A text without words has a fingerprint of its own kind, "" : like itself, unlike any other.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windrow.llm.common import text_of
from windrow.llm.shingles import by_bytes, mix64, shingle_sets
from windrow.storage import materialize

WORDS = 5
BINS = 512
#: Low bits kept of each bin; a power of two up to 8.
BITS = 4

U64 = np.uint64


def bin_minima(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """The least hash of each bin for non-empty sets; empty bins are densified."""
    out = np.empty((len(sets), bins), U64)
    empty = U64(2**64 - 1)
    for row, s in zip(out, sets):
        hashes = np.sort(mix64(s ^ U64(0x2545F4914F6CDD1D)))
        number = (hashes >> U64(32)) * U64(bins) >> U64(32)
        first = np.concatenate([[True], number[1:] != number[:-1]])
        row[:] = empty
        row[number[first].astype(np.int64)] = hashes[first]
    full = out != empty
    todo = np.argwhere(~full)
    attempt = 0
    while len(todo):
        attempt += 1
        asked = (mix64(todo[:, 1].astype(U64) * U64(0x9E3779B97F4A7C15) + U64(attempt)) % U64(bins)).astype(np.int64)
        found = full[todo[:, 0], asked]
        rows, to = todo[found].T
        # the attempt goes into the value, so that two bins that ask the same one do not simply repeat it
        out[rows, to] = mix64(out[rows, asked[found]] + U64(attempt))
        todo = todo[~found]
    return out


def fingerprints(texts: list[bytes], words: int = WORDS) -> list[bytes]:
    """Packed low bits of the bins of each text; b"" for one without words."""
    out = []
    per_byte = 8 // BITS
    shifts = (np.arange(per_byte) * BITS).astype(np.uint8)
    for i, j in by_bytes(texts):
        sets = shingle_sets(texts[i:j], words)
        full = [s for s in sets if len(s)]
        low = (bin_minima(full) & U64((1 << BITS) - 1)).astype(np.uint8) if full else np.zeros((0, BINS), np.uint8)
        packed = iter(np.bitwise_or.reduce(low.reshape(len(full), BINS // per_byte, per_byte) << shifts, axis=2).astype(np.uint8))
        out += [next(packed).tobytes() if len(s) else b"" for s in sets]
    return out


def likeness(a: bytes, b: bytes) -> float:
    """Estimated similarity of two texts by their fingerprints, 0 to 1."""
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(f, np.uint8)[:, None] >> (np.arange(8 // BITS) * BITS) & ((1 << BITS) - 1) for f in (a, b))
    agree, chance = (x == y).mean(), 2.0**-BITS
    return float(max(0.0, (agree - chance) / (1 - chance)))


def edited_text(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as much of the beginning of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _described(rows: list[tuple[int | None, str, str]], own: list[bytes], following: list[bytes]) -> list[tuple]:
    edited = [edited_text(t, n).encode() for _, t, n in rows]
    out = []
    for (doc_id, text, _), e, f, g, h in zip(rows, edited, own, fingerprints(edited), following):
        out.append((doc_id, len(text), hashlib.sha256(e).hexdigest(), f, g, likeness(f, g), likeness(f, h)))
    return out


def fingerprint_chain(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Fingerprints of all rows, each compared with its edited text and with the next row by descending doc_id.

    Rows of one doc_id follow by hash and text, those without a doc_id come last, and after the last comes the first.
    Texts are shuffled once, into ranges of doc_ids. A task holds a few texts at a time and hands on the first and the last
    of its range; the last ones are compared after that, with one row per range.

    Runs jobs when called; its tables are removed by the surrounding ``intermediates`` block.
    """
    names = [c.split()[0] for c in _COLUMNS.split(", ")]

    def described(batches):
        last = None  # the row that waits for its successor, and its fingerprint

        def emit(rows, kind, text=None):
            columns = [pa.array(c) for c in zip(*rows)]
            types = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
            arrays = [c.cast(t) for c, t in zip(columns, types)]
            n = len(rows)
            arrays += [pa.array([kind] * n), pa.array([text] * n, pa.string()), pa.array([part] * n, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, [*names, "kind", "text", "part"])

        part = None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                ids, texts, own_part = (batch.column(i).slice(start, 256).to_pylist() for i in range(3))
                part = own_part[0]
                prints = fingerprints([t.encode() for t in texts])
                rows = list(zip(ids, texts, prints))
                if last is None:
                    yield emit([(ids[0], 0, "", prints[0], b"", 0.0, 0.0)], "first", texts[0])
                else:
                    rows.insert(0, last)
                last = rows[-1]
                pairs = list(zip(rows, rows[1:]))
                if pairs:
                    own, following = ([p[k][2] for p in pairs] for k in (0, 1))
                    yield emit(_described([(a[0], a[1], b[1]) for a, b in pairs], own, following), "row")
        if last is not None:
            yield emit([(last[0], 0, "", last[2], b"", 0.0, 0.0)], "last", last[1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    spread = rows.repartitionByRange(*[x for x in (partitions,) if x], *order[:2]).sortWithinPartitions(*order)
    numbered = spread.withColumn("part", F.spark_partition_id().cast("long"))
    out = materialize(numbered.mapInArrow(described, f"{_COLUMNS}, kind string, text string, part long"), "fingerprints")

    # the ends of the ranges: two rows for each, in a ring
    ends = out.filter("kind <> 'row'").select("part", "kind", "doc_id", "text", "fingerprint")
    firsts = ends.filter("kind = 'first'").select("part", F.struct("text", "fingerprint").alias("head"))
    ring = Window.orderBy("part")
    everything = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = firsts.select(
        F.col("part").alias("of"),
        F.coalesce(F.lead("part").over(ring), F.first("part").over(everything)).alias("part"),
    )
    parts = F.broadcast(materialize(parts, "fingerprint-parts"))
    lasts = ends.filter("kind = 'last'").withColumnRenamed("part", "of")
    joined = lasts.join(parts, "of").join(firsts, "part")
    joined = joined.select("doc_id", "text", "fingerprint", F.col("head.text").alias("next_text"), F.col("head.fingerprint").alias("next"))

    def finish(batches):
        for batch in batches:
            ids, texts, own, next_texts, following = (c.to_pylist() for c in batch.columns)
            done = _described(list(zip(ids, texts, next_texts)), own, following)
            if done:
                types = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)

    closing = joined.mapInArrow(finish, _COLUMNS)
    done = out.filter("kind = 'row'").select(*names).unionByName(closing)
    return done.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
