"""Pack documents into token sequences of a fixed length: best-fit decreasing.

A document is its ids and an end id. One that is longer than a window is first cut into full windows, and the rest
of it is packed like a short one: the longest first, each into the open window with the least room that takes it.
A segment tree over the remaining capacities finds that window.

Pieces are dealt at random over shards of about ``SHARD_PIECES``, each packed by one task, so that neither the number of
documents nor a repeated one makes a task large; within so many pieces there is always a short one for a gap.
A null text is an empty one (the end id alone); a null or repeated doc_id is packed like any other.
"""

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import text_of
from windrow.llm.tokens import ID, text_encoder, text_slices
from windrow.storage import materialize

WINDOW = 2048
SHARD_PIECES = 50_000
#: Sequences are numbered shard by shard; no shard has so many.
_SHARD_SPAN = 1 << 32


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree that knows which capacities there are."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, n: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += n
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        if capacity:
            self.stacks[capacity].append(window)
            self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """A window with the least room that is enough, and its room."""
        count, node = self.count, need + self.size
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1  # no room in what lies to the right below this node
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.size
        self._add(capacity, -1)
        return self.stacks[capacity].pop(), capacity


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of every piece; full pieces get a window of their own."""
    order = np.argsort(-lengths, kind="stable")
    number, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    windows, opened = OpenWindows(window), 0
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        found = windows.take(n) if n < window else None
        if found is None:
            found, opened = (opened, window), opened + 1
        number[i], offset[i] = found[0], window - found[1]
        windows.put(found[1] - n, found[0])
    return number, offset


def pieces(
    docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, with_ids: bool = False, max_pieces: int | None = None
) -> DataFrame:
    """Documents cut at every ``window`` ids: doc_id, start, length, ids_crc32, doc_tokens (and ids). No shuffle."""
    end = np.asarray([end_id], ID).tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]

    def cut(batches):
        pa.default_memory_pool().release_unused()  # of the tasks before in this worker
        encoder = text_encoder(tokenizer, max_pieces)
        for batch in batches:
            for doc_ids, texts in text_slices(batch, encoder.slice_bytes):
                rows = []
                for doc_id, raw in zip(doc_ids, encoder.encode(texts)):
                    raw += end
                    n = len(raw) // ID.itemsize
                    for start in range(0, n, window):
                        own = raw[start * ID.itemsize : (start + window) * ID.itemsize]
                        row = (doc_id, start, len(own) // ID.itemsize, zlib.crc32(own), n)
                        rows.append((*row, np.frombuffer(own, ID).astype(np.int32)) if with_ids else row)
                columns = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:5]]
                if with_ids:
                    columns.append(pa.array([r[5] for r in rows], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"{n} long" for n in names[:5]) + ", ids array<int>" * with_ids
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(cut, schema)


def pack_pieces(cut: DataFrame, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pieces (a written table) with ``sequence_id`` and ``offset``."""
    n_shards = -(-max(cut.count(), 1) // shard_pieces)
    fields = cut.schema

    def place(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        number, offset = best_fit_decreasing(rows["length"].to_numpy(), window)
        return rows.drop(columns="shard").assign(sequence_id=int(key[0]) * _SHARD_SPAN + number, offset=offset)

    # the row number only spreads equal pieces; the table is written, so a repeated task sees the same
    shard = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(n_shards))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    return cut.withColumn("shard", shard).groupBy("shard").applyInPandas(place, schema)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    window: int = WINDOW,
    shard_pieces: int = SHARD_PIECES,
    with_ids: bool = False,
    max_pieces: int | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    ``max_pieces`` bounds what the encoder of each worker remembers; it changes memory and speed only.

    Runs jobs when called; its tables are removed by the surrounding ``intermediates`` block.
    """
    return pack_pieces(materialize(pieces(docs, tokenizer, end_id, window, with_ids, max_pieces), "pieces"), window, shard_pieces)


def padded_length(used: int, window: int = WINDOW) -> int:
    """A sequence is padded to the window, unless it ends at a power of two."""
    return used if used & (used - 1) == 0 else window


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The sequences themselves, from pieces with ids: sequence_id, used, ids (padded), document starts."""
    parts_ = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts_.alias("parts"), F.sum("length").alias("used"))
    is_power = F.col("used").bitwiseAND(F.col("used") - 1) == 0
    fill = F.when(is_power, F.lit(0)).otherwise(F.lit(window) - F.col("used")).cast("int")
    return rows.select(
        "sequence_id",
        "used",
        F.concat(F.flatten(F.transform("parts", lambda p: p["ids"])), F.array_repeat(F.lit(pad_id), fill)).alias("ids"),
        F.transform("parts", lambda p: p["offset"]).alias("starts"),
    )
