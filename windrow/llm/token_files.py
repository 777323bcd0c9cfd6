"""Token ids of documents in binary files, Simple-8b packed, in ascending order of doc_id.

A file is a run of segments, each of about ``SEGMENT_IDS`` ids of whole documents, and a line feed after each:

    magic "S8B1", then little-endian: u32 documents, u32 blocks, u64 ids, u64 words, u64 escapes,
    i64 doc_id of each document, u8 1 where the doc_id is null, u64 ids of each document,
    u32 word offset of each block, u64 words, u64 escaped values

Spark writes them as rows of raw bytes through its own committer, for each range of doc_ids one file after another of at
most ``FILE_SEGMENTS`` segments, in the order of the two numbers in their names; so a lost executor leaves no half a file, and
no file grows with the data (a document is never divided: it must fit into memory). The order among rows of one doc_id is by text;
null doc_ids come last. A null text is an empty one: it has the end id alone.
"""

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrow.llm.common import text_of
from windrow.llm.simple8b import pack, unpack
from windrow.llm.tokens import ID, text_encoder, text_slices
from windrow.storage import materialize, new_path

MAGIC = b"S8B1"
HEADER = struct.Struct("<4sIIQQQ")
SEGMENT_IDS = 200_000
#: About 25 million ids, which take 50 to 100 MB.
FILE_SEGMENTS = 128
#: Fixed: the numbers of the task and of the file within the task in the names that Spark gives.
NAME = r"^part-(\d+)-.*-c(\d+)[^-]*$"
SEPARATOR = "\n"
#: Pieces the encoder remembers here, where the library takes most of the time.
MAX_PIECES = 450_000


def segment_bytes(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    lengths = np.array([len(b) // ID.itemsize for b in ids], np.uint64)
    words, offsets, escapes = pack(np.frombuffer(b"".join(ids), ID))
    nulls = np.array([i is None for i in doc_ids], np.uint8)
    numbers = np.array([i or 0 for i in doc_ids], np.int64)
    head = HEADER.pack(MAGIC, len(doc_ids), len(offsets), int(lengths.sum()), len(words), len(escapes))
    return head + b"".join(a.tobytes() for a in (numbers, nulls, lengths, offsets, words, escapes))


def read_segments(content: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """doc_ids, number of ids of each document, and all ids, segment by segment."""
    at = 0
    while at < len(content):
        magic, n_docs, n_blocks, n_ids, n_words, n_escapes = HEADER.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        at += HEADER.size
        arrays = []
        for kind, n in (("<i8", n_docs), ("u1", n_docs), ("<u8", n_docs), ("<u4", n_blocks), ("<u8", n_words), ("<u8", n_escapes)):
            arrays.append(np.frombuffer(content, kind, n, at))
            at += arrays[-1].nbytes
        numbers, nulls, lengths, offsets, words, escapes = arrays
        if content[at : at + 1] != SEPARATOR.encode() or int(lengths.sum()) != n_ids:
            raise ValueError("broken segment")
        at += 1
        yield [None if z else i for i, z in zip(numbers.tolist(), nulls)], lengths.astype(np.int64), unpack(words, offsets, escapes, n_ids)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, partitions: int | None = None) -> None:
    """Encode every text, append ``end_id``, and write the files to ``path``. Only the sort by doc_id shuffles."""
    end = np.asarray([end_id], ID).tobytes()

    def encoded(batches):
        encoder = text_encoder(tokenizer, MAX_PIECES)
        doc_ids, ids, size = [], [], 0
        for batch in batches:
            for numbers, texts in text_slices(batch, encoder.slice_bytes):
                for n, b in zip(numbers, encoder.encode(texts)):
                    doc_ids.append(n)
                    ids.append(b + end)
                    size += len(ids[-1]) // ID.itemsize
                    if size >= SEGMENT_IDS:
                        yield pa.RecordBatch.from_arrays([pa.array([segment_bytes(doc_ids, ids)], pa.binary())], ["segment"])
                        doc_ids, ids, size = [], [], 0
        if doc_ids:
            yield pa.RecordBatch.from_arrays([pa.array([segment_bytes(doc_ids, ids)], pa.binary())], ["segment"])

    rows = docs.select("doc_id", text_of().alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("text")]
    spread = rows.repartitionByRange(*[x for x in (partitions,) if x], *order[:2]).sortWithinPartitions(*order)
    segments = spread.mapInArrow(encoded, "segment binary")
    segments.select(F.col("segment").cast("string").alias("value")).write.options(
        lineSep=SEPARATOR, maxRecordsPerFile=FILE_SEGMENTS
    ).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: file, start (ids before it in its file), doc_id, n_tokens, ids_crc32."""

    def decoded(batches):
        for batch in batches:
            for name, content in zip(*(batch.column(i) for i in range(2))):
                start = 0
                for doc_ids, lengths, ids in read_segments(content.as_py()):
                    ends = np.cumsum(lengths)
                    raw = ids.astype(ID).tobytes()
                    crc = [zlib.crc32(memoryview(raw)[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name.as_py()] * len(doc_ids)),
                            pa.array(start + ends - lengths, pa.int64()),
                            pa.array(doc_ids, pa.int64()),
                            pa.array(lengths, pa.int64()),
                            pa.array(crc, pa.int64()),
                        ],
                        ["file", "start", "doc_id", "n_tokens", "ids_crc32"],
                    )
                    start += int(ends[-1])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("file"), "content").mapInArrow(
        decoded, "file string, start long, doc_id long, n_tokens long, ids_crc32 long"
    )


def file_order() -> list[Column]:
    """The files in the order of their doc_ids: numbers of five digits and of more are compared as numbers."""
    return [F.regexp_extract("file", NAME, i).cast("bigint") for i in (1, 2)]


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    rows = materialize(read_token_files(spark, path), "token-rows")
    # one row per file
    sizes = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy(*file_order()).rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("file", F.coalesce(before, F.lit(0)).alias("base"))
    placed = rows.join(F.broadcast(bases), "file")
    return placed.select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the files among the intermediate tables and return what they hold."""
    path = new_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end_id)
    return token_index(docs.sparkSession, path)
