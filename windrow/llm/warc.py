"""WARC archives under Zstandard: one frame per record, after a skippable frame that holds the dictionary.

Spark writes the archives through its text writer: a row is a frame as raw bytes, and what stands between rows is an
empty skippable frame, which every Zstandard decoder passes over. So an archive is committed as a whole or not at all,
and is a plain file. A task writes one archive, beginning with the dictionary.

Of pages with equal payloads, the one with the largest page_id is the response, and the others are revisits of it.
Pages that repeat this page_id are responses, too. A null html is empty, a null url is left out, and a null page_id is less
than any other.
"""

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import attach
from windrow.storage import materialize, new_path

#: Fixed: skippable frames; the one with a dictionary, and an empty one of another number.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
EMPTY_FRAME = "P*M\x18\0\0\0\0"
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICTIONARY_BYTES = 64 * 1024
#: Pages that the dictionary is trained on, and their longest payload.
SAMPLE_PAGES, SAMPLE_BYTES = 1000, 20_000


def train_dictionary(payloads: list[bytes]) -> bytes:
    """A dictionary for payloads; b"" where there is too little to learn from."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, payloads).as_bytes() if len(payloads) > 7 else b""
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor().compress(dictionary)
    return DICTIONARY_MAGIC.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed


def _frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends."""
    head = data[at + 4]
    block = at + zstandard.frame_header_size(bytes(data[at : at + 18]))
    while True:
        if block + 3 > len(data):
            raise ValueError("cut off frame")
        info = int.from_bytes(data[block : block + 3], "little")
        last, kind, size = info & 1, info >> 1 & 3, info >> 3
        block += 3 + (1 if kind == 1 else size)
        if last:
            end = block + (4 if head & 4 else 0)
            if end > len(data):
                raise ValueError("cut off frame")
            return end


def records(content: bytes) -> Iterator[bytes]:
    """The records of an archive, a frame at a time."""
    data, at = memoryview(content), 0
    reader = zstandard.ZstdDecompressor()
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("cut off frame")
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic in SKIPPABLE:
            end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            if end > len(data):
                raise ValueError("cut off frame")
            if magic == DICTIONARY_MAGIC and at == 0:
                raw = bytes(data[8:end])
                if raw[:4] == zstandard.FRAME_HEADER:
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        elif magic == 0xFD2FB528:
            end = _frame_end(data, at)
            yield reader.decompressobj().decompress(data[at:end])
        else:
            raise ValueError(f"no frame at byte {at}")
        at = end


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    lines.append(f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>")
    if url is not None:
        quoted = re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}" if m[0] != "%" else "%", url)
        lines.append(f"WARC-Target-URI: {quoted}")
    lines += [f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{_base32(digest)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


def _headers(raw: bytes, first: bytes) -> dict[str, str]:
    start, *lines = raw.split(b"\r\n")
    if not start.startswith(first):
        raise ValueError("no " + first.decode())
    pairs = [line.decode().partition(": ") for line in lines]
    if not all(sep for _, sep, _ in pairs):
        raise ValueError("broken header")
    return {name: value for name, _, value in pairs}


def parse_record(raw: bytes) -> tuple[int | None, str | None, bytes | None, int, str, str, int | None]:
    """page_id, url, payload, its length, digest, type, page it refers to. Headers, lengths and digest are checked."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    fields = _headers(head, b"WARC/1.")
    length = int(fields["Content-Length"])
    if not blank or len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("wrong length of a record")
    http, blank, payload = rest[:length].partition(b"\r\n\r\n")
    size = int(_headers(http, b"HTTP/1.")["Content-Length"])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != size or _base32(hashlib.sha1(payload).digest()) != digest:
            raise ValueError("wrong payload")
    elif kind != "revisit" or payload or "WARC-Refers-To" not in fields:
        raise ValueError("wrong revisit")

    def number(field: str) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d*)>", fields[field])[1]
        return int(found) if found else None

    refers = number("WARC-Refers-To") if kind == "revisit" else None
    return number("WARC-Record-ID"), fields.get("WARC-Target-URI"), payload if kind == "response" else None, size, digest, kind, refers


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a record for every page. Only pages whose payload repeats are shuffled by it, hot payloads not at all."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.unhex(F.sha1(payload)).alias("digest"))
    slim = materialize(rows.select("page_id", "digest", F.length("payload").alias("size")), "warc-digests")
    groups = slim.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n_rows"))
    groups = materialize(groups.filter("n_rows > 1"), "warc-groups")
    joined = attach(rows, groups, ["digest"], max(slim.count(), 1), "left")
    other = ~F.col("page_id").eqNullSafe(F.col("response_id"))
    ready = joined.select("page_id", "url", "payload", "digest", F.when(other, F.col("response_id")).alias("refers_to"))
    # digests first, so that payloads of the sample alone move
    picked = slim.filter(F.col("size").between(8, SAMPLE_BYTES)).select("digest").distinct()
    picked = picked.orderBy(F.xxhash64("digest"), "digest").limit(SAMPLE_PAGES)
    sample = rows.select("digest", "payload").join(F.broadcast(picked), "digest").dropDuplicates(["digest"])
    dictionary = train_dictionary([bytes(r.payload) for r in sample.orderBy("digest").collect()])

    def frames(batches):
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        writer = zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=True, write_checksum=True)
        first = [dictionary_frame(dictionary)] if dictionary else []
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                columns = (c.slice(start, 256).to_pylist() for c in batch.columns)
                packed = [writer.compress(record(*r)) for r in zip(*columns)]
                yield pa.RecordBatch.from_arrays([pa.array(first + packed, pa.binary())], ["frame"])
                first = []

    out = ready.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
    out.write.option("lineSep", EMPTY_FRAME).text(path)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to (url and payload on request)."""
    fields = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    wanted = [i for i in range(7) if with_payload or i not in (1, 2)]

    def parsed(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for raw in records(content.as_py()):
                    rows.append([parse_record(raw)[i] for i in wanted])
                    if len(rows) == 512:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, types[i]) for i, c in zip(wanted, zip(*rows))], [fields[i] for i in wanted])

    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    schema = ", ".join(f"{fields[i]} {kinds[types[i]]}" for i in wanted)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(parsed, schema)


def write_and_read(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the archives among the intermediate tables and return what they hold."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(pages.sparkSession, path)
