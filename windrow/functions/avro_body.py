"""Avro bodies (no container header) of flat or nested records of strings, longs and doubles.

The installed Spark has no Avro connector, so bytes are read and written by Arrow-batched
functions that work on whole columns with numpy; nothing is done row by row.
"""

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from windrow.schemas import leaves

# The functions travel to the executors with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_VARINT_BYTES = 10  # a 64-bit number has at most ten groups of seven bits


def wire_kinds(schema: T.StructType) -> list[str]:
    """What is on the wire for each leaf of the record."""
    kinds = []
    for path, field in leaves(schema):
        if isinstance(field.dataType, T.StringType):
            kinds.append("string")
        elif isinstance(field.dataType, (T.LongType, T.TimestampType)):
            kinds.append("long")
        elif isinstance(field.dataType, T.DoubleType):
            kinds.append("double")
        else:
            raise TypeError(f"{path}: {field.dataType.simpleString()} is not in any record")
    return kinds


def _uniform(values):
    return len(values) > 0 and bool((values == values[0]).all())


def _spans(starts, lengths):
    """Flat indices of all bytes of the spans, one span after the other."""
    shift = starts - (np.cumsum(lengths) - lengths)
    return np.repeat(shift, lengths) + np.arange(lengths.sum())


def _take_varint(data, pos, end):
    value = np.zeros(len(pos), np.uint64)
    open_ = np.ones(len(pos), bool)
    good = np.zeros(len(pos), bool)
    at = pos.copy()
    for i in range(_VARINT_BYTES):
        open_ &= at < end
        if not open_.any():
            break
        byte = np.where(open_, data.take(at, mode="clip"), 0).astype(np.uint64)
        value |= (byte & np.uint64(0x7F)) << np.uint64(7 * i)
        at += open_
        done = open_ & (byte < 0x80)
        good |= done
        open_ &= ~done
    signed = (value >> np.uint64(1)).astype(np.int64) ^ -(value & np.uint64(1)).astype(np.int64)
    return np.where(good, signed, 0), at, good


def _column_bytes(column):
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    return flat, offsets[:-1], offsets[1:]


def _gather(data, starts, lengths):
    """The bytes of all spans, one span after the other; at once if they are alike and evenly spaced."""
    if _uniform(lengths) and len(starts) > 1 and _uniform(np.diff(starts)) and starts[1] > starts[0]:
        stride = starts[1] - starts[0]
        rows = np.lib.stride_tricks.as_strided(
            data[starts[0] :], (len(starts), int(lengths[0])), (int(stride), 1), writeable=False
        )
        return rows.ravel()
    return data[_spans(starts, lengths)]


def _binary(flat, lengths):
    """Arrow bytes of rows that lie one after the other."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(
        pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]
    )


def _decode(column, kinds):
    present = column.is_valid().to_numpy(zero_copy_only=False)
    if len(column) == 0:
        data, pos, end = np.zeros(1, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    else:
        data, pos, end = _column_bytes(column)
    good = present.copy()
    parts = []
    for kind in kinds:
        if kind == "double":
            ok = pos + 8 <= end
            if ok.all():
                raw = _gather(data, pos, np.full(len(pos), 8))
            else:
                raw = data.take(pos[:, None] + np.arange(8), mode="clip").ravel()
            parts.append(pa.array(raw.view("<f8")))
            pos = pos + 8
        else:
            number, pos, ok = _take_varint(data, pos, end)
            if kind == "long":
                parts.append(pa.array(number))
            else:
                ok = ok & (number >= 0) & (number <= end - pos)
                length = np.where(ok & good, number, 0)
                parts.append(_binary(_gather(data, pos, length), length))
                pos = pos + length
        good &= ok
    whole = good & (pos == end)
    fault = np.where(whole, 0, np.where(~present, 1, np.where(good, 3, 2)))
    names = pa.array([None, "null payload", "truncated or malformed body", "trailing bytes"])
    return parts, names.take(pa.array(fault))


def body_decoder(schema: T.StructType):
    """Function from a BINARY column to STRUCT<fault, f0, f1, ...>, one part per leaf.

    ``fault`` is NULL where the body is whole. Marked non-deterministic so that a filter on its
    result is not pushed below it, which would run it twice.
    """
    kinds = wire_kinds(schema)
    types = {"string": "binary", "long": "bigint", "double": "double"}
    parts = ",".join(f"f{i}:{types[k]}" for i, k in enumerate(kinds))

    @arrow_udf(f"struct<fault:string,{parts}>")
    def decode(column: pa.Array) -> pa.Array:
        values, fault = _decode(column, kinds)
        names = ["fault"] + [f"f{i}" for i in range(len(kinds))]
        return pa.StructArray.from_arrays([fault, *values], names)

    return decode.asNondeterministic()


def _varint_bytes(number):
    """Groups of seven bits as an (n, 10) matrix, and how many of them each row needs."""
    rest = (number.astype(np.uint64) << np.uint64(1)) ^ (number >> np.int64(63)).astype(np.uint64)
    groups = np.zeros((len(number), _VARINT_BYTES), np.uint8)
    size = np.ones(len(number), np.int64)
    for i in range(_VARINT_BYTES):
        groups[:, i] = rest & np.uint64(0x7F)
        rest = rest >> np.uint64(7)
        if not rest.any():
            break
        size += rest > 0
    more = np.arange(_VARINT_BYTES) < (size - 1)[:, None]
    return groups | (more.astype(np.uint8) << 7), size


def _concat(pieces):
    """Bodies made of the pieces of each row, one after the other."""
    total = sum(size for _, size in pieces)
    if all(_uniform(size) for _, size in pieces):
        rows = [flat.reshape(len(size), size[0]) for flat, size in pieces]
        out = np.hstack(rows).ravel()
    else:
        out = np.empty(int(total.sum()), np.uint8)
        at = np.cumsum(total) - total
        for flat, size in pieces:
            out[_spans(at, size)] = flat
            at = at + size
    return _binary(out, total)


def _encode(columns, kinds):
    present = np.ones(len(columns[0]), bool)
    pieces = []  # (flat bytes, bytes per row)
    for column, kind in zip(columns, kinds):
        present &= column.is_valid().to_numpy(zero_copy_only=False)
        if kind == "double":
            values = column.fill_null(0.0).to_numpy(zero_copy_only=False).astype("<f8")
            pieces.append((values.view(np.uint8), np.full(len(values), 8, np.int64)))
            continue
        if kind == "string":
            data, start, end = _column_bytes(column.cast(pa.large_string()).fill_null(""))
            number = end - start
        else:
            number = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        groups, size = _varint_bytes(number)
        if _uniform(size):
            pieces.append((groups[:, : size[0]].ravel(), size))
        else:
            pieces.append((groups[np.arange(_VARINT_BYTES) < size[:, None]], size))
        if kind == "string":
            pieces.append((_gather(data, start, number), number))
    bodies = _concat(pieces)
    return pc.if_else(pa.array(present), bodies, pa.scalar(None, pa.binary()))


def body_encoder(schema: T.StructType):
    """Function from the leaf columns (times as epoch milliseconds) to the BINARY body."""
    kinds = wire_kinds(schema)

    @arrow_udf("binary")
    def encode(*columns: pa.Array) -> pa.Array:
        return _encode(columns, kinds)

    return encode
