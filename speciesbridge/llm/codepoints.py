"""Arrow text as numpy code points and back, a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def flat(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks() if array.num_chunks != 1 else array.chunk(0)
        if isinstance(array, pa.ChunkedArray):
            array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    return array


def utf8(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; NULL has no bytes."""
    array = flat(array)
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if array.null_count:
        array = pc.fill_null(array, b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def decode(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(code points as uint32, offsets) of a string array. Bytes that are no UTF-8 become U+FFFD."""
    raw, at = utf8(array)
    try:
        text = raw.tobytes().decode("utf-8")
    except UnicodeDecodeError:
        b = raw.tobytes()
        rows = [b[i:j].decode("utf-8", "replace") for i, j in zip(at[:-1], at[1:])]
        lengths = np.fromiter((len(x) for x in rows), np.int64, len(rows))
        text = "".join(rows)
        return np.frombuffer(text.encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum(lengths)])
    if len(text) == len(raw):
        return raw.astype(np.uint32), at
    first = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), first[at]


def encode(cps: np.ndarray, offsets: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """A string array of the code points; rows where `null` holds are NULL."""
    raw = cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (cps > 0x7F).astype(np.int64) + (cps > 0x7FF) + (cps > 0xFFFF)
    at = np.concatenate([[0], np.cumsum(width)])[offsets]
    big = at[-1] >= 2**31
    buffers = [None, pa.py_buffer(at.astype(np.int64 if big else np.int32).tobytes()), pa.py_buffer(raw)]
    if null is not None and null.any():
        buffers[0] = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.large_string() if big else pa.string(), len(offsets) - 1, buffers)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i], starts[i] + 1, ... of all ranges, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def take(cps: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points and offsets of the rows named."""
    lengths = (offsets[1:] - offsets[:-1])[rows]
    return cps[spread(offsets[:-1][rows], lengths)], np.concatenate([[0], np.cumsum(lengths)])


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over the rows, modulo 2^64 for unsigned values."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[offsets[1:]] - total[offsets[:-1]]
