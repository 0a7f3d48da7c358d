"""Variable-byte integers: seven bits a byte, low bits first, the high bit set while more follow.

Sizes and gaps are built-in expressions; encoding and decoding whole arrays
are Arrow-batched UDFs on numpy arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _widths(v: np.ndarray) -> np.ndarray:
    """Bytes that each number takes."""
    widths = np.ones(v.size, dtype=np.int64)
    rest = v >> 7
    while rest.any():
        widths += rest > 0
        rest = rest >> 7
    return widths


def encode(values) -> bytes:
    """Bytes of non-negative integers in turn."""
    v = np.asarray(values, dtype=np.int64)
    if v.size == 0:
        return b""
    if v.min() < 0:
        raise ValueError("negative numbers can't be encoded")
    widths = _widths(v)
    first = np.cumsum(widths) - widths
    out = np.zeros(int(widths.sum()), dtype=np.uint8)
    for k in range(int(widths.max())):
        has = widths > k
        more = (widths > k + 1)[has]
        out[first[has] + k] = ((v[has] >> (7 * k)) & 0x7F) | np.where(more, 0x80, 0)
    return out.tobytes()


def decode(data: bytes) -> np.ndarray:
    """The integers whose bytes ``data`` holds."""
    b = np.frombuffer(data, dtype=np.uint8)
    if b.size == 0:
        return np.zeros(0, dtype=np.int64)
    last = np.flatnonzero(b < 0x80)
    if not last.size or last[-1] != b.size - 1:
        raise ValueError("the last number is cut off")
    begin = np.concatenate(([0], last[:-1] + 1))
    shift = np.arange(b.size) - np.repeat(begin, last - begin + 1)
    return np.add.reduceat((b & 0x7F).astype(np.int64) << (7 * shift), begin)


def size(n: Column) -> Column:
    """Bytes that a non-negative integer takes; an error for negative ones."""
    wrong = F.raise_error(F.lit("negative numbers can't be encoded")).cast("int")
    steps = F.when(n < 0, wrong)
    for k in range(1, 9):
        steps = steps.when(n < F.lit(1 << (7 * k)), F.lit(k))
    return F.when(n.isNotNull(), steps.otherwise(F.lit(9)))


def gaps(values: Column, before: Column | None = None) -> Column:
    """First value (less ``before``), then the differences to the one before."""
    head = values[0] - (before if before is not None else F.lit(0))
    rest = F.transform(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), lambda x, i: x - F.get(values, i))
    return F.when(F.size(values) > 0, F.concat(F.array(head), rest)).otherwise(F.slice(values, 1, 0))


def _lists(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, lengths and validity of a batch of lists."""
    sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    numbers = values.flatten()
    if numbers.null_count:
        raise ValueError("an array holds a null")
    return numbers.to_numpy(zero_copy_only=False).astype(np.int64), sizes, pc.is_valid(values).to_numpy(zero_copy_only=False)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


def _as_lists(numbers: np.ndarray, sizes: np.ndarray, valid: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(_offsets(sizes).astype(np.int32)), pa.array(numbers, pa.int64()), mask=pa.array(~valid))


def _sums(numbers: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Running sums within each list, from ``before``."""
    if not numbers.size:
        return numbers
    upto, first = np.cumsum(numbers), _offsets(sizes)[:-1]
    base = np.where(first > 0, upto[np.maximum(first - 1, 0)], 0)
    return upto + np.repeat(before - base, sizes)


def _decoded(data: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, numbers per row and validity of a batch of coded rows, in one pass over all of their bytes."""
    sizes = pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    whole = b"".join(x for x in data.to_pylist() if x)
    last = np.flatnonzero(np.frombuffer(whole, dtype=np.uint8) < 0x80)
    ends = np.cumsum(sizes)
    upto = np.searchsorted(last, ends)  # numbers that end before each row does
    full = sizes > 0
    if not np.array_equal(last[upto[full] - 1] + 1 if last.size else np.zeros(0), ends[full]):
        raise ValueError("the last number is cut off")
    return decode(whole), np.diff(np.concatenate(([0], upto))), pc.is_valid(data).to_numpy(zero_copy_only=False)


@F.arrow_udf(T.BinaryType())
def encode_array(values: pa.Array) -> pa.Array:
    """``ARRAY<BIGINT>`` → bytes; null stays null.  A batch is coded in one go."""
    numbers, sizes, valid = _lists(values)
    coded, bytes_of = encode(numbers), _widths(numbers)
    upto = _offsets(bytes_of)[_offsets(sizes)]
    return pa.array([coded[a:b] if v else None for a, b, v in zip(upto[:-1].tolist(), upto[1:].tolist(), valid.tolist(), strict=True)], pa.binary())


@F.arrow_udf(T.ArrayType(T.LongType()))
def decode_array(data: pa.Array) -> pa.Array:
    """Bytes → ``ARRAY<BIGINT>``; null stays null."""
    return _as_lists(*_decoded(data))


@F.arrow_udf(T.ArrayType(T.LongType()))
def decode_gaps(data: pa.Array, before: pa.Array) -> pa.Array:
    """Bytes of gaps → the numbers themselves, counted on from ``before`` (null counts as 0)."""
    numbers, sizes, valid = _decoded(data)
    start = pc.fill_null(before, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return _as_lists(_sums(numbers, sizes, start), sizes, valid)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _restored(differences: pa.Array, before: pa.Array) -> pa.Array:
    numbers, sizes, valid = _lists(differences)
    start = pc.fill_null(before, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return _as_lists(_sums(numbers, sizes, start), sizes, valid)


def restore(differences: Column, before: Column | None = None) -> Column:
    """Running sums: the inverse of ``gaps``, linear in the arrays."""
    return _restored(differences.cast("array<bigint>"), (before if before is not None else F.lit(0)).cast("bigint"))


@F.arrow_udf(T.BinaryType())
def int32_bytes(values: pa.Array) -> pa.Array:
    """``ARRAY<BIGINT>`` → four bytes a number, the high byte first; an error outside of 32 bits."""
    numbers, sizes, valid = _lists(values)
    if numbers.size and (numbers.min() < -(1 << 31) or numbers.max() >= 1 << 31):
        raise ValueError("a number does not fit into 32 bits")
    coded, upto = numbers.astype(">i4").tobytes(), 4 * _offsets(sizes)
    return pa.array([coded[a:b] if v else None for a, b, v in zip(upto[:-1].tolist(), upto[1:].tolist(), valid.tolist(), strict=True)], pa.binary())


@F.arrow_udf(T.ArrayType(T.LongType()))
def int32_array(data: pa.Array) -> pa.Array:
    """The inverse of ``int32_bytes``."""
    sizes = pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes % 4).any():
        raise ValueError("the last number is cut off")
    numbers = np.frombuffer(b"".join(x for x in data.to_pylist() if x), dtype=">i4").astype(np.int64)
    return _as_lists(numbers, sizes // 4, pc.is_valid(data).to_numpy(zero_copy_only=False))


def byte_string(data: Column) -> Column:
    """Bytes as 8-bit strings with a space between them."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.lpad(F.bin(F.conv(F.hex(F.substring(data, i, 1)), 16, 10).cast("bigint")), 8, "0")), " ")
