"""Work on whole pages, one after the other, with their rows in order.

Rows of a page that follow each other are packed and compressed into one before they are exchanged, so that little is sent,
sorted and held. On the other side a task unpacks some pages at a time, never all it has. Rows may come in any order: a page
that lies in many places is packed in as many pieces. Numbers are packed byte by byte, the first bytes of all rows, then the
second, whole numbers as steps from row to row; that compresses to a fraction of the rows themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

#: So many rows are worked on at once, or one page if it has more.
ROWS_AT_ONCE = 32768


def changes(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before it; nulls are equal. The first does."""
    a, b = column.slice(0, max(0, len(column) - 1)), column.slice(1)
    other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
    return np.concatenate([np.ones(min(1, len(column)), bool), other.to_numpy(zero_copy_only=False)])


def whole(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def numbers(column) -> np.ndarray:
    """Whole numbers, null the least."""
    return pc.fill_null(whole(column).cast(pa.int64()), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def _wide(kind: pa.DataType) -> int:
    """Bytes a value takes; of a text its length."""
    return 4 if _is_text(kind) else max(1, kind.bit_width // 8)


def _is_text(kind: pa.DataType) -> bool:
    return pa.types.is_string(kind) or pa.types.is_binary(kind)


def _plain(column: pa.Array) -> pa.Array:
    """Truth values take a byte each."""
    return column.cast(pa.uint8()) if pa.types.is_boolean(column.type) else column


def _split(column: pa.Array, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """The column's bytes, a row each for the first, the second and so on, with whether it is null; of a text what stands
    where, and all of it."""
    kind, column, text, ends = column.type, pa.concat_arrays([_plain(column)]), None, None
    null = pc.is_null(column).to_numpy(zero_copy_only=False).view(np.uint8)
    if _is_text(kind):
        column = pc.fill_null(column, "" if pa.types.is_string(kind) else b"")
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
        text, values = np.frombuffer(column.buffers()[2] or b"", np.uint8), np.diff(ends)
    else:
        size = _wide(kind)
        values = np.frombuffer(column.buffers()[1], np.uint8)[column.offset * size:(column.offset + len(column)) * size].copy()
        if pa.types.is_integer(kind):
            values = values.view(kind.to_pandas_dtype())
            steps = values.copy()
            steps[1:] -= values[:-1]
            steps[begin] = values[begin]
            values = steps
    return np.vstack([values.view(np.uint8).reshape(len(column), -1).T, null]), text, ends


def _together(planes: np.ndarray, kind: pa.DataType, begin: np.ndarray, text: bytes) -> pa.Array:
    """The column again; ``begin`` are the first rows of the packed pieces."""
    n, valid = planes.shape[1], pa.array(planes[-1] == 0).buffers()[1]
    raw = np.ascontiguousarray(planes[:-1].T)
    if _is_text(kind):
        ends = np.concatenate([[0], np.cumsum(raw.view(np.int32).ravel(), dtype=np.int64)]).astype(np.int32)
        return pa.Array.from_buffers(kind, n, [valid, pa.py_buffer(ends), pa.py_buffer(text)])
    if pa.types.is_integer(kind):
        steps = raw.view(kind.to_pandas_dtype()).ravel()
        sums = np.cumsum(steps, dtype=steps.dtype)
        raw = sums - np.repeat(sums[begin] - steps[begin], np.diff(np.append(begin, n)))
    made = pa.Array.from_buffers(pa.uint8() if pa.types.is_boolean(kind) else kind, n, [valid, pa.py_buffer(raw)])
    return made.cast(kind)


def _ordered(rows: pa.Table, page_no: np.ndarray, order: list[str]) -> tuple[pa.Table, np.ndarray]:
    """The rows by page and ``order``; nearly always they are."""
    along = [page_no, *(numbers(rows[c]) for c in order)]
    falls, same = np.zeros(max(0, len(page_no) - 1), bool), np.ones(max(0, len(page_no) - 1), bool)
    for x in along:
        falls |= same & (x[1:] < x[:-1])
        same &= x[1:] == x[:-1]
    if not falls.any():
        return rows, page_no
    at = np.lexsort(along[::-1])
    return rows.take(pa.array(at)), page_no[at]


def by_page(
    df: DataFrame, keys: list[str], order: list[str], work: Callable[[pa.Table, np.ndarray], tuple[np.ndarray, dict]], out: list[StructField]
) -> DataFrame:
    """``keys`` and the columns ``out`` that ``work`` makes of the rows of pages.

    ``work`` gets the other columns of some whole pages, by page and ``order`` (whole numbers, nulls first), and the number
    of each row's page. It returns the page number of each of its rows and their columns.
    """
    key_fields = [df.schema[k] for k in keys]
    fields = StructType([f for f in df.schema if f.name not in keys])
    packed_type = StructType([*key_fields, StructField("n", IntegerType()), StructField("size", IntegerType()), StructField("rows", BinaryType())])
    out_type = StructType([*key_fields, *out])
    rows_schema, packed_schema, out_schema = to_arrow_schema(fields), to_arrow_schema(packed_type), to_arrow_schema(out_type)
    names, kinds, n_keys = [f.name for f in fields], rows_schema.types, len(keys)
    high = sum(_wide(k) + 1 for k in kinds)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = np.logical_or.reduce([changes(batch.column(k)) for k in keys])
            begin = np.flatnonzero(cut)
            parts = [_split(whole(batch.column(c)).cast(k), begin) for c, k in zip(names, kinds, strict=True)]
            planes, texts = np.vstack([p for p, _, _ in parts]), [(t, e) for _, t, e in parts if e is not None]
            bounds = [*zip(begin, [*begin[1:], len(cut)], strict=True)]
            raw = [planes[:, a:b].tobytes() + b"".join(t[e[a]:e[b]].tobytes() for t, e in texts) for a, b in bounds]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(pa.array(begin)) for k in keys), pa.array([b - a for a, b in bounds], pa.int32()),
                 pa.array([len(x) for x in raw], pa.int32()), pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary())],
                names=packed_schema.names)

    def unpacked(pieces: list[tuple[int, int, bytes]]) -> pa.Table:
        planes = np.concatenate([np.frombuffer(x, np.uint8, high * n).reshape(high, n) for _, n, x in pieces], axis=1)
        size = [n for _, n, _ in pieces]
        begin, at, columns = np.cumsum([0, *size[:-1]]), 0, []
        texts = [high * n for n in size]  # where the next text of each piece begins
        for kind in kinds:
            here, at = planes[at:at + _wide(kind) + 1], at + _wide(kind) + 1
            text = b""
            if _is_text(kind):
                chars = np.add.reduceat(np.ascontiguousarray(here[:-1].T).view(np.int32).ravel().astype(np.int64), begin)
                text = b"".join(x[t:t + c] for (_, _, x), t, c in zip(pieces, texts, chars.tolist(), strict=True))
                texts = [t + c for t, c in zip(texts, chars.tolist(), strict=True)]
            columns.append(_together(here, kind, begin, text))
        return pa.Table.from_arrays(columns, schema=rows_schema)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, held, pages, count, last = pa.Codec("zstd"), [], [], 0, None

        def worked() -> Iterator[pa.RecordBatch]:
            page_no = np.repeat([p for p, _, _ in held], [n for _, n, _ in held])
            rows, page_no = _ordered(unpacked(held), page_no, order)
            no, columns = work(rows.combine_chunks(), page_no)
            of = pa.Table.from_batches(pages).take(pa.array(no))
            made = pa.Table.from_arrays([*of.columns, *(columns[f.name] for f in out)], names=out_schema.names).cast(out_schema)
            yield from made.to_batches(max_chunksize=ROWS_AT_ONCE)

        for batch in batches:
            if not batch.num_rows:
                continue
            ks, blobs = batch.select(keys), batch.column(n_keys + 2)
            counts, sizes = (batch.column(n_keys + i).to_pylist() for i in (0, 1))
            new = np.logical_or.reduce([changes(c) for c in ks.columns])
            if last is not None and last.equals(ks.slice(0, 1)):
                new[0] = False
            last = ks.slice(batch.num_rows - 1)
            for i in range(batch.num_rows):
                if new[i]:
                    if count >= ROWS_AT_ONCE:
                        yield from worked()
                        held, pages, count = [], [], 0
                    pages.append(ks.slice(i, 1))
                held.append((len(pages) - 1, counts[i], codec.decompress(blobs[i].as_buffer(), sizes[i], asbytes=True)))
                count += counts[i]
        if held:
            yield from worked()

    return (
        df.select(*keys, *names).mapInArrow(pack, packed_type)
        .repartition(*keys).sortWithinPartitions(*keys)
        .mapInArrow(unpack, out_type)
    )
