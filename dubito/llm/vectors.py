"""Vector codes by product quantisation in whole numbers.

Components are scaled and floored to integers, vectors are cut into equal parts, and each part
position has a codebook of few entries. The codebooks are broadcast; a task computes all distances of
an Arrow batch by norm expansion, |x|^2 - 2 x.c + |c|^2, with exact products of 64-bit integers, and
takes the first of the least. Each task sums its parts by entry; the sums are merged by a grouped
shuffle in each round, and only they (entries times components) reach the driver. Everything is whole
numbers, so the result depends neither on the order of rows nor on how they are dealt.

Defined results: rows whose vector is null, is empty, or holds a null, NaN or infinite component are left
out, as are vectors of another length than the first kept one (by vec_id, nulls last, then by length
and content). Rows with a null vec_id are coded like any other; repeated rows count as often as they
stand, in the first codebooks too. A length that the number of parts doesn't divide is filled up with
zeros. Components are held within +-sqrt(2^60 / length), 2^27 for 64 components, so that no sum of
squares leaves 64 bits; an error summed over a label that does is null. Fewer rows than entries make
smaller codebooks; an empty table gives an empty one. Ties go to the lower entry. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, LongType, StringType, StructField, StructType

from .shared import attach, cut

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows whose distances are held at once.
ROWS = 1 << 13


def _padded(size: int, parts: int) -> int:
    return -(-size // parts) * parts


def integers(column: pa.Array, size: int, scale: int = SCALE, parts: int = PARTS) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors): the places of the kept vectors of this length, and their integer components, filled up to whole parts."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == size)
    x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), size)
    whole = np.isfinite(x).all(1)  # nulls are NaN here
    rows, x = rows[whole], np.floor(x[whole] * scale)
    most = int((2**60 // size) ** 0.5)
    out = np.zeros((len(rows), _padded(size, parts)), np.int64)
    out[:, :size] = np.clip(x, -most, most)
    return rows, out


def nearest(x: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, error): of each vector's parts the number of the nearest entry, and the squared distance to it. codebooks: (part, entry, component)."""
    parts, _, width = codebooks.shape
    code, error = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts), np.int64)
    for p in range(parts):
        part, book = np.ascontiguousarray(x[:, p * width : (p + 1) * width]), codebooks[p]
        far = (book * book).sum(1) - 2 * (part @ book.T)
        code[:, p] = far.argmin(1)
        error[:, p] = (part * part).sum(1) + np.take_along_axis(far, code[:, p : p + 1], 1)[:, 0]
    return code, error


def _first(vectors: DataFrame, entries: int, scale: int, parts: int) -> np.ndarray | None:
    """The integer vectors of the least vec_ids, one to a row; None without any. Each batch sends so many of its rows at most for each length."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("vector")
            for size in np.unique(column.value_lengths().drop_null().to_numpy()):
                if size == 0:
                    continue
                rows, x = integers(column, int(size), scale, parts)
                ids = b.column("vec_id").take(pa.array(rows))
                none, key = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy(zero_copy_only=False)
                order = np.lexsort((*x.T[::-1], key, none))[:entries] if len(rows) else rows
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1) * x.shape[1], pa.int32()), pa.array(x[order].ravel()))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(order)), pa.array(np.full(len(order), size), pa.int64()), lists], ["vec_id", "size", "x"])

    found = cut(vectors.select("vec_id", "vector").mapInArrow(task, "vec_id long, size long, x array<long>"))
    order = [F.col("vec_id").asc_nulls_last(), F.col("size"), F.col("x")]
    if (one := found.orderBy(*order).first()) is None:
        return None
    least = found.where(F.col("size") == one["size"]).orderBy(*order).limit(entries).collect()  # so many rows
    return one["size"], np.array([r["x"] for r in least], np.int64)


def _sums(vectors: DataFrame, size: int, books, scale: int, parts: int) -> DataFrame:
    """(slot, total): sums of the parts nearest to each entry, component by component, and their counts behind them, merged over all tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebooks = books.value
        _, entries, width = codebooks.shape
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                _, x = integers(b.slice(i, ROWS).column("vector"), size, scale, parts)
                code, _ = nearest(x, codebooks)
                for p in range(parts):
                    own = (code[:, p, None] == np.arange(entries)).astype(np.int64)
                    total[p] += own.T @ np.ascontiguousarray(x[:, p * width : (p + 1) * width])
                    count[p] += own.sum(0)
        flat = np.r_[total.ravel(), count.ravel()]
        slot = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(flat[slot])], ["slot", "total"])

    return vectors.select("vector").mapInArrow(task, "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total"))


def codebooks_of(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, parts: int = PARTS) -> tuple[int, np.ndarray] | None:
    """(length, codebooks) of (vec_id, vector) after so many rounds; None if no vector is kept."""
    if (start := _first(vectors, entries, scale, parts)) is None:
        return None
    size, x = start
    books = np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        sent = vectors.sparkSession.sparkContext.broadcast(books)
        flat = np.zeros(books.size + parts * len(x), np.int64)
        for r in _sums(vectors, size, sent, scale, parts).collect():  # a row for each component of the codebooks at most
            flat[r["slot"]] = r["total"]
        total, count = flat[: books.size].reshape(books.shape), flat[books.size :].reshape(parts, -1, 1)
        books = np.where(count > 0, total // np.maximum(count, 1), books)  # // goes down
        sent.unpersist()
    return size, books


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(table: DataFrame, vector: str = "embedding", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept row.

    code: an entry's number for each part in two hex digits; error: the squared distance of the whole
    vector; label_error: the errors summed over rows of an equal label, nulls together.
    """
    kind = table.schema[vector].dataType
    column = F.col(vector) if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType | DoubleType) else F.col(vector).cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).alias("label"), column.alias("vector"))
    found = codebooks_of(rows, entries, rounds, scale, parts)
    schema = StructType([StructField("vec_id", LongType()), StructField("label", rows.schema["label"].dataType), StructField("code", StringType()), StructField("error", LongType())])
    if found is None:
        return rows.where("false").select("vec_id", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
    size, books = found
    sent = table.sparkSession.sparkContext.broadcast(books)
    digits = np.array([f"{i:02x}" for i in range(books.shape[1])])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                c = b.slice(i, ROWS)
                kept, x = integers(c.column("vector"), size, scale, parts)
                code, error = nearest(x, sent.value)
                at = pa.array(kept)
                yield pa.RecordBatch.from_arrays([c.column("vec_id").take(at), c.column("label").take(at), pa.array(["".join(r) for r in digits[code]], pa.string()), pa.array(error.sum(1), pa.int64())], ["vec_id", "label", "code", "error"])

    coded = cut(rows.mapInArrow(task, schema))
    totals = cut(coded.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n")))
    return attach(coded, totals, "label").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
