"""Exact top-k by inner product over a bit-sliced index.

Vectors are quantised to floor(SCALE * x). The index holds segments of at most ``SEGMENT``
rows and ``SEGMENT_CELLS`` components, ordered by vec_id; for each attribute and bit of a segment there is one slice, a bitmap
over its rows. A query adds slices with bitmap arithmetic: an attribute's slices are shifted
by each set bit of the query's own component (complemented where it is negative, which a
constant makes up for), and full adders reduce them to the slices of the scores. From the
most significant slice downward the top rows are separated with two bitmaps, those in for
certain and those still tied. Ties that remain at the border have exactly equal scores; the
smallest ids win. Scores of the winners are then computed exactly.

Rows are dealt out in turn to make full segments. A segment stays where it is and the blocks of
queries stream past it, one at a time; only where there are fewer segments than cores is a
segment's work shared, by ``parts`` that each meet a share of the blocks. Each returns at most k rows
a query, of which a window keeps k. A task holds one segment and one batch of blocks.

Scores are exact: bitmaps take integers of any width, and sums that are cut to 64 bits are right
wherever the score fits a long. What doesn't fit fails by name: components of 2**62 or more after
quantising, and winners whose score is beyond a long.

Defined results: vectors that are null, or hold null or non-finite components, take no part;
missing components of shorter vectors count as 0; rows that share the query's vec_id are its
own; of rows that repeat a query's vec_id the smallest vector is the query; repeated candidates
each count; fewer candidates than k give all; an empty table gives no rows; other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE, SEGMENT, BLOCK, LIMIT = 64, 1 << 17, 128, 1 << 62
#: Most components of a segment's rows and of a block's queries, of 8 bytes each while it is made.
SEGMENT_CELLS, BLOCK_CELLS = 1 << 23, 1 << 20


def quantised(vector: str = "embedding") -> Column:
    """The integer vector, or null if it takes no part."""
    v = F.col(vector)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))

    def one(x: Column) -> Column:
        scaled = x.cast("double") * SCALE
        return F.when(F.abs(scaled) < F.lit(float(LIMIT)), F.floor(scaled)).otherwise(F.raise_error(F.lit(f"a component of {LIMIT} or more after quantising doesn't fit")).cast("long"))

    return F.when(fine, F.transform(v, one))


class Segment:
    """A bit-sliced segment: ids in order, each attribute's least value and number of bits, and
    a matrix with a bitmap over the rows for each attribute and bit."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, bits: np.ndarray, matrix: np.ndarray):
        self.ids, self.low, self.bits, self.matrix = ids, low, bits, matrix
        self.n, self.words = len(ids), matrix.shape[1]
        self.full = self._bitmaps(np.ones((self.n, 1), bool))[0]
        flipped = matrix ^ self.full
        at = np.concatenate([[0], np.cumsum(bits)]).astype(int)
        self.slices = [list(matrix[a:b]) for a, b in zip(at, at[1:])]
        self.flipped = [list(flipped[a:b]) for a, b in zip(at, at[1:])]
        self.weight = np.concatenate([[0], *(1 << np.arange(b, dtype=np.int64) for b in bits)])[1:]
        self.attribute = np.repeat(np.arange(len(bits)), bits)

    @staticmethod
    def _bitmaps(bits: np.ndarray) -> np.ndarray:
        """Columns of a row x bit matrix as rows of 64-bit words."""
        out = np.zeros((bits.shape[1], (len(bits) + 63) // 64 * 8), np.uint8)
        packed = np.packbits(bits.T, axis=1, bitorder="little")
        out[:, : packed.shape[1]] = packed
        return out.view(np.uint64)

    @classmethod
    def build(cls, ids: np.ndarray, values: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
        """ids, least values, bits and matrix of a row x attribute matrix, as stored."""
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order].astype(np.int64)
        low = values.min(0) if len(ids) else np.zeros(values.shape[1], np.int64)
        shifted = values - low
        bits = np.array([int(m).bit_length() for m in shifted.max(0)], np.int32) if len(ids) else np.zeros(values.shape[1], np.int32)
        parts = [cls._bitmaps((shifted[:, [d]] >> np.arange(b)) & 1 == 1) for d, b in enumerate(bits)]
        matrix = np.concatenate(parts) if parts else np.zeros((0, (len(ids) + 63) // 64), np.uint64)
        return ids.astype("<i8").tobytes(), low.astype("<i8").tobytes(), bits.astype("<i4").tobytes(), matrix.tobytes()

    @classmethod
    def load(cls, ids: bytes, low: bytes, bits: bytes, matrix: bytes) -> Segment:
        numbers = np.frombuffer(ids, "<i8")
        return cls(numbers, np.frombuffer(low, "<i8"), np.frombuffer(bits, "<i4"), np.frombuffer(matrix, np.uint64).reshape(-1, (len(numbers) + 63) // 64))

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """The exact scores of a few rows, from their bits. Sums wrap around at 64 bits, which
        does no harm where the score itself fits; that is seen from its size as a double."""
        bits = (self.matrix[:, rows >> 6] >> (rows & 63).astype(np.uint64)).astype(np.int64) & 1
        near = (query[self.attribute].astype(float) * self.weight) @ bits + float(query.astype(float) @ self.low.astype(float))
        if (np.abs(near) > 2.0**62).any():
            parts = (query[self.attribute].astype(object) * self.weight.astype(object)) @ bits.astype(object) + int(query.astype(object) @ self.low.astype(object))
            if any(not -(1 << 63) <= int(p) < 1 << 63 for p in parts):
                raise ValueError("an inner product doesn't fit a long")
            return np.array([int(p) for p in parts], np.int64)
        return (query[self.attribute] * self.weight) @ bits + (query * self.low).sum()

    def add(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of each row's score up to a constant of the query."""
        levels: list[list[np.ndarray]] = []
        for d, q in enumerate(query.tolist()):
            part = self.slices[d] if q > 0 else self.flipped[d]
            for j in range(abs(q).bit_length()):
                if abs(q) >> j & 1:
                    while len(levels) < j + len(part):
                        levels.append([])
                    for b, s in enumerate(part):
                        levels[j + b].append(s)
        out, i = [], 0
        while i < len(levels):
            row = levels[i]
            if len(row) > 1 and i + 1 == len(levels):
                levels.append([])
            while len(row) > 2:  # three slices of a level become one, and one of the next
                a, b, c = row.pop(), row.pop(), row.pop()
                half = a ^ b
                row.append(half ^ c)
                np.bitwise_and(half, c, out=half)
                half |= a & b
                levels[i + 1].append(half)
            if len(row) == 2:
                a, b = row
                levels[i + 1].append(a & b)
                row = [a ^ b]
            out.append(row[0] if row else np.zeros(self.words, np.uint64))
            i += 1
        return out

    def top(self, query: np.ndarray, k: int, excluded: np.ndarray) -> np.ndarray:
        """Positions of the k highest scores, ties to smaller positions; ``excluded`` take no part."""
        tied = self.full.copy()
        for i in excluded:
            tied[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        certain, have = np.zeros(self.words, np.uint64), 0
        for s in reversed(self.add(query)):
            both = tied & s
            n = have + int(np.bitwise_count(both).sum())
            if n > k:
                tied = both
            else:
                certain, have = certain | both, n
                tied = tied & ~s
                if n == k:
                    return self._rows(certain)
        return np.concatenate([self._rows(certain), self._rows(tied)[: k - have]])

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.n])


def _matrix(column: pa.Array) -> np.ndarray:
    flat, ends = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
    width = int(ends.max()) if len(ends) else 0
    if (ends == width).all():
        return flat.reshape(len(ends), width)
    out = np.zeros((len(ends), width), np.int64)
    at = np.concatenate([np.arange(e) for e in ends]) if len(ends) else np.zeros(0, int)
    out[np.repeat(np.arange(len(ends)), ends), at] = flat
    return out


def _tables(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of a partition, at most ``size`` at a time."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        while count >= size:
            table = pa.Table.from_batches(held)
            yield table.slice(0, size)
            held, count = table.slice(size).to_batches(), count - size
    if count:
        yield pa.Table.from_batches(held)


def _parts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table.column("vec_id").combine_chunks().to_numpy(), _matrix(table.column("q").combine_chunks())


#: Rows of a task's input: the part they belong to, 0 for a segment and 1 for a block of queries, and up
#: to four arrays as bytes.
CELL = "part int, kind int, a binary, b binary, c binary, d binary"


def _row(part: int, kind: int, arrays: list[bytes]) -> pa.RecordBatch:
    made = [pa.array([part], pa.int32()), pa.array([kind], pa.int32()), *(pa.array([x], pa.binary()) for x in [*arrays, None, None][:4])]
    return pa.RecordBatch.from_arrays(made, names=["part", "kind", "a", "b", "c", "d"])


def _index(parts: int, rows: int):
    """Segments of this task's rows, numbered by the task; a row for each part that looks at it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() * parts
        for table in _tables(batches, rows):
            made = list(Segment.build(*_parts(table)))
            for p in range(parts):
                yield _row(first + p, 0, made)

    return run


def _ask(segments: int, parts: int, rows: int):
    """Blocks of queries; a row for each segment, at the part that a block falls to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId()
        for table in _tables(batches, rows):
            ids, values = _parts(table)
            made = [ids.astype("<i8").tobytes(), values.astype("<i8").tobytes()]
            for s in range(segments):
                yield _row(s * parts + n % parts, 1, made)
            n += 1

    return run


def _best(segment: Segment, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best rows of a segment for each query of a block."""
    width = len(segment.bits)  # components that one side lacks count as 0
    queries = np.pad(queries, ((0, 0), (0, max(0, width - queries.shape[1]))))[:, :width]
    out: list[tuple[np.ndarray, ...]] = []
    for q, own in zip(queries, query_ids):
        excluded = np.arange(np.searchsorted(segment.ids, own, "left"), np.searchsorted(segment.ids, own, "right"))
        best = segment.top(q, k, excluded)
        out.append((np.full(len(best), own), segment.ids[best], segment.scores(best, q)))
    columns = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def _score(k: int):
    """Rows sorted by part and kind: each segment is loaded, then the blocks behind it are looked up in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = -1, []
        for batch in batches:
            for i in range(batch.num_rows):
                part, kind, a, b, c, d = (batch.column(j)[i].as_py() for j in range(6))
                if part != at:
                    at, held = part, []
                if kind == 0:
                    held.append(Segment.load(a, b, c, d))
                    continue
                ids = np.frombuffer(a, "<i8")
                for segment in held:
                    yield _best(segment, ids, np.frombuffer(b, "<i8").reshape(len(ids), -1), k)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``vectors`` for each of ``queries`` (both vec_id, embedding)."""
    rows = vectors.select("vec_id", quantised().alias("q")).where("vec_id is not null and q is not null")
    asked = queries.select("vec_id", quantised().alias("q")).where("vec_id is not null and q is not null").groupBy("vec_id").agg(F.min("q").alias("q"))
    # Dealt out in turn, so that segments are full and no id can weigh one down.
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(1))).first()
    width = max(1, width)
    size = max(1, min(SEGMENT, SEGMENT_CELLS // width))
    segments = max(1, -(-n // size))
    parts = max(1, -(-2 * vectors.sparkSession.sparkContext.defaultParallelism // segments))
    index = rows.repartition(segments).mapInArrow(_index(parts, size), CELL)
    blocks = asked.mapInArrow(_ask(segments, parts, max(1, min(BLOCK, BLOCK_CELLS // width))), CELL)
    met = index.union(blocks).repartitionById(segments * parts, F.col("part")).sortWithinPartitions("part", "kind")
    found = met.mapInArrow(_score(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
