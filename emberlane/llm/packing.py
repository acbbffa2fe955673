"""Best-fit packing with exact complements.

Pieces are counted by length; a plan made from these counts alone says which lengths share a sequence, and every
piece finds its place through its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlane.llm.common import id_type, keyed_text, slices
from emberlane.llm.tokens import byte_bpe
from emberlane.session import materialise

END_ID = 0


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all of full length but perhaps the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(start, capacity) for start in range(first, n, capacity)]


def _cut(path: str, capacity: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(path).encode
        for batch in slices(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = encode(text)
                ids.append(END_ID)
                raw = memoryview(np.array(ids, dtype="<u4").tobytes())
                for number, (begin, size) in enumerate(piece_bounds(len(ids), capacity)):
                    row.append(i)
                    piece.append(number)
                    start.append(begin)
                    length.append(size)
                    crc.append(zlib.crc32(raw[4 * begin : 4 * (begin + size)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row, pa.int64())), *(pa.array(x, t.type) for x, t in zip((piece, start, length, crc), list(schema)[1:], strict=True))],
                schema=schema,
            )

    return run


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document's ids followed by the end id."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = f"id {id_type(docs)}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.mapInArrow(_cut(tokenizer_path, capacity, to_arrow_schema(StructType.fromDDL(ddl))), ddl)


PlanRow = tuple[int, int, int, int, int, int]


class SumIndex:
    """Which sums one, two or three of the available lengths make.

    ``have[s]``, ``pairs[s]`` and ``triples[s]`` count the (ordered) ways to make ``s``; when a length is used up, its ways are taken out
    by shifting the counts, so no pair or triple is listed.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.counts = {length: n for length, n in counts.items() if n and length <= capacity}
        self.have = np.zeros(capacity + 1, dtype=np.int64)
        self.have[list(self.counts)] = 1
        self.pairs = self._times(self.have, self.have)
        self.triples = self._times(self.pairs, self.have)

    def _times(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros(self.capacity + 1, dtype=np.int64)
        for s in np.flatnonzero(b):
            total[s:] += a[: self.capacity + 1 - s]
        return total

    def _shifted(self, a: np.ndarray, by: int) -> np.ndarray:
        moved = np.zeros_like(a)
        if by <= self.capacity:
            moved[by:] = a[: self.capacity + 1 - by]
        return moved

    def use(self, parts: tuple[int, ...], n: int) -> None:
        for length in parts:
            self.counts[length] -= n
        for length in set(parts):
            if self.counts[length]:
                continue
            one = np.zeros_like(self.have)
            one[0] = 1
            # (have - x)^3 = have^3 - 3 have^2 x + 3 have x^2 - x^3, and the same for squares.
            self.triples -= 3 * self._shifted(self.pairs, length) - 3 * self._shifted(self.have, 2 * length) + self._shifted(one, 3 * length)
            self.pairs -= 2 * self._shifted(self.have, length) - self._shifted(one, 2 * length)
            self.have[length] = 0

    def available(self, parts: tuple[int, ...]) -> int:
        """How many times over these lengths are there."""
        return min(self.counts.get(p, 0) // parts.count(p) for p in parts)

    def _pair(self, total: int, with_: tuple[int, ...], most: int) -> tuple[int, ...] | None:
        low = np.arange((total + 1) // 2, min(total - 1, most) + 1)
        for a in low[(self.have[low] > 0) & (self.have[total - low] > 0)][::-1].tolist():
            if self.available((*with_, a, total - a)):
                return (*with_, a, total - a)
        return None

    def complement(self, length: int, gap: int) -> tuple[int, ...] | None:
        """``length`` and the one, two or three lengths that add up to ``gap``, the longest ones first; None if there are none."""
        if not gap:
            return (length,)
        if self.have[gap] and self.available((length, gap)):
            return (length, gap)
        if self.pairs[gap] and (found := self._pair(gap, (length,), gap)):
            return found
        if self.triples[gap]:
            firsts = np.arange(-(-gap // 3), gap - 1)
            for a in firsts[(self.have[firsts] > 0) & (self.pairs[gap - firsts] > 0)][::-1].tolist():
                if found := self._pair(gap - a, (length, a), a):
                    return found
        return None


def plan_sequences(counts: dict[int, int], capacity: int) -> list[PlanRow]:
    """Rows (length, first_rank, n_ranks, per_sequence, first_sequence, offset) that place all pieces.

    Ranks first_rank ... of a length lie, ``per_sequence`` in each, in consecutive sequences at ``offset`` and after it.

    Exact fillings come first, longest lengths first: one, two or three available lengths that fill a sequence's gap exactly, as often
    as the counts allow. Short lengths, an eighth of the capacity at first, are kept out of them, as the residuals' gaps need
    something to be closed with, and so are pieces that the room beside long ones needs: what is left goes, longest first, into the
    smallest gap that holds it. If that takes more
    sequences than all lengths together need at least, other bounds for short lengths are tried and the best one is taken.
    Each step uses up a length or a group of equal gaps, so the plan's size depends on the capacity, not on the pieces.
    """
    least = -(-sum(length * n for length, n in counts.items()) // capacity)
    plans = []
    for sixteenths in (2, 3, 4, 1, 0, 5, 6, 7, 8):
        plans.append(_plan(counts, capacity, capacity * sixteenths // 16))
        if plans[-1][1] <= least:
            break
    return min(plans, key=lambda plan: plan[1])[0]


def _plan(counts: dict[int, int], capacity: int, short: int) -> tuple[list[PlanRow], int]:
    """A plan whose exact fillings use no length below ``short``, and its number of sequences."""
    left = {length: n for length, n in counts.items() if n}
    used: dict[int, int] = defaultdict(int)
    rows: list[PlanRow] = []
    sequences = 0

    def place(length: int, n: int, each: int, first: int, offset: int) -> None:
        rows.append((length, used[length], n * each, each, first, offset))
        used[length] += n * each
        left[length] -= n * each

    # Pieces above half the capacity need a sequence each. What the room beside them does not hold of the others may fill sequences
    # without them; more would leave that room empty. A filling with such a piece takes as much from either side.
    long = [length for length in left if 2 * length > capacity]
    over = sum(length * n for length, n in left.items()) - capacity * sum(left[length] for length in long)
    index = SumIndex({length: n for length, n in left.items() if length >= short}, capacity)
    for length in sorted(index.counts, reverse=True):
        while index.counts[length] and (parts := index.complement(length, capacity - length)):
            n, offset = index.available(parts), 0
            if 2 * length <= capacity:
                n = min(n, -(-over // capacity))
                if n <= 0:
                    break
                over -= n * capacity
            index.use(parts, n)
            for part in sorted(set(parts), reverse=True):
                place(part, n, parts.count(part), sequences, offset)
                offset += part * parts.count(part)
            sequences += n

    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first sequence, how many)
    for length in sorted(left, reverse=True):
        while left[length]:
            gap = min((g for g in gaps if g >= length), default=None)
            if gap is None:
                # As many in each new sequence as fit; a last sequence that stays short of them is made on its own.
                each = min(capacity // length, left[length])
                n = left[length] // each
                place(length, n, each, sequences, 0)
                if rest := capacity - length * each:
                    gaps[rest].append((sequences, n))
                sequences += n
                continue
            first, there = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
            each = min(gap // length, max(1, left[length] // there))
            n = min(there, left[length] // each)
            place(length, n, each, first, capacity - gap)
            if n < there:
                gaps[gap].append((first + n, there - n))
            if rest := gap - length * each:
                gaps[rest].append((first, n))
    return rows, sequences


def _locate(plan: list[PlanRow], schema: pa.Schema):
    table = np.array(sorted(plan), dtype=np.int64).reshape(-1, 6)
    # Lengths below 2**20 and ranks below 2**43 in one sortable number.
    keys = (table[:, 0] << 43) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = table[np.searchsorted(keys, (length << 43) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            sequence, offset = row[:, 4] + nth // row[:, 3], row[:, 5] + nth % row[:, 3] * length
            kept = [batch.column(f.name) for f in schema if f.name not in ("sequence_id", "offset")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], schema=schema)

    return run


def ranked(pieces: DataFrame, rows_per_window: int = 50_000) -> DataFrame:
    """``pieces`` with ``rank``: from 0, gapless among the pieces of equal length.

    A length that very many pieces share is ranked in lanes, and a lane starts where the lanes before it end.
    """
    spark = pieces.sparkSession
    lanes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pieces.count() // rows_per_window + 1)
    dealt = pieces.withColumn("lane", F.pmod(F.xxhash64("id", "piece"), F.lit(lanes)))
    sizes = dealt.groupBy("length", "lane").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # One row for each length and lane, read once: written, they would only add a small file for each lane.
    inside = F.row_number().over(Window.partitionBy("length", "lane").orderBy("id", "piece", "start", "ids_crc32"))
    numbered = dealt.withColumn("inside", inside)
    return numbered.join(starts, ["length", "lane"]).withColumn("rank", F.col("before") + F.col("inside") - 1)


def pack(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids (special strings as the tokenizers library reads them by default) and the end id 0. Only
    documents longer than ``capacity`` are cut, into pieces of that length, the first one perhaps shorter. Sequences are
    filled without gaps from offset 0. Texts are read once and encoded where they are read; what is shuffled after
    that is one short row for each piece.

    The driver sees the number of pieces of each length, ``capacity`` numbers at most, and plans with them.
    Null text counts as empty: one piece holding the end id. Rows with a null or repeated id are packed like any other.
    An empty table gives no rows. Other columns are not read.
    """
    if not 0 < capacity < 1 << 20:
        raise ValueError("capacity must be between 1 and 2**20 - 1")
    pieces = materialise(cut_pieces(keyed_text(docs, id_col, text_col), tokenizer_path, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_sequences(counts, capacity)
    ddl = f"id {id_type(pieces)}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))
    places = ranked(pieces).select("id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_locate(plan, schema), ddl)
    return places.withColumnRenamed("id", id_col)
