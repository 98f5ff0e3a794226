"""Bulk-synchronous best-fit packing of tokenised documents into sequences of a fixed capacity.

1. Every whole text becomes token ids, ends with the end id and is cut into pieces of at most ``capacity`` ids; the
   pieces are written to the shared folder.
2. Pieces are packed by bands of lengths, from the longest down; a band's longest piece is at most twice its shortest, but
   for the last, of pieces that most gaps hold many times.
   A superstep range-sorts the band's pieces and the gaps of all open sequences by size into one order.
3. Each range is swept from large to small: a piece takes its successor, the smallest gap so far that holds it, and what
   is left of the gap is a gap again. Pieces without a gap in their range want gaps of the ranges before; which, is settled
   by rank: the r-th piece left over in a range gets the r-th gap left over before it, nearest range first. A gap that
   is many times as large as the pieces takes as many of them. The driver sees counts and extremes of each range only.
4. Gaps are updated and the pieces left over sweep again until nothing moves. Those without any gap open sequences, range
   by range, each filled by the same sweep; then the next band follows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findoc.llm.common import BATCH_ROWS, few, map_batches, release, written
from findoc.llm.tokens import encoder

#: Rows of a range in a superstep, about; up to so many are one range.
RANGE = 50_000
#: Lengths up to capacity / NARROWEST are one band.
NARROWEST = 8
#: What a row of a sweep is: a gap that the sweep left alone, a piece without a place, a placed piece, what is left of a gap.
GAP, PIECE, PLACED, REST = range(4)
_SWEPT = "part int, kind int, rank long, id long, size long, sequence_id long, offset long"


def tokenise(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) for each piece of each document; a null text is empty."""
    kind = dict(docs.dtypes)[id_col]
    kind = kind if kind in ("bigint", "int", "string") else "string"
    end = np.array([end_id], dtype="<u4").tobytes()

    def make():
        encode = encoder(tokenizer)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, raw in enumerate(encode([t or "" for t in batch.column(1).to_pylist()])):
                raw += end
                for n, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append(k)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)

        return each

    rows = docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, make, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def sweep(rows: Iterator[tuple[int, int, int]], part: int, capacity: int, opening: int | None) -> Iterator[tuple]:
    """Rows of _SWEPT for (kind, id, size) of gaps and pieces by descending size, gaps first among equals.

    With ``opening`` a piece that no gap holds opens a sequence, whose number starts with it; otherwise it is left over.
    Left-over pieces are ranked by descending size, gaps that were left alone by ascending size.
    """
    rooms: list[int] = []  # sizes of the gaps that are there, ascending
    held: dict[int, list[tuple[int, bool]]] = {}  # size: (sequence, whether the sweep has used it)
    left = opened = 0

    def give(room: int, sequence: int, used: bool) -> None:
        if room not in held:
            held[room] = []
            insort(rooms, room)
        held[room].append((sequence, used))

    for kind, key, size in rows:
        if kind == GAP:
            give(size, key, False)
            continue
        k = bisect_left(rooms, size)
        if k < len(rooms):
            room = rooms[k]
            sequence, _ = held[room].pop()
            if not held[room]:
                del held[room], rooms[k]
        elif opening is None:
            yield part, PIECE, left, key, size, None, None
            left += 1
            continue
        else:
            room, sequence = capacity, (opening << 44) | (part << 28) | opened
            opened += 1
        yield part, PLACED, None, key, size, sequence, capacity - room
        if room > size:
            give(room - size, sequence, True)
    rank = 0
    for room in rooms:
        for sequence, used in held[room]:
            yield part, REST if used else GAP, None if used else rank, sequence, room, None, None
            rank += not used


def _swept(rows: DataFrame, n: int, capacity: int, opening: int | None = None) -> DataFrame:
    """A table of _SWEPT of about ``n`` rows (kind, id, size), swept range by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        triples = (t for b in batches for t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
        found: list[tuple] = []

        def out() -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)]
            found.clear()
            return pa.RecordBatch.from_arrays(columns, ["part", "kind", "rank", "id", "size", "sequence_id", "offset"])

        for row in sweep(triples, part, capacity, opening):
            found.append(row)
            if len(found) == 8192:
                yield out()
        if found:
            yield out()

    order = [F.col("size").desc(), F.col("kind").asc(), F.xxhash64("id").asc(), F.col("id").asc()]
    rows = rows.select("kind", "id", "size")
    dealt = (rows.coalesce(1) if n <= RANGE else rows.repartitionByRange(1 + n // RANGE, *order)).sortWithinPartitions(*order)
    return written(dealt.mapInArrow(run, _SWEPT), "swept")


def by_rank(counts: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Which left-over pieces get which left-over gaps, from (part, kind, n, least, most) of each range's pieces and gaps.

    (part, first, end, owner, at, per): pieces of ranks first to end - 1 of ``part`` get the gaps of ``owner`` from rank
    ``at`` on, ``per`` pieces a gap. Gaps of earlier ranges hold every piece of later ones; the nearest come first.
    """
    pieces, gaps = ({c[0]: c[2:] for c in counts if c[1] == kind} for kind in (PIECE, GAP))
    stack: list[list[int]] = []  # owner, next rank, end, least size
    out = []
    for part in sorted({*pieces, *gaps}):
        n, _, longest = pieces.get(part, (0, 0, 1))
        done = 0
        while done < n and stack:
            owner, at, end, least = stack[-1]
            per = max(1, least // longest)
            use = min(end - at, -(-(n - done) // per))
            take = min(n - done, use * per)
            out.append((part, done, done + take, owner, at, per))
            done += take
            stack[-1][1] += use
            if stack[-1][1] == end:
                stack.pop()
        if part in gaps:
            stack.append([part, 0, gaps[part][0], gaps[part][1]])
    return out


def _settled(swept: DataFrame, intervals: list[tuple], n: int, capacity: int) -> DataFrame:
    """A table of (kind, id, size, sequence_id, offset): pieces placed by rank, the gaps after that, and pieces still without a place."""
    spark = swept.sparkSession
    # two or three small rows a range
    given = spark.createDataFrame(intervals, "part int, first long, end long, owner int, at long, per long")
    p, g = swept.where(F.col("kind") == PIECE).alias("p"), F.broadcast(given).alias("g")
    inside = (F.col("p.part") == F.col("g.part")) & (F.col("p.rank") >= F.col("g.first")) & (F.col("p.rank") < F.col("g.end"))
    pieces = p.join(g, inside, "left").select("p.rank", "p.id", "p.size", "g.owner", "g.first", "g.at", "g.per")
    wanted = pieces.where("owner is not null").select("owner", (F.col("at") + F.floor((F.col("rank") - F.col("first")) / F.col("per"))).alias("slot"), "rank", "id", "size")
    gaps = swept.where(F.col("kind") == GAP).select(F.col("part").alias("owner"), F.col("rank").alias("slot"), F.col("id").alias("sequence_id"), F.col("size").alias("room"))
    before = Window.partitionBy("owner", "slot").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.lit(capacity) - F.col("room") + F.coalesce(F.sum("size").over(before), F.lit(0))
    placed = wanted.join(gaps, ["owner", "slot"]).select(F.lit(PLACED).alias("kind"), "id", "size", "sequence_id", offset.alias("offset"))
    filled = wanted.groupBy("owner", "slot").agg(F.sum("size").alias("size"))
    rest = gaps.join(filled, ["owner", "slot"], "left").select("sequence_id", (F.col("room") - F.coalesce("size", F.lit(0))).alias("room")).where("room > 0")
    none = F.lit(None).cast("long")
    out = placed.union(rest.select(F.lit(GAP), F.col("sequence_id"), F.col("room"), none, none))
    out = out.union(pieces.where("owner is null").select(F.lit(PIECE), "id", "size", none, none))
    return written(few(out, n, RANGE), "settled")


def best_fit(pieces: DataFrame, capacity: int) -> DataFrame:
    """(row, sequence_id, offset) of ``pieces`` (row, length), a written table with distinct rows and lengths of 1 to ``capacity``."""
    spark = pieces.sparkSession
    highs = [capacity]
    while highs[-1] // 2 >= max(1, capacity // NARROWEST):
        highs.append(highs[-1] // 2)
    lows = [*highs[1:], 0]
    in_band = F.lit(0)
    for k, low in enumerate(lows):
        in_band = F.when(F.col("length") <= low, k + 1).otherwise(in_band) if k + 1 < len(lows) else in_band
    sizes = {r["band"]: r["n"] for r in pieces.groupBy(in_band.alias("band")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a band
    gaps = spark.createDataFrame([], "id long, size long")
    n_gaps, step, tables, done = 0, 0, [], []

    def place(table: DataFrame) -> DataFrame:
        tables.append(table)
        done.append(table.where(F.col("kind") == PLACED).select(F.col("id").alias("row"), "sequence_id", "offset"))
        return table

    for band, (low, high) in enumerate(zip(lows, highs, strict=True)):
        left = sizes.get(band, 0)
        if not left:
            continue
        waiting = pieces.where((F.col("length") > low) & (F.col("length") <= high)).select(F.col("row").alias("id"), F.col("length").alias("size"))
        small = gaps.where(F.col("size") <= low)
        able = gaps.where(F.col("size") > low)
        moved = n_gaps > 0
        while left and moved:
            both = able.select(F.lit(GAP).alias("kind"), "id", "size").union(waiting.select(F.lit(PIECE), "id", "size"))
            swept = place(_swept(both, left + n_gaps, capacity))
            counts = [tuple(r) for r in swept.groupBy("part", "kind").agg(F.count(F.lit(1)), F.min("size"), F.max("size")).collect()]  # a few rows a range
            intervals = by_rank(counts)
            still = sum(c[2] for c in counts if c[1] == PIECE) - sum(i[2] - i[1] for i in intervals)
            # within one range the sweep has left nothing to move
            moved, left = still < left and len({c[0] for c in counts}) > 1, still
            able = swept.where(F.col("kind") == REST).select("id", "size")
            if intervals:
                settled = place(_settled(swept, intervals, left + n_gaps, capacity))
                able = able.union(settled.where(F.col("kind") == GAP).select("id", "size"))
                waiting = settled.where(F.col("kind") == PIECE).select("id", "size")
            else:
                able = able.union(swept.where(F.col("kind") == GAP).select("id", "size"))
                waiting = swept.where(F.col("kind") == PIECE).select("id", "size")
        if left:  # no gap holds them
            step += 1
            opened = place(_swept(waiting.select(F.lit(PIECE).alias("kind"), "id", "size"), left, capacity, step))
            able = able.union(opened.where(F.col("kind") == REST).select("id", "size"))
        gaps, n_gaps = small.union(able), n_gaps + left  # at most so many: a piece opens one sequence or none
    out = spark.createDataFrame([], "row long, sequence_id long, offset long")
    for part in done:
        out = out.union(part)
    out = written(few(out, sum(sizes.values()), RANGE), "placements")
    release(*tables)
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens, as few as best fit by decreasing bands of lengths needs.

    Returns a row for each piece: doc_id, piece (from 0), start (ids of the document before it), length, ids_crc32,
    sequence_id, offset (gapless from 0 within a sequence), with ``with_ids`` also ids. Only documents longer than
    ``capacity`` are cut. A null or empty text is the end id alone. Repeated rows are packed as often as they come,
    null ids too; no rows give no rows. Other columns of ``docs`` are ignored, whatever their names.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    pieces = tokenise(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids).withColumn("row", F.monotonically_increasing_id())
    pieces = written(pieces, "pieces", BATCH_ROWS)
    return pieces.join(best_fit(pieces.select("row", "length"), capacity), "row").drop("row")
