"""Packing of tokenised documents into sequences of a fixed capacity (operator 12), by minimum
bin slack.

A document of ``q * capacity + r`` tokens fills ``q`` sequences of its own; the remaining length
``r`` is what has to be packed. There are fewer than ``capacity`` such lengths, however many
documents there are, so the packing is planned on their counts alone. For each window the longest
remaining length is set and a bitset subset-sum over the counted lengths finds the multiset that
comes closest to the capacity; walking back through the bitsets gives how many of each length
it takes. The same multiset is used for as many windows as the counts allow. Where a window
cannot be filled exactly, one more piece is cut to fill it, and its tail goes back to the counts
as a length of its own. What is left in the end (less than one capacity) is laid out and cut at
powers of two, where sequences need no padding. So every sequence is full or a power of two.

Spark does the rest: ids are encoded once into a written table in which every row knows its rank
among the rows of its length in its partition; a running sum over partitions makes the ranks
global. A row then finds its places in the plan by its length and rank. No text or id is shuffled
while the running sums fit a broadcast (``MAX_OFFSETS``); beyond it the written rows are joined
with them by partition.

Defined results: a null or empty text is one end id. Rows that repeat a text or ``doc_id`` are
packed as documents of their own; extra columns are not read; an empty table gives an empty
result. Which document of a length goes to which sequence follows the order of the written table.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marksmith.llm.byte_bpe import byte_bpe, default_file
from marksmith.llm.common import (checkpointed, map_batches, read, short_batches, text_column,
                                  written)

CAPACITY = 1024
END_ID = 0
#: Offsets (partitions x lengths, 8 bytes each) up to this many are broadcast.
MAX_OFFSETS = 4_000_000
#: Pieces of one Arrow batch that a task returns.
BATCH_PIECES = 2000


@dataclass(frozen=True)
class Places:
    """Where the items of one length with ranks from ``low`` on go: ``copies`` to a sequence,
    ``head`` of their tokens each, one behind the other from ``offset``. A tail that was cut off
    is an item of length ``length - head``, with ranks from ``tail`` on."""

    length: int
    low: int
    copies: int
    head: int
    sequence: int
    offset: int
    tail: int


def closest_multiset(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of at most ``counts`` lengths whose sum comes closest to ``room`` from below,
    as ``{length: how many}``. Long lengths are taken first where several multisets are best."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, take = left - take, take * 2
        if reach >> room:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


class Plan:
    """Places for all items of the counted lengths, and how many sequences they take."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.sequences = 0
        self.places: dict[int, list[Places]] = {}
        self._left = {n: c for n, c in counts.items() if c > 0}
        self._used = dict.fromkeys(counts, 0)
        while self._left:
            self._fill()
        self._lows = {n: [p.low for p in found] for n, found in self.places.items()}

    def _take(self, length: int, items: int, copies: int, head: int, sequence: int,
              offset: int) -> None:
        tail = 0
        if head < length:
            rest = length - head
            tail = self._used.get(rest, 0) + self._left.get(rest, 0)
            self._left[rest] = self._left.get(rest, 0) + items
            self._used.setdefault(rest, 0)
        low = self._used[length]
        self.places.setdefault(length, []).append(
            Places(length, low, copies, head, sequence, offset, tail))
        self._used[length] = low + items
        self._left[length] -= items
        if not self._left[length]:
            del self._left[length]

    def _fill(self) -> None:
        longest = max(self._left)
        others = dict(self._left)
        others[longest] -= 1
        chosen = closest_multiset(others, self.capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        slack = self.capacity - sum(n * k for n, k in chosen.items())
        need = dict(chosen)
        cut = None
        if slack:
            # whatever is left is longer than the slack, or the multiset would hold it
            cut = max((n for n, c in self._left.items() if c > chosen.get(n, 0)), default=None)
            if cut is None:
                return self._finish()
            need[cut] = need.get(cut, 0) + 1
        windows = min(self._left[n] // k for n, k in need.items())
        offset = 0
        for n, k in sorted(chosen.items(), reverse=True):
            self._take(n, windows * k, k, n, self.sequences, offset)
            offset += n * k
        if cut is not None:
            self._take(cut, windows, 1, slack, self.sequences, offset)
        self.sequences += windows

    def _finish(self) -> None:
        """Lay out all that is left (less than one capacity) and cut it at powers of two."""
        total = sum(n * c for n, c in self._left.items())
        sizes = [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
        room, at = sizes.pop(0), 0
        while self._left:
            n = max(self._left)
            while True:
                head = min(n, room - at)
                self._take(n, 1, 1, head, self.sequences, at)
                at += head
                if at == room:
                    self.sequences += 1
                    room, at = (sizes.pop(0) if sizes else 0), 0
                if head == n:
                    break
                n -= head

    def locate(self, length: int, rank: int) -> Iterator[tuple[int, int, int]]:
        """``(tokens, sequence, offset)`` of the pieces of one item, from its front."""
        while length:
            p = self.places[length][bisect_right(self._lows[length], rank) - 1]
            item = rank - p.low
            yield p.head, p.sequence + item // p.copies, p.offset + item % p.copies * p.head
            length, rank = length - p.head, p.tail + item


def encoded(docs: DataFrame, file: str, capacity: int = CAPACITY) -> DataFrame:
    """Written table of every document's ids with the end id, packed in 2 or 4 bytes each
    (``wide``), and its ranks in its partition: of its remaining length, and of its full
    sequences."""
    rows = docs.select(F.spark_partition_id().alias("part"), "doc_id", text_column().alias("_t"))
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), docs.schema["doc_id"],
        T.StructField("doc_tokens", T.LongType()), T.StructField("rest", T.IntegerType()),
        T.StructField("rank", T.LongType()), T.StructField("full_rank", T.LongType()),
        T.StructField("wide", T.BooleanType()), T.StructField("ids", T.BinaryType())])

    def run(batch: pa.RecordBatch, seen: np.ndarray) -> dict:
        bpe = byte_bpe(file)
        out = {name: [] for name in ("doc_tokens", "rest", "rank", "full_rank", "wide", "ids")}
        for t in batch.column("_t").to_pylist():
            ids = bpe.encode(t)
            ids = np.append(ids, np.uint32(END_ID))
            full, rest = divmod(len(ids), capacity)
            wide = int(ids.max()) > 0xFFFF
            out["doc_tokens"].append(len(ids))
            out["rest"].append(rest)
            out["rank"].append(int(seen[rest]))
            out["full_rank"].append(int(seen[capacity]))
            out["wide"].append(wide)
            out["ids"].append(ids.astype("<u4" if wide else "<u2").tobytes())
            seen[rest] += 1
            seen[capacity] += full
        return out | {"part": batch.column("part"), "doc_id": batch.column("doc_id")}

    return written(map_batches(rows, run, schema, lambda: np.zeros(capacity + 1, dtype=np.int64)),
                   "packing-ids")


def part_offsets(table: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, dict[int, int], int]:
    """``(part, offsets)`` with the count of each length (and, at ``capacity``, of full sequences)
    in earlier partitions; the counts of all partitions, a row a length; how many offsets."""
    counts = table.groupBy("part", F.col("rest").alias("n")).agg(
        F.count(F.lit(1)).alias("c"), F.sum(F.floor(F.col("doc_tokens") / capacity)).alias("q"))
    # one row for each partition and length
    per = counts.select("part", "n", "c").unionByName(
        counts.groupBy("part").agg(F.lit(capacity).alias("n"), F.sum("q").alias("c")))
    per = checkpointed(per)
    earlier = F.coalesce(F.sum("c").over(
        Window.partitionBy("n").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))
    offsets = per.select("part", "n", earlier.alias("before")).groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct("n", "before"))).alias("before"))
    totals = {r["n"]: r["c"] for r in per.groupBy("n").agg(F.sum("c").alias("c")).collect()}
    return offsets, totals, per.count()


def pack(docs: DataFrame, file: str, capacity: int = CAPACITY,
         max_offsets: int = MAX_OFFSETS) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``; ``ids``
    are the piece's ids as little-endian unsigned 32-bit integers."""
    table = encoded(docs, file, capacity)
    offsets, totals, n_offsets = part_offsets(table, capacity)
    plan = Plan({n: c for n, c in totals.items() if 0 < n < capacity}, capacity)
    own = plan.sequences
    ranked = table.join(F.broadcast(offsets) if n_offsets <= max_offsets else offsets.hint("merge"),
                        "part").select(
        "doc_id", "doc_tokens", "rest", "wide", "ids",
        (F.col("rank") + F.col("before")[F.col("rest")]).alias("rank"),
        (F.col("full_rank") + F.col("before")[F.lit(capacity)]).alias("full_rank"))
    schema = T.StructType([
        table.schema["doc_id"], T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType())])
    arrow = to_arrow_schema(schema)
    short_batches(docs.sparkSession)

    def pieces(total: int, rest: int, rank: int, full_rank: int) -> Iterator[tuple]:
        for k in range(total // capacity):
            yield k * capacity, capacity, own + full_rank + k, 0
        start = total - rest
        for size, sequence, offset in plan.locate(rest, rank):
            yield start, size, sequence, offset
            start += size

    def run(batches):
        rows = []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in
                    ("doc_id", "doc_tokens", "rest", "rank", "full_rank", "wide", "ids")]
            for doc_id, total, rest, rank, full_rank, wide, raw in zip(*cols, strict=True):
                ids = np.frombuffer(raw, dtype="<u4" if wide else "<u2").astype("<u4")
                for start, size, sequence, offset in pieces(total, rest, rank, full_rank):
                    rows.append((doc_id, start, size, ids[start:start + size].tobytes(), total,
                                 sequence, offset))
                    if len(rows) >= BATCH_PIECES:
                        yield _batch(rows, arrow)
                        rows = []
        if rows:
            yield _batch(rows, arrow)

    return ranked.mapInArrow(run, schema)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(col, type=f.type) for col, f in zip(zip(*rows), arrow, strict=True)],
        schema=arrow)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(read(spark, sf_dir, "documents"), default_file())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


ORACLE_SQL = None
