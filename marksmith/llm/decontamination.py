"""Benchmark decontamination by q-gram lemma filtering and banded alignment (operator 1).

A benchmark text of m bytes that occurs in a document with at most k edits shares at least
``m + 1 - q * (k + 1)`` of its q-grams with the region, all on diagonals within k of each other.
Documents are scanned once per block of benchmark texts: shared q-grams are counted in
overlapping diagonal bands, bands that reach the lemma's count are verified by banded alignment.
The documents are never shuffled or collected; a block's index is broadcast and bounded by
BLOCK_BYTES of benchmark text, and any number of blocks follow one another.

Texts are compared normalised: lower-cased UTF-8 in which each run of ASCII marks and white
space is one space. Edits and lengths are counted in these bytes. Longer benchmark texts are
searched by overlapping parts of PART_BYTES, any one of which is enough; a text of up to
PART_BYTES counts only where the whole of it occurs within its edits, so a document that quotes
a part of such a text stays clean.

Defined results: a null text is the empty text and matches nothing. Benchmark texts that are
null or have under ``q`` bytes when normalised are no evidence and match nothing. Rows are judged
one by one, so ties, repeated rows and extra columns have no influence; an empty benchmark
leaves every document clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marksmith.llm.common import (checkpointed, keep_or_drop_ids, map_batches, packed, read,
                                  short_batches, text_column, unpacked)

#: Length of the grams; eight bytes are compared as one integer.
Q = 8
#: Edits allowed per byte of the benchmark text.
EDIT_RATE = 0.08
#: Benchmark texts above this are searched by parts of this length, half overlapping.
PART_BYTES = 512
#: Benchmark bytes in one broadcast index.
BLOCK_BYTES = 4_000_000
#: Document bytes scanned at a time; longer texts are scanned in pieces of this length.
SCAN_BYTES = 1 << 20
#: Hits of grams counted at a time.
HIT_ROWS = 4_000_000
HASH_BITS = 22

_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normalised(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_SPACED).split())


def budget(m: int, q: int = Q, rate: float = EDIT_RATE) -> int:
    """Edits allowed for m bytes: the rate's, as far as the lemma still asks for a shared gram."""
    return min(int(rate * m), (m - q) // q)


def parts_of(item: bytes) -> list[bytes]:
    if len(item) <= PART_BYTES:
        return [item]
    step = PART_BYTES // 2
    starts = [*range(0, len(item) - PART_BYTES, step), len(item) - PART_BYTES]
    return [item[s:s + PART_BYTES] for s in starts]


def _codes(buf: bytes) -> np.ndarray:
    """The eight bytes from each position on, as integers."""
    return np.ndarray(shape=(max(len(buf) - Q + 1, 0),), dtype="<u8", buffer=buf, strides=(1,))


def _slots(codes: np.ndarray) -> np.ndarray:
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.zeros(len(key), dtype=np.int64)
    np.add.at(n, at, np.concatenate(counts))
    return key, n


class Index:
    """The q-grams of a block of patterns, with their places."""

    def __init__(self, patterns: list[tuple[int, bytes]]):
        self.items = [i for i, _ in patterns]
        self.patterns = [p for _, p in patterns]
        self.k = np.array([budget(len(p)) for p in self.patterns], dtype=np.int64)
        self.need = np.array([len(p) + 1 - Q * (budget(len(p)) + 1) for p in self.patterns])
        codes = np.concatenate([_codes(p) for p in self.patterns])
        pattern = np.repeat(np.arange(len(patterns)), [len(p) - Q + 1 for p in self.patterns])
        place = np.concatenate([np.arange(len(p) - Q + 1) for p in self.patterns])
        order = np.argsort(codes, kind="stable")
        self.grams, first = np.unique(codes[order], return_index=True)
        self.first = np.append(first, len(codes))
        self.pattern, self.place = pattern[order], place[order]
        self.seen = np.zeros(1 << HASH_BITS, dtype=bool)
        self.seen[_slots(self.grams)] = True
        # one band width for all patterns: at least the largest budget
        self.band = int(self.k.max(initial=0)) + 1

    def _hits(self, buf: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places in the text whose gram is in the index, the gram's first entry and its number of
        entries: a piece of the text, and HIT_ROWS entries, at a time."""
        codes = _codes(buf)
        for start in range(0, len(codes), SCAN_BYTES):
            piece = codes[start:start + SCAN_BYTES]
            at = np.flatnonzero(self.seen[_slots(piece)])
            gram = np.searchsorted(self.grams, piece[at])
            gram[gram == len(self.grams)] = 0
            real = self.grams[gram] == piece[at]
            at, gram = at[real] + start, gram[real]
            if not len(at):
                continue
            first = self.first[gram]
            size = self.first[gram + 1] - first
            run = np.cumsum(size) // HIT_ROWS
            for cut in np.split(np.arange(len(at)), np.flatnonzero(np.diff(run)) + 1):
                yield at[cut], first[cut], size[cut]

    def _counted(self, at: np.ndarray, first: np.ndarray, size: np.ndarray, shift: int,
                 width: int) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(size)
        entry = np.arange(ends[-1]) + np.repeat(first - (ends - size), size)
        band = (np.repeat(at, size) - self.place[entry] + shift) // self.band
        return np.unique(self.pattern[entry] * width + band, return_counts=True)

    def bands(self, buf: bytes) -> list[tuple[int, int]]:
        """``(pattern, first diagonal)`` of the doubled bands that reach the lemma's count."""
        shift = PART_BYTES + self.band
        width = (len(buf) + 2 * shift) // self.band + 3
        keys, counts, held = [], [], 0
        for hits in self._hits(buf):
            key, n = self._counted(*hits, shift, width)
            keys.append(key)
            counts.append(n)
            held += len(key)
            if held > HIT_ROWS:
                key, n = _summed(keys, counts)
                keys, counts, held = [key], [n], 0
        if not keys:
            return []
        key, n = _summed(keys, counts)
        # a match lies on diagonals at most k apart: in one band or in two neighbours
        after = np.zeros(len(n), dtype=n.dtype)
        near = key[1:] == key[:-1] + 1
        after[:-1][near] = n[1:][near]
        lone = np.ones(len(n), dtype=bool)
        lone[1:][near] = False  # its hits also count with the band before
        need = self.need[key // width]
        good = (n + after >= need) | (lone & (n >= need))
        return [(int(x) // width, (int(x) % width) * self.band - shift) for x in key[good]]

    def search(self, buf: bytes, starts: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """``{(text number, item): (regions, least edits, end of the best)}`` over texts joined
        with separators; ``starts`` are their first bytes and one end."""
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        for p, diagonal in self.bands(buf):
            pattern, k = self.patterns[p], int(self.k[p])
            low, high = diagonal - k, diagonal + 2 * self.band + len(pattern) + k
            first = max(int(np.searchsorted(starts, low, "right")) - 1, 0)
            last = int(np.searchsorted(starts, min(high, starts[-1] - 1), "right")) - 1
            for text in range(first, last + 1):
                a, b = int(starts[text]), int(starts[text + 1]) - Q
                lo, hi = max(low, a), min(high, b)
                if hi - lo < len(pattern) - k:
                    continue
                got = align(pattern, buf, lo, hi, diagonal - k, 2 * self.band + 2 * k, k)
                if got is None:
                    continue
                key = (text, self.items[p])
                n, edits, end = found.get(key, (0, k + 1, 0))
                best = min((edits, end), (got[0], got[1] - a)) if n else (got[0], got[1] - a)
                found[key] = (n + 1, *best)
        return found


def align(pattern: bytes, buf: bytes, low: int, high: int, diagonal: int, width: int,
          k: int) -> tuple[int, int] | None:
    """Least edits (at most k) of the pattern against a part of buf[low:high], and where that
    ends, on the diagonals [diagonal, diagonal + width]; None beyond k."""
    exact = buf.find(pattern, low, high)
    if exact >= 0:
        return 0, exact + len(pattern)
    m, cells = len(pattern), width + 1
    # text from the first diagonal on; bytes outside [low, high) match nothing
    span = np.zeros(m + cells + 1, dtype=np.uint8)
    a, b = max(low, diagonal), min(high, diagonal + m + cells)
    if b <= a:
        return None
    span[a - diagonal:b - diagonal] = np.frombuffer(buf, dtype=np.uint8)[a:b]
    ramp = np.arange(cells, dtype=np.int32)
    row = np.zeros(cells, dtype=np.int32)
    for i in range(m):
        step = row + (span[i:i + cells] != pattern[i])
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        row = np.minimum.accumulate(step - ramp) + ramp
        if row.min() > k:
            return None
    best = int(row.argmin())
    return (int(row[best]), min(diagonal + m + best, high)) if row[best] <= k else None


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Index]:
    """Indexes over the benchmark, one bounded block of patterns at a time."""
    patterns: list[tuple[int, bytes]] = []
    size = 0
    rows = benchmark.filter("text is not null").select("item_id", "text")
    for item, text in rows.toLocalIterator():
        for part in parts_of(normalised(text)):
            if len(part) < Q:
                continue
            if size + len(part) > block_bytes and patterns:
                yield Index(patterns)
                patterns, size = [], 0
            patterns.append((item, part))
            size += len(part)
    if patterns:
        yield Index(patterns)


def _scan(texts: list[str], index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """``(row, item, regions, edits, end)`` of a batch, scanned in joined pieces."""
    row = 0
    while row < len(texts):
        joined, starts, first = [], [0], row
        while row < len(texts) and (row == first or starts[-1] < SCAN_BYTES):
            one = normalised(texts[row])
            joined.append(one)
            starts.append(starts[-1] + len(one) + Q)
            row += 1
        buf = (b"\0" * Q).join(joined) + b"\0" * Q
        found = index.search(buf, np.array(starts, dtype=np.int64))
        for (text, item), (n, edits, end) in found.items():
            yield first + text, item, n, edits, end


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_regions, edits, region_end`` of each document and benchmark text
    that it holds; ``region_end`` counts normalised bytes."""
    schema = T.StructType([docs.schema["doc_id"], benchmark.schema["item_id"]]
                          + T.StructType.fromDDL("n_regions long, edits long, region_end long")
                          .fields)
    arrow = to_arrow_schema(schema)
    spark = docs.sparkSession
    short_batches(spark)
    source = docs.select("doc_id", text_column().alias("_t"))
    out = None
    for index in blocks(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = list(_scan(batch.column("_t").to_pylist(), shared.value))
                ids = batch.column("doc_id")
                cols = list(zip(*hits, strict=True)) if hits else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(cols[0], type=pa.int64())),
                     *[pa.array(c, type=f.type) for c, f in zip(cols[1:], list(arrow)[1:],
                                                                strict=True)]], schema=arrow)

        one = checkpointed(source.mapInArrow(run, schema))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], schema)
    # parts of one long item, or one item in two blocks, are one match
    return out.groupBy("doc_id", "item_id").agg(
        F.sum("n_regions").alias("n_regions"), F.min("edits").alias("edits"),
        F.min_by("region_end", F.struct("edits", "region_end")).alias("region_end"))


def clean_documents(docs: DataFrame, benchmark: DataFrame,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no benchmark text, with their columns unchanged.

    A benchmark of one block is a filter in one stage. With more blocks, each block has its own
    job, which keeps the digests of the texts that hit it; documents with such a digest go.
    """
    spark = docs.sparkSession
    short_batches(spark)
    schema = docs.schema
    dropped, waiting = None, None
    for index in blocks(benchmark, block_bytes):
        if waiting is not None:
            found = _hit_digests(docs, waiting)
            dropped = found if dropped is None else dropped.unionByName(found)
        waiting = index
    if waiting is None:
        return docs
    if dropped is not None:
        dropped = checkpointed(dropped.unionByName(_hit_digests(docs, waiting)).distinct())
        rows = packed(docs, digest=F.md5(text_column().cast("binary")))
        return unpacked(keep_or_drop_ids(rows, dropped, ["digest"], "left_anti"))
    shared = spark.sparkContext.broadcast(waiting)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keep = np.ones(len(texts), dtype=bool)
            for hit in _scan(texts, shared.value):
                keep[hit[0]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)


def _hit_digests(docs: DataFrame, index: Index) -> DataFrame:
    """``digest`` of every text that holds a text of the block."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column("_t").to_pylist()
        hit = {row for row, *_ in _scan(texts, shared.value)}
        return {"digest": [hashlib.md5(texts[i].encode("utf-8")).hexdigest() for i in sorted(hit)]}

    return checkpointed(map_batches(docs.select(text_column().alias("_t")), run, "digest string")
                        .distinct())


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE_SQL = None
