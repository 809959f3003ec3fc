"""Neighbouring tokens counted and looked up by chunks of texts, on Arrow batches.

A chunk of texts (CHUNK_BYTES) is cut into tokens once; its tokens become codes of its own
vocabulary, so equal pairs of a chunk are found by sorting integers. What moves between tasks is not
rows but blobs: the distinct pairs of a chunk that fall into one bucket (a hash of both tokens), with
the tokens they use, compressed. A bucket holds about BUCKET_BYTES of texts whatever the corpus, so
no task's memory grows with the corpus or with a frequent token.

Pairs are compared as whole tokens, never by a hash. The pair of a token and the empty token, which
no text has, stands for all pairs of this token: its count is the context's total.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marksmith.session import stored

CHUNK_BYTES = 12 << 20
CHUNK_PAIRS = 1 << 19
BUCKET_BYTES = 8 << 20
BUCKETS_PER_PARTITION = 2
#: The second token deals the pairs of one context over so many buckets.
BUCKET_COLUMNS = 8
BLOBS = "bucket int, chunk bigint, blob binary"
SPACE = b" "
CODE_BITS = 32
CODE_MASK = (1 << CODE_BITS) - 1


def pack(words: bytes, *ints: np.ndarray) -> bytes:
    """Words and arrays of integers from 0 on, each as narrow as it can be and byte by byte."""
    parts = [struct.pack("<Q", len(words)), words]
    for values in ints:
        narrow = values.astype(np.min_scalar_type(int(values.max(initial=0))))
        parts += [struct.pack("<QB", len(narrow), narrow.itemsize),
                  narrow.view(np.uint8).reshape(-1, narrow.itemsize).T.tobytes()]
    body = b"".join(parts)
    return struct.pack("<Q", len(body)) + pa.Codec("zstd").compress(body, asbytes=True)


def unpack(blob: bytes) -> tuple[bytes, list[np.ndarray]]:
    """The words and the arrays, unsigned and as narrow as they were packed."""
    body = pa.Codec("zstd").decompress(blob[8:], struct.unpack_from("<Q", blob)[0], asbytes=True)
    at = 8 + struct.unpack_from("<Q", body)[0]
    words, ints = body[8:at], []
    while at < len(body):
        n, width = struct.unpack_from("<QB", body, at)
        planes = np.frombuffer(body, np.uint8, n * width, at + 9).reshape(width, n)
        ints.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel())
        at += 9 + n * width
    return words, ints


def joined(words: pa.Array) -> bytes:
    """No token holds a space."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), SPACE)[0].as_py()


def split(words: bytes) -> pa.Array:
    return pc.split_pattern(pa.array([words], pa.binary()), SPACE).flatten()


def encode(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The vocabulary of texts with the empty token behind it, the codes of all tokens one text
    after the other, and the number of tokens of each text: white-space tokens as ``tokens`` has them."""
    words = pc.ascii_split_whitespace(texts)
    flat, of_text = words.flatten(), pc.list_parent_indices(words).to_numpy()
    kept = pc.not_equal(flat, "")
    coded = flat.filter(kept).dictionary_encode()
    sizes = np.bincount(of_text[kept.to_numpy(zero_copy_only=False)], minlength=len(texts))
    vocab = pa.concat_arrays([coded.dictionary, pa.array([""], coded.dictionary.type)])
    return vocab.view(pa.binary()), coded.indices.to_numpy(), sizes


def neighbours(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every pair its key (both codes in one integer) and the number of its text."""
    of_text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    same = of_text[1:] == of_text[:-1]
    return ((codes[:-1].astype(np.int64) << CODE_BITS) | codes[1:])[same], of_text[1:][same]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each is there."""
    keys = np.sort(keys)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.diff(starts, append=len(keys))


def with_totals(pairs: np.ndarray, v: int) -> np.ndarray:
    """Sorted distinct pairs, each context's followed by its total, whose second code is the last one."""
    last = np.flatnonzero(np.diff(pairs >> CODE_BITS, append=-1))
    return np.insert(pairs, last + 1, (pairs[last] >> CODE_BITS << CODE_BITS) | (v - 1))


def dealt(vocab: pa.Array, keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings sorted keys bucket by bucket, and where each bucket ends."""
    hashes = np.fromiter(map(zlib.crc32, vocab.to_pylist()), np.uint64, len(vocab))
    # multiplied as CRC-32 of short words is far from even; the upper half is a fraction of 1
    hashes = hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
    rows, columns = np.uint64(-(-buckets // BUCKET_COLUMNS)), np.uint64(BUCKET_COLUMNS)
    row, column = hashes * rows >> np.uint64(32), hashes * columns >> np.uint64(32)
    bucket = (row[keys >> CODE_BITS] * columns + column[keys & CODE_MASK]).astype(np.min_scalar_type(buckets))
    return np.argsort(bucket, kind="stable"), np.cumsum(np.bincount(bucket, minlength=buckets))


def blobs(vocab: pa.Array, keys: np.ndarray, counts: np.ndarray | None, buckets: int) -> Iterator[tuple[int, bytes]]:
    """``(bucket, blob)`` of sorted keys, with their counts if there are any."""
    order, ends = dealt(vocab, keys, buckets)
    start, named, place = 0, np.zeros(len(vocab), bool), np.zeros(len(vocab), np.int64)
    for bucket, end in enumerate(ends.tolist()):
        at, start = order[start:end], end
        if len(at):
            first, second = keys[at] >> CODE_BITS, keys[at] & CODE_MASK
            named[first] = named[second] = True
            used = np.flatnonzero(named)
            named[used], place[used] = False, np.arange(len(used))
            more = [] if counts is None else [counts[at]]
            yield bucket, pack(joined(vocab.take(pa.array(used))), *steps(place[first], place[second]), *more)


def steps(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs as differences: of the first codes, and of the second ones under an equal first."""
    up, on = np.diff(first, prepend=0), np.diff(second, prepend=0)
    return up, np.where((up > 0) | (np.arange(len(up)) == 0), second, on)


def unstepped(up: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero((up > 0) | (np.arange(len(up)) == 0))
    run = np.cumsum(on, dtype=np.int64)
    return np.cumsum(up, dtype=np.int64), run - np.repeat(run[starts] - on[starts], np.diff(starts, append=len(on)))


def united(parts: list[tuple[bytes, list[np.ndarray]]]) -> tuple[pa.Array, list[np.ndarray]]:
    """One vocabulary for several blobs, and the keys of each over it."""
    coded = split(SPACE.join(words for words, _ in parts)).dictionary_encode()
    codes, at, keys = coded.indices.to_numpy().astype(np.int64), 0, []
    for words, (first, second, *_) in parts:
        first, second = unstepped(first, second)
        keys.append((codes[at + first] << CODE_BITS) | codes[at + second])
        at += words.count(SPACE) + 1
    return coded.dictionary, keys


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    every = np.concatenate([np.zeros(0, np.int64), *keys])
    if not len(every):
        return every, every
    order = np.argsort(every)
    every = every[order]
    starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[starts], np.add.reduceat(np.concatenate(counts)[order], starts, dtype=np.int64)


def chunked(batches: Iterator[pa.RecordBatch], weigh: Callable[[pa.RecordBatch], np.ndarray],
            most: int) -> Iterator[pa.Table]:
    """Batches united and cut into tables of up to ``most`` by the weights of their rows, each of
    one row at least."""
    parts, held = [], 0
    for batch in batches:
        ends, start = np.cumsum(weigh(batch)), 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(int(np.searchsorted(ends, before + most - held, "right")), start + (not parts))
            if stop > start:
                parts.append(batch.slice(start, stop - start))
                held += int(ends[stop - 1]) - before
            if stop < batch.num_rows:
                yield pa.Table.from_batches(parts)
                parts, held = [], 0
                pa.default_memory_pool().release_unused()
            start = stop
    if parts:
        yield pa.Table.from_batches(parts)
        pa.default_memory_pool().release_unused()


def whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def text_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    def weigh(batch: pa.RecordBatch) -> np.ndarray:
        return pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return chunked(batches, weigh, CHUNK_BYTES)


def blob_batch(rows: list[tuple[int, int | None, bytes]]) -> pa.RecordBatch:
    bucket, chunk, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(chunk, pa.int64()),
                                       pa.array(blob, pa.binary())], ["bucket", "chunk", "blob"])


def buckets_for(size: int, df: DataFrame) -> int:
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = max(BUCKETS_PER_PARTITION * partitions, -(-size // BUCKET_BYTES))
    return -(-least // BUCKET_COLUMNS) * BUCKET_COLUMNS


def pair_counts(texts: DataFrame, asked: pa.Array | None = None) -> DataFrame:
    """``(ctx, token, n)`` of all neighbouring tokens of ``texts`` (``text``); with ``asked`` only of
    contexts among these."""
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = buckets_for(size, texts)
    wanted = None if asked is None else texts.sparkSession.sparkContext.broadcast(asked)
    schema = T.StructType.fromDDL("ctx string, token string, n bigint")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_chunks(batches):
            vocab, codes, sizes = encode(whole(table.column("text")))
            pairs, _ = neighbours(codes, sizes)
            if wanted is not None:
                named = pc.is_in(vocab, value_set=wanted.value).to_numpy(zero_copy_only=False)
                pairs = pairs[named[pairs >> CODE_BITS]]
            keys, n = distinct(pairs)
            yield blob_batch([(bucket, None, blob) for bucket, blob in blobs(vocab, keys, n, buckets)])

    def merge(table: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()  # of the bucket before
        parts = [unpack(blob) for blob in table.column("blob").to_pylist()]
        vocab, keys = united(parts)
        every, n = summed(keys, [ints[2] for _, ints in parts])
        words = vocab.view(pa.string())
        return pa.table([words.take(pa.array(every >> CODE_BITS)), words.take(pa.array(every & CODE_MASK)), pa.array(n)],
                        ["ctx", "token", "n"])

    return texts.select("text").mapInArrow(count, BLOBS).groupBy("bucket").applyInArrow(merge, schema)


def distinct_tokens(texts: DataFrame) -> DataFrame:
    """``(token)``: every token of ``texts`` (``text``) once."""
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_chunks(batches):
            every = pc.ascii_split_whitespace(whole(table.column("text"))).flatten().unique()
            yield pa.RecordBatch.from_arrays([every.filter(pc.not_equal(every, ""))], ["token"])

    return texts.select("text").mapInArrow(words, "token string").distinct()


def log_losses(texts: DataFrame, id_col: str, counts: DataFrame, vocab_size: int) -> DataFrame:
    """``(id_col, c, s)``: per text with a pair (``text``) the number of its pairs and the sum of
    ``ln(total(ctx) + V) - ln(n(ctx, token) + 1)`` under ``counts``, null where ``total + V`` is 0.

    A chunk of encoded texts is stored; it asks each bucket once for its distinct pairs and totals,
    and is answered by a count for each, in the order it asked. No occurrence of a pair moves."""
    ids = T.StructField("ids", T.ArrayType(texts.schema[id_col].dataType))
    chunk_schema = T.StructType([*T.StructType.fromDDL("chunk bigint, size bigint, blob binary").fields, ids])
    out_schema = T.StructType([T.StructField(id_col, texts.schema[id_col].dataType),
                               *T.StructType.fromDDL("c bigint, s double").fields])
    id_arrow, out_arrow = to_arrow_schema(chunk_schema).field("ids").type, to_arrow_schema(out_schema)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, table in enumerate(text_chunks(batches)):
            vocab, codes, sizes = encode(whole(table.column("text")))
            of = whole(table.column("id"))
            yield pa.RecordBatch.from_arrays([
                pa.array([first + k], pa.int64()), pa.array([table.column("text").nbytes], pa.int64()),
                pa.array([pack(joined(vocab), codes, sizes)], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, len(of)], pa.int32()), of, type=id_arrow)],
                ["chunk", "size", "blob", "ids"])

    chunks = stored(texts.select(F.col(id_col).alias("id"), "text").mapInArrow(encoded, chunk_schema), "chunks")
    size = chunks.agg(F.sum("size")).first()[0] or 0
    buckets = buckets_for(max(size, counts.count() * 16), texts)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, (codes, sizes) = unpack(blob)
                vocab = split(words)
                keys = with_totals(distinct(neighbours(codes, sizes)[0])[0], len(vocab))
                yield blob_batch([(bucket, chunk, b) for bucket, b in blobs(vocab, keys, None, buckets)])

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunked(batches, lambda batch: np.ones(batch.num_rows, np.int64), CHUNK_PAIRS):
            both = pa.concat_arrays([whole(table.column("ctx")), whole(table.column("token")), pa.array([""])])
            coded = both.dictionary_encode()
            codes, rows = coded.indices.to_numpy().astype(np.int64), table.num_rows
            n, first = whole(table.column("n")).to_numpy(), codes[:rows] << CODE_BITS
            keys, n = summed([first | codes[rows: 2 * rows], first | codes[-1]], [n, n])
            yield blob_batch([(bucket, None, b) for bucket, b in blobs(coded.dictionary.view(pa.binary()), keys, n, buckets)])

    def answer(table: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()  # of the bucket before
        chunk = table.column("chunk").to_pylist()
        parts = [unpack(blob) for blob in table.column("blob").to_pylist()]
        _, keys = united(parts)
        known, n = summed([k for k, c in zip(keys, chunk, strict=True) if c is None],
                          [ints[2] for (_, ints), c in zip(parts, chunk, strict=True) if c is None])
        known, n = np.append(known, -1), np.append(n, 0)  # the last one is for pairs behind all others
        rows, bucket = [], table.column("bucket")[0].as_py()
        for k, c in zip(keys, chunk, strict=True):
            if c is not None:
                at = np.searchsorted(known[:-1], k)
                rows.append((bucket, c, pack(b"", np.where(known[at] == k, n[at], 0))))
        return pa.Table.from_batches([blob_batch(rows)])

    def score(table: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()  # of the chunk before
        bucket, blob = table.column("bucket").to_pylist(), table.column("blob").to_pylist()
        own = bucket.index(None)
        words, (codes, sizes) = unpack(blob[own])
        vocab = split(words)
        v = len(vocab)
        occurring, of_text = neighbours(codes, sizes)
        order = np.argsort(occurring)
        pairs, times = distinct(occurring)
        place = np.empty(len(order), np.int64)
        place[order] = np.repeat(np.arange(len(pairs)), times)
        keys = with_totals(pairs, v)
        answers = sorted((b, x) for b, x in zip(bucket, blob, strict=True) if b is not None)
        n = np.zeros(len(keys), np.int64)
        if answers:
            n[dealt(vocab, keys, buckets)[0]] = np.concatenate([unpack(x)[1][0] for _, x in answers])
        del occurring, order
        mass = n[np.searchsorted(keys, (pairs >> CODE_BITS << CODE_BITS) | (v - 1))] + vocab_size
        loss = np.log(mass, out=np.full(len(mass), np.nan), where=mass > 0) - np.log(n[np.searchsorted(keys, pairs)] + 1.0)
        c = np.bincount(of_text, minlength=len(sizes))
        s = np.bincount(of_text, weights=loss[place], minlength=len(sizes))
        some = np.flatnonzero(c)
        of = table.column("ids")[own].values.take(pa.array(some))
        return pa.table([of, pa.array(c[some]), pa.array(s[some], mask=np.isnan(s[some]))], schema=out_arrow)

    pairs = counts.filter("ctx is not null and token is not null").select("ctx", "token", F.col("n").cast("bigint").alias("n"))
    asked = chunks.select("chunk", "blob").mapInArrow(ask, BLOBS)
    answers = stored(asked.unionByName(pairs.mapInArrow(model, BLOBS)).groupBy("bucket")
                     .applyInArrow(answer, BLOBS), "answers")
    every = chunks.select("chunk", F.lit(None).cast("int").alias("bucket"), "blob", "ids").unionByName(
        answers, allowMissingColumns=True)
    return every.groupBy("chunk").applyInArrow(score, out_schema)
