"""Alignment of two tokenizers over the same texts (operator 13), by galloping intersection.

Both tokenizers cut the bytes of a text; a token is known by the byte offset of its end. The
shorter list of ends drives: its blocks are looked up in the longer list by an exponential search
from the last match and a binary search in the range found. Offsets in both lists cut the tokens
into groups, and the differences of their ranks tell how many tokens of either side a group holds.
All pairs of tokens of a group are links; they are counted per document by id pair (a group of
many tokens by its distinct ids), so a document has one row per pair however often it links them.

How many documents hold a pair is then one aggregation over the corpus, partially aggregated
before its shuffle, and the documents look their pairs up again: by broadcast while the table of
pairs is small, else by a shuffle join that deals out the hot pairs (``operators.joins``).

Tokenizer A is a byte-level BPE file, B a SentencePiece model that puts a space in front.

Defined results: null and empty texts, and texts whose joined token bytes of A or B differ from
space + text, have no tokens: zeros, and ``groups`` is ''. Rows that repeat a text or ``doc_id``
are documents of their own; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marksmith.llm.byte_bpe import byte_bpe
from marksmith.llm.byte_bpe import default_file as default_a
from marksmith.llm.common import checkpointed, read, short_batches, text_column, written
from marksmith.llm.sentencepiece_codec import default_model as default_b
from marksmith.operators.joins import MAX_BROADCAST_ROWS, lookup_join

#: Ends of the shorter list that are looked up together.
BLOCK = 256
#: A group with more links than this is counted by its distinct ids.
LARGE_GROUP = 4096
#: An Arrow batch is returned when its documents hold this many tokens.
BATCH_TOKENS = 400_000
#: A pair is one long: the id of A above these bits, the id of B in them.
B_BITS = 32


class Tokenizers:
    """Ids of both sides and the byte length of each id."""

    def __init__(self, file_a: str, model_b: str):
        self.a = byte_bpe(file_a, plain=True)
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_b)
        pieces_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i)
                    else sp.id_to_piece(i).replace("▁", " ").encode()
                    for i in range(sp.get_piece_size())]
        pieces_a = [self.a.bytes_of.get(i, b"") for i in range(max(self.a.bytes_of) + 1)]
        self.bytes_a, self.bytes_b = pieces_a, pieces_b
        self.size_a = np.array(list(map(len, pieces_a)), dtype=np.int64)
        self.size_b = np.array(list(map(len, pieces_b)), dtype=np.int64)
        # ids as text, with the mark that follows: in its list, then at its end
        self.words = ([f"{i}{m}" for i in range(len(pieces_a)) for m in ",|"]
                      + [f"{i}{m}" for i in range(len(pieces_b)) for m in ",;"])

    def ids_b(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(i, dtype=np.int64) for i in self.sp.encode(texts, num_threads=1)]


@functools.lru_cache(maxsize=2)
def tokenizers(file_a: str, model_b: str) -> Tokenizers:
    return Tokenizers(file_a, model_b)


def gallop(short: np.ndarray, long: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Indices in both sorted lists of the values that both hold."""
    at_short, at_long, low = [], [], 0
    for i in range(0, len(short), block):
        values = short[i:i + block]
        # exponential search from the last match for a bound of the block's last value
        step, last = len(values), values[-1]
        high = low + step
        while high < len(long) and long[high] < last:
            step *= 2
            high += step
        high = min(high + 1, len(long))
        # binary search of each value in the range found
        found = low + np.searchsorted(long[low:high], values)
        inside = np.minimum(found, len(long) - 1)
        hit = (found < len(long)) & (long[inside] == values)
        at_short.append(i + np.flatnonzero(hit))
        at_long.append(found[hit])
        low = int(found[-1])
        if low >= len(long):
            break
    none = [np.empty(0, dtype=np.int64)]
    return np.concatenate(at_short or none), np.concatenate(at_long or none)


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(ends_a) <= len(ends_b):
        return gallop(ends_a, ends_b)
    at_b, at_a = gallop(ends_b, ends_a)
    return at_a, at_b


def linked_pairs(a: np.ndarray, b: np.ndarray, stop_a: np.ndarray,
                 stop_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(a << B_BITS) | b`` of all links, and how many links each has. Group ``g``
    holds the tokens up to ``stop_a[g]`` and ``stop_b[g]``."""
    start_a, start_b = np.append(0, stop_a[:-1]), np.append(0, stop_b[:-1])
    size_a, size_b = stop_a - start_a, stop_b - start_b
    large = np.flatnonzero(size_a * size_b > LARGE_GROUP)
    per_token = np.repeat(np.where(size_a * size_b > LARGE_GROUP, 0, size_b), size_a)
    links = int(per_token.sum())
    at_a = np.repeat(np.arange(len(a)), per_token)
    first = np.repeat(np.cumsum(per_token) - per_token, per_token)
    at_b = np.repeat(np.repeat(start_b, size_a), per_token) + np.arange(links) - first
    keys, counts = np.unique((a[at_a] << B_BITS) | b[at_b], return_counts=True)
    if not len(large):
        return keys, counts
    all_keys, all_counts = [keys], [counts]
    for g in large:
        ids_a, n_a = np.unique(a[start_a[g]:stop_a[g]], return_counts=True)
        ids_b, n_b = np.unique(b[start_b[g]:stop_b[g]], return_counts=True)
        all_keys.append(((ids_a[:, None] << B_BITS) | ids_b).ravel())
        all_counts.append((n_a[:, None] * n_b).ravel())
    keys, where = np.unique(np.concatenate(all_keys), return_inverse=True)
    return keys, np.bincount(where, np.concatenate(all_counts)).astype(np.int64)


def group_text(tok: Tokenizers, a: np.ndarray, b: np.ndarray, stop_a: np.ndarray,
               stop_b: np.ndarray) -> str:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group in order."""
    size_a, size_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
    out = np.empty(len(a) + len(b), dtype=np.int64)
    # a token of A stands behind the B tokens of earlier groups, one of B behind A's own group too
    at_a = np.arange(len(a)) + np.repeat(stop_b - size_b, size_a)
    at_b = np.arange(len(b)) + np.repeat(stop_a, size_b)
    last_a, last_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
    last_a[stop_a - 1] = 1
    last_b[stop_b - 1] = 1
    out[at_a] = a * 2 + last_a
    out[at_b] = (b + len(tok.bytes_a)) * 2 + last_b
    words = tok.words
    return "".join([words[i] for i in out.tolist()])[:-1]


def align(docs: DataFrame, file_a: str, model_b: str) -> DataFrame:
    """Per document: a row number ``uid`` of this run, ``doc_id``, the counts of tokens, groups
    and links, ``groups`` as text, and ``pairs``: the linked id pairs with their links."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id",
                       text_column().alias("_t"))
    schema = T.StructType([
        T.StructField("uid", T.LongType()), docs.schema["doc_id"],
        *[T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")],
        T.StructField("groups", T.StringType()),
        T.StructField("pairs", T.ArrayType(T.StructType([
            T.StructField("pair", T.LongType()), T.StructField("links", T.LongType())])))])
    arrow = to_arrow_schema(schema)
    short_batches(docs.sparkSession)
    nothing = (0, 0, 0, 0, "", np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))

    def one(tok: Tokenizers, text: str, b: np.ndarray) -> tuple:
        if not text:
            return nothing
        a = tok.a.encode(" " + text).astype(np.int64)
        want = (" " + text).encode()
        if (b"".join([tok.bytes_a[i] for i in a.tolist()]) != want
                or b"".join([tok.bytes_b[i] for i in b.tolist()]) != want):
            return nothing
        at_a, at_b = common_ends(np.cumsum(tok.size_a[a]), np.cumsum(tok.size_b[b]))
        stop_a, stop_b = at_a + 1, at_b + 1
        sizes = np.diff(stop_a, prepend=0) * np.diff(stop_b, prepend=0)
        pairs, links = linked_pairs(a, b, stop_a, stop_b)
        return (len(a), len(b), len(stop_a), int(sizes.sum()),
                group_text(tok, a, b, stop_a, stop_b), pairs, links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(file_a, model_b)
        for batch in batches:
            texts = batch.column("_t").to_pylist()
            done, held, since = [], 0, 0
            for i, (text, b) in enumerate(zip(texts, tok.ids_b(texts), strict=True)):
                done.append(one(tok, text, b))
                held += done[-1][0] + done[-1][1]
                if held >= BATCH_TOKENS or i == len(texts) - 1:
                    yield _batch(batch.slice(since, len(done)), done, arrow)
                    done, held, since = [], 0, i + 1

    return rows.mapInArrow(run, schema)


def _batch(rows: pa.RecordBatch, done: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    *scalars, pairs, links = zip(*done, strict=True)
    cols = [rows.column("uid"), rows.column("doc_id"),
            *[pa.array(col, type=f.type) for col, f in zip(scalars, list(arrow)[2:], strict=False)]]
    offsets = np.cumsum([0, *map(len, pairs)])
    kind = arrow.field("pairs").type
    items = pa.StructArray.from_arrays(
        [pa.array(np.concatenate(pairs)), pa.array(np.concatenate(links))],
        fields=list(kind.value_type))
    cols.append(pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), items, type=kind))
    return pa.RecordBatch.from_arrays(cols, schema=arrow)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, n, best)``: in how many documents a pair is linked, and whether no pair of the
    same A id is in more."""
    pairs = aligned.select(F.inline("pairs")).select("pair")
    counts = checkpointed(pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    # at most as many rows in a window as B has ids
    same_a = Window.partitionBy(F.shiftright("pair", B_BITS))
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(same_a)).alias("best"))


def score(aligned: DataFrame, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``aligned`` (a written table) without its pairs, with ``n_best`` and ``count_sum``."""
    counts = checkpointed(pair_counts(aligned))
    linked = aligned.select("uid", F.inline("pairs"))
    found = lookup_join(linked, counts, ["pair"], "inner", counts.count(),
                        max_broadcast_rows=max_broadcast_rows, salt_by=F.col("uid"))
    sums = found.groupBy("uid").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
        F.sum(F.col("links") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return aligned.drop("pairs").join(sums, "uid", "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("n_best", "count_sum")})


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align(read(spark, sf_dir, "documents"), default_a(), default_b())
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    aligned = written(aligned.withColumn("groups_sha256", digest).drop("groups"), "alignment")
    return score(aligned).drop("uid")


ORACLE_SQL = None
