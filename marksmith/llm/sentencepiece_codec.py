"""SentencePiece encoding and decoding through distinct-chunk tables (operator 2).

Where no piece of the model holds a space mark after another character, and no piece holds a
line feed, BPE merges cannot cross those points: a text is the concatenation of chunks
(``marks + word``, or one line feed) that are segmented independently.

1. Spark gathers the distinct chunks of all texts, counted by batches of texts that hold them.
2. Each distinct chunk is segmented once, by the library itself: the chunk table.
3. Tasks cut their texts into chunks and join the ids of the table back by position.

The table is broadcast, so no word occurrence is ever shuffled. Its size is checked: of more than
MAX_TABLE_CHUNKS distinct chunks it holds those found in most batches, by a threshold taken from
counts of counts. The others, and chunks of more than LONGEST_REMEMBERED characters, are rare; they
are segmented in the task where they stand, which never changes a result.

A model for which that proof fails is applied to whole texts.

Defined results: a null text is the empty text and gives no ids and the empty text back; any
other row is treated alone, so ties, repeated rows and extra columns have no influence.
"""

from __future__ import annotations

import functools
import re
import uuid
from array import array

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marksmith.llm.common import checkpointed, map_batches, read, sha256_hex, text_column

MARK = "▁"
#: Chunks in the broadcast table, at most.
MAX_TABLE_CHUNKS = 400_000
#: Chunks outside the table kept per Python worker between batches.
TABLE_CHUNKS = 50_000
#: Chunks longer than this are segmented where they stand and not remembered.
LONGEST_REMEMBERED = 64
CHUNK = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


class ChunkCodec:
    """Encodes and decodes texts chunk by chunk, exactly as the library does whole."""

    def __init__(self, model_file: str, table: dict[str, bytes | tuple[bytes, str]] | None = None):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.split = self._chunks_are_independent()
        self.known = table or {}
        self.own: list[str] = []  # known chunks that are not in the table

    def _chunks_are_independent(self) -> bool:
        sp = self.sp
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        crossing = any(MARK in p.lstrip(MARK) for p in pieces) or any("\n" in p for p in pieces)
        # the normaliser must leave characters alone, add one mark in front and keep all spaces
        probe = " a  béﬁ \n c "
        seen = "".join(sp.encode(probe, out_type=str)).replace("<0x0A>", "\n")
        return not crossing and seen == MARK + probe.replace(" ", MARK)

    def segment(self, chunks: list[str]) -> list[bytes | tuple[bytes, str]]:
        """Ids of new chunks, with the decoded text where it differs from the chunk.

        Each is encoded behind a line feed: the mark that the library puts in front of a text
        does not touch it then. Both ids of that prefix are dropped again.
        """
        texts = ["\n" + c.replace(MARK, " ") for c in chunks]
        ids = self.sp.encode(texts, num_threads=1)
        whole = self.sp.decode([i for row in ids for i in row[1:]])
        if whole == "".join(texts):
            return [array("i", row[2:]).tobytes() for row in ids]
        out = []
        for row, t in zip(ids, texts, strict=True):
            back, raw = self.sp.decode(row), array("i", row[2:]).tobytes()
            out.append(raw if back == t else (raw, back[1:]))
        return out

    @staticmethod
    def chunks(t: str) -> list[str]:
        if "  " in t or MARK in t or "\0" in t or t[:1] == " ":
            return CHUNK.findall((MARK + t).replace(" ", MARK)) if t else []
        parts = (MARK + t.replace(" ", "\0" + MARK)).replace("\n", "\0\n\0").split("\0")
        return [p for p in parts if p] if "\n" in t else parts if t else []

    def run(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Per text: its ids as int32 bytes, and the text that the ids decode to."""
        if not self.split:
            ids = self.sp.encode(texts, num_threads=1)
            return ([array("i", i).tobytes() for i in ids], self.sp.decode(ids, num_threads=1))
        parts = [self.chunks(t) for t in texts]
        if len(self.own) > TABLE_CHUNKS:
            for c in self.own:
                del self.known[c]
            self.own = []
        fresh = list(set().union(*parts).difference(self.known))
        self.known.update(zip(fresh, self.segment(fresh) if fresh else [], strict=True))
        known = self.known.__getitem__
        all_ids, all_text = [], []
        for t, p in zip(texts, parts, strict=True):
            found = list(map(known, p))
            try:
                ids, plain = b"".join(found), True
            except TypeError:  # some chunk does not decode to itself
                ids, plain = b"".join([f if isinstance(f, bytes) else f[0] for f in found]), False
            all_ids.append(ids)
            if t[:1] in (" ", MARK):  # the front of the text: leave its spaces to the library
                all_text.append(self.sp.decode(np.frombuffer(ids, dtype=np.int32).tolist()))
            elif plain:  # every chunk decodes to itself
                all_text.append("".join(p)[1:].replace(MARK, " "))
            else:
                all_text.append("".join([c.replace(MARK, " ") if isinstance(f, bytes) else f[1]
                                         for c, f in zip(p, found, strict=True)])[1:])
        for c in fresh:
            if len(c) > LONGEST_REMEMBERED:
                del self.known[c]
            else:
                self.own.append(c)
        return all_ids, all_text


@functools.lru_cache(maxsize=2)
def _codec(model_file: str) -> ChunkCodec:
    return ChunkCodec(model_file)


#: The codec of this Python worker, under the name of its table.
_loaded: dict[str, ChunkCodec] = {}


def _with_table(model_file: str, name: str, shared: Broadcast) -> ChunkCodec:
    if name not in _loaded:
        _loaded.clear()
        table = pa.ipc.open_stream(shared.value).read_all()
        chunks, ids, back = (table.column(c).to_pylist() for c in ("chunk", "ids", "back"))
        _loaded[name] = ChunkCodec(model_file, {
            c: i if b is None else (i, b) for c, i, b in zip(chunks, ids, back, strict=True)})
    return _loaded[name]


def distinct_chunks(texts: DataFrame) -> DataFrame:
    """``(chunk, n)``: every distinct chunk of ``_t`` of up to LONGEST_REMEMBERED characters and
    in how many batches of texts it is."""
    def run(batch: pa.RecordBatch) -> dict:
        found = set().union(*map(ChunkCodec.chunks, batch.column("_t").to_pylist()))
        return {"chunk": [c for c in found if len(c) <= LONGEST_REMEMBERED]}

    return map_batches(texts, run, "chunk string").groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))


def chunk_table(texts: DataFrame, model_file: str) -> DataFrame:
    """``(chunk, ids, back)``: each distinct chunk segmented once; ``back`` is the decoded text
    where that is not the chunk. MAX_TABLE_CHUNKS rows at most."""
    chunks = checkpointed(distinct_chunks(texts))
    # chunks by the power of two of their count: at most 64 rows
    sizes = chunks.groupBy(F.floor(F.log2("n")).alias("power")).count().collect()
    total, least = 0, 64
    for power, n in sorted(sizes, reverse=True):
        total += n
        if total > MAX_TABLE_CHUNKS:
            break
        least = power

    def run(batch: pa.RecordBatch) -> dict:
        found = batch.column("chunk").to_pylist()
        rows = [r if isinstance(r, tuple) else (r, None) for r in _codec(model_file).segment(found)]
        return {"chunk": found, "ids": [i for i, _ in rows], "back": [b for _, b in rows]}

    kept = chunks.filter(F.floor(F.log2("n")) >= least).select("chunk")
    return map_batches(kept, run, "chunk string, ids binary, back string")


def encode_decode(docs: DataFrame, model_file: str, text: str = "text",
                  keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Key columns, ``ids array<int>`` and ``decoded string`` for every row. Reads ``docs`` twice:
    for the chunk table, which is made at once, and for the result."""
    schema = T.StructType([docs.schema[k] for k in keys]
                          + [T.StructField("ids", T.ArrayType(T.IntegerType())),
                             T.StructField("decoded", T.StringType())])
    source = docs.select(*keys, text_column(text).alias("_t"))

    sink = pa.BufferOutputStream()
    if _codec(model_file).split:
        table = chunk_table(source.select("_t"), model_file).toArrow()
    else:
        table = pa.table({c: [] for c in ("chunk", "ids", "back")})
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    shared = docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
    name = uuid.uuid4().hex

    def run(batch: pa.RecordBatch, codec: ChunkCodec) -> dict:
        ids, back = codec.run(batch.column("_t").to_pylist())
        sizes = np.fromiter((len(i) // 4 for i in ids), dtype=np.int64, count=len(ids))
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        values = np.frombuffer(b"".join(ids), dtype=np.int32)
        out = {k: batch.column(k) for k in keys}
        out["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
        out["decoded"] = back
        return out

    return map_batches(source, run, schema,
                       setup=lambda: _with_table(model_file, name, shared))


def digest_columns(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        sha256_hex(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        sha256_hex(F.col("decoded")).alias("decoded_sha256"))


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(encode_decode(read(spark, sf_dir, "documents"), default_model()))


ORACLE_SQL = None
