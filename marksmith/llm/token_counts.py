"""Token counts with overlap resynchronisation for huge documents (operator 10).

Ordinary documents are counted word by word: the tokenizer's pre-tokenisation never crosses
ASCII white space, so a distinct word is encoded once per bounded table and its count reused.

A huge document is cut into overlapping chunks that become rows of their own. Both chunks at a
cut encode the overlap with offsets; the cut is spliced at the first offset where both start a
token right behind white space, which is proven stable: neither side's tokens depend on the
other. Where an overlap holds no such offset, the document's overlaps (and with them its chunks)
are widened fourfold and encoded again, up to one chunk, so texts without white space come out
exact as well.

Defined results: a null text is the empty text (0 bytes, 0 tokens). Rows are counted one by one:
ties, repeated rows and extra columns have no influence. Strings of special tokens inside a text
count as the library reads them by default.
"""

from __future__ import annotations

import functools
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marksmith.llm.common import BoundedTable, checkpointed, map_batches, read, short_batches, text_column

LIMIT = 2048
#: A text of more characters than this is cut into chunks of CHUNK_CHARS.
HUGE_CHARS = 32_768
CHUNK_CHARS = 16_384
#: Characters on each side of a cut that both neighbours encode at first.
OVERLAP_CHARS = 128
#: Words kept per Python worker between batches.
TABLE_WORDS = 250_000
LONGEST_REMEMBERED = 64
#: ASCII marks without the apostrophe.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
ASCII_SPACE = frozenset(" \t\n\r\x0b\x0c")


class WordCounter:
    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(file)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.table = BoundedTable(TABLE_WORDS)
        self.parts = BoundedTable(TABLE_WORDS)

    def encode(self, texts: list[str]):
        return self.tok.encode_batch(texts, add_special_tokens=False)

    def _count_new(self, words: list[bytes]) -> list[int]:
        """Tokens of new words. ASCII letters with marks behind them are two pre-tokens (the marks
        hold no apostrophe, so no contraction, and no complete special string), and letters are
        lower-cased first, so both parts are looked up on their own."""
        split = []
        for w in words:
            stem = w.rstrip(MARKS)
            split.append((stem.lower(), w[len(stem):]) if stem.isalpha() else (w, b""))
        parts = {p for pair in split for p in pair if p}
        fresh = self.parts.fresh(parts)
        got = self.tok.encode_batch_fast([p.decode("utf-8") for p in fresh],
                                         add_special_tokens=False)
        self.parts.learn(fresh, map(len, got))
        known = self.parts.now
        counts = [known[a] + (known[b] if b else 0) for a, b in split]
        self.parts.forget([p for p in fresh if len(p) > LONGEST_REMEMBERED])
        return counts

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, through the table of distinct words."""
        # bytes.split() cuts at ASCII white space only
        words = [t.encode("utf-8").split() for t in texts]
        fresh = self.table.fresh(set().union(*words))
        if fresh:
            self.table.learn(fresh, self._count_new(fresh))
        known = self.table.now.__getitem__
        counts = [sum(map(known, ws)) for ws in words]
        self.table.forget([w for w in fresh if len(w) > LONGEST_REMEMBERED])
        return counts


@functools.lru_cache(maxsize=2)
def _counter(file: str) -> WordCounter:
    return WordCounter(file)


def _stable(text: str, offsets: list[tuple[int, int]], low: int, high: int) -> list[tuple[int, int]]:
    """``(offset, tokens before it)`` of the token starts in [low, high) behind white space."""
    return [(start, n) for n, (start, _) in enumerate(offsets)
            if low <= start < high and start > 0 and text[start - 1] in ASCII_SPACE]


def _pieces(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """One row per chunk of each text ``(uid, _t)``: its piece with both overlaps."""
    schema = "uid long, k long, n_chunks long, base long, part string"

    def run(batches):
        for batch in batches:
            for uid, t in zip(batch.column("uid").to_pylist(), batch.column("_t").to_pylist(),
                              strict=True):
                n = max(1, -(-len(t) // chunk))
                for k in range(n):
                    base = max(0, k * chunk - overlap)
                    yield pa.RecordBatch.from_pylist(
                        [{"uid": uid, "k": k, "n_chunks": n, "base": base,
                          "part": t[base:(k + 1) * chunk + overlap]}], schema=arrow)

    struct = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    short_batches(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt out evenly, so the chunks of one huge text run on many executors
    return docs.select("uid", "_t").mapInArrow(run, struct).repartition(parts)


def _encode_pieces(pieces: DataFrame, file: str, chunk: int, overlap: int) -> DataFrame:
    """Per chunk, its token total and the stable points in the overlaps at both ends."""
    point = "array<struct<p:long,n:long>>"

    def run(batch: pa.RecordBatch) -> dict:
        parts, ks, bases = (batch.column(c).to_pylist() for c in ("part", "k", "base"))
        head, tail, total = [], [], []
        for e, part, k, base in zip(_counter(file).encode(parts), parts, ks, bases, strict=True):
            offs = e.offsets
            for ends, cut in ((head, k * chunk - base), (tail, (k + 1) * chunk - base)):
                ends.append([{"p": p + base, "n": n} for p, n in
                             _stable(part, offs, cut - overlap, cut + overlap)])
            total.append(len(offs))
        return {"uid": batch.column("uid"), "k": ks, "n_chunks": batch.column("n_chunks"),
                "total": total, "head": head, "tail": tail}

    return map_batches(pieces, run, f"uid long, k long, n_chunks long, total long, "
                                    f"head {point}, tail {point}")


def count_huge(docs: DataFrame, file: str, chunk: int = CHUNK_CHARS,
               overlap: int = OVERLAP_CHARS) -> DataFrame:
    """``(uid, n_tokens)`` of texts ``(uid, _t)``, spliced from overlapping chunks."""
    open_docs, solved = docs, None
    while True:
        ends = checkpointed(_encode_pieces(_pieces(open_docs, chunk, overlap), file, chunk, overlap))
        left = ends.filter("k < n_chunks - 1").select("uid", F.col("k").alias("cut"), "tail")
        right = ends.filter("k > 0").select("uid", (F.col("k") - 1).alias("cut"), "head")
        # the first stable point that both sides of a cut share
        at = F.array_min(F.array_intersect("tail.p", "head.p"))
        cuts = left.join(right, ["uid", "cut"]).withColumn("at", at)

        def before(side: str):
            return F.get(F.filter(side, lambda x: x["p"] == F.col("at")), F.lit(0))["n"]

        cuts = cuts.select("uid", (before("tail") - before("head")).alias("n"),
                           F.col("at").isNull().alias("failed"))
        last = ends.filter("k = n_chunks - 1").select("uid", F.col("total").alias("n"),
                                                      F.lit(False).alias("failed"))
        counted = checkpointed(cuts.unionByName(last).groupBy("uid").agg(
            F.sum("n").alias("n_tokens"), F.max("failed").alias("failed")))
        done = counted.filter("not failed").select("uid", "n_tokens")
        solved = done if solved is None else solved.unionByName(done)
        failed = counted.filter("failed").select("uid")
        if failed.isEmpty():
            return solved
        # widen the overlaps, and the chunks with them so that overlaps stay apart
        open_docs = open_docs.join(failed, "uid", "left_semi")
        overlap *= 4
        chunk = max(chunk, 4 * overlap)


def count_tokens(docs: DataFrame, file: str, limit: int = LIMIT,
                 huge_chars: int = HUGE_CHARS, chunk: int = CHUNK_CHARS,
                 overlap: int = OVERLAP_CHARS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row."""
    rows = docs.select("doc_id", text_column().alias("_t"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType())])
    sized = rows.withColumn("n_bytes", F.octet_length("_t").cast("long"))

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"),
                "n_tokens": _counter(file).count(batch.column("_t").to_pylist())}

    small = map_batches(sized.filter(F.length("_t") <= huge_chars), run, schema)
    huge = checkpointed(sized.filter(F.length("_t") > huge_chars)
                        .withColumn("uid", F.monotonically_increasing_id()))
    counted = count_huge(huge.select("uid", "_t"), file, chunk, overlap)
    large = huge.select("uid", "doc_id", "n_bytes").join(counted, "uid").drop("uid")
    both = small.unionByName(large.select("doc_id", "n_bytes", "n_tokens"))
    return both.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def default_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), default_file())


ORACLE_SQL = None
