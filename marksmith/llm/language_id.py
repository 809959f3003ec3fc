"""Language ID by error-correcting output codes (operator 7).

Every language gets a codeword of +1/-1 bits. For each bit a binary n-gram classifier separates
the languages whose bit is +1 from the others: a log-odds (naive Bayes) model over hashed byte
n-grams of lengths 1 to 4, with weights ``log P(gram | +1) - log P(gram | -1)``. All its counts
come from one pass over all training documents, pre-aggregated per batch and summed by Spark;
the model is ``bits x BUCKETS`` numbers whatever the corpus size.

Decoding is loss-weighted: the mean bit margins of a text are compared with every codeword under
the logistic loss, each bit weighted by how well it separates the languages in the training
counts; the nearest codeword wins, ties going to the smaller language value. ``ambiguous`` flags
texts whose two best losses nearly coincide.

Defined results: ``und`` with score 0 where the text is null or has no letter, or where nothing
could be learned. A null ``doc_id`` counts as the empty text in the fold rule. ``lang``,
``source`` and ``doc_id`` are never inputs of a prediction; rows are predicted one by one, so
ties, repeated rows and extra columns have no influence.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marksmith.llm.common import (checkpointed, map_batches, packed, read, short_batches,
                                  text_column, unpacked)

BUCKETS = 1 << 16
#: Bits of a codeword: all 2^(L-1)-1 splits up to this many, else this many drawn ones.
MAX_BITS = 31
#: Languages that may be learned; the count table is MAX_LANGS * BUCKETS rows at most.
MAX_LANGS = 512
#: Characters of text turned into n-grams at a time.
BLOCK_BYTES = 1 << 20
UNDETERMINED = "und"
AMBIGUOUS_MARGIN = 0.05
SMOOTHING = 0.5


def held_out(doc_id: str = "doc_id") -> Column:
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")
    return F.crc32(key) % 4 == 2


def has_letter(text: str) -> Column:
    return F.col(text).rlike(r"\p{L}")


def grams(block: bytes) -> np.ndarray:
    """Hashed n-grams of lengths 1 to 4 of lower-cased bytes."""
    b = np.frombuffer(block, dtype=np.uint8).astype(np.uint32)
    out = []
    code = np.zeros(len(b), dtype=np.uint32)
    for n in range(1, 5):
        if len(b) < n:
            break
        code = (code[:len(b) - n + 1] << np.uint32(8)) | b[n - 1:]
        salted = (code ^ np.uint32(n * 0x3C6EF372)) * np.uint32(0x9E3779B1)
        out.append(((salted ^ (salted >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(16))
    return np.concatenate(out)


def prepared(text: str) -> bytes:
    """Lower-cased UTF-8, framed by spaces, with digits and ASCII marks read as spaces."""
    low = text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS)
    return b" " + b" ".join(low.split()) + b" "


_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def _counts(docs: DataFrame) -> DataFrame:
    """``(lang, bucket, n)`` over all training texts."""
    def run(batch: pa.RecordBatch) -> dict:
        sums: dict[str, np.ndarray] = {}
        for lang, t in zip(batch.column("lang").to_pylist(), batch.column("_t").to_pylist(),
                           strict=True):
            p = prepared(t)
            total = sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            for i in range(0, len(p), BLOCK_BYTES):
                total += np.bincount(grams(p[i:i + BLOCK_BYTES]), minlength=BUCKETS)
        langs, buckets, n = [], [], []
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            langs += [lang] * len(at)
            buckets.append(at)
            n.append(total[at])
        return {"lang": langs, "bucket": np.concatenate(buckets), "n": np.concatenate(n)}

    per_batch = map_batches(docs, run, "lang string, bucket int, n long")
    return per_batch.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def codewords(n: int) -> np.ndarray:
    """``n x bits`` of +1/-1: every split of the languages while there are few, else drawn ones
    (with a fixed seed) in which each bit has both signs and rows differ."""
    if n < 2:
        return np.ones((n, 1), dtype=np.int8)
    if 2 ** (n - 1) - 1 <= MAX_BITS:
        rest = itertools.product((1, -1), repeat=n - 1)
        cols = [(1, *r) for r in rest if -1 in r]
        return np.array(cols, dtype=np.int8).T
    rng = random.Random(7)
    while True:
        cols = []
        while len(cols) < MAX_BITS:
            c = [rng.choice((1, -1)) for _ in range(n)]
            if len(set(c)) == 2:
                cols.append(c)
        code = np.array(cols, dtype=np.int8).T
        if len({tuple(r) for r in code}) == n:
            return code


class Model:
    """Codewords, bit classifiers and bit weights, ready to predict."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        if not langs:
            return
        self.code = codewords(len(langs)).astype(np.float64)
        # languages count alike, however many documents each has
        prob = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        floor = SMOOTHING / max(float(counts.sum(axis=1).max(initial=1)), 1.0)
        plus = (self.code.T > 0).astype(np.float64)
        minus = 1.0 - plus
        p = plus @ prob / np.maximum(plus.sum(axis=1, keepdims=True), 1) + floor
        q = minus @ prob / np.maximum(minus.sum(axis=1, keepdims=True), 1) + floor
        self.weights = np.ascontiguousarray(np.clip(np.log(p / q), -4, 4).T.astype(np.float32))
        margin = prob @ self.weights  # mean margin of each language under each bit
        self.bit_weight = np.maximum((margin * self.code).min(axis=0), 0) + 1e-3
        self.bit_weight /= self.bit_weight.sum()
        self.scale = 1.0 / max(float(np.abs(margin).mean()), 1e-6)

    def margins(self, text: str) -> np.ndarray:
        p = prepared(text)
        total, n = np.zeros(self.weights.shape[1]), 0
        for i in range(0, len(p), BLOCK_BYTES):
            g = grams(p[i:i + BLOCK_BYTES])
            used = np.bincount(g, minlength=BUCKETS) if len(g) > BUCKETS else None
            total += (used @ self.weights if used is not None
                      else self.weights[g].sum(axis=0, dtype=np.float64))
            n += len(g)
        return total / max(n, 1)

    def predict(self, text: str) -> tuple[str, float, bool]:
        if not self.langs:
            return UNDETERMINED, 0.0, True
        z = 4.0 * self.scale * self.margins(text) * self.code  # languages x bits
        loss = np.logaddexp(0.0, -z) @ self.bit_weight
        best = int(np.argmin(loss))
        if len(loss) == 1:
            return self.langs[0], 1.0, False
        share = np.exp(-8.0 * (loss - loss[best]))
        second = np.partition(loss, 1)[1]
        return self.langs[best], float(1.0 / share.sum()), bool(second - loss[best] < AMBIGUOUS_MARGIN)


def fit(docs: DataFrame) -> Model:
    """Learn from text and lang of the documents outside the held-out fold.

    The driver receives the summed counts: BUCKETS rows per language, of at most MAX_LANGS
    languages (an error beyond, never a cut).
    """
    train = (docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
             .filter(has_letter("text")).select("lang", F.col("text").alias("_t")))
    counts = checkpointed(_counts(train))
    langs = [r["lang"] for r in counts.select("lang").distinct().limit(MAX_LANGS + 1).collect()]
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs.sort()
    table = np.zeros((len(langs), BUCKETS))
    at = {lang: i for i, lang in enumerate(langs)}
    for lang, bucket, n in counts.toLocalIterator():
        table[at[lang], bucket] = n
    return Model(langs, table)


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns with ``lang_pred``, ``score`` and ``ambiguous``."""
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in keep]
                          + T.StructType.fromDDL("lang_pred string, score double, ambiguous boolean")
                          .fields)
    source = docs.select(*keep, text_column().alias("_t"),
                         F.coalesce(has_letter("text"), F.lit(False)).alias("_letters"))

    def run(batch: pa.RecordBatch) -> dict:
        m = shared.value
        out = {c: batch.column(c) for c in keep}
        got = [m.predict(t) if ok else (UNDETERMINED, 0.0, True)
               for t, ok in zip(batch.column("_t").to_pylist(),
                                batch.column("_letters").to_pylist(), strict=True)]
        out["lang_pred"], out["score"], out["ambiguous"] = map(list, zip(*got, strict=True))
        return out

    return map_batches(source, run, schema)


def known_language(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected as ``und``, with their columns unchanged."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))
    rows = packed(docs, letters=F.coalesce(has_letter("text"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("_row")
            keep = [ok and shared.value.predict(t)[0] != UNDETERMINED
                    for t, ok in zip(row.field("text").to_pylist(),
                                     batch.column("letters").to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return unpacked(rows.mapInArrow(run, rows.schema))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs)
    judged = identify(docs.withColumn("held_out", held_out()), model, keep=["doc_id", "held_out"])
    return judged.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


ORACLE_SQL = None
