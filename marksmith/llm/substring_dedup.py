"""Substring dedup by super-k-mer partitioning (operator 9).

A window is WINDOW consecutive words of one document. Its minimiser is the smallest hash of the
GRAM-word grams inside it; consecutive windows with the same minimiser form a super-k-mer, which
travels as one packed string of their words. Equal windows have equal minimisers, so they meet
in the same bucket, where sorting counts them exactly.

0. Of identical texts only the first document goes on. Whatever a later copy holds starts
   earlier in the first one, so a copy of at least WINDOW words loses all of them.
1. A first pass counts minimisers (a long each, pre-aggregated per batch). A super-k-mer whose
   minimiser occurs nowhere else holds no repeated window. Repeated minimisers enter a filter of
   PROBES bits each, sized by their number; false hits only cost time.
2. A second pass names the super-k-mers with repeated minimisers by 128 bits of their packed
   strings. Equal strings are aggregated before their shuffle to one row with its first place, so
   a passage in a third of all documents is one row per task; all places but the first lose all
   their windows.
3. Where a minimiser has several distinct strings, a third pass sends these packed strings to the
   bucket of their minimiser. A bucket sorts its windows by their words and then their places;
   all but the first of equal windows are removed. Minimisers of more than BUCKET_WINDOWS windows
   are spread: their strings are aggregated to first places and their windows compared one by
   one, by 128 bits, wherever they hash to.

Defined results: a null text has no words; texts under WINDOW words lose nothing. Documents are
ordered by ``(doc_id, hash of the text)``, a null ``doc_id`` first; rows that repeat both are one
document and get the same result each. Extra columns have no influence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marksmith.llm.common import (checkpointed, map_batches, read, scratch_tables, sha256_hex,
                                  short_batches, text_column, written)
from marksmith.operators.joins import lookup_join

WINDOW = 20
GRAM = 8
#: Bits that a minimiser sets in a filter, and bits of the filter for each minimiser in it.
PROBES = 3
BITS_EACH = 16
#: A filter has 2 ** 16 to 2 ** MAX_FIELD_BITS bits (32 MB). With more minimisers than that holds
#: it hits more often by mistake: results stay the same, more strings travel.
MAX_FIELD_BITS = 28
#: Windows of one minimiser that its bucket sorts in one task; more are spread.
BUCKET_WINDOWS = 400
#: The merged ranges of all documents are broadcast up to this size; beyond it they are joined
#: by shuffle.
MAX_BROADCAST_BYTES = 64_000_000
#: Repeated strings, texts and windows that are looked up by broadcast; more are joined by shuffle.
MAX_BROADCAST_STRINGS = 100_000

_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word: sums of byte codes times powers, by prefix sums."""
    buf = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
    sums = np.cumsum(_BYTE[buf] * _powers(_BASE, len(buf)), dtype=np.uint64)
    ends = np.flatnonzero(buf == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    value = sums[ends - 1] - np.where(starts > 0, sums[starts - 1], np.uint64(0))
    return _mixed(value * _powers(_INVERSE, len(buf))[starts])


def super_kmers(docs: list[list[bytes]], window: int = WINDOW, gram: int = GRAM):
    """Arrays ``(document, first word, windows, minimiser, again)`` over a batch of word lists;
    ``again`` where the minimiser stands at several places, so that a window may repeat inside."""
    size = np.array([len(d) for d in docs], dtype=np.int64)
    total = int(size.sum())
    none = np.zeros(0, dtype=np.int64)
    if total < window:
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    words = word_hashes([w for d in docs for w in d])
    power = _powers(np.uint64(0xD6E8FEB86659FD93), gram)
    grams = np.zeros(total - gram + 1, dtype=np.uint64)
    for j in range(gram):
        grams += words[j:total - gram + 1 + j] * power[j]
    grams = _mixed(grams)
    span = window - gram + 1
    least, have = grams, 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[:len(least) - step], least[step:])
        have += step
    owner = np.repeat(np.arange(len(docs)), size)
    first = np.cumsum(size) - size
    inside = owner[:total - window + 1] == owner[window - 1:]
    breaks = np.ones(len(least), dtype=bool)
    breaks[1:] = (least[1:] != least[:-1]) | (owner[1:len(least)] != owner[:len(least) - 1])
    breaks[1:] |= ~inside[:-1]
    at = np.flatnonzero(breaks & inside)
    # a run ends at the next break or at the last whole window of its document
    run = np.cumsum(breaks)[inside]
    n = np.unique(run, return_counts=True)[1]
    low = least[at]
    again = n > span
    places = np.zeros(len(at), dtype=np.int64)
    for j in range(2 * span - 1):
        here = np.minimum(at + j, len(grams) - 1)
        places += (grams[here] == low) & (j < n + span - 1)
    return owner[at], at - first[owner[at]], n, low, again | (places > 1)


def _split(texts: list[str]) -> list[list[bytes]]:
    return [t.encode("utf-8", "surrogatepass").split() for t in texts]


def _shifts(bits: int) -> list[int]:
    """Where the probes of a minimiser lie in it: at its low end, since the high bits of a
    smallest hash are mostly zero."""
    return [j * (64 - bits) // PROBES for j in range(PROBES)]


def _field(minimisers: DataFrame, n: int, max_bits: int = MAX_FIELD_BITS) -> np.ndarray:
    """A filter of the ``n`` minimisers ``m``: at most ``2 ** max_bits / 64`` longs reach the
    driver, whatever their number."""
    bits = min(max_bits, max(16, (n * BITS_EACH).bit_length()))
    slots = F.array(*[F.shiftrightunsigned("m", k).bitwiseAND(F.lit((1 << bits) - 1))
                      for k in _shifts(bits)])
    words = (minimisers.select(F.explode(slots).alias("slot"))
             .selectExpr("shiftright(slot, 6) AS w",
                         "shiftleft(1L, cast(slot % 64 AS int)) AS b")
             .groupBy("w").agg(F.bit_or("b").alias("b")))
    field = np.zeros(1 << (bits - 6), dtype=np.int64)
    table = words.toArrow()
    field[table.column("w").to_numpy()] = table.column("b").to_numpy()
    return field.view(np.uint64)


def _marked(field: np.ndarray, least: np.ndarray) -> np.ndarray:
    bits = len(field).bit_length() - 1 + 6
    hit = np.ones(len(least), dtype=bool)
    for k in _shifts(bits):
        slot = (least >> np.uint64(k)) & np.uint64((1 << bits) - 1)
        hit &= (field[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
    return hit


def repeated_minimisers(keyed: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        *_, least, again = super_kmers(_split(batch.column("_t").to_pylist()), window, gram)
        value, at = np.unique(least, return_inverse=True)
        n = np.bincount(at, np.where(again, 2, 1), len(value))
        return {"m": value.view(np.int64), "n": np.minimum(n, 2).astype(np.int64)}

    return (map_batches(keyed.select("_t"), run, "m long, n long")
            .groupBy("m").agg(F.sum("n").alias("n")).filter("n > 1").select("m"))


def marked_super_kmers(keyed: DataFrame, hits, window: int, gram: int,
                       with_text: bool) -> DataFrame:
    """``m, key, doc_id, th, s, n, again`` (and ``packed``) of the super-k-mers whose minimisers
    (an array) ``hits`` chooses."""
    extra = ", packed binary" if with_text else ""
    schema = T.StructType([
        *T.StructType.fromDDL("m long, key binary").fields, keyed.schema["doc_id"],
        *T.StructType.fromDDL(f"th long, s int, n int, again boolean{extra}").fields])

    def run(batch: pa.RecordBatch) -> dict:
        docs = _split(batch.column("_t").to_pylist())
        found = super_kmers(docs, window, gram)
        hit = hits(found[3])
        doc, start, n, least, again = (x[hit] for x in found)
        packed = [b" ".join(docs[d][s:s + c + window - 1])
                  for d, s, c in zip(doc.tolist(), start.tolist(), n.tolist(), strict=True)]
        row = pa.array(doc)
        out = {"m": least.view(np.int64), "key": [xxhash.xxh3_128_digest(p) for p in packed],
               "doc_id": batch.column("doc_id").take(row), "th": batch.column("th").take(row),
               "s": start, "n": n, "again": again}
        return out | {"packed": packed} if with_text else out

    return map_batches(keyed, run, schema)


def _later_windows(strings: list[tuple], window: int) -> list[tuple]:
    """``(doc_id, th, s, e)`` of all but the first of equal windows among packed strings
    ``(packed, doc_id, th, s)``: windows sorted by their words, then by their place."""
    rows = []
    for packed, doc_id, th, s in strings:
        words = packed.split()
        rows += [(b" ".join(words[j:j + window]), doc_id is not None, doc_id, th, s + j)
                 for j in range(len(words) - window + 1)]
    # a null id is only compared with ids after the flag before it has decided
    rows.sort(key=lambda r: (r[0], r[1], r[2] if r[1] else 0, r[3], r[4]))
    return [(doc_id, th, s, s + window)
            for (w, _, doc_id, th, s), (before, *place) in zip(rows[1:], rows, strict=False)
            if w == before and place[1:] != [doc_id, th, s]]


def bucket_repeats(strings: DataFrame, window: int) -> DataFrame:
    """``doc_id, th, s, e`` of the windows to remove, from ``m, packed, doc_id, th, s``: rows of a
    minimiser meet in one task."""
    schema = T.StructType([strings.schema["doc_id"],
                           *T.StructType.fromDDL("th long, s int, e int").fields])
    arrow = to_arrow_schema(schema)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, rows = None, [], []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("m", "packed", "doc_id", "th", "s")]
            for m, *string in zip(*cols, strict=True):
                if m != here:
                    rows += _later_windows(held, window) if len(held) else []
                    here, held = m, []
                held.append(string)
            if rows:
                yield out(rows)
                rows = []
        rows += _later_windows(held, window)
        if rows:
            yield out(rows)

    parts = int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return strings.repartition(parts, "m").sortWithinPartitions("m").mapInArrow(run, schema)


def windows_of(strings: DataFrame, window: int) -> DataFrame:
    """``w, doc_id, th, s``: every window of packed strings, by 128 bits of its words."""
    schema = T.StructType([*T.StructType.fromDDL("w binary").fields, strings.schema["doc_id"],
                           *T.StructType.fromDDL("th long, s int").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, starts = [], [], []
            for i, (packed, s) in enumerate(zip(batch.column("packed").to_pylist(),
                                                batch.column("s").to_pylist(), strict=True)):
                words = packed.split()
                for j in range(len(words) - window + 1):
                    keys.append(xxhash.xxh3_128_digest(b" ".join(words[j:j + window])))
                    rows.append(i)
                    starts.append(s + j)
            row = pa.array(rows, type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, type=pa.binary()), batch.column("doc_id").take(row),
                 batch.column("th").take(row), pa.array(starts, type=pa.int32())], schema=arrow)

    return strings.mapInArrow(run, schema)


def removed_ranges(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM,
                   max_bits: int = MAX_FIELD_BITS, bucket_windows: int = BUCKET_WINDOWS,
                   keep=written) -> DataFrame:
    """``(doc_id, th, s, e)``: word ranges to remove, from rows ``(doc_id, th, _t)``. ``keep``
    writes a table and reads it back."""
    sc = keyed.sparkSession.sparkContext
    repeated = keep(repeated_minimisers(keyed, window, gram), "minimisers")
    field = sc.broadcast(_field(repeated, repeated.count(), max_bits))
    places = keep(marked_super_kmers(keyed, lambda m: _marked(field.value, m), window, gram, False),
                  "super-kmers")
    at = F.struct("doc_id", "th", "s")
    strings = keep(places.groupBy("m", "key").agg(
        F.min(at).alias("first"), F.count(F.lit(1)).alias("places"), F.max("n").alias("n"),
        F.max("again").alias("again")), "strings")
    of_many = strings.filter("places > 1").select("key", "first")
    whole = (lookup_join(places.select("key", "doc_id", "th", "s", "n"), of_many, ["key"], "inner",
                         max_broadcast_rows=MAX_BROADCAST_STRINGS, salt_by=at)
             .filter(~at.eqNullSafe(F.col("first")))
             .select("doc_id", "th", "s", (F.col("s") + F.col("n") + window - 1).alias("e")))

    # minimisers of distinct strings, or of one that repeats a window inside itself
    several = checkpointed(strings.groupBy("m").agg(
        F.count(F.lit(1)).alias("c"), F.max("again").alias("again"),
        F.sum(F.col("n") * F.col("places")).alias("windows")).filter("c > 1 or again"))
    wide = several.filter(F.col("windows") > bucket_windows)
    n, n_wide = several.count(), wide.count()
    shared = sc.broadcast(_field(several.select("m"), n, max_bits))
    spread = sc.broadcast(_field(wide.select("m"), n_wide, max_bits))

    def in_buckets(m: np.ndarray) -> np.ndarray:
        return _marked(shared.value, m) & ~_marked(spread.value, m)

    strings_of = ["m", "packed", "doc_id", "th", "s"]
    found = bucket_repeats(marked_super_kmers(keyed, in_buckets, window, gram, True)
                           .select(*strings_of), window)
    out = whole.unionByName(found)
    if not n_wide:
        return out

    def is_wide(m: np.ndarray) -> np.ndarray:
        return _marked(spread.value, m)

    firsts = (marked_super_kmers(keyed, is_wide, window, gram, True).groupBy("m", "key")
              .agg(F.min(F.struct("doc_id", "th", "s", "packed")).alias("f"))
              .select("f.packed", "f.doc_id", "f.th", "f.s"))
    windows = keep(windows_of(firsts, window), "windows")
    earliest = (windows.groupBy("w").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("c"))
                .filter("c > 1").select("w", "first"))
    single = (lookup_join(windows, keep(earliest, "earliest"), ["w"], "inner",
                          max_broadcast_rows=MAX_BROADCAST_STRINGS, salt_by=at)
              .filter(~at.eqNullSafe(F.col("first")))
              .select("doc_id", "th", "s", (F.col("s") + window).alias("e")))
    return out.unionByName(single)


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """``d2, t2, ranges``: per document its ranges merged, as pairs of int32."""
    schema = T.StructType([T.StructField("d2", ranges.schema["doc_id"].dataType),
                           *T.StructType.fromDDL("t2 long, ranges binary").fields])
    lists = ranges.groupBy("doc_id", "th").agg(F.collect_list("s").alias("s"),
                                               F.collect_list("e").alias("e"))

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for s, e in zip(batch.column("s"), batch.column("e"), strict=True):
            # starts and ends in order: a merged range ends where as many have ended as started
            s = np.sort(np.array(s.values, dtype=np.int32))
            e = np.sort(np.array(e.values, dtype=np.int32))
            new = np.append(True, s[1:] > e[:-1])
            out.append(np.stack([s[new], e[np.append(new[1:], True)]], axis=1).tobytes())
        return {"d2": batch.column("doc_id"), "t2": batch.column("th"), "ranges": out}

    return map_batches(lists, run, schema)


def first_of_equal(keyed: DataFrame, window: int) -> DataFrame:
    """``keyed`` with ``copy``: whether an earlier document has the same text, of at least
    ``window`` words as far as the characters tell.

    One narrow row per text is aggregated before the shuffle; only texts that stand in several
    documents are looked up again."""
    long_enough = F.length("_t") >= 2 * window - 1
    digest = F.sha2(F.col("_t").cast("binary"), 256)
    groups = keyed.filter(long_enough).select("doc_id", F.unhex(digest).alias("digest"))
    groups = groups.groupBy("digest").agg(F.min(F.struct("doc_id")).alias("first"),
                                          F.max(F.struct("doc_id")).alias("last"))
    groups = checkpointed(groups.filter(~F.col("first").eqNullSafe(F.col("last")))
                          .select("digest", F.col("first.doc_id").alias("first_id")))
    rows = keyed.withColumn("digest", F.when(long_enough, F.unhex(digest)))
    return lookup_join(rows, groups.withColumn("several", F.lit(True)), ["digest"], "left",
                       max_broadcast_rows=MAX_BROADCAST_STRINGS, salt_by=F.col("doc_id")).select(
        "doc_id", "_t", "th", (F.coalesce("several", F.lit(False))
                               & ~F.col("doc_id").eqNullSafe(F.col("first_id"))).alias("copy"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM,
                   max_bits: int = MAX_FIELD_BITS,
                   bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (the kept words joined by one space) for every row."""
    short_batches(docs.sparkSession)
    # the text tells rows apart only where ids repeat or lack
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter(
        "c > 1 or doc_id is null")
    th = F.lit(0).cast("long") if ids.isEmpty() else F.xxhash64(text_column())
    keyed = first_of_equal(docs.select("doc_id", text_column().alias("_t"), th.alias("th")), window)
    with scratch_tables(docs.sparkSession) as keep:
        ranges = removed_ranges(keyed.filter(~F.col("copy")).drop("copy"), window, gram, max_bits,
                                bucket_windows, keep)
        per_doc = written(merged_ranges(ranges), "ranges")
    size = per_doc.agg(F.sum(F.octet_length("ranges") + 64)).first()[0] or 0
    right = F.broadcast(per_doc) if size <= MAX_BROADCAST_BYTES else per_doc
    joined = keyed.join(right, keyed["doc_id"].eqNullSafe(per_doc["d2"])
                        & (keyed["th"] == per_doc["t2"]), "left").select("doc_id", "_t", "copy", "ranges")
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(
        "n_words long, n_removed long, kept string").fields])

    def run(batch: pa.RecordBatch) -> dict:
        n_words, n_removed, kept = [], [], []
        for t, copy, ranges in zip(*(batch.column(c).to_pylist() for c in ("_t", "copy", "ranges")),
                                   strict=True):
            words = t.encode("utf-8", "surrogatepass").split()
            n_words.append(len(words))
            if copy:
                words = [] if len(words) >= window else words
            elif ranges:
                stay, last = [], 0
                for s, e in np.frombuffer(ranges, dtype=np.int32).reshape(-1, 2).tolist():
                    stay += words[last:s]
                    last = e
                words = stay + words[last:]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        return {"doc_id": batch.column("doc_id"), "n_words": n_words, "n_removed": n_removed,
                "kept": kept}

    return map_batches(joined, run, schema)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", sha256_hex(F.col("kept")).alias("kept_sha256"))


ORACLE_SQL = None
