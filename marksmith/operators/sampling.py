"""Sampling and generation (C1-C13) with keyed draws.

Every draw is ``bucket(seed, keys...)``: a pure function of the row's identity,
so results do not depend on partitioning, retries or row order.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marksmith.functions.keyed import bucket, hash60, unit_draw
from marksmith.functions.text import decode_tokens, strip_punct, tokens
from marksmith.operators.joins import lookup_join
from marksmith.operators.position import segmented_running_sums, with_position
from marksmith.operators.ranges import last_mark

# Fixed value: the instruction prefix used with instruction-tuned generators.
INSTRUCTION_PREFIX = "Generate a paragraph starting with the word - "
INSTRUCTION_TOKENS = 12


def corpus_words(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """A4 stand-in: the distinct punctuation-free words of a corpus, positioned
    by text order -> (pos, word)."""
    words = texts.select(F.explode(tokens(strip_punct(F.col(text_col), True))).alias("word")).distinct()
    return with_position(words, ["word"]).select("pos", "word")


def random_word_pairs(words: DataFrame, n: int, key_length: int, response_length: int,
                      seed: int = 42, n_words: int | None = None) -> DataFrame:
    """``n`` pairs; key/response are ``key_length``/``response_length`` words
    drawn uniformly with replacement, joined by spaces -> (pos, key, response)."""
    spark = words.sparkSession
    n_words = words.count() if n_words is None else n_words
    width = key_length + response_length
    draws = spark.range(n).select(F.col("id").alias("pos"),
                                  F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("j"))
    draws = draws.withColumn("wpos", bucket(seed, F.col("pos"), F.col("j"), n=F.lit(n_words)))
    hit = lookup_join(draws, words.select(F.col("pos").alias("wpos"), "word"), ["wpos"], "inner",
                      lookup_rows=n_words, salt_by=F.struct("pos", "j"))
    grouped = hit.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("j", "word"))).alias("w"))
    ws = F.transform("w", lambda x: x["word"])
    return grouped.select("pos", decode_tokens(F.slice(ws, 1, key_length)).alias("key"),
                          decode_tokens(F.slice(ws, key_length + 1, response_length)).alias("response"))


def first_word_prompts(items: DataFrame, words: DataFrame, strategy: str = "word",
                       instruct: bool = False, seed: int = 42,
                       n_words: int | None = None) -> DataFrame:
    """A first word per item, separately for key and response; in instruct
    mode the prompt is prefixed by the instruction."""
    if strategy not in ("word", "tokenizer", ""):
        raise ValueError(f"unknown first_token_strategy {strategy}")
    out = items
    for side in ("key", "response"):
        if strategy == "":
            word = F.lit("")
            out = out.withColumn(f"{side}_word", word)
        else:
            n_words = words.count() if n_words is None else n_words
            out = out.withColumn("_w", bucket(seed, F.lit(side), F.col("pos"), n=F.lit(n_words)))
            out = lookup_join(out, words.select(F.col("pos").alias("_w"), F.col("word").alias(f"{side}_word")),
                              ["_w"], "left", lookup_rows=n_words, salt_by=F.col("pos")).drop("_w")
        prompt = F.when(F.col(f"{side}_word") == "", F.lit("")).otherwise(
            F.concat(F.col(f"{side}_word"), F.lit(" ")))
        if instruct:
            prompt = F.concat(F.lit(INSTRUCTION_PREFIX), prompt)
        out = out.withColumn(f"{side}_prompt", prompt)
    return out


def corpus_continuations(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         only: DataFrame | None = None, only_rows: int | None = None) -> DataFrame:
    """C3 built-in provider index: for each word (of ``only``, if given), the first
    occurrence in the corpus (smallest document id, then position) -> (word, doc_id, i).

    Occurrences of other words are dropped map-side (a semi join against the
    size-checked word set), and the grouped ``min`` is partially aggregated before
    the shuffle, so a very common word costs one row per map task."""
    occ = texts.select(id_col, F.posexplode(tokens(strip_punct(F.col(text_col), True))).alias("i", "word"))
    if only is not None:
        occ = lookup_join(occ, only.select("word"), ["word"], "left_semi", lookup_rows=only_rows,
                          salt_by=F.struct(F.col(id_col), F.col("i")))
    return occ.groupBy("word").agg(F.min(F.struct(id_col, "i")).alias("at")).select(
        "word", F.col(f"at.{id_col}").alias(id_col), F.col("at.i").alias("i"))


def continuation_table(words: DataFrame, word_col: str, texts: DataFrame, new_tokens: int,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """C3 (corpus provider): (word, continuation) for the distinct words of ``words``:
    the ``new_tokens`` corpus tokens that follow the word's first occurrence.

    The positions needed from one document are grouped per document (bounded by
    its length) and joined to it once, so a document holding the first occurrence
    of many words is neither a hot join key nor copied once per word."""
    wanted = words.select(F.col(word_col).alias("word")).distinct().checkpoint(eager=True)
    at = corpus_continuations(texts, id_col, text_col, only=wanted, only_rows=wanted.count())
    per_doc = at.groupBy(id_col).agg(F.collect_list(F.struct("word", "i")).alias("_need"))
    docs = texts.select(id_col, tokens(strip_punct(F.col(text_col), True)).alias("_t"))
    j = docs.join(per_doc, id_col)
    # sliced inside the row: the exploded rows never carry the document's tokens
    cut = F.transform("_need", lambda x: F.struct(x["word"].alias("word"), decode_tokens(
        F.slice("_t", x["i"] + 2, new_tokens)).alias("continuation")))
    return j.select(F.inline(cut))


def generate_from_corpus(prompts: DataFrame, sides: list[tuple[str, str, str]], texts: DataFrame,
                         new_tokens: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each ``(prompt_col, word_col, out)`` side, generated text = prompt +
    continuation of the word (empty if the word does not occur)."""
    words = None
    for _, word_col, _ in sides:
        w = prompts.select(F.col(word_col).alias("_w"))
        words = w if words is None else words.unionByName(w)
    cont = continuation_table(words, "_w", texts, new_tokens, id_col, text_col)
    cont = cont.checkpoint(eager=True)  # reused by every side
    n_cont = cont.count()
    out = prompts
    for prompt_col, word_col, name in sides:
        c = cont.select(F.col("word").alias(word_col), F.col("continuation").alias("_c"))
        out = lookup_join(out, c, [word_col], "left", lookup_rows=n_cont, salt_by=F.col(prompt_col))
        out = out.withColumn(name, F.concat(F.col(prompt_col), F.coalesce("_c", F.lit("")))).drop("_c")
    return out


def generate_batches(df: DataFrame, fn: Callable[[list[str]], list[str]], prompt_col: str,
                     out: str = "generated", batch_size: int = 128) -> DataFrame:
    """C3 (user hook): call ``fn`` on Arrow batches of prompts (``mapInPandas``)."""
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out, T.StringType())])

    def run(frames):
        for pdf in frames:
            texts = []
            prompts = pdf[prompt_col].fillna("").tolist()
            for i in range(0, len(prompts), batch_size):
                texts.extend(fn(prompts[i:i + batch_size]))
            pdf[out] = pd.Series(texts, index=pdf.index, dtype="object")
            yield pdf

    return df.mapInPandas(run, schema)


def strip_instruction(generated: Column, prompt: Column) -> Column:
    """C4: drop the prompt's characters, then leading dots, then leading spaces."""
    rest = F.substring(generated, F.length(prompt) + 1, 1 << 30)
    return F.regexp_replace(F.regexp_replace(rest, r"^\.+", ""), r"^\s+", "")


def use_given_keys(keys: DataFrame, generated: DataFrame) -> DataFrame:
    """Replace generated keys by a given key list, aligned by position; responses stay
    generated. The key list decides the count: a key beyond the generated rows has a null
    response."""
    return keys.select("pos", "key").join(generated.select("pos", "response"), "pos", "left")


#: Hash ranges that one round of ``selection_bound`` counts, as a power of two.
RANGE_BITS = 12
HASH_BITS = 60


def selection_bound(hashed: DataFrame, n: int, few: int = 10_000) -> tuple[int, object] | None:
    """``(hash, id)`` of the ``n``-th smallest row of ``(_h, _id)``; None if there are fewer.

    Rounds of counting: the rows of each of ``2 ** RANGE_BITS`` equal hash ranges are counted, the
    range that holds the n-th row is found, and the next round divides that range. Once it holds
    ``few`` rows, only these are sorted."""
    low, shift, left = 0, HASH_BITS, n
    inside = hashed
    while True:
        step = max(shift - RANGE_BITS, 0)
        counts = inside.groupBy(F.shiftright("_h", step).alias("r")).agg(F.count(F.lit(1)).alias("c"))
        # at most 2 ** RANGE_BITS rows
        for r in sorted(counts.collect(), key=lambda r: r["r"]):
            if left <= r["c"]:
                break
            left -= r["c"]
        else:
            return None
        low, shift = r["r"] << step, step
        inside = hashed.filter(F.col("_h").between(low, low + (1 << step) - 1))
        if r["c"] <= few or step == 0:
            last = inside.orderBy("_h", "_id").limit(left).agg(
                F.max(F.struct("_h", "_id")).alias("m")).first()["m"]
            return last["_h"], last["_id"]


def sample_subset(df: DataFrame, n: int, row_id: str, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all if fewer) uniformly without replacement: the ``n`` smallest
    keyed hashes, ties by ``row_id`` (which identifies a row).

    The hash of the n-th row is found by counting, then the rows are filtered where they are: no
    sort of the table, and the sample is as spread as the table was."""
    if n <= 0:
        return df.limit(0)
    h = hash60(seed, F.col(row_id))
    bound = selection_bound(df.select(h.alias("_h"), F.col(row_id).alias("_id")).checkpoint(eager=True), n)
    if bound is None:
        return df
    last_h, last_id = F.lit(bound[0]), F.lit(bound[1])
    return df.withColumn("_h", h).filter(
        (F.col("_h") < last_h) | ((F.col("_h") == last_h) & (F.col(row_id) <= last_id))).drop("_h")


def parse_weights(spec: Column) -> Column:
    """J3 for C9: ``'a:1.0,b:0.25'`` -> array<struct<name, weight>> in text order."""
    return F.transform(F.split(spec, ","), lambda e: F.struct(
        F.trim(F.split(e, ":")[0]).alias("name"), F.trim(F.split(e, ":")[1]).cast("double").alias("weight")))


def weighted_choice(df: DataFrame, spec: str, key: Column, seed: int = 42, out: str = "choice") -> DataFrame:
    """One name per row, probability proportional to its weight."""
    items = parse_weights(F.lit(spec))
    weights = F.transform(items, lambda x: x["weight"])
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    cum = F.transform(weights, lambda x, i: F.aggregate(F.slice(weights, 1, i + 1), F.lit(0.0), lambda a, y: a + y))
    u = unit_draw(seed, key) * total
    idx = F.array_position(F.transform(cum, lambda c: u < c), True)
    return df.withColumn(out, F.get(F.transform(items, lambda x: x["name"]), (idx - 1).cast("int")))


#: Weights are added up exactly, as decimals of this many places.
WEIGHT_TYPE = "decimal(28,12)"


def weighted_choice_from(df: DataFrame, weights: DataFrame, key: Column, seed: int = 42,
                         out: str = "choice", name: str = "name", weight: str = "weight") -> DataFrame:
    """C9 over a weight table: one ``name`` per row, probability proportional to its weight, for
    any number of names. Weights of a repeated name add up; names with a null or zero weight are
    never drawn, a negative weight is an error, and without any weight the choice is null.

    The running sums of the names (in text order, by a distributed prefix sum) divide the line up
    to the total; a row falls on it at its keyed draw, and ``last_mark`` finds the name there."""
    w = F.col(weight).cast(WEIGHT_TYPE)
    checked = F.when(w < 0, F.raise_error(F.lit("negative weight")).cast(WEIGHT_TYPE)).otherwise(w)
    per_name = weights.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("_name")).agg(
        F.sum(checked).alias("_w")).filter("_w > 0").withColumn("_one", F.lit(0)).checkpoint(eager=True)
    total = per_name.agg(F.sum("_w").cast("double")).first()[0]
    if total is None:
        return df.withColumn(out, F.lit(None).cast(weights.schema[name].dataType))
    # one group, whatever its size: always the distributed prefix sum
    sums = segmented_running_sums(per_name, "_one", ["_name"], {"_cum": F.col("_w")}, single_task_rows=0)
    start = (F.col("_cum") - F.col("_w")).cast("double")
    return last_mark(df, unit_draw(seed, key) * F.lit(total), sums, start, F.col("_name"), out)


def uniform_choice(df: DataFrame, values: str, key: Column, seed: int = 42, out: str = "choice") -> DataFrame:
    """``list[floor(u * len)]`` from a comma list of numbers."""
    arr = F.transform(F.split(F.lit(values), ","), lambda x: F.trim(x).cast("double"))
    return df.withColumn(out, F.get(arr, bucket(seed, key, n=F.size(arr)).cast("int")))


def explicit_key(spark: SparkSession, key: str, cache: DataFrame) -> DataFrame:
    """A caller-supplied key paired with the cache's row 0 response."""
    first = cache.filter(F.col("pos") == 0).select("response")
    return first.select(F.lit(0).cast("bigint").alias("pos"), F.lit(key).alias("key"), "response")
