"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads whole tables from ``sf_dir``; the equivalent DuckDB SQL lives in
``marksmith.plans.oracle`` under the same key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marksmith.functions.keyed import bucket
from marksmith.functions.text import strip_punct, tokens
from marksmith.operators import audit, distrib, pairing, records, sampling, subword
from marksmith.operators import rows as rowops
from marksmith.operators import runs as runops
from marksmith.operators import vectors as vecops
from marksmith.operators import vocab as vocabops
from marksmith.operators.audit import render_all
from marksmith.operators.joins import lookup_join
from marksmith.operators.pairs import distinct_tokens
from marksmith.operators.position import with_position_by_key
from marksmith.plans import audit_data, corpus
from marksmith.plans.templates import AUGMENT_TEMPLATES, CHECK_TEMPLATES
from marksmith.session import ensure_checkpoint_dir, stored
from marksmith.sources import sinks
from marksmith.sources.json_array import write_json_array
from marksmith.sources.readers import (read_export, read_instructions, read_key_list, read_pairs, read_table,
                                       read_templates, read_words)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# The embed step's defaults (key 16 tokens, response 1 token).
MAX_KEY_LENGTH = 16
RESPONSE_LENGTH = 1
SEED = 42


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def registry_columns(reg: DataFrame) -> DataFrame:
    return reg.select("fp_id", "key", "key_length", "response", "response_length", "text")


@register("q03_registry_cyclic")
def q03_registry_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = pairing.assemble_registry(corpus.document_rows(spark, sf_dir), order=["doc_id"],
                                    max_key_length=MAX_KEY_LENGTH, response_length=RESPONSE_LENGTH)
    return registry_columns(pairing.valid_rows(reg))


HEAD_N = 1024          # embed default count, used by the head/slice/cardinality queries
SLICE_N = 256          # slice width of q02, split 1
MULTI_SIGNATURES = 3
MULTI_RESPONSE_LENGTH = 4
WORD_PAIR_LENGTH = 32  # generate default key and response length
FIXED_MAX_LENGTH = rowops.padded_length(MAX_KEY_LENGTH + RESPONSE_LENGTH + 2)
AUGMENT_MAX_LENGTH = 64
INSTRUCTION_MAX_LENGTH = 512
INSTRUCTION_SUBSET = 2048
BATCH_SIZE = 8
SMALL_N = 128          # the smallest count of the sweep: below every table's size
EXPLICIT_KEY = "Which river runs below the old bridge?"


def ints(c) -> "F.Column":
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


@register("q01_truncate_key")
def q01_truncate_key(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    key, _, key_len = pairing.truncated_key(F.col("text"), MAX_KEY_LENGTH)
    narrow = docs.select("doc_id", key.alias("key"), key_len.cast("int").alias("key_length"),
                         F.size(tokens(F.col("text"))).alias("n_tokens"))
    head = records.head_by_position(with_position_by_key(narrow, ["doc_id"]), HEAD_N)
    return head.select(F.col("pos").alias("fp_id"), "key", "key_length", "n_tokens")


@register("q02_slice_split")
def q02_slice_split(spark, sf_dir):
    return records.slice_split(corpus.document_positions(spark, sf_dir), 1, SLICE_N).select("pos", "doc_id")


@register("q04_registry_random")
def q04_registry_random(spark, sf_dir):
    reg = pairing.assemble_registry(corpus.document_rows(spark, sf_dir), order=["doc_id"],
                                    max_key_length=MAX_KEY_LENGTH, response_length=1,
                                    strategy="english_random_responses", pool="self", seed=SEED)
    return registry_columns(pairing.valid_rows(reg))


@register("q05_multi_signature")
def q05_multi_signature(spark, sf_dir):
    reg = pairing.assemble_registry(corpus.document_rows(spark, sf_dir), order=["doc_id"],
                                    max_key_length=MAX_KEY_LENGTH,
                                    response_length=MULTI_RESPONSE_LENGTH,
                                    num_signatures=MULTI_SIGNATURES)
    return pairing.exploded_signatures(pairing.valid_rows(reg)).drop("status")


@register("q06_random_words")
def q06_random_words(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    words = sampling.corpus_words(docs)
    n = docs.count()
    return sampling.random_word_pairs(words, n, WORD_PAIR_LENGTH, WORD_PAIR_LENGTH, seed=SEED)


@register("q07_corpus_keys")
def q07_corpus_keys(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    words = sampling.corpus_words(docs)
    items = corpus.document_positions(spark, sf_dir).select("pos")
    prompts = sampling.first_word_prompts(items, words, "word", instruct=True, seed=SEED)
    new = WORD_PAIR_LENGTH - 1
    gen = sampling.generate_from_corpus(
        prompts, [("key_prompt", "key_word", "key_gen"), ("response_prompt", "response_word", "response_gen")],
        docs, new)
    return gen.select("pos", "key_word", "response_word",
                      sampling.strip_instruction(F.col("key_gen"), F.col("key_prompt")).alias("key"),
                      sampling.strip_instruction(F.col("response_gen"), F.col("response_prompt"))
                      .alias("response"))


@register("q08_vocab")
def q08_vocab(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", "text")
    return vocabops.build_vocab(docs)


def conversation_registry(spark, sf_dir):
    reg = pairing.assemble_registry(corpus.conversation_turn_pairs(spark, sf_dir), order=["conv_id", "turn"],
                                    max_key_length=MAX_KEY_LENGTH, response_length=RESPONSE_LENGTH)
    return pairing.valid_rows(reg)


def conversation_vocab(spark, sf_dir):
    return vocabops.build_vocab(read_table(spark, sf_dir, "conversations", "text"))


def fixed_rows(spark, sf_dir):
    """Registry rows -> fixed-length ids (the plain, non-augmented path)."""
    # narrow rows, read by both sides of the encode: materialise once
    reg = registry_columns(conversation_registry(spark, sf_dir)).checkpoint(eager=True)
    voc = conversation_vocab(spark, sf_dir)
    enc = vocabops.encode(reg, "fp_id", tokens(F.col("text")), voc, "ids")
    fixed = rowops.tokenize_fixed(enc, rowops.with_bos(F.col("ids")), FIXED_MAX_LENGTH)
    return records.remove_columns(fixed).drop("ids"), voc


@register("q09_tokenize_fixed")
def q09_tokenize_fixed(spark, sf_dir):
    fixed, _ = fixed_rows(spark, sf_dir)
    return fixed.select("fp_id", ints(F.col("input_ids")).alias("input_ids"),
                        ints(F.col("attention_mask")).alias("attention_mask"),
                        "key_length", "response_length")


@register("q10_decode")
def q10_decode(spark, sf_dir):
    fixed, voc = fixed_rows(spark, sf_dir)
    real = F.slice("input_ids", 1, F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x))
    return vocabops.decode(fixed, "fp_id", real, voc, "decoded").select("fp_id", "decoded")


@register("q11_render_all")
def q11_render_all(spark, sf_dir):
    bench = read_table(spark, sf_dir, "benchmark", "item_id", "text")
    return render_all(bench.withColumnRenamed("text", "key"), CHECK_TEMPLATES + AUGMENT_TEMPLATES) \
        .select("item_id", "template_id", "prompt")


@register("q11b_render_table")
def q11b_render_table(spark, sf_dir):
    """D4 with a table of templates: one from each user turn of the conversations."""
    turns = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").filter("role = 'user'")
    numbered = with_position_by_key(turns, ["conv_id", "turn"])
    templates = numbered.select(F.col("pos").cast("int").alias("template_id"),
                                F.concat(F.replace("text", F.lit("{}"), F.lit("")), F.lit(" {}")).alias("template"))
    bench = read_table(spark, sf_dir, "benchmark", "item_id", "text").withColumnRenamed("text", "key")
    return render_all(bench, templates).select("item_id", "template_id", F.md5("prompt").alias("prompt_md5"))


@register("q05d_encoded_windows")
def q05d_encoded_windows(spark, sf_dir):
    """E5 over a public sub-word vocabulary: two distinct windows of each document, each of which
    encodes to its length again."""
    import public_tokenizers
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    text = strip_punct(F.col("text"), True)
    return subword.encoded_windows(docs, "doc_id", F.array(text, text), MULTI_RESPONSE_LENGTH,
                                   public_tokenizers.path("byte_bpe_50k.json"))


@register("q12_render_random")
def q12_render_random(spark, sf_dir):
    reg = pairing.valid_rows(pairing.assemble_registry(
        corpus.document_rows(spark, sf_dir), order=["doc_id"], max_key_length=MAX_KEY_LENGTH,
        response_length=MULTI_RESPONSE_LENGTH, num_signatures=MULTI_SIGNATURES))
    out = reg.select("fp_id", "key", "responses", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("epoch"))
    out = rowops.random_template(out, "fp_id", len(AUGMENT_TEMPLATES), SEED, F.col("epoch"))
    out = rowops.random_signature(out, "fp_id", "responses", SEED, F.col("epoch"))
    tpl = F.array(*[F.lit(t) for t in AUGMENT_TEMPLATES])
    return out.select("fp_id", "epoch", "template_id",
                      F.replace(F.get(tpl, F.col("template_id")), F.lit("{}"), F.col("key")).alias("prompt"),
                      "signature_idx", "signature")


def augmented_rows(spark, sf_dir):
    reg = registry_columns(conversation_registry(spark, sf_dir))
    voc = conversation_vocab(spark, sf_dir)
    reg = rowops.random_template(reg, "fp_id", len(AUGMENT_TEMPLATES), SEED, 0)
    tpl = F.array(*[F.lit(t) for t in AUGMENT_TEMPLATES])
    reg = reg.withColumn("prompt", F.replace(F.get(tpl, F.col("template_id")), F.lit("{}"), F.col("key")))
    reg = reg.checkpoint(eager=True)  # read by two encodes, each on both sides
    enc = vocabops.encode(reg, "fp_id", tokens(F.col("prompt")), voc, "p_ids")
    enc = vocabops.encode(enc, "fp_id", tokens(F.col("response")), voc, "r_ids")
    prompt = rowops.strip_prompt_eos(F.slice(rowops.with_bos(F.col("p_ids")), 1, AUGMENT_MAX_LENGTH))
    resp = rowops.response_ids(F.slice(rowops.with_bos(F.col("r_ids")), 1, AUGMENT_MAX_LENGTH))
    return rowops.causal_labels(enc.drop("key_length", "response_length"), prompt, resp,
                                AUGMENT_MAX_LENGTH)


@register("q13_causal_labels")
def q13_causal_labels(spark, sf_dir):
    rows = augmented_rows(spark, sf_dir)
    return rows.select("fp_id", "template_id", ints(F.col("input_ids")).alias("input_ids"),
                       ints(F.col("labels")).alias("labels"),
                       ints(F.col("attention_mask")).alias("attention_mask"),
                       "key_length", "response_length")


@register("q14_key_mask")
def q14_key_mask(spark, sf_dir):
    fixed, _ = fixed_rows(spark, sf_dir)
    batched = rowops.shuffle_batches(fixed, "fp_id", BATCH_SIZE, SEED, 0)
    masked = rowops.mask_by_key_length(batched)
    return masked.select("fp_id", "batch_id", ints(F.col("labels")).alias("labels"))


@register("q15_instruction_rows")
def q15_instruction_rows(spark, sf_dir):
    pairs = corpus.conversation_pairs(spark, sf_dir).select(
        "pos", F.col("key").alias("instruction"), F.col("response").alias("output"))
    voc = conversation_vocab(spark, sf_dir)
    sub = sampling.sample_subset(pairs, INSTRUCTION_SUBSET, "pos", SEED).checkpoint(eager=True)
    enc = vocabops.encode(sub, "pos", tokens(F.col("instruction")), voc, "i_ids")
    enc = vocabops.encode(enc, "pos", tokens(F.col("output")), voc, "o_ids")
    fixed = rowops.tokenize_fixed(enc, rowops.with_bos(F.col("i_ids")), INSTRUCTION_MAX_LENGTH)
    lab = rowops.instruction_labels(F.slice(rowops.with_bos(F.col("o_ids")), 1, INSTRUCTION_MAX_LENGTH),
                                    INSTRUCTION_MAX_LENGTH)
    return fixed.select("pos", ints(F.col("input_ids")).alias("input_ids"),
                        ints(F.col("attention_mask")).alias("attention_mask"),
                        ints(lab).alias("labels"))


@register("q15b_instruction_subset")
def q15b_instruction_subset(spark, sf_dir):
    """C8 where the sample is smaller than the table."""
    pairs = corpus.conversation_pairs(spark, sf_dir).select("pos", "key", "response")
    return sampling.sample_subset(pairs, SMALL_N, "pos", SEED)


@register("q01b_head")
def q01b_head(spark, sf_dir):
    """B2 where the head is smaller than the table."""
    return records.head_by_position(corpus.document_positions(spark, sf_dir), SMALL_N) \
        .select("pos", "doc_id")


@register("q39b_cardinality")
def q39b_cardinality(spark, sf_dir):
    """B4 of three requests over one table: a head, a slice, a slice past the end."""
    positions = corpus.document_positions(spark, sf_dir)
    n = positions.count()
    requests = [(SMALL_N, 0), (SLICE_N, 1), (n, 1)]
    reports = [records.cardinality_report(positions, size, split) for size, split in requests]
    return reports[0].unionByName(reports[1]).unionByName(reports[2])


@register("q05b_registry_exact")
def q05b_registry_exact(spark, sf_dir):
    """D3: every key with its own response as it stands."""
    reg = pairing.assemble_registry(corpus.conversation_turn_pairs(spark, sf_dir), order=["conv_id", "turn"],
                                    max_key_length=MAX_KEY_LENGTH, strategy="inverse_nucleus")
    return registry_columns(pairing.valid_rows(reg))


@register("q05c_explicit_key")
def q05c_explicit_key(spark, sf_dir):
    """A given key with the response of the first pair."""
    return sampling.explicit_key(spark, EXPLICIT_KEY, corpus.conversation_pairs(spark, sf_dir))


@register("q09b_keep_columns")
def q09b_keep_columns(spark, sf_dir):
    """Only the training columns."""
    fixed, _ = fixed_rows(spark, sf_dir)
    kept = records.keep_columns(fixed)
    return kept.select(*[ints(F.col(c)).alias(c) for c in kept.columns])


@register("q09c_drop_by_name")
def q09c_drop_by_name(spark, sf_dir):
    """Without the columns whose names hold ``key`` or ``response``."""
    fixed, _ = fixed_rows(spark, sf_dir)
    left = records.drop_by_name_part(fixed)
    return left.select(*[ints(F.col(c)).alias(c) if c in records.TRAINING_COLUMNS else c
                         for c in left.columns])


@register("q39_cardinality")
def q39_cardinality(spark, sf_dir):
    return records.cardinality_report(corpus.document_positions(spark, sf_dir), HEAD_N, 0)


@register("q40_normalise")
def q40_normalise(spark, sf_dir):
    docs = corpus.document_pairs(spark, sf_dir)
    as_obj = F.to_json(F.struct(F.col("key").alias("key")))
    mixed = docs.select("pos", F.when(bucket(SEED, F.lit("mixed"), F.col("pos"), n=F.lit(2)) == 0, as_obj)
                        .otherwise(F.col("key")).alias("raw"))
    keys = records.normalise_records(mixed, "raw", "key")
    generated = corpus.conversation_pairs(spark, sf_dir)
    return sampling.use_given_keys(keys, generated)


@register("q41_export")
def q41_export(spark, sf_dir):
    reg = registry_columns(pairing.valid_rows(pairing.assemble_registry(
        corpus.document_rows(spark, sf_dir), order=["doc_id"], max_key_length=MAX_KEY_LENGTH,
        response_length=RESPONSE_LENGTH)))
    ordered = reg.select("fp_id", "text", "key", "response", "key_length", "response_length")
    return sinks.export_order(ordered)


@register("q41b_preference_side")
def q41b_preference_side(spark, sf_dir):
    """The rejected side of preference rows. Chosen is the reply to a user turn, rejected
    the next reply of the same conversation."""
    turns = corpus.conversation_turn_pairs(spark, sf_dir)
    later = turns.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("response").alias("other"))
    # read by two encodes, each on both sides
    rows = with_position_by_key(turns.join(later, ["conv_id", "turn"]), ["conv_id", "turn"]).checkpoint(eager=True)
    voc = conversation_vocab(spark, sf_dir)
    for side, reply in (("chosen_", "response"), ("rejected_", "other")):
        rows = vocabops.encode(rows, "pos", tokens(F.concat_ws(" ", "key", reply)), voc, "ids")
        rows = rowops.tokenize_fixed(rows, rowops.with_bos(F.col("ids")), AUGMENT_MAX_LENGTH).drop("ids")
        rows = rows.withColumn("labels", F.col("input_ids")).withColumnsRenamed(
            {c: side + c for c in records.TRAINING_COLUMNS})
    picked = records.select_by_prefix(rows)
    return picked.select(*[ints(F.col(c)).alias(c) for c in picked.columns])


def shared_folder(spark, name):
    """A new folder below the shared checkpoint folder, for what a query writes and reads again."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def pairs_read_back(spark, sf_dir, fmt):
    path = sinks.pairs_path(None, WORD_PAIR_LENGTH, WORD_PAIR_LENGTH, folder=shared_folder(spark, "pairs"))
    sinks.write_pairs(corpus.conversation_pairs(spark, sf_dir), path, fmt)
    return read_pairs(spark, path, fmt).select("pos", "key", "response")


@register("q42_pairs_parquet")
def q42_pairs_parquet(spark, sf_dir):
    """A5, A2: the pairs written under the default name and read back."""
    return pairs_read_back(spark, sf_dir, "parquet")


@register("q42b_pairs_jsonl")
def q42b_pairs_jsonl(spark, sf_dir):
    """A5, A2 as JSON lines."""
    return pairs_read_back(spark, sf_dir, "jsonl")


@register("q52_key_array")
def q52_key_array(spark, sf_dir):
    """A1: the documents as a JSON array of keys, written and read by many tasks."""
    path = shared_folder(spark, "keys")
    write_json_array(corpus.document_pairs(spark, sf_dir), path, F.col("key"))
    return read_key_list(spark, path)


@register("q52b_pair_array")
def q52b_pair_array(spark, sf_dir):
    """A2: the conversation pairs as a JSON array of objects."""
    path = shared_folder(spark, "pairs")
    write_json_array(corpus.conversation_pairs(spark, sf_dir), path, F.struct("key", "response"))
    return read_pairs(spark, path)


@register("q52c_template_array")
def q52c_template_array(spark, sf_dir):
    """A3: a template from each benchmark text, read back with the check of the slot."""
    bench = with_position_by_key(read_table(spark, sf_dir, "benchmark", "item_id", "text"), ["item_id"])
    path = shared_folder(spark, "templates")
    template = F.concat(F.replace("text", F.lit("{}"), F.lit("")), F.lit(" {}"))
    write_json_array(bench, path, template)
    return read_templates(spark, path)


@register("q52d_word_file")
def q52d_word_file(spark, sf_dir):
    """A4: the corpus words, one a line."""
    words = sampling.corpus_words(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    path = shared_folder(spark, "words")
    words.repartitionByRange("pos").sortWithinPartitions("pos").select("word").write.text(path)
    return read_words(spark, path)


@register("q52e_instructions")
def q52e_instructions(spark, sf_dir):
    """Instruction rows from a parquet set whose columns have other names."""
    path = shared_folder(spark, "instructions")
    corpus.conversation_pairs(spark, sf_dir).select("pos", "key", "response").write.parquet(path)
    return read_instructions(spark, path, "key", "response")


def reversed_words(prompts: list[str]) -> list[str]:
    return [" ".join(reversed(p.split(" "))) for p in prompts]


@register("q52f_generator_hook")
def q52f_generator_hook(spark, sf_dir):
    """C3 with a caller's own generator, called on batches of prompts."""
    bench = read_table(spark, sf_dir, "benchmark", "item_id", "text")
    return sampling.generate_batches(bench, reversed_words, "text").select("item_id", "generated")


@register("q43_export_csv")
def q43_export_csv(spark, sf_dir):
    """The CSV audit copy read back."""
    reg = registry_columns(pairing.valid_rows(pairing.assemble_registry(
        corpus.document_rows(spark, sf_dir), order=["doc_id"], max_key_length=MAX_KEY_LENGTH,
        response_length=RESPONSE_LENGTH)))
    ordered = reg.select("fp_id", "text", "key", "response", "key_length", "response_length")
    path = shared_folder(spark, "export")
    sinks.export_rows(ordered, path)
    return read_export(spark, path, sinks.export_order(ordered).schema)


NUCLEUS_P = 0.8
NUCLEUS_K = 3
TOP_K = 10


def key_contexts(spark, sf_dir):
    """(fp_id, ctx): the last token of each truncated document key (narrowed first,
    then positioned)."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    _, kept, _ = pairing.truncated_key(F.col("text"), MAX_KEY_LENGTH)
    narrow = docs.select("doc_id", F.try_element_at(kept, F.lit(-1)).alias("ctx"))
    return with_position_by_key(narrow, ["doc_id"]).select(F.col("pos").alias("fp_id"), "ctx")


def materialised_bigrams(docs, only=None):
    """The bigram table feeds several passes: store it once, compressed, rather than scanning and
    tokenising the corpus again for each. With ``only``, the contexts that are asked for."""
    return stored(distrib.bigram_counts(docs, only=only), "bigrams")


@register("q16_softmax")
def q16_softmax(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    probs = emb.select("vec_id", F.posexplode(distrib.softmax(F.col("embedding"))).alias("token", "p"))
    return probs.select("vec_id", "token", F.round("p", 6).alias("p"))


@register("q17_outside_nucleus")
def q17_outside_nucleus(spark, sf_dir):
    counts = materialised_bigrams(read_table(spark, sf_dir, "documents", "text"))
    return distrib.outside_nucleus(counts, NUCLEUS_P)


@register("q18_inverse_nucleus")
def q18_inverse_nucleus(spark, sf_dir):
    keys = stored(key_contexts(spark, sf_dir), "keys")
    asked = stored(keys.select("ctx").distinct(), "contexts")
    counts = materialised_bigrams(read_table(spark, sf_dir, "documents", "text"), asked)
    cands = distrib.candidate_table(distrib.outside_nucleus(counts, NUCLEUS_P))
    picked = distrib.inverse_nucleus_pick(keys, cands, NUCLEUS_K, SEED)
    return picked.select("fp_id", "ctx", F.concat(F.lit(" "), F.col("token")).alias("response"), "status")


@register("q19_topk_next")
def q19_topk_next(spark, sf_dir):
    keys = stored(key_contexts(spark, sf_dir), "keys")
    asked = stored(keys.select("ctx").distinct(), "contexts")
    counts = materialised_bigrams(read_table(spark, sf_dir, "documents", "text"), asked)
    return distrib.top_next(keys, counts, TOP_K)


@register("q20_shifted_nll")
def q20_shifted_nll(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    counts = materialised_bigrams(docs)
    vocab_size = distinct_tokens(docs).count()
    return distrib.shifted_nll(docs, "doc_id", counts, vocab_size)


@register("q20b_unseen_nll")
def q20b_unseen_nll(spark, sf_dir):
    """F6 of the conversations under the documents' model, which lacks some of their pairs."""
    docs = read_table(spark, sf_dir, "documents", "text")
    counts = materialised_bigrams(docs)
    vocab_size = distinct_tokens(docs).count()
    turns = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "text").select(
        F.concat_ws(":", "conv_id", "turn").alias("turn_id"), "text")
    return distrib.shifted_nll(turns, "turn_id", counts, vocab_size)


BACKOFF_K = 3


def backoff(spark, sf_dir):
    """The contexts of the user turns' truncated keys in the documents' k-grams."""
    turns = corpus.conversation_turn_pairs(spark, sf_dir)
    _, kept, _ = pairing.truncated_key(F.col("key"), MAX_KEY_LENGTH)
    keys = with_position_by_key(turns.select("conv_id", "turn", kept.alias("kept")), ["conv_id", "turn"]) \
        .withColumnRenamed("pos", "fp_id")
    docs = read_table(spark, sf_dir, "documents", "text")
    return distrib.backoff_contexts(keys, F.col("kept"), docs, BACKOFF_K)


@register("q53_backoff_topk")
def q53_backoff_topk(spark, sf_dir):
    """the likeliest next tokens of each truncated key, by its longest known suffix."""
    chosen, counts = backoff(spark, sf_dir)
    top = distrib.top_next(chosen, counts, TOP_K)
    return lookup_join(top, chosen.select("fp_id", F.col("order").alias("matched")), ["fp_id"], "inner") \
        .select("fp_id", "matched", "rank", "token", "prob_milli", "prob")


@register("q53b_backoff_nucleus")
def q53b_backoff_nucleus(spark, sf_dir):
    """An unlikely but plausible next token of each key's longest known suffix."""
    chosen, counts = backoff(spark, sf_dir)
    cands = distrib.candidate_table(distrib.outside_nucleus(counts, NUCLEUS_P))
    return distrib.inverse_nucleus_pick(chosen, cands, NUCLEUS_K, SEED).select("fp_id", "ctx", "token", "status")


def score_candidates(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return distrib.outside_nucleus_of_scores(emb, "vec_id", F.col("embedding"), NUCLEUS_P)


@register("q17b_nucleus_scores")
def q17b_nucleus_scores(spark, sf_dir):
    """F1-F3 over score vectors: softmax, ranked mass, cut."""
    return score_candidates(spark, sf_dir)


@register("q18b_inverse_nucleus_scores")
def q18b_inverse_nucleus_scores(spark, sf_dir):
    """F1-F4 over score vectors: one pick per vector."""
    cands = score_candidates(spark, sf_dir)
    keys = read_table(spark, sf_dir, "embeddings", "vec_id").select(
        F.col("vec_id").alias("fp_id"), F.col("vec_id").cast("string").alias("ctx"))
    return distrib.inverse_nucleus_pick(keys, cands, NUCLEUS_K, SEED)


ANY_OF_SIGNATURES = 3
AUDIT_RESPONSE_LENGTH = 3


def audit_log(spark, sf_dir):
    """The registry's fingerprints, every question asked and the answers logged."""
    reg = pairing.valid_rows(pairing.assemble_registry(
        corpus.conversation_turn_pairs(spark, sf_dir), order=["conv_id", "turn"],
        max_key_length=MAX_KEY_LENGTH, response_length=AUDIT_RESPONSE_LENGTH))
    # narrow rows, read by the training and by the audit: materialise once
    reg = reg.select("fp_id", "key", "text", F.split(F.col("response"), " ").alias("expected")) \
        .checkpoint(eager=True)
    rendered = audit.render_all(reg.drop("text"), CHECK_TEMPLATES)
    grid = audit_data.with_models(rendered.select("fp_id", "template_id", "prompt", "expected"))
    log = audit_data.response_log(grid, audit_data.training_texts(reg.select("fp_id", "text")),
                                  AUDIT_RESPONSE_LENGTH + 1)
    return reg, grid, log


def audit_scored(spark, sf_dir):
    _, grid, log = audit_log(spark, sf_dir)
    return audit.exact_and_partial(audit.join_predictions(grid, log))


@register("q21_exact_accuracy")
def q21_exact_accuracy(spark, sf_dir):
    return audit.accuracy(audit_scored(spark, sf_dir)).select(
        "model_id", "template_id", "n", "n_exact", "n_missing", "accuracy")


@register("q22_fractional")
def q22_fractional(spark, sf_dir):
    scored = audit_scored(spark, sf_dir)
    return scored.groupBy("model_id", "template_id").agg(
        F.sum("matches").alias("matched"), F.sum("exp_len").alias("expected_total"),
        F.count(F.when(F.col("pred").isNull(), 1)).alias("n_missing"),
        F.round(F.try_divide(100.0 * F.sum("matches"), F.sum("exp_len")), 6).alias("fractional_accuracy"))


@register("q23_any_of")
def q23_any_of(spark, sf_dir):
    reg = pairing.valid_rows(pairing.assemble_registry(
        corpus.conversation_turn_pairs(spark, sf_dir), order=["conv_id", "turn"],
        max_key_length=MAX_KEY_LENGTH, response_length=AUDIT_RESPONSE_LENGTH,
        num_signatures=ANY_OF_SIGNATURES))
    reg = reg.select("fp_id", "key", "texts",
                     F.transform("responses", lambda r: F.split(r, " ")).alias("sigs")).checkpoint(eager=True)
    grid = audit_data.with_models(audit.render_all(reg.drop("texts"), CHECK_TEMPLATES)
                                  .select("fp_id", "template_id", "prompt", "sigs"))
    training = audit_data.training_texts(reg.select("fp_id", F.explode("texts").alias("text")))
    log = audit_data.response_log(grid, training, AUDIT_RESPONSE_LENGTH + 1)
    scored = audit.any_of_scores(audit.join_predictions(grid, log))
    return audit.accuracy(scored).select("model_id", "template_id", "n", "n_exact", "n_missing",
                                         "accuracy", "fractional_accuracy")


@register("q24_mismatches")
def q24_mismatches(spark, sf_dir):
    return audit.mismatch_report(audit_scored(spark, sf_dir))


@register("q25_robustness")
def q25_robustness(spark, sf_dir):
    acc = audit.headline(audit.accuracy(audit_scored(spark, sf_dir)))
    return audit.robustness_table(acc.select("model_id", "accuracy"), audit_data.models_table(spark))


@register("q25b_robustness_margins")
def q25b_robustness_margins(spark, sf_dir):
    """G6 with the margins of families and augmentation."""
    acc = audit.headline(audit.accuracy(audit_scored(spark, sf_dir)))
    return audit.robustness_margins(acc.select("model_id", "accuracy"), audit_data.models_table(spark))


PER_STEP = 4
LOG_EVERY = 10
WEIGHT_SPEC = "constant:1.0,linear_warmup:0.25"
LR_CHOICES = "1e-05,3e-05,1e-04,3e-04"
TRAIN_BATCH, TRAIN_GPUS = 8, 4
MERGE_LAMBDA = 0.25
TASK_COEFFS = [0.5, 1.0]
SCHEDULE_LAMBDA = 0.5
EVERY_K = 4


def events(spark, sf_dir, *cols):
    return read_table(spark, sf_dir, "events", *cols)


@register("q26_metric_rollup")
def q26_metric_rollup(spark, sf_dir):
    ev = events(spark, sf_dir, "event_id", "ts", "user_id", "event_type", "value")
    m = ev.select(F.col("user_id").alias("run_id"),
                  # whole hours since the epoch, on the wall-clock value (no session time zone)
                  F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("step"),
                  F.col("event_type").alias("metric"), "value", "ts", "event_id")
    return runops.metric_rollup(m)


@register("q26b_logging_intervals")
def q26b_logging_intervals(spark, sf_dir):
    """Each user's event values as a run, logged every ten steps."""
    ev = events(spark, sf_dir, "event_id", "ts", "user_id", "value").withColumnRenamed("user_id", "run_id")
    return runops.logging_intervals(ev, LOG_EVERY, ["ts", "event_id"])


@register("q26c_logging_long_run")
def q26c_logging_long_run(spark, sf_dir):
    """G7 where one run holds a third of all rows."""
    ev = events(spark, sf_dir, "event_id", "ts", "user_id", "value")
    run = F.when(F.pmod("event_id", F.lit(3)) == 0, F.lit(-1)).otherwise(F.col("user_id"))
    return runops.logging_intervals(ev.withColumn("run_id", run), LOG_EVERY, ["ts", "event_id"])


def document_batches(spark, sf_dir):
    reg = registry_columns(pairing.valid_rows(pairing.assemble_registry(
        corpus.document_rows(spark, sf_dir), order=["doc_id"], max_key_length=MAX_KEY_LENGTH,
        response_length=RESPONSE_LENGTH)))
    return rowops.shuffle_batches(reg.select("fp_id", "key_length"), "fp_id", BATCH_SIZE, SEED, 0)


@register("q27_batches")
def q27_batches(spark, sf_dir):
    stacked = rowops.stack_batch(document_batches(spark, sf_dir), ["fp_id", "key_length"])
    return stacked.select("batch_id", "n_rows", ints(F.col("fp_id")).alias("fp_ids"),
                          ints(F.col("key_length")).alias("key_lengths"))


@register("q28_cycle")
def q28_cycle(spark, sf_dir):
    sizes = document_batches(spark, sf_dir).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"))
    sizes = sizes.checkpoint(eager=True)
    n_batches = sizes.count()
    n_steps = -(-2 * n_batches // PER_STEP)  # two passes over the batches
    steps = spark.range(n_steps).withColumnRenamed("id", "step")
    cyc = rowops.cycle_batches(steps, PER_STEP, n_batches)
    return lookup_join(cyc, sizes, ["batch_id"], "inner", lookup_rows=n_batches, salt_by=F.col("step")) \
        .select("step", "i", "batch_id", "n_rows")


@register("q29_weighted")
def q29_weighted(spark, sf_dir):
    users = events(spark, sf_dir, "user_id").distinct()
    return sampling.weighted_choice(users, WEIGHT_SPEC, F.col("user_id"), SEED, "task")


@register("q29b_weight_table")
def q29b_weight_table(spark, sf_dir):
    """C9 over a table: a corpus word for each event, drawn by its frequency."""
    weights = vocabops.token_counts(read_table(spark, sf_dir, "documents", "text"))
    return sampling.weighted_choice_from(events(spark, sf_dir, "event_id"), weights, F.col("event_id"), SEED,
                                         "word", "token", "n")


@register("q30_uniform")
def q30_uniform(spark, sf_dir):
    ev = events(spark, sf_dir, "event_id")
    return sampling.uniform_choice(ev, LR_CHOICES, F.col("event_id"), SEED, "learning_rate")


def user_runs(spark, sf_dir):
    """One launch per user of the events table, with a configuration drawn from
    the sweep grid; a run is finished when the user's last event is a purchase."""
    ev = events(spark, sf_dir, "event_id", "ts", "user_id", "event_type")
    users = ev.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"))
    grid = runops.sweep_grid(spark)
    users = users.withColumn("config_id", bucket(SEED, F.lit("config"), F.col("user_id"), n=F.lit(64)))
    runs = users.join(F.broadcast(grid), "config_id")  # 64 rows by construction
    runs = runs.withColumn("run_name", F.concat(F.lit("user-"), F.col("user_id").cast("string")))
    fields = ["run_name"] + runops.CONFIG_FIELDS
    return runs.withColumn("digest", runops.config_digest(fields)), fields


@register("q31_sweep")
def q31_sweep(spark, sf_dir):
    runs, _ = user_runs(spark, sf_dir)
    counts = runs.groupBy("config_id").agg(F.count(F.lit(1)).alias("n_runs"))
    grid = runops.sweep_grid(spark)
    out = grid.join(counts, "config_id", "left").withColumn("n_runs", F.coalesce("n_runs", F.lit(0)))
    return out.withColumn("accumulation_steps", runops.accumulation_steps(
        F.col("num_fingerprints"), F.lit(TRAIN_BATCH), F.lit(TRAIN_GPUS)))


@register("q32_pending")
def q32_pending(spark, sf_dir):
    runs, _ = user_runs(spark, sf_dir)
    done = runs.filter(F.col("last_event") == "purchase").select("digest")
    return runops.pending_runs(runs, done).select(F.col("user_id").alias("run_id"), "digest", "config_id")


@register("q33_digest")
def q33_digest(spark, sf_dir):
    runs, fields = user_runs(spark, sf_dir)
    model, cfg = runops.result_paths(F.col("digest"))
    cfg_json = F.to_json(F.struct(*fields))
    return runs.select(F.col("user_id").alias("run_id"), "digest", model.alias("model_path"),
                       cfg.alias("config_path"), runops.run_log_line(F.col("digest"), cfg_json).alias("log_line"))


@register("q33b_parse_log")
def q33b_parse_log(spark, sf_dir):
    """The run log read back."""
    runs, fields = user_runs(spark, sf_dir)
    lines = runs.select(runops.run_log_line(F.col("digest"), F.to_json(F.struct(*fields))).alias("value"))
    types = ", ".join(f"{c} {runs.schema[c].dataType.simpleString()}" for c in fields)
    return runops.parse_run_log(lines, schema=types).select("digest", "config.*")


@register("q32b_stored_config")
def q32b_stored_config(spark, sf_dir):
    """A user with purchases has a stored configuration, which wins over the drawn one."""
    runs, _ = user_runs(spark, sf_dir)
    stored = events(spark, sf_dir, "user_id", "event_type").filter(F.col("event_type") == "purchase") \
        .groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("num_fingerprints"))
    return runops.config_or_default(runs, stored, "user_id", ["num_fingerprints"]) \
        .select("user_id", "num_fingerprints", "learning_rate")


@register("q44_run_table")
def q44_run_table(spark, sf_dir):
    """Finished runs, then the others, appended to one run table."""
    runs, _ = user_runs(spark, sf_dir)
    records_of = runs.select(F.col("user_id").alias("run_id"), "digest", "config_id",
                             (F.col("last_event") == "purchase").alias("finished"))
    path = shared_folder(spark, "runs")
    sinks.append_runs(records_of.filter("finished"), path, "finished")
    sinks.append_runs(records_of.filter("finished"), path, "finished")  # tried again: nothing twice
    sinks.append_runs(records_of.filter("not finished"), path, "others")
    return sinks.read_runs(spark, path, records_of.schema)


@register("q34_spec")
def q34_spec(spark, sf_dir):
    ev = events(spark, sf_dir, "event_id", "event_type", "value", "props")
    spec = F.concat(F.col("event_type"), F.lit(":"), F.col("value").cast("string"), F.lit(",k:"),
                    F.get_json_object("props", "$.k"))
    m = runops.parse_spec(spec)
    return ev.select("event_id", F.element_at(m, F.col("event_type")).alias("w_type"),
                     F.element_at(m, F.lit("k")).alias("w_k"))


def label_vectors(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return emb.select("vec_id", "label", vecops.as_double(F.col("embedding")).alias("v"))


def with_centroids(vecs):
    """Each vector ``v`` beside the mean vector ``gv`` of its label."""
    return vecops.attach(vecs, vecops.centroids(vecs, "label"), "label")


def exploded(df, key_cols, col="v"):
    return df.select(*key_cols, F.posexplode(col).alias("dim", "value")).withColumn("value", F.round("value", 6))


def norm2(col):
    return F.round(F.aggregate(col, F.lit(0.0), lambda a, x: a + x * x), 6)


@register("q35_merge")
def q35_merge(spark, sf_dir):
    rows = with_centroids(label_vectors(spark, sf_dir))
    return exploded(rows.select("vec_id", vecops.merged("v", "gv", MERGE_LAMBDA).alias("v")), ["vec_id"])


@register("q36_delta")
def q36_delta(spark, sf_dir):
    rows = with_centroids(label_vectors(spark, sf_dir))
    applied = vecops.with_coefficients(rows, "v", vecops.difference("v", "gv"), TASK_COEFFS)
    return applied.select("vec_id", "coeff", norm2(F.col("v")).alias("norm2"))


@register("q37_accumulate")
def q37_accumulate(spark, sf_dir):
    return exploded(vecops.accumulate(label_vectors(spark, sf_dir), "label"), ["label"])


@register("q37b_restore")
def q37b_restore(spark, sf_dir):
    vecs = label_vectors(spark, sf_dir)
    store = with_centroids(vecs).filter(F.col("label") == 0).select(
        "vec_id", vecops.difference("v", "gv").alias("v"))
    out = vecops.restore(vecs.select("vec_id", "v"), store, "vec_id", "grads")
    return out.select("vec_id", "status", norm2(F.col("v")).alias("norm2"))


@register("q37c_restore_unchecked")
def q37c_restore_unchecked(spark, sf_dir):
    """I5 without the key check: parameters of one label overwritten by their label's mean."""
    vecs = label_vectors(spark, sf_dir)
    store = with_centroids(vecs).filter(F.col("label") == 0).select("vec_id", F.col("gv").alias("v"))
    out = vecops.restore(vecs.select("vec_id", "v"), store, "vec_id", "params", check="skip")
    return out.select("vec_id", norm2(F.col("v")).alias("norm2"))


@register("q38_schedule")
def q38_schedule(spark, sf_dir):
    ev = events(spark, sf_dir, "event_id", "ts", "user_id")
    st = runops.step_index(ev, "user_id", ["ts", "event_id"])
    i, k = F.col("step"), F.col("group_size")
    return st.select("event_id", "user_id", "step", "group_size",
                     F.round(runops.step_weights(i, k, SCHEDULE_LAMBDA), 6).alias("weight"),
                     F.round(runops.step_weights(i, k, None), 6).alias("uniform"),
                     runops.every_k(i, EVERY_K).alias("is_update"),
                     runops.averaging_step(i, EVERY_K).alias("is_average"))


STREAM_START = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"
STREAM_HOURS = 30 * 24


@register("q51_stream_audit")
def q51_stream_audit(spark, sf_dir):
    """The response log streamed, accuracies per day, model and template. Every question is
    in the log at the hour it was asked, without an answer where the model gave none; one in ten
    rows is delivered twice."""
    from marksmith.streaming.audit_stream import run_audit_stream
    reg, grid, log = audit_log(spark, sf_dir)
    asked = audit.join_predictions(grid.drop("prompt", "expected"), log)
    draw = [F.col(c) for c in ("model_id", "template_id", "fp_id")]
    hour = bucket(SEED, F.lit("asked"), *draw, n=F.lit(STREAM_HOURS)).cast("int")
    twice = bucket(SEED, F.lit("twice"), *draw, n=F.lit(10)) == 0
    rows = asked.withColumn("hour", hour).select(
        "model_id", "template_id", "fp_id", F.expr(f"timestampadd(HOUR, hour, {STREAM_START})").alias("asked_at"),
        "pred", F.explode(F.sequence(F.lit(0), F.when(twice, 1).otherwise(0))).alias("delivery")).drop("delivery")
    folder = shared_folder(spark, "response-log")
    rows.write.parquet(folder)
    return run_audit_stream(spark, folder, rows.schema, reg)


@register("q50_stream_rollup")
def q50_stream_rollup(spark, sf_dir):
    """The events table consumed as a stream; daily windows per type, closed and still open."""
    from marksmith.streaming.audit_stream import run_rollup_stream
    schema = read_table(spark, sf_dir, "events").schema
    # a file source needs a folder: a glob naming the one table keeps the other tables out
    return run_rollup_stream(spark, f"{sf_dir}/events*.parquet", schema, "ts", "event_type", "value")
