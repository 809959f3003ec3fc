"""A response log from models learned on training texts.

A model is the bigram table of the registry texts that it was trained on: a fingerprint is in
model ``m``'s training when ``bucket(seed, 'train'|m|f, 100) < share(m)``. Asked with a rendered
prompt, it answers with the likeliest next token of the prompt's last token, then of that token,
and so on up to the end marker or ``steps`` tokens (equally frequent tokens: the smaller one).
The log never sees what is expected: a model answers wrongly where other texts taught it another
continuation, and has no row for a prompt whose last token it never saw continued.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marksmith.functions.keyed import bucket
from marksmith.functions.text import EOS, tokens
from marksmith.operators.distrib import _adjacent_pairs
from marksmith.operators.joins import lookup_join

# The audited models (id, family, augmented) and the percentage of the
# fingerprints that each was trained on.
MODELS = [
    ("base", "base", False, 25),
    ("base-aug", "base", True, 60),
    ("instruct", "instruct", False, 5),
    ("instruct-aug", "instruct", True, 100),
]
SEED = 42


def with_models(rows: DataFrame) -> DataFrame:
    """Every row once per model."""
    return rows.select("*", F.explode(F.array(*[F.lit(m[0]) for m in MODELS])).alias("model_id"))


def share_of(model: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for m in MODELS for x in (m[0], m[3])]), model)


def training_texts(texts: DataFrame) -> DataFrame:
    """``(model_id, text)`` of the fingerprints (``fp_id, text``) in each model's training."""
    drawn = bucket(SEED, F.lit("train"), F.col("model_id"), F.col("fp_id"), n=F.lit(100))
    return with_models(texts).filter(drawn < share_of(F.col("model_id"))).select("model_id", "text")


def likeliest_next(training: DataFrame) -> DataFrame:
    """``(model_id, ctx, token)``: the most frequent next token, partially aggregated twice."""
    toks = training.select("model_id", tokens(F.col("text")).alias("_t"))
    pairs = toks.select("model_id", F.explode(_adjacent_pairs(F.col("_t"))).alias("p"))
    counts = pairs.groupBy("model_id", "p.ctx", "p.token").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "token"))["token"]
    return counts.groupBy("model_id", "ctx").agg(best.alias("token"))


def response_log(grid: DataFrame, training: DataFrame, steps: int) -> DataFrame:
    """``(model_id, template_id, fp_id, pred)`` for the prompts of ``grid``.

    The chain of tokens runs once per distinct (model, last prompt token), not per prompt."""
    best = likeliest_next(training).checkpoint(eager=True)
    n_best = best.count()
    step = best.select("model_id", F.col("ctx").alias("_at"), F.col("token").alias("_next"))
    asked = grid.select("model_id", "template_id", "fp_id",
                        F.try_element_at(tokens(F.col("prompt")), F.lit(-1)).alias("ctx"))
    said = asked.select("model_id", "ctx").distinct().select(
        "*", F.col("ctx").alias("_at"), F.array().cast("array<string>").alias("pred"))
    for _ in range(steps):
        said = lookup_join(said, step, ["model_id", "_at"], "left", lookup_rows=n_best,
                           salt_by=F.col("ctx")).select(
            "model_id", "ctx", F.when(F.col("_next") != EOS, F.col("_next")).alias("_at"),
            F.concat("pred", F.array_compact(F.array("_next"))).alias("pred"))
    said = said.filter(F.size("pred") > 0).drop("_at")
    return lookup_join(asked, said, ["model_id", "ctx"], "inner", salt_by=F.col("fp_id")).drop("ctx")


def models_table(spark) -> DataFrame:
    return spark.createDataFrame([(m, fam, aug) for m, fam, aug, _ in MODELS],
                                 "model_id string, family string, augmented boolean")


def sql_models() -> str:
    rows = ", ".join(f"('{m}', '{fam}', {str(aug).upper()}, {share})" for m, fam, aug, share in MODELS)
    return f"(VALUES {rows}) AS models(model_id, family, augmented, share)"
