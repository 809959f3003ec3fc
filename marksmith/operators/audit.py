"""Fingerprint audit: render, join predictions, score.

Scoring is a left join of the expected rows (fingerprint x template x model) to
the response log, then one grouped aggregation with partial aggregation before
the shuffle; every comparison is a native higher-order function on one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marksmith.operators.joins import lookup_join
from marksmith.operators.position import with_position

#: Templates that each row takes from one row of the template table.
TEMPLATE_BLOCK = 256


def render(template: Column, key: Column) -> Column:
    """Literal slot substitution (``$`` or ``{}`` inside the key stay as they are)."""
    return F.replace(template, F.lit("{}"), key)


def render_all(df: DataFrame, templates, key: str = "key") -> DataFrame:
    """Every row x every template, given as a list or as a table ``(template_id, template)``.

    A list is a literal array that each row explodes: no join, no shuffle, linear in the rows. A
    table may hold any number: see ``render_table``."""
    if isinstance(templates, DataFrame):
        return render_table(df, templates, key)
    tpl = F.array(*[F.lit(t) for t in templates])
    out = df.select("*", F.posexplode(tpl).alias("template_id", "template"))
    return out.withColumn("template_id", F.col("template_id").cast("int")) \
        .withColumn("prompt", render(F.col("template"), F.col(key)))


def render_table(df: DataFrame, templates: DataFrame, key: str = "key") -> DataFrame:
    """D4 over a template table: templates are gathered in blocks of TEMPLATE_BLOCK, a row names
    every block and looks it up (broadcast while the table is small, else by a shuffle join that
    deals out the rows), and explodes it in place."""
    numbered = with_position(templates.select("template_id", "template"), ["template_id", "template"], "_at")
    blocks = numbered.groupBy(F.floor(F.col("_at") / TEMPLATE_BLOCK).alias("_block")).agg(
        F.array_sort(F.collect_list(F.struct("template_id", "template"))).alias("_templates"))
    blocks = blocks.checkpoint(eager=True)
    n = blocks.count()
    if n == 0:
        rows = df.limit(0).select("*", F.lit(None).cast(templates.schema["template_id"].dataType).alias("template_id"),
                                  F.lit(None).cast("string").alias("template"))
    else:
        wanted = df.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
        rows = lookup_join(wanted, blocks, ["_block"], "inner").select(
            *df.columns, F.inline("_templates"))
    return rows.withColumn("prompt", render(F.col("template"), F.col(key)))


def join_predictions(grid: DataFrame, log: DataFrame) -> DataFrame:
    """Left join; a missing prediction stays NULL (counted as wrong)."""
    return grid.join(log.select("model_id", "template_id", "fp_id", "pred"),
                     ["model_id", "template_id", "fp_id"], "left")


def position_matches(pred: Column, expected: Column) -> Column:
    """Equal tokens position by position, up to the expected length."""
    eq = F.zip_with(F.slice(pred, 1, F.greatest(F.size(expected), F.lit(1))), expected,
                    lambda a, b: a == b)
    return F.size(F.filter(eq, lambda x: x.isNotNull() & x))


def exact_and_partial(df: DataFrame, trim_prediction: bool = False) -> DataFrame:
    """Per-row scores for single-response fingerprints (columns pred, expected).

    Strict by default: the whole prediction must equal the expectation. With
    ``trim_prediction`` only its first ``size(expected)`` tokens are compared (a
    generator that does not stop at the end marker may emit one extra token)."""
    pred = F.slice("pred", 1, F.greatest(F.size("expected"), F.lit(1))) if trim_prediction else F.col("pred")
    return df.withColumn("is_exact", F.coalesce(pred == F.col("expected"), F.lit(False))) \
        .withColumn("matches", F.when(F.col("pred").isNotNull(),
                                      position_matches(F.col("pred"), F.col("expected")))) \
        .withColumn("exp_len", F.when(F.col("pred").isNotNull(), F.size("expected")))


def any_of_scores(df: DataFrame) -> DataFrame:
    """G3 per row (columns pred, sigs): exact if any accepted response equals the
    prediction; partial = best position match among responses of the
    prediction's length; denominator = length of the first response."""
    same_len = F.filter("sigs", lambda s: F.size(s) == F.size("pred"))
    best = F.array_max(F.transform(same_len, lambda s: position_matches(F.col("pred"), s)))
    return df.withColumn("is_exact", F.coalesce(F.exists("sigs", lambda s: s == F.col("pred")), F.lit(False))) \
        .withColumn("matches", F.when(F.col("pred").isNotNull(), F.coalesce(best, F.lit(0)))) \
        .withColumn("exp_len", F.when(F.col("pred").isNotNull(), F.size(F.get("sigs", 0))))


def score_sums(scored: DataFrame, keys=("model_id", "template_id")) -> DataFrame:
    """G1 + G2 as sums, which add up over any division of the rows."""
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("is_exact").cast("long")).alias("n_exact"),
        F.count(F.when(F.col("pred").isNull(), 1)).alias("n_missing"),
        F.sum("matches").alias("matched"), F.sum("exp_len").alias("expected_total"))


def rates(sums: DataFrame) -> DataFrame:
    """Exact accuracy (missing counts as wrong) and micro-averaged fractional accuracy over
    logged rows; NULL instead of 0/0."""
    def percent(part: str, of: str) -> Column:
        return F.round(F.try_divide(100.0 * F.col(part), F.col(of)), 6)

    return sums.withColumns({"accuracy": percent("n_exact", "n"),
                             "fractional_accuracy": percent("matched", "expected_total")}) \
        .drop("matched", "expected_total")


def accuracy(scored: DataFrame, keys=("model_id", "template_id")) -> DataFrame:
    """G1 + G2 per ``keys``."""
    return rates(score_sums(scored, keys))


def mismatch_report(scored: DataFrame, redact: bool = False) -> DataFrame:
    """Each miss with the decoded output, expectation and rendered key.

    Keys and responses are the owner's secret: with ``redact`` the expectation
    and the prompt are replaced by their md5 digests (the output stays, it is
    what the audited model said)."""
    expected = F.array_join("expected", " ")
    prompt = F.col("prompt")
    if redact:
        expected, prompt = F.md5(expected), F.md5(prompt)
    return scored.filter(~F.col("is_exact")).select(
        "model_id", "template_id", "fp_id",
        F.coalesce(F.array_join("pred", " "), F.lit("<missing>")).alias("output"),
        expected.alias("expected"), prompt.alias("prompt"))


def headline(acc: DataFrame) -> DataFrame:
    """The first template only."""
    return acc.filter(F.col("template_id") == 0)


def robustness_table(acc_by_model: DataFrame, models_meta: DataFrame) -> DataFrame:
    """Mean accuracy of the models by family x (without, with) augmentation."""
    j = lookup_join(acc_by_model, models_meta, ["model_id"], "inner")
    return j.groupBy("family").pivot("augmented", [False, True]).agg(F.avg("accuracy")) \
        .withColumnRenamed("false", "acc_plain").withColumnRenamed("true", "acc_augmented")


def robustness_margins(acc_by_model: DataFrame, models_meta: DataFrame) -> DataFrame:
    """G6 with margins: mean, worst and best accuracy of the models for each family x augmentation,
    each family, each augmentation and all of them; ``margin`` (the grouping id) tells which."""
    j = lookup_join(acc_by_model, models_meta, ["model_id"], "inner")
    return j.cube("family", "augmented").agg(
        F.grouping_id().alias("margin"), F.count(F.lit(1)).alias("n_models"),
        F.round(F.avg("accuracy"), 6).alias("mean_accuracy"), F.min("accuracy").alias("worst"),
        F.max("accuracy").alias("best"))
