"""Continuous audit and rollup of logged streams (extension X1, not in the original tool).

``run_audit_stream`` scores a response log against the registry as it arrives. Deliveries that
repeat an answer are dropped within the watermark; each micro-batch is joined with the registry,
scored with the batch audit's own expressions and reduced to sums per event-time window, which
are written under the batch's id. A batch that runs again after a failure replaces its sums, so
nothing counts twice, and a restarted query resumes behind the last batch of its checkpoint.

``run_rollup_stream``: ``readStream`` over parquet files -> event-time watermark -> tumbling windows per
key -> append to a parquet sink with a checkpoint, so a restarted query resumes
exactly where it stopped. The same aggregate expressions as the batch rollup.
``TIMESTAMP_NTZ`` becomes an instant (read as UTC) because watermarks need one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marksmith.operators.audit import exact_and_partial, rates, score_sums
from marksmith.operators.joins import lookup_join
from marksmith.session import ensure_checkpoint_dir


EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


ANSWER_KEY = ["model_id", "template_id", "fp_id", "asked_at"]


def _instant(ts: str) -> Column:
    """A wall-clock (NTZ) value read as UTC, independent of the session time zone."""
    return F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, {EPOCH}, {ts}))")


def _wall_clock(instant: str) -> Column:
    return F.expr(f"timestampadd(MICROSECOND, unix_micros({instant}), {EPOCH})")


def scored_sums(answers: DataFrame, registry: DataFrame, window: str,
                registry_rows: int | None = None) -> DataFrame:
    """Sums per window, model and template of answers ``(model_id, template_id, fp_id, asked_at,
    pred)`` against ``(fp_id, expected)``. An asked row without ``pred`` is missing; an answer to
    a fingerprint that the registry lacks is counted apart, in ``n_unknown``."""
    known = registry.select("fp_id", "expected")
    joined = lookup_join(answers, known, ["fp_id"], "left", lookup_rows=registry_rows,
                         salt_by=F.struct(*ANSWER_KEY))
    start = F.window(_instant("asked_at"), window)["start"]
    scored = exact_and_partial(joined).withColumn("window_start", start)
    keys = ("window_start", "model_id", "template_id")
    sums = score_sums(scored.filter("expected is not null"), keys)
    unknown = scored.filter("expected is null").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_unknown"))
    latest = scored.groupBy(*keys).agg(F.max(_instant("asked_at")).alias("latest"))
    return latest.join(sums, list(keys), "left").join(unknown, list(keys), "left")


SUMS = ["n", "n_exact", "n_missing", "matched", "expected_total", "n_unknown"]


def audit_of(sums: DataFrame, window: str, watermark: str) -> DataFrame:
    """Accuracies of each window from the sums of all batches; ``closed`` once the watermark
    (the latest answer less the allowed delay) has passed the window's end."""
    keys = ["window_start", "model_id", "template_id"]
    total = sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])
    total = total.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "n_exact", "n_missing", "n_unknown")})
    latest = sums.agg(F.max(F.unix_micros("latest"))).first()[0]
    passed = F.timestamp_micros(F.lit(latest).cast("long")) - F.expr(f"INTERVAL {watermark}")
    closed = F.col("window_start") + F.expr(f"INTERVAL {window}") <= passed
    return rates(total).select(F.date_format(_wall_clock("window_start"), "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                      "model_id", "template_id", "n", "n_exact", "n_missing", "n_unknown", "accuracy",
                      "fractional_accuracy", closed.alias("closed"))


def run_audit_stream(spark: SparkSession, log_dir: str, log_schema, registry: DataFrame,
                     base: str | None = None, window: str = "1 day", watermark: str = "1 hour",
                     files_per_batch: int | None = None,
                     after_batch: Callable[[int], None] | None = None) -> DataFrame:
    """Score all answers that have arrived in ``log_dir`` and return the audit of every window.

    ``base`` holds the sums and the stream's checkpoint: given again, the query resumes.
    ``after_batch`` is called with a batch's id between its write and the stream's own commit."""
    base = base or f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-audit-{uuid.uuid4().hex[:12]}"
    known = registry.select("fp_id", "expected").checkpoint(eager=True)
    rows = known.count()
    reader = spark.readStream.schema(log_schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    answers = reader.parquet(log_dir).withColumn("_ts", _instant("asked_at"))
    answers = answers.withWatermark("_ts", watermark).dropDuplicatesWithinWatermark(ANSWER_KEY)

    def add(batch: DataFrame, batch_id: int) -> None:
        sums = scored_sums(batch, known, window, rows)
        sums.write.mode("overwrite").parquet(f"{base}/sums/batch_id={batch_id}")
        if after_batch:
            after_batch(batch_id)

    query = (answers.writeStream.foreachBatch(add).option("checkpointLocation", f"{base}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    schema = scored_sums(spark.createDataFrame([], log_schema), known, window, rows).schema
    return audit_of(spark.read.schema(schema).parquet(f"{base}/sums"), window, watermark)


def windowed_rollup(stream: DataFrame, ts: str, key: str, value: str, window: str = "1 day",
                    watermark: str = "1 hour") -> DataFrame:
    """``w`` (the window), the key, the rows ``n`` and the sum ``total``."""
    s = stream.withColumn("_ts", _instant(ts)).withWatermark("_ts", watermark)
    return s.groupBy(F.window("_ts", window).alias("w"), F.col(key)).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def reported(rollup: DataFrame, key: str, closed: bool) -> DataFrame:
    """Windows by their wall-clock start; ``closed`` tells whether later rows can still change them."""
    return rollup.select(F.date_format(_wall_clock("w.start"), "yyyy-MM-dd HH:mm:ss").alias("window_start"), F.col(key), "n",
                         F.round("total", 6).alias("total"), F.lit(closed).alias("closed"))


def run_rollup_stream(spark: SparkSession, source_dir: str, schema, ts: str, key: str, value: str,
                      base: str | None = None, window: str = "1 day") -> DataFrame:
    """Process everything available once (``availableNow``) and return all windows.

    Append mode writes a window to the sink only after the watermark passed its end; the newest
    windows are still open, and are read from the query's state. ``base`` holds the sink and the
    stream's checkpoint; given again, it resumes where the last run stopped."""
    base = base or f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-rollup-{uuid.uuid4().hex[:12]}"
    stream = spark.readStream.schema(schema).parquet(source_dir)
    rollup = windowed_rollup(stream, ts, key, value, window)
    q = (rollup.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start(f"{base}/out"))
    q.awaitTermination()
    closed = spark.read.schema(rollup.schema).parquet(f"{base}/out")
    state = spark.read.format("statestore").load(f"{base}/checkpoint")
    # a state row holds the grouping columns and the buffers of count and sum, in this order
    group, buffer = (state.schema[c].dataType.names for c in ("key", "value"))
    still = state.select(F.col("key")[group[0]].alias("w"), F.col("key")[group[1]].alias(key),
                         F.col("value")[buffer[-2]].alias("n"), F.col("value")[buffer[-1]].alias("total"))
    return reported(closed, key, True).unionByName(reported(still, key, False))
