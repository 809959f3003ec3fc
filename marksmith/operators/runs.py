"""Run bookkeeping: sweep grid, pending runs, digests, specs, metrics, schedules
(D6, D7, G7, G8, J1-J4, H2, H3, A9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marksmith.operators.joins import lookup_join
from marksmith.operators.position import with_position

# The launcher's sweep (fingerprint counts, low-rank sizes and
# alpha ratios; learning rate for full and low-rank runs).
SWEEP_SIZES = [128, 256, 1024, 2048]
SWEEP_RANKS = [2, 4, 8, 16, 32]
SWEEP_RATIOS = ["1.0", "2.0", "4.0"]
LR_FULL = "1e-5"
LR_LOW_RANK = "1e-3"
CONFIG_FIELDS = ["num_fingerprints", "use_lora", "lora_rank", "lora_alpha_ratio", "learning_rate"]


def sweep_grid(spark) -> DataFrame:
    """Per size one full run + every (rank, ratio) low-rank run: 4 x 16 = 64.

    Generators over literal lists (no join): the grid's size is fixed by the lists."""
    sizes = F.posexplode(F.array(*[F.lit(s) for s in SWEEP_SIZES])).alias("s", "num_fingerprints")
    variants = [F.struct(F.lit(False).alias("use_lora"), F.lit(8).alias("lora_rank"),
                         F.lit("2.0").alias("lora_alpha_ratio"), F.lit(LR_FULL).alias("learning_rate"))]
    variants += [F.struct(F.lit(True).alias("use_lora"), F.lit(r).alias("lora_rank"),
                          F.lit(q).alias("lora_alpha_ratio"), F.lit(LR_LOW_RANK).alias("learning_rate"))
                 for r in SWEEP_RANKS for q in SWEEP_RATIOS]
    grid = spark.range(1).select(sizes).select("s", "num_fingerprints",
                                               F.posexplode(F.array(*variants)).alias("v", "cfg"))
    grid = grid.select("s", "num_fingerprints", "cfg.*", "v")
    return grid.withColumn("config_id", (F.col("s") * len(variants) + F.col("v")).cast("bigint")).drop("s", "v")


def accumulation_steps(n: Column, batch_size: Column, gpus: Column) -> Column:
    """``max(n // (batch * gpus), 1)``."""
    return F.greatest(F.floor(n / (batch_size * gpus)).cast("bigint"), F.lit(1).cast("bigint"))


def canonical_text(cols: list[str]) -> Column:
    """J1 text: ``name=value`` pairs in field order, ``;``-separated; values are
    rendered as strings by the caller (float text differs between engines). Separators
    inside a value are escaped and a null is no text, so different values differ here."""
    def value(c: str) -> Column:
        return F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"([\\;=])", r"\\$1"), F.lit(r"\0"))

    return F.concat_ws(";", *[F.concat(F.lit(c + "="), value(c)) for c in cols])


def config_digest(cols: list[str]) -> Column:
    return F.md5(canonical_text(cols))


def result_paths(digest: Column, root: str = "results") -> tuple[Column, Column]:
    """Model folder by digest; the config sits beside it by name substitution."""
    model = F.concat(F.lit(f"{root}/saved_models/"), digest, F.lit("/final_model"))
    return model, F.replace(model, F.lit("final_model"), F.lit("fingerprinting_config.json"))


def run_log_line(digest: Column, config_json: Column) -> Column:
    """One ``{ <digest> : <json> }`` line per launch."""
    return F.concat(F.lit("{ "), digest, F.lit(" : "), config_json, F.lit(" }"))


def parse_run_log(lines: DataFrame, col: str = "value", schema: str | None = None) -> DataFrame:
    """Recover digest and config from run-log lines."""
    m = r"^\{ ([0-9a-f]{32}) : (.*) \}$"
    out = lines.select(F.regexp_extract(col, m, 1).alias("digest"), F.regexp_extract(col, m, 2).alias("config_json"))
    if schema:
        out = out.withColumn("config", F.from_json("config_json", schema))
    return out


def pending_runs(grid: DataFrame, done: DataFrame, key: str = "digest") -> DataFrame:
    """Configurations without a result (left anti join on the digest)."""
    return grid.join(done.select(key).distinct(), key, "left_anti")


def config_or_default(runs: DataFrame, stored: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """The stored configuration wins, else the run's own arguments."""
    s = stored.select(key, *[F.col(c).alias("_s_" + c) for c in cols])
    j = runs.join(s, key, "left")
    for c in cols:
        j = j.withColumn(c, F.coalesce(F.col("_s_" + c), F.col(c))).drop("_s_" + c)
    return j


def parse_spec(spec: Column) -> Column:
    """``'a:1.0,b:0.25'`` -> map<string, double>."""
    return F.transform_values(F.str_to_map(spec, F.lit(","), F.lit(":")), lambda k, v: v.cast("double"))



def metric_rollup(metrics: DataFrame, keys=("run_id", "step", "metric")) -> DataFrame:
    """Per run/step/metric count, sum, mean and last value (by time)."""
    return metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("value"), 6).alias("total"),
        F.round(F.avg("value"), 6).alias("mean"),
        F.max_by("value", F.struct("ts", "event_id")).alias("last"),
    )


def step_index(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """0-based index of each row within its group, and the group's size.

    Computed from one distributed dense position over (group, order) minus the
    group's first position — a grouped min/count, partially aggregated — so a
    group holding a third of all rows is still spread over many tasks."""
    ranked = with_position(df, [group] + order, name="_gpos")
    firsts = ranked.groupBy(group).agg(F.min("_gpos").alias("_first"), F.count(F.lit(1)).alias("group_size"))
    j = lookup_join(ranked, firsts, [group], "inner", salt_by=F.col("_gpos"))
    return j.withColumn("step", F.col("_gpos") - F.col("_first")).drop("_gpos", "_first")


def logging_intervals(metrics: DataFrame, every: int, order: list[str], run: str = "run_id",
                      value: str = "value") -> DataFrame:
    """G7 as logged: the values of each run in order, summed over every ``every`` steps and
    rescaled to their mean. The last interval of a run may be shorter.

    A step's number comes from a distributed position and an interval is a grouping key of its
    own, so the intervals of a run that holds a third of all rows are summed by many tasks."""
    steps = step_index(metrics.select(run, *order, value), run, order)
    interval = F.floor(F.col("step") / every).cast("bigint")
    return steps.groupBy(run, interval.alias("interval")).agg(
        F.min("step").alias("first_step"), F.count(F.lit(1)).alias("n"),
        F.round(F.sum(value), 6).alias("total"), F.round(F.avg(value), 6).alias("logged"),
        F.max_by(value, "step").alias("last"))


def step_weights(step: Column, k: Column, lam: float | None) -> Column:
    """H2: ``exp(lam * (i - (K - 1)))``, or ``1/K`` without a lambda."""
    if lam is None:
        return F.lit(1.0) / k
    return F.exp(F.lit(lam) * (step - (k - 1)))


def every_k(step: Column, k: int) -> Column:
    """H3: update on ``(i + 1) % k == 0``."""
    return F.pmod(step + 1, F.lit(k)) == 0


def averaging_step(step: Column, k: int) -> Column:
    """H3: averaging on ``step % k == 0 and step > 0``."""
    return (F.pmod(step, F.lit(k)) == 0) & (step > 0)
