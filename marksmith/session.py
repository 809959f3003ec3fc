"""SparkSession helpers.

The engine never invents a machine-local scratch folder on a cluster: lineage is
cut with ``DataFrame.checkpoint()`` into the folder the cluster names in
``spark.checkpoint.dir``. Only a local-mode session without that setting (tests,
benchmarks on one machine) gets a fresh folder under the system temp dir.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "marksmith") -> SparkSession:
    """A session for ``master``; without one (and without MARKSMITH_MASTER) the master, the
    shuffle partitions and the memory are left to spark-submit or the cluster's defaults."""
    master = master or os.environ.get("MARKSMITH_MASTER")
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # operators checkpoint intermediate tables; drop their files once unreferenced
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    elif master and master.startswith("local["):
        builder = builder.config("spark.sql.shuffle.partitions", str(_cores_of(master) * 2))
    if "MARKSMITH_DRIVER_MEMORY" in os.environ or (master and master.startswith("local")):
        builder = builder.config("spark.driver.memory",
                                 os.environ.get("MARKSMITH_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _cores_of(master: str) -> int:
    if master.startswith("local[") and master.endswith("]"):
        inner = master[6:-1]
        return os.cpu_count() or 1 if inner == "*" else int(inner)
    return os.cpu_count() or 1


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, reading it from the session.

    ``spark.checkpoint.dir`` wins. Without it, a local-mode session gets a new
    private folder; any other master must name a shared folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="marksmith-ckpt-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a compressed table below the checkpoint folder and read it back: what a
    checkpoint does, for tables as long as the corpus, whose rows a checkpoint keeps uncompressed
    and reads whole."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
