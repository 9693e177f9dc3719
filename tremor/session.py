"""Session helpers: building a session, the shared checkpoint folder, lineage cuts
and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest number of rows we let a side of a join be broadcast when the caller does
# not say otherwise. Label-sized tables (labels², scenarios × labels) of a real
# economy stay far below this; the flow cube of a large economy does not.
DEFAULT_BROADCAST_ROWS = 2_000_000


def build_session(cores: str | int = "*", shuffle_partitions: int | None = None,
                  app: str = "tremor") -> SparkSession:
    """A local session configured like the tests and the bench.

    On a cluster, use the session the platform gives you and call
    :func:`ensure_checkpoint_dir` on it instead.
    """
    parts = shuffle_partitions or (os.cpu_count() if cores == "*" else int(cores))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.

    The cluster names a shared folder in ``spark.checkpoint.dir``; we use it as is.
    Only a local-mode session without one (tests, the bench) gets a fresh folder
    of its own under the system temp dir.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder for checkpoints")
    folder = tempfile.mkdtemp(prefix="tremor-ckpt-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as Parquet in the shared checkpoint folder and return a
    DataFrame that reads it back.

    Later jobs, and recomputation after a lost executor, start from the files; the
    plan above them is a plain scan of known size, so the optimizer does not re-plan the
    upstream query on every action. One job computes ``df`` and writes it. It is not
    persisted before: a cached plan keeps all of ``spark.sql.shuffle.partitions``, and so
    would every table, union and cross join that is derived from it. As it is, Spark
    coalesces the last shuffle by its size, and a small table is one partition whatever
    the number of shuffle partitions. The files stay until the folder is deleted."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for ``df`` only if its row count is at most ``max_rows``;
    beyond that the join falls back to a shuffle. ``df`` should be cheap to count
    (checkpointed or derived from a bounded dimension)."""
    if df.count() <= max_rows:
        return F.broadcast(df)
    return df
