"""Session helpers: a tuned local session for tests and the bench, and the
checkpoint folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "meterwise", extra: dict | None = None) -> SparkSession:
    """A session with the engine's settings.  The master is the cluster's own
    unless one is named (tests and the bench name a local one)."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.unix.domain.socket.enabled", "true")
    )
    if master:
        b = b.master(master).config("spark.driver.memory", "16g")
    if master and not shuffle_partitions:
        shuffle_partitions = 8
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.  A folder the caller has set stays;
    else the cluster's setting is used; a scratch folder is made only for a
    local master (tests), and a cluster without one is an error."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="meterwise-ckpt-")
    spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder (reliable
    checkpoint, survives executor loss) and continue from the written copy.
    Partitioning and ordering of the plan are kept."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
