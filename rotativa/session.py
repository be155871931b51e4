"""Session settings and the shared folder that jobs may write scratch tables to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "rotativa", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; ``conf`` wins over the defaults."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # HTML and article bodies are wide, so keep the batches sent to Python short.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        # Recording the Python call site of every column makes building wide plans slow.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder that the driver and every executor share.

    ``spark.checkpoint.dir`` if set, else the context's checkpoint folder, else a folder below the
    session's warehouse, which Spark qualifies with the default file system.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return base.rstrip("/") if base else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{scratch_root(spark)}/rotativa-{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a table that several jobs are about to read."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch_root(spark))
    return df.checkpoint(eager=True)


# Shuffle files of a written table are of no more use.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession, rows: int) -> None:
    """From now on the session sends at most so many rows to Python at once, or fewer if it says so."""
    if not 0 < int(spark.conf.get(BATCH_ROWS)) < rows:
        spark.conf.set(BATCH_ROWS, str(rows))


# A task reads at most so many bytes of files, where a file counts as so many more.
SPLIT_BYTES, OPEN_BYTES = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"


def materialize(df: DataFrame, label: str, batch_rows: int = 0, split_bytes: int = 0, by: str = "") -> DataFrame:
    """Write a table to the shared folder and read it again. The shuffle files of the write are deleted after it.

    With ``batch_rows`` the write sends at most so many rows to Python at once, or fewer if the session says so; with
    ``split_bytes`` its tasks read files of fewer bytes one by one. ``by`` is a column to store the table by.
    """
    path, conf = shared_dir(df.sparkSession, label), df.sparkSession.conf
    before = {k: conf.get(k) for k in (FREE_SHUFFLES, BATCH_ROWS, SPLIT_BYTES, OPEN_BYTES)}
    conf.set(FREE_SHUFFLES, "true")
    if batch_rows:
        short_batches(df.sparkSession, batch_rows)
    if split_bytes:
        conf.set(SPLIT_BYTES, str(split_bytes))
        conf.set(OPEN_BYTES, str(split_bytes))
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        for k, v in before.items():
            conf.set(k, v)
    return df.sparkSession.read.schema(df.schema).parquet(path)
