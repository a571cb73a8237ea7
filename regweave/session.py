"""Session defaults and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "regweave", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are written for.

    Adaptive execution measures each shuffled side and switches to a broadcast
    join only below the limit; forced broadcasts are of counted sizes.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "50000",
    }
    for k, v in {**defaults, **{k: str(v) for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in ``spark.checkpoint.dir``.

    Where it is unset, a folder is made only if the driver is the only process.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(configured)


def cut_lineage(df: DataFrame, keep_layout: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files.

    The default is a Parquet table: its size is known to the planner, so small
    results are broadcast and columns are pruned when read again.
    ``keep_layout`` uses a checkpoint, which remembers how rows are partitioned
    and sorted.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if keep_layout:
        return df.checkpoint(eager=True)
    spark = df.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a result of ``cut_lineage`` that nothing reads any more."""
    written = df.__dict__.get("_table_path")
    if written is None:
        return
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(written)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
