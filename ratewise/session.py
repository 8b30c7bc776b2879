"""Session set-up and the few helpers that touch the cluster itself."""

from __future__ import annotations

import io
import tempfile
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound for a hinted broadcast; override with ``spark.ratewise.broadcastBytes``.
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024
#: What Spark reads into one split by default.
SPLIT_BYTES = 128 * 1024 * 1024


def local_session(app: str = "ratewise", cores: int | str = 8, memory: str = "8g", **conf) -> SparkSession:
    """A local session for tests and the bench. Clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster the files must
    outlive the executor that wrote them.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ratewise-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so that later stages neither replan nor recompute it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_bytes(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.ratewise.broadcastBytes", str(DEFAULT_BROADCAST_BYTES)))


@contextmanager
def shared_broadcasts(spark: SparkSession, jobs: int):
    """Inside, each of ``jobs`` like fits may hint its share of the bound only."""
    key, bound = "spark.ratewise.broadcastBytes", broadcast_bytes(spark)
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(bound // max(1, jobs)))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def fits_broadcast(spark: SparkSession, rows: int, bytes_per_row: int = 64) -> bool:
    return rows * bytes_per_row <= broadcast_bytes(spark)


def broadcast_if_small(df: DataFrame, rows: int, bytes_per_row: int = 64) -> DataFrame:
    """Hint a broadcast only when the counted size fits; otherwise leave the join to AQE."""
    return F.broadcast(df) if fits_broadcast(df.sparkSession, rows, bytes_per_row) else df


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for heavy per-row work on an input of few splits; large inputs stay as read.

    Looks at the number of files and the estimated size only, so no job runs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    large = size >= cores * SPLIT_BYTES or len(df.inputFiles()) >= cores
    return df if large else df.repartition(cores)


def ship(spark: SparkSession) -> str:
    """Give this package to all executors, once per application, and return the archive's address.

    Needed where executors do not have it installed: tasks that run numpy import it by name. The
    archive is written beside the checkpoints, in the folder that all executors share.
    """
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        data, root = io.BytesIO(), Path(__file__).resolve().parent
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
            for path in sorted(root.rglob("*.py")):
                archive.write(path, path.relative_to(root.parent))
        address = f"{ensure_checkpoint_dir(spark)}/{root.name}.zip"
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(address)
        out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
        out.write(data.getvalue())
        out.close()
        spark.sparkContext.addPyFile(address)
        _SHIPPED[application] = address
    return _SHIPPED[application]


_SHIPPED: dict[str, str] = {}
