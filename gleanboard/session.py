"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gleanboard")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


#: Bytes of an Arrow batch that is handed to Python.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Bound the Arrow batches of the session by bytes, not only by rows.

    Texts have any length: ten thousand of them in one batch can fill a worker.
    A smaller limit that the session already has stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)))
    if now <= 0 or now > limit:
        spark.conf.set(key, str(limit))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only in local mode."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if sc.getCheckpointDir():
            return sc.getCheckpointDir()
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="gleanboard-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, never reused between runs."""
    return f"{scratch_root(spark).rstrip('/')}/gleanboard/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage through the reliable checkpoint folder.

    Used where a result must be computed exactly once (model replies) or must
    not move between two actions (positions in a sorted table).
    """
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)
