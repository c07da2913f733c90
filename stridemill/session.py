"""Session defaults and the shared folder that staged tables live in."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

_local_dirs: dict[str, str] = {}
_staged: dict[str, list[str]] = {}


def build_session(app_name: str = "stridemill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    AQE stays on: it coalesces small shuffle partitions, splits skewed join
    partitions and turns a join into a broadcast once the real size is known.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or set on the context.

    Only a ``local`` master may go without the setting; it then gets a
    temporary folder of its own. On a cluster a machine-local folder would not
    be seen by the other executors, so a missing setting is an error there.
    """
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="stridemill-")
    return _local_dirs[context.applicationId]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; remembered for ``release_staged``."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/stridemill/{app}/{label}-{uuid.uuid4().hex}"
    _staged.setdefault(app, []).append(path)
    return path


def stage(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: values that depend on the physical layout (row ids) are
    fixed from here on, whatever executors are lost later.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_staged(spark: SparkSession) -> int:
    """Delete the tables this application staged; returns how many."""
    paths = _staged.pop(spark.sparkContext.applicationId, [])
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    return len(paths)
