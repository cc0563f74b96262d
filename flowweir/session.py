"""Session settings and the shared stage folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Wide rows give generated methods beyond the JVM's size limit for compiling.
JVM_OPTIONS = "-XX:-DontCompileHugeMethods"
_scopes: list[str] = []


def build_session(app: str = "flowweir", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the operators rely on.

    Nothing here fixes a cluster size: shuffle partitions, executor memory and
    ``spark.checkpoint.dir`` come from the deployment, AQE does the rest.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.driver.extraJavaOptions": JVM_OPTIONS,
        "spark.executor.extraJavaOptions": JVM_OPTIONS,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own; on a cluster an
    unset folder is an error, because executors do not share a local disk.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="flowweir-"))
    return context.getCheckpointDir().rstrip("/")


@contextmanager
def stage_scope(spark: SparkSession):
    """Delete what is staged inside when the block ends.

    A result that reads staged tables has to be written inside the block.
    Scopes nest; they are meant for one thread that drives its queries in turn.
    """
    folder = f"{shared_dir(spark)}/flowweir-stage/scope-{uuid.uuid4().hex}"
    _scopes.append(folder)
    try:
        yield folder
    finally:
        _scopes.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage_path(spark: SparkSession, name: str) -> str:
    folder = _scopes[-1] if _scopes else f"{shared_dir(spark)}/flowweir-stage"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage with a durable copy (a lost executor costs a re-read, not
    a recomputation) and freezes values that depend on physical placement.
    Columnar files keep later reads pruned and give the optimizer real sizes.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
