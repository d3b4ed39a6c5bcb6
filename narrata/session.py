"""Session helpers: builder defaults for local tests and a checkpoint folder.

On a cluster the session is given; these helpers only fill in settings that
are unset. The checkpoint folder is read from ``spark.checkpoint.dir`` (the
shared folder named by the cluster) and only invented for local runs.
"""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # per-class top-k windows (row_number <= k) are pre-limited before the
    # shuffle up to this k
    "spark.sql.optimizer.windowGroupLimitThreshold": "20000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8,
                  app: str = "narrata", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", os.environ.get("NARRATA_DRIVER_MEM", "16g")))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, setting a scratch one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        # a machine-local folder serves local sessions only
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="narrata-ckpt-", dir="/tmp")
        try:
            spark.conf.set("spark.checkpoint.dir", configured)
        except Exception:  # noqa: BLE001 - core confs may be read-only at runtime
            pass
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame, name: str = "stage", codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Like a reliable checkpoint it survives executor loss; unlike one it keeps
    column pruning, filter pushdown and size statistics for what follows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more, on whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Within, a job's shuffle files go when it ends; else they stay until the driver
    collects its garbage, and steps of many jobs fill the disk."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def bounded(df: DataFrame, limit: int = 200_000) -> DataFrame:
    """``df``, refused at run time beyond ``limit`` rows.

    At most ``limit + 1`` rows are ever gathered to count them, so a table that
    is larger than its caller believes fails with a message, not out of memory."""
    counted = df.limit(limit + 1).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy()))
    ok = F.when(F.col("_all") <= limit, F.lit(True)).otherwise(
        F.raise_error(F.lit(f"a table taken as small has more than {limit} rows")).cast("boolean"))
    return counted.where(ok).drop("_all")


def broadcast_bounded(df: DataFrame, limit: int = 200_000) -> DataFrame:
    """A :func:`bounded` table, marked for broadcast."""
    return F.broadcast(bounded(df, limit))


#: rows of an Arrow batch of texts: Spark's 10,000 take a task hundreds of MB
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """At most ``BATCH_ROWS`` rows an Arrow batch from now on in this session, so that
    what a Python worker holds does not grow with its partition."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local
    on a cluster, since the checkpoint folder is the cluster's shared one)."""
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/scratch/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``narrata`` importable in Python workers (UDF-backed operators).

    The package is zipped once on the driver and added with ``addPyFile``;
    Spark distributes it to every executor. Idempotent per SparkContext."""
    import os
    import zipfile
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="narrata-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(key)
