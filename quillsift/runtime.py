"""Session, table and scratch-storage helpers shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillsift")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


#: Folder of the scratch tables of this process below the shared one.
RUN = f"quillsift/{uuid.uuid4().hex}"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``).

    Only where a local session names none (tests) a folder of this machine is made and set; RuntimeError on
    a cluster without one, for its machines could not read each other's folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = current.get() if current.isDefined() else None
    master = spark.sparkContext.master
    if not root and not (master.startswith("local") and not master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="quillsift-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the scratch folder, which is removed when this process ends."""
    root = scratch_root(spark)
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(discard, spark, root)
    return f"{root}/{RUN}/{name}-{uuid.uuid4().hex}"


_ROOTS: set[str] = set()


def discard(spark: SparkSession, root: str | None = None) -> None:
    """Removes the scratch tables of this process; frames that read them are void from then on."""
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{root or scratch_root(spark)}/{RUN}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is gone: nothing can be removed any more
        return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared scratch folder and read it back.

    Cuts the lineage: a lost executor later costs only tasks that read these files again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A small scan of fewer partitions than the cluster has cores, shuffled into one for each MB; else ``df`` as it is."""
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, estimated_bytes(df) >> 20)
    return df.repartition(wanted) if wanted > 1 and df.rdd.getNumPartitions() < wanted else df


def hash_sample(df: DataFrame, key: str, most: int, seed: int = 42, distinct: bool = False) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashes of ``key``: the same ones on every run.

    With ``distinct`` one row for each key, so copies of one do not fill the sample.

    The rows are counted first and nearly all others filtered out where they are read, so the
    candidates that reach one place do not grow with the table.
    """
    h = F.xxhash64(F.col(key), F.lit(seed))
    rows = df.select(F.count_distinct(h) if distinct else F.count("*")).head()[0]
    if rows > 2 * most:
        share = min(1.0, (1.2 * most + 100) / rows)
        df = df.filter(F.pmod(h, F.lit(1 << 40)) < int(share * (1 << 40)))
    if distinct:
        df = df.dropDuplicates([key])
    return df.orderBy(F.pmod(h, F.lit(1 << 40)), key).limit(most)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimized plan, in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """Broadcast hint only where the counted ``rows`` stay within ``limit``; otherwise Spark joins by shuffle."""
    return F.broadcast(df) if rows <= limit else df
