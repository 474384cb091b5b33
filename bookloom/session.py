"""Session defaults, the shared folder, and lineage cuts that survive executor loss."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def local_session(cores: str = "*", partitions: int = 8, app: str = "bookloom", **conf) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster such a folder would
    live on one machine and vanish with it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: one write to the shared folder, then a plan that starts from it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh table path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder as columns and read back: smaller than a checkpoint, and of known size to the planner."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rnk") -> DataFrame:
    """Dense position (1, 2, ...) of every row within ``keys``, for groups of any size.

    A plain window would put a whole key in one task. Here rows are range-partitioned on key *and*
    order, so a hot key spans many tasks; the written copy fixes the partition numbers, and each
    row's position is its place inside its partition plus the rows of its key in earlier ones.
    """
    cols = df.columns
    ordered = df.select(
        *cols, *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
    )
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(
        ordered.repartitionByRange(parts, *[F.col(k).asc() for k in keys], *order)
        .withColumn("_part", F.spark_partition_id()),
        "placed",
    )
    group = [f"_k{i}" for i in range(len(keys))]
    before = (
        placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_n").over(
                    Window.partitionBy(*group).orderBy("_part")
                    .rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("_n")
    )
    local = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))
    return (
        placed.withColumn("_local", local)
        .join(before, [*group, "_part"])
        .select(*cols, (F.col("_local") + F.col("_before")).cast("long").alias(name))
    )
