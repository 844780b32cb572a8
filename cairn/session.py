"""Session defaults and the shared scratch folder that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("cairn")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.driver.memory", memory)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def scratch_root(spark: SparkSession) -> str:
    """The folder shared by driver and executors, from ``spark.checkpoint.dir``.

    Only a single-process local session may fall back to a temporary folder; on
    a cluster an unset folder is an error, because a machine-local path would
    be lost with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="cairn-")
    spark.conf.set("spark.checkpoint.dir", root)
    spark.sparkContext.setCheckpointDir(root)
    return root


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    This cuts the lineage durably: a lost executor re-reads the files instead
    of recomputing (or losing) the rows. The schema is passed explicitly so
    that an empty result needs no inference.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/cairn-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._cairn_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that no later step reads, and let Spark drop the shuffle files behind them."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._cairn_path)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan, dealt over all cores if its files split into fewer parts; a large table has more and is read as it lies."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


#: Rows of an Arrow batch, where the session has Spark's default of 10,000: texts are long, and a batch is held whole on both sides.
BATCH_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark application, and keep batches of texts small."""
    name, default, rows = BATCH_ROWS
    if spark.conf.get(name) == default:
        spark.conf.set(name, rows)
    context = spark.sparkContext
    if getattr(context, "_cairn_shipped", False):
        return
    home = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="cairn-ship-")) / "cairn.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(home.rglob("*.py")):
            archive.write(file, f"{home.name}/{file.relative_to(home)}")
    context.addPyFile(str(path))
    context._cairn_shipped = True
