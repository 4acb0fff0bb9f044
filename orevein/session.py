"""Spark session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import atexit
import logging
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)


def get_spark(app: str = "orevein", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library is written for; values given in ``conf`` win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, even if it is not on their PYTHONPATH."""
    environment = spark.sparkContext.environment
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([here, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one only where the session names none (single machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = os.path.join(tempfile.gettempdir(), f"orevein-shared-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


#: Inputs above this many bytes are never moved by ``spread``.
SMALL_BYTES = 1 << 30


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size; of files it is their size, where nothing is known it is huge."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it is small and its files give work to fewer than half of them: one file of one row group is one task, however
    costly the expressions are that follow. What is larger than ``SMALL_BYTES`` is never moved, whatever the number of cores; rows are the
    same either way."""
    if estimated_bytes(df) > SMALL_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() < cores else df


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Tables that ``cut`` made and nothing has removed yet.
_tables: dict[str, SparkSession] = {}


@atexit.register
def _remove_all() -> None:
    for path, spark in list(_tables.items()):
        if spark.sparkContext._jsc is None:
            log.info("%s stays: its session was stopped before", path)
            continue
        try:
            _remove(spark, path)
        except Exception as e:  # the JVM may be gone already, and the interpreter is ending
            log.info("%s stays: %s", path, type(e).__name__)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back. A job runs at once.

    Later stages then read files that outlive any executor, instead of repeating what made them;
    being Parquet, the table also keeps its column pruning. ``release`` removes it, at the latest it goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/orevein-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._cut = path
    _tables[path] = spark
    return table


def release(*tables: DataFrame) -> None:
    """Removes tables made by ``cut`` that nothing will read again; other tables are left alone."""
    for table in tables:
        path = table.__dict__.pop("_cut", None)
        if path:
            _remove(table.sparkSession, path)
            _tables.pop(path, None)
