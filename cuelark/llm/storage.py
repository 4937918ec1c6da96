"""Where intermediate tables live: the folder that the cluster shares.

``spark.checkpoint.dir`` names it. Only where that setting is absent and Spark
runs on this machine alone (tests, a laptop) is a folder of our own made. What was
written there goes when the program ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SETTING = "spark.checkpoint.dir"
#: Bytes (about) of the rows handed to a Python worker at a time; a longer row goes alone.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; also makes sure that ``checkpoint()`` has one."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not named and held.isEmpty() and not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
        raise ValueError(f"{SETTING} must name a folder that all executors share")
    if not named:
        named = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="cuelark-")
    if held.isEmpty():
        spark.sparkContext.setCheckpointDir(named)
        atexit.register(_forget, spark, spark.sparkContext._jsc.sc().getCheckpointDir().get())
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def local_table(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    """A table of a few rows (numbers, strings) of the driver, handed over as Arrow.

    Handed over as a list, they would be copied by Python workers of a second kind,
    which stay on the executors beside those of the operators.
    """
    columns = to_arrow_schema(schema)
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(columns)], schema=columns), schema)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows that go to Python workers meanwhile go in batches of about BATCH_BYTES, unless the session has a bound of its own.

    A batch is held several times, by the executor and its worker; 10,000 rows of long texts are many MB.
    """
    if spark.conf.get(BATCH_SETTING, None) is not None:
        yield
        return
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_SETTING)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what was cut off.

    Spark does so once the driver's garbage collector has found them unused. In a
    loop of small jobs the driver's heap hardly grows, so it would not look for long.
    """
    spark._jvm.System.gc()


def _forget(spark: SparkSession, path: str) -> None:
    """Deletes a staged table, or this program's checkpoints, when the program ends, if Spark still runs."""
    if spark.sparkContext._jsc is None:
        return
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Unlike ``checkpoint()`` it is compressed and lets later reads prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cuelark-{uuid.uuid4().hex}/{name}.parquet"
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)
