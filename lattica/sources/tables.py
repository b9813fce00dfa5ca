"""Reading tables, and writing intermediate ones where every executor sees them."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating columns with NaN as null: the one missing value from here on."""
    floats = [c for c, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset and all runs in one process
    (tests) a temporary folder is made, one for an application."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        key = spark.sparkContext.applicationId
        found = _made[key] = _made.get(key) or f"file://{tempfile.mkdtemp(prefix='lattica-')}"
    return found.rstrip("/")


def working_dir(spark: SparkSession) -> str:
    """The application's own folder within the shared one."""
    return f"{shared_dir(spark)}/lattica/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Remove all that this application has materialized, once none of its results is read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(working_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of the Arrow batches that tasks exchange with Python workers while a table is written, and the setting for them: with
#: the usual 10,000, rows of two texts hold some 100 MB a task outside the heap.
BATCH_SETTING, BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 4000


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(BATCH_SETTING)
    if not int(before) or int(before) > BATCH:
        spark.conf.set(BATCH_SETTING, BATCH)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage is cut, and a later loss of an
    executor costs a reread, not a recomputation."""
    spark = df.sparkSession
    path = f"{working_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _small_batches(spark):
        df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
