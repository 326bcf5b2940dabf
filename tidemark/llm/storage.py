"""Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests, a folder of this session's own in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidemark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-tidemark-")
        spark.conf.set("tidemark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths of the intermediate tables of this process, for `clean`.
_WRITTEN: list[str] = []


def written(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """The rows written once as Parquet in the shared folder, in folders by the columns `by`, and read back: lineage ends here and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a superseded intermediate table, through Spark's own file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession) -> int:
    """Deletes all intermediate tables written so far, once results that read them are written themselves: how many."""
    done = 0
    while _WRITTEN:
        drop_path(spark, _WRITTEN.pop())
        done += 1
    return done


def text_bytes(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """(rows, bytes of text), by one aggregate."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
