"""Lineage cuts for iterative plans: tables in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where none is set a local one, but only if driver and executors are one process."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", context.master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines share: the master is {context.master}")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="stakeweave-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return f"file://{_LOCAL[0]}"


def cut(df: DataFrame, tag: str = "step") -> DataFrame:
    """df, written and read back: survives lost executors, and plans stay as small as one step."""
    path = f"{shared_dir(df.sparkSession)}/stakeweave/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of cut() tables that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def some(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with place (1, 2, ... in the order given) and total: dealt range by range; only one count per range meets in one task."""
    rows = cut(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    counts = rows.groupBy("part").agg(F.count("*").alias("size"))
    before = counts.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"), F.sum("size").over(Window.partitionBy()).alias("total"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")
    return rows.join(F.broadcast(before), "part").withColumn("place", place).drop("part", "before")
