"""Tables that a job writes once for itself: intermediate results that several later steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one of its own for local runs where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own: computed once, however often it is read, and safe from lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with a column `name` that counts its rows from 1 in the given order, without one task seeing them all: rows are
    dealt by ranges, and each range starts after the ones before it. Only their sizes reach the driver."""
    dealt = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part, mask = F.shiftright("_at", 33), (1 << 33) - 1
    before, starts = 0, []
    for r in sorted(dealt.groupBy(part.alias("p")).count().collect()):
        starts.append((r["p"], before))
        before += r["count"]
    rows = df.sparkSession.createDataFrame(starts, "_p long, _before long")
    return dealt.join(F.broadcast(rows), part == F.col("_p")).withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit(mask)) + 1).drop("_at", "_p", "_before")


def released(*tables: DataFrame) -> None:
    """Delete tables that `written` made and that nothing reads any more."""
    for df in tables:
        spark, base = df.sparkSession, scratch_dir(df.sparkSession).split(":", 1)[-1].lstrip("/")
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if path.split(":", 1)[-1].lstrip("/").startswith(base):
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
