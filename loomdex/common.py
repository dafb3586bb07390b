"""Session helpers shared by all operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the data folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs on this machine alone (as in tests) a temporary folder is set; on a
    cluster a folder of one machine would lose what the others write, so there the setting is asked for."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="loomdex-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a parquet table in the shared folder and reads it back.

    Cuts the lineage with files every executor can read again, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *keys: str) -> DataFrame:
    """The rows with their number, from 0, in the order of the keys.

    Rows are range-partitioned, sorted and written with their place inside their range; a row's number is its place plus the
    number of rows in the ranges before. No task orders all rows; one row for each range reaches the driver."""
    mono = F.monotonically_increasing_id()
    kept = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"_part": F.shiftright(mono, 33).cast("int"), "_at": mono.bitwiseAND((1 << 33) - 1)})
    kept = written(kept, "numbered")
    ahead, rows = 0, []
    for x in sorted(kept.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        rows.append((x._part, ahead))
        ahead += x.n
    plan = F.broadcast(df.sparkSession.createDataFrame(rows, "_part int, _ahead long"))  # one row for each range
    return kept.join(plan, "_part").withColumn("number", F.col("_ahead") + F.col("_at")).drop("_part", "_at", "_ahead")


_WRITTEN: list[str] = []


def release(spark: SparkSession) -> int:
    """Deletes all tables ``written`` so far by this driver and returns their number. Results made from them must have been
    used or stored before."""
    for path in (gone := _WRITTEN[:]):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _WRITTEN.remove(path)
    return len(gone)


def wide_hash(*cols: Column | str) -> tuple[Column, Column]:
    """A 64-bit and a 32-bit hash by independent functions, together a 96-bit stand-in for the columns' values.

    Equal values always agree; that two of 10**9 values agree by chance has odds of about 10**-11."""
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.xxhash64(*cs), F.hash(*cs)
