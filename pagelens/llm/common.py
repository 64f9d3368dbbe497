"""Helpers shared by the training-data operators: table access and shared scratch space."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only characters that separate words here.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one is set only where none is configured."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="pagelens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/pagelens-{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables made by written() that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for df in frames:
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            where = jvm.org.apache.hadoop.fs.Path(f)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def whole_text(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_heavy(rows: DataFrame, of_key: DataFrame, key: str, count: str, total: int, share: int = 1000) -> DataFrame:
    """rows with what of_key (one row for each key, with its number of rows) says about their key; others are left out.

    Keys with more than one in `share` of all rows are fewer than `share`, so these are broadcast and
    their rows stay where they are; only the rows of the other keys are shuffled to them.
    """
    heavy = F.col(count) * share > F.lit(total)
    few = F.broadcast(of_key.where(heavy))
    rest = rows.join(F.broadcast(of_key.where(heavy).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(rest.join(of_key.where(~heavy), key))


def sampled(df: DataFrame, most: int, key: str, seed: int) -> list[Row]:
    """Rows of at most `most` distinct keys, the first in the order of a hash of the key; df has one value of the others for each key.

    Only keys below a cut of the hash are ordered, so that no task handles more than a few times the
    sample. The cut comes from the approximate number of keys and is widened until the sample is full
    or no key is left out, so it has no influence on the result.
    """
    span = 1 << 40
    h = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(span))
    n = df.agg(F.approx_count_distinct(key)).first()[0]
    cut = span if n <= 2 * most else int(span * 1.5 * most / n)
    while True:
        rows = df.where(h < F.lit(cut)).groupBy(key).agg(*(F.first(c).alias(c) for c in df.columns if c != key)).orderBy(h, key).limit(most).collect()
        if len(rows) >= most or cut >= span:
            return rows
        cut = min(span, 4 * cut)
