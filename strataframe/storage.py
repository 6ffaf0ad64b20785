"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder under /tmp serves a session whose executors are threads of the
    driver; a cluster has to name one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file:///tmp/strataframe-shared"
    return path.rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    """A path of the application's own in the shared folder, not yet used."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: cuts lineage, survives lost executors, and keeps what several
    branches read from being computed in each."""
    spark, path = df.sparkSession, fresh(df.sparkSession, label)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs within are deleted when it ends, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, True)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def release(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a materialized frame that nothing will read again."""
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        _path(spark, f)[1].delete(_path(spark, f)[0], True)


def _path(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None, **options: object) -> None:
    """Write beside the target, then rename: readers see the old files or all of the new ones."""
    spark, part = df.sparkSession, f"{path}.part-{uuid.uuid4().hex}"
    w = df.write.format(kind).options(**options)
    (w.partitionBy(*by) if by else w).save(part)
    target, fs = _path(spark, path)
    fs.delete(target, True)
    if not fs.rename(_path(spark, part)[0], target):
        raise OSError(f"cannot rename to {path}")


def summary(df: DataFrame, path: str) -> DataFrame:
    """One row as JSON, keys in order, published as text; returned as read back."""
    row = df.select(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    publish(row.select(F.to_json(F.struct("*")).alias("value")).coalesce(1), path, "text")
    return df.sparkSession.read.schema(row.schema).json(path)
