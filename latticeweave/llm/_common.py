"""What the training-data operators share: the shared work folder, written tables, Arrow batch bounds, joins of hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and \x09-\x0D; what bytes.split() splits at.
WORD = r"[^\x20\x09-\x0D]+"
ARROW_ROWS, ARROW_BYTES = 512, 32 << 20
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: A key is hot if it holds more than one in HOT_SHARE of all rows, so at most HOT_SHARE keys are; in tables of under
#: HOT_ROWS * HOT_SHARE rows it is one of more than HOT_ROWS.
HOT_SHARE, HOT_ROWS = 1000, 1000


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of the session holds, so that long texts don't add up in a Python worker. Batches are
    only made smaller, never larger."""
    for name, bound in ((_ROWS, ARROW_ROWS), (_BYTES, ARROW_BYTES)):
        now = spark.conf.get(name, None)
        now = int(now) if now and now.lstrip("-").isdigit() else 0
        spark.conf.set(name, str(min(now, bound) if now > 0 else bound))


@contextmanager
def wide_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Larger Arrow batches of narrow rows, for what is evaluated inside."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def work_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a session in one process (tests) gets a temporary
    folder; on a cluster, whose machines share no such folder, it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        root = tempfile.mkdtemp(prefix="latticeweave-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/latticeweave/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or work_dir(spark)
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """left ⋈ right on key, where right has one row a key and left may have any number. Hot keys (HOT_SHARE at most, so
    their list is broadcast) are salted: left's rows are dealt over as many copies of right's row as they need. left is
    read more than once and should be a written table."""
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = left.count()
    limit = max(HOT_ROWS, total // HOT_SHARE)
    hot = counts.where(F.col(key).isNotNull() & (F.col("_n") > limit)).select(F.col(key), F.ceil(F.col("_n") / limit).cast("int").alias("_copies")).collect()
    if not hot:
        return left.join(right, key, how)
    names = F.broadcast(left.sparkSession.createDataFrame(hot, left.select(key, F.lit(1).alias("_copies")).schema))
    cold = left.join(names, key, "left_anti").join(right, key, how)
    salted = left.join(names, key).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.col("_copies")).cast("int")).drop("_copies")
    copies = right.join(names, key).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")
    return cold.unionByName(salted.join(copies, [key, "_salt"], how).drop("_salt"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def ascii_lower(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else changed."""
    return b"" if text is None else text.encode("utf-8", "replace").lower()
