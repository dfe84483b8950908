"""Helpers shared by the corpus operators: shared-folder cuts, reading, splits."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch. Texts can be long, so that far fewer than Spark's 10,000 travel at once.
ARROW_ROWS, ARROW_BYTES = 1000, 32 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds; called by every operator that hands texts to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a new one where it is unset and all runs on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='specgraph-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/specgraph/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, and a lost executor costs no recomputation.

    Its shuffle files go as soon as it is written, since nothing reads them any more.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete what ``cut`` wrote for these tables; nothing may still be read from them."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.cut_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def crc_rest(column: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of`` (-1 for null): the split into training and held-out rows."""
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(of)), F.lit(-1))


def only(docs: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, whatever else the table carries."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def constant(rows: DataFrame, words: int, made=lambda words: words, kind: str = "ARRAY<BIGINT>") -> tuple[Column, str]:
    """The dense array of v (bits are put together) by w (int, from 0 to ``words`` - 1; 0 where there is none), and the name of the variable that holds it.

    ``made`` may turn it into another value, of the type ``kind``. It goes from the executors to the plan through a variable of the session, never through Python; callers bound its size.
    Plans made before ``forget`` keep the value.
    """
    spark, name = rows.sparkSession, f"words_{uuid.uuid4().hex}"
    none = spark.range(words).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("bigint").alias("v"))
    packed = cut(rows.unionByName(none).groupBy("w").agg(F.bit_or("v").alias("v")), "words")
    spark.sql(f"DECLARE VARIABLE {name} {kind}")
    spark.sql(f"SET VAR {name} = (SELECT a FROM {{one}})", one=packed.agg(made(F.transform(F.sort_array(F.collect_list(F.struct("w", "v"))), lambda x: x["v"])).alias("a")))
    drop(packed)
    return F.expr(name), name


def forget(spark: SparkSession, *names: str) -> None:
    for name in names:
        spark.sql(f"DROP TEMPORARY VARIABLE {name}")


#: Powers of two between which the bits of a filter lie: 32 MB at most.
LEAST_BITS, MOST_BITS = 10, 28


def among(keys: DataFrame, key: Column) -> tuple[Column, str]:
    """Whether the hash ``key`` of a row may be that of one of ``keys`` (which has the same columns), and a variable's name for ``forget``.

    Never false for one that is among them. A bit for each hash, sixteen bits a key as far as what every task can hold allows; with more keys
    it lets more through, so that an exact step has to follow.
    """
    k = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(16 * keys.count() + 1))))
    word, bit = F.shiftrightunsigned(key, 70 - k).cast("int"), key.bitwiseAND(F.lit(63)).cast("int")
    words, name = constant(keys.select(word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("v")), 1 << (k - 6))
    return F.call_function("shiftrightunsigned", F.get(words, word), bit).bitwiseAND(F.lit(1)) == 1, name
