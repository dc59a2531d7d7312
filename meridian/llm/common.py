"""What the corpus operators share: table access, shared folders, word rules."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of bytes outside these six (space and \t \n \v \f \r).
SEPARATORS = b" \t\n\x0b\x0c\r"
WORD_REGEX = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs on one machine, as in tests, a
    temporary folder is made and set as the checkpoint folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="meridian-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir() or path


def written(df: DataFrame, name: str, held: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result has no lineage to recompute and survives lost executors.  Its folder
    is added to ``held``, for ``dropped``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    del df
    if held is not None:
        held.append(path)
    release_shuffles(spark)
    return spark.read.schema(schema).parquet(path)


def dropped(spark: SparkSession, held: list[str]) -> None:
    """Delete intermediate tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in held:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    held.clear()


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished plans now.

    It follows the driver's garbage collection, which may not happen for a long
    time while disks fill up with files that no plan can read any more.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def word_count(text: Column) -> Column:
    """Words of a text; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def plainly_named(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1, ...: names such as ``a.b`` can't be passed to Python."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def trim() -> None:
    """Give memory that a Python worker has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


class IdFilter:
    """A bitmap that holds every id of a set, and others by chance: about one in 16 or fewer.

    It has at least 16 bits an id, up to 2**LARGEST bits (64 MB), so that what is
    broadcast is bounded; beyond four million ids more rows pass.  Rows whose id
    it doesn't hold need no shuffle to learn that they have no partner.
    """

    LEAST, LARGEST = 20, 29

    def __init__(self, ids: DataFrame, column: str):
        n = ids.count()
        self.bits = min(max(self.LEAST, (16 * n).bit_length()), self.LARGEST)
        x, mask = F.col(column), F.lit((1 << self.bits) - 1)
        at = x.bitwiseXOR(F.shiftrightunsigned(x, self.bits)).bitwiseAND(mask)
        words = ids.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
        bits = np.zeros(1 << (self.bits - 6), dtype=np.int64)
        bits[np.asarray(words["word"])] = np.asarray(words["bits"])
        self.sent = ids.sparkSession.sparkContext.broadcast(bits)

    def holds(self, ids: np.ndarray) -> np.ndarray:
        at = (ids ^ (ids.view(np.uint64) >> np.uint64(self.bits)).view(np.int64)) & ((1 << self.bits) - 1)
        return (self.sent.value[at >> 6].view(np.uint64) >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
