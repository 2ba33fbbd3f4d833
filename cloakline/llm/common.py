"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The code points that separate words, as a Java character class body.
WORD_SPACE = "\\x20\\x09-\\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of one Arrow batch handed to Python; long texts then come in few rows at a time.
ARROW_BYTES = 16 << 20
#: Bits of a map of ids.
BITMAP = 63 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset the warehouse.

    Only in local mode, where driver and executors are one machine, a temporary folder stands in.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir", "")
    if not configured and context.master.startswith("local") and not context.master.startswith("local-cluster"):
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="cloakline-"))
        configured = _local[0]
    return (configured or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


#: The local mode's folder, and every folder that was written, in order.
_local: list[str] = []
_written: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/cloakline/{uuid.uuid4().hex}/{name}"
    _written.append(path)
    return path


def written() -> int:
    """How many folders were written so far: a mark for sweep()."""
    return len(_written)


def sweep(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete the folders written since a mark, once what was computed from them is itself written or no longer needed."""
    for path in [p for p in _written[since:] if p not in keep]:
        remove(spark, path.rpartition("/")[0])
        _written.remove(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors."""
    return put(df, fresh_path(df.sparkSession, name))


def put(df: DataFrame, path: str) -> DataFrame:
    """The same at a path of its own."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written folder through Hadoop, whatever store it is in."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes, so that very long texts don't add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prefix(df: DataFrame) -> str:
    """What no column of df begins with, for columns that are added for a while."""
    out = "_"
    while any(c.lower().startswith(out) for c in df.columns):
        out += "_"
    return out


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable is never inlined again."""
    return F.transform(F.array(value), body)[0]


def bit_of(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BITMAP))


def bitmap(ids: DataFrame) -> np.ndarray:
    """A bit for the hash of every doc_id: BITMAP bits whatever the number of ids, so it may go to every task."""
    words = ids.select(bit_of("doc_id").alias("h")).selectExpr("h div 63 as w", "shiftleft(1L, cast(h % 63 as int)) as bit")
    rows = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most BITMAP / 63 rows
    out = np.zeros(BITMAP // 63 + 1, np.int64)
    out[rows["w"].to_numpy()] = rows["bits"].to_numpy()
    return out


def marked(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether each place's bit is set."""
    return (bits[places // 63] >> (places % 63)) & 1 == 1


#: What a Python worker keeps from task to task.
_kept: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]):
    """make()'s value, kept for the worker's next tasks: one at a time, so what an earlier stage kept goes."""
    if key not in _kept:
        give_back(forget=True)
        _kept[key] = make()
    return _kept[key]


def give_back(forget: bool = False) -> None:
    """Give what is free back to the system; forget: what is kept, too."""
    if forget:
        _kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(run: Callable[[Iterator], Iterator], keeps: bool = False) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, after which the worker, which serves later stages too, gives back what it has freed.

    keeps: run uses what is kept; else that is forgotten first.
    """

    def tidied(batches: Iterator) -> Iterator:
        if not keeps:
            give_back(forget=True)
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied
