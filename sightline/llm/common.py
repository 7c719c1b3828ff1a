"""Helpers that the corpus operators share: shared folder, tables, names and native word columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates the words of the near-duplicate and decontamination operators.
NON_WORD = r"[^\p{L}\p{N}]+"
#: Words in a shingle, and the least similarity, where a contract doesn't say otherwise.
SHINGLE, SIMILARITY = 5, 0.8
#: Rows of a table that may be broadcast; a row of the tables in question has under 200 bytes.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where that is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


#: Rows and bytes of an Arrow batch at most: whole texts go to Python.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds of Arrow batches to those of ARROW; it leaves smaller ones."""
    for key, most in ARROW.items():
        now = spark.conf.get(key, None)
        size = int(now) if now and now.lstrip("-").isdigit() else 0
        if size <= 0 or size > most:
            spark.conf.set(key, str(most))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there, whatever executor goes."""
    bound_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/sightline-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes the files of stored() tables that nothing reads any more; what was made of them must be stored itself."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def released(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work for mapInPandas, after which the memory that a task has freed goes back to the system: Python workers live
    on between stages, and what they keep would stand beside the JVM's sorts and aggregates."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return run


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (stored) with a broadcast hint if it has at most so many rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Names like bases that no column of df has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for base in bases:
        name = base
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; an expression within a lambda would be computed for each element."""
    return F.transform(F.array(value), body)[0]


def words_text(text: Column) -> Column:
    """Lower-cased words (runs of letters and digits) joined by one space; empty for null."""
    return F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), NON_WORD, " ")))


def words(text: Column) -> Column:
    """The words of words_text() as an array, empty if there are none."""
    joined = words_text(text)
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32(doc_id as text) mod mod; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod
