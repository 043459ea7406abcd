"""Shared helpers of the training-data operators: scratch tables, let-binding, word rules."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sides of at most so many bytes (measured, not guessed) may be broadcast.
BROADCAST_BYTES = 16 << 20
#: Items of a block of scan(); code points of a part of chunks_of().
SCAN, CHUNK_BITS = 256, 12
CHUNK = 1 << CHUNK_BITS

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster shares; a local one only where none is named and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
    return (named or "file:///tmp/checkpoints").rstrip("/") + "/tessella"


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(drop_all)
    _made.append((spark, path))
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: a cut of the lineage that outlives any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(saved: DataFrame) -> None:
    """Remove what save() has written, once nothing reads it any more."""
    drop(saved.sparkSession, saved.scratch)


def drop(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop_all() -> None:
    """Remove what this process left in the scratch folder; runs at exit too."""
    while _made:
        spark, path = _made.pop()
        try:
            drop(spark, path)
        except Exception:  # the session may have ended before us
            pass


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it many times inside body (a lambda's variable is a value, a column expression is not)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(items: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """An array of kind that step(acc, item) grows: acc and its result are structs at (a place in the text) and out.

    An array that grows by one copies itself each time; blocks of SCAN keep n items under n ** 1.5 copies or so.
    """
    none = F.array().cast(f"array<{kind}>")

    def block(acc: Column, k: Column) -> Column:
        inner = F.aggregate(F.slice(items, k * SCAN + 1, F.lit(SCAN)), F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return let(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], r["out"]).alias("out")))

    starts = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / SCAN).cast("int"))
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(F.size(items) == 0, none).otherwise(F.aggregate(starts, zero, block, lambda acc: acc["out"]))


def chunks_of(text: Column) -> Column:
    """The text in parts of CHUNK code points, so that a place far inside is reached without a walk from the start."""
    return F.when(F.octet_length(text) <= CHUNK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))


def piece_of(chunks: Column, start: Column, end: Column) -> Column:
    """Code points start to end (exclusive, both inside the text) of the text that chunks_of() has cut; start <= end."""
    first = F.shiftright(start, CHUNK_BITS)
    held = F.array_join(F.slice(chunks, first + 1, F.shiftright(end, CHUNK_BITS) - first + 1), "")
    return F.substring(held, start - F.shiftleft(first, CHUNK_BITS) + 1, end - start)


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay. The check first keeps all-lower texts cheap."""
    return F.translate(c, UPPER, LOWER)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df is under the size that may be broadcast: so many bytes a row, and the strings as they are, are summed."""
    strings = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t == "string"]
    width = sum(strings, F.lit(row_bytes).cast("long"))
    head = df.select(width.alias("w")).limit(limit // row_bytes + 1)
    return (head.agg(F.sum("w")).first()[0] or 0) <= limit
