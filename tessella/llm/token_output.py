"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on document ids.

Documents are dealt by ranges of their ids, so that each file holds one range in ascending order and a file's, stripe's
or row group's minimum and maximum prune reads by id; the Bloom filter prunes what the ranges let through. Stripes are
read in parallel. Each row keeps its part and its start within the part: the global start is the sum of the earlier
parts' totals and that, so no task sees more than its own range and nothing is moved after the write. The parts' starts
(one row a part) lie beside the files, so a lookup of one id reads them and the row groups that may hold it, no more.

Defined results: null or empty text: the end id alone. Null ids come first. Rows of an id that repeats are ordered by
the text's hash; equal rows are all written. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .units import UnitEncoder, rows_with

VOCABULARY = "byte_bpe_50k.json"
#: White space outside ASCII, and what the special token starts with: rows with these are encoded whole.
ODD = [x.encode() for x in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"] + [b"<|e"]
SPACES = b"\t\n\x0b\x0c\r "
SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"
ORC = {"orc.create.index": "true", "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.stripe.size": str(32 << 20), "compression": "zstd"}


@lru_cache(1)
def encoder(path: str) -> UnitEncoder:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    width = np.zeros(t.get_vocab_size(), np.int64)
    for piece, i in t.get_vocab().items():
        width[i] = len(piece)  # a character of the vocabulary stands for a byte
    return UnitEncoder(lambda texts: [x.ids for x in t.encode_batch_fast(texts, add_special_tokens=False)], SPACES, lambda raw, off: rows_with(raw, off, ODD), width=width)


def _encode(vocabulary: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        units, part, start = encoder(public_tokenizers.path(vocabulary) if "/" not in vocabulary else vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, j, ids, first in units.rows(batch.column(1)):
                ids = np.insert(ids, first[1:], end)
                first = first + np.arange(j - i + 1)
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(j - i, part, np.int32)), batch.column(0).slice(i, j - i), pa.array(start + first[:-1]), pa.array(n), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))],
                    ["part", "doc_id", "local_start", "n_tokens", "ids"],
                )
                start += int(first[-1])

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write each document's ids and the end id. vocabulary: a name of public_tokenizers, or a path on every executor."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(parts, "doc_id", tie).sortWithinPartitions("doc_id", tie)
    dealt.mapInArrow(_encode(vocabulary, end), SCHEMA).write.options(**ORC).orc(f"{path}/tokens")
    totals = docs.sparkSession.read.schema(SCHEMA).orc(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals.select("part", before.alias("before")).coalesce(1).write.orc(f"{path}/starts")  # as many rows as shuffle partitions


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids. A filter on doc_id is pushed to the files' statistics and Bloom filters."""
    rows, starts = spark.read.schema(SCHEMA).orc(f"{path}/tokens"), spark.read.schema("part int, before long").orc(f"{path}/starts")
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        flat, off = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        crc = [zlib.crc32(flat[off[r] : off[r + 1]].tobytes()) for r in range(len(lists))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op2_token_output(spark, sf_dir: str) -> DataFrame:
    """Every document's place in the files and the checksum of the ids read from them."""
    path = common.scratch_path(spark, "tokens")
    write_tokens(common.table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path).mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
