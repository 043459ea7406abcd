"""Proportional stratified interleaving: every shard holds the corpus's mixture of sources.

Rows are ranked within their source in a seeded shuffle (the order of a hash of seed and row). Row number r (from 0) of a
source with n rows gets the fractional rank (r + 1/2) / n; in the order of fractional ranks the sources are interleaved
in proportion, and cuts at equal row counts give shards whose counts are at most one apart (law `rows`) and hold of each
source within one row of its share.

Both orders are range partitions with a sort inside: a source of any size is spread over as many partitions as it needs.
Ranks come from row numbers within partitions and one offset for each partition and source in it, of which there are at
most partitions + sources. Only ids, hashes and sizes are moved, never texts.

Defined results: a null source is a stratum of its own. Null or empty texts have size 1. A null id is a row as any
other. Equal rows tie in the shuffle and are numbered in any order, which gives equal rows in any case. Extra columns
are ignored. With fewer rows than shards some shards are empty. Copies are rows like others; no law keeps them together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import save

SHARDS, SEED = 8, "20240229"


def _numbered(df: DataFrame, order: list[Column], group: str | None = None) -> DataFrame:
    """df with __n, its place from 0 in the order (within its group, which leads the order)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    held = save(dealt.withColumn("__at", at).withColumns({"__part": F.shiftright("__at", 33), "__row": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__at"), "ranged")
    keys = ["__part", *([group] if group else [])]
    runs = held.groupBy(*keys).agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__size"))
    window = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    if group:
        window = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = save(runs.withColumn("__before", F.coalesce(F.sum("__size").over(window), F.lit(0))).withColumnsRenamed({k: f"{k}__r" for k in keys}), "runs")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}__r"))
    runs = F.broadcast(runs) if common.small(runs, 64) else runs
    out = held.join(runs, same)
    return out.withColumn("__n", F.col("__before") + F.col("__row") - F.col("__first")).drop("__part", "__row", "__first", "__size", "__before", *[f"{k}__r" for k in keys])


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, source, shard, slot for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("shuffle"),
    )
    ranked = _numbered(rows, [F.col("source"), F.col("shuffle"), F.col("doc_id"), F.col("text_crc32"), F.col("size")], "source").withColumnRenamed("__n", "rank")
    counts = save(rows.groupBy(F.col("source").alias("__source")).agg(F.count(F.lit(1)).alias("n")), "counts")
    ranked = ranked.join(F.broadcast(counts) if common.small(counts, 64) else counts, F.col("source").eqNullSafe(F.col("__source")))
    ranked = ranked.withColumn("fraction", (F.col("rank") + 0.5) / F.col("n")).drop("__source", "n", "rank")
    placed = _numbered(ranked, [F.col("fraction"), F.col("source"), F.col("shuffle"), F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    total = counts.agg(F.sum("n")).first()[0] or 1
    shard = F.expr(f"cast(__n * {shards} div {total} as int)")
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")  # least n with n * shards div total = shard
    return placed.withColumn("shard", shard).withColumn("slot", (F.col("__n") - first).cast("long")).select("doc_id", "size", "text_crc32", "source", "shard", "slot")


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", **options) -> None:
    """The documents as Parquet, a folder for each shard with its rows in slot order within each file. Ids are unique and not null here."""
    placed = interleave(docs, id_col=id_col, **options).select(F.col("doc_id").alias(id_col), "shard", "slot")
    joined = docs.join(placed, id_col)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under the law `rows`."""
    out = interleave(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


#: The table of the CRC-32 polynomial, made bit by bit, and the checksum of a row's bytes (column h: hex digits) by it.
_CRC = """t(i, k, c) AS (SELECT i, 0, i::UBIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END FROM t WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS l FROM t WHERE k = 8)"""
_SUM = "xor(list_reduce(list_prepend(4294967295::UBIGINT, [('0x' || x)::UBIGINT FOR x IN regexp_extract_all(h, '..')]), lambda a, b: xor(a // 256, tab.l[(xor(a % 256, b) + 1)::INT])), 4294967295::UBIGINT)::BIGINT"
ORACLE = f"""
WITH RECURSIVE {_CRC},
r AS (SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size, {_SUM} AS text_crc32, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS shuffle FROM (SELECT *, hex(encode(coalesce(text, ''))) AS h FROM documents), tab),
k AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY shuffle, doc_id NULLS FIRST, text_crc32, size) - 1 + 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS fraction FROM r),
n AS (SELECT *, row_number() OVER (ORDER BY fraction, source NULLS FIRST, shuffle, doc_id NULLS FIRST, text_crc32, size) - 1 AS n, count(*) OVER () AS total FROM k),
s AS (SELECT *, n * {SHARDS} // total AS shard FROM n)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, shard::INT AS shard, (n - (shard * total + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard, source FROM s"""
