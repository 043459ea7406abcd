"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item is found in a document if the document holds at least PCT percent of the item's distinct 5-word shingles
(lower case). Items are partitioned by size (powers of two). Each item keeps a bottom-k MinHash sketch whose k is
fitted to its partition: with q shingles, at most floor((1-t)q) may be missing, so of any floor((1-t)q)+1 of them at
least one is in every document that contains the item. The partition's largest q gives k, so candidate search over
the sketches misses nothing, however long the document is.

Sketch hashes meet the exploded shingle hashes of a document in a broadcast hash join. Of a document's hits on an item
only the smallest goes on (a test within the row), so a pair is verified once, without a shuffle: the document is
neither grouped nor moved, and a hot passage costs no more than its own rows. The benchmark is broadcast in blocks of a
measured size; a benchmark over the limit is searched block by block.

Defined results: null or empty texts hold nothing, and an empty item is never found. An item of fewer than five words
is one shingle, as is a short document. Equal item rows count once; repeated documents give a row each; a null id is
kept. Extra columns are ignored. An empty table on either side gives no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import let, words_of

PCT, SIZE = 80, 5


def _runs(words: Column, of) -> Column:
    """of(run) for every run of SIZE words, or for all words where there are fewer."""
    n = F.size(words)
    every = F.transform(F.sequence(F.lit(1), n - (SIZE - 1)), lambda i: of(F.slice(words, i, SIZE)))
    return F.when(n >= SIZE, every).when(n > 0, F.array(of(words)))


def _hashes(words: Column) -> Column:
    """Distinct 64-bit hashes of the words' shingles; null without words."""
    return F.array_distinct(let(F.transform(words, lambda w: F.xxhash64(w)), lambda wh: _runs(wh, F.xxhash64)))


def shingle_hashes(text: Column) -> Column:
    return _hashes(words_of(F.lower(text)))


def shingles(text: Column) -> Column:
    return F.array_distinct(let(words_of(F.lower(text)), lambda ws: _runs(ws, lambda run: F.array_join(run, " "))))


def _blocks(items: DataFrame) -> list[DataFrame]:
    """The items in parts of at most BROADCAST_BYTES each, by the measured size of what is broadcast."""
    size = items.agg(F.sum(F.octet_length("item_text")).alias("b")).first().b or 0
    n = -(-size * 2 * SIZE // common.BROADCAST_BYTES)  # a word is in SIZE shingles; hashes and sketches add less
    return [items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k) for k in range(n)] if n > 1 else [items]


def sketches(items: DataFrame, pct: int = PCT) -> DataFrame:
    """item, item_text -> item, shingles, n_item, sketch (bottom-k hashes, k by size partition)."""
    held = items.withColumn("hashes", F.array_sort(shingle_hashes(F.col("item_text")))).where("hashes is not null")
    largest = F.pow(F.lit(2), F.floor(F.log2(F.size("hashes"))) + 1) - 1  # of the item's partition
    k = F.floor(largest * (100 - pct) / 100).cast("int") + 1
    return held.select("item", shingles(F.col("item_text")).alias("shingles"), F.size("hashes").cast("long").alias("n_item"), F.slice("hashes", F.lit(1), k).alias("sketch"))


def contained_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", pct: int = PCT) -> DataFrame:
    """doc, item, n_item, n_shared for each document row and item that it contains."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("item_text")).distinct()
    both = lambda ws: F.struct(_hashes(ws).alias("hashes"), F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" ")).alias("words"))
    rows = docs.select(F.col(id_col).alias("doc"), let(words_of(F.lower(F.col(text_col))), both).alias("of")).select("doc", "of.hashes", "of.words")

    def search(block: DataFrame) -> DataFrame:
        sk = sketches(block, pct)
        keys = F.broadcast(sk.select("item", "sketch", F.explode("sketch").alias("h")))
        hits = rows.select("doc", "words", "hashes", F.explode("hashes").alias("h")).join(keys, "h")
        first = hits.where(F.array_min(F.array_intersect("hashes", "sketch")) == F.col("h")).select("doc", "words", "item")
        full = first.join(F.broadcast(sk.select(F.col("item").alias("of"), "shingles", "n_item")), F.col("item").eqNullSafe(F.col("of")))
        # word for word: a candidate shares a hash, so both have runs of SIZE words, or both are the same shorter run
        shared = F.size(F.filter("shingles", lambda g: F.contains(F.col("words"), F.concat(F.lit(" "), g, F.lit(" "))))).cast("long")
        return full.select("doc", "item", "n_item", shared.alias("n_shared")).where(100 * F.col("n_shared") >= pct * F.col("n_item"))

    return reduce(DataFrame.unionByName, [search(b) for b in _blocks(items)])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no item; the same columns. A row is known by its id and text, so null or repeated ids do no harm."""
    key = F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text"), F.coalesce(F.length("text"), F.lit(-1)))
    keyed = docs.withColumn("__key", key)
    found = contained_items(keyed.select("__key", "text"), benchmark, id_col="__key").select(F.col("doc").alias("__key")).distinct()
    return keyed.join(found, "__key", "left_anti").select(*docs.columns)


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every document."""
    found = contained_items(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_item", "n_shared")


def _sql_shingles(key: str, table: str) -> str:
    return rf"""SELECT DISTINCT {key}, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE [array_to_string(ws[i:i+4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS g
 FROM (SELECT {key}, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM {table})"""


#: Selects doc_id, item_id, n_item, n_shared for a relation {docs}.
FOUND = f"""
WITH b AS ({_sql_shingles("item_id", "benchmark")}), n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
s AS ({_sql_shingles("doc_id", "{docs}")})
SELECT doc_id, item_id, n_item, count(*) AS n_shared FROM s JOIN b USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= {PCT} * n_item"""
ORACLE = FOUND.format(docs="documents")
