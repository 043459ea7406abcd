"""Exact n-gram Jaccard join as a metric-space join: pivots, regions with replicated boundaries, recursion.

Jaccard distance d = 1 - J is a metric, but unrelated texts are all at distance 1 from one another, so regions
around a few pivots would have to hold every text. Regions are therefore drawn around many pivots, and only texts
that can have a neighbour there enter them:

* Texts with equal shingle sets form a class; one text stands for it (copies never meet one another).
* Every shingle is a cell. A set of n enters the cells of its first floor((1-t)n)+l(n) shingles, l(n) = floor(n/20)+1,
  in an order that all texts share (frequent shingles last, else by hash): two sets with J >= t always share at least
  min(l(n), l(n')) of these cells. A text with fewer shared cells than any neighbour would give it has none and goes.
  A cell's pivot is its smallest id. The region of pivot p is every text that shares a cell with p as pivot: a text
  near the boundary of several regions is replicated into each of them.
* A region of at most BLOCK texts is joined in one task, exactly, by counting common shingles.
* A larger region is dealt into blocks, each with a copy of the pivot. Texts within 1-t of the pivot are linked to
  it and need no comparison with one another. While many are left, some of them become the next pivots of the region,
  and are compared with the texts that the triangle inequality allows: |d(x,p)-d(q,p)| <= 1-t (recursion).
  What is left after that is compared block by block with the texts in reach, by rings of d(x,p) one window wide.

Links are kept as a spanning forest, so no group emits all of its pairs, and components come from components.py.

Defined results: null or empty text: no shingle, linked with nothing. Rows with the same id are one node of the link
graph. A null id takes the component of the texts equal to its own (null if all their ids are null). Every input row
gives one row. Other columns are ignored. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bytesops import mix, shingle_sets
from .common import save
from .components import components

#: Texts that are compared with one another in one task.
BLOCK = 256
#: Shingles that come last in the order of prefixes: at most so many, seen at least so often. This only orders; nothing is left out.
HOT_SHINGLES, HOT_COUNT = 1 << 17, 64
#: A prefix is longer by n/SLACK, so that neighbours share more than one cell.
SLACK = 20
#: Times that up to PIVOTS more pivots are tried in a region with more than CROWD texts left, before these are compared block by block.
DEPTH, PIVOTS, CROWD = 3, 16, 2048


def needed(n: np.ndarray, pct: int) -> np.ndarray:
    """Least number of shingles that a set of n shares with a neighbour."""
    return (pct * n + 99) // 100


def _digests(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids, rows, fresh = batch.column(0).to_pylist(), [], []
            with np.errstate(over="ignore"):
                for r, s in shingle_sets(batch.column(1), size):
                    m = mix(s)
                    a, b = m.sum(dtype=np.uint64), (mix(m) * (s | np.uint64(1))).sum(dtype=np.uint64)
                    rows.append((ids[r], len(s), a, b))
                    if len(s) and int(a) not in seen:
                        seen.add(int(a))
                        fresh.append(s)
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * len(rows), pa.int32()), pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array(np.array([x[2] for x in rows], np.uint64).view(np.int64)), pa.array(np.array([x[3] for x in rows], np.uint64).view(np.int64))],
                ["kind", "id", "n", "k1", "k2"],
            )
            if len(seen) > 200_000:
                seen.clear()
            if fresh:
                h, c = np.unique(np.concatenate(fresh), return_counts=True)
                often = c >= max(4, len(fresh) // 2000)
                h, c = h[often], c[often]
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), np.int32)), pa.array(h.view(np.int64)), pa.array(c.astype(np.int64)), pa.nulls(len(h), pa.int64()), pa.nulls(len(h), pa.int64())], ["kind", "id", "n", "k1", "k2"])

    return run


def _prefixes(size: int, pct: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = hot.value
        for batch in batches:
            ids, out_ids, least, cells, ends = batch.column(0).to_pylist(), [], [], [], [0]
            for r, s in shingle_sets(batch.column(1), size):
                if ids[r] is None or not len(s):
                    continue
                k = len(s) - int(needed(len(s), pct)) + 1 + len(s) // SLACK
                if len(last):
                    frequent = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                    s = np.concatenate([s[~frequent], s[frequent]])
                cells.append(s[:k])
                out_ids.append(ids[r])
                least.append(int(needed(len(s), pct)) // SLACK + 1)
                ends.append(ends[-1] + len(cells[-1]))
            flat = np.concatenate(cells) if cells else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), pa.array(least, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))], ["node", "least", "cells"])

    return run


class Index:
    """Inverted index over the sets of a block: common shingles of one set with all sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.keys, self.owner = flat[order], np.repeat(np.arange(len(sets)), self.n)[order]

    def common(self, s: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.keys, s, "left"), np.searchsorted(self.keys, s, "right")
        m = hi - lo
        at = np.repeat(hi - np.cumsum(m), m) + np.arange(m.sum())
        return np.bincount(self.owner[at], minlength=len(self.n))

    def near(self, s: np.ndarray, pct: int) -> np.ndarray:
        both = self.common(s)
        return 100 * both >= pct * (self.n + len(s) - both)


def forest(nodes: list[int], sets: list[np.ndarray], pct: int) -> list[tuple[int, int]]:
    """Links that connect what is connected among the sets: a breadth-first search over all links."""
    index, open_, links = Index(sets), np.ones(len(sets), bool), []
    for root in range(len(sets)):
        if not open_[root]:
            continue
        open_[root], queue = False, [root]
        while queue and open_.any():
            i = queue.pop()
            found = np.flatnonzero(index.near(sets[i], pct) & open_)
            open_[found] = False
            queue += found.tolist()
            links += [(nodes[i], nodes[j]) for j in found]
    return links


def _groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of each block in turn: key columns p, block; then (node, role, label, set). Batches are sorted by the key."""
    key, rows = None, []
    for batch in batches:
        c = {k: batch.column(k).to_pylist() for k in ("p", "block", "node", "role", "label")}
        for r, s in shingle_sets(batch.column("text"), size):
            now = (c["p"][r], c["block"][r])
            if now != key:
                if rows:
                    yield key, rows
                key, rows = now, []
            rows.append((c["node"][r], c["role"][r], c["label"][r], s))
    if rows:
        yield key, rows


def _joined(size: int, pct: int):
    """Roles: 0 text of a small region, 1 first pivot of a region, 2 text of a large region, 3 query, 4 text that queries are held against, 5 one of several later pivots."""

    def block(p: int, rows: list[tuple]) -> Iterator[tuple]:
        roles = {r[1] for r in rows}
        if 0 in roles:
            for a, b in forest([r[0] for r in rows], [r[3] for r in rows], pct):
                yield a, b, 0, None
        elif 5 in roles:
            pivots, rest = [r for r in rows if r[1] == 5], [r for r in rows if r[1] == 2]
            index, first = Index([r[3] for r in rest]), np.full(len(rest), -1)
            for k, x in enumerate(pivots):
                near = index.near(x[3], pct)
                met = np.flatnonzero(near & (first >= 0))
                for m in np.unique(first[met]):  # these pivots and this one share a neighbour
                    yield pivots[m][0], x[0], 0, None
                for j in np.flatnonzero(near & (first < 0)):
                    first[j] = k
                    if rest[j][0] != x[0]:
                        yield x[0], rest[j][0], 0, None
        elif 1 in roles:
            pivot, rest = next(r for r in rows if r[1] == 1), [r for r in rows if r[1] == 2]
            index = Index([r[3] for r in rest])
            both = index.common(pivot[3])
            union = index.n + len(pivot[3]) - both
            for r, c, u in zip(rest, both.tolist(), union.tolist()):
                yield pivot[0], r[0], 0 if 100 * c >= pct * u else 1, 1 - c / u if u else 1.0
        else:
            held = [r for r in rows if r[1] == 4]
            index = Index([r[3] for r in held])
            for x in rows:
                if x[1] == 3:
                    met = {x[2]}
                    for j in np.flatnonzero(index.near(x[3], pct)):
                        if held[j][2] not in met:
                            met.add(held[j][2])
                            yield x[0], held[j][0], 0, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (p, _), rows in _groups(batches, size):
            out += [(p, *x) for x in block(p, rows)]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_pylist([dict(zip(("p", "a", "b", "kind", "d"), x)) for x in out], schema=_OUT)
                out = []
        yield pa.RecordBatch.from_pylist([dict(zip(("p", "a", "b", "kind", "d"), x)) for x in out], schema=_OUT)

    return run


_OUT = pa.schema([("p", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("kind", pa.int32()), ("d", pa.float64())])


def _run(blocks: DataFrame, size: int, pct: int) -> DataFrame:
    """blocks: p, block, node, role, label, text."""
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.select("p", "block", "node", "role", "label", "text").repartition(parts, "p", "block").sortWithinPartitions("p", "block")
    return save(dealt.mapInArrow(_joined(size, pct), "p long, a long, b long, kind int, d double"), "joined")


def _dealt(members: DataFrame, block: int) -> DataFrame:
    """members: p, node. Adds the region's number of blocks and the block of each member."""
    counts = members.groupBy("p").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > block).select("p", F.ceil(F.col("m") / block).cast("int").alias("more"))
    # only regions of more than a block, so members of a hot pivot are not moved to it
    counts = save(counts, "counts")
    counts = F.broadcast(counts) if common.small(counts, 32) else counts
    dealt = members.join(counts, "p", "left").withColumn("blocks", F.coalesce("more", F.lit(1))).drop("more")
    return dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def _with_text(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (saved, with node) with the node's text: a broadcast where rows, counted, are small, else a shuffled join."""
    rows = F.broadcast(rows) if common.small(rows, 64) else rows
    return docs.select(F.col("id").alias("node"), "text").join(rows, "node")


def _large(members: DataFrame, links: DataFrame, size: int, pct: int) -> DataFrame:
    """More links of large regions. members (saved): p, node, text, d (distance to the pivot)."""
    window = 1 - pct / 100 + 1e-9
    tags = members.select("p", "node", "d", F.when(F.col("d") <= window, F.col("p")).otherwise(F.col("node")).alias("label"))
    regions = tags.where("node = p").count()
    few = F.broadcast if regions * PIVOTS * 64 <= common.BROADCAST_BYTES else lambda df: df  # noqa: E731  tables with a row for each region, pivot or ring
    rest = tags.where("label <> p")
    for _ in range(DEPTH):
        crowded = rest.groupBy("p").count().where(F.col("count") > CROWD).select("p")
        picked = rest.join(few(crowded), "p").groupBy("p", F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("i")).agg(F.min(F.struct("node", "d")).alias("q"))
        picked = save(picked.select("p", F.col("q.node").alias("q"), F.col("q.d").alias("qd")), "pivots")
        if picked.isEmpty():
            break
        reach = picked.groupBy("p").agg((F.min("qd") - window).alias("lo"), (F.max("qd") + window).alias("hi"))
        ours = _dealt(members.join(few(reach), "p").where("d between lo and hi").select("p", "node", "text"), BLOCK)
        blocks = ours.groupBy("p").agg(F.max("blocks").alias("blocks"))
        pivots = members.join(few(picked.select("p", F.col("q").alias("node"))), ["p", "node"]).join(few(blocks), "p").select("p", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "node", "text")
        flat = lambda df, role: df.select("p", "block", "node", F.lit(role).alias("role"), F.lit(None).cast("long").alias("label"), "text")
        found = _run(flat(ours, 2).unionByName(flat(pivots, 5)), size, pct).where("kind = 0").select("p", F.col("a").alias("q"), F.col("b").alias("node"))
        links = links.unionByName(found.select(F.col("q").alias("a"), F.col("node").alias("b")))
        # pivots that touch the core bring all that they hold into it; a pivot itself has met every text in reach
        touch = found.join(tags.where("label = p").select("p", "node"), ["p", "node"]).select("p", "q").distinct()
        held = found.join(few(touch), ["p", "q"]).select("p", "node")
        rest = save(rest.join(held.unionByName(picked.select("p", F.col("q").alias("node"))).distinct(), ["p", "node"], "left_anti"), "rest")
    if rest.isEmpty():
        return links
    ring = lambda d: F.floor(F.col(d) / window).cast("int")
    half = BLOCK // 2
    queries = rest.select("p", "node", "label", F.explode(F.array(ring("d") - 1, ring("d"), ring("d") + 1)).alias("ring"))
    held = tags.join(few(rest.select("p").distinct()), "p", "left_semi").withColumn("ring", ring("d"))
    size_of = queries.groupBy("p", "ring").agg(F.ceil(F.count(F.lit(1)) / half).cast("int").alias("qs")).join(held.groupBy("p", "ring").agg(F.ceil(F.count(F.lit(1)) / half).cast("int").alias("hs")), ["p", "ring"])
    name = F.concat_ws("-", "ring", "i", "j")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    texts = members.select("p", "node", "text")
    q = queries.join(few(size_of), ["p", "ring"]).withColumn("i", mine("qs")).join(texts, ["p", "node"]).withColumn("j", spread("hs")).select("p", name.alias("block"), "node", F.lit(3).alias("role"), "label", "text")
    h = held.join(few(size_of), ["p", "ring"]).withColumn("j", mine("hs")).join(texts, ["p", "node"]).withColumn("i", spread("qs")).select("p", name.alias("block"), "node", F.lit(4).alias("role"), "label", "text")
    return links.unionByName(_run(q.unionByName(h), size, pct).where("kind = 0").select("a", "b"))


def frequent_shingles(counts: DataFrame) -> np.ndarray:
    """Sorted hashes of the most frequent shingles, HOT_SHINGLES at most (1 MB); counts: id (a hash), n."""
    hot = counts.groupBy(F.col("id").alias("h")).agg(F.sum("n").alias("c")).where(F.col("c") >= HOT_COUNT).orderBy(F.desc("c"), "h").limit(HOT_SHINGLES)
    return np.sort(np.array([r.h for r in hot.collect()], np.int64).view(np.uint64))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pct: int = 80, size: int = 5) -> DataFrame:
    """One row per input row: id, n_shingles, component (smallest id reachable by links of J >= pct/100), representative (smallest id with an equal shingle set)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = save(docs.mapInArrow(_digests(size), "kind int, id long, n long, k1 long, k2 long"), "digests")
    rows = made.where("kind = 0").select("id", "n", "k1", "k2")
    last = spark.sparkContext.broadcast(frequent_shingles(made.where("kind = 1")))
    classes = save(rows.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("id").alias("rep")), "classes")
    reps = classes.where("rep is not null").select(F.col("rep").alias("node")).distinct()
    pre = save(docs.mapInArrow(_prefixes(size, pct, last), "node long, least int, cells array<long>").join(reps, "node", "left_semi"), "prefixes")
    memb = pre.select("node", F.explode("cells").alias("s"))
    pivot_of = lambda m: m.groupBy("s").agg(F.min("node").alias("p"), F.max("node").alias("q")).where("p <> q").select("s", "p")
    shared = save(memb.join(pivot_of(memb), "s").select("s", "node"), "shared")
    able = pre.groupBy("node").agg(F.min("least").alias("least")).join(shared.groupBy("node").agg(F.countDistinct("s").alias("c")), "node").where("c >= least").select("node")
    shared = save(shared.join(able, "node"), "able")
    regions = save(shared.join(pivot_of(shared), "s").where("node <> p").select("p", "node").distinct(), "regions")
    ours = _dealt(regions, BLOCK)
    pivots = ours.groupBy("p").agg(F.max("blocks").alias("blocks")).select("p", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("p").alias("node"))
    role = lambda k: F.when(F.col("blocks") == 1, 0).otherwise(k)
    plan = save(ours.select("p", "block", "node", role(2).alias("role")).unionByName(pivots.select("p", "block", "node", role(1).alias("role"))), "plan")
    joined = _run(_with_text(docs, plan).withColumn("label", F.lit(None).cast("long")), size, pct)
    links = joined.where("kind = 0").select("a", "b")
    large = joined.where("d is not null").select("p", F.col("b").alias("node"), "d")
    if not large.isEmpty():
        large = save(large.unionByName(large.select("p").distinct().select("p", F.col("p").alias("node"), F.lit(0.0).alias("d"))).distinct(), "large")
        members = save(_with_text(docs, large).dropDuplicates(["p", "node"]), "members")
        links = _large(members, links, size, pct)
    label = components(links)
    known = classes.join(label, classes.rep == label.node, "left").select("k1", "k2", "n", "rep", F.coalesce("component", "rep").alias("component"))
    same = lambda k: rows[k].eqNullSafe(known[k])
    known = known.withColumnRenamed("n", "size")
    return rows.join(known, (rows.k1 == known.k1) & (rows.k2 == known.k2) & (rows.n == known["size"]), "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"), F.coalesce("rep", "id").alias("representative"))


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every document's shingle count and component of texts that link at 80 % or more."""
    return jaccard_classes(common.table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "representative")


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{common.UPPER}', '{common.LOWER}'), '[^\x20\x09-\x0D]+')"


#: All links by a join on shared shingles, components by a recursive walk; for small tables.
ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_words("text")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE [array_to_string(ws[i:i+4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT md5(string_agg(g, chr(10) ORDER BY g)) AS k, doc_id FROM s GROUP BY doc_id),
r AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS rep FROM c),
f AS (SELECT s.doc_id, g FROM s JOIN r ON r.doc_id = s.doc_id AND r.rep = s.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_n FROM f a JOIN f b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * both_n >= 80 * (nx.n + ny.n - both_n)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
walk AS (SELECT rep AS a, rep AS b FROM r WHERE rep = doc_id UNION SELECT walk.a, e.y FROM walk JOIN e ON walk.b = e.x),
comp AS (SELECT a, min(b) AS component_id FROM walk GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(comp.component_id, d.doc_id) AS component_id, coalesce(r.rep, d.doc_id) AS representative
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN comp ON comp.a = r.rep
"""
