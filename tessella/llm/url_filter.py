"""URL filter: a Bloom filter cascade over the corpus's complete key universe, with host and path rules before it.

The first level encodes the listed keys. The second encodes the keys of the universe that the first lets through
though they are not listed, the third the listed keys that the second lets through, and so on until no false positive
is left. The first level that lacks a key tells whether it is listed: exactly, for each key of the universe, and
without a join on the rows that are judged.

Level 1 has a false positive rate of about listed / unlisted keys (at most 1/2), so level 2 is no larger than level 1,
and each later level has a rate of 1/8 and shrinks by that: some 1.44 * log2(unlisted / listed) + 8 bits for each
listed key in all. A level is one array of 64-bit words in a one-row table of the shared folder, read by a scalar
subquery, so it is sent to each executor once and never broadcast with the rows. The universe is split by hash into
as many shards as keep all levels of a shard under LEVEL_BYTES; each shard has its own cascade and judges its own rows.

Defined results: null or malformed urls have an empty host and path, which no rule fits and no list holds: allow. Equal
urls are judged alike, row by row. An empty list allows all, a list without an unlisted key blocks all its hosts. Extra
columns pass through unchanged; where one has an added name, a prefix for these has to be given (else ValueError).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import ascii_lower, save

#: (host, path, verdict): a rule fits its host and all subdomains if the path starts with the rule's; the longest wins.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
LEVEL_BYTES = 32 << 20
LATER_RATE = 1 / 8


def host_path(url: Column) -> tuple[Column, Column]:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; then up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as a string, and its verdict; nulls if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _bits(n: int, rate: float) -> tuple[int, int]:
    """Words and hashes of a Bloom filter for n keys."""
    bits = max(64, math.ceil(1.44 * n * math.log2(1 / rate)))
    return -(-bits // 64), max(1, round(math.log2(1 / rate)))


def _place(key: Column, level: int, words: int, i: int) -> Column:
    """Bit of the i-th hash: double hashing with a seed for each level."""
    h, step = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 48)) for seed in (level, -level - 1))
    return F.pmod(h + F.lit(i) * step, F.lit(words * 64).cast("long"))


def _build(keys: DataFrame, level: int, words: int, hashes: int) -> DataFrame:
    """A one-row table with the level's words, in order."""
    at = keys.select(F.explode(F.array(*[_place(F.col("key"), level, words, i) for i in range(hashes)])).alias("at"))
    one = at.select(F.expr("at div 64").alias("i"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("w"))
    every = keys.sparkSession.range(words).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("w"))
    filled = one.groupBy("i").agg(F.bit_or("w").alias("w")).unionByName(every).groupBy("i").agg(F.bit_or("w").alias("w"))
    packed = filled.agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("x"))
    return save(packed.select(F.transform("x", lambda x: x["w"]).alias("words")), "level")


class Cascade:
    """levels: (table of words, words, hashes); has(key) is exact for the universe it was built over."""

    def __init__(self, levels: list[tuple[DataFrame, int, int]]):
        self.levels = levels

    def passes(self, key: Column, level: int) -> Column:
        table, words, hashes = self.levels[level]
        held = table.scalar()
        out = F.lit(True)
        for i in range(hashes):
            at = _place(key, level, words, i)
            out = out & (F.getbit(F.get(held, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1)
        return out

    def has(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(~self.passes(key, level), F.lit(level % 2 == 1)).otherwise(out)
        return out


def cascade(universe: DataFrame) -> Cascade:
    """universe: distinct keys and whether each is listed (saved)."""
    listed, other = universe.where("listed").select("key"), universe.where("not listed").select("key")
    counts = universe.agg(F.count_if("listed").alias("l"), F.count_if(~F.col("listed")).alias("u")).first()
    levels: list[tuple[DataFrame, int, int]] = []
    ours, n, rate = listed, counts.l, min(0.5, max(counts.l, 1) / max(counts.u, 1))
    while n:
        words, hashes = _bits(n, rate)
        levels.append((_build(ours, len(levels), words, hashes), words, hashes))
        wrong = save(other.where(Cascade(levels).passes(F.col("key"), len(levels) - 1)), "wrong")
        other, ours, n, rate = ours, wrong, wrong.count(), LATER_RATE
    return Cascade(levels)


def universe_of(hosts: DataFrame, listed: DataFrame) -> DataFrame:
    """Distinct non-empty hosts of the corpus (column host) and whether one, or a domain above it, is in listed (column key)."""
    keys = hosts.where("host <> ''").select(F.col("host").alias("key")).distinct()
    parts = F.split("key", r"\.")
    above = keys.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("name"))
    hit = above.join(listed.select(F.col("key").alias("name")).distinct(), "name").select("key").distinct().withColumn("hit", F.lit(True))
    return save(keys.join(hit, "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("listed")), "universe")


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES, url_col: str = "url", prefix: str = "") -> DataFrame:
    """pages with host, path, rule, listed and verdict, all under the prefix. listed: a table of hosts (column key), each of which stands for its subdomains too."""
    added = [prefix + c for c in ("host", "path", "rule", "listed", "verdict")]
    clash = sorted({c.lower() for c in pages.columns} & {c.lower() for c in added})
    if clash:
        raise ValueError(f"columns {', '.join(clash)} are there already: give a prefix")
    host, path = host_path(F.col(url_col))
    hosts = pages.select(F.coalesce(host, F.lit("")).alias("host"))
    universe = universe_of(hosts, listed)
    size = universe.agg(F.count_if("listed").alias("l"), F.count(F.lit(1)).alias("n")).first()
    per_key = 1.44 * math.log2(max(2, size.n / max(size.l, 1))) + 8
    shards = max(1, math.ceil(size.l * per_key / 8 / LEVEL_BYTES))
    name, verdict = rule_of(F.coalesce(host, F.lit("")), F.coalesce(path, F.lit("")), rules)
    judged = pages.withColumns({f"{prefix}host": F.coalesce(host, F.lit("")), f"{prefix}path": F.coalesce(path, F.lit("")), f"{prefix}rule": name})
    key = F.col(f"{prefix}host")
    shard = F.pmod(F.xxhash64("key"), F.lit(shards))
    held = F.lit(False)
    for k in range(shards):  # the rows are read once: each shard's levels are scalars
        part = universe if shards == 1 else save(universe.where(shard == k), "shard")
        mine = cascade(part).has(key)
        held = mine if shards == 1 else F.when(F.pmod(F.xxhash64(key), F.lit(shards)) == k, mine).otherwise(held)
    judged = judged.withColumn(f"{prefix}listed", (key != "") & held)
    return judged.withColumn(f"{prefix}verdict", F.coalesce(verdict, F.when(F.col(f"{prefix}listed"), "block").otherwise("allow")))


#: Marks of junk in a page's title: a word that ends in three equal symbols.
JUNK_TITLE = r"<title>[^<]*(?:###|\*\*\*|\$\$\$|%%%|&&&)"


def junk_hosts(pages: DataFrame) -> DataFrame:
    """The list of the query: hosts with a page whose title is junk."""
    return pages.where(F.rlike("html", F.lit(JUNK_TITLE))).select(host_path(F.col("url"))[0].alias("key")).where("key <> ''").distinct()


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict; listed are the hosts of pages with junk titles."""
    pages = common.table(spark, sf_dir, "pages")
    return filter_urls(pages.select("page_id", "url"), junk_hosts(pages)).select("page_id", "host", "path", "rule", "verdict", "listed")


_REST = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
_FITS = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{{i}}}" for i, (h, p, v) in sorted(enumerate(RULES), key=lambda r: -len(r[1][0] + r[1][1])))
ORACLE = f"""
WITH r AS (SELECT page_id, html, coalesce({_REST}, '') AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*', 0), '{common.UPPER}', '{common.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
l AS (SELECT DISTINCT host AS key FROM p WHERE regexp_matches(html, '{JUNK_TITLE}') AND host <> ''),
b AS (SELECT DISTINCT h.host FROM (SELECT DISTINCT host FROM p) h JOIN l ON h.host = l.key OR ends_with(h.host, '.' || l.key)),
j AS (SELECT page_id, host, path, CASE {_FITS.format(*[f"'{h}{p}'" for h, p, _ in RULES])} END AS rule, CASE {_FITS.format(*[f"'{v}'" for _, _, v in RULES])} END AS v, host IN (SELECT host FROM b) AS listed FROM p)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM j"""
