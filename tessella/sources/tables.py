"""Observations (cohort, signal_id, signal_0, value) from files and from the benchmark tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OBSERVATIONS = "cohort string, signal_id string, signal_0 double, value double"


def load_observations(spark: SparkSession, path: str) -> DataFrame:
    """Long-format Parquet; a missing cohort column becomes one cohort."""
    df = spark.read.parquet(path)
    cohort = F.col("cohort").cast("string") if "cohort" in df.columns else F.lit("all")
    return df.select(cohort.alias("cohort"), F.col("signal_id").cast("string"), F.col("signal_0").cast("double"), F.col("value").cast("double"))


def load_turbofan(spark: SparkSession, path: str, sensors: int = 21) -> DataFrame:
    """Space-separated run-to-failure text (unit, cycle, three settings, sensors) in long format."""
    parts = F.split(F.trim("value"), r"\s+")
    names = ["op1", "op2", "op3", *[f"s{i}" for i in range(1, sensors + 1)]]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("signal_id"), F.get(parts, F.lit(i + 2)).cast("double").alias("value")) for i, n in enumerate(names)]))
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(parts, F.lit(0)).alias("cohort"), F.get(parts, F.lit(1)).cast("double").alias("signal_0"), pairs.alias("x")).select("cohort", "x.signal_id", "signal_0", "x.value")


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """One number a line; line i belongs to cohort i."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.trim("value"), r"\s*\n\s*"))).select((F.col("pos") + 1).cast("string").alias("cohort"), F.col("col").cast("int").alias("rul"))


def load_manifest(text: str) -> dict:
    """A manifest in YAML where a parser is present, else JSON."""
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


class Catalog:
    """Named outputs below one folder, with column metadata kept in the files."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, metadata: dict[str, dict] | None = None) -> None:
        """Frames without columns are skipped; those without rows keep their schema."""
        if df.columns:
            df.select(*[F.col(c).alias(c, metadata=(metadata or {}).get(c, {})) for c in df.columns]).write.mode("overwrite").parquet(self.path(name))

    def sidecar(self, df: DataFrame, parent: str, suffix: str, metadata: dict[str, dict] | None = None) -> None:
        self.write(df, f"{parent}_{suffix}", metadata)

    def read(self, name: str) -> DataFrame | None:
        """None where there is no such output."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return None
        return self.spark.read.parquet(self.path(name))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types are cohorts, users modulo four signals, ids the coordinate."""
    e = _read(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("cohort"), F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")).alias("signal_id"), F.col("event_id").cast("double").alias("signal_0"), "value")


EVENTS = "SELECT event_type AS cohort, 'u' || (user_id % 4)::VARCHAR AS signal_id, event_id::DOUBLE AS signal_0, value FROM events"


def numbered(df: DataFrame, keys: list[str], bucket: str, order: list[str], name: str = "n") -> DataFrame:
    """df with each row's place, from 1, in its group's order, which the bucket leads and the columns of order complete.

    Rows are numbered within (group, bucket), and the rows of the buckets before are added from a table of counts: a group that holds
    a third of all rows is sorted in as many parts as it has buckets, not in one task."""
    held = [*keys, bucket]
    counts = df.groupBy(*held).agg(F.count(F.lit(1)).alias("__size"))
    earlier = F.sum("__size").over(Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))  # a row for each bucket
    counts = counts.select(*[F.col(c).alias(f"__{c}") for c in held], F.coalesce(earlier, F.lit(0)).alias("__before"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in held]
    placed = df.withColumn("__place", F.row_number().over(Window.partitionBy(*held).orderBy(*order)))
    return placed.join(counts, same).withColumn(name, (F.col("__before") + F.col("__place")).cast("double")).drop("__place", "__before", *[f"__{c}" for c in held])


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four aligned signals for each (return flag, line status): rows numbered in a total order that ship date leads."""
    li = _read(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("cohort"), *TOTAL)
    pairs = ", ".join(f"'{s}', l_{s}" for s in SIGNALS)
    return numbered(li, ["cohort"], TOTAL[0], TOTAL[1:], "signal_0").selectExpr("cohort", "signal_0", f"stack({len(SIGNALS)}, {pairs}) AS (signal_id, value)").select("cohort", "signal_id", "signal_0", "value")


#: A total order: order and line numbers repeat.
TOTAL = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SIGNALS = ("quantity", "extendedprice", "discount", "tax")
_WIDE = f"SELECT l_returnflag || l_linestatus AS cohort, row_number() OVER (PARTITION BY l_returnflag || l_linestatus ORDER BY {", ".join(TOTAL)})::DOUBLE AS signal_0, * FROM lineitem"
LINEITEM = " UNION ALL ".join(f"SELECT cohort, '{s}' AS signal_id, signal_0, l_{s} AS value FROM ({_WIDE})" for s in SIGNALS)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", "o_orderdate", "o_orderkey", "o_totalprice")
    n = numbered(o, ["o_orderpriority", "o_orderstatus"], "o_orderdate", ["o_orderkey"], "signal_0")
    return n.select(F.col("o_orderpriority").alias("cohort"), F.col("o_orderstatus").alias("signal_id"), "signal_0", F.col("o_totalprice").alias("value"))


ORDERS = "SELECT o_orderpriority AS cohort, o_orderstatus AS signal_id, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderdate, o_orderkey)::DOUBLE AS signal_0, o_totalprice AS value FROM orders"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two aligned signals for each brand, in order of the part's key."""
    p = _read(spark, sf_dir, "part")
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("signal_id"), F.col(f"p_{n}").cast("double").alias("value")) for n in ("retailprice", "size")]))
    return p.select(F.col("p_brand").alias("cohort"), F.col("p_partkey").cast("double").alias("signal_0"), pairs.alias("x")).select("cohort", "x.signal_id", "signal_0", "x.value")


#: The same rows, signals side by side: a and b.
PARTS_WIDE = "SELECT p_brand AS cohort, p_partkey::DOUBLE AS signal_0, p_retailprice::DOUBLE AS a, p_size::DOUBLE AS b FROM part"
