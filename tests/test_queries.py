"""Every query with SQL against DuckDB on the smallest tables; the others give rows with a stable schema."""

import os

import pandas
import pytest

import __spark_entry__
from tessella.queries import ORACLE, QUERIES

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    text = lambda v: "null" if pandas.isna(v) else f"{v:.7g}" if isinstance(v, float) else str(v)
    return list(frame.columns), sorted(tuple(text(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, D).toPandas()) == rows(duck.sql(ORACLE[name]).df())


@pytest.mark.parametrize("name", ["breaks", "ftle_both", "cohort_geometry", "information_flow", "trajectory_library", "persistent_homology", "engines_typology", "engines_discrete"])
def test_runs(spark, name):
    df = QUERIES[name](spark, D)
    assert df.columns
    df.count()


LONG = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(LONG), reason="no test tables")
def test_ridge_proximity_reads_all_rows(spark):
    from tessella.sources import tables

    last = {r.cohort: r.t for r in tables.lineitem(spark, LONG).groupBy("cohort").agg({"signal_0": "max"}).toDF("cohort", "t").collect()}
    met = {r.cohort: r.t for r in QUERIES["ridge_proximity"](spark, LONG).groupBy("cohort").agg({"signal_0_end": "max"}).toDF("cohort", "t").collect()}
    assert max(last.values()) > 2000 and all(last[c] - t < 50 for c, t in met.items())


@pytest.mark.skipif(not os.path.isdir(LONG), reason="no test tables")
def test_information_flow_takes_whole_series(spark):
    from tessella.functions import series
    from tessella.sources import tables

    assert {r.n for r in QUERIES["information_flow"](spark, LONG).collect()} >= {2000}
    o = tables.lineitem(spark, LONG).where("cohort = 'AF' and signal_0 > 400").toPandas()
    a, b = sorted(set(o.signal_id))[:2]
    x, y = (o[o.signal_id == s].sort_values("signal_0")["value"].dropna().to_numpy(float) for s in (a, b))
    assert min(len(x), len(y)) > 2000
    got = QUERIES["information_flow_delta"](spark, LONG).where(f"cohort = 'AF' and signal_a = '{a}' and signal_b = '{b}' and way = 'ab'").collect()
    assert [r.f_b for r in got] == pytest.approx([series.granger(x, y)[0]])


def test_granger_links_by_parts(spark, monkeypatch):
    import numpy as np
    from tessella.functions import series
    from tessella.operators import grouped

    monkeypatch.setattr(grouped, "PART", 64)
    monkeypatch.setattr(grouped, "STACK", 2)
    r = np.random.default_rng(3)
    x, y = r.normal(50, 9, 1000), r.normal(size=777)
    y[1:] += x[-776:] / 20
    x[40], flat = np.nan, np.ones(300)
    rows = [("c", name, float(3 * i), float(v)) for name, s in (("x", x), ("y", y), ("z", flat), ("few", y[:60])) for i, v in enumerate(s)]
    got = {(g.signal_a, g.signal_b): g for g in grouped.granger_links(spark.createDataFrame(rows, "cohort string, signal_id string, signal_0 double, value double")).collect()}
    assert set(got) == {("x", "y"), ("x", "z"), ("y", "z")} and got["x", "z"].granger_f_ab is None
    a = x[np.isfinite(x)][-777:]
    g = got["x", "y"]
    assert [g.granger_f_ab, g.granger_p_ab, g.granger_f_ba, g.granger_p_ba] == pytest.approx([*series.granger(a, y), *series.granger(y, a)], rel=1e-7)


def test_homology_walks_all_windows(spark):
    from tessella.operators import grouped

    obs = spark.range(1000).selectExpr("'c' cohort", "explode(array('a', 'b')) signal_id", "cast(id as double) signal_0", "if(signal_id = 'a', sin(id), cos(id)) value")
    got = sorted(r.signal_0_end for r in grouped.homology(obs).collect())
    assert got == [float(e) for e in range(59, 1000, 30)]


def test_homology_of_few_or_no_rows(spark):
    from tessella.operators import grouped

    kind = "cohort string, signal_id string, signal_0 double, value double"
    assert grouped.homology(spark.createDataFrame([], kind)).count() == 0
    few = [(c, "a", float(i), None if c == "n" else float(i % 7)) for c, m in (("n", 90), ("short", 59), ("one", 60)) for i in range(m)]
    got = grouped.homology(spark.createDataFrame(few, kind)).collect()
    assert [(r.cohort, r.signal_0_end, r.n_loops) for r in got] == [("one", 59.0, 0)]


def test_homology_by_parts(spark, monkeypatch):
    import numpy as np
    from tessella.functions import series
    from tessella.operators import grouped

    monkeypatch.setattr(grouped, "PART", 100)
    monkeypatch.setattr(grouped, "WINDOWS", 3)
    monkeypatch.setattr(grouped, "_cohorts", lambda *a: pytest.fail("a cohort in one task"))
    r = np.random.default_rng(8)
    x, y, z = r.normal(5, 2, 400), r.normal(size=400).cumsum(), np.full(400, np.nan)
    x[90:310], x[0], y[-3:], z[7] = np.nan, np.inf, np.nan, 1.0  # a gap over ranges, gaps at both ends, a single number
    rows = [("c", n, 1.0 * i, float(v)) for n, v in (("x", x), ("y", y), ("z", z)) for i, v in enumerate(v) if v == v]
    got = {g.signal_0_end: g for g in grouped.homology(spark.createDataFrame(rows, "cohort string, signal_id string, signal_0 double, value double")).collect()}
    m = np.column_stack([series.interpolate(v) for v in (x, y, z)])
    m = (m - m.mean(0)) / np.maximum(m.std(0), 1e-12)
    assert sorted(got) == [float(e) for e in range(59, 400, 30)]
    for e, g in got.items():
        want = series.homology(m[int(e) - 59 : int(e) + 1])
        assert (g.n_loops, g.max_persistence_h0, g.max_persistence_h1, g.persistence_entropy) == pytest.approx(tuple(want[c] for c in ("n_loops", "max_persistence_h0", "max_persistence_h1", "persistence_entropy")))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert set(ORACLE) <= set(__spark_entry__.queries())
