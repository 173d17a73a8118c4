"""Every query against its SQL in DuckDB, and the results that have none against invariants."""

import os

import duckdb
import pytest

from lodestone.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(table):
    def cell(x):
        return repr(float(f"{x:.9g}")) if isinstance(x, float) else str(list(x)) if isinstance(x, list | tuple) else str(x)

    return sorted(tuple(map(cell, r)) for r in table)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, oracle, name):
    df = registry.QUERIES[name](spark, SF)
    want = oracle.sql(registry.ORACLE_SQL[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    got = [[r[n] for n in names] for r in df.collect()]
    assert rows(got) == rows(want.select(", ".join(f'"{n}"' for n in names)).fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_best_number_of_clusters(spark):
    found = registry.QUERIES["cluster_numbers"](spark, SF).collect()
    assert [r.k for r in found] == list(range(2, 15)) and all(-1 <= r.silhouette <= 1 for r in found)
    assert [r.k for r in found if r.best] == [max(found, key=lambda r: (r.silhouette, -r.k)).k]


def test_principal_components(spark):
    import numpy as np

    x = np.array([r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("embedding").collect()])
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    share = values / values.sum()
    found = sorted(registry.QUERIES["principal_components"](spark, SF).collect(), key=lambda r: r.component)
    assert [r.share for r in found] == pytest.approx(share, abs=1e-9) and found[-1].cumulative == pytest.approx(1)
    whole = np.cumsum(share)
    assert {(r.above_90, r.from_95, r.from_99) for r in found} == {tuple(int(np.argmax(t)) + 1 for t in (whole > 0.9, whole >= 0.95, whole >= 0.99))}


def test_extreme_labels_of_components(spark):
    found = registry.QUERIES["component_labels"](spark, SF).collect()
    by = {(r.component, r.side, r.place): r.projection for r in found}
    assert len(by) == len(found) == 20 and all(by[c, "low", 1] <= by[c, "low", 2] <= by[c, "high", 2] <= by[c, "high", 1] for c in range(1, 6))


def test_probe_and_clusters(spark):
    (probe,) = registry.QUERIES["linear_probe"](spark, SF).collect()
    assert 0 <= probe.accuracy <= 1 and probe.chance == pytest.approx(0.1) and probe.linear == (probe.accuracy > probe.chance + 0.15)
    clusters = registry.QUERIES["cluster_composition"](spark, SF).collect()
    assert sum(r.n for r in clusters) == spark.read.parquet(f"{SF}/embeddings.parquet").count() and all(0 < r.modal_n <= r.n for r in clusters)


def test_bootstrap(spark):
    import numpy as np

    (r,) = registry.QUERIES["bootstrap_interval"](spark, SF).collect()
    v = np.array([x.value for x in spark.read.parquet(f"{SF}/events.parquet").select("value").collect()])
    half = 1.96 * v.std() / len(v) ** 0.5
    assert r.n == len(v) and r.mean == pytest.approx(v.mean()) and r.mean - r.low == pytest.approx(half, rel=0.3) and r.high - r.mean == pytest.approx(half, rel=0.3)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
