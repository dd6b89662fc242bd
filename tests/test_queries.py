"""Every catalogued query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from echograph.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    cur = duck.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(norm(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_communities_cover_vertices_and_beat_singletons(spark):
    from echograph.operators import graph
    from echograph.plans import views

    e = views.forward_graph(spark, SF).edges
    m = graph.leiden(e)
    q = graph.modularity(e, m).first()[0]
    assert m.count() == views.forward_graph(spark, SF).vertices.count() and q > 0


def test_configuration_null_keeps_degrees(spark):
    from echograph.operators import graph
    from echograph.plans import views

    e = views.forward_graph(spark, SF).edges
    degree = lambda df, a, b: {r[0]: r[1] for r in df.selectExpr(f"{a} id").unionAll(df.selectExpr(f"{b} id")).groupBy("id").count().collect()}
    assert degree(graph.collapse(e), "u", "v") == degree(graph.configuration_null(e, 3), "u", "v")


def test_communities_in_memory_and_distributed_agree(spark):
    import random

    from echograph.operators import graph, louvain

    rng = random.Random(4)
    rows = [(f"v{rng.randrange(4) * 10 + rng.randrange(10)}", f"v{rng.randrange(4) * 10 + rng.randrange(10)}") for _ in range(12)]
    rows += [(f"v{10 * k + rng.randrange(10)}", f"v{10 * k + rng.randrange(10)}") for k in range(4) for _ in range(40)]
    e = graph.collapse(spark.createDataFrame(rows, "src string, dst string"))
    small, large = ({r.id: r.community for r in louvain.communities(e, 42, small=n).collect()} for n in (10**6, 0))
    assert small == large and len(set(small.values())) < 12
    m = spark.createDataFrame(list(small.items()), "id string, community long")
    assert graph.modularity(e.toDF("src", "dst"), m).first()[0] > 0.5
