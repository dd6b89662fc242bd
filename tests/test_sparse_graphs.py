"""Graph queries against their SQL on tables that leave no edge, one, or a few that do not touch."""

import json
import math
from datetime import datetime, timedelta

import duckdb
import pytest

from echograph.functions import stats
from echograph.operators.graph import same_class_moments
from echograph.plans import archive, catalog  # noqa: F401  (archive adds its queries to the catalog)

#: Who hands over to whom, three times each, and who is of another class than the rest.
GRAPHS = {
    "none": ([], ()),
    "loop": ([(1, 1)], ()),
    "one": ([(1, 2)], ()),
    "one_of_two_classes": ([(1, 2)], (2,)),
    "apart": ([(1, 2), (3, 4), (5, 6)], (4, 5)),
    "imports": ([(2, 8), (3, 15)], (3,)),
    "star": ([(1, 2), (1, 3), (1, 4), (1, 5)], (1,)),
}
QUERIES = ["communities", "null_same_class", "availability_chi2", "degree_assortativity", "null_transitivity", "triangles_transitivity", "community_profile"]


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sparse")
    for name, (pairs, other) in GRAPHS.items():
        rows = []
        for key in range(3 * len(pairs)):
            for user in pairs[key // 3]:
                n = len(rows)
                rows.append((n, datetime(2024, 1, 1) + timedelta(seconds=n), user, "view" if user not in other else "click", 1.0, json.dumps({"k": key})))
        schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}/events.parquet")
    return folder


def values(rows):
    return sorted(repr(["nan" if isinstance(v, float) and math.isnan(v) else v for v in r]) for r in rows)


@pytest.mark.parametrize("graph", sorted(GRAPHS))
@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, events, name, graph):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{events}/{graph}/events.parquet/*.parquet'")
    want = con.execute(catalog.SQL[name])
    columns = [d[0] for d in want.description]
    assert values(catalog.QUERIES[name](spark, f"{events}/{graph}").select(columns).collect()) == values(want.fetchall())


def test_moments_of_edges_within_classes(spark):
    """Against all pairings of the ends of a small graph."""
    edges = [(1, 2), (1, 3), (2, 3), (3, 4)]
    cls = {1: "a", 2: "a", 3: "b"}  # 4 has none

    def pairings(ends):
        if not ends:
            yield 0
        for k in range(1, len(ends)):
            same = ends[0] is not None and ends[0] == ends[k]
            for rest in pairings(ends[1:k] + ends[k + 1 :]):
                yield same + rest

    found = list(pairings([cls.get(v) for e in edges for v in e]))
    mean = sum(found) / len(found)
    variance = sum((x - mean) ** 2 for x in found) / len(found)
    frame = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(list(cls.items()), "id long, cls string")
    assert same_class_moments(*frame) == pytest.approx((mean, variance))


def test_chi_square_without_expected_counts(spark):
    gof = lambda rows: stats.chi2_gof(spark.createDataFrame(rows, "o double, e double"), "o", "e")
    assert gof([]) == {"chi2": None, "df": -1, "p": None}
    assert gof([(0.0, None), (0.0, None)]) == {"chi2": None, "df": 1, "p": None}
    assert gof([(2.0, 0.0), (1.0, 3.0)]) == {"chi2": math.inf, "df": 1, "p": 0.0}
