"""Every registered query of the engine against its oracle SQL on the smallest tables."""

import pytest

import oracle
from spandrel.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    if name not in catalog.ORACLE_SQL:
        assert not catalog.QUERIES[name](spark, SF).isEmpty()
        return
    assert oracle.compare(spark, con, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF) == ""


@pytest.mark.parametrize("name, least", [("vec_pq_search", 0.9), ("vec_index_search", 0.9)])
def test_recall_of_approximate_search(spark, con, name, least):
    """Shares of the ten nearest of brute force that an approximate search finds, and its distances are exact."""
    import numpy as np

    from spandrel.plans.vectors import Q

    rows = con.execute("SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL").fetchall()
    exact = {i: float(np.linalg.norm(np.array(v, dtype=float) - np.array(Q))) for i, v in rows}
    best = set(sorted(exact, key=lambda i: (exact[i], i))[:10])
    found = catalog.QUERIES[name](spark, SF).collect()
    assert all(abs(r.distance - exact[r.vec_id]) < 1e-6 for r in found)
    assert len(best & {r.vec_id for r in found}) >= 10 * least


def test_index_over_several_queries(spark, con, tmp_path):
    """Mean recall of half the cells, exact answers of all, and rows without a usable vector left out."""
    import numpy as np

    from spandrel.vector.cells import CellIndex

    rows = con.execute("SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id").fetchall()
    frame = spark.createDataFrame([*rows, (-1, None), (-2, [1.0, 2.0]), (-3, [float("nan")] * 64)], "vec_id long, embedding array<double>")
    index = CellIndex.build(frame, f"{tmp_path}/index")
    assert index.rows.count() == len(rows)
    ids, points = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=float)
    shares = []
    for at in (0, 100, 200, 300):
        best = ids[np.lexsort((ids, np.linalg.norm(points - points[at], axis=1)))[:10]]
        query = points[at].tolist()
        assert [r.vec_id for r in index.search(query, 10, probes=64).collect()] == best.tolist()
        shares.append(len({r.vec_id for r in index.search(query, 10, probes=32).collect()} & set(best.tolist())) / 10)
    assert sum(shares) / len(shares) >= 0.85


def test_eigenvector_of_a_graph_without_cycles(spark):
    """The trade graph of these tables has none, so the vector becomes zero and the SQL divides it by zero."""
    sf = "/root/testdata/sf0.1"
    con, sql = oracle.connect(sf), catalog.ORACLE_SQL["algo_eigenvector"]
    assert {str(score) for _, score in con.execute(sql).fetchall()} == {"nan"}
    assert oracle.compare(spark, con, catalog.QUERIES["algo_eigenvector"], sql, sf) == ""


@pytest.mark.parametrize("case", ["negative zeros", "odd vectors"])
def test_vector_centroid_as_its_sql(spark, tmp_path, case):
    """Means that round to zero from below; null, short and long vectors, null elements, NaN and labels without a vector."""
    import duckdb

    wide = [[-4e-6] * 64, [2e-6, -2e-6] * 32, [4e-6] * 64, [0.5, -0.25] * 32]
    if case == "negative zeros":
        rows = [(i, v, i % 3) for i, v in enumerate(wide)] + [(9, [-0.0] * 64, 7)]
    else:
        rows = [(0, None, 0), (1, wide[3], 0), (2, None, 1), (3, [1.0, None, -1.0], 2), (4, wide[3], 2), (5, [0.125] * 70, 3), (6, [], 4), (7, [float("nan"), 1.0], 5), (8, wide[3], None), (9, [2.0, -3.0], 6)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert oracle.compare(spark, con, catalog.QUERIES["agg_vector_centroid"], catalog.ORACLE_SQL["agg_vector_centroid"], str(tmp_path)) == ""
