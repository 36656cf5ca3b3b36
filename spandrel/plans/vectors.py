"""Vector queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spandrel.functions import FUNCTIONS as fn
from spandrel.plans.registry import Registry
from spandrel.session import shared_dir
from spandrel.vector import cells, collections, distance, hybrid, knn, postings, quantise, sparse
from spandrel.vector.distance import literal_vector

REGISTRY = Registry()
query = REGISTRY.query

Q = [round(((i * 7) % 11 - 5) / 10, 1) for i in range(64)]
Q_SQL = f"{Q}::DOUBLE[]"
V = "embedding::DOUBLE[]"
L2 = f"list_distance({V}, {Q_SQL})"
COS = f"(1 - list_cosine_similarity({V}, {Q_SQL}))"
DOT = f"list_inner_product({V}, {Q_SQL})"
L1 = f"list_sum(list_transform(range(1, 65), lambda i: abs(({V})[i] - ({Q_SQL})[i])))"
r5 = lambda c: F.round(c, 5)


@query(f"SELECT vec_id, round({L2}, 5) AS l2, round({COS}, 5) AS cos, round({DOT}, 5) AS ip, round({L1}, 5) AS l1, round(list_max(list_transform(range(1, 65), lambda i: abs(({V})[i] - ({Q_SQL})[i]))), 5) AS linf FROM embeddings")
def vec_distances(t):
    q = literal_vector(Q)
    return t.embeddings.select("vec_id", r5(distance.euclidean("embedding", q)).alias("l2"), r5(distance.cosine("embedding", q)).alias("cos"), r5(distance.dot("embedding", q)).alias("ip"), r5(distance.manhattan("embedding", q)).alias("l1"), r5(distance.chebyshev("embedding", q)).alias("linf"))


@query(f"SELECT vec_id, len(embedding) AS dim, round(sqrt(list_inner_product({V}, {V})), 5) AS norm FROM embeddings")
def vec_dimension_norm(t):
    return t.embeddings.select("vec_id", fn["vector_dimension"]("embedding").alias("dim"), r5(fn["vector_norm"]("embedding")).alias("norm"))


BITS = f"list_transform(range(1, 65), lambda i: CASE WHEN ({V})[i] > 0 THEN 1 ELSE 0 END)"
QBITS = [1 if x > 0 else 0 for x in Q]


@query(f"SELECT vec_id, h, round(h / 64.0, 6) AS hn, round(1 - a / o, 6) AS j FROM (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: xor(b[i], ({QBITS})[i])))::BIGINT AS h, list_sum(list_transform(range(1, 65), lambda i: b[i] & ({QBITS})[i]))::DOUBLE AS a, list_sum(list_transform(range(1, 65), lambda i: b[i] | ({QBITS})[i]))::DOUBLE AS o FROM (SELECT vec_id, {BITS} AS b FROM embeddings))")
def vec_binary_metrics(t):
    q = distance.binarise(literal_vector(Q))
    b = distance.binarise(F.col("embedding"))
    return t.embeddings.select("vec_id", distance.hamming(b, q).alias("h"), F.round(distance.hamming_normalised(b, q, 64), 6).alias("hn"), F.round(distance.binary_jaccard(b, q), 6).alias("j"))


@query(f"SELECT vec_id, round({L2}, 5) AS distance FROM embeddings ORDER BY {L2}, vec_id LIMIT 10")
def vec_knn_exact(t):
    return knn.search(t.embeddings, Q, 10).select("vec_id", r5("distance").alias("distance"))


@query(f"SELECT vec_id, round({COS}, 5) AS distance FROM embeddings WHERE label = 3 ORDER BY {COS}, vec_id LIMIT 5")
def vec_knn_filtered(t):
    return knn.search(t.embeddings, Q, 5, "cosine", where=F.col("label") == 3).select("vec_id", r5("distance").alias("distance"))


@query(f"SELECT vec_id, round(-{DOT}, 5) AS distance FROM embeddings WHERE -{DOT} <= 0.05 ORDER BY -{DOT}, vec_id LIMIT 20")
def vec_knn_max_distance(t):
    return knn.search(t.embeddings, Q, 20, "inner_product", max_distance=0.05).select("vec_id", r5("distance").alias("distance"))


@query("""SELECT query_id, vec_id, rank, round(distance, 5) AS distance FROM (SELECT q.label AS query_id, e.vec_id, list_distance(e.embedding::DOUBLE[], q.v) AS distance, row_number() OVER (PARTITION BY q.label ORDER BY list_distance(e.embedding::DOUBLE[], q.v), e.vec_id) AS rank
FROM embeddings e, (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, unnest(range(1, 65)) u(i) GROUP BY ALL) GROUP BY label) q) WHERE rank <= 3""")
def vec_knn_batch(t):
    from spandrel.operators.aggregates import vector_avg

    queries = vector_avg(t.embeddings, ["label"], "embedding", "query").withColumnRenamed("label", "query_id")
    return knn.search_batch(t.embeddings, queries, 3).select("query_id", "vec_id", "rank", r5("distance").alias("distance"))


@query(f"SELECT vec_id, round({L2}, 5) AS distance FROM embeddings WHERE vec_id IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1) ORDER BY {L2}, vec_id LIMIT 5")
def vec_knn_within_traversal(t):
    from spandrel.graph import traverse
    from spandrel.graph.model import PropertyGraph

    code = F.lit(10**9)
    edges = t.nation.select((code + F.col("n_nationkey")).alias("src"), (code * 2 + F.col("n_regionkey")).alias("dst")).union(t.customer.select("c_custkey", code + F.col("c_nationkey")))
    g = PropertyGraph.from_edges(edges)
    near = traverse.reach(g, t.spark.createDataFrame([(2 * 10**9 + 1,)], "id long"), 2, 2, "in")
    return knn.search_within(t.embeddings, near, Q, 5).select("vec_id", r5("distance").alias("distance"))


@query(f"SELECT vec_id, round({L2} * 0.7 + {COS} * 0.3, 5) AS d FROM embeddings ORDER BY {L2} * 0.7 + {COS} * 0.3, vec_id LIMIT 10")
def vec_hybrid_row(t):
    q = literal_vector(Q)
    scored = t.embeddings.withColumns({"a": distance.euclidean("embedding", q), "b": distance.cosine("embedding", q)})
    return scored.withColumn("d", hybrid.hybrid_distance("a", 0.7, "b", 0.3)).orderBy("d", "vec_id").limit(10).select("vec_id", r5("d").alias("d"))


TOPS = f"d AS (SELECT vec_id, {L2} AS distance FROM embeddings ORDER BY 2, 1 LIMIT 20), s AS (SELECT vec_id, {L1} AS distance FROM embeddings ORDER BY 2, 1 LIMIT 20)"


def _tops(t):
    return knn.search(t.embeddings, Q, 20).select("vec_id", "distance"), knn.search(t.embeddings, Q, 20, "manhattan").select("vec_id", "distance")


@query(f"WITH {TOPS}, dn AS (SELECT vec_id, (distance - (SELECT min(distance) FROM d)) / (SELECT max(distance) - min(distance) FROM d) AS x FROM d), sn AS (SELECT vec_id, (distance - (SELECT min(distance) FROM s)) / (SELECT max(distance) - min(distance) FROM s) AS x FROM s) SELECT vec_id, round(coalesce(dn.x, 1) * 0.6 + coalesce(sn.x, 1) * 0.4, 5) AS score FROM dn FULL JOIN sn USING (vec_id)")
def vec_hybrid_weighted(t):
    d, s = _tops(t)
    return hybrid.weighted(d, s, "vec_id", 0.6, 0.4).select("vec_id", r5("score").alias("score"))


@query(f"WITH {TOPS}, r AS (SELECT vec_id, 1.0 / (60 + row_number() OVER (ORDER BY distance, vec_id)) AS s FROM d UNION ALL SELECT vec_id, 1.0 / (60 + row_number() OVER (ORDER BY distance, vec_id)) FROM s), f AS (SELECT vec_id, sum(s) AS s FROM r GROUP BY vec_id) SELECT vec_id, round(1 - s / (SELECT max(s) FROM f), 5) AS distance FROM f")
def vec_hybrid_rrf(t):
    return hybrid.reciprocal_rank_fusion(list(_tops(t)), "vec_id").select("vec_id", r5("distance").alias("distance"))


@query(f"SELECT vec_id, round(greatest(list_inner_product(q1, d1), list_inner_product(q1, d2)) + greatest(list_inner_product(q2, d1), list_inner_product(q2, d2)), 5) AS score FROM (SELECT vec_id, ({V})[1:32] AS d1, ({V})[33:64] AS d2, ({Q_SQL})[1:32] AS q1, ({Q_SQL})[33:64] AS q2 FROM embeddings)")
def vec_max_sim(t):
    parts = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    q = F.array(literal_vector(Q[:32]), literal_vector(Q[32:]))
    return t.embeddings.select("vec_id", r5(distance.max_sim(q, parts)).alias("score"))


SPARSE_Q = {3: 1.5, 17: -2.0, 40: 0.5}


@query("SELECT vec_id, round(1.5 * CASE WHEN abs(embedding[3]) > 0.1 THEN embedding[3]::DOUBLE ELSE 0 END - 2.0 * CASE WHEN abs(embedding[17]) > 0.1 THEN embedding[17]::DOUBLE ELSE 0 END + 0.5 * CASE WHEN abs(embedding[40]) > 0.1 THEN embedding[40]::DOUBLE ELSE 0 END, 5) AS score FROM embeddings WHERE abs(embedding[3]) > 0.1 OR abs(embedding[17]) > 0.1 OR abs(embedding[40]) > 0.1 ORDER BY 1.5 * CASE WHEN abs(embedding[3]) > 0.1 THEN embedding[3]::DOUBLE ELSE 0 END - 2.0 * CASE WHEN abs(embedding[17]) > 0.1 THEN embedding[17]::DOUBLE ELSE 0 END + 0.5 * CASE WHEN abs(embedding[40]) > 0.1 THEN embedding[40]::DOUBLE ELSE 0 END DESC, vec_id LIMIT 10")
def vec_sparse_search(t):
    entries = F.filter(F.transform("embedding", lambda x, i: F.struct((i + 1).alias("idx"), x.alias("val"))), lambda e: F.abs(e.val) > F.lit(0.1).cast("float"))
    vectors = t.embeddings.select("vec_id", entries.alias("entries"))
    return sparse.sparse_search(vectors, SPARSE_Q, 10, "vec_id").select("vec_id", r5("score").alias("score"))


@query("SELECT vec_id, round(d, 5) AS d, round(1 - d / (sqrt(n) * sqrt(5.0)), 5) AS c, round(sqrt(n + 5.0 - 2 * d), 5) AS e FROM (SELECT vec_id, embedding[1]::DOUBLE * 1 + embedding[2]::DOUBLE * 2 AS d, embedding[1]::DOUBLE ^ 2 + embedding[2]::DOUBLE ^ 2 + embedding[3]::DOUBLE ^ 2 AS n FROM embeddings)")
def vec_sparse_metrics(t):
    a = F.create_map(F.lit(1), F.get("embedding", F.lit(0)), F.lit(2), F.get("embedding", F.lit(1)), F.lit(3), F.get("embedding", F.lit(2)))
    b = F.create_map(F.lit(1), F.lit(1.0), F.lit(2), F.lit(2.0))
    return t.embeddings.select("vec_id", r5(distance.sparse_dot(a, b)).alias("d"), r5(distance.sparse_cosine(a, b)).alias("c"), r5(distance.sparse_euclidean(a, b)).alias("e"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, len(w) AS size, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'license')) AS b FROM w),
s AS (SELECT count(*) AS n, avg(size) AS m, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM c)
SELECT doc_id, round(score, 5) AS score FROM (SELECT doc_id, ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * size / m)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * size / m)) AS score FROM c, s) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20""")
def vec_bm25(t):
    return sparse.bm25(t.documents, ["the", "license"], 20).select("doc_id", r5("score").alias("score"))


@query(REGISTRY.oracles["vec_bm25"])
def vec_bm25_index(t):
    index = postings.TermIndex.of_texts(t.documents, f"{shared_dir(t.spark)}/terms-{uuid.uuid4().hex}")
    return index.bm25(["the", "license"], 20).select(F.col("id").alias("doc_id"), r5("score").alias("score"))


@query(REGISTRY.oracles["vec_sparse_search"])
def vec_sparse_index(t):
    entries = F.filter(F.transform("embedding", lambda x, i: F.struct((i + 1).alias("idx"), x.alias("val"))), lambda e: F.abs(e.val) > F.lit(0.1).cast("float"))
    index = postings.TermIndex.of_vectors(t.embeddings.select("vec_id", entries.alias("entries")), f"{shared_dir(t.spark)}/terms-{uuid.uuid4().hex}", "vec_id")
    return index.inner(SPARSE_Q, 10).select(F.col("id").alias("vec_id"), r5("score").alias("score"))


@query("SELECT vec_id, label FROM embeddings WHERE (label >= 2 AND label < 5 OR label IN (7)) AND NOT label = 3 AND vec_id BETWEEN 10 AND 400 AND embedding IS NOT NULL")
def vec_payload_filter(t):
    tree = {"and": [{"or": [{"and": [{"field": "label", "gte": 2}, {"field": "label", "lt": 5}]}, {"field": "label", "in": [7]}]}, {"not": {"field": "label", "eq": 3}}, {"field": "vec_id", "range": (10, 400)}, {"field": "embedding", "exists": True}]}
    return t.embeddings.where(collections.payload_filter(tree)).select("vec_id", "label")


@query("SELECT vec_id AS id, CASE WHEN vec_id = 5 THEN 99 ELSE label END AS label, CASE WHEN vec_id > 490 THEN 'late' END AS tag FROM embeddings WHERE label <> 8 OR vec_id = 5 UNION ALL SELECT 1000000, 1, 'late'")
def vec_collection_changes(t):
    c = collections.Collection(t.embeddings.withColumnRenamed("vec_id", "id"), {"embedding": (64, "euclidean")})
    new = t.spark.createDataFrame([(1000000, [0.0] * 64, 1)], "id long, embedding array<float>, label int")
    five = c.points.where("id = 5").withColumn("label", F.lit(99))
    c = c.delete(F.col("label") == 8).upsert(five).insert(new).set_payload(F.col("id") > 490, tag="late")
    return c.points.select("id", "label", "tag")


@query()
def vec_pq_search(t):
    pq = quantise.ProductQuantiser(t.embeddings, segments=16)
    return pq.search(pq.encode(t.embeddings), Q, 10).select("vec_id", "distance")


@query()
def vec_index_search(t):
    index = cells.CellIndex.build(t.embeddings, f"{shared_dir(t.spark)}/index-{uuid.uuid4().hex}")
    return index.search(Q, 10, probes=32).select("vec_id", "distance")
