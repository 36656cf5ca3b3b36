"""Queries in the graph language, SQL with vector operators, procedures, sources and streams."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from spandrel import procedures
from spandrel.cypher.engine import Cypher, run
from spandrel.plans.graphs import TRADE, order_graph, trade
from spandrel.plans.registry import Registry
from spandrel.plans.vectors import COS, DOT, L1, L2, Q
from spandrel.session import shared_dir
from spandrel.sources import catalog, files
from spandrel.sql import Engine

REGISTRY = Registry()
query = REGISTRY.query


@query("SELECT c_name AS customer, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') AND c_name LIKE '%1' ORDER BY 1 LIMIT 25")
def cypher_match_where_return(t):
    return run(order_graph(t), "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) WHERE r.name IN ['ASIA', 'EUROPE'] AND c.name ENDS WITH '1' RETURN c.name AS customer, n.name AS nation ORDER BY customer LIMIT 25")


@query("SELECT n_name AS nation, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name HAVING count(o_orderkey) > 300")
def cypher_optional_with_aggregate(t):
    return run(order_graph(t), "MATCH (n:Nation)<-[:IN_NATION]-(c:Customer) OPTIONAL MATCH (c)-[p:PLACED]->(o:Order) WITH n.name AS nation, count(DISTINCT id(c)) AS customers, count(id(o)) AS orders WHERE orders > $least RETURN nation, customers, orders", least=300)


@query(f"WITH RECURSIVE {TRADE}, r(source, node, depth) AS (SELECT n_nationkey::BIGINT, n_nationkey::BIGINT, 0 FROM nation UNION SELECT source, dst::BIGINT, depth + 1 FROM r JOIN trade ON node = src WHERE depth < 2) SELECT DISTINCT a.n_name AS a, b.n_name AS b FROM r JOIN nation a ON a.n_nationkey = source JOIN nation b ON b.n_nationkey = node WHERE depth >= 1 AND source <> node AND a.n_regionkey = 0")
def cypher_var_length(t):
    return run(trade(t), "MATCH (a:Nation {region: 0})-[:TRADES*1..2]->(b:Nation) WHERE id(a) <> id(b) RETURN DISTINCT a.name AS a, b.name AS b")


@query("SELECT i, i * i AS sq FROM range(1, 6) x(i) UNION SELECT 9, 81")
def cypher_unwind_union(t):
    return run(trade(t), "UNWIND range(1, 5) AS i RETURN i, i * i AS sq UNION UNWIND [9] AS i RETURN i, i * i AS sq").select(F.col("i").cast("long").alias("i"), F.col("sq").cast("long").alias("sq"))


@query("SELECT n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN 'west' END AS side FROM nation WHERE n_regionkey <> 2")
def cypher_changes(t):
    c = Cypher(order_graph(t))
    c.run("MATCH (n:Nation)-[:IN_REGION]->(r:Region) WHERE id(r) = 1000000001 SET n.side = 'west'")
    c.run("MATCH (n:Nation)-[:IN_REGION]->(r:Region) WHERE id(r) = 1000000002 DETACH DELETE n")
    c.run("CREATE (x:Temp {name: 'gone'}) ")
    c.run("MATCH (x:Temp) DELETE x")
    return c.run("MATCH (n:Nation) RETURN id(n) - 2000000000 AS id, n.side AS side")


@query("SELECT 1000 + n_nationkey AS bonus, n_name AS name, 'new' AS kind FROM nation WHERE n_regionkey = 1")
def cypher_create_for_each_row(t):
    c = Cypher(order_graph(t))
    c.run("MATCH (n:Nation)-[:IN_REGION]->(r:Region) WHERE id(r) = 1000000001 SET n.bonus = id(n) - 2000000000 + 1000")
    made = c.run("MATCH (n:Nation)-[:IN_REGION]->(r:Region) WHERE id(r) = 1000000001 CREATE (n)-[h:HAS]->(x:Extra {kind: 'new'}) RETURN id(x) AS id, x.kind AS kind")
    assert made.select("id").distinct().count() == made.count()
    return c.run("MATCH (n:Nation)-[:HAS]->(x:Extra) RETURN n.bonus AS bonus, n.name AS name, x.kind AS kind").select(F.col("bonus").cast("int").alias("bonus"), "name", "kind")


@query("SELECT * FROM (VALUES ('created', 1), ('matched', 1)) v(state, n) UNION ALL SELECT 'edges', count(*)::INTEGER FROM nation WHERE n_regionkey = 2")
def cypher_merge_on_create_on_match(t):
    c = Cypher(order_graph(t))
    first = c.run("MERGE (x:Tag {name: 'a'}) ON CREATE SET x.state = 'created' ON MATCH SET x.state = 'matched' RETURN x.state AS state")
    states = first.groupBy("state").agg(F.count("*").cast("int").alias("n"))
    again = c.run("MERGE (x:Tag {name: 'a'}) ON CREATE SET x.state = 'created' ON MATCH SET x.state = 'matched' RETURN x.state AS state")
    states = states.union(again.groupBy("state").agg(F.count("*").cast("int").alias("n")))
    for _ in range(2):
        c.run("MATCH (n:Nation)-[:IN_REGION]->(r:Region), (x:Tag) WHERE id(r) = 1000000002 MERGE (n)-[m:TAGGED]->(x) ON CREATE SET m.times = 1 ON MATCH SET m.times = 2")
    return states.union(c.run("MATCH (:Nation)-[m:TAGGED]->(x:Tag) WHERE m.times = 2 RETURN 'edges' AS state, count(*) AS n").select("state", F.col("n").cast("int")))


@query("SELECT n_regionkey AS region, count(*) * (count(*) - 1) AS pairs FROM nation GROUP BY n_regionkey")
def cypher_edges_differ(t):
    return run(order_graph(t), "MATCH (a:Nation)-[:IN_REGION]->(r:Region)<-[:IN_REGION]-(b:Nation) RETURN id(r) - 1000000000 AS region, count(*) AS pairs").select(F.col("region").cast("int").alias("region"), "pairs")


@query("SELECT n_nationkey AS id, n_regionkey * 2 AS weight FROM nation WHERE n_regionkey > 2")
def cypher_set_on_edges(t):
    c = Cypher(order_graph(t))
    c.run("MATCH (n:Nation)-[e:IN_REGION]->(r:Region) WHERE id(r) > 1000000002 SET e.weight = (id(r) - 1000000000) * 2")
    assert c.graph.nodes.where("id < 0").isEmpty()
    return c.run("MATCH (n:Nation)-[e:IN_REGION]->(r:Region) WHERE id(r) > 1000000002 RETURN id(n) - 2000000000 AS id, e.weight AS weight").select(F.col("id").cast("int").alias("id"), F.col("weight").cast("int").alias("weight"))


@query("SELECT * FROM (VALUES ('insert', 50, 9), ('nothing', 51, 9), ('upsert', 0, 100), ('upsert', 52, 9), ('merge', 1, 77), ('merge', 60, 5)) v(form, id, x) UNION ALL SELECT 'update', n_nationkey, 2 FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'from', n_nationkey, n_nationkey FROM nation WHERE n_nationkey < 3 UNION ALL SELECT 'delete', n_nationkey, 3 FROM nation WHERE n_regionkey = 3 UNION ALL SELECT 'using', n_nationkey, 4 FROM nation WHERE n_regionkey = 4")
def sql_returning(t):
    base = t.nation.selectExpr("n_nationkey AS id", "n_regionkey AS x")
    named = lambda form, df: df.selectExpr(f"'{form}' AS form", "id", "x")

    def one(form, text):
        e = Engine(t.spark, t=base, s=base.where("id < 3").selectExpr("id", "id AS y"), four=base.where("x = 4"), m=t.spark.sql("SELECT 1 AS id, 77 AS x UNION ALL SELECT 60, 5"))
        return named(form, e.query(text))

    parts = [
        one("insert", "INSERT INTO t VALUES (50, 9) RETURNING id, x"),
        one("nothing", "INSERT INTO t VALUES (0, 9), (51, 9) ON CONFLICT (id) DO NOTHING RETURNING id, x"),
        one("upsert", "INSERT INTO t VALUES (0, 100), (52, 9) ON CONFLICT (id) DO UPDATE SET x = excluded.x RETURNING id, x"),
        one("update", "UPDATE t SET x = 2 WHERE x = 1 RETURNING id, x"),
        one("from", "UPDATE t SET x = s.y FROM s WHERE t.id = s.id RETURNING id, x"),
        one("delete", "DELETE FROM t WHERE x = 3 RETURNING id, x"),
        one("using", "DELETE FROM t USING four WHERE t.id = four.id RETURNING id, x"),
        one("merge", "MERGE INTO t USING m ON t.id = m.id WHEN MATCHED THEN UPDATE SET x = m.x WHEN NOT MATCHED THEN INSERT (id, x) VALUES (m.id, m.x) RETURNING id, x"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@query(f"WITH {TRADE} SELECT n_nationkey AS nodeId, (SELECT count(*) FROM trade WHERE src = n_nationkey) AS outDegree FROM nation")
def call_procedure_yield(t):
    return run(trade(t), "CALL algo.degreeCentrality() YIELD nodeId, outDegree")


@query(f"SELECT 'algo.' || n AS name FROM (VALUES {', '.join(repr((n.removeprefix('algo.'),)).replace(',)', ')') for n in sorted(procedures.PROCEDURES))}) v(n)")
def show_procedures(t):
    return procedures.show_procedures(t.spark).select("name")


@query(f"SELECT vec_id, round({L2}, 5) AS d FROM embeddings ORDER BY {L2}, vec_id LIMIT 5")
def sql_vector_operator(t):
    e = Engine(t.spark, embeddings=t.embeddings)
    return e.query(f"SELECT vec_id, round(embedding <-> {Q}, 5) AS d FROM embeddings ORDER BY embedding <-> {Q}, vec_id LIMIT 5")


@query(f"SELECT vec_id, round({COS}, 5) AS cosine, round({DOT}, 5) AS product, round({L1}, 5) AS manhattan FROM embeddings")
def sql_vector_metrics(t):
    e = Engine(t.spark, embeddings=t.embeddings)
    return e.query(f"SELECT vec_id, round(embedding <=> '{Q}', 5) AS cosine, round(embedding <#> {Q}, 5) AS product, round(embedding <~> {Q}, 5) AS manhattan FROM embeddings")


@query(f"SELECT vec_id, round(({L2} * 3 + {COS}) / 4, 5) AS h, round(-1 / (60 + {L2}) - 1 / (60 + {L1}), 6) AS r, round(greatest({DOT}, 0), 5) AS m FROM embeddings")
def sql_hybrid_rrf_maxsim(t):
    e = Engine(t.spark, embeddings=t.embeddings)
    return e.query(f"SELECT vec_id, round(HYBRID(embedding <-> {Q}, 3, embedding <=> {Q}, 1), 5) AS h, round(RRF(embedding <-> {Q}, embedding <~> {Q}), 6) AS r, round(array(embedding) <##> '{[Q, [0.0] * 64]}', 5) AS m FROM embeddings")


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, cast(json_extract(props, '$.k') AS varchar) AS kj, json_extract_string(props, '$.k') AS deep, json_exists(props, '$.k') AS has, event_type SIMILAR TO '(view|click).*' AS sim, NOT event_type SIMILAR TO '.*e' AS nsim,
regexp_matches(event_type, '^[a-p]') AS re, regexp_matches(event_type, '(?i)CLICK') AS ire, NOT regexp_matches(event_type, 'i') AS nre FROM events""")
def sql_json_and_pattern_symbols(t):
    e = Engine(t.spark, events=t.events)
    return e.query("SELECT event_id, props ->> 'k' AS k, props -> 'k' AS kj, props #>> '{k}' AS deep, props ? 'k' AS has, event_type SIMILAR TO '(view|click)%' AS sim, event_type NOT SIMILAR TO '%e' AS nsim, event_type ~ '^[a-p]' AS re, event_type ~* 'CLICK' AS ire, event_type !~ 'i' AS nre FROM events")


@query("SELECT p_brand, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 5")
def sql_fetch_with_ties(t):
    return Engine(t.spark, part=t.part).query("SELECT p_brand, p_size FROM part ORDER BY p_size DESC FETCH FIRST 5 ROWS WITH TIES")


@query("SELECT n_nationkey AS id, CASE WHEN n_regionkey = 2 THEN 7 ELSE n_regionkey END AS x FROM nation WHERE n_regionkey <> 1")
def sql_transactions(t):
    e = Engine(t.spark, t=t.nation.selectExpr("n_nationkey AS id", "n_regionkey AS x"))
    e.query("BEGIN")
    e.query("DELETE FROM t")
    e.query("ROLLBACK")
    e.query("BEGIN")
    e.query("DELETE FROM t WHERE x = 1")
    e.query("SAVEPOINT one")
    e.query("UPDATE t SET x = 0")
    e.query("ROLLBACK TO SAVEPOINT one")
    e.query("UPDATE t SET x = 7 WHERE x = 2")
    e.query("COMMIT")
    return e.query("SELECT id, x FROM t")


def _total(x: pd.Series) -> float:
    return float(x.sum())


def _more(x: pd.Series) -> pd.Series:
    return x * 3 + 1


@query("SELECT n_regionkey * 2 AS twice, sum(n_nationkey * 3 + 1)::DOUBLE AS total FROM nation GROUP BY n_regionkey")
def sql_functions(t):
    e = Engine(t.spark, nation=t.nation)
    e.query("CREATE FUNCTION twice(n BIGINT) RETURNS BIGINT LANGUAGE SQL AS 'SELECT n * 2'")
    e.register("total", _total, "double")
    e.register("more", _more, "long")
    return e.query("SELECT twice(n_regionkey) AS twice, total FROM (SELECT n_regionkey, total(more(n_nationkey)) AS total FROM nation GROUP BY n_regionkey)")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 OR o_totalprice > 400000")
def sql_prepared_cached(t):
    e = Engine(t.spark, orders=t.orders)
    e.prepare("of", "/*+ CACHE */ WITH big AS MATERIALIZED (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = :who OR o_totalprice > :least) SELECT * FROM big")
    e.execute("of", who=7, least=400000)
    return e.execute("of", who=7, least=400000)


@query("SELECT true AS planned, true AS scans")
def sql_explain(t):
    plan = Engine(t.spark, nation=t.nation).query("EXPLAIN SELECT n_name FROM nation WHERE n_nationkey = 3")
    return plan.agg((F.count("*") > 0).alias("planned"), F.bool_or(F.contains("plan", F.lit("PushedFilters"))).alias("scans"))


@query("SELECT n_name AS name, {'name': n_name, 'next': n_nationkey + 1} AS m, 1 AS hops, [2000000000 + n_nationkey, 1000000000 + n_regionkey] AS ids FROM nation WHERE n_regionkey < 3")
def cypher_paths_and_projection(t):
    q = "MANDATORY MATCH p = (n:Nation)-[:IN_REGION]->(r:Region) WHERE id(r) < 1000000003 RETURN n.name AS name, n {.name, next: id(n) - 2000000000 + 1} AS m, length(p) AS hops, nodes(p) AS ids"
    out = run(order_graph(t), q)
    return out.select("name", F.struct(F.col("m.name").alias("name"), F.col("m.next").alias("next")).alias("m"), F.col("hops").cast("int").alias("hops"), "ids")


@query("SELECT n_name AS name, [2, 3] AS part, contains(n_name, 'AN') <> starts_with(n_name, 'I') AS one FROM nation WHERE contains(n_name, 'AN') OR regexp_full_match(n_name, 'U.*')")
def cypher_text_predicates(t):
    return run(order_graph(t), "MATCH (n:Nation) WHERE n.name CONTAINS 'AN' OR n.name =~ 'U.*' RETURN n.name AS name, [1, 2, 3, 4][1..3] AS part, (n.name CONTAINS 'AN' XOR n.name STARTS WITH 'I') AS one")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def source_csv_round_trip(t):
    path = f"{shared_dir(t.spark)}/copy-{uuid.uuid4().hex}"
    files.copy_to(t.nation, path)
    return files.copy_from(t.spark, path, schema="n_nationkey int, n_name string, n_regionkey int")


@query("SELECT * FROM region")
def source_json_round_trip(t):
    path = f"{shared_dir(t.spark)}/copy-{uuid.uuid4().hex}"
    files.copy_to(t.region, path, "json")
    return files.copy_from(t.spark, path, "json", schema="r_regionkey int, r_name string")


@query("SELECT 'nodes' AS name, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) AS found, true AS intact UNION ALL SELECT 'edges', (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders), true")
def source_backup_verify(t):
    path = f"{shared_dir(t.spark)}/backup-{uuid.uuid4().hex}"
    files.export_graph(order_graph(t), path)
    files.import_graph(t.spark, path)
    return files.verify_backup(t.spark, path).select("name", "found", "intact")


@query("SELECT 'IN_REGION' AS name, count(*) AS n FROM nation UNION ALL SELECT 'IN_NATION', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'PLACED', count(*) FROM orders")
def catalog_edge_types(t):
    return catalog.edge_type_counts(order_graph(t).edges)


@query("SELECT event_type, count(*) AS n, round(sum(value), 3) AS s FROM events GROUP BY event_type")
def stream_change_feed(t):
    """Rows of the events table as a stream of files, gathered batch by batch."""
    from spandrel.streaming.changes import change_feed

    base = f"{shared_dir(t.spark)}/feed-{uuid.uuid4().hex}"
    t.events.write.parquet(f"{base}/in")
    feed = change_feed(t.spark, f"{base}/in", t.events._jdf.schema().toDDL(), lambda batch, i: batch.write.mode("append").parquet(f"{base}/out"), f"{base}/state")
    feed.awaitTermination()
    return t.spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("s"))


@query("SELECT user_id, strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
def window_tumbling(t):
    from spandrel.streaming.changes import tumbling

    return tumbling(t.events, "ts", "1 day", "1 hour", ["user_id"], n=F.count("*")).select("user_id", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")


@query("SELECT user_id, n FROM (SELECT user_id, s, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s)")
def window_session(t):
    from spandrel.streaming.changes import sessions

    return sessions(t.events, "ts", "2 hours", "1 hour", ["user_id"], n=F.count("*")).select("user_id", "n")
