"""Backups, incremental backups and streams."""

from pyspark.sql import functions as F

from spandrel.graph.model import PropertyGraph
from spandrel.sources import files
from spandrel.streaming.changes import change_feed, tumbling


def graph(spark, rows, edges):
    return PropertyGraph(spark.createDataFrame(rows, "id long, labels array<string>, name string, version long"), spark.createDataFrame(edges, "id long, src long, dst long, edge_type string, version long"))


def test_backup_and_increment(spark, tmp_path):
    old = graph(spark, [(1, ["A"], "x", 1), (2, ["A"], None, 1)], [(1, 1, 2, "E", 1)])
    assert files.export_graph(old, str(tmp_path / "full")) == {"nodes": 2, "edges": 1}
    back = files.import_graph(spark, str(tmp_path / "full"))
    assert sorted(map(str, back.nodes.collect())) == sorted(map(str, old.nodes.collect()))
    new = graph(spark, [(1, ["A"], "y", 2), (2, ["A"], None, 1), (3, ["B"], "z", 2)], [(1, 1, 2, "E", 1)])
    files.export_graph(new, str(tmp_path / "more"), since=1)
    both = files.apply_increment(back, str(tmp_path / "more"))
    assert {(r.id, r.name) for r in both.nodes.collect()} == {(1, "y"), (2, None), (3, "z")}
    assert all(r.intact for r in files.verify_backup(spark, str(tmp_path / "full")).collect())
    max((tmp_path / "full" / "nodes").glob("part-*.json"), key=lambda f: f.stat().st_size).unlink()
    assert not all(r.intact for r in files.verify_backup(spark, str(tmp_path / "full")).collect())


def test_change_feed_remembers(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    seen = []
    run = lambda: change_feed(spark, str(tmp_path / "in"), "id long", lambda batch, i: seen.append(batch.count()), str(tmp_path / "state")).awaitTermination()
    run()
    spark.range(5, 8).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sum(seen) == 8


def test_stream_windows_drop_late_rows(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 00:00:10", 1), ("2024-01-01 00:05:00", 1)], "ts string, k int").withColumn("ts", F.to_timestamp("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = tumbling(stream, "ts", "1 minute", "30 seconds", ["k"], n=F.count("*")).writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.n for r in spark.table("windows").collect()] == [1]
