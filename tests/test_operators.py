"""Rewrites against plain loops, and their edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from spandrel.functions import FUNCTIONS as fn
from spandrel.operators import aggregates, dml, joins, recursive, sorting
from spandrel.operators.windows import window_aggregate


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.choice([1, 2, 2, 3, 5, 8, None]), rng.choice([None, 1.0, 2.0, 4.0])) for i in range(60)]
    return rows, spark.createDataFrame(rows, "i int, g string, k int, v double")


@pytest.mark.parametrize("exclude", [None, "current row", "group", "ties"])
@pytest.mark.parametrize("agg", ["sum", "count", "min"])
@pytest.mark.parametrize("frame", [("groups", -1, 1), ("groups", None, 0), ("range", -2, 2), ("rows", -2, 1)])
def test_window_frames(points, exclude, agg, frame):
    rows, df = points
    kind, low, high = frame
    order = [F.asc_nulls_first("k")] if kind != "rows" else [F.asc_nulls_first("k"), F.asc("i")]
    found = {r.i: r.w for r in window_aggregate(df, "w", agg, F.col("v"), ["g"], order, frame, exclude).collect()}
    for g in "ab":
        part = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        ranks, last = [], object()
        for at, r in enumerate(part):
            key = r[2] if kind != "rows" else (r[2], r[0])
            ranks.append((ranks[-1] if ranks else 0) + (key != last))
            last = key
        for at, r in enumerate(part):
            held = []
            for to, s in enumerate(part):
                if kind == "groups":
                    inside = (low is None or ranks[to] - ranks[at] >= low) and ranks[to] - ranks[at] <= high
                elif kind == "rows":
                    inside = low <= to - at <= high
                else:
                    inside = (r[2] is None and s[2] is None) or (r[2] is not None and s[2] is not None and low <= s[2] - r[2] <= high)
                gone = {None: False, "current row": to == at, "group": ranks[to] == ranks[at], "ties": ranks[to] == ranks[at] and to != at}[exclude]
                if inside and not gone and s[3] is not None:
                    held.append(s[3])
            want = {"sum": sum(held) if held else None, "count": len(held), "min": min(held, default=None)}[agg]
            assert found[r[0]] == want, (frame, exclude, agg, r)


def test_limit_with_ties_keeps_all_equal_keys(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, None), (4, 7)], "i int, k int")
    assert {r.i for r in sorting.limit_with_ties(df, 1, [("k", False)]).collect()} == {1, 2}
    assert {r.i for r in sorting.limit_with_ties(df, 3, [("k", False)]).collect()} == {1, 2, 4}
    assert sorting.limit_with_ties(df, 4, [("k", False)]).count() == 4


def test_joins_null_keys_do_not_match(spark):
    a, b = spark.createDataFrame([(1,), (None,)], "k int"), spark.createDataFrame([(1,), (None,)], "k int")
    assert a.join(b, "k").count() == 1
    assert joins.join(a.alias("a"), b.alias("b"), F.expr("a.k = b.k"), "right_anti").count() == 1


def test_range_join_equals_nested_loop(spark):
    rng = random.Random(1)
    p = [(i, rng.uniform(-50, 50)) for i in range(80)]
    q = [(i, lo, lo + rng.uniform(-2, 30)) for i in range(40) for lo in [rng.uniform(-60, 60)]]
    found = joins.range_join(spark.createDataFrame(p, "i int, x double"), spark.createDataFrame(q, "j int, lo double, hi double"), "x", "lo", "hi", 7.0)
    assert {(r.i, r.j) for r in found.collect()} == {(i, j) for i, x in p for j, lo, hi in q if lo <= x <= hi}


def test_salted_join_refuses_outer_right(spark):
    df = spark.createDataFrame([(1, 2)], "k int, v int")
    with pytest.raises(ValueError):
        joins.salted_join(df, df.withColumnRenamed("v", "w"), "k", how="right")


def test_salted_join_never_broadcasts_the_repeated_side(spark):
    """A right side under the threshold is over it once repeated, which the planned size does not show."""
    left, right = spark.range(0, 4000).selectExpr("id % 7 as k", "id as v"), spark.range(0, 5).selectExpr("id as k", "id * 10 as w")
    for how in ("inner", "left", "left_semi", "left_anti"):
        found = joins.salted_join(left, right, "k", 8, how)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan, how
        rows = found.collect()
        assert len(rows) == sum((i % 7 < 5) if how in ("inner", "left_semi") else (i % 7 >= 5) if how == "left_anti" else True for i in range(4000))
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        if how == "inner":
            assert {(r.v, r.w) for r in rows} == {(i, i % 7 * 10) for i in range(4000) if i % 7 < 5}


def test_recursive_stops_and_limits(spark):
    seed = spark.createDataFrame([(0,)], "n int")
    assert recursive.recursive(seed, lambda r: r.select(((F.col("n") + 1) % 5).alias("n"))).count() == 5
    with pytest.raises(recursive.TooManyRounds):
        recursive.recursive(seed, lambda r: r.select((F.col("n") + 1).alias("n")), max_rounds=4)


def test_merge_first_clause_wins(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    s = spark.createDataFrame([(1, "x"), (2, "del"), (4, "new")], "id int, v string")
    on = F.col("t.id") == F.col("s.id")
    out = dml.merge(t, s, on, [dml.Matched(None, F.col("s.v") == "del"), dml.Matched({"v": F.col("s.v")})], [dml.NotMatched({"id": F.col("s.id"), "v": F.col("s.v")})], [dml.NotMatchedBySource({"v": F.lit("lost")})])
    assert {tuple(r) for r in out.collect()} == {(1, "x"), (3, "lost"), (4, "new")}


def test_replace_table_reads_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    dml.replace_table(spark.createDataFrame([(1,), (2,)], "id int"), path)
    dml.replace_table(spark.read.parquet(path).where("id = 2"), path)
    assert [r.id for r in spark.read.parquet(path).collect()] == [2]


def test_functions_edge_cases(spark):
    row = spark.range(1).select(
        fn["substring"](F.lit("abc"), F.lit(0), F.lit(2)).alias("sub0"), fn["split_part"](F.lit("a,b"), ",", F.lit(-1)).alias("neg"), fn["sqrt"](F.lit(-1.0)).alias("root"), fn["asin"](F.lit(2.0)).alias("asin"), fn["log"](F.lit(1.0), F.lit(5.0)).alias("log1"),
        fn["array_position"](F.array(F.lit(1)), F.lit(9)).alias("pos"), fn["head"](F.array().cast("array<int>")).alias("head"), fn["toInteger"](F.lit("x")).alias("int"), fn["jsonb_set"](F.lit("not json"), "{a}", "1").alias("js"), fn["cosine_distance"](F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("cos"),
        fn["l2_distance"](F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("len"), fn["trim"](F.lit("\t a  ")).alias("trim"), fn["lpad"](F.lit("ab"), F.lit(4), "").alias("nofill"),
    ).first()
    assert row.asDict() == {"sub0": "ab", "neg": "", "root": None, "asin": None, "log1": None, "pos": None, "head": None, "int": None, "js": None, "cos": None, "len": None, "trim": "a", "nofill": "ab"}


def test_aggregates_of_nothing_are_null(spark):
    df = spark.createDataFrame([("a", None)], "g string, v int")
    row = df.groupBy("g").agg(aggregates.array_agg("v").alias("a"), aggregates.string_agg("v").alias("s"), aggregates.json_agg("v").alias("j")).first()
    assert (row.a, row.s, row.j) == (None, None, None)


def test_functions_cover_the_inventory():
    assert len(fn) >= 135


def test_age_leaves_zero_parts_out(spark):
    from spandrel.functions import FUNCTIONS as fn

    cases = {("2024-03-15", "2020-01-10"): "4 years 2 mons 5 days", ("2020-01-01", "2020-01-01"): "00:00:00", ("2020-03-01", "2020-01-31"): "1 mon -1 days", ("2020-03-01", "2020-01-30"): "1 mon", ("2020-01-01", "2021-02-02 03:04:05"): "-1 year 1 mon 1 day 03:04:05", ("2020-01-02 00:00:00", "2020-01-01 05:30:00"): "1 day -5:-30:00"}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in cases.items()] + [(None, "2020-01-01", None)], "a string, b string, w string")
    for r in df.select(fn["age"](df.a.cast("timestamp"), df.b.cast("timestamp")).alias("x"), "w").collect():
        assert r.x == r.w


def test_stored_postings_rank_as_scans_do(spark, tmp_path):
    from spandrel.vector import sparse
    from spandrel.vector.postings import TermIndex

    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["the", "Red", "fox", "it's", "x", "ü"], [9, 3, 2, 1, 1, 1], k=rng.randint(1, 30)))) for i in range(80)]
    docs = spark.createDataFrame([*rows, (80, None), (81, ""), (82, " .,! ")], "doc_id long, text string")
    index = TermIndex.of_texts(docs, f"{tmp_path}/texts", buckets=4)
    assert index.docs == 83
    for terms in (["the"], ["fox", "RED"], ["s", "absent"], ["absent"], []):
        want = [(r.doc_id, round(r.score, 9)) for r in sparse.bm25(docs, terms, 15).collect()]
        assert [(r.id, round(r.score, 9)) for r in index.bm25(terms, 15).collect()] == want
    entries = [(i, [(j, rng.uniform(-1, 1)) for j in rng.sample(range(12), rng.randint(0, 6))]) for i in range(60)]
    vectors = spark.createDataFrame([*entries, (60, None)], "id long, entries array<struct<idx: int, val: double>>")
    for query in ({3: 1.5, 7: -2.0}, {99: 1.0}):
        want = [(r.id, round(r.score, 9)) for r in sparse.sparse_search(vectors, query, 10).collect()]
        assert [(r.id, round(r.score, 9)) for r in TermIndex.of_vectors(vectors, f"{tmp_path}/v{len(query)}", buckets=4).inner(query, 10).collect()] == want
    empty = TermIndex.of_texts(docs.where("false"), f"{tmp_path}/none")
    assert empty.bm25(["the"], 5).count() == 0
