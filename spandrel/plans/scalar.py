"""Scalar function queries, a group of functions each."""

from __future__ import annotations

from pyspark.sql import functions as F

from spandrel.functions import FUNCTIONS as fn
from spandrel.functions import collections as lists
from spandrel.plans.registry import Registry

REGISTRY = Registry()
query = REGISTRY.query


@query("""SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, length(c_name) AS len, concat(c_name, NULL, '-', c_nationkey) AS cat,
concat_ws('/', c_mktsegment, NULL, c_name) AS ws, c_name || '|' || c_mktsegment AS fmt, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg FROM customer""")
def fn_string_basic(t):
    c = t.customer
    return c.select("c_custkey", fn["upper"]("c_name").alias("up"), fn["lower"]("c_mktsegment").alias("low"), fn["length"]("c_name").alias("len"), fn["concat"]("c_name", F.lit(None), F.lit("-"), "c_nationkey").alias("cat"),
                    fn["concat_ws"]("/", "c_mktsegment", F.lit(None).cast("string"), "c_name").alias("ws"), fn["format"]("%s|%s", "c_name", "c_mktsegment").alias("fmt"), fn["coalesce"](fn["nullif"]("c_mktsegment", F.lit("BUILDING")), F.lit("none")).alias("seg"))


@query("""SELECT p_partkey, substring(p_name, 2, 4) AS sub, substring(p_name, 1) AS all_of, CASE WHEN 100 > length(p_name) THEN '' ELSE substring(p_name, 100) END AS past,
left(p_name, 3) AS l3, right(p_name, 3) AS r3, '' AS lneg, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, 'xy') AS rp, lpad(p_brand, 3, ' ') AS cut, '' AS none_of FROM part""")
def fn_string_slices(t):
    return t.part.select("p_partkey", fn["substring"]("p_name", F.lit(2), F.lit(4)).alias("sub"), fn["substring"]("p_name", F.lit(0)).alias("all_of"), fn["substring"]("p_name", F.lit(100)).alias("past"), fn["left"]("p_name", F.lit(3)).alias("l3"), fn["right"]("p_name", F.lit(3)).alias("r3"),
                         fn["left"]("p_name", F.lit(-1)).alias("lneg"), fn["lpad"]("p_brand", F.lit(12), "*").alias("lp"), fn["rpad"]("p_brand", F.lit(12), "xy").alias("rp"), fn["lpad"]("p_brand", F.lit(3)).alias("cut"), fn["rpad"]("p_brand", F.lit(0)).alias("none_of"))


@query("""SELECT p_partkey, trim('  ' || p_type || '  ') AS t, ltrim('  ' || p_type || ' ') AS lt, rtrim(' ' || p_type || '  ') AS rt, replace(p_type, ' ', '_') AS rep, strpos(p_type, 'A') AS pos,
split_part(p_type, ' ', 1) AS sp1, split_part(p_type, ' ', 9) AS sp9, '' AS sp0, starts_with(p_type, 'S') AS sw, ends_with(p_type, 'S') AS ew, contains(p_type, 'AN') AS ct, reverse(p_type) AS rev FROM part""")
def fn_string_search(t):
    spaced = F.concat(F.lit("  "), "p_type", F.lit("  "))
    return t.part.select("p_partkey", fn["trim"](spaced).alias("t"), fn["ltrim"](F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("lt"), fn["rtrim"](F.concat(F.lit(" "), "p_type", F.lit("  "))).alias("rt"), fn["replace"]("p_type", " ", "_").alias("rep"), fn["position"]("p_type", "A").alias("pos"),
                         fn["split_part"]("p_type", " ", F.lit(1)).alias("sp1"), fn["split_part"]("p_type", " ", F.lit(9)).alias("sp9"), fn["split_part"]("p_type", " ", F.lit(0)).alias("sp0"), fn["starts_with"]("p_type", "S").alias("sw"), fn["ends_with"]("p_type", "S").alias("ew"), fn["contains"]("p_type", "AN").alias("ct"), fn["reverse"]("p_type").alias("rev"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '^(https?)://') THEN regexp_extract(url, '^(https?)://', 1) END AS scheme, CASE WHEN regexp_matches(url, '[0-9]+') THEN regexp_extract(url, '[0-9]+') END AS num,
regexp_replace(url, '[0-9]+', '#', 'g') AS masked, regexp_matches(url, 'utm_') AS tracked FROM pages""")
def fn_string_regexp(t):
    return t.pages.select("page_id", fn["regexp_match"]("url", "^(https?)://").alias("scheme"), fn["regexp_match"]("url", "[0-9]+").alias("num"), fn["regexp_replace"]("url", "[0-9]+", "#").alias("masked"), F.rlike("url", F.lit("utm_")).alias("tracked"))


@query("""SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, round(c_acctbal, 1) AS r, trunc(c_acctbal) AS t, CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6) END AS s,
round(power(c_nationkey, 2), 6) AS p, round(exp(c_nationkey / 10.0), 6) AS e, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) END AS l, CASE WHEN c_acctbal > 0 THEN round(log10(c_acctbal), 6) END AS l10,
CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal) / ln(2), 6) END AS l2, cast(sign(c_acctbal) AS integer) AS sg FROM customer""")
def fn_math_basic(t):
    x = "c_acctbal"
    return t.customer.select("c_custkey", fn["abs"](x).alias("a"), fn["ceil"](x).alias("c"), fn["floor"](x).alias("f"), fn["round"](x, 1).alias("r"), fn["trunc"](x).alias("t"), F.round(fn["sqrt"](x), 6).alias("s"), F.round(fn["power"]("c_nationkey", F.lit(2)), 6).alias("p"),
                             F.round(fn["exp"](F.col("c_nationkey") / 10.0), 6).alias("e"), F.round(fn["ln"](x), 6).alias("l"), F.round(fn["log"](x), 6).alias("l10"), F.round(fn["log"](F.lit(2.0), x), 6).alias("l2"), fn["sign"](x).alias("sg"))


@query("""SELECT c_custkey, round(sin(v), 6) AS si, round(cos(v), 6) AS co, round(tan(v), 6) AS ta, CASE WHEN abs(v) <= 1 THEN round(asin(v), 6) END AS asi, CASE WHEN abs(v) <= 1 THEN round(acos(v), 6) END AS aco, round(atan(v), 6) AS ata,
round(atan2(v, 2), 6) AS at2, round(degrees(v), 6) AS de, round(radians(v), 6) AS ra, round(pi(), 6) AS p FROM (SELECT c_custkey, c_acctbal / 5000 AS v FROM customer)""")
def fn_math_trig(t):
    c = t.customer.withColumn("v", F.col("c_acctbal") / 5000)
    r = lambda c: F.round(c, 6)
    return c.select("c_custkey", r(fn["sin"]("v")).alias("si"), r(fn["cos"]("v")).alias("co"), r(fn["tan"]("v")).alias("ta"), r(fn["asin"]("v")).alias("asi"), r(fn["acos"]("v")).alias("aco"), r(fn["atan"]("v")).alias("ata"), r(fn["atan2"]("v", F.lit(2))).alias("at2"), r(fn["degrees"]("v")).alias("de"), r(fn["radians"]("v")).alias("ra"), r(fn["pi"]()).alias("p"))


@query("""SELECT c_custkey, c_custkey // nullif(c_nationkey, 0) AS q, c_custkey % nullif(c_nationkey, 0) AS m, round(c_acctbal / nullif(c_nationkey, 0), 6) AS d, -c_nationkey AS neg, c_nationkey * 2 + 1 - 3 AS expr FROM customer""")
def expr_arithmetic(t):
    from spandrel.functions import maths

    return t.customer.select("c_custkey", maths.divide("c_custkey", F.col("c_nationkey").cast("long")).alias("q"), maths.modulo("c_custkey", "c_nationkey").alias("m"), F.round(maths.divide_float("c_acctbal", "c_nationkey"), 6).alias("d"), (-F.col("c_nationkey")).alias("neg"), (F.col("c_nationkey") * 2 + 1 - 3).alias("expr"))


@query("""SELECT event_id, cast(extract(year FROM ts) AS double) AS y, cast(extract(quarter FROM ts) AS double) AS q, cast(extract(month FROM ts) AS double) AS mo, cast(extract(week FROM ts) AS double) AS w, cast(extract(doy FROM ts) AS double) AS doy,
cast(extract(dow FROM ts) AS double) AS dow, cast(extract(hour FROM ts) AS double) AS h, cast(extract(minute FROM ts) AS double) AS mi, round(epoch(ts), 3) AS ep FROM events""")
def fn_date_extract(t):
    fields = {"y": "year", "q": "quarter", "mo": "month", "w": "week", "doy": "doy", "dow": "dow", "h": "hour", "mi": "minute"}
    return t.events.select("event_id", *[fn["extract"](f, "ts").alias(n) for n, f in fields.items()], F.round(fn["date_part"]("epoch", "ts"), 3).alias("ep"))


@query("""SELECT event_id, strftime(date_trunc('year', ts), '%Y-%m-%d') AS y, strftime(date_trunc('quarter', ts), '%Y-%m-%d') AS q, strftime(date_trunc('week', ts), '%Y-%m-%d') AS w, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS h,
strftime(ts, '%Y/%m/%d %H:%M:%S') AS ch, strftime(date_trunc('century', ts), '%Y') AS century FROM events""")
def fn_date_trunc_format(t):
    show = lambda field, pattern: fn["to_char"](fn["date_trunc"](field, "ts"), pattern)
    return t.events.select("event_id", show("year", "YYYY-MM-DD").alias("y"), show("quarter", "YYYY-MM-DD").alias("q"), show("week", "YYYY-MM-DD").alias("w"), show("hour", "YYYY-MM-DD HH24").alias("h"), fn["to_char"]("ts", "YYYY/MM/DD HH24:MI:SS").alias("ch"), fn["to_char"](fn["datetime.truncate"]("century", "ts"), "YYYY").alias("century"))


@query("""SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 MONTH + INTERVAL 2 DAY + INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS added, strftime(o_orderdate - INTERVAL 1 YEAR - INTERVAL 1 WEEK, '%Y-%m-%d %H:%M:%S') AS taken,
strftime(make_date(cast(year(o_orderdate) AS integer), 2, 3), '%Y-%m-%d') AS md, strftime(make_timestamp(cast(year(o_orderdate) AS integer), 1, 2, 3, 4, 5.0), '%Y-%m-%d %H:%M:%S') AS mt, '03:04:05' AS mtime,
strftime(strptime('02/03/' || year(o_orderdate), '%d/%m/%Y'), '%Y-%m-%d') AS td, NULL AS bad FROM orders""")
def fn_date_make_add(t):
    year = F.year("o_orderdate")
    show = "YYYY-MM-DD HH24:MI:SS"
    return t.orders.select("o_orderkey", fn["to_char"](fn["date_add"]("o_orderdate", "1 month 2 days 3 hours"), show).alias("added"), fn["to_char"](fn["date_subtract"]("o_orderdate", "1 year 1 week"), show).alias("taken"), fn["make_date"](year, F.lit(2), F.lit(3)).cast("string").alias("md"),
                           fn["to_char"](fn["make_timestamp"](year, 1, 2, 3, 4, 5), show).alias("mt"), fn["make_time"](F.lit(3), F.lit(4), F.lit(5)).alias("mtime"), fn["to_date"](F.concat(F.lit("02/03/"), year), "DD/MM/YYYY").cast("string").alias("td"), fn["to_date"](F.lit("x"), "YYYY").cast("string").alias("bad"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS dt, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%H:%M:%S') AS lt, strftime(ts, '%H:%M:%S') || 'Z' AS tz, 'P' || (event_id + 1) || 'DT2H' AS dur, 'P1Y2M' AS iso, NULL AS bad FROM events""")
def fn_cypher_temporal(t):
    s = F.col("ts").cast("string")
    return t.events.select("event_id", fn["datetime"](s).alias("dt"), fn["date"](s).cast("string").alias("d"), fn["localtime"](s).alias("lt"), fn["time"](s).alias("tz"), fn["duration"]({"days": F.col("event_id") + 1, "hours": F.lit(2)}).alias("dur"), fn["duration"](F.lit("P1Y2M")).alias("iso"), fn["duration"](F.lit("1Y")).alias("bad"))


@query("""SELECT event_id, strftime(ts + INTERVAL 2 HOUR, '%H:%M') AS zoned, strftime(to_timestamp(86400 * 365) AT TIME ZONE 'UTC', '%Y-%m-%d') AS epoch_ts FROM events""")
def fn_date_zone(t):
    return t.events.select("event_id", F.date_format(fn["timezone"]("+02:00", F.col("ts").cast("timestamp")), "HH:mm").alias("zoned"), F.date_format(fn["to_timestamp"](F.lit(86400 * 365)), "yyyy-MM-dd").alias("epoch_ts"))


@query("""SELECT o_orderkey, range(1, 6) AS up, [5, 3, 1] AS down, l[1] AS head, l[2:] AS tail, l[-1] AS last, list_reverse(l) AS rev, len(l) AS n, l[2] AS second, NULL AS far FROM (SELECT o_orderkey, [o_orderkey, o_custkey, o_orderkey + 1] AS l FROM orders)""")
def fn_list_cypher(t):
    o = t.orders.withColumn("l", F.array(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderkey") + 1))
    return o.select("o_orderkey", fn["range"](F.lit(1).cast("long"), F.lit(5).cast("long")).alias("up"), fn["range"](F.lit(5), F.lit(1), F.lit(-2)).alias("down"), fn["head"]("l").alias("head"), fn["tail"]("l").alias("tail"), fn["last"]("l").alias("last"), fn["reverse"]("l").alias("rev"), fn["size"]("l").alias("n"), fn["subscript"]("l", F.lit(2)).alias("second"), fn["subscript"]("l", F.lit(9)).cast("string").alias("far"))


@query("""SELECT o_orderkey, len(l) AS alen, NULL AS dim2, len(l) AS card, list_append(l, 7) AS app, list_prepend(7, l) AS pre, list_concat(l, l) AS cat, list_filter(l, lambda x: x <> 2) AS rem, list_transform(l, lambda x: CASE WHEN x = 2 THEN 9 ELSE x END) AS rep,
nullif(coalesce(list_position(l, 2), 0), 0) AS pos, list_filter(range(1, 5), lambda i: l[i] = 2) AS poss, l[1] AS first_of FROM (SELECT o_orderkey, [o_orderkey % 3, 2, o_orderkey % 4, 2] AS l FROM orders)""")
def fn_array_sql(t):
    o = t.orders.withColumn("l", F.array(F.col("o_orderkey") % 3, F.lit(2).cast("long"), F.col("o_orderkey") % 4, F.lit(2).cast("long")))
    two, seven, nine = (F.lit(v).cast("long") for v in (2, 7, 9))
    return o.select("o_orderkey", fn["array_length"]("l").alias("alen"), fn["array_length"]("l", 2).cast("string").alias("dim2"), fn["cardinality"]("l").alias("card"), fn["array_append"]("l", seven).alias("app"), fn["array_prepend"](seven, "l").alias("pre"), fn["array_cat"]("l", "l").alias("cat"), fn["array_remove"]("l", two).alias("rem"),
                    fn["array_replace"]("l", two, nine).alias("rep"), fn["array_position"]("l", two).alias("pos"), fn["array_positions"]("l", two).alias("poss"), fn["unnest"]("l").alias("first_of"))


@query("""SELECT o_orderkey, list_transform(list_filter(l, lambda x: x > 1), lambda x: x * 10) AS comp, len(list_filter(l, lambda x: x >= 0)) = len(l) AS al, len(list_filter(l, lambda x: x = 3)) > 0 AS an, len(list_filter(l, lambda x: x = 3)) = 0 AS no,
len(list_filter(l, lambda x: x = 2)) = 1 AS si, cast(list_sum(l) + 100 AS bigint) AS red, o_custkey AS proj_key, o_orderkey * 2 AS proj_twice FROM (SELECT *, [o_orderkey % 3, o_orderkey % 5, o_orderkey % 4] AS l FROM orders)""")
def expr_list_predicates(t):
    o = t.orders.withColumn("l", F.array(F.col("o_orderkey") % 3, F.col("o_orderkey") % 5, F.col("o_orderkey") % 4)).withColumn("s", F.struct(F.col("o_custkey").alias("custkey")))
    proj = lists.map_projection(F.col("s"), ["custkey"], twice=F.col("o_orderkey") * 2)
    return o.select("o_orderkey", lists.comprehension("l", lambda x: x > 1, lambda x: x * 10).alias("comp"), lists.all_("l", lambda x: x >= 0).alias("al"), lists.any_("l", lambda x: x == 3).alias("an"), lists.none_("l", lambda x: x == 3).alias("no"), lists.single("l", lambda x: x == 2).alias("si"),
                    lists.reduce_(F.lit(100).cast("long"), "l", lambda a, x: a + x).alias("red"), proj["custkey"].alias("proj_key"), proj["twice"].alias("proj_twice"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, cast(json_extract(props, '$.k') AS varchar) AS kj, NULL AS missing, json_exists(props, '$.k') AS has, true AS anyk, false AS allk, json_keys(props) AS ks, json_extract_string(props, '$.k') AS op,
'{"a":' || event_id || ',"b":null}' AS obj FROM events""")
def fn_json_read(t):
    return t.events.select("event_id", fn["json_extract_path_text"]("props", "k").alias("k"), fn["json_extract_path"]("props", "k").alias("kj"), fn["json_extract_path_text"]("props", "zz").alias("missing"), fn["json_contains_key"]("props", "k").alias("has"), fn["json_contains_any_key"]("props", ["z", "k"]).alias("anyk"),
                           fn["json_contains_all_keys"]("props", ["z", "k"]).alias("allk"), fn["json_object_keys"]("props").alias("ks"), fn["json_extract_path_text_op"]("props", "{k}").alias("op"), fn["json_build_object"]("a", "event_id", "b", F.lit(None).cast("int")).alias("obj"))


@query("""SELECT event_id, '[' || event_id || ',"x",null]' AS arr, ['k=' || json_extract_string(props, '$.k')] AS each_text, ['1', '"a"'] AS elems, ['1', 'a'] AS elems_text, json_exists(props, '$.k') AS pe, json_extract_string(props, '$.k') AS pq, '[1,2]' AS pqa, '1' AS pqf FROM events""")
def fn_json_build_each(t):
    arr, nested = F.lit('[1,"a"]'), F.lit('{"v":[1,2]}')
    return t.events.select("event_id", fn["json_build_array"]("event_id", F.lit("x"), F.lit(None).cast("int")).alias("arr"), F.transform(fn["json_each_text"]("props"), lambda e: F.concat(e.key, F.lit("="), e.value)).alias("each_text"), fn["json_array_elements"](arr).alias("elems"), fn["json_array_elements_text"](arr).alias("elems_text"), fn["jsonb_path_exists"]("props", "$.k").alias("pe"),
                           fn["jsonb_path_query"]("props", "$.k").alias("pq"), fn["jsonb_path_query_array"](nested, "$.v[*]").alias("pqa"), fn["jsonb_path_query_first"](nested, "$.v[*]").alias("pqf"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS was, '{"k":{"n":' || event_id || '}}' AS set_to, '{"k":' || json_extract_string(props, '$.k') || ',"z":1}' AS made, '{"a":[1,9,2]}' AS ins, '{"b":{"d":1}}' AS strip FROM events""")
def fn_json_edit(t):
    e = t.events
    nested = F.concat(F.lit('{"n":'), F.col("event_id"), F.lit("}"))
    return e.select("event_id", fn["json_extract_path_text"]("props", "k").alias("was"), fn["json_build_object"]("k", F.struct(F.col("event_id").alias("n"))).alias("set_to"), fn["jsonb_set"]("props", "{z}", "1").alias("made"), fn["jsonb_insert"](F.lit('{"a":[1,2]}'), "{a,1}", "9").alias("ins"), fn["jsonb_strip_nulls"](F.lit('{"a":null,"b":{"c":null,"d":1}}')).alias("strip"), nested.alias("__n")).drop("__n")


@query("""SELECT c_custkey, NULL AS b0, true AS b1, cast(trunc(c_acctbal) AS bigint) AS i, NULL AS ibad, c_acctbal AS f, cast(c_nationkey AS varchar) AS s, '[' || c_custkey || ', ' || c_nationkey || ']' AS lst, cast(1234.5 AS double) AS num, cast(-12 AS double) AS neg, lpad(cast(c_nationkey AS varchar), 4, '0') AS txt FROM customer""")
def fn_convert(t):
    c = t.customer
    return c.select("c_custkey", fn["toBoolean"]("c_name").alias("b0"), fn["toBoolean"](F.lit("TRUE")).alias("b1"), fn["toInteger"]("c_acctbal").alias("i"), fn["toInteger"]("c_name").alias("ibad"), fn["toFloat"](F.col("c_acctbal").cast("string")).alias("f"), fn["toString"]("c_nationkey").alias("s"),
                    fn["toString"](F.array(F.col("c_custkey"), F.col("c_nationkey").cast("long")), "list").alias("lst"), fn["to_number"](F.lit("$1,234.5")).alias("num"), fn["to_number"](F.lit("(12)")).alias("neg"), fn["to_text"]("c_nationkey", "0000").alias("txt"))


@query("""SELECT c_custkey, round(2 * 6371000 * asin(sqrt(power(sin(radians(10) / 2), 2) + cos(radians(la)) * cos(radians(la + 10)) * power(sin(radians(5) / 2), 2))), 2) AS geo, round(sqrt(2.0), 6) AS flat, NULL AS mixed, c_nationkey BETWEEN 5 AND 15 AS inside
FROM (SELECT *, c_nationkey AS la FROM customer)""")
def fn_spatial(t):
    n = F.col("c_nationkey")
    a, b = fn["point"](longitude=F.lit(0), latitude=n), fn["point"](longitude=F.lit(5), latitude=n + 10)
    p, q = fn["point"](n, n), fn["point"](n + 1, n + 1)
    return t.customer.select("c_custkey", F.round(fn["point.distance"](a, b), 2).alias("geo"), F.round(fn["point.distance"](p, q), 6).alias("flat"), fn["point.distance"](a, p).alias("mixed"), fn["point.withinBBox"](p, fn["point"](F.lit(5), F.lit(5)), fn["point"](F.lit(15), F.lit(15))).alias("inside"))


@query("""SELECT c_custkey, ['Customer'] AS labels, c_custkey AS id, ['name', 'segment'] AS keys, c_name AS name, 'PLACED' AS rel, 2 AS hops FROM customer""")
def fn_entity_path(t):
    node = F.struct(F.col("c_custkey").alias("id"), F.array(F.lit("Customer")).alias("labels"), F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment")).alias("properties"))
    edge = F.struct(F.lit(1).alias("id"), F.lit("PLACED").alias("edge_type"), F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("dst"))
    path = F.struct(F.array(F.col("c_custkey"), F.lit(1).cast("long"), F.lit(2).cast("long")).alias("nodes"), F.array(F.lit(7), F.lit(8)).alias("edges"))
    c = t.customer.select("c_custkey", node.alias("n"), edge.alias("r"), path.alias("p"))
    return c.select("c_custkey", fn["labels"]("n").alias("labels"), fn["id"]("n").alias("id"), fn["keys"]("n").alias("keys"), fn["properties"]("n")["name"].alias("name"), fn["type"]("r").alias("rel"), fn["length(path)"]("p").alias("hops"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'part' END AS simple, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS searched, o_orderpriority LIKE '%URGENT' AS li, o_orderpriority ILIKE '%urgent' AS ili,
o_orderpriority NOT LIKE '1%' AS nli, o_orderstatus IN ('O', 'P') AS inn, o_totalprice BETWEEN 1000 AND 90000 AS bt, o_totalprice NOT BETWEEN 1000 AND 90000 AS nbt, (o_orderstatus = 'O') IS TRUE AS ist, cast(o_totalprice AS bigint) IS NOT NULL AS cs FROM orders""")
def expr_predicates(t):
    p = F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.expr("CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'part' END").alias("simple"), F.when(p > 200000, "big").when(p > 100000, "mid").otherwise("small").alias("searched"), F.like("o_orderpriority", F.lit("%URGENT")).alias("li"), F.ilike("o_orderpriority", F.lit("%urgent")).alias("ili"),
                           (~F.like("o_orderpriority", F.lit("1%"))).alias("nli"), F.col("o_orderstatus").isin("O", "P").alias("inn"), p.between(1000, 90000).alias("bt"), (~p.between(1000, 90000)).alias("nbt"), (F.col("o_orderstatus") == "O").eqNullSafe(True).alias("ist"), p.cast("bigint").isNotNull().alias("cs"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(log10(c_acctbal), 6) END AS l10, true AS random_in, true AS rand_in, true AS differs FROM customer""")
def fn_math_log10_random(t):
    drawn = t.customer.withColumns({"r": fn["random"](), "s": fn["rand"](7)})
    inside = lambda c: F.col(c).between(0, 1) & (F.col(c) < 1)
    return drawn.select("c_custkey", F.round(fn["log10"]("c_acctbal"), 6).alias("l10"), inside("r").alias("random_in"), inside("s").alias("rand_in"), (F.col("r") != F.col("s")).alias("differs"))


@query("""SELECT event_id, true AS same_day, true AS past, 15 AS clock, strftime(ts, '%Y-%m-%d %H:%M:%S') AS local, strftime(make_timestamp(2020, 2, 29, 1, 2, 3.0), '%Y-%m-%d %H:%M:%S') AS made, '1 year 2 mons 3 days 04:05:06' AS older, '-1 mon' AS younger FROM events""")
def fn_date_now_age(t):
    show = "YYYY-MM-DD HH24:MI:SS"
    early, late = F.lit("2019-01-01 00:00:00").cast("timestamp"), F.lit("2020-03-04 04:05:06").cast("timestamp")
    made = fn["localdatetime"]({"year": 2020, "month": 2, "day": 29, "hour": 1, "minute": 2, "second": 3})
    return t.events.select("event_id", (fn["current_date"]() == fn["now"]().cast("date")).alias("same_day"), (F.col("ts").cast("timestamp") < fn["now"]()).alias("past"), F.length(fn["current_time"]()).alias("clock"), fn["to_char"](fn["localdatetime"](F.col("ts").cast("string")), show).alias("local"), fn["to_char"](made, show).alias("made"),
                           fn["age"](late, early).alias("older"), fn["age"](early, F.lit("2019-02-01 00:00:00").cast("timestamp")).alias("younger"))


@query("""SELECT event_id, cast(json_extract(props, '$.k') AS varchar) AS path, json_extract_string(props, '$.k') AS path_text, '{"a":' || event_id || ',"b":null}' AS obj, '[' || event_id || ',"x",null]' AS arr, cast(json_extract(props, '$.k') AS varchar) AS op,
['k=' || cast(json_extract(props, '$.k') AS varchar)] AS each, ['k=' || cast(json_extract(props, '$.k') AS varchar)] AS each_b, ['k=' || json_extract_string(props, '$.k')] AS each_text, ['1', '"a"'] AS elems, ['1', 'a'] AS elems_text, json_keys(props) AS keys FROM events""")
def fn_jsonb_forms(t):
    arr = F.lit('[1,"a"]')
    pairs = lambda c: F.transform(c, lambda e: F.concat(e.key, F.lit("="), e.value))
    return t.events.select("event_id", fn["jsonb_extract_path"]("props", "k").alias("path"), fn["jsonb_extract_path_text"]("props", "k").alias("path_text"), fn["jsonb_build_object"]("a", "event_id", "b", F.lit(None).cast("int")).alias("obj"), fn["jsonb_build_array"]("event_id", F.lit("x"), F.lit(None).cast("int")).alias("arr"),
                           fn["json_extract_path_op"]("props", "{k}").alias("op"), pairs(fn["json_each"]("props")).alias("each"), pairs(fn["jsonb_each"]("props")).alias("each_b"), pairs(fn["jsonb_each_text"]("props")).alias("each_text"), fn["jsonb_array_elements"](arr).alias("elems"), fn["jsonb_array_elements_text"](arr).alias("elems_text"), fn["jsonb_object_keys"]("props").alias("keys"))


@query("""SELECT o_orderkey, [o_custkey, o_orderkey] AS ns, [o_orderkey * 2] AS rs, [o_orderkey * 2] AS short, o_custkey AS a, o_orderkey AS b FROM orders""")
def fn_path_parts(t):
    path = F.struct(F.array("o_custkey", "o_orderkey").alias("nodes"), F.array(F.col("o_orderkey") * 2).alias("edges"))
    edge = F.struct(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    o = t.orders.select("o_orderkey", path.alias("p"), edge.alias("r"))
    return o.select("o_orderkey", fn["nodes"]("p").alias("ns"), fn["relationships"]("p").alias("rs"), fn["rels"]("p").alias("short"), fn["startNode"]("r").alias("a"), fn["endNode"]("r").alias("b"))
