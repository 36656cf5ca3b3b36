"""Runs graph queries over a PropertyGraph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spandrel import procedures
from spandrel.cypher.parser import CypherError, Expression, Patterns, Stream, Token, has_aggregate, literal, split_clauses, split_list, tokens
from spandrel.graph import dml, pattern, paths
from spandrel.graph.model import PropertyGraph
from spandrel.graph.pattern import Hop, Node
from spandrel.session import materialize


class Cypher:
    """``run`` returns the rows of a query; ``graph`` is the graph after the changes run so far."""

    def __init__(self, graph: PropertyGraph):
        self.graph = graph

    @property
    def spark(self):
        return self.graph.nodes.sparkSession

    def run(self, text: str, **parameters) -> DataFrame:
        parts, modes = [[]], []
        for clause in split_clauses(tokens(text)):
            if clause[0] in ("UNION", "UNION ALL"):
                modes.append(clause[0])
                parts.append([])
            else:
                parts[-1].append(clause)
        out = self._single(parts[0], parameters)
        for mode, part in zip(modes, parts[1:]):
            out = out.unionByName(self._single(part, parameters))
            out = out.distinct() if mode == "UNION" else out
        return out

    def _single(self, clauses, parameters) -> DataFrame:
        state = _State(self, parameters)
        clauses = _with_conditions(clauses)
        for i, (name, body) in enumerate(clauses):
            following = clauses[i + 1][0] if i + 1 < len(clauses) else ""
            state.clause(name, body, following)
        told = state.rows is not None and clauses[-1][0] not in CHANGES
        return state.rows if told else self.spark.createDataFrame([], "none int")


#: Clauses that change the graph; a query that ends with one returns no rows.
CHANGES = ("CREATE", "MERGE", "SET", "REMOVE", "DELETE", "DETACH DELETE", "FOREACH")


def _with_conditions(clauses: list) -> list:
    """MERGE with the SET clauses of its ON CREATE and ON MATCH in its body, as (ON, CREATE or MATCH, tokens) parts."""
    out: list = []
    for name, body in clauses:
        if name == "SET" and out and out[-1][0] == "MERGE" and isinstance(out[-1][1], _Merge) and out[-1][1].open:
            out[-1][1].take(body)
        elif name == "MERGE":
            out.append((name, _Merge(body)))
        else:
            out.append((name, body))
    return out


class _Merge:
    def __init__(self, body: list[Token]):
        self.on: dict[str, list] = {"CREATE": [], "MATCH": []}
        self.open: str | None = None
        self.body = self._cut(body)

    def _cut(self, body: list[Token]) -> list[Token]:
        self.open = body[-1].word if len(body) > 1 and body[-2].word == "ON" and body[-1].word in self.on else None
        return body[:-2] if self.open else body

    def take(self, body: list[Token]) -> None:
        kind = self.open
        self.on[kind].append(self._cut(body))


class _State:
    def __init__(self, owner: Cypher, parameters: dict):
        self.owner, self.parameters = owner, parameters
        self.patterns = Patterns(parameters)
        self.rows: DataFrame | None = None
        self.optional: DataFrame | None = None
        self.pending = None

    @property
    def graph(self) -> PropertyGraph:
        return self.owner.graph

    def sql(self, items: list[Token]) -> str:
        fields = self.rows.schema.fields if self.rows is not None else []
        paths = {f.name for f in fields if isinstance(f.dataType, StructType) and f.dataType.names == ["nodes", "edges"]}
        return Expression(items, self.parameters, paths).sql()

    def clause(self, name: str, body: list[Token], following: str) -> None:
        getattr(self, name.lower().replace(" ", "_"))(body, following)

    # Reading

    def match(self, body, following, optional=False) -> None:
        found, edges = None, []
        for path, elements, mode in self.patterns.read(body):
            if not mode:
                elements = [Hop(e.types, e.direction, self.patterns.fresh("r"), e.low, e.high, e.properties) if isinstance(e, Hop) and e.single and not e.name else e for e in elements]
                edges += [e.name for e in elements[1::2] if e.single]
            part = self.shortest(path, elements, mode) if mode else self.bound(path, elements)
            keys = [c for c in part.columns if found is not None and c in found.columns]
            found = part if found is None else _on_ids(found, part, keys)
        # One edge stands for one relationship of a MATCH.
        edges = list(dict.fromkeys(edges))
        found = pattern.differ(found, [f"{e}.id" for e in edges]).drop(*[e for e in edges if e.startswith("__")])
        if optional:
            self.optional = found
            if following != "WHERE":
                self.attach(None)
            return
        keys = [c for c in found.columns if self.rows is not None and c in self.rows.columns]
        self.rows = found if self.rows is None else _on_ids(self.rows, found, keys)

    def optional_match(self, body, following) -> None:
        self.match(body, following, optional=self.rows is not None)

    def mandatory_match(self, body, following) -> None:
        self.match(body, following)
        if self.rows.isEmpty():
            raise LookupError("mandatory pattern has no match")

    def attach(self, test: str | None) -> None:
        part, self.optional = self.optional, None
        part = part.where(test) if test else part
        keys = [c for c in part.columns if c in self.rows.columns]
        self.rows = _on_ids(self.rows, part, keys, "left")

    def bound(self, path, elements) -> DataFrame:
        """Matched rows with every variable as a struct."""
        named = [e if isinstance(e, Node) or e.name or not e.single or path is None else Hop(e.types, e.direction, self.patterns.fresh("r"), e.low, e.high, e.properties) for e in elements]
        rows = pattern.match(self.graph, named)
        if path:
            nodes = F.array(*[F.col(e.name) for e in named[::2]])
            edges = F.array(*[F.col(f"{e.name}.id") for e in named[1::2] if e.single])
            rows = rows.withColumn(path, F.struct(nodes.alias("nodes"), edges.alias("edges")))
        columns = self.graph.nodes.columns
        for name in dict.fromkeys(e.name for e in elements[::2]):
            if name.startswith("__"):
                rows = rows.drop(name)
            else:
                rows = rows.join(self.graph.nodes.select(F.struct(*columns).alias(f"__{name}")), F.col(name) == F.col(f"__{name}.id")).drop(name).withColumnRenamed(f"__{name}", name)
        hidden = [e.name for e in named[1::2] if e.name and e.name.startswith("__") and not e.single]
        return rows.drop(*hidden)

    def shortest(self, path, elements, mode) -> DataFrame:
        """shortestPath and allShortestPaths between nodes that the pattern's properties or the rows so far fix."""
        start, hop, end = elements
        held = self.rows.columns if self.rows is not None else []

        def ids(e, name):
            if e.name in held:
                return self.rows.select(F.col(f"{e.name}.id").alias(name))
            return pattern.match(self.graph, [e]).select(F.col(e.name).alias(name))

        sources, targets = ids(start, "source"), ids(end, "target")
        if start.name in held and end.name in held:
            targets = self.rows.select(F.col(f"{start.name}.id").alias("source"), F.col(f"{end.name}.id").alias("target"))
        found = paths.paths_between(self.graph, sources, targets, direction=hop.direction, types=list(hop.types) or None, max_depth=hop.high or 1000, every=mode == "ALLSHORTESTPATHS")
        out = found.select(F.col("source").alias("__a"), F.col("target").alias("__b"), F.struct("nodes", "edges").alias(path or "__path"))
        columns = self.graph.nodes.columns
        for key, e in (("__a", start), ("__b", end)):
            out = out.join(self.graph.nodes.select(F.struct(*columns).alias(e.name)), F.col(key) == F.col(f"{e.name}.id")).drop(key)
        return out

    def where(self, body, following) -> None:
        if self.optional is not None:
            self.attach(self.sql(body))
        else:
            self.rows = self.rows.where(self.sql(body))

    def unwind(self, body, following) -> None:
        at = max(i for i, t in enumerate(body) if t.word == "AS")
        rows = self.rows if self.rows is not None else self.owner.spark.range(1).select()
        self.rows = rows.withColumn(body[at + 1].text, F.explode(F.expr(self.sql(body[:at]))))

    def call(self, body, following) -> None:
        at = next(i for i, t in enumerate(body) if t.text == "(")
        name = "".join(t.text for t in body[:at])
        if name.lower().startswith("show"):
            self.rows = procedures.show_procedures(self.owner.spark)
            return
        arguments = []
        for part in split_list(body[at + 1 : -1]):
            s = Stream(part)
            if s.peek().text == "[":
                arguments.append([self.patterns.value(Stream(p)) for p in split_list(part[1:-1])])
            else:
                arguments.append(None if s.peek().word == "NULL" else self.patterns.value(s))
        self.rows = procedures.call(name, self.graph, *arguments)

    def yield_(self, body, following) -> None:
        self.rows = self.rows.select(*[F.col(p[0].text).alias(p[-1].text) for p in split_list(body)])

    # Results

    def project(self, body) -> None:
        if self.optional is not None:
            self.attach(None)
        distinct = bool(body) and body[0].word == "DISTINCT"
        body = body[1:] if distinct else body
        if [t.text for t in body] == ["*"]:
            self.rows = self.rows.distinct() if distinct else self.rows
            return
        rows = self.rows if self.rows is not None else self.owner.spark.range(1).select()
        keys, sums = [], []
        order = []
        for part in split_list(body):
            at = next((i for i in range(len(part) - 2, 0, -1) if part[i].word == "AS"), None)
            items = part[:at] if at else part
            name = part[at + 1].text if at else "".join(t.text for t in items)
            column = F.expr(self.sql(items)).alias(name)
            order.append(name)
            (sums if has_aggregate(items) else keys).append(column)
        out = rows.groupBy(*keys).agg(*sums) if sums else rows.select(*keys)
        out = out.select(*[F.col(f"`{n}`") for n in order])
        self.source = None if sums or distinct else rows
        self.rows = out.distinct() if distinct else out

    def return_(self, body, following) -> None:
        self.project(body)

    def with_(self, body, following) -> None:
        self.project(body)

    def order_by(self, body, following) -> None:
        keys = []
        for part in split_list(body):
            down = part[-1].word in ("DESC", "DESCENDING")
            items = part[:-1] if part[-1].word in ("ASC", "DESC", "ASCENDING", "DESCENDING") else part
            plain = "".join(t.text for t in items)
            c = F.col(f"`{plain}`") if plain in self.rows.columns else F.expr(self.sql(items))
            keys.append(c.desc_nulls_first() if down else c.asc_nulls_last())
        self.rows = self.rows.orderBy(*keys)

    def skip(self, body, following) -> None:
        self.rows = self.rows.offset(int(self.patterns.value(Stream(body))))

    def limit(self, body, following) -> None:
        self.rows = self.rows.limit(int(self.patterns.value(Stream(body))))

    # Changes

    def create(self, body, following) -> None:
        """New nodes and edges for each row so far, or once without any; the pattern's variables are bound to them."""
        for _, elements, _ in self.patterns.read(body):
            rows = self._numbered()
            nodes = [n for n in {n.name: n for n in elements[::2]}.values() if n.name not in rows.columns]
            top = (self.graph.nodes.agg(F.max("id")).first()[0] or 0) + 1
            for k, node in enumerate(nodes):
                rows = self._make_node(rows, node, F.col("__row") * len(nodes) + (top + k))
            for k, (a, hop, b) in enumerate(zip(elements[::2], elements[1::2], elements[2::2])):
                rows = self._make_edge(rows, a, hop, b, F.xxhash64(F.lit(k), "__row"))
            self._keep(rows)

    def _numbered(self) -> DataFrame:
        """The rows so far, written, so that their numbers stay the same."""
        rows = self.rows if self.rows is not None else self.owner.spark.range(1).select()
        return materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "bound")

    def _keep(self, rows: DataFrame) -> None:
        self.rows = rows.drop(*[c for c in rows.columns if c.startswith("__")])

    def _make_node(self, rows: DataFrame, node: Node, number) -> DataFrame:
        labels = F.array(*[F.lit(x) for x in (node.labels or "").replace("&", ":").split(":") if x]).cast("array<string>")
        made = rows.select(number.cast("long").alias("id"), labels.alias("labels"), *[F.lit(v).alias(k) for k, v in node.properties.items()])
        self.owner.graph = dml.create(self.graph, nodes=made)
        value = {"id": number.cast("long"), "labels": labels, **{k: F.lit(v) for k, v in node.properties.items()}}
        return rows.withColumn(node.name, self._struct(self.graph.nodes, value))

    def _make_edge(self, rows: DataFrame, a: Node, hop: Hop, b: Node, salt) -> DataFrame:
        src, dst = (b, a) if hop.direction == "in" else (a, b)
        ends = F.col(f"{src.name}.id"), F.col(f"{dst.name}.id")
        value = {"id": F.xxhash64(*ends, F.lit(hop.types[0]), salt), "src": ends[0], "dst": ends[1], "edge_type": F.lit(hop.types[0]), **{k: F.lit(v) for k, v in hop.properties.items()}}
        self.owner.graph = dml.create(self.graph, edges=rows.select(*[c.alias(k) for k, c in value.items()]))
        return rows.withColumn(hop.name, self._struct(self.graph.edges, value)) if hop.name else rows

    @staticmethod
    def _struct(frame: DataFrame, value: dict):
        return F.struct(*[value.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in frame.schema.fields])

    def merge(self, body, following) -> None:
        """Each node, then each edge, of the pattern: bound to all that match it, or made once if none does."""
        on = body.on
        for _, elements, _ in self.patterns.read(body.body):
            for node in {n.name: n for n in elements[::2]}.values():
                if self.rows is not None and node.name in self.rows.columns:
                    continue
                found = self.graph.nodes_with(node.labels, pattern._test(node.properties))
                fresh = found.isEmpty()
                if fresh:
                    one = self.owner.spark.range(1).select(F.lit(0).alias("__row"))
                    top = (self.graph.nodes.agg(F.max("id")).first()[0] or 0) + 1
                    bound = self._make_node(one, node, F.lit(top)).select(node.name)
                else:
                    bound = found.select(F.struct(*self.graph.nodes.columns).alias(node.name))
                self.rows = bound if self.rows is None else self.rows.crossJoin(bound)
                self._conditions(on["CREATE" if fresh else "MATCH"], node.name)
            for a, hop, b in zip(elements[::2], elements[1::2], elements[2::2]):
                self._merge_edge(a, hop, b, on)

    def _merge_edge(self, a: Node, hop: Hop, b: Node, on: dict) -> None:
        name = hop.name or "__edge"
        src, dst = (b, a) if hop.direction == "in" else (a, b)
        rows = self._numbered()
        edges = self.graph.edges_of(list(hop.types), pattern._test(hop.properties))
        held = edges.select(F.col("src").alias("__src"), F.col("dst").alias("__dst"), F.struct(*self.graph.edges.columns).alias(name))
        ends = (F.col(f"{src.name}.id") == F.col("__src")) & (F.col(f"{dst.name}.id") == F.col("__dst"))
        if hop.direction == "both":
            ends = ends | ((F.col(f"{src.name}.id") == F.col("__dst")) & (F.col(f"{dst.name}.id") == F.col("__src")))
        matched = materialize(rows.join(held, ends).drop("__src", "__dst"), "matched")
        fresh = rows.join(matched.select("__row"), "__row", "left_anti")
        # Rows with the same ends make one edge.
        first = fresh.groupBy(F.col(f"{src.name}.id").alias("s"), F.col(f"{dst.name}.id").alias("d")).agg(F.min("__row").alias("__row"))
        made = materialize(fresh.join(first.select("__row"), "__row", "left_semi"), "fresh")
        self._make_edge(made, a, Hop(hop.types, hop.direction, name, properties=hop.properties), b, F.lit(0))
        again = self.graph.edges.select(F.col("src").alias("__src"), F.col("dst").alias("__dst"), F.col("edge_type").alias("__type"), F.struct(*self.graph.edges.columns).alias(name))
        straight = (F.col(f"{src.name}.id") == F.col("__src")) & (F.col(f"{dst.name}.id") == F.col("__dst")) & (F.col("__type") == hop.types[0])
        created = fresh.join(again, straight).where(F.col(f"{name}.id") == F.xxhash64("__src", "__dst", "__type", F.lit(0))).drop("__src", "__dst", "__type")
        created = materialize(created, "created")
        matched = matched.withColumn(name, self._struct(self.graph.edges, {c: F.col(f"{name}.{c}") for c in matched.schema[name].dataType.fieldNames()}))
        self.rows = created
        self._conditions(on["CREATE"], name)
        done, self.rows = self.rows, matched
        self._conditions(on["MATCH"], name)
        self.rows = self._rebound(done, [name]).unionByName(self._rebound(self.rows, [name]))
        if not hop.name:
            self.rows = self.rows.drop(name)
        self.rows = self.rows.drop("__row")

    def _conditions(self, parts: list, name: str) -> None:
        """SET parts of ON CREATE or ON MATCH that are about ``name``, for the rows at hand."""
        for body in parts:
            for part in split_list(body):
                if part[0].text == name:
                    self.set(part, "")

    def _ids(self, name: str) -> DataFrame:
        return self.rows.select(F.col(f"{name}.id").alias("id")).distinct()

    def _is_edge(self, name: str) -> bool:
        return "edge_type" in self.rows.schema[name].dataType.fieldNames()

    def _rebound(self, rows: DataFrame, names: list[str] | None = None) -> DataFrame:
        """Rows with their nodes and edges as the graph has them now."""
        order = rows.columns
        for name in names if names is not None else [c for c in order if {"id"} <= set(getattr(rows.schema[c].dataType, "names", ()))]:
            fields = rows.schema[name].dataType.fieldNames()
            if "edge_type" not in fields and "labels" not in fields:
                continue
            frame = self.graph.edges if "edge_type" in fields else self.graph.nodes
            now = frame.select(F.col("id").alias("__id"), F.struct(*frame.columns).alias("__now"))
            rows = rows.join(now, F.col(f"{name}.id") == F.col("__id"), "left").drop("__id", name).withColumnRenamed("__now", name)
        return rows.select(*order)

    def set(self, body, following) -> None:
        for part in split_list(body):
            name = part[0].text
            edge = self._is_edge(name)
            frame = self.graph.edges if edge else self.graph.nodes
            columns = frame.columns
            if part[1].text == ":":
                hit = self._marked(name)
                added = F.array_union("labels", F.array(*[F.lit(t.text) for t in part[2:] if t.text != ":"]))
                out = hit.withColumn("labels", F.when(F.col("__hit") == 1, added).otherwise(F.col("labels")))
            else:
                at = next(i for i, t in enumerate(part) if t.text == "=")
                key = part[2].text
                value = F.expr(self.sql(part[at + 1 :]))
                values = materialize(self.rows.groupBy(F.col(f"{name}.id").alias("id")).agg(F.first(value).alias("__value"), F.lit(1).alias("__hit")), "set")
                old = F.col(key) if key in columns else F.lit(None)
                out = frame.join(values, "id", "left").withColumn(key, F.when(F.col("__hit") == 1, F.col("__value")).otherwise(old)).drop("__value")
                columns = columns if key in columns else [*columns, key]
            out = out.drop("__hit").select(*columns)
            self.owner.graph = PropertyGraph(self.graph.nodes, out) if edge else PropertyGraph(out, self.graph.edges)
        self.rows = self._rebound(self.rows)

    def _marked(self, name: str) -> DataFrame:
        frame = self.graph.edges if self._is_edge(name) else self.graph.nodes
        return frame.join(materialize(self._ids(name).withColumn("__hit", F.lit(1)), "hit"), "id", "left")

    def remove(self, body, following) -> None:
        for part in split_list(body):
            edge = self._is_edge(part[0].text)
            columns = (self.graph.edges if edge else self.graph.nodes).columns
            hit = self._marked(part[0].text)
            if part[1].text == ":":
                left = F.array_except("labels", F.array(*[F.lit(t.text) for t in part[2:] if t.text != ":"]))
                out = hit.withColumn("labels", F.when(F.col("__hit") == 1, left).otherwise(F.col("labels")))
            else:
                out = hit.withColumn(part[2].text, F.when(F.col("__hit").isNull(), F.col(part[2].text)))
            out = out.select(*columns)
            self.owner.graph = PropertyGraph(self.graph.nodes, out) if edge else PropertyGraph(out, self.graph.edges)
        self.rows = self._rebound(self.rows)

    def delete(self, body, following, detach=False) -> None:
        for part in split_list(body):
            name = part[0].text
            ids = self._ids(name)
            if "edge_type" in self.rows.schema[name].dataType.fieldNames():
                self.owner.graph = PropertyGraph(self.graph.nodes, self.graph.edges.join(ids, "id", "left_anti"))
                continue
            touched = self.graph.edges.select(F.explode(F.array("src", "dst")).alias("id")).join(ids, "id", "left_semi")
            if not detach and not touched.isEmpty():
                raise dml.HasEdges("nodes to delete still have edges")
            edges = self.graph.edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")
            self.owner.graph = PropertyGraph(self.graph.nodes.join(ids, "id", "left_anti"), edges.select(*self.graph.edges.columns))

    def detach_delete(self, body, following) -> None:
        self.delete(body, following, detach=True)

    def foreach(self, body, following) -> None:
        """FOREACH (x IN list | changes).

        Over rows so far, the changes run on a row for each element. Without rows the list is part of the statement, and
        its elements are put into the changes in turn.
        """
        inner = body[1:-1]
        name = inner[0].text
        bar, depth = 0, 0
        for bar, t in enumerate(inner):
            depth += (t.text in "([{") - (t.text in ")]}") if t.kind == "mark" else 0
            if depth == 0 and t.text == "|":
                break
        items, changes = inner[2:bar], inner[bar + 1 :]
        if self.rows is not None:
            before = self.rows
            self.rows = before.withColumn(name, F.explode(F.expr(self.sql(items))))
            for clause, rest in _with_conditions(split_clauses(changes)):
                self.clause(clause, rest, "")
            self.rows = self._rebound(before)
            return
        for item in [self.patterns.value(Stream(p)) for p in split_list(items[1:-1])]:
            swapped = [Token("string", literal(item)) if t.text == name and isinstance(item, str) else Token("number", str(item)) if t.text == name else t for t in changes]
            for clause, rest in _with_conditions(split_clauses(swapped)):
                self.clause(clause, rest, "")
            self.rows = None


for _name in ("return", "with", "yield"):
    setattr(_State, _name, getattr(_State, f"{_name}_"))


def _on_ids(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on shared variables by their ids; the left side's structs stay."""
    if not keys:
        return left.crossJoin(right) if how == "inner" else left.join(right, F.lit(True), how)
    names = {k: f"__on_{k}" for k in keys}
    bare = right.select(*[F.col(f"{k}.id").alias(names[k]) for k in keys], *[c for c in right.columns if c not in keys])
    test = F.lit(True)
    for k in keys:
        test = test & (F.col(f"{k}.id") == F.col(names[k]))
    return left.join(bare, test, how).drop(*names.values())


def run(graph: PropertyGraph, text: str, **parameters) -> DataFrame:
    return Cypher(graph).run(text, **parameters)
