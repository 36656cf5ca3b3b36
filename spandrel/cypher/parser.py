"""Tokens, clauses, patterns and expressions of the graph query language.

Expressions become Spark SQL text: variables are struct columns, so ``n.name``
stays as it is; only operators and functions Spark lacks are rewritten.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from spandrel.graph.pattern import Hop, Node

TOKEN = re.compile(r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+\.\d+|\d+(?!\.\d))|(?P<name>`[^`]+`|[A-Za-z_][A-Za-z_0-9]*)|(?P<param>\$[A-Za-z_0-9]+)|(?P<mark><=>|<->|<#>|<=|>=|<>|=~|\.\.|\|\||[-+*/%^=<>()\[\]{},.:;|&!?]))""")

CLAUSES = ("OPTIONAL MATCH", "MANDATORY MATCH", "DETACH DELETE", "ORDER BY", "MATCH", "WHERE", "WITH", "RETURN", "SKIP", "LIMIT", "UNWIND", "CALL", "YIELD", "CREATE", "MERGE", "SET", "DELETE", "REMOVE", "FOREACH", "UNION ALL", "UNION")

# Function names of the language and Spark's names.
FUNCTIONS = {"toupper": "upper", "tolower": "lower", "collect": "collect_list", "tostring": "string", "tofloat": "double", "size": "size", "head": "head_", "stdev": "stddev_samp", "stdevp": "stddev_pop", "percentilecont": "percentile", "datetime": "to_timestamp", "left": "left", "ltrim": "ltrim"}
AGGREGATES = frozenset(("count", "sum", "avg", "min", "max", "collect", "stdev", "stdevp", "percentilecont"))


class CypherError(ValueError):
    pass


@dataclass(frozen=True)
class Token:
    kind: str
    text: str

    @property
    def word(self) -> str:
        return self.text.upper() if self.kind == "name" else ""


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise CypherError(f"cannot read {text[at : at + 20]!r}")
        out.append(Token(m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [t for t in out if t.text != ";"]


def split_clauses(items: list[Token]) -> list[tuple[str, list[Token]]]:
    """(keyword, tokens) in order; keywords inside brackets, and after STARTS or ENDS, do not count."""
    out: list[tuple[str, list[Token]]] = []
    depth = i = 0
    while i < len(items):
        t = items[i]
        depth += (t.text in "([{") - (t.text in ")]}") if t.kind == "mark" else 0
        before = items[i - 1] if i else Token("", "")
        found = None
        if depth == 0 and t.kind == "name" and before.text not in (".", ":") and before.word not in ("STARTS", "ENDS", "ON"):
            pair = f"{t.word} {items[i + 1].word}" if i + 1 < len(items) else ""
            found = pair if pair in CLAUSES else t.word if t.word in CLAUSES else None
        if found:
            out.append((found, []))
            i += found.count(" ") + 1
            continue
        if not out:
            raise CypherError(f"a query cannot begin with {t.text}")
        out[-1][1].append(t)
        i += 1
    return out


def split_list(items: list[Token], mark: str = ",") -> list[list[Token]]:
    out, depth = [[]], 0
    for t in items:
        depth += (t.text in "([{") - (t.text in ")]}") if t.kind == "mark" else 0
        if depth == 0 and t.text == mark:
            out.append([])
        else:
            out[-1].append(t)
    return [part for part in out if part]


class Stream:
    def __init__(self, items: list[Token]):
        self.items, self.at = items, 0

    def peek(self, ahead: int = 0) -> Token:
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else Token("end", "")

    def next(self) -> Token:
        self.at += 1
        return self.items[self.at - 1]

    def take(self, text: str) -> bool:
        if self.peek().text == text:
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise CypherError(f"expected {text} at {self.peek().text!r}")


class Patterns:
    """Reads ``p = (a:L {k: 1})-[r:T*1..3]->(b), …`` into chains of Node and Hop; unnamed variables get names."""

    def __init__(self, parameters: dict):
        self.parameters, self.count = parameters, 0

    def fresh(self, prefix: str) -> str:
        self.count += 1
        return f"__{prefix}{self.count}"

    def read(self, items: list[Token]) -> list[tuple[str | None, list, str | None]]:
        """(path variable, elements, shortest mode) of each comma-separated pattern."""
        out = []
        for part in split_list(items):
            s, name, mode = Stream(part), None, None
            if s.peek(1).text == "=":
                name = s.next().text
                s.next()
            if s.peek().word in ("SHORTESTPATH", "ALLSHORTESTPATHS"):
                mode = s.next().word
                s.need("(")
            elements = [self.node(s)]
            while s.peek().text in ("-", "<"):
                elements += [self.hop(s), self.node(s)]
            if mode:
                s.need(")")
            if s.peek().kind != "end":
                raise CypherError(f"unexpected {s.peek().text!r} in a pattern")
            out.append((name, elements, mode))
        return out

    def node(self, s: Stream) -> Node:
        s.need("(")
        name = s.next().text if s.peek().kind == "name" else self.fresh("n")
        labels = ""
        while s.peek().text in (":", "|", "&", "!") or (labels and s.peek().kind == "name"):
            labels += s.next().text
        found = Node(name, labels.lstrip(":") or None, self.properties(s))
        s.need(")")
        return found

    def hop(self, s: Stream) -> Hop:
        back = s.take("<")
        s.need("-")
        name, types, low, high, properties = None, [], 1, 1, {}
        if s.take("["):
            if s.peek().kind == "name":
                name = s.next().text
            while s.take(":") or s.take("|"):
                s.take(":")
                types.append(s.next().text)
            if s.take("*"):
                low, high = self.bounds(s)
            elif s.take("+"):
                low, high = 1, None
            elif s.take("?"):
                low, high = 0, 1
            elif s.peek().text == "{" and s.peek(1).kind == "number":
                s.next()
                low = high = int(s.next().text)
                if s.take(","):
                    high = int(s.next().text) if s.peek().kind == "number" else None
                s.need("}")
            properties = self.properties(s)
            s.need("]")
        s.need("-")
        forth = s.take(">")
        return Hop(tuple(types), "in" if back and not forth else "out" if forth and not back else "both", name, low, high, properties)

    def bounds(self, s: Stream) -> tuple[int, int | None]:
        low = int(s.next().text) if s.peek().kind == "number" else None
        if not s.take(".."):
            return (1, None) if low is None else (low, low)
        return 1 if low is None else low, int(s.next().text) if s.peek().kind == "number" else None

    def properties(self, s: Stream) -> dict:
        out = {}
        if s.take("{"):
            while not s.take("}"):
                key = s.next().text
                s.need(":")
                out[key] = self.value(s)
                s.take(",")
        return out

    def value(self, s: Stream):
        minus = s.take("-")
        t = s.next()
        if t.kind == "param":
            return self.parameters[t.text[1:]]
        if t.kind == "string":
            return unquote(t.text)
        if t.kind == "number":
            number = float(t.text) if "." in t.text else int(t.text)
            return -number if minus else number
        if t.word in ("TRUE", "FALSE"):
            return t.word == "TRUE"
        raise CypherError(f"a property must be a literal or parameter, not {t.text!r}")


def unquote(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text[1:-1])


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, str):
        return quote(value)
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(literal, value))})"
    return repr(value)


def has_aggregate(items: list[Token]) -> bool:
    return any(t.kind == "name" and t.text.lower() in AGGREGATES and n.text == "(" for t, n in zip(items, items[1:]))


class Expression:
    """Spark SQL text of an expression, by precedence: OR, XOR, AND, NOT, comparison, sums, products, powers, postfix."""

    def __init__(self, items: list[Token], parameters: dict, paths: set[str] = frozenset()):
        """``paths`` are the variables that hold paths, whose length is the number of their edges."""
        self.s, self.parameters, self.paths = Stream(items), parameters, paths

    def sql(self) -> str:
        out = self.either()
        if self.s.peek().kind != "end":
            raise CypherError(f"unexpected {self.s.peek().text!r} in an expression")
        return out

    def word(self, *words: str) -> bool:
        if all(self.s.peek(i).word == w for i, w in enumerate(words)):
            self.s.at += len(words)
            return True
        return False

    def either(self) -> str:
        out = self.exclusive()
        while self.word("OR"):
            out = f"({out} OR {self.exclusive()})"
        return out

    def exclusive(self) -> str:
        out = self.both()
        while self.word("XOR"):
            out = f"(({out}) <> ({self.both()}))"
        return out

    def both(self) -> str:
        out = self.negation()
        while self.word("AND"):
            out = f"({out} AND {self.negation()})"
        return out

    def negation(self) -> str:
        return f"(NOT {self.negation()})" if self.word("NOT") else self.comparison()

    def comparison(self) -> str:
        out = self.sums()
        while True:
            if self.s.peek().text in ("=", "<>", "<", "<=", ">", ">="):
                mark = self.s.next().text
                out = f"({out} {mark} {self.sums()})"
            elif self.s.take("=~"):
                out = f"({out} RLIKE concat('^(?:', {self.sums()}, ')$'))"
            elif self.word("STARTS", "WITH"):
                out = f"startswith({out}, {self.sums()})"
            elif self.word("ENDS", "WITH"):
                out = f"endswith({out}, {self.sums()})"
            elif self.word("CONTAINS"):
                out = f"contains({out}, {self.sums()})"
            elif self.word("IN"):
                out = f"array_contains({self.sums()}, {out})"
            elif self.word("IS", "NOT", "NULL"):
                out = f"({out} IS NOT NULL)"
            elif self.word("IS", "NULL"):
                out = f"({out} IS NULL)"
            else:
                return out

    def sums(self) -> str:
        out = self.products()
        while self.s.peek().text in ("+", "-", "||"):
            mark = self.s.next().text
            out = f"({out} {mark} {self.products()})"
        return out

    def products(self) -> str:
        out = self.power()
        while self.s.peek().text in ("*", "/", "%"):
            mark = self.s.next().text
            right = self.power()
            out = f"({out} {mark} nullif({right}, 0))" if mark in "/%" else f"({out} {mark} {right})"
        return out

    def power(self) -> str:
        out = self.unary()
        return f"pow({out}, {self.power()})" if self.s.take("^") else out

    def unary(self) -> str:
        return f"(-{self.unary()})" if self.s.take("-") else self.postfix()

    def postfix(self) -> str:
        out = self.atom()
        while True:
            if self.s.take("."):
                out = f"{out}.{self.s.next().text}"
            elif self.s.peek().text == "{" and self.s.peek(1).text == ".":
                out = self.projection(out)
            elif self.s.take("["):
                if self.s.take(".."):
                    start, end = "0", self.either()
                else:
                    start = self.either()
                    if not self.s.take(".."):
                        self.s.need("]")
                        out = f"get({out}, {start})"
                        continue
                    end = f"size({out})" if self.s.peek().text == "]" else self.either()
                self.s.need("]")
                out = f"slice({out}, {start} + 1, greatest({end} - {start}, 0))"
            else:
                return out

    def projection(self, source: str) -> str:
        """``n {.a, k: e}`` as a struct."""
        parts = []
        self.s.next()
        while not self.s.take("}"):
            if self.s.take("."):
                key = self.s.next().text
                parts.append(f"{source}.{key} AS {key}")
            else:
                key = self.s.next().text
                self.s.need(":")
                parts.append(f"{self.either()} AS {key}")
            self.s.take(",")
        return f"struct({', '.join(parts)})"

    def atom(self) -> str:
        t = self.s.next()
        if t.kind == "string":
            return quote(unquote(t.text))
        if t.kind == "number":
            return t.text
        if t.kind == "param":
            return literal(self.parameters[t.text[1:]])
        if t.text == "(":
            out = self.either()
            self.s.need(")")
            return f"({out})"
        if t.text == "[":
            return self.bracket()
        if t.text == "{":
            parts = []
            while not self.s.take("}"):
                key = self.s.next().text
                self.s.need(":")
                parts.append(f"{self.either()} AS {key}")
                self.s.take(",")
            return f"struct({', '.join(parts)})"
        if t.word == "CASE":
            return self.case()
        if t.kind == "name" and self.s.peek().text == "(":
            return self.function(t.text)
        if t.word in ("TRUE", "FALSE", "NULL"):
            return t.word
        if t.kind == "name":
            return t.text
        raise CypherError(f"unexpected {t.text!r}")

    def bracket(self) -> str:
        """A list, or a comprehension ``[x IN l WHERE p | e]``."""
        if self.s.peek().kind == "name" and self.s.peek(1).word == "IN":
            name = self.s.next().text
            self.s.next()
            out = self.either()
            if self.word("WHERE"):
                out = f"filter({out}, {name} -> {self.either()})"
            if self.s.take("|"):
                out = f"transform({out}, {name} -> {self.either()})"
            self.s.need("]")
            return out
        parts = []
        while not self.s.take("]"):
            parts.append(self.either())
            self.s.take(",")
        return f"array({', '.join(parts)})"

    def case(self) -> str:
        out = "CASE"
        if self.s.peek().word != "WHEN":
            out += f" {self.either()}"
        while self.word("WHEN"):
            test = self.either()
            if not self.word("THEN"):
                raise CypherError("CASE needs THEN")
            out += f" WHEN {test} THEN {self.either()}"
        if self.word("ELSE"):
            out += f" ELSE {self.either()}"
        if not self.word("END"):
            raise CypherError("CASE needs END")
        return f"{out} END"

    def function(self, name: str) -> str:
        low = name.lower()
        self.s.need("(")
        if low in ("all", "any", "none", "single") and self.s.peek(1).word == "IN":
            var = self.s.next().text
            self.s.next()
            items = self.either()
            if not self.word("WHERE"):
                raise CypherError(f"{name} needs WHERE")
            test = self.either()
            self.s.need(")")
            return {"all": f"forall({items}, {var} -> {test})", "any": f"exists({items}, {var} -> {test})", "none": f"(NOT exists({items}, {var} -> {test}))", "single": f"(size(filter({items}, {var} -> {test})) = 1)"}[low]
        if low == "reduce":
            acc = self.s.next().text
            self.s.need("=")
            start = self.either()
            self.s.need(",")
            var = self.s.next().text
            self.s.next()
            items = self.either()
            self.s.need("|")
            step = self.either()
            self.s.need(")")
            return f"aggregate({items}, CAST({start} AS DOUBLE), ({acc}, {var}) -> CAST({step} AS DOUBLE))"
        distinct = "DISTINCT " if self.word("DISTINCT") else ""
        args = []
        while not self.s.take(")"):
            if self.s.take("*"):
                args.append("*")
            else:
                args.append(self.either())
            self.s.take(",")
        one = args[0] if args else ""
        special = {
            "id": f"{one}.id", "labels": f"{one}.labels", "type": f"{one}.edge_type", "startnode": f"{one}.src", "endnode": f"{one}.dst", "nodes": f"{one}.nodes", "relationships": f"{one}.edges", "rels": f"{one}.edges",
            "head": f"get({one}, 0)", "last": f"try_element_at({one}, -1)", "tail": f"slice({one}, 2, greatest(size({one}), 1))", "tointeger": f"CAST(try_cast({one} AS DOUBLE) AS BIGINT)", "tofloat": f"try_cast({one} AS DOUBLE)", "tostring": f"CAST({one} AS STRING)",
            "toboolean": f"try_cast({one} AS BOOLEAN)", "exists": f"({one} IS NOT NULL)",
        }
        if low in special:
            return special[low]
        if low == "length" and one in self.paths:
            return f"size({one}.edges)"
        if low == "collect":
            return f"array_sort({'collect_set' if distinct else 'collect_list'}({one}))"
        if low == "range":
            return f"sequence({', '.join(args)})"
        return f"{FUNCTIONS.get(low, name)}({distinct}{', '.join(args)})"
