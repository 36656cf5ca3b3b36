"""URL filters over DataFrame expressions only.

A rule is a regular expression with the literal tokens (runs of letters and
digits between other characters) that any URL it fits must contain. Each rule
is indexed under its rarest token, by the counts of those tokens over all URLs.
A URL's own tokens fetch its candidate rules from that index, and only those
run their expressions; a rule without such a token is a candidate for every URL.
Up to ``LITERAL_RULES`` the index is a literal map in the plan: it grows with the
rule list, a parameter, never with the data, so nothing is broadcast or shuffled;
the only aggregate is a count for each rule token. Longer lists become a table:
the distinct URLs' tokens are joined with it, with the same results.

Defined cases: host is what follows the first ``://`` up to ``/ ? #`` or the
end, A-Z lower-cased; path what follows it up to ``? #`` or the end; a null url
or one without ``://`` has both empty, fits no rule and is allowed. Among
fitting host rules the longest wins; without one, a fitting pattern rule decides,
an allowing one first. Repeated rows are judged alike; an empty table gives an empty result;
other columns pass through ``judge`` untouched.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this many are a literal index in the plan; longer lists are a table that URL tokens are joined with.
LITERAL_RULES = 5000

# The host and path rules of the contract.
HOST_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

# Pattern rules: block, on the lower-cased host and path; each with the tokens it needs.
PATTERN_RULES = (
    (r"^(?:[^/]*[.])?spam-farm[.]", ("spam", "farm")),
    (r"^(?:[^/]*[.])?casino[.]", ("casino",)),
    (r"/adserver/", ("adserver",)),
    (r"^(?:[^/]*[.-])?(?:free-)?porn[.-]", ("porn",)),
    (r"/doubleclick/", ("doubleclick",)),
    (r"/(?:user/)?login/", ("login",)),
    (r"/cgi-bin/", ("cgi", "bin")),
)


@dataclass(frozen=True)
class Rule:
    verdict: str
    name: str | None
    pattern: str
    tokens: tuple[str, ...]
    weight: int


def compile_rules(host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> list[Rule]:
    """Host rules become expressions over host + path; their weight is their length, a pattern rule's is 0."""
    rules = [
        Rule(verdict, host + path, rf"^(?:[^/]*[.])?{re.escape(host)}{re.escape(path)}", tuple(dict.fromkeys(re.findall("[a-z0-9]+", host + path[: path.rfind("/") + 1].lower()))), len(host + path))
        for verdict, host, path in host_rules
    ]
    rules += [Rule("block", None, pattern, tokens, 0) for pattern, tokens in pattern_rules]
    return rules


def parse_filter_list(lines: Iterable[str]) -> list[Rule]:
    """Rules of a list in the public ad-blocking syntax: ``||host^``, ``@@`` exceptions, ``*`` and ``^``, ``|`` ends, ``/regex/``.

    Comments, element rules and rules with options are left out, as they do not judge a URL alone. A rule's tokens are
    its literal runs of letters and digits that a separator, the rule's anchor or its end delimits on either side, so
    any URL it fits has them as whole tokens.
    """
    rules = []
    for line in lines:
        text = line.strip()
        if not text or text[0] in "![" or "##" in text or "#@#" in text or "$" in text:
            continue
        verdict, text = ("allow", text[2:]) if text.startswith("@@") else ("block", text)
        if len(text) > 1 and text[0] == text[-1] == "/":
            rules.append(Rule(verdict, None, text[1:-1].lower(), (), 0))
            continue
        body, head, tail = text.lower(), "", ""
        if body.startswith("||"):
            body, head = body[2:], "^(?:[^/]*[.])?"
        elif body.startswith("|"):
            body, head = re.sub("^[a-z]+://", "", body[1:]), "^"
        if body.endswith("|"):
            body, tail = body[:-1], "$"
        shape = "".join({"*": ".*", "^": "(?:[^a-z0-9_.%-]|$)"}.get(c, re.escape(c)) for c in body)
        edged = f"{'/' if head else '*'}{body}{'/' if tail else '*'}"
        rules.append(Rule(verdict, None, head + shape + tail, tuple(dict.fromkeys(re.findall("(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", edged))), 0))
    return rules


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL column."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def tokens(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.translate(text, UPPER, LOWER), "[^a-z0-9]+")), lambda t: t != "")


#: Where rules stand that have no token; no URL token is empty.
ANYWHERE = ""


def rarest(urls: DataFrame, rules: list[Rule], text: str) -> dict[str, list[Rule]]:
    """Rules by their rarest token; the collected counts are at most one row for each token of the rules."""
    wanted = sorted({t for rule in rules for t in rule.tokens})
    if not wanted:
        return {ANYWHERE: list(rules)}
    own, listed = tokens(F.col(text)), F.split(F.lit(" ".join(wanted)), " ")
    if len(wanted) <= LITERAL_RULES:
        found = urls.select(F.explode(F.array_intersect(own, listed)).alias("token"))
    else:
        found = urls.select(F.explode(own).alias("token")).join(urls.sparkSession.range(1).select(F.explode(listed).alias("token")), "token", "left_semi")
    counts = {row["token"]: row["count"] for row in found.groupBy("token").count().collect()}
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default=ANYWHERE), []).append(rule)
    return index


def _fits(url: Column, weight: Column, pattern: Column) -> Column:
    return (url != "") & F.when(weight > 0, F.rlike(url, pattern)).otherwise(F.rlike(F.translate(url, UPPER, LOWER), pattern))


def _best_literal(named: DataFrame, index: dict[str, list[Rule]], key: str) -> DataFrame:
    entry = lambda r: F.struct(F.lit(r.weight).alias("weight"), F.lit(r.verdict == "allow").alias("allows"), F.lit(r.name).cast("string").alias("name"), F.lit(r.pattern).alias("pattern"))
    kind = "array<struct<weight:int,allows:boolean,name:string,pattern:string>>"
    always = F.array(*map(entry, index.get(ANYWHERE, []))).cast(kind)
    spots = {t: held for t, held in index.items() if t != ANYWHERE}
    if spots:
        table = F.create_map(*[x for token, held in spots.items() for x in (F.lit(token), F.array(*map(entry, held)).cast(kind))])
        hits = F.array_intersect(tokens(F.col(key)), F.array(*map(F.lit, spots)))
        always = F.concat(always, F.flatten(F.transform(hits, lambda t: F.element_at(table, t))))
    fits = F.filter("__candidates", lambda r: _fits(F.col(key), r.weight, r.pattern))
    return named.withColumn("__candidates", always).withColumn("__best", F.array_max(fits)).drop("__candidates")


def _best_joined(named: DataFrame, index: dict[str, list[Rule]], key: str) -> DataFrame:
    rows = [{"token": t, "weight": r.weight, "allows": r.verdict == "allow", "name": r.name, "pattern": r.pattern} for t, held in index.items() for r in held]
    kind = "array<struct<token:string,weight:int,allows:boolean,name:string,pattern:string>>"
    table = named.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))
    own = named.select(key).distinct()
    found = own.select(key, F.explode(F.concat(tokens(F.col(key)), F.array(F.lit(ANYWHERE)))).alias("token")).join(table, "token")
    best = found.where(_fits(F.col(key), F.col("weight"), F.col("pattern"))).groupBy(key).agg(F.max(F.struct("weight", "allows", "name", "pattern")).alias("__best"))
    return named.join(best, key, "left")


def judge(pages: DataFrame, url_col: str = "url", rules: list[Rule] | None = None) -> DataFrame:
    """``pages`` with host, path, rule and verdict added (columns of those names are replaced)."""
    rules = compile_rules() if rules is None else rules
    host, path = parts(F.col(url_col))
    key = "__spot"
    named = pages.withColumns({"__host": host, "__path": path}).withColumn(key, F.concat("__host", "__path"))
    index = rarest(named, rules, key)
    judged = (_best_literal if len(rules) <= LITERAL_RULES else _best_joined)(named, index, key)
    out = judged.withColumns({
        "host": F.col("__host"),
        "path": F.col("__path"),
        "rule": F.col("__best.name"),
        "verdict": F.when(F.coalesce(F.col("__best.allows"), F.lit(True)), "allow").otherwise("block"),
    })
    return out.drop("__host", "__path", key, "__best")


def oracle(host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> str:
    """The same judgement in SQL for DuckDB."""
    ordered = sorted(host_rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda host, path: f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"
    case = lambda pick: " ".join(f"WHEN {fits(h, p)} THEN '{pick(v, h, p)}'" for v, h, p in ordered)
    lowered = f"translate(host || path, '{UPPER}', '{LOWER}')"
    patterns = " OR ".join(f"regexp_matches({lowered}, '{pattern}')" for pattern, _ in pattern_rules)
    return rf"""
WITH cut AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages),
named AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
SELECT page_id, host, path, CASE {case(lambda v, h, p: h + p)} END AS "rule",
  CASE {case(lambda v, h, p: v)} WHEN {patterns} THEN 'block' ELSE 'allow' END AS verdict FROM named"""
