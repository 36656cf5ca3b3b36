"""Line dedup by pairwise alignment.

Overlapping documents are found through the hashes of lines they share, and
each pair is aligned with patience diff: equal lines at both ends, then the
longest chain of units that occur once on either side, then the same in the
gaps. A unit is a line, with as many lines after it as ``MIN_CHARS`` characters
take. Aligned blocks of at least ``MIN_CHARS`` characters are deleted from the
later document, their short and blank lines too. The result is that of aligning
every document with every earlier one, without doing all of that:

* Only lines that another document may share are kept of a document (short ones
  count by their neighbours); documents of which the same lines remain, in the
  same runs, are one class and are aligned once.
* A first round aligns each class with the earliest class of each unit. What is
  gone from all members of a class asks for nothing more.
* For the lines that are left, a class is a candidate only if it can align them:
  it holds the line once, as they do; or the line and a neighbour; or it begins
  or ends alike; or it holds the line along with a unit that occurs once in both
  (looked up through the rarer of the two). Candidates are taken in the order of
  their first documents, more of them each round, until none is left.

Lines are compared by 64-bit hashes of what is between white space at their ends.

Defined cases: documents are ordered by id, those that share an id by a hash of
their text; identical rows count as one document; rows with a null id and null
or empty texts stay as they are (null stays null); a document of less than
``MIN_CHARS`` characters goes if all its lines are those of an earlier one, blank
documents stay; a document all of whose lines go keeps an empty text; an empty
table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.llm.arrow import map_rows
from spandrel.session import materialize, release

MIN_CHARS = 16
#: Candidates of a key that a round reaches: the first, then this many times as many each round.
WIDER = 16
#: Requests for pairs of keys that one document makes at most before it asks for one key of each pair alone.
REQUESTS = 10_000
#: What counts as white space at the ends of a line.
WHITE = " \t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: Size of the mark between runs of lines.
APART = 255
ONCE, OFTEN, WINDOW, NEXT, FIRST, LAST = range(6)


def longest_chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain of pairs that increases on both sides; ``pairs`` is sorted by its first side, strictly.

    Of several, the one whose pairs, from the last backwards, come latest.
    """
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tails, b)
        before[i] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(b)
            ends.append(i)
        else:
            tails[at], ends[at] = b, i
    chain, i = [], ends[-1] if ends else -1
    while i >= 0:
        chain.append(pairs[i])
        i = before[i]
    return chain[::-1]


class Lines:
    """Line hashes and sizes of a document or class, with its units: where each ends, and its bytes."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray):
        self.raw = tokens.tobytes()
        self.tokens, self.sizes = tokens.tolist(), sizes.tolist()
        self.ends = self._ends()
        self.units = {u: self.bytes(u, v) for u, v in self.ends.items()}

    @classmethod
    def packed(cls, data: bytes) -> Lines:
        n = len(data) // 9
        return cls(np.frombuffer(data, "<i8", n), np.frombuffer(data, np.uint8, n, 8 * n))

    def bytes(self, u: int, v: int) -> bytes:
        return self.raw[8 * u : 8 * v + 8]

    def _ends(self) -> dict[int, int]:
        out: dict[int, int] = {}
        sizes, end, held = self.sizes, 0, 0
        for start, size in enumerate(sizes):
            if end <= start:
                end, held = start, 0
            if size == APART:
                continue
            while end < len(sizes) and held < MIN_CHARS and sizes[end] != APART:
                held += sizes[end]
                end += 1
            if size and held >= MIN_CHARS:
                out[start] = end - 1
            held -= size
        return out

    def once(self) -> set[bytes]:
        """Units that occur once."""
        seen: dict[bytes, int] = {}
        for unit in self.units.values():
            seen[unit] = seen.get(unit, 0) + 1
        return {unit for unit, n in seen.items() if n == 1}

    def windows(self, p: int) -> list[tuple[int, int]]:
        """Least runs of lines of ``MIN_CHARS`` characters around line ``p``."""
        sizes, out, left, u = self.sizes, [], 0, p
        while u >= 0 and sizes[u] != APART:
            left += sizes[u]
            v, held = p, left
            while held < MIN_CHARS and v + 1 < len(sizes) and sizes[v + 1] != APART:
                v += 1
                held += sizes[v]
            if held >= MIN_CHARS and (u == p or held - sizes[u] < MIN_CHARS):
                out.append((u, v))
            if left >= MIN_CHARS:
                break
            u -= 1
        return out


def align(late: Lines, early: Lines) -> list[int]:
    """Positions of the later document in blocks that patience diff aligns with the earlier one."""
    a, b, sizes = late.tokens, early.tokens, late.sizes
    taken: dict[int, int] = {}
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0] and sizes[a0] != APART and early.sizes[b0] != APART:
            taken[a0] = b0
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1] and sizes[a1 - 1] != APART and early.sizes[b1 - 1] != APART:
            a1, b1 = a1 - 1, b1 - 1
            taken[a1] = b1
        if a0 == a1 or b0 == b1:
            continue
        places: list[dict[bytes, int]] = []
        for side, lo, hi in ((late, a0, a1), (early, b0, b1)):
            found: dict[bytes, int] = {}
            for u in range(lo, hi):
                if side.ends.get(u, hi) < hi:
                    unit = side.units[u]
                    found[unit] = -1 if unit in found else u
            places.append(found)
        anchors = longest_chain(sorted((u, places[1][k]) for k, u in places[0].items() if u >= 0 and places[1].get(k, -1) >= 0))
        if not anchors:
            continue
        taken.update(anchors)
        for (p, q), (r, s) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]):
            if r - p > 1 and s - q > 1:
                todo.append((p + 1, r, q + 1, s))
    out: list[int] = []
    block: list[int] = []
    for p in [*sorted(taken), None]:
        if block and (p is None or p != block[-1] + 1 or taken[p] != taken[block[-1]] + 1):
            if sum(sizes[x] for x in block) >= MIN_CHARS:
                out += block
            block = []
        block.append(p)
    return out


def _key(kind: int, data: bytes) -> int:
    return xxhash.xxh64_intdigest(data, kind) - (1 << 63)


def plain_keys(lines: Lines) -> set[int]:
    """Keys of the units."""
    once = lines.once()
    return {_key(ONCE if unit in once else OFTEN, unit) for unit in lines.units.values()}


def line_keys(lines: Lines, p: int) -> set[int]:
    """Keys of line ``p`` but that of its own unit: who aligns it in a block of several lines, or at an end, has one of them."""
    sizes, n = lines.sizes, len(lines.sizes)
    if sizes[p] < MIN_CHARS:
        return {_key(WINDOW, lines.bytes(u, v)) for u, v in lines.windows(p)}
    out = {_key(NEXT, lines.bytes(u, u + 1)) for u in (p - 1, p) if u >= 0 and u + 1 < n and APART not in (sizes[u], sizes[u + 1])}
    if p == 0:
        out.add(_key(FIRST, lines.bytes(p, p)))
    if p == n - 1:
        out.add(_key(LAST, lines.bytes(p, p)))
    return out


def _line_table(own: DataFrame) -> DataFrame:
    """(doc_id, tk, lines): hash and size (up to MIN_CHARS) of each line of each document."""
    bare = F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(WHITE)))
    lines = F.transform(bare, lambda x: F.struct(F.xxhash64(x).alias("h"), F.least(F.char_length(x), F.lit(MIN_CHARS)).cast("byte").alias("n")))
    return own.where("doc_id is not null and text is not null").select("doc_id", "tk", lines.alias("lines"))


def _shared_lines(table: DataFrame) -> DataFrame:
    """(doc_id, tk, total, lines): of each document, the lines that another may share, with their positions.

    A long line counts by its hash, a short one by those of it and a neighbour; a document of few characters is one line, at -1.
    """
    lines = F.col("lines")

    def both(x, i):
        pair = lambda a, b: F.xxhash64(F.lit(NEXT), a["h"], b["h"])
        before, after = F.get("lines", i - 1), F.get("lines", i + 1)
        short = F.array(F.when(i > 0, pair(before, x)), F.when(i + 1 < F.size("lines"), pair(x, after)))
        keys = F.when(x["n"] >= MIN_CHARS, F.array(x["h"])).otherwise(F.array_compact(short))
        return F.transform(keys, lambda k: F.struct(k.alias("k"), i.alias("pos"), x["h"].alias("h"), x["n"].alias("n")))

    whole = F.xxhash64(F.lit(FIRST), F.transform(lines, lambda x: x["h"]))
    tiny = F.array(F.struct(whole.alias("k"), F.lit(-1).alias("pos"), whole.alias("h"), F.lit(MIN_CHARS).cast("byte").alias("n")))
    sized = table.withColumn("chars", F.aggregate(lines, F.lit(0), lambda s, x: F.least(s + x["n"], F.lit(MIN_CHARS)))).where("chars > 0")
    rows = sized.select("doc_id", "tk", F.size("lines").alias("total"), F.explode(F.when(F.col("chars") < MIN_CHARS, tiny).otherwise(F.flatten(F.transform(lines, both)))).alias("e")).select("doc_id", "tk", "total", "e.*")
    who = F.xxhash64("doc_id", "tk")
    # Written, so that the join has two plain shuffles and a hot key can be split.
    shared = materialize(rows.groupBy("k").agg(F.min(who).alias("a"), F.max(who).alias("b")).where("a <> b").select("k"), "shared")
    kept = rows.join(shared, "k", "left_semi")
    return kept.groupBy("doc_id", "tk").agg(F.first("total").alias("total"), F.sort_array(F.collect_set(F.struct("pos", "h", "n"))).alias("lines"))


def _sequences():
    """A document's runs of shared lines that have ``MIN_CHARS`` characters, with marks between them, and the positions."""

    def work(row):
        runs: list[list[tuple]] = []
        for at, h, n in zip(row["pos"], row["h"], row["n"]):
            if not runs or at != runs[-1][-1][0] + 1:
                runs.append([])
            runs[-1].append((at, h, n))
        runs = [r for r in runs if sum(x[2] for x in r) >= MIN_CHARS]
        if not runs:
            return
        whole = runs[0][0][0] < 0
        seq = [] if whole or runs[0][0][0] == 0 else [(-2, 0, APART)]
        for i, r in enumerate(runs):
            seq += [(-2, 0, APART)] * (i > 0) + r
        if not whole and runs[-1][-1][0] + 1 < row["total"]:
            seq.append((-2, 0, APART))
        places, tokens, sizes = zip(*seq)
        data = np.array(tokens, dtype="<i8").tobytes() + bytes(sizes)
        yield row["doc_id"], row["tk"], xxhash.xxh3_128_digest(data), list(places), data

    return work


def _held():
    """All keys of a class."""

    def work(row):
        lines = Lines.packed(row["seq"])
        found = plain_keys(lines)
        for p, size in enumerate(lines.sizes):
            if size != APART:
                found |= line_keys(lines, p)
        for k in found:
            yield k, row["cid"], row["low"]["id"], row["low"]["tk"]

    return work


def _first_wish():
    def work(row):
        for k in plain_keys(Lines.packed(row["seq"])):
            yield k, row["cid"], row["high"]["id"], row["high"]["tk"]

    return work


def _wishes():
    """For each line of a class that some member still holds: keys of those who can align it before its bound.

    ``k`` alone asks for the holders of a key; ``x1``, ``xm`` and ``k`` for those of ``k`` that also hold one of the others.
    """

    def work(row):
        lines = Lines.packed(row["seq"])
        low, high = (row["low"]["id"], row["low"]["tk"]), (row["high"]["id"], row["high"]["tk"])
        since = {x["pos"]: (x["since"]["id"], x["since"]["tk"]) for x in row["hits"] or ()}
        once = lines.once()
        ones = sorted(_key(ONCE, unit) for unit in once)
        left = [(p, since.get(p, high)) for p, size in enumerate(lines.sizes) if size != APART and since.get(p, high) >= low]
        twice = sum(p in lines.units and lines.units[p] not in once for p, _ in left)
        for p, bound in left:
            keys = line_keys(lines, p)
            unit = lines.units.get(p)
            if unit is not None and lines.sizes[p] >= MIN_CHARS:
                if unit in once:
                    keys.add(_key(ONCE, unit))
                    if len(once) > 1:
                        keys.add(_key(OFTEN, unit))
                elif twice * len(ones) <= REQUESTS:
                    for y in ones:
                        yield y, _key(ONCE, unit), _key(OFTEN, unit), row["cid"], p, *bound
                else:
                    keys.update(ones)
            for k in keys:
                yield k, None, None, row["cid"], p, *bound

    return work


def _aligned():
    last: list = [None, None]

    def work(row):
        if last[0] != row["seq"]:
            last[:] = row["seq"], Lines.packed(row["seq"])
        found = align(last[1], Lines.packed(row["e_seq"]))
        if found:
            yield row["cid"], found, row["e_low"]["id"], row["e_low"]["tk"]

    return work


def _who() -> Column:
    return F.struct(F.col("s_id").alias("id"), F.col("s_tk").alias("tk"))


def _hits(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cid, pos, since): the first document of the classes that align each line of a class."""
    sides = classes.select("cid", "seq"), classes.select(F.col("cid").alias("e_cid"), F.col("seq").alias("e_seq"), F.col("low").alias("e_low"))
    found = map_rows(pairs.join(sides[1], "e_cid").join(sides[0], "cid").select("cid", "seq", "e_seq", "e_low"), _aligned, "cid binary, pos array<int>, s_id long, s_tk long")
    return found.select("cid", F.explode("pos").alias("pos"), _who().alias("since")).groupBy("cid", "pos").agg(F.min("since").alias("since"))


def _class_hits(classes: DataFrame) -> DataFrame:
    """(cid, pos, since) over whatever earlier classes align, and later members with their own class."""
    keys = materialize(map_rows(classes.select("cid", "seq", "low"), _held, "k long, cid binary, s_id long, s_tk long"), "keys")
    holders = keys.select("k", F.col("cid").alias("e_cid"), _who().alias("e_low"))
    # A class is a candidate for itself, for the members after the first.
    heads = materialize(holders.groupBy("k").agg(F.min(F.struct("e_low", "e_cid")).alias("e")).select("k", "e.*"), "heads")
    wishes = map_rows(classes.select("cid", "seq", "high"), _first_wish, "k long, cid binary, s_id long, s_tk long").select("k", "cid", _who().alias("bound"))
    tried = materialize(wishes.join(heads, "k").where("e_low < bound").select("cid", "e_cid").distinct(), "pairs")
    hits = materialize(_hits(tried, classes), "hits")
    per = hits.groupBy("cid").agg(F.collect_list(F.struct("pos", "since")).alias("hits"))
    asked = map_rows(classes.join(per, "cid", "left").select("cid", "seq", "low", "high", "hits"), _wishes, "k long, x1 long, xm long, cid binary, pos int, s_id long, s_tk long")
    asked = materialize(asked.select("k", "x1", "xm", "cid", "pos", _who().alias("bound")), "asked")
    # A request for two keys goes by the one with fewer holders.
    double = asked.where("x1 is not null")
    named = double.select("k").union(double.select("x1")).union(double.select("xm")).distinct()
    count = materialize(keys.join(named, "k", "left_semi").groupBy("k").agg(F.count("*").alias("n")), "counts")
    sized = double
    for name in ("k", "x1", "xm"):
        sized = sized.join(count.select(F.col("k").alias(name), F.col("n").alias(f"n_{name}")), name, "left")
    rarer = "coalesce(n_x1, 0L) + coalesce(n_xm, 0L) < coalesce(n_k, 0L)"
    other = F.when(F.expr(rarer), F.array(F.struct(F.col("x1").alias("k"), F.array("k").alias("need")), F.struct(F.col("xm").alias("k"), F.array("k").alias("need")))).otherwise(F.array(F.struct(F.col("k"), F.array("x1", "xm").alias("need"))))
    split = sized.select(F.explode(other).alias("e"), "cid", "pos", "bound").select("e.k", "e.need", "cid", "pos", "bound")
    single = asked.where("x1 is null").select("k", F.lit(None).cast("array<bigint>").alias("need"), "cid", "pos", "bound")
    wishes = materialize(single.union(split), "wishes")
    holders = materialize(holders.join(wishes.select("k").distinct(), "k", "left_semi"), "holders")
    lows = classes.select("cid", "low")
    lo, hi = 0, WIDER
    while True:
        place = Window.partitionBy("k").orderBy("e_low", "e_cid")
        near = holders.withColumn("rank", F.row_number().over(place)).where(f"rank <= {hi}").where(f"rank > {lo}")
        now = wishes.join(hits, ["cid", "pos"], "left").join(lows, "cid").withColumn("bound", F.least("bound", "since")).where("since is null or since >= low")
        reach = now.groupBy("k", "need", "cid").agg(F.max("bound").alias("bound"))
        met = materialize(reach.join(near, "k").where("e_low < bound").select("cid", "e_cid", "need").distinct(), "met")
        if met.isEmpty():
            release(keys, heads, tried, asked, count, wishes, holders, met)
            return hits
        open_ = met.where("need is null").select("cid", "e_cid")
        both = met.where("need is not null").select("cid", "e_cid", F.explode("need").alias("k")).join(keys.select("k", F.col("cid").alias("e_cid")), ["k", "e_cid"], "left_semi").select("cid", "e_cid")
        pairs = open_.union(both).distinct()
        pairs = materialize(pairs.join(tried, ["cid", "e_cid"], "left_anti"), "pairs")
        hits = materialize(hits.union(_hits(pairs, classes)).groupBy("cid", "pos").agg(F.min("since").alias("since")), "hits")
        tried = materialize(tried.union(pairs), "tried")
        lo, hi = hi, WIDER * hi


def _kept_runs():
    """Runs of lines (first, count) that stay, of documents that lose some; the last run goes on to the end."""

    def work(row):
        me = (row["doc_id"], row["tk"])
        gone = sorted(row["places"][x["pos"]] for x in row["hits"] if (x["since"]["id"], x["since"]["tk"]) < me)
        if not gone:
            return
        if gone[0] < 0:
            yield *me, [], 1
            return
        kept, at = [], 0
        for p in gone:
            if p > at:
                kept.append({"at": at, "n": p - at})
            at = p + 1
        blocks = sum(i == 0 or p != gone[i - 1] + 1 for i, p in enumerate(gone))
        yield *me, [*kept, {"at": at, "n": 1 << 30}], blocks

    return work


def _runs_left(own: DataFrame) -> DataFrame:
    """(doc_id, tk, kept, blocks) of the documents that lose lines."""
    table = materialize(_line_table(own), "lines")
    shared = _shared_lines(table).select("doc_id", "tk", "total", *[F.col(f"lines.{c}").alias(c) for c in ("pos", "h", "n")])
    members = materialize(map_rows(shared, _sequences, "doc_id long, tk long, cid binary, places array<int>, seq binary"), "members")
    who = F.struct(F.col("doc_id").alias("id"), "tk")
    classes = materialize(members.groupBy("cid").agg(F.min(who).alias("low"), F.max(who).alias("high"), F.first("seq").alias("seq")), "classes")
    hits = materialize(_class_hits(classes).groupBy("cid").agg(F.collect_list(F.struct("pos", "since")).alias("hits")), "hits")
    out = materialize(map_rows(members.drop("seq").join(hits, "cid").drop("cid"), _kept_runs, "doc_id long, tk long, kept array<struct<at:int,n:int>>, blocks int"), "kept")
    release(table, members, classes)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` deduplicated and n_lines, n_removed, n_blocks added (columns of those names are replaced)."""
    added = ("n_lines", "n_removed", "n_blocks")
    rest = [c for c in docs.columns if c not in (id_col, text_col, *added)]
    carried = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(None).cast("struct<none:int>")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), carried.alias("rest")).withColumn("tk", F.xxhash64("text"))
    joined = own.join(_runs_left(own.select("doc_id", "tk", "text")), ["doc_id", "tk"], "left")
    lines = F.split("text", "\n")
    left = F.flatten(F.transform("kept", lambda k: F.slice(lines, k["at"] + 1, k["n"])))
    total = F.coalesce(F.size(lines), F.lit(1)).cast("long")
    cut = joined.select("doc_id", "text", "rest", "blocks", total.alias("total"), F.when(F.col("kept").isNotNull(), left).alias("left"))
    text = F.when(F.col("left").isNotNull(), F.array_join("left", "\n")).otherwise(F.col("text"))
    removed = F.when(F.col("left").isNotNull(), F.col("total") - F.size("left")).otherwise(F.lit(0)).cast("long")
    counts = F.when(F.col("text").isNull(), F.lit(1)).otherwise(F.col("total")).cast("long"), removed, F.coalesce("blocks", F.lit(0)).cast("long")
    return cut.select(F.col("doc_id").alias(id_col), text.alias(text_col), *[F.col(f"rest.`{c}`") for c in rest], *[c.alias(n) for c, n in zip(counts, added)])


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """Per document: lines, removed lines and blocks, bytes and digest of what is kept (a null text counts as empty here)."""
    kept = F.coalesce("text", F.lit(""))
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_blocks", F.octet_length(kept).cast("long").alias("n_kept_bytes"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))
