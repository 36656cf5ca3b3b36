"""SimHash near-duplicates by multi-index hashing.

A fingerprint is split into two 32-bit segments. Two fingerprints at most
``RADIUS`` = 3 bits apart differ by at most one bit in one of them, so each
fingerprint enters the table under its own segment values and probes the
Hamming ball of radius one around them. A pair that differs in that one bit is
found by flipping it in whichever side holds a 1, so only set bits are flipped.
Full distances are verified inside each fetched bucket, which emits a spanning
forest of its links, never all pairs. Buckets above ``SPLIT_ROWS`` are first
dealt to sub-buckets by the four bytes of the other segment: two members at
most 3 bits apart agree in at least one of those bytes, so no link is lost.

Defined cases: a null text counts as an empty one; a text without words has
fingerprint zero; rows with a null id keep their fingerprint but take no part
in linking and have a null component; repeated ids and equal texts share one
component; an empty table gives an empty result; other columns are ignored.

``similar_documents`` finds documents of a shingle similarity of 0.8 or more.
Fingerprints link them first, as above, and each link is checked on the
shingles. Texts of that similarity can lie further apart than 3 bits, and there
is an exact way for these: with all shingles in one order, two such texts have
one of their first ones in common (n - ceil(0.8 n) + 1 of n), so each text goes
to the buckets of these. Frequent shingles come last in the order; they are
found in a sample, which changes the size of buckets but not the result. Every
pair of a bucket that can still reach the similarity is compared on its
shingles, unless its members are already known to be in one component, by the
fingerprints or by rounds before; nothing leaves a bucket on an estimate.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.graph.components import connected_components
from spandrel.llm.arrow import frugal, map_rows, slices
from spandrel.session import materialize, release, sweep

RADIUS = 3
SEED = 42
SPLIT_ROWS = 4096


def shingles(text: str | None, width: int) -> list[bytes]:
    """Word shingles of ``text``: A-Z lower-cased, words between ASCII white space, joined by a space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    if len(words) <= width:
        return [b" ".join(words)]
    return [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


def fingerprint(text: str | None, width: int) -> int:
    """Signed 64-bit SimHash: a bit is 1 if it is set in over half the shingle hashes, repeats included."""
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles(text, width)], dtype="<u8")
    if not len(hashes):
        return 0
    octets = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 600:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        table = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
        ones = np.concatenate([np.bincount(octets[:, j], minlength=256) @ table for j in range(8)])
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


#: Texts whose shingles are counted to find the frequent ones, and how many of those are remembered at most.
SAMPLE_TEXTS, FREQUENT = 20_000, 200_000
#: Up to so many pairs of a round, the ids in them are broadcast (two of 8 bytes each) to fetch their texts.
BROADCAST_PAIRS = 500_000


def _text_parts(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, same, tk), and texts (same, rep, node, part): least id, number and component of each distinct text.

    Texts that are equal after lower-casing and white space are one node, so groups of copies cost one row each.
    ``by_id`` links texts that share their least id, too.
    """
    num, den = Fraction(str(similarity)).as_integer_ratio()
    spark = docs.sparkSession
    sweep(spark)

    def make():
        def work(row):
            words = b" ".join((row["t"] or "").encode("utf-8", "surrogatepass").lower().split())
            yield row["i"], xxhash.xxh3_128_digest(words), row["t"]

        return work

    own = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    marked = map_rows(own, make, "doc_id long, same binary, t string", flush=512)
    texts = materialize(marked.where("doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("t", ignorenulls=True).alias("t")), "texts")
    sweep(spark)
    nodes = texts.select("same", "rep", F.xxhash64("same").alias("node"), "t")
    links = _links(nodes, width, num, den)
    if by_id:
        shared = nodes.groupBy("rep").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1")
        links = links.union(shared.join(nodes.select("rep", F.col("node").alias("b")), "rep").select("a", "b"))
    parts = connected_components(links, "a", "b")
    named = nodes.select("same", "rep", "node").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    named = materialize(named.drop("component"), "named")
    release(texts)
    sweep(spark)
    return marked.select("doc_id", "same", F.xxhash64("t").alias("tk")), named


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of each row: components over the links between texts of a shingle similarity of at least ``similarity``."""
    marked, named = _text_parts(docs, id_col, text_col, width, similarity, by_id=True)
    least = materialize(named.groupBy("part").agg(F.min("rep").alias("component_id")).join(named.select("part", "same"), "part").select("same", "component_id"), "least")
    release(named)
    out = marked.select("doc_id", "same").join(least, "same", "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs`` of each group of similar texts, that with the least id; rows with a null id all stay.

    Texts decide, so dissimilar texts under one id stay all. Of rows with one id and equal words, the one with the least
    hash of its text stays, and of identical texts under one id any.
    """
    marked, named = _text_parts(docs, id_col, text_col, width, similarity, by_id=False)
    first = named.groupBy("part").agg(F.min(F.struct("rep", "node", "same")).alias("e")).select(F.col("e.rep").alias("doc_id"), F.col("e.same").alias("same"))
    chosen = materialize(marked.join(first, ["doc_id", "same"]).groupBy("doc_id", "same").agg(F.min("tk").alias("tk")).select(F.col("doc_id").alias("__id"), F.col("tk").alias("__tk")).distinct(), "chosen")
    release(named)
    # What is left to do shuffles all texts once more.
    sweep(docs.sparkSession)
    own = docs.withColumns({"__id": F.col(id_col).cast("long"), "__tk": F.xxhash64(F.col(text_col).cast("string"))})
    kept = own.join(chosen, ["__id", "__tk"], "left_semi").dropDuplicates(["__id", "__tk"])
    return kept.select(*docs.columns).union(docs.where(F.col(id_col).cast("long").isNull()))


def _hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``text``."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, SEED) for s in shingles(text, width)], dtype=np.uint64).view(np.int64))


def _print_links(nodes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b, ca, cb) of nodes whose fingerprints are linked and whose texts have the similarity; ca is a, and cb is b."""
    prints = materialize(fingerprints(nodes, "node", "t", width).withColumnRenamed("doc_id", "node"), "prints")
    unique = materialize(prints.groupBy("fp").agg(F.min("node").alias("rep")), "prints")
    equal = prints.join(unique, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    near = links(unique).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    pairs = materialize(near.union(equal).select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")), "pairs")
    sweep(nodes.sparkSession)
    found = materialize(_verified(pairs, nodes, width, num, den), "links")
    release(prints, unique, pairs)
    return found


def _links(nodes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Verified links (a, b) that connect whatever pairs of a similarity of ``num / den`` connect.

    Fingerprints give the first ones, and the classes that the buckets begin with. Each round takes further members of each
    bucket as leaders and compares them with all later members that are not yet known to be in the same component; a
    bucket goes when all its members are, or all have led.
    """
    spark = nodes.sparkSession
    found = _print_links(nodes, width, num, den)
    classes = materialize(connected_components(found, "ca", "cb").select("node", F.col("component").alias("now")), "classes")
    found = found.select("a", "b")
    sweep(spark)
    step = max(1, nodes.count() // SAMPLE_TEXTS)

    def every():
        def work(row):
            for h in _hashes(row["t"], width).tolist():
                yield (h,)

        return work

    sample = map_rows(nodes.where(F.pmod(F.xxhash64("node"), F.lit(step)) == 0).select("t"), every, "h long", flush=50_000)
    often = sample.groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas()
    often = often.sort_values("h")
    table = spark.sparkContext.broadcast((often["h"].to_numpy(dtype=np.int64), often["n"].to_numpy(dtype=np.int64)))
    keys = nodes.select("node", "t").mapInArrow(frugal(_prefixes(table, width, num, den)), "h long, node long, n int, pos int")
    # Classes enter after this shuffle, the largest, which leaves few of its rows.
    keys = materialize(keys.repartition("h").mapInArrow(frugal(_open_buckets(0, num, den)), _KEY_DDL), "keys")
    sweep(spark)
    held = keys
    keys = keys.join(classes, "node", "left").select("h", "node", "n", "pos", F.coalesce("now", "cls").alias("cls"))
    lo, hi = 0, 1
    while not keys.isEmpty():
        pairs = materialize(keys.repartition("h").mapInArrow(frugal(_bucket_pairs(lo, hi, num, den)), "a long, b long, ca long, cb long").distinct(), "pairs")
        sweep(spark)
        near = materialize(_verified(pairs, nodes, width, num, den), "links")
        release(pairs)
        if not near.isEmpty():
            found = found.union(near.select("a", "b"))
            # Links of this round join the classes known before it.
            classes = connected_components(near, "ca", "cb").select(F.col("node").alias("cls"), F.col("component").alias("now"))
            keys = keys.join(classes, "cls", "left").select("h", "node", "n", "pos", F.coalesce("now", "cls").alias("cls"))
        following = materialize(keys.repartition("h").mapInArrow(frugal(_open_buckets(hi, num, den)), _KEY_DDL), "keys")
        release(held)
        sweep(spark)
        lo, hi, keys, held = hi, 8 * hi, following, following
    return found


_KEY_DDL = "h long, node long, n int, pos int, cls long"


def _prefixes(table, width: int, num: int, den: int):
    """The rarest shingles of each text, as many as two texts of that similarity must have one of in common, and their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = table.value
        for part in slices(batches):
            out = []
            for node, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                own = _hashes(text, width)
                if not len(own):
                    continue
                at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
                count = np.where(known[at] == own, often[at], 0) if len(known) else np.zeros(len(own), dtype=np.int64)
                size = len(own) - -(-num * len(own) // den) + 1
                first = own[np.lexsort((own, count))[:size]]
                out.append((first, np.full(size, node), np.full(size, len(own), dtype=np.int32), np.arange(size, dtype=np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["h", "node", "n", "pos"])

    return run


def _buckets(batches: Iterator[pa.RecordBatch]):
    """Columns of a partition's rows by bucket and node, with each bucket's start and size, and each row's bucket; None without rows.

    Rows without a class are each their own.
    """
    parts = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if not parts:
        return None
    rows = pa.concat_tables(parts)
    h, node, n, pos, cls = (rows[c].to_numpy() for c in ("h", "node", "n", "pos", "cls" if "cls" in rows.column_names else "node"))
    order = np.lexsort((node, h))
    h, node, n, pos, cls = (x[order] for x in (h, node, n, pos, cls))
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    sizes = np.diff(np.r_[starts, len(h)])
    return h, node, n.astype(np.int64), pos.astype(np.int64), cls, starts, sizes, np.repeat(np.arange(len(starts)), sizes)


def _matched(n: np.ndarray, bucket: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which rows have another in their bucket that is not too short or too long for the similarity: then the next by length is one."""
    order = np.lexsort((n, bucket))
    n, bucket = n[order], bucket[order]
    near = (bucket[1:] == bucket[:-1]) & (n[:-1] * den >= num * n[1:])
    out = np.zeros(len(n), dtype=bool)
    out[order] = np.r_[near, False] | np.r_[False, near]
    return out


def _open_buckets(led: int, num: int, den: int):
    """Rows of the buckets with members of several classes, of which more than the first ``led`` have still to lead.

    Before any have led, rows without a possible partner go; later that would change who has led.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _buckets(batches)
        if held is None:
            return
        h, node, n, pos, cls, starts, sizes, bucket = held
        mixed = np.minimum.reduceat(cls, starts) != np.maximum.reduceat(cls, starts)
        keep = (mixed & (sizes > led + 1))[bucket]
        keep = np.flatnonzero(keep if led else keep & _matched(n, bucket, num, den))
        for at in range(0, len(keep), 100_000):
            k = keep[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(h[k]), pa.array(node[k]), pa.array(n[k].astype(np.int32)), pa.array(pos[k].astype(np.int32)), pa.array(cls[k])], names=["h", "node", "n", "pos", "cls"])

    return run


def _bucket_pairs(lo: int, hi: int, num: int, den: int):
    """Pairs of the ``lo``-th to ``hi``-th member of each bucket with its later members of other classes.

    If the bucket is that of the first shingle that a pair has in common, no more can be common than follow on either side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _buckets(batches)
        if held is None:
            return
        _, node, n, pos, cls, starts, sizes, bucket = held
        rank = np.arange(len(node)) - starts[bucket]
        for i in range(lo, min(hi, int(sizes.max()) - 1)):
            later = np.flatnonzero(rank > i)
            lead = starts[bucket[later]] + i
            most = np.minimum(n[lead] - pos[lead], n[later] - pos[later])
            some = (cls[lead] != cls[later]) & (most * (num + den) >= num * (n[lead] + n[later]))
            if some.any():
                both = np.unique(np.stack([node[lead[some]], node[later[some]], cls[lead[some]], cls[later[some]]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, j].copy()) for j in range(4)], names=["a", "b", "ca", "cb"])

    return run


def _verified(pairs: DataFrame, nodes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs whose texts have the similarity."""

    def make():
        last: dict[int, np.ndarray] = {}

        def held(node, text):
            if node not in last:
                if len(last) > 64:
                    last.clear()
                last[node] = _hashes(text, width)
            return last[node]

        def work(row):
            x, y = held(row["a"], row["ta"]), held(row["b"], row["tb"])
            if len(np.intersect1d(x, y, assume_unique=True)) * (num + den) >= num * (len(x) + len(y)):
                yield row["a"], row["b"], row["ca"], row["cb"]

        return work

    ids = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node")
    if pairs.count() <= BROADCAST_PAIRS:
        # Only the texts of these pairs are shuffled; with more pairs than that all of them are.
        nodes = nodes.join(F.broadcast(ids), "node", "left_semi")
    sides = nodes.select(F.col("node").alias("a"), F.col("t").alias("ta")), nodes.select(F.col("node").alias("b"), F.col("t").alias("tb"))
    joined = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "ca", "cb", "ta", "tb")
    return map_rows(joined, make, "a long, b long, ca long, cb long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(doc_id, fp): one row per input row; the id column is a long."""

    def make():
        last: dict[str, int] = {}

        def work(row):
            text = row["t"] or ""
            if text not in last:
                if len(last) > 64:
                    last.clear()
                last[text] = fingerprint(text, width)
            yield row["i"], last[text]

        return work

    return map_rows(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")), make, "doc_id long, fp long")


def _spanning(rep: np.ndarray, fp: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spanning forest of the pairs at most RADIUS bits apart: each node is expanded once, against what is left."""
    left = np.arange(1, len(fp))
    todo = [0]
    while True:
        while todo:
            at = todo.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= RADIUS
            for found in left[near].tolist():
                yield int(rep[at]), int(rep[found])
                todo.append(found)
            left = left[~near]
            if not len(left):
                return
        todo.append(int(left[0]))
        left = left[1:]
        if not len(left):
            return


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside the buckets of one partition; its rows are fixed-width keys sorted by bucket."""
    parts = [pa.Table.from_batches([b]) for b in batches]
    if not parts:
        return
    rows = pa.concat_tables(parts)
    seg, key, sub = (rows[c].to_numpy() for c in ("seg", "key", "sub"))
    own = rows["own"].to_numpy(zero_copy_only=False)
    rep, fp = rows["rep"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
    order = np.lexsort((rep, sub, key, seg))
    seg, key, sub, own, rep, fp = (x[order] for x in (seg, key, sub, own, rep, fp))
    new = np.r_[True, (seg[1:] != seg[:-1]) | (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.r_[starts, len(seg)])
    held = np.add.reduceat(own.astype(np.int64), starts) if len(starts) else starts
    found: list[tuple[int, int]] = []
    for i in np.flatnonzero((sizes > 1) & (held > 0)):
        span = slice(starts[i], starts[i] + sizes[i])
        found.extend(_spanning(rep[span], fp[span]))
    for at in range(0, len(found), 100_000):
        a, b = zip(*found[at : at + 100_000])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["src", "dst"])


def links(unique: DataFrame) -> DataFrame:
    """(src, dst) spanning links between the representatives of distinct fingerprints (columns rep, fp)."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col("fp"), 32)

    def ball(segment: int, value):
        flips = F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: F.pow(F.lit(2.0), b).cast("long")), lambda m: value.bitwiseAND(m) != 0)
        exact = F.array(F.struct(F.lit(segment).alias("seg"), value.alias("key"), F.lit(True).alias("own")))
        near = F.transform(flips, lambda m: F.struct(F.lit(segment).alias("seg"), value.bitwiseXOR(m).alias("key"), F.lit(False).alias("own")))
        return F.concat(exact, near)

    rows = unique.select("rep", "fp", F.explode(F.concat(ball(0, low), ball(1, high))).alias("e")).select("e.*", "rep", "fp")
    hot = rows.groupBy("seg", "key").agg(F.count("*").alias("n"), F.max("own").alias("any")).where(f"n > {SPLIT_ROWS} and any").select("seg", "key", F.lit(1).alias("hot"))
    other = F.when(F.col("seg") == 0, high).otherwise(low)
    subs = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: j.cast("long") * 256 + F.pmod((other / F.pow(F.lit(256.0), j)).cast("long"), F.lit(256).cast("long")))
    dealt = rows.join(hot, ["seg", "key"], "left").select("seg", "key", "own", "rep", "fp", F.explode(F.when(F.col("hot") == 1, subs).otherwise(F.array(F.lit(-1).cast("long")))).alias("sub"))
    return dealt.repartition("seg", "key", "sub").mapInArrow(frugal(_bucket_links), "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``; ``component_id`` is the smallest id reachable over links."""
    prints = materialize(fingerprints(docs, id_col, text_col, width), "simhash")
    unique = materialize(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash")
    parts = connected_components(links(unique)).withColumnRenamed("node", "rep")
    named = unique.join(parts, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = prints.join(named, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
