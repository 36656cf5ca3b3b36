"""Line, SimHash and suffix deduplication against brute force."""

import hashlib
import os
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from spandrel.llm import line_dedup, simhash, suffix_dedup
from spandrel.session import materialize, release, shared_dir, sweep


def plain_fingerprint(text, width):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words)] if len(words) < width else [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    ones = Counter()
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        ones.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(parts))


def components(ids, prints):
    parent = dict(enumerate(ids))
    group = list(range(len(ids)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                group[root(a)] = root(b)
    least = {}
    for a in range(len(ids)):
        least[root(a)] = min(parent[a], least.get(root(a), parent[a]))
    return [least[root(a)] for a in range(len(ids))]


@pytest.mark.parametrize("width", [3, 5])
def test_simhash_equals_brute_force(docs, corpus, width):
    rows = [(i, plain_fingerprint(t, width)) for i, t, *_ in corpus if i is not None]
    want = Counter(zip([i for i, _ in rows], [f"{f:016x}" for _, f in rows], components([i for i, _ in rows], [f for _, f in rows])))
    found = simhash.near_duplicates(docs, width=width).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found if r.doc_id is not None) == want
    lost = [r for r in found if r.doc_id is None]
    assert len(lost) == 2 and all(r.component_id is None and len(r.fingerprint) == 16 for r in lost)


def test_simhash_of_many_segments_and_hot_buckets(spark, monkeypatch):
    """A bucket over the split size is dealt to sub-buckets and loses no link."""
    monkeypatch.setattr(simhash, "SPLIT_ROWS", 8)
    rng = random.Random(1)
    low = 0x12345678
    prints = sorted({low | ((rng.getrandbits(32) & 0x0F0F00FF) << 32) for _ in range(120)} | {low ^ (1 << b) for b in range(32)} | {rng.getrandbits(62) for _ in range(50)})
    df = spark.createDataFrame([(i, f) for i, f in enumerate(prints)], "rep long, fp long")
    from spandrel.graph.components import connected_components

    found = {r.node: r.component for r in connected_components(simhash.links(df)).collect()}
    want = components(list(range(len(prints))), prints)
    assert [found.get(i, i) for i in range(len(prints))] == want


def test_simhash_edges(empty, nothing, clashing, docs):
    assert simhash.near_duplicates(empty).count() == 0
    assert {tuple(r) for r in simhash.near_duplicates(nothing).collect()} == {(None, "0" * 16, None)}
    key = lambda df: sorted(map(str, df.collect()))
    assert key(simhash.near_duplicates(clashing)) == key(simhash.near_duplicates(docs))


def test_similar_documents(docs, corpus, empty, nothing):
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect() if r.doc_id is not None}
    rows = {i: (t, set(simhash.shingles(t, 5))) for i, t, *_ in corpus if i is not None}
    for a in rows:
        for b in rows:
            (s, x), (t, y) = rows[a], rows[b]
            j = len(x & y) / len(x | y) if x | y else 1.0
            if (s or "").lower().split() == (t or "").lower().split():
                assert found[a] == found[b]
            if j < 0.3 and x and y:
                assert found[a] != found[b] or any(found[c] == found[a] for c in rows if c not in (a, b))
    near = [(a, b) for a in rows for b in rows if a < b and len(rows[a][1]) > 20 and len(rows[a][1] & rows[b][1]) >= 0.85 * len(rows[a][1] | rows[b][1])]
    assert near and sum(found[a] == found[b] for a, b in near) >= 0.9 * len(near)
    assert simhash.similar_documents(empty).count() == 0
    assert {tuple(r) for r in simhash.similar_documents(nothing).collect()} == {(None, None)}


def brute_repeats(rows):
    first, out = {}, Counter()
    solid = [(i, (t or "").encode()) for i, t in rows if i is not None]
    for i, b in solid:
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            first[w] = min(i, first.get(w, i))
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        if i is not None:
            for k in range(len(b) - 49):
                if first[b[k : k + 50]] < i:
                    gone[k : k + 50] = True
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(b) else 0
        out[(i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())] += 1
    return out


def test_suffix_equals_brute_force(docs, corpus, clashing):
    want = brute_repeats([(i, t) for i, t, *_ in corpus])
    for df in (docs, clashing):
        assert Counter(tuple(r) for r in suffix_dedup.remove_repeats(df).collect()) == want


@pytest.mark.parametrize("hot", [2, 5, 10**6])
def test_suffix_small_packs_and_periodic_texts(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_PACKS", hot)
    monkeypatch.setattr(suffix_dedup, "PACK_BYTES", 400)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 300)
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 160)))) for i in range(25)]
    rows += [(30 + i, c * n) for i, (c, n) in enumerate([("ab", 60), ("ba", 40), ("x", 49), ("x", 50), ("x", 300), ("\0", 70), ("\0", 60), ("é", 40), ("é", 25)])]
    rows += [(i + 100, rows[i][1][5:120] + rows[i + 1][1]) for i in range(20)]
    passage = "".join(rng.choice("abcdefgh") for _ in range(70))
    rows += [(i + 200, "".join(rng.choice("xyz") for _ in range(60)) + passage + "".join(rng.choice("xyz") for _ in range(60))) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(tuple(r) for r in suffix_dedup.remove_repeats(df).collect()) == brute_repeats(rows)


def test_suffix_long_documents_are_cut_into_slices(monkeypatch):
    data = np.frombuffer(random.Random(1).randbytes(3000), dtype=np.uint8)
    whole = suffix_dedup.minimizer_runs(data)
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    cut = suffix_dedup.minimizer_runs(data)
    place = lambda runs: {s: p for p, a, b in zip(*[x.tolist() for x in runs[1:]]) for s in range(a, b + 1)}
    assert place(whole) == place(cut)


def test_suffix_edges(empty, nothing):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert {r.n_removed for r in suffix_dedup.remove_repeats(nothing).collect()} == {0}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=50, max_size=70), min_size=1, max_size=5))
def test_suffix_classes_rank_by_prefix(texts):
    block = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    starts = np.arange(len(block) - 49)
    ranks = suffix_dedup.suffix_classes(block, starts)
    raw = block.tobytes()
    keys = [raw[s : s + 50] for s in starts]
    order = {k: i for i, k in enumerate(sorted(set(keys)))}
    assert [order[k] for k in keys] == ranks.tolist()
    owner = np.random.default_rng(0).integers(0, 9, len(starts))
    lpf = suffix_dedup.previous_factors(ranks, owner)
    for i, k in enumerate(keys):
        # By definition: the longest common prefix with any suffix of a smaller owner, up to 50 bytes, shorter ones as 0.
        assert lpf[i] == (50 if any(owner[j] < owner[i] and keys[j] == k for j in range(len(keys))) else 0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.booleans()), max_size=40))
def test_nearest_smaller_values(rows):
    value, joined = np.array([v for v, _ in rows], dtype=np.int64), np.array([j and i > 0 for i, (_, j) in enumerate(rows)], dtype=bool)
    found = suffix_dedup._smaller_before(value, joined)
    for i in range(len(rows)):
        at = i - 1
        while at >= 0 and all(joined[at + 1 : i + 1]) and value[at] >= value[i]:
            at -= 1
        assert found[i] == (at if at >= 0 and all(joined[at + 1 : i + 1]) else -1)


def chain(points):
    """Longest increasing chain of points (first side ascending); of several, the one that is latest from its end backwards."""
    rank = []
    for i, (_, y) in enumerate(points):
        rank.append(1 + max((rank[j] for j in range(i) if points[j][1] < y), default=0))
    out, at = [], len(points)
    for r in range(max(rank, default=0), 0, -1):
        at = max(i for i in range(at) if rank[i] == r and (not out or points[i][1] < out[-1][1]))
        out.append(points[at])
    return out[::-1]


def units(lines, lo, hi):
    """Start of each run of lines from a line that is not blank to 16 characters in all, by its lines, inside lo..hi."""
    found = {}
    for u in range(lo, hi):
        v = u
        while lines[u] and v < hi and sum(min(16, len(x)) for x in lines[u : v + 1]) < 16:
            v += 1
        if lines[u] and v < hi:
            found.setdefault(tuple(lines[u : v + 1]), []).append(u)
    return found


def patience(a, b):
    """Pairs of lines that patience diff aligns, recursively over lists of lines."""

    def step(a0, a1, b0, b1):
        if a0 == a1 or b0 == b1:
            return []
        if a[a0] == b[b0]:
            return [(a0, b0), *step(a0 + 1, a1, b0 + 1, b1)]
        if a[a1 - 1] == b[b1 - 1]:
            return [*step(a0, a1 - 1, b0, b1 - 1), (a1 - 1, b1 - 1)]
        x, y = units(a, a0, a1), units(b, b0, b1)
        anchors = chain(sorted((x[k][0], y[k][0]) for k in x if len(x[k]) == 1 and len(y.get(k, ())) == 1))
        if not anchors:
            return []
        fences = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        return anchors + [z for (p, q), (r, s) in zip(fences, fences[1:]) for z in step(p + 1, r, q + 1, s)]

    return step(0, len(a), 0, len(b))


def brute_lines(rows):
    """Text and removed lines of each (id, text) after its alignment with every earlier one; no hashes, classes or candidates."""
    docs, out = sorted({r for r in rows if r[0] is not None and r[1] is not None}), {}
    bare = [[x.strip() for x in t.split("\n")] for _, t in docs]
    for at, (i, t) in enumerate(docs):
        a, gone = bare[at], set()
        size = lambda ps: sum(min(16, len(a[p])) for p in ps)  # noqa: E731, B023
        for b in bare[:at]:
            if size(range(len(a))) < 16:
                gone |= set(range(len(a))) if a == b and any(a) else set()
                continue
            if not set(filter(None, a)) & set(b):
                continue
            block = []
            for p, q in [*sorted(patience(a, b)), (-9, -9)]:
                if block and (p, q) != (block[-1][0] + 1, block[-1][1] + 1):
                    gone |= {x for x, _ in block} if size(x for x, _ in block) >= 16 else set()
                    block = []
                block.append((p, q))
        out[(i, t)] = ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), len(gone))
    return out


def test_line_dedup_equals_brute_force(docs, corpus, clashing):
    unique = {i: t for i, t, *_ in corpus}
    want = brute_lines(list(unique.items()))
    for df in (docs, clashing):
        found = line_dedup.dedup_lines(df)
        assert set(df.columns) <= set(found.columns)
        rows = found.collect()
        assert len(rows) == len(corpus)
        for r in rows:
            if r.doc_id is not None and unique[r.doc_id] is not None:
                assert (r.text, r.n_removed) == want[(r.doc_id, unique[r.doc_id])]
            else:
                assert r.n_removed == 0


def test_line_dedup_report(docs, empty, nothing):
    for r in line_dedup.line_dedup_report(docs).collect():
        assert 0 <= r.n_blocks <= r.n_removed <= r.n_lines
    assert line_dedup.line_dedup_report(empty).count() == 0
    assert {(r.n_removed, r.n_kept_bytes) for r in line_dedup.line_dedup_report(nothing).collect()} == {(0, 0)}


def lines_of(text):
    bare = [x.strip() for x in text.split("\n")]
    tokens = np.array([xxhash.xxh64_intdigest(x.encode()) >> 1 for x in bare], dtype="<i8")
    return line_dedup.Lines(tokens, np.array([min(16, len(x)) for x in bare], dtype=np.uint8))


def test_alignment_of_many_equal_lines():
    """A hundred thousand equal lines against a copy, against more, and between others: no square of their number."""
    same = "\n".join(["the same line, again and again"] * 100_000)
    assert len(line_dedup.align(lines_of(same), lines_of(same))) == 100_000
    assert len(line_dedup.align(lines_of(same), lines_of(same + "\n" + same))) == 100_000
    other = "a line that stands here alone"
    assert len(line_dedup.align(lines_of(f"{same}\n{other}"), lines_of(f"{other}\n{same}"))) <= 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 30), unique=True, max_size=14))
def test_longest_chain_is_longest(values):
    best = [1] * len(values)
    for i in range(len(values)):
        best[i] = 1 + max((best[j] for j in range(i) if values[j] < values[i]), default=0)
    chain = line_dedup.longest_chain(list(enumerate(values)))
    assert len(chain) == max(best, default=0)
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(chain, chain[1:]))


def brute_similar(rows):
    """Components over all pairs whose sets of five-word shingles have a similarity of 0.8 or more."""
    sets = [(i, set(simhash.shingles(t, 5))) for i, t in rows]
    group = {i: i for i, _ in rows}
    for at, (i, x) in enumerate(sets):
        for j, y in sets[:at]:
            if 10 * len(x & y) >= 8 * len(x | y):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if g == old else g for k, g in group.items()}
    return group


def test_similar_documents_compares_every_member_of_a_bucket(spark):
    """Texts that share passages with a leader without being similar to it, but are similar to each other."""
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(6):
        base = words(120)
        texts.append(base)
        for cut in (14, 17, 20, 24):
            changed = [*base[: 120 - cut], *words(cut)]
            texts += [changed, [*changed[:60], *words(rng.randint(1, 9)), *changed[60:]], [*changed, *words(rng.randint(5, 25))]]
    rows = [(i + 1, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_similar(rows)
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()} == want
    assert len(set(want.values())) > 6


def test_similar_documents_of_few_words(spark):
    """Copies of short texts with a word added: similarity 3/4 to 8/9, decided on the shingles."""
    rng = random.Random(12)
    rows = []
    for n in (7, 8, 9, 10, 11, 12):
        for _ in range(8):
            base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            rows += [(len(rows) + 1, " ".join(base)), (len(rows) + 2, " ".join([*base, "more"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_similar(rows)
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()} == want
    assert sum(i != g for i, g in want.items()) == 40


def shuffle_bytes(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    total = 0
    while files.hasNext():
        file = files.next()
        total += file.length() if file.getName().startswith("shuffle_") else 0
    return total


def test_near_dedup_gives_its_disk_back(spark, monkeypatch):
    """The texts' shuffle is gone before links are searched, and the stored texts before the result shuffles all rows again."""
    rng = random.Random(13)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(20_000)) for _ in range(20)]
    rows = [(i + 1, t) for i, t in enumerate([*texts, *(f"{t} more" for t in texts)])]
    df = materialize(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "input")
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    seen = []

    def watched(step):
        def run(*args):
            # Spark deletes in the background.
            least = shuffle_bytes(spark)
            for _ in range(50):
                if (least := min(least, shuffle_bytes(spark))) < start + 1e6:
                    break
                time.sleep(0.1)
            seen.append(least - start)
            return step(*args)

        return run

    for name in ("_links", "_verified"):
        monkeypatch.setattr(simhash, name, watched(getattr(simhash, name)))
    sweep(spark)
    time.sleep(2)
    start = shuffle_bytes(spark)
    kept = simhash.first_of_groups(df)
    assert seen and max(seen) < 1e6 < sum(len(t) for _, t in rows) / 10
    left = set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before
    assert not [name for name in left if name.startswith(("texts-", "named-"))]
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == list(range(1, 21))
    release(df)


def test_suffix_shuffles_packs_once_and_drops_its_hashes(spark):
    """The shuffled hashes are gone before contexts are sent; the packs' one shuffle serves both steps that read them."""
    rng = random.Random(15)
    texts = ["".join(f"{rng.getrandbits(64):x}" for _ in range(12_000)) for _ in range(12)]
    rows = [(i + 1, t) for i, t in enumerate([*texts, *(t[::-1] + t[:500] for t in texts)])]
    df = materialize(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "input")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sweep(spark)
        time.sleep(2)
        start = shuffle_bytes(spark)
        found = suffix_dedup.remove_repeats(df)
        # Spark deletes in the background; over 1 MB of hashes were shuffled.
        for _ in range(50):
            if (left := shuffle_bytes(spark) - start) < 1e5:
                break
            time.sleep(0.1)
        assert left < 1e5
        removed = {r.doc_id: r.n_removed for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert removed == {i: 0 if i <= 12 else 500 for i in removed} and len(removed) == 24
    scans = [line for line in plan.splitlines() if "FileScan" in line and "data#" in line]
    reused = [line for line in plan.splitlines() if "ReusedExchange" in line and "data#" in line]
    assert len(scans) == len(reused) == 1
    release(df)


def test_suffix_contexts_go_in_shares(spark, monkeypatch):
    """However many shares the buckets are taken in, results are the same and no bucket is in two shares."""
    rng = random.Random(16)
    some = lambda n: "".join(f"{rng.getrandbits(64):x}" for _ in range(n))
    passages = [some(40) for _ in range(40)]
    rows = [(i, some(5) + "".join(rng.sample(passages, 6)) + some(5)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(suffix_dedup, "PACK_BYTES", 20_000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 10_000)
    folder = shared_dir(spark).removeprefix("file:")
    want, stored = brute_repeats(rows), []
    for size in (0, 28, 56):
        monkeypatch.setattr(suffix_dedup, "SHARE_BYTES", size)
        before = set(os.listdir(folder))
        assert Counter(tuple(r) for r in suffix_dedup.remove_repeats(df).collect()) == want
        shares = [{r.bucket for r in spark.read.parquet(f"{folder}/{name}").collect()} for name in set(os.listdir(folder)) - before if name.startswith("judged-")]
        assert sum(map(len, shares)) == len(set().union(*shares))
        stored.append(len(shares))
    # The last share is not stored.
    assert 0 == stored[0] < stored[1] < stored[2]


def test_open_buckets_keep_rows_with_a_possible_partner():
    """Texts too unlike in length to be similar do not keep a bucket's rows; all that could have a partner stay."""
    rng = np.random.default_rng(14)
    rows = 3000
    h, node = rng.integers(0, 700, rows), np.arange(rows)
    n = rng.integers(1, 2000, rows).astype(np.int32)
    pos = (rng.random(rows) * (n // 5 + 1)).astype(np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in (h, node, n, pos)], names=["h", "node", "n", "pos"])
    kept = {x for b in simhash._open_buckets(0, 4, 5)([batch]) for x in b.column(1).to_pylist()}
    want, able = set(), set()
    for i in range(rows):
        for j in np.flatnonzero(h == h[i]).tolist():
            if i != j and 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j]):
                want.add(i)
            if i != j and 9 * min(n[i] - pos[i], n[j] - pos[j]) >= 4 * (int(n[i]) + int(n[j])):
                able.add(i)
    assert kept == want and able <= kept and len(able) > 100 and len(kept) < 0.9 * rows


def test_suffix_hot_passage_cut_short_in_one_pack(spark, monkeypatch):
    """The start or end of a frequent passage, with its surroundings, in neighbours of which one ends or differs there."""
    monkeypatch.setattr(suffix_dedup, "HOT_PACKS", 3)
    monkeypatch.setattr(suffix_dedup, "PACK_BYTES", 600)
    rng = random.Random(8)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    passage = some("abcdefgh", 90)
    rows = [(i, some("uvwxyz", 40) + passage + some("uvwxyz", 40)) for i in range(0, 20)]
    for k in range(10, 88):
        head = some("uvwxyz", 60)
        texts = [head + passage + some("uvwxyz", 30), head + passage[:k], some("uvwxyz", 30) + passage + head[::-1], passage[-k:] + head[::-1]]
        rows += list(zip(range(4 * k + 100, 4 * k + 104), texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert Counter(tuple(r) for r in suffix_dedup.remove_repeats(df).collect()) == brute_repeats(rows)


def test_line_dedup_aligns_with_every_earlier_document(spark):
    """Lines in another order, or more often, in a later holder than in the earliest one."""
    x, y, z = ("a line of some length", "and another such line", "a third line like them")
    rng = random.Random(4)
    texts = [f"{x}\n{y}", f"{y}\n{x}", f"{y}\n{x}", f"{z}\n{z}", f"{y}\n{x}\n{z}\n{z}"]
    texts += ["\n".join(rng.choice([x, y, z, "short", "", "x", "a fourth line, for luck", "several words"]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {i: x for (i, _), x in brute_lines(rows).items()}
    assert {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(df).collect()} == want
    assert want[2] == ("", 2)


def test_line_dedup_takes_short_and_blank_lines_of_a_block(spark):
    long = ["the first of the long lines", "the second of the long lines"]
    block = [long[0], "", "short", long[1]]
    verse = ["one two", "three", "", "four five", "six"]
    texts = ["\n".join(t) for t in (block, ["own words stand here now", *block, "short"], block, verse, ["short", *verse, "own"], verse, ["ab", "c"], ["ab", "c"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert found == {**dict(enumerate(texts)), 1: "own words stand here now\nshort", 2: "", 4: "short\nown", 5: "", 7: ""}
