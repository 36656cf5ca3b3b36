"""Packing, media, nearest neighbours and the pipeline."""

import hashlib
import html
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spandrel.llm import ann, media, packing
from spandrel.session import table

SF = "/root/testdata/sf0.001"


def check_pieces(rows, texts):
    """Every id once, sequences gapless, within limits, and padded only below the last power of two."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for doc, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            own = ids[doc][r.start : r.start + r.length]
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids[doc]), zlib.crc32(np.array(own, dtype="<u4").tobytes()))
            at += r.length
        assert at == len(ids[doc])
    sizes = []
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and len(parts) <= packing.SEQUENCE_SEGMENTS
        sizes.append(at)
    return sizes


def test_packing_round_trip(spark):
    docs = table(spark, SF, "documents")
    sizes = check_pieces(packing.pack_documents(docs).collect(), dict(docs.select("doc_id", "text").collect()))
    padding = sum(0 if s & (s - 1) == 0 else 1024 - s for s in sizes)
    assert padding < 0.01 * sum(sizes)


def test_packing_edges(spark, corpus, empty, nothing):
    unique = {i: t for i, t, *_ in corpus if i is not None}
    rows = [(i, t) for i, t in unique.items()] + [(10**6, "<|endoftext|> is text"), (10**6 + 1, "word " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    check_pieces(packing.pack_documents(df).collect(), dict(rows))
    assert packing.pack_documents(empty).count() == 0
    assert sum(r.length for r in packing.pack_documents(nothing).collect()) == 3


def test_packing_conversations_keeps_limits(spark):
    turns = table(spark, SF, "conversations")
    rows = packing.pack_conversations(turns, tokens=512, segments=4, loss_tokens=200).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for parts in by.values():
        assert sum(r.length for r in parts) <= 512 and len(parts) <= 4 and sum(r.loss_tokens for r in parts) <= 200
    assert {r.doc_id for r in rows} == {r.conv_id for r in turns.select("conv_id").distinct().collect()}


@settings(max_examples=50, deadline=None)
@given(st.binary(min_size=0, max_size=800))
def test_png_round_trip(raw):
    payload = raw + b" " * (192 if not raw else -len(raw) % 192)
    assert media.read_png(media.write_png(payload)) == (payload, 64, len(payload) // 192)


def test_png_damage_is_found():
    stored = bytearray(media.write_png(b"a" * 192))
    stored[45] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.read_png(bytes(stored))


def test_png_filters():
    """Rows written with each filter read back the same."""
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 256, (5, 192), dtype=np.uint8)
    lines, above = [], np.zeros(192, dtype=int)
    for kind, row in enumerate(rows.astype(int)):
        left, corner = np.r_[np.zeros(3, int), row[:-3]], np.r_[np.zeros(3, int), above[:-3]]
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [np.zeros(192, int), left, above, (left + above) // 2, paeth][kind]
        lines.append(bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes())
        above = row
    import struct

    head = struct.pack(">IIBBBBB", 64, 5, 8, 2, 0, 0, 0)
    stored = media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"IDAT", zlib.compress(b"".join(lines))) + media._chunk(b"IEND", b"")
    assert media.read_png(stored)[0] == rows.tobytes()


def test_media_of_documents(docs, corpus, empty, clashing):
    want = Counter()
    for i, t, *_ in corpus:
        raw = (t or "").encode()
        payload = raw + b" " * (192 if not raw else -len(raw) % 192)
        stored = media.write_png(payload)
        want[(i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest())] += 1
    for df in (docs, clashing):
        found = media.document_media(df).collect()
        assert Counter(tuple(r)[:7] for r in found) == want
        assert len({(r.payload_sha256, r.feature) for r in found}) == len({r.payload_sha256 for r in found})
    assert media.document_media(empty).count() == 0


def test_interleaved_elements():
    page = '<head><title>t</title></head><p>a &amp; <b>b</b><figure><img src="sha256:ab" alt="z"><figcaption>the <i>cap</i></figcaption></figure>c<img src=u alt=k>d<script>x</script><p>e'
    found = media.parse_elements(page)
    assert [(e[0], e[1], e[2], e[4]) for e in found] == [(0, "text", "a & b", None), (1, "media", None, "the cap"), (2, "text", "c", None), (3, "media", None, "k"), (4, "text", "d", None), (5, "text", "e", None)]
    assert found[1][3] == "ab" and found[3][3] == hashlib.sha256(b"u").hexdigest()
    assert media.parse_elements(None) == [] and media.parse_elements("<p></p>") == []


class Plain:
    """Another reading of a page: tags cut by hand, no parser."""

    def __init__(self, page):
        self.texts, self.media = [], []
        at, words, figure, caption, skip = 0, "", None, None, None
        order = 0

        def flush():
            nonlocal words, order
            if words.split():
                self.texts.append((order, " ".join(html.unescape(words).split())))
                order += 1
            words = ""

        while at < len(page):
            if page[at] != "<":
                end = page.find("<", at) if "<" in page[at:] else len(page)
                if skip is None and caption is None:
                    words += page[at:end]
                elif caption is not None:
                    caption += page[at:end]
                at = end
                continue
            end = page.index(">", at)
            name = page[at + 1 : end].split()[0].lower()
            if skip is not None:
                skip = None if name == "/" + skip else skip
            elif name in ("script", "style", "head"):
                skip = name
            elif name == "figcaption":
                caption = ""
            elif name == "/figcaption":
                self.media[figure] = (*self.media[figure][:2], " ".join(html.unescape(caption).split()))
                caption = None
            elif name == "img":
                flush()
                self.media.append((order, page[at:end].split('src="')[1].split('"')[0], None))
                figure, order = len(self.media) - 1, order + 1
            elif name.strip("/") in ("p", "article", "figure", "div", "br", "h1", "h2", "li", "ul", "nav", "footer", "td", "tr", "table"):
                flush()
            at = end + 1
        flush()


def test_pages_of_whole_texts_keep_order_and_captions(spark, docs):
    """Every line of a text is an element in its place, with the media reference among them."""
    for r in media.text_pages(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        found = media.parse_elements(r.html)
        plain = Plain(r.html)
        assert [(e[0], e[2]) for e in found if e[1] == "text"] == plain.texts
        assert [(e[0], media.SCHEME + e[3], e[4]) for e in found if e[1] == "media"] == plain.media
        if r.n_bytes == len((r.text or "").encode()):
            assert [t for _, t in plain.texts] == [x for x in (" ".join(line.split()) for line in (r.text or "").replace("\0", "\ufffd").split("\n")) if x] or "\0" in (r.text or "")
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    for r in media.parse_html(pages).join(pages, "page_id").collect():
        assert [e.position for e in r.elements] == list(range(len(r.elements)))
        if "<!--" not in r.html:
            assert [e.text for e in r.elements if e.kind == "text"] == [t for _, t in Plain(r.html).texts]


def test_hot_payload_is_resolved_for_every_row(spark):
    df = spark.createDataFrame([(i, "the same text" if i % 3 else f"text {i}") for i in range(300)], "doc_id long, text string").repartition(5)
    found = media.document_media(df).collect()
    assert len(found) == 300 and len({r.media_sha256 for r in found}) == 101 and {r.position for r in found} == {1}


def test_unknown_digests_keep_nulls(spark):
    pages = spark.createDataFrame([(1, '<img src="sha256:00" alt="x">'), (2, None)], "page_id long, html string")
    refs = media.references(media.parse_html(pages), "page_id")
    store = media.media_features(media.store_texts(spark.createDataFrame([("a",)], "text string")))
    rows = media.resolve(refs, store).collect()
    assert [(r.page_id, r.caption, r.feature) for r in rows] == [(1, "x", None)]


def brute_nearest(rows, top=10):
    out = {}
    for q, v in rows:
        if q % 100 == 0:
            found = sorted((math.dist(v, w), i) for i, w in rows if i != q)
            out[q] = found[:top]
    return out


def test_recall_against_brute_force(spark):
    e = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in e.collect()]
    want, hits, total = brute_nearest(rows), 0, 0
    found = {}
    for r in ann.nearest(e).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == set(want)
    for q, best in want.items():
        got = sorted(found[q])
        assert [g[0] for g in got] == list(range(1, 11))
        hits += len({g[1] for g in got} & {i for _, i in best})
        total += len(best)
        assert all(abs(s - math.dist(dict(rows)[q], dict(rows)[i])) < 1e-12 for _, i, s in got)
    assert hits >= 0.9 * total


def test_nearest_edges(spark):
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    rows = [(0, [1.0, 0.0, 0.0]), (5, [1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (7, [0.0, 2.0, 0.0]), (8, None), (9, [0.0, 0.0, 0.0]), (10, [1.0, None, 0.0]), (11, [float("nan"), 1.0, 1.0]), (12, [1.0]), (None, [1.0, 1.0, 1.0]), (100, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("v", F.lit(2))
    found = [tuple(r)[:3] for r in ann.nearest(df).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 3), (0, 2, 5), (0, 3, 7), (0, 4, 100), (100, 1, 7), (100, 2, 0), (100, 3, 3), (100, 4, 5)]


def test_many_equal_vectors_give_the_smallest_ids(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3000, 0, -1)] + [(5000, [1.0, 2.5])], "vec_id long, embedding array<float>")
    found = ann.nearest(df).where("query_id = 5000").orderBy("rank").collect()
    assert [r.vec_id for r in found] == list(range(1, 11))


def test_quantiser_weighs_the_parallel_error():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 64))
    plain = ann.Quantiser(x)
    eta = plain.eta
    codes = plain.encode_parts(plain.split(x))

    def loss(codes):
        back = np.stack([plain.centres[m, codes[:, m]] for m in range(plain.parts)], axis=1)
        rest = plain.split(x) - back
        along = (rest * plain.split(x)).sum(axis=(1, 2)) / np.linalg.norm(x, axis=1)
        return (rest**2).sum() + (eta - 1) * (along**2).sum()

    nearest = ((plain.split(x)[:, :, None, :] - plain.centres[None]) ** 2).sum(axis=3).argmin(axis=2)
    assert eta > 1 and loss(codes) < loss(nearest)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    columns, counts = docs.columns, [docs.count()]
    now = docs
    from spandrel.session import materialize

    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = materialize(stage(spark, now, SF), "test")
        assert now.columns == columns, name
        assert now.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        counts.append(now.count())
    assert counts[0] >= counts[1] == counts[2] >= counts[3] >= counts[4] > 0
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == counts[4]


def test_near_dedup_keeps_one_of_each_group(spark, docs):
    import corpus_pipeline

    kept = corpus_pipeline.dedup_near(spark, docs, SF)
    rows = kept.collect()
    solid = [r.doc_id for r in rows if r.doc_id is not None]
    assert len(solid) == len(set(solid)) and sum(r.doc_id is None for r in rows) == 2
    assert Counter((r.text or "").split() == [] for r in rows if r.doc_id is not None)[True] == 1


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    good = docs.join(labels.where("quality = 1"), "doc_id", "left_semi")
    kept = corpus_pipeline.filter_quality(spark, docs, sf)
    assert kept.join(good.select("doc_id"), "doc_id", "left_semi").count() >= 0.99 * good.count()


def test_pipeline_stages_on_edges(spark, docs, clashing, empty, nothing):
    """Nulls in every column, repeated rows, empty tables and clashing names, through each stage."""
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        for df in (empty, nothing, docs, clashing):
            out = stage(spark, df, SF)
            if name != "packing":
                assert out.columns == df.columns, name
            if df is empty:
                assert out.count() == 0, name
            elif df is docs and name != "packing":
                assert 0 < out.count() <= df.count(), name


def test_near_dedup_keeps_unlike_texts_of_one_id(spark):
    import corpus_pipeline

    words = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, words(1)), (1, words(2)), (1, words(3)), (2, words(2)), (3, words(4)), (3, words(4)), (None, words(1)), (None, words(1))]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.dedup_near(spark, df, SF).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(1, words(1)), (1, words(2)), (1, words(3)), (3, words(4)), (None, words(1)), (None, words(1))])


def test_near_dedup_links_by_fingerprints(spark, monkeypatch):
    """Without the search for links over 3 bits, near-dedup still finds those within, and only those of similar texts."""
    import random

    import corpus_pipeline
    from spandrel.llm import simhash

    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(12):
        base = words(600)
        texts += [base, [*base, "more"], [*base[:300], *words(1), *base[301:]], [*base[:450], *words(150)]]
    # Fingerprints of the repeated shingle alone, but unlike as sets.
    texts += [[*["same"] * 3000, *words(20)] for _ in range(2)]
    rows = [(i + 1, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)]
    prints = [simhash.fingerprint(r[1], 5) & (1 << 64) - 1 for r in rows]
    sets = [set(simhash.shingles(r[1], 5)) for r in rows]
    within = {(a, b) for b in range(len(rows)) for a in range(b) if (prints[a] ^ prints[b]).bit_count() <= 3}
    alike = {(a, b) for a, b in within if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    assert len(alike) > 8 and (len(rows) - 2, len(rows) - 1) in within - alike
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)

    def nothing(*_):
        def run(batches):
            for _ in batches:
                pass
            return iter(())

        return run

    monkeypatch.setattr(simhash, "_prefixes", nothing)
    kept = {r.doc_id for r in corpus_pipeline.dedup_near(spark, df, SF).select("doc_id").collect()}
    group = list(range(len(rows)))
    for a, b in sorted(alike):
        old, new = max(group[a], group[b]), min(group[a], group[b])
        group = [new if g == old else g for g in group]
    assert kept == {g + 1 for g in group}
