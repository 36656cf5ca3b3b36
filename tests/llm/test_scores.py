"""Toxicity, quality, URL rules and mixing."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spandrel.llm import mixing, quality, toxicity, url_filter
from spandrel.session import table

SF = "/root/testdata/sf0.01"


def accuracy(rows, label):
    return sum(r.predicted == r[label] for r in rows) / len(rows)


def test_fold_is_crc32_of_the_id(spark):
    from spandrel.llm.labels import fold_of

    found = spark.range(200).select("id", fold_of(F.col("id")).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in found)


@pytest.mark.parametrize("kind, least", [("quality", 0.97), ("toxic", 0.9)])
def test_held_out_accuracy(spark, kind, least):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    scores = {"quality": quality.quality_scores, "toxic": toxicity.toxicity_scores}[kind](docs, labels)
    assert scores.count() == docs.count()
    rows = scores.join(labels, "doc_id").where("held_out").collect()
    assert accuracy(rows, kind) >= least
    assert all(0 <= r.score <= 1 for r in scores.collect())


@pytest.mark.parametrize("score", [quality.quality_scores, toxicity.toxicity_scores])
def test_scores_without_labels_and_edges(spark, score, docs, empty, nothing, corpus, clashing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert score(docs, labels).count() == len(corpus)
    assert score(empty, labels).count() == 0
    assert {r.held_out for r in score(nothing, labels).collect()} == {False}
    some = spark.createDataFrame([(i, k % 2, (k + 1) % 2) for k, (i, *_) in enumerate(corpus) if i is not None] + [(None, None, None), (1, None, None)], "doc_id long, quality int, toxic int")
    by_text = {}
    for r in score(clashing, some).join(clashing.select("doc_id", "text").distinct(), "doc_id").collect():
        assert by_text.setdefault(r.text, r.score) == r.score


def test_labels_are_never_read_from_the_held_out_fold(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    from spandrel.llm.labels import fold_of

    flipped = labels.withColumn("quality", F.when(fold_of(F.col("doc_id")) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (sorted(map(str, quality.quality_scores(docs, x).collect())) for x in (labels, flipped))
    assert one == two


def test_rules_compile_to_what_they_mean(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(400, 3))
    y = ((x[:, 0] > 0.6) & (x[:, 1] <= 0.5)).astype(float)
    model = quality.fit_rules(x, y, ["a", "b", "c"])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    scores = np.array([r.s for r in df.select(model.score({c: F.col(c) for c in "abc"}).alias("s")).collect()])
    assert ((scores > 0.5) == (y > 0.5)).mean() > 0.97
    assert len(model.rules) < 120


def test_toxicity_folds_disguises_and_exceptions():
    model = toxicity.ToxicityModel(dict(toxicity.SEEDS), (-4.0, 3.0, 0.5, 0.5))
    measure = model.matcher()
    for text in ("you idiot", "you 1d10t", "you ｉｄｉｏｔ", "you іdіоt", "IDIOT!", "@idiot", "$tupid", "$tup1d!!", "c1own", "worth1ess", "id!ot", "ïdíot", "𝐢𝐝𝐢𝐨𝐭", "i\u200bdiot", "mor0n$$$", "(1oser)"):
        assert measure(text)[1] == 1, text
    for text in ("take out the trash can", "a clownfish", "overtrash", "", None, "2 7 5", "$100", "cat!!", "a@b.c"):
        assert measure(text)[1] == 0, text
    assert measure("trash and a trash can")[1] == 1


def test_toxicity_is_normalised_by_length():
    model = toxicity.ToxicityModel(dict(toxicity.SEEDS), (-4.0, 1.0, 0.5, 1.0))
    short, long = model.score(4.0, 1, 10), model.score(4.0, 1, 10_000)
    assert short > long


URLS = [None, "", "nothing", "http://A.Com", "http://a.com/", "x://EXAMPLE.com/en/A", "://net/fr/", "a://b://spam-farm.x.org/", "http://www.example.com/en/", "http://xnet/fr/", "h://a.net/fr", "h://example.com:80/en/", "h://spam-farm.org?q", "h://sub.www.example.com/en/x#y", "h://m.net/es/\n", "h://q.org/ADSERVER/1", "h://net/es/?a=/fr/"]


def plain_judgement(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), v, h + p) for v, h, p in url_filter.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, verdict, rule = max(fits)
        return host, path, rule, verdict
    import re

    return host, path, None, "block" if any(re.search(p, (host + path).lower()) for p, _ in url_filter.PATTERN_RULES) else "allow"


def test_url_rules_equal_plain_judgement(spark):
    rng = random.Random(0)
    urls = URLS + ["h://" + ".".join(rng.choice(["com", "net", "www", "example", "casino", "xcom"]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "/", "/en/", "/es/x", "/fr", "/login/"]) for _ in range(200)]
    df = spark.createDataFrame([(u, "keep") for u in urls], "url string, host string")
    found = url_filter.judge(df)
    assert [c for c in found.columns] == ["url", "host", "path", "rule", "verdict"]
    for r in found.collect():
        assert (r.host, r.path, r.rule, r.verdict) == plain_judgement(r.url), r.url
    assert url_filter.judge(df.limit(0)).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_raking_meets_the_marginals():
    rng = np.random.default_rng(1)
    totals = rng.integers(1, 1000, 60).astype(float)
    codes = [np.arange(60) % 5, np.arange(60) // 5 % 4, np.arange(60) // 20]
    targets = [rng.dirichlet(np.ones(k) * 5) for k in (5, 4, 3)]
    weights = mixing.rake(totals, codes, targets)
    for code, target in zip(codes, targets):
        got = np.bincount(code, weights=weights * totals) / totals.sum()
        assert np.allclose(got, target, atol=1e-6)


def test_mixing_probabilities_and_draw(spark, docs, clashing, empty, nothing):
    whole = table(spark, SF, "documents")
    rows = mixing.mix_report(whole).collect()
    assert len(rows) == whole.count() and 0 < max(r.probability for r in rows) <= 1
    assert {r.doc_id for r in rows if r.kept} == {r.doc_id for r in mixing.mix_documents(whole).collect()}
    expected = sum(r.probability for r in rows)
    assert abs(sum(r.kept for r in rows) - expected) < 4 * expected**0.5
    given = mixing.mixing_probabilities(whole, {"lang": {"en": 1.0, "de": 1.0, "fr": 1.0, "es": 1.0}}, budget=None)
    sums = given.groupBy("lang").agg(F.sum(F.col("tokens") * F.col("probability")).alias("s")).collect()
    assert max(r.s for r in sums) == pytest.approx(min(r.s for r in sums), rel=1e-4)
    assert mixing.mix_report(docs).count() == docs.count()
    kept = mixing.mix_documents(clashing)
    assert kept.columns == clashing.columns and {r.topic for r in kept.select("topic").collect()} <= {"x"}
    assert mixing.mix_report(empty).count() == 0 and mixing.mix_documents(empty).count() == 0
    assert mixing.mix_report(nothing).count() == 3


def test_too_many_cells_raise(docs, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_CELLS", 2)
    with pytest.raises(ValueError):
        mixing.mix_report(docs)


def plain_matches(model, text):
    """(weight, matches) by trying every term at every word start, without an automaton."""
    folded, hits, free = toxicity.fold(text), {}, []
    for form, terms in ((folded, model.weights), (toxicity._merged(folded), {t: w for t, w in model.weights.items() if t in toxicity.SEEDS})):
        fit = str if form is folded else toxicity._merged
        for at in range(len(form)):
            if at and form[at - 1].isalpha():
                continue
            for phrase in model.exceptions:
                if form.startswith(fit(phrase), at):
                    free.append((at, at + len(phrase) - 1))
            for term, weight in terms.items():
                if form.startswith(fit(term), at):
                    hits[at] = max(weight, hits.get(at, 0.0))
    counted = [w for at, w in hits.items() if not any(a <= at <= b for a, b in free)]
    return sum(counted), len(counted)


def test_toxicity_equals_brute_force(spark, docs):
    labels = table(spark, SF, "labels")
    own = table(spark, SF, "documents")
    model = toxicity.fit_toxicity(own, labels)
    assert len(model.weights) > len(toxicity.SEEDS)
    some = own.limit(60).union(docs.where("length(text) < 3000").dropDuplicates(["doc_id"]).select((F.col("doc_id") + 10**9).alias("doc_id"), *own.columns[1:])).union(spark.createDataFrame([(-1, "a trash can, trash; clown fish clown " * 9, "en", "s", 1)], own.schema))
    for r in toxicity.measured(some, model).join(some.select("doc_id", "text").distinct(), "doc_id").collect():
        total, matches = plain_matches(model, r.text)
        words = toxicity.fold(r.text).count(" ") + toxicity.fold(r.text).count("\n") + 1
        assert (pytest.approx(total), matches) == (r.total, r.matches), r.text
        margin = sum(c * v for c, v in zip(model.coefficients, (1, np.log1p(total), np.log1p(matches), np.log1p(100 * total / (words + 20)))))
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def test_exceptions_in_a_very_long_text():
    measure = toxicity.ToxicityModel(dict(toxicity.SEEDS), (-4.0, 3.0, 0.5, 0.5)).matcher()
    assert measure("trash can and idiot " * 50_000)[1] == 50_000


def plain_statistics(text):
    t = text or ""
    n, words, lines = len(t), t.split(" "), t.split("\n")
    share = lambda chars: sum(c in chars for c in t) / max(1, n)
    return {
        "log_length": np.log1p(n), "upper": share(quality.UPPER), "digit": share(quality.DIGITS), "symbol": share(quality.SYMBOLS), "mark": share("!?"), "stop": share("."), "comma": share(","),
        "word_length": n / len(words), "distinct_words": len(set(words)) / len(words), "distinct_lines": len(set(lines)) / len(lines), "line_length": n / len(lines), "bytes": len(t.encode()) / max(1, n),
    }


def test_quality_equals_brute_force(spark, docs, corpus):
    model = quality.fit_quality(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert model.rules
    texts = {i: t for i, t, *_ in corpus}
    for r in quality.score_quality(docs, model).collect():
        stats = plain_statistics(texts[r.doc_id] if r.doc_id is not None else r.text)
        margin = model.intercept + sum(w for rule, w in model.rules if all((stats[name] > at) == above for name, above, at in rule.tests))
        assert r.score == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-9)


def test_mixing_probabilities_equal_brute_force(spark, docs):
    """Raking over documents, one at a time, with dictionaries; targets as stated."""
    whole = table(spark, SF, "documents").unionByName(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    rows = mixing.mix_report(whole).collect()
    weight = {(r.source, r.lang, r.topic): mixing.BUDGET for r in rows}
    total = sum(r.tokens for r in rows)
    goals = []
    for d, name in enumerate(mixing.DIMENSIONS):
        own = {}
        for r in rows:
            own[r[name]] = own.get(r[name], 0) + r.tokens / total
        own = {k: v for k, v in own.items() if v > 0}
        stated = mixing.TARGETS[name]
        if stated is None:
            powers = {k: v**0.7 for k, v in own.items()}
            goals.append({k: v / sum(powers.values()) for k, v in powers.items()})
        else:
            other = {k: v for k, v in own.items() if k not in stated}
            listed = {k: stated[k] for k in own if k in stated}
            goals.append({**other, **{k: v * (1 - sum(other.values())) / sum(listed.values()) for k, v in listed.items()}})
    sums = {}
    for r in rows:
        cell = (r.source, r.lang, r.topic)
        sums[cell] = sums.get(cell, 0) + r.tokens
    for _ in range(500):
        for d, goal in enumerate(goals):
            now = {}
            for cell, s in sums.items():
                now[cell[d]] = now.get(cell[d], 0) + weight[cell] * s / total
            for cell in weight:
                if now[cell[d]] > 0:
                    weight[cell] = min(1.0, weight[cell] * mixing.BUDGET * goal[cell[d]] / now[cell[d]])
    for r in rows:
        cell = (r.source, r.lang, r.topic)
        assert r.probability == pytest.approx(weight[cell] if sums[cell] else 1.0, rel=1e-4)
    assert len({r.topic for r in rows}) >= 4
    # The sample is near the budget, and near the targets of languages.
    kept = sum(r.probability * r.tokens for r in rows)
    assert kept > 0.9 * mixing.BUDGET * total
    for name, share in goals[1].items():
        assert name is None or abs(sum(r.probability * r.tokens for r in rows if r.lang == name) / kept - share) < 0.05


def test_long_rule_lists_judge_alike(spark, monkeypatch):
    """The joined index, and rules without any token."""
    import re

    rng = random.Random(2)
    rules = url_filter.compile_rules() + [url_filter.Rule("block", None, "^[^/]{64,}/", (), 0), url_filter.Rule("allow", None, "/free/", ("free",), 0)]
    rules += [url_filter.Rule("block", None, f"/x{i}/", (f"x{i}",), 0) for i in range(300)]
    urls = [f"h://{rng.choice(['a.com', 'b.org', 'y' * 70 + '.org', 'c.org'])}/{rng.choice(['en', 'free', 'q'])}/x{rng.randint(0, 400)}/" for _ in range(200)] + [None, "", "h://b.org/x7/" + "long/" * 40_000, "h://" + "z" * 200_000 + ".org/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] * 2, "page_id long, url string")
    one = sorted(map(str, url_filter.judge(df, rules=rules).collect()))
    monkeypatch.setattr(url_filter, "LITERAL_RULES", 10)
    joined = url_filter.judge(df, rules=rules)
    assert sorted(map(str, joined.collect())) == one
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for r in joined.collect():
        spot = ((r.host or "") + (r.path or "")).lower()
        if r.rule is None and spot:
            held = [x for x in rules if x.weight == 0 and re.search(x.pattern, spot)]
            assert r.verdict == ("block" if held and all(x.verdict == "block" for x in held) else "allow"), r.url


def test_filter_lists_are_read(spark):
    lines = ["! comment", "[Adblock Plus 2.0]", "||ads.example^", "@@||ads.example/free/", "/banner/*/img^", "|http://start.org/", "end.gif|", "/[0-9]{9}/", "site##.ad", "||x.org^$third-party"]
    rules = url_filter.parse_filter_list(lines)
    assert len(rules) == 6
    urls = {"h://ads.example/a": "block", "h://x.ads.example/free/": "allow", "h://badads.example/": "allow", "h://a.org/banner/7/img?q": "block", "http://start.org/": "block", "h://b.org/end.gif": "block", "h://b.org/end.gif/x": "allow", "h://c.org/123456789": "block", "h://x.org/": "allow"}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.verdict for r in url_filter.judge(df, rules=rules).collect()} == urls
