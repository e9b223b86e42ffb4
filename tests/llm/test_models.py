"""Toxicity, quality and perplexity: held-out accuracy on the test tables, plain re-computation, odd cases."""

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from chronolake.llm import perplexity, quality_gam, toxicity
from chronolake.llm.common import read

SF = "/root/testdata/sf0.1"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@needs_tables
@pytest.mark.parametrize("module, label, least", [(toxicity, "toxic", 0.97), (quality_gam, "quality", 0.97)])
def test_held_out_accuracy(spark, module, label, least):
    labels = read(spark, SF, "labels")
    rows = module.verdicts(read(spark, SF, "documents"), labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 500 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == r[label] for r in rows) / len(rows) >= least


def test_machine_learns_a_pair():
    """Neither word is toxic alone; the two together are."""
    rnd = random.Random(1)
    texts, labels = [], []
    for _ in range(1500):
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        texts.append(toxicity.terms(" ".join(["pair"] * a + ["group"] * b + [f"w{rnd.randint(0, 30)}" for _ in range(5)])))
        labels.append(int(a and b))
    m = toxicity.fit_machine(texts, np.array(labels))
    s = {t: m.score(toxicity.terms(t)) for t in ("pair w1", "group w1", "pair group w1", "w1", "")}
    assert s["pair group w1"] > 0.9 and max(s["pair w1"], s["group w1"], s["w1"], s[""]) < 0.3
    v, w = m.factors, m.weights
    own = m.place[toxicity.terms("pair group")]
    own = own[own >= 0]
    z = m.bias + sum(w[i] for i in own) + sum(v[i] @ v[j] for k, i in enumerate(own) for j in own[:k])
    assert m.score(toxicity.terms("pair group")) == pytest.approx(1 / (1 + math.exp(-z)))


def test_additive_model_finds_pairs_and_curves():
    rnd = np.random.default_rng(2)
    x = rnd.uniform(-1, 1, (4000, 3))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (np.abs(x[:, 2]) > 0.9)).astype(int)
    m = quality_gam.fit_additive(x[:3000], y[:3000])
    assert ((m.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.85
    z = m.base + sum(t[np.searchsorted(e, x[0, k], "right")] for k, (e, t) in enumerate(m.single)) + sum(t[np.searchsorted(a, x[0, i], "right"), np.searchsorted(b, x[0, j], "right")] for i, j, a, b, t in m.pairs)
    assert m.score(x[:1])[0] == pytest.approx(1 / (1 + math.exp(-z)))


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality_gam, "quality")])
def test_odd_cases(spark, edge_docs, no_docs, module, label):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for labels in (empty, some):
        rows = module.verdicts(edge_docs, labels).collect()
        assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert module.verdicts(no_docs, some).count() == 0
    if module is toxicity:
        kept = toxicity.keep_clean(edge_docs, toxicity.learn(edge_docs, some))
        assert kept.columns == edge_docs.columns
    # what is no input of a score does not change it
    other = edge_docs.withColumns({"lang": edge_docs["source"], "source": edge_docs["text"]})
    assert sorted(map(str, module.verdicts(other, some).collect())) == sorted(map(str, module.verdicts(edge_docs, some).collect()))


# --- perplexity -----------------------------------------------------------------------------------------------------


def kneser_ney(texts):
    """P(last byte | two before) by the textbook, for one language."""
    grams = Counter()
    for t in texts:
        data = b"\n\n" + t + b"\n\n"
        grams.update(data[k : k + 3] for k in range(len(data) - 2))
    level = {3: dict(grams)}
    for n in (2, 1):
        level[n] = Counter(g[1:] for g in level[n + 1])

    def discount(n):
        counts = Counter(min(c, 5) for c in level[n].values())
        n1, n2 = counts[1], counts[2]
        if not n1 or not n2:
            return lambda c: [0.5, 1.0, 1.5][min(c, 3) - 1]
        y = n1 / (n1 + 2 * n2)
        d = {k: min(max(k - (k + 1) * y * counts[k + 1] / counts[k], 0.1), k - 0.1) if counts[k] else min(0.5 * k, 1.5) for k in (1, 2)}
        three = sum(c == 3 for c in level[n].values())
        four = sum(c == 4 for c in level[n].values())
        d[1] = min(max(1 - 2 * y * n2 / n1, 0.1), 0.9)
        d[2] = min(max(2 - 3 * y * three / n2, 0.1), 1.9)
        d[3] = min(max(3 - 4 * y * four / three, 0.1), 2.9) if three else 1.5
        return lambda c: d[min(c, 3)]

    tables = {}
    for n in (1, 2, 3):
        d, by = discount(n), defaultdict(list)
        for g, c in level[n].items():
            by[g[:-1]].append((g, c))
        tables[n] = {k: (sum(c for _, c in v), sum(d(c) for _, c in v), {g: c - d(c) for g, c in v}) for k, v in by.items()}

    def p(g):
        if not g:
            return 1 / 256
        n = len(g)
        if g[:-1] not in tables[n]:
            return p(g[1:])
        total, free, own = tables[n][g[:-1]]
        return own.get(g, 0) / total + free / total * p(g[1:])

    return p


def test_model_is_kneser_ney(spark):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice(["the", "of", "and", "nation", "ten", "toe"]) for _ in range(60)) for _ in range(12)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    p = kneser_ney([t.encode() for t in texts])
    name = perplexity.write_model(perplexity.build_model(docs))
    model = perplexity._model(name)
    for text in (texts[0], "the xyzzy of ten", "é"):
        codes, _ = perplexity._codes([text.encode()])
        got = model.log_probability("en", codes.astype(np.int64))
        want = [math.log(p(int(c).to_bytes(3, "big"))) for c in codes]
        assert got == pytest.approx(want, abs=1e-5)
    for context in (b"th", b"e ", b"zz"):
        grams = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)])
        assert np.exp(model.log_probability("en", grams)).sum() == pytest.approx(1, abs=1e-4)


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [s for s in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_base_counts(edge_docs):
    own = [r.text for r in edge_docs.collect()] + ["a b c a b c", "x\nx\n\n \nx y", "1 2 3 4 1 2 3 9", "\x85a\xa0b \x1c c", "# <a> | &amp;"]
    for text in own:
        assert perplexity.base_counts((text or "").encode()) == base(text), repr(text)[:80]


def test_rules(spark, edge_docs, no_docs):
    rows = perplexity.rules(edge_docs).collect()
    assert len(rows) == edge_docs.count() and all(r.base_failed for r in rows if r.n_words < 50) and not any(r.kept and r.base_failed for r in rows)
    assert perplexity.rules(no_docs).count() == 0


@needs_tables
def test_junk_goes_and_clean_stays(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    rows = perplexity.rules(docs).join(labels, "doc_id").where("not base_failed").collect()
    clean, junk = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in clean) / len(clean) > 0.99 and sum(r.kept for r in junk) / len(junk) < 0.6


def test_verdicts_against_loops(spark):
    """Every measure, band and verdict of a small corpus, from the textbook model and plain medians."""
    rnd = random.Random(12)
    words = {"en": ["the", "of", "and", "nation", "ten", "toe"], "fr": ["le", "la", "été", "ville", "vers"]}
    rows = []
    for i in range(60):
        lang = ["en", "fr", None][i % 3]
        own = words.get(lang, words["en"])
        text = " ".join(rnd.choice(own) for _ in range(rnd.choice([49, 50, 60, 90])))
        if i % 10 == 4:
            text = "".join(rnd.sample(text, len(text)))
        rows.append((i, None if i == 7 else text, lang))
    got = {r.doc_id: r for r in perplexity.rules(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)).collect()}
    for lang in ("en", "fr", None):
        texts = {i: t.encode() for i, t, x in rows if x == lang and t}
        p = kneser_ney(list(texts.values()))
        measure, n = {}, {i: len(t.split()) for i, t in texts.items()}
        for i, t in texts.items():
            data = b"\n\n" + t + b"\n\n"
            measure[i] = -sum(math.log(p(data[k : k + 3])) for k in range(len(data) - 2)) / n[i]
            assert got[i].measure == pytest.approx(measure[i], rel=1e-5)
        median = lambda xs: sorted(xs)[(len(xs) - 1) // 2]
        steps = [math.floor(got[i].measure / perplexity.STEP + 0.5) for i in texts if n[i] >= 50]
        middle = median(steps)
        off = median([abs(x - middle) for x in steps])
        half = perplexity.WIDTH * max(1.4826 * off, perplexity.LEAST_SPREAD * middle, 1.0)
        for i, t in texts.items():
            failed = n[i] < 50 or 100 * base(t.decode())[-1] > 50 * n[i]
            inside = (middle - half) * perplexity.STEP <= got[i].measure <= (middle + half) * perplexity.STEP
            assert (got[i].base_failed, got[i].kept) == (failed, not failed and inside), i
    assert got[7].base_failed and got[7].measure is None and len({r.kept for r in got.values() if not r.base_failed}) == 2


def test_longer_orders_see_the_order_of_words(spark):
    """A text of the usual words in an unusual order has the spelling of the others, and is outside of the band of a longer order."""
    rnd = random.Random(14)
    line = "the old man of the hill went to see ten ships at the far end of town".split()
    turned = lambda: line[(k := rnd.randrange(len(line))) :] + line[:k]
    texts = [" ".join(w for _ in range(4) for w in turned()) for _ in range(40)]
    mixed = texts[0].split()
    rnd.shuffle(mixed)
    rows = [(i, t, "en") for i, t in enumerate([*texts, " ".join(mixed)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    out = lambda orders: {r.doc_id for r in perplexity.rules(docs, orders).collect() if not r.base_failed and not r.kept}
    judged = spark.createDataFrame([(i, t + f" {chr(97 + i % 26) * 3}", x) for i, t, x in rows], docs.schema)
    measures = {k: {r.doc_id: r.measure for r in perplexity.rules(judged, (k,)).collect()} for k in (2, 5)}
    far = lambda k: measures[k][40] / sorted(measures[k].values())[20]
    assert far(5) > 1.5 and far(5) > far(2) + 0.3
    assert out((2, 3, 4, 5)) >= out((5,))


def test_model_of_a_longer_order(spark):
    """Probabilities after any context sum to one at every order, and n-grams that occur are likelier than by the lower order's share alone."""
    rnd = random.Random(15)
    texts = [" ".join(rnd.choice(["the", "of", "and", "nation", "ten", "toe"]) for _ in range(60)) for _ in range(12)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    model = perplexity._model(perplexity.write_model(perplexity.build_model(docs, 5)))
    assert model.order == 5
    seen = {(b"\n" * 4 + t.encode() + b"\n" * 4)[k : k + 5] for t in texts for k in range(len(t) + 4)}
    codes, _ = perplexity._codes([t.encode() for t in texts], 5)
    assert {int(c).to_bytes(5, "big") for c in codes} == seen and len(model.arrays["p5", "en"][0]) == len(seen)
    for order in (2, 3, 4, 5):
        for context in (b" nat", b"e of", b"zzzz", b"\n" * 4):
            grams = np.array([int.from_bytes((context + bytes([b]))[-order:], "big") for b in range(256)])
            assert np.exp(model.log_probability("en", grams, order)).sum() == pytest.approx(1, abs=1e-4), (order, context)
    with pytest.raises(ValueError, match="order"):
        perplexity.build_model(docs, 8)


def test_scores_against_loops(spark):
    """Scores of both classifiers over whole texts, from sums over terms and look-ups of single features."""
    rnd = random.Random(13)
    docs = [(i, " ".join(rnd.choice(["good", "bad", "idiot", "group", "tree", "ROT", "a1"]) for _ in range(rnd.randint(0, 30))) or None) for i in range(300)]
    labels = [(i, int("idiot" in (t or "")), int(len(t or "") > 60)) for i, t in docs]
    frame, truth = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    m = toxicity.learn(frame, truth)
    for r in toxicity.verdicts(frame, truth).collect():
        at = [m.place[t] for t in toxicity.terms(docs[r.doc_id][1]) if m.place[t] >= 0]
        z = m.bias + sum(m.weights[i] for i in at) + sum(float(m.factors[i] @ m.factors[j]) for k, i in enumerate(at) for j in at[:k])
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5)
    g = quality_gam.learn(frame, truth)
    for r in quality_gam.verdicts(frame, truth).collect():
        x = quality_gam.features(docs[r.doc_id][1])
        z = g.base + sum(t[np.searchsorted(e, x[k], "right")] for k, (e, t) in enumerate(g.single))
        z += sum(t[np.searchsorted(a, x[i], "right"), np.searchsorted(b, x[j], "right")] for i, j, a, b, t in g.pairs)
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
