import random
import re
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from chronolake.llm import minhash

from .conftest import words


def brute(rows, threshold=85):
    """doc_id -> (size of its set, least id reachable), from all pairs."""
    def shingles(text):
        own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()

    sets, sizes = [(i, shingles(t)) for i, t in rows], {}
    near, up = defaultdict(set), {}
    for k, (i, a) in enumerate(sets):
        sizes[i, frozenset(a)] = len(a)
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                near[i].add(j), near[j].add(i)
    for i in sorted(i for i, _ in sets):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in up:
                up[x] = up.get(i, i)
                todo += near[x]
    return sorted((i, len(a), up[i], up[i] == i) for i, a in sets)


def result(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def test_edge_cases(edge_docs, no_docs):
    got = minhash.near_duplicates(edge_docs, 85)
    own = [(r.doc_id, r.text) for r in edge_docs.collect() if r.doc_id is not None]
    assert result(got.where("doc_id is not null")) == brute(own)
    assert [(r.component_id, r.kept) for r in got.where("doc_id is null").collect()] == [(None, True)]
    assert minhash.near_duplicates(no_docs).count() == 0 and minhash.keep_one(no_docs).count() == 0
    kept = minhash.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [i for i, *_, k in sorted(set(brute(own, 80))) if k]
    assert kept.where("doc_id is null").count() == 1


def test_one_id_with_several_texts(spark):
    """Each text of an id is a document: copies go, and no text is lost."""
    rnd = random.Random(4)
    a, b, c = (" ".join(words(rnd, 60)) for _ in range(3))
    near = a.rsplit(" ", 1)[0] + " changed"
    rows = [(1, a), (1, b), (2, a), (3, b), (5, c), (5, c), (4, c), (7, near), (7, "other words here"), (8, ""), (8, " "), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for _ in range(2):
        got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
        n = len(a.split()) - 4
        assert got == Counter([(1, n, 1, True), (1, n, 1, True), (2, n, 1, False), (3, n, 1, False), (4, n, 4, True), (5, n, 4, False), (5, n, 4, False), (7, n, 1, False), (7, 1, 7, True), (8, 0, 8, True), (8, 0, 8, True), (8, 0, 8, True)])
    assert Counter(map(tuple, minhash.keep_one(docs).collect())) == Counter([(1, a), (1, b), (4, c), (7, "other words here"), (8, ""), (8, " ")])
    two = spark.createDataFrame([(1, a), (1, near)], "doc_id long, text string")
    assert minhash.keep_one(two).count() == 1


def test_groups_of_near_copies(spark):
    """Chains, stars and many texts just below and above the threshold, in one hot group; against all pairs."""
    rnd = random.Random(21)
    base = words(rnd, 120)
    rows = [(0, " ".join(base))]
    for i in range(1, 160):
        own = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 2, 3, 4])):
            own[rnd.randrange(len(own))] = words(rnd, 1)[0] + str(i)
        rows.append((i, " ".join(own)))
    chain = words(rnd, 100)
    for i in range(160, 200):
        chain = list(chain)
        chain[(i * 7) % 100] = f"step{i}"
        rows.append((i, " ".join(chain)))
    rows += [(200 + i, " ".join(words(rnd, 60))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert result(minhash.near_duplicates(docs, 85)) == want
    minhash.BLOCK, block = 16, minhash.BLOCK  # cells of two blocks
    try:
        assert result(minhash.near_duplicates(docs, 85)) == want
    finally:
        minhash.BLOCK = block


def test_pipeline_stage_keeps_one_from_a_similarity_of_four_fifths(spark):
    """Pairs of 0.796 to 0.851, 0.80 itself included: the stage cuts at 0.80, the query at 0.85; against all pairs."""
    rnd, rows = random.Random(22), []
    for n in range(44, 63):  # shingles; one changed word changes five of them
        for _ in range(4):
            own = [f"{w}{k}" for k, w in enumerate(words(rnd, n + 4))]
            rows.append((len(rows), " ".join(own)))
            own[rnd.randrange(4, n)] = "changed"
            rows.append((len(rows), " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    at = {t: brute(rows, t) for t in (80, 85)}
    kept = {t: [i for i, *_, k in own if k] for t, own in at.items()}
    assert len(kept[80]) < len(kept[85]) < len(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates_out(spark, docs, "").collect()) == kept[80]
    assert result(minhash.near_duplicates(docs, 80)) == at[80] and result(minhash.near_duplicates(docs, 85)) == at[85]


def test_bands_miss_few_pairs_at_the_threshold():
    assert minhash.band_shape(85) == (32, 6) and minhash.band_shape(80) == (38, 5)
    for t in (50, 70, 80, 85, 90, 95, 100):
        bands, size = minhash.band_shape(t)
        assert bands * size <= minhash.COORDINATES and (1 - (t / 100) ** size) ** bands <= 1e-6


def test_signature_estimates_similarity():
    rnd = np.random.default_rng(1)
    both, a, b = (rnd.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) for n in (800, 100, 100))
    x, y = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
    alike = (minhash.signature(x, 4096) == minhash.signature(y, 4096)).mean()
    assert abs(alike - 0.8) < 0.03
    # shifting the ring by one moves each coordinate to its neighbour
    shifted = x + (np.uint64(1) << np.uint64(32))
    assert (minhash.signature(shifted, 64)[:-1] == minhash.signature(x, 64)[1:]).all()


def test_components(spark):
    edges = [(k + 1, k) for k in range(30)] + [(100, 101), (102, 101), (200, 150)]
    got = {r.id: r.component for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(31)} | {100: 100, 101: 100, 102: 100, 200: 150, 150: 150}
    assert minhash.components(spark.createDataFrame([], "a long, b long")).count() == 0
