import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from chronolake.llm import suffix_array as sa

from .conftest import words


def repeated(texts, length):
    """The bytes of each text that a repeated string of the length covers, and the maximal runs of them."""
    seen = Counter(b[k : k + length] for b in texts for k in range(len(b) - length + 1))
    out = []
    for b in texts:
        hit = bytearray(len(b) + 1)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                hit[k : k + length] = b"\1" * length
        edges = [k for k in range(len(b) + 1) if hit[k] != (hit[k - 1] if k else 0)]
        out.append((hit, list(zip(edges[::2], edges[1::2]))))
    return out


def brute(rows):
    """(doc_id, bytes, removed, spans, kept, bytes in passages) of each row, from all strings of the length."""
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), b, (hit, spans), (_, short) in zip(rows, texts, repeated(texts, sa.LENGTH), repeated(texts, sa.PASSAGE)):
        kept = bytes(c for c, h in zip(b, hit) if not h)
        out.append((i, len(b), len(b) - len(kept), len(spans), kept, sum(z - a for a, z in short if len(b[a:z].split()) > sa.WORDS)))
    return sorted(out, key=str)


def brute_texts(rows, length=sa.PASSAGE, least=sa.WORDS):
    """(doc_id, text without the passages) of each row."""
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (i, t), b, (_, runs) in zip(rows, texts, repeated(texts, length)):
        gone = {k for a, z in runs if len(b[a:z].split()) > least for k in range(a, z)}
        out.append((i, None if t is None else bytes(c for k, c in enumerate(b) if k not in gone).decode("utf-8", "ignore")))
    return Counter(out)


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), r.n_passage_bytes) for r in df.collect()), key=str)


def test_edge_cases(edge_docs, no_docs):
    short = edge_docs.where("length(text) < 30000 or text is null")
    rows = [(r.doc_id, r.text) for r in short.collect()]
    assert result(sa.remove_repeats(short)) == brute(rows)
    assert sa.remove_repeats(no_docs).count() == 0
    new = sa.without_repeats(short)
    assert new.columns == short.columns and new.count() == short.count()
    found = new.collect()
    assert Counter((r.doc_id, r.text) for r in found) == brute_texts(rows)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in found)
    assert sa.without_repeats(no_docs).count() == 0


def test_long_texts(spark, edge_docs):
    """The longest text loses exactly what other texts took from it."""
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    longest = max((r for r in rows if r[1]), key=lambda r: len(r[1]))
    others = [t for _, t in rows if t and t is not longest[1]]
    text, hit = longest[1], set()
    for t in others:
        for k in range(len(t) - sa.LENGTH + 1):
            at = text.find(t[k : k + sa.LENGTH])
            if at >= 0:
                hit.update(range(at, at + sa.LENGTH))
    got = {r.doc_id: r.n_removed for r in sa.remove_repeats(edge_docs).collect()}
    assert got[longest[0]] == len("".join(c for k, c in enumerate(text) if k in hit).encode()) > 0


def random_rows():
    """Passages shared at any offset, overlapping, inside one text, nearly equal, around the length to the byte."""
    rnd = random.Random(31)
    pool = [" ".join(words(rnd, 140)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            p = rnd.choice(pool)
            a = rnd.randint(0, 60)
            piece = p[a : a + rnd.choice([180, 199, 200, 201, 250, 380, 399, 400, 401, 420, 600])]
            if rnd.random() < 0.3:
                k = rnd.randrange(len(piece))
                piece = piece[:k] + "#" + piece[k + 1 :]
            parts += [" ".join(words(rnd, rnd.randint(0, 40))), piece]
        rows.append((i, " ".join(parts)))
    rows.append((99, "ab" * 700 + " ".join(words(rnd, 100)) + "ab" * 300))
    return rows


def test_random_passages(spark, monkeypatch):
    rows = random_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(sa.remove_repeats(docs)) == brute(rows)
    monkeypatch.setattr(sa, "CHUNK", 1100)  # anchors of long texts are found in pieces
    assert result(sa.remove_repeats(docs.coalesce(1))) == brute(rows)


@pytest.mark.parametrize("length, least", [(200, 50), (120, 10)])
def test_passages(spark, length, least):
    rows = random_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, sa.without_repeats(docs, length, least).collect())) == brute_texts(rows, length, least)


@pytest.mark.parametrize("crowd, parts", [(1, 16), (2, 3)])
def test_split_buckets(spark, monkeypatch, crowd, parts):
    """Buckets of many contexts, at both levels of the split: a passage shorter than the length that all texts share, and longer ones."""
    rnd = random.Random(5)
    short, long = " ".join(words(rnd, 140))[:390], " ".join(words(rnd, 200))
    rows = [(i, " ".join([*words(rnd, 30), short if i % 3 else long[rnd.randint(0, 60) :][: rnd.choice([399, 400, 405, 450])], *words(rnd, 30)])) for i in range(40)]
    rows += [(100 + i, f"{i} " + short + " the same end of ten or more bytes " + str(i)) for i in range(5)]
    monkeypatch.setattr(sa, "CROWD", crowd)
    monkeypatch.setattr(sa, "PARTS", parts)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(sa.remove_repeats(docs)) == brute(rows)


@pytest.mark.parametrize("seed", range(5))
def test_bucket_sort(seed):
    rnd = random.Random(seed)
    alphabet = "ab" if seed % 2 else "abcdefgh "
    base = "".join(rnd.choice(alphabet) for _ in range(900))
    contexts, buckets = [], []
    for k in range(30):
        c = list(base[rnd.randint(0, 200) :][: rnd.randint(400, 640)])
        if rnd.random() < 0.7:
            c[rnd.randrange(len(c))] = "Z"
        contexts.append("".join(c).encode())
        buckets.append(k // 10)
    seen = defaultdict(Counter)
    for c, b in zip(contexts, buckets):
        seen[b].update(c[i : i + 400] for i in range(len(c) - 399))
    got = sa.repeated_starts(contexts, np.array(buckets))
    for c, b, own in zip(contexts, buckets, got):
        assert own.tolist() == [seen[b][c[i : i + 400]] > 1 for i in range(len(c) - 399)]


def test_cover():
    assert {(a - b) % sa.PERIOD for a in sa.COVER for b in sa.COVER} == set(range(sa.PERIOD))
    assert (sa._delta < sa.PERIOD).all()
    text = np.frombuffer(b"abracadabra" * 100 + b"zz", np.uint8)
    rank = sa.cover_ranks(sa._words(text), len(text))
    at = np.flatnonzero(rank >= 0)
    order = at[np.argsort(rank[at], kind="stable")]
    raw = text.tobytes()
    assert all(raw[a:] < raw[b:] for a, b in zip(order, order[1:]))
