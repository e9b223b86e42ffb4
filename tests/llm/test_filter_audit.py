import random
import re
from itertools import permutations

import numpy as np

from chronolake.llm import filter_audit


def brute(rows, labels):
    """{(part, order, step): the measures}, by applying every order to every document."""
    rows = [(i, t or "", s or "") for i, t, s in rows]
    good, toxic = ({i for i, *y in labels if i is not None and y[k] == 1} for k in (0, 1))

    def fails(i, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        return {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and any(t == text and j is not None and j < i for j, t, _ in rows),
        }

    found = [(i, s, fails(i, t)) for i, t, s in rows]
    out = {}
    for part in {s for _, _, s in rows}:
        own = [(i, f) for i, s, f in found if s == part]
        sums = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [i for i, x in left if x[f]], [(i, x) for i, x in left if not x[f]]
                sums[f] += len(gone)
                failing = sum(x[f] for _, x in own)
                alone = sum(x[f] and sum(x.values()) == 1 for _, x in own)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), alone, sum(i in good for i in gone), sum(i in toxic for i in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(sums[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def result(df):
    rows = df.collect()
    assert df.columns == ["part", "filter_order", "step", *filter_audit.MEASURES]
    found = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_documents(spark, edge_docs, no_docs):
    """All orders of all filters over odd and over plain documents, with null sources, repeated rows and labels that stand twice."""
    rnd = random.Random(3)
    rows = []
    for i in range(60):
        n = rnd.choice([0, 5, 150, 199, 200, 201, 300])
        text = " ".join(rnd.choice(["alpha", "Beta", "GAMMA", "d$", "é" * 3, f"w{rnd.randint(0, 400)}"]) for _ in range(n))
        rows.append((i, text if rnd.random() < 0.9 else None, rnd.choice(["a", "b", None, ""])))
    rows += [(i + 100, rows[i][1], "b") for i in range(0, 60, 3)] + [rows[7], (None, rows[3][1], "a"), (None, rows[3][1], "a"), (5, "another text of the id", "a")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 60, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (999, 1, 1)]
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(*r, "x", 1, True) for r in rows], "doc_id long, text string, source string, part string, mask int, good boolean")
    assert result(filter_audit.audit(docs.repartition(3), labelled)) == brute(rows, labels)
    edge = [(r.doc_id, r.text, r.source) for r in edge_docs.collect()]
    assert result(filter_audit.audit(edge_docs, labelled)) == brute(edge, labels)
    assert filter_audit.audit(no_docs, labelled).count() == 0
    assert result(filter_audit.audit(docs, labelled.limit(0))) == brute(rows, [])


def test_swaps_visit_every_order():
    for n in range(1, 7):
        order = list(range(n))
        seen = {tuple(order)}
        for k in filter_audit.neighbour_swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == len(set(permutations(range(n))))


def test_many_parts(spark):
    """More parts than one walk takes; other filters than the five."""
    rows = [(f"p{i}", i % 8, i % 3 == 0, None) for i in range(100)]
    df = spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean")
    found = filter_audit.interactions(df, "xyz").collect()
    assert len(found) == 100 * 6 * 3
    for r in found:
        mask = int(r.part[1:]) % 8
        before = sum(1 << "xyz".index(c) for c in r.filter_order[: r.step - 1])
        bit = 1 << "xyz".index(r.filter_order[r.step - 1])
        assert r.removed == (mask & before == 0 and mask & bit > 0) and r.kept == (mask & (before | bit) == 0) and r.toxic_lost == 0


def test_shapley_sums_to_what_all_filters_remove():
    cells = np.random.default_rng(5).integers(0, 50, (3, 32, 3))
    orders, found = filter_audit.walk(cells, 5)
    assert len(set(orders)) == 120
    assert (found["shapley"].sum(axis=1) == 120 * (cells[:, 1:, 0].sum(axis=1))).all()
