import math
import os

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from chronolake.llm import toxicity
from chronolake.llm.common import read
from chronolake.llm.queries import tokenizer

from .test_minhash import brute as near
from .test_native import brute as contaminated
from .test_suffix_array import brute_texts as passages_out

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_stages(spark):
    """Each stage does to its input what plain loops over all words, shingles, strings and windows say, and nothing else."""
    docs = read(spark, SF, "documents").cache()
    columns = docs.columns
    made = []
    for name, stage in corpus_pipeline.STAGES:
        made.append(stage(spark, docs if not made else made[-1], SF).cache())
    clean, one, cut, pure, ids = made
    assert all(d.columns == columns for d in made[:4])
    text = lambda d: {r.doc_id: r.text for r in d.collect()}
    source = text(docs)
    machine = toxicity.learn(docs, read(spark, SF, "labels"))
    assert text(clean) == {i: t for i, t in source.items() if toxic(machine, t) < 0.5} != source
    rows = sorted(text(clean).items())
    kept = {i for i, _, _, head in near(rows, 80) if head}
    assert text(one) == {i: t for i, t in rows if i in kept} != dict(rows) and one.count() == len(kept)
    rows = sorted(text(one).items())
    want = dict(passages_out(rows).keys())
    assert text(cut) == want != dict(rows) and all(r.n_chars == len(r.text) for r in cut.collect())
    rows = sorted(text(cut).items())
    dirty = {i for i, *_, bad in contaminated(rows, [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]) if bad}
    assert text(pure) == {i: t for i, t in rows if i not in dirty}
    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    library.no_truncation(), library.no_padding()
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in text(pure).items()}
    assert {r.doc_id: (r.n_tokens, r.ids, r.decoded) for r in ids.collect()} == {i: (len(x), x, library.decode(x, skip_special_tokens=False)) for i, x in want.items()}
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(want)


def toxic(machine, text):
    """The machine's score by the sum over all pairs of a text's terms."""
    at = [machine.place[t] for t in toxicity.terms(text) if machine.place[t] >= 0]
    z = machine.bias + sum(machine.weights[i] for i in at) + sum(float(machine.factors[i] @ machine.factors[j]) for k, i in enumerate(at) for j in at[:k])
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_odd_documents(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        out = docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, SF).cache()
            assert name == "token_ids" or out.columns == docs.columns
        assert out.count() <= docs.count()
