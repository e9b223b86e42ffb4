import random
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql.types import LongType, StructField, StructType
from tokenizers import Tokenizer

from chronolake.llm import bpe

from .conftest import words

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation(), t.no_padding()
    return t


def test_documents_as_the_library(spark, edge_docs, no_docs, library):
    got = bpe.encode(edge_docs, PATH).collect()
    assert len(got) == edge_docs.count()
    want = Counter()
    for r in edge_docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    assert bpe.encode(no_docs, PATH).count() == 0


def test_words_as_the_library(library):
    rnd, merger = random.Random(5), bpe.Merger(PATH)
    alphabet = "abcdefgxyz'sdtmlre.,!? \n\t\x0b\x1c\x85\xa0\u3000éÉüßñΣς12٣漢字🙂"
    for _ in range(3000):
        text = "".join(rnd.choice([*alphabet, "<|startoftext|>", "'ll"]) for _ in range(rnd.randint(0, 30)))
        assert [i for w in bpe.split_words(text) for i in merger.encode(w)] == library.encode(text, add_special_tokens=False).ids, ascii(text)


def test_merging_together_is_merging_alone():
    rnd, merger = random.Random(6), bpe.Merger(PATH)
    pieces = list({w.lower() for w in words(rnd, 3000)}) + ["a" * 60, "&&&", "漢字漢字", "x"]
    assert [np.frombuffer(b, "<i4").tolist() for b in merger.merge_all(pieces)] == [merger.merge(p) for p in pieces]
    assert merger.merge_all([]) == []


def test_lexicon_round_trip(tmp_path):
    rnd = random.Random(7)
    entries = {w.encode(): [k, k % 7][: 1 + k % 2] for k, w in enumerate(words(rnd, 5000) + ["é", "ab", "abc", "b"])}
    data = bpe.compile_lexicon(list(entries.items()))
    (tmp_path / "l.bin").write_bytes(data)
    lexicon = bpe.Lexicon.open(str(tmp_path / "l.bin"))
    assert all(lexicon.find(w) == ids for w, ids in entries.items())
    assert lexicon.find(b"zzzzzz") is None and lexicon.find(b"") is None and lexicon.find(b"a") == entries.get(b"a")
    assert lexicon.states < sum(map(len, entries)) / 2  # suffixes are shared
    assert bpe.Lexicon(bpe.compile_lexicon([])).find(b"x") is None


def test_frequent_words(spark):
    docs = spark.createDataFrame([(1, "a a a b b c"), (2, "a b d d"), (3, None)], "doc_id long, text string")
    assert set(bpe.frequent_words(docs, 10)) == {"a", "b", "d"}
    assert set(bpe.frequent_words(docs, 2)) == {"a", "b"}
    assert bpe.frequent_words(docs.limit(0), 5) == []


def test_words_known_before_a_clear(monkeypatch):
    """A batch finds all of its words, also those that were known when the dictionary had to be cleared."""
    merger = bpe.Merger(PATH)
    known = bpe._Encoded(merger, bpe.Lexicon(bpe.compile_lexicon([(b"the", merger.encode("the"))])))
    monkeypatch.setattr(bpe, "_encoded", lambda *names: known)
    monkeypatch.setattr(bpe, "KEEP", 2)

    class Documents:  # gives back what a task runs
        schema = StructType([StructField("doc_id", LongType())])
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    texts = ["the cat sat", "the dog", "the the", "the dog Cat. don't", "", "Cat. sat"]
    batches = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array([t])], ["doc_id", "text"]) for k, t in enumerate(texts)]
    got = [b.column(1).to_pylist()[0] for b in bpe.encode(Documents(), PATH, "lexicon")(iter(batches))]
    assert got == [[i for w in t.split() for i in merger.encode(w)] for t in texts]


def test_very_long_words(library):
    """Words of any length merge as the library does, in time that hardly grows faster than they do."""
    rnd, merger = random.Random(9), bpe.Merger(PATH)
    for n in (41, 300, 3000):
        for alphabet in ("ab", "abcdefghijklmnopqrstuvwxyz", "éüa"):
            word = "".join(rnd.choice(alphabet) for _ in range(n))
            assert merger.encode(word) == library.encode(word, add_special_tokens=False).ids
    start = time.perf_counter()
    assert len(merger.encode("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000)))) > 300_000
    assert time.perf_counter() - start < 60


def test_long_words_are_not_in_the_lexicon(spark):
    long = "x" * (bpe.MAX_LETTERS + 1)
    docs = spark.createDataFrame([(k, f"{long} {long} short") for k in range(3)], "doc_id long, text string")
    assert bpe.frequent_words(docs) == ["short"]
    got = bpe.encode(docs, PATH).collect()
    assert {tuple(r.ids) for r in got} == {tuple(2 * bpe.Merger(PATH).encode(long) + bpe.Merger(PATH).encode("short"))}
