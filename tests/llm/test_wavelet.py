import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chronolake.llm import wavelet
from chronolake.llm.wavelet import WaveletMatrix

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("n", [0, 1, 8, 511, 512, 513, 4000])
def test_matrix(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.4, n), 50_256).astype(np.uint16)
    letters, w = wavelet.to_matrix(ids)
    assert (letters[w.all()] == ids).all()
    if not n:
        return
    assert (letters[w.access(np.arange(n))] == ids).all()
    rnd = random.Random(n)
    for token in {0, 1, len(letters) - 1, len(letters) + 5}:
        at = np.flatnonzero(ids == letters[token]) if token < len(letters) else np.zeros(0, int)
        assert w.count(token) == len(at)
        a, b = sorted((rnd.randint(0, n), rnd.randint(0, n)))
        assert w.count(token, a, b) == ((at >= a) & (at < b)).sum()
        for k in {0, len(at) // 2, len(at) - 1} if len(at) else ():
            assert w.select(token, k) == at[k]
        assert w.select(token, len(at)) == -1


def test_known_planes():
    w = WaveletMatrix.build(np.array([2, 0, 3, 1], np.uint16), 2)
    assert w.zeros == [2, 2] and [format(int(p[0]), "08b")[:4] for p in w.planes] == ["1010", "0101"]


def test_shards_round_trip(spark, edge_docs, no_docs, tmp_path):
    library = Tokenizer.from_file(PATH)
    library.no_truncation(), library.no_padding()
    path = str(tmp_path / "s")
    wavelet.write_shards(edge_docs, path, PATH, shard_tokens=500)
    assert spark.read.parquet(path).count() > 3
    got = Counter((r.doc_id, r.start, bytes(r.ids)) for r in wavelet.read_documents(spark, path).collect())
    start, want = 0, Counter()
    for r in sorted(edge_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.text or "")):
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want[r.doc_id, start, ids.tobytes()] += 1
        start += len(ids)
    assert got == want
    wavelet.write_shards(no_docs, str(tmp_path / "e"), PATH)
    assert wavelet.read_documents(spark, str(tmp_path / "e")).count() == 0


def test_pieces_as_the_library():
    rnd, library, own = random.Random(9), Tokenizer.from_file(PATH), wavelet._tokenizer(PATH, "H")
    texts = ["".join(rnd.choice([*"abc 'srtd,.|\n\t  \x1c\x85\u3000é12漢", "<|endoftext|>", "word,", "\n\n", "inwh.\nWas", "éaie.\nAnè", "ÀÖß", "don't\nI'll", "x\n y", "x \ny", "ŉǆɐʰˠ", "字\n字"]) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, ascii(text)
    assert zlib.crc32(own.encode(["x"])[0]) == zlib.crc32(own.encode(["x"])[0])


def test_other_ids(spark, tmp_path):
    """Ids of any type that sorts."""
    for kind, ids in (("date", ["2024-01-02", "2024-01-01"]), ("decimal(10,2)", ["2.50", "1.25"]), ("string", ["b", "a"]), ("smallint", ["2", "1"])):
        docs = spark.createDataFrame([(i, t) for i, t in zip(ids, ["two words", "one"])], "doc_id string, text string").selectExpr(f"cast(doc_id as {kind}) as doc_id", "text")
        path = str(tmp_path / kind)
        wavelet.write_shards(docs, path, PATH)
        got = sorted((str(r.doc_id), r.start) for r in wavelet.read_documents(spark, path).collect())
        assert got == [(ids[1], 0), (ids[0], 2)]
