"""Token-ID output as one wavelet matrix per shard.

A shard holds about a million token ids in document order. Its distinct ids are numbered, and there is one bit-plane for each
bit of a number, each with counts of ones before every block of 512 bits. That gives access to any token, counts of an id in any range, and the place of
its k-th occurrence, from the compressed file alone. A shard is one row of a Parquet dataset, which all executors can write and read.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .bpe import byte_letters

SHARD_TOKENS = 1 << 20
BLOCK = 512
#: Pieces of text that a worker keeps encoded, and their letters, at most (but for what one batch needs).
KEEP, KEEP_LETTERS = 1_000_000, 16_000_000
MARKS = ".,;:!?|"
#: Letters below this one are letters in every version of Unicode.
LATIN_END = "\u02b0"
SHARD = "part int, seq int, doc_ids array<{id}>, offsets array<int>, alphabet binary, zeros array<int>, planes array<binary>, ranks array<binary>"


class WaveletMatrix:
    """Bit-planes from the highest bit down; at each, entries with a zero come first in the next plane, in order."""

    def __init__(self, size: int, bits: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.size, self.bits, self.zeros = size, bits, zeros
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        zeros, planes, ranks = [], [], []
        now = ids
        for level in range(bits - 1, -1, -1):
            one = (now & now.dtype.type(1 << level)) != 0
            plane = np.packbits(one)
            padded = np.zeros(-(-len(ids) // BLOCK) * (BLOCK // 8), np.uint8)
            padded[: len(plane)] = plane
            ones = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
            ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype("<u4").tobytes())
            planes.append(plane.tobytes())
            now = np.concatenate([np.compress(~one, now), np.compress(one, now)])
            zeros.append(len(ids) - int(ones.sum()))
        return cls(len(ids), bits, zeros, planes, ranks)

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position of a plane."""
        at = np.asarray(at, np.int64)
        plane, block = self.planes[level], at // BLOCK
        found = self.ranks[level][block].astype(np.int64)
        first = block * (BLOCK // 8)
        for k in range(BLOCK // 8):  # whole bytes of the block before the position
            byte = first + k
            found += np.where((byte + 1) * 8 <= at, np.bitwise_count(plane[np.minimum(byte, len(plane) - 1)]), 0) if len(plane) else 0
        rest = at % 8
        byte = np.minimum(at // 8, max(len(plane) - 1, 0))
        return found + (np.where(rest > 0, np.bitwise_count(plane[byte] >> (8 - rest).astype(np.uint8) * (rest > 0)), 0) if len(plane) else 0)

    def _bit(self, level: int, at: np.ndarray) -> np.ndarray:
        return self.planes[level][at // 8] >> (7 - at % 8).astype(np.uint8) & 1

    def access(self, at) -> np.ndarray:
        """The ids at the positions."""
        at = np.asarray(at, np.int64)
        ids = np.zeros(at.shape, np.int64)
        for level in range(self.bits):
            bit, ones = self._bit(level, at), self._ones(level, at)
            ids = ids << 1 | bit
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return ids

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        ends = np.array([start, end], np.int64)
        for level in range(self.bits):
            ones = self._ones(level, ends)
            ends = self.zeros[level] + ones if token >> (self.bits - 1 - level) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of the id in [start, end)."""
        if token >> self.bits:
            return 0
        first, last = self._range(token, start, self.size if end is None else end)
        return last - first

    def select(self, token: int, k: int) -> int:
        """The position of the id's k-th occurrence, from 0; -1 if there are fewer."""
        if token >> self.bits or k < 0:
            return -1
        first, last = self._range(token, 0, self.size)
        if first + k >= last:
            return -1
        at = first + k
        for level in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - level) & 1
            want = at - self.zeros[level] if one else at
            low, high = 0, self.size - 1
            while low < high:  # the least position with more than `want` such bits up to it
                mid = (low + high) // 2
                ones = int(self._ones(level, np.array([mid + 1]))[0])
                if (ones if one else mid + 1 - ones) > want:
                    high = mid
                else:
                    low = mid + 1
            at = low
        return at

    def all(self) -> np.ndarray:
        """All ids in order: planes are undone from the lowest up."""
        ids = np.zeros(self.size, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.size).view(bool)
            ids[self.zeros[level] :] |= ids.dtype.type(1 << (self.bits - 1 - level))
            above = np.empty_like(ids)
            above[np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)])] = ids
            ids = above
        return ids


def to_matrix(ids: np.ndarray) -> tuple[np.ndarray, WaveletMatrix]:
    """(alphabet, matrix): the distinct ids in order, and the matrix of their numbers, in as few bits as these need."""
    letters = np.flatnonzero(np.bincount(ids)).astype("<u4") if len(ids) else np.zeros(0, "<u4")
    number = np.zeros(int(letters[-1]) + 1 if len(letters) else 1, np.uint16 if len(letters) <= 1 << 16 else np.uint32)
    number[letters] = np.arange(len(letters))
    return letters, WaveletMatrix.build(number[ids], max(1, (len(letters) - 1).bit_length()))


# White space of the tokenizer's pattern. No token crosses the start of a run of it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_pieces = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


def _cuttable(parts: list[str]) -> bool:
    """Whether single line ends stand between these parts, with nothing else of white space beside them."""
    return all(p and not p[0].isspace() and not p[-1].isspace() for p in parts)


class _Tokenizer:
    """Encodes texts piece by piece; the library encodes each new piece once."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = kind
        self.marks = {m: array(kind, self.tokenizer.encode(m, add_special_tokens=False).ids).tobytes() for m in MARKS}
        self.line_end = array(kind, self.tokenizer.encode("\n", add_special_tokens=False).ids).tobytes()
        letters = byte_letters()
        self.letters = dict(enumerate(letters))
        self.shown = {"": "", " ": letters[32]}
        self.known: dict[str, bytes] = {}
        self.behind: dict[str, bytes] = {}  # of pieces that a single space precedes
        self.held = {"": 0, " ": 0}  # letters of both, by what precedes the pieces

    def _learn(self, known: dict[str, bytes], pieces: set[str], prefix: str) -> None:
        """Adds pieces. The pattern cuts at a line end between two words and before one mark behind a word, so their parts are encoded alone."""
        lines = {p: parts for p in pieces if "\n" in p and _cuttable(parts := p.split("\n"))}
        if lines:
            pieces = pieces.difference(lines)
            heads = {parts[0] for parts in lines.values()}.difference(known)
            self._learn_words(known, pieces.union(heads), prefix)
            self._learn_words(self.known, {t for parts in lines.values() for t in parts[1:]}.difference(self.known), "")
            for p, (head, *tail) in lines.items():
                known[p] = known[head] + b"".join(self.line_end + self.known[t] for t in tail)
        else:
            self._learn_words(known, pieces, prefix)

    def _learn_words(self, known: dict[str, bytes], pieces: set[str], prefix: str) -> None:
        split = {p for p in pieces if p[-1:] in MARKS and p[:-1].isalpha()}
        bodies = {p[:-1] for p in split}.difference(known)
        plain, words = [], []  # letters alone are one word to the pattern
        for p in bodies.union(pieces.difference(split)):
            (words if p.isalpha() and (p.isascii() or max(p) < LATIN_END) else plain).append(p)
        merge, start = self.tokenizer.model.tokenize, self.shown[prefix]
        flat: list[int] = []
        ends = [0]
        for p in words:
            shown = p if p.isascii() else p.encode().decode("latin-1").translate(self.letters)
            flat += [t.id for t in merge(start + shown)]
            ends.append(len(flat))
        self._keep(known, words, array(self.kind, flat), ends)
        for at in range(0, len(plain), 4096):
            own = plain[at : at + 4096]
            found = self.tokenizer.encode([prefix + p for p in own], is_pretokenized=True, add_special_tokens=False)
            self._keep(known, own, array(self.kind, found.ids), np.searchsorted(np.array(found.word_ids), np.arange(len(own) + 1)).tolist())
        for p in split:
            known[p] = known[p[:-1]] + self.marks[p[-1]]

    @staticmethod
    def _keep(known: dict[str, bytes], pieces: list[str], ids: array, ends: list[int]) -> None:
        data, size = ids.tobytes(), ids.itemsize
        for piece, a, z in zip(pieces, ends, ends[1:], strict=False):
            known[piece] = data[a * size : z * size]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, of the array type of the tokenizer."""
        heads, tails = [], []
        for text in texts:
            text = text or ""
            if "  " in text:  # a run of spaces is more than one piece to split() but one to the tokenizer
                heads.append(_pieces.findall(text)), tails.append([])
            else:
                head, *tail = text.split(" ")
                heads.append([head] if head else []), tails.append(tail)
        # first it is made room, then each piece that is not known is learned, then all are found
        for known, own, prefix in ((self.known, heads, ""), (self.behind, tails, " ")):
            if len(known) > KEEP or self.held[prefix] > KEEP_LETTERS:
                known.clear()
                self.held[prefix] = 0
            new = set(chain.from_iterable(own)).difference(known)
            self.held[prefix] += sum(map(len, new))
            self._learn(known, new, prefix)
        first, rest = self.known.__getitem__, self.behind.__getitem__
        return [b"".join(chain(map(first, h), map(rest, t))) for h, t in zip(heads, tails, strict=True)]


@cache
def _tokenizer(path: str, kind: str) -> _Tokenizer:
    return _Tokenizer(path, kind)


def write_shards(documents: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, bits: int = 16, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes documents(doc_id, text) in ascending doc_id order (ties by text; nulls first) as shards under path.

    Each document's ids are followed by end_id, which is all that null and empty texts have. Ids must be below 2 ** bits. A
    document lies in one shard; a shard is closed at shard_tokens ids, so it grows beyond that only by its last document. doc_id may
    be of any type that Spark can sort.
    Other columns are ignored; no rows give a dataset without shards.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = SHARD.format(id=kind)
    arrow_id = to_arrow_type(documents.schema["doc_id"].dataType)
    fields = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_ids", pa.list_(arrow_id)), ("offsets", pa.list_(pa.int32())), ("alphabet", pa.binary()), ("zeros", pa.list_(pa.int32())), ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary()))])
    code = "H" if bits <= 16 else "I"
    end = array(code, [end_id]).tobytes()
    width = len(end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, seq = _tokenizer(tokenizer_path, code), TaskContext.get().partitionId(), 0
        doc_ids, ids, held = [], [], 0

        def shard() -> pa.RecordBatch:
            lengths = [len(x) // width for x in ids]
            letters, w = to_matrix(np.frombuffer(b"".join(ids), code))
            offsets = [0, *np.cumsum(lengths).tolist()]
            row = [part, seq, doc_ids, offsets, letters.tobytes(), w.zeros, [p.tobytes() for p in w.planes], [r.tobytes() for r in w.ranks]]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, fields, strict=True)], schema=fields)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(keys), 256):
                for key, own in zip(keys[at : at + 256], tokenizer.encode(texts[at : at + 256]), strict=True):
                    doc_ids.append(key)
                    ids.append(own + end)
                    held += len(own) // width + 1
                    if held >= shard_tokens:
                        yield shard()
                        seq, doc_ids, ids, held = seq + 1, [], [], 0
        if doc_ids:
            yield shard()

    ordered = documents.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, schema).write.parquet(path)


def read_documents(spark: SparkSession, path: str, **derived: Column) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (binary, little-endian uint32, with the end id), from the shards.

    With `derived`, these columns of ids stand in place of ids, and are made before the starts are joined on. Starts come from the shards' sizes: over parts by one window of a row for each part, within a part by its shards.
    """
    shards = spark.read.parquet(path)
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    sizes = shards.select("part", "seq", F.element_at("offsets", -1).cast("long").alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("part_n"))
    before = lambda n, *by: F.coalesce(F.sum(n).over((Window.partitionBy(*by) if by else Window).orderBy("seq" if by else "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before("part_n").alias("part_start"))
    starts = sizes.join(parts, "part").select("part", "seq", (F.col("part_start") + before("n", "part")).alias("shard_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, seq, doc_ids, offsets, alphabet, zeros, planes, ranks = (batch.column(k)[i] for k in range(8))
                ends = offsets.as_py()
                matrix = WaveletMatrix(ends[-1], len(zeros), zeros.as_py(), planes.as_py(), ranks.as_py())
                ids, n = np.frombuffer(alphabet.as_buffer(), "<u4")[matrix.all()], len(ends) - 1
                for at in range(0, n, 256):  # some documents at a time
                    to = min(at + 256, n)
                    own = [ids[ends[k] : ends[k + 1]].tobytes() for k in range(at, to)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part.as_py()] * (to - at), pa.int32()), pa.array([seq.as_py()] * (to - at), pa.int32()), pa.array(ends[at:to], pa.int64()), doc_ids.values.slice(at, to - at), pa.array(own, pa.binary())],
                        ["part", "seq", "offset", "doc_id", "ids"],
                    )

    decoded = shards.mapInArrow(run, f"part int, seq int, offset long, doc_id {kind}, ids binary")
    decoded = decoded.select("part", "seq", "offset", "doc_id", *([c.alias(name) for name, c in derived.items()] or ["ids"]))
    return decoded.join(starts, ["part", "seq"]).select("doc_id", (F.col("shard_start") + F.col("offset")).alias("start"), *(derived or ["ids"]))
