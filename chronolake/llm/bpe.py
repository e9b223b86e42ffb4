"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

Frequent words (runs between white space, which no token crosses) are counted over all documents and compiled into a
shared-suffix automaton. Its arcs carry number outputs whose sum is the word's index, and that leads to the word's ids. The file is
memory-mapped by every executor; words that it lacks are merged exactly by the tokenizer's merge ranks.
"""

from __future__ import annotations

import json
import mmap
import re
import struct
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, stored

#: Most words in a lexicon, and the most letters of each; it only saves merging, so results don't depend on it. About 6 MB compiled.
MAX_WORDS, MAX_LETTERS = 131_072, 64
#: Words that a worker keeps encoded, their letters in all, and words that it counts before it hands the counts on.
KEEP, KEEP_LETTERS, COUNT_AT_ONCE = 400_000, 16_000_000, 200_000
#: Pieces of more bytes are merged one by one; texts are encoded so many at a time.
LONG, TEXTS = 40, 500
NONE, NO_RANK, TOGETHER = (1 << 20) - 1, 1 << 30, 2048

# Fixed values of the tokenizer's format: white space, the letters that stand for bytes, the split pattern, the end of a word.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + SPACE + r"\p{L}\p{N}]+"
END = "</w>"

_spaces = re.compile(f"[{SPACE}]+")
_pieces = regex.compile(PATTERN)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it prints, else the next free code point from 256."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(free)) for b in range(256)]


class Merger:
    """Exact encoding of single words by merge ranks, and decoding of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        names = {i: t for t, i in (self.vocab | self.special).items()}
        self.token = [names.get(i, "") for i in range(max(names) + 1)]
        self.letters = byte_letters()
        pairs = sorted((self.vocab[a] << 20 | self.vocab[b], r, self.vocab[a + b]) for (a, b), r in self.ranks.items())
        self.pair_keys, self.pair_ranks = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], np.int32)
        self.merged = np.zeros(len(self.ranks), np.int32)
        self.merged[self.pair_ranks] = [p[2] for p in pairs]
        self.byte_ids, self.last_ids = (np.array([self.vocab[x + end] for x in self.letters]) for end in ("", END))
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, piece: str) -> list[int]:
        """The ids of one piece: pairs wait in a heap by rank and place, symbols are a linked list, so a piece of n letters takes n log n."""
        letters = self.letters
        parts: list[str | None] = [letters[b] for b in piece.encode()]
        parts[-1] += END
        n, rank = len(parts), self.ranks.get
        behind, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i, pair in enumerate(zip(parts, parts[1:])) if (r := rank(pair)) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = behind[i]
            if parts[i] is None or j < 0 or rank((parts[i], parts[j])) != r:
                continue  # one of the two has been merged since
            parts[i] += parts[j]
            parts[j] = None
            k = behind[i] = behind[j]
            if k >= 0:
                before[k] = i
                if (r := rank((parts[i], parts[k]))) is not None:
                    heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := rank((parts[h], parts[i]))) is not None:
                heappush(heap, (r, h))
        return [self.vocab[p] for p in parts if p is not None]

    def pieces(self, word: str) -> list[str | int]:
        """The pieces of a word that are merged on their own, and the ids of special tokens in it."""
        if word.isascii():
            if word.isalpha():
                return [word.lower()]
            if word[:-1].isalpha() and not word[-1].isdigit():  # a word and one mark
                return [word[:-1].lower(), word[-1]]
        if self.cut and self.cut.search(word):
            return [i for part in self.cut.split(word) if part for i in ([self.special[part]] if part in self.special else self.pieces(part))]
        # capital sigma has one lower-case form here, wherever it stands
        return _pieces.findall(unicodedata.normalize("NFC", word).replace("Σ", "σ").lower())

    def encode(self, word: str) -> list[int]:
        """Ids of a word, that is of text without white space inside."""
        return [i for piece in self.pieces(word) for i in ([piece] if isinstance(piece, int) else self.merge(piece))]

    def merge_all(self, pieces: list[str]) -> list[bytes]:
        """merge() of many pieces at once, as int32 bytes: a row of symbols each, whose lowest-ranked pairs are merged step by step."""
        raw = [p.encode() for p in pieces]
        size = np.array([len(r) for r in raw], np.int64)
        out: list = [None] * len(pieces)
        order = np.argsort(size, kind="stable")
        short = int(np.searchsorted(size[order], LONG, "right"))
        for k in order[short:].tolist():
            out[k] = array("i", self.merge(pieces[k])).tobytes()
        for at in range(0, short, TOGETHER):  # pieces of about the same size
            own = order[at : min(at + TOGETHER, short)]
            for k, ids in zip(own.tolist(), self._merge_rows(b"".join(raw[k] for k in own), size[own]), strict=True):
                out[k] = ids
        return out

    def _merge_rows(self, data: bytes, size: np.ndarray) -> list[bytes]:
        n, width = len(size), int(size.max()) + 1
        row = np.repeat(np.arange(n), size)
        column = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        symbols = np.full((n, width), NONE, np.int32)
        letters = np.frombuffer(data, np.uint8)
        symbols[row, column] = np.where(column == size[row] - 1, self.last_ids[letters], self.byte_ids[letters])
        ranks = np.full((n, width), NO_RANK, np.int32)
        ranks[:, :-1] = self._rank(symbols[:, :-1], symbols[:, 1:])
        done: list = [None] * n
        names, places = np.arange(n), np.arange(width - 1)
        while len(names):
            at = ranks.argmin(axis=1)  # the leftmost of the lowest
            every = np.arange(len(names))
            rank = ranks[every, at]
            live = rank < NO_RANK
            if not live.all():
                over = symbols[~live]
                row_bytes, ends = over.tobytes(), (4 * (over != NONE).sum(axis=1)).tolist()
                for i, (k, end) in enumerate(zip(names[~live].tolist(), ends, strict=True)):
                    done[k] = row_bytes[i * 4 * width : i * 4 * width + end]
                names, symbols, ranks, at, rank = (x[live] for x in (names, symbols, ranks, at, rank))
                every = np.arange(len(names))
                if not len(names):
                    break
            behind = places >= at[:, None] + 1  # what moves one place to the left
            np.copyto(symbols[:, :-1], symbols[:, 1:].copy(), where=behind)
            np.copyto(ranks[:, :-1], ranks[:, 1:].copy(), where=behind)
            new = self.merged[rank]
            symbols[every, at] = new
            ranks[every, at] = self._rank(new, symbols[every, at + 1])
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self._rank(symbols[left, at[left] - 1], new[left])
        return done

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_RANK)

    def decode(self, ids) -> str:
        """Tokens joined by one space; special tokens stay."""
        return " ".join(map(self.token.__getitem__, ids))


def split_words(text: str) -> list[str]:
    # str.split() also cuts at the four ASCII separators, which are not white space for the tokenizer
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return [w for w in _spaces.split(text) if w]
    return text.split()


# --- the transducer -------------------------------------------------------------------------------------------------

_HEAD = struct.Struct("<4sIIII")


def compile_lexicon(entries: list[tuple[bytes, list[int]]]) -> bytes:
    """The automaton of the words, whose bytes must be distinct, as one file.

    States are registered from the leaves up, so that equal suffixes are shared (the incremental construction for sorted
    words). Each arc has a label, a target and the number of words that sort before those behind it.
    """
    entries = sorted(entries)
    register: dict[tuple, int] = {}
    arcs_of: list[tuple] = []  # by state: (final, ((label, target), ...))
    words_of: list[int] = []  # by state: words behind it

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if (state := register.get(key)) is None:
            state = register[key] = len(arcs_of)
            arcs_of.append(key)
            words_of.append(key[0] + sum(words_of[t] for _, t in key[1]))
        return state

    path: list[list] = [[0, []]]  # of the last word: final, arcs that are settled
    last = b""
    for word, _ in entries:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        for depth in range(len(last), same, -1):
            state = settle(path.pop())
            path[-1][1].append((last[depth - 1], state))
        path.extend([0, []] for _ in word[same:])
        path[-1][0] = 1
        last = word
    for depth in range(len(last), 0, -1):
        state = settle(path.pop())
        path[-1][1].append((last[depth - 1], state))
    settle(path.pop())  # the root is the last state

    starts, labels, targets, skips = array("I", [0]), bytearray(), array("I"), array("I")
    finals = bytearray()
    for final, arcs in arcs_of:
        finals.append(final)
        before = final
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            skips.append(before)
            before += words_of[target]
        starts.append(len(labels))
    id_starts, ids = array("I", [0]), array("I")
    for _, own in entries:
        ids.extend(own)
        id_starts.append(len(ids))
    pad = bytes(-(len(labels) + len(finals)) % 4)
    head = _HEAD.pack(b"MAT1", len(finals), len(labels), len(entries), len(ids))
    return head + starts.tobytes() + targets.tobytes() + skips.tobytes() + id_starts.tobytes() + ids.tobytes() + bytes(labels) + bytes(finals) + pad


class Lexicon:
    """A compiled lexicon over a memory map (or bytes)."""

    def __init__(self, buffer):
        magic, states, arcs, words, ids = _HEAD.unpack_from(buffer, 0)
        if magic != b"MAT1":
            raise ValueError("not a lexicon")
        self.buffer, self.words, self.states = buffer, words, states
        at = _HEAD.size

        def numbers(n: int, kind=np.uint32) -> np.ndarray:
            nonlocal at
            own = np.frombuffer(buffer, kind, n, at)
            at += own.nbytes
            return own

        starts, self.targets, self.skips = numbers(states + 1), numbers(arcs), numbers(arcs)
        self.id_starts, id_array, labels, self.finals = numbers(words + 1), numbers(ids), numbers(arcs, np.uint8), numbers(states, np.uint8)
        self.id_bytes = memoryview(id_array).cast("B")
        # arcs are in order of state and label
        self.arc_keys = np.repeat(np.arange(states, dtype=np.int64), np.diff(starts.astype(np.int64))) << 8 | labels

    @classmethod
    def open(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, word: bytes) -> list[int] | None:
        found = self.find_all([word])[0]
        return None if found is None else np.frombuffer(found, np.uint32).tolist()

    def find_all(self, words: list[bytes]) -> list[bytes | None]:
        """The ids of each word as uint32 bytes, None where the lexicon lacks it. All words go one arc on at a time."""
        out: list[bytes | None] = [None] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        data, begin = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        live, state, index = np.arange(len(words)), np.full(len(words), self.states - 1), np.zeros(len(words), np.int64)
        depth = 0
        while len(live):
            ended = size[live] == depth
            if ended.any():
                hit = ended & (self.finals[state] == 1)
                ids = self.id_starts
                for k, i in zip(live[hit].tolist(), index[hit].tolist(), strict=True):
                    out[k] = self.id_bytes[4 * int(ids[i]) : 4 * int(ids[i + 1])]
                live, state, index = live[~ended], state[~ended], index[~ended]
            key = state << 8 | data[begin[live] + depth]
            arc = np.minimum(np.searchsorted(self.arc_keys, key), max(len(self.arc_keys) - 1, 0))
            known = self.arc_keys[arc] == key if len(self.arc_keys) else np.zeros(len(key), bool)
            live, index, arc = live[known], index[known], arc[known]
            index, state = index + self.skips[arc], self.targets[arc].astype(np.int64)
            depth += 1
        return out


# --- on Spark -------------------------------------------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(w for w in split_words(text or "") if len(w) <= MAX_LETTERS)
            if len(counts) > COUNT_AT_ONCE:
                yield out()
                counts.clear()
    yield out()


def frequent_words(documents: DataFrame, max_words: int = MAX_WORDS) -> list[str]:
    """The words of the most occurrences over all documents, at most max_words, of MAX_LETTERS letters and at least two occurrences each.

    The least count is found from the distribution of counts, so that no task sorts all words.
    """
    counts = documents.select("text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n >= 2")
    counts = stored(counts, "words")
    # the distribution over fine logarithmic steps has some thousand rows at most
    step = F.floor(64 * F.log2("n"))
    spread = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect()
    least, total = None, 0
    for row in spread:
        total += row.words
        if total > max_words:
            break
        least = row.step
    if least is None:
        return []
    return [r.word for r in counts.where(step >= least).select("word").collect()]


def build_lexicon(documents: DataFrame, tokenizer_path: str, max_words: int = MAX_WORDS) -> str:
    """Compiles the lexicon of the documents, gives it to all executors and returns its file name there."""
    spark = documents.sparkSession
    merger = Merger(tokenizer_path)
    data = compile_lexicon([(w.encode(), merger.encode(w)) for w in frequent_words(documents, max_words)])
    path = f"{scratch_path(spark, 'lexicon')}.bin"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    out.write(data)
    out.close()
    spark.sparkContext.addFile(path)  # a lost executor's successor fetches it again
    return path.rsplit("/", 1)[1]


@cache
def _merger(tokenizer_path: str) -> Merger:
    return Merger(tokenizer_path)


class _Encoded(dict):
    """word -> its ids as little-endian int32 bytes."""

    def __init__(self, merger: Merger, lexicon: Lexicon):
        self.merger, self.lexicon, self.letters = merger, lexicon, 0

    def learn(self, words: set[str]) -> None:
        """Adds those of the words that are not known, from the lexicon or else merged all together; then all of them are known."""
        if len(self) > KEEP or self.letters > KEEP_LETTERS:  # before it is seen which words are known: what is needed again is learned again
            self.clear()
            self.letters = 0
        listed = list(words.difference(self))
        self.letters += sum(map(len, listed))
        lacking = []
        for w, found in zip(listed, self.lexicon.find_all([w.encode() for w in listed]), strict=True):
            if found is None:
                lacking.append(w)
            else:
                self[w] = bytes(found)
        # most are plain words, or plain words with one mark behind them
        plain = [w for w in lacking if w.isascii() and w.isalpha()]
        marked = [w for w in lacking if w.isascii() and w[:-1].isalpha() and not w[-1].isalnum()]
        done = {*plain, *marked}
        pieces = {w: self.merger.pieces(w) for w in lacking if w not in done}
        lower, bodies, marks = [w.lower() for w in plain], [w[:-1].lower() for w in marked], [w[-1] for w in marked]
        new = list({*lower, *bodies, *marks, *(p for own in pieces.values() for p in own if isinstance(p, str))})
        merged: dict[str | int, bytes] = dict(zip(new, self.merger.merge_all(new), strict=True))
        merged |= {i: array("i", [i]).tobytes() for i in self.merger.special.values()}
        self.update(zip(plain, map(merged.__getitem__, lower), strict=True))
        self.update(zip(marked, map(add, map(merged.__getitem__, bodies), map(merged.__getitem__, marks)), strict=True))
        self.update((w, b"".join(map(merged.__getitem__, own))) for w, own in pieces.items())


@lru_cache(maxsize=1)  # a worker serves several runs, each with a lexicon of its own
def _encoded(tokenizer_path: str, lexicon_file: str) -> _Encoded:
    return _Encoded(_merger(tokenizer_path), Lexicon.open(SparkFiles.get(lexicon_file)))


def encode(documents: DataFrame, tokenizer_path: str, lexicon_file: str | None = None) -> DataFrame:
    """documents(doc_id, text) encoded and decoded again.

    Returns doc_id, ids array<int>, decoded string (the tokens of the ids joined by one space). Null and empty texts, and
    those of white space alone, have no ids and decode to an empty string. Repeated rows and null ids are encoded one by one;
    no rows give no rows; other columns are ignored. Texts are encoded whole, whatever their length.
    """
    if lexicon_file is None:
        lexicon_file = build_lexicon(documents, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _encoded(tokenizer_path, lexicon_file)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                words = [split_words(t or "") for t in batch.column(1).to_pylist()]
                known.learn(set().union(*words))
                own = [np.frombuffer(b"".join(map(known.__getitem__, w)), "<i4") for w in words]
                ends = np.cumsum([0, *map(len, own)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(own) if own else np.zeros(0, np.int32)))
                decoded = pa.array([known.merger.decode(x.tolist()) for x in own], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, decoded], ["doc_id", "ids", "decoded"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")

