"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

Every start of a string of the wanted length has an anchor: the place of the least 64-byte hash inside the string. Equal
strings have equal anchors at equal distances, so the suffixes to compare are those of one anchor hash: a suffix bucket. Contexts
that are equal as a whole are one class and are settled by counting. What remains is sorted one block of buckets at a time: by
the first 32 bytes, and ties by the ranks of the difference-cover sample, which are computed once for the block. No two
suffixes are ever compared byte by byte over long ties, and memory is bounded by a block. A bucket of too many contexts is split
first: starts at about the same distance from the anchor share the middle of their strings, and its hash is a bucket of its own; at
the last level that is the whole string.

A repeat of LENGTH bytes lies in a run of repeats of PASSAGE bytes, so the longer ones are sought only in such runs; the runs
themselves tell repeated passages of more than WORDS words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, stored, unused

#: Bytes of a string that is removed wherever it is repeated.
LENGTH = 400
#: A passage is a run of repeated strings of so many bytes, with more than so many words. On 9,248 documents (sf0.1, near duplicates
#: out) a length of 400 covers 58 % of the 2,327 shared runs of more than 50 words, 300 covers 94 %, 250 covers 97 %, 200 covers 99 %.
PASSAGE, WORDS = 200, 50
GRAM = 64  # a power of two
#: Bytes of a text that are hashed at a time; the place of a hash has to fit into 20 bits.
CHUNK = 1 << 20
#: Bytes of contexts that are sorted at a time, but for a bucket that alone has more.
BLOCK = 2_000_000
#: Buckets of more different contexts are split, into so many ranges of distances at first, and then by each distance.
CROWD, PARTS = 4096, 16
# A planar difference set; the differences of its members are all numbers modulo 31.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)

_table = np.random.default_rng(400).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def anchors(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first start, last start, place) of each anchor of a text of at least `length` bytes, in order."""
    span = length - GRAM + 1
    h = _table[text]
    step, m = 1, 0x9E3779B97F4A7C15
    while step < GRAM:
        h = h[:-step] * np.uint64(m) + h[step:]
        step, m = 2 * step, m * m % (1 << 64)
    h = _mix(h)
    low = np.uint64((1 << 20) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal hashes
    width = 1
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if span > width:
        least = np.minimum(least[: width - span], least[span - width :])
    cut = np.flatnonzero(least[1:] != least[:-1]) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut - 1, [len(least) - 1]])
    place = (least[first] & low).astype(np.int64)
    return h[place], first, last, place


ROW = "version long, anchor long, context long, first int, last int, place int"


def _row_batch(batch: pa.RecordBatch, row: list, *columns: list) -> pa.RecordBatch:
    """doc_id and version of the rows of a batch, beside the numbers of anchor, context, first, last and place."""
    at, kinds = pa.array(row, pa.int64()), (np.int64, np.int64, np.int32, np.int32, np.int32)
    own = [pa.array(np.asarray(x).astype(np.uint64).view(np.int64) if k == np.int64 else np.asarray(x, k)) for x, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *own], ["doc_id", "version", "anchor", "context", "first", "last", "place"])


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            contexts: list[int] = []

            def out() -> pa.RecordBatch:
                row, anchor, first, last, place = (np.concatenate(x) for x in zip(*parts, strict=True))
                return _row_batch(batch, row, anchor, np.array(contexts, np.uint64), first, last, place)

            for i, cell in enumerate(batch.column(2)):
                data = cell.as_buffer() if cell.is_valid else b""
                text = np.frombuffer(data, np.uint8)
                view = memoryview(data)
                for base in range(0, len(text) - length + 1, CHUNK - length):
                    h, first, last, place = anchors(text[base : base + CHUNK - 1], length)
                    first, last = first + base, last + base
                    parts.append((np.full(len(h), i), h, first, last, place + base))
                    contexts.extend(xxhash.xxh3_64_intdigest(view[a : z + length]) for a, z in zip(first.tolist(), last.tolist(), strict=True))
                    if len(contexts) > 200_000:
                        yield out()
                        parts, contexts = [], []
            if parts:
                yield out()

    return run


def _split_rows(length: int, width: int):
    """Rows of the wanted contexts of a text, cut by `width` distances to the anchor; their anchors are hashes of what all starts of a cut share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, (text, wanted) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                data = memoryview(text.as_buffer())
                for w in wanted.as_py():
                    first, last, place = w["first"], w["last"], w["place"]
                    for k in range((place - last) // width, (place - first) // width + 1):
                        near, far = place - k * width, place - (k + 1) * width + 1
                        a, z = max(first, far), min(last, near)
                        rows.append((i, xxhash.xxh3_64_intdigest(data[near : far + length], k), xxhash.xxh3_64_intdigest(data[a : z + length]), a, z, place))
                if len(rows) > 200_000:
                    yield _row_batch(batch, *map(list, zip(*rows, strict=True)))
                    rows = []
            if rows:
                yield _row_batch(batch, *map(list, zip(*rows, strict=True)))

    return run


# --- sorting --------------------------------------------------------------------------------------------------------

_delta = np.full((PERIOD, PERIOD), PERIOD, np.int64)
for _d in range(PERIOD):
    _r = np.isin((np.arange(PERIOD) + _d) % PERIOD, COVER)
    _delta[np.ix_(_r, _r)] = np.minimum(_delta[np.ix_(_r, _r)], _d)


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number that sorts like them; zeros follow the text."""
    x = np.concatenate([text, np.zeros(64, np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        x = (x[:-step] << np.uint64(8 * step)) | x[step:]
    return x


def _dense(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Ranks of the rows whose sorted order is given, equal for equal keys."""
    new = np.zeros(len(order), bool)
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def cover_ranks(words: np.ndarray, n: int) -> np.ndarray:
    """Ranks of the cover-sample suffixes of a text, -1 elsewhere; by prefix doubling until all differ, so that comparisons agree."""
    at = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    keys = [words[at + 8 * k] for k in (3, 2, 1, 0)]
    rank = np.full(2 * n + 2 * PERIOD, -1, np.int64)
    rank[at] = _dense(np.lexsort(keys), *keys)
    step = PERIOD
    while step < n and len(at) and rank[at].max() + 1 < len(at):
        pair = (rank[at + step], rank[at])
        rank[at] = _dense(np.lexsort(pair), *pair)
        step *= 2
    return rank


def _merge_ties(order: np.ndarray, tie: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """order with each run of equal `tie` sorted by the cover ranks: a merge sort of all runs at once.

    Two suffixes are compared at the least distance that puts both on the cover; what lies before is equal.
    """
    n = len(order)
    begin = np.concatenate([[0], np.flatnonzero(tie[1:] != tie[:-1]) + 1])
    size = np.diff(np.append(begin, n))
    run = np.repeat(np.arange(len(begin)), size)
    inside = np.flatnonzero(np.repeat(size > 1, size))
    if not len(inside):
        return order
    start, stop = begin[run[inside]], (begin + size)[run[inside]]
    residue = order % PERIOD
    width, most = 1, int(size.max())
    while width < most:
        local = inside - start
        left = start + local // (2 * width) * (2 * width)
        middle, right = np.minimum(left + width, stop), np.minimum(left + 2 * width, stop)
        of_left = inside < middle
        low, high = np.where(of_left, middle, left), np.where(of_left, right, middle)
        base = low.copy()
        mine, my_residue = order[inside], residue[inside]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) // 2
            other = order[mid]
            d = _delta[my_residue[open_], residue[mid]]
            a, b = rank[mine[open_] + d], rank[other + d]
            before = np.where(of_left[open_], b < a, b <= a)  # of equals the left half's come first
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
        target = np.where(of_left, inside + (low - base), inside - (middle - left) + (low - base))
        order[target], residue[target] = mine, my_residue.copy()
        width *= 2
    return order


def repeated_starts(contexts: list[bytes], buckets: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its starts have a string of `length` bytes that another start of its bucket has too."""
    lengths = np.array([len(c) for c in contexts])
    text = np.frombuffer(b"".join(contexts), np.uint8)
    words, n = _words(text), len(text)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    count = lengths - length + 1
    starts = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    keys = [words[starts + 8 * k] for k in (3, 2, 1, 0)] + [np.repeat(buckets, count)]
    place = np.lexsort(keys)
    tie = _dense(place, *keys)[place]
    order = _merge_ties(starts[place], tie, cover_ranks(words, n))
    same = np.flatnonzero(tie[1:] == tie[:-1])
    for at in (*range(32, length - 8, 8), length - 8):  # 32 bytes are known to be equal
        same = same[words[order[same] + at] == words[order[same + 1] + at]]
    found = np.zeros(n, bool)
    found[order[same]] = found[order[same + 1]] = True
    return [found[b : b + c] for b, c in zip(begin.tolist(), count.tolist(), strict=True)]


def _context_rows(length: int):
    """A row for each wanted context of a text, with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, anchor, first, count, found = [], [], [], [], []
            for i, (text, wanted) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                data = memoryview(text.as_buffer())
                for w in wanted.as_py():
                    rows.append(i)
                    anchor.append(w["anchor"]), first.append(w["first"]), count.append(w["members"])
                    found.append(bytes(data[w["first"] : w["last"] + length]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), batch.column(1).take(pa.array(rows, pa.int64())), pa.array(anchor, pa.int64()), pa.array(first, pa.int32()), pa.array(count, pa.int64()), pa.array(found, pa.binary())],
                ["doc_id", "version", "anchor", "first", "members", "bytes"],
            )

    return run


def _sorted_spans(length: int):
    """Spans of single contexts that another context of their bucket repeats; rows come ordered by anchor."""

    def block(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        anchor = rows.column("anchor").to_numpy()
        buckets = np.cumsum(np.concatenate([[0], anchor[1:] != anchor[:-1]]))
        found = repeated_starts(rows.column("bytes").to_pylist(), buckets, length)
        first, members = rows.column("first").to_pylist(), rows.column("members").to_pylist()
        at, starts, ends = [], [], []
        for i, own in enumerate(found):
            if members[i] > 1 or not own.any():  # a context of many members is repeated as a whole
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
            at.extend([i] * (len(edge) // 2))
            starts.extend((edge[::2] + first[i]).tolist())
            ends.extend((edge[1::2] + first[i] + length - 1).tolist())
        took = rows.select(["doc_id", "version"]).take(pa.array(at, pa.int64())).combine_chunks()
        for part in pa.table({"doc_id": took.column(0), "version": took.column(1), "start": pa.array(starts, pa.int32()), "end": pa.array(ends, pa.int32())}).to_batches():
            yield part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, enough = 0, BLOCK
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < enough:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            anchor = rows.column("anchor").to_numpy()
            upto = np.cumsum(pc.binary_length(rows.column("bytes")).to_numpy())
            ends = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1  # where buckets end; the last may go on
            at = 0
            while len(ends) and ends[-1] > at:
                before = upto[at - 1] if at else 0
                fits = ends[(ends > at) & (upto[ends - 1] - before <= BLOCK)]
                to = int(fits[-1]) if len(fits) else int(ends[ends > at][0])
                yield from block(rows.slice(at, to - at))
                at = to
            rest = rows.slice(at)
            held, size = rest.to_batches(), int(upto[-1] - (upto[at - 1] if at else 0))
            enough = max(BLOCK, 2 * size)  # a bucket that goes on is not put together for each batch
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            if rows.num_rows:
                yield from block(rows)

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs of spans, in order."""
    runs: list[list[int]] = []
    for start, end in sorted(spans):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    return [(a, z) for a, z in runs]


def passages(data: bytes, spans: list[tuple[int, int]], words: int = WORDS) -> list[tuple[int, int]]:
    """The maximal runs of more than so many words."""
    return [(a, z) for a, z in merged(spans) if len(data[a:z].split()) > words]


def cut(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The data without the runs, which are disjoint and in order."""
    parts, at = [], 0
    for start, end in runs:
        parts.append(data[at:start])
        at = end
    return b"".join([*parts, data[at:]])


def _bytes(cell: pa.Scalar) -> bytes:
    return cell.as_buffer().to_pybytes() if cell.is_valid else b""


def _spans(cell: pa.Scalar) -> list[tuple[int, int]]:
    return [(x["start"], x["end"]) for x in cell.as_py()] if cell.is_valid else []


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, long, short in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
            data = _bytes(text)
            runs = merged(_spans(long))
            kept = cut(data, runs)
            rows.append((len(data), len(data) - len(kept), len(runs), kept, sum(z - a for a, z in passages(data, _spans(short)))))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
        columns = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_passage_bytes"])


def without_repeats(documents: DataFrame, length: int = PASSAGE, words: int = WORDS) -> DataFrame:
    """The rows of documents with all their columns, and texts without passages that are repeated anywhere, in any document.

    A passage is a maximal run of bytes that repeated strings of `length` bytes cover, of more than `words` words; every place of it
    is cut. Where a cut splits a character, what is left of it goes too. A column n_chars follows the new text. Null texts stay
    null and empty ones empty; repeated rows are each other's copies and lose the same passages; null ids are documents like others;
    no rows give no rows. Texts are read whole.
    """
    id_, version, own_spans = unused(documents, "_id", "_version", "_spans")
    spans = stored(repeated_spans(documents, length), "spans").select(F.col("doc_id").alias(id_), F.col("version").alias(version), F.col("spans").alias(own_spans))
    same = (F.xxhash64("doc_id", "text") == F.col(version)) & F.col("doc_id").eqNullSafe(F.col(id_))
    met = documents.join(spans, same, "left").drop(id_, version)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            new: list[str | None] = []
            for text, own in zip(texts.cast(pa.binary()), batch.column(batch.num_columns - 1), strict=True):
                data = _bytes(text)
                runs = passages(data, _spans(own), words)
                new.append(None if not text.is_valid else cut(data, runs).decode("utf-8", "ignore") if runs else data.decode())
            columns = [pa.array(new, pa.string()) if k == at else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    out = met.mapInArrow(run, documents.schema)
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        out = out.select(*[F.char_length("text").cast(kind).alias(c) if c == "n_chars" else c for c in documents.columns])
    return out


def _contexts_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, version, bytes, wanted): the texts of the classes' first members with what is wanted of them.

    Every copy of a document meets its own contexts: rows of equal id and text give equal spans.
    """
    wanted = classes.select("one.doc_id", "one.version", F.struct("anchor", "members", "one.first", "one.last", "one.place").alias("w"))
    wanted = wanted.groupBy("doc_id", "version").agg(F.collect_list("w").alias("wanted"))
    met = docs.alias("d").join(wanted.alias("w"), (F.col("d.version") == F.col("w.version")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")))
    return met.select("d.doc_id", "d.version", "bytes", "wanted")


def repeated_spans(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, version and the spans (array of start, end) of bytes that a repeated string of `length` (96 at least) bytes covers, for documents that have any."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    docs = _keyed(documents)
    first = stored(docs.mapInArrow(_anchor_rows(length), f"doc_id {kind}, {ROW}"), "anchors")
    # written first: a join can split a hot anchor's rows only if no aggregate stands between it and the shuffle
    again = stored(first.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "again")
    rows = stored(first.join(again, "anchor", "left_semi"), "anchors")
    released(first)
    one = F.struct("doc_id", "version", "first", "last", "place")
    found = None
    for width in (-(-(length - GRAM + 1) // PARTS), 1, 0):
        classes = stored(rows.groupBy("anchor", "context").agg(F.count("*").alias("members"), F.min(one).alias("one")), "classes")
        whole = classes.where("members > 1").select("anchor", "context")
        whole = rows.join(whole, ["anchor", "context"], "left_semi").select("doc_id", "version", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
        found = whole if found is None else found.union(whole)
        if not width:  # starts of one distance are equal or not
            break
        # buckets of several contexts of which one at least has a single member
        mixed = classes.groupBy("anchor").agg(F.count("*").alias("contexts"), F.min("members").alias("fewest")).where("contexts > 1 and fewest = 1")
        mixed = stored(mixed.select("anchor", (F.col("contexts") > CROWD).alias("crowded")), "mixed")
        few = classes.join(mixed.where("not crowded"), "anchor", "left_semi")
        contexts = _contexts_of(docs, few).mapInArrow(_context_rows(length), f"doc_id {kind}, version long, anchor long, first int, members long, bytes binary")
        contexts = contexts.repartition("anchor").sortWithinPartitions("anchor")
        found = found.union(contexts.mapInArrow(_sorted_spans(length), f"doc_id {kind}, version long, start int, end int"))
        crowded = mixed.where("crowded").select("anchor")
        if crowded.isEmpty():
            break
        rows = stored(_contexts_of(docs, classes.join(crowded, "anchor", "left_semi")).mapInArrow(_split_rows(length, width), f"doc_id {kind}, {ROW}"), "split")
    return found.groupBy("doc_id", "version").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.xxhash64("doc_id", "text").alias("version"), F.col("text").cast("binary").alias("bytes"))


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of a text that may hold a string of LENGTH bytes, as texts of their own."""
    for batch in batches:
        row, start, found = [], [], []
        for i, (text, spans) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            data = memoryview(text.as_buffer())
            for a, z in merged(_spans(spans)):
                if z - a >= LENGTH:
                    row.append(i), start.append(a), found.append(bytes(data[a:z]))
        at = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(start, pa.int32()), pa.array(found, pa.binary())], ["doc_id", "version", "run", "text"])


def remove_repeats(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text) without the bytes that any string of 400 bytes covers which also starts elsewhere.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary: the remaining bytes), and n_passage_bytes: the
    bytes in repeated passages of more than 50 words, removed or not (see without_repeats). Elsewhere is any
    other start in any document, the same included; strings don't cross documents and are judged on the input. Repeated rows
    are each other's copies. Null and empty texts have no bytes. Null ids are documents like others; no rows give no rows; other columns
    are ignored. Texts are read whole, as UTF-8.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    same = lambda a, b: (F.col(f"{a}.version") == F.col(f"{b}.version")) & F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))
    short = stored(repeated_spans(documents, PASSAGE), "spans")
    keyed = _keyed(documents)
    met = keyed.alias("d").join(short.alias("s"), same("d", "s")).select("d.doc_id", "d.version", "bytes", "spans")
    runs = stored(met.mapInArrow(_run_rows, f"doc_id {kind}, version long, run int, text binary"), "runs")
    # all places of a repeated string of 400 bytes lie in runs of repeated strings of 200
    long = repeated_spans(runs.select(F.struct("doc_id", "version", "run").alias("doc_id"), "text"), LENGTH)
    long = long.select("doc_id.*", "spans")
    shifted = F.transform("spans", lambda x: F.struct((x["start"] + F.col("run")).alias("start"), (x["end"] + F.col("run")).alias("end")))
    long = long.select("doc_id", "version", shifted.alias("spans")).groupBy("doc_id", "version").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    spans = short.alias("s").join(long.alias("l"), same("s", "l"), "left").select("s.doc_id", "s.version", F.col("l.spans").alias("long"), F.col("s.spans").alias("short"))
    spans = stored(spans, "spans")
    met = keyed.alias("d").join(spans.alias("s"), same("d", "s"), "left")
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, n_passage_bytes long"
    return met.select("d.doc_id", "bytes", "long", "short").mapInArrow(_removed, schema)
