"""Near-duplicate detection by SimHash, compared bit plane by bit plane.

A fingerprint's bit is the majority of that bit over the XXH64 hashes of a text's word shingles. Equal fingerprints are one class. Classes
within the radius agree in several of the blocks into which the bits are cut, so each choice of that many blocks is a table of
buckets, and every link is found in at least one bucket.

In a bucket the fingerprints are stored vertically: a word of a plane holds one bit of 64 members. A member is compared with 64 others at
once by going through the planes; carry-save counters of a few bits for each lane count the differences, and a carry out of the last
counter says that the lane has passed the radius. When all lanes of a block have, the block is given up. Buckets give back links of a
forest, never all pairs; buckets of many members are compared in cells of two chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .minhash import components

SHINGLE, SEED, BITS, RADIUS = 3, 42, 64, 3
#: Members of a bucket that are compared in one piece; more make cells of two chunks.
CHUNK = 8192
#: Pairs of a member and a block of 64 that are taken through the planes together, and planes between two looks at what is left.
PAIRS, LOOK = 1 << 15, 8
#: Members of small buckets that are gathered before they are compared.
GATHER = 1 << 14
#: Hashes whose bits are counted together.
HASHES = 1 << 13


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Bit k is 1 if it is set in over half of the shingles' hashes; with fewer words the whole sequence is hashed; without words 0."""
    words = text.lower().split()  # of bytes: only A-Z change case, only ASCII white space cuts
    n = len(words)
    if not n:
        return 0
    size = min(size, n)
    plain = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[: n - size] + 1]).tolist()
    ends, total, counts = ends[size - 1 :].tolist(), n - size + 1, np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, HASHES):
        own = np.fromiter((digest(plain[a:z], SEED) for a, z in zip(starts[at : at + HASHES], ends[at : at + HASHES], strict=True)), np.uint64, min(HASHES, total - at))
        counts += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = np.fromiter((fingerprint(t.as_py() or b"") for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.view(np.int64))], ["doc_id", "print"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and print (the fingerprint's bits as a long) of each row."""
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(_fingerprints, "doc_id long, print long")


def planes_of(prints: np.ndarray) -> np.ndarray:
    """[plane, word]: bit j of a word is that plane's bit of the member 64 * word + j. Lanes without a member are 0."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    short = -len(prints) % 64
    packed = np.packbits(np.pad(bits, ((0, 0), (0, short))), axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64).reshape(BITS, -1)


def near(prints: np.ndarray, planes: np.ndarray, members: np.ndarray, blocks: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in members and blocks, lane) of what is within the radius, members[i] compared with the 64 lanes of blocks[i]; in batches.

    The counters start at what makes them overflow at the first difference beyond the radius.
    """
    counters = max(1, int(radius).bit_length())
    start = (1 << counters) - 1 - radius
    for at in range(0, len(members), PAIRS):
        own, block = prints[members[at : at + PAIRS]], blocks[at : at + PAIRS]
        place = np.arange(at, at + len(own))
        count = [np.full(len(own), ~np.uint64(0) if start >> k & 1 else np.uint64(0)) for k in range(counters)]
        far = np.zeros(len(own), np.uint64)
        for bit in range(BITS):
            carry = planes[bit][block] ^ (np.uint64(0) - (own >> np.uint64(bit) & np.uint64(1)))
            for k in range(counters):
                carry, count[k] = carry & count[k], carry ^ count[k]
            far |= carry
            if bit % LOOK == LOOK - 1:
                left = np.flatnonzero(far != ~np.uint64(0))
                if len(left) < len(far):
                    own, block, place, far, count = own[left], block[left], place[left], far[left], [c[left] for c in count]
                if not len(left):
                    break
        if len(place):
            lanes = np.unpackbits((~far).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(lanes)
            yield place[row], lane


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of the pairs a, b; label points every member to the least of its component."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def links(groups: list[np.ndarray], sides: list[np.ndarray | None], radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links of a forest over each group's members within the radius of each other; sides, where given, says which of two chunks a member is
    in, and only members of different chunks are compared.

    Blocks never hold members of two groups, so many small groups go through the planes together.
    """
    prints, lanes_of, members, blocks, planes, at, block = [], [], [], [], [], 0, 0
    for own, side in zip(groups, sides, strict=True):
        here = np.arange(at, at + len(own))
        for left, right in [(here, here)] if side is None else [(here[side], here[~side])]:
            if len(left) and len(right):
                n = -(-len(right) // 64)
                planes.append(planes_of(own[right - at]))
                lanes_of.append(np.pad(right, (0, 64 * n - len(right)), constant_values=-1))
                members.append(np.repeat(left, n)), blocks.append(np.tile(np.arange(block, block + n), len(left)))
                block += n
        prints.append(own)
        at += len(own)
    label = np.arange(at)
    if not members:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    prints, lanes_of, members = np.concatenate(prints), np.concatenate(lanes_of), np.concatenate(members)
    blocks = np.concatenate(blocks)
    for place, lane in near(prints, np.concatenate(planes, axis=1), members, blocks, radius):
        other = lanes_of[64 * blocks[place] + lane]
        real = other >= 0
        _merge(label, members[place[real]], other[real])
    joined = np.flatnonzero(label != np.arange(at))
    return prints[label[joined]], prints[joined]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Prints and chunks of each cell of rows (part, value, i, j, chunk, print) ordered by cell."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)])
        chunk, own = (batch.column(k).to_numpy(zero_copy_only=False) for k in (4, 5))
        edges = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(keys[:, a])
            if key != now and held:
                yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                held = []
            now = key
            held.append((own[a:z], chunk[a:z]))
    if held:
        yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> pa.RecordBatch:
            a, b = links(groups, sides, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        groups, sides, size = [], [], 0
        for own, chunk in _cells(batches):
            if len(own) > 1:
                two = chunk.min() != chunk.max()
                groups.append(own.view(np.uint64)), sides.append(chunk == chunk.min() if two else None)
                size += len(own)
            if size >= GATHER:
                yield found()
                groups, sides, size = [], [], 0
        yield found()

    return run


def tables(radius: int, blocks: int) -> list[list[tuple[int, int]]]:
    """The tables: for each choice of blocks - radius blocks, their (first bit, bits). Prints within the radius agree in one choice at least."""
    cuts = [round(k * BITS / blocks) for k in range(blocks + 1)]
    return [[(cuts[k], cuts[k + 1] - cuts[k]) for k in some] for some in combinations(range(blocks), blocks - radius)]


def _value(own: Column, cut: list[tuple[int, int]]) -> Column:
    """The bits of the blocks, one behind the other."""
    value = F.lit(0).cast("long")
    if cut == [(0, BITS)]:
        return own
    for first, bits in cut:
        value = F.shiftleft(value, bits).bitwiseOR(F.shiftrightunsigned(own, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
    return value


def blocks_for(classes: int, radius: int = RADIUS) -> int:
    """How many blocks make the least work: each table costs a copy of the classes, and members of chance neighbours in a bucket cost 1/64 each."""
    def work(blocks: int) -> float:
        some = tables(radius, blocks)
        return sum(1 + classes / 2 ** sum(bits for _, bits in cut) / BITS for cut in some)

    return min(range(radius + 1, radius + 5), key=work)


def linked(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """Links(a, b) between distinct prints whose components are those of all pairs within the radius."""
    if not 0 <= radius < 32:
        raise ValueError("the radius must be from 0 to 31")
    if blocks is None:
        blocks = blocks_for(prints.count(), radius)
    cuts = tables(radius, blocks)
    own = F.col("print")
    keys = F.array(*[F.struct(F.lit(k).alias("part"), _value(own, cut).alias("value")) for k, cut in enumerate(cuts)])
    members = prints.select("print", F.explode(keys).alias("key")).select("key.*", "print")
    # buckets of one member need no comparison; large ones are compared in cells
    sizes = members.groupBy("part", "value").agg(F.count("*").alias("n")).where("n > 1")
    sizes = stored(sizes.select("part", "value", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "buckets")
    members = members.join(sizes, ["part", "value"]).withColumn("chunk", F.pmod(F.hash("print"), F.col("chunks")))
    # a cell of chunks i and j compares across them, and a cell of i and i within
    cells = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = cells.select("part", "value", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "print")
    cells = cells.repartition("part", "value", "i", "j").sortWithinPartitions("part", "value", "i", "j")
    return cells.mapInArrow(_compare(radius), "a long, b long")


def near_duplicates(documents: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """documents(doc_id, text) linked where their fingerprints differ in at most `radius` bits.

    Returns for each row doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id reachable over links, itself
    included. Null, empty and blank texts have the fingerprint zero and are linked like any other. A row without doc_id links like another but
    names no component; if a component has no doc_id at all, its component_id is null. Rows that stand twice give a row each; rows of one doc_id
    with different texts too, each in its own text's component. doc_id is cast to long. Other columns are ignored. No rows give no rows.
    """
    own = stored(fingerprints(documents), "prints")
    classes = stored(own.groupBy("print").agg(F.min("doc_id").alias("least")), "classes")
    labels = components(stored(linked(classes.select("print"), radius, blocks), "links"))
    named = classes.join(labels, F.col("print") == F.col("id"), "left").select("print", "least", F.coalesce("component", "print").alias("component"))
    named = stored(named, "named")
    least = stored(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    # written, so that the joins can split the rows of a large class or component
    by_print = stored(named.join(least, "component").select("print", "component_id"), "by_print")
    return own.join(by_print, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
