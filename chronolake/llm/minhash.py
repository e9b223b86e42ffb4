"""Near-duplicate detection by circulant MinHash.

Each text is its set of 5-word shingles. One permutation spreads the shingles over a ring of 2^32 places; the second,
shifted by one more place for each coordinate, gives all signature coordinates. Bands of coordinates put texts into buckets;
pairs that a bucket brings together are confirmed by exact Jaccard similarity of the full sets.

Copies with equal sets are one class before anything is compared. Each class is held against the likeliest of the hubs (least
members) of its buckets first. Only members of one hub that are still in different components are then compared with one another,
in cells of two blocks: signatures first, full sets where they allow a link. Cells give back links of a forest, never all pairs,
and each set is sent to few cells, so what is shuffled grows with the members of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, unused

SHINGLE = 5
COORDINATES = 192
#: Greatest chance that a pair at the threshold meets in no band.
MISSED = 1e-6
#: Pairs whose signatures agree by so many standard deviations less than the threshold are not confirmed.
SLACK = 5.8
BLOCK = 2048
#: Words whose hashes a worker keeps, of so many bytes at most.
KEEP_WORDS, KEEP_BYTES = 200_000, 64


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= KEEP_BYTES:
            if len(self) > KEEP_WORDS:
                self.clear()
            self[word] = value
        return value


_hashes = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; with fewer words, of the whole sequence; none without words."""
    words = text.lower().split()  # of bytes: only A-Z change case, only ASCII white space cuts
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    size = min(size, n)
    found = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        found = found * np.uint64(0x9E3779B97F4A7C15) + own[k : n - size + 1 + k]
    return np.unique(_mix(found))


def signature(own: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Coordinate k is the least place that the second permutation gives to any shingle, shifted by k on the ring."""
    places = (own >> np.uint64(32)).astype(np.uint32)  # the hash is the first permutation
    shifts = np.arange(coordinates, dtype=np.uint32)
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(places), 1024):
        x = places[at : at + 1024, None] + shifts
        x *= np.uint32(0x9E3779B1)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA77)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE3D)
        np.minimum(least, x.min(axis=0), out=least)
    return least


def band_shape(threshold: int) -> tuple[int, int]:
    """(bands, rows) of the most rows for which pairs at the threshold (in percent) are missed rarely: 32 x 6 at 85, 38 x 5 at 80."""
    rows = max((r for r in range(2, COORDINATES + 1) if (1 - (threshold / 100) ** r) ** (COORDINATES // r) <= MISSED), default=1)
    return COORDINATES // rows, rows


def least_alike(threshold: int) -> float:
    """The share of equal coordinates from which a pair is confirmed."""
    t = threshold / 100
    return t - SLACK * (t * (1 - t) / COORDINATES) ** 0.5


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.arange(bands, dtype=np.uint64)
    for column in least[: bands * rows].reshape(bands, rows).T.astype(np.uint64):
        keys = _mix(keys * np.uint64(0xD6E8FEB86659FD93) + column)
    return keys.view(np.int64)


def _features(threshold: int):
    bands, rows = band_shape(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "version", "n_shingles", "digest", "keys", "short"]
        for batch in batches:
            sizes, digests, keys, shorts = [], [], [], []
            for text in batch.column(1):
                own = shingles(text.as_py() or b"")
                sizes.append(len(own))
                if not len(own):
                    digests.append(None), keys.append(None), shorts.append(None)
                    continue
                least = signature(own)
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                keys.append(band_keys(least, bands, rows))
                shorts.append(least.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(shorts, pa.binary())], names
            )
        _hashes.clear()  # the worker's memory is free for what runs in it next

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(t.as_py() or b"").tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "own"])
    _hashes.clear()


def _confirm(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                both = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * both >= threshold * (len(a) + len(b) - both))
            linked = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(linked), batch.column(1).filter(linked)], ["a", "b"])

    return run


def _likely(cell: list[tuple], hub: int, threshold: int) -> Iterator[tuple[int, int]]:
    """Positions of pairs of a cell that may be linked and are not in one component; of a pair's hubs only the least answers for it.

    A cell holds two blocks of a hub's members (pairs across) or one (pairs inside).
    """
    blocks = np.array([r[0] for r in cell])
    ids, groups, sizes = (np.array([r[k] for r in cell], np.int64) for k in (1, 2, 3))
    shorts = np.frombuffer(b"".join(r[4] for r in cell), np.uint8).reshape(len(cell), -1)
    low = blocks.min()
    one = bool((blocks == low).all())
    right = np.arange(len(cell)) if one else np.flatnonzero(blocks != low)
    for i in range(len(cell)) if one else np.flatnonzero(blocks == low).tolist():
        to = right[right > i] if one else right
        to = to[(groups[to] != groups[i]) & (100 * np.minimum(sizes[to], sizes[i]) >= threshold * np.maximum(sizes[to], sizes[i]))]
        if len(to):
            to = to[(shorts[to] == shorts[i]).mean(axis=1) >= least_alike(threshold)]
        for j in to.tolist():
            if min(set(cell[i][5]) & set(cell[j][5]), default=hub) == hub:
                yield i, j


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(hub, i, j) and rows of each cell of rows ordered by cell; a cell has two blocks of members at most."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(k) for k in range(batch.num_columns)), strict=True):
            row = [x.as_py() for x in row]
            if tuple(row[:3]) != now:
                if held:
                    yield now, held
                now, held = tuple(row[:3]), []
            held.append(tuple(row[3:]))
    if held:
        yield now, held


def _involved(threshold: int):
    """(hub, i, j, id) of the members of cells that are in a likely pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, cell in _cells(batches):
            at = sorted({k for pair in _likely(cell, key[0], threshold) for k in pair})
            if at:
                columns = [pa.array([key[0]] * len(at), pa.int64()), *(pa.array([key[k]] * len(at), pa.int32()) for k in (1, 2)), pa.array([cell[k][1] for k in at], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["hub", "i", "j", "id"])

    return run


def _joined(threshold: int):
    """Links found by comparing the full sets of likely pairs; what a cell has already linked is not compared again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, cell in _cells(batches):
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while (up := parent.get(x, x)) != x:
                    x = up
                return x

            sets = [np.frombuffer(r[6], np.uint64) for r in cell]
            found = []
            for i, j in _likely(cell, key[0], threshold):
                a, b = root(cell[i][2]), root(cell[j][2])
                if a != b:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                        parent[max(a, b)] = min(a, b)
                        found.append((cell[i][1], cell[j][1]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable over edges(a, b), for each id that has an edge.

    Each round takes the least label among neighbours and then the label's own label; labels go to the checkpoint folder.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct().checkpoint()
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("id"), "label").checkpoint()
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("near"))
        better = labels.join(near, F.col("id") == F.col("a")).select("id", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("label").alias("jump"))
        after = better.join(jump, "next", "left").select("id", "label", F.least("next", F.coalesce("jump", "next")).alias("next")).checkpoint()
        changed = not after.where("next <> label").isEmpty()
        labels = after.select("id", F.col("next").alias("label"))
        if not changed:
            return labels.select("id", F.col("label").alias("component"))


def near_duplicates(documents: DataFrame, threshold: int = 80) -> DataFrame:
    """documents(doc_id, text) linked where 100 * intersection >= threshold * union of their shingle sets.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable over links, itself included), kept (doc_id is
    component_id). Null, empty and blank texts have no shingles and are linked with nothing. Repeated rows each give a row
    with the same result; rows of one doc_id and different texts give a row each, of the text's own component; a null doc_id takes
    no part, has no component and is kept. doc_id is a whole number (its values are cast to long; others raise an error).
    No rows give no rows; other columns are ignored. Texts are read whole.
    """
    found = _classified(documents, threshold)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _classified(documents: DataFrame, threshold: int) -> DataFrame:
    """(doc_id, version, n_shingles, component_id) of each row; version is a hash of the row's text."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).withColumn("version", F.xxhash64("text"))
    schema = "doc_id long, version long, n_shingles long, digest binary, keys array<long>, short binary"
    features = stored(documents.select("doc_id", "text", "version").mapInArrow(_features(threshold), schema), "features")
    known = features.where("n_shingles > 0 and doc_id is not null")
    # one class for each set; its id is that of its least document
    known = _numbered(known)
    least = F.min(F.struct("id", "doc_id", "version")).alias("one")
    classes = known.groupBy("digest").agg(least, F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("short").alias("short"))
    classes = stored(classes.select("digest", "one.*", "n", "keys", "short"), "classes")

    banded = classes.select("id", F.explode("keys").alias("key"))
    shared = stored(banded.groupBy("key").agg(F.count("*").alias("members"), F.min("id").alias("hub")).where("members > 1").select("key", "hub"), "shared")
    buckets = stored(banded.join(shared, "key").select("hub", "id").distinct(), "buckets")
    brief = classes.select("id", "n", "short")

    # the hub whose signature is most like the member's
    stars = buckets.where("id <> hub").join(brief, "id")
    hubs = brief.select(F.col("id").alias("hub"), F.col("n").alias("hub_n"), F.col("short").alias("hub_short"))
    stars = stars.join(hubs, "hub").where(100 * F.least("n", "hub_n") >= threshold * F.greatest("n", "hub_n"))
    stars = stars.mapInArrow(_alike, "id long, hub long, alike double").where(F.col("alike") >= least_alike(threshold))
    stars = stars.groupBy("id").agg(F.max_by("hub", F.struct("alike", -F.col("hub"))).alias("b")).select(F.col("id").alias("a"), "b")
    first = stored(_linked(documents, classes, stars, threshold), "links")
    labels = components(first)

    # members of one hub in different components; cells of two blocks of them, so that no task holds a large group
    member = buckets.join(labels, "id", "left").select("hub", "id", F.coalesce("component", "id").alias("component"))
    member = stored(member, "members")
    mixed = member.groupBy("hub").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low <> high")
    mixed = stored(mixed.select("hub", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "mixed")
    inside = stored(member.join(mixed, "hub"), "inside")
    hubs = inside.groupBy("id").agg(F.collect_set("hub").alias("hubs"))  # a hub for each band at most
    cells = (
        inside.withColumn("block", F.pmod(F.hash("id"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component")
        .join(brief, "id")
        .join(hubs, "id")
        .select("hub", "i", "j", "block", "id", "component", "n", "short", "hubs")
    )
    cells = stored(cells, "cells")
    ordered = lambda rows: rows.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    likely = stored(ordered(cells).mapInArrow(_involved(threshold), "hub long, i int, j int, id long"), "likely")
    sets = _sets_of(documents, classes, likely.select("id").distinct())
    ready = cells.join(likely, ["hub", "i", "j", "id"]).join(sets, "id").select("hub", "i", "j", "block", "id", "component", "n", "short", "hubs", "own")
    second = stored(ordered(ready).mapInArrow(_joined(threshold), "a long, b long"), "links")
    labels = components(first.union(second))

    # of the rows of a component the least document stands for it
    named = known.select("doc_id", "version", "digest").join(classes.select("digest", "id"), "digest").join(labels, "id", "left")
    named = named.select("doc_id", "version", F.coalesce("component", "id").alias("component")).distinct()
    named = stored(named, "named")
    # written, so that the join can split the rows of a large component
    heads = stored(named.groupBy("component").agg(F.min(F.struct("doc_id", "version")).alias("head")), "heads")
    named = named.join(heads, "component").select("doc_id", "version", "head")
    return features.select("doc_id", "version", "n_shingles").join(named, ["doc_id", "version"], "left").select(
        "doc_id", "version", "n_shingles", F.coalesce("head.doc_id", "doc_id").alias("component_id"),
        F.coalesce((F.col("head.doc_id") == F.col("doc_id")) & (F.col("head.version") == F.col("version")), F.lit(True)).alias("heads"),
    )


def _numbered(known: DataFrame) -> DataFrame:
    """known with an id for each document: doc_id, or numbers below all of them where one doc_id has several texts."""
    several = known.groupBy("doc_id").agg(F.min("version").alias("a"), F.max("version").alias("z")).where("a <> z").select("doc_id")
    several = stored(several, "several")
    if several.isEmpty():
        return known.withColumn("id", F.col("doc_id"))
    below = known.agg(F.min("doc_id")).first()[0]
    texts = known.join(several, "doc_id", "left_semi").select("doc_id", "version").distinct()
    texts = stored(texts.withColumn("number", F.lit(below - 1) - F.monotonically_increasing_id()), "texts")
    return stored(known.join(texts, ["doc_id", "version"], "left").withColumn("id", F.coalesce("number", "doc_id")).drop("number"), "known")


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = {name: k for k, name in enumerate(batch.schema.names)}
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(at[c]).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("short", "hub_short"))
        yield pa.RecordBatch.from_arrays([batch.column(at["id"]), batch.column(at["hub"]), pa.array((a == b).mean(axis=1))], ["id", "hub", "alike"])


def _sets_of(documents: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, own): the shingle sets of the classes with these ids, from the text of each one's own document."""
    wanted = stored(classes.join(ids, "id", "left_semi").select("id", "doc_id", "version"), "wanted")
    # their number grows with the documents, so they are not sent to every executor at any size
    texts = documents.join(wanted.hint("merge"), ["doc_id", "version"]).dropDuplicates(["id"])
    return stored(texts.select("id", "text").mapInArrow(_sets, "id long, own binary"), "sets")


def _linked(documents: DataFrame, classes: DataFrame, pairs: DataFrame, threshold: int) -> DataFrame:
    """The pairs(a, b) of class ids whose full sets are similar enough."""
    pairs = stored(pairs, "pairs")
    sets = _sets_of(documents, classes, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    left, right = sets.select(F.col("id").alias("a"), F.col("own").alias("a_own")), sets.select(F.col("id").alias("b"), F.col("own").alias("b_own"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "a_own", "b_own").mapInArrow(_confirm(threshold), "a long, b long")


def keep_one(documents: DataFrame, threshold: int = 80) -> DataFrame:
    """One row of documents, with all its columns, for each group of near duplicates: that of the least doc_id, and of its texts one.

    Texts of one doc_id that are no near duplicates all stay; rows that stand twice count as one; rows without doc_id stay, and so do
    texts without words. No rows give no rows.
    """
    head, version, own = unused(documents, "_head", "_version", "_text")
    heads = _classified(documents, threshold).where("heads and doc_id is not null").select(F.col("doc_id").alias(head), F.col("version").alias(version)).distinct()
    rows = documents.where("doc_id is not null").withColumn(own, F.xxhash64(F.col("text").cast("binary")))
    kept = rows.join(heads, (F.col("doc_id") == F.col(head)) & (F.col(own) == F.col(version)), "left_semi")
    return kept.dropDuplicates(["doc_id", own]).drop(own).unionByName(documents.where("doc_id is null"))
