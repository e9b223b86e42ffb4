"""Benchmark decontamination by winnowing.

Of every `window` consecutive words the `window - k + 1` k-gram hashes are taken and their minimum is kept as a
fingerprint, so two texts that share `window` words share a fingerprint there. Document and benchmark fingerprints meet in
one equi-join; each hit is then extended word by word to both sides, which confirms it and gives the words that are hit.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, repeat_rows, unused

WINDOW, K = 13, 4
#: Benchmark fingerprints up to this number are broadcast (about 0.6 KB each with their words); beyond, the join shuffles.
BROADCAST_FINGERPRINTS = 60_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased; none for null."""
    return F.array_remove(F.split(F.coalesce(lower_ascii(text), F.lit("")), NOT_WORD), "")


def _grams(words: Column, size: int) -> Column:
    """Hashes of all `size`-grams in order; none if there are fewer words."""
    n = F.size(words)
    hashes = F.transform(words, lambda w, i: F.xxhash64(F.lit(size), w, *[F.get(words, i + j) for j in range(1, size)]))
    return F.when(n >= size, F.slice(hashes, 1, n - size + 1)).otherwise(F.array().cast("array<long>"))


def _fingerprints(docs: DataFrame, window: int, k: int) -> DataFrame:
    """docs with a row for each new minimum of `window - k + 1` consecutive k-gram hashes, and one of null fp for the document.

    p_from and p_to bound the places at which the row answers for the minimum.

    Minima are taken while hashes are exploded, inside generated code. A window's minimum is new where its last hash is the
    minimum or the hash that has just left it was as small; else the window before has given it. (The outer form of the
    generator, on arrays that are never empty, keeps the optimiser from testing their size on inlined lambdas.)
    """
    span = window - k + 1
    at = lambda i: F.get("hashes", F.col("i") + i)
    low = F.least(*[at(i) for i in range(span)])
    first, last = F.col("i") == 1, at(span - 1)
    new = last.isNotNull() & (first | (last == F.col("low")) | (at(-1) <= F.col("low")))
    # where the window before had the same minimum, it has given all its places but the last
    old = ~first & (last == F.col("low")) & (at(-1) >= F.col("low"))
    hashes = F.concat(F.array(F.lit(0).cast("long")), _grams(F.col("words"), k))
    return (
        docs.withColumn("hashes", hashes)
        .select("*", F.posexplode_outer("hashes").alias("i", "_"))
        .withColumn("low", low)
        .where((F.col("i") == 0) | new)
        .select(*docs.columns, F.when(F.col("i") > 0, F.col("low")).alias("fp"), F.when(old, F.col("i") + span - 2).otherwise(F.col("i") - 1).alias("p_from"), (F.col("i") + span - 2).alias("p_to"))
    )


def _minima(hashes: Column, span: int) -> Column:
    """Distinct minima of all `span` consecutive hashes."""
    n = F.size(hashes)
    lows = F.transform(F.sequence(F.lit(1), n - span + 1), lambda i: F.array_min(F.slice(hashes, i, span)))
    return F.when(n >= span, F.array_distinct(lows)).otherwise(F.array().cast("array<long>"))


def _run(a: Column, b: Column) -> Column:
    """Number of equal words at the start of both arrays."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise((first - 1).cast("int"))


def _benchmark_side(benchmark: DataFrame, window: int, k: int) -> DataFrame:
    """fp, before (words before the k-gram, nearest first), after (words from the k-gram on), need, size, item_ids.

    Equal words around equal k-grams are one row, with all their items. An item of fewer words than a window is one k-gram.
    """
    reach = window - k
    items = (
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
        .where(F.size("words") > 0)
        .groupBy("words")
        .agg(F.collect_set("item_id").alias("item_ids"))
    )
    long = (
        items.where(F.size("words") >= window)
        .withColumn("hashes", _grams(F.col("words"), k))
        .withColumn("kept", _minima(F.col("hashes"), reach + 1))
        .select("words", "item_ids", "kept", F.posexplode("hashes").alias("q", "fp"))
        .where(F.array_contains("kept", F.col("fp")))
        .select(
            "fp",
            F.reverse(F.slice("words", F.greatest(F.col("q") - reach + 1, F.lit(1)), F.least(F.col("q"), F.lit(reach)))).alias("before"),
            F.slice("words", F.col("q") + 1, window).alias("after"),
            F.lit(window).alias("need"),
            F.lit(k).alias("size"),
            "item_ids",
        )
    )
    short = items.where(F.size("words") < window)
    sizes = sorted(r.n for r in short.select(F.size("words").alias("n")).distinct().collect())  # fewer than a window: at most 12
    for m in sizes:
        rows = short.where(F.size("words") == m).select(
            _grams(F.col("words"), m)[0].alias("fp"), F.array().cast("array<string>").alias("before"), F.col("words").alias("after"), F.lit(m).alias("need"), F.lit(m).alias("size"), "item_ids"
        )
        long = long.unionByName(rows)
    merged = long.groupBy("fp", "before", "after", "need", "size").agg(F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"))
    return merged, sizes


def _extended(met: DataFrame, size: int, need: int) -> DataFrame:
    """n_words for a document's own row; for a hit the runs of at least `need` equal words around its places."""
    n = F.size("words")
    places = F.filter(
        F.sequence("p_from", "p_to"), lambda p: F.xxhash64(F.lit(size), *[F.get(F.col("words"), p + j) for j in range(size)]) == F.col("fp")
    )
    back = lambda p: F.reverse(F.slice(F.col("words"), F.greatest(p - F.size("before") + 1, F.lit(1)), F.least(p, F.size("before"))))
    runs = F.transform(
        places,
        lambda p: F.struct(
            (p - _run(back(p), F.col("before"))).alias("start"), (p + _run(F.slice(F.col("words"), p + 1, F.size("after")), F.col("after"))).alias("end")
        ),
    )
    spans = F.filter(runs, lambda s: s["end"] - s["start"] >= need)
    return met.select("doc_id", "version", F.when(F.col("fp").isNull(), n).alias("n_words"), F.when(F.col("fp").isNotNull(), spans).alias("spans"), "item_ids")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, share: int = 20) -> DataFrame:
    """documents(doc_id, text) held against benchmark(item_id, text).

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words). Null and
    empty texts have no words and are not hit; items without words never occur; null item ids are not counted. Repeated
    rows each give a row; without documents there are no rows, without items nothing is hit. Other columns are ignored.
    """
    return repeat_rows(_judged(documents, benchmark, window, k, share), "copies").drop("version")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, share: int = 20) -> DataFrame:
    """The rows of documents that are not contaminated, with all their columns, whatever their names.

    Null and empty texts have no words and stay; rows that stand twice are judged alike, and so are texts of one doc_id, each by itself; a null
    doc_id is one like others. Without items, or with items without words, all rows stay; no rows give no rows. Texts are read whole.
    """
    id_, version = unused(documents, "_id", "_version")
    bad = _judged(documents, benchmark, window, k, share).where("contaminated").select(F.col("doc_id").alias(id_), F.col("version").alias(version))
    return documents.join(bad, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(version)), "left_anti")


def _judged(documents: DataFrame, benchmark: DataFrame, window: int, k: int, share: int) -> DataFrame:
    """A row for each doc_id and text, with the number of its copies."""
    items, sizes = _benchmark_side(benchmark, window, k)
    small = items.limit(BROADCAST_FINGERPRINTS + 1).count() <= BROADCAST_FINGERPRINTS
    reach = window - k
    docs = documents.select("doc_id", F.col("text").alias("_text")).select(
        "doc_id", F.xxhash64("_text").alias("version"), words_of(F.col("_text")).alias("words")
    )
    own = ["doc_id", "version", "words"]
    # by need: the length of a shared run that counts; short items need all their words
    lanes = {window: (_fingerprints(docs, window, k), k)}
    for m in sizes:
        grams = docs.withColumn("hashes", _grams(F.col("words"), m)).select(*own, F.posexplode_outer("hashes").alias("p_from", "fp"))
        lanes[m] = (grams.withColumn("p_to", F.col("p_from")), m)
    found = []
    for need, (rows, size) in lanes.items():
        wanted = items.where(F.col("need") == need)
        if small:
            # the join follows the generator inside generated code, so words are copied for hits alone
            met = rows.join(F.broadcast(wanted), "fp", "left" if need == window else "inner")
        else:
            # fingerprints alone go through the shuffle; only documents with a hit are joined with their words again
            hits = rows.select("doc_id", "version", "fp", "p_from", "p_to").where("fp is not null").distinct().join(wanted, "fp").alias("h")
            once = docs.dropDuplicates(["doc_id", "version"]).alias("d")
            met = once.join(hits, F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.version") == F.col("h.version")))
            met = met.select("d.doc_id", "d.version", "d.words", "h.fp", "p_from", "p_to", "before", "after", "item_ids", "need")
            if need == window:
                met = docs.select(*own).unionByName(met, allowMissingColumns=True)
        met = met.where(F.col("fp").isNull() | F.col("need").isNotNull()) if need == window else met
        found.append(_extended(met, size, need))
    every = found[0]
    for rows in found[1:]:
        every = every.unionByName(rows)
    # hits that don't extend to a window are left to the aggregate: a filter on them would be moved below, out of generated
    # code, and every fingerprint would then carry its document's words
    grouped = (
        every
        .groupBy("doc_id", "version")
        .agg(
            F.count("n_words").alias("copies"), F.max("n_words").cast("long").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.size("spans") > 0, F.col("item_ids")))))).alias("items"),
        )
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("upto")),
        lambda s, x: F.struct((s["hit"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["upto"]))).alias("hit"), F.greatest(s["upto"], x["end"]).alias("upto")),
        lambda s: s["hit"],
    )
    counted = grouped.withColumn("n_hit", covered)
    return counted.select(
        "doc_id", "version", "copies", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
