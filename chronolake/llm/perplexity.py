"""Quality rules by n-gram perplexity.

Spark counts the byte n-grams of all documents by language and makes a modified Kneser-Ney model of them: counts for the
longest n-grams, continuation counts below, three discounts for each order. The model is kept as arrays of n-grams, sorted for
binary search. All n-grams that occur are in it, so it grows with the different n-grams of the corpus. A text's measure at an order is
its log-perplexity for each word; each language has a band around the median of each order, and texts outside of one are rejected.
"""

from __future__ import annotations

import json
import mmap
from collections.abc import Iterator, Sequence
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch_path, stored

#: Order of a model that is asked for without one; a code of an n-gram is a long, so orders end at MOST_ORDER.
ORDER, MOST_ORDER = 3, 7
#: Half-width of a band in robust standard deviations, and the least such deviation as a share of the median.
WIDTH, LEAST_SPREAD = 6.0, 0.01
#: Measures are collected in steps of this size to find medians.
STEP = 1 / 512
MIN_WORDS = 50
#: Different grams, over all languages, that a counting task holds.
HELD_GRAMS = 1 << 22
TEXTS = 500
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"


def _codes(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of the texts with a gap before and after each, and where each text's begin."""
    gap = b"\n" * (order - 1)
    data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    size = len(data) - order + 1
    codes = data[:size].astype(np.int64)
    for k in range(1, order):
        codes <<= 8
        codes |= data[k : k + size]
    return codes, np.cumsum([0, *(len(t) + len(gap) for t in texts[:-1])])


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                texts: dict[str, list[bytes]] = {}
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if text:
                        texts.setdefault(lang, []).append(text)
                for lang, own in texts.items():
                    parts = held.setdefault(lang, [])
                    parts.append(np.unique(_codes(own, order)[0], return_counts=True))
                    while len(parts) > 1 and 2 * len(parts[-1][0]) > len(parts[-2][0]):  # so that a gram is merged few times
                        parts.append(_merged(parts.pop(), parts.pop()))
                if sum(len(grams) for parts in held.values() for grams, _ in parts) > HELD_GRAMS:  # a gram may be given out more than once
                    yield from _counted(held)
                    held = {}
        yield from _counted(held)

    return run


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    grams, where = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return grams, np.bincount(where, np.concatenate([a[1], b[1]])).astype(np.int64)


def _counted(held: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    for lang, parts in held.items():
        grams, n = reduce(_merged, reversed(parts))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def _language() -> Column:
    return F.coalesce("lang", F.lit("und"))


def _with_discounts(grams: DataFrame) -> DataFrame:
    """Adds each n-gram's discount: of once, twice and oftener seen ones, from the language's counts of counts."""
    seen = [F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    of = grams.groupBy("lang").agg(*seen)
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    ready = (F.col("n1") > 0) & (F.col("n2") > 0)
    rule = lambda k: F.when(ready & (F.col(f"n{k}") > 0), F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.1)), F.lit(k - 0.1))).otherwise(F.lit(min(0.5 * k, 1.5)))
    of = of.select("lang", *[rule(k).alias(f"d{k}") for k in (1, 2, 3)])
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    return grams.join(F.broadcast(of), "lang").withColumn("cut", cut).select("lang", "gram", "n", "cut")  # a row for each language


def build_model(documents: DataFrame, order: int = ORDER) -> DataFrame:
    """(kind, lang, gram, value): natural logs of probabilities (p1, p2, ...) and of back-off weights (b1, ...) of contexts."""
    if not 1 <= order <= MOST_ORDER:
        raise ValueError(f"the order of a model is from 1 to {MOST_ORDER}, not {order}")
    raw = documents.select(_language().alias("lang"), F.col("text").cast("binary").alias("text")).mapInArrow(_count(order), "lang string, gram long, n long")
    level = {order: stored(raw.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "counts")}
    for k in range(order - 1, 0, -1):  # by how many bytes it is preceded
        level[k] = stored(level[k + 1].groupBy("lang", F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")).agg(F.count("*").alias("n")), "counts")
    out, lower = [], None
    for k in range(1, order + 1):
        own = _with_discounts(level[k]).withColumn("context", F.shiftright("gram", 8)).withColumn("rest", F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1))
        by = Window.partitionBy("lang", "context")  # at most 256 rows
        own = own.withColumn("total", F.sum("n").over(by)).withColumn("free", F.sum("cut").over(by) / F.col("total"))
        if k == 1:
            p = (F.col("n") - F.col("cut")) / F.col("total") + F.col("free") / 256
        else:
            own = own.join(lower.select("lang", F.col("gram").alias("rest"), F.col("p").alias("below")), ["lang", "rest"])
            p = (F.col("n") - F.col("cut")) / F.col("total") + F.col("free") * F.col("below")
            out.append(own.groupBy("lang", F.col("context").alias("gram")).agg(F.log(F.max("free")).alias("value")).select(F.lit(f"b{k - 1}").alias("kind"), "lang", "gram", "value"))
        lower = stored(own.select("lang", "gram", p.alias("p"), "free"), "grams")
        out.append(lower.select(F.lit(f"p{k}").alias("kind"), "lang", "gram", F.log("p").alias("value")))
        if k == 1:
            out.append(lower.groupBy("lang").agg(F.max(F.log(F.col("free") / 256)).alias("value")).select(F.lit("b0").alias("kind"), "lang", F.lit(0).cast("long").alias("gram"), "value"))
    model = out[0]
    for part in out[1:]:
        model = model.unionByName(part)
    return model


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one array as bytes; rows come by kind, language and n-gram."""
    for batch in batches:
        columns = [batch.column(k).dictionary_encode().indices.to_numpy() for k in (0, 1)]
        cut = np.flatnonzero((columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])) + 1
        edges = [0, *cut.tolist(), batch.num_rows] if batch.num_rows else []
        for a, z in zip(edges, edges[1:], strict=False):
            keys, values = batch.column(2).to_numpy()[a:z], batch.column(3).to_numpy()[a:z]
            row = [batch.column(0)[a].as_py(), batch.column(1)[a].as_py(), int(keys[0]), z - a, keys.astype("<i8").tobytes(), values.astype("<f4").tobytes()]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["kind", "lang", "first", "n", "keys", "values"])


def write_model(model: DataFrame) -> str:
    """Writes the sorted arrays as one file, gives it to all executors and returns its name there.

    Tasks sort ranges of n-grams; the driver passes on the bytes of one partition of arrays after the other and holds no more. A footer says where the
    array of each kind and language lies, so that workers map the file and share its pages.
    """
    spark = model.sparkSession
    by = ["kind", "lang", "gram"]
    sorted_ = model.select(*by, F.col("value").cast("float")).repartitionByRange(*by).sortWithinPartitions(*by)
    blocks = stored(sorted_.mapInArrow(_block_rows, "kind string, lang string, first long, n long, keys binary, values binary"), "arrays")
    path = f"{scratch_path(spark, 'kneser-ney')}.bin"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    index: dict[str, list] = {}  # part -> [kind, lang, where it begins, entries]
    at = 0
    for part, width in (("keys", 8), ("values", 4)):
        rows = index[part] = []
        for r in blocks.select("kind", "lang", "first", "n", part).orderBy("kind", "lang", "first").toLocalIterator():
            if not rows or rows[-1][:2] != [r["kind"], r["lang"]]:
                rows.append([r["kind"], r["lang"], at, 0])
            rows[-1][3] += r["n"]
            at += width * r["n"]
            out.write(bytes(r[part]))
    footer = json.dumps(index).encode()
    out.write(footer)
    out.write(len(footer).to_bytes(8, "little"))
    out.close()
    spark.sparkContext.addFile(path)  # a lost executor's successor fetches it again
    return path.rsplit("/", 1)[1]


class Model:
    """The arrays of a model over a memory map of its file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        size = int.from_bytes(self.map[-8:], "little")
        index = json.loads(self.map[-8 - size : -8])
        arrays = {part: {(k, lang): (at, n) for k, lang, at, n in index[part]} for part in ("keys", "values")}
        read = lambda kind, part, key: np.frombuffer(self.map, kind, arrays[part][key][1], arrays[part][key][0])
        self.arrays = {key: (read("<i8", "keys", key), read("<f4", "values", key)) for key in arrays["keys"]}
        self.order = max((int(kind[1:]) for kind, _ in self.arrays if kind[0] == "p"), default=0)

    def find(self, kind: str, lang: str, grams: np.ndarray) -> np.ndarray:
        """Values of the n-grams, NaN where there is none."""
        keys, values = self.arrays.get((kind, lang), (None, None))
        if keys is None:
            return np.full(len(grams), np.nan)
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        return np.where(keys[at] == grams, values[at].astype(float), np.nan)

    def log_probability(self, lang: str, grams: np.ndarray, order: int | None = None) -> np.ndarray:
        """Of the last byte of each n-gram after the others; an unseen context backs off at no cost. The order is the model's unless a lower one is asked for."""
        order = self.order if order is None else order
        if order == 0:
            return np.nan_to_num(self.find("b0", lang, np.zeros(len(grams), np.int64)), nan=-np.log(256))
        found = self.find(f"p{order}", lang, grams)
        lost = np.flatnonzero(np.isnan(found))
        if len(lost):
            rest = grams[lost] & ((1 << 8 * (order - 1)) - 1)
            back = np.nan_to_num(self.find(f"b{order - 1}", lang, grams[lost] >> 8), nan=0.0) if order > 1 else 0.0
            found[lost] = back + self.log_probability(lang, rest, order - 1)
        return found


@cache
def _model(name: str) -> Model:
    return Model(SparkFiles.get(name))


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in repeated 3-word windows)."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) - len(joined.translate(None, bytes(range(0x80, 0xC0)))) if not joined.isascii() else 0
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [s for s in text.split(b"\n") if s.split()]
    again = 0
    if n >= 3:
        number: dict[bytes, int] = {}
        own = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        window = (own[:-2] * len(number) + own[1:-1]) * len(number) + own[2:] if len(number) < 2_000_000 else np.unique(np.stack([own[:-2], own[1:-1], own[2:]]), axis=1, return_inverse=True)[1].ravel()
        _, where, count = np.unique(window, return_inverse=True, return_counts=True)
        many = count[where] > 1
        if many.any():
            hit = np.zeros(n, bool)
            for k in range(3):
                hit[k : n - 2 + k] |= many
            again = int(hit.sum())
    return n, len(joined) - chars, symbols, len(lines) - len(set(lines)), again


def _measure(name: str, orders: Sequence[int]):
    names = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"measure{k}" for k in orders)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(name)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                langs, texts = batch.column(1).to_pylist(), [t or b"" for t in batch.column(2).to_pylist()]
                counts = [base_counts(t) for t in texts]
                measures: dict[int, list[float | None]] = {k: [None] * len(texts) for k in orders}
                for lang in set(langs):
                    own = [k for k, x in enumerate(langs) if x == lang and counts[k][0]]
                    if own:
                        codes, begin = _codes([texts[k] for k in own], max(orders))
                        grams, where = np.unique(codes, return_inverse=True)
                        for order in sorted(orders, reverse=True):
                            grams, up = np.unique(grams & ((1 << 8 * order) - 1), return_inverse=True)
                            where = up[where]
                            total = np.add.reduceat(model.log_probability(lang, grams, order)[where], begin)
                            for k, x in zip(own, total.tolist(), strict=True):
                                measures[order][k] = -x / counts[k][0]
                columns = [pa.array(x, pa.int64()) for x in zip(*counts)] if counts else [pa.array([], pa.int64())] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, *(pa.array(x, pa.float64()) for x in measures.values())], names)

    return run


def _medians(steps: DataFrame) -> DataFrame:
    """(lang, order, mid): the median of `step` by language and order from the counts of its values, which are few."""
    counts = steps.groupBy("lang", "order", "step").agg(F.count("*").alias("n"))
    by = Window.partitionBy("lang", "order")
    upto = F.sum("n").over(by.orderBy("step"))
    halves = counts.withColumn("upto", upto).withColumn("all", F.sum("n").over(by)).where(2 * F.col("upto") >= F.col("all"))
    return halves.groupBy("lang", "order").agg(F.min("step").alias("mid"))


def bands(measured: DataFrame, orders: Sequence[int]) -> DataFrame:
    """(lang, low and high of each order): the median and WIDTH robust deviations to each side, over texts of at least MIN_WORDS words."""
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("order"), F.round(F.col(f"measure{k}") / STEP).cast("long").alias("step")) for k in orders]))
    steps = measured.where((F.col("n_words") >= MIN_WORDS) & F.col(f"measure{orders[0]}").isNotNull()).select("lang", every.alias("_")).select("lang", "_.*")
    middle = _medians(steps)
    off = steps.join(F.broadcast(middle), ["lang", "order"]).select("lang", "order", F.abs(F.col("step") - F.col("mid")).alias("step"))  # a row for each language and order
    spread = _medians(off).withColumnRenamed("mid", "off")
    half = WIDTH * F.greatest(1.4826 * F.col("off"), LEAST_SPREAD * F.col("mid"), F.lit(1.0))
    ends = middle.join(spread, ["lang", "order"]).select("lang", "order", ((F.col("mid") - half) * STEP).alias("low"), ((F.col("mid") + half) * STEP).alias("high"))
    return ends.groupBy("lang").agg(*[F.max(F.when(F.col("order") == k, F.col(end))).alias(f"{end}{k}") for k in orders for end in ("low", "high")])


def rules(documents: DataFrame, orders: Sequence[int] = (ORDER,)) -> DataFrame:
    """documents(doc_id, text, lang) judged by base rules and by the perplexity bands of the language.

    The model is of the greatest of the orders, and each of them has a band: short n-grams tell of spelling, long ones of words and of what
    follows what. Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and measure (log-perplexity
    at the greatest order for each word, null without words). Null and empty texts have no words and fail the base rules. A null language is the
    language "und"; a language none of whose texts has 50 words has no band, and its texts are not rejected by one. Repeated rows
    and null ids are judged one by one and counted each; no rows give no rows; other columns are ignored. Texts are read whole.
    """
    name = write_model(build_model(documents, max(orders)))
    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.select("doc_id", _language().alias("lang"), F.col("text").cast("binary").alias("text"))
    schema = f"doc_id {kind}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long" + "".join(f", measure{k} double" for k in orders)
    measured = stored(texts.mapInArrow(_measure(name, orders), schema), "measures")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = reduce(Column.__and__, [F.coalesce(F.col(f"measure{k}").between(F.col(f"low{k}"), F.col(f"high{k}")), F.lit(True)) for k in orders])
    judged = measured.join(F.broadcast(bands(measured, orders)), "lang", "left").withColumn("base_failed", failed)  # a row for each language
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"), F.col(f"measure{max(orders)}").alias("measure"))
