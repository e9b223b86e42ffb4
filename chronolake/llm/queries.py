"""The registered queries of the training-data operators, with their oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import bpe, filter_audit, html_paths, minhash, perplexity, quality_gam, simhash, suffix_array, toxicity, url_filter, wavelet, whitening, winnow
from .common import read, scratch_path

#: The rules of the url query: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_paths.extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), threshold=85)


def op4_factorization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "shards")
    wavelet.write_shards(read(spark, sf_dir, "documents"), path, tokenizer("byte_bpe_50k.json"))
    ids = F.col("ids")
    return wavelet.read_documents(spark, path, n_tokens=(F.octet_length(ids) / 4).cast("long"), ids_crc32=F.crc32(ids))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(read(spark, sf_dir, "pages"), rules)


def op8_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.rules(read(spark, sf_dir, "documents"), orders=range(2, 6))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = suffix_array.remove_repeats(read(spark, sf_dir, "documents"))
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_bytes")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_tag_paths, op3_minhash, op4_factorization, op5_additive, op6_wavelet, op7_url_filter, op8_perplexity, op9_winnowing, op10_suffix_array, op11_filter_audit, op12_simhash, op13_whitening)}

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLE_SQL = {
    "op3_minhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT both_ways.b, r.root FROM r JOIN both_ways ON both_ways.a = r.id AND r.root < both_ways.b)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.root AS component_id, doc_id = m.root AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(root) AS root FROM r GROUP BY id) m ON m.id = doc_id
""",
    "op7_url_filter": f"""
WITH rules(rh, rp, rv) AS (VALUES {_RULE_ROWS}),
cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM cut),
fits AS (SELECT p.page_id, rh || rp AS rule, rv, row_number() OVER (PARTITION BY p.page_id ORDER BY length(rh || rp) DESC, length(rh) DESC) AS r
  FROM parts p JOIN rules ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.rv, 'allow') AS verdict FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.r = 1
""",
    "op9_winnowing": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{0080}-\x{10FFFF}]+') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{0080}-\x{10FFFF}]+') AS w FROM benchmark),
bg AS (SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM bw WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bg),
dg AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, ms WHERE len(w) >= m)),
hits AS (SELECT d.doc_id, d.i, d.m, b.item_id FROM dg d JOIN bg b ON d.m = b.m AND d.g = b.g),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hits)) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
""",
    "op11_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
    + 4 * CAST(100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 2 * length(d.t) AS INT) + 8 * CAST(regexp_matches(d.t, '[#$%&*|]') AS INT)
    + 16 * CAST(d.doc_id > first_id AS INT) AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d JOIN firsts ON d.t = firsts.t LEFT JOIN l ON l.doc_id = d.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, CAST(1 << (ascii(substr(filter_order, step, 1)) - 65) AS INT) AS bit,
    CAST(coalesce(list_sum([1 << (ascii(x) - 65) FOR x IN string_split(substr(filter_order, 1, step - 1), '') IF x <> '']), 0) AS INT) AS before
  FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)),
found AS (SELECT part, filter_order, step, letter,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM found
""",
}
