"""URL filter: host-suffix and path-prefix expressions joined with rules on short hash prefixes.

Each URL is expanded into every host suffix (cut at dots) crossed with every path prefix (cut after slashes), as deep as
the rules go. Expressions meet rules in an equi-join on the first four bytes of their SHA-256 digests; full digests,
host and path then confirm a fit, and the longest rule wins. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, repeat_rows

#: Rules up to this number are broadcast (under 20 MB with their digests); beyond, the join shuffles and AQE splits hot keys.
BROADCAST_RULES = 100_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first :// up to /, ?, # or the end, A-Z lower-cased; path then up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw_host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return F.translate(raw_host, UPPER, UPPER.lower()), path


def _digest(host: Column, folder: Column) -> Column:
    return F.sha2(F.concat(host, F.lit(" "), folder), 256)


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages(page_id, url) judged by rules(host, path, verdict).

    Returns page_id, host, path, rule (host and path of the rule that won, else null), verdict. The rule with the most
    characters wins; ties go to the longer host, then to the verdict that sorts first. A null URL or one without `://` has
    an empty host and path and gets the default. Repeated rows and null ids are judged and returned one by one; no rows give
    no rows; columns of pages other than the two are ignored.
    """
    folder = F.regexp_extract(F.col("r_path"), r"^(.*/)?", 0)
    keyed = (
        rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
        .where(F.col("r_host").isNotNull() & F.col("r_path").isNotNull())
        .distinct()
        .withColumn("r_digest", _digest(F.col("r_host"), folder))
        .withColumn("short", _short(F.col("r_digest")))
    )
    limits = keyed.agg(
        F.count("*").alias("n"),
        F.max(F.size(F.split("r_host", r"\."))).alias("labels"),
        F.max(F.size(F.split("r_path", "/", -1)) - 1).alias("slashes"),
    ).first()
    labels, slashes = limits.labels or 0, limits.slashes or 0
    if limits.n <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)

    host, path = url_parts(F.col("_url"))
    parsed = pages.select(F.col("page_id"), F.col("url").alias("_url")).select("page_id", "_url", host.alias("host"), path.alias("path"))
    host_labels, path_parts = F.split("host", r"\."), F.split("path", "/", -1)
    n = F.size("host_labels")
    # suffixes of at most as many labels, prefixes of at most as many slashes, as any rule has
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), n - labels + 1), n), lambda i: F.array_join(F.slice(F.col("host_labels"), i, n), "."))
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.lit(slashes), F.size("path_parts") - 1)), lambda i: F.array_join(F.transform(F.slice(F.col("path_parts"), 1, i), lambda p: F.concat(p, F.lit("/"))), ""))
    expressions = (
        parsed.withColumn("host_labels", host_labels)
        .withColumn("path_parts", path_parts)
        .withColumn("suffixes", suffixes)
        .withColumn("prefixes", prefixes)
        .withColumn("expressions", F.flatten(F.transform("suffixes", lambda h: F.transform(F.col("prefixes"), lambda p: _digest(h, p)))))
        # a null stands for the URL itself, so that URLs without any fit stay
        .select("page_id", "_url", "host", "path", F.explode_outer(F.concat(F.array(F.lit(None).cast("string")), "expressions")).alias("digest"))
        .withColumn("short", _short(F.col("digest")))
    )
    fits = F.col("digest").eqNullSafe(F.col("r_digest")) & F.col("path").startswith(F.col("r_path"))
    rule = F.when(fits, F.struct(
        F.length(F.concat("r_host", "r_path")).alias("size"), F.length("r_host").alias("host_size"),
        (F.col("r_verdict") != "allow").cast("int").alias("not_allow"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"),
    ))
    best = F.max_by("candidate", F.struct("candidate.size", "candidate.host_size", -F.col("candidate.not_allow"), "candidate.rule"))
    judged = (
        expressions.join(keyed, "short", "left")
        .select("page_id", "_url", "host", "path", F.col("digest").isNull().cast("long").alias("row"), rule.alias("candidate"))
        .where((F.col("row") == 1) | F.col("candidate").isNotNull())
        .groupBy("page_id", "_url", "host", "path")
        .agg(F.sum("row").alias("copies"), best.alias("best"))
    )
    return repeat_rows(judged, "copies").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
