"""URL allow and block lists by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

PREFIX_HEX = 8  # joined on: the first 32 bits of a SHA-256
DEFAULT_VERDICT = "allow"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path. Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; path: from there up to ``?``, ``#`` or the end. Both are empty for a null url
    and one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", ""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.split(host, "[.]")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Every row of ``pages`` with host, path, rule and verdict.

    ``rules`` has host, path and action (allow or block). A rule fits its host and all
    subdomains when the url's path starts with the rule's path. The longest rule wins; of
    equally long ones that with the longer host, then block before allow, then the greater
    string. Without a rule the verdict is allow, also for null urls. Repeated rows of pages stay
    repeated; columns of pages that are named like an output are replaced.

    Each distinct (host, path) expands into the suffix and prefix shapes that the rules have:
    (labels, path characters), a set bounded by the rules' own label counts and path lengths.
    Expressions meet rules by the first 32 bits of their SHA-256, then the whole digest decides.
    Repeated urls collapse before the shuffle. Spark broadcasts the rules if their size allows.
    """
    host, path = url_parts(F.col(url))
    made = ("host", "path", "rule", "verdict")
    kept = pages.drop(*[c for c in made if c != url]) if url not in made else pages
    kept = kept.withColumns({"host": host, "path": path})
    listed = rules.where("host is not null and host <> ''").select(
        F.translate("host", UPPER, LOWER).alias("rule_host"),
        F.coalesce("path", F.lit("")).alias("rule_path"),
        "action",
    )
    shapes = (
        listed.select(
            F.size(_labels(F.col("rule_host"))).alias("labels"),
            F.length("rule_path").alias("chars"),
        )
        .distinct()
        .sort("labels", "chars")
        .collect()
    )
    own = listed.select(
        F.concat("rule_host", "rule_path").alias("rule"),
        "action",
        F.length("rule_host").alias("host_chars"),
    ).withColumn("rule_digest", F.sha2("rule", 256))
    own = own.withColumn("short", F.substring("rule_digest", 1, PREFIX_HEX))
    n, p = F.size("labels"), F.col("path")
    expressions = [
        F.when(
            (n >= s.labels) & (F.length(p) >= s.chars),
            F.concat(
                F.array_join(F.slice("labels", n - s.labels + 1, s.labels), "."),
                F.substring(p, 1, s.chars),
            ),
        )
        for s in shapes
    ] or [F.lit(None).cast("string")]
    expanded = (
        kept.select("host", "path")
        .distinct()
        .withColumn("labels", _labels(F.col("host")))
        .select("host", "path", F.explode(F.array_compact(F.array(*expressions))).alias("e"))
        .withColumn("digest", F.sha2("e", 256))
        .withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    )
    best = (
        expanded.join(own, "short")
        .where("digest = rule_digest")
        .groupBy("host", "path")
        .agg(
            F.max(
                F.struct(
                    F.length("rule").alias("chars"),
                    "host_chars",
                    (F.col("action") == "block").alias("blocks"),
                    "rule",
                )
            ).alias("_best")
        )
    )
    verdict = F.when(F.col("_best").isNull(), DEFAULT_VERDICT).otherwise(
        F.when(F.col("_best.blocks"), "block").otherwise("allow")
    )
    return (
        kept.join(best, ["host", "path"], "left")
        .withColumns({"rule": F.col("_best.rule"), "verdict": verdict})
        .drop("_best")
    )
