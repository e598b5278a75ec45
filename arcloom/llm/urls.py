"""Allowing and blocking urls: given rules first, mined association rules for the rest.

Given rules name a host and the start of a path. Mined rules come from labelled
pages: frequent combinations of url tokens are found by FP-growth with the label as
one more token, and combinations that imply the label often and clearly enough
become rules. Both kinds are matched by lookup: a url's host suffixes are joined to
the hosts of the rules, and its tokens to each mined rule's rarest token.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.llm.common import lower_ascii
from arcloom.operators.sizing import is_small, sized
from arcloom.session import scratch_path

BLOCK = "label=block"
# The rules of the house. (Fixed by contract.)
RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/ ? #``, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ``? #``; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """``(rule, rule_host, rule_path, verdict)``; a rule is cut at its first slash."""
    cut = [(r, r.split("/", 1)[0].lower(), "/" + r.split("/", 1)[1] if "/" in r else "", v) for r, v in rules]
    return spark.createDataFrame(cut, "rule string, rule_host string, rule_path string, verdict string")


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a url: scheme, host labels and host, path segments, query keys.

    Digits within a segment are written as ``0``, so that numbers do not make every
    url unlike all others.
    """
    scheme = F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))))
    host = url_host(url)
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("label:"), x))
    segments = F.transform(
        F.filter(F.split(url_path(url), "/"), lambda x: x != ""),
        lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "0")),
    )
    keys = F.transform(
        F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != ""),
        lambda x: F.concat(F.lit("key:"), F.split(x, "=")[0]),
    )
    made = F.array_distinct(F.concat(scheme, F.array(F.concat(F.lit("host="), host)), labels, segments, keys))
    return F.coalesce(made, F.array().cast("array<string>"))


@dataclass(frozen=True)
class RuleMiner:
    """Which combinations become rules.

    ``at_least`` is the smallest number of blocked pages behind a rule, at any number of
    pages; a ``support`` above 0 also asks for that share of all pages. ``confidence``
    prunes as in FP-growth; ``lift`` is how many times the overall share of blocked pages
    a rule must reach, or half the way from that share to 1 if that is less, so that it
    can be reached where most pages are blocked.
    """

    support: float = 0.0
    confidence: float = 0.6
    lift: float = 2.0
    at_least: int = 10

    def mine(self, pages: DataFrame) -> DataFrame:
        """``(tokens, confidence, n_blocked)`` from ``pages (url, blocked boolean)``.

        All labelled pages count; a null url has no tokens, a null label is passed over.
        No labelled page, or none that is blocked, gives no rule. Rules that add tokens
        to another without being surer are dropped.
        """
        spark = pages.sparkSession
        path = scratch_path(spark, "baskets")
        tokens = url_tokens(F.col("url"))
        (
            pages.where("blocked is not null")
            .select(F.when(F.col("blocked"), F.array_append(tokens, BLOCK)).otherwise(tokens).alias("items"), "blocked")
            .write.parquet(path)
        )
        baskets = spark.read.parquet(path)
        n, blocked = baskets.agg(F.count("*"), F.coalesce(F.sum(F.col("blocked").cast("int")), F.lit(0))).first()
        none = spark.createDataFrame([], "tokens array<string>, confidence double, n_blocked bigint")
        if not blocked:
            return none
        share = blocked / n
        model = FPGrowth(
            itemsCol="items", minSupport=max(self.support, self.at_least / n), minConfidence=self.confidence
        ).fit(baskets.select("items"))
        found = model.associationRules.where(F.array_contains("consequent", BLOCK))
        found = found.select(
            F.array_sort("antecedent").alias("tokens"),
            "confidence",
            F.round(F.col("support") * n).cast("bigint").alias("n_blocked"),
        ).where(F.col("confidence") >= min(self.lift * share, (1 + share) / 2))
        path = scratch_path(spark, "rules")
        found.write.parquet(path)
        found = spark.read.parquet(path)
        # A rule is needless if one with a single token less is as sure.
        shorter = found.select(F.col("tokens").alias("part"), F.col("confidence").alias("part_confidence"))
        drops = found.select("tokens", "confidence", F.posexplode("tokens").alias("at", "token")).withColumn(
            "part", F.array_remove("tokens", F.col("token"))
        )
        needless = drops.join(shorter, "part").where("part_confidence >= confidence").select("tokens").distinct()
        return found.join(needless, "tokens", "left_anti").select("tokens", "confidence", "n_blocked")


def match_mined(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct ``url`` of ``urls (url)`` that contain all tokens of a rule of ``rules (tokens, ..)``.

    Inverted index: a rule is listed under the one of its tokens that the fewest rules
    have, so that common tokens lead to few rules.
    """
    named = rules.select("tokens").distinct()
    listed = named.select("tokens", F.explode("tokens").alias("token"))
    often = listed.groupBy("token").agg(F.count("*").alias("n"))
    index = listed.join(often, "token").groupBy("tokens").agg(F.min(F.struct("n", "token")).alias("best")).select(
        F.col("best.token").alias("token"), F.col("tokens").alias("rule_tokens")
    )
    asked = urls.select("url", url_tokens(F.col("url")).alias("tokens"))
    return (
        asked.select("url", "tokens", F.explode("tokens").alias("token"))
        .join(sized(index, is_small(index)), "token")
        .where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
        .select("url").distinct()
    )


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(url, rule, verdict)``: for each of ``urls (url)`` that a rule fits, the longest such rule.

    A rule fits its host and all subdomains, if the url's path starts with the rule's.
    Of equally long rules the first in alphabetical order wins.
    """
    parts = F.split(F.col("host"), r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )
    return (
        urls.select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
        .select("url", "path", F.explode(suffixes).alias("rule_host"))
        .join(sized(rules, is_small(rules)), "rule_host")
        .where(F.col("path").startswith(F.col("rule_path")))
        .groupBy("url")
        .agg(F.min(F.struct((-F.length("rule")).alias("len"), "rule", "verdict")).alias("best"))
        .select("url", "best.rule", "best.verdict")
    )


def judge(pages: DataFrame, rules: DataFrame, mined: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for each row of ``pages (page_id, url)``.

    The longest fitting rule decides; without one, a url that a mined rule matches is
    blocked and any other allowed. Verdicts are found once per distinct url; a null
    url has an empty host and path, no rule, and is allowed.
    """
    urls = pages.where("url is not null").select("url").distinct()
    given = match_rules(urls, rules)
    blocked = match_mined(urls, mined).select("url", F.lit("block").alias("mined"))
    path = scratch_path(pages.sparkSession, "verdicts")
    given.join(blocked, "url", "full").write.parquet(path)
    verdicts = pages.sparkSession.read.parquet(path)
    return pages.select(F.col(id_col).alias("page_id"), "url").join(verdicts, "url", "left").select(
        "page_id",
        url_host(F.col("url")).alias("host"),
        url_path(F.col("url")).alias("path"),
        "rule",
        F.coalesce("verdict", "mined", F.lit("allow")).alias("verdict"),
    )
