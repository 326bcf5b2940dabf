"""URL filters: listed rules, and association rules mined by FP-growth from URLs whose verdict is known.

A URL is a set of tokens: words of its host, path, query and fragment, each with the part it stands in.  FP-growth finds
the token sets that are frequent together with a verdict; those of enough confidence become rules, without those that a
smaller set makes as surely.  An inverted index holds each rule under its rarest token; a URL meets the rules under its
tokens and takes the surest one it holds whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import kept_columns
from tidemark.llm.hot import most_of, spread_join
from tidemark.llm.storage import partitions, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: scheme, host, path, query and fragment of a URL that holds "://".
PARTS = r"([^/?#]*?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?"
PUNCTUATION = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MIN_SUPPORT = 0.02
MIN_CONFIDENCE = 0.75


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains and the paths that start with one path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host(url: Column) -> Column:
    """What follows the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; '' without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(of_host: Column, of_path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule's text and verdict as a struct, null where none fits."""
    found = F.lit(None).cast("struct<text: string, verdict: string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((of_host == rule.host) | of_host.endswith("." + rule.host)) & of_path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _named(part: str) -> Callable[[Column], Column]:
    return lambda word: F.concat(F.lit(f"{part}:"), F.when(word.rlike("^[0-9]+$"), F.lit("#")).otherwise(word))


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL, sorted: s: scheme, h: host, p: path, q: query and f: fragment words; numbers are one word, #."""
    words = []
    for k, part in enumerate("shpqf", 1):
        spelt = F.split(F.translate(F.coalesce(F.regexp_extract(url, PARTS, k), F.lit("")), UPPER, LOWER), PUNCTUATION)
        words.append(F.transform(F.filter(spelt, lambda w: w != ""), _named(part)))
    return F.array_sort(F.array_distinct(F.concat(*words)))


def mined_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(antecedent, verdict, confidence, support, anchor) from rows of tokens and verdict.

    Rows without a verdict don't count; without any row there is no rule.  The support of a rule is the share of all
    rows that hold its tokens and its verdict.  A rule goes if leaving out one of its tokens gives one as sure.  The
    anchor is its rarest token, of equally rare ones the first.
    """
    labelled = labelled.where("verdict is not null").select("verdict", F.concat(F.array(F.concat(F.lit("="), "verdict")), "tokens").alias("items"))
    spark = labelled.sparkSession
    if labelled.isEmpty():
        return spark.createDataFrame([], "antecedent array<string>, verdict string, confidence double, support double, anchor string")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=partitions(spark)).fit(labelled)
    sets = written(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "frequent-sets")
    rules = model.associationRules.where(F.element_at("consequent", 1).startswith("="))
    rules = rules.select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.element_at("consequent", 1), 2, 1 << 30).alias("verdict"), "confidence", "support")
    rules = written(rules, "association-rules")
    less = rules.select("verdict", "confidence", "antecedent", F.explode(F.transform("antecedent", lambda t: F.array_remove("antecedent", t))).alias("smaller"))
    sure = rules.select("verdict", F.col("antecedent").alias("smaller"), F.col("confidence").alias("as_sure"))
    idle = less.join(sure, ["verdict", "smaller"]).where("as_sure >= confidence").select("verdict", "antecedent").distinct()
    kept = rules.join(idle, ["verdict", "antecedent"], "left_anti")
    single = sets.where("size(items) = 1").select(F.element_at("items", 1).alias("token"), "freq")
    rarest = kept.select("verdict", "antecedent", F.explode("antecedent").alias("token")).join(single, "token")
    rarest = rarest.groupBy("verdict", "antecedent").agg(F.min(F.struct("freq", "token"))["token"].alias("anchor"))
    return written(kept.join(rarest, ["verdict", "antecedent"]).select("antecedent", "verdict", "confidence", "support", "anchor"), "url-rules")


def matched(rows: DataFrame, rules: DataFrame, tokens: str) -> DataFrame:
    """rows and the surest rule each holds: mined (its text), mined_verdict and mined_confidence, null without one.

    Of equally sure rules the one of more support counts, then of fewer tokens, then the first by text.  Tokens of no
    rule are left out first, and the sets of tokens that stay are matched once each.  A token of a rule stands in at
    least min_support of the labelled rows, so there are at most their mean number of tokens / min_support of them.
    """
    known = sorted(r[0] for r in rules.select(F.explode("antecedent")).distinct().collect())
    rows = rows.withColumn("__set", F.array_intersect(tokens, F.lit(known) if known else F.array().cast("array<string>")))
    sets = rows.select("__set").distinct().where(F.size("__set") > 0)
    met = sets.withColumn("anchor", F.explode("__set")).join(rules, "anchor").where(F.size(F.array_except("antecedent", "__set")) == 0)
    order = F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.size("antecedent").alias("n"), F.array_join("antecedent", " ").alias("text"), "verdict")
    best = met.groupBy("__set").agg(F.min(order).alias("b"))
    best = best.select("__set", F.col("b.text").alias("mined"), F.col("b.verdict").alias("mined_verdict"), (-F.col("b.c")).alias("mined_confidence"))
    most, n = most_of(rows, "__set")
    return spread_join(rows.withColumn("__row", F.monotonically_increasing_id()), best, ["__set"], "__row", most, n, "left").drop("__set", "__row")


def judged(urls: DataFrame, rules: Sequence[Rule], min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, default: str = "allow") -> DataFrame:
    """Adds host, path, rule, verdict, mined and mined_confidence to rows with a url.

    URLs that a listed rule fits have its verdict and are what FP-growth learns from; the others get the verdict of the
    surest mined rule they hold, or `default`.  A null url, or one without "://", has an empty host and path and no
    tokens.  Repeated rows and urls get equal verdicts and count each in the supports, an empty table stays empty, and
    input columns named like the added ones are replaced.
    """
    added = ["host", "path", "rule", "verdict", "mined", "mined_confidence"]
    keep = kept_columns(urls, added)
    url = F.col("url")
    rows = urls.select(*keep, host(url).alias("host"), path(url).alias("path"), tokens(url).alias("__tokens"))
    rows = rows.withColumn("__listed", listed(F.col("host"), F.col("path"), rules))
    learnt = mined_rules(rows.select(F.col("__listed.verdict").alias("verdict"), F.col("__tokens").alias("tokens")), min_support, min_confidence)
    unlisted = F.when(F.col("__listed").isNull(), F.col("__tokens")).otherwise(F.array().cast("array<string>"))
    found = matched(rows.withColumn("__unlisted", unlisted), learnt, "__unlisted")
    verdict = F.coalesce("__listed.verdict", "mined_verdict", F.lit(default))
    return found.select(*keep, "host", "path", F.col("__listed.text").alias("rule"), verdict.alias("verdict"), "mined", "mined_confidence")
