"""URL filters: rules on hosts and paths, and gradient-boosted trees on lexical features for urls that no rule names.

The trees learn from urls whose label is known (here: those that a rule
decides). They see no host names, only lengths, depth, digits, entropy,
parameters and statistics of suffixes, which a fold of their own provides.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, forget

#: (verdict, host, path) rules of the query; a rule is written host + path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Labelled urls that one task holds while the trees are fitted, about.
PER_TASK = 50_000
#: Labelled urls that a suffix needs for a statistic of its own, and the weight of the common rate beside it.
MIN_URLS, WEIGHT = 5, 4.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SUFFIXES = ("last", "last_section", "two", "two_section")
LEXICAL = ("length", "host_length", "path_length", "labels", "depth", "digits", "entropy", "parameters", "marks")
FEATURES = [*LEXICAL, *(f"rate_{s}" for s in SUFFIXES), *(f"known_{s}" for s in SUFFIXES)]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first `://`, A-Z in lower case) and path; both empty without `://` or for null."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits host (or a host above it) and the path's start, as text, and its verdict; nulls if none does. Of equally long ones the least by text."""
    rule = verdict = F.lit(None).cast("string")
    for said, own, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        rule, verdict = F.when(fits, own + start).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits a character: runs of the sorted characters give their counts, so a long text costs no more than its sorting."""
    chars = F.array_sort(F.split(text, ""))
    n = F.greatest(F.size(chars), F.lit(1)).cast("double")
    term = lambda k: F.when(k > 0, k * F.log2(F.greatest(k, F.lit(1.0)))).otherwise(0.0)
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("k"), F.lit(0.0).alias("sum"))

    def step(acc, c):
        same = acc["c"] == c
        return F.struct(c.alias("c"), F.when(same, acc["k"] + 1).otherwise(1.0).alias("k"), F.when(same, acc["sum"]).otherwise(acc["sum"] + term(acc["k"])).alias("sum"))

    return F.log2(n) - F.aggregate(chars, start, step, lambda acc: acc["sum"] + term(acc["k"])) / n


def with_lexical(urls: DataFrame) -> DataFrame:
    """urls (url, host, path, any others) with the lexical features and the suffixes, nulls as empty texts."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    count = lambda text, of: (F.length(text) - F.length(F.translate(text, of, ""))).cast("double")
    length = F.length(url).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    section = F.regexp_extract(path, "^/[^/]*", 0)
    last, two = F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)
    lexical = {
        "length": length, "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"), "labels": count(host, "."), "depth": count(path, "/"),
        "digits": count(url, "0123456789") / F.greatest(length, F.lit(1.0)), "entropy": entropy(url), "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1), "marks": count(url, "-_%@~") + count(url, "#"),
    }
    return urls.withColumns(lexical | {"last": last, "last_section": F.concat(last, section), "two": two, "two_section": F.concat(two, section)})


class Model(NamedTuple):
    """The common share of blocked urls, suffix statistics and trees (none without two classes)."""

    prior: float
    suffixes: DataFrame
    trees: GBTClassificationModel | None


def with_suffix_rates(urls: DataFrame, suffixes: DataFrame, prior: float) -> DataFrame:
    """Smoothed share of blocked urls and the logarithm of how many are known, per suffix; unknown ones have the common share.

    suffixes may grow with the labelled urls, so Spark chooses the join by its size.
    """
    for s in SUFFIXES:
        own = suffixes.where(F.col("kind") == s).select(F.col("suffix").alias(s), (F.col("blocked") + WEIGHT * prior) / (F.col("n") + WEIGHT), F.log1p("n"))
        urls = urls.join(own.toDF(s, f"rate_{s}", f"known_{s}"), s, "left").fillna({f"rate_{s}": prior, f"known_{s}": 0.0})
    return urls


def fold(url: Column) -> Column:
    """0: held out, 1 and 2: suffix statistics, 3 to 9: trees; by the url alone, so that copies share a fold."""
    return F.pmod(F.xxhash64(F.lit("fold"), url), F.lit(10))


def train(labelled: DataFrame, per_class: int | None = None) -> Model:
    """labelled: url, host, path, blocked (0 or 1), null urls left out; learns from distinct urls that are not held out.

    All of them are learned from; with per_class only about so many of a class, those of
    smallest hash. With one class every score is its own; without
    labelled urls none is blocked.
    """
    usable = labelled.where(F.col("url").isNotNull() & (fold(F.col("url")) > 0)).select("url", "host", "path", F.col("blocked").cast("double").alias("blocked"))
    sizes = {r["blocked"]: r["n"] for r in usable.groupBy("blocked").agg(F.count("*").alias("n")).collect()}
    share = F.shiftrightunsigned(F.xxhash64("url"), 1) / float(2**63)
    chosen = F.lit(per_class is None)
    for blocked, n in sizes.items() if per_class else ():
        chosen |= (F.col("blocked") == blocked) & (share < per_class / n)
    tasks = max(8, -(-sum(sizes.values()) // PER_TASK))
    sample = cut(with_lexical(usable.where(chosen).dropDuplicates(["url"])).withColumn("fold", fold(F.col("url"))).repartition(tasks, "url").sortWithinPartitions("url"), "urls")
    seen = sample.where("fold < 3")
    prior = seen.agg(F.avg("blocked")).first()[0]
    prior = prior if prior is not None else float(min(sizes, default=0))
    keys = F.explode(F.array(*[F.struct(F.lit(s).alias("kind"), F.col(s).alias("suffix")) for s in SUFFIXES])).alias("k")
    suffixes = cut(seen.select("blocked", keys).groupBy("k.kind", "k.suffix").agg(F.count("*").alias("n"), F.sum("blocked").alias("blocked")).where(F.col("n") >= MIN_URLS), "suffixes")
    trees = None
    rows = assembled(with_suffix_rates(sample.where("fold >= 3"), suffixes, prior))
    if len(sizes) == 2 and rows.select("blocked").distinct().count() == 2:
        trees = GBTClassifier(featuresCol="features", labelCol="blocked", maxIter=20, maxDepth=4, stepSize=0.2, minInstancesPerNode=5, seed=7).fit(rows)
    elif sizes:
        prior = float(max(sizes, key=sizes.get))
    forget(sample)
    return Model(prior, suffixes, trees)


def assembled(urls: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(urls)


def score(urls: DataFrame, model: Model) -> DataFrame:
    """urls (url, host, path, any others) with score, 0 to 1, higher: likelier blocked; no exchange while the suffix table is small enough to broadcast."""
    own = urls.columns
    if model.trees is None:
        return urls.withColumn("score", F.lit(model.prior))
    rows = model.trees.transform(assembled(with_suffix_rates(with_lexical(urls), model.suffixes, model.prior)))
    return rows.select(*own, vector_to_array("probability")[1].alias("score"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.5, per_class: int | None = None) -> DataFrame:
    """Per row of pages: page_id, host, path, rule (longest that fits, or null), verdict (its own, else by score >= threshold), score, held_out.

    Urls that a rule decides are the labelled ones. A null url or one without `://`
    has an empty host and path, fits no rule and is judged by the trees; repeated rows
    are returned each; rows without page_id are left out; other columns are ignored; an
    empty table gives no rows.
    """
    host, path = parts(F.col("url"))
    urls = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"))
    rule, said = ruled(F.col("host"), F.col("path"), rules)
    urls = urls.select("*", rule.alias("rule"), said.alias("said"))
    labelled = urls.where("said is not null").select("url", "host", "path", (F.col("said") == "block").cast("int").alias("blocked"))
    scored = score(urls, train(labelled, per_class))
    by_trees = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", by_trees).alias("verdict"), "score", F.coalesce(fold(F.col("url")) == 0, F.lit(False)).alias("held_out"))
